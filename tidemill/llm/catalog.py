"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, jaccard, licenses, lines, lm, mixing, packing, quality, redirects, toxicity

QUERIES = {
    "op1_order_minhash": fingerprints.op1_order_minhash,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_packing": packing.op5_packing,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_lattice_scores": lm.op7_lattice_scores,
    "op8_redirect_classes": redirects.op8_redirect_classes,
    "op9_quality_forest": quality.op9_quality_forest,
    "op10_noisy_channel_toxicity": toxicity.op10_noisy_channel_toxicity,
}

SQL = {
    "op2_source_mixing": mixing.OP2_SQL,
    "op3_ngram_jaccard_join": jaccard.OP3_SQL,
    "op6_line_dedup": lines.OP6_SQL,
}
