"""Line dedup: lines whose key stands in many documents are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Keys with at least 1/HEAVY_SHARE of all repeated lines are joined by broadcast: there are HEAVY_SHARE of them at most,
#: whatever the input. Every other key has too few lines to burden the task that its shuffle join meets it in.
HEAVY_SHARE = 10_000


def line_key(line: Column) -> Column:
    return C.ascii_lower(F.btrim(line, F.lit(C.SPACE)))


def _keyed(df: DataFrame) -> DataFrame:
    """A 96-bit key from the line's text."""
    return df.select("*", F.xxhash64("_key").alias("_h1"), F.hash("_key").alias("_h2"))


def frequent_keys(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(_h1, _h2, _n) of the keys in min_docs rows or more. docs: _text. Counts are partial before the shuffle."""
    keys = docs.select(F.explode(F.array_distinct(F.transform(F.split("_text", "\n"), line_key))).alias("_key"))
    keys = keys.where(F.length("_key") >= min_chars)
    return _keyed(keys).groupBy("_h1", "_h2").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_docs)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with every line dropped whose key stands in min_docs documents or more.

    A key is the line without the white space at its ends and with A-Z in lower case; keys under min_chars code points
    always stay. Each row is one document: a repeated row counts again. Returns the columns of docs under their own
    names in `row`, and n_lines, n_dropped, kept (the text that stays).

    Null or empty text: one empty line, which stays. A text of which every line goes becomes empty. Null ids are
    ids like others. An empty table gives an empty table. Names in docs can't clash: they stay inside `row`.
    """
    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), C.text_of(text_col).alias("_text"))
    src = src.withColumn("_th", F.xxhash64("_text"))
    frequent = C.written(frequent_keys(src, min_docs, min_chars), "lines")
    total = frequent.agg(F.sum("_n")).first()[0] or 0
    heavy = F.col("_n") * HEAVY_SHARE >= total

    spots = src.select("_id", "_th", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
    spots = _keyed(spots.select("_id", "_th", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_chars))
    spots = spots.select("_id", "_th", "_pos", "_h1", "_h2")
    hot = F.broadcast(frequent.where(heavy).select("_h1", "_h2", F.lit(True).alias("_hot")))
    flagged = spots.join(hot, ["_h1", "_h2"], "left")
    # Heavy lines are settled; they pass the shuffle join under keys of their own, which spread them and match nothing.
    settled = F.col("_hot").isNotNull()
    flagged = flagged.select("_id", "_th", "_pos", "_hot", F.when(settled, F.xxhash64("_id", "_th", "_pos")).otherwise(F.col("_h1")).alias("_k1"), F.when(~settled, F.col("_h2")).alias("_k2"))
    light = frequent.where(~heavy).select(F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"), F.lit(True).alias("_light"))
    gone = flagged.join(light, ["_k1", "_k2"], "left").where("_hot OR _light").select("_id", "_th", "_pos")
    gone = gone.groupBy(F.col("_id").alias("_id2"), F.col("_th").alias("_th2")).agg(F.collect_set("_pos").alias("_gone"))

    joined = src.join(gone, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    lines = joined.select("row", F.split("_text", "\n").alias("_lines"), F.coalesce("_gone", F.expr("array()").cast("array<int>")).alias("_gone"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return lines.select(
        "row",
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
        F.when(F.size("_gone") == 0, F.array_join("_lines", "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i + 1)), "\n")).alias("kept"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
