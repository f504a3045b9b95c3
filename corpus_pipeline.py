"""A training corpus from documents: quality rules, line dedup, near-duplicate classes, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives the next one's docs; run() writes each stage's rows to the shared
folder and reads them again. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import common as C
from tidemill.llm import jaccard, lines, mixing, packing, quality


def _keyed(docs: DataFrame) -> DataFrame:
    """docs as `row`, with its id and a hash of its text."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(C.text_of("text")).alias("_th"))


def _same(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins on _id and _th; ids may be null."""
    other = other.withColumnsRenamed({"_id": "_id2", "_th": "_th2"})
    return df.join(other, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), how)


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor the forest reject. Length alone rejects none here, as short documents are
    clean more often than not; over half of the words in repeated windows reject one of 50 words or more. Null texts
    and others without words go; null ids are judged as others. Repeated rows go or stay together, ties of the score
    with the threshold stay, and an empty table gives an empty one."""
    verdicts = quality.judge(docs, C.read(spark, sf_dir, "labels"), min_words=1, repeats_from=50)
    gone = verdicts.where("NOT kept").select("_id", "_th").distinct()
    return _same(_keyed(docs), gone, "left_anti").select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more rows share, with n_chars of what stays. Null texts stay null, and a
    document of which no line stays is kept, empty. Repeated rows count as documents of their own; an empty table gives
    an empty one."""
    out = lines.drop_repeated_lines(docs)
    text = F.when(F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    changed = F.struct(*(text.alias(c) if c == "text" else (F.length("kept").cast("long") if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
    return out.select(changed.alias("row")).select("row.*")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id (null ids last, ties by the text's hash) of each near-duplicate class: five-word
    shingles, similarity of 0.8 or more. Rows without words are classes of their own with the rows of their id and text.
    Of repeated rows the least one stays; an empty table gives an empty one."""
    classes = jaccard.similarity_classes(docs, k=5, num=80, den=100, whole=jaccard.PAGE)
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_th")
    first = classes.where("_class IS NOT NULL").groupBy("_class").agg(F.min(order).alias("_f")).select("_f._id", "_f._th")
    first = first.union(classes.where("_class IS NULL").select("_id", "_th")).distinct()
    kept = _same(_keyed(docs), first, "left_semi")
    return kept.groupBy("_id", "_th").agg(F.min("row").alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number; a hash deals rows to partitions, and each
    is a mix by itself in the order of the slots that take the rows. One of no words (null texts too) stays as it is, at
    a place that a hash gives it. Rows with one id and text, null
    ids too, are alike and share what the mix takes of them. An empty table gives an empty one."""
    taken = mixing.mix(docs.select("doc_id", "text", "source", F.xxhash64(C.text_of("text")).alias("_th")), carry=("doc_id", "_th"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    slots = [F.get("slots", F.lit(i)).alias(f"_slot{i}") for i in (0, 1)]
    times = taken.select(F.col("row.doc_id").cast("long").alias("_id"), F.col("row._th").alias("_th"), times.alias("_times"), *slots)
    shared = times.groupBy("_id", "_th").agg(F.sum("_times").alias("_all"), F.count("*").alias("_rows"), F.min("_slot0").alias("_slot0"), F.min("_slot1").alias("_slot1"))
    rows = _same(_keyed(docs), shared, "inner")
    rows = rows.withColumn("_at", F.when(F.col("_rows") == 1, 0).otherwise(F.row_number().over(Window.partitionBy("_id", "_th").orderBy(F.lit(0))) - 1))
    times = (F.floor(F.col("_all") / F.col("_rows")) + (F.col("_at") < F.col("_all") % F.col("_rows")).cast("int")).cast("int")
    rows = rows.withColumn("_times", times).where("_times > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)).alias("_turn"))
    slot = F.coalesce(F.when(F.col("_turn") == 1, F.col("_slot1")), "_slot0", F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 20)))
    return rows.sortWithinPartitions(slot).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, with the ids that they hold (little-endian, 32 bits). Null and empty texts
    are an end alone, rows of one id are documents of their own, and an empty table gives an empty one."""
    return packing.pack(docs, keep_ids=True)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("n-gram jaccard join", one_of_each_class),
    ("mixing sources", mixed),
    ("packing", packed),
]

#: The forest, the R-trees and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
