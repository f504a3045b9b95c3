"""Order MinHash fingerprints: signatures that follow edit distance, not only the set of k-mers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: A sort key is 36 bits of hash over 27 bits of position: texts of up to 2**27 words, more than a string can hold.
HASH_SHIFT, POS_BITS = 28, 27
POWERS = [1 << b for b in range(POS_BITS, -1, -1)]


def _packed(h: Column, pos: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(h, HASH_SHIFT), POS_BITS).bitwiseOR(pos.cast("long"))


def _pos(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POS_BITS) - 1).cast("long"))


def with_sketch(df: DataFrame, text: str, out: str, k: int = 5, tuple_size: int = 2, slots: int = 64) -> DataFrame:
    """Adds `out`, array<bigint> of `slots` 32-bit hashes: the Order MinHash of the words of column `text`.

    k-mers are runs of k words (all words, in a shorter text), each numbered by its earlier occurrences in the text. A
    hash of k-mer and number ranks them on a circle. Slot i takes the tuple_size k-mers of least rank from i / slots of
    the circle on, a permutation of its own, puts them in the order of the text and hashes them. Texts without words
    get one fixed hash in every slot.
    """
    words, kmer, by_hash, ranked, steps = (f"_{out}_{x}" for x in ("words", "kmer", "by_hash", "ranked", "steps"))
    df = df.withColumn(words, F.transform(C.words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size(words)
    at = lambda i: F.get(F.col(words), i)
    runs = F.transform(F.slice(F.col(words), F.lit(1), n - (k - 1)), lambda h, i: F.xxhash64(h, *(at(i + j) for j in range(1, k))))
    none = F.expr("array()").cast("array<bigint>")
    df = df.withColumn(kmer, F.when(n >= k, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(none)).drop(words)
    df = df.withColumn(by_hash, F.sort_array(F.transform(kmer, _packed))).withColumn(steps, F.filter(F.lit(POWERS), lambda s: s <= F.size(kmer)))

    hash_at = lambda i: F.shiftright(F.get(F.col(by_hash), i), POS_BITS)
    # How many equal neighbours stand before place i: they are a run, so doubling steps find its start.
    earlier = lambda h, i: F.aggregate(F.col(steps), F.lit(0), lambda n, s: F.when(hash_at(i - n - s) == h, n + s).otherwise(n))
    number = lambda h, i: F.when(hash_at(i - 1) == h, earlier(h, i)).otherwise(F.lit(0))
    rank = lambda p, i: _packed(F.xxhash64(F.shiftright(p, POS_BITS), number(F.shiftright(p, POS_BITS), i)), _pos(p))
    df = df.withColumn(ranked, F.sort_array(F.transform(by_hash, rank))).drop(by_hash)

    least = lambda start: F.aggregate(F.col(steps), F.lit(0), lambda n, s: F.when(F.get(F.col(ranked), n + s - 1) < start, n + s).otherwise(n))
    starts = F.lit([(1 << 63) // slots * i for i in range(slots)])
    firsts = f"_{out}_firsts"
    df = df.withColumn(firsts, F.transform(starts, least))
    pick = lambda first: F.sort_array(F.array_distinct(F.array(*(_pos(F.get(F.col(ranked), (first + j) % F.size(ranked))) for j in range(tuple_size)))))
    hashed = lambda first: F.shiftrightunsigned(F.xxhash64(F.transform(pick(first), lambda p: F.get(F.col(kmer), p.cast("int")))), 32)
    sketch = F.when(F.size(kmer) > 0, F.transform(firsts, hashed)).otherwise(F.array_repeat(F.lit(0).cast("long"), slots))
    return df.withColumn(out, sketch).drop(kmer, ranked, steps, firsts)


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share of slots in which two sketches agree; 0 where one is null."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.coalesce(same / F.size(a), F.lit(0.0))


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def with_next(docs: DataFrame, runs: int, body: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies body to the rows with _next, the _text of the next row by descending _id (after the last: the first),
    and adds _next_sketch, the _sketch that body gave that row. docs: _id, _text.

    Ids are cut into `runs` ranges, whose ends, 2 * runs numbers at most, are all that the driver sees. Each range
    gets a copy of the first row of the next one, so one shuffle of the texts does. Rows with equal ids stand in the
    order of a hash of their texts. Rows with a null id have no next: an empty text, and no sketch.
    """
    ids = docs.select("_id").where("_id IS NOT NULL").repartitionByRange(runs, "_id")
    ends = sorted((r.lo, r.hi) for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).collect())
    lows, highs = F.lit([lo for lo, _ in ends]).cast("array<bigint>"), F.lit([hi for _, hi in ends]).cast("array<bigint>")
    steps = F.lit([s for s in POWERS if s <= max(1, len(ends))])
    run = F.aggregate(steps, F.lit(-1), lambda n, s: F.when(F.get(lows, n + s) <= F.col("_id"), n + s).otherwise(n))
    rows = docs.withColumn("_run", F.when(F.col("_id").isNull(), -1 - F.pmod(F.xxhash64("_text"), F.lit(runs)).cast("int")).otherwise(run))
    if ends:
        copy = F.when(F.get(highs, F.col("_run")) == F.col("_id"), F.pmod(F.col("_run") + 1, F.lit(len(ends))))
    else:
        copy = F.lit(None).cast("int")
    places = F.filter(F.array(F.struct(F.col("_run").alias("run"), F.lit(False).alias("copy")), F.struct(copy.alias("run"), F.lit(True).alias("copy"))), lambda p: p["run"].isNotNull())
    rows = rows.withColumn("_place", F.explode(places)).withColumn("_run", F.col("_place.run")).withColumn("_copy", F.col("_place.copy")).drop("_place")
    rows = rows.withColumn("_tie", F.xxhash64("_text"))
    order = Window.partitionBy("_run").orderBy("_copy", F.col("_id").desc(), "_tie")
    rows = rows.withColumn("_next", F.when(F.col("_id").isNotNull(), F.lead("_text").over(order)))
    rows = body(rows.withColumn("_next", F.coalesce("_next", F.lit(""))))
    return rows.withColumn("_next_sketch", F.when(F.col("_id").isNotNull(), F.lead("_sketch").over(order))).where("NOT _copy")


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, tuple_size: int = 2, slots: int = 64) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like they are.

    The edited text has its last third of code points replaced by the first as many (or all) of the next document by
    descending id; after the last comes the first. One row for each row of docs: _id, _text, _edited, _sketch,
    _edited_sketch, _next_sketch. Null text: empty. Equal ids: in the order of a hash of the text. Null id: no next
    document, so the last third is cut off. An empty table gives an empty table; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_of(text_col).alias("_text"))

    def body(rows: DataFrame) -> DataFrame:
        n = F.length("_text")
        cut = F.floor(n / 3).cast("int")
        rows = rows.withColumn("_edited", F.concat(F.substring("_text", 1, n - cut), F.substring("_next", 1, cut))).drop("_next")
        rows = rows.withColumn("_edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256)).withColumn("_n_chars", n.cast("long"))
        rows = with_sketch(rows, "_edited", "_edited_sketch", k, tuple_size, slots).drop("_edited")
        return with_sketch(rows, "_text", "_sketch", k, tuple_size, slots).drop("_text")

    return with_next(src, 8 * C.partitions(docs.sparkSession), body)


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_with_edits(C.read(spark, sf_dir, "documents"))
    return out.select(
        F.col("_id").alias("doc_id"),
        F.col("_n_chars").alias("n_chars"),
        F.col("_edited_sha256").alias("edited_sha256"),
        as_text("_sketch").alias("fingerprint"),
        as_text("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"),
        likeness("_sketch", "_next_sketch").alias("near_next"),
    )
