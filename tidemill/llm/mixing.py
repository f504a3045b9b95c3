"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: 1 / golden ratio, the step of the schedule's points.
GOLDEN = 0.6180339887498949
#: Cells of [0, 1) by which points meet the sources' shares.
CELLS = 4096
#: Most groups that rows of one source, or slots, are dealt to.
MOST_GROUPS = 65_536


def source_key(c: Column) -> Column:
    """A string that is never null and orders as the source's code points do, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Adds weight, target and total to one row for each source (_s, source_size).

    share * total is dealt by weight; a source stops at most * its size and what is over goes to the others by weight.
    That is one level for all: target = min(most * size, level * weight), found from running sums over the sources in
    the order in which they reach their limit. One row for each source stands in the windows, no more.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("_s")) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w.cast("double")).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), "_s")
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    t = t.withColumn("total", F.sum("source_size").over(everything))
    t = t.withColumn("_level", (F.lit(float(share)) * F.col("total") - before) / rest).withColumn("_at", F.row_number().over(by))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct("_at", "_level"))
    t = t.withColumn("_level", F.min(fits).over(everything)["_level"])
    return t.withColumn("target", F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))).drop("_cap", "_at", "_level")


def schedule(spark: SparkSession, targets: DataFrame, slots: int, block: float) -> DataFrame:
    """(_s, _block, slot): the blocks that each source gives, and the slot that takes each: a source gives as many as
    reach its target.

    Slot t belongs to the source whose share of [0, 1) holds frac(t / golden ratio); slots are ranked within their
    source, and the n-th takes the source's n-th block. Ranks come from counts of runs of slots, so that a source with
    most slots is no task. Points deal slots out to within a few of the shares: what a source gets too many stays
    unused, and what it gets too few follows after all points, in the order of the sources.
    """
    run = max(256, math.ceil(slots / MOST_GROUPS))
    hi = F.sum("target").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    all_ = F.sum("target").over(Window.partitionBy())
    need = F.ceil(F.round("target") / block).cast("long")
    shares = targets.where("target > 0").select("_s", ((hi - F.col("target")) / all_).alias("_lo"), (hi / all_).alias("_hi"), need.alias("_need"))
    cells = shares.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") * CELLS), F.floor(F.col("_hi") * CELLS))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))).alias("_u"))
    points = points.withColumn("_cell", F.floor(F.col("_u") * CELLS))
    dealt = points.join(cells, "_cell").where("_u >= _lo AND _u < _hi").select("_s", "_need", "slot", F.floor(F.col("slot") / run).alias("_run"))
    counts = dealt.groupBy("_s", "_run").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_s").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_s", "_run").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("_s", "_run", before.alias("_before")), ["_s", "_run"])
    ranked = ranked.select("_s", (F.col("_before") + F.col("_rank")).cast("long").alias("_block"), "slot", "_need").where("_block < _need").drop("_need")

    short = shares.select("_s", "_need").join(counts.groupBy("_s").agg(F.sum("_c").alias("_got")), "_s", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    missing = F.greatest(F.lit(0), F.col("_need") - F.col("_got"))
    short = short.withColumn("_after", F.sum(missing).over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)) - missing).where("_need > _got")
    rest = short.select("_s", F.explode(F.sequence(F.col("_got"), F.col("_need") - 1)).alias("_block"), "_got", "_after")
    return ranked.union(rest.select("_s", "_block", F.lit(slots) + F.col("_after") + F.col("_block") - F.col("_got")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ("doc_id",), weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2, block: int = 1024, seed: str = "mix") -> DataFrame:
    """What a mix of share * all words takes of each document; one row for each row of docs.

    Sources stand in code point order, null last, and get the weights in turn. The documents of a source, in the order
    of a hash of their ids, are one stream of words, read again from its start when it ends; the stream is cut into
    blocks of `block` words, and the blocks that the schedule gives a slot are taken, the last one up to the target.
    Returns `row` (the columns of docs named in carry: texts don't need to go along), size, source_size, target, taken,
    first_slot (null if nothing is taken) and slots: for each reading that takes of the document, its first slot there.

    Null or empty text has size 0 and is taken 0 times. Repeated rows are documents of their own. Ties of the hash go
    by id, then size; null ids have the hash of their text's. An empty table gives an empty table. Names in docs can't clash: they stay inside `row`. most is
    a whole number. Reruns agree.
    """
    spark = docs.sparkSession
    src = docs.select(F.struct(*carry).alias("row"), F.col(id_col).alias("_id"), C.n_words(C.text_of(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.xxhash64(C.text_of(text_col))).alias("_null"), source_key(F.col(source_col)).alias("_s"))
    src = C.written(src, "mix-sizes")
    src = src.withColumn("_hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null "), F.col("_null").cast("string"))))))
    n = src.count()
    groups = min(MOST_GROUPS, max(1, math.ceil(n / 256)))
    width = math.ceil(2**32 / groups)
    src = src.withColumn("_group", F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") / width))

    sums = C.written(src.groupBy("_s", "_group").agg(F.sum("size").alias("_sum")), "mix-sums")
    targets = C.written(source_targets(sums.groupBy("_s").agg(F.sum("_sum").alias("source_size")), weights, share, most), "mix-targets")
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    upto = F.coalesce(F.sum("_sum").over(Window.partitionBy("_s").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("_s", "_group", upto.alias("_offset")).join(targets, "_s")

    inside = Window.partitionBy("_s", "_group").orderBy("_hash", "_id", "size")
    at = src.select("*", F.row_number().over(inside).alias("_n"), F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_in"))
    at = at.join(offsets, ["_s", "_group"]).withColumn("_from", F.col("_offset") + F.col("_in")).withColumn("_stop", F.round("target").cast("long"))

    epoch = F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1)))
    turns = at.withColumn("_turn", epoch).withColumn("_a", F.col("_from") + F.col("_turn") * F.col("source_size"))
    turns = turns.withColumn("_b", F.least(F.col("_a") + F.col("size"), F.col("_stop")))
    used = F.when(F.col("_b") > F.col("_a"), F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_b") - 1) / block)))
    pieces = turns.select("*", F.explode_outer(used).alias("_block"))
    overlap = F.least(F.col("_b"), (F.col("_block") + 1) * block) - F.greatest(F.col("_a"), F.col("_block") * block)
    pieces = pieces.select("row", "_s", "_group", "_n", "size", "source_size", "target", "_turn", "_block", overlap.alias("_words"))
    plan = schedule(spark, targets, math.ceil(words / block), block)
    got = pieces.join(plan, ["_s", "_block"], "left").withColumn("_words", F.when(F.col("slot").isNull(), 0).otherwise(F.col("_words")))
    slots = F.array_compact(F.array(*(F.min(F.when((F.col("_turn") == i) & (F.col("_words") > 0), F.col("slot"))) for i in range(int(most)))))
    out = got.groupBy("_s", "_group", "_n").agg(*(F.first(c).alias(c) for c in ("row", "size", "source_size", "target")), F.sum("_words").cast("long").alias("taken"), slots.alias("slots"))
    return out.select("row", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"), "slots")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(C.read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "first_slot")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS pos, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(cap, (SELECT arg_min(level, pos) FROM l WHERE level <= cap / weight) * weight)::DOUBLE AS target FROM l),
p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
-- shares of [0, 1), and the blocks of 1024 words that reach each target
h AS (SELECT source, ceil(round(target) / 1024)::BIGINT AS need, (sum(target) OVER o - target) / sum(target) OVER () AS lo, sum(target) OVER o / sum(target) OVER () AS hi
      FROM t WHERE target > 0 WINDOW o AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT ceil(sum(target) / 1024)::BIGINT AS slots FROM t),
g AS (SELECT h.source, need, slot, row_number() OVER (PARTITION BY h.source ORDER BY slot) - 1 AS block
      FROM (SELECT unnest(range(slots)) AS slot FROM n) JOIN h ON (slot * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE >= lo AND (slot * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE < hi),
m AS (SELECT h.source, h.need, coalesce(c.got, 0) AS got, greatest(0, h.need - coalesce(c.got, 0)) AS missing FROM h LEFT JOIN (SELECT source, count(*) AS got FROM g GROUP BY source) c ON h.source IS NOT DISTINCT FROM c.source),
k AS (SELECT *, sum(missing) OVER (ORDER BY source NULLS LAST) - missing AS after FROM m),
plan AS (SELECT source, block, slot FROM g WHERE block < need UNION ALL
         SELECT source, block, (SELECT slots FROM n) + after + block - got FROM (SELECT *, unnest(range(got, need)) AS block FROM k)),
u AS (SELECT p.doc_id, p.source, (p.a + i * t.source_size)::BIGINT AS a, least(p.a + i * t.source_size + p.size, round(t.target))::BIGINT AS b FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) v(i)),
x AS (SELECT doc_id, source, a, b, unnest(range(a // 1024, (b - 1) // 1024 + 1)) AS block FROM u WHERE b > a),
s2 AS (SELECT x.doc_id, sum(least(b, (x.block + 1) * 1024) - greatest(a, x.block * 1024))::BIGINT AS taken, min(slot)::BIGINT AS first_slot
       FROM x JOIN plan ON x.source IS NOT DISTINCT FROM plan.source AND x.block = plan.block GROUP BY x.doc_id)
SELECT p.doc_id, p.size::BIGINT AS size, t.source_size, t.target, coalesce(s2.taken, 0)::BIGINT AS taken, s2.first_slot
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN s2 ON p.doc_id = s2.doc_id
"""
