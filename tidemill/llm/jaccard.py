"""Jaccard join of shingle sets: R-trees over counts of token groups, within blocks that lose no link."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components

#: Groups that shingles are hashed to; their counts are a set's point.
DIMS = 256
#: Points to a leaf of the R-tree, and children to a node.
FANOUT = 16
#: Points to a page of a block, and shingles: two pages are one task's work.
PAGE, PAGE_SHINGLES = 512, 2_000_000
#: Larger blocks are joined by their head first: most are families that it connects, at a check for each set. Where looser
#: links leave many outsiders, whose texts go along again, up to a page at once takes less.
WHOLE = 32
#: Word hashes that a worker remembers.
CACHE_WORDS = 250_000
#: Keys of sets that a task remembers to have signed; a forgotten one is signed again.
MOST_SEEN = 250_000
SIGNATURE_MASK = (1 << 48) - 1

_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Texts to sorted arrays of 64-bit hashes of their distinct k-word shingles."""

    def __init__(self, k: int):
        self.k, self.words = k, {}

    def __call__(self, text: str) -> np.ndarray:
        ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        for w in set(ws).difference(self.words):
            self.words[w] = xxhash.xxh3_64_intdigest(w)
        a = np.fromiter(map(self.words.__getitem__, ws), np.uint64, len(ws))
        if not len(a):
            return a
        k = min(self.k, len(a))
        h = np.full(len(a) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * _P + a[i : len(a) - k + 1 + i]
        return np.unique(_mixed(h))


def set_key(s: np.ndarray) -> int:
    """Identifies a set; equal sets are one point."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


class Blocks:
    """Exact blocking by a pigeonhole over token groups: two sets that link share a signature.

    Linked sets of sizes a and b differ in (1-t)/(1+t)*(a+b) shingles at most. Sizes fall into classes such that linked
    sets are in one class or in neighbours. For each class, shingles are dealt to more groups than linked sets of it can
    differ in, so one group that isn't empty holds the same shingles in both: its content is the signature. A set gives
    signatures for its class and the next. There are so many groups that even the least set of a class has enough that
    aren't empty, by three standard deviations; the rare set that has not gives its empty ones too.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den, self.bounds = num, den, [1]
        while self.bounds[-1] < 1 << 40:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, (b - 1) * den // num + 1))
        self.groups: dict[int, int] = {}

    def differ(self, c: int) -> int:
        return (self.den - self.num) * 2 * (self.bounds[c + 1] - 1) // (self.den + self.num)

    def group_count(self, c: int) -> int:
        if c not in self.groups:
            most, least = self.differ(c), self.bounds[max(0, c - 1)]
            n = most + 2
            while n < 2 * most + 16 and n * (1 - math.exp(-least / n)) - 3 * math.sqrt(n * math.exp(-least / n)) <= most:
                n += 1 + most // 200
            self.groups[c] = n
        return self.groups[c]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        c, out = bisect_right(self.bounds, len(s)) - 1, []
        for at in (c, c + 1):
            most = self.differ(at)
            if not most:  # only equal sets link
                continue
            groups = self.group_count(at)
            g = (s % np.uint64(groups)).astype(np.int64)
            content = np.zeros(groups, np.uint64)
            np.add.at(content, g, _mixed(s ^ np.uint64(at + 1)))
            full = np.bincount(g, minlength=groups) > 0
            chosen = np.flatnonzero(full) if full.sum() > most else np.arange(groups)
            out.append(_mixed(content[chosen] + (chosen.astype(np.uint64) + np.uint64(1)) * _P + np.uint64(at) * np.uint64(7919)))
        return (np.concatenate(out) if out else np.empty(0, np.uint64)) & np.uint64(SIGNATURE_MASK)


class CountTree:
    """An R-tree, bulk loaded by size and first coordinates: each node has the largest counts and the least size below."""

    def __init__(self, sets: list[np.ndarray], rows: np.ndarray):
        self.size = np.array([len(sets[i]) for i in rows])
        counts = np.array([np.bincount((sets[i] % np.uint64(DIMS)).astype(np.int64), minlength=DIMS) for i in rows], np.uint32).reshape(len(rows), DIMS)
        order = np.lexsort((counts[:, 1], counts[:, 0], self.size))
        self.rows, self.size = rows[order], self.size[order]
        self.levels = [(counts[order], self.size)]
        while len(self.levels[-1][1]) > 1:
            top, least = self.levels[-1]
            starts = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, starts, axis=0), np.minimum.reduceat(least, starts)))

    def pairs(self, other: CountTree, num: int, den: int) -> Iterator[tuple[int, int]]:
        """Pairs of rows whose overlap, at most the sum of the lesser counts, may do for a link."""
        height = max(len(self.levels), len(other.levels))
        level = lambda t, i: t.levels[min(i, len(t.levels) - 1)]
        fan = lambda t, i, at: range(at, at + 1) if i >= len(t.levels) - 1 else range(at * FANOUT, min((at + 1) * FANOUT, len(t.levels[i][1])))
        (a, na), (b, nb) = level(self, height - 1), level(other, height - 1)
        todo = [(height - 1, 0, 0)] * bool(np.minimum(a[0], b[0]).sum(dtype=np.int64) * (num + den) >= num * (na[0] + nb[0]) and (self is not other or height > 1))
        while todo:
            i, u, v = todo.pop()
            if i:
                i -= 1
                us, vs = fan(self, i, u), fan(other, i, v)
                (a, na), (b, nb) = level(self, i), level(other, i)
                for x in us:
                    most = np.minimum(a[x], b[vs.start : vs.stop]).sum(1, dtype=np.int64)
                    # intersection * den >= union * num, with union = sizes - intersection
                    need = num * (na[x] + nb[vs.start : vs.stop])
                    todo += [(i, x, vs.start + int(j)) for j in np.flatnonzero(most * (num + den) >= need) if self is not other or x > vs.start + j or (i and x == vs.start + j)]
            else:
                yield int(self.rows[u]), int(other.rows[v])


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def spanning_links(keys: list[int], right: list[bool], texts: list[str], classes: list[int] | None, k: int, num: int, den: int) -> list[tuple[int, int]]:
    """Verified links that connect what links connect: within the texts on the left if there are none on the right,
    else between both. Pairs of one class are connected already, and one that a link has connected isn't looked at again."""
    shingler, first = Shingler(k), {}
    for i, key in enumerate(keys):
        first.setdefault(key, i)
    at = list(first.values())
    sets = {i: shingler(texts[i]) for i in at}
    leader: dict[int, int] = {}
    parent = {i: leader.setdefault(classes[i], i) if classes else i for i in at}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, other = (np.array([i for i in at if right[i] == p], np.int64) for p in (False, True))
    a = CountTree(sets, left) if len(left) else None
    b = CountTree(sets, other) if len(other) else None
    out = []
    for x, y in (a or b).pairs(b or a, num, den) if a or b else ():
        i, j = root(x), root(y)
        if i != j and linked(sets[x], sets[y], num, den):
            parent[i] = j
            out.append((keys[x], keys[y]))
    return out


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100, whole: int | None = None) -> DataFrame:
    """(_id, _th, n_shingles, component_id, _class) for each row of docs: the class that links of at least num/den Jaccard
    similarity of k-word shingles make, named by its least id; _class is its key, null for a row without shingles.

    Equal sets are one point. Sets meet in blocks by shared signatures; a block is named by its least key, so that all
    that meet anywhere meet in a block to which each set belongs a few times. First the set that names a block is
    joined with all others there, which makes most families one class; then those of a block that are outside its class
    are joined with all in it. Blocks of up to `whole` sets (WHOLE) are joined at once. All joins are of R-trees over group counts, in pages, and pairs that survive are
    verified on the sets themselves. So each text goes along once for each of its blocks, and again only for pages of
    outsiders. Only links that connect something new leave a task: a group of copies gives as many rows as it has texts.

    A text under k words is one shingle. Null text or one without words has no shingles, links with nothing and is its
    own class. Null ids are never the name of a class that has another id. Repeated rows are in one class. An empty
    table gives an empty table; other columns are not read. _th is xxhash64 of the text.
    """
    src = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_of(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    blocks = Blocks(num, den)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(k), set()
        for batch in batches:
            sizes, keys, marks = [], [], []
            for text in batch.column("_text").to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
                if new := len(s) and keys[-1] not in seen:  # equal sets have equal signatures
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    seen.add(keys[-1])
                marks.append(blocks.signatures(s).view(np.int64) if new else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, marks)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *marks])))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), lists], names=["_id", "_th", "n_shingles", "_key", "_marks"])

    points = C.written(src.mapInArrow(measured, "_id long, _th long, n_shingles long, _key long, _marks array<long>"), "jaccard-points")
    marks = points.select(F.explode("_marks").alias("_mark"), "_key")
    # Marks are shuffled at all sizes alike. Tables that are joined are written: so both sides of a join are plain shuffles, and Spark can split a heavy key.
    shared = C.written(marks.groupBy("_mark").agg(F.min("_key").alias("_block"), F.max("_key").alias("_most")).where("_block != _most").select("_mark", "_block"), "jaccard-marks")
    met = C.written(marks.hint("merge").join(shared, "_mark").where("_key != _block").select("_key", "_block").distinct(), "jaccard-met")

    points = points.drop("_marks")
    one = C.written(points.where("_key IS NOT NULL").groupBy("_key").agg(F.min(F.struct("_id", "_th")).alias("_row"), F.first("n_shingles").alias("_n")), "jaccard-sets")
    met = C.written(met.join(one, "_key").select("_key", "_block", "_row", "_n"), "jaccard-members")
    heads = met.select(F.col("_block").alias("_key")).distinct().join(one, "_key").select("_key", F.col("_key").alias("_block"), "_row", "_n")
    paged = lambda n, total: F.ceil(F.greatest(n / PAGE, total / PAGE_SHINGLES)).cast("int")

    def joined(work: DataFrame) -> DataFrame:
        """Links between the right and the left of each (_block, _p, _q) of work, whose texts are fetched by _row."""

        def links(frame: pd.DataFrame) -> pd.DataFrame:
            found = spanning_links(*(frame[c].tolist() for c in ("_key", "_right", "_text", "_class")), k, num, den)
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        work = work.select(F.col("_row._id").alias("_id2"), F.col("_row._th").alias("_th2"), "_key", "_class", "_block", "_p", "_q", "_right")
        work = src.hint("merge").join(work, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2"))).drop("_id", "_th", "_id2", "_th2")
        return work.groupBy("_block", "_p", "_q").applyInPandas(links, "a long, b long")

    # Small blocks whole; of larger ones the head with all that it meets.
    sizes = C.written(met.groupBy("_block").agg(paged(F.count("*"), F.sum("_n")).alias("_pages"), (F.count("*") > (whole or WHOLE)).alias("_large")), "jaccard-sizes")
    columns = ["_key", F.col("_key").alias("_class"), "_block", "_row", "_p", F.lit(-1).alias("_q")]
    members = met.join(sizes, "_block").withColumn("_p", F.pmod(F.xxhash64("_key"), F.col("_pages")).cast("int")).select(*columns, (F.col("_large") | (F.col("_pages") > 1)).alias("_right"))
    work = heads.join(sizes, "_block").withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1))).select(*columns, F.lit(False).alias("_right"))
    classes = C.written(connected_components(joined(work.union(members))), "jaccard-classes")

    # Of larger blocks, those outside the class of the head with all that the block holds.
    of = lambda c, name: classes.select(F.col("node").alias(c), F.col("component").alias(name))
    met = met.join(sizes.where("_large OR _pages > 1"), "_block", "left_semi").join(of("_key", "_kc"), "_key", "left").join(of("_block", "_bc"), "_block", "left")
    met = met.withColumn("_class", F.coalesce("_kc", "_key")).withColumn("_out", F.col("_class") != F.coalesce("_bc", "_block")).drop("_kc", "_bc")
    met = C.written(met, "jaccard-classed")
    sizes = met.groupBy("_block").agg(paged(F.count_if("_out"), F.sum(F.when(F.col("_out"), F.col("_n")))).alias("_outs"), (paged(1 + F.count_if(~F.col("_out")), F.sum("_n"))).alias("_ins"))
    sizes = C.written(sizes.where("_outs > 0"), "jaccard-outside")
    if not sizes.isEmpty():
        heads = heads.join(of("_key", "_kc"), "_key", "left").select("_key", "_block", "_row", "_n", F.coalesce("_kc", "_key").alias("_class"), F.lit(False).alias("_out"))
        every = met.select("_key", "_block", "_row", "_n", "_class", "_out").unionByName(heads).join(sizes, "_block")
        # Pages of outsiders come first; those of others, after them, meet only these.
        page = F.when(F.col("_out"), F.pmod(F.xxhash64("_key"), F.col("_outs"))).otherwise(F.col("_outs") + F.pmod(F.xxhash64("_key"), F.col("_ins"))).cast("int")
        every = every.withColumn("_page", page).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("_out"), F.col("_outs") + F.col("_ins") - 1).otherwise(F.col("_outs") - 1))))
        work = every.select("_key", "_class", "_block", "_row", F.least("_page", "_other").alias("_p"), F.greatest("_page", "_other").alias("_q"), (F.col("_page") > F.col("_other")).alias("_right"))
        classes = C.written(connected_components(joined(work).union(classes.select("node", "component"))), "jaccard-classes")

    rows = points.join(classes, points["_key"] == classes["node"], "left").withColumn("_class", F.coalesce("component", "_key"))
    rows = C.written(rows.select("_id", "_th", "n_shingles", "_class"), "jaccard-rows")
    names = C.written(rows.where("_class IS NOT NULL").groupBy(F.col("_class").alias("_of")).agg(F.min("_id").alias("_name")), "jaccard-names")
    out = rows.join(names, F.col("_class") == F.col("_of"), "left")
    return out.select("_id", "_th", "n_shingles", F.when(F.col("_class").isNull(), F.col("_id")).otherwise(F.col("_name")).alias("component_id"), "_class")


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity_classes(C.read(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a AND r.c < e.b)
SELECT n.doc_id, any_value(n.n) AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY 1
"""
