"""Quality rules: an isolation forest over statistics of the rules, its threshold set from labelled rows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TREES, SUBSAMPLE = 200, 256
#: The threshold lets through all but this share of the labelled good rows that the base rules keep.
GOOD_LOSS = 0.002
#: A statistic counts from the value on that all but this share of the good rows stay under.
GOOD_EXCESS = 0.001
#: The median and the value that all but GOOD_EXCESS stay under are so many standard deviations apart in a normal distribution.
USUAL_SPREADS = 3.09
#: The weight of all bad rows that the forest grows on, at most, as a share of the good ones: unusual rows.
BAD_SHARE = 0.03
SYMBOLS = b"#*$%&|<>"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: How often a row is good or bad in the half that grows the trees, and in the half that sets the threshold.
COUNTS = ["grow_good", "grow_bad", "rest_good", "rest_bad"]
FEATURES = ["symbols", "repeats", "capitals", "marks", "lone", "dup_lines", "top_word", "sameness", "mean_word"]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, until = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, until)
            until = i + 3
    return n


def statistics(text: str) -> list[float]:
    """BASE, then FEATURES, of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - sum(map(len, words)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    base = [n, chars, symbols, dups, repeats]
    if not n:
        return base + [0.0] * len(FEATURES)
    counts = Counter(words)
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return base + [
        symbols / n,
        repeats / n,
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars,
        count(b"!?=_@{}[]();:\"'/\\+~^-") / n,
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
        dups / len(lines),
        max(counts.values()) / n,
        1 - math.log(len(counts)) / math.log(n) if n > 1 else 0.0,
        chars / n,
    ]


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _th, BASE, FEATURES) of each row of docs; _th is xxhash64 of the text."""
    names = BASE + FEATURES

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = np.array([statistics(t) for t in b["_text"]], dtype=float).reshape(len(b), len(names))
            out = pd.DataFrame(values, columns=names)
            out.insert(0, "_id", b["_id"].astype("Int64"))
            out.insert(1, "_th", b["_th"])
            yield out.astype(dict.fromkeys(BASE, "int64"))

    src = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_of(text_col).alias("_text")).withColumn("_th", F.xxhash64("_text"))
    return src.mapInPandas(rows, ", ".join(["_id long", "_th long", *(f"{n} long" for n in BASE), *(f"{n} double" for n in FEATURES)]))


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of a failed search among n rows, which needn't be whole."""
    n = np.maximum(n, 1)
    return np.where(n > 2, np.maximum(1.0, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n), np.minimum(n - 1, 1.0))


class Rows:
    """Rows that a model is fitted on, as a pandas frame. It asks for bounded sums over all of them, and no more."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows

    def mapped(self, f: Callable[[pd.DataFrame], pd.DataFrame]) -> Rows:
        return Rows(f(self.rows))

    def summed(self, f: Callable[[pd.DataFrame], pd.DataFrame]) -> pd.DataFrame:
        """f of all rows, merged by its column `key`: lo... by minimum, hi... by maximum, others by sum; ordered by key."""
        return merged(f(self.rows)).sort_values("key", ignore_index=True)


class SparkRows(Rows):
    """The same over a written table: each task merges its own sums, a shuffle those of all tasks."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _over(self, f: Callable[[pd.DataFrame], pd.DataFrame], merge: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                if not merge:
                    yield f(b)
                else:
                    total = merged(f(b) if total is None else pd.concat([total, f(b)]))
            if total is not None:
                yield total

        none = f(pd.DataFrame({c: pd.Series(dtype="float64" if t == "double" else "int64") for c, t in self.rows.dtypes}))
        return self.rows.mapInPandas(run, ", ".join(f"{c} {'double' if t.kind == 'f' else 'long'}" for c, t in none.dtypes.items()))

    def mapped(self, f: Callable[[pd.DataFrame], pd.DataFrame]) -> Rows:
        return SparkRows(C.written(self._over(f, merge=False), "quality-fit"))

    def summed(self, f: Callable[[pd.DataFrame], pd.DataFrame]) -> pd.DataFrame:
        over = self._over(f, merge=True)
        out = over.groupBy("key").agg(*({"min": F.min, "max": F.max, "sum": F.sum}[how](c).alias(c) for c, how in merges(over.columns).items()))
        return out.toPandas().sort_values("key", ignore_index=True)


def merges(columns: Iterable[str]) -> dict[str, str]:
    return {c: {"lo": "min", "hi": "max"}.get(c[:2], "sum") for c in columns if c != "key"}


def merged(sums: pd.DataFrame) -> pd.DataFrame:
    return sums.groupby("key", as_index=False).agg(merges(sums.columns)) if len(sums) else sums


def selected(rows: Rows, columns: Callable[[pd.DataFrame], list[tuple[np.ndarray, np.ndarray]]], shares: list[float]) -> tuple[list[float], list[int]]:
    """Of each column (values, times) the least value that at least its share of the others is at or under, as exactly
    as a sort has it, and the number of values; 0 of none. Four rounds count 16 bits more of each value, in order."""
    m = len(shares)
    prefix, rank, number = np.zeros(m, np.uint64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    for shift in (48, 32, 16, 0):

        def count(b: pd.DataFrame, shift: int = shift, prefix: np.ndarray = prefix.copy()) -> pd.DataFrame:
            keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for j, (x, n) in enumerate(columns(b)):
                bits = (np.ascontiguousarray(x, float) + 0.0).view(np.uint64)
                bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63)) >> np.uint64(shift)
                at = np.flatnonzero((n > 0) & ((shift == 48) | (bits >> np.uint64(16) == prefix[j])))
                found, back = np.unique((bits[at] & np.uint64(0xFFFF)).astype(np.int64), return_inverse=True)
                sums = np.zeros(len(found), np.int64)
                np.add.at(sums, back, n[at])
                keys.append((j << 16) + found)
                times.append(sums)
            return pd.DataFrame({"key": np.concatenate(keys), "n": np.concatenate(times)})

        got = rows.summed(count)
        column, bucket, n = got["key"].to_numpy(np.int64) >> 16, got["key"].to_numpy(np.int64) & 0xFFFF, got["n"].to_numpy(np.int64)
        for j in np.unique(column).tolist():
            ends = np.cumsum(n[column == j])
            if shift == 48:
                number[j], rank[j] = ends[-1], math.ceil(shares[j] * (ends[-1] - 1))
            i = int(np.searchsorted(ends, rank[j], "right"))
            rank[j] -= ends[i] - n[column == j][i]
            prefix[j] = prefix[j] << np.uint64(16) | np.uint64(bucket[column == j][i])
    values = np.where(prefix >> np.uint64(63), prefix ^ np.uint64(1 << 63), ~prefix).view(float)
    return [float(v) if n else 0.0 for v, n in zip(values, number, strict=True)], number.tolist()


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits of a hash of whole numbers."""
    h = np.atleast_1d(x).astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class IsolationForest:
    """Trees of random splits as arrays; few splits isolate an unusual row. As the method has it, each tree splits a draw of
    subsample rows, any of all rows, until they are apart; how many rows are in a leaf is counted over all rows.

    rows: _id, FEATURES, grow_good, grow_bad (how often a row counts); a bad one has the weight bad_weight. The children of
    node i are 2 i + 1 and 2 i + 2.
    """

    def __init__(self, rows: Rows, distinct: Rows, n_good: int, n_bad: int, bad_weight: float, trees: int = TREES, subsample: int = SUBSAMPLE):
        total = n_good + bad_weight * n_bad
        self.size, self.depth = min(float(subsample), total), max(1, math.ceil(math.log2(max(2, min(subsample, total)))))
        self.feature = np.full((trees, 2 ** (self.depth + 1) - 1), -1, np.int8)
        self.split, self.path = np.zeros(self.feature.shape), np.zeros(self.feature.shape)
        share = min(1.0, 2 * subsample / max(1.0, total))  # twice as many as the least of them that a tree takes
        drawn = rows.summed(lambda b: self._draws(b, share, bad_weight))
        for tree, of in drawn.groupby("lo_tree"):
            x = np.repeat(of[[f"lo_{f}" for f in FEATURES]].to_numpy(float), np.minimum(of["n"], subsample), axis=0)[:subsample]
            self._grow(int(tree), x)
        found = distinct.summed(self._masses)
        tree, node = np.divmod(found["key"].to_numpy(np.int64), self.feature.shape[1])
        weight = found["grow_good"].to_numpy(float) + bad_weight * found["grow_bad"].to_numpy(float)
        self.path += np.log2(np.arange(1, self.feature.shape[1] + 1)).astype(int)
        self.path[tree, node] += mean_path(weight * (self.size / total))

    def _draws(self, b: pd.DataFrame, share: float, bad_weight: float) -> pd.DataFrame:
        """The rows of least hashes for each tree, about; equal rows of one id are one, with their number."""
        b = b[(b["grow_good"] > 0) | (b["grow_bad"] > 0)]
        x, bad = b[FEATURES].to_numpy(float) + 0.0, (b["grow_bad"] > 0).to_numpy()
        row = mixed(b["_id"].to_numpy(np.int64))
        for f in x.T:
            row = mixed((row ^ np.ascontiguousarray(f).view(np.uint64)).view(np.int64))
        out = [(np.empty(0, np.int64),) * 3]
        for tree in range(len(self.feature)):
            h = mixed(row.view(np.int64), 2 * tree + 1)
            hit = np.flatnonzero((h < share * 2.0**64) & (~bad | (mixed(row.view(np.int64), 2 * tree + 2) < bad_weight * 2.0**64)))
            out.append((hit, np.full(len(hit), tree), (h[hit] >> np.uint64(1)).view(np.int64)))
        hit, tree, key = map(np.concatenate, zip(*out, strict=True))
        drawn = pd.DataFrame(x[hit], columns=[f"lo_{f}" for f in FEATURES])
        return drawn.assign(key=key, lo_tree=tree, n=(b["grow_good"] + b["grow_bad"]).to_numpy(np.int64)[hit])

    def _grow(self, tree: int, x: np.ndarray) -> None:
        rng, todo = np.random.default_rng([5, tree]), [(0, x, 0)]
        while todo:
            node, rows, depth = todo.pop()
            lo, hi = rows.min(0), rows.max(0)
            free = np.flatnonzero(hi > lo)
            if depth >= self.depth or not len(free):
                continue
            f = int(rng.choice(free))
            s = min(rng.uniform(lo[f], hi[f]), np.nextafter(hi[f], lo[f]))
            self.feature[tree, node], self.split[tree, node] = f, s
            under = rows[:, f] <= s
            todo += [(2 * node + 1, rows[under], depth + 1), (2 * node + 2, rows[~under], depth + 1)]

    @property
    def trees(self) -> list[tuple[np.ndarray, ...]]:
        """(feature or -1, split, left child, path length) of each tree's nodes."""
        left = 2 * np.arange(self.feature.shape[1]) + 1
        return [(f, s, left, p) for f, s, p in zip(self.feature, self.split, self.path, strict=True)]

    def leaves(self, x: np.ndarray, tree: int) -> np.ndarray:
        rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > self.split[tree, node]), node)
        return node

    def _masses(self, b: pd.DataFrame) -> pd.DataFrame:
        """How many rows that grow the trees are in each leaf."""
        x, n = b[FEATURES].to_numpy(float), b[["grow_good", "grow_bad"]].to_numpy(np.int64)
        out = [(np.empty(0, np.int64), n[:0])]
        for tree in range(len(self.feature)):
            found, back = np.unique(self.leaves(x, tree), return_inverse=True)
            sums = np.zeros((len(found), 2), np.int64)
            np.add.at(sums, back, n)
            out.append((tree * self.feature.shape[1] + found, sums))
        key, n = map(np.concatenate, zip(*out, strict=True))
        return pd.DataFrame({"key": key, "grow_good": n[:, 0], "grow_bad": n[:, 1]})

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; unusual rows near 1."""
        x, back = np.unique(x, axis=0, return_inverse=True)
        total = np.zeros(len(x))
        for tree in range(len(self.feature)):
            total += self.path[tree, self.leaves(x, tree)]
        return (2.0 ** (-total / len(self.feature) / max(1e-9, float(mean_path(self.size)))))[back.ravel()]


def base_failed(min_words: int, most_repeats: int, repeats_from: int = 0) -> Column:
    return (F.col("n_words") < min_words) | ((F.col("n_words") >= repeats_from) & (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words")))


class Judge:
    """An isolation forest over how far each statistic is beyond the usual, and the score over which a document goes.

    labelled: _id, FEATURES, quality. All rows count. The good rows tell what is usual; half of the rows, by a hash of the
    id, grow the trees, with a bounded weight of the bad ones; the other half sets the threshold, midway to the bad rows'
    scores where these are clear of it. With few good rows nothing goes.
    """

    def __init__(self, labelled: pd.DataFrame | Rows, good_loss: float = GOOD_LOSS):
        rows = labelled if isinstance(labelled, Rows) else Rows(labelled)
        self.limit, m = math.inf, len(FEATURES)
        values, number = selected(rows, self._good, [1 - GOOD_EXCESS] * m + [0.5] * m)
        if number[0] < 20:
            return
        self.usual = np.array(values[:m])
        self.scale = (self.usual - values[m:]) / USUAL_SPREADS + 1e-3
        own = rows.mapped(self._roles)
        rows = own.mapped(self._distinct)
        n = dict(rows.summed(lambda b: pd.DataFrame({"key": range(4), "n": [int(b[c].sum()) for c in COUNTS]})).to_numpy().tolist())
        good, bad, rest_good, rest_bad = (int(n.get(k, 0)) for k in range(4))
        if not good or not rest_good:
            return
        self.forest = IsolationForest(own, rows, good, bad, min(1.0, BAD_SHARE * max(1, good) / max(1, bad)))
        rows = rows.mapped(lambda b: pd.DataFrame({"score": self.forest.score(b[FEATURES].to_numpy(float)), **{c: b[c] for c in COUNTS[2:]}}))
        (self.limit, lowest), _ = selected(rows, lambda b: [(b["score"].to_numpy(), b[c].to_numpy(np.int64)) for c in COUNTS[2:]], [1 - good_loss, 0.02])
        if rest_bad:
            self.limit = max(self.limit, (self.limit + lowest) / 2)

    @staticmethod
    def _good(b: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        n = (b["quality"] == 1).to_numpy(np.int64)
        return [(b[f].to_numpy(float), n) for f in FEATURES] * 2

    def _roles(self, b: pd.DataFrame) -> pd.DataFrame:
        """_id, the excesses of rows, and what each counts as: good or bad, in which half."""
        half = (mixed(b["_id"].to_numpy(np.int64)) & np.uint64(1)).astype(np.int64)
        kind = np.where(b["quality"] == 1, 0, np.where(b["quality"] == 0, 1, 4)) + 2 * half
        out = pd.DataFrame(self.excess(b[FEATURES].to_numpy(float)), columns=FEATURES)
        return out.assign(_id=b["_id"].to_numpy(np.int64), **{c: (kind == i).astype(np.int64) for i, c in enumerate(COUNTS)})

    @staticmethod
    def _distinct(b: pd.DataFrame) -> pd.DataFrame:
        """The distinct excesses, and how often each counts as what."""
        return b.groupby(FEATURES, as_index=False)[COUNTS].sum()

    def excess(self, x: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(0, x - self.usual) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(self.excess(x)) if hasattr(self, "forest") else np.zeros(len(x))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, most_repeats: int = 50, repeats_from: int = 0, good_loss: float = GOOD_LOSS) -> DataFrame:
    """Verdicts on all rows of docs: _id, _th, BASE, FEATURES, base_failed, score, kept; one row for each row of docs.

    base_failed: under min_words words, or over most_repeats percent of them in repeated 3-word windows (of
    texts with repeats_from words or more). Such documents go. Of the others those go whose isolation score is over the threshold: forest and threshold are fitted on labelled
    rows that the base rules keep, all of them, and the threshold lets all but good_loss of the good ones pass. The driver
    gets sums of a size that doesn't grow with the rows.

    Null or empty text: no words. Null ids are judged as others but never labelled. Without labels only the base rules
    judge. An empty table gives an empty table; other columns of docs are not read.
    """
    stats = C.written(with_statistics(docs, id_col, text_col), "quality")
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL").groupBy("_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed(min_words, most_repeats, repeats_from)).select("_id", *FEATURES).join(known, "_id")
    fitted = Judge(SparkRows(C.written(rows, "quality-labelled")), good_loss)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["score"] = fitted.score(b[FEATURES].to_numpy(float))
            b["kept"] = b["score"] <= fitted.limit
            yield b

    columns = ", ".join(["_id long", "_th long", *(f"{n} long" for n in BASE), *(f"{n} double" for n in FEATURES), "score double", "kept boolean"])
    out = stats.mapInPandas(scored, columns)
    return out.withColumn("base_failed", base_failed(min_words, most_repeats, repeats_from)).withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"))
    return out.select(F.col("_id").alias("doc_id"), *BASE, "base_failed", "kept", "score")
