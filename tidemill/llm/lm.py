"""LM scoring: the marginal probability of a text over all segmentations into the pieces of an existing vocabulary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Words with at least 1/HEAVY_SHARE of all words travel with the scoring code: HEAVY_SHARE of them at most, whatever
#: the input. All others are looked up by a shuffle join, in which none of them is a burden.
HEAVY_SHARE = 100_000
#: Distinct words that a counting task holds before it sends their counts on.
MOST_WORDS = 400_000
#: Of the pieces' weights, so many tokens come from their ranks in the vocabulary file and the rest from counts.
PRIOR_TOKENS = 1000.0
START = "▁"
#: Marks a row that stands for a document's own sums. No word starts with a space.
OWN = " "
#: Stands for the end of a text among the pieces, once; no word starts with a space.
END = " end"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, float]:
    """piece -> prior weight, which falls as 1/rank: the file's scores are ranks. Pieces with a start mark elsewhere
    than at their start can't stand within a word and are left out; bytes keep their names, <0x00> to <0xFF>."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i)) and START not in m.id_to_piece(i)[1:]]
    top = max(m.get_score(i) for i in kept)
    weights = {m.id_to_piece(i): 1.0 / (100.0 + top - m.get_score(i)) for i in kept}
    for b in range(256):
        weights.setdefault(f"<0x{b:02X}>", min(weights.values()))
    total = sum(weights.values())
    return {p: w / total for p, w in weights.items()}


class Lattice:
    """log_probability(word): log of the sum over all segmentations of the word, start mark first, into pieces.

    A character that is no piece stands as its bytes. Pieces don't reach over words, so a text's marginal is the
    product of its words' and the end's; and as the pieces that start a word close the word before, the probabilities
    of all words and the end sum to one.
    """

    def __init__(self, logs: dict[str, float]):
        self.logs = {p: v for p, v in logs.items() if not (len(p) == 6 and p.startswith("<0x"))}
        self.bytes = [logs[f"<0x{b:02X}>"] for b in range(256)]
        self.prefixes = {p[:i] for p in self.logs for i in range(1, len(p) + 1)}

    def log_probability(self, word: str) -> float:
        s, logs, prefixes, exp, log = START + word, self.logs, self.prefixes, math.exp, math.log
        n = len(s)
        best = [-math.inf] * (n + 1)  # the recursion's log sums, each as its largest term and the sum over it
        over = [0.0] * (n + 1)
        best[0], over[0] = 0.0, 1.0
        for i in range(n):
            if over[i] == 0.0:
                continue
            here = best[i] + log(over[i])
            j = i + 1
            if s[i] not in logs:
                self._add(best, over, j, here + sum(self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass")))
            while j <= n:
                part = s[i:j]
                if part not in prefixes:
                    break
                v = logs.get(part)
                if v is not None:
                    v += here
                    b = best[j]
                    if v <= b:
                        over[j] += exp(v - b)
                    else:
                        over[j] = over[j] * exp(b - v) + 1.0 if over[j] else 1.0
                        best[j] = v
                j += 1
        return best[n] + log(over[n])

    @staticmethod
    def _add(best: list[float], over: list[float], j: int, v: float) -> None:
        if v <= best[j]:
            over[j] += math.exp(v - best[j])
        else:
            over[j] = over[j] * math.exp(best[j] - v) + 1.0 if over[j] else 1.0
            best[j] = v

    def longest(self, word: str) -> list[str]:
        """The word's pieces by longest match from the left: a first guess for counts."""
        s, out, i = START + word, [], 0
        while i < len(s):
            j, found = i + 1, 0
            while j <= len(s) and (part := s[i:j]) in self.prefixes:
                if part in self.logs:
                    found = j
                j += 1
            if found:
                out.append(s[i:found])
                i = found
            else:
                out += [f"<0x{b:02X}>" for b in s[i].encode("utf-8", "surrogatepass")]
                i += 1
        return out

    def best(self, word: str) -> list[str]:
        """The pieces of the word's likeliest segmentation."""
        s, logs, prefixes = START + word, self.logs, self.prefixes
        n = len(s)
        value, start = [-math.inf] * (n + 1), [0] * (n + 1)
        value[0] = 0.0
        for i in range(n):
            here = value[i]
            if here == -math.inf:
                continue
            if s[i] not in logs:
                v = here + sum(self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass"))
                if v > value[i + 1]:
                    value[i + 1], start[i + 1] = v, i
            j = i + 1
            while j <= n and (part := s[i:j]) in prefixes:
                v = logs.get(part)
                if v is not None and here + v > value[j]:
                    value[j], start[j] = here + v, i
                j += 1
        out, j = [], n
        while j:
            part = s[start[j] : j]
            out += [part] if part in logs else [f"<0x{b:02X}>" for b in part.encode("utf-8", "surrogatepass")]
            j = start[j]
        return out


def lower_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def held_out(id_col: Column, fold: int, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, total): counts in training rows and in all rows of docs (_text, _held)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            ws = list(counts[0].keys() | counts[1].keys())
            c, h = [counts[0][w] for w in ws], [counts[1][w] for w in ws]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array([a + b for a, b in zip(c, h, strict=True)], pa.int64())], names=["word", "c", "total"])

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[held].update(lower_words(text))
                if len(counts[0]) + len(counts[1]) > MOST_WORDS:
                    yield out()
        yield out()

    parts = docs.select("_text", "_held").mapInArrow(count, "word string, c long, total long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


@dataclass
class Model:
    """What training gave, besides the word counts: sums, and the pieces' log probabilities (one for each piece)."""

    tokens: int  # N, ends included
    distinct: int  # V, the end included
    ends: int
    discount: float
    logs: dict[str, float]
    end_log: float

    def base(self, c: int) -> float:
        return math.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def score(self, c: int, log_p: float) -> float:
        """log10 of max(c - d, 0) / N + d * V / N * p: what the counts give up goes to the lattice, so the whole stays a
        distribution over texts."""
        if not self.tokens:
            return log_p / math.log(10)
        known = max(c - self.discount, 0.0) / self.tokens
        if known:
            return math.log10(known + self.discount * self.distinct / self.tokens * math.exp(log_p))
        return math.log10(self.discount * self.distinct / self.tokens) + log_p / math.log(10)


def piece_weights(words: DataFrame, lattice: Lattice, guess: bool, prior: dict[str, float]) -> dict[str, float]:
    """The log weight of each piece from how often it stands in the distinct words, PRIOR_TOKENS of them by the prior.
    A word counts once however frequent it is: what the discount leaves to the lattice, it leaves by word. The driver
    gets a count for each piece of the file."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        cut = lattice.longest if guess else lattice.best
        for b in batches:
            for word in b["word"]:
                n.update(cut(word))
        if n:
            yield pd.DataFrame({"piece": list(n.keys()), "n": list(n.values())})

    pieces = {r.piece: r.n for r in words.mapInPandas(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    total = sum(pieces.values()) + PRIOR_TOKENS + 1
    return {p: math.log((pieces.get(p, 0) + PRIOR_TOKENS * w) / total) for p, w in prior.items()} | {END: -math.log(total)}


def trained(counts: DataFrame, ends: int, path: str) -> Model:
    """counts: word_counts() as a written table. Pieces are counted by longest match, then by best segmentation."""
    prior = vocabulary(path)
    known = counts.where("c > 0")
    r = known.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    logs = piece_weights(known.select("word"), Lattice({p: math.log(w) for p, w in prior.items()}), True, prior)
    logs = piece_weights(known.select("word"), Lattice(logs), False, prior)
    ones, twos = r[2], r[3]
    return Model(r[1] + ends, r[0] + (ends > 0), ends, ones / (ones + 2 * twos) if ones and twos else 0.5, logs, logs[END])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, path: str | None = None, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """Scores of all rows of docs by a model of those that aren't held out: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score.

    Tokens are the words, A-Z lowered, and one end. base_score is the smoothed unigram score of the words. score is the
    log10 probability of the text: each word's is its discounted share of the training tokens, and what the discount
    leaves over, times its marginal over all segmentations into the pieces of the vocabulary file. The pieces' weights
    are their counts in all training words, over a prior from their ranks.

    Each word's lattice is run once over the table of all words. Null or empty text: the end alone. Null ids are held
    out, as the empty id is. Repeated rows get equal scores. Without training rows the prior scores alone. An empty
    table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_of(text_col).alias("_text"), held_out(F.col(id_col), held_fold, folds).alias("_held"))
    counts = C.written(word_counts(src), "words")
    ends = src.where("NOT _held").count()
    model = trained(counts, ends, path or default_vocabulary())
    lattice = Lattice(model.logs)

    def lattice_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["base"] = [model.base(c) for c in b["c"]]
            b["model"] = [model.score(c, lattice.log_probability(w)) for c, w in zip(b["c"], b["word"], strict=True)]
            b["known"] = (b["c"] > 0).astype("int64")
            yield b[["word", "total", "base", "model", "known"]]

    words = C.written(counts.mapInPandas(lattice_scores, "word string, total long, base double, model double, known long"), "scores")
    everything = words.agg(F.sum("total")).first()[0] or 0
    heavy = F.col("total") * heavy_share >= everything
    known = {r.word.encode("utf-8", "surrogatepass"): (r.base, r.model, r.known) for r in words.where(heavy).select("word", "base", "model", "known").toLocalIterator()}
    held = spark.sparkContext.broadcast(known)
    end = (model.base(ends), model.score(ends, model.end_log), int(ends > 0))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each light word of each document, and one for the document with the sums of the others."""
        get = held.value.get
        for batch in batches:
            ids, ths, ws, tfs, tokens, base, score, sure = [], [], [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                th = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                n, b, m, k = Counter(lower_words(text)), end[0], end[1], end[2]
                start = len(ws)
                for w, tf in n.items():
                    if (v := get(w)) is not None:
                        b += tf * v[0]
                        m += tf * v[1]
                        k += tf * v[2]
                    else:
                        ws.append(w)
                        tfs.append(tf)
                light = len(ws) - start
                tokens += [0] * light + [n.total() + 1]
                base += [0.0] * light + [b]
                score += [0.0] * light + [m]
                sure += [0] * light + [k]
                ws.append(f"{OWN}{th}".encode())
                tfs.append(0)
                ids += [doc_id] * (light + 1)
                ths += [th] * (light + 1)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(ws, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int32()), pa.array(tokens, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(sure, pa.int64())], names=["_id", "_th", "word", "tf", "_tokens", "_base", "_score", "_sure"])

    rows = src.select("_id", "_text").mapInArrow(split, "_id long, _th long, word string, tf int, _tokens long, _base double, _score double, _sure long")
    rows = rows.join(words.where(~heavy).select("word", "base", "model", "known"), "word", "left")
    add = lambda own, tf: F.sum(F.col(own) + F.coalesce(F.col("tf") * F.col(tf), F.lit(0)))
    # Repeated rows have one sum between them; _n of them share it.
    sums = rows.groupBy("_id", "_th").agg(F.count_if(F.col("_tokens") > 0).alias("_n"), F.max("_tokens").alias("n_tokens"), add("_base", "base").alias("b"), add("_score", "model").alias("s"), add("_sure", "known").alias("k"))
    sums = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return sums.select(
        F.col("_id").alias("doc_id"),
        held_out(F.col("_id"), held_fold, folds).alias("held_out"),
        "n_tokens",
        (F.col("k") / F.col("_n")).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("b") / F.col("_n")).alias("base_score"),
        (F.col("s") / F.col("_n")).alias("score"),
    )


def op7_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(C.read(spark, sf_dir, "documents"))
