"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LENGTH = 4096
END_ID = 2
#: Documents to a group on average. A group is packed in one task; this bounds its memory whatever the input.
GROUP_DOCS = 8192
#: Words whose ids a worker remembers, some 80 MB.
CACHE_WORDS = 500_000
#: Bytes of text that are encoded at once; a longer text goes alone.
SLICE_BYTES = 6 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Arrays of ids, the same that `tokenizers` gives for the file.

    The file's rules split a text at white space and further into words, and merge within each: a word has the same ids
    everywhere and is merged once. Texts of a slice are split and their parts made distinct by Arrow; distinct parts
    are split into words, words looked up, and the ids of all texts gathered from theirs. That short way takes texts of
    letters whose lower case and normal form are one character; all others, and those that hold a special token's
    string, go through `tokenizers` as a whole.
    """

    #: What keeps a text from the short way.
    OTHER = r"<\||[^\t-\r\x20-\x7E\x{A1}-\x{12F}\x{131}-\x{17E}]"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        pre = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(pre[0]["pattern"]["Regex"])
        bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, pre[1]]}}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        suffix, vocab = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.empty(0, np.uint32), np.zeros(1, np.int64)  # of known words, one after another

    def merge(self, new: list[str]) -> None:
        """Learns the ids of words: they are encoded as one text, and a word's last id ends it."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):
            raise ValueError("the tokenizer doesn't mark where words end")
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])

    def parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, one after another, and where each ends."""
        words: list[str] = []
        upto = []
        for p in parts:
            if p.isalpha():
                words.append(p)
            else:
                words += self.words.findall(p)
            upto.append(len(words))
        if len(self.known) > CACHE_WORDS:
            self.forget()
        if new := set(words).difference(self.known):
            self.merge(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        lengths = self.ends[at + 1] - self.ends[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.array(upto, np.int64)]
        return self.ids[C.ragged(self.ends[at], lengths)], ends

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        flat = split.flatten().dictionary_encode()
        ids, ends = self.parts(flat.dictionary.to_pylist())
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        at = flat.indices.to_numpy()
        lengths = (ends - starts)[at]
        ids = ids[C.ragged(starts[at], lengths)]
        first = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        bounds = np.concatenate([[0], np.cumsum(lengths)])[first].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; texts hold no null."""
        other = pc.match_substring_regex(texts, self.OTHER).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i, ids in zip(np.flatnonzero(~other).tolist(), self.plain(texts.filter(pa.array(~other))), strict=True):
            out[i] = ids
        for i in np.flatnonzero(other).tolist():
            out[i] = np.array(self.whole.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, length: int, end_id: int, keep_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document of docs (doc_id, _text) cut into full
    sequences and a rest."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.binary())] * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        tok, end = tokenizer(path), np.array([end_id], "<u4")
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text")
            for first, stop in C.slices(texts, SLICE_BYTES):
                out: list[tuple] = []
                for doc_id, found in zip(doc_ids[first:stop], tok.encode(texts.slice(first, stop - first)), strict=True):
                    ids = np.concatenate([found, end]).astype("<u4").tobytes()
                    n = len(ids) // 4
                    for a in range(0, n, length):
                        part = ids[4 * a : 4 * (a + length)]
                        out.append((doc_id, a, len(part) // 4, zlib.crc32(part), n, part))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=False)], names=[n for n, _ in fields])

    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each item; items must come longest first. A tournament tree holds at each node the most room left in
    the bins below it, so the leftmost bin with room for an item is found in log(n) steps."""
    leaves = 1 << max(0, (len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    out = []
    for n in lengths:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < n:
                at += 1
        out.append(at - leaves)
        tree[at] -= n
        at //= 2
        while at:
            most = tree[2 * at] if tree[2 * at] > tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == most:
                break
            tree[at] = most
            at //= 2
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, path: str | None = None, group_docs: int = GROUP_DOCS, seed: int = 17, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `length` tokens.

    A document is its ids and end_id. It is cut into full sequences and a rest; the rests are packed within groups that
    a hash deals out, longest first, each into the first sequence with room. Returns a row for each piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, and with keep_ids the ids as little-endian 32-bit bytes.

    Null or empty text: end_id alone. Repeated rows and ids: documents of their own. Ties of length go by id, then
    start. An empty table gives an empty table; other columns are not read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), C.text_of(text_col).alias("_text"))
    groups = max(1, math.ceil(docs.count() / group_docs))
    cut = pieces(src, path or default_tokenizer(), length, end_id, keep_ids)
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.lit(seed)), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        frame["_bin"] = first_fit_decreasing(frame["length"].tolist(), length)
        frame["offset"] = frame.groupby("_bin")["length"].cumsum() - frame["length"]
        frame["sequence_id"] = frame["_group"] * 2**32 + frame["_bin"]
        return frame.drop(columns=["_group", "_bin"])

    return cut.groupBy("_group").applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))
