"""The queries against brute force on a small fixture with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NO_DOCS = "corpus without rows"


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def corpus():
    rng = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "déjà", "ÉTÉ", "x", "zeta9", "omega!", "kappa", "lambda", "mu", "nu"] + [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n ", "one", "One two", "a b c", "\n\n", "same line\nother " + "w1 " * 3]
    for _ in range(40):
        texts.append("\n".join(" ".join(rng.choices(vocab, k=rng.randint(3, 25))) for _ in range(rng.randint(1, 6))))
    for i in range(12):  # a line in many documents, in several spellings
        texts.append(f"Shared Line here\n{rng.random()}\n  shared line HERE\t")
    long = " ".join(rng.choices(vocab, k=6000))
    base = rng.choices(vocab, k=120)
    texts += [long, long + " end", " ".join(base), " ".join(base).upper()]
    for _ in range(8):  # near copies
        t = list(base)
        for _ in range(rng.randint(1, 4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(" ".join(t))
    texts += ["Licensed under CC BY-NC 4.0.", "see the GNU General-Public license; the gnu general public License and MIT license", "cc bycc by", "\x85w\xa0x y", "It's 123 ½ <|endoftext|> ok"]
    ids = rng.sample(range(1, 10_000), len(texts))
    return [(i, t, "en", rng.choice(["b", "a", "Z", None, "c"]), len(t or "")) for i, t in zip(ids, texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 0)) for r in rows[:60]] + [(r[0], 0, 0) for r in rows[60:70]], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return d


def run(spark, name, d):
    from tidemill.llm.catalog import QUERIES

    return [r.asDict() for r in QUERIES[name](spark, d).collect()]


def by_id(out):
    assert len({r["doc_id"] for r in out}) == len(out)
    return {r["doc_id"]: r for r in out}


def test_empty_tables(spark, empty):
    from tidemill.llm.catalog import QUERIES

    for name in QUERIES:
        assert run(spark, name, empty) == [], name


def test_op1(spark, tables, rows):
    out = by_id(run(spark, "op1_order_minhash", tables))
    order = sorted(rows, key=lambda r: -r[0])
    assert len(out) == len(rows)
    for i, (doc_id, text, *_) in enumerate(order):
        t, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        r = out[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
        nf = out[order[(i + 1) % len(order)][0]]["fingerprint"]
        assert (r["near_next"] == 1) == (r["fingerprint"] == nf)
    texts = {r[0]: lowered(r[1] or "") for r in rows}
    same = defaultdict(set)
    for r in rows:
        same[r[1] or ""].add(out[r[0]]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and texts


def test_op1_follows_order(spark):
    from tidemill.llm import fingerprints as fp

    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(words)
    halves = " ".join(words[200:] + words[:200])
    edits = list(words)
    for i in rng.sample(range(400), 8):
        edits[i] = "new"
    shuffled = " ".join(rng.sample(words, 400))
    twice = " ".join(["ha"] * 300)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([a, a, " ".join(edits), halves, shuffled, twice, twice + " ha"])], "id int, t string")
    s = {r.id: r.s for r in fp.with_sketch(df, "t", "s").collect()}
    like = lambda x, y: sum(p == q for p, q in zip(s[x], s[y])) / len(s[x])
    assert like(0, 1) == 1 and 0.5 < like(0, 2) < 1 and like(0, 3) < 0.75 and like(0, 4) < 0.05
    assert like(5, 6) > 0.5  # numbered occurrences make long repetitions differ by little


def plain_sketch(text, k, tuple_size, slots):
    """Order MinHash by plain loops, with the hashes of the columns."""
    import struct

    import xxhash

    def chain(values, sizes="q"):
        seed = 42
        for i, v in enumerate(values):
            data = v.encode() if isinstance(v, str) else struct.pack("<" + sizes[min(i, len(sizes) - 1)], v)
            seed = xxhash.xxh64_intdigest(data, seed)
        return seed - (seed >> 63 << 64)

    unsigned = lambda x: x % 2**64
    words = [chain([w]) for w in WORD.findall(text)]
    if not words:
        return [0] * slots
    kmers = [chain(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [chain(words)]
    seen, ranked = Counter(), []
    for pos, h in enumerate(kmers):
        top = unsigned(h) >> 28
        ranked.append((unsigned(chain([top, seen[top]], "qi")) >> 28, pos))  # the number of the k-mer among its equals
        seen[top] += 1
    ranked.sort()
    out = []
    for i in range(slots):
        start = 2**63 // slots * i
        first = sum((r << 27) | pos < start for r, pos in ranked)
        picked = sorted({ranked[(first + j) % len(ranked)][1] for j in range(tuple_size)})
        out.append(unsigned(chain([kmers[p] for p in picked])) >> 32)
    return out


def test_op1_against_plain_loops(spark):
    """The array expressions: k-mers, their numbers among equals, ranks, tuples in the order of the text."""
    from tidemill.llm import fingerprints as fp

    rng = random.Random(3)
    texts = ["", " \t", "a", "a b", "a b a b a b a b c a b a b a", "x " * 200] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 60))) for _ in range(20)]
    for k, tuple_size, slots in ((2, 2, 8), (5, 2, 64), (1, 3, 16)):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        got = {r.id: list(r.s) for r in fp.with_sketch(df, "t", "s", k, tuple_size, slots).collect()}
        assert got == {i: plain_sketch(t, k, tuple_size, slots) for i, t in enumerate(texts)}


def test_op1_spread(spark):
    """Likeness falls with the words that are changed, and strays little: its mean over texts and its spread."""
    import statistics as st

    from tidemill.llm import fingerprints as fp

    rng, rows = random.Random(6), []
    for i in range(60):
        words = [f"w{rng.random()}" for _ in range(64)]
        for changes in (1, 4, 16):
            other = list(words)
            for j in rng.sample(range(64), changes):
                other[j] = "new"
            rows.append((changes, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "changes int, a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "sa"), "b", "sb").select("changes", fp.likeness("sa", "sb").alias("x"))
    found = defaultdict(list)
    for r in df.collect():
        found[r.changes].append(r.x)
    mean = {c: st.mean(v) for c, v in found.items()}
    # One word changes 5 of 60 k-mers: both of a tuple are least in both texts with a chance of about (55 / 65) ** 2.
    assert abs(mean[1] - (55 / 65) ** 2) < 0.05 and mean[1] > mean[4] + 0.15 > mean[16] + 0.3 and max(map(st.pstdev, found.values())) < 0.12


def test_op2(spark, tables, rows):
    out = by_id(run(spark, "op2_source_mixing", tables))
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += size[r[0]]
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_ = 1.5 * sum(totals.values()), set(order)
    target = {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * totals[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        o = out[r[0]]
        assert o["size"] == size[r[0]] and o["source_size"] == totals[r[3]] and o["target"] == pytest.approx(target[r[3]])
        assert 0 <= o["taken"] <= 2 * o["size"]
        taken[r[3]] += o["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert out == by_id(run(spark, "op2_source_mixing", tables))


def test_op2_schedule_is_even(spark):
    from tidemill.llm import mixing

    targets = spark.createDataFrame([("a", 700.0), ("b", 290.0), ("c", 10.0)], "_s string, target double")
    slots = {(r["_s"], r["_block"]): r["slot"] for r in mixing.schedule(spark, targets, 5000, 0.2).collect()}
    assert len(set(slots.values())) == len(slots) == 5000 and sum(x < 5000 for x in slots.values()) >= 4990
    for s, share in (("a", 0.7), ("b", 0.29), ("c", 0.01)):
        at = [slots[s, i] for i in range(sum(1 for k in slots if k[0] == s))]
        assert at == sorted(at) and len(at) == round(5000 * share)
        for n in (100, 777, 5000):
            assert abs(sum(x < n for x in at) - share * n) < 6
        points = [t for t in range(5000) if {"a": 0, "b": 0.7, "c": 0.99}[s] <= t * mixing.GOLDEN % 1 < {"a": 0.7, "b": 0.99, "c": 1}[s]]
        assert [x for x in at if x < 5000] == points[: len(at)]


def test_op2_slots_decide(spark, rows):
    """What is taken, and in which slot, against a walk over the schedule's points, block by block."""
    from tidemill.llm import mixing

    block, golden = 16, mixing.GOLDEN
    out = [r.asDict() for r in mixing.mix(spark.createDataFrame(rows, DOCS), block=block).collect()]
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    target, streams = {}, defaultdict(list)
    for r in out:
        i = r["row"]["doc_id"]
        s = next(x[3] for x in rows if x[0] == i)
        target[s] = r["target"]
        streams[s].append((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i))
    order = sorted(target, key=lambda s: (s is None, s or ""))
    words = {s: [i for _, i in sorted(streams[s]) for _ in range(size[i])] * 2 for s in order}
    need = {s: -(-round(target[s]) // block) for s in order}
    total, slots = sum(target.values()), -(-sum(target.values()) // block)
    upto, walk = 0.0, []
    bounds = []
    for s in order:
        bounds.append((s, upto / total, (upto + target[s]) / total))
        upto += target[s]
    for t in range(int(slots)):
        walk += [(t, s) for s, lo, hi in bounds if lo <= t * golden % 1 < hi]
    given = Counter(s for _, s in walk)
    t = int(slots)
    for s in order:
        for _ in range(max(0, need[s] - given[s])):
            walk.append((t, s))
            t += 1
    taken, first, at = Counter(), {}, Counter()
    for t, s in walk:
        if at[s] < need[s]:
            for i in words[s][at[s] * block : min((at[s] + 1) * block, round(target[s]))]:
                taken[i] += 1
                first.setdefault(i, t)
            at[s] += 1
    assert {r["row"]["doc_id"]: (r["taken"], r["first_slot"]) for r in out} == {i: (taken[i], first.get(i)) for i in size}
    assert all(r["first_slot"] == (r["slots"] or [None])[0] and len(r["slots"]) <= 2 for r in out)


def shingle_set(t, k):
    w = WORD.findall(lowered(t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def classes(sets, num, den):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def test_op3(spark, tables, rows):
    out = by_id(run(spark, "op3_ngram_jaccard_join", tables))
    sets = {r[0]: shingle_set(r[1], 4) for r in rows}
    want = classes(sets, 85, 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == {i: (len(sets[i]), want[i]) for i in sets}
    assert max(Counter(want.values()).values()) > 3


def test_op3_many_near_copies(spark):
    """Pages and trees: one family whose texts link in chains, cut into several pages."""
    from tidemill.llm import jaccard

    rng = random.Random(9)
    words = [f"v{i}" for i in range(60)]
    texts = []
    for i in range(150):
        if i % 3 == 0:
            words = list(words)
            words[rng.randrange(60)] = f"n{i}"
        t = list(words)
        if rng.random() < 0.7:
            t[rng.randrange(60)] = f"m{i}"
        texts.append(" ".join(t))
    old, jaccard.PAGE = jaccard.PAGE, 20
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["_id"]: r["component_id"] for r in jaccard.similarity_classes(df, k=3, num=80, den=100).collect()}
    finally:
        jaccard.PAGE = old
    assert got == classes({i: shingle_set(t, 3) for i, t in enumerate(texts)}, 80, 100)


def test_op3_blocks_lose_no_link():
    import numpy as np

    from tidemill.llm.jaccard import Blocks, linked

    rng, links = np.random.default_rng(2), 0
    blocks = Blocks(85, 100)
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop = rng.integers(0, max(1, len(a) // 8) + 1)
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 10) + 1))).astype(np.uint64)]))
        if len(b) and not np.array_equal(a, b) and linked(a, b, 85, 100):
            links += 1
            assert set(blocks.signatures(a).tolist()) & set(blocks.signatures(b).tolist())
    assert links > 300


def test_op3_counts_of_any_size():
    """Many shingles in one group: counts are whole, so the bound stays above the overlap."""
    import numpy as np

    from tidemill.llm.jaccard import DIMS, CountTree, linked

    base = np.arange(140_000, dtype=np.uint64) * np.uint64(DIMS)
    sets = [base[i * 1000 :] for i in range(4)]
    assert linked(sets[0], sets[3], 85, 100)
    tree = CountTree(sets, np.arange(4))
    assert {frozenset(p) for p in tree.pairs(tree, 85, 100)} == {frozenset((i, j)) for i in range(4) for j in range(i)}


def test_op3_trees_against_all_pairs():
    """Trees give each pair within the bound once, within one and between two; and none at all where the roots are apart."""
    import numpy as np

    from tidemill.llm.jaccard import DIMS, CountTree

    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 500 if i % 3 else 2**63, int(rng.integers(1, 60))).astype(np.uint64)) for i in range(90)]
    counts = [np.bincount((s % np.uint64(DIMS)).astype(np.int64), minlength=DIMS) for s in sets]
    within = lambda i, j: 185 * np.minimum(counts[i], counts[j]).sum() >= 85 * (len(sets[i]) + len(sets[j]))
    for n, m in ((1, 1), (1, 40), (17, 3), (50, 40), (2, 0)):
        a, b = np.arange(n), np.arange(n, n + m)
        one = CountTree(sets, a)
        inside = [frozenset(p) for p in one.pairs(one, 85, 100)]
        assert len(set(inside)) == len(inside) and set(inside) == {frozenset((i, j)) for i in a for j in a if i < j and within(i, j)}
        if m:
            both = list(one.pairs(CountTree(sets, b), 85, 100))
            assert len(set(both)) == len(both) and set(both) == {(i, j) for i in a for j in b if within(i, j)}


def test_op3_outsiders(spark):
    """Two families in one block, larger than a page, and texts that link with none: classes are those of all pairs."""
    from tidemill.llm import jaccard

    rng = random.Random(21)
    shared, texts = [f"s{i}" for i in range(40)], []
    for f in range(3):
        own = shared + [f"f{f}x{i}" for i in range(12)]
        for _ in range(30):
            t = list(own)
            t[rng.randrange(40, 52)] = f"r{rng.random()}"
            texts.append(" ".join(t))
    rng.shuffle(texts)
    old, jaccard.PAGE = jaccard.PAGE, 7
    whole, jaccard.WHOLE = jaccard.WHOLE, 3
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r["_id"]: r["component_id"] for r in jaccard.similarity_classes(df, k=2, num=80, den=100).collect()}
    finally:
        jaccard.PAGE, jaccard.WHOLE = old, whole
    assert got == classes({i: shingle_set(t, 2) for i, t in enumerate(texts)}, 80, 100)


def test_op4(spark, tables, rows):
    out = by_id(run(spark, "op4_license_scan", tables))
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    some = 0
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))
        at = {k: [i for i in range(len(w)) if w[i : i + len(p.split())] == p.split()] for k, p in phrases.items()}
        places = sorted(sum(at.values(), []))
        r = out[doc_id]
        base = sorted(k for k in at if at[k])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), places[0] if places else None, places[-1] if places else None)
        assert r["base_labels"] == ",".join(base)
        labels = r["labels"].split(",") if r["labels"] else []
        assert set(base) <= set(labels) and labels == sorted(set(labels)) and 0 <= r["score"] <= 1
        some += len(places)
    assert some >= 4 and any("cc-by-nc" in r["labels"] for r in out.values())


def test_op4_notices(spark):
    from tidemill.llm import licenses

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
    changed = mit.replace("hereby ", "").replace("a copy", "one more copy")
    noise = "of this software and the software to any person " * 20
    df = spark.createDataFrame([(1, mit), (2, changed), (3, noise), (4, mit + " and " + mit), (4, mit + " and " + mit)], "doc_id long, text string")
    out = [r.asDict() for r in licenses.scan_licenses(df).collect()]
    got = defaultdict(list)
    for r in out:
        got[r["row"]["doc_id"]].append(r)
    assert got[1][0]["labels"] == "mit" and got[1][0]["score"] == 1.0 and got[1][0]["n_base"] == 0
    assert got[2][0]["labels"] == "mit" and 0.7 <= got[2][0]["score"] < 1
    assert got[3][0]["labels"] == ""
    assert len(got[4]) == 2 and all(len(r["spans"]) == 2 for r in got[4])


def test_op4_deciding_words(spark):
    from tidemill.llm import licenses

    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation"
    cc = "Licensed under a Creative Commons Attribution{} 4.0 International License"
    want = {
        gpl.format(""): "gpl",
        gpl.format("Lesser "): "lgpl",
        gpl.format("Affero "): "agpl",
        "Licensed under the GNU General Public License version 2": "gpl",
        "Licensed under the GNU General Public License.": "gpl",
        "Licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "Licensed under the GNU General Public License v3.": "gpl,gpl-3.0",
        "so it is licensed under the GNU General Public License, either version 3 or later": "gpl,gpl-3.0",
        cc.format(""): "cc-by",
        cc.format(" ShareAlike"): "cc-by-sa",
        cc.format("-NonCommercial"): "cc-by-nc",
        cc.format("-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
    }
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string"))
    assert {r["row"]["text"]: r["labels"] for r in out.collect()} == want


def test_op5(spark, tables, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    bins = defaultdict(list)
    for r in run(spark, "op5_packing", tables):
        pieces[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096


def test_op5_first_fit():
    from tidemill.llm.packing import first_fit_decreasing

    rng = random.Random(3)
    for n in (0, 1, 2, 7, 300):
        items = sorted((rng.randint(1, 100) for _ in range(n)), reverse=True)
        rooms, want = [], []
        for x in items:
            at = next((i for i, room in enumerate(rooms) if room >= x), len(rooms))
            if at == len(rooms):
                rooms.append(100)
            rooms[at] -= x
            want.append(at)
        assert first_fit_decreasing(items, 100) == want


def test_op5_ids_of_odd_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemill.llm import common, packing

    texts = ["", " ", " a  b ", "don't 'start' x's,'re we'll 12ab", "'s", "<|endoftext|> x", "İI\x85y\xa0z", "ÀÉ ß ŁŸ ı", "a\x0bb\x0cc\r\n", "ｆｕｌｌ 𝔘", "e\u0301 x", "\x1c a", "don't " * 3000]
    want = [e.ids for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(texts, add_special_tokens=False)]
    tok = packing.WordTokenizer(packing.default_tokenizer())
    for most in (1, 100, 1 << 20):  # alone, a few, all at once
        got = [ids.tolist() for a, b in common.slices(pa.array(texts), most) for ids in tok.encode(pa.array(texts).slice(a, b - a))]
        assert got == want
    old, packing.CACHE_WORDS = packing.CACHE_WORDS, 2
    try:
        assert [tok.encode(pa.array([t]))[0].tolist() for t in texts] == want
    finally:
        packing.CACHE_WORDS = old


def test_op5_little_padding(spark, sf_dir):
    """All sequences but the last few of a group are nearly full: at most 1% of what they hold is padding."""
    from tidemill.llm import packing

    d = sf_dir.replace("sf0.001", "sf0.01")
    fill = packing.pack(spark.read.parquet(f"{d}/documents.parquet")).groupBy("sequence_id").agg(F.sum("length").alias("n"))
    r = fill.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.max("n").alias("most")).first()
    least = -(-r["tokens"] // 4096)
    assert r["most"] <= 4096 and r["sequences"] <= 1.01 * least + 1


def test_op6(spark, tables, rows):
    out = by_id(run(spark, "op6_line_dedup", tables))
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    some = 0
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if n[key(x)] < 10]
        some += len(lines) - len(kept)
        assert (out[doc_id]["n_lines"], out[doc_id]["n_dropped"]) == (len(lines), len(lines) - len(kept))
        assert out[doc_id]["kept_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
    assert some >= 20


def test_op6_light_and_heavy_agree(spark, tables):
    from tidemill.llm import lines

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    get = lambda: sorted((r["row"]["doc_id"], r["kept"]) for r in lines.drop_repeated_lines(docs).collect())
    all_heavy = get()
    old, lines.HEAVY_SHARE = lines.HEAVY_SHARE, 1
    try:
        assert get() == all_heavy
    finally:
        lines.HEAVY_SHARE = old


def test_op7(spark, tables, rows):
    import math

    from tidemill.llm import lm

    words = {r[0]: [w for w in WORD.findall(lowered(r[1] or ""))] for r in rows}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    c = Counter(w for i in words if not held[i] for w in [*words[i], " end"])
    n, v = sum(c.values()), len(c)
    for share in (lm.HEAVY_SHARE, 3):  # all words heavy, then most light
        old, lm.HEAVY_SHARE = lm.HEAVY_SHARE, share
        try:
            out = by_id([r.asDict() for r in lm.score_documents(spark.read.parquet(f"{tables}/documents.parquet"), heavy_share=share).collect()])
        finally:
            lm.HEAVY_SHARE = old
        assert any(held.values())
        for i in words:
            tokens = [*words[i], " end"]
            r = out[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(tokens), sum(c[w] > 0 for w in tokens), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens))
            assert math.isfinite(r["score"]) and r["score"] < 0


def test_op7_score_against_plain_loops(spark, tables, rows):
    """The model's score of each text from counts, discount and lattice, one word after another."""
    import math

    from tidemill.llm import lm

    words = {r[0]: WORD.findall(lowered(r[1] or "")) for r in rows}
    train = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    ends = sum(zlib.crc32(str(i).encode()) % 10 > 0 for i in words)
    prior = lm.vocabulary(lm.default_vocabulary())
    logs = {p: math.log(x) for p, x in prior.items()}
    for cut in ("longest", "best"):
        lattice, n = lm.Lattice(logs), Counter()
        for w in train:
            n.update(getattr(lattice, cut)(w))
        total = sum(n.values()) + lm.PRIOR_TOKENS + 1
        logs = {p: math.log((n[p] + lm.PRIOR_TOKENS * x) / total) for p, x in prior.items()}
    lattice = lm.Lattice(logs)
    ones, twos = (sum(c == k for c in train.values()) for k in (1, 2))
    d, tokens, distinct = ones / (ones + 2 * twos), sum(train.values()) + ends, len(train) + 1
    chance = lambda c, p: max(c - d, 0) / tokens + d * distinct / tokens * p
    out = by_id(run(spark, "op7_lattice_scores", tables))
    for i, ws in words.items():
        want = math.log10(chance(ends, 1 / total)) + sum(math.log10(chance(train[w], math.exp(lattice.log_probability(w)))) for w in ws)
        assert out[i]["score"] == pytest.approx(want)


def test_op7_lattice():
    import math
    from itertools import product

    from tidemill.llm.lm import START, Lattice

    logs = {p: math.log(x) for p, x in {START: 0.1, START + "a": 0.2, "a": 0.1, "b": 0.15, "ab": 0.2, "ba": 0.05}.items()}
    logs |= {f"<0x{b:02X}>": math.log(0.2 / 256) for b in range(256)}
    lattice = Lattice(logs)
    for word in ("a", "ab", "abab", "é", "abéa"):
        s, total = START + word, 0.0
        for cuts in product((0, 1), repeat=len(s) - 1):
            parts, start = [], 0
            for i, cut in enumerate((*cuts, 1), 1):
                if cut:
                    parts.append(s[start:i])
                    start = i
            p = 1.0
            for x in parts:
                if x in logs:
                    p *= math.exp(logs[x])
                elif len(x) == 1:
                    p *= math.exp(sum(logs[f"<0x{b:02X}>"] for b in x.encode()))
                else:
                    p = 0.0
            total += p
        assert lattice.log_probability(word) == pytest.approx(math.log(total))
        for cut in (lattice.longest(word), lattice.best(word)[::-1]):
            assert "".join(p for p in cut if not p.startswith("<0x")) == s.replace("é", "")
        assert "".join(p for p in lattice.longest(word) if not p.startswith("<0x")) == s.replace("é", "")
    assert math.isfinite(lattice.log_probability("ab" * 20_000))


def test_op8(spark, tmp_path):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    move = "<meta http-equiv='Refresh' content='0; URL={}'>"
    pages = [
        (1, "http://Example.org/es/x", None),
        (2, "https://example.org/en/12?q#f", ""),
        (3, "http://other.org/es/", "<p>"),
        (4, "http://a.b.com/de/1?x", None),
        (5, "http://b.com/fr", None),
        (6, "http://com/fr/", None),
        (7, "http://b.net/1", link.format("http://b.com/de/1")),
        (8, "http://b.net/2", move.format("/1")),
        (9, "http://c.net/1", link.format("http://b.com/fr/9")),
        (10, "http://c.net/2#top", link.format("http://b.net/3")),
        (11, "http://c.net/1#again", link.format("//b.com/de/2")),
        (12, None, link.format("http://b.com/de/1")),
        (13, "no scheme", None),
        (14, "ftp://EXAMPLE.ORG", None),
        (14, "ftp://EXAMPLE.ORG", None),
        (15, "x://notexample.org/es/", None),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in run(spark, "op8_redirect_classes", str(tmp_path)))
    key = lambda r: (r[0], r[1], r[2], r[3] or "", r[4])
    assert sorted(out, key=key) == [
        (1, "example.org", "/es/x", "example.org/es/", "block"),
        (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "other.org", "/es/", "org/", "allow"),
        (4, "a.b.com", "/de/1", "com/de/", "block"),
        (5, "b.com", "/fr", None, "allow"),
        (6, "com", "/fr/", "com/fr/", "allow"),
        (7, "b.net", "/1", None, "block"),
        (8, "b.net", "/2", None, "block"),
        (9, "c.net", "/1", None, "allow"),
        (10, "c.net", "/2", None, "allow"),
        (11, "c.net", "/1", None, "allow"),
        (12, "", "", None, "allow"),
        (13, "", "", None, "allow"),
        (14, "example.org", "", None, "allow"),
        (14, "example.org", "", None, "allow"),
        (15, "notexample.org", "/es/", "org/", "allow"),
    ]


def test_op8_same_resource(spark):
    """Dot segments, default ports, a rel with several tokens, refreshes and given redirects: aliases of a blocked page."""
    from tidemill.llm import redirects

    link = '<link rel="{}" href="{}">'
    pages = [
        (1, "http://n.net/x/y/z", link.format("nofollow Canonical", "../../a/./b/../c")),
        (2, "http://n.net:80/a/c", link.format("canonical", "//B.com:80/de/1/..")),
        (3, "https://n.net/a/c", None),
        (4, "https://m.net:443", link.format("canonicals", "http://b.com/de/")),
        (5, "https://m.net/q?x=/../y", link.format("canonical", "/..")),
        (6, "https://m.net/", None),
        (7, "http://r.net/old", None),
        (8, "http://r.net/older", "<meta http-equiv=refresh content='1;url=./old'>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://r.net/./old", "http://s.b.com/de/x"), (None, "http://b.com/de/"), ("http://q.net/", None)], "from_url string, to_url string")
    out = {r["_id"]: (r["verdict"], r["alias_of"]) for r in redirects.judge_urls(df, redirects.RULES, redirects=moved).collect()}
    assert {i: v for i, (v, _) in out.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "block"}
    assert out[1][1] == out[2][1] == "http://b.com/de/" and out[5][1] == out[6][1] == out[4][1] == "https://m.net/" and out[3][1] is None
    none = {r["_id"]: (r["rule"], r["verdict"]) for r in redirects.judge_urls(df, []).collect()}
    assert set(none.values()) == {(None, "allow")}


def test_op8_odd_rows(spark):
    """Null ids and urls, repeated rows, a very long url and page, and names that the operator uses itself."""
    from tidemill.llm import redirects

    long = "http://b.com/" + "x" * 200_000
    rows = [(None, None, None), (None, None, None), (None, "http://b.com/de/", ""), (1, long, "<p>" * 100_000), (1, long, "<link rel=canonical href=/de/1>"), (2, "://", None), (3, "http:///p", None), (4, "HTTP://B.COM/de/", None)]
    df = spark.createDataFrame([(*r, "n", "h", 1, "a") for r in rows], "page_id long, url string, html string, _node string, host string, _id int, alias_of string")
    out = redirects.judge_urls(df, redirects.RULES).collect()
    assert len(out) == len(rows)
    assert [r["verdict"] for r in out if r["_id"] == 1] == ["block", "block"]  # one url, so both are aliases of /de/1
    assert sorted((r["host"], r["verdict"]) for r in out if r["_id"] is None) == [("", "allow"), ("", "allow"), ("b.com", "block")]
    assert next(r for r in out if r["_id"] == 4)["rule"] == "com/de/"


def test_op8_classes_of_all_pages(spark, sf_dir):
    """Links drawn between the pages of the tables as redirects: classes and verdicts against union-find and plain rules."""
    from tidemill.llm import redirects

    rng = random.Random(8)
    rules = [("block", "example.com", "/en/"), ("block", "example.org", "/de/"), ("allow", "example.net", "/en/7")]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r["page_id"], r["url"]) for r in pages.select("page_id", "url").collect()]
    links = [(rng.choice(rows)[1], rng.choice(rows)[1]) for _ in range(len(rows) // 2)]
    moved = spark.createDataFrame(links, "from_url string, to_url string")
    out = {r["_id"]: (r["rule"], r["verdict"]) for r in redirects.judge_urls(pages, rules, redirects=moved).collect()}

    def rule(u):
        host, path = re.match(r"[^/?#]*", u.split("://", 1)[1])[0].lower(), re.match(r"[^/?#]*([^?#]*)", u.split("://", 1)[1])[1]
        fit = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, None)

    name = lambda u: u.split("#")[0]
    parent = {name(u): name(u) for _, u in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(name(a))] = root(name(b))
    linked = {name(u) for e in links for u in e}
    verdicts = defaultdict(set)
    for u in linked:
        verdicts[root(u)].add(rule(u)[1])
    want = {}
    for i, u in rows:
        got, v = rule(u), verdicts[root(name(u))] if name(u) in linked else set()
        want[i] = (got[0], got[1] or ("allow" if "allow" in v else "block" if "block" in v else "allow"))
    assert out == want and any(r is None and v == "block" for r, v in out.values())


def test_components(spark):
    from tidemill.llm.graph import connected_components

    rng = random.Random(5)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    loose = [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    edges = path + star + loose + [(5, 5), (7, None)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in path + star + [e for e in loose if e[0] != e[1]]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in list(parent)}
    assert connected_components(spark.createDataFrame([(5, 5), (None, 1)], "a long, b long")).collect() == []


def base_statistics(t):
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = t.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_op9(spark, tables, rows):
    out = by_id(run(spark, "op9_quality_forest", tables))
    for doc_id, text, *_ in rows:
        r, want = out[doc_id], base_statistics(text or "")
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_op9_kept_against_plain_loops(spark, sf_dir):
    """The verdict on each document of a table: statistics, the fit on labelled rows, and a walk down each tree."""
    import numpy as np
    import pandas as pd

    from tidemill.llm import quality

    d = sf_dir.replace("sf0.001", "sf0.01")
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality").collect()}
    stats = {i: quality.statistics(t) for i, t in docs.items()}
    failed = {i: v[0] < 50 or 100 * v[4] > 50 * v[0] for i, v in stats.items()}
    known = sorted((i, *stats[i][5:], q) for i, q in labels.items() if i in docs and not failed[i])
    fitted = quality.Judge(pd.DataFrame(known, columns=["_id", *quality.FEATURES, "quality"]))

    def score(row):
        depths = []
        for feature, split, left, path in fitted.forest.trees:
            node = 0
            while feature[node] >= 0:
                node = left[node] + int(row[feature[node]] > split[node])
            depths.append(path[node])
        n = fitted.forest.size
        return 2 ** -(sum(depths) / len(depths) / (2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n))

    out = by_id(run(spark, "op9_quality_forest", d))
    for i, v in stats.items():
        s = score(fitted.excess(np.array([v[5:]]))[0])
        assert out[i]["score"] == pytest.approx(s) and (abs(s - fitted.limit) < 1e-9 or out[i]["kept"] == (not failed[i] and s <= fitted.limit))
    assert 0 < sum(r["kept"] for r in out.values()) < len(out)


def test_op9_forest_finds_junk(spark, sf_dir):
    from tidemill.llm import quality

    d = sf_dir.replace("sf0.001", "sf0.1")
    out = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    known = out.join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("doc_id", "_id"), "_id").where("NOT base_failed")
    r = {(x.quality, x.kept): x.n for x in known.groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert r.get((1, False), 0) <= 0.01 * r[1, True] and r.get((0, True), 0) <= 0.1 * r[0, False]


def test_op9_fits_all_labelled_rows(spark):
    """Over 20,000 labelled rows: the same verdicts as of a fit on all of them in one frame."""
    import pandas as pd

    from tidemill.llm import quality

    rng = random.Random(21)
    words = ["harbour", "lantern", "meadow", "Oatmeal", "pebbles", "quarry!", "#orchard", "willow"]
    text = lambda i: " ".join(rng.choices(["$$", "!!!", "A"], k=9) if i % 50 == 0 else rng.choices(words, weights=[9, 9, 9, 2, 9, 1, 1, 9], k=9))
    rows = [(i, text(i)) for i in range(23_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 50 > 0)) for i, _ in rows], "doc_id long, quality int")
    stats = {i: quality.statistics(t) for i, t in rows}
    known = pd.DataFrame([(i, *v[5:], int(i % 50 > 0)) for i, v in stats.items() if 100 * v[4] <= 50 * v[0]], columns=["_id", *quality.FEATURES, "quality"])
    assert len(known) > 20_000
    fitted = quality.Judge(known)
    x = known[quality.FEATURES].to_numpy(float)
    want = dict(zip(known["_id"].tolist(), zip(fitted.score(x).tolist(), (fitted.score(x) <= fitted.limit).tolist())))
    got = {r["_id"]: (r["score"], r["kept"]) for r in quality.judge(docs, labels, min_words=1).where("NOT base_failed").collect()}
    assert got == want and 0 < sum(not kept for _, kept in want.values()) < 1000


def test_op9_selected(spark):
    """Order statistics of all rows against a sort, in one frame and over partitions."""
    import numpy as np
    import pandas as pd

    from tidemill.llm.quality import Rows, SparkRows, selected

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"a": np.concatenate([rng.normal(size=900), np.zeros(2000), [1e300, -1e300, 5e-324, -0.0]]), "n": rng.integers(0, 4, 2904)})
    columns = lambda b: [(b["a"].to_numpy(), b["n"].to_numpy(np.int64)), (b["a"].to_numpy(), (b["n"] == 9).to_numpy(np.int64)), (b["a"].to_numpy(), (b["n"] == 1).to_numpy(np.int64))]
    for share in (0.0, 0.02, 0.5, 0.998, 1.0):
        each, some = np.repeat(rows["a"], rows["n"]), rows["a"][rows["n"] == 1]
        want = [float(np.quantile(each, share, method="higher")), 0.0, float(np.quantile(some, share, method="higher"))]
        assert selected(Rows(rows), columns, [share] * 3) == (want, [len(each), 0, len(some)])
    assert selected(SparkRows(spark.createDataFrame(rows).repartition(7)), columns, [1.0] * 3)[0] == want


def test_op10(spark, tables, rows):
    out = by_id(run(spark, "op10_noisy_channel_toxicity", tables))
    for doc_id, *_ in rows:
        r = out[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)


def channel_of(text, usual=()):
    """A channel whose character model is of the text."""
    import numpy as np

    from tidemill.llm.toxicity import Channel, trigram_counts

    tokens = text.split()
    return Channel(trigram_counts(tokens, np.ones(len(tokens), np.int64)), frozenset(usual))


def restored(channel, *texts, join=None):
    """The words that the channel reads in each text; of a spaced word, what may begin in it ends in *."""
    import numpy as np
    import pyarrow as pa

    from tidemill.llm.toxicity import read

    f, row, word = channel.words(read(pa.array(texts)), lambda f: np.ones(len(f.words), bool), join)
    out = [set() for _ in texts]
    for r, w in zip(row.tolist(), word.tolist()):
        assert f.words[w] not in out[r]
        out[r].add(f.words[w])
    return out


def test_op10_trigrams():
    import numpy as np

    from tidemill.llm.toxicity import EDGE, OTHER, STATES, trigram_counts

    tokens, times, want = ["ab", "é1", "x"], [3, 2, 1], Counter()
    code = lambda c: ord(c) - 97 if "a" <= c <= "z" else OTHER if ord(c) > 127 else EDGE
    for t, n in zip(tokens, times):
        s = [EDGE, EDGE, *map(code, t), EDGE, EDGE]
        for a, b, c in zip(s, s[1:], s[2:]):
            want[(a * STATES + b) * STATES + c] += n
    got = trigram_counts(tokens, np.array(times))
    assert {i: n for i, n in enumerate(got.tolist()) if n} == want
    assert not trigram_counts([], np.array([], np.int64)).any()


def test_op10_viterbi_is_best():
    """The decoder's path against all readings of a token, each letter, repetition and filler as the lattice has them."""
    from tidemill.llm.toxicity import EDGE, FILLERS, OTHER, Channel, state

    channel = channel_of("stupid idiot loser clown trash scum lass less sail toil " * 20)

    def best(token):
        found = []

        def go(i, a, b, cost, word):
            if i == len(token):
                found.append((cost + channel.cost[a][b][EDGE], word))
                return
            ch, options = token[i], Channel.choices(token[i])
            again = i > 0 and ch == token[i - 1]
            for x in options:
                s = state(x)
                go(i + 1, b, s, cost + channel.cost[a][b][s] + (x != ch) * channel.SIGN + (again and s == b) * channel.TWICE, word + x)
            if again and b < OTHER and state(options[0] if options else ch) == b:
                go(i + 1, a, b, cost + channel.REPEAT, word)
            if not options or ch in FILLERS or (not ch.isalpha() and i in (0, len(token) - 1)):
                go(i + 1, a, b, cost + channel.FILLER + (0 if ch in FILLERS or not options else 2), word)

        go(0, EDGE, EDGE, 0.0, "")
        least = min(found)[0]
        return {word for cost, word in found if cost < least + 1e-9}

    rng = random.Random(7)
    for token in ["1d1ot", "s.t.u.p.i.d", "l0s3r!", "tr4$h", "sc-um", "!!", "$$less"] + ["".join(rng.choices("stuildo10$.-", k=rng.randint(1, 8))) for _ in range(60)] + ["".join(rng.choices("aselé", k=rng.randint(1, 9))) for _ in range(200)]:
        assert channel.decode(token) in best(token), token


def test_op10_decodes():
    channel = channel_of("the stupid idiot is a loser and the clown eats trash with a pathetic moron in this little town where people live " * 50, ["people", "little"])
    for disguised, word in {"1d1ot": "idiot", "l0s3r": "loser", "s.t.u.p.i.d": "stupid", "cl0wn": "clown", "tr4$h": "trash", "stuuuupid": "stupid", "m0r0n!": "moron"}.items():
        assert channel.decode(disguised) == word, disguised
    spaced, plain, long = restored(channel, "you i d i o t of a town", "The people live, live", "u r a n i d i o t")
    assert "idiot" in spaced and plain == {"the", "people", "live"} and "idiot*" in {w[:5] + w[-1] for w in long}
    assert channel.segmented("theidiot") == ["the", "idiot"]


def test_op10_sign_runs_and_doubles():
    words = "stupid idiot loser clown trash pathetic scum asshole ass shit"
    channel = channel_of(f"{words} and the small town where all the people live with a looser rule " * 50, ["looser"])
    disguised = {"10ser": "loser", "1053r": "loser", "idi07": "idiot", "id107": "idiot", "1d107": "idiot", "57upid": "stupid", "$$tupid": "stupid", "(10wn": "clown", "5(um": "scum", "a$$": "ass", "@$$hole": "asshole", "sh17": "shit", "patheti(": "pathetic", "stuupid": "stupid", '"patheti(,"': "pathetic", "iidiot": "idiot", "stupiid": "stupid", "@55": "ass", "a55": "ass", "st&u#pid": "stupid"}
    missed = {t: found for t, found in zip(disguised, restored(channel, *(f"so {t} here" for t in disguised))) if disguised[t] not in found}
    assert not missed
    a, b, c, d = restored(channel, "you a s s of a", "a looser rule", "--- ... ***", "")
    assert "ass" in a and "loser" not in b and c == d == set()


def test_op10_split_words():
    import numpy as np

    from tidemill.llm.toxicity import polynomials, whole

    channel = channel_of("stupid idiot loser clown trash the sat up in town and ran here " * 50)
    heavy = whole(polynomials(["stupid", "idiot", "uphere"])[0])
    a, b, c = restored(channel, "so st upid here", "sat up here", "st\nupid idi, ot", join=lambda h: np.isin(h, heavy))
    assert "stupid" in a and "uphere" not in b and {"stupid", "idiot"} <= c


def test_op10_features():
    """Hashes of whole words and beginnings: equal for equal features, whatever stands beside them."""
    from tidemill.llm.toxicity import PREFIXES, features

    def of(words):
        f = features(words)
        out = defaultdict(set)
        for w, h in zip(f.word.tolist(), f.hash.tolist()):
            out[words[w]].add(h)
        return out

    words = ["a", "idiot", "idiots", "idiot*", "ꝏ𝔘é", "x" * 5000, "worthless"]
    got, ids = of(words), {}
    for w in words:
        want = {("beginning", w[:n]) for n in PREFIXES if len(w.removesuffix("*")) >= n} | (set() if w[-1] == "*" else {("whole", w)})
        assert len(got[w]) == len(want) and of([w])[w] == got[w]
        for x in want:
            ids.setdefault(x, []).append(got[w])
    assert all(set.intersection(*v) for v in ids.values()) and len(set().union(*got.values())) == len(ids)


def test_op10_score_against_plain_loops(spark):
    """Weights from counts of rows, the strongest feature of each word, and the sum of the largest few."""
    import math

    from tidemill.llm import toxicity as T

    rng = random.Random(12)
    clean = ["harbour", "lantern", "meadow", "oatmeal", "pebbles", "quarry", "orchard", "willow"]
    bad = ["grumpkin", "snorfle", "blathers", "vilest"]
    train, held = ([i for i in range(2400) if (zlib.crc32(str(i).encode()) % 4 == 2) == h] for h in (False, True))
    text = {i: " ".join(rng.choices(clean, k=8) + ([rng.choice(bad[: 2 + i % 3])] + ["sn0rfle"] * (i % 5 == 1) if i % 2 else [])) for i in train + held}
    docs = spark.createDataFrame([(i, t) for i, t in text.items()], "_id long, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in train], "_id long, toxic int")
    old, T.HEAVY_SHARE = T.HEAVY_SHARE, 0.2  # so that some weights are joined
    try:
        channel = T.channel_of(docs)
        scorer, table, (a, b, c) = T.trained(docs.where(~F.col("_id").isin(held)), labels, channel, 100_000)
        got = {r["_id"]: (r["top"], r["some"]) for r in T.evidence_of(docs, "_id", "long", channel, scorer, table).collect()}
    finally:
        T.HEAVY_SHARE = old
    assert len(scorer.keys) and table.count()
    part = {r["_id"]: r["p"] for r in docs.select("_id", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(4)).alias("p")).collect()}
    words = dict(zip(text, restored(channel, *text.values())))
    of = lambda w: {("whole", w)} | {w[:n] for n in T.PREFIXES if len(w) >= n}
    n, rows = {0: Counter(), 1: Counter()}, Counter()
    for i in train:
        if part[i]:
            rows[i % 2] += 1
            n[i % 2].update(set().union(*map(of, words[i])))
    weight = {f: math.log((x + 0.1) / (rows[1] + 0.2)) - math.log((n[0][f] + 0.5) / (rows[0] + 1)) for f, x in n[1].items() if x >= T.LEAST_ROWS}
    for i in text:
        best = sorted((max([0.0, *(w for f in of(x) if (w := weight.get(f, 0)) > 1)]) for x in words[i]), reverse=True)[: T.TOP]
        assert got[i] == (pytest.approx(best[0]), pytest.approx(sum(best)))
    assert {got[i][0] > 0 for i in held if i % 2} == {True} and {got[i][0] for i in held if i % 2 == 0} == {0.0}


def test_op10_rare_words(spark):
    from tidemill.llm import toxicity

    train, held = ([i for i in range(45_000) if (zlib.crc32(str(i).encode()) % 4 == 2) == h] for h in (False, True))
    train = train[:32_000]
    rows = [(i, f"so much vilest here {i % 7}" if i % 2 else "so much kinder here") for i in train]
    rare = [i for i in train if i % 2][:12]  # a thousandth of the toxic rows is more
    rows = [(i, "so much quorvex here") if i in rare else (i, t) for i, t in rows]
    rows += [(held[0], "so quorvex here"), (held[1], "so kinder here")]
    labels = spark.createDataFrame([(i, i % 2) for i in train], "doc_id long, toxic int")
    out = by_id(toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).where(F.col("doc_id").isin(held[:2])).collect())
    assert out[held[0]]["score"] > 0.9 and out[held[1]]["predicted"] == 0


def test_op10_pages(spark):
    """Pages of weights of any size give one result, and no join's rows grow with the words of the texts."""
    from tidemill.llm import toxicity as T

    rng = random.Random(31)
    clean, rude = ([f"{a}{b}{c}" for a in x for b in "aeiou" for c in ("ndle", "rkin", "stop")] for x in (("h", "l", "m"), ("gr", "sn", "bl")))
    rows = [(i, " ".join(rng.choices(clean, k=6) + (rng.sample(rude, 3) if i % 2 else []))) for i in range(900)]
    docs, labels = spark.createDataFrame(rows, "_id long, _text string"), spark.createDataFrame([(i, i % 2) for i in range(900)], "_id long, toxic int")
    old, found = (T.HEAVY_SHARE, T.PAGE), []
    try:
        for T.HEAVY_SHARE, T.PAGE in ((0.0, 1 << 18), (1.0, 1 << 18), (1.0, 50), (0.1, 20)):
            channel = T.channel_of(docs)
            scorer, table, weights = T.trained(docs, labels, channel, 100_000)
            out = T.evidence_of(docs, "_id", "long", channel, scorer, table)
            assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
            found.append((len(T.pages(table)), weights, {r["_id"]: (r["top"], r["some"]) for r in out.collect()}))
    finally:
        T.HEAVY_SHARE, T.PAGE = old
    (n, weights, want), *others = found
    assert n == 1 and others[0][0] == 1 and others[1][0] > 2 and len(want) == 900 and {want[i][0] > 0 for i in range(1, 900, 2)} == {True}
    assert all(w == pytest.approx(weights) and got == {i: pytest.approx(v) for i, v in want.items()} for _, w, got in others)


def test_op10_held_out(spark, sf_dir):
    from tidemill.llm import toxicity

    d = sf_dir.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id")
    r = out.agg(*(F.count_if(F.expr(e)) for e in ("toxic = 1 AND predicted = 1", "toxic = 1", "toxic = 0 AND predicted = 1", "toxic = 0"))).first()
    assert r[0] >= 0.8 * r[1] and r[2] <= 0.02 * r[3]
