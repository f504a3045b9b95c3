"""The pipeline's stages against brute force, and odd inputs: clashing names, null ids, repeated rows, empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_contracts import DOCS, WORD, classes, corpus, lowered, shingle_set

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def rows():
    return corpus()


def collect(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages_are_the_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "mixing sources", "packing"]


def test_quality_stage_keeps_clean_documents(spark, sf_dir):
    import corpus_pipeline as p

    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = p.good_documents(spark, docs, d)
    assert kept.columns == COLUMNS
    seen = kept.select(F.col("doc_id"), F.lit(1).alias("k"))
    counts = labels.join(docs.select("doc_id"), "doc_id").join(seen, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count("k").alias("k"))
    n = {r["quality"]: (r["n"], r["k"]) for r in counts.collect()}
    assert n[1][1] >= 0.99 * n[1][0] and n[0][1] <= 0.1 * n[0][0]


def test_line_stage(spark, rows):
    import corpus_pipeline as p

    out = {r[0]: r for r in collect(p.without_repeated_lines(spark, table(spark, rows), ""))}
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    n = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    assert len(out) == len(rows)
    for r in rows:
        kept = "\n".join(x for x in (r[1] or "").split("\n") if n[key(x)] < 10)
        assert out[r[0]][1] == (None if r[1] is None else kept) and out[r[0]][4] == len(kept) and out[r[0]][2:4] == r[2:4]


def test_class_stage(spark, rows):
    import corpus_pipeline as p

    out = collect(p.one_of_each_class(spark, table(spark, rows), ""))
    sets = {r[0]: shingle_set(r[1], 5) for r in rows}
    want = classes(sets, 80, 100)
    assert sorted(out) == sorted(r for r in rows if want[r[0]] == r[0])


def test_class_stage_with_repeated_rows_and_null_ids(spark):
    import corpus_pipeline as p

    t = "a b c d e f g h"
    rows = [(5, t, "en", "s", 1), (5, t, "en", "s", 1), (3, t, "en", "s", 1), (None, t, "en", "s", 1), (None, "x y z", None, None, None), (7, None, None, None, None), (7, None, None, None, None)]
    out = collect(p.one_of_each_class(spark, table(spark, rows), ""))
    assert sorted(out, key=repr) == sorted([rows[2], rows[4], rows[5]], key=repr)


def test_class_stage_with_reused_ids(spark):
    """Two classes whose least documents share an id: one document of each stays."""
    import corpus_pipeline as p

    a, b = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = [(1, a, "en", "s", 1), (1, b, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1)]
    assert sorted(collect(p.one_of_each_class(spark, table(spark, rows), ""))) == sorted(rows[:2])


def test_mixing_stage_order(spark, rows):
    """Rows of a partition come in the order of their slots."""
    import corpus_pipeline as p
    from tidemill.llm import mixing

    docs = table(spark, rows)
    slots = {r["row"]["doc_id"]: r["slots"] for r in mixing.mix(docs).collect()}
    seen, at = Counter(), defaultdict(list)
    for i, part in p.mixed(spark, docs, "").select("doc_id", F.spark_partition_id()).collect():
        if slots[i]:
            at[part].append(slots[i][min(seen[i], len(slots[i]) - 1)])
            seen[i] += 1
    assert all(v == sorted(v) for v in at.values()) and sum(map(len, at.values())) > 40


def test_packing_stage_holds_the_ids(spark, rows):
    import zlib

    import corpus_pipeline as p

    out = p.packed(spark, table(spark, rows), "").collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in out) and out


def test_quality_stage_rejects_long_repetition(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c d " * 20, "en", "s", 1), (2, "a b c d " * 3, "en", "s", 1), (3, " ".join(f"w{i}" for i in range(60)), "en", "s", 1), (4, " ", "en", "s", 1), (5, None, "en", "s", 0)]
    assert sorted(r[0] for r in collect(p.good_documents(spark, table(spark, rows), str(tmp_path)))) == [2, 3]


def test_mixing_stage(spark, rows):
    import corpus_pipeline as p
    from tidemill.llm import mixing

    docs = table(spark, rows)
    out = Counter(r[0] for r in collect(p.mixed(spark, docs, "")))
    taken = {r["row"]["doc_id"]: (r["taken"], r["size"], r["target"]) for r in mixing.mix(docs).collect()}
    for i, (n, size, _) in taken.items():
        assert out[i] == (1 if size == 0 else round(n / size + 1e-9))
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        n, size, target = taken[r[0]]
        per[r[3]][0] += out[r[0]] * size
        per[r[3]][1] = target
        per[r[3]][2] = max(per[r[3]][2], size)
    assert all(abs(got - want) <= largest for got, want, largest in per.values())


def test_mixing_stage_with_repeated_rows(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(None, "d e", "en", None, 3)] * 2
    out = Counter(r[0] for r in collect(p.mixed(spark, table(spark, rows), "")))
    assert sum(out.values()) >= 5 and set(out) == {1, None}


def test_run(spark, rows, tmp_path):
    import corpus_pipeline as p

    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    fill = defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for b in fill.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len({r.doc_id for r in out}) > 40


def test_run_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).collect() == []


#: Rows that every operator must take: null ids, null texts, repeated rows, a very long line and word.
ODD = [(1, "a b c d e f", 1), (1, "a b c d e f", 1), (None, None, None), (None, "x", 2), (None, "x", 2), (2, "w" * 300_000, 3), (3, "word " * 30_000, 4), (4, "\n" * 5000, 5), (-5, "-", 6), (2**62, "ß É   𝔘", 7)]


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names the operators might use themselves."""
    rows = [(i, t, "en", "s" if i else None, n, "a", "b", 1, 2, 3) for i, t, n in ODD]
    return spark.createDataFrame(rows, DOCS + ", row string, size string, _id int, _text int, taken int")


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_odd_rows(spark, odd, odd_labels):
    from tidemill.llm import fingerprints, jaccard, licenses, lines, lm, mixing, packing, quality, toxicity

    n = len(ODD)
    assert fingerprints.fingerprint_with_edits(odd).count() == n
    mix = mixing.mix(odd).collect()
    assert len(mix) == n and all(0 <= r["taken"] <= 2 * r["size"] for r in mix)
    sim = jaccard.similarity_classes(odd).collect()
    assert len(sim) == n and {r["component_id"] for r in sim if r["_id"] == 1} == {1}
    assert len(licenses.scan_licenses(odd).collect()) == n
    packed = packing.pack(odd).collect()
    assert sum(r["start"] == 0 for r in packed) == n
    kept = lines.drop_repeated_lines(odd, min_docs=2).collect()
    assert len(kept) == n and sorted(r["n_dropped"] for r in kept)[-4:] == [1, 1, 1, 1]
    scored = lm.score_documents(odd).collect()
    assert len(scored) == n and len({(r["doc_id"], r["n_tokens"], r["score"]) for r in scored}) == n - 2
    assert quality.judge(odd, odd_labels).count() == n
    assert toxicity.score_toxicity(odd, odd_labels).count() == n


def test_extra_columns_stay(spark, odd, odd_labels, tmp_path):
    import corpus_pipeline as p

    for stage in (p.without_repeated_lines, p.one_of_each_class, p.mixed):
        assert stage(spark, odd, "").columns == odd.columns
    odd_labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert p.good_documents(spark, odd, str(tmp_path)).columns == odd.columns
    assert p.packed(spark, odd, "").where("start = 0").count() == len(ODD)


def test_deterministic_whatever_the_partitions(spark, rows):
    from tidemill.llm import mixing, packing

    docs = table(spark, rows)
    for run in (lambda d: mixing.mix(d).select("row.doc_id", "taken"), lambda d: packing.pack(d).drop("x")):
        a, b = (sorted(map(tuple, run(d).collect())) for d in (docs.repartition(7), docs.coalesce(1)))
        assert a == b


def test_heavy_duplicates(spark):
    """A third of all rows are one text, another third near copies of one."""
    from tidemill.llm import jaccard

    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)]
    near = [" ".join("x" if j == rng.randrange(80) else w for j, w in enumerate(words)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(["same text of some words " * 5] * 60 + near + [" ".join(rng.choices(words, k=40)) for _ in range(60)])]
    got = {r["_id"]: r["component_id"] for r in jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes({i: shingle_set(t, 4) for i, t in rows}, 85, 100) and WORD
