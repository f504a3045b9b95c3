"""License scans by diagonal voting: k-gram matches against templates, gathered by their offset."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

#: Word characters, A-Z lowered before: ASCII letters and digits, and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Notices as their licenses publish them, with a label each.
NOTICES = [
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]

#: What tells the licenses of a family apart: a place of a notice has the same of these as the notice. A family is known
#: by words of its notices; of the spellings of one mark, any counts.
DECIDING = [
    ({"gnu"}, [("lesser general", "library general"), ("affero",)]),
    ({"cc", "creative"}, [("sa", "sharealike", "share alike"), ("nc", "noncommercial", "non commercial"), ("nd", "noderivatives", "noderivs", "no derivatives", "no derivs")]),
]

#: Diagonals of a notice this near to each other are one place of it: a few words put in or left out.
NEAR_DIAGONALS = 3
#: The share of a notice's k-grams that a place must have for the label. The share is also its part of the score.
LEAST_SHARE = 0.7


def license_words(text: Column) -> Column:
    """The array of words; a text without any has none."""
    return F.array_remove(F.split(C.ascii_lower(text), NOT_WORD), "")


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> DataFrame:
    """(_size, _gram, _t, _base, _label, _of, _at): each k-gram of each template with its position; k is less in a
    shorter template. Its rows are those of the lists given, a few hundred: small enough to broadcast, whatever the input."""
    rows = []
    for t, (base, label, text) in enumerate([(True, b, a) for a, b in phrases] + [(False, a, b) for a, b in notices]):
        ws = text.split()
        size = min(k, len(ws))
        rows += [(size, " ".join(ws[i : i + size]), t, base, label, len(ws) - size + 1, len(ws), i) for i in range(len(ws) - size + 1)]
    return spark.createDataFrame(rows, "_size int, _gram string, _t int, _base boolean, _label string, _grams int, _of int, _at int")


def deciding_rules(label: str, text: str) -> tuple[list[list[str]], list[str], list[str]]:
    """Of a notice: marks of which a place must have one spelling each, those that it must not have, and the spellings
    of the version in the label, of which the place or the few words behind it must have one."""
    spaced, must, never = f" {text} ", [], []
    for family, marks in DECIDING:
        if family & set(text.split()):
            for spellings in ([f" {x} " for x in m] for m in marks):
                if any(x in spaced for x in spellings):
                    must.append(spellings)
                else:
                    never += spellings
    version = re.search(r"-(\d+)\.(\d+)$", label)
    if not version:
        return must, never, []
    major, minor = version.groups()
    spellings = [f" {major} {minor} ", f" v{major} {minor} "]
    if minor == "0":
        spellings += [f" version {major} ", f" v {major} ", f" v{major} ", f" license {major} "]
    return must, never, spellings


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, k: int = 3, least_share: float = LEAST_SHARE) -> DataFrame:
    """Base places and labels of each text.

    The hash of each run of k words (and of each shorter run that a short template needs) is joined with the templates'
    positions; a match is verified word by word and votes for its diagonal, the place where the template would start.
    A base phrase stands where a diagonal has all its votes. Of a notice, diagonals within NEAR_DIAGONALS are one
    place, which counts from least_share of the notice's k-grams on, where its words are the deciding ones. Returns for each row of docs: `row`, n_words,
    n_base, first_word, last_word, base_labels, labels, score (the largest share found, 1 for a base phrase, else 0)
    and spans, an array of (label, start, stop, share).

    Null text: no words, no labels. Repeated rows get equal results. An empty table gives an empty table. Names in
    docs can't clash: they stay inside `row`.
    """
    spark = docs.sparkSession
    templates = template_grams(spark, phrases, notices, k)
    rules = [(t, *deciding_rules(label, text)) for t, (label, text) in enumerate(notices, len(phrases))]
    rules = F.broadcast(spark.createDataFrame(rules, "_rule int, _must array<array<string>>, _never array<string>, _versions array<string>"))
    sizes = sorted({min(k, len(text.split())) for text in [p[0] for p in phrases] + [n[1] for n in notices]})
    grams = templates.withColumn("_ws", F.split("_gram", " ")).withColumn("_h", F.xxhash64(F.transform("_ws", lambda w: F.xxhash64(w)))).drop("_gram")

    src = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_id"), C.text_of(text_col).alias("_text"))
    src = src.withColumn("_th", F.xxhash64("_text")).withColumn("_words", license_words(F.col("_text"))).drop("_text")

    seen = src.select("_id", "_th", "_words", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hs"))
    at = lambda i: F.get(F.col("_hs"), i)
    # All runs that start at a word at once. Near the text's end a longer one is cut short; no word by word match has it.
    hashes = lambda h, i: (F.xxhash64(h, *(at(i + j) for j in range(1, s))).alias(f"h{s}") for s in sizes)
    starts = F.slice("_hs", 1, F.greatest(F.size("_hs") - (sizes[0] - 1), F.lit(0)))
    rolled = seen.select("_id", "_th", "_words", F.explode(F.transform(starts, lambda h, i: F.struct(i.alias("i"), *hashes(h, i)))).alias("_g"))
    # The templates' hashes, a few hundred, are constants that a run is held against where it is made; what may match is joined.
    known = {s: [r["_h"] for r in grams.where(F.col("_size") == s).select("_h").distinct().collect()] for s in sizes}
    rolled = rolled.where(reduce(Column.__or__, (F.col(f"_g.h{s}").isin(known[s]) for s in sizes)))
    rolled = rolled.select("_id", "_th", "_words", "_g.i", F.inline(F.array(*(F.struct(F.lit(s).alias("size"), F.col(f"_g.h{s}").alias("h")) for s in sizes))))
    votes = rolled.join(F.broadcast(grams), (F.col("size") == F.col("_size")) & (F.col("h") == F.col("_h")))
    votes = votes.where(F.slice("_words", F.col("i") + 1, F.col("_size")) == F.col("_ws"))
    votes = votes.select("_id", "_th", "_t", "_base", "_label", "_grams", "_of", "_size", "_at", (F.col("i") - F.col("_at")).alias("_diagonal"), "_words")
    # The words that a place starting on this diagonal can have; no more of the text goes on.
    votes = votes.withColumn("_near", F.when(~F.col("_base"), F.slice("_words", F.greatest(F.col("_diagonal"), F.lit(0)) + 1, 2 * F.col("_of") + 3 * NEAR_DIAGONALS))).drop("_words")

    template = ["_id", "_th", "_t", "_base", "_label", "_grams", "_of", "_size"]
    diagonals = votes.groupBy(*template, "_diagonal").agg(F.collect_set("_at").alias("_ats"), F.any_value("_near").alias("_near"))
    diagonals = C.written(diagonals, "license-diagonals")
    base = diagonals.where(F.col("_base") & (F.size("_ats") == F.col("_grams"))).select("_id", "_th", "_base", "_label", F.col("_diagonal").alias("_start"), (F.col("_diagonal") + F.col("_of")).alias("_stop"), F.lit(1.0).alias("_share"))

    along = Window.partitionBy("_id", "_th", "_t").orderBy("_diagonal")
    far = F.coalesce(F.col("_diagonal") - F.lag("_diagonal").over(along) > NEAR_DIAGONALS, F.lit(True))
    places = diagonals.where(~F.col("_base")).withColumn("_far", far.cast("int")).withColumn("_place", F.sum("_far").over(along))
    merged = places.groupBy(*template, "_place").agg(F.array_distinct(F.flatten(F.collect_list("_ats"))).alias("_ats"), F.min(F.col("_diagonal") + F.array_min("_ats")).alias("_start"), F.max(F.col("_diagonal") + F.array_max("_ats") + F.col("_size")).alias("_stop"), F.min_by("_near", "_diagonal").alias("_near"), F.greatest(F.min("_diagonal"), F.lit(0)).alias("_from"), F.max(F.col("_diagonal") + F.col("_of")).alias("_end"))
    share = F.size("_ats") / F.col("_grams")
    # A place is no longer than the notice with its gaps: votes strewn over a text are no notice.
    loose = merged.where((share >= least_share) & (F.col("_stop") - F.col("_start") <= F.col("_of") + 2 * NEAR_DIAGONALS))
    spaced = lambda at, n: F.concat(F.lit(" "), F.array_join(F.slice("_near", at + 1, n), " "), F.lit(" "))
    loose = loose.withColumn("_place", spaced(F.col("_start") - F.col("_from"), F.col("_stop") - F.col("_start"))).withColumn("_wide", spaced(F.lit(0), F.col("_end") + NEAR_DIAGONALS - F.col("_from")))
    has = lambda text: lambda x: F.contains(F.col(text), x)
    decided = F.forall("_must", lambda m: F.exists(m, has("_place"))) & ~F.exists("_never", has("_place")) & ((F.size("_versions") == 0) | F.exists("_versions", has("_wide")))
    loose = loose.join(rules, F.col("_t") == F.col("_rule")).where(decided).select("_id", "_th", "_base", "_label", "_start", "_stop", share.alias("_share"))

    span = F.struct(F.col("_label").alias("label"), F.col("_start").alias("start"), F.col("_stop").alias("stop"), F.col("_share").alias("share"))
    found = base.unionByName(loose).groupBy(F.col("_id").alias("_id2"), F.col("_th").alias("_th2")).agg(
        F.count_if("_base").alias("n_base"),
        F.min(F.when(F.col("_base"), F.col("_start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("_base"), F.col("_start"))).cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("_base"), F.col("_label")))).alias("_base_labels"),
        F.array_sort(F.collect_set("_label")).alias("_labels"),
        F.max("_share").alias("score"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    out = src.select("row", "_id", "_th", F.size("_words").cast("long").alias("n_words")).join(found, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2")), "left")
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("row", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", joined("_base_labels").alias("base_labels"), joined("_labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
