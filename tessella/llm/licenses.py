"""License scans in DataFrame expressions only: MinHash bands over overlapping word windows, then exact containment.

Templates are short notices; their shingles are runs of SHINGLE words (a notice may have no more than five words
in all, so shingles of five would leave it one). For a window length L, the templates of more than L/4
and at most L/2 words are looked up, with windows each L/2 words, so one window holds a whole notice. Its
Jaccard similarity to the template is then at least (L/4 * 0.8) / (L * 1.0) = 0.2; BANDS bands of one row find
it with probability 1 - 0.8^BANDS, above 0.9999. Found pairs are verified exactly: the share of the template's
distinct shingles that the window has must reach CONTAINMENT.

Only windows that share a shingle with some template can collide in a band; others are set aside before
any MinHash is computed, which loses nothing.

Templates are a parameter, a list or a table of notices or of whole licence bodies; their words and shingles are sent with the plan, so they should be some thousands of
templates at most.

Cases: null and empty texts have no windows; a text shorter than a window is one window; rows with one doc_id
are reported as one document, rows with a null doc_id by their texts, each unequal text as a row of its own; templates of fewer than SHINGLE words are never found; an empty
table, of texts or templates, gives an empty result; other columns are left out. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, BANDS = 2, 0.8, 48

#: (license, notice): fixed values, the usual short notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    bare = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?![\p{L}\p{N}])", "")
    return F.filter(F.split(bare, r"\s+"), lambda w: w != "")


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(words: Column) -> Column:
    """The hashes of all runs of SHINGLE words, in order."""
    last = F.size(words) - SHINGLE + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _bands(shingles: Column) -> Column:
    """BANDS band keys: the band's number with the least of the shingles' rehashed values."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.xxhash64(b, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b)))))


Given = list[tuple[str, str]] | DataFrame


def templates(spark: SparkSession, given: Given) -> DataFrame:
    """(license, text, w, t_words, length, t_shingles): length is the window length that looks it up."""
    rows = given.select("license", "text") if isinstance(given, DataFrame) else spark.createDataFrame(given, "license string, text string")
    rows = rows.select("license", "text", _words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") >= SHINGLE)
    length = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("w").cast("double"))) + 1).cast("int")
    return rows.select("license", "text", "w", F.size("w").alias("t_words"), length.alias("length"), F.array_distinct(_runs(F.col("w"))).alias("t_shingles"))


#: Anchors up to which a text is searched for each of them; more are looked up among its words. Shingles up to which windows are filtered by them all.
SEARCHED, FILTERED = 64, 5_000


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", given: Given | None = None) -> DataFrame:
    """Per document and license found: key, license, n_windows, best containment, and the first and last word of its windows."""
    known = templates(df.sparkSession, TEMPLATES if given is None else given)
    facts = known.select("length", "t_shingles", "w").collect()  # the templates are a parameter, not data
    lengths = sorted({r["length"] for r in facts})
    every = sorted({s for r in facts for s in r["t_shingles"]})
    anchors = _anchors([r["w"] for r in facts])
    rows = df.select(F.col(key), F.when(F.col(key).isNull(), F.xxhash64(text)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    if not anchors:
        rows = rows.where(F.lit(False))
    elif len(anchors) <= SEARCHED:  # the lower case is computed once and not for each anchor
        rows = rows.where(_bound(F.lower("_t"), lambda t: _any([t.contains(a) for a in anchors])))
    words = rows.select(key, "_row", _words(F.col("_t")).alias("_w"))
    if len(anchors) > SEARCHED:
        words = words.where(F.arrays_overlap("_w", F.lit(anchors)))
    hashed = words.select(key, "_row", F.size("_w").alias("_n"), _runs(F.col("_w")).alias("_h"))

    def starts(n: int) -> Column:
        every_half = F.sequence(F.lit(1), F.greatest(F.col("_n") - n // 2, F.lit(1)), F.lit(n // 2))
        return F.transform(every_half, lambda at: F.struct(F.lit(n).alias("length"), at.alias("at")))

    cuts = F.flatten(F.array(*[starts(n) for n in lengths])) if lengths else F.array().cast("array<struct<length:int,at:int>>")
    windows = hashed.select(key, "_row", "_h", F.explode(cuts).alias("_c")).select(
        key, "_row", "_c.length", "_c.at", F.array_distinct(F.slice("_h", F.col("_c.at"), F.col("_c.length") - SHINGLE + 1)).alias("shingles")
    )
    if len(every) <= FILTERED:
        windows = windows.where(F.arrays_overlap("shingles", F.lit(every).cast("array<bigint>")))
    banded = windows.where(F.size("shingles") > 0).select(key, "_row", "length", "at", "shingles", F.explode(_bands(F.col("shingles"))).alias("band"))
    of_known = known.select("license", "length", "t_shingles", F.explode(_bands(F.col("t_shingles"))).alias("band"))
    met = banded.join(F.broadcast(of_known), ["length", "band"])  # the templates' own rows: BANDS for each
    exact = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    sure = met.select(key, "_row", "license", "length", "at", exact.alias("c")).where(F.col("c") >= CONTAINMENT)
    one = sure.groupBy(key, "_row", "license", "length", "at").agg(F.max("c").alias("c"))
    return one.groupBy(key, "_row", "license").agg(
        F.count(F.lit(1)).alias("n_windows"), F.round(F.max("c"), 6).alias("containment"), F.min("at").cast("long").alias("first_word"),
        F.max(F.col("at") + F.col("length") - 1).cast("long").alias("last_word"),
    ).drop("_row")


def _any(tests: list[Column]) -> Column:
    """Whether one holds, as a tree of little depth."""
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2])] + tests[len(tests) // 2 * 2 :]
    return tests[0]


def _anchors(notices: list[list[str]]) -> list[str]:
    """Words of which each text that holds a notice has one. A containment of at least 0.8 lacks at most a fifth of
    the distinct shingles, so of any larger set of a notice's shingles one is there, with its words; of each
    shingle the longer word is taken, and the shingles with the longest words, as these are rare."""
    chosen = set()
    for words in notices:
        pairs = sorted({tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}, key=lambda p: (-max(map(len, p)), p))
        lacking = int((1 - CONTAINMENT) * len(pairs) + 1e-9)
        chosen |= {max(p, key=lambda w: (len(w), w)) for p in pairs[: lacking + 1]}
    return sorted(chosen)
