import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import collocations
from tessella.llm.queries import op13_collocations

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = collections.defaultdict(int)
    for p, a in found.items():
        for q in ((p[0], *p[1:3]), (p[0], *p[2:])) if len(p) == 4 else ():
            inside[q] = max(inside[q], a)
    out = []
    for p, a in found.items():
        score, _, l, r = min((1_000_000 * a * a // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
        if p not in inside or 100 * inside[p] < 50 * a:
            out.append((p[0], " ".join(p[1:]), a, l, r, n[p[0]], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k + 1, *r[1:]) for k, r in enumerate(own[:top])]
    return sorted(ranked)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("lang", "text").collect()]


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_equal_brute_force(spark, small):
    want = brute(pairs(spark.read.parquet(f"{small}/documents.parquet")))
    assert want and shown(op13_collocations(spark, small)) == want


@pytest.mark.parametrize("shard_words,range_bytes", [(60, 2_000), (1, 300), (10_000, 1 << 30)])
def test_small_shards_and_ranges(spark, monkeypatch, shard_words, range_bytes):
    """Tries that end within texts, ranges that begin within subtrees, words as prefixes of others, a very frequent word and pair."""
    monkeypatch.setattr(collocations, "TEXT_BYTES", 40)
    rng = random.Random(shard_words)
    words = ["a", "A", "ab", "abc", "b", "Bé", "é", "\x01", "𝒳y", "-", "the", "the", "the", "of"] + [f"w{k}" for k in range(12)]
    texts = ["".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t", ". ", "\n", ",", "  "]) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    rows = [(rng.choice(["x", "x", "y", None, ""]), t) for t in texts] + [("x", "of the " * 200), ("x", None), ("z", "")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"range": F.lit(1), "phrase": F.lit("p"), "_part": F.lit(2)}).repartition(3)
    want = brute(rows, 4, 30)
    assert len(want) > 60
    assert shown(collocations.mined(df, 4, 30, shard_words=shard_words, range_bytes=range_bytes)) == want


def test_odd_rows_and_empty_tables(spark, odd, empty):
    named = odd.withColumn("lang", F.when(F.col("doc_id") > 5, "q"))
    assert shown(collocations.mined(named)) == brute(pairs(named))
    assert collocations.mined(empty.withColumn("lang", F.lit("q"))).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_000_001
    rows = [("x", 1, "p", "", a + 7, 0, 0), ("x", 1, "q", "", a + 9, 0, 0), ("x", 2, "p q", "q", a, a + 7, a)]
    df = spark.createDataFrame(rows, "lang string, depth int, phrase string, suffix string, a long, l1 long, l2 long")
    assert collocations.scored(df).first()["score"] == 1_000_000 * a * a // ((a + 7) * (a + 9))


@pytest.mark.parametrize("block", [10, 300, 1_000_000])
def test_merged_tries_equal_one_trie(block):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(200)).encode() for _ in range(4)]
    one, blobs = collocations.Shard(), []
    for t in texts:
        own = collocations.Shard()
        for shard in (one, own):
            shard.add(t)
            shard.stop()
        words, nodes, counts, _ = own.trie(True)
        blobs.append(collocations.serialised(words, nodes, counts, collocations.zstandard.ZstdCompressor()))
    words, nodes, counts, n = one.trie(True)
    assert n == 800
    keys, sums, up = [], [], []
    for got_words, ranks, got, first, second in collocations.merged(blobs, block):
        assert got_words == words
        keys += ((ranks[0] << 42) | (ranks[1] << 21) | ranks[2]).tolist()
        sums += got.tolist()
        up += zip(first.tolist(), second.tolist())
    assert keys == nodes.tolist() and sums == counts.tolist()
    of = dict(zip(keys, sums))
    for k, (first, second) in zip(keys, up):
        assert first == of[k >> 42 << 42] and (not k >> 21 & (1 << 21) - 1 or second == of[k >> 21 << 21])
