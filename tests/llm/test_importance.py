import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tessella.llm import importance
from tessella.llm.queries import op11_importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2) for i in range(len(w) - n + 1)]


def brute(docs, target, least=20, share=(25, 100)):
    """Rows (doc_id, n_features, weight, score, rank), rank by sorting everything."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log(float(b + 1) * float(s.sum() + 10_000) / (float(a + 1) * float(t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist())]
    rows = []
    for i, text in docs:
        w, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = fit[: share[0] * len(fit) // share[1]]
    rest = [r for r in rows if r[4] < least] + fit[len(drawn) :]
    return sorted(((*r[:4], k + 1) for k, r in enumerate(drawn)), key=repr) + sorted(((*r[:4], None) for r in rest), key=repr)


def shown(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    return sorted((r for r in rows if r[4] is not None), key=repr) + sorted((r for r in rows if r[4] is None), key=repr)


def pairs(df):
    return [(r[0], r[1]) for r in df.collect()]


def test_importance_equals_brute_force(spark, small):
    docs, target = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    assert shown(op11_importance(spark, small)) == brute(pairs(docs.select("doc_id", "text")), pairs(target.select("item_id", "text")))


def test_importance_of_odd_rows(spark, odd, empty, docs):
    target = spark.createDataFrame([(1, "word word x"), (2, None)], "item_id long, text string")
    many = odd.unionByName(odd.where("doc_id = 7")).unionByName(odd.where("doc_id is null"))
    assert shown(importance.report(many, target)) == brute(pairs(many.select("doc_id", "text")), pairs(target))
    assert importance.report(empty, target).count() == 0
    assert shown(importance.report(odd, empty)) == brute(pairs(odd.select("doc_id", "text")), [])


def test_long_texts_lose_no_pair(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    monkeypatch.setattr(importance, "WORDS", 30)
    rng = random.Random(3)
    texts = [" ".join("ab"[: rng.randint(1, 2)] * rng.randint(1, 60) for _ in range(rng.randint(0, 80))) for _ in range(20)]
    hashes, found = importance.PairHashes(100), {}
    for words, rows, new in importance.worded([t.encode() for t in texts]):
        for r, b in zip(*importance.buckets(hashes, words, rows, new)):
            found.setdefault(int(r), []).append(int(b))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(features(t)[1]) for k, t in enumerate(texts) if t.strip()}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16, 33])
def test_tournament_merges_and_leaves_the_rest(k):
    rng = random.Random(k)
    runs = [sorted((rng.randint(0, 9), rng.randint(0, 9)) for _ in range(rng.randint(0, 12))) for _ in range(k)]
    tree = importance.Tournament([iter(r) for r in runs])
    want = sorted(x for r in runs for x in r)
    taken = [tree.pop() for _ in range(len(want) // 2)]
    assert taken == want[: len(want) // 2]
    assert sorted(tree.rest()) == want[len(want) // 2 :]
    assert importance.Tournament([iter([])]).pop() is None


@pytest.mark.parametrize("share", [(1, 3), (1, 1), (0, 1)])
def test_draw_cuts_scores_with_many_rows_by_id(spark, share):
    """Few scores, repeated ids, null ids and copies: ranges of 10 rows, runs of 16."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        id = None if i % 9 == 0 else rng.randint(0, 150)
        n = rng.randint(1, 2)
        rows += [(id, 30 if i % 7 else 3, n, 0, rng.choice([5, 6, 6, 6, -3]) if id is not None else 6)] * rng.randint(1, 3)
    df = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long").repartition(5)
    got = sorted((tuple(r) for r in importance.ranked(df, share, range_rows=10, run_rows=16).collect()), key=repr)
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = share[0] * len(fit) // share[1]
    want = [(r[0], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(fit)] + [(r[0], *r[2:], None) for r in rows if r[1] < 20]
    assert got == sorted(want, key=repr)


def test_sql_equals_the_query(spark, small):
    import duckdb

    from tessella.llm.queries import oracle_sql

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got = con.sql(oracle_sql()["op11_importance"])
    assert [c for c in got.columns] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(got.fetchall(), key=repr) == sorted((tuple(r) for r in op11_importance(spark, small).collect()), key=repr)
