"""corpus_pipeline.run() against the five stages done plainly on a small table."""

import base64
import collections

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessella.llm.queries import QUALITY_SQL, vocabulary

from test_text_operators import brute_join, texts


def plain_lines(rows):
    """(doc_id, text) without the lines that a larger doc_id keeps."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            holders.setdefault(k, []).append(i)
    keeper = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if keeper.get(key(x), i) == i)) for i, t in rows]


def test_run(spark, docs, small):
    import corpus_pipeline

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as from '{small}/documents.parquet'")
    good = {i for i, ok in con.execute(f"select doc_id, kept from ({QUALITY_SQL})").fetchall() if ok}
    rows = plain_lines([(i, t) for i, t in texts(docs) if i in good])
    single = {c for _, c, _ in brute_join(rows)}
    left = {i: t for i, t in rows if i in single}
    flat = lambda t: " ".join(t.split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert got and set(got) <= set(left)
    gone = set(left) - set(got)
    assert {i for i, t in left.items() if any(b in flat(t) for b in items)} <= gone
    for i in gone:  # each holds a long enough part of an item
        low = flat(left[i]).lower()
        assert any(" ".join(b.split()[a : a + 8]).lower() in low for b in items for a in range(max(1, len(b.split()) - 7)))
    path, pattern = vocabulary()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for i, r in got.items():
        assert list(r["ids"]) == public.encode_ordinary(left[i]) and r["n_tokens"] == len(r["ids"]) and r["round_trip"]


#: Names that an operator might use for columns of its own.
CLASHING = ["_id", "_lines", "_n_lines", "_extra", "_found", "id", "lines", "__own", "row", "rep", "comp", "path", "ids", "a", "b", "hash"]


def odd_documents(docs):
    """Some documents with null ids, nulls in other columns, repeated rows, empty texts, and columns of clashing names."""
    some = docs.where("doc_id % 4 = 0")
    nulls = some.where("doc_id % 8 = 0").withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long")})
    empty = some.where("doc_id % 16 = 0").withColumns({"doc_id": F.col("doc_id") + 100_000, "text": F.when(F.col("doc_id") % 32 == 0, "")})
    every = some.unionByName(some.where("doc_id % 12 = 0")).unionByName(nulls).unionByName(empty)
    return every, every.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_odd_documents(spark, docs, small, k):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    plain, clashing = odd_documents(docs)
    want = [tuple(r) for r in stage(spark, plain, small).select("doc_id", *([] if k == 4 else ["text", "n_chars"])).collect()]
    out = stage(spark, clashing, small)
    got = out.collect()
    assert collections.Counter(tuple(r[c] for c in ("doc_id", *([] if k == 4 else ["text", "n_chars"]))) for r in got) == collections.Counter(want)
    if k < 4:
        assert out.columns == clashing.columns
        assert all(r[c] == c + ("none" if r["doc_id"] is None else str(r["doc_id"])) for r in got for c in CLASHING)
    before = collections.Counter(r["doc_id"] for r in plain.collect())
    after = collections.Counter(i for i, *_ in want)
    assert after[None] == before[None] or k == 0  # only the quality rules judge a row by itself
    assert stage(spark, clashing.limit(0), small).count() == 0
