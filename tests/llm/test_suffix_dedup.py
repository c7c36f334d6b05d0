import collections
import hashlib
import random

import numpy as np
import pytest

from tessella.llm import suffix_dedup
from tessella.llm.queries import op12_suffix_dedup
from tessella.plans import scans

L = suffix_dedup.LENGTH


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) by counting every string of LENGTH bytes."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[k : k + L] for _, t in raw for k in range(len(t) - L + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t) + 1)
        for k in range(len(t) - L + 1):
            if seen[t[k : k + L]] > 1:
                gone[k : k + L] = b"\1" * L
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("letters", [1, 2, 3, 26])
def test_suffix_array(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 8, 30, 200]:
        for _ in range(60 if n < 100 else 10):
            s = [rng.randint(1, letters) for _ in range(n)]
            s = s * rng.randint(1, 3) + [0]
            assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:]), s


def mixture(rng, texts, alphabet):
    """Texts of shared passages, cut anywhere and changed here and there."""
    made = lambda n: "".join(rng.choices(alphabet, k=n))
    passages = [made(rng.choice([150, 199, 200, 201, 230, 420, 900])) for _ in range(6)]
    out = []
    for _ in range(texts):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                p = p[rng.randint(0, 60) : len(p) - rng.randint(0, 60)]
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice(alphabet) + p[k + 1 :]
            parts += [p, made(rng.choice([0, 1, 7, 60, 300]))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("hot", [2_000, 3])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop é𝒳\n"])
def test_removal_equals_brute_force(spark, alphabet, hot):
    rng = random.Random(len(alphabet))
    texts = mixture(rng, 120, alphabet)
    rows = [(rng.choice([None, 7, k, k]), t) for k, t in enumerate([*texts, *texts[:3], "x" * 700, "xy" * 400, "x" * 200, "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = shown(suffix_dedup.removed(df, hot=hot).withColumn("kept_sha256", suffix_dedup.F.sha2("kept", 256)))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 10_000 and any(r[2] and r[1] - r[2] for r in got)


def test_removal_of_the_given_documents(spark, small):
    want = brute(pairs(spark.read.parquet(f"{small}/documents.parquet")))
    assert shown(op12_suffix_dedup(spark, small)) == want


def test_odd_rows_and_empty_tables(spark, odd, empty):
    assert shown(suffix_dedup.report(odd)) == brute(pairs(odd))
    assert suffix_dedup.report(empty).count() == 0


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 333)
    rng = random.Random(9)
    rows = list(enumerate(mixture(rng, 40, "abcd")))
    raw = [t.encode() for _, t in rows]
    starts = collections.Counter()
    for k, t in enumerate(raw):
        for begin in range(0, max(1, len(t) - L + 1), 333):
            piece = t[begin : begin + 333 + L - 1]
            _, _, s0, s1, _ = suffix_dedup.segments(np.frombuffer(piece, np.uint8), np.array([len(piece)]))
            starts.update((k, begin + s) for a, b in zip(s0, s1) for s in range(a, b + 1))
    assert starts == collections.Counter((k, s) for k, t in enumerate(raw) for s in range(len(t) - L + 1))


def test_shared_windows_of_segments():
    """Segments around one anchor, any start, right and left ends that differ."""
    rng = random.Random(2)
    core = bytes(rng.choices(b"abcdefgh", k=400))
    texts, offsets = [], []
    for _ in range(60):
        a, b = rng.randint(0, 160), rng.randint(240, 400)
        t = bytearray(core[a:b])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice(b"abcdefgh")
        t[170 - a : 210 - a] = core[170:210]
        if len(t) >= L and bytes(t) not in texts:
            texts.append(bytes(t))
            offsets.append(170 - a)
    seen = collections.Counter((k - o, t[k : k + L]) for t, o in zip(texts, offsets) for k in range(min(o, len(t) - L) + 1))
    want = [(i, k) for i, (t, o) in enumerate(zip(texts, offsets)) for k in range(min(o, len(t) - L) + 1) if seen[k - o, t[k : k + L]] > 1]
    of, at = suffix_dedup.shared_windows(texts, np.array(offsets))
    assert sorted(set(zip(of.tolist(), at.tolist()))) == want and want


def test_copies_of_a_text_make_windows_once(spark, monkeypatch):
    """A segment of a common anchor that came with forty copies of its text, and one that came once."""
    rng = random.Random(4)
    core = "".join(rng.choices("abcdefgh", k=240))
    twice, once = ("x" * 20 + core).encode(), (core + "y" * 30).encode()
    rows = [(1, 1, 10, 260, 0, False, bytearray(twice))] * 40 + [(1, 2, 20, 270, 0, True, bytearray(once))]
    hot = spark.createDataFrame(rows, "h long, g long, a long, b int, start int, open boolean, bytes binary").repartition(8)
    made = []

    def noted(df):
        """Adds the rows that the tasks in Arrow of df's plan make."""
        run = df._jdf.queryExecution()
        run.toRdd().count()
        left = [run.executedPlan()]
        while left:
            plan = left.pop()
            left += scans._below(plan)
            if plan.getClass().getSimpleName() == "MapInArrowExec":
                made.append(int(plan.metrics().apply("pythonNumRowsReceived").value()))
        return df

    real = suffix_dedup.saved
    monkeypatch.setattr(suffix_dedup, "saved", lambda df, name: real(noted(df), name))
    spans = noted(suffix_dedup.counted(hot))
    assert sorted(map(tuple, spans.collect())) == [(20, 270, k, k + L) for k in range(len(core) - L + 1)]
    assert sum(made) == len(twice) + len(once) - 2 * (L - 1)


def test_near_copies_make_few_rows(spark, monkeypatch):
    """Of 400 copies of a passage, each with a word of its own, nearly all windows repeat: what is made and joined for them follows the copies, not the windows."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    texts = []
    for k in range(400):
        at = rng.randrange(len(words))
        texts.append(" ".join([*words[:at], f"{k:05d}", *words[at + 1 :]]))
    rows = list(enumerate(texts))
    made = []

    def noted(df):
        run = df._jdf.queryExecution()
        run.toRdd().count()
        left = [run.executedPlan()]
        while left:
            plan = left.pop()
            left += scans._below(plan)
            if "Join" in plan.getClass().getSimpleName():
                made.append(int(plan.metrics().apply("numOutputRows").value()))
            if plan.getClass().getSimpleName() == "MapInArrowExec":
                made.append(int(plan.metrics().apply("pythonNumRowsReceived").value()))
        return df

    windows, real = [], suffix_dedup.saved

    def kept(df, name):
        out = real(noted(df) if name in ("pieces", "piece-kinds", "hot-windows", "spans") else df, name)
        if name == "segment-bytes":
            windows.append(out.where("hot").selectExpr(f"sum(length(bytes) - {L - 1})").first()[0])
        return out

    monkeypatch.setattr(suffix_dedup, "saved", kept)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shown(suffix_dedup.removed(df, hot=3).withColumn("kept_sha256", suffix_dedup.F.sha2("kept", 256))) == brute(rows)
    assert windows[0] > 50_000 and max(made) < windows[0] / 5
