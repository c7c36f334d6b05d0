r"""Personal data: exact base patterns, then a skip-chain conditional random field over candidate tokens.

Candidate tokens are runs without white space that hold a digit or @; all others are outside any entity.
Within a document, neighbouring candidates are linked in a chain, and each candidate is linked to the
nearest earlier one of the same form, for each of its forms (letters and digits in lower case; 5 or more digits; the
last 7 of 8 or more digits; the part of 5 or more characters before an @; those of a whole base span of several tokens): skip links, linear in number however often a token
repeats. Unary potentials are a softmax regression on token shapes, pairwise ones smoothed log-odds of label pairs; both are
fitted on the base labels of a bounded sample (the FIT_DOCS documents of the smallest hashes of id and text). Tokens in base
spans are observed. Loopy belief propagation then carries their labels along the links, so that a token which the patterns
miss, but which repeats or resembles one they found, gets the same label. Tokens with a marginal of at least SURE are
added as spans, neighbouring ones of a kind as one. Base spans always stay. The number of rounds is fixed, so a
document's result does not depend on the documents that share its batch.

Cases: a null text counts as empty; a row is a document of its own, so repeated rows give repeated results; a null
doc_id is hashed like any other; empty tables fit no model and give an empty result; other columns are left
out, so names cannot clash. Texts are read whole, and every pattern scans in linear time; numbers of any length are safe.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, smallest_hashes

KINDS = ["email", "ip", "card", "phone"]
OUTSIDE, LABELS = 0, 5
FIT_DOCS = 4000
SURE, ROUNDS = 0.85, 8
#: Chain links, skip links by text, skip links by digits.
LINKS = "ctd"
#: Pairs of equal labels that each kind of link is taken to have had before any was counted: tokens with the same text nearly always, those that share five
#: digits or more as good as surely name one thing, and a
#: sample has few such pairs.
SAME = (0.0, 100.0, 100_000.0)

#: Fixed values of the contract; possessive and bounded forms that match the same.
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

SEED = re.compile(r"[0-9@]\S*")
WORDY = re.compile(r"[\W_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end), sorted."""
    spans, last = [], 0
    if "@" in text:
        for m in AT.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                spans.append((start, 0, m.end()))
                last = m.end()
            else:
                last = max(last, m.start())
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.groups())):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of each token with a digit or @."""
    out, last = [], 0
    for m in SEED.finditer(text):
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        out.append((start, m.end()))
        last = m.end()
    return out


N_FEATURES = 24


def features(token: str) -> list[int]:
    """The indexes of the token's shape features."""
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    number = re.sub("[^0-9]", "", token) if 12 <= digits <= 19 else ""
    return [
        0,
        1 + min(4, digits // 4),
        6 + min(3, letters // 3),
        10 + min(4, token.strip(".,;:!?").count(".")),
        *([15] if "@" in token else []),
        *([16] if "-" in token.strip("-") else []),
        *([17] if token[0] == "+" else []),
        *([18] if token[0] in "([" else []),
        *([19] if any(q in token for q in "\"'") else []),
        *([20] if digits == len(token) else []),
        *([21] if digits and letters else []),
        *([22 + luhn(number)] if 12 <= len(number) <= 19 else []),
    ]


def forms_of(token: str) -> set[tuple[str, str]]:
    """The forms by which tokens, or whole base spans, resemble each other."""
    plain = WORDY.sub("", token).lower()
    if not plain:
        return set()
    digits = "".join(c for c in plain if c.isdigit())
    forms = {("t", plain)}
    if len(digits) >= 5:
        forms.add(("d", digits))
    if len(digits) >= 8:
        forms.add(("e", digits[-7:]))
    local = WORDY.sub("", token.partition("@")[0]).lower()
    if "@" in token and len(local) >= 5:
        forms.add(("t", local))
    return forms


def links(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], ...]:
    """(chain links, skip links by text, skip links by digits) between candidates, as pairs of positions; what digits link is not linked by text too. A base span of
    several candidates lends its own forms to the last of them."""
    chain = [(k, k + 1) for k in range(len(spans) - 1) if spans[k + 1][0] - spans[k][1] == 1]
    skip, seen, at = {"t": set(), "d": set(), "e": set()}, {}, 0
    ends = sorted(base, key=lambda x: (x[2], x[0]))
    for k, (a, b) in enumerate(spans):
        forms = forms_of(text[a:b])
        while at < len(ends) and ends[at][2] <= b:
            if ends[at][0] < a < ends[at][2]:
                forms |= forms_of(text[ends[at][0] : ends[at][2]])
            at += 1
        for form in forms:
            if form in seen:
                skip[form[0]].add((seen[form], k))
            seen[form] = k
    digits = skip["d"] | skip["e"]
    return chain, sorted(skip["t"] - digits), sorted(digits)


def labels_of(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[int]:
    """For each candidate 1 + the kind of the first base span that overlaps it, or 0."""
    out, at = [], 0
    for a, b in spans:
        while at < len(base) and base[at][2] <= a and all(x[2] <= a for x in base[at : at + 4]):
            at += 1
        out.append(next((k + 1 for s, k, e in base[at : at + 8] if s < b and a < e), OUTSIDE))
    return out


class Model:
    """Unary weights and the log potentials of chain links, skip links by text and skip links by digits."""

    def __init__(self, unary: np.ndarray, *pairs: np.ndarray):
        self.unary, self.pairs = unary, pairs

    @classmethod
    def fitted(cls, shapes: list[tuple[tuple[int, ...], int, int]], *pairs: np.ndarray, steps: int = 200) -> Model:
        """shapes: (features, label, count). Piecewise: softmax regression for the unary part, counts for the links."""
        unary = np.zeros((N_FEATURES, LABELS))
        if shapes:
            x = np.zeros((len(shapes), N_FEATURES))
            for k, (on, _, _) in enumerate(shapes):
                x[k, list(on)] = 1
            y = np.eye(LABELS)[[label for _, label, _ in shapes]]
            n = np.array([c for _, _, c in shapes], float)[:, None]
            for _ in range(steps):
                p = np.exp(x @ unary - (x @ unary).max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                unary -= 2.0 * (x.T @ ((p - y) * n) / n.sum() + 1e-4 * unary)

        def odds(counts: np.ndarray, same: float) -> np.ndarray:
            both = counts + counts.T + 0.5 + same * np.eye(LABELS)
            joint = both / both.sum()
            own = joint.sum(1)
            return np.log(joint / np.outer(own, own))

        return cls(unary, *map(odds, pairs, SAME))


def marginals(model: Model, unary: np.ndarray, *links: np.ndarray) -> np.ndarray:
    """Loopy belief propagation over all candidates of a slice of documents at once; links are (n, 2) arrays, one for each of the model's pairs."""
    ends = np.concatenate(links).astype(np.int64).reshape(-1, 2)
    if not len(ends):
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    potential = np.concatenate([np.repeat(of[None], len(own), 0) for of, own in zip(model.pairs, links, strict=True)])
    source, target = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]])
    potential, back = np.concatenate([potential, potential]), np.concatenate([np.arange(len(ends), 2 * len(ends)), np.arange(len(ends))])
    messages = np.zeros((2 * len(ends), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        out = belief[source] - messages[back]
        scores = out[:, :, None] + potential
        top = scores.max(1)
        new = top + np.log(np.exp(scores - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        messages = 0.5 * messages + 0.5 * new
    belief = unary.copy()
    np.add.at(belief, target, messages)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_DOCS) -> Model:
    """A model from the base labels of rows documents at most; counts of shapes and label pairs leave the executors."""
    chosen = smallest_hashes(df.select(key, text), rows, 11)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = []
            for t in part.column(0).to_pylist():
                t = t or ""
                spans = candidates(t)
                base = base_spans(t)
                own = labels_of(spans, base)
                found += [("u", ",".join(map(str, features(t[a:b]))), y) for (a, b), y in zip(spans, own, strict=True)]
                for kind, pairs in zip(LINKS, links(t, spans, base), strict=True):
                    found += [(kind, "", own[i] * LABELS + own[j]) for i, j in pairs]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32()))], names=["what", "shape", "label"])

    shapes, pairs = [], {kind: np.zeros((LABELS, LABELS)) for kind in LINKS}
    counts = chosen.select(F.col(text).alias("text")).mapInArrow(counted, "what string, shape string, label int").groupBy("what", "shape", "label").count()
    for row in counts.orderBy("what", "shape", "label").collect():  # at most the number of shapes that features() can name
        if row["what"] == "u":
            shapes.append((tuple(map(int, row["shape"].split(","))), row["label"], row["count"]))
        else:
            pairs[row["what"]][divmod(row["label"], LABELS)] += row["count"]
    return Model.fitted(shapes, *pairs.values())


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], model: Model) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the model adds: (start, index in KINDS, end), disjoint from the base."""
    spans = [candidates(t) for t in texts]
    own = [labels_of(s, b) for s, b in zip(spans, bases, strict=True)]
    linked, rows, firsts = tuple([] for _ in LINKS), [], []
    for t, s, y, base in zip(texts, spans, own, bases, strict=True):
        first = len(rows)
        firsts.append(first)
        if any(y) or len(s) > 1:
            for every, some in zip(linked, links(t, s, base), strict=True):
                every += [(first + i, first + j) for i, j in some]
        for (a, b), label in zip(s, y, strict=True):
            unary = model.unary[features(t[a:b])].sum(0)
            if label:
                unary = np.where(np.arange(LABELS) == label, 0.0, -30.0)
            rows.append(unary)
    if not rows:
        return [[] for _ in texts]
    p = marginals(model, np.array(rows), *[np.array(x).reshape(-1, 2) for x in linked])
    out = []
    for t, s, y, first in zip(texts, spans, own, firsts, strict=True):
        found: list[tuple[int, int, int]] = []
        whole = -2  # where the last added token ended, marks included
        for k, ((a, b), label) in enumerate(zip(s, y, strict=True)):
            best = int(p[first + k].argmax())
            if label or best == OUTSIDE or p[first + k, best] < SURE:
                continue
            joins, whole = a - whole == 1, b
            while a < b and not t[a].isalnum() and t[a] not in "+(":
                a += 1
            while b > a and not t[b - 1].isalnum() and not (t[b - 1] == ")" and "(" in t[a:b]):
                b -= 1
            if joins and found and found[-1][1] == best - 1:
                found[-1] = (found[-1][0], best - 1, b)
            elif a < b:
                found.append((a, best - 1, b))
        out.append(found)
    return out


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def report(df: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: key, base counts by kind, digest of the base spans, all spans, and the number that the model added."""
    model = fit(df, key, text) if model is None else model
    source = df.select(F.col(key), F.col(text).alias("text"))
    schema = source.drop("text").schema
    names = [key, *[x.split()[0] for x in SCHEMA.split(", ")]]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = ["" if t is None else t for t in part.column(1).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, model)
            counts = [pa.array([sum(x[1] == k for x in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b in bases], pa.string())
            every = pa.array([shown(sorted(b + a)) for b, a in zip(bases, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, every, pa.array([len(a) for a in added], pa.int64())], names=names)

    for field in SCHEMA.split(", "):
        schema = schema.add(*field.split())
    return source.mapInArrow(found, schema)
