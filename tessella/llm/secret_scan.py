r"""Secret scans in DataFrame expressions only: base patterns, then sliding-window entropy over candidate strings.

Spark has no function for the positions of all matches, so they are derived: the pieces between
matches (split) and the matches (regexp_extract_all) alternate, and running sums of their lengths are
the positions. Candidate strings are runs of 20 or more characters of [A-Za-z0-9+/_=-]. For each
character class the Shannon entropy of every window of 20 characters is kept by incremental counts:
the state carries the count of each character; when the window moves, only the counts of the character that leaves and
of the one that enters change, and with them two terms of sum(c log2 c). A candidate is reported if its highest window
reaches the class's threshold, unless the allow-list suppresses it or a base span overlaps it. Base spans and
candidates are merged in order of their starts, and running extremes of the base spans tell which candidates are free.

Cases: a null text counts as empty; empty tables and repeated rows need no care; other columns are left out
of the result, so names cannot clash. Texts are scanned whole. Every pattern uses possessive or plain
character-class loops, so long texts and long tokens cost linear time; running sums over n matches cost n^1.5 at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: (kind, Java pattern of a match that counts).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
BASE_KINDS = ["assign", "access", "hex"]

WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}+"
#: (kind, pattern of the whole candidate, least entropy in bits of its best window); the first class that fits is the candidate's.
CLASSES = [
    ("entropy_hex", r"^[0-9A-Fa-f]*[0-9][0-9A-Fa-f]*$", 3.0),
    ("entropy_alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.6),
    ("entropy_base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.8),
]
#: Candidates that fit one of these are never reported: identifiers in UUID form, examples and placeholders (of 64 characters
#: at most, as longer strings hold such runs by chance), paths of plain words.
ALLOWED = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)^(?=.{0,64}$).*(example|placeholder|dummy|xxxx|0123456789|abcdefgh)",
    r"^[A-Za-z_=/-]+$",
    r"^[0-9_=/+-]+$",
]
KIND_ORDER = [*BASE_KINDS, *[k for k, _, _ in CLASSES]]


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running(values: Column, first: Column, grown, block: int = 512) -> Column:
    """For each of the values the fold of those before it: first, grown(first, v1), grown(grown(first, v1), v2)... The fold
    starts from first in each block of values, and again over the blocks' totals, so grown must be associative with first
    as its neutral element. Appending copies an array, so this costs n * block and (n / block)^2 rather than n^2."""

    def fold(items: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(first.alias("at"), F.array_repeat(first, 0).alias("out")),
            lambda a, x: F.struct(grown(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: fold(F.slice(v, k * block + 1, block)))
        return F.flatten(let(blocks, lambda b: F.zip_with(b, fold(F.transform(b, lambda x: x["at"]))["out"], lambda x, start: F.transform(x["out"], lambda y: grown(start, y)))))

    return let(values, whole)


def _spans(pieces: Column, matches: Column) -> Column:
    """array<struct<s, m>>: start and text of each match, given the pieces between matches."""
    steps = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("m")))

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda y: y["gap"] + F.length(y["m"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(x, before, lambda y, at: F.struct((at + y["gap"]).alias("s"), y["m"].alias("m")))

    return let(steps, placed)


def _found(text: Column, pattern: str, may: Column) -> Column:
    """(pieces, matches) of pattern in text; neither is computed for texts that cannot match."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(may, F.split(text, pattern, -1)).otherwise(none).alias("p"),
        F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("m"),
    )


#: The characters that candidates are made of; all others count as one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def best_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window of the text (shorter texts: of the whole).

    The fold's state holds the window's count of each character of ALPHABET. A step has the characters that enter and leave; it
    changes their two counts and the two terms of sum(c log2 c), so a text costs time in proportion to its length."""
    log = F.lit([0.0] + [c * math.log2(c) for c in range(1, window + 2)])
    term = lambda c: F.element_at(log, c + 1)
    slots = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) + 1)

    def steps(own: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), window), own)
        pairs = F.zip_with(own, F.slice(leaving, 1, F.size(own)), lambda i, o: F.struct(i.alias("i"), o.alias("o")))
        width = F.least(F.size(own), F.lit(window))
        return let(F.struct(pairs.alias("pairs"), width.alias("width")), fold)

    def fold(given: Column) -> Column:
        start = F.struct(
            F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(0.0).alias("best")
        )

        def step(a: Column, x: Column) -> Column:
            full = x["o"] > 0
            gone = F.when(full, F.element_at(a["counts"], F.greatest(x["o"], F.lit(1)))).otherwise(1)
            less = a["sum"] + F.when(full, term(gone - 1) - term(gone)).otherwise(0.0)
            had = F.element_at(a["counts"], x["i"]) - F.when(full & (x["i"] == x["o"]), 1).otherwise(0)
            total = less + term(had + 1) - term(had)
            n = F.least(a["n"] + 1, F.lit(window))
            bits = F.log2(n.cast("double")) - total / n
            counts = F.when(x["i"] == x["o"], a["counts"]).otherwise(
                F.transform(a["counts"], lambda c, k: c + F.when(k + 1 == x["i"], 1).when(k + 1 == x["o"], -1).otherwise(0))
            )
            return F.struct(counts.alias("counts"), total.alias("sum"), n.alias("n"), F.when(n >= given["width"], F.greatest(a["best"], bits)).otherwise(a["best"]).alias("best"))

        return F.aggregate(given["pairs"], start, step, lambda a: a["best"])

    return F.when(text == "", F.lit(0.0)).otherwise(let(slots, steps))


def candidate_kind(text: Column) -> Column:
    """The entropy kind of a candidate, or null if its entropy is too low or the allow-list suppresses it."""
    shape = F.lit(None).cast("struct<kind:string,least:double>")
    for name, pattern, least in reversed(CLASSES):
        shape = F.when(text.rlike(pattern), F.struct(F.lit(name).alias("kind"), F.lit(least).alias("least"))).otherwise(shape)
    for pattern in ALLOWED:
        shape = F.when(~text.rlike(pattern), shape)
    return let(shape, lambda x: F.when(x.isNotNull() & (best_entropy(text) >= x["least"]), x["kind"]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base and added: arrays of struct<s, o, e> (start, index in KIND_ORDER, end; code points, end exclusive), base sorted."""
    t = F.coalesce(F.col(text), F.lit(""))
    kinds = {
        "assign": _found(F.col("_t"), ASSIGN, F.col("_t").contains("=") | F.col("_t").contains(":")),
        "access": _found(F.col("_t"), ACCESS, F.col("_t").contains("AKIA")),
        "hex": _found(F.col("_t"), HEX, F.col("_long")),
        "entropy": _found(F.col("_t"), CANDIDATE, F.col("_long")),
    }
    rows = df.select(F.col(key).alias("_key"), t.alias("_t"))
    rows = rows.withColumn("_long", F.col("_t").rlike(CANDIDATE.replace("(?<![A-Za-z0-9+/_=-])", "")))
    rows = rows.select("_key", *[v.alias(f"_{k}") for k, v in kinds.items()])
    rows = rows.select("_key", *[_spans(F.col(f"_{k}.p"), F.col(f"_{k}.m")).alias(f"_{k}") for k in kinds])
    value = lambda m: F.regexp_extract(m, ASSIGN, 2)
    span = lambda x, o: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), (x["s"] + F.length(x["m"])).alias("e"))
    assign = F.filter("_assign", lambda x: F.length(value(x["m"])) >= 8)
    base = F.sort_array(
        F.concat(F.transform(assign, lambda x: span(x, 0)), F.transform("_access", lambda x: span(x, 1)), F.transform("_hex", lambda x: span(x, 2)))
    )
    rows = rows.select("_key", "_entropy", base.alias("_base"))
    free = F.when((F.size("_base") == 0) | (F.size("_entropy") == 0), F.col("_entropy")).otherwise(_apart(F.col("_entropy"), F.col("_base")))
    rows = rows.select("_key", "_base", F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), candidate_kind(x["m"]).alias("k"))).alias("_free"))
    order = F.lit(KIND_ORDER)
    added = F.transform(
        F.filter("_free", lambda x: x["k"].isNotNull()),
        lambda x: F.struct(x["s"].alias("s"), (F.array_position(order, x["k"]) - 1).cast("int").alias("o"), (x["s"] + F.length(x["m"])).alias("e")),
    )
    return rows.select(F.col("_key").alias(key), F.col("_base").alias("base"), added.alias("added"))


def _apart(found: Column, base: Column) -> Column:
    """The candidates (sorted array<struct<s, m>>) that overlap no base span (sorted array<struct<s, o, e>>)."""
    far = (1 << 31) - 1
    of_base = F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("i"), b["e"].alias("e")))
    of_found = F.transform(found, lambda x, i: F.struct(x["s"].alias("s"), (i + 1).alias("i"), (x["s"] + F.length(x["m"])).alias("e")))

    def merged(every: Column) -> Column:
        ends = F.transform(every, lambda x: F.when(x["i"] == 0, x["e"]).otherwise(0))
        starts = F.transform(F.reverse(every), lambda x: F.when(x["i"] == 0, x["s"]).otherwise(far))
        reached = running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        ahead = F.reverse(running(starts, F.lit(far), lambda a, b: F.least(a, b)))
        near = F.zip_with(reached, ahead, lambda a, b: F.struct(a.alias("reached"), b.alias("ahead")))
        judged = F.zip_with(every, near, lambda x, y: F.when((x["i"] > 0) & (y["reached"] <= x["s"]) & (y["ahead"] >= x["e"]), x["i"]))
        return F.transform(F.filter(judged, lambda i: i.isNotNull()), lambda i: F.element_at(found, i))

    return let(F.sort_array(F.concat(of_base, of_found)), merged)


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.lit(kinds), x["o"] + 1), x["s"], x["e"])), ",")


def report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: the counts of base spans by kind, the digest of the base spans, all spans."""
    found = scan(df, key, text)
    count = lambda o: F.size(F.filter("base", lambda x: x["o"] == o)).cast("long")
    return found.select(
        key,
        *[count(o).alias(f"n_{k}") for o, k in enumerate(BASE_KINDS)],
        F.sha2(joined(F.col("base"), KIND_ORDER).cast("binary"), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "added")), KIND_ORDER).alias("spans"),
    )
