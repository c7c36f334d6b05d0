"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule is a boolean expression that is true for a text to reject. On a bounded sample, the rows of the smallest hashes,
each rule's work is counted and its rejections are found, all in one job. The next rule is always the one with most
rejections per unit of work among the texts that the rules before it let pass; a nested CASE evaluates it only for
these. Work is counted, not timed, so the order is the same on each run; ties go to the cheaper rule, then to the name.

Cases: a null text has no words and fails min_words; an empty table gives an empty result; repeated
rows are judged alike; other columns pass through, whatever their names (metrics are computed in
structs and named at the end). Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import WORD_BREAK, smallest_hashes

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then refers to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")


def word_chars_of(text: Column) -> Column:
    return F.length(F.translate(text, WORD_BREAK, "")).cast("long")


def n_symbols_of(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines_of(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WORD_BREAK, "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _doubled(hashes: Column, step: int) -> Column:
    """From the hashes of all runs of step words those of runs of twice as many."""

    def pairs(h: Column) -> Column:
        later = F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0)))
        return F.filter(F.zip_with(h, later, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda x: x.isNotNull())

    return let(hashes, pairs)


def window_hashes_of(words: Column, width: int = WINDOW) -> Column:
    """A 64-bit hash for each run of width words; width is a power of two."""
    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < width:
        hashes, step = _doubled(hashes, step), 2 * step
    return hashes


def covered_by_repeats(hashes: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

    def repeats(o: Column) -> Column:
        both = F.zip_with(o, F.slice(o, 2, F.greatest(F.size(o) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("one"), b.alias("next")))
        return F.filter(both, lambda p: p["one"]["h"] == p["next"]["h"])

    pairs = let(ordered, repeats)
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda p: F.array(p["one"]["at"], p["next"]["at"])))))
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, at: F.struct((at + width).alias("end"), (s["n"] + width - F.greatest(s["end"] - at, F.lit(0))).alias("n")),
        lambda s: s["n"].cast("long"),
    )


def n_repeat_words_of(words: Column) -> Column:
    """Words in windows of 8 words that are found twice or more in the text, the first included; compared by 64-bit hashes."""
    none = F.lit(0).cast("long")
    return let(window_hashes_of(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered_by_repeats(h)))


@dataclass(frozen=True)
class Rule:
    """rejects: a boolean expression over the column text, or over metrics that are given as columns. per_char and per_word: its
    work, in units of one pass over a character."""

    name: str
    rejects: Column
    per_char: float = 1.0
    per_word: float = 0.0


def rules(text: str = "text") -> list[Rule]:
    """The rules of production: two of the base and four that only clear junk can fail."""
    t = _text(text)
    n_words = F.size(words_of(t)).cast("long")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return [
        Rule("min_words", n_words < 20, 2.0, 2.0),
        Rule("repeated_windows", 100 * n_repeat_words_of(words_of(t)) > 30 * n_words, 4.0, 60.0),
        Rule("symbols", 10 * n_symbols_of(t) > 3 * n_words, 3.0, 2.0),
        Rule("word_length", (word_chars_of(t) > 16 * n_words) | (word_chars_of(t) < 2 * n_words), 4.0, 2.0),
        Rule("duplicate_lines", 2 * n_dup_lines_of(t) > F.size(F.split(t, "\n", -1)), 3.0),
        Rule("capitals", (letters > 40) & (10 * F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) > 7 * letters), 8.0),
    ]


#: Rows of the sample, at most.
SAMPLE = 2_048


def ordered(df: DataFrame, given: list[Rule], text: str = "text", rows: int = SAMPLE) -> list[Rule]:
    """The rules, each the one of most rejections per work among the sampled texts that those before it let pass."""
    t = _text(text)
    verdicts = F.concat(*[F.when(r.rejects, "1").otherwise("0") for r in given])
    sample = smallest_hashes(df, rows, 7).select(verdicts.alias("v"), F.length(t).alias("chars"), F.size(words_of(t)).alias("words"))
    left = [r.asDict() for r in sample.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).collect()]  # 2^rules rows at most
    order, todo = [], list(enumerate(given))
    while todo:

        def rank(item: tuple[int, Rule]) -> tuple[float, float, str]:
            k, rule = item
            work = sum(rule.per_char * r["chars"] + rule.per_word * r["words"] for r in left) + 1
            return -sum(r["n"] for r in left if r["v"][k] == "1") / work, work, rule.name

        k, rule = best = min(todo, key=rank)
        order.append(rule)
        todo = [x for x in todo if x[0] != k]
        left = [r for r in left if r["v"][k] == "0"]
    return order


def cascade(given: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null; later rules are not evaluated."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(given):
        verdict = F.when(rule.rejects, F.lit(rule.name)).otherwise(verdict)
    return verdict


def kept(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that no rule rejects."""
    return df.where(cascade(ordered(df.select(key, text), rules(text), text)).isNull())


def judged(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the metrics, base_failed, kept and failed_rule. The base's metrics are wanted for every row, so here the
    rules read them instead of the text; the cascade's order is found as for kept()."""
    t = _text(text)
    order = [r.name for r in ordered(df.select(key, text), rules(text), text)]
    w = F.col("_words")
    base = df.select(F.col(key), t.alias("_t"), words_of(t).alias("_words")).select(
        key,
        "_t",
        F.size(w).cast("long").alias("n_words"),
        word_chars_of(F.col("_t")).alias("word_chars"),
        n_symbols_of(F.col("_t")).alias("n_symbols"),
        n_dup_lines_of(F.col("_t")).alias("n_dup_lines"),
        window_hashes_of(w).alias("_hashes"),
    )
    base = base.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("_hashes")) == F.size("_hashes"), F.lit(0).cast("long")).otherwise(covered_by_repeats(F.col("_hashes"))),
    )
    n, t = F.col("n_words"), F.col("_t")
    known = {
        "min_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "word_length": (F.col("word_chars") > 16 * n) | (F.col("word_chars") < 2 * n),
        "duplicate_lines": 2 * F.col("n_dup_lines") > F.size(F.split(t, "\n", -1)),
    }
    given = [Rule(r.name, known.get(r.name, r.rejects)) for r in rules("_t")]
    by_name = {r.name: r for r in given}
    failed = known["min_words"] | known["repeated_windows"]
    return base.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), cascade([by_name[x] for x in order]).alias("failed_rule"),
    ).withColumn("kept", F.col("failed_rule").isNull())
