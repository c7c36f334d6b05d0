"""URL filters: rules on host and path, then a logistic regression on hashed character n-grams of host and path.

The model is fitted on a small labelled table of URLs on the driver (LABELLED_ROWS, a fixed
bound; a real table should replace it) and scores pages in DataFrame expressions only. The hash is a polynomial over code points, so
that SQL engines without Spark's hash functions can check the scores.

Cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged by the
model's intercept alone; empty tables, repeated rows and other columns need no special care.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, WIDTH = 2048, 3
#: (verdict, host, path): fixed values of the contract; a rule fits its host and all subdomains.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: The labelled table is built from these words by rules: kinds of sites that lists of unwanted hosts usually name, and kinds of ordinary sites. No host name
#: of a `pages` table is in it (tested), but single words such as casino or adult can occur in both.
UNWANTED = """casino poker roulette jackpot slots gambling betting bets wager lottery bingo pills viagra cialis pharmacy steroids meds loans payday forex binary-options crypto-profit
adult porn xxx sex escort webcam dating-hookup nude ads adserver banner popup tracker tracking clicks affiliate spam bulk-mail link-farm traffic-boost replica fake-watches
miracle-diet weight-loss keygen warez crack torrent-free prize-winner free-gift giveaway phishing account-verify malware""".split()
PLAIN = """library garden school weather recipes travel museum history theatre hospital university orchestra athletics science research journal news times herald gazette radio
review books reading writing poetry painting gallery music festival cinema football cycling hiking sailing climbing kitchen bakery farm market village city council parish
church transport railway station harbour airport hotel bakehouse workshop carpenter engineering physics chemistry biology geology astronomy mathematics statistics
language grammar dictionary translation law court parliament ministry embassy police firebrigade charity foundation society institute academy college nursery teacher
student parents children family health nurse dentist pharmacology nutrition energy water forest river mountain island coast birds horses dogs wildlife climate""".split()
AROUND = ["best", "online", "club", "zone", "world", "central", "direct", "my", "top", "24", "hub", "portal"]
HOSTS = ["{a}-{w}.{t}", "www.{w}{a}.{t}", "{w}-{a}.{t}", "{w}.{a}.{t}"]
PATHS = ["/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}", "/", "/index.html", "/{n}/page", "/archive/{n}"]
TOPS = ["com", "net", "org", "info", "co.uk", "de", "fr", "io"]
#: Rows that are made of each word.
EACH = 6
LABELLED_ROWS = EACH * (len(UNWANTED) + len(PLAIN)) + 60


def labelled() -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): LABELLED_ROWS rows. Both kinds of words get the same companions, forms, top-level domains and paths."""
    rows = []
    for words, label in ((UNWANTED, 1), (PLAIN, 0)):
        for i, word in enumerate(words):
            for k in range(EACH):
                n = EACH * i + k
                host = HOSTS[n % len(HOSTS)].format(w=word, a=AROUND[(5 * n + i) % len(AROUND)], t=TOPS[(3 * n + i) % len(TOPS)])
                rows.append((host, PATHS[(n + i) % len(PATHS)].format(n=100 + 37 * n % 9_000), label))
    return [*rows, *[("", "", 0)] * 60]  # a page without a URL gives no reason to block


def grams(text: str, salt: int) -> list[int]:
    """The slots of text's n-grams; host and path differ by salt."""
    return [(ord(text[i]) * 961 + ord(text[i + 1]) * 31 + ord(text[i + 2]) + salt) % SIZE for i in range(len(text) - WIDTH + 1)]


@lru_cache(maxsize=2)
def model(steps: int = 1_500, rate: float = 16.0, decay: float = 3e-5) -> tuple[tuple[float, ...], float]:
    """Weights and intercept by gradient descent on the labelled table; a gram's value is its share of the URL's grams. Both kinds of rows weigh the same
    together. Deterministic."""
    rows = [(grams(host, 0) + grams(path, 500), label) for host, path, label in labelled()]
    label = np.array([y for _, y in rows], float)
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())
    slot, of = np.array([s for slots, _ in rows for s in slots]), np.array([k for k, (slots, _) in enumerate(rows) for _ in slots])
    share = 4.0 / np.maximum(1, np.bincount(of, minlength=len(rows)))
    weights, intercept = np.zeros(SIZE), 0.0
    for _ in range(steps):
        score = intercept + share * np.bincount(of, weights[slot], minlength=len(rows))
        error = weight * (1 / (1 + np.exp(-score)) - label)
        weights -= rate * (decay * weights + np.bincount(slot, (error * share)[of], minlength=SIZE))
        intercept -= rate / 16 * error.sum()
    return tuple(round(float(w), 6) for w in weights), round(float(intercept), 6)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def _slots(text: Column, salt: int) -> Column:
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c))
    pair = F.zip_with(codes, F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))), lambda a, b: a * 31 + b)
    triple = F.zip_with(pair, F.slice(codes, 3, F.greatest(F.size(codes) - 2, F.lit(0))), lambda a, b: (a * 31 + b + salt) % SIZE)
    return F.filter(triple, lambda s: s.isNotNull())


def score_of(host: Column, path: Column) -> Column:
    """The model's log-odds that a URL is unwanted."""
    weights, intercept = model()
    table = F.lit(list(weights))
    slots = F.concat(_slots(host, 0), _slots(path, 500))
    total = F.aggregate(slots, F.lit(0.0), lambda s, x: s + F.element_at(table, x + 1))
    return F.lit(intercept) + F.lit(4.0) * total / F.greatest(F.lit(1), F.size(slots))


def judged(df: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """key, host, path, rule (null if none fits), verdict (the rule's, else block from even odds) and the score."""
    parts = df.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("_rule", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    parts = parts.withColumn("score", score_of(F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0, "block").otherwise("allow"))
    return parts.select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def sql() -> str:
    """The same in DuckDB SQL over pages."""
    weights, intercept = model()
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'v': '{v}', 'r': '{h}{p}'}}"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    slot = "(ord({t}[i:i]) * 961 + ord({t}[i+1:i+1]) * 31 + ord({t}[i+2:i+2]) + {s}) % " + str(SIZE)
    slots = lambda t, s: f"list_transform(generate_series(1, greatest(0, length({t}) - 2)), lambda i: {slot.format(t=t, s=s)})"
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), scored AS (
  SELECT *, CASE {cases} END AS found,
         list_concat({slots("host", 0)}, {slots("path", 500)}) AS slots
  FROM parts
)
SELECT page_id, host, path, found.r AS rule,
       coalesce(found.v, CASE WHEN {intercept} + 4.0 * coalesce(list_sum(list_transform(slots, lambda s: ([{", ".join(map(str, weights))}]::DOUBLE[])[s + 1])), 0)
                                   / greatest(1, len(slots)) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM scored"""
