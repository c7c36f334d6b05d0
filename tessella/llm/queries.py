"""The operators' queries over whole tables, with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, collocations, decontamination, importance, licenses, line_dedup, ngram_join, pii, quality, secret_scan, suffix_dedup, training_order, urls
from tessella.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """(path, pattern) of the public rank file; a parameter of the operator, read where the tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.report(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("failed_rule")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), *vocabulary())


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_training_order, op2_pii, op3_secrets, op4_quality, op5_line_dedup, op6_ngram_join, op7_bpe, op8_licenses, op9_urls, op10_decontamination, op11_importance, op12_suffix_dedup, op13_collocations, pipeline,
    ]
    return {f.__name__: f for f in named}


QUALITY_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM docs)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))
          - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')))))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM docs LEFT JOIN covered USING (rid)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars > 16 * n_words OR word_chars < 2 * n_words
            OR 2 * n_dup_lines > len(string_split(t, chr(10)))
            OR (length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 40
                AND 10 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 7 * length(regexp_replace(t, '[^\p{L}]', '', 'g')))) AS kept
FROM b"""

LINES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT rid, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rid, doc_id, ls, unnest(generate_series(1, len(ls))) AS i FROM docs)
), often AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT rid) >= 5),
judged AS (SELECT rid, doc_id, i, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN often USING (k))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid"""


COLLOCATIONS_SQL = r"""
WITH docs AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece FROM documents
), pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS w FROM docs),
runs AS (
  SELECT lang, k, u.phrase AS phrase, u.w1 AS w1, u.w2 AS w2, u.w3 AS w3 FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: {'phrase': array_to_string(w[i:i+k-1], ' '), 'w1': w[i], 'w2': w[i+1], 'w3': w[i+2]})) AS u
    FROM pieces, (VALUES (1), (2), (3)) AS ks(k) WHERE len(w) >= k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, lang || chr(1) || k || chr(1) || phrase AS key, any_value(w1) AS w1, any_value(w2) AS w2, any_value(w3) AS w3, count(*) AS a FROM runs GROUP BY lang, k, phrase
), cut AS (
  SELECT lang, k, phrase, a, 1 AS c, '1' || chr(1) || w1 AS p, CASE WHEN k = 2 THEN '1' || chr(1) || w2 ELSE '2' || chr(1) || w2 || ' ' || w3 END AS q FROM f WHERE k > 1 AND a >= 10
  UNION ALL SELECT lang, k, phrase, a, 2, '2' || chr(1) || w1 || ' ' || w2, '1' || chr(1) || w3 FROM f WHERE k = 3 AND a >= 10
), lefts AS MATERIALIZED (SELECT cut.*, f.a AS l FROM cut JOIN f ON f.key = cut.lang || chr(1) || p
), s AS (
  SELECT x.lang, x.k, x.phrase, x.a, c, l, f.a AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l::HUGEINT * f.a) AS BIGINT) AS score FROM lefts AS x JOIN f ON f.key = x.lang || chr(1) || q
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS most FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f WHERE k = 3 AND a >= 10 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f WHERE k = 3 AND a >= 10) GROUP BY 1, 2
), kept AS (SELECT best.* FROM best LEFT JOIN inside ON k = 2 AND inside.lang = best.lang AND inside.phrase = best.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang) QUALIFY rank <= 2000"""


#: Every 200-byte string of every text, counted by its 64-bit hash; bytes as pairs of hex digits.
REPEATS_SQL = r"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT rid, pos, hash(substr(h, 2 * pos + 1, 400)) AS k FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS pos FROM docs)),
often AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY k) AS n FROM wins) WHERE n > 1),
begun AS (SELECT rid, pos, coalesce((pos > lag(pos) OVER (PARTITION BY rid ORDER BY pos) + 200)::INT, 1) AS fresh FROM often),
spans AS (SELECT rid, min(pos) AS a, max(pos) + 200 AS z FROM (SELECT rid, pos, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS nth FROM begun) GROUP BY rid, nth),
gaps AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS low FROM spans),
kept AS (SELECT rid, count(*) AS n, sum(z - a)::BIGINT AS gone, max(z) AS top, string_agg(substr(h, 2 * low + 1, 2 * (a - low)), '' ORDER BY a) AS k FROM gaps JOIN docs USING (rid) GROUP BY rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(top, 0) + 1))) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""

#: The crc32 of each feature by a walk over its bytes and the table of the polynomial's remainders; all features of a step go on together.
IMPORTANCE_SQL = r"""
WITH RECURSIVE src AS (
  SELECT 0 AS side, doc_id AS id, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark
), ws AS MATERIALIZED (
  SELECT side, id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM src
), feats AS MATERIALIZED (SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS f FROM ws),
tab AS MATERIALIZED (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS r(i)
), walk AS (
  SELECT f, hex(encode(f)) AS h, 1 AS pos, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM feats)
  UNION ALL SELECT f, h, pos + 2, xor(c >> 8, t) FROM walk JOIN tab ON tab.i = xor(c & 255, ('0x' || substr(h, pos, 2))::BIGINT) WHERE pos < length(h)
), crc AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS b FROM walk WHERE pos > length(h)),
counts AS (SELECT side, b, count(*) AS n FROM feats JOIN crc USING (f) GROUP BY 1, 2),
gains AS (
  SELECT bs.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM counts WHERE side = 0) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM counts WHERE side = 1) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS bs(b) LEFT JOIN counts s ON s.b = bs.b AND s.side = 0 LEFT JOIN counts t ON t.b = bs.b AND t.side = 1
), sums AS (SELECT rid, count(*) AS n, sum(gain) AS g FROM feats JOIN crc USING (f) JOIN gains USING (b) WHERE side = 0 GROUP BY 1),
docs AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, CAST(coalesce(floor(g / n), 0) AS BIGINT) AS weight, ('0x' || sha256('7:' || coalesce(id::VARCHAR, ''))[1:8])::BIGINT AS h
  FROM ws LEFT JOIN sums USING (rid) WHERE side = 0
), scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM docs),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND k <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN k END AS rank FROM placed"""


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": QUALITY_SQL, "op5_line_dedup": LINES_SQL, "op9_urls": urls.sql(), "op11_importance": IMPORTANCE_SQL, "op12_suffix_dedup": REPEATS_SQL, "op13_collocations": COLLOCATIONS_SQL}
