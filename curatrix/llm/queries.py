"""The registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, lines, minhash, mixing, neighbours, pieces, pii, quality, secrets, store, toxicity
from .common import documents


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(documents(spark, sf_dir)))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.rules(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "store")
    store.write(documents(spark, sf_dir), path)
    store.verify(spark, path)
    return store.read(spark, path)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(documents(spark, sf_dir), documents(spark, sf_dir, "labels")).drop("passages")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.spans(documents(spark, sf_dir)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(documents(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_rules": op3_quality_rules,
    "op4_token_store": op4_token_store,
    "op5_pieces": op5_pieces,
    "op6_lines": op6_lines,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_neighbours": op10_neighbours,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

OP3_SQL = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws, row_number() OVER () AS r FROM documents
), tri AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM w
), m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (r) LEFT JOIN cov USING (r)
), f AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEATED} * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS k FROM f GROUP BY source
), p AS (
  SELECT count(*) AS hosts, sum(k) / sum(n) AS common, avg(k / n) AS mean,
         coalesce(var_samp(k / n), 0) - avg(k / n) * (1 - avg(k / n)) * avg(1.0::DOUBLE / n) AS between_ FROM h
), s AS (
  SELECT CASE WHEN hosts > 1 AND between_ > 1e-12 AND mean > 0 AND mean < 1 THEN mean ELSE common END AS rate,
         CASE WHEN hosts > 1 AND between_ > 1e-12 AND mean > 0 AND mean < 1
              THEN greatest(mean * (1 - mean) / between_ - 1, 1.0) ELSE {quality.WEAK} END AS strength FROM p
), v AS (
  SELECT source, (k + rate * strength) / (n + strength) <= {quality.MAX_RATE} AS ok FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * n / w AS r, row_number() OVER (ORDER BY 2.0::DOUBLE * n / w, source) AS k FROM s
), c AS (
  SELECT k, r, 1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE - coalesce(sum(2 * n) OVER b, 0)::DOUBLE AS room,
         (SELECT sum(w) FROM s)::DOUBLE - coalesce(sum(w) OVER b, 0)::DOUBLE AS weight
  FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT room, weight FROM c WHERE room / weight <= r ORDER BY k LIMIT 1),
t AS (SELECT source, n, least(2.0::DOUBLE * n, l.room * w / l.weight) AS target FROM o, l),
x AS (
  SELECT doc_id, size, n AS source_size, target, CASE WHEN n > 0 THEN target / n ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken FROM x
"""

SQL: dict[str, str] = {"op3_quality_rules": OP3_SQL, "op9_mixing": OP9_SQL}
