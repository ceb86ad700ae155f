"""The queries of this package's operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, language, licenses, mixing, quality, simhash, surrogates, tokens, toxicity, warc
from palimpsest.llm.common import documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenise(documents(spark, sf_dir), tokens.default_tokenizer())


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_all(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.evaluate(documents(spark, sf_dir)).drop("kept_chars")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_licenses": op2_licenses,
    "op3_language": op3_language,
    "op4_simhash": op4_simhash,
    "op5_tokens": op5_tokens,
    "op6_surrogates": op6_surrogates,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontaminate": op9_decontaminate,
    "op10_mixing": op10_mixing,
}

OP9_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
         FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT m FROM iwin),
dwin AS (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS win FROM dw, lens, unnest(range(1, len(w) - m + 2)) AS t(i)),
occ AS (SELECT d.rid, d.i, d.m, b.item_id FROM dwin d JOIN iwin b ON d.win = b.win AND d.m = b.m),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

OP1_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM r
"""

OP7_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
lines AS (SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS own FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)),
l AS (SELECT rid, sum(own) AS kept_all, count(*) - count(DISTINCT line) AS n_dup_lines,
      sum(CASE WHEN NOT regexp_matches(line, $ENDS$) OR regexp_matches(line, '!!') OR 10 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > own
               OR length(line) - length(regexp_replace(line, '[|»›]', '', 'g')) >= 3 OR regexp_matches(lower(line), $MENU$) OR regexp_matches(lower(line), $BOIL$) THEN 0 ELSE own END) AS kept_chars
      FROM lines WHERE own > 0 GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(kept_all, 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * kept_chars >= 60 * word_chars AS kept FROM b
""".replace("$ENDS$", "'" + quality.ENDS.replace("'", "''") + "'")
    .replace("$MENU$", "'" + quality.MENU + "'")
    .replace("$BOIL$", "'" + quality.BOILERPLATE + "'")
)

SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op2_licenses": licenses.sql(), "op7_quality": OP7_SQL, "op9_decontaminate": OP9_SQL}
