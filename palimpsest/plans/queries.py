"""Registered queries of the engine, each over its whole table, and the SQL for the same rows. Names begin with the operator's number in the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import numbers as N
from palimpsest.functions import text as X
from palimpsest.functions import validators as V
from palimpsest.operators import anonymize as A
from palimpsest.operators import context as C
from palimpsest.operators import evaluate as E
from palimpsest.operators import model as M
from palimpsest.operators import recognize as R
from palimpsest.operators import statistics as S
from palimpsest.operators import structured as ST
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.plans import profiles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
EMAIL_SQL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IPV4_SQL = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
SALT = b"0123456789abcdef"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_sql(pattern: str, source: str = "documents", key: str = "doc_id", where: str = "true") -> str:
    """Relations p (key, text, matches, gaps) and s (key, text, i, value, byte_start, byte_end)."""
    quoted = pattern.replace("'", "''")
    return f"""p AS (SELECT {key}, text, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM {source}),
s AS (SELECT * FROM (SELECT *, (byte_start + strlen(value))::BIGINT AS byte_end FROM (SELECT {key}, text, i, m[i] AS value, g[i] AS before, g[i + 1] AS after,
  (list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: strlen(x))), 0))::BIGINT AS byte_start
  FROM p, unnest(range(1, len(m) + 1)) AS u(i))) WHERE {where})"""


def detected(spark: SparkSession, sf_dir: str, spans: Column, source: str = "documents", key: str = "doc_id") -> DataFrame:
    docs = table(spark, sf_dir, source).select(key, "text").withColumn("spans", spans)
    return docs.select(key, "text", F.explode("spans").alias("s")).select(key, "text", "s.entity", F.col("s.byte_start").cast("long").alias("byte_start"), F.col("s.byte_end").cast("long").alias("byte_end"), F.col("s.text").alias("value"), "s.pattern", "s.score")


def emails() -> Column:
    return R.all_spans(F.col("text"), R.BASE["email"])


def with_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", emails())


# --- recognizers -----------------------------------------------------------------------------------------------------


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, byte_start, byte_end, value FROM s")
def r01_email_spans(spark, sf_dir):
    return detected(spark, sf_dir, emails()).select("doc_id", "byte_start", "byte_end", "value")


@query(f"WITH {spans_sql(chr(92) + '([0-9]{3}' + chr(92) + ')[ .-][0-9]{3}[ .-][0-9]{4}', where='NOT regexp_matches(right(before, 1), $$[0-9]$$) AND NOT regexp_matches(left(after, 1), $$[0-9]$$) AND value[2:4] <> $$000$$ AND value[7:9] <> $$000$$')} SELECT doc_id, byte_start, byte_end, value FROM s")
def r02_us_parens_phone_spans(spark, sf_dir):
    return detected(spark, sf_dir, R.phone(F.col("text"), "regex_only")).filter("pattern = 'us_parens'").select("doc_id", "byte_start", "byte_end", "value")


@query(f"WITH {spans_sql(IPV4_SQL, where='NOT regexp_matches(right(before, 1), $$[0-9.]$$) AND NOT regexp_matches(left(after, 1), $$[0-9.]$$) AND len(list_filter(string_split(value, $$.$$), lambda o: o::INT > 255)) = 0')} SELECT doc_id, byte_start, byte_end, value FROM s")
def r06_ipv4_spans(spark, sf_dir):
    return detected(spark, sf_dir, R.all_spans(F.col("text"), R.BASE["ip_address"])).filter("pattern = 'ipv4'").select("doc_id", "byte_start", "byte_end", "value")


_URL_SQL = r"https?://[A-Za-z0-9.-]+(?:[/?#][^\s]*)?"


@query(f"WITH pages_text AS (SELECT page_id, url AS text FROM pages), {spans_sql(_URL_SQL, 'pages_text', 'page_id')} SELECT page_id, byte_start, byte_end, value FROM (SELECT page_id, byte_start, regexp_replace(value, $$[)]+$$ || '$', '') AS value FROM s) x, LATERAL (SELECT byte_start + strlen(value) AS byte_end)")
def r07_url_spans(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")).withColumn("spans", R.url(F.col("text"), "regex_only", ("url",)))
    return pages.select("page_id", F.explode("spans").alias("s")).select("page_id", F.col("s.byte_start").cast("long").alias("byte_start"), F.col("s.byte_end").cast("long").alias("byte_end"), F.col("s.text").alias("value"))


@query("SELECT page_id, regexp_extract(url, '^https?://([A-Za-z0-9.-]+)', 1) AS value FROM pages")
def r08_domain_of_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([A-Za-z0-9.-]+)", 1).alias("text"))
    return pages.select("page_id", F.explode(R.domain(F.col("text"))).alias("s")).select("page_id", F.col("s.text").alias("value"))


@query(f"WITH {spans_sql('[0-9a-f]{40}')} SELECT doc_id, byte_start, byte_end, value FROM s")
def r14_pattern_definition(spark, sf_dir):
    rule = {"name": "secrets", "entity": "secret", "patterns": [{"name": "hex40", "regex": "[0-9a-f]{40}", "score": 0.6}]}
    return detected(spark, sf_dir, R.pattern_definition(F.col("text"), rule)).select("doc_id", "byte_start", "byte_end", "value")


@query(f"WITH {spans_sql('worthless|trash')} SELECT doc_id, byte_start, byte_end, value FROM s")
def r16_deny_list(spark, sf_dir):
    return detected(spark, sf_dir, R.deny_list(F.col("text"), [{"entity": "insult", "values": ["worthless", "trash"]}])).select("doc_id", "byte_start", "byte_end", "value")


@query("SELECT doc_id, strlen(regexp_extract(text, '^[A-Za-z]+'))::BIGINT AS byte_end FROM documents WHERE regexp_matches(text, '^[A-Za-z]+')")
def r17_custom_recognizer(spark, sf_dir):
    import re

    first = R.CustomRecognizer("first_word", ("word",), lambda texts: [[("word", 0, m.end(), 0.5)] if (m := re.match("[A-Za-z]+", t)) else [] for t in texts])
    return detected(spark, sf_dir, first.spans(F.col("text"))).select("doc_id", "byte_end")


# --- predicates, units, validators -------------------------------------------------------------------------------------


@query("SELECT doc_id, text IS NOT NULL AS valid, coalesce(strlen(text), 0)::BIGINT AS bytes, coalesce(length(text), 0)::BIGINT AS chars FROM documents")
def p01_utf8(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.is_valid_utf8("text"), F.lit(False)).alias("valid"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, value FROM s WHERE NOT regexp_matches(value, '@mail[1-4][.]')")
def p05_allow_list(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = analyze(d, Options(entities=("email",), allow_list=[{"entity": "email", "patterns": ["@mail[1-4][.]"]}, {"entity": "phone", "values": ["x"]}]))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.text").alias("value"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, byte_start, (length(text) - length(regexp_replace(text, '^.*' || chr(0), ''))) * 0 + length(array_to_string(list_transform(range(1, i + 1), lambda k: p2.g[k]), '')) + coalesce(length(array_to_string(list_transform(range(1, i), lambda k: p2.m[k]), '')), 0) AS char_start FROM s JOIN (SELECT doc_id, m, g FROM p) p2 USING (doc_id)")
def p14_byte_to_char(spark, sf_dir):
    return detected(spark, sf_dir, emails()).select("doc_id", "byte_start", X.byte_to_char(F.col("text"), F.col("byte_start")).cast("long").alias("char_start"))


@query("SELECT doc_id, strlen(left(text, length(text) // 2))::BIGINT AS half, CASE WHEN length(text) >= 100 THEN strlen(left(text, 100)) END::BIGINT AS byte_at FROM documents")
def p15_char_to_byte(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.col("text")
    return d.select("doc_id", X.char_to_byte(text, F.floor(F.length(text) / 2).cast("int")).cast("long").alias("half"), X.char_to_byte(text, F.lit(100)).cast("long").alias("byte_at"))


@query("SELECT CASE WHEN lang IN ('en', 'es', 'fr', 'de', 'pt', 'it', 'unknown') THEN lang END AS language, count(*) AS n FROM documents GROUP BY 1")
def p17_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


_GATE_SQL = " ".join("WHEN regexp_matches(text, '" + p.replace("'", "''") + f"') THEN '{reason}'" for p, reason in ((M.STRONG_LOCATION, "location_context"), (M.COMMA_CAPITALIZED, "comma_capitalized_phrase"), (M.STREET_NUMBER, "street_number")))


@query(f"SELECT CASE {_GATE_SQL} ELSE 'no_location_signal' END AS reason, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY 1")
def p19_location_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(M.location_gate(F.col("text")).alias("reason")).agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT page_id, len(list_filter(string_split(h, '.'), lambda x: x = '' OR strlen(x) > 63 OR starts_with(x, '-') OR ends_with(x, '-'))) = 0 AND len(string_split(h, '.')) >= 2 AND regexp_full_match(string_split(h, '.')[-1], '[A-Za-z]{2,63}') AS valid FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages)")
def f03_domain_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", V.domain_labels(F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("valid"))


_TOKEN_SQL = r"[\p{L}\p{N}_]+(?:[''-][\p{L}\p{N}_]+)*"
_STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(list_filter(n, lambda x: x <> '' AND x NOT IN ({_STOP_SQL}))))::BIGINT AS n_keywords, md5(array_to_string(list_sort(list_distinct(list_filter(n, lambda x: x <> '' AND x NOT IN ({_STOP_SQL})))), ' ')) AS keywords FROM (SELECT doc_id, t, list_transform(t, lambda x: trim(lower(x), '_')) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{_TOKEN_SQL}') AS t FROM documents))")
def f05_tokens_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.token_norms(F.col("text")).alias("n"))
    return d.select("doc_id", F.size("n").cast("long").alias("n_tokens"), F.size(X.keywords(F.col("n"))).cast("long").alias("n_keywords"), F.md5(F.array_join(F.array_sort(X.keywords(F.col("n"))), " ")).alias("keywords"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT left(regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 32) AS shape, count(*) AS n FROM s GROUP BY 1")
def f08_token_shapes(spark, sf_dir):
    return detected(spark, sf_dir, emails()).groupBy(X.token_shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(CASE WHEN greatest(b, d) - least(a, c) = 0 THEN 0 ELSE greatest(0, least(b, d) - greatest(a, c)) / (greatest(b, d) - least(a, c))::DOUBLE END, 6) AS overlap FROM (SELECT l_orderkey, l_linenumber, l_extendedprice, l_linenumber::INT AS a, (l_linenumber + l_quantity)::INT AS b, floor(l_quantity / 2)::INT AS c, floor(l_quantity / 2)::INT + 10 AS d FROM lineitem)")
def f10_iou(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice", "int(l_linenumber) AS a", "int(l_linenumber + l_quantity) AS b", "int(floor(l_quantity / 2)) AS c", "int(floor(l_quantity / 2)) + 10 AS d")
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(N.iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("overlap"))


@query("SELECT event_id, round(greatest(value, 1.0) + ln(exp(value - greatest(value, 1.0)) + exp(1.0 - greatest(value, 1.0))), 6) AS lae, round(1 / (1 + exp(-value / 100)), 6) AS sig FROM events WHERE value IS NOT NULL")
def f12_log_functions(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").filter(v.isNotNull()).select("event_id", F.round(N.log_add_exp(v, F.lit(1.0)), 6).alias("lae"), F.round(N.sigmoid(v / 100), 6).alias("sig"))


@query("SELECT lang, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS fingerprint FROM documents GROUP BY lang")
def f14_output_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(N.rows_fingerprint(F.col("doc_id").cast("string")).alias("fingerprint"))


# --- context ---------------------------------------------------------------------------------------------------------


@query(f"WITH {spans_sql(IPV4_SQL, where='NOT regexp_matches(right(before, 1), $$[0-9.]$$) AND NOT regexp_matches(left(after, 1), $$[0-9.]$$)')}, t AS (SELECT doc_id, byte_start, regexp_extract_all(text[1:0] || decode(encode(text)[1:byte_start]), '{_TOKEN_SQL}') AS a, regexp_extract_all(decode(encode(text)[byte_end + 1:]), '{_TOKEN_SQL}') AS b FROM s) SELECT doc_id, byte_start, array_to_string(list_transform(list_concat(a[-5:], b[1:5]), lambda x: trim(lower(x), '_')), ' ') AS terms FROM t")
def c02_neighbour_terms(spark, sf_dir):
    found = detected(spark, sf_dir, R.all_spans(F.col("text"), [R.Rule("ip", "ip", "ip", R.IPV4, 0.5)]))
    return found.select("doc_id", "byte_start", F.array_join(C.surrounding_terms(X.tokens(F.col("text")), F.col("byte_start"), F.col("byte_end")), " ").alias("terms"))


# --- conflicts -------------------------------------------------------------------------------------------------------


_WORD_SQL = "[A-Z][a-z]+"


@query(f"WITH {spans_sql(_WORD_SQL)}, b AS (SELECT *, coalesce(CASE WHEN regexp_full_match(before, '[ \\n]*') AND i > 1 THEN 0 ELSE 1 END, 1) AS brk FROM s), c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b) SELECT doc_id, count(*) AS merged, sum(n)::BIGINT AS words, sum(e - st)::BIGINT AS bytes FROM (SELECT doc_id, g, count(*) AS n, min(byte_start) AS st, max(byte_end) AS e FROM c GROUP BY doc_id, g) GROUP BY doc_id")
def j10_merge_whitespace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", R.all_spans(F.col("text"), [R.Rule("word", "word", "word", _WORD_SQL, 0.5, trim=False)]))
    d = d.withColumn("n", F.size("spans")).filter("n > 0").withColumn("merged", A.merge_whitespace(F.col("text"), F.col("spans")))
    return d.select("doc_id", F.size("merged").cast("long").alias("merged"), F.col("n").cast("long").alias("words"), F.aggregate("merged", F.lit(0).cast("long"), lambda a, s: a + s["byte_end"] - s["byte_start"]).alias("bytes"))


# --- rewriting -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '[EMAIL]', 'g') AS anonymized, len(regexp_extract_all(text, '{EMAIL_SQL}'))::BIGINT AS n FROM documents")
def o13_redact_email(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return A.redact(d, Options(entities=("email",))).select("doc_id", "anonymized", F.size("items").cast("long").alias("n"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, entity, source_byte_start, replacement FROM (SELECT doc_id, 'email' AS entity, byte_start::INT AS source_byte_start, '' AS replacement FROM s)")
def o04_redact_items(spark, sf_dir):
    done = A.anonymize(with_emails(spark, sf_dir), A.Operators({"email": {"type": "redact"}}))
    return A.exploded(done, "doc_id").select("doc_id", "i.entity", "i.source_byte_start", "i.replacement")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, value, repeat('*', greatest(length(value) - 4, 0)) || right(value, 4) AS masked FROM s")
def o05_mask_email(spark, sf_dir):
    return detected(spark, sf_dir, emails()).select("doc_id", "value", A.mask(F.col("value"), "*", 4).alias("masked"))


_HASH_SQL = f"'$palimpsest$v1$hash$sha256$deterministic$' || rtrim(translate(to_base64('{SALT.decode()}'::BLOB), '+/', '-_'), '=') || '$' || sha256('{SALT.decode()}' || value)"


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, {_HASH_SQL} AS hashed FROM s")
def o06_hash_email(spark, sf_dir):
    return detected(spark, sf_dir, emails()).select("doc_id", A.hash_value(F.col("value"), salt=SALT).alias("hashed"))


@query(f"WITH {spans_sql(EMAIL_SQL)}, h AS (SELECT doc_id, value, {_HASH_SQL} AS h FROM s), o AS (SELECT doc_id, value, h, lead(value, 1, value) OVER (PARTITION BY doc_id ORDER BY value) AS other FROM h) SELECT doc_id, h AS hashed, true AS own, value = other AS next FROM o")
def o07_verify_hash(spark, sf_dir):
    """Each value against its own hash, and against that of the next one in the document."""
    rows = detected(spark, sf_dir, emails()).select("doc_id", "value").withColumn("h", A.hash_value(F.col("value"), salt=SALT))
    other = F.lead("value").over(Window.partitionBy("doc_id").orderBy("value"))
    rows = rows.withColumn("other", F.coalesce(other, F.col("value")))
    return rows.select("doc_id", F.col("h").alias("hashed"), A.verify_hash(F.col("value"), F.col("h")).alias("own"), A.verify_hash(F.col("other"), F.col("h")).alias("next"))


@query(f"SELECT doc_id, regexp_replace(text, '{EMAIL_SQL}', '<e>', 'g') AS anonymized FROM documents")
def o09_custom_operator(spark, sf_dir):
    return A.anonymize_custom(with_emails(spark, sf_dir), lambda value, entity, options: "<e>")


# --- vault, structured data, conversations -----------------------------------------------------------------------------

_VAULT_SQL = f"{spans_sql(EMAIL_SQL)}, f AS (SELECT value, min((doc_id, byte_start)) AS first FROM s GROUP BY value), k AS (SELECT 'email' AS entity, value, row_number() OVER (ORDER BY first) AS counter FROM f)"


@query(f"WITH {_VAULT_SQL} SELECT entity, value, counter, '<<EMAIL_' || CASE WHEN counter < 1000 THEN lpad(counter::VARCHAR, 3, '0') ELSE counter::VARCHAR END || '>>' AS token FROM k")
def k01_email_tokens(spark, sf_dir):
    return K.pseudonymize(with_emails(spark, sf_dir))[1].select("entity", "value", "counter", "token")


@query(f"WITH {_VAULT_SQL} SELECT 'table' AS backend, count(*) AS size FROM k")
def k04_vault_info(spark, sf_dir):
    return K.info(K.pseudonymize(with_emails(spark, sf_dir))[1])


@query("SELECT doc_id, md5(text) AS restored, length(text)::BIGINT AS n FROM documents")
def k08_rehydrate_roundtrip(spark, sf_dir):
    docs, vault = K.pseudonymize(with_emails(spark, sf_dir))
    return K.rehydrate(docs.drop("text"), vault, text="anonymized").select("doc_id", F.md5("restored").alias("restored"), F.length("restored").cast("long").alias("n"))


@query(f"WITH c AS (SELECT *, conv_id * 1000 + turn AS id FROM conversations), u AS (SELECT id, conv_id, turn, text FROM c WHERE role = 'user'), {spans_sql(EMAIL_SQL, 'u', 'id')}, w AS (SELECT s.*, conv_id, turn FROM s JOIN u USING (id)), f AS (SELECT conv_id, value, min((turn, byte_start)) AS first FROM w GROUP BY 1, 2), k AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM f) SELECT conv_id, turn, role, coalesce(length(text), 0)::BIGINT + coalesce((SELECT sum(11 + 2 - length(w.value)) FROM w WHERE w.id = c.id), 0)::BIGINT AS n_chars FROM c")
def l01_redact_user_turns(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    out, _ = ST.redact_messages(messages, options=Options(entities=("email",)))
    return out.select("conv_id", "turn", "role", F.coalesce(F.length("anonymized"), F.lit(0)).cast("long").alias("n_chars"))


@query("SELECT conv_id, turn, md5(text) AS restored FROM conversations")
def l02_rehydrate_messages(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations")
    out, vault = ST.redact_messages(messages, options=Options(entities=("email", "ip_address")))
    return ST.rehydrate_messages(out.drop("text"), vault, text="anonymized").select("conv_id", "turn", F.md5("restored").alias("restored"))


@query("SELECT c_custkey, '[REDACTED]' AS c_name, 'x' AS c_mktsegment, c_acctbal FROM customer")
def st2_field_policies(spark, sf_dir):
    policies = {"c_nationkey": "drop", "c_name": ("operator", {"type": "replace", "value": "[REDACTED]"}), "c_mktsegment": ("replace", "x"), "c_acctbal": "keep"}
    return ST.redact_columns(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"), policies)


@query("SELECT count(*) AS events, count(*) FILTER (WHERE props IS NOT NULL) AS with_props FROM events")
def st1_walk_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = ST.leaves(e, "props", "event_id").select("event_id").distinct()
    return e.join(n.withColumn("w", F.lit(1)), "event_id", "left").agg(F.count("*").alias("events"), F.count("w").alias("with_props"))


# --- evaluation ------------------------------------------------------------------------------------------------------


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def a07_confusion(spark, sf_dir):
    return E.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT 'email' AS entity, 'fp' AS kind, CASE WHEN length(value) <= 4 THEN '1-4' WHEN length(value) <= 8 THEN '5-8' WHEN length(value) <= 16 THEN '9-16' WHEN length(value) <= 32 THEN '17-32' ELSE '33+' END AS length, left(regexp_replace(regexp_replace(value, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g'), 32) AS shape, count(*) AS n FROM s GROUP BY ALL ORDER BY n DESC, length, shape LIMIT 10")
def a08_top_signatures(spark, sf_dir):
    return E.top_signatures(detected(spark, sf_dir, emails()).select("entity", F.lit("fp").alias("kind"), "value"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT 'email' AS entity, count(*) AS n, true AS supported FROM s HAVING count(*) > 0")
def a09_frequencies(spark, sf_dir):
    return E.frequencies(detected(spark, sf_dir, emails()), profiles.BASE_ENTITIES)


@query("WITH i AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, CASE WHEN r <= greatest(1, least(floor(n * 0.7), n - 1)) THEN 'train' ELSE 'held_out' END AS split FROM part JOIN i USING (p_brand)")
def a21_template_split(spark, sf_dir):
    return E.template_split(table(spark, sf_dir, "part"), 0.7, "p_brand").select("p_partkey", "split")


@query("SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INT AS turn FROM nation")
def a22_interleave(spark, sf_dir):
    return E.interleave(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey").select("n_regionkey", "n_nationkey", "turn")


# --- statistics ------------------------------------------------------------------------------------------------------

_EVENTS = "events WHERE value IS NOT NULL"


@query(f"SELECT event_type, max(CASE WHEN i = ceil((n - 1) * 0.5) THEN value END) AS p50, max(CASE WHEN i = ceil((n - 1) * 0.95) THEN value END) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM {_EVENTS}) GROUP BY 1")
def a10_percentile_by_index(spark, sf_dir):
    return S.percentile_by_index(table(spark, sf_dir, "events"), "value", [0.5, 0.95], "event_type")


@query(f"SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM {_EVENTS} GROUP BY 1")
def a11_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("value is not null").groupBy("event_type").agg(*[S.nearest_rank("value", p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])


_BUCKET_SQL = "CASE WHEN v <= 1000 THEN ceil(greatest(v, 1) / 10) * 10 WHEN v <= 10000 THEN ceil(v / 50) * 50 WHEN v <= 100000 THEN ceil(v / 500) * 500 WHEN v <= 1000000 THEN ceil(v / 5000) * 5000 ELSE ceil(v / 50000) * 50000 END::BIGINT"


@query(f"SELECT {_BUCKET_SQL} AS bucket, count(*) AS n FROM (SELECT value * 1000 AS v FROM {_EVENTS}) GROUP BY 1")
def a12_histogram(spark, sf_dir):
    return S.histogram(table(spark, sf_dir, "events").filter("value is not null").withColumn("us", F.col("value") * 1000), "us")


@query(f"SELECT {_BUCKET_SQL} AS bucket, count(*)::BIGINT AS n FROM (SELECT value * 1000 AS v FROM {_EVENTS}) GROUP BY 1")
def a13_merge_histograms(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("us", F.col("value") * 1000)
    return S.merge_histograms(S.histogram(e, "us", "event_type"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def a15_pearson(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(S.pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def a16_regression(spark, sf_dir):
    slope, intercept, r2 = S.regression("l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 4).alias("slope"), F.round(intercept, 4).alias("intercept"), F.round(r2, 6).alias("r2"))


@query(f"SELECT event_type, round(avg(value) FILTER (WHERE r > greatest(1, n // 2)) / avg(value) FILTER (WHERE r <= greatest(1, n // 2)), 6) AS drift FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM {_EVENTS}) GROUP BY 1")
def a18_drift(spark, sf_dir):
    return S.drift(table(spark, sf_dir, "events").filter("value is not null"), "value", "event_id", "event_type").select("event_type", F.round("drift", 6).alias("drift"))


@query("WITH b AS (SELECT event_type, min(epoch_us(ts)) // 1000000 AS s FROM events GROUP BY 1) SELECT event_type, ((epoch_us(ts) // 1000000 - s) // 3600)::BIGINT AS \"window\", count(*) AS n, round(avg(value), 6) AS mean FROM events JOIN b USING (event_type) GROUP BY 1, 2")
def w01_tumbling(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return S.tumbling(e, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000), 3600, "value", "event_type").select("event_type", "window", "n", F.round("mean", 6).alias("mean"))


@query(f"SELECT event_id, event_type, median FROM (SELECT event_id, event_type, quantile_disc(value, 0.5) OVER w AS median, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM {_EVENTS} WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE r >= 60")
def w02_rolling_median(spark, sf_dir):
    return S.rolling_median(table(spark, sf_dir, "events").filter("value is not null"), "value", "event_id", "event_type").select("event_id", "event_type", "median")


@query(f"SELECT event_type, first, last, last - first AS delta FROM (SELECT event_type, min_by(value, event_id) AS first, max_by(value, event_id) AS last FROM {_EVENTS} GROUP BY 1)")
def w04_degrading(spark, sf_dir):
    return S.degrading(table(spark, sf_dir, "events").filter("value is not null"), "value", "event_id", "event_type").select("event_type", "first", "last", "delta")


# --- model outputs ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey AS doc_id, l_linenumber AS label, round(ln(avg(exp(l_discount))), 6) AS log_prob FROM lineitem GROUP BY 1, 2")
def m15_mean_log_probs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("offset"), F.col("l_linenumber").alias("label"), F.col("l_discount").alias("log_prob"), F.lit(True).alias("mask"))
    return M.mean_log_probs(rows).select("doc_id", "label", F.round("log_prob", 6).alias("log_prob"))


@query()
def m08_chunks(spark, sf_dir):
    return M.chunks(table(spark, sf_dir, "documents")).select("doc_id", "index", "byte_start", "byte_end")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All base entities of all documents, detected and replaced."""
    done = A.redact(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "anonymized", F.size("items").alias("n_items"))


@query()
def o13_redact_all(spark, sf_dir):
    return flagship(spark, sf_dir)


