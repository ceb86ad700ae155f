"""Further registered queries: rates, trends, splits, decoders, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import anonymize as A
from palimpsest.operators import evaluate as E
from palimpsest.operators import model as M
from palimpsest.operators import statistics as S
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.plans import span_queries  # noqa: F401  registers its queries
from palimpsest.plans.queries import EMAIL_SQL, detected, emails, query, spans_sql, table
from palimpsest.sources import datasets


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IN (3, 1, 2)")
def s07_locked_selection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), "doc_id", "text")
    return datasets.locked_selection(docs, ["3", "1", "2"]).select("doc_id", "text")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, count(*) AS n FROM s GROUP BY 1")
def s08_prediction_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", emails())
    parsed = F.from_json("value", "sample_id string, predictions array<struct<entity_type:string,start_position:int,end_position:int>>")
    return datasets.prediction_lines(docs).select(parsed.alias("p")).filter(F.size("p.predictions") > 0).select(F.col("p.sample_id").cast("long").alias("doc_id"), F.size("p.predictions").cast("long").alias("n"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT DISTINCT doc_id FROM s ORDER BY doc_id::VARCHAR LIMIT 5")
def s19_smoke_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("sample_id"), "text").withColumn("spans", emails())
    return datasets.smoke_subset(docs, ("email",), 5).select("doc_id")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, byte_start, byte_end FROM s")
def p03_p04_p09_filters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = analyze(docs, Options(entities=("email", "phone"), score_threshold=0.8, include_text=False))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.byte_start").cast("long").alias("byte_start"), F.col("s.byte_end").cast("long").alias("byte_end"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, bool_and(decode(encode(text)[byte_start + 1:byte_end]) = value) AS sliced FROM s GROUP BY 1")
def p12_p16_byte_slices(spark, sf_dir):
    rows = detected(spark, sf_dir, emails())
    return rows.groupBy("doc_id").agg(F.bool_and(X.byte_slice(F.col("text"), F.col("byte_start"), F.col("byte_end")) == F.col("value")).alias("sliced"))


@query("SELECT CASE WHEN length(text) <= 4 THEN '1-4' WHEN length(text) <= 8 THEN '5-8' WHEN length(text) <= 16 THEN '9-16' WHEN length(text) <= 32 THEN '17-32' ELSE '33+' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def f09_length_buckets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(X.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT doc_id, '[MAIL]' AS replacement, byte_start::INT AS source_byte_start FROM s")
def o03_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", emails())
    done = A.anonymize(docs, A.Operators({"email": {"type": "replace", "value": "[MAIL]"}}))
    return A.exploded(done, "doc_id").select("doc_id", "i.replacement", "i.source_byte_start")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT DISTINCT value, true AS known FROM s")
def k03_lookup(spark, sf_dir):
    rows = detected(spark, sf_dir, emails()).select("doc_id", F.col("byte_start").alias("b"), F.lit("email").alias("entity"), "value")
    vault = K.build(rows, ["doc_id", "b"])
    back = K.lookup_token(vault.select("token"), vault)
    return K.lookup_value(back.select("entity", "value"), vault).select("value", F.col("token").isNotNull().alias("known"))


@query("SELECT lang, count(*) AS samples, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END)::BIGINT AS tp FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def a04_by_template(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    hit = ((F.col("toxic") == 1) & (F.col("quality") == 0)).cast("int")
    scored = labels.select("lang", hit.alias("tp"), F.lit(0).alias("fp"), F.lit(0).alias("fn"), F.lit(0).alias("offset_mismatches"), F.lit(0).alias("wrong_entity"))
    return E.corpus_scores(scored, "lang").select("lang", "samples", "tp")


@query(f"WITH {spans_sql(EMAIL_SQL)} SELECT 'email' AS entity, 'fp' AS kind, CASE WHEN regexp_matches(value, '[0-9]') THEN 'ambiguous_number' ELSE 'ambiguous_text' END AS cause, count(*)::BIGINT AS count FROM s GROUP BY ALL")
def a06_error_buckets(spark, sf_dir):
    errors = detected(spark, sf_dir, emails()).select("entity", F.lit("fp").alias("kind"), "value")
    return E.error_buckets(errors).select("entity", "kind", "cause", "count")


@query("SELECT event_type, round(count(*) / 3600.0, 6)::DOUBLE AS per_second FROM events GROUP BY 1")
def a14_throughput(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(S.throughput(F.count("*"), F.lit(3600.0)), 6).alias("per_second"))


@query("SELECT event_type, round(avg(p), 6) AS mean_percentile, event_type <> 'click' AS stable_output FROM (SELECT event_type, user_id % 3 AS r, quantile_disc(value, 0.95) AS p FROM events WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def a19_repetitions(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value is not null").withColumn("r", F.col("user_id") % 3).withColumn("fp", F.when(F.col("event_type") == "click", F.col("r").cast("string")).otherwise("x"))
    return S.mean_of_repetitions(e, "r", "value", 0.95, "fp", "event_type").withColumn("mean_percentile", F.round("mean_percentile", 6))


@query("SELECT event_type, half, count(*) AS n FROM (SELECT event_type, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= greatest(1, count(*) OVER (PARTITION BY event_type) // 2) THEN 1 ELSE 2 END AS half FROM events) GROUP BY 1, 2")
def w03_halves(spark, sf_dir):
    return S.halves(table(spark, sf_dir, "events"), "event_id", "event_type").groupBy("event_type", "half").agg(F.count("*").alias("n"))


@query("SELECT doc_id, (strlen(text) // 256)::BIGINT AS window, (CASE WHEN strlen(text) <= 192 THEN 192 WHEN strlen(text) <= 256 THEN 256 WHEN strlen(text) <= 384 THEN 384 WHEN strlen(text) <= 512 THEN 512 ELSE 768 END)::INT AS bucket FROM documents")
def m13_m14_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("pos"))
    return M.windows(rows, 256).select("doc_id", F.col("window").cast("long").alias("window"), M.bucket(F.col("pos"), [192, 256, 384, 512, 768]).cast("int").alias("bucket"))


@query("SELECT doc_id, len(w)::BIGINT AS words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[-_][\\p{L}\\p{N}_]+)*|\\S') AS w FROM documents)")
def f07_model_words(spark, sf_dir):
    words = X.model_words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("words"), F.md5(F.array_join(words, " ")).alias("digest"))


