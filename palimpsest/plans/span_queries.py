"""Registered queries of span policies, scoring, decoders and validators, over whole tables that are read as spans, labels and scores.

``spans_of`` reads lineitem as the spans of one document for each order: range, entity, score and origin come from the row, so the ranges of an order overlap, touch, nest and repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import numbers as N
from palimpsest.functions import text as X
from palimpsest.functions import validators as V
from palimpsest.functions.spans import span
from palimpsest.operators import conflict as J
from palimpsest.operators import context as C
from palimpsest.operators import evaluate as E
from palimpsest.operators import model as M
from palimpsest.operators import recognize as R
from palimpsest.operators import statistics as S
from palimpsest.operators import structured as ST
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.plans import profiles
from palimpsest.plans.queries import EMAIL_SQL, query, spans_sql, table

# --- lineitem as spans -----------------------------------------------------------------------------------------------

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_ENTITY = "CASE l_returnflag WHEN 'A' THEN 'email' WHEN 'R' THEN 'url' ELSE 'person' END"
_SPANS_SQL = f"""v AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}))::INT AS ord, {_ENTITY} AS entity, (l_partkey % 40)::INT AS byte_start,
  (l_partkey % 40 + 1 + l_suppkey % 15)::INT AS byte_end, l_quantity / 50 AS score, CASE WHEN l_linestatus = 'F' THEN 'M' END AS model_label, l_discount, l_tax, l_quantity FROM lineitem)"""
_OUT = "doc_id, entity, byte_start, byte_end, score"


def spans_of(spark, sf_dir) -> DataFrame:
    """doc_id, ord, entity, byte_start, byte_end, score, model_label and some columns of the line."""
    rows = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))
    at = "l_partkey % 40"
    return rows.selectExpr("l_orderkey AS doc_id", "ord", f"{_ENTITY} AS entity", f"int({at}) AS byte_start", f"int({at} + 1 + l_suppkey % 15) AS byte_end", "l_quantity / 50 AS score", "CASE WHEN l_linestatus = 'F' THEN 'M' END AS model_label", "l_discount", "l_tax", "l_quantity")


def span_arrays(spark, sf_dir) -> DataFrame:
    """doc_id, spans: an order has a few lines."""
    items = F.array_sort(F.collect_list(F.struct("ord", "entity", "byte_start", "byte_end", "score", "model_label")))
    made = F.transform(items, lambda x: span(entity=x["entity"], byte_start=x["byte_start"], byte_end=x["byte_end"], score=x["score"], model_label=x["model_label"], recognizer=F.when(x["model_label"].isNotNull(), "ner").otherwise("rule")))
    return spans_of(spark, sf_dir).groupBy("doc_id").agg(made.alias("spans"))


def _resolved(spark, sf_dir, f) -> DataFrame:
    return span_arrays(spark, sf_dir).select("doc_id", F.explode(f(F.col("spans"))).alias("s")).select("doc_id", "s.entity", "s.byte_start", "s.byte_end", "s.score")


_STRUCT = "entity IN ('email','phone','credit_card','iban','us_ssn','ip_address','domain','url') AND model_label IS NULL"
_BEATEN = f"SELECT * FROM v a WHERE model_label IS NULL OR NOT EXISTS (SELECT 1 FROM (SELECT * FROM v WHERE {_STRUCT}) r WHERE r.doc_id = a.doc_id AND a.byte_start < r.byte_end AND r.byte_start < a.byte_end)"


def _dedupe(of: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity, byte_start, byte_end ORDER BY score DESC, ord) AS same FROM {of}) WHERE same = 1"


def _maximal(of: str) -> str:
    return f"SELECT * FROM {of} a WHERE NOT EXISTS (SELECT 1 FROM {of} b WHERE b.doc_id = a.doc_id AND b.entity = a.entity AND a.byte_start >= b.byte_start AND a.byte_end <= b.byte_end AND (a.byte_start, a.byte_end) <> (b.byte_start, b.byte_end))"


@query(f"WITH {_SPANS_SQL} SELECT {_OUT} FROM ({_BEATEN})")
def j05_structured_beats_model(spark, sf_dir):
    return _resolved(spark, sf_dir, J.structured_beats_model)


@query(f"WITH {_SPANS_SQL} SELECT {_OUT} FROM ({_dedupe('v')})")
def j06_exact_duplicates(spark, sf_dir):
    return _resolved(spark, sf_dir, J.without_exact_copies)


@query(f"WITH {_SPANS_SQL} SELECT {_OUT} FROM ({_maximal('v')})")
def j07_maximal_spans(spark, sf_dir):
    return _resolved(spark, sf_dir, J.maximal_of_entity)


@query(f"WITH {_SPANS_SQL} SELECT {_OUT} FROM v")
def j08_none(spark, sf_dir):
    return _resolved(spark, sf_dir, lambda s: J.resolve(s, "none"))


@query(f"WITH {_SPANS_SQL}, b AS ({_BEATEN}), d AS ({_dedupe('b')}) SELECT {_OUT} FROM ({_maximal('d')})")
def j09_default_policy(spark, sf_dir):
    return _resolved(spark, sf_dir, J.default)


_OVERLAP = "o.byte_start < y.b AND y.a < o.byte_end"
_SAME = "o.byte_start = y.a AND o.byte_end = y.b"
_NESTED = "((o.byte_start >= y.a AND o.byte_end <= y.b) OR (y.a >= o.byte_start AND y.b <= o.byte_end))"


def _greedy_sql(order: str, clash: str = _OVERLAP, name: str = "") -> str:
    """Relations o<name> (v by rank r) and f<name> (doc_id, rs: the ranks that stay): a rank at a time, against those that stayed."""
    return f"""o{name} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}, byte_start, byte_end, ord) AS r FROM v),
k{name} AS (SELECT doc_id, 0::BIGINT AS r, []::STRUCT(a INT, b INT, e VARCHAR)[] AS kept, []::BIGINT[] AS rs FROM (SELECT DISTINCT doc_id FROM v)
UNION ALL SELECT k.doc_id, o.r, CASE WHEN x THEN k.kept ELSE list_append(k.kept, {{'a': o.byte_start, 'b': o.byte_end, 'e': o.entity}}) END, CASE WHEN x THEN k.rs ELSE list_append(k.rs, o.r) END
FROM k{name} k JOIN o{name} o ON o.doc_id = k.doc_id AND o.r = k.r + 1, LATERAL (SELECT len(list_filter(k.kept, lambda y: {clash})) > 0 AS x)),
f{name} AS (SELECT doc_id, max_by(rs, r) AS rs FROM k{name} GROUP BY doc_id)"""


def _kept_sql(order: str) -> str:
    return f"WITH RECURSIVE {_SPANS_SQL}, {_greedy_sql(order)} SELECT o.doc_id, entity, byte_start, byte_end, score FROM o JOIN f ON o.doc_id = f.doc_id AND list_contains(f.rs, o.r)"


@query(_kept_sql("byte_end - byte_start DESC, score DESC, byte_start, byte_end, entity"))
def j03_prefer_longer(spark, sf_dir):
    return _resolved(spark, sf_dir, J.prefer_longer)


@query(_kept_sql("score DESC, byte_end - byte_start DESC, byte_start, byte_end, entity"))
def j04_prefer_higher_confidence(spark, sf_dir):
    return _resolved(spark, sf_dir, J.prefer_higher_confidence)


@query(
    f"""WITH RECURSIVE {_SPANS_SQL}, {_greedy_sql("byte_start, byte_start - byte_end", f"o.entity = y.e AND {_OVERLAP}", "1")}, {_greedy_sql("score DESC, byte_start", name="2")},
{_greedy_sql("score DESC, byte_start", f"{_OVERLAP} AND (NOT {_NESTED} OR ({_SAME}))", "3")}, {_greedy_sql("score DESC, byte_start", f"{_OVERLAP} AND NOT ({_SAME} AND o.entity <> y.e)", "4")}
SELECT doc_id, len(f1.rs)::INT AS by_label, len(f2.rs)::INT AS flat, len(f3.rs)::INT AS nested, len(f4.rs)::INT AS multi FROM f1 JOIN f2 USING (doc_id) JOIN f3 USING (doc_id) JOIN f4 USING (doc_id)"""
)
def j16_j17_suppression(spark, sf_dir):
    s = F.col("spans")
    return span_arrays(spark, sf_dir).select("doc_id", F.size(J.discard_overlaps_by_label(s)).alias("by_label"), F.size(J.suppress(s)).alias("flat"), F.size(J.suppress(s, flat=False)).alias("nested"), F.size(J.suppress(s, multi_label=True)).alias("multi"))


@query(f"WITH {_SPANS_SQL} SELECT {_OUT} FROM ({_dedupe('v')})")
def j18_cascade_merge(spark, sf_dir):
    return _resolved(spark, sf_dir, J.cascade_merge)


@query(f"WITH {_SPANS_SQL} SELECT count(*) AS labels, sum(CASE WHEN entity IN ('email', 'url') THEN 1 ELSE 0 END)::BIGINT AS base FROM v")
def p10_supported_split(spark, sf_dir):
    return spans_of(spark, sf_dir).agg(F.count("*").alias("labels"), F.sum(profiles.supported(F.col("entity"), "regex_only").cast("int")).alias("base"))


@query(f"WITH {_SPANS_SQL} SELECT doc_id, ord, '<<' || upper(entity) || '_' || CASE WHEN byte_end * 29 < 1000 THEN lpad((byte_end * 29)::VARCHAR, 3, '0') ELSE (byte_end * 29)::VARCHAR END || '>>' AS token FROM v")
def k02_tokens(spark, sf_dir):
    return spans_of(spark, sf_dir).select("doc_id", "ord", K.TokenFormat().token(F.col("entity"), F.col("byte_end") * 29).alias("token"))


# --- scoring: some lines are gold, some are predicted, a few of those with another range or entity -----------------------

_GOLD_SQL = "gold AS (SELECT doc_id AS sample_id, ord, entity, byte_start, byte_end FROM v WHERE l_tax < 0.07)"
_MOVED = "CASE WHEN l_quantity < 9 THEN 1 ELSE 0 END"
_PRED_SQL = f"pred AS (SELECT doc_id AS sample_id, ord, CASE WHEN l_quantity > 45 THEN 'phone' ELSE entity END AS entity, byte_start + {_MOVED} AS byte_start, byte_end + {_MOVED} AS byte_end, score FROM v WHERE l_discount > 0.01)"
_EVAL_SQL = f"""{_SPANS_SQL}, {_GOLD_SQL}, {_PRED_SQL},
m AS (SELECT entity, g.ord IS NOT NULL AS has_g, p.ord IS NOT NULL AS has_p
  FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, entity, byte_start, byte_end ORDER BY ord) AS n FROM gold) g
  FULL JOIN (SELECT *, row_number() OVER (PARTITION BY sample_id, entity, byte_start, byte_end ORDER BY ord) AS n FROM pred) p USING (sample_id, entity, byte_start, byte_end, n))"""
_COUNTS_SQL = "count(*) FILTER (WHERE has_g AND has_p) AS tp, count(*) FILTER (WHERE NOT has_g) AS fp, count(*) FILTER (WHERE NOT has_p) AS fn"


def gold_and_pred(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v = spans_of(spark, sf_dir)
    gold = v.filter("l_tax < 0.07").select(F.col("doc_id").alias("sample_id"), "ord", "entity", "byte_start", "byte_end")
    moved = F.expr(_MOVED)
    entity = F.when(F.col("l_quantity") > 45, "phone").otherwise(F.col("entity"))
    pred = v.filter("l_discount > 0.01").select(F.col("doc_id").alias("sample_id"), "ord", entity.alias("entity"), (F.col("byte_start") + moved).alias("byte_start"), (F.col("byte_end") + moved).alias("byte_end"), "score")
    return gold, pred


def samples(spark, sf_dir) -> DataFrame:
    gold, pred = gold_and_pred(spark, sf_dir)
    return E.arrays(gold, "gold").join(E.arrays(pred, "pred"), "sample_id", "full")


_LISTS_SQL = """l AS (SELECT sample_id, coalesce(g, []) AS g, coalesce(p, []) AS p FROM (SELECT sample_id, list({'e': entity, 'a': byte_start, 'b': byte_end} ORDER BY ord) AS g FROM gold GROUP BY 1)
  FULL JOIN (SELECT sample_id, list({'e': entity, 'a': byte_start, 'b': byte_end, 'n': ord} ORDER BY ord) AS p FROM pred GROUP BY 1) USING (sample_id))"""
_LAP = "g.a < y.b AND y.a < g.b"
_TESTS = {"x": "y.e = g.e AND y.a = g.a AND y.b = g.b", "o": f"y.e = g.e AND {_LAP} AND NOT (y.a = g.a AND y.b = g.b)", "w": f"y.e <> g.e AND {_LAP}"}


def _pass_sql(name: str, of: str) -> str:
    """Relation <name> (sample_id, g and p: what is left, n: pairs) after one pass over the gold spans of ``of``: each takes the first prediction that passes."""
    return f"""{name}_i AS (SELECT sample_id, 0 AS i, g AS todo, []::STRUCT(e VARCHAR, a INT, b INT)[] AS g, p, 0 AS n FROM {of}
UNION ALL SELECT sample_id, i + 1, todo, CASE WHEN hit IS NULL THEN list_append(s.g, todo[i + 1]) ELSE s.g END, CASE WHEN hit IS NULL THEN p ELSE list_filter(p, lambda y: y.n <> hit.n) END, n + CASE WHEN hit IS NULL THEN 0 ELSE 1 END
FROM {name}_i s, LATERAL (SELECT todo[i + 1] AS g) t, LATERAL (SELECT list_filter(s.p, lambda y: {_TESTS[name].replace("g.", "t.g.")})[1] AS hit) WHERE i < len(todo)),
{name} AS (SELECT sample_id, g, p, n FROM {name}_i WHERE i = len(todo))"""


_SCORES_SQL = f"""{_SPANS_SQL}, {_GOLD_SQL}, {_PRED_SQL}, {_LISTS_SQL}, {_pass_sql('x', 'l')}, {_pass_sql('o', 'x')}, {_pass_sql('w', 'o')},
scored AS (SELECT sample_id, x.n AS tp, o.n AS offset_mismatches, w.n AS wrong_entity, len(w.p)::INT AS fp, len(w.g)::INT AS fn FROM x JOIN o USING (sample_id) JOIN w USING (sample_id))"""


@query(f"WITH RECURSIVE {_SCORES_SQL} SELECT * FROM scored")
def a01_sample_scores(spark, sf_dir):
    return E.score_samples(samples(spark, sf_dir)).select("sample_id", "tp", "offset_mismatches", "wrong_entity", "fp", "fn")


@query(
    f"""WITH RECURSIVE {_SCORES_SQL}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(offset_mismatches)::BIGINT AS offset_mismatches, sum(wrong_entity)::BIGINT AS wrong_entity, count(*) AS samples FROM scored)
SELECT *, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(5 * tp / (5 * tp + 4 * fn + fp)::DOUBLE, 6) AS f2 FROM t"""
)
def a02_corpus_scores(spark, sf_dir):
    out = E.corpus_scores(E.score_samples(samples(spark, sf_dir)))
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "f2")})


@query(f"WITH {_EVAL_SQL}, c AS (SELECT entity, {_COUNTS_SQL} FROM m GROUP BY entity) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END, 6) AS recall FROM c")
def a03_per_entity(spark, sf_dir):
    rows = E.ratios(E.exact_counts(*gold_and_pred(spark, sf_dir), "entity"))
    return rows.select("entity", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"WITH {_EVAL_SQL} SELECT {_COUNTS_SQL} FROM m")
def j12_exact_match(spark, sf_dir):
    return E.exact_counts(*gold_and_pred(spark, sf_dir))


_IOU = "CASE WHEN greatest(t.g.b, y.b) - least(t.g.a, y.a) = 0 THEN 0 ELSE greatest(0, least(t.g.b, y.b) - greatest(t.g.a, y.a)) / (greatest(t.g.b, y.b) - least(t.g.a, y.a))::DOUBLE END"
_BEST = f"list_sort(list_transform(list_filter(s.p, lambda y: y.e $IS$ t.g.e AND {_IOU} >= 0.5), lambda y: {{'o': -({_IOU}), 'n': y.n, 'y': y}}))[1]"


@query(
    f"""WITH RECURSIVE {_SPANS_SQL}, {_GOLD_SQL}, {_PRED_SQL}, {_LISTS_SQL}, i AS (SELECT sample_id, 0 AS i, g AS todo, p, 0 AS tp, 0 AS wrong, 0 AS fn FROM l
UNION ALL SELECT sample_id, i + 1, todo, CASE WHEN coalesce(same, other) IS NULL THEN p ELSE list_filter(p, lambda y: NOT (y.e = coalesce(same, other).y.e AND y.a = coalesce(same, other).y.a AND y.b = coalesce(same, other).y.b)) END,
  tp + CASE WHEN same IS NULL THEN 0 ELSE 1 END, wrong + CASE WHEN same IS NULL AND other IS NOT NULL THEN 1 ELSE 0 END, fn + CASE WHEN coalesce(same, other) IS NULL THEN 1 ELSE 0 END
FROM i s, LATERAL (SELECT todo[i + 1] AS g) t, LATERAL (SELECT {_BEST.replace('$IS$', '=')} AS same, {_BEST.replace('$IS$', '<>')} AS other) WHERE i < len(todo))
SELECT sample_id, tp AS iou_tp, wrong AS iou_wrong, fn AS iou_fn, len(p)::INT AS iou_fp FROM i WHERE i = len(todo)"""
)
def a05_iou(spark, sf_dir):
    return E.iou_samples(samples(spark, sf_dir), 0.5).select("sample_id", "iou_tp", "iou_wrong", "iou_fn", "iou_fp")


_AT = [0.2, 0.5, 0.75, 0.92]


@query(
    f"""WITH {_EVAL_SQL}, t AS (SELECT unnest({_AT})::DOUBLE AS threshold), g AS (SELECT DISTINCT sample_id, entity, byte_start, byte_end, true AS known FROM gold),
c AS (SELECT threshold, count(g.known) AS tp, count(p.sample_id) - count(g.known) AS fp FROM t LEFT JOIN pred p ON p.score >= threshold LEFT JOIN g ON p.sample_id = g.sample_id AND p.entity = g.entity AND p.byte_start = g.byte_start AND p.byte_end = g.byte_end GROUP BY 1),
f AS (SELECT threshold, tp, fp, (SELECT count(*) FROM g) - tp AS fn FROM c)
SELECT *, CASE WHEN tp > 0 THEN round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) END AS f1, row_number() OVER (ORDER BY CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END DESC NULLS LAST, threshold) = 1 AS best FROM f"""
)
def a20_threshold_sweep(spark, sf_dir):
    gold, pred = gold_and_pred(spark, sf_dir)
    return E.sweep(pred, gold, _AT).select("threshold", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "best")


# --- model outputs -----------------------------------------------------------------------------------------------------

_LABEL = "CASE WHEN l_quantity < 15 THEN 'B-' WHEN l_quantity < 35 THEN 'I-' WHEN l_quantity < 45 THEN 'E-' ELSE '' END || CASE l_returnflag WHEN 'A' THEN 'PER' WHEN 'R' THEN 'LOC' ELSE 'ORG' END"


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_quantity < 15 AND l_returnflag = 'A' THEN 0.6 WHEN l_returnflag = 'A' THEN 0.5 WHEN l_returnflag = 'R' THEN 0.3 ELSE 0.7 END::DOUBLE AS threshold FROM lineitem")
def m02_thresholds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.expr(_LABEL)).withColumn("entity", F.when(F.col("l_returnflag") == "R", "location").otherwise("other"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", M.threshold(F.col("label"), F.col("entity"), {"PER": 0.5, "B-PER": 0.6}, {"location": 0.3}, 0.7).alias("threshold"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag = 'A' OR l_discount * 10 < CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 0.5 END AS gated FROM lineitem")
def m03_gates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("label", F.expr(_LABEL)).withColumn("entity", F.when(F.col("l_returnflag") == "R", "location").otherwise("other"))
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", M.requires_context(F.col("label"), F.col("entity"), F.col("l_discount") * 10, ("PER",), {"LOC": 0.8}, {"other": 0.5}).alias("gated"))


_TOKENS_SQL = f"tok AS (SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}))::INT AS pos, CASE WHEN l_tax > 0.06 THEN 'O' ELSE {_LABEL} END AS label, l_discount AS score FROM lineitem)"


def model_tokens(spark, sf_dir) -> DataFrame:
    """doc_id, pos, label, start, end, score: the lines of an order as labelled tokens."""
    rows = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))
    return rows.select(F.col("l_orderkey").alias("doc_id"), "pos", F.when(F.col("l_tax") > 0.06, "O").otherwise(F.expr(_LABEL)).alias("label"), (F.col("pos") * 5).alias("start"), (F.col("pos") * 5 + 4).alias("end"), F.col("l_discount").alias("score"))


@query(
    f"""WITH {_TOKENS_SQL}, b AS (SELECT *, regexp_replace(label, '^[BIESLU]-', '') AS base, lag(regexp_replace(label, '^[BIESLU]-', '')) OVER w AS before, lag(label) OVER w AS last FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, sum(CASE WHEN regexp_matches(label, '^[IE]-') AND before = base AND last <> 'O' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM b)
SELECT doc_id, min_by(base, pos) AS label, min(pos * 5)::INT AS start, max(pos * 5 + 4)::INT AS "end", round(avg(score), 6) AS score FROM c WHERE label <> 'O' GROUP BY doc_id, island"""
)
def m09_bio_merge(spark, sf_dir):
    return M.merge_bio(model_tokens(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    """WITH x AS (SELECT c_custkey AS doc_id, 2 + c_nationkey % 3 AS n_words, unnest(range(0, 16)) AS i, c_acctbal, c_nationkey FROM customer),
y AS (SELECT doc_id, n_words, i, ((floor(c_acctbal) + i * 37) % 23 - 11) / 4 AS logit FROM x)
SELECT doc_id, (i // 4)::INT AS start, (i // 4 + (i // 2) % 2 + 1)::INT AS "end", CASE i % 2 WHEN 0 THEN 'p' ELSE 'q' END AS label, round(1 / (1 + exp(-logit)), 6) AS score FROM y WHERE logit > 0 AND i // 4 + (i // 2) % 2 + 1 <= n_words"""
)
def m10_span_logits(spark, sf_dir):
    logits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((F.floor("c_acctbal") + i * 37) % 23 - 11) / 4)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (2 + F.col("c_nationkey") % 3).alias("n_words"), logits.alias("logits"))
    return M.decode_span_logits(rows, 2, ["p", "q"]).withColumn("score", F.round("score", 6))


_BIOES = ["O", "B-x", "I-x", "E-x", "S-x"]
_NEXT = ", ".join(f"({i}, {j})" for i, a in enumerate(_BIOES) for j, b in enumerate(_BIOES) if M.transition_allowed(a, b))


@query(
    f"""WITH s AS (SELECT c_custkey AS doc_id, t, l, ((c_custkey * 7 + t * 31 + l * 17 + floor(c_acctbal)::BIGINT) % 97)::DOUBLE AS x FROM customer, unnest(range(0, 3)) AS a(t), unnest(range(0, 5)) AS b(l)),
n AS (SELECT * FROM (VALUES {_NEXT}) AS n(i, j)),
p AS (SELECT a.doc_id, a.l AS l1, b.l AS l2, c.l AS l3, a.x + b.x + c.x AS total FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.t = 0 AND b.t = 1 JOIN s c ON a.doc_id = c.doc_id AND c.t = 2
  JOIN n n1 ON n1.i = a.l AND n1.j = b.l JOIN n n2 ON n2.i = b.l AND n2.j = c.l WHERE a.l IN (0, 1, 4) AND c.l IN (0, 3, 4))
SELECT doc_id, l1::VARCHAR || ',' || l2::VARCHAR || ',' || l3::VARCHAR AS path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, l3, l2, l1) AS r FROM p) WHERE r = 1"""
)
def m16_viterbi(spark, sf_dir):
    """Against all paths of three tokens."""
    at = lambda t, i: ((F.col("c_custkey") * 7 + t * 31 + i * 17 + F.floor("c_acctbal")) % 97).cast("double")
    scores = F.array(*[F.array(*[at(t, i) for i in range(5)]) for t in range(3)])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), scores.alias("scores"))
    return M.viterbi(rows, _BIOES).select("doc_id", F.array_join("path", ",").alias("path"))


_TAGS_SQL = f"tag AS (SELECT doc_id, pos, CASE WHEN label = 'O' THEN 'O' WHEN regexp_matches(label, '^[BIE]-') THEN label ELSE 'S-' || label END AS x FROM (SELECT * FROM tok)), q AS (SELECT doc_id, list(x ORDER BY pos) AS xs FROM tag GROUP BY 1)"
_EMIT = "list_append(s.o, {'l': s.l, 'a': s.f, 'b': i})"


@query(
    f"""WITH RECURSIVE {_TOKENS_SQL}, {_TAGS_SQL},
s AS (SELECT doc_id, xs, 0 AS i, NULL::VARCHAR AS l, NULL::INT AS f, []::STRUCT(l VARCHAR, a INT, b INT)[] AS o FROM q
UNION ALL SELECT doc_id, xs, i + 1,
  CASE WHEN x = 'O' OR g IN ('S', 'E') THEN NULL ELSE nm END,
  CASE WHEN x = 'O' OR g IN ('S', 'E') THEN NULL WHEN g = 'I' AND s.l IS NOT DISTINCT FROM nm THEN s.f ELSE i END,
  CASE WHEN g = 'I' AND s.l IS NOT DISTINCT FROM nm THEN s.o WHEN g = 'E' AND s.l IS NOT DISTINCT FROM nm THEN list_append(s.o, {{'l': s.l, 'a': s.f, 'b': i + 1}})
    WHEN x <> 'O' AND g IN ('S', 'E') THEN list_append(CASE WHEN s.l IS NULL THEN s.o ELSE {_EMIT} END, {{'l': nm, 'a': i, 'b': i + 1}}) WHEN s.l IS NULL THEN s.o ELSE {_EMIT} END
FROM s, LATERAL (SELECT xs[i + 1] AS x, CASE WHEN xs[i + 1] = 'O' THEN '' ELSE xs[i + 1][1] END AS g, xs[i + 1][3:] AS nm) WHERE i < len(xs)),
e AS (SELECT doc_id, CASE WHEN l IS NULL THEN o ELSE {_EMIT} END AS o FROM s WHERE i = len(xs))
SELECT doc_id, r.l AS label, r.a AS start, r.b AS "end" FROM (SELECT doc_id, unnest(o) AS r FROM e)"""
)
def m18_bioes_spans(spark, sf_dir):
    tags = F.when((F.col("label") == "O") | F.col("label").rlike("^[BIE]-"), F.col("label")).otherwise(F.concat(F.lit("S-"), "label"))
    rows = model_tokens(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", tags.alias("x")))), lambda t: t["x"]).alias("labels"))
    return rows.select("doc_id", F.explode(M.bioes_spans(F.col("labels"))).alias("s")).select("doc_id", "s.label", "s.start", "s.end")


@query("SELECT c_custkey AS doc_id, round((-(c_nationkey) / 10.0 - (c_custkey % 7) / 10.0)::DOUBLE / 2, 6) AS mean FROM customer WHERE (-(c_nationkey) / 10.0 - (c_custkey % 7) / 10.0)::DOUBLE / 2 >= -0.95")
def m19_log_prob_filter(spark, sf_dir):
    probs = F.array(F.lit(-9.0), -F.col("c_nationkey") / 10, -(F.col("c_custkey") % 7) / 10, F.lit(-9.0))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("start"), F.lit(3).alias("end"), probs.alias("log_probs"))
    return M.mean_log_prob_filter(rows, -0.95).select("doc_id", F.round("mean_log_prob", 6).alias("mean"))


_FIRST = "regexp_extract(text, '^[A-Za-z]+')"


@query(
    f"""WITH w AS (SELECT doc_id, text, lang, {_FIRST} AS first, (n_chars % 100) / 100.0 AS score FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'person' AS entity, 0::INT AS byte_start, strlen(first)::INT AS byte_end, score::DOUBLE AS score, first AS text, false AS requires_context FROM w WHERE score >= 0.5 AND first <> ''
UNION ALL SELECT doc_id, 'location', 1, strlen(left(text, 3))::INT, 1.0, substr(text, 2, 2), lang = 'en' FROM w WHERE length(text) >= 3 AND NOT regexp_matches(left(text, 4), '[^A-Za-z ,.]') AND lang IN ('en', 'de')"""
)
def m01_normalize_outputs(spark, sf_dir):
    """Outputs of a model derived from each text: the first word in bytes, two letters in characters without a score, and labels that are ignored or not known."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    plain = (F.length("text") >= 3) & ~F.substring("text", 1, 4).rlike("[^A-Za-z ,.]")
    one = lambda label, start, end, unit, score: F.struct(label.alias("label"), F.lit(start).alias("start"), end.cast("int").alias("end"), F.lit(unit).alias("offset_unit"), score.cast("double").alias("score"))
    outputs = F.array(
        one(F.lit("B-PER"), 0, F.octet_length(first), "byte", (F.col("n_chars") % 100) / 100), one(F.when(F.col("lang") == "en", "I-GPE").when(F.col("lang") == "de", "LOC").otherwise("MISC"), 1, F.when(plain, 3).otherwise(0), "character", F.lit(None)),
        one(F.lit("O"), 0, F.lit(1), "byte", F.lit(0.9)), one(F.lit("B-ODD"), 0, F.lit(1), "byte", F.lit(0.9)),
    )
    rows = docs.select("doc_id", F.explode(outputs).alias("o")).select("doc_id", "o.*")
    labels = {"PER": "person", "LOC": "location", "GPE": "location"}
    return M.normalize(rows, docs.select("doc_id", "text"), labels, default=0.5, gates={"labels": ("GPE",)}, align="strict").drop("source_entity", "threshold")


@query(
    f"""WITH {spans_sql(EMAIL_SQL)}, w AS (SELECT doc_id, {_FIRST} AS first, (n_chars % 100) / 100.0 AS score FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'email' AS entity, byte_start::INT AS byte_start, byte_end::INT AS byte_end, value FROM s
UNION ALL SELECT doc_id, 'person', 0, strlen(first)::INT, first FROM w WHERE score >= 0.7 AND first <> '' AND NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = w.doc_id AND s.byte_start < strlen(first))"""
)
def r18_model_profile(spark, sf_dir):
    """The balanced product with a model's outputs as a table: its spans join those of the rules, and give way to structured ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    outputs = docs.filter("text IS NOT NULL").select("doc_id", F.lit("B-PER").alias("label"), F.lit(0).alias("start"), F.octet_length(first).alias("end"), F.lit("byte").alias("offset_unit"), ((F.col("n_chars") % 100) / 100).alias("score"))
    found = analyze(docs, Options(profile="balanced", entities=("email", "person"), model_options={"align": "strict"}), outputs=outputs)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.entity", "s.byte_start", "s.byte_end", F.col("s.text").alias("value"))


@query("SELECT l_orderkey AS doc_id, l_partkey % 40 AS start, max(l_discount) AS score FROM lineitem GROUP BY 1, 2")
def m07_dedupe_outputs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit("PER").alias("label"), (F.col("l_partkey") % 40).alias("start"), (F.col("l_partkey") % 40 + 3).alias("end"), F.col("l_discount").alias("score"))
    return M.dedupe_outputs(rows).select("doc_id", "start", "score")


@query(
    """SELECT c_custkey AS doc_id, ['A', 'B', 'C'][best] AS label, round(exp(x[best] - 9) / (exp(x[1] - 9) + exp(x[2] - 9) + exp(x[3] - 9)), 6) AS score
FROM (SELECT *, list_position(x, list_max(x)) AS best FROM (SELECT c_custkey, [c_nationkey / 3.0, floor(c_acctbal)::BIGINT % 11, c_custkey % 9]::DOUBLE[] AS x FROM customer))"""
)
def m11_argmax_tokens(spark, sf_dir):
    logits = F.array(F.col("c_nationkey") / 3, (F.floor("c_acctbal") % 11).cast("double"), (F.col("c_custkey") % 9).cast("double"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), logits.alias("logits"))
    return M.argmax_tokens(rows, ["A", "B", "C"]).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_SPANS_SQL}, h AS (SELECT doc_id, max(score) AS top FROM v WHERE entity = 'person' GROUP BY 1), d AS (SELECT DISTINCT doc_id FROM v),
extra AS (SELECT o_orderkey AS doc_id, 'person' AS entity, 3 AS byte_start, 9 AS byte_end, 0.6 AS score FROM orders JOIN d ON d.doc_id = o_orderkey LEFT JOIN h ON h.doc_id = o_orderkey WHERE top IS NULL OR top < 0.5),
b AS (SELECT doc_id, entity, byte_start, byte_end, score, 'primary' AS role FROM v UNION ALL SELECT *, 'secondary' FROM extra)
SELECT doc_id, entity, byte_start, byte_end, max(score) AS score FROM b GROUP BY ALL"""
)
def j19_cascade(spark, sf_dir):
    """A second model's span for the orders whose persons are missing or uncertain."""
    primary = spans_of(spark, sf_dir).select("doc_id", "entity", "byte_start", "byte_end", "score")
    docs = primary.select("doc_id").distinct().withColumn("text", F.lit(""))
    second = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("person").alias("entity"), F.lit(3).alias("byte_start"), F.lit(9).alias("byte_end"), F.lit(0.6).alias("score"))
    return M.cascade(docs, primary, second, "missing_or_uncertain", "person", 0.5).drop("role")


# --- validators, labels, context: values made of each customer ---------------------------------------------------------

_BODY = "lpad((c_custkey * 7919 + 13)::VARCHAR, 9, '0') || lpad((floor(abs(c_acctbal) * 100)::BIGINT)::VARCHAR, 9, '0')"
_VALUES_SQL = f"""cu AS (SELECT *, {_BODY} AS body FROM customer),
va AS (SELECT c_custkey, c_nationkey, body, '4' || body[4:18] AS card, 'DE' || CASE WHEN c_nationkey < 13 THEN lpad((98 - (body || '131400')::HUGEINT % 97)::VARCHAR, 2, '0') ELSE '00' END || body AS iban,
  lpad((c_custkey % 950)::VARCHAR, 3, '0') || '-' || lpad((c_nationkey)::VARCHAR, 2, '0') || '-' || lpad((c_custkey * 3 % 10000)::VARCHAR, 4, '0') AS ssn FROM cu)"""
_LUHN_SQL = "list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN card[16 - i]::INT ELSE card[16 - i]::INT * 2 - CASE WHEN card[16 - i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_SSN_GOOD = "substr(ssn, 1, 3) NOT IN ('000', '666') AND substr(ssn, 1, 3) < '900' AND substr(ssn, 5, 2) <> '00' AND substr(ssn, 8, 4) <> '0000'"


def values_of(spark, sf_dir) -> DataFrame:
    """c_custkey, c_nationkey, card, iban (half of them with the right check digits), ssn."""
    body = F.concat(F.lpad((F.col("c_custkey") * 7919 + 13).cast("string"), 9, "0"), F.lpad(F.floor(F.abs("c_acctbal") * 100).cast("string"), 9, "0"))
    rows = table(spark, sf_dir, "customer").withColumn("body", body)
    check = F.lpad((98 - F.concat("body", F.lit("131400")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    ssn = F.concat_ws("-", F.lpad((F.col("c_custkey") % 950).cast("string"), 3, "0"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 3 % 10000).cast("string"), 4, "0"))
    return rows.select("c_custkey", "c_nationkey", F.concat(F.lit("4"), F.substring("body", 4, 15)).alias("card"), F.concat(F.lit("DE"), F.when(F.col("c_nationkey") < 13, check).otherwise("00"), "body").alias("iban"), ssn.alias("ssn"))


@query(f"WITH {_VALUES_SQL} SELECT c_custkey, {_LUHN_SQL} AS valid FROM va")
def f01_luhn(spark, sf_dir):
    return values_of(spark, sf_dir).select("c_custkey", V.luhn(F.concat_ws(" ", F.substring("card", 1, 4), F.substring("card", 5, 4), F.substring("card", 9, 8))).alias("valid"))


@query(f"WITH {_VALUES_SQL} SELECT c_custkey, c_nationkey < 13 OR (body || '131400')::HUGEINT % 97 = 1 AS valid FROM va")
def f02_iban(spark, sf_dir):
    return values_of(spark, sf_dir).select("c_custkey", V.iban(F.col("iban")).alias("valid"))


@query(f"WITH {_VALUES_SQL} SELECT c_custkey, 3 AS byte_start, ssn AS value FROM va WHERE {_SSN_GOOD}")
def r04_us_ssn(spark, sf_dir):
    t = values_of(spark, sf_dir).withColumn("text", F.concat(F.lit("id "), "ssn", F.lit(" end 1"), "ssn"))
    return t.select("c_custkey", F.explode(R.all_spans(F.col("text"), R.BASE["us_ssn"])).alias("s")).select("c_custkey", "s.byte_start", F.col("s.text").alias("value"))


@query(f"WITH {_VALUES_SQL} SELECT c_custkey, 4 AS byte_start, CASE WHEN c_custkey % 2 = 0 THEN lower(iban) ELSE iban END AS value FROM va WHERE c_nationkey < 13 OR (body || '131400')::HUGEINT % 97 = 1")
def r05_iban(spark, sf_dir):
    t = values_of(spark, sf_dir).withColumn("text", F.concat(F.lit("pay "), F.when(F.col("c_custkey") % 2 == 0, F.lower("iban")).otherwise(F.col("iban")), F.lit(". or XX"), F.substring("iban", 3, 20)))
    return t.select("c_custkey", F.explode(R.all_spans(F.col("text"), R.BASE["iban"])).alias("s")).select("c_custkey", "s.byte_start", F.col("s.text").alias("value"))


@query(f"WITH {_VALUES_SQL} SELECT c_custkey, 5 AS byte_start, card AS value FROM va WHERE {_LUHN_SQL}")
def r03_credit_card_spans(spark, sf_dir):
    t = values_of(spark, sf_dir).withColumn("text", F.concat(F.lit("card "), "card", F.lit(" paid")))
    return t.select("c_custkey", F.explode(R.all_spans(F.col("text"), R.BASE["credit_card"])).alias("s")).select("c_custkey", "s.byte_start", F.col("s.text").alias("value"))


@query(
    f"""WITH {_VALUES_SQL}, g AS (SELECT c_custkey, c_nationkey FROM va WHERE {_SSN_GOOD})
SELECT c_custkey, 0.85::DOUBLE AS before, CASE WHEN c_nationkey < 8 OR c_nationkey >= 16 THEN 1.0 ELSE 0.85 END::DOUBLE AS after, c_nationkey < 8 OR c_nationkey >= 16 AS matched FROM g"""
)
def c04_context_boost(spark, sf_dir):
    lead = F.when(F.col("c_nationkey") < 8, "my ssn is ").when(F.col("c_nationkey") < 16, "number ").otherwise("the social security number ")
    t = values_of(spark, sf_dir).withColumn("text", F.concat(lead, "ssn", F.lit(" ok"))).withColumn("spans", R.all_spans(F.col("text"), R.BASE["us_ssn"]))
    after = C.enhance(F.col("text"), F.col("spans"), C.ContextOptions())
    return t.select("c_custkey", F.explode(after).alias("s")).select("c_custkey", F.col("s.original_score").alias("before"), F.round("s.score", 6).alias("after"), F.col("s.context_matched").isNotNull().alias("matched"))


@query(
    """SELECT o_orderkey, r.s AS byte_start, r.v AS value, r.p AS pattern FROM (SELECT o_orderkey, unnest([{'s': 3, 'v': strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'p': 'iso_timestamp'}, {'s': 27, 'v': strftime(o_orderdate, '%-m/%-d/%y'), 'p': 'slash_date'},
  {'s': 32 + strlen(strftime(o_orderdate, '%-m/%-d/%y')), 'v': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ'), 'p': 'iso_8601_tz'}, {'s': 56 + strlen(strftime(o_orderdate, '%-m/%-d/%y')), 'v': strftime(o_orderdate, '%d.%m.%Y'), 'p': 'dot_date'}]) AS r FROM orders)"""
)
def r09_date_time(spark, sf_dir):
    d = F.col("o_orderdate").cast("timestamp")
    parts = ["yyyy-MM-dd HH:mm:ss", "M/d/yy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd.MM.yyyy"]
    a, b, c, e = (F.date_format(d, p) for p in parts)
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("on "), a, F.lit(" or "), F.lit(" "), b, F.lit(" at  "), c, F.lit("    "), e).alias("text"))
    return t.select("o_orderkey", F.explode(R.date_time(F.col("text"), "deterministic_plus")).alias("s")).select("o_orderkey", "s.byte_start", F.col("s.text").alias("value"), "s.pattern")


_TAXONOMY_SQL = "tx AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(sorted(profiles.TAXONOMY.items()))) + f", ({len(profiles.TAXONOMY)}, 'no such', 'unknown')) AS t(i, source_entity, entity))"


@query(f"WITH {_TAXONOMY_SQL} SELECT p_partkey, source_entity, entity, '<' || upper(replace(source_entity, ' ', '_')) || '>' AS placeholder FROM part JOIN tx ON i = p_partkey % {len(profiles.TAXONOMY) + 1}")
def f15_f16_labels(spark, sf_dir):
    names = F.array(*[F.lit(k) for k in sorted(profiles.TAXONOMY)], F.lit("no such"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % (len(profiles.TAXONOMY) + 1)).cast("int")).alias("source_entity"))
    return profiles.map_labels(rows).withColumn("placeholder", X.placeholder(F.col("source_entity")))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 20 AND (p_size - 25) * 1e6 > 1048576 AND p_retailprice > 1000 THEN 'growing' WHEN p_size > 20 AND (p_size - 25) * 1e6 < -1048576 AND p_retailprice < 1000 THEN 'shrinking' ELSE 'stable' END AS trend FROM part"""
)
def a17_trend(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") - 1000).alias("slope"), F.when(F.col("p_size") > 20, 0.9).otherwise(0.1).alias("r2"), ((F.col("p_size") - 25) * 1e6).alias("growth"), F.lit(1e6).alias("baseline"))
    return rows.select("p_partkey", S.trend(F.col("slope"), F.col("r2"), F.col("growth"), F.col("baseline")).alias("trend"))


@query(
    """SELECT c_custkey, r.e AS entity, r.s::INT AS byte_start, r.v AS value FROM (SELECT c_custkey, unnest([{'e': 'title', 's': 0, 'v': 'Dr.'}, {'e': 'person', 's': 4, 'v': seg}, {'e': 'title', 's': 14 + n, 'v': 'Mr.'}, {'e': 'person', 's': 18 + n, 'v': 'John ' || seg},
  {'e': 'street_address', 's': 33 + 2 * n, 'v': num}, {'e': 'street_address', 's': 34 + 2 * n + strlen(num), 'v': 'Main Road'}, {'e': 'location', 's': 45 + 2 * n + strlen(num), 'v': 'Paris'}]) AS r
  FROM (SELECT c_custkey, c_mktsegment[1] || lower(c_mktsegment[2:]) AS seg, strlen(c_mktsegment) AS n, (1 + c_nationkey)::VARCHAR AS num FROM customer))"""
)
def r10_r13_wide_profile(spark, sf_dir):
    name = F.initcap("c_mktsegment")
    text = F.concat(F.lit("Dr. "), name, F.lit(" said hi. Mr. John "), name, F.lit(" lives at "), (1 + F.col("c_nationkey")).cast("string"), F.lit(" Main Road, Paris"))
    found = analyze(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), Options(profile="deterministic_plus", entities=("person", "location", "street_address", "title")))
    return found.select("c_custkey", F.explode("spans").alias("s")).select("c_custkey", "s.entity", "s.byte_start", F.col("s.text").alias("value"))



# --- documents and nested data -----------------------------------------------------------------------------------------

_CAPITALS = "[A-Z][a-z]+"
_SKIPPED = ", ".join(f"'{w}'" for w in E.SKIP_WORDS)


@query(
    f"""WITH {spans_sql(_CAPITALS)}, b AS (SELECT *, CASE WHEN i > 1 AND len(list_filter(string_split_regex(lower(before), '[\\s,.\\-:;()]+'), lambda x: x <> '' AND x NOT IN ({_SKIPPED}))) = 0 THEN 0 ELSE 1 END AS brk FROM s),
c AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b)
SELECT doc_id, count(*) AS merged, sum(n)::BIGINT AS words, sum(e - st)::BIGINT AS bytes FROM (SELECT doc_id, g, count(*) AS n, min(byte_start) AS st, max(byte_end) AS e FROM c GROUP BY ALL) GROUP BY 1"""
)
def j11_merge_skip_words(spark, sf_dir):
    found = F.transform(X.matches(F.col("text"), _CAPITALS), lambda m, i: F.struct(F.lit("word").alias("entity"), m["s"].alias("byte_start"), m["e"].alias("byte_end"), i.alias("at")))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", found.alias("spans")).withColumn("n", F.size("spans")).filter("n > 0").withColumn("merged", E.merge_skip_words(F.col("text"), F.col("spans")))
    return d.select("doc_id", F.size("merged").cast("long").alias("merged"), F.col("n").cast("long").alias("words"), F.aggregate("merged", F.lit(0).cast("long"), lambda a, s: a + s["byte_end"] - s["byte_start"]).alias("bytes"))


@query(
    """SELECT event_id, '{"id": ' || event_id::VARCHAR || ', "type": "[REDACTED]", "password": "[REDACTED]", "list": ["' || event_type || '", {"note": "mail [EMAIL]"}, ' || props || ']}' AS json FROM events WHERE props IS NOT NULL"""
)
def st4_nested_documents(spark, sf_dir):
    """Nested documents made of each event: fields by policy and by name, text leaves by analysis, then nested again."""
    nested = F.concat(
        F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "type": "'), F.col("event_type"), F.lit('", "password": "p", "gone": "x", "list": ["'), F.col("event_type"), F.lit('", {"note": "mail u'), F.col("user_id").cast("string"), F.lit('@x.org"}, '), F.col("props"), F.lit("]}")
    )
    docs = table(spark, sf_dir, "events").filter("props IS NOT NULL").select("event_id", nested.alias("j"))
    policies = {"gone": "drop", "type": ("replace", "[REDACTED]")}
    return ST.renest(ST.redact_leaves(ST.leaves(docs, "j", "event_id"), policies, Options(entities=("email",))), "event_id")


@query(
    f"""WITH {_SPANS_SQL}, t AS (SELECT doc_id, ord, (ord - 1) % 4 AS a, (ord - 1) % 4 + 1 + ord % 3 AS b FROM v)
SELECT doc_id, ord, [0, 5, 9, 20][a + 1] AS char_start, [4, 8, 19, 20][b] AS char_end FROM t WHERE b <= 4 AND [4, 8, 19, 20][b] > [0, 5, 9, 20][a + 1]"""
)
def m20_token_to_char(spark, sf_dir):
    at = (F.col("ord") - 1) % 4
    rows = spans_of(spark, sf_dir).select("doc_id", "ord", at.cast("int").alias("start"), (at + 1 + F.col("ord") % 3).cast("int").alias("end"), F.array(*map(F.lit, (0, 5, 9, 20))).alias("char_starts"), F.array(*map(F.lit, (4, 8, 19, 20))).alias("char_ends"))
    return M.token_to_char(rows).select("doc_id", "ord", "char_start", "char_end")


@query("""SELECT c_custkey, sha256('{"c_custkey":' || c_custkey::VARCHAR || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey::VARCHAR || '}') AS fingerprint FROM customer""")
def f13_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.fingerprint(F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey")).alias("fingerprint"))


@query(
    f"""WITH {_VALUES_SQL}, g AS (SELECT c_custkey, c_nationkey FROM va WHERE {_SSN_GOOD})
SELECT c_custkey, CASE WHEN c_nationkey < 8 THEN 0.85 ELSE 0.425 END::DOUBLE AS score, c_nationkey < 8 AS with_context FROM g"""
)
def c08_context_policies(spark, sf_dir):
    """A policy halves scores below 0.9; words around the value raise them again; spans that need context and have none go."""
    lead = F.when(F.col("c_nationkey") < 8, "my badge is ").when(F.col("c_nationkey") < 16, "number ").otherwise("other ")
    t = values_of(spark, sf_dir).withColumn("text", F.concat(lead, "ssn", F.lit(" ok"))).withColumn("spans", R.all_spans(F.col("text"), R.BASE["us_ssn"]))
    options = C.ContextOptions(policies={"us_ssn": {"lower_below": 0.9, "multiplier": 0.5, "add_words": ["badge"], "min_score": 0.85}})
    after = C.enhance(F.col("text"), F.col("spans"), options)
    return t.select("c_custkey", F.explode(after).alias("s")).select("c_custkey", F.round("s.score", 6).alias("score"), F.col("s.context_matched").isNotNull().alias("with_context"))
