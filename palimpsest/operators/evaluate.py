"""Scoring predicted spans against gold spans, by sample and over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.numbers import f_beta, iou, precision, recall
from palimpsest.functions.spans import cut_at, let
from palimpsest.functions.text import bytes_slice, length_bucket, token_shape, utf8

SKIP_WORDS = ("and", "at", "de", "del", "in", "la", "of", "the")
_PAIR = "struct<entity:string,byte_start:int,byte_end:int,at:int>"


def arrays(rows: DataFrame, name: str, key: str = "sample_id") -> DataFrame:
    """key, name: the spans of a sample in order of ``ord``, with their places. A sample is bounded by its text."""
    spans = F.transform(F.array_sort(F.collect_list(F.struct("ord", "entity", "byte_start", "byte_end"))), lambda s, i: F.struct(s["entity"].alias("entity"), s["byte_start"].cast("int").alias("byte_start"), s["byte_end"].cast("int").alias("byte_end"), i.alias("at")))
    return rows.groupBy(key).agg(spans.alias(name))


def _overlap(a: Column, b: Column) -> Column:
    return iou(a["byte_start"], a["byte_end"], b["byte_start"], b["byte_end"])


def _exact(a: Column, b: Column) -> Column:
    return (a["entity"] == b["entity"]) & (a["byte_start"] == b["byte_start"]) & (a["byte_end"] == b["byte_end"])


def _greedy(state: Column, test) -> Column:
    """state: struct(gold, pred, n). Each gold span in order takes the first prediction that passes; both leave their lists."""
    none = F.array().cast(f"array<{_PAIR}>")
    start = F.struct(none.alias("gold"), state["pred"].alias("pred"), F.lit(0).alias("n"))

    def step(acc, g):
        hit = F.array_min(F.transform(F.filter(acc["pred"], lambda p: test(g, p)), lambda p: p["at"]))
        return let(hit, lambda h: F.when(h.isNull(), F.struct(F.array_append(acc["gold"], g).alias("gold"), acc["pred"].alias("pred"), acc["n"].alias("n"))).otherwise(
            F.struct(acc["gold"].alias("gold"), F.filter(acc["pred"], lambda p: p["at"] != h).alias("pred"), (acc["n"] + 1).alias("n"))))

    return F.aggregate(state["gold"], start, step)


def score_samples(samples: DataFrame) -> DataFrame:
    """samples(..., gold, pred) with tp, offset_mismatches, wrong_entity, fp, fn: exact matches first, then same entity with overlap, then other entity with overlap; what is left is false."""
    none = F.array().cast(f"array<{_PAIR}>")
    base = F.struct(F.coalesce("gold", none).alias("gold"), F.coalesce("pred", none).alias("pred"))
    rows = samples.withColumn("_e", _greedy(base, _exact))
    rows = rows.withColumn("_o", _greedy(F.col("_e"), lambda g, p: (g["entity"] == p["entity"]) & (_overlap(g, p) > 0) & ~_exact(g, p)))
    rows = rows.withColumn("_w", _greedy(F.col("_o"), lambda g, p: (g["entity"] != p["entity"]) & (_overlap(g, p) > 0)))
    return rows.withColumns({"tp": F.col("_e.n"), "offset_mismatches": F.col("_o.n"), "wrong_entity": F.col("_w.n"), "fn": F.size("_w.gold"), "fp": F.size("_w.pred"), "missed": F.col("_w.gold"), "spurious": F.col("_w.pred")}).drop("_e", "_o", "_w")


def ratios(rows: DataFrame) -> DataFrame:
    """precision, recall, f1, f2 of summed counts; null on 0 by 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f_beta(tp, fp, fn), "f2": f_beta(tp, fp, fn, 2.0)})


def corpus_scores(scored: DataFrame, *by: str) -> DataFrame:
    """Counts summed over samples (by template, say), and their ratios."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "offset_mismatches", "wrong_entity")]
    return ratios((scored.groupBy(*by) if by else scored.groupBy()).agg(*sums, F.count("*").alias("samples")))


def exact_counts(gold: DataFrame, pred: DataFrame, *by: str, key: str = "sample_id") -> DataFrame:
    """tp, fp, fn of exact matches (by entity, say), as an equi-join that pairs repeated spans one to one."""
    number = lambda d: d.withColumn("_n", F.row_number().over(Window.partitionBy(key, "entity", "byte_start", "byte_end").orderBy("ord")))
    keys = [key, "entity", "byte_start", "byte_end", "_n"]
    both = number(gold).select(*keys, F.lit(1).alias("g")).join(number(pred).select(*keys, F.lit(1).alias("p")), keys, "full")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    return (both.groupBy(*by) if by else both.groupBy()).agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def iou_samples(samples: DataFrame, limit: float = 0.9) -> DataFrame:
    """samples with iou_tp, iou_wrong, iou_fn, iou_fp: each gold span takes the unused prediction of its entity with the highest overlap, else of another entity, from ``limit`` on."""
    none = F.array().cast(f"array<{_PAIR}>")
    start = F.struct(F.coalesce("pred", none).alias("left"), F.lit(0).alias("tp"), F.lit(0).alias("wrong"), F.lit(0).alias("fn"))

    def best(g, preds):
        ranked = F.array_sort(F.transform(preds, lambda p: F.struct((-_overlap(g, p)).alias("o"), p["at"].alias("at"), p.alias("p"))))
        return let(F.filter(ranked, lambda r: -r["o"] >= limit), lambda r: F.when(F.size(r) > 0, F.get(r, F.lit(0))["p"]))

    def without(left, p):
        return F.filter(left, lambda x: ~_exact(x, p))

    def step(acc, g):
        same = best(g, F.filter(acc["left"], lambda p: p["entity"] == g["entity"]))
        other = best(g, F.filter(acc["left"], lambda p: p["entity"] != g["entity"]))
        state = lambda left, a, b, c: F.struct(left.alias("left"), (acc["tp"] + a).alias("tp"), (acc["wrong"] + b).alias("wrong"), (acc["fn"] + c).alias("fn"))
        return let(F.struct(same.alias("s"), other.alias("o")), lambda m: F.when(m["s"].isNotNull(), state(without(acc["left"], m["s"]), 1, 0, 0)).when(m["o"].isNotNull(), state(without(acc["left"], m["o"]), 0, 1, 0)).otherwise(state(acc["left"], 0, 0, 1)))

    rows = samples.withColumn("_i", F.aggregate(F.coalesce("gold", none), start, step))
    return rows.withColumns({"iou_tp": F.col("_i.tp"), "iou_wrong": F.col("_i.wrong"), "iou_fn": F.col("_i.fn"), "iou_fp": F.size("_i.left")}).drop("_i")


def merge_skip_words(text: Column, spans: Column, words: tuple[str, ...] = SKIP_WORDS) -> Column:
    """Spans of one entity with only punctuation, blanks or skip words between become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["entity"].alias("entity"), s["byte_start"].alias("byte_start"), s["byte_end"].alias("byte_end"), s["at"].alias("at"))))

    def merged(data):
        def begins(s, i, all_):
            before = F.get(all_, i - 1)
            between = F.lower(bytes_slice(data, before["byte_end"], s["byte_start"]))
            parts = F.filter(F.split(between, r"(?U)[\s,.\-:;()]+"), lambda w: w != "")
            return ~F.coalesce((before["entity"] == s["entity"]) & (before["byte_end"] <= s["byte_start"]) & F.forall(parts, lambda w: w.isin(*words)), F.lit(False))

        first, last = (lambda run: F.element_at(run, 1)), (lambda run: F.element_at(run, -1))
        one = lambda run: F.struct(first(run)["entity"].alias("entity"), first(run)["byte_start"].alias("byte_start"), last(run)["byte_end"].alias("byte_end"), first(run)["at"].alias("at"))
        return F.transform(cut_at(ordered, begins), one)

    return let(utf8(text), merged)


def likely_cause(entity: Column, value: Column, kind: str) -> Column:
    """A coarse reason for an error, for counting."""
    return F.when(F.lit(kind) == "fn", F.when(value.rlike(r"^[0-9 .()+-]+\z"), "numeric_format").when(value.rlike(r"\p{L}+ \p{L}+"), "multi_word_value").otherwise("unmatched_value")).otherwise(F.when(value.rlike("[0-9]"), "ambiguous_number").otherwise("ambiguous_text"))


def error_buckets(errors: DataFrame, examples: int = 5) -> DataFrame:
    """errors(entity, kind, value) -> entity, kind, cause, count, and the shapes of a few values (never the values)."""
    cause = F.when(F.col("kind") == "fn", likely_cause(F.col("entity"), F.col("value"), "fn")).otherwise(likely_cause(F.col("entity"), F.col("value"), "fp"))
    rows = errors.select("entity", "kind", cause.alias("cause"), token_shape(F.col("value")).alias("shape"))
    ranked = rows.groupBy("entity", "kind", "cause", "shape").agg(F.count("*").alias("n"))
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("entity", "kind", "cause").orderBy(F.desc("n"), "shape")))
    return top.groupBy("entity", "kind", "cause").agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("shape")))).alias("shapes"))


def confusion(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    return rows.groupBy(expected, predicted).agg(F.count("*").alias("n"))


def top_signatures(errors: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent (entity, kind, length bucket, shape); ties by key."""
    rows = errors.select("entity", "kind", length_bucket(F.length("value")).alias("length"), token_shape(F.col("value")).alias("shape"))
    return rows.groupBy("entity", "kind", "length", "shape").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity", "kind", "length", "shape").limit(k)


def sweep(spans: DataFrame, gold: DataFrame, thresholds: list[float], key: str = "sample_id") -> DataFrame:
    """precision, recall and F1 of exact matches at each threshold on the score, and whether it is the best. The thresholds are a stated list; a span counts for all those below its score."""
    keys = [key, "entity", "byte_start", "byte_end"]
    hits = spans.join(gold.select(*keys, F.lit(1).alias("_g")).distinct(), keys, "left")
    total = gold.select(*keys).distinct().agg(F.count("*").alias("_total"))
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: t <= F.col("score"))
    counts = hits.select("_g", F.explode(reached).alias("threshold")).groupBy("threshold").agg(F.count("_g").alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"))
    all_ = gold.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double").join(counts, "threshold", "left").fillna(0, ["tp", "fp"])
    rows = ratios(all_.crossJoin(F.broadcast(total)).withColumn("fn", F.col("_total") - F.col("tp")).drop("_total"))
    best = F.row_number().over(Window.orderBy(F.desc_nulls_last("f1"), "threshold"))
    return rows.withColumn("best", best == 1)


def template_split(samples: DataFrame, ratio: float = 0.7, column: str = "template_id") -> DataFrame:
    """samples with split: the first floor(n * ratio) distinct templates, at least one and not all, are train."""
    ids = samples.select(column).distinct().withColumn("_r", F.row_number().over(Window.orderBy(column))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * ratio), F.col("_n") - 1))
    return samples.join(ids.select(column, F.when(F.col("_r") <= cut, "train").otherwise("held_out").alias("split")), column)


def interleave(rows: DataFrame, dataset: str, order: str) -> DataFrame:
    """Rows of several data sets in turn."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(dataset).orderBy(order))).orderBy("turn", dataset)


def frequencies(spans: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    return spans.groupBy("entity").agg(F.count("*").alias("n")).withColumn("supported", F.col("entity").isin(*supported))
