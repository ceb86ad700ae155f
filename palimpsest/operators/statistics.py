"""Percentiles, histograms, trends and windows over measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the latency histogram: below a limit in microseconds, the width of a bucket.
BUCKETS = ((1_000, 10), (10_000, 50), (100_000, 500), (1_000_000, 5_000))
WIDEST = 50_000
MIB = 1 << 20


#: Ranges into which the values of a group are dealt to find a rank; one range for each point is sorted.
RANGES = 256


def _on(by: tuple[str, ...], left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the row of right for its group (a null is a group too). right has a row for each group, or a few."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(by)})
    same = [left[c].eqNullSafe(named[f"_k{i}"]) for i, c in enumerate(by)]
    return left.join(named, same).drop(*[f"_k{i}" for i in range(len(by))])


def values_at(df: DataFrame, value: str, indexes, *by: str) -> DataFrame:
    """by, i0, i1 ...: the values at some places of each group's sorted values. indexes: the places, from 0, as functions of the number of values.

    No group is sorted as a whole: approximate quantiles deal its values into RANGES ranges, the counts of the ranges say in which a place is, and only those ranges are ranked.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cuts = rows.groupBy(*by).agg(F.percentile_approx(F.col("_v").cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    dealt = _on(by, rows, cuts).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col("_v").cast("double")))).drop("_cuts")
    sizes = dealt.groupBy(*by, "_r").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    sizes = sizes.withColumn("_end", F.sum("_n").over(w.orderBy("_r"))).withColumn("_total", F.sum("_n").over(w))  # RANGES rows of a group
    places = F.array(*[f(F.col("_total")).cast("long") for f in indexes])
    wanted = sizes.select(*by, F.col("_r").alias("_wr"), (F.col("_end") - F.col("_n")).alias("_begin"), F.filter(F.transform(places, lambda at, k: F.struct(k.alias("k"), at.alias("at"))), lambda x: (x["at"] >= F.col("_end") - F.col("_n")) & (x["at"] < F.col("_end"))).alias("_places"))
    wanted = wanted.filter(F.size("_places") > 0)
    found = _on(by, dealt, wanted).filter("_r = _wr")
    found = found.withColumn("_i", F.col("_begin") + F.row_number().over(Window.partitionBy(*by, "_r").orderBy("_v")) - 1)
    hits = found.select(*by, "_v", F.explode(F.filter("_places", lambda x: x["at"] == F.col("_i"))).alias("_x"))
    return hits.groupBy(*by).agg(*[F.max(F.when(F.col("_x.k") == k, F.col("_v"))).alias(f"i{k}") for k in range(len(indexes))])


def percentile_by_index(df: DataFrame, value: str, points: list[float], *by: str) -> DataFrame:
    """The sorted value at index ceil((n - 1) * p), for numeric values."""
    found = values_at(df, value, [lambda n, p=p: F.ceil((n - 1) * p) for p in points], *by)
    return found.select(*by, *[F.col(f"i{k}").alias(f"p{round(p * 100)}") for k, p in enumerate(points)])


def nearest_rank(value: str, p: float) -> Column:
    """Nearest rank, as an aggregate: the value at max(1, ceil(p * n))."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")


def bucket_bound(micros: Column) -> Column:
    """The upper bound of a latency's bucket."""
    up = lambda width: (F.ceil(F.greatest(micros, F.lit(1)) / width) * width).cast("long")
    out = up(WIDEST)
    for limit, width in reversed(BUCKETS):
        out = F.when(micros <= limit, up(width)).otherwise(out)
    return out


def histogram(df: DataFrame, micros: str, *by: str) -> DataFrame:
    """by, bucket, n. Two histograms merge by summing n."""
    return df.groupBy(*by, bucket_bound(F.col(micros)).alias("bucket")).agg(F.count("*").alias("n"))


def merge_histograms(histograms: DataFrame, *by: str) -> DataFrame:
    return histograms.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def histogram_percentiles(h: DataFrame, points: list[float], *by: str) -> DataFrame:
    """Upper bounds of the buckets that hold the nearest ranks. A histogram has few rows whatever it counts."""
    w = Window.partitionBy(*by)
    rows = h.withColumn("_c", F.sum("n").over(w.orderBy("bucket"))).withColumn("_t", F.sum("n").over(w))
    return rows.groupBy(*by).agg(*[F.min(F.when(F.col("_c") >= F.greatest(F.lit(1), F.ceil(F.col("_t") * p)), F.col("bucket"))).alias(f"p{round(p * 100)}") for p in points])


def throughput(n: Column, seconds: Column) -> Column:
    return F.try_divide(n, seconds)


def pearson(x: str, y: str) -> Column:
    """Null where either has no variance."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.corr(x, y))


def regression(x: str, y: str) -> tuple[Column, Column, Column]:
    """slope, intercept, r2 as aggregates; r2 is 1 without variance of y, and never below 0."""
    slope, intercept = F.regr_slope(y, x), F.regr_intercept(y, x)
    r2 = F.when(F.var_pop(y) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.regr_r2(y, x)))
    return slope, intercept, r2


def trend(slope: Column, r2: Column, growth: Column, baseline: Column) -> Column:
    """growing, shrinking or stable, with a noise budget of 1 MiB or 0.1 % of the baseline."""
    budget = F.greatest(F.lit(float(MIB)), baseline * 0.001)
    return F.when((growth > budget) & (slope > 0) & (r2 >= 0.5), "growing").when((growth < -budget) & (slope < 0) & (r2 >= 0.5), "shrinking").otherwise("stable")


def halves(df: DataFrame, order: str, *by: str) -> DataFrame:
    """df with half 1 or 2, split at max(1, n div 2) in the order of a numeric column; rows of a group that are equal in it and stand on the split are dealt in any order."""
    first = lambda n: F.greatest(F.lit(1), F.floor(n / 2))
    cut = values_at(df, order, [lambda n: first(n) - 1], *by).withColumnRenamed("i0", "_cut")
    rows = _on(by, df, cut)
    at = F.col(order)
    counts = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(at < F.col("_cut")).alias("_less"))
    rows = _on(by, rows, counts)
    tie = F.row_number().over(Window.partitionBy(*by, order).orderBy(order))
    return rows.withColumn("half", F.when(at < F.col("_cut"), 1).when(at > F.col("_cut"), 2).when(tie <= first(F.col("_n")) - F.col("_less"), 1).otherwise(2)).drop("_cut", "_n", "_less")


def drift(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Mean of the second half by that of the first."""
    return halves(df, order, *by).groupBy(*by).agg(F.try_divide(F.avg(F.when(F.col("half") == 2, F.col(value))), F.avg(F.when(F.col("half") == 1, F.col(value)))).alias("drift"))


def mean_of_repetitions(df: DataFrame, repetition: str, value: str, p: float, fingerprint: str, *by: str) -> DataFrame:
    """The mean over repetitions of a percentile, and whether all have one output fingerprint."""
    each = df.groupBy(*by, repetition).agg(nearest_rank(value, p).alias("_p"), F.min(fingerprint).alias("_f"), F.max(fingerprint).alias("_g"))
    return each.groupBy(*by).agg(F.avg("_p").alias("mean_percentile"), ((F.count_distinct("_f") == 1) & (F.max("_g") == F.min("_f"))).alias("stable_output"))


def tumbling(df: DataFrame, seconds: Column, size: int, value: str, *by: str, complete: float = 0.0) -> DataFrame:
    """by, window (from the start of each series), n, mean; windows shorter than ``complete`` of their size can be left out."""
    start = df.groupBy(*by).agg(F.min(seconds).alias("_start")) if by else df.agg(F.min(seconds).alias("_start"))
    rows = (df.withColumn("_s", seconds).join(F.broadcast(start) if not by else start, list(by)) if by else df.withColumn("_s", seconds).crossJoin(F.broadcast(start))).withColumn("_e", F.col("_s") - F.col("_start"))
    out = rows.groupBy(*by, F.floor(F.col("_e") / size).cast("long").alias("window")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.max("_e") - F.min("_e")).alias("_span"))
    return out.filter(F.col("_span") >= complete * size).drop("_span")


def rolling_median(df: DataFrame, value: str, order: str, *by: str, size: int = 60) -> DataFrame:
    """The nearest-rank median of the last ``size`` rows, full frames only. A series is ordered in one task: deal long ones into parts that overlap by ``size`` rows."""
    w = Window.partitionBy(*by).orderBy(order)
    frame = F.array_sort(F.collect_list(value).over(w.rowsBetween(-size + 1, 0)))
    rows = df.withColumn("_n", F.row_number().over(w)).withColumn("median", F.get(frame, F.lit(-(-size // 2) - 1)))
    return rows.filter(F.col("_n") >= size).drop("_n")


def degrading(df: DataFrame, value: str, order: str, *by: str, limit: float = 0.15) -> DataFrame:
    """by, first, last, delta, growth and whether it reaches the limit."""
    ends = df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"))
    growth = F.try_divide(F.col("last") - F.col("first"), F.abs("first"))
    return ends.withColumns({"delta": F.col("last") - F.col("first"), "growth": growth, "degrading": F.coalesce(growth >= limit, F.lit(False))})
