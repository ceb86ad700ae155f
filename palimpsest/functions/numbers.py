"""Numeric functions on columns: overlap, rates, log sums, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common bytes by the bytes of the outer hull."""
    inter = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull == 0, F.lit(0.0)).otherwise(inter / hull)


def precision(tp: Column, fp: Column) -> Column:
    return F.try_divide(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return F.try_divide(tp, tp + fn)


def f_beta(tp: Column, fp: Column, fn: Column, beta: float = 1.0) -> Column:
    """Null where precision or recall is, or both are 0."""
    p, r = precision(tp, fp), recall(tp, fn)
    return F.try_divide((1 + beta * beta) * p * r, beta * beta * p + r)


def log_add_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(xs, lambda x: F.exp(x - top) / total)


def log_softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    total = F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return F.transform(xs, lambda x: x - top - total)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the columns as JSON with sorted keys as given."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def rows_fingerprint(row: Column) -> Column:
    """An aggregate: SHA-256 of all rows' strings in sorted order. For bounded groups (a sample, a document)."""
    return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(row))), 256)
