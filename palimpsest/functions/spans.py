"""The span struct and folds over a document's spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of a detected span. Offsets are bytes; what a step does not use is null.
FIELDS = {
    "entity": "string",
    "byte_start": "int",
    "byte_end": "int",
    "score": "double",
    "text": "string",
    "source_entity": "string",
    "recognizer": "string",
    "pattern": "string",
    "context_words": "array<string>",
    "weak_words": "array<string>",
    "negative_words": "array<string>",
    "negative_reject": "boolean",
    "requires_context": "boolean",
    "context_min_score": "double",
    "model_label": "string",
    "original_score": "double",
    "context_matched": "array<string>",
    "context_strength": "string",
    "conflict_policy": "string",
}
SPAN = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def span(**fields: Column) -> Column:
    """A span struct; fields that are not given are null."""
    return F.struct(*[fields[k].cast(t).alias(k) if k in fields else F.lit(None).cast(t).alias(k) for k, t in FIELDS.items()])


def update(s: Column, **fields: Column) -> Column:
    return F.struct(*[(fields[k].cast(t) if k in fields else s[k]).alias(k) for k, t in FIELDS.items()])


def length(s: Column) -> Column:
    return s["byte_end"] - s["byte_start"]


def overlaps(a: Column, b: Column) -> Column:
    return (a["byte_start"] < b["byte_end"]) & (b["byte_start"] < a["byte_end"])


def let(value: Column, body) -> Column:
    """body(value) with value computed once: an expression that is used in several places would else be written out, and run, in each."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Items in a block of ``running``.
BLOCK = 64


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / BLOCK)).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, start: Column, op, levels: int = 2) -> Column:
    """For each of values, op (associative, with start as its neutral value) of all before it.

    A fold that appends copies its list at each step, so it takes quadratic time; here blocks are summed up, the blocks' results run the same way, and only
    a block is looked at for each item.
    """
    before = lambda all_: F.transform(all_, lambda x, i: F.aggregate(F.slice(all_, F.lit(1), i), start, op))
    if not levels:
        return let(values, before)

    def of(blocks):
        bases = running(F.transform(blocks, lambda b: F.aggregate(b, start, op)), start, op, levels - 1)
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(before(b), lambda x: op(base, x))))

    return let(values, lambda all_: let(_blocks(all_), of))


def cut_at(items: Column, begins) -> Column:
    """items as consecutive lists: begins(item, i, items) says where a new one begins (the first always does)."""
    def of(all_):
        starts = F.filter(F.transform(all_, lambda x, i: F.when((i == 0) | begins(x, i, all_), i + 1)), lambda i: i.isNotNull())
        return let(starts, lambda b: F.transform(b, lambda at, k: F.slice(all_, at, F.coalesce(F.get(b, k + 1), F.size(all_) + 1) - at)))

    return let(items, of)


def sort_by(spans: Column, key) -> Column:
    """spans in the order of key(span), a list of columns, then of their place."""
    keyed = F.transform(spans, lambda s, i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(key(s))], i.alias("at"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def in_order(spans: Column) -> Column:
    return sort_by(spans, lambda s: [s["byte_start"], s["byte_end"], s["entity"]])


def by_run(spans: Column, body) -> Column:
    """body(run) for each run of spans that overlap or touch one after the other, in the order of the runs. What only concerns overlapping spans looks at one run, not at all spans."""
    def runs(ordered):
        far = running(F.transform(ordered, lambda s: s["byte_end"]), F.lit(-1).cast("int"), lambda a, x: F.greatest(a, x), levels=1)
        cut = cut_at(F.zip_with(ordered, far, lambda s, end: F.struct(s.alias("s"), (s["byte_start"] > end).alias("begins"))), lambda x, i, _: x["begins"])
        return F.flatten(F.transform(cut, lambda run: body(F.transform(run, lambda x: x["s"]))))

    return let(sort_by(spans, lambda s: [s["byte_start"], s["byte_end"]]), runs)


def greedily(run: Column, key, clash=overlaps) -> Column:
    """From first to last by key(span), then place in the list, a span stays if it clashes with none that stayed."""
    return F.aggregate(sort_by(run, key), no_spans(), lambda kept, s: F.when(F.exists(kept, lambda k: clash(s, k)), kept).otherwise(F.array_append(kept, s)))


def keep_greedily(spans: Column, key, clash=overlaps) -> Column:
    """``greedily``, where only spans that overlap or touch may clash."""
    return by_run(spans, lambda run: greedily(run, key, clash))


def keep_longest(spans: Column) -> Column:
    return in_order(keep_greedily(spans, lambda s: [-length(s), s["byte_start"], s["byte_end"]]))
