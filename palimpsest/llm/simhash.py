"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: the text with A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined by one
space (all words where there are fewer, none for no word), XXH64 with seed 42 of each shingle's UTF-8, repeats counted.
A bit is 1 if it is set in more than half of the hashes. No words, or a null text: fingerprint zero, linked like any other.

Links: fingerprints that differ in ``radius`` bits or fewer. Copies share a fingerprint, so all later work is on distinct
fingerprints. A pair within ``radius`` agrees on at least one of ``radius + 1`` disjoint segments, hence each segment
value is a search space of its own, spread by hash over the cluster. In each search space the fingerprints are sorted by
Gray rank; every eight neighbours form a node that keeps the bits which all of them share; eight nodes form the next one, up to
the root. A search goes down from the root, adds the differences on the bits that a node shares beyond its parent's, and drops the whole
group when the sum is over ``radius``. A space with more than ``limit`` fingerprints is split again by the same rule on
its free bits until it is small or has no free bits beyond ``radius`` a segment, so that no key grows with the data.

Defined results: null doc_id stays a row, and a component of null ids only has a null id; repeated rows give equal rows;
equal texts always share a component; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import batch, bounded_batches, discard, materialize, tidy

SEED = 42
WIDTH = 3
RADIUS = 2
#: Fingerprints in one search space before it is split.
LIMIT = 1024
FANOUT = 8

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hashes of the shingles of one text in order, repeats included."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    width = min(width, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())), np.uint64, n - width + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _HASHES_AT_ONCE):
        bits += np.unpackbits(hashes[at : at + _HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash (64 bits), fp (the fingerprint as a signed long)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, width) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield batch(schema, doc_id=b.column("doc_id"), text_hash=b.column("text_hash"), fp=fps.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, text_hash long, fp long")


# --- the index over one set of search spaces -------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the reflected Gray sequence."""
    x = x.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Search trees over the fingerprints of several spaces; ``space`` is a dense number for each fingerprint."""

    def __init__(self, fps: np.ndarray, space: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(fps), space))
        self.order, self.fps, self.space = order, fps[order].astype(np.uint64), space[order]
        ones = np.full(len(fps), np.uint64(0xFFFFFFFFFFFFFFFF))
        #: From the leaves to the roots: value, shared bits, space, first child in the level below.
        self.levels = [(self.fps, ones, self.space, np.arange(len(fps) + 1))]
        while len(self.levels[-1][2]) > len(np.unique(self.levels[-1][2])):
            value, mask, sp, _ = self.levels[-1]
            new = np.concatenate(([True], sp[1:] != sp[:-1]))
            first_of_space = np.maximum.accumulate(np.where(new, np.arange(len(sp)), 0))
            starts = np.flatnonzero((np.arange(len(sp)) - first_of_space) % fanout == 0)
            low, high = np.bitwise_and.reduceat(value, starts), np.bitwise_or.reduceat(value, starts)
            shared = np.bitwise_and.reduceat(mask, starts) & ~(low ^ high)
            self.levels.append((low & shared, shared, sp[starts], np.append(starts, len(sp))))
        self.visited = [0] * len(self.levels)

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Indexes of queries and of the sorted fingerprints that they meet; roots: the number of each query's space. Adds to ``visited``, the nodes that were looked at by level."""
        value, mask, _, _ = self.levels[-1]
        self.visited[-1] += len(queries)
        q, node = np.arange(len(queries)), roots
        seen = mask[node]
        far = np.bitwise_count((queries ^ value[node]) & seen).astype(np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            near = far <= radius
            q, node, far = q[near], node[near], far[near]
            child, parent_mask = self.levels[depth][3], self.levels[depth][1][node]
            count = child[node + 1] - child[node]
            at = np.repeat(np.arange(len(q)), count)
            offset = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            below = child[node][at] + offset
            value, mask, _, _ = self.levels[depth - 1]
            far = far[at] + np.bitwise_count((queries[q[at]] ^ value[below]) & mask[below] & ~parent_mask[at])
            q, node = q[at], below
            self.visited[depth - 1] += len(node)
        near = far <= radius
        return q[near], node[near]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a class) after the classes of a[i] and b[i] are united."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = label[label]
            if (shorter == label).all():
                break
            label = shorter
    return label


def linked_classes(fps: np.ndarray, space: np.ndarray, radius: int = RADIUS, at_once: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that have a link in their space, and the smallest member of their class there.

    at_once: searches side by side; each holds a space's nodes at most, so this bounds the memory.
    """
    index = GrayIndex(fps, space)
    label = np.arange(len(fps))
    roots = np.searchsorted(index.levels[-1][2], index.space)
    for at in range(0, len(fps), at_once):
        q, found = index.search(index.fps[at : at + at_once], roots[at : at + at_once], radius)
        q = q + at
        label = merge_labels(label, q[q < found], found[q < found])
    member = np.flatnonzero(np.bincount(label, minlength=len(fps))[label] > 1)
    order = np.argsort(label[member], kind="stable")
    member = member[order]
    signed = index.fps[member].view(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(label[member]) != 0))) if len(member) else np.array([], int)
    least = np.minimum.reduceat(signed, starts) if len(member) else signed
    return signed, np.repeat(least, np.diff(np.append(starts, len(member))))


def segments(bits: list[int], parts: int) -> list[list[int]]:
    """bits dealt in order into ``parts`` runs of nearly equal length."""
    cut = [len(bits) * i // parts for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def search_spaces(distinct: DataFrame, radius: int, limit: int) -> DataFrame:
    """fp, fixed (the bits that the space fixes), value (their value): every space whose size is in 2..limit, or that cannot be split."""
    whole = list(range(64))
    frontier = distinct.select("fp")
    masks = [_mask(p) for p in segments(whole, radius + 1)]
    spaces = frontier.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("fixed"))
    spaces = spaces.withColumn("value", F.col("fp").bitwiseAND(F.col("fixed")))
    sizes = spaces.groupBy("fixed", "value").agg(F.count("*").alias("n"))
    # A space of n > limit: the same rule on its free bits. The rule for every mask that can occur is known beforehand.
    done = None
    while True:
        large = materialize(sizes.filter(F.col("n") > limit).select(F.col("fixed").alias("f"), F.col("value").alias("v")), "large_spaces")
        found = [r.f for r in large.select("f").distinct().collect()]  # masks, of which there are few whatever the data
        split = {f: [f | _signed(_mask(p)) for p in segments([b for b in whole if not (f & ((1 << 64) - 1)) >> b & 1], radius + 1)] for f in found}
        split = {f: [_signed(m & ((1 << 64) - 1)) for m in ms] for f, ms in split.items() if bin(f & ((1 << 64) - 1)).count("1") + radius + 1 < 64}
        if not split:
            return spaces if done is None else done.unionByName(spaces)
        large = large.filter(F.col("f").isin(list(split)))
        on = (spaces.fixed == large.f) & (spaces.value == large.v)
        kept = spaces.join(large, on, "left_anti")
        done = kept if done is None else done.unionByName(kept)
        rule = F.create_map(*[x for f, ms in split.items() for x in (F.lit(f), F.array(*map(F.lit, ms)))])
        spaces = materialize(spaces.join(large, on).select("fp", F.explode(rule[F.col("fixed")]).alias("fixed")).withColumn("value", F.col("fp").bitwiseAND(F.col("fixed"))), "split_spaces")
        sizes = spaces.groupBy("fixed", "value").agg(F.count("*").alias("n"))


def local_links(distinct: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """a, b: each fingerprint that has a link in some space, with the smallest member of its class there."""
    bounded_batches(distinct.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(parts):
        fps = np.concatenate([p[0] for p in parts]).view(np.uint64)
        keys = np.stack([np.concatenate([p[i] for p in parts]) for i in (1, 2)])
        new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        space = np.cumsum(new) - 1
        many = np.bincount(space)[space] > 1
        space = space[many]
        a, b = linked_classes(fps[many], np.unique(space, return_inverse=True)[1], radius) if many.any() else (np.array([], np.int64),) * 2
        differ = a != b
        return batch(schema, a=a[differ], b=b[differ])

    def run(batches):
        held, rows = [], 0
        for x in batches:
            part = [c.to_numpy(zero_copy_only=False) for c in x.columns]
            if rows >= 1 << 16:  # everything before the last space that began is whole
                begun = np.flatnonzero((part[1][1:] != part[1][:-1]) | (part[2][1:] != part[2][:-1])) + 1
                if held[-1][1][-1] != part[1][0] or held[-1][2][-1] != part[2][0]:
                    begun = np.concatenate(([0], begun))
                if len(begun):
                    cut = begun[-1]
                    yield links(held + [[c[:cut] for c in part]])
                    held, rows, part = [], 0, [c[cut:] for c in part]
            held.append(part)
            rows += len(part[0])
        if rows:
            yield links(held)

    spaces = search_spaces(distinct, radius, limit)
    return spaces.repartition("fixed", "value").sortWithinPartitions("fixed", "value").mapInArrow(tidy(run), "a long, b long").distinct()


# --- connected components --------------------------------------------------------------------------------------------


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """Edges u, v with m, the least of u and its neighbours. The join key is ~u, so that both sides are dealt by it and a hub can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("nu"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.bitwise_not(pairs.u) == least.nu).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) for the nodes of edges(a, b): large-star and small-star steps until nothing changes."""
    stars = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = of(stars)  # edges to the least member of each class are stars already
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _least_neighbour(lower)
        last, stars = stars, materialize(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct(), "stars")
        discard(last)
        state = of(stars)
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links)."""
    return _grouped(docs, width, radius, limit).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Of the rows of docs, with their columns, one for each component: the one with the smallest doc_id (a null only where all are), then text hash."""
    return first_of_each(docs, _grouped(docs, width, radius, limit))


def first_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of docs for each root of grouped(doc_id, text_hash, root).

    The texts are dealt once, for the join. Only rows that repeat an id and a text are numbered, if there are any: first in parts, then the first of each part, so that no task holds all rows of a text.
    """
    key = ["id", "none", "hash"]
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = grouped.groupBy("root").agg(F.min(order).alias("x"))
    first = first.select(F.coalesce("x.doc_id", F.lit(0)).alias("id"), F.col("x.none").alias("none"), F.col("x.text_hash").alias("hash"))
    named = grouped.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.col("text_hash").alias("hash"))
    repeated = materialize(named.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").join(first, key, "left_semi").select(*key), "repeated_rows")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"))
    kept = rows.join(first, key, "left_semi")
    if repeated.isEmpty():
        return kept.select("row.*")
    many = rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(64))).join(repeated, key, "left_semi")
    one = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("part"))
    many = many.withColumn("n", one("part", *key)).filter("n = 1").withColumn("n", one(*key)).filter("n = 1")
    return kept.join(repeated, key, "left_anti").select("row.*").unionByName(many.select("row.*"))


def _grouped(docs: DataFrame, width: int, radius: int, limit: int) -> DataFrame:
    """doc_id, text_hash, fp, root (the least fingerprint of the component), component_id."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    roots = components(local_links(distinct, radius, limit))
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    named = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id")).select(F.bitwise_not("root").alias("nr"), "component_id")
    of = named.join(ids, F.bitwise_not(named.root) == ids.nr).select(F.bitwise_not("fp").alias("nf"), "root", "component_id")
    of = materialize(of, "component_of_fingerprint")
    return fps.join(of, F.bitwise_not(fps.fp) == of.nf).select("doc_id", "text_hash", "fp", "root", "component_id")
