"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words: A-Z lower-cased, then runs of digits, a-z and code points from U+0080. A window is ``width`` consecutive words of an
item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

The search works on word numbers instead of characters: only the items' words have one, and any other word lets the
search skip past it. Memory: about 150 bytes a word of a block. Windows of equal length form one group with m words a window; a block is its last two words (one where m
is 1). The shift table says for each block how far its last place in a window is from the end, so that a block that no
window holds skips m - 1 places. Where the shift is zero, the bucket of that suffix block, then the pair of first words,
select the windows that are compared word by word.

The items are a stated set: they are dealt into blocks of about ``block_bytes`` of text. A block's texts are broadcast, each worker makes its tables once, and all
documents are searched for it. So no size of the benchmark is broadcast unchecked. One block, the usual case, is one pass. With more, the documents are
numbered and written once, each pass reads them and keeps what it found (number, spans and items of the documents that have any), and that is merged and joined at the end.

Defined results: a null or wordless text has no words, no hits and is not contaminated; an item with a null id makes hits but is not
listed; equal items are listed by each id; rows that repeat give equal rows; very long texts are searched whole; empty tables give no hits or no rows; of the benchmark item_id and text are read, of the
documents doc_id and text, and ``without_contaminated`` returns all their columns, whatever they are called.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palimpsest.llm.common import bounded_batches, materialize, tidy

WIDTH = 10
#: Text of items whose tables are sent to the tasks at a time.
BLOCK_BYTES = 8 << 20

_words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _words(text.translate(_LOWER)) if text else []


class WuManber:
    """Windows of one length m: rows of word numbers, and the items of each. Tables are by block (two numbers as one) and hold numbers only."""

    def __init__(self, windows: np.ndarray, owners: np.ndarray, length: int):
        self.m = length
        order = np.lexsort((owners, *windows.T[::-1]))
        windows, owners = windows[order], owners[order]
        new = np.concatenate(([True], (windows[1:] != windows[:-1]).any(axis=1)))
        starts = np.flatnonzero(new)
        #: Distinct windows; first owner of each in owners (those of one window stand together).
        windows, self.owners, self.first = windows[starts], owners, np.append(starts, len(owners))
        self.block = min(2, length)
        blocks = [self._blocks(windows, end) for end in range(self.block, length + 1)]
        #: shift: how far a block's last place in a window is from the end.
        keys, shifts = np.concatenate(blocks), np.repeat(np.arange(length - self.block, -1, -1), len(windows))
        order = np.lexsort((shifts, keys))
        keys, shifts = keys[order], shifts[order]
        least = np.concatenate(([True], keys[1:] != keys[:-1]))
        self.shift = dict(zip(keys[least].tolist(), shifts[least].tolist()))
        #: bucket: the windows of a suffix block, in the order of their first block: place and end in self.rows.
        head, tail = self._blocks(windows, self.block), blocks[-1]
        by = np.lexsort((head, tail))
        self.rows, self.head, self.tail, self.number = windows[by], head[by], tail[by], by
        cuts = np.flatnonzero(np.concatenate(([True], self.tail[1:] != self.tail[:-1])))
        self.bucket = dict(zip(self.tail[cuts].tolist(), zip(cuts.tolist(), np.append(cuts[1:], len(self.tail)).tolist())))

    def _blocks(self, windows: np.ndarray, end: int) -> np.ndarray:
        last = windows[:, end - 1].astype(np.int64)
        return last if self.block == 1 else (windows[:, end - 2].astype(np.int64) << 32) | last

    def search(self, ids: list[int]):
        """(end, number of the window) of each occurrence; ids has -1 for a word that no item has."""
        m, block, shift, bucket = self.m, self.block, self.shift.get, self.bucket
        far = m - block + 1
        at, n = m, len(ids)
        while at <= n:
            if ids[at - 1] < 0:
                at += m
                continue
            key = ids[at - 2] << 32 | ids[at - 1] if block == 2 else ids[at - 1]
            step = shift(key, far)
            if step:
                at += step
                continue
            low, high = bucket[key]
            head = ids[at - m] << 32 | ids[at - m + 1] if block == 2 else ids[at - m]
            low, high = low + int(np.searchsorted(self.head[low:high], head)), low + int(np.searchsorted(self.head[low:high], head, "right"))
            for row in range(low, high):
                if ids[at - m : at] == self.rows[row].tolist():
                    yield at, int(self.number[row])
            at += 1

    def items(self, window: int) -> np.ndarray:
        return self.owners[self.first[window] : self.first[window + 1]]


class Matcher:
    """The tables of one block of items."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.number: dict[str, int] = {}
        self.names = [item for item, _ in items]
        groups: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for k, (_, text) in enumerate(items):
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int32)
            if len(ids):
                m = min(width, len(ids))
                groups[m].append((np.lib.stride_tricks.sliding_window_view(ids, m), k))
        self.tables = [WuManber(np.concatenate([w for w, _ in parts]), np.repeat([k for _, k in parts], [len(w) for w, _ in parts]).astype(np.int32), m) for m, parts in sorted(groups.items())]

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint [start, end) of hit words in order, and the items with occurring windows."""
        get = self.number.get
        ids = [get(w, -1) for w in words]
        found, items = [], set()
        for table in self.tables:
            seen = set()
            for end, window in table.search(ids):
                found.append((end - table.m, end))
                seen.add(window)
            items.update(self.names[k] for w in seen for k in table.items(w).tolist())
        return merge(found), items


_matchers: dict[str, Matcher] = {}


def matcher_of(name: str, rows: list[tuple[object, str | None]], width: int) -> Matcher:
    """One at a time in each worker process, made once."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher(rows, width)
    return _matchers[name]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items as lists of (id as a string, text), each of about block_bytes of text at most."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) if total else 0
    if blocks > 1:
        blocks *= 2  # hashing deals unevenly
        items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.col("block") == k).drop("block")
        if rows := [(r.item_id, r.text) for r in part.collect()]:
            yield rows


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = "n_words long, spans array<struct<a:int,b:int>>, items array<string>"


def _one_pass(state: DataFrame, rows: list[tuple], width: int, keep: str, hits_only: bool) -> DataFrame:
    """keep (a column of state), n_words, spans, items of state(keep, text); rows: a block of items."""
    sent = state.sparkSession.sparkContext.broadcast(rows)  # block_bytes of text at most, or one item
    name, out = uuid.uuid4().hex, StructType([state.schema[keep], *StructType.fromDDL(_FOUND).fields])

    def run(batches):
        matcher = matcher_of(name, sent.value, width)
        for b in batches:
            counts, spans, ids = [], [], []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                found, items = matcher.hits(words)
                counts.append(len(words))
                spans.append([{"a": x, "b": y} for x, y in found])
                ids.append(sorted({i for i in items if i is not None}))
            made = pa.RecordBatch.from_arrays([b.column(keep), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))], names=[keep, "n_words", "spans", "items"])
            yield made.filter(pa.array([bool(s) for s in spans], pa.bool_())) if hits_only else made

    return state.select(keep, "text").mapInArrow(tidy(run), out)


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (a struct of docs' columns), n_words, spans (disjoint [a, b) in words, in order), items (ids with occurring windows, sorted)."""
    bounded_batches(docs.sparkSession)
    state = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    blocks = item_blocks(items, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _one_pass(state, first, width, "row", False)
    state = materialize(state.withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = None
    for rows in chain((first, second), blocks):
        part = materialize(_one_pass(state, rows, width, "number", True).select("number", "spans", "items"), "hits")
        found = part if found is None else found.unionByName(part)
    #: Spans of a document: in order, each as far as the ones before reach; those that begin behind that are on their own.
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<a:int,b:int>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] >= x["a"]), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(F.try_element_at(out, F.lit(-1))["a"].alias("a"), F.greatest(F.try_element_at(out, F.lit(-1))["b"], x["b"]).alias("b")))).otherwise(F.array_append(out, x)),
    )
    found = found.groupBy("number").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    found = found.select(F.col("number").alias("of"), merged.alias("spans"), "items")
    words = F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"))
    lower = state.withColumn("text", F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return lower.select("number", "row", F.coalesce(words, F.lit(0)).cast("long").alias("n_words")).join(found, F.col("number") == F.col("of"), "left").select(
        "row", "n_words", F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return find_hits(docs.select("doc_id", "text"), items, width, block_bytes).select(
        "row.doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def without_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with their columns, in which no window occurs."""
    return find_hits(docs, items, width, block_bytes).filter(F.size("spans") == 0).select("row.*")
