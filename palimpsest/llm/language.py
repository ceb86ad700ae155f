"""Language identification by rank-order profiles of character n-grams.

An n-gram is one to three characters of a lower-cased word with one blank on either side. A profile holds the ``PROFILE`` most frequent n-grams of a
language in order (ties by the n-gram's number). A document's most frequent n-grams are ranked alike, and its distance to a language is the sum over
them of how far out of place each is in the profile, ``PROFILE`` for one that the profile lacks. The least distance wins, ties go to the first language by name.

Learning: from text and non-null lang of the rows that the caller passes, of which a hash of doc_id and text picks about ``TRAIN_ROWS`` documents of each of the
``LANGUAGES`` most frequent lang values; whole texts are counted. Prediction: every whole text, in one pass without a shuffle; long texts are counted in pieces.

Defined results: ``und`` with score 0 where the text is null or has no letter, or nothing could be learned; repeated rows get equal rows; a null doc_id is a row like any other and not held out; an empty table
gives no rows; doc_id, text and (to learn) lang are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import batch, bounded_batches, materialize, tidy

PROFILE = 400
TRAIN_ROWS = 4000
#: The most languages that are learned: a bound of the fit, for tables whose lang is not clean.
LANGUAGES = 1000
_PIECE = 1 << 18

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def _grams(points: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams of words, which stand between zeros."""
    a = points.astype(np.int64)
    two = (a[:-1] + 1 << 21) | a[1:]
    three = (a[:-2] + 1 << 42) | (a[1:-1] << 21) | a[2:]
    return np.concatenate((a[a > 0], two, three[a[1:-1] > 0]))


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, ascending, and their counts."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, 0)
    keep = (points > 0) | np.append(True, points[:-1] > 0)
    points = np.concatenate(([0], points[keep], [0]))
    if points[1] == 0:
        points = points[1:]
    if len(points) > 1 and points[-2] == 0:
        points = points[:-1]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(points) - 2:
        cut = len(points) if len(points) - at <= _PIECE else at + _PIECE
        found.append(np.unique(_grams(points[at:cut]), return_counts=True))
        if cut == len(points):
            break
        at = cut - 2  # the grams that reach over the cut; those counted twice are taken back
        over = np.unique(_grams(points[at:cut]), return_counts=True)
        found.append((over[0], -over[1]))
    if len(found) == 1:
        return found[0]
    keys, index = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.bincount(index, weights=np.concatenate([c for _, c in found])).astype(np.int64)
    return keys[counts > 0], counts[counts > 0]


def top_grams(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.langs = size, sorted(profiles)
        self.keys = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.values()])) if profiles else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = gram_counts(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        top = top_grams(keys, counts, self.size)
        at = np.searchsorted(self.keys, top)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != top] = len(self.keys)
        ranks = self.ranks[:, at]
        far = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, size: int = PROFILE) -> Profiles:
    """Profiles of the languages in docs(doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).dropna(subset=["lang", "text"])
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not totals:
        return Profiles({}, size)
    share = F.create_map(*[x for lang, n in sorted(totals.items()) for x in (F.lit(lang), F.lit(max(1, int((1 << 30) * min(1.0, train_rows / n)))))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")]).select("lang", "text")

    def run(batches):
        schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
        for b in batches:
            held = defaultdict(list)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held[lang].append(gram_counts(text))
            for lang, found in held.items():
                keys, index = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(index, weights=np.concatenate([c for _, c in found]), minlength=len(keys)).astype(np.int64)
                yield batch(schema, lang=[lang] * len(keys), gram=keys, n=counts)

    counts = materialize(chosen.mapInArrow(tidy(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", first).filter(F.col("rank") <= size).orderBy("lang", "rank").collect():  # size n-grams of a language at most
        profiles.setdefault(r.lang, []).append(r.gram)
    return Profiles(profiles, size)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text has remainder 2 by 4; a null id is held out from nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only text is an input of the prediction."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            found = [profiles.predict(t) for t in b.column("text").to_pylist()]
            yield batch(schema, doc_id=b.column("doc_id"), held_out=b.column("held_out"), lang_pred=[x for x, _ in found], score=[s for _, s in found])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all."""
    return identify(docs, learn(docs.filter(~held_out(F.col("doc_id")))))
