"""Toxicity by a classifier chain of linear models over words.

The categories stand in order (by default: low quality, then toxic; the labels hold no other toxicity category, so ``toxic`` is the only one that is one). With ``categories`` a chain of any length is fitted. Each is a logistic regression on the presence of
selected words and on the probabilities of the categories before it. A later model is trained with out-of-fold probabilities of the earlier ones, so
that it sees them as they will be on new text; the models that predict are fitted on all rows of the sample.

Fit: on a bounded sample, ``sample_rows`` labelled documents as chosen by a hash of doc_id. Of documents that share one of a few least
hashes of 3-word shingles one is used, so that copies and their labels do not count as evidence several times. The words are those with the highest chi-square for a category, by
counts over the whole sample, and beyond chance. The threshold of the last category is the one of the best F1 on its out-of-fold probabilities.
Prediction covers the whole text of every document and needs no shuffle.

Defined results: a null or wordless text has the probabilities of a document without any known word and is never toxic; repeated rows get
equal rows; null labels are not used, of several labels of a document the largest counts; without usable labels all probabilities are 0 and nothing is toxic; a null doc_id
has no label but is predicted; whole texts are read, however long; empty documents give no rows; columns named like the ones used here stay as they are in ``without_toxic``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, materialize, tidy

#: Name of the category, the column of the labels and the value that stands for it.
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
SAMPLE_ROWS = 20_000
WORDS_PER_CATEGORY = 1500
#: The least chi-square of a selected word: far beyond chance for one word, so that few words of a vocabulary pass by chance.
LEAST_CHI_SQUARE = 20.0
LEAST_DOCUMENTS = 5
FOLDS = 4
#: Documents that share any of so many sketches are copies to the fit.
SKETCHES = 6
STEPS = 120
RIDGE = 1e-4

_words = re.compile(r"[^\W\d_]+").findall


def word_set(text: str | None) -> set[str]:
    return set(_words(text.lower())) if text else set()


def _sketches(text: str | None) -> list[int]:
    """The least hash of the text's 3-word shingles by each of SKETCHES orders."""
    words = text.lower().split() if text else []
    hashes = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int((hashes * np.uint64(2 * k + 1) ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min() >> np.uint64(1)) for k in range(SKETCHES)]


class Linear:
    """Logistic regression on sets of numbers (rows as one flat array) and a few dense columns, by accelerated gradient steps."""

    def __init__(self, size: int, dense: int):
        self.w, self.u, self.b = np.zeros(size), np.zeros(dense), 0.0

    def logits(self, flat: np.ndarray, row: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.w[flat], minlength=len(dense)) + dense @ self.u + self.b

    def fit(self, flat: np.ndarray, row: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Linear:
        n = len(y)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.b = float(np.log(rate / (1 - rate)))
        moment = [0.0, 0.0, 0.0]
        second = [0.0, 0.0, 0.0]
        for t in range(1, STEPS + 1):
            err = (1 / (1 + np.exp(-np.clip(self.logits(flat, row, dense), -30, 30))) - y) / n
            grads = [np.bincount(flat, weights=err[row], minlength=len(self.w)) + RIDGE * self.w, dense.T @ err + RIDGE * self.u, err.sum()]
            steps = []
            for i, g in enumerate(grads):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                steps.append(0.1 * (moment[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8))
            self.w, self.u, self.b = self.w - steps[0], self.u - steps[1], float(self.b - steps[2])
        return self


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Chain:
    """words: number of each selected word; models: one Linear for each category in order; threshold: of the last one."""

    def __init__(self, words: dict[str, int], models: list[Linear], threshold: float):
        self.words, self.models, self.threshold = words, models, threshold

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (rows by categories) and whether the last one passes the threshold."""
        get = self.words.get
        ids = [[i for i in map(get, word_set(t)) if i is not None] for t in texts]
        flat = np.fromiter((i for x in ids for i in x), np.int64)
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        p = np.zeros((len(texts), 0))
        for m in self.models:
            p = np.column_stack([p, sigmoid(m.logits(flat, row, p))])
        known = np.array([len(x) > 0 for x in ids], dtype=bool)
        return p, known & (p[:, -1] >= self.threshold)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """In the middle of the gap below the last accepted probability, where accepting all above has the best F1."""
    order = np.argsort(-p, kind="stable")
    tp = np.cumsum(y[order])
    f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(np.diff(p[order]) != 0, True)
    k = int(np.argmax(np.where(last, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float((p[order][k] + below) / 2)


def fit_arrays(words: dict[str, int], rows: list[list[int]], y: np.ndarray) -> Chain:
    """y: rows by categories, 0 or 1."""
    n, fold = len(rows), np.arange(len(rows)) % FOLDS
    flat = np.fromiter((i for x in rows for i in x), np.int64)
    row = np.repeat(np.arange(n), [len(x) for x in rows])
    earlier, models, threshold = np.zeros((n, 0)), [], 0.5
    for c in range(y.shape[1]):
        held = np.zeros(n)
        for k in range(FOLDS):
            out, new = fold == k, np.cumsum(fold != k) - 1
            inside = ~out[row]
            m = Linear(len(words), c).fit(flat[inside], new[row[inside]], earlier[~out], y[~out, c])
            held[out] = sigmoid(m.logits(flat, row, earlier))[out]
        models.append(Linear(len(words), c).fit(flat, row, earlier, y[:, c]))
        threshold = best_threshold(held, y[:, c]) if 0 < y[:, c].sum() < n else 1.1
        earlier = np.column_stack([earlier, held])
    return Chain(words, models, threshold)


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS) -> Chain | None:
    """A chain fitted on a sample of at most about sample_rows labelled documents; None without usable labels."""
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").alias("_id"), *[F.col(c).alias(f"_l{i}") for i, (_, c, _) in enumerate(categories)]).dropna()
    total = usable.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample_rows / total))
    chosen = usable.filter(draw).groupBy("_id").agg(*[F.max(F.col(f"_l{i}") == F.lit(v)).cast("int").alias(f"_y{i}") for i, (_, _, v) in enumerate(categories)])
    schema = "doc_id long, sketches array<long>, words array<string>, " + ", ".join(f"_y{i} int" for i in range(len(categories)))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([_sketches(t) for t in texts], pa.list_(pa.int64())), pa.array([sorted(word_set(t)) for t in texts], pa.list_(pa.string())), *[b.column(f"_y{i}") for i in range(len(categories))]],
                names=["doc_id", "sketches", "words", *[f"_y{i}" for i in range(len(categories))]],
            )

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = text.join(F.broadcast(chosen), text.doc_id == F.col("_id")).drop("_id").mapInArrow(tidy(run), schema)
    sample = materialize(sample, "sample")
    groups = sample.select("doc_id", F.posexplode("sketches").alias("k", "sketch"))
    least = groups.groupBy("k", "sketch").agg(F.min("doc_id").alias("first"), F.collect_set("doc_id").alias("ids"))  # of the bounded sample
    copies = least.select("first", F.explode("ids").alias("copy")).filter("copy <> first").select("copy").distinct()
    sample = sample.join(copies, sample.doc_id == copies.copy, "left_anti").dropDuplicates(["doc_id"])
    sample = materialize(sample, "sample_without_copies")
    n = sample.count()
    if not n:
        return None
    ys = [f"_y{i}" for i in range(len(categories))]
    totals = sample.agg(*[F.sum(c).alias(c) for c in ys]).first()
    counts = materialize(sample.select(F.explode("words").alias("word"), *ys).groupBy("word").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in ys]).filter(F.col("df") >= LEAST_DOCUMENTS), "word_counts")
    chosen_words: set[str] = set()
    for c in ys:
        a, df, pos = F.col(c).cast("double"), F.col("df").cast("double"), float(totals[c] or 0)
        miss = a * (n - pos) - (df - a) * pos
        chi = n * miss * miss / (df * (n - df) * pos * (n - pos)) if 0 < pos < n else F.lit(0.0)
        chosen_words |= {r.word for r in counts.filter(F.col("df") < n).withColumn("chi", chi).filter(F.col("chi") >= LEAST_CHI_SQUARE).orderBy(F.desc("chi"), "word").limit(WORDS_PER_CATEGORY).collect()}
    number = {w: i for i, w in enumerate(sorted(chosen_words))}
    rows = sample.select("doc_id", F.array_intersect("words", F.array(*map(F.lit, sorted(chosen_words))) if chosen_words else F.array().cast("array<string>")).alias("words"), *ys).collect()
    rows.sort(key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    return fit_arrays(number, [[number[w] for w in r.words] for r in rows], np.array([[r[c] for c in ys] for r in rows], dtype=float))


def scores(docs: DataFrame, chain: Chain | None, categories=CATEGORIES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default), p_<category> for each category, is_<last category>."""
    bounded_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    names, last = [f"p_{c}" for c, _, _ in categories], f"is_{categories[-1][0]}"
    kept = docs.select(*[F.col(c) for c in keep], F.col("text").cast("string").alias("_text"))
    if chain is None:
        return kept.select(*keep, *[F.lit(0.0).alias(x) for x in names], F.lit(False).alias(last))
    schema = kept.drop("_text").schema
    for x in names:
        schema = schema.add(x, "double")
    schema = schema.add(last, "boolean")

    def run(batches):
        for b in batches:
            p, hit = chain.predict(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *[pa.array(p[:, i]) for i in range(len(names))], pa.array(hit)], names=[*keep, *names, last])

    return kept.mapInArrow(tidy(run), schema)


def classify(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, p_<category>..., is_<last category> of every document."""
    return scores(docs, fit(docs, labels, categories, sample_rows), categories)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not toxic, with their columns."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return scores(rows, fit(docs, labels), keep=["row"]).filter(~F.col(f"is_{CATEGORIES[-1][0]}")).select("row.*")
