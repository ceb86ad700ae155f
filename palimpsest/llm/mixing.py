"""Mixing to target weights by soft domain membership, with DataFrame functions only.

A labelled table gives some documents a domain. A naive Bayes classifier over six binned shape features (words, symbols a word,
upper-case share, digit share, lines a word, word length) predicts the posterior of each domain for every document. The rates r >= 0 of
the documents then solve

    min  1/2 sum_k (M_k - w_k)^2 + ridge/2 sum_d s_d (r_d - 1)^2,   M_k = sum_d s_d p_dk r_d,   lower <= r_d

with s_d the document's share of the tokens and w the target weights times ``scale``. Rates have no upper bound unless one is given. The ridge only chooses among the
rates that meet the targets: it is so small that every target that rates can meet is met within 0.5 % of itself. A domain that no
posterior favours enough cannot be met; ``reached`` gives each domain's expected total beside its target.

Projected gradient: the rates are always the projection of 1 + p . y on their bounds, and y, a number for each domain, moves along the gradient
w - M - ridge y, in the metric of its curvature (the sums of s p_i p_j over the rates within their bounds), by the longest of the steps 1, 1/2, 1/4 ... that descends enough, until
the gradient is below TOLERANCE. Each step is one aggregation that returns some sums; no row of any table comes to the driver. Documents of one
cell (one bin of each feature) have one posterior and so one rate, hence the aggregations run on the cells' token sums, CELLS rows at most
whatever the corpus, which is exactly the document problem. The cells' rates go back to the documents by a broadcast of that bounded table.

A document's copies are its rate rounded up or down by a keyed hash of its id and text, so that their expected tokens match the targets.
Words are runs of characters other than blanks, tabs and line ends; they count as tokens.

Defined results: a null text is empty (0 tokens, copies by its cell's rate); a null doc_id is a row like any other; labels without
documents, with a null domain, or of a domain that has no target are not used; a document with several labels counts for each; without any usable label the posterior is the target weights;
where no document has a token all rates are 1; rows that repeat have equal rates and copies; a value on the edge of two bins belongs to the upper one; empty documents give no rows. Columns of documents
named like the ones added are not touched by ``mix``, and ``document_rates`` reads doc_id and text only.
"""

from __future__ import annotations

from math import log, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize

TARGETS = {"1": 0.8, "0": 0.2}
LOWER = 0.0
RIDGE = 1e-6
#: The descent ends when no component of the gradient is larger.
TOLERANCE = 1e-10
#: Steps that are tried side by side: powers of one half.
HALVINGS = 12
SEED = 7

#: Upper edges of the bins of each feature; the last bin is open.
EDGES = {
    "words": [10, 50, 200, 1000, 5000],
    "symbols": [0.0001, 0.1, 0.5, 1.5],
    "upper": [0.02, 0.06, 0.2],
    "digits": [0.0001, 0.005, 0.02],
    "lines": [0.0001, 0.02, 0.05, 0.2],
    "length": [4, 5, 6, 8],
}
CELLS = prod(len(e) + 1 for e in EDGES.values())


_BLANKS = r"\x20\x09-\x0D"


def cells(docs: DataFrame) -> DataFrame:
    """docs with _tokens and _cell, the number of the document's bins. Each pass over a text is made once: the features are columns before they are put into bins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blanks = F.length("_text") - F.length(F.replace("_text", F.lit(" ")))
    lines = F.length("_text") - F.length(F.replace("_text", F.lit("\n")))
    #: Blanks and line ends that stand alone inside a text part two words each; other texts are counted word by word.
    alone = ~F.col("_text").rlike(rf"[{_BLANKS}]{{2}}|[\x09\x0B-\x0D]|\A[{_BLANKS}]|[{_BLANKS}]\z|\A\z")
    words = F.when(alone, F.col("_blanks") + F.col("_lines") + 1).otherwise(F.regexp_count("_text", F.lit(f"[^{_BLANKS}]+")))
    #: The characters that are counted, a small part of the text.
    marks = F.regexp_replace("_text", r"[^A-Z0-9#*$%&|<>!]+", "")
    one = docs.withColumn("_text", text).withColumns({"_blanks": blanks, "_lines": lines, "_marks": marks, "_chars": F.length("_text")}).withColumn("_words", words.cast("long")).drop("_text")
    upper, digits = F.length(F.regexp_replace("_marks", "[^A-Z]+", "")), F.length(F.regexp_replace("_marks", "[^0-9]+", ""))
    two = one.withColumns({"_upper": upper, "_digits": digits})
    symbols = F.length("_marks") - F.col("_upper") - F.col("_digits")
    chars, many = F.greatest(F.col("_chars"), F.lit(1)), F.greatest(F.col("_words"), F.lit(1))
    value = {"words": F.col("_words"), "symbols": symbols / many, "upper": F.col("_upper") / chars, "digits": F.col("_digits") / chars, "lines": F.col("_lines") / many, "length": chars / many}
    cell = F.lit(0)
    for name, edges in EDGES.items():
        part = F.lit(0)
        for e in edges:
            part = part + (F.col(f"_f_{name}") >= e).cast("int")
        cell = cell * (len(edges) + 1) + part
    three = two.withColumns({f"_f_{name}": v for name, v in value.items()})
    return three.select(*[three[c] for c in docs.columns], F.col("_words").alias("_tokens"), cell.cast("int").alias("_cell"))


def _bins(cell: str = "_cell") -> list[Column]:
    out, left = [], F.col(cell)
    for edges in reversed(EDGES.values()):
        out.append(F.pmod(left, F.lit(len(edges) + 1)))
        left = F.floor(left / (len(edges) + 1))
    return out[::-1]


def classifier(counted: DataFrame, labels: DataFrame, domain: str, domains: list[str]) -> list[Column]:
    """The posterior of each domain as an expression over _cell. counted: doc_id, _cell of all documents."""
    named = labels.select(F.col("doc_id").alias("_id"), F.col(domain).cast("string").alias("_domain")).filter(F.col("_domain").isin(domains))
    by_cell = materialize(counted.join(named, counted.doc_id == named._id).groupBy("_domain", "_cell").agg(F.count("*").alias("n")), "labelled_cells")
    sizes = {r._domain: r.n for r in by_cell.groupBy("_domain").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        return []
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), b.cast("int").alias("b")) for i, b in enumerate(_bins())])).alias("x")
    seen = {(r.f, r.b, r._domain): r.n for r in by_cell.select("_domain", "n", pairs).groupBy("x.f", "x.b", "_domain").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    logs = []
    for d in domains:
        score = F.lit(log((sizes.get(d, 0) + 1) / (total + len(domains))))
        for i, (edges, b) in enumerate(zip(EDGES.values(), _bins())):
            k = len(edges) + 1
            score = score + F.element_at(F.array(*[F.lit(log((seen.get((i, j, d), 0) + 1) / (sizes.get(d, 0) + k))) for j in range(k)]), b.cast("int") + 1)
        logs.append(score)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    exps = [F.exp(x - top) for x in logs]
    return [e / sum(exps[1:], exps[0]) for e in exps]


def counted_cells(docs: DataFrame) -> DataFrame:
    """doc_id, _cell, _tokens and _hash (of the text, for the rounding) of every document, written once: all passes over the texts that rates need."""
    return materialize(cells(docs.select("doc_id", "text")).select("doc_id", "_cell", "_tokens", F.xxhash64("text").alias("_hash")), "cells")


def fit_rates(counted: DataFrame, labels: DataFrame, domain: str = "quality", targets: dict[str, float] | None = None, lower: float = LOWER, upper: float | None = None, scale: float = 1.0, ridge: float = RIDGE) -> DataFrame:
    """counted: counted_cells(). A row for each cell that occurs, CELLS at most: _cell, share (of the tokens), posterior (array by sorted domain), rate."""
    targets = targets or TARGETS
    domains = sorted(targets)
    weights = [targets[d] * scale / sum(targets.values()) for d in domains]
    posterior = classifier(counted, labels, domain, domains) or [F.lit(w / sum(weights)) for w in weights]
    sums = counted.groupBy("_cell").agg(F.sum("_tokens").alias("tokens"))
    total = counted.agg(F.sum("_tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(float(total or 1))
    state = materialize(sums.select("_cell", share.alias("share"), F.array(*[p.cast("double") for p in posterior]).alias("posterior")), "shares")  # CELLS rows at most
    y = _descend(state, weights, lower, upper, ridge) if total else [0.0] * len(domains)
    return materialize(state.withColumn("rate", _rate(y, lower, upper)), "rates")


def _rate(y: list[float], lower: float, upper: float | None) -> Column:
    rate = F.greatest(F.lit(float(lower)), _level(y))
    return rate if upper is None else F.least(F.lit(float(upper)), rate)


def _level(y: list[float]) -> Column:
    """1 + p . y, of which the rate is the projection on its bounds."""
    out = F.lit(1.0)
    for i, x in enumerate(y):
        out = out + F.col("posterior")[i] * F.lit(x)
    return out


def _descend(state: DataFrame, weights: list[float], lower: float, upper: float | None, ridge: float) -> list[float]:
    """The y at which the gradient w - M - ridge y vanishes. In y the problem is to minimise sum s H(1 + p . y) - w . y + ridge/2 |y|^2, with the rate as H's derivative."""
    k = len(weights)
    p = [F.col("posterior")[i] for i in range(k)]
    low, high = F.lit(float(lower)), None if upper is None else F.lit(float(upper))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def height(y):
        t, r = _level(y), _rate(y, lower, upper)
        return F.sum(F.col("share") * (r * t - r * r / 2))

    def slope(y):
        t = _level(y)
        free = t > low if high is None else (t > low) & (t < high)
        rate = _rate(y, lower, upper)
        return [F.sum(F.col("share") * p[i] * rate) for i in range(k)] + [F.sum(F.when(free, F.col("share") * p[i] * p[j]).otherwise(0.0)) for i, j in pairs]

    y, last = [0.0] * k, None
    while True:
        got = state.agg(*[c.alias(f"x{n}") for n, c in enumerate(slope(y))]).first()
        gradient = [w - got[i] - ridge * v for i, (w, v) in enumerate(zip(weights, y))]
        worst = max(map(abs, gradient))
        if worst <= TOLERANCE or (last is not None and worst >= last and worst <= 1e-7):
            return y
        last = worst
        metric = [[0.0] * k for _ in range(k)]
        for n, (i, j) in enumerate(pairs):
            metric[i][j] = metric[j][i] = got[k + n]
        for i in range(k):
            metric[i][i] += ridge
        move = _solve(metric, gradient)
        descent = sum(g * m for g, m in zip(gradient, move))
        tried = [[v + m / (1 << h) for v, m in zip(y, move)] for h in range(HALVINGS)]
        found = state.agg(*[height(t).alias(f"x{n}") for n, t in enumerate([y, *tried])]).first()
        value = [found[n] - sum(w * v - ridge / 2 * v * v for w, v in zip(weights, t)) for n, t in enumerate([y, *tried])]
        good = [h for h in range(HALVINGS) if value[h + 1] <= value[0] - 1e-4 * descent / (1 << h)]
        if not good and descent <= 1e-14 * max(1.0, abs(value[0])):  # beyond what sums of doubles can tell
            return y
        if tried[good[0] if good else HALVINGS - 1] == y:
            return y
        y = tried[good[0] if good else HALVINGS - 1]


def _solve(a: list[list[float]], b: list[float]) -> list[float]:
    """x with a x = b, for a small positive definite matrix."""
    n, rows = len(b), [[*row, v] for row, v in zip(a, b)]
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(i + 1, n):
            f = rows[r][i] / rows[i][i]
            rows[r] = [x - f * z for x, z in zip(rows[r], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def reached(rates: DataFrame, targets: dict[str, float] | None = None, scale: float = 1.0) -> DataFrame:
    """Of fit_rates(): domain, target and expected (shares of the tokens), met (within 0.5 % of the target)."""
    targets = targets or TARGETS
    domains = sorted(targets)
    sums = rates.agg(*[F.coalesce(F.sum(F.col("share") * F.col("posterior")[i] * F.col("rate")), F.lit(0.0)).alias(f"x{i}") for i in range(len(domains))])
    goal = [targets[d] * scale / sum(targets.values()) for d in domains]
    rows = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(g).alias("target"), F.col(f"x{i}").alias("expected")) for i, (d, g) in enumerate(zip(domains, goal))])
    return sums.select(F.explode(rows).alias("r")).select("r.*", (F.abs(F.col("r.expected") - F.col("r.target")) <= 0.005 * F.col("r.target")).alias("met"))


def _copies(rate: Column, seed: int) -> Column:
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("_hash")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def document_rates(docs: DataFrame, labels: DataFrame, domain: str = "quality", targets: dict[str, float] | None = None, seed: int = SEED, **fit) -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> for each domain, rate, copies."""
    targets = targets or TARGETS
    counted = counted_cells(docs)
    rated = counted.join(F.broadcast(fit_rates(counted, labels, domain, targets, **fit)), "_cell")
    return rated.select("doc_id", F.col("_tokens").alias("n_tokens"), *[F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(sorted(targets))], "rate", _copies(F.col("rate"), seed).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "quality", targets: dict[str, float] | None = None, seed: int = SEED, **fit) -> DataFrame:
    """docs with each row as often as its rate says. Rows are kept with their cell, so that the texts are examined once."""
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("_hash"))
    counted = materialize(cells(rows).select("row", "doc_id", "_cell", "_tokens", "_hash"), "rows_with_cells")
    rates = F.broadcast(fit_rates(counted.drop("row"), labels, domain, targets, **fit))
    rated = counted.join(rates, "_cell").withColumn("_copies", _copies(F.col("rate"), seed)).filter("_copies > 0")
    return rated.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")
