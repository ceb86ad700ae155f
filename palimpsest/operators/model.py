"""What surrounds a model: normalising its outputs, thresholds and gates, alignment, chunks, and decoding of logits. Outputs come in as a table."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.numbers import sigmoid, softmax
from palimpsest.functions.spans import let
from palimpsest.functions.text import ASCII_BOUNDARY, byte_slice, grapheme_to_byte, tokens

#: Words that an organisation or a place may end in.
SUFFIXES = {"organization": "bank corp corporation hospital inc llc ltd university".split(), "location": "airport center centre hospital station university".split()}
STRONG_LOCATION = r"(?i)\b(address(?:es)?|city|state|country|county|province|region|zip|postal|street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|apartment|apt\.?|suite|located|location|lives\s+in|based\s+in|works\s+in|town|from|in|near|toward|towards|inside|outside|at|to|serving|arrived|coming)\b"
COMMA_CAPITALIZED = r"\b[A-Z][\w'-]+(?:\s+[A-Z][\w'-]+){0,2},\s+[A-Z][\w'-]+"
STREET_NUMBER = r"\b\d{1,6}\s+[A-Z][\w'-]+"
TRIM = " \n\r\t.,;:!?()[]{}<>\"'`"


def base_label(label: Column) -> Column:
    return F.regexp_replace(label, "^[BIESLU]-", "")


def _holds(text: Column, pattern: str) -> Column:
    """Whether a pattern with boundaries of ASCII words occurs."""
    return text.rlike(pattern.replace(r"\b", ASCII_BOUNDARY))


def location_gate(text: Column) -> Column:
    """Why a location model should run on a text, or no_location_signal."""
    return F.when(_holds(text, STRONG_LOCATION), "location_context").when(_holds(text, COMMA_CAPITALIZED), "comma_capitalized_phrase").when(_holds(text, STREET_NUMBER), "street_number").otherwise("no_location_signal")


def gate_summary(docs: DataFrame, text: str = "text") -> DataFrame:
    run = (location_gate(F.col(text)) != "no_location_signal").cast("int")
    return docs.select(run.alias("run")).agg(F.count("*").alias("total"), F.sum("run").alias("run_count"), F.avg("run").alias("run_rate"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key] if table else F.lit(None)


def threshold(label: Column, entity: Column, by_label: dict | None = None, by_entity: dict | None = None, default: float = 0.0) -> Column:
    """By label, by its base, by entity, or the default."""
    by_label, by_entity = by_label or {}, by_entity or {}
    return F.coalesce(_lookup(by_label, label), _lookup(by_label, base_label(label)), _lookup(by_entity, entity), F.lit(float(default)))


def requires_context(label: Column, entity: Column, score: Column, labels: tuple[str, ...] = (), below_by_label: dict | None = None, below_by_entity: dict | None = None) -> Column:
    """Labels that always need context; else scores below the label's, then the entity's limit."""
    always = (label.isin(*labels) | base_label(label).isin(*labels)) if labels else F.lit(False)
    limit = F.coalesce(_lookup(below_by_label or {}, label), _lookup(below_by_label or {}, base_label(label)), _lookup(below_by_entity or {}, entity))
    return always | F.coalesce(score < limit, F.lit(False))


def normalize(outputs: DataFrame, docs: DataFrame, labels: dict[str, str], ignored: tuple[str, ...] = ("O",), low_score: tuple[str, ...] = (), low_multiplier: float = 0.4, by_label: dict | None = None, by_entity: dict | None = None, default: float = 0.0, strict: bool = False, gates: dict | None = None, align: str = "expand", key: str = "doc_id") -> DataFrame:
    """outputs(doc_id, label, start, end, offset_unit, score) as spans: key, entity, byte_start, byte_end, score, text, source_entity, threshold, requires_context.

    A missing score is 1; one outside of 0..1 ends the query. Unknown labels are left out, or end the query if strict.
    """
    label = F.col("label")
    score = F.coalesce("score", F.lit(1.0))
    rows = outputs.filter(~label.isin(*ignored) & ~base_label(label).isin(*ignored))
    entity = F.coalesce(_lookup(labels, label), _lookup(labels, base_label(label)), *([F.raise_error(F.lit("unknown_model_label")).cast("string")] if strict else []))
    rows = rows.withColumn("entity", entity).filter(F.col("entity").isNotNull())
    rows = rows.withColumn("score", F.when(score.between(0, 1), score).otherwise(F.raise_error(F.lit("invalid_model_score")).cast("double")))
    if low_score:
        low = label.isin(*low_score) | base_label(label).isin(*low_score) | F.col("entity").isin(*low_score)
        rows = rows.withColumn("score", F.when(low, F.col("score") * low_multiplier).otherwise(F.col("score")))
    rows = rows.withColumn("threshold", threshold(label, F.col("entity"), by_label, by_entity, default)).filter("score >= threshold")
    rows = rows.withColumn("requires_context", requires_context(label, F.col("entity"), F.col("score"), **(gates or {})))
    rows = rows.join(docs.select(key, F.col("text").alias("_text")), key)
    unit = F.coalesce("offset_unit", F.lit("byte"))
    to_bytes = lambda c: F.when(unit == "byte", c).otherwise(grapheme_to_byte(F.col("_text"), c))
    rows = rows.withColumn("byte_start", to_bytes(F.col("start")).cast("int")).withColumn("byte_end", to_bytes(F.col("end")).cast("int"))
    if align != "strict":
        rows = align_to_tokens(rows, align)
    rows = rows.filter("byte_start >= 0 and byte_start < byte_end").filter(F.col("byte_end") <= F.octet_length("_text"))
    return rows.select(key, "entity", "byte_start", "byte_end", "score", byte_slice(F.col("_text"), F.col("byte_start"), F.col("byte_end")).alias("text"), label.alias("source_entity"), "threshold", "requires_context")


def align_to_tokens(rows: DataFrame, mode: str, text: str = "_text") -> DataFrame:
    """expand: to the tokens that a span meets. contract: to those inside it. Where there is none, the span stays."""
    if mode not in ("expand", "contract"):
        raise ValueError("align must be strict, expand or contract")
    a, b = F.col("byte_start"), F.col("byte_end")
    meets = (lambda t: (t["byte_start"] < b) & (a < t["byte_end"])) if mode == "expand" else (lambda t: (t["byte_start"] >= a) & (t["byte_end"] <= b))
    hit = F.filter(tokens(F.col(text)), meets)
    rows = rows.withColumn("_hit", hit)
    first, last = F.array_min(F.transform("_hit", lambda t: t["byte_start"])), F.array_max(F.transform("_hit", lambda t: t["byte_end"]))
    return rows.withColumn("byte_start", F.coalesce(first, a)).withColumn("byte_end", F.coalesce(last, b)).drop("_hit")


def conservative_boundaries(text: Column, start: Column, end: Column) -> Column:
    """struct(byte_start, byte_end): without punctuation and symbols at the edges, then without a trailing connector word; as before where nothing would be left."""
    value = byte_slice(text, start, end)
    left = F.octet_length(F.regexp_extract(value, r"(?U)^\s*[\p{P}\p{S}]*", 0))
    right = F.octet_length(F.regexp_extract(value, r"(?U)[\s\p{P}\p{S}]*\z", 0))
    s, e = F.least(start + left, end), F.greatest(end - right, start)

    def connector(p):
        cut = F.octet_length(F.regexp_extract(byte_slice(text, p["s"], p["e"]), r"(?iU)\s+(?:and|or|with|at|in|from|to|for)\z", 0))
        return F.when(p["s"] < p["e"] - cut, F.struct(p["s"].cast("int").alias("byte_start"), (p["e"] - cut).cast("int").alias("byte_end"))).otherwise(F.struct(start.cast("int").alias("byte_start"), end.cast("int").alias("byte_end")))

    return let(F.struct(s.alias("s"), e.alias("e")), connector)


def expand_suffix(text: Column, entity: Column, end: Column) -> Column:
    """The end after the next token, if that is a suffix word of the entity."""
    after = F.filter(tokens(text), lambda t: t["byte_start"] >= end)
    out = end
    def moved(t):
        hit = F.lit(False)
        for e, words in SUFFIXES.items():
            hit = hit | ((entity == e) & t["norm"].isin(*words))
        return F.when(hit, t["byte_end"]).otherwise(out)
    return let(after, lambda a: F.when(F.size(a) > 0, moved(F.get(a, F.lit(0)))).otherwise(out))


def dedupe_outputs(outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The highest score of each label and range, as overlapping chunks may repeat one."""
    return outputs.groupBy(key, "label", "start", "end").agg(F.max("score").alias("score"))


def chunks(docs: DataFrame, size: int = 400, overlap: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, index, byte_start, byte_end, chunk: pieces of at most size bytes that end with a token, each beginning with a token about overlap bytes before the last end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    token = regex.compile(r"[\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*")

    def cut(value: str) -> list[tuple]:
        raw = value.encode()
        if len(raw) <= size:
            return [(0, 0, len(raw), value)]
        at, offsets, last = 0, [], 0
        for m in token.finditer(value):
            at += len(value[last : m.start()].encode())
            length = len(m.group().encode())
            offsets.append((at, at + length))
            at, last = at + length, m.end()
        out, start = [], 0
        while True:
            want = min(start + size, len(raw))
            while want < len(raw) and raw[want] & 0xC0 == 0x80:
                want -= 1
            end = len(raw) if want == len(raw) else max((e for s, e in offsets if s >= start and e <= want), default=want)
            out.append((len(out), start, end, raw[start:end].decode()))
            if end >= len(raw) or end <= start:
                return out
            begin = [s for s, _ in offsets if max(start + 1, end - overlap) <= s <= end]
            start = begin[0] if begin else end

    @F.pandas_udf("array<struct<index:int,byte_start:int,byte_end:int,chunk:string>>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: cut(v) if v else [])

    return docs.select(key, F.explode(run(F.col(text))).alias("c")).select(key, "c.*")


def merge_bio(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(key, pos, label, start, end, score) of tokens -> spans(key, label, start, end, score): I- and E- continue a span of their base; the score is the mean."""
    w = Window.partitionBy(key).orderBy("pos")
    off = (F.col("label") == "O") | (F.col("start") == F.col("end"))
    rows = rows.withColumn("base", base_label(F.col("label"))).withColumn("off", off)
    goes_on = F.col("label").rlike("^[IE]-") & (F.lag("base").over(w) == F.col("base")) & ~F.lag("off").over(w)
    rows = rows.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("island", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~F.col("off"))
    return rows.groupBy(key, "island").agg(F.min_by("base", "pos").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("island")


def argmax_tokens(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows(..., logits) with label (the first of the highest) and score (its softmax)."""
    best = F.array_position(F.col("logits"), F.array_max("logits")).cast("int")
    return rows.withColumn("label", F.element_at(F.array(*map(F.lit, labels)), best)).withColumn("score", F.element_at(softmax(F.col("logits")), best)).drop("logits")


def decode_span_logits(rows: DataFrame, max_width: int, classes: list[str], limit: float = 0.5, key: str = "doc_id") -> DataFrame:
    """rows(key, n_words, logits flat by start, width, class) -> key, start, end (exclusive, in words), label, score above the limit."""
    n = len(classes)
    flat = rows.select(key, "n_words", F.posexplode("logits").alias("i", "logit")).withColumn("score", sigmoid(F.col("logit")))
    start, width, c = F.floor(F.col("i") / (max_width * n)), F.floor(F.col("i") / n) % max_width, F.col("i") % n
    flat = flat.select(key, "n_words", start.cast("int").alias("start"), (start + width + 1).cast("int").alias("end"), F.element_at(F.array(*map(F.lit, classes)), (c + 1).cast("int")).alias("label"), "score")
    return flat.filter((F.col("score") > limit) & (F.col("end") <= F.col("n_words"))).drop("n_words")


def decode_token_scores(rows: DataFrame, limit: float = 0.5, key: str = "doc_id") -> DataFrame:
    """rows(key, label, starts, ends, insides: arrays of probabilities by word) -> key, label, start, end, score: start and end above the limit, all inside at least; the least is the score."""
    at = F.sequence(F.lit(1), F.size("starts"))
    pairs = F.flatten(F.transform(at, lambda s: F.transform(F.filter(at, lambda e: e >= s), lambda e: F.struct(s.alias("s"), e.alias("e")))))
    good = rows.select(key, "label", "starts", "ends", "insides", F.explode(F.filter(pairs, lambda p: (F.element_at("starts", p["s"]) > limit) & (F.element_at("ends", p["e"]) > limit))).alias("p"))
    inside = F.slice("insides", F.col("p.s"), F.col("p.e") - F.col("p.s") + 1)
    good = good.filter(F.forall(inside, lambda x: x >= limit))
    return good.select(key, "label", (F.col("p.s") - 1).alias("start"), F.col("p.e").alias("end"), F.least(F.element_at("starts", F.col("p.s")), F.element_at("ends", F.col("p.e")), F.array_min(inside)).alias("score"))


def windows(rows: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """rows(key, pos) with the number of a fixed window and the place in it."""
    return rows.withColumn("window", F.floor(F.col("pos") / size)).withColumn("place", F.col("pos") % size)


def bucket(length: Column, buckets: list[int]) -> Column:
    """The smallest bucket that holds a length; the largest for longer ones."""
    out = F.lit(max(buckets))
    for b in sorted(buckets, reverse=True):
        out = F.when(length <= b, b).otherwise(out)
    return out


def mean_log_probs(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows(key, offset, label, log_prob, mask) of overlapping windows -> the log of the mean probability of each offset and label."""
    top = rows.filter("mask").groupBy(key, "offset", "label").agg(F.max("log_prob").alias("top"))
    joined = rows.filter("mask").join(top, [key, "offset", "label"])
    return joined.groupBy(key, "offset", "label").agg((F.first("top") + F.log(F.sum(F.exp(F.col("log_prob") - F.col("top")))) - F.log(F.count("*"))).alias("log_prob"))


def bioes_labels(labels: list[str]) -> list[str]:
    return ["O", *[f"{t}-{x}" for x in labels for t in "BIES"]]


def transition_allowed(a: str, b: str) -> bool:
    """Whether token label b may follow a."""
    ta, la, tb, lb = a[:1], a[2:], b[:1], b[2:]
    return tb in "IE" and lb == la if ta in "BI" else tb in "OBS"


def viterbi(rows: DataFrame, labels: list[str], biases: dict[tuple[str, str], float] | None = None, key: str = "doc_id") -> DataFrame:
    """rows(key, scores: array of tokens by labels) with ``path``, the best allowed label indexes; argmax by token where no path is finite; ties to the lowest index.

    biases: added to the transition between two boundary tags, e.g. ("O", "B"). Begins with B, S or O, ends with E, S or O.
    """
    n, low = len(labels), float("-inf")
    bias = biases or {}
    moves = F.array(*[F.array(*[F.lit(bias.get((labels[i][:1], labels[j][:1]), 0.0) if transition_allowed(labels[i], labels[j]) else low) for i in range(n)]) for j in range(n)])
    begin = F.array(*[F.lit(0.0 if x[:1] in "BSO" else low) for x in labels])
    end = F.array(*[F.lit(0.0 if x[:1] in "ESO" else low) for x in labels])
    add = lambda xs, ys: F.zip_with(xs, ys, lambda x, y: x + y)
    first_best = lambda xs: F.array_position(xs, F.array_max(xs)).cast("int")

    def step(acc, row):
        options = F.transform(moves, lambda to: add(acc["best"], to))
        return let(options, lambda o: F.struct(F.zip_with(row, o, lambda r, x: r + F.array_max(x)).alias("best"), F.array_append(acc["back"], F.transform(o, first_best)).alias("back")))

    scores = F.col("scores")
    start = F.struct(add(F.get(scores, F.lit(0)), begin).alias("best"), F.array().cast("array<array<int>>").alias("back"))
    rows = rows.withColumn("_v", F.aggregate(F.slice(scores, F.lit(2), F.size(scores)), start, step))
    rows = rows.withColumn("_end", add(F.col("_v.best"), end))
    walk = F.aggregate(F.reverse("_v.back"), F.array(first_best(F.col("_end"))), lambda path, back: F.concat(F.array(F.element_at(back, F.get(path, F.lit(0)))), path))
    alone = F.transform(scores, first_best)
    return rows.withColumn("path", F.transform(F.when(F.array_max("_end") > low, walk).otherwise(alone), lambda x: x - 1)).drop("_v", "_end")


def bioes_spans(labels: Column) -> Column:
    """array<string> of token labels -> array<struct<label, start, end>>: a tolerant reading; a lone I or E opens a span, O or a change closes one."""
    out = F.array().cast("array<struct<label:string,start:int,end:int>>")
    start = F.struct(out.alias("out"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("from"), F.lit(0).alias("at"))

    def step(a, x):
        tag, name = F.substring(x, 1, 1), F.when(x == "O", F.lit(None)).otherwise(F.substr(x, F.lit(3), F.length(x)))
        here = a["at"]
        same = F.coalesce(a["label"] == name, F.lit(False))
        closed = F.when(a["label"].isNotNull(), F.array_append(a["out"], F.struct(a["label"].alias("label"), a["from"].alias("start"), here.alias("end")))).otherwise(a["out"])
        one = F.struct(name.alias("label"), here.alias("start"), (here + 1).alias("end"))
        none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
        state = lambda o, n, f: F.struct(o.alias("out"), n.alias("label"), f.alias("from"), (here + 1).alias("at"))
        return (
            F.when(name.isNull(), state(closed, none_s, none_i))
            .when(tag == "S", state(F.array_append(closed, one), none_s, none_i))
            .when((tag == "I") & same, state(a["out"], a["label"], a["from"]))
            .when((tag == "E") & same, state(F.array_append(a["out"], F.struct(a["label"].alias("label"), a["from"].alias("start"), (here + 1).alias("end"))), none_s, none_i))
            .when(tag == "E", state(F.array_append(closed, one), none_s, none_i))
            .otherwise(state(closed, name, here))
        )

    last = lambda a: F.when(a["label"].isNotNull(), F.array_append(a["out"], F.struct(a["label"].alias("label"), a["from"].alias("start"), a["at"].alias("end")))).otherwise(a["out"])
    return F.aggregate(labels, start, step, last)


def mean_log_prob_filter(rows: DataFrame, least: float) -> DataFrame:
    """rows(start, end, log_probs by token) whose mean over the span is at least ``least``."""
    part = F.slice("log_probs", F.col("start") + 1, F.col("end") - F.col("start"))
    return rows.withColumn("mean_log_prob", F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)).filter(F.col("mean_log_prob") >= least)


def token_to_char(rows: DataFrame) -> DataFrame:
    """rows(start, end in tokens, char_starts, char_ends) with char_start, char_end; spans beyond the tokens or without length go."""
    good = rows.filter((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.size("char_starts")))
    good = good.withColumn("char_start", F.get("char_starts", F.col("start"))).withColumn("char_end", F.get("char_ends", F.col("end") - 1))
    return good.filter("char_end > char_start")


def trim_ascii(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end) without blanks and punctuation at the edges."""
    value = byte_slice(text, start, end)
    left, right = F.octet_length(F.ltrim(value, F.lit(TRIM))), F.octet_length(F.rtrim(value, F.lit(TRIM)))
    return F.struct((end - left).alias("start"), (start + right).alias("end"))


def secondary(docs: DataFrame, primary: DataFrame, run, gate: Column, key: str = "doc_id") -> DataFrame:
    """primary outputs and those of run(docs) for the documents that pass the gate only; the filter stands before the model."""
    return primary.unionByName(run(docs.filter(gate)), allowMissingColumns=True)


def cascade(docs: DataFrame, primary: DataFrame, secondary_spans: DataFrame, trigger: str = "missing", entity: str = "location", uncertain: float = 0.97, policy: str = "none", key: str = "doc_id") -> DataFrame:
    """Secondary spans where the primary ones lack the entity (missing), or are below ``uncertain`` too (missing_or_uncertain), always or never; then the highest score for each entity and range."""
    if trigger not in ("never", "missing", "missing_or_uncertain", "always"):
        raise ValueError("unknown trigger")
    have = primary.filter(F.col("entity") == entity).groupBy(key).agg(F.max("score").alias("_top"))
    state = docs.select(key, "text").join(have, key, "left")
    wanted = {"never": F.lit(False), "always": F.lit(True), "missing": F.col("_top").isNull(), "missing_or_uncertain": F.col("_top").isNull() | (F.col("_top") < uncertain)}[trigger]
    if policy != "none":
        context = _holds(F.col("text"), STRONG_LOCATION)
        wanted = wanted & (context if policy == "strong" else context | F.col("_top").isNotNull())
    extra = secondary_spans.join(state.filter(wanted).select(key), key, "left_semi").withColumn("role", F.lit("secondary"))
    both = primary.withColumn("role", F.lit("primary")).unionByName(extra, allowMissingColumns=True)
    return both.groupBy(key, "entity", "byte_start", "byte_end").agg(F.max("score").alias("score"), F.max_by("role", "score").alias("role"))
