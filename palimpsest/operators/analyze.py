"""Analysis of a text column: recognizers, filters, context and conflict policy, all inside the row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.spans import no_spans, span, update
from palimpsest.functions.text import LANGUAGES, tokens, utf8
from palimpsest.operators import conflict, context
from palimpsest.operators import model as M
from palimpsest.operators.recognize import Registry
from palimpsest.plans.labels import MODEL_THRESHOLD, label_map
from palimpsest.plans.profiles import MODEL_ENTITIES, NER_ENTITIES, PHI_ENTITIES, entities_of, profile_of


@dataclass
class Options:
    """What an analysis may be told. Checked once, on the driver, before any plan is built."""

    entities: tuple[str, ...] | None = None
    profile: str = "regex_only"
    language: str = "en"
    score_threshold: float = 0.0
    include_text: bool = True
    #: As in the analyzer, not checked: an unknown name is the default policy.
    conflict_strategy: str | bool | None = "default"
    registry: Registry = field(default_factory=Registry)
    allow_list: list[dict] = field(default_factory=list)
    context: context.ContextOptions = field(default_factory=context.ContextOptions)
    phone_accept: Callable[[Column], Column] | None = None
    detect_language: Callable[[Column], Column] | None = None
    #: How a model's outputs are read: label to entity, least score, and what else ``model.normalize`` takes.
    model_labels: dict[str, str] = field(default_factory=lambda: label_map("conll") | label_map("ontonotes") | label_map("gliner") | {e: e for e in (*NER_ENTITIES, *PHI_ENTITIES)})
    model_threshold: float = MODEL_THRESHOLD
    model_options: dict = field(default_factory=dict)

    def __post_init__(self):
        self.profile = profile_of(self.profile)
        if self.language not in LANGUAGES:
            raise ValueError("unsupported language")
        if self.entities is None:
            self.entities = entities_of(self.profile)
        self.entities = tuple(self.entities)
        if not all(isinstance(e, str) for e in self.entities):
            raise ValueError("entities must be names")
        c = self.context
        if isinstance(self.score_threshold, bool) or not isinstance(self.score_threshold, (int, float)) or self.score_threshold < 0:
            raise ValueError("score_threshold must be a number from 0")
        if min(c.window, c.prefix_count, c.suffix_count) < 0 or min(c.boost, c.min_score) < 0:
            raise ValueError("context options must not be negative")
        if c.match not in ("whole_word", "substring"):
            raise ValueError("context_match must be whole_word or substring")
        if not all(isinstance(w, str) for w in c.words):
            raise ValueError("context must be words")
        for e in self.allow_list:
            if not isinstance(e, dict) or set(e) - {"entity", "values", "patterns", "case_sensitive"}:
                raise ValueError("invalid allow list entry")
        self.registry.check(self.own_entities)

    @property
    def own_entities(self) -> tuple[str, ...]:
        """What the recognizers are asked for: all but what only the profile's models can find."""
        of_models = MODEL_ENTITIES.get(self.profile, ())
        return tuple(e for e in self.entities if e not in of_models or e in self.registry.supported())


def allowed(s: Column, entries: list[dict]) -> Column:
    """Whether any entry allows the span: its entity (if given), and one of its values or patterns."""
    out = F.lit(False)
    for e in entries:
        hit = F.lit(False)
        if e.get("values"):
            exact = e.get("case_sensitive", True)
            value = s["text"] if exact else F.lower(s["text"])
            hit = hit | value.isin([v if exact else v.lower() for v in e["values"]])
        for p in e.get("patterns", ()):
            hit = hit | s["text"].rlike(p)
        out = out | ((s["entity"] == e["entity"]) & hit if e.get("entity") else hit)
    return F.coalesce(out, F.lit(False))


def analyze_column(text: Column, options: Options) -> Column:
    """The spans of a text: requested entities, not allowed, accepted by context and threshold, after the conflict policy, in range order."""
    found = options.registry.spans(text, options.own_entities, options.profile, options.phone_accept)
    found = F.filter(found, lambda s: s["entity"].isin(*options.entities))
    if options.allow_list:
        found = F.filter(found, lambda s: ~allowed(s, options.allow_list))
    return found


def finish(rows: DataFrame, text: Column, found: str, options: Options, out: str) -> DataFrame:
    """rows with out, what follows recognition of the spans in the column found: context, acceptance, threshold, dropped text, conflicts.

    Each step is a column of its own. As one expression they nest deeper than the analyzer resolves; the optimizer puts them together again.
    """
    some = F.size(found) > 0
    active = not (options.profile == "regex_only" and not options.context.words)
    toks = F.when(some & context.needed(F.col(found), options.context), tokens(text)) if active else F.lit(None)
    rows = rows.withColumn("_toks", toks).withColumn("_data", F.when(some, utf8(text)))
    rows = rows.withColumn("_kept", F.when(some, context.enhance(text, F.col(found), options.context, active, F.col("_toks"), F.col("_data"))).otherwise(F.col(found)))
    kept = F.filter("_kept", lambda s: context.accepted(s) & (s["score"] >= options.score_threshold))
    if not options.include_text:
        kept = F.transform(kept, lambda s: update(s, text=F.lit(None)))
    rows = rows.withColumn("_kept", F.when(some, kept).otherwise(F.col(found)))
    done = F.when(F.size("_kept") > 0, conflict.resolve(F.col("_kept"), options.conflict_strategy)).otherwise(F.col("_kept"))
    return rows.withColumn(out, done).drop("_toks", "_data", "_kept")


def model_spans(docs: DataFrame, outputs: DataFrame, options: Options, key: str, text: str) -> DataFrame:
    """key, _model: the spans of a model's outputs(key, label, start, end, offset_unit, score) for each document that has any. A document's outputs meet in a task."""
    given = {"default": options.model_threshold} | options.model_options
    rows = M.normalize(outputs, docs.select(key, F.col(text).alias("text")), options.model_labels, key=key, **given)
    one = span(entity=F.col("entity"), byte_start=F.col("byte_start"), byte_end=F.col("byte_end"), score=F.col("score"), text=F.col("text"), source_entity=F.col("source_entity"), recognizer=F.lit("ner"), requires_context=F.col("requires_context"), model_label=F.col("source_entity"))
    return rows.groupBy(F.col(key).alias("_key")).agg(F.collect_list(one).alias("_model"))


def analyze(docs: DataFrame, options: Options | None = None, text: str = "text", spans: str = "spans", outputs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """docs with a spans column; null where the text is null or not valid UTF-8, with the reason in ``error``.

    Recognition is a step of its own: the array of found spans is computed once, and documents without any skip the rest. outputs: what a model
    says of the documents (see ``model_spans``), joined on key; its spans go through the same filters, context and policy. Models themselves run elsewhere.
    """
    options = options or Options()
    value = F.col(text)
    ok = value.isNotNull() & F.is_valid_utf8(value)
    found = docs.withColumn("_found", F.when(ok, analyze_column(value, options)))
    if outputs is not None:
        found = found.join(model_spans(docs, outputs, options, key, text), F.col(key) == F.col("_key"), "left").drop("_key")
        wanted = F.filter(F.coalesce("_model", no_spans()), lambda s: s["entity"].isin(*options.entities) & ~allowed(s, options.allow_list))
        found = found.withColumn("_found", F.when(ok, F.concat("_found", wanted))).drop("_model")
    if options.detect_language is not None:
        found = found.withColumn("language", F.coalesce(options.detect_language(value), F.lit("unknown")))
    return finish(found, value, "_found", options, spans).withColumn("error", F.when(~ok & value.isNotNull(), "invalid_utf8")).drop("_found")
