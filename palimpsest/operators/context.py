"""Context scoring: the words around a span raise its score, satisfy its need for context, or speak against it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.spans import FIELDS, let, update
from palimpsest.functions.text import bytes_slice, token_norms, tokens, utf8


@dataclass(frozen=True)
class ContextOptions:
    words: tuple[str, ...] = ()
    window: int = 30
    prefix_count: int = 5
    suffix_count: int = 5
    boost: float = 0.15
    min_score: float = 0.4
    match: str = "whole_word"
    #: By (recognizer, entity), recognizer or entity: add_words, min_score, require_context_below, lower_below with multiplier, reject_below.
    policies: dict = field(default_factory=dict)


def byte_window(data: Column, start: Column, end: Column, size: int) -> Column:
    """Of a text's bytes, from size bytes before the span to size after it, the span included, cut to whole characters."""
    from_, to = F.greatest(start - size, F.lit(0)), F.least(end + size, F.octet_length(data))
    return F.regexp_replace(F.make_valid_utf8(bytes_slice(data, from_, to)), "^�+|�+\\z", "")


def surrounding_terms(toks: Column, start: Column, end: Column, before: int = 5, after: int = 5) -> Column:
    """Normalised tokens: the last ``before`` that end by start, the first ``after`` that begin at end or later."""
    left = let(F.filter(toks, lambda t: t["byte_end"] <= start), lambda x: F.slice(x, F.greatest(F.size(x) - before + 1, F.lit(1)), F.lit(before)))
    right = F.slice(F.filter(toks, lambda t: t["byte_start"] >= end), F.lit(1), F.lit(after))
    return F.filter(F.transform(F.concat(left, right), lambda t: t["norm"]), lambda n: n != "")


def _word_hit(word: Column, terms: Column) -> Column:
    joined = lambda xs: F.concat(F.lit("\x01"), F.array_join(xs, "\x01"), F.lit("\x01"))
    return let(F.filter(token_norms(word), lambda n: n != ""), lambda parts: (F.size(parts) > 0) & F.contains(joined(terms), joined(parts)))


def matched_words(data: Column, toks: Column, s: Column, words: Column, o: ContextOptions) -> Column:
    """The words found among the terms around the span, as runs of whole tokens; if none, those that the byte window contains."""
    loose = let(F.lower(byte_window(data, s["byte_start"], s["byte_end"], o.window)), lambda low: F.filter(words, lambda w: F.contains(low, F.lower(w))))
    if o.match == "substring":
        return loose
    terms = surrounding_terms(toks, s["byte_start"], s["byte_end"], o.prefix_count, o.suffix_count)
    whole = let(terms, lambda t: F.filter(words, lambda w: _word_hit(w, t)))
    return let(whole, lambda x: F.when(F.size(x) > 0, x).otherwise(loose))


def _policy(s: Column, policies: dict) -> Column:
    out = s
    def rank(key):
        return 2 if isinstance(key, tuple) else 1
    for key, p in sorted(policies.items(), key=lambda kv: (rank(kv[0]), str(kv[0]))):
        if isinstance(key, tuple):
            hit = (s["recognizer"] == key[0]) & (s["entity"] == key[1])
        else:
            hit = (s["recognizer"] == key) | (s["entity"] == key)
        score = s["score"]
        if "lower_below" in p:
            score = F.when(score < p["lower_below"], score * p.get("multiplier", 1.0)).otherwise(score)
        needs = F.coalesce(s["requires_context"], F.lit(False))
        for limit in ("require_context_below", "reject_below"):
            if limit in p:
                needs = needs | (s["score"] < p[limit])
        words = F.array_distinct(F.concat(F.coalesce(s["context_words"], F.array().cast("array<string>")), F.array(*map(F.lit, p.get("add_words", []))).cast("array<string>")))
        least = F.lit(p["min_score"]) if "min_score" in p else s["context_min_score"]
        out = F.when(hit, update(s, score=score, requires_context=needs, context_words=words, context_min_score=least)).otherwise(out)
    return out


def needed(spans: Column, o: ContextOptions) -> Column:
    """Whether some span has words to look for: only then are the tokens of a text built."""
    none = F.array().cast("array<string>")
    return F.size(spans) > 0 if o.words or o.policies else F.exists(spans, lambda s: (F.size(F.coalesce(s["context_words"], none)) > 0) | (F.size(F.coalesce(s["negative_words"], none)) > 0))


def enhance(text: Column, spans: Column, o: ContextOptions, active: bool = True, toks: Column | None = None, data: Column | None = None) -> Column:
    """spans with scores after context. Without words of their own, from the options or by a policy, spans stay as they are. toks, data: the text's tokens (where ``needed``) and bytes, if they are at hand."""
    if not active or (not o.words and o.boost == 0 and not o.policies):
        return spans
    none = F.array().cast("array<string>")
    unique = lambda ws: F.aggregate(ws, none, lambda a, w: F.when(F.exists(a, lambda x: F.lower(x) == F.lower(w)), a).otherwise(F.array_append(a, w)))

    def one(toks, data, raw):
        moved = _policy(raw, o.policies) if o.policies else raw
        return let(moved, lambda s: let(unique(F.concat(F.coalesce(s["context_words"], none), F.array(*map(F.lit, o.words)).cast("array<string>"))), lambda words: let(
            F.struct(matched_words(data, toks, s, words, o).alias("for_"), F.coalesce(matched_words(data, toks, s, F.coalesce(s["negative_words"], none), o), none).alias("against")), lambda m: scored(raw, s, m["for_"], m["against"]))))

    def scored(raw, s, matched, against):
        weak = F.coalesce(s["weak_words"], none)
        only_weak = (F.size(weak) > 0) & F.forall(matched, lambda w: F.exists(weak, lambda x: F.lower(x) == F.lower(w)))
        score = F.least(F.greatest(s["score"] + o.boost, F.greatest(F.coalesce(s["context_min_score"], F.lit(o.min_score)), F.lit(0.0))), F.lit(1.0))
        strong = (F.size(matched) > 0) & ~only_weak
        strength = F.when(strong, "strong").when(F.size(matched) > 0, "weak").when(F.size(against) > 0, "negative")
        return update(
            s,
            original_score=raw["score"],
            score=F.when(strong, score).otherwise(s["score"]),
            context_matched=F.when(strong, matched),
            context_strength=strength,
            negative_words=F.when(F.size(against) > 0, against),
        )

    plain = F.transform(spans, lambda s: update(s, original_score=s["score"], negative_words=F.lit(None).cast(FIELDS["negative_words"])))
    bound = F.struct((tokens(text) if toks is None else toks).alias("toks"), (utf8(text) if data is None else data).alias("data"))
    return F.when(needed(spans, o), let(bound, lambda x: F.transform(spans, lambda raw: one(x["toks"], x["data"], raw)))).otherwise(plain)


def accepted(s: Column) -> Column:
    """Not spoken against where that rejects; with strong context where that is needed."""
    return ~(F.coalesce(s["negative_reject"], F.lit(False)) & (F.size(F.coalesce(s["negative_words"], F.array().cast("array<string>"))) > 0)) & (~F.coalesce(s["requires_context"], F.lit(False)) | s["context_matched"].isNotNull())
