"""Overlap policies over a document's array of spans. No policy needs a shuffle: each is a fold or filter inside the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.spans import by_run, greedily, in_order, keep_greedily, length, let, overlaps, update

STRUCTURED = ["email", "phone", "credit_card", "iban", "us_ssn", "ip_address", "domain", "url"]
STRATEGIES = ("none", "aggressive", "prefer_longer", "prefer_higher_confidence", "presidio_like")


def _tagged(spans: Column, policy: str, keep) -> Column:
    """keep(spans); all survivors carry the policy if it dropped any span."""
    tag = lambda s: update(s, conflict_policy=F.coalesce(s["conflict_policy"], F.lit(policy)))
    return let(spans, lambda before: let(keep(before), lambda kept: F.when(F.size(kept) < F.size(before), F.transform(kept, tag)).otherwise(kept)))


def prefer_longer(spans: Column) -> Column:
    order = lambda s: [-length(s), -s["score"], s["byte_start"], s["byte_end"], s["entity"]]
    return _tagged(spans, "prefer_longer", lambda x: in_order(keep_greedily(x, order)))


def prefer_higher_confidence(spans: Column) -> Column:
    order = lambda s: [-s["score"], -length(s), s["byte_start"], s["byte_end"], s["entity"]]
    return _tagged(spans, "prefer_higher_confidence", lambda x: in_order(keep_greedily(x, order)))


def _structured_beats_model(run: Column) -> Column:
    rule = lambda s: s["entity"].isin(STRUCTURED) & (F.coalesce(s["recognizer"], F.lit("")) != "ner") & s["model_label"].isNull()
    return let(run, lambda all_: F.filter(all_, lambda s: s["model_label"].isNull() | ~F.exists(all_, lambda r: rule(r) & overlaps(s, r))))


def _without_exact_copies(run: Column) -> Column:
    order = lambda s: [-s["score"], -length(s), s["byte_start"], s["byte_end"], s["entity"]]
    same = lambda a, b: (a["byte_start"] == b["byte_start"]) & (a["byte_end"] == b["byte_end"]) & (a["entity"] == b["entity"])
    return greedily(run, order, same)


def _maximal_of_entity(run: Column) -> Column:
    inside = lambda a, b: (a["entity"] == b["entity"]) & (a["byte_start"] >= b["byte_start"]) & (a["byte_end"] <= b["byte_end"]) & (length(a) < length(b))
    return let(run, lambda all_: F.filter(all_, lambda s: ~F.exists(all_, lambda o: inside(s, o))))


def structured_beats_model(spans: Column) -> Column:
    """Model spans that overlap a rule-based structured entity go."""
    return by_run(spans, _structured_beats_model)


def without_exact_copies(spans: Column) -> Column:
    """One span for each range and entity: the highest score, then the first."""
    return by_run(spans, _without_exact_copies)


def maximal_of_entity(spans: Column) -> Column:
    """Spans that no other span of their entity contains."""
    return by_run(spans, _maximal_of_entity)


def default(spans: Column) -> Column:
    """Structured beats model, exact copies, containment within an entity; overlaps of different entities stay."""
    return _tagged(spans, "presidio_like", lambda x: in_order(by_run(x, lambda run: _maximal_of_entity(_without_exact_copies(_structured_beats_model(run))))))


def resolve(spans: Column, strategy: str | bool | None = "default") -> Column:
    """By the policy's name; as in the analyzer, a name that is not known means the default policy."""
    if strategy in ("none", False):
        return in_order(spans)
    if strategy in ("aggressive", "prefer_longer"):
        return prefer_longer(spans)
    if strategy == "prefer_higher_confidence":
        return prefer_higher_confidence(spans)
    return default(spans)


def cascade_merge(spans: Column) -> Column:
    """The highest score for each entity and range; in range order."""
    return in_order(without_exact_copies(spans))


def discard_overlaps_by_label(spans: Column) -> Column:
    """Within a label, from the earliest and longest on, spans that overlap none kept."""
    order = lambda s: [s["byte_start"], -length(s)]
    clash = lambda a, b: (a["entity"] == b["entity"]) & overlaps(a, b)
    return in_order(keep_greedily(spans, order, clash))


def suppress(spans: Column, flat: bool = True, multi_label: bool = False) -> Column:
    """Non-maximum suppression of decoded spans by score. flat: no overlap at all, else nesting may stay. multi_label: different entities may share a range."""
    def clash(a, b):
        same = (a["byte_start"] == b["byte_start"]) & (a["byte_end"] == b["byte_end"])
        nested = ((a["byte_start"] >= b["byte_start"]) & (a["byte_end"] <= b["byte_end"])) | ((b["byte_start"] >= a["byte_start"]) & (b["byte_end"] <= a["byte_end"]))
        hit = overlaps(a, b) if flat else overlaps(a, b) & (~nested | same)
        return hit & ~(same & (a["entity"] != b["entity"])) if multi_label else hit

    return in_order(keep_greedily(spans, lambda s: [-s["score"], s["byte_start"]], clash))
