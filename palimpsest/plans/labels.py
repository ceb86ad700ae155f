"""Label spaces of models: outside label to entity, boundary tags, and the policy defaults of profiles."""

from __future__ import annotations

from palimpsest.operators.model import bioes_labels, transition_allowed

#: Labels by label set.
LABEL_MAPS = {
    "conll": {"PER": "person", "LOC": "location", "ORG": "organization", "MISC": "misc"},
    "ontonotes": {"PERSON": "person", "GPE": "location", "LOC": "location", "FAC": "location", "ORG": "organization", "NORP": "organization", "DATE": "date_time", "TIME": "date_time"},
    "gliner": {"person": "person", "location": "location", "organization": "organization", "email": "email", "phone number": "phone", "address": "street_address"},
}
#: Thresholds of profiles with models.
MODEL_THRESHOLD = 0.7
SECONDARY_LOCATION = {"threshold": 0.999, "trigger": "missing"}
SPAN_THRESHOLDS = {"person": 0.5, "organization": 0.9, "location": 0.5}
BUCKETS = (192, 256, 384, 512, 768)


def label_map(name: str, extra: dict[str, str] | None = None) -> dict[str, str]:
    return LABEL_MAPS[name] | (extra or {})


def label_space(labels: list[str], background: str = "O") -> dict:
    """Token labels with their tags; every label must have all four tags, and the background one."""
    full = bioes_labels(sorted(set(labels)))
    return {"labels": full, "background": background, "tags": {x: x[:1] for x in full}, "allowed": [(a, b) for a in full for b in full if transition_allowed(a, b)]}


def check_complete(token_labels: list[str]) -> None:
    names = {x[2:] for x in token_labels if x != "O"}
    missing = set(bioes_labels(sorted(names))) - set(token_labels)
    if missing:
        raise ValueError(f"incomplete label space: {len(missing)} labels are missing")


def decoder(kind: str = "viterbi", least_log_prob: float | None = None) -> dict:
    """argmax or viterbi; raw logits will do where paths are compared only, which is Viterbi without a limit on log-probabilities."""
    if kind not in ("argmax", "viterbi"):
        raise ValueError("unknown decoder")
    return {"kind": kind, "raw_logits": kind == "viterbi" and least_log_prob is None}
