"""Logs and telemetry that carry no personal data."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.structured import SENSITIVE

#: What telemetry may carry.
MEASUREMENTS = ("duration", "count", "input_bytes", "span_count")
METADATA = ("profile", "status", "operation", "entity_counts")


class RedactingFilter(logging.Filter):
    """Replaces values of sensitive keys in a record's mapping arguments and extras, whole texts by their length."""

    def filter(self, record: logging.LogRecord) -> bool:
        if isinstance(record.args, dict):
            record.args = {k: "[REDACTED]" if k in SENSITIVE else v for k, v in record.args.items()}
        for k in SENSITIVE:
            if hasattr(record, k):
                setattr(record, k, "[REDACTED]")
        return True


def safe_event(measurements: dict, metadata: dict) -> tuple[dict, dict]:
    """Allowed keys only: other measurements become 0, other metadata ``redacted``."""
    return {k: v if k in MEASUREMENTS and isinstance(v, (int, float)) else 0 for k, v in measurements.items()}, {k: v if k in METADATA else "redacted" for k, v in metadata.items()}


def observed(docs: DataFrame, name: str, spans: str = "spans") -> DataFrame:
    """docs with counts as observed metrics of the query that runs it."""
    return docs.observe(name, F.count("*").alias("count"), F.sum(F.size(spans)).alias("span_count"))


def redact_request(params: dict, mode: str = "replace") -> dict:
    """Parameters or headers of a request, for a handler or foreachBatch sink: replace, assign_redacted (beside the original) or disabled."""
    clean = {k: "[REDACTED]" if k.lower().replace("-", "_") in SENSITIVE else v for k, v in params.items()}
    return {"replace": clean, "assign_redacted": params | {"redacted": clean}, "disabled": params}[mode]
