"""Rewriting: each span's bytes are replaced by an operator's result, with the byte ranges before and after."""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.spans import let, running, update
from palimpsest.functions.text import byte_slice, bytes_slice, graphemes, utf8
from palimpsest.operators import conflict

#: The default replacements.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "credit_card": "[CREDIT_CARD]", "iban": "[IBAN]", "us_ssn": "[US_SSN]", "ip_address": "[IP_ADDRESS]", "domain": "[DOMAIN]", "url": "[URL]"}
REDACTED = "[REDACTED]"
#: First part of an encoded hash.
HASH_LABEL = "palimpsest"
OPTIONS = {"replace": {"value"}, "redact": set(), "mask": {"char", "keep_last"}, "hash": {"algorithm", "mode", "salt"}, "pseudonymize": {"vault"}, "custom": {"function"}}


class OperatorError(ValueError):
    """An invalid configuration or failed operator. Carries a code only, never a value from a text."""

    CODES = ("invalid_operator", "unknown_option", "invalid_option", "missing_salt", "unexpected_salt", "invalid_span", "custom_failed", "invalid_strategy")

    def __init__(self, code: str, operator: str = ""):
        super().__init__(f"{code}: {operator}" if operator else code)
        self.code = code


@dataclass(frozen=True)
class Operators:
    """Operator configuration by entity; checked before any text is read. A map of one's own replaces the placeholders, and gets ``default`` if it has none."""

    by_entity: dict | None = None

    def table(self) -> dict[str, dict]:
        if not self.by_entity:
            return {e: {"type": "replace", "value": v} for e, v in PLACEHOLDERS.items()} | {"default": {"type": "replace", "value": REDACTED}}
        return {"default": {"type": "replace", "value": REDACTED}} | {e: c for e, c in self.by_entity.items() if e not in ("conflict_policy", "merge_whitespace")}

    def validate(self) -> Operators:
        for config in self.table().values():
            kind = config.get("type")
            if kind not in OPTIONS:
                raise OperatorError("invalid_operator")
            if set(config) - {"type"} - OPTIONS[kind]:
                raise OperatorError("unknown_option", kind)
            if kind == "replace" and not isinstance(config.get("value", REDACTED), str):
                raise OperatorError("invalid_option", kind)
            if kind == "mask" and (len(config.get("char", "*")) != 1 or not isinstance(config.get("keep_last", 0), int) or config.get("keep_last", 0) < 0):
                raise OperatorError("invalid_option", kind)
            if kind == "hash":
                mode, salt = config.get("mode", "secure"), config.get("salt")
                if config.get("algorithm", "sha256") not in ("sha256", "sha512") or mode not in ("secure", "deterministic"):
                    raise OperatorError("invalid_option", kind)
                if mode == "deterministic" and (salt is None or len(salt) < 16):
                    raise OperatorError("missing_salt", kind)
                if mode == "secure" and salt is not None:
                    raise OperatorError("unexpected_salt", kind)
            if kind == "custom" and not callable(config.get("function")):
                raise OperatorError("invalid_option", kind)
        return self


def mask(value: Column, char: str = "*", keep_last: int = 0) -> Column:
    """All graphemes but the last few replaced."""
    return let(graphemes(value), lambda g: F.concat(F.repeat(F.lit(char), F.greatest(F.size(g) - keep_last, F.lit(0))), F.array_join(F.slice(g, F.greatest(F.size(g) - keep_last + 1, F.lit(1)), F.lit(keep_last)), "") if keep_last else F.lit("")))


def _url64(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def _digest(value: Column, salt: Column, algorithm: str) -> Column:
    return F.sha2(F.concat(salt, F.encode(value, "UTF-8")), 512 if algorithm == "sha512" else 256)


def hash_value(value: Column, algorithm: str = "sha256", mode: str = "deterministic", salt: bytes | None = None, label: str = HASH_LABEL) -> Column:
    """$label$v1$hash$algorithm$mode$salt$digest of salt and value. secure: a fresh salt for each value, so the column is not deterministic."""
    if mode == "deterministic":
        s = F.unhex(F.lit(bytes(salt).hex()))
    else:
        fresh = F.udf(lambda _: os.urandom(16), "binary").asNondeterministic()
        s = fresh(value)
    return let(s, lambda x: F.concat(F.lit(f"${label}$v1$hash${algorithm}${mode}$"), _url64(x), F.lit("$"), _digest(value, x, algorithm)))


def verify_hash(value: Column, encoded: Column, label: str = HASH_LABEL) -> Column:
    """Whether an encoded hash is the value's; false for anything malformed."""
    parts = F.split(encoded, r"\$")
    raw = F.translate(parts[6], "-_", "+/")
    salt = F.try_to_binary(F.rpad(raw, (F.ceil(F.length(raw) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64"))
    good = encoded.rlike(rf"^\${label}\$v1\$hash\$sha(256|512)\$(secure|deterministic)\$[A-Za-z0-9_-]+\$[0-9a-f]+\z")
    right = F.when(parts[4] == "sha512", _digest(value, salt, "sha512")).otherwise(_digest(value, salt, "sha256"))
    return F.coalesce(F.when(good, parts[7] == right), F.lit(False))


def custom(function, options: dict | None = None):
    """A Python function of (value, entity, options) as an operator, in Arrow batches; any failure ends the query without the value in the message."""

    @F.pandas_udf("string")
    def run(values: pd.Series, entities: pd.Series) -> pd.Series:
        try:
            out = [function(v, e, options or {}) for v, e in zip(values, entities)]
        except Exception:
            raise OperatorError("custom_failed") from None
        if not all(isinstance(x, str) for x in out):
            raise OperatorError("custom_failed")
        return pd.Series(out)

    return run


def replacement(entity: Column, value: Column, table: dict[str, dict], token: Column | None = None) -> Column:
    """The operator's result by entity; token: the pseudonym, where an operator is ``pseudonymize``."""

    def one(config: dict) -> Column:
        kind = config["type"]
        if kind == "replace":
            return F.lit(config.get("value", REDACTED))
        if kind == "redact":
            return F.lit("")
        if kind == "mask":
            return mask(value, config.get("char", "*"), config.get("keep_last", 0))
        if kind == "hash":
            return hash_value(value, config.get("algorithm", "sha256"), config.get("mode", "secure"), config.get("salt"))
        if kind == "pseudonymize" and token is not None:
            return token
        raise OperatorError("invalid_operator", kind)

    out = one(table["default"])
    for e, config in table.items():
        if e != "default":
            out = F.when(entity == e, one(config)).otherwise(out)
    return out


def operator_name(entity: Column, table: dict[str, dict]) -> Column:
    out = F.lit(table["default"]["type"])
    for e, config in table.items():
        out = F.when(entity == e, F.lit(config["type"])).otherwise(out)
    return out


def merge_whitespace(text: Column, spans: Column) -> Column:
    """Neighbours of one entity with only white space between become one span."""
    from palimpsest.functions.spans import cut_at, no_spans, sort_by

    def merged(data):
        def begins(s, i, all_):
            before = F.get(all_, i - 1)
            return ~F.coalesce((before["entity"] == s["entity"]) & (before["byte_end"] <= s["byte_start"]) & bytes_slice(data, before["byte_end"], s["byte_start"]).rlike(r"^(?U)\s*\z"), F.lit(False))

        one = lambda run: F.when(F.size(run) == 1, F.element_at(run, 1)).otherwise(update(F.element_at(run, 1), byte_end=F.element_at(run, -1)["byte_end"], text=F.lit(None)))
        return F.transform(cut_at(sort_by(spans, lambda s: [s["byte_start"], s["byte_end"]]), begins), one)

    return F.when(F.size(spans) > 1, let(utf8(text), merged)).otherwise(F.coalesce(spans, no_spans()))


def spliced(data: Column, items: Column, start, end, new) -> Column:
    """A text, given as its bytes, with the range of each item (ordered, without overlap) replaced; start, end, new: functions of an item."""
    gap = lambda x, i: bytes_slice(data, F.when(i == 0, F.lit(0)).otherwise(end(F.get(items, i - 1))), start(x))
    tail = bytes_slice(data, end(F.element_at(items, -1)), F.octet_length(data))
    return F.concat(F.array_join(F.transform(items, lambda x, i: F.concat(gap(x, i), new(x))), ""), tail)


def valid_span(data: Column, s: Column) -> Column:
    """Of a text's bytes: bounds in the text, start before end, whole characters, and the value (if given) equal to the bytes."""
    slice_ = bytes_slice(data, s["byte_start"], s["byte_end"])
    return (s["byte_start"] >= 0) & (s["byte_start"] < s["byte_end"]) & (s["byte_end"] <= F.octet_length(data)) & F.is_valid_utf8(slice_) & (s["text"].isNull() | (s["text"] == slice_))


def anonymize(docs: DataFrame, operators: Operators | None = None, conflict_strategy: str | bool = "aggressive", merge_ws: bool = False, text: str = "text", spans: str = "spans", strict: bool = False) -> DataFrame:
    """docs with ``anonymized`` and ``items`` (entity, operator, source and replacement byte ranges, replacement, replacement_order).

    Spans that are not valid for the text are left out, or end the query if strict.
    """
    operators = (operators or Operators()).validate()
    if conflict_strategy not in (False, *conflict.STRATEGIES):
        raise OperatorError("invalid_strategy")
    table, value = operators.table(), F.col(text)
    docs = docs.withColumn("_bytes", F.when(F.size(spans) > 0, utf8(value)))
    data = F.col("_bytes")
    invalid = lambda s: ~F.coalesce(valid_span(data, s), F.lit(False))
    good = F.filter(spans, lambda s: ~invalid(s))
    if strict:
        good = F.when(F.exists(spans, invalid), F.raise_error(F.lit("invalid_span"))).otherwise(F.col(spans))
    chosen = merge_whitespace(value, good) if merge_ws else good
    rows = docs.withColumn("_chosen", F.when(F.size(spans) > 0, conflict.resolve(chosen, conflict_strategy)))
    custom_entities = {e: c for e, c in table.items() if c["type"] == "custom"}
    if custom_entities:
        raise OperatorError("invalid_operator", "custom: use anonymize_custom")
    item = "array<struct<entity:string,operator:string,source_byte_start:int,source_byte_end:int,replacement_byte_start:int,replacement_byte_end:int,replacement:string,replacement_order:string>>"
    order = F.when(F.size("_chosen") >= 2, "right_to_left")
    made = F.transform("_chosen", lambda s: F.struct(s["entity"].alias("entity"), s["byte_start"].alias("b"), s["byte_end"].alias("e"), replacement(s["entity"], bytes_slice(data, s["byte_start"], s["byte_end"]), table).alias("new")))
    rows = rows.withColumn("_new", F.when(F.size("_chosen") > 0, made))
    #: What the replacements before have added.
    moved = running(F.transform("_new", lambda x: F.octet_length(x["new"]) - (x["e"] - x["b"])), F.lit(0), lambda a, x: a + x)

    def described(x, by):
        at = x["b"] + by
        return F.struct(x["entity"].alias("entity"), operator_name(x["entity"], table).alias("operator"), x["b"].alias("source_byte_start"), x["e"].alias("source_byte_end"),
            at.alias("replacement_byte_start"), (at + F.octet_length(x["new"])).alias("replacement_byte_end"), x["new"].alias("replacement"), order.alias("replacement_order"))

    text_ = F.when(F.col("_new").isNull(), value).otherwise(spliced(data, F.col("_new"), lambda x: x["b"], lambda x: x["e"], lambda x: x["new"]))
    items = F.when(F.col("_new").isNull(), F.array().cast(item)).otherwise(F.zip_with("_new", moved, described))
    return rows.withColumn("anonymized", text_).withColumn("items", items).drop("_chosen", "_new", "_bytes")


def exploded(done: DataFrame, *keep: str) -> DataFrame:
    """keep and i: a row for each item of ``anonymize``.

    From ``explode`` the optimizer infers a filter on the size of the items and moves it below the steps that make them. There each step is written out in all places
    that use it: a text is scanned dozens of times, and encoded again for each span. From ``explode_outer`` it infers none.
    """
    return done.select(*keep, F.explode_outer("items").alias("i")).filter(F.col("i").isNotNull())


def anonymize_custom(docs: DataFrame, function, options: dict | None = None, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """key, anonymized: every span replaced by a Python function, called on batches of values."""
    value = F.col(text)
    rows = docs.select(key, F.col(text).alias("_text"), F.posexplode(conflict.resolve(F.col(spans), "aggressive")).alias("at", "s"))
    rows = rows.withColumn("new", custom(function, options)(byte_slice(F.col("_text"), F.col("s.byte_start"), F.col("s.byte_end")), F.col("s.entity")))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("s.byte_start").alias("b"), F.col("s.byte_end").alias("e"), "new"))).alias("_new"))
    joined = docs.join(lists, key, "left")
    joined = joined.withColumn("_bytes", F.when(F.col("_new").isNotNull(), utf8(value)))
    done = spliced(F.col("_bytes"), F.col("_new"), lambda x: x["b"], lambda x: x["e"], lambda x: x["new"])
    return joined.select(key, F.when(F.col("_new").isNull(), value).otherwise(done).alias("anonymized"))


def redact(docs: DataFrame, options=None, operators: Operators | None = None, conflict_strategy: str | bool = "aggressive", merge_ws: bool = False, text: str = "text") -> DataFrame:
    """Analysis (its default policy keeps overlaps of different entities), then rewriting (which does not)."""
    from palimpsest.operators.analyze import analyze

    return anonymize(analyze(docs, options, text=text), operators, conflict_strategy, merge_ws, text=text)


def random_salt() -> str:
    return base64.urlsafe_b64encode(os.urandom(16)).decode().rstrip("=")
