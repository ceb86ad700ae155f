"""Redaction of nested data and of conversations."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import anonymize as A
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze

#: Keys whose values are always replaced.
SENSITIVE = ("password", "password_hash", "token", "authorization", "api_key", "secret", "ssn", "credit_card")
MAX_DEPTH = 20


def leaves(docs: DataFrame, column: str, key: str = "doc_id", max_depth: int = MAX_DEPTH) -> DataFrame:
    """key, path (array of strings), value, kind (string, other or empty), marks (for each step of the path k, a key, or i, an index) of each leaf of a JSON column, in order of ``at``.

    An empty object or list is a leaf. Depth beyond max_depth ends the query.
    """

    @F.pandas_udf("array<struct<path:array<string>,value:string,kind:string,marks:string,at:int>>")
    def walk(texts: pd.Series) -> pd.Series:
        def down(x, path, marks, out):
            if len(path) > max_depth:
                raise ValueError("max_depth_exceeded")
            if isinstance(x, dict) and x:
                for k, v in x.items():
                    down(v, [*path, k], marks + "k", out)
            elif isinstance(x, list) and x:
                for i, v in enumerate(x):
                    down(v, [*path, str(i)], marks + "i", out)
            else:
                kind = "string" if isinstance(x, str) else "empty" if isinstance(x, (dict, list)) else "other"
                out.append((path, x if isinstance(x, str) else json.dumps(x), kind, marks, len(out)))
            return out

        return texts.map(lambda t: down(json.loads(t), [], "", []) if t else [])

    return docs.select(key, F.explode(walk(F.col(column))).alias("x")).select(key, "x.*")


def redact_leaves(rows: DataFrame, policies: dict[str, object] | None = None, options: Options | None = None, operators: A.Operators | None = None, dry_run: bool = False) -> DataFrame:
    """rows(path, value, kind) with action and new_value. Policies by the last key: "drop", "keep", "traverse", ("replace", v), ("operator", config), ("entity", name).

    Keys that are sensitive by name are replaced whatever their type; text leaves else go through analysis and rewriting. A dry run changes nothing but what drop and replace say.
    """
    policies = policies or {}
    name = F.try_element_at("path", F.lit(-1))
    action, new = F.lit("analyze"), F.lit(None).cast("string")
    for k in SENSITIVE:
        if k not in policies:
            action, new = F.when(name == k, "sensitive").otherwise(action), F.when(name == k, F.col("value") if dry_run else F.lit(A.REDACTED)).otherwise(new)
    for k, p in policies.items():
        hit = name == k
        if p == "drop" or p == "keep":
            action, new = F.when(hit, p).otherwise(action), F.when(hit, F.lit(None) if p == "drop" else F.col("value")).otherwise(new)
        elif isinstance(p, tuple) and p[0] == "replace":
            action, new = F.when(hit, "replace").otherwise(action), F.when(hit, F.lit(p[1])).otherwise(new)
        elif isinstance(p, tuple) and p[0] in ("operator", "entity"):
            config = p[1] if p[0] == "operator" else (operators or A.Operators()).table().get(p[1], {"type": "replace", "value": A.REDACTED})
            A.Operators({"default": config}).validate()
            result = F.col("value") if dry_run else A.replacement(F.lit("field"), F.col("value"), {"default": config})
            action, new = F.when(hit, p[0]).otherwise(action), F.when(hit, result).otherwise(new)
    rows = rows.withColumn("action", F.when((F.col("kind") != "string") & (action == "analyze"), "opaque").otherwise(action)).withColumn("new_value", new)
    found = analyze(rows.withColumn("_text", F.when(F.col("action") == "analyze", F.col("value"))), options, text="_text")
    done = A.anonymize(found, operators, text="_text")
    text = F.when(F.col("action") == "opaque", F.col("value")).when(F.col("action") == "analyze", F.col("value") if dry_run else F.col("anonymized")).otherwise(F.col("new_value"))
    return done.withColumn("new_value", text).drop("_text", "anonymized", "spans", "error")


def renest(rows: DataFrame, key: str = "doc_id", value: str = "new_value") -> DataFrame:
    """key, json: the documents of redact_leaves() again, with the new values; leaves that were dropped are gone from their object or list. One document's leaves meet in a task."""

    @F.pandas_udf("string")
    def build(lists: pd.Series) -> pd.Series:
        def one(leaves_):
            root, places = [None], {}  # a list of one, so that a document that is a single value is built alike; place of each index that is left in its list
            for leaf in sorted(leaves_, key=lambda x: x["at"]):
                if leaf["action"] == "drop":
                    continue
                where, step = root, 0
                for name, mark in zip(leaf["path"], leaf["marks"]):
                    if where[step] is None:
                        where[step] = {} if mark == "k" else []
                    where = where[step]
                    if mark == "k":
                        where.setdefault(name, None)
                        step = name
                    else:
                        step = places.setdefault((id(where), name), len(where))
                        if step == len(where):
                            where.append(None)
                text, typed = leaf["value"], leaf["kind"] != "string" and leaf["action"] in ("opaque", "keep")
                where[step] = json.loads(text) if typed and text is not None else text
            return json.dumps(root[0], ensure_ascii=False)

        return lists.map(lambda x: one(list(x)))

    leaf = F.struct("at", "path", "marks", "kind", F.col(value).alias("value"), "action")
    return rows.groupBy(key).agg(F.collect_list(leaf).alias("_leaves")).select(key, build("_leaves").alias("json"))


def pseudonymize_leaves(rows: DataFrame, options: Options | None = None, key: str = "doc_id", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows of leaves() with action and new_value: pseudonyms in all text leaves, one vault over all documents; and that vault."""
    from palimpsest.operators import conflict

    texts = rows.withColumn("_leaf", F.concat_ws("\x1f", F.col(key).cast("string"), F.format_string("%09d", "at")))
    found = analyze(texts.withColumn("_text", F.when(F.col("kind") == "string", F.col("value"))), options, text="_text").drop("error")
    found = found.withColumn("spans", F.coalesce(conflict.prefer_longer(F.col("spans")), F.array().cast(found.schema["spans"].dataType)))
    out, vault = K.pseudonymize(found, "_leaf", "_leaf", text="_text", known=known)
    new = F.when(F.col("kind") == "string", F.col("anonymized")).otherwise(F.col("value"))
    return out.withColumn("action", F.when(F.col("kind") == "string", "analyze").otherwise("opaque")).withColumn("new_value", new).drop("spans", "anonymized", "_text", "_leaf"), vault


def rehydrate_leaves(rows: DataFrame, vault: DataFrame, key: str = "doc_id", fmt: K.TokenFormat = K.TokenFormat()) -> DataFrame:
    """rows(path, value, kind, ...) with action and new_value: the values of the vault's tokens in all text leaves; then ``renest`` gives the documents."""
    texts = rows.withColumn("_leaf", F.concat_ws("\x1f", F.col(key).cast("string"), F.format_string("%09d", "at")))
    out = K.rehydrate(texts.withColumn("_text", F.when(F.col("kind") == "string", F.col("value"))), vault, "_leaf", None, fmt, "_text")
    new = F.when(F.col("kind") == "string", F.col("restored")).otherwise(F.col("value"))
    return out.withColumn("action", F.when(F.col("kind") == "string", "analyze").otherwise("opaque")).withColumn("new_value", new).drop("restored", "_text", "_leaf")


def redact_struct(column: Column, kind: T.DataType, policies: dict[str, object], leaf, depth: int = 0) -> Column:
    """The same for a typed column: rebuilds structs, arrays and map values, with ``leaf`` for strings. No Python at run time."""
    if depth > MAX_DEPTH:
        raise ValueError("max_depth_exceeded")
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind.fields:
            p = policies.get(f.name, "sensitive" if f.name in SENSITIVE else "traverse")
            if p == "drop":
                continue
            x = column[f.name]
            if p == "sensitive":
                x = F.lit(A.REDACTED)
            elif isinstance(p, tuple) and p[0] == "replace":
                x = F.lit(p[1])
            elif isinstance(p, tuple):
                x = A.replacement(F.lit("field"), x, {"default": p[1]})
            elif p != "keep":
                x = redact_struct(x, f.dataType, policies, leaf, depth + 1)
            parts.append(x.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact_struct(x, kind.elementType, policies, leaf, depth + 1))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        value = lambda k, v: redact_struct(v, kind.valueType, policies, leaf, depth + 1)
        return F.transform_values(column, lambda k, v: F.when(k.isin(*SENSITIVE), F.lit(A.REDACTED)).otherwise(v) if isinstance(kind.valueType, T.StringType) and not policies else value(k, v))
    return leaf(column) if isinstance(kind, T.StringType) else column


def redact_columns(df: DataFrame, policies: dict[str, object], leaf=lambda x: x) -> DataFrame:
    """All columns of a table by field policies."""
    return df.select(redact_struct(F.struct("*"), df.schema, policies, leaf).alias("r")).select("r.*")


def redact_messages(messages: DataFrame, roles: tuple[str, ...] = ("user",), options: Options | None = None, fmt: K.TokenFormat = K.TokenFormat(), session: str = "conv_id", turn: str = "turn", text: str = "text", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """messages with ``anonymized`` (pseudonyms in the given roles' texts, other texts as they were), and one vault for each conversation."""
    from palimpsest.operators import conflict

    found = analyze(messages.withColumn("_own", F.when(F.col("role").isin(*roles), F.col(text))), options, text="_own")
    found = found.withColumn("spans", F.coalesce(conflict.prefer_longer(F.col("spans")), F.array().cast(found.schema["spans"].dataType))).drop("error")
    out, vault = K.pseudonymize(found, turn, turn, [session], fmt, known, text)
    return out.drop("spans", "_own"), vault


def rehydrate_messages(messages: DataFrame, vault: DataFrame, session: str = "conv_id", turn: str = "turn", text: str = "text", fmt: K.TokenFormat = K.TokenFormat()) -> DataFrame:
    return K.rehydrate(messages, vault, turn, [session], fmt, text)


class PolicyRegistry:
    """Field policies by the name of a schema."""

    def __init__(self):
        self._by_name: dict[str, dict] = {}

    def register(self, name: str, policies: dict) -> None:
        self._by_name[name] = dict(policies)

    def redact(self, name: str, df: DataFrame, leaf=lambda x: x) -> DataFrame:
        return redact_columns(df, self._by_name[name], leaf)
