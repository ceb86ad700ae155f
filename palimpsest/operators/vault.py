"""A vault as a table: entity, value, counter, token. Tokens are a set operation over first-seen order, so they are the same however the data is split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from palimpsest.functions.spans import let
from palimpsest.functions.text import utf8
from palimpsest.operators.anonymize import spliced


#: Ranges in which the values of an entity are ranked side by side.
RANGES = 256


@dataclass(frozen=True)
class TokenFormat:
    prefix: str = "<<"
    suffix: str = ">>"
    separator: str = "_"
    width: int = 3
    case: str = "upper"

    def __post_init__(self):
        if self.case not in ("upper", "lower", "preserve") or self.width < 1 or not self.prefix or not self.suffix:
            raise ValueError("invalid token format")

    def token(self, entity: Column, counter: Column) -> Column:
        name = {"upper": F.upper(entity), "lower": F.lower(entity), "preserve": entity}[self.case]
        number = counter.cast("string")
        return F.concat(F.lit(self.prefix), name, F.lit(self.separator), F.lpad(number, F.greatest(F.lit(self.width), F.length(number)), F.lit("0")), F.lit(self.suffix))

    def pattern(self) -> str:
        quote = lambda s: "".join("\\" + c if not c.isalnum() else c for c in s)
        return quote(self.prefix) + "[A-Za-z0-9_]+" + quote(self.suffix)


def build(rows: DataFrame, order: list[str], scope: list[str] | None = None, fmt: TokenFormat = TokenFormat(), known: DataFrame | None = None) -> DataFrame:
    """The vault of rows(entity, value, *order, *scope): a counter for each entity (and scope, e.g. a conversation) by first occurrence.

    known: an earlier vault, whose tokens stay, whose counters go on and whose uses are added up. One ranking sees the distinct values of an entity in a scope, not the rows. Without a scope it is
    split: values are ranked within up to RANGES ranges of the first number of their order, and the ranges before are added.
    """
    scope = scope or []
    found = rows.groupBy(*scope, "entity", "value").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("uses"))
    names = [*scope, "entity"]
    if known is not None:
        first = found.join(known.select(*names, "value"), [*names, "value"], "left_anti")
        last = known.groupBy(*names).agg(F.max("counter").alias("last"))
        first = first.join(last, names, "left")
    else:
        first = found.withColumn("last", F.lit(0))
    by = names
    if not scope and isinstance(rows.schema[order[0]].dataType, NumericType):
        cuts = first.groupBy("entity").agg(F.percentile_approx(F.col(f"first.{order[0]}").cast("double"), [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts"))
        first = first.join(F.broadcast(cuts), "entity")  # a row for each entity
        first = first.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col(f"first.{order[0]}")))).drop("cuts")
        sizes = first.groupBy("entity", "range").agg(F.count("*").alias("size"))
        before = Window.partitionBy("entity").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        earlier = sizes.select("entity", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
        first, by = first.join(F.broadcast(earlier), ["entity", "range"]), ["entity", "range"]  # RANGES rows for each entity
    else:
        first = first.withColumn("earlier", F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("first"))
    new = first.withColumn("counter", (F.col("earlier") + rank + F.coalesce("last", F.lit(0))).cast("long")).select(*names, "value", "counter", "uses")
    new = new.withColumn("token", fmt.token(F.col("entity"), F.col("counter")))
    if known is None:
        return new
    again = found.select(*names, "value", F.col("uses").alias("_again"))
    old = known.join(again, [*names, "value"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)) + F.coalesce("_again", F.lit(0))) if "uses" in known.columns else known
    return old.select(*known.columns).unionByName(new, allowMissingColumns=True)


def lookup_token(tokens: DataFrame, vault: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """tokens(token) with entity and value; for an unknown token null and its length and shape, never more."""
    found = tokens.join(vault.select(*(scope or []), "token", "entity", "value"), [*(scope or []), "token"], "left")
    return found.withColumn("token_length", F.when(F.col("value").isNull(), F.length("token"))).withColumn("well_formed", F.col("token").rlike("^" + TokenFormat().pattern() + r"\z"))


def lookup_value(values: DataFrame, vault: DataFrame, scope: list[str] | None = None) -> DataFrame:
    return values.join(vault.select(*(scope or []), "entity", "value", "token"), [*(scope or []), "entity", "value"], "left")


def info(vault: DataFrame) -> DataFrame:
    return vault.agg(F.lit("table").alias("backend"), F.count("*").alias("size"))


def pseudonymize(docs: DataFrame, key: str = "doc_id", order: str | None = None, scope: list[str] | None = None, fmt: TokenFormat = TokenFormat(), known: DataFrame | None = None, text: str = "text", spans: str = "spans") -> tuple[DataFrame, DataFrame]:
    """docs with ``anonymized``, and the vault. Spans must not overlap. First-seen order: ``order`` (key by default), then the place in the text."""
    scope = scope or []
    by = order or key
    ids = list(dict.fromkeys([*scope, key, by]))
    rows = docs.select(*ids, F.explode(spans).alias("s")).select(*ids, F.col("s.entity").alias("entity"), F.col("s.text").alias("value"), F.col("s.byte_start").alias("b"), F.col("s.byte_end").alias("e"))
    vault = build(rows, [by, "b"], scope, fmt, known)
    named = rows.join(vault.select(*scope, "entity", "value", "token"), [*scope, "entity", "value"])
    keys = list(dict.fromkeys([*scope, key]))
    lists = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "e", "token"))).alias("_new"))
    value = F.col(text)
    out = docs.join(lists, keys, "left").withColumn("_bytes", F.when(F.col("_new").isNotNull(), utf8(value)))
    done = spliced(F.col("_bytes"), F.col("_new"), lambda x: x["b"], lambda x: x["e"], lambda x: x["token"])
    return out.withColumn("anonymized", F.when(F.col("_new").isNull(), value).otherwise(done)).drop("_new", "_bytes"), vault


def rehydrate(docs: DataFrame, vault: DataFrame, key: str = "doc_id", scope: list[str] | None = None, fmt: TokenFormat = TokenFormat(), text: str = "text", unknown: str = "keep") -> DataFrame:
    """docs with ``restored``. As tokens are replaced one after the other over the whole text, a restored value that holds a later token is restored too.

    unknown: keep leaves tokens that the vault lacks, error ends the query.
    """
    if unknown not in ("keep", "error"):
        raise ValueError("unknown must be keep or error")
    scope = scope or []
    keys = list(dict.fromkeys([*scope, key]))
    found = docs.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(fmt.pattern()), F.lit(0))).alias("at", "token"))
    named = found.join(vault.select(*scope, "token", "value"), [*scope, "token"], "left")
    if unknown == "error":
        named = named.withColumn("value", F.coalesce("value", F.raise_error(F.lit("unknown token")).cast("string")))
    lists = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "token", "value"))).alias("_new"))
    out = docs.join(lists, keys, "left")
    #: In turn over the whole text only where a value holds a token itself; else one pass, with the values in the order of their tokens.
    known = F.array_distinct(F.transform(F.filter("_new", lambda x: x["value"].isNotNull()), lambda x: F.struct(x["token"], x["value"])))
    in_turn = F.aggregate(known, F.col(text), lambda t, x: F.replace(t, x["token"], x["value"]))
    once = F.array_join(F.zip_with(F.split(F.col(text), fmt.pattern(), -1), F.col("_new"), lambda g, x: F.concat(g, F.coalesce(x["value"], x["token"], F.lit("")))), "")
    nested = F.exists("_new", lambda x: F.coalesce(x["value"].rlike(fmt.pattern()), F.lit(False)))
    return out.withColumn("restored", F.when(F.col("_new").isNull(), F.col(text)).when(nested, in_turn).otherwise(once)).drop("_new")


def rehydrate_once(text: Column, table: Column, fmt: TokenFormat = TokenFormat()) -> Column:
    """A single pass with a map of tokens to values: restored values are not looked at again."""
    found, gaps = F.regexp_extract_all(text, F.lit(fmt.pattern()), F.lit(0)), F.split(text, fmt.pattern(), -1)
    return let(found, lambda m: F.array_join(F.zip_with(gaps, m, lambda g, t: F.concat(g, F.coalesce(table[t], t, F.lit("")))), ""))
