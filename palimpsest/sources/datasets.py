"""Data sets of texts with gold spans, predictions, vocabularies and manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPAN = "struct<entity_type:string,entity:string,label:string,entity_value:string,value:string,text:string,start_position:int,start:int,char_start:int,end_position:int,end:int,char_end:int>"
_SAMPLE = f"id:string,sample_id:string,full_text:string,text:string,sentence:string,content:string,template_id:int,spans:array<{_SPAN}>,entities:array<{_SPAN}>,tags:array<{_SPAN}>"
_ROOT = f"samples array<struct<{_SAMPLE}>>, data array<struct<{_SAMPLE}>>"


#: Rows of the largest report.
REPORT_ROWS = 1000


def texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    """doc_id by position, text."""
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_samples(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """sample_id, text, template_id, spans(entity, value, char_start, char_end, byte_start, byte_end). The root may be a list, {"samples": []} or {"data": []}.

    With a pinned sha256, another file ends the query.
    """
    files = spark.read.format("binaryFile").load(path)
    content = F.col("content").cast("string")
    if sha256:
        content = F.when(F.sha2("content", 256) == sha256, content).otherwise(F.raise_error(F.lit("snapshot_mismatch")))
    rows = files.select(content.alias("c"))
    listed = F.from_json("c", f"array<struct<{_SAMPLE}>>")
    named = F.from_json("c", _ROOT)
    samples = F.when(F.ltrim("c").startswith("["), listed).otherwise(F.coalesce(named["samples"], named["data"]))
    rows = rows.select(F.posexplode(samples).alias("ord", "s"))
    s = lambda *names: F.coalesce(*[F.col(f"s.{n}") for n in names])
    text = s("full_text", "text", "sentence", "content")
    rows = rows.select("ord", F.coalesce(s("id", "sample_id"), F.col("ord").cast("string")).alias("sample_id"), text.alias("text"), F.col("s.template_id").alias("template_id"), s("spans", "entities", "tags").alias("raw"))

    def one(x):
        first, last = F.coalesce(x["start_position"], x["start"], x["char_start"]), F.coalesce(x["end_position"], x["end"], x["char_end"])
        at = lambda c: F.octet_length(F.substr(F.col("text"), F.lit(1), c))
        return F.struct(F.coalesce(x["entity_type"], x["entity"], x["label"]).alias("entity"), F.coalesce(x["entity_value"], x["value"], x["text"]).alias("value"), first.alias("char_start"), last.alias("char_end"), at(first).alias("byte_start"), at(last).alias("byte_end"))

    return rows.select("ord", "sample_id", "text", "template_id", F.transform("raw", one).alias("spans"))


def smoke_subset(samples: DataFrame, supported: tuple[str, ...], n: int) -> DataFrame:
    """The first n samples by id with a supported span."""
    return samples.filter(F.exists("spans", lambda s: s["entity"].isin(*supported))).orderBy("sample_id").limit(n)


def locked_selection(samples: DataFrame, ids: list[str], sha256: str | None = None, key: str = "sample_id") -> DataFrame:
    """The samples of a pinned list of ids in its order; another hash of the list, or a missing id, is an error."""
    import hashlib

    if sha256 and hashlib.sha256("\n".join(ids).encode()).hexdigest() != sha256:
        raise ValueError("selection_hash_mismatch")
    wanted = samples.sparkSession.createDataFrame(list(enumerate(ids)), f"position int, {key} string")
    joined = wanted.join(samples, key, "left")
    some = next(c for c in samples.columns if c != key)
    return joined.withColumn(some, F.when(F.col(some).isNull(), F.raise_error(F.lit("missing sample")).cast(samples.schema[some].dataType)).otherwise(F.col(some))).orderBy("position")


def prediction_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """value: a JSON line for each document with entity_type, start_position and end_position in code points, score; never text."""
    from palimpsest.functions.text import byte_to_char

    at = lambda b: byte_to_char(F.col(text), b)
    rows = F.transform(spans, lambda s: F.struct(s["entity"].alias("entity_type"), at(s["byte_start"]).alias("start_position"), at(s["byte_end"]).alias("end_position"), s["score"].alias("score")))
    return docs.select(F.to_json(F.struct(F.col(key).cast("string").alias("sample_id"), F.coalesce(rows, F.array().cast("array<struct<entity_type:string,start_position:int,end_position:int,score:double>>")).alias("predictions"))).alias("value"))


def write_predictions(docs: DataFrame, path: str, **names) -> None:
    prediction_lines(docs, **names).write.text(path)


def read_external_predictions(spark: SparkSession, path: str, selection: DataFrame, entities: tuple[str, ...]) -> DataFrame:
    """sample_id, entity, byte_start, byte_end, score of another system's JSON lines; ``problem`` names what is wrong with a row: its id, entity, bounds or a value that should not be there."""
    schema = "sample_id string, latency_ms double, predictions array<struct<entity:string,byte_start:int,byte_end:int,value:string,score:double,source_entity:string>>"
    rows = spark.read.schema(schema).json(path)
    repeated = rows.groupBy("sample_id").agg(F.count("*").alias("times"))
    joined = rows.join(repeated, "sample_id").join(selection.select("sample_id", F.octet_length("text").alias("size")), "sample_id", "left")
    p = joined.select("sample_id", "times", "size", F.explode_outer("predictions").alias("p"))
    problem = F.when(F.col("times") > 1, "repeated_id").when(F.col("size").isNull(), "unknown_id").when(~F.col("p.entity").isin(*entities), "unknown_entity").when(~((F.col("p.byte_start") >= 0) & (F.col("p.byte_start") < F.col("p.byte_end")) & (F.col("p.byte_end") <= F.col("size"))), "bounds").when(F.col("p.value").isNotNull(), "value_present")
    return p.select("sample_id", "p.entity", "p.byte_start", "p.byte_end", "p.score", problem.alias("problem"))


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """token (binary), rank of a BPE rank file: a base64 token and a rank a line. A wrong number of columns or a repeated token or rank ends the query."""
    lines = spark.read.text(path).filter("value <> ''").select(F.split("value", " ").alias("p"))
    bad = (F.size("p") != 2) | ~F.coalesce(F.get("p", F.lit(1)).rlike("^[0-9]+$"), F.lit(False))
    rows = lines.select(F.when(bad, F.raise_error(F.lit("invalid_rank_line")).cast("string")).otherwise(F.get("p", F.lit(0))).alias("t"), F.get("p", F.lit(1)).try_cast("int").alias("rank"))
    rows = rows.select(F.unbase64("t").alias("token"), "rank")
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("token").alias("t"), F.count_distinct("rank").alias("r")).select(F.when((F.col("n") != F.col("t")) | (F.col("n") != F.col("r")), F.raise_error(F.lit("repeated_token_or_rank")).cast("int")).otherwise(0).alias("ok"))
    return rows.crossJoin(F.broadcast(counts)).filter("ok = 0").drop("ok")


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("id",)) -> list[dict]:
    """Entries of a small capability manifest: schema_version 1, the required fields, unique ids."""
    text = "".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    manifest = json.loads(text)
    entries = manifest.get("entries", manifest.get("capabilities", []))
    if manifest.get("schema_version") != 1 or any(f not in e for e in entries for f in required) or len({e["id"] for e in entries}) != len(entries):
        raise ValueError("invalid manifest")
    return entries


def write_report(metrics: DataFrame, path: str, title: str = "Report") -> None:
    """A small table as report.json and report.md below path; one of more than REPORT_ROWS rows is an error, not cut."""
    rows = [r.asDict(recursive=True) for r in metrics.limit(REPORT_ROWS + 1).collect()]
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows")
    cells = metrics.columns
    table = "\n".join(["| " + " | ".join(cells) + " |", "|" + "-|" * len(cells), *("| " + " | ".join(str(r[c]) for c in cells) + " |" for r in rows)])
    spark = metrics.sparkSession
    for name, text in (("json", json.dumps({"title": title, "rows": rows}, default=str)), ("md", f"# {title}\n\n{table}")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.{name}")
