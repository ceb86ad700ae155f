"""Command line: python -m palimpsest.cli detect|redact|export|config|eval|cases|check [FILE].

detect, redact, export: texts are lines of FILE or of the standard input; found values are shown only if asked for. eval: scores of a profile on the samples of FILE (see ``datasets.read_samples``),
by entity and over all. cases: runs the recognizer cases of FILE, a JSON object of {entity: [[text, [values]]]}; the status is 1 if one fails. check: a profile's entities, and those for which it has models.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import evaluate as E
from palimpsest.operators.analyze import Options, analyze
from palimpsest.operators.anonymize import redact
from palimpsest.plans.profiles import MODEL_ENTITIES
from palimpsest.sources.datasets import prediction_lines, read_samples, texts


def evaluate(spark: SparkSession, path: str, options: Options) -> DataFrame:
    """entity (null: all), tp, fp, fn, precision, recall, f1, f2 of exact matches on the samples of a file."""
    samples = read_samples(spark, path)
    gold = samples.select("sample_id", F.posexplode("spans").alias("ord", "s")).select("sample_id", "ord", "s.entity", "s.byte_start", "s.byte_end").filter(F.col("entity").isin(*options.entities))
    found = analyze(samples.select("sample_id", "text"), options, key="sample_id")
    pred = found.select("sample_id", F.posexplode("spans").alias("ord", "s")).select("sample_id", "ord", "s.entity", "s.byte_start", "s.byte_end")
    by = E.exact_counts(gold, pred, "entity")
    whole = by.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("entity", F.lit(None).cast("string"))
    return E.ratios(by.unionByName(whole)).select("entity", "tp", "fp", "fn", "precision", "recall", "f1", "f2").orderBy(F.col("entity").asc_nulls_last())


def run_cases(spark: SparkSession, path: str, profile: str) -> int:
    with open(path, encoding="utf-8") as f:
        cases = json.load(f)
    failed = total = 0
    for entity, rows in cases.items():
        docs = texts(spark, [t for t, _ in rows])
        got = {r.doc_id: [s.text for s in r.spans] for r in analyze(docs, Options(profile=profile, entities=(entity,))).collect()}
        wrong = [i for i, (_, values) in enumerate(rows) if got[i] != values]
        total, failed = total + len(rows), failed + len(wrong)
        print(json.dumps({"entity": entity, "cases": len(rows), "failed": wrong}))
    print(json.dumps({"cases": total, "failed": failed}))
    return 1 if failed else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("command", choices=("detect", "redact", "export", "config", "eval", "cases", "check"))
    p.add_argument("file", nargs="?", default="-")
    p.add_argument("--entities", default="")
    p.add_argument("--profile", default="regex_only")
    p.add_argument("--include-text", action="store_true")
    a = p.parse_args(argv)
    options = Options(entities=tuple(a.entities.split(",")) if a.entities else None, profile=a.profile, include_text=a.include_text or a.command == "redact")
    if a.command == "config":
        print(json.dumps({"entities": options.entities, "profile": options.profile, "language": options.language, "score_threshold": options.score_threshold}))
        return 0
    if a.command == "check":
        print(json.dumps({"profile": options.profile, "entities": options.entities, "of_models": [e for e in options.entities if e in MODEL_ENTITIES.get(options.profile, ())]}))
        return 0
    spark = spark or SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    if a.command == "cases":
        return run_cases(spark, a.file, a.profile)
    if a.command == "eval":
        for row in evaluate(spark, a.file, options).toLocalIterator():
            print(json.dumps(row.asDict()))
        return 0
    if a.file == "-":
        docs = texts(spark, sys.stdin.read().splitlines())
    else:
        docs = spark.read.text(a.file).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    if a.command == "redact":
        out = redact(docs, options).orderBy("doc_id").select("anonymized")
    elif a.command == "export":
        out = prediction_lines(analyze(docs, options))
    else:
        out = analyze(docs, options).orderBy("doc_id").select("doc_id", F.explode("spans").alias("s")).select(F.to_json(F.struct("doc_id", "s.entity", "s.byte_start", "s.byte_end", "s.score", "s.text")))
    for row in out.toLocalIterator():
        print(row[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
