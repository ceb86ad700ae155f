"""Byte-pair encoding, vault backends, label spaces, mixed policies and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from palimpsest import cli
from palimpsest.operators import backends
from palimpsest.operators import model as M
from palimpsest.operators import structured as ST
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.operators.backends import MemoryVault, TableVault
from palimpsest.operators.bpe import PATTERNS, Encoding, encoding_of
from palimpsest.plans import labels, profiles
from palimpsest.sources import datasets
from palimpsest.streaming.rehydrate import rehydrate_stream


def test_bpe_round_trip_and_offsets(spark):
    pytest.importorskip("tiktoken")
    ranks = {bytes([i]): i for i in range(256)} | {b"he": 256, b"ll": 257, b"hell": 258}
    e = Encoding(spark, ranks, PATTERNS["r50k_base"], {"<end>": 300})
    d = spark.createDataFrame([("hello é",), (None,)], "t string")
    row = d.select(e.encode(F.col("t")).alias("i"), e.offsets(F.col("t")).alias("o"), e.decode(e.encode(F.col("t"))).alias("t")).first()
    assert row.t == "hello é" and row.i[0] == 258 and row.o[-1].byte_end == len("hello é".encode())
    with pytest.raises(ValueError):
        Encoding(spark, {b"a": 0, b"b": 0}, PATTERNS["r50k_base"])
    assert spark.createDataFrame([("a<end>",)], "t string").select(e.encode(F.col("t"), allowed=("<end>",)).alias("i")).first().i[-1] == 300


def test_backends(spark, tmp_path):
    rows = spark.createDataFrame([("email", "a", 1)], "entity string, value string, at int")
    for backend in (MemoryVault(spark), TableVault(spark, str(tmp_path / "vault"))):
        backend.save(K.build(rows, ["at"], known=backend.load()))
        more = rows.unionByName(spark.createDataFrame([("email", "b", 2)], rows.schema))
        backend.save(K.build(more, ["at"], known=backend.load()))
        assert {r.value: r.token for r in backend.load().collect()} == {"a": "<<EMAIL_001>>", "b": "<<EMAIL_002>>"}
        backend.clear()
        assert K.info(backend.load()).first().size == 0


def test_label_space():
    space = labels.label_space(["b", "a"])
    assert space["labels"][:5] == ["O", "B-a", "I-a", "E-a", "S-a"] and ("B-a", "I-a") in space["allowed"] and ("B-a", "I-b") not in space["allowed"] and ("O", "E-a") not in space["allowed"]
    with pytest.raises(ValueError):
        labels.check_complete(["O", "B-a"])
    assert labels.decoder()["raw_logits"] and not labels.decoder(least_log_prob=-1.0)["raw_logits"]
    assert profiles.prune_models(("person",), {"a": ("person",), "b": ("phone",)}) == ["a"]


def test_gate_and_cascade(spark):
    docs = spark.createDataFrame([(1, "lives in Bern"), (2, "nothing")], "doc_id int, text string")
    schema = "doc_id int, entity string, byte_start int, byte_end int, score double"
    primary = spark.createDataFrame([(2, "location", 0, 3, 0.5)], schema)
    extra = spark.createDataFrame([(1, "location", 9, 13, 0.9), (2, "location", 0, 3, 0.99)], schema)
    got = {(r.doc_id, r.score, r.role) for r in M.cascade(docs, primary, extra).collect()}
    assert got == {(1, 0.9, "secondary"), (2, 0.5, "primary")}
    assert {(r.doc_id, r.score) for r in M.cascade(docs, primary, extra, "always").collect()} == {(1, 0.9), (2, 0.99)}
    seen = []
    M.secondary(docs, primary, lambda d: seen.append(d.count()) or extra.limit(0), M.location_gate(F.col("text")) != "no_location_signal")
    assert seen == [1]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("mail a@b.com\nplain\n")
    assert cli.main(["redact", str(tmp_path / "in.txt"), "--entities", "email"], spark) == 0
    assert capsys.readouterr().out.splitlines() == ["mail [EMAIL]", "plain"]
    cli.main(["detect", str(tmp_path / "in.txt"), "--entities", "email"], spark)
    out = json.loads(capsys.readouterr().out)
    assert out["byte_start"] == 5 and "text" not in out
    cli.main(["config"], spark)
    assert json.loads(capsys.readouterr().out)["profile"] == "regex_only"


def test_table_vault_opened_again(spark, tmp_path):
    first = backends.TableVault(spark, str(tmp_path / "v"))
    assert first.load().count() == 0
    rows = spark.createDataFrame([(1, 0, "email", "a@b.com"), (2, 0, "email", "c@d.com"), (3, 0, "email", "a@b.com")], "doc_id long, b int, entity string, value string")
    first.save(K.build(rows, ["doc_id", "b"]))
    again = backends.TableVault(spark, str(tmp_path / "v"))
    assert {r.value: (r.counter, r.uses) for r in again.load().collect()} == {"a@b.com": (1, 2), "c@d.com": (2, 1)}
    more = spark.createDataFrame([(9, 0, "email", "e@f.com"), (9, 5, "email", "c@d.com")], "doc_id long, b int, entity string, value string")
    again.save(K.build(more, ["doc_id", "b"], known=again.load()))
    third = backends.TableVault(spark, str(tmp_path / "v"))
    assert {r.value: (r.counter, r.uses) for r in third.load().collect()} == {"a@b.com": (1, 2), "c@d.com": (2, 2), "e@f.com": (3, 1)} and third.generation == 2
    (tmp_path / "v" / "000003").mkdir()  # a save that failed
    assert third.generation == 2
    third.clear()
    assert backends.TableVault(spark, str(tmp_path / "v")).load().count() == 0


def test_counters_in_ranges_are_those_of_one_ranking(spark):
    rows = spark.range(5000).selectExpr("id * 37 % 4999 AS doc_id", "int(id % 3) AS b", "'e' AS entity", "concat('v', id % 1700) AS value")
    got = {r.value: r.counter for r in K.build(rows, ["doc_id", "b"]).collect()}
    first = {}
    for r in rows.collect():
        first[r.value] = min(first.get(r.value, (r.doc_id, r.b)), (r.doc_id, r.b))
    assert got == {v: i + 1 for i, v in enumerate(sorted(first, key=first.get))}


def test_documents_are_nested_again(spark):
    data = [
        {"user": {"email": "me: a@b.com", "password": 7, "tags": ["x", {"y": []}, "call a@b.com"]}, "gone": "z", "n": 5, "none": None, "deep": [[1, [2, "c@d.com"]], {}], "0": {"1": True}},
        ["a@b.com", 1.5], "a@b.com", 3, {},
    ]
    docs = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(data)], "doc_id long, j string")
    rows = ST.leaves(docs, "j")
    out = {r.doc_id: json.loads(r.json) for r in ST.renest(ST.redact_leaves(rows, {"gone": "drop"}, Options(entities=("email",)))).collect()}
    want = {"user": {"email": "me: [EMAIL]", "password": "[REDACTED]", "tags": ["x", {"y": []}, "call [EMAIL]"]}, "n": 5, "none": None, "deep": [[1, [2, "[EMAIL]"]], {}], "0": {"1": True}}
    assert out == {0: want, 1: ["[EMAIL]", 1.5], 2: "[EMAIL]", 3: 3, 4: {}}
    named, vault = ST.pseudonymize_leaves(rows, Options(entities=("email",)))
    hidden = ST.renest(named)
    assert "@" not in "".join(r.json for r in hidden.collect()) and vault.count() == 2
    back = ST.renest(ST.rehydrate_leaves(ST.leaves(hidden, "json"), vault))
    assert {r.doc_id: json.loads(r.json) for r in back.collect()} == dict(enumerate(data))


def test_streams_end_and_come_in_order(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string, last boolean"
    chunks = [("s", i, c, False) for i, c in enumerate("Hello <<EMAIL_001>>, bye")] + [("t", 0, "<<EMA", True)]
    spark.createDataFrame(chunks[::-1], schema).repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = rehydrate_stream(source, {"<<EMAIL_001>>": "a@b.com"}).writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("select * from ended").collect()
    assert "".join(r.output for r in sorted(rows, key=lambda r: r.seq) if r.stream_id == "s") == "Hello a@b.com, bye"
    kept = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    assert kept == [1]  # the stream that has ended is forgotten
    with pytest.raises(ValueError, match="too large"):
        rehydrate_stream(source, {"k": "x" * (65 << 20)})


def test_reports_are_not_cut(spark, tmp_path):
    with pytest.raises(ValueError):
        datasets.write_report(spark.range(1001), str(tmp_path / "r"))


@pytest.mark.parametrize("profile", [*profiles.PROFILES, *profiles.PRODUCTS])
def test_every_profile_and_product_runs(spark, profile):
    docs = spark.createDataFrame([(1, "Jane Roe (jane@x.org) took Aspirin in Bern"), (2, None), (3, "nothing")], "doc_id long, text string")
    schema = "doc_id long, label string, start int, end int, offset_unit string, score double"
    outputs = spark.createDataFrame([(1, "B-PER", 0, 8, "byte", 0.9), (1, "PER", 10, 14, "byte", 0.99), (1, "medication", 27, 34, "character", 0.8), (1, "LOC", 38, 42, "byte", 0.3), (4, "PER", 0, 1, "byte", 0.9)], schema)
    got = {r.doc_id: r.spans for r in analyze(docs, Options(profile=profile), outputs=outputs).collect()}
    found = {(s.entity, s.text) for s in got[1]}
    asked = profiles.entities_of(profile)
    want = {("email", "jane@x.org")} | ({("person", "Jane Roe")} if "person" in asked else set()) | ({("medication", "Aspirin")} if "medication" in asked else set())
    assert want <= found and not {e for e, _ in found} - set(asked) and ("location", "Bern") not in found or profile == "deterministic_plus"
    assert got[2] is None and got[3] == []


def test_unknown_profiles_and_entities_are_refused():
    with pytest.raises(ValueError):
        Options(profile="fastest")
    with pytest.raises(ValueError):
        Options(profile="hybrid_ner", entities=("medication",))


def test_tools(spark, tmp_path, capsys):
    cases = {"email": [["a@b.com x", ["a@b.com"]], ["none", []]], "us_ssn": [["123-45-6789", ["123-45-6789"]]]}
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert cli.main(["cases", str(tmp_path / "cases.json")], spark) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1]) == {"cases": 3, "failed": 0}
    cases["email"][1][1] = ["x@y.z"]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    assert cli.main(["cases", str(tmp_path / "cases.json")], spark) == 1
    capsys.readouterr()
    samples = [{"id": "a", "full_text": "é a@b.com c@d.com", "spans": [{"entity_type": "email", "entity_value": "a@b.com", "start_position": 2, "end_position": 9}, {"entity_type": "email", "entity_value": "c@d", "start_position": 10, "end_position": 13}]}]
    (tmp_path / "s.json").write_text(json.dumps(samples))
    assert cli.main(["eval", str(tmp_path / "s.json"), "--entities", "email"], spark) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(r["entity"], r["tp"], r["fp"], r["fn"], r["precision"]) for r in rows] == [("email", 1, 1, 1, 0.5), (None, 1, 1, 1, 0.5)]
    cli.main(["check", "--profile", "balanced"], spark)
    assert json.loads(capsys.readouterr().out)["of_models"] == ["person", "location", "organization"]


def test_encodings_by_model():
    assert [encoding_of(m) for m in ("gpt2", "gpt-4", "gpt-4o", "gpt-4o-mini", "gpt-4-32k", "davinci")] == ["gpt2", "cl100k_base", "o200k_base", "o200k_base", "cl100k_base", "r50k_base"]
    with pytest.raises(KeyError):
        encoding_of("other")


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_every_pattern_cuts_all_of_a_text(name):
    import regex

    text = "It's 12345 naïve HTTPServers, don't\n\n  x\t漢字 Ⅳ!! \u00a0end  "
    assert "".join(regex.findall(PATTERNS[name], text)) == text
