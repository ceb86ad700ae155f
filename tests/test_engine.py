"""The engine on small inputs: offsets, recognizers, context, conflicts, rewriting, vault, nested data, streams, decoders, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import spans
from palimpsest.functions import text as X
from palimpsest.functions import validators as V
from palimpsest.functions.spans import span
from palimpsest.operators import anonymize as A
from palimpsest.operators import context as C
from palimpsest.operators import evaluate as E
from palimpsest.operators import model as M
from palimpsest.operators import recognize as R
from palimpsest.operators import statistics as S
from palimpsest.operators import structured as ST
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.sources import datasets, logs
from palimpsest.streaming.rehydrate import Rehydrator, TokenTooLong, rehydrate_stream


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def found(df, *fields):
    return [(r.doc_id, *(r.s[f] for f in fields)) for r in df.select("doc_id", F.explode("spans").alias("s")).collect()]


SEGMENTS = ["a", "é", "é", "𝄞", "👩‍🚀", "שלום", "\x00", "\r\n", "\t", " ", "x@y.com", "日本"]


def test_offsets_are_bytes_whatever_the_text(spark):
    r = random.Random(0)
    values = ["".join(r.choice(SEGMENTS) for _ in range(20)) for _ in range(60)]
    rows = texts(spark, *values).select("doc_id", "text", F.explode(X.matches(F.col("text"), "x@y[.]com")).alias("m")).collect()
    assert len(rows) == sum(v.count("x@y.com") for v in values)
    for row in rows:
        assert row.text.encode()[row.m.s : row.m.e].decode() == row.m.v == "x@y.com"


def test_unit_conversions(spark):
    t = "é𝄞👩‍🚀a"
    row = texts(spark, t).select(*[X.byte_to_char(F.col("text"), F.lit(b)).alias(f"b{b}") for b in range(19)], *[X.char_to_byte(F.col("text"), F.lit(c)).alias(f"c{c}") for c in range(8)], F.size(X.graphemes(F.col("text"))).alias("g")).first()
    starts = {len(t[:k].encode()): k for k in range(len(t) + 1)}
    assert [row[f"b{b}"] for b in range(19)] == [starts.get(b) for b in range(19)]
    assert [row[f"c{c}"] for c in range(8)] == [len(t[:c].encode()) if c <= len(t) else None for c in range(8)] and row.g == 4


@pytest.mark.parametrize(
    ("entity", "text", "values"),
    [
        ("email", "Write to Jane.Doe+x@mail.example.com, or a@-bad.com or x@y.c", ["Jane.Doe+x@mail.example.com"]),
        ("email", "a@b.co_x@y.com", ["a@b.co", "_x@y.com"]),
        ("phone", "call (415) 555-1234 or +1 415-555-1234 or 000-555-1234", ["(415) 555-1234", "+1 415-555-1234"]),
        ("phone", "1234567890 and 1111111111 and 4155551234", ["4155551234"]),
        ("credit_card", "4111 1111 1111 1111 and 4111 1111 1111 1112", ["4111 1111 1111 1111"]),
        ("us_ssn", "123-45-6789 000-12-3456", ["123-45-6789"]),
        ("iban", "DE89 3704 0044 0532 0130 00 x", []),
        ("iban", "(DE89370400440532013000)", ["DE89370400440532013000"]),
        ("ip_address", "10.0.0.1 256.1.1.1 1.2.3.4.5 ::1 fe80::1:2 1::2::3", ["10.0.0.1", "::1", "fe80::1:2"]),
        ("url", "see https://example.com/a?b=c) and http://nodot/x", ["https://example.com/a?b=c"]),
        ("domain", "www.example.org a@mail.example.org -x.com", ["www.example.org"]),
    ],
)
def test_recognizers(spark, entity, text, values):
    assert [v for _, v in found(analyze(texts(spark, text), Options(entities=(entity,))), "text")] == values


def test_trailing_dot_stays_and_literal_suffix_goes(spark):
    rule = R.Rule("x", "x", "x", r"x[^\s]*", 0.5)
    got = texts(spark, "x. xa.,;: xb))").select("doc_id", R.rule_spans(F.col("text"), rule).alias("spans"))
    assert [v for _, v in found(got, "text")] == ["x.", "xa", "xb"]


def test_pattern_definition_callbacks(spark):
    rule = {"name": "n", "entity": "code", "patterns": [{"name": "p", "regex": "[A-Z][0-9]", "score": 0.9, "invalid_score": 0.2}], "validate": lambda v: v > "B", "invalidate": lambda v: v == "C3", "context": ["code"]}
    got = texts(spark, "A1 B2 C3").select("doc_id", R.pattern_definition(F.col("text"), rule).alias("spans"))
    assert [(v, s) for _, v, s in found(got, "text", "score")] == [("A1", 0.2), ("B2", 0.9)]


def test_deny_list_offsets_under_normalisation(spark):
    entry = {"entity": "name", "values": ["jane doe", "a.b"], "case_sensitive": False, "normalize_whitespace": True}
    got = texts(spark, "İ JANE \n Doe axb A.B").select("doc_id", "text", R.deny_list(F.col("text"), [entry]).alias("spans"))
    assert [(s, e, v) for _, s, e, v in found(got, "byte_start", "byte_end", "text")] == [(3, 13, "JANE \n Doe"), (18, 21, "A.B")]


def test_custom_recognizer_results_are_checked(spark):
    bad = R.CustomRecognizer("bad", ("x",), lambda ts: [[("x", 0, 99, 1.0)] for _ in ts])
    with pytest.raises(Exception, match="invalid result of recognizer bad"):
        texts(spark, "secret value").select(bad.spans(F.col("text"))).collect()


def test_options_are_checked(spark):
    for bad in ({"profile": "no"}, {"language": "xx"}, {"score_threshold": -1}, {"entities": ("nothing",)}, {"allow_list": [{"no": 1}]}, {"context": C.ContextOptions(match="no")}, {"context": C.ContextOptions(window=-1)}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert Options(profile="regex_only").entities[0] == "email"


def test_context_gate_and_negative_words(spark):
    rule = {"name": "n", "entity": "code", "patterns": [{"name": "p", "regex": "[0-9]{4}", "score": 0.3, "requires_context": True}], "context": ["pin code", "pin"], "negative_context": ["year"], "negative_context_reject": True}
    options = Options(entities=("code",), registry=R.Registry(built_ins=False, definitions=[rule]), profile="deterministic_plus")
    got = found(analyze(texts(spark, "pin code: 1234", "number 1234", "the pin year 1999", "PIN 7777"), options), "text", "score")
    assert [(i, v, round(s, 2)) for i, v, s in got] == [(0, "1234", 0.45), (3, "7777", 0.45)]


def test_null_and_empty_texts(spark):
    rows = A.redact(texts(spark, None, "", "a@b.com")).orderBy("doc_id").collect()
    assert [r.anonymized for r in rows] == [None, "", "[EMAIL]"]


def test_splice_ranges_and_items(spark):
    row = A.redact(texts(spark, "é a@b.com, https://x.org!"), operators=A.Operators({"email": {"type": "mask", "keep_last": 4}})).first()
    assert row.anonymized == "é ***.com, [REDACTED]!"
    for i in row["items"]:
        assert row.anonymized.encode()[i.replacement_byte_start : i.replacement_byte_end].decode() == i.replacement and i.replacement_order == "right_to_left"


def test_operator_configuration_errors_carry_no_values():
    for config in ({"type": "no"}, {"type": "mask", "char": "ab"}, {"type": "mask", "x": "canary"}, {"type": "hash", "mode": "deterministic"}, {"type": "hash", "mode": "secure", "salt": b"0" * 16}, {"type": "custom", "function": "canary"}):
        with pytest.raises(A.OperatorError) as e:
            A.Operators({"default": config}).validate()
        assert "canary" not in str(e.value)


def test_strategy_names(spark):
    with pytest.raises(A.OperatorError):
        A.anonymize(texts(spark, "x").withColumn("spans", F.array().cast(R.SPANS_TYPE)), conflict_strategy="default")


def test_hashes(spark):
    d = texts(spark, "value").withColumn("h", A.hash_value(F.col("text"), "sha512", salt=b"s" * 16)).withColumn("f", A.hash_value(F.col("text"), mode="secure"))
    row = d.select(*[A.verify_hash(F.col("text"), F.col(c)).alias(c) for c in "hf"], A.verify_hash(F.lit("other"), F.col("h")).alias("o"), A.verify_hash(F.col("text"), F.lit("$x$y")).alias("m")).first()
    assert tuple(row) == (True, True, False, False)


def test_invalid_spans_are_left_out(spark):
    rows = [(0, 2, 6, None), (0, 0, 1, "no"), (0, 0, 99, None)]
    spans = F.array(*[span(entity=F.lit("x"), byte_start=F.lit(s), byte_end=F.lit(e), score=F.lit(1.0), text=F.lit(t)) for _, s, e, t in rows])
    d = texts(spark, "é abcd").withColumn("spans", spans)
    assert A.anonymize(d).first().anonymized == "é[REDACTED]d"
    with pytest.raises(Exception, match="invalid_span"):
        A.anonymize(d, strict=True).collect()


def test_vault_counters_continue_and_grow_past_their_width(spark):
    fmt = K.TokenFormat(width=1)
    rows = spark.createDataFrame([("email", f"v{i:02}", i) for i in range(12)], "entity string, value string, at int")
    vault = K.build(rows.filter("at < 5"), ["at"], fmt=fmt)
    grown = {r.value: r.token for r in K.build(rows, ["at"], fmt=fmt, known=vault).collect()}
    assert grown["v00"] == "<<EMAIL_1>>" and grown["v11"] == "<<EMAIL_12>>" and len(set(grown.values())) == 12
    lost = K.lookup_token(spark.createDataFrame([("<<EMAIL_99>>",)], "token string"), vault).first()
    assert lost.value is None and lost.token_length == 12 and lost.well_formed


def test_rehydrate_unknown_and_nested(spark):
    vault = spark.createDataFrame([("<<A_001>>", "x <<B_001>>", "a"), ("<<B_001>>", "y", "b")], "token string, value string, entity string")
    d = texts(spark, "<<A_001>> <<B_001>> <<C_001>>")
    assert K.rehydrate(d, vault).first().restored == "x y y <<C_001>>"
    with pytest.raises(Exception, match="unknown token"):
        K.rehydrate(d, vault, unknown="error").collect()
    once = d.select(K.rehydrate_once(F.col("text"), F.create_map(F.lit("<<A_001>>"), F.lit("<<B_001>>"))).alias("r")).first().r
    assert once == "<<B_001>> <<B_001>> <<C_001>>"


def test_rehydrator_at_every_cut():
    text, table = "Hi <<EMAIL_001>>, <<x <<NO_9>> é<<PHONE_002>>> end <<", {"<<EMAIL_001>>": "a@b.com", "<<PHONE_002>>": "<<EMAIL_001>>"}
    want = text.replace("<<PHONE_002>>", "\x00").replace("<<EMAIL_001>>", "a@b.com").replace("\x00", "<<EMAIL_001>>")
    for i in range(len(text) + 1):
        for j in range(i, len(text) + 1, 7):
            r = Rehydrator(table.get)
            assert r.feed(text[:i]) + r.feed(text[i:j]) + r.feed(text[j:]) + r.flush() == want
    with pytest.raises(TokenTooLong):
        Rehydrator(table.get, max_token_bytes=8).feed("<<ABCDEFGHIJ")


def test_stream_restores_across_batches(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string, last boolean"
    spark.createDataFrame([("s", 0, "Hello <<EM", False), ("s", 1, "AIL_001>>!", False), ("t", 0, "<<EMA", True), ("s", 2, " bye <", True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = rehydrate_stream(source, {"<<EMAIL_001>>": "a@b.com"}).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("select * from restored").collect()
    assert "".join(r.output for r in sorted(rows, key=lambda r: r.seq) if r.stream_id == "s") == "Hello a@b.com! bye <" and [r.output for r in rows if r.stream_id == "t"] == ["<<EMA"]


def test_nested_json(spark):
    data = {"user": {"email": "me: a@b.com", "password": 7, "tags": ["x", "call 415-555-1234"]}, "keep": "a@b.com", "gone": "z", "n": 5}
    rows = ST.leaves(spark.createDataFrame([(1, json.dumps(data))], "doc_id long, j string"), "j")
    got = {".".join(r.path): (r.action, r.new_value) for r in ST.redact_leaves(rows, {"keep": "keep", "gone": "drop"}).collect()}
    assert got == {"user.email": ("analyze", "me: [EMAIL]"), "user.password": ("sensitive", "[REDACTED]"), "user.tags.0": ("analyze", "x"), "user.tags.1": ("analyze", "call [PHONE]"), "keep": ("keep", "a@b.com"), "gone": ("drop", None), "n": ("opaque", "5")}
    deep = "[" * 25 + "1" + "]" * 25
    with pytest.raises(Exception, match="max_depth_exceeded"):
        ST.leaves(spark.createDataFrame([(1, deep)], "doc_id long, j string"), "j").collect()


def test_typed_structs(spark):
    df = spark.createDataFrame([((1, "a", ["s"]), "t")], "r struct<id:int,password:string,list:array<string>>, token string")
    out = ST.redact_columns(df, {}, leaf=lambda c: F.upper(c))
    row = out.first()
    assert (row.r.id, row.r.password, row.r.list, row.token) == (1, "[REDACTED]", ["S"], "[REDACTED]") and isinstance(out.schema["r"].dataType, T.StructType)


def test_metrics_of_a_sample(spark):
    gold = spark.createDataFrame([("a", 0, "x", 0, 10), ("a", 1, "y", 20, 30)], "sample_id string, ord int, entity string, byte_start int, byte_end int")
    pred = spark.createDataFrame([("a", 0, "x", 5, 12), ("a", 1, "x", 0, 10), ("a", 2, "x", 22, 30)], "sample_id string, ord int, entity string, byte_start int, byte_end int")
    row = E.score_samples(E.arrays(gold, "gold").join(E.arrays(pred, "pred"), "sample_id")).first()
    assert (row.tp, row.offset_mismatches, row.wrong_entity, row.fp, row.fn) == (1, 0, 1, 1, 0)


def test_skip_word_merge(spark):
    d = texts(spark, "Bank of the West, and x").withColumn("s", F.array(*[F.struct(F.lit("o").alias("entity"), F.lit(a).alias("byte_start"), F.lit(b).alias("byte_end"), F.lit(i).alias("at")) for i, (a, b) in enumerate([(0, 4), (12, 16), (22, 23)])]))
    assert [(x.byte_start, x.byte_end) for x in d.select(E.merge_skip_words(F.col("text"), F.col("s")).alias("m")).first().m] == [(0, 23)]


def test_published_counts_give_published_ratios(spark):
    rows = spark.createDataFrame([(503, 20, 483)], "tp long, fp long, fn long")
    r = E.ratios(rows).first()
    assert [round(x, 4) for x in (r.precision, r.recall, r.f1, r.f2)] == [0.9618, 0.5101, 0.6667, 0.563]
    assert E.ratios(spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")).first().f1 is None


def test_histogram_merge_and_percentiles(spark):
    rows = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate([5, 10, 11, 1000, 1001, 250_000, 3_000_000])], "part int, us double")
    parts = S.histogram(rows, "us", "part")
    merged = S.merge_histograms(parts)
    assert {(r.bucket, r.n) for r in merged.collect()} == {(10, 2), (20, 1), (1000, 1), (1050, 1), (250_000, 1), (3_000_000, 1)}
    assert tuple(S.histogram_percentiles(merged, [0.5, 0.99]).first()) == (1000, 3_000_000)


def test_decoders(spark):
    rows = spark.createDataFrame([(0, 2, [9.0, -9.0, -9.0, 9.0])], "doc_id int, n_words int, logits array<double>")
    assert [(r.start, r.end, r.label) for r in M.decode_span_logits(rows, 2, ["p"]).collect()] == [(0, 1, "p")]
    rows = spark.createDataFrame([(0, "p", [0.9, 0.1, 0.2], [0.1, 0.2, 0.8], [0.9, 0.7, 0.6])], "doc_id int, label string, starts array<double>, ends array<double>, insides array<double>")
    assert [(r.start, r.end, r.score) for r in M.decode_token_scores(rows).collect()] == [(0, 3, 0.6)]
    d = texts(spark, "at Acme Bank and (x)").select(M.expand_suffix(F.col("text"), F.lit("organization"), F.lit(7)).alias("e"), M.conservative_boundaries(F.col("text"), F.lit(3), F.lit(16)).alias("c")).first()
    assert d.e == 12 and (d.c.byte_start, d.c.byte_end) == (3, 12)
    with pytest.raises(Exception, match="invalid_model_score"):
        M.normalize(spark.createDataFrame([(0, "PER", 0, 1, "byte", 1.5)], "doc_id int, label string, start int, end int, offset_unit string, score double"), texts(spark, "ab"), {"PER": "person"}).collect()


def test_chunks_cover_the_text(spark):
    text = "Wörter und Wörter sind hier. " * 60
    rows = M.chunks(texts(spark, text), 200, 20).orderBy("index").collect()
    raw = text.encode()
    assert rows[0].byte_start == 0 and rows[-1].byte_end == len(raw) and all(raw[r.byte_start : r.byte_end].decode() == r.chunk and r.byte_end - r.byte_start <= 200 for r in rows)
    assert all(a.byte_start < b.byte_start <= a.byte_end for a, b in zip(rows, rows[1:]))


def test_sources(spark, tmp_path):
    sample = {"full_text": "é Bob", "spans": [{"entity_type": "PERSON", "entity_value": "Bob", "start_position": 2, "end_position": 5}], "template_id": 3}
    for name, root in (("list", [sample]), ("named", {"samples": [sample]}), ("data", {"data": [sample]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(root))
        row = datasets.read_samples(spark, str(tmp_path / f"{name}.json")).first()
        assert (row.text, row.template_id, row.spans[0].byte_start, row.spans[0].byte_end, row.spans[0].entity) == ("é Bob", 3, 3, 6, "PERSON")
    with pytest.raises(Exception, match="snapshot_mismatch"):
        datasets.read_samples(spark, str(tmp_path / "list.json"), "0" * 64).collect()
    line = json.loads(datasets.prediction_lines(analyze(texts(spark, "é a@b.com"))).first().value)
    assert line["sample_id"] == "0" and [(p["entity_type"], p["start_position"], p["end_position"]) for p in line["predictions"]] == [("email", 2, 9)]
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 1\n")
    assert [bytes(r.token) for r in datasets.read_ranks(spark, str(tmp_path / "ranks")).orderBy("rank").collect()] == [b"a", b"b"]
    (tmp_path / "bad").write_text("YQ== 0\nYQ== 1\n")
    with pytest.raises(Exception, match="repeated_token_or_rank"):
        datasets.read_ranks(spark, str(tmp_path / "bad")).collect()


def test_logs_and_telemetry():
    import logging

    record = logging.LogRecord("x", 20, "f", 1, "%(token)s", ({"token": "canary", "a": 1},), None)
    record.password = "canary"
    logs.RedactingFilter().filter(record)
    assert "canary" not in record.getMessage() and record.password == "[REDACTED]"
    assert logs.safe_event({"duration": 3, "x": 9}, {"profile": "fast", "text": "canary"}) == ({"duration": 3, "x": 0}, {"profile": "fast", "text": "redacted"})
    assert logs.redact_request({"Authorization": "canary", "q": "1"}) == {"Authorization": "[REDACTED]", "q": "1"}


def test_validators(spark):
    ips = spark.createDataFrame([(v,) for v in ("1.2.3.4", "1.2.3.256", "1.2.3.08", "::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2:3:4:5:6:7:8", "12345::1")], "v string")
    assert [r.x for r in ips.select(V.ip_address(F.col("v")).alias("x")).collect()] == [True, False, False, True, True, False, False, False]


# --- long rows -------------------------------------------------------------------------------------------------------


def test_running_totals(spark):
    r = random.Random(2)
    for n in (0, 1, 63, 64, 65, 4096, 4097, 9000):
        values = [r.randrange(100) for _ in range(n)]
        row = spark.createDataFrame([(values,)], "v array<int>").select(
            spans.running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s"), spans.running(F.col("v"), F.lit(-1), lambda a, x: F.greatest(a, x), levels=1).alias("m")
        ).first()
        assert row.s == [sum(values[:i]) for i in range(n)] if n < 5000 else row.s[-1] == sum(values[:-1])
        assert row.m == [max(values[:i], default=-1) for i in range(n)] if n < 5000 else row.m[-1] == max(values[:-1])


def test_matches_of_a_long_text(spark):
    words = [f"tök{i}" for i in range(60_000)]
    got = spark.createDataFrame([(" ".join(words),), ("",), (None,), ("no match: --",)], "t string").select(X.matches(F.col("t"), r"tök[0-9]+").alias("m")).collect()
    at, want = 0, []
    for w in words:
        size = len(w.encode())
        want.append((at, at + size, w))
        at += size + 1
    assert [tuple(m) for m in got[0].m] == want and [not r.m for r in got[1:]] == [True] * 3


def test_greedy_choice_by_runs_is_that_over_all(spark):
    r = random.Random(4)
    rows = []
    for _ in range(60):
        row = []
        for _ in range(r.randrange(0, 40)):
            b = r.randrange(200)
            row.append((b, b + r.randrange(1, 12), round(r.random(), 2), r.choice("ab")))
        rows.append(row)
    made = F.transform("r", lambda x: spans.span(byte_start=x["b"], byte_end=x["e"], score=x["s"], entity=x["k"]))
    key = lambda s: [-s["score"], -spans.length(s), s["byte_start"], s["byte_end"], s["entity"]]
    df = spark.createDataFrame([(x,) for x in rows], "r array<struct<b:int,e:int,s:double,k:string>>")
    got = df.select(spans.in_order(spans.keep_greedily(made, key)).alias("x")).collect()
    for row, kept in zip(rows, got):
        want = []
        for b, e, s, k in sorted(row, key=lambda x: (-x[2], x[0] - x[1], x[0], x[1], x[3])):
            if all(e <= b2 or e2 <= b for b2, e2, _, _ in want):
                want.append((b, e, s, k))
        assert [(x.byte_start, x.byte_end, x.score, x.entity) for x in kept.x] == sorted(want, key=lambda x: (x[0], x[1], x[3]))


def test_rewriting_a_text_with_many_spans(spark):
    text = " ".join(f"user{i}@mail.example.com" for i in range(3000))
    row = A.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), Options(entities=("email",)), merge_ws=False).first()
    assert row.anonymized == " ".join(["[EMAIL]"] * 3000) and len(row["items"]) == 3000
    data = row.anonymized.encode()
    assert all(data[x.replacement_byte_start : x.replacement_byte_end] == b"[EMAIL]" for x in row["items"])
    one = A.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), Options(entities=("email",)), merge_ws=True).first()
    assert one.anonymized == "[EMAIL]"
