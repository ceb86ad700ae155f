"""Acceptance cases, as data: what a text holds, by recognizer, profile, context, model outputs and nested data. All cases of a kind run as one table."""

import json
import os

import pytest

from palimpsest.operators import structured as ST
from palimpsest.operators import vault as K
from palimpsest.operators.analyze import Options, analyze
from palimpsest.streaming.rehydrate import Rehydrator

with open(os.path.join(os.path.dirname(__file__), "acceptance.json"), encoding="utf-8") as f:
    CASES = json.load(f)


def spans_of(spark, texts, options, outputs=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in analyze(docs, options, outputs=outputs).collect()}


def place(text, value):
    at = text.encode().index(value.encode())
    return at, at + len(value.encode())


@pytest.fixture(scope="module")
def recognized(spark):
    out = {}
    for entity, cases in CASES["recognizers"].items():
        got = spans_of(spark, [t for t, _ in cases], Options(entities=(entity,)))
        out |= {(entity, t): got[i] for i, (t, _) in enumerate(cases)}
    return out


@pytest.mark.parametrize("entity, text, values", [(e, t, v) for e, cases in CASES["recognizers"].items() for t, v in cases])
def test_recognizer(recognized, entity, text, values):
    assert [(s.entity, s.byte_start, s.byte_end, s.text) for s in recognized[entity, text]] == [(entity, *place(text, v), v) for v in values]


@pytest.fixture(scope="module")
def wide(spark):
    out = {}
    for entities in {tuple(e) for _, e, _ in CASES["wide"]}:
        texts = [t for t, e, _ in CASES["wide"] if tuple(e) == entities]
        got = spans_of(spark, texts, Options(profile="deterministic_plus", entities=entities))
        out |= {(t, entities): got[i] for i, t in enumerate(texts)}
    return out


@pytest.mark.parametrize("text, entities, values", CASES["wide"])
def test_wide_profile(wide, text, entities, values):
    assert sorted((s.entity, s.text) for s in wide[text, tuple(entities)]) == sorted(map(tuple, values))


@pytest.mark.parametrize("without, with_, entity, value, words", CASES["context"])
def test_context_raises_the_score(spark, without, with_, entity, value, words):
    got = spans_of(spark, [without, with_], Options(entities=(entity,), profile="deterministic_plus"))
    (a,), (b,) = got[0], got[1]
    assert a.text == b.text == value and b.score > a.score and set(words) & {w.lower() for w in b.context_matched}


@pytest.mark.parametrize("text, entities, outputs, values", CASES["models"])
def test_model_outputs(spark, text, entities, outputs, values):
    at = lambda v: text.index(v)
    rows = spark.createDataFrame([(0, label, at(v), at(v) + len(v), "character", score) for label, v, score in outputs], "doc_id long, label string, start int, end int, offset_unit string, score double")
    got = spans_of(spark, [text], Options(profile="hybrid_gliner_urchade", entities=tuple(entities)), rows)
    assert [(s.entity, s.byte_start, s.byte_end, s.text) for s in got[0]] == [(e, *place(text, v), v) for e, v in values]


@pytest.mark.parametrize("data, entities, policies, want", CASES["nested"])
def test_nested_data(spark, data, entities, policies, want):
    rows = ST.leaves(spark.createDataFrame([(1, json.dumps(data))], "doc_id long, j string"), "j")
    out = ST.renest(ST.redact_leaves(rows, policies, Options(entities=tuple(entities)))).first()
    assert json.loads(out.json) == want


def test_vault_reuses_tokens_and_restores(spark):
    rows = spark.createDataFrame([(1, 0, "email", "jane@example.com"), (1, 20, "email", "jane@example.com"), (1, 40, "phone", "202-555-0188")], "doc_id long, b int, entity string, value string")
    vault = K.build(rows, ["doc_id", "b"])
    assert {(r.value, r.token) for r in vault.collect()} == {("jane@example.com", "<<EMAIL_001>>"), ("202-555-0188", "<<PHONE_001>>")}
    docs = spark.createDataFrame([(1, "Email <<EMAIL_001>> Phone <<PHONE_001>>")], "doc_id long, text string")
    assert K.rehydrate(docs, vault).first().restored == "Email jane@example.com Phone 202-555-0188"


def test_messages_of_some_roles(spark):
    messages = spark.createDataFrame([(1, 0, "system", "Be concise."), (1, 1, "user", "Email jane@example.com")], "conv_id long, turn long, role string, text string")
    out, vault = ST.redact_messages(messages, options=Options(entities=("email",)))
    assert [r.anonymized for r in out.orderBy("turn").collect()] == ["Be concise.", "Email <<EMAIL_001>>"]
    reply = spark.createDataFrame([(1, 2, "assistant", "I will contact <<EMAIL_001>>.")], "conv_id long, turn long, role string, text string")
    assert ST.rehydrate_messages(reply, vault).first().restored == "I will contact jane@example.com."


def test_split_tokens():
    r = Rehydrator({"<<EMAIL_001>>": "jane@example.com"}.get)
    assert [r.feed(c) for c in ("Hello <<EMA", "IL_001", ">>")] == ["Hello ", "", "jane@example.com"] and r.flush() == ""


def test_url_and_domain_both_stay(spark):
    got = spans_of(spark, ["Open https://example.com/login"], Options(entities=("url", "domain")))
    assert [(s.entity, s.text) for s in got[0]] == [("url", "https://example.com/login"), ("domain", "example.com")]
