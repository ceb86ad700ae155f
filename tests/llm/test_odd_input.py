"""Stated results for odd input, and brute force, for the operators that SQL cannot express."""

import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import decontaminate, language, near_copies, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "der hund und die katze " * 20_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], DOCS)


# --- language --------------------------------------------------------------------------------------------------------

WORDS = {"de": "der hund und die katze gehen nach haus weil es regnet".split(), "en": "the dog and a cat go home when it rains outside".split(), "fr": "le chien et la chatte vont chez eux car il pleut".split()}


def grams(text):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f"\0{w}\0"
        for n in (1, 2, 3):
            out.update(g for g in (w[i : i + n] for i in range(len(w) - n + 1)) if g.strip("\0") and (n < 3 or g[1] != "\0"))
    return out


def number(g):
    """The order among n-grams that are equally frequent."""
    a = [ord(c) for c in g]
    return a[0] if len(a) == 1 else (a[0] + 1 << 21) | a[1] if len(a) == 2 else (a[0] + 1 << 42) | (a[1] << 21) | a[2]


def top(counts, size):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def test_out_of_place_distance_by_brute_force(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(WORDS[k]) for _ in range(r.randrange(1, 30))), k) for i, k in enumerate(list(WORDS) * 30)]
    size = 60
    profiles = {k: top(sum((grams(t) for _, t, lang in rows if lang == k), Counter()), size) for k in WORDS}
    learned = language.learn(docs(spark, rows), size=size)
    texts = [t for _, t, _ in rows[:40]] + ["hund dog chien", "x", "1 2 3", "", None, "der the le", LONG]
    for t in texts:
        mine = top(grams(t or ""), size)
        if not mine:
            assert learned.predict(t) == ("und", 0.0)
            continue
        far = {k: sum(abs(i - p.index(g)) if g in p else size for i, g in enumerate(mine)) for k, p in profiles.items()}
        lang, score = learned.predict(t)
        assert lang == min(far, key=lambda k: (far[k], k)) and abs(score - (1 - far[lang] / (size * len(mine)))) < 1e-12


def test_language_of_odd_tables(spark):
    rows = [(i, " ".join(WORDS[k]), k) for i, k in enumerate(list(WORDS) * 12)]
    rows += [(100, None, "de"), (101, "", "en"), (102, " ", None), (None, "der hund", "de"), (103, LONG, None), (104, "the dog", None), (104, "the dog", None)]
    more = spark.createDataFrame([(i, t, k, True, "x", 2.0) for i, t, k in rows], "doc_id long, text string, lang string, held_out boolean, lang_pred string, score double")
    got = language.learn_and_identify(more).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == "und" and by[103].lang_pred == "de" and by[104].lang_pred == "en" and by[None].lang_pred == "de" and not by[None].held_out
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert language.learn_and_identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in language.identify(docs(spark, rows), language.learn(docs(spark, []))).collect()} == {"und"}


def test_tie_goes_to_the_first_language():
    p = language.Profiles({"b": [97, 98], "a": [97, 98]}, 2)
    assert p.predict("a b")[0] == "a" and p.predict("zz")[0] == "a"


def test_heavily_copied_texts_are_sampled_by_row(spark):
    """One text, very often: about as many of its rows are learned as stated, not all or none."""
    seen = []
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'der hund' AS text", "'de' AS lang")
    counts = language.gram_counts("der hund")
    profiles = language.learn(rows, train_rows=500)
    assert profiles.langs == ["de"] and len(profiles.keys) == len(counts[0]) and not seen


# --- WARC ------------------------------------------------------------------------------------------------------------


def member(payload, level=6):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/octet-stream\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head + payload + b"\r\n\r\n") + packer.flush()


@pytest.mark.parametrize("step", [1, 7, 50, 1000])
def test_members_stored_inside_members_are_not_records(step):
    """An archive as the payload of a stored record: at no split do its members count, and every outer member counts once."""
    inner = member(b"inner " * 5, 0)
    whole = [member(b"first"), member(b"xx" + inner + b"yy", 0), member(b"last"), member(inner + b"-", 0), member(b"end")]
    data = b"".join(whole)
    read = lambda at, n: data[at : at + n]
    want = [sum(map(len, whole[:k])) for k in range(len(whole))]
    found = [at for start in range(0, len(data), step) for at, _ in warc.members(read, len(data), start, start + step)]
    assert found == want
    assert io.BytesIO(data).read(2) == b"\x1f\x8b"


def test_short_payloads_are_not_joined(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "" if i % 2 else "a" * 1200, 7) for i in range(40)] + [(None, None, None, 7), (99, "u", "é" * 600, 7)], "page_id long, url string, html string, revisit int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 42 and got[38].record_type == "response" and got[0].refers_to == 38 and got[1].record_type == "response" and got[99].payload_bytes == 1200
    assert warc.round_trip(pages.filter("false")).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def labelled(n=300):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        bad, poor = i % 5 == 0, i % 3 == 0
        words = [f"w{r.randrange(400)}" for _ in range(40)] + ["vile"] * bad + ["junk"] * poor
        r.shuffle(words)
        rows.append((i, " ".join(words).replace("w", "q").translate(str.maketrans("0123456789", "abcdefghij")), "en"))
        labels.append((i, 0 if poor else 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_later_links_are_trained_on_out_of_fold_probabilities(monkeypatch):
    """The second model's dense input is what models fitted without a row's fold say of it."""
    r = np.random.default_rng(0)
    rows = [sorted(r.choice(30, 6, replace=False).tolist()) for _ in range(80)]
    y = np.column_stack([[0 in x for x in rows], [1 in x for x in rows]]).astype(float)
    seen, fit = [], toxicity.Linear.fit

    def watched(self, flat, row, dense, target):
        seen.append((self, dense.copy(), target.copy()))
        return fit(self, flat, row, dense, target)

    monkeypatch.setattr(toxicity.Linear, "fit", watched)
    chain = toxicity.fit_arrays({str(i): i for i in range(30)}, rows, y)
    fold = np.arange(80) % toxicity.FOLDS
    flat, row = np.concatenate(rows), np.repeat(np.arange(80), 6)
    held = np.zeros(80)
    for k in range(toxicity.FOLDS):
        model, _, target = seen[k]
        assert len(target) == (fold != k).sum()
        held[fold == k] = toxicity.sigmoid(model.logits(flat, row, np.zeros((80, 0))))[fold == k]
    final = next(d for m, d, _ in seen if m is chain.models[1])
    assert np.allclose(final[:, 0], held)


def test_toxicity_of_odd_tables(spark):
    rows, labels = labelled()
    table = spark.createDataFrame([*labels, (1, 1, 1), (1, None, 0), (None, 1, 1), (9999, 1, 1)], LABELS)
    odd = [(1000, None, None), (1001, "", None), (1002, "123 ...", None), (None, "vile", None), (1003, "vile " * 50_000, None), (1004, "calm words", None), (1004, "calm words", None)]
    more = spark.createDataFrame([(i, t, k, 0.5, True) for i, t, k in rows + odd], "doc_id long, text string, lang string, p_toxic double, is_toxic boolean")
    got = toxicity.classify(more, table).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert not any(by[i].is_toxic for i in (1000, 1001, 1002, 1004)) and by[1003].is_toxic and by[None].is_toxic
    kept = toxicity.without_toxic(more, table)
    assert kept.columns == more.columns and 1003 not in {r.doc_id for r in kept.collect()} and kept.filter("doc_id = 1004").count() == 2
    for empty in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, None, None)], LABELS)):
        assert not any(r.is_toxic or r.p_toxic for r in toxicity.classify(docs(spark, rows[:5]), empty).collect())
    assert toxicity.classify(docs(spark, []), table).count() == 0


def test_the_largest_of_several_labels_counts(spark):
    rows, labels = labelled()
    double = [(i, q, 0) for i, q, _ in labels] + labels + [(i, q, 0) for i, q, _ in labels]
    one, many = (toxicity.fit(docs(spark, rows), spark.createDataFrame(x, LABELS)) for x in (labels, double))
    assert one.words == many.words and abs(one.threshold - many.threshold) < 1e-9


# --- decontamination -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [60, 400, 1 << 20])
def test_items_of_any_length_in_any_blocks(spark, block):
    r = random.Random(11)
    words = [f"w{i}" for i in range(12)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 1, 2, 3, 9, 10, 11, 25])))) for k in range(30)] + [(None, "w1 w2 w3"), (30, None), (31, "--"), (5, "w9 w9")]
    rows = [(i, " ".join(r.choice([*words, "z", "Y"]) for _ in range(r.randrange(0, 60))).upper(), "en") for i in range(40)] + [(77, None, "en"), (None, "w1 w2 w3", "en"), (1, "w1", "en")]

    def by_hand(text):
        ws = decontaminate.words_of(text)
        hit, found = set(), set()
        for item, t in items:
            w = decontaminate.words_of(t)
            m = min(10, len(w))
            for k in range(len(w) - m + 1 if m else 0):
                for at in range(len(ws) - m + 1):
                    if ws[at : at + m] == w[k : k + m]:
                        hit.update(range(at, at + m))
                        found |= {str(item)} if item is not None else set()
        return len(ws), len(hit), len(found)

    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs(spark, rows), bench, block_bytes=block).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items) for r in got) == sorted((i or -1, *by_hand(t)) for i, t, _ in rows)


# --- near copies -----------------------------------------------------------------------------------------------------


def test_one_large_group_of_edits(spark, monkeypatch):
    """Edits of one text, near to it and far from it: the same classes as all pairs give, with pairs found in either way."""
    r = random.Random(3)
    base = [f"b{r.randrange(900)}" for _ in range(150)]
    texts = {}
    for i in range(260):
        words = list(base)
        for at in r.sample(range(150), r.choice([0, 1, 2, 3, 4, 6, 9])):
            words[at] = f"x{r.randrange(9000)}"
        texts[i] = " ".join(words)
    sets = {i: set(near_copies.shingles(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k >= 0.8 * (len(sets[i]) + len(sets[j]) - k) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {a: new if b == old else b for a, b in root.items()}
    d = docs(spark, [(i, t, "en") for i, t in texts.items()])
    for few in (near_copies.FEW, 1):
        monkeypatch.setattr(near_copies, "FEW", few)
        assert sorted(x.doc_id for x in near_copies.one_of_each(d).select("doc_id").collect()) == sorted(set(root.values()))


# --- stages ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows, labels = labelled(120)
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, sf_dir, name, stage):
    """Empty tables, nulls, repeated rows and ids, a very long text, columns with the names that stages use themselves."""
    rows, _ = labelled(40)
    odd = [(None, None, None), (None, "", "en"), (None, "a lone row without an id", "en"), (None, "a lone row without an id", "en"), (7000, LONG, "de"), (7001, "twice the same row", "en"), (7001, "twice the same row", "en"), (7002, None, None)]
    extra = ", row string, n long, rate double, copies int, key long, root long, spans string, items string, is_toxic boolean"
    more = spark.createDataFrame([(i, t, k, "s", 1, "r", 1, 0.5, 2, 3, 4, "a", "b", True) for i, t, k in rows + odd], DOCS + extra)
    out = stage(spark, more, sf_dir)
    got = out.collect()
    assert got and stage(spark, more.filter("false"), sf_dir).count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == more.columns and 7000 in {r.doc_id for r in got}
