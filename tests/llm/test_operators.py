"""Each operator of the llm package on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns, and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from palimpsest.llm import decontaminate, language, licenses, mixing, quality, simhash, surrogates, tokens, toxicity, warc
from palimpsest.llm.common import scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text here."), (5, "Same text here."), (6, "Same text here."), (None, "No id at all."), (7, "É𝄞 ümläut 漢字   x"), (8, "a\n\nb  c")]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def clashing(spark, rows=ODD):
    """More columns, named like what operators add."""
    return spark.createDataFrame([(i, t, "en", "s", None, 0, "x", 1.5) for i, t in rows], DOCS + ", fp int, row string, p_toxic double")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_contract():
    for _, t in ODD[:3] + ODD[4:]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def near(n, seed):
    """Random fingerprints with clusters of close ones."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = r.getrandbits(64)
        out.append(base)
        for _ in range(r.randrange(4)):
            x = base
            for b in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << b
            out.append(x)
    return out


@pytest.mark.parametrize("fanout", [2, 8])
def test_index_finds_all_neighbours(fanout):
    fps = np.array(sorted(set(near(300, 1))), np.uint64)
    space = np.arange(len(fps)) % 3
    space.sort()
    index = simhash.GrayIndex(fps, space, fanout)
    q, found = index.search(index.fps, np.searchsorted(index.levels[-1][2], index.space), 2)
    got = set(zip(q.tolist(), found.tolist()))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if index.space[i] == index.space[j] and int(index.fps[i] ^ index.fps[j]).bit_count() <= 2}
    assert got == want


def test_index_prunes_whole_groups():
    """In a space as the segments make it (21 bits fixed), the tree is several levels deep, and the more leaves it has, the smaller is the share that is looked at."""
    r = np.random.default_rng(4)
    for size, share in ((64, 0.95), (1024, 0.3), (8192, 0.1)):
        fps = np.unique((np.uint64(0x15555) << np.uint64(43)) | r.integers(0, 1 << 43, size, np.uint64))
        index = simhash.GrayIndex(fps, np.zeros(len(fps), int))
        index.search(index.fps, np.zeros(len(fps), int), 2)
        assert len(index.levels) >= 3 and index.visited[0] <= share * len(fps) ** 2, (size, index.visited)


def brute_components(pairs, radius=2):
    ids = [i for i, _ in pairs]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in pairs:
        for b, y in pairs:
            if (x ^ y).bit_count() <= radius:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("limit", [1024, 4])
def test_links_and_components(spark, limit):
    """A small limit splits spaces; links must not depend on it."""
    fps = sorted(set(near(60, 2) + [0, 1, 3, 7, 15, 31, 63, 127]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.local_links(distinct, 2, limit)).collect()}
    want = brute_components(list(zip(signed, fps)))
    assert {x: roots.get(x, x) for x in signed} == want


def test_near_duplicates_on_odd_rows(spark):
    got = rows(simhash.near_duplicates(clashing(spark)), "doc_id", "fingerprint", "component_id")
    byid = {i: (f, c) for i, f, c in got}
    assert byid[1] == byid[2] == byid[3] == ("0" * 16, 1)
    assert byid[5][1] == byid[6][1] == 5 and byid[4][1] == 4
    assert len(got) == len(ODD) and byid[None][1] is None
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_one_of_each_keeps_columns(spark):
    kept = simhash.one_of_each(clashing(spark))
    assert kept.columns == clashing(spark).columns
    assert [i for i, _ in rows(kept, "doc_id", "text")] == [1, 4, 5, 7, 8, None] or sorted(i or 0 for i, _ in rows(kept, "doc_id", "text")) == [0, 1, 4, 5, 7, 8]


# --- decontamination -------------------------------------------------------------------------------------------------


def brute_hits(text, items, width=10):
    words = decontaminate.words_of(text)
    hit, names = set(), set()
    for name, t in items:
        w = decontaminate.words_of(t)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[k : k + m]:
                    hit.update(range(i, i + m))
                    names.add(name)
    return len(hit), sorted(str(n) for n in names if n is not None)


def test_wu_manber_against_brute_force():
    r = random.Random(3)
    vocabulary = "a b c d e".split()
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(str(i), text(n)) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 14])] + [("x", None), ("y", "--"), (None, "z z z")]
    items = items[1:]
    matcher = decontaminate.Matcher(items, width=6)
    for n in (0, 1, 5, 40, 200):
        t = text(n) + " z z z"
        found, names = matcher.hits(decontaminate.words_of(t))
        want = brute_hits(t, items, 6)
        assert sum(b - a for a, b in found) == want[0]
        assert sorted(x for x in names if x is not None) == want[1]


def test_items_of_one_word():
    r = random.Random(4)
    items = [("1", "a"), ("2", "B"), ("3", "c d"), ("4", "-e-"), ("5", "q")]
    matcher = decontaminate.Matcher(items)
    for n in (1, 2, 7, 50):
        t = " ".join(r.choice("a b c d e f g".split()) for _ in range(n))
        found, names = matcher.hits(decontaminate.words_of(t))
        assert (sum(b - a for a, b in found), sorted(names)) == brute_hits(t, items)
    assert matcher.hits(["a", "x", "a", "x", "a"])[0] == [(0, 1), (2, 3), (4, 5)]


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_contamination_rows(spark, block):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (2, "short item"), (None, "hidden words"), (3, None), (4, "")]
    texts = [*ODD, (20, "X one TWO three four five six seven eight nine ten, eleven"), (21, "a short-item and hidden words"), (22, "ten nine eight")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(clashing(spark, texts), bench, block_bytes=block).collect()}
    for i, t in texts:
        n, names = brute_hits(t, [(str(a) if a is not None else None, b) for a, b in items])
        assert (got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, len(names), n > 0)
        assert got[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert got[i].n_words == len(decontaminate.words_of(t))
    clean = decontaminate.without_contaminated(clashing(spark, texts), bench, block_bytes=block)
    assert clean.columns == clashing(spark).columns and sorted(i or 0 for i, in rows(clean, "doc_id")) == sorted([i or 0 for i, _ in ODD] + [22])
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate.contamination(docs(spark), empty).collect())


# --- tokens ----------------------------------------------------------------------------------------------------------


def test_rank_coding_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = (r.integers(0, 1 << 32, n) >> r.integers(0, 32, n)).astype(np.uint32)
        control, data = tokens.encode_ranks(x)
        assert (tokens.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == x).all()


def test_block_round_trip():
    ids = [np.array([5, 5, 70_000, 0], np.uint32), np.array([0], np.uint32)]
    names, got = tokens.decode_block(tokens.encode_block([None, -3], ids))
    assert names == [None, -3] and all((a == b).all() for a, b in zip(ids, got))
    with pytest.raises(ValueError):
        tokens.decode_block(b"x" * 40)


def test_tokenise_equals_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    encode = Tokenizer.from_file(path).encode
    texts = [*ODD, (30, "it's we'll\tx  y\r\n<|endoftext|> z"), (31, "a1b2 ... !!\n\n\n x"), (32, "naïve café—dash αβγ"), (33, "   lead and trail  ")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokens.tokenise(clashing(spark, texts), path, block_ids=50).collect()), key=lambda x: x[2])
    want = {}
    for i, t in texts:
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        want[i] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    at = 0
    assert [g[:2] for g in got] == sorted((i is not None, i or 0) for i, _ in texts)
    for known, i, start, n, crc in got:
        assert start == at and (n, crc) == want[i if known else None]
        at += n
    assert tokens.tokenise(docs(spark, []), path).count() == 0


def test_encoder_equals_the_tokenizer_on_random_text(monkeypatch):
    """Contractions, marks, all kinds of blanks, the special token, other scripts; a cache that turns over all the time."""
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    whole, coder, r = Tokenizer.from_file(path), tokens.Encoder(open(path, encoding="utf-8").read()), random.Random(5)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    atoms = ["a", "Word", " the", "'s", "'ll", "'", "n't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u200b", "\u2028", "\u3000", "\u1680", "\u205f", "—", "“", "é", "e\u0301", "ß", "д", "漢字", "か", "1", "23", "½", ".", ",", "!!", "<|", "<|endoftext|>", "<", "|", "_", "-", "\x00", "\x7f", "😀", "Ġ", "Ċ", "ſ"]
    for _ in range(100):
        texts = ["".join(r.choice(atoms) for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 60))]
        for t, got in zip(texts, coder.encode(texts)):
            assert got.tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


# --- WARC ------------------------------------------------------------------------------------------------------------


def test_members_at_any_split():
    payloads = [b"<html>" + bytes([65 + i % 26]) * (i * 37 % 400) + warc.MAGIC * (i % 3) for i in range(40)]
    data = b"".join(warc.record(i, f"http://x/{i}", p, len(p), hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate(payloads))
    data = data[:100] + b"" + data[100:] + b"\x1f\x8b\x08 no member"
    read = lambda at, n: data[at : at + n]
    for size in (1, 7, 100, 333, len(data)):
        found = [(at, h["warc-record-id"], block.partition(b"\r\n\r\n")[2]) for s in range(0, len(data), size) for at, c in warc.members(read, len(data), s, s + size) for h, block in warc.parse(c)]
        assert [x[2] for x in found] == payloads and len({x[0] for x in found}) == 40


def test_round_trip_of_pages(spark):
    big, small = "é" * 600, "tiny"
    pages = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", small), (4, "http://d", small), (5, "u\r\nx", None), (None, "http://n", "n" * 2000), (6, "http://e", LONG)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")).collect()}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 9, 3, 4)] == [("revisit", 9), ("revisit", 9), ("response", None), ("response", None), ("response", None)]
    assert got[5].url == "u%0D%0Ax" and got[1].url == "http://a" and got[9].url is None
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_reader_gives_payloads_and_splits(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string")
    files = warc.write_archives(pages, scratch(spark, "t"))
    got = warc.read_archives(files, split_bytes=64).collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted(f"page {i} " * 50 for i in range(30))


# --- language --------------------------------------------------------------------------------------------------------


def test_gram_counts_by_pieces(monkeypatch):
    text = "The quick, brown FOX—jumps 12 over l'été " * 20
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_PIECE", 50)
    parts = language.gram_counts(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert len(language.gram_counts("12 .-")[0]) == len(language.gram_counts(None)[0]) == len(language.gram_counts("")[0]) == 0


def test_language_of_held_out_documents(spark):
    r = random.Random(5)
    words = {"xx": "the and of to that with for".split(), "yy": "der und nicht ein schon mit".split()}
    texts = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i in range(200) for k in [("xx", "yy")[i % 2]]] + [(900, None, "xx"), (901, "123 ...", "yy"), (902, "the and", None)]
    d = spark.createDataFrame([(i, t, k, "s", None) for i, t, k in texts], DOCS)
    got = {x.doc_id: x for x in language.learn_and_identify(d).collect()}
    assert all(got[i].lang_pred == k for i, t, k in texts[:200])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in texts)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "xx" and all(0 <= x.score <= 1 for x in got.values())
    assert {x.lang_pred for x in language.identify(docs(spark), language.learn(docs(spark, []))).collect()} == {"und"}


# --- quality ---------------------------------------------------------------------------------------------------------


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)})


def test_repeated_words_against_brute_force():
    r = random.Random(6)
    for n in (0, 4, 5, 6, 30, 120):
        for k in (2, 5, 40):
            words = [str(r.randrange(k)) for _ in range(n)]
            assert quality.repeated_words(words) == brute_repeats(words)


def test_lines_and_verdict(spark):
    good = "This is a sentence with enough words in it.\nAnd here there is another one, quite different."
    menu = "home\nlogin\na | b | c | d\nWe use cookies to enable javascript\n" + "one two three four five six seven eight nine ten"
    got = {r.doc_id: r for r in quality.evaluate(clashing(spark, [*ODD, (10, good), (11, menu), (12, good + "\n" + good.split("\n")[0])]), with_text=True).collect()}
    assert got[10].kept and got[10].clean_text == good and not got[11].kept and not got[11].base_failed
    assert got[12].n_dup_lines == 1 and got[1].n_words == 0 and got[1].base_failed and not got[4].kept
    assert quality.evaluate(docs(spark, [])).count() == 0


# --- toxicity --------------------------------------------------------------------------------------------------------


def test_chain_finds_planted_words(spark):
    r = random.Random(7)
    vocabulary, bad = [a + b for a in "bcdfg" for b in "aeiou"], ["vile", "nasty"]
    made = []
    for i in range(600):
        words = [r.choice(vocabulary) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            words[r.randrange(30)] = r.choice(bad)
        made.append((i, " ".join(words), toxic))
    d = docs(spark, [(i, t) for i, t, _ in made] + [(900 + k, t) for k, (_, t) in enumerate(ODD)])
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in made[:400]] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.classify(d, labels).collect()}
    assert all(got[i].is_toxic == t for i, _, t in made)
    assert not any(got[900 + k].is_toxic for k in range(len(ODD)))
    kept = toxicity.without_toxic(d.selectExpr("*", "1 AS row", "2 AS p_toxic"), labels)
    assert kept.columns[-2:] == ["row", "p_toxic"] and kept.count() == d.count() - 120
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert not any(x.is_toxic or x.p_toxic for x in toxicity.classify(docs(spark), none).collect())


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    clean = [(i, "plain words of a document here. " * (1 + i % 7)) for i in range(200)]
    noisy = [(1000 + i, "#### $$$ %%% &&& " * (1 + i % 5)) for i in range(200)]
    d = docs(spark, clean + noisy + [(5000, None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000 + i, 0, 0) for i in range(0, 200, 2)] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    got = mixing.document_rates(d, labels, targets={"1": 0.8, "0": 0.2}).collect()
    tokens_ = {k: sum(r.n_tokens * r.rate * r[f"p_{k}"] for r in got) for k in "01"}
    share = tokens_["1"] / sum(tokens_.values())
    assert abs(share - 0.8) < 0.05 and all(r.rate >= 0 for r in got)
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.copies for r in got) - sum(tokens_.values())) < 0.1 * total
    mixed = mixing.mix(clashing(spark, clean + noisy), labels, lower=1.0)
    assert mixed.columns == clashing(spark).columns and {r.doc_id for r in mixed.collect()} == {i for i, _ in clean + noisy}


def brute_rates(share, p, w, lower, ridge):
    """The least squares of the documents themselves, by accelerated projected gradient over one rate a document."""
    rate = z = np.maximum(np.ones(len(share)), lower)
    k = 1.0
    for _ in range(20_000):
        new = np.maximum(lower, z - (p @ ((share * z) @ p - w) + ridge * (z - 1)) / (1 + ridge))
        if np.abs(new - rate).max() < 1e-13:
            return new
        if ((z - new) * (new - rate) * share).sum() > 0:  # start again where it swings
            k = 1.0
        after = (1 + (1 + 4 * k * k) ** 0.5) / 2
        rate, z, k = new, new + (k - 1) / after * (new - rate), after
    return rate


def three_domains(spark):
    """Domain c has about one word in a hundred."""
    kinds = [("a", 300, "plain words of a document here. "), ("b", 150, "SHOUTED Words AND More OF Them\n"), ("c", 10, "#### $$$ %%% 12 &&& ")]
    rows = [(k * 1000 + i, text * (1 + i % 7)) for k, (_, n, text) in enumerate(kinds) for i in range(n)]
    labels = [(k * 1000 + i, name) for k, (name, n, _) in enumerate(kinds) for i in range(0, n, 2)] + [(1, "b"), (1002, "a"), (2, None), (3, "unknown")]
    return rows, spark.createDataFrame(labels, "doc_id long, kind string")


@pytest.mark.parametrize("lower, scale, targets", [(0.0, 1.0, {"a": 0.4, "b": 0.4, "c": 0.2}), (1.0, 1.25, {"a": 0.5, "b": 0.45, "c": 0.05}), (0.0, 1.0, {"a": 0.01, "b": 0.98, "c": 0.01})])
def test_rates_solve_the_least_squares_of_the_documents(spark, lower, scale, targets):
    rows_, labels = three_domains(spark)
    w = scale * np.array([targets[d] for d in "abc"])
    for ridge in (0.01, mixing.RIDGE):
        got = mixing.document_rates(docs(spark, rows_), labels, "kind", targets, lower=lower, scale=scale, ridge=ridge).collect()
        share = np.array([r.n_tokens for r in got]) / sum(r.n_tokens for r in got)
        p, rate = np.array([(r.p_a, r.p_b, r.p_c) for r in got]), np.array([r.rate for r in got])
        totals = (share * rate) @ p
        assert np.abs(rate - np.maximum(lower, 1 - p @ (totals - w) / ridge)).max() < 1e-3  # where the gradient vanishes on every free rate
        if ridge == 0.01:
            assert np.abs(rate - brute_rates(share, p, w, lower, ridge)).max() < 1e-3
        elif lower == 0:
            assert (np.abs(totals - w) <= 0.005 * w).all()


def test_reached_tells_what_cannot_be_met(spark):
    """Every document looks alike, so no rate can raise one domain above the other."""
    d = docs(spark, [(i, "same shape of text here") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    rates = mixing.fit_rates(mixing.counted_cells(d), labels)
    got = {r.domain: r for r in mixing.reached(rates).collect()}
    assert not got["0"].met and not got["1"].met and abs(got["0"].expected - 0.5) < 0.01 and abs(got["1"].target - 0.8) < 1e-9


def test_cells_are_those_of_each_text(spark):
    """Bins by hand, on their edges too; words are counted word by word."""
    texts = ["", None, "one", " one  two ", "a\nb\n\nc", "tab\tand\rmore", "word " * 10 + "end", "A1#" * 40, "x" * 9, LONG, "é 漢字 Ü", "w" * 3 + " " + "w" * 4]
    rows_ = [(i, t) for i, t in enumerate(texts)]

    def by_hand(t):
        t = t or ""
        words = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        chars, many = max(1, len(t)), max(1, words)
        count = lambda cs: sum(c in cs for c in t)
        value = {"words": words, "symbols": count("#*$%&|<>!") / many, "upper": sum("A" <= c <= "Z" for c in t) / chars, "digits": sum("0" <= c <= "9" for c in t) / chars, "lines": t.count("\n") / many, "length": chars / many}
        cell = 0
        for name, edges in mixing.EDGES.items():
            cell = cell * (len(edges) + 1) + sum(value[name] >= e for e in edges)
        return words, cell

    got = {r.doc_id: (r._tokens, r._cell) for r in mixing.cells(docs(spark, rows_)).collect()}
    assert got == {i: by_hand(t) for i, t in rows_}


def test_document_rates_with_clashing_columns_and_repeated_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(5, 0, 0)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(i, t, 1, 2, 0.5, 3, 4) for i, t in [*ODD, *ODD]], "doc_id long, text string, rate int, copies int, share double, _cell int, _words int")
    got = mixing.document_rates(more, labels).collect()
    assert len(got) == 2 * len(ODD) and all(r.rate >= 0 for r in got)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_tokens), set()).add((r.rate, r.copies))
    assert all(len(x) == 1 for x in same.values())
    mixed = mixing.mix(more, labels, lower=1.0)
    assert mixed.columns == more.columns and {r.doc_id for r in mixed.collect()} == {i for i, _ in ODD}


def test_mixing_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.document_rates(docs(spark), none).count() == len(ODD)
    assert mixing.document_rates(docs(spark, []), none).count() == 0


# --- licences --------------------------------------------------------------------------------------------------------


def test_every_sentence_has_an_anchor():
    """However its lines are wrapped; names of licences after "under" have a pattern of their own."""
    for forms in [*licenses.SENTENCES.values(), *licenses.HEADINGS.values()]:
        assert all(any(a in s.lower().replace(" ", "\n") for a in licenses.ANCHORS) for s in forms)
    for names in licenses.REFERENCES.values():
        assert all(any(a in n for a in licenses.ANCHORS) or re.search(licenses.NAMES, f"under\n{n}") for n in names)
    assert {i for _, run in licenses.RULES for i in run} <= set(licenses.known().values())
    assert len(set(licenses.known().values())) >= 90


def test_licences_with_holders_and_by_reference(spark):
    S = licenses.SENTENCES
    bsd = ".\n".join([S["BSDRedistribution"][0] + ":\n\n1", S["BSDSource"][0], S["BSDBinary"][0], "Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission".replace("Inc.", "Inc"), "THIS SOFTWARE IS PROVIDED BY GOOGLE INC AND CONTRIBUTORS " + S["BSDAsIs"][0].split("CONTRIBUTORS ")[1]])
    agpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.".split(": ")
    texts = {
        bsd: "BSD-3-Clause", ":\n".join(agpl): "AGPL-3.0-or-later", "Distributed under the Boost Software License.": "BSL-1.0", "This software is licensed under the MIT license": "MIT", "Licensed under the MIT license, see LICENSE.": "MIT",
        "It is code.\nThe source code is released under the terms of the GNU General\nPublic License v3.0.": "GPL-3.0", "Made available under an ISC licence.": "ISC", "Provided under LGPL-2.1.": "LGPL-2.1", "All files are distributed under the Eclipse Public License 2.0.": "EPL-2.0",
        "This is free and unencumbered software released into\nthe public\ndomain.": "Unlicense", "This work is in the public  domain.": "public-domain", "Released under\nCC BY-SA 4.0": "CC-BY-SA-4.0", "We sat under the apple tree.": "", "under the GPL spell": "", "All rights reserved.": "",
        ". ".join([S["ZlibAsIs"][0], S["ZlibLiable"][0], S["ZlibPermission"][0]]): "Zlib", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.": "Apache-2.0",
    }
    got = {r.doc_id: r.licences for r in licenses.scan(docs(spark, list(enumerate(texts)))).collect()}
    assert {t: got[i] for i, t in enumerate(texts)} == texts


def test_licence_rules(spark):
    mit = "MIT License\n\nCopyright (c) 2020 X\n\n" + ".\n\n".join(licenses.SENTENCES[k][0] for k in ("MITPermission", "MITNotice", "MITAsIs", "MITLiability"))
    texts = [*ODD, (40, mit), (41, "Some text.\nLicensed under CC BY-NC 4.0."), (42, "x. Released under the MIT License. y.\nLicensed under the Apache License, Version 2.0."), (43, "All rights reserved.")]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licenses.scan(clashing(spark, texts)).collect()}
    assert got[40] == (5, "MIT") and got[41] == (1, "CC-BY-NC-4.0") and got[42] == (2, "Apache-2.0,MIT") and got[43] == (1, "")
    assert all(got[i] == (0, "") for i, _ in ODD) and licenses.scan(docs(spark, [])).count() == 0


# --- surrogates ------------------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_surrogates_keep_format_and_coreference(spark):
    text = "Mail a.b7@corp.example.de or A.B7@corp.example.de, call +1 (415) 555-0199, card 4111 1111 1111 1111 / 4111111111111112, ip 10.0.0.255, ssn 123-45-6789, key 0a1b2c3d4e5f60718293a4b5c6d7e8f9. Mrs. Anna Schmidt met Mr. Schmidt and г-жа Анна Петрова."
    got = {r.doc_id: r for r in surrogates.replace_all(clashing(spark, [*ODD, (50, text), (51, text), (52, "again a.b7@corp.example.de only"), (52, "again a.b7@corp.example.de only"), (53, LONG + text)])).collect()}
    new = got[50].text
    assert got[51].text == new and got[53].text == LONG + new and got[50].types == "email,email,phone,card,ipv4,ssn,secret,name,name,name"
    for private in ("a.b7@", "555-0199", "4111 1111 1111 1111", "10.0.0.255", "123-45-6789", "0a1b2c3d", "Anna", "Schmidt", "Петрова"):
        assert private not in new
    m = re.search(r"Mail (\w\.\w\d@\w{4}\.example\.org) or (\S+), call \+1 \(\d{3}\) \d{3}-\d{4}, card (\d{4} \d{4} \d{4} \d{4}) / 4111111111111112, ip (10\.\d+\.\d+\.\d+), ssn \d{3}-\d{2}-\d{4}, key [0-9a-f]{32}\. Mrs\. (\w+) (\w+) met Mr\. (\w+) and г-жа (\w+) (\w+)\.$", new)
    assert m and m[1].lower() == m[2].lower() and m[1] in got[52].text
    assert luhn(m[3]) % 10 == 0 and m[3][:2] == "41"
    assert m[5] in surrogates.GIVEN["given:latin:f"] and m[6] == m[7] and m[8] in surrogates.GIVEN["given:cyrillic:f"] and m[9].endswith("нова")
    for i, t in ODD:
        assert got[i].text == t and got[i].n_entities == 0
    assert surrogates.replace_all(docs(spark, [])).count() == 0


def test_names_are_one_person_throughout(spark):
    texts = [
        (1, "Mr. John Smith called. Smith was angry, and John Smith left. Mrs. Smith and Mr. Smith stayed. Blacksmith, Smith-Jones and smith are others."),
        (2, "Dr. Alan Turing wrote; Turing's paper. Alan slept. Frau Dr. Marie O'Brien-Jones and Herr Ludwig van Beethoven met Prof. Ana Q. Lopez."),
        (3, "κ. Γιώργος Παπαδόπουλος, κα Ελένη Παπαδοπούλου. Παπαδόπουλος"),
        (4, "г-н Иван Петров и г-жа Анна Петрова; Петрова и Петров. г-жа Коваленко"),
        (5, "Smith is not named with a title here."),
        (6, "Miss Smith again"),
    ]
    got = {r.doc_id: r for r in surrogates.replace_all(docs(spark, texts)).collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. (\w+) was angry, and (\w+) (\w+) left\. Mrs\. (\w+) and Mr\. (\w+) stayed\. Blacksmith, Smith-Jones and smith are others\.", got[1].text)
    assert m and m[1] == m[4] != "John" and len({m[2], m[3], m[5], m[6], m[7]}) == 1 and m[2] != "Smith" and m[1] in surrogates.GIVEN["given:latin:m"]
    assert got[6].text == f"Miss {m[2]} again" and got[5].text == texts[4][1] and got[1].n_entities == 5
    m = re.fullmatch(r"Dr\. (\w+) (\w+) wrote; (\w+)'s paper\. (\w+) slept\. Frau Dr\. (\w+) (\w+) and Herr (\w+) van (\w+) met Prof\. (\w+) ([A-Z])\. (\w+)\.", got[2].text)
    assert m and m[2] == m[3] and m[1] == m[4] and m[5] in surrogates.GIVEN["given:latin:f"] and m[7] in surrogates.GIVEN["given:latin:m"] and m[10] != "Q"
    greek = re.fullmatch(r"κ\. (\w+) (\w+ίδης), κα (\w+) (\w+ίδου)\. (\w+)", got[3].text)
    assert greek and greek[2] == greek[5] and greek[1] in surrogates.GIVEN["given:greek:m"] and greek[3] in surrogates.GIVEN["given:greek:f"]
    m = re.fullmatch(r"г-н (\w+) (\w+нов) и г-жа (\w+) (\w+нова); (\w+) и (\w+)\. г-жа (\w+ко)", got[4].text)
    assert m and m[4] == m[5] == m[2] + "а" and m[6] == m[2]


def valid_number(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ssn":
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    if kind == "phone":
        return all(x[0] in "23456789" and x[1:] != "11" for x in (d[-10:-7], d[-7:-4]))
    if kind == "card":
        return luhn(d) % 10 == 0
    moved = v.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1


def test_numbers_stay_valid_and_all_surrogates_are_distinct(spark):
    """Against brute force over a small corpus: every type, both validity and distinctness, no surrogate that occurs, no value of its own."""
    r = random.Random(3)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c) % 10 == 0)

    def iban():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    exists = lambda: next(x for x in iter(lambda: str(r.randrange(200, 1000)), None) if x[1:] != "11")
    made = {
        "ssn": {f"{next(x for x in iter(lambda: r.randrange(1, 900), None) if x != 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}" for _ in range(150)},
        "phone": {f"{exists()}-{exists()}-{digits(4)}" for _ in range(150)},
        "card": {card() for _ in range(100)},
        "iban": {iban() for _ in range(60)},
        "ipv4": {f"192.168.7.{i}" for i in range(120)} | {f"{r.randrange(1, 224)}.{digits(2).lstrip('0') or 1}.{r.randrange(256)}.{r.randrange(256)}" for _ in range(100)},
        "ipv6": {f"fe80::{r.randrange(1, 1 << 16):x}" for _ in range(60)} | {"::1", "1::", "fe80::2"},
        "email": {f"{c}@{d}.de" for c in "abcdefghijklmnopqrstuvwxyz" for d in ("one", "two")},
        "secret": {f"{r.getrandbits(128):032x}a" for _ in range(40)},
        "name": {f"{t} {x}" for t in ("Mr.", "Mrs.") for x in {"".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3)).capitalize() for _ in range(400)}},
    }
    rows_ = [(k, i, v) for k, vs in made.items() for i, v in enumerate(sorted(vs))]
    got = {x.doc_id: x for x in surrogates.replace_all(docs(spark, [(n, v) for n, (_, _, v) in enumerate(rows_)])).collect()}
    new = {}
    for n, (kind, _, v) in enumerate(rows_):
        assert got[n].types == kind and got[n].text != v, (kind, v, got[n])
        new.setdefault(kind, {})[v] = got[n].text
    for kind, table in new.items():
        if kind == "name":
            table = {v.split()[1]: set() for v in table}
            for v, s in new[kind].items():
                table[v.split()[1]].add(s.split()[1])
            assert all(len(x) == 1 for x in table.values())
            table = {v: next(iter(x)) for v, x in table.items()}
        assert len({s.lower() for s in table.values()}) == len(table) and not {s.lower() for s in table.values()} & {v.lower() for v in table}, kind
        if kind in ("ssn", "phone", "card", "iban"):
            assert all(valid_number(kind, v) and valid_number(kind, s) for v, s in table.items()), kind
    assert all(s.startswith("192.168.") for v, s in new["ipv4"].items() if v.startswith("192.168."))


def test_one_number_in_several_formats(spark):
    text = "+1 (415) 555-2671, 415-555-2671, (415) 555-2671, 4111 1111 1111 1111, 4111111111111111, DE89 3704 0044 0532 0130 00, DE89370400440532013000; not: 1234567890123, DE89370400440532013001, 12:30:45, a::b; odd: 123-456-7890 900-12-3456 +44 020 555-1234"
    got = surrogates.replace_all(docs(spark, [(1, text)])).first()
    parts, odd = got.text.split("; ")[0].split(", "), got.text.split("odd: ")[1].split(" ", 2)
    assert len({re.sub("[^0-9]", "", x)[-10:] for x in parts[:3]}) == 1 and len({x.replace(" ", "") for x in parts[3:5]}) == 1 and len({x.replace(" ", "") for x in parts[5:7]}) == 1
    assert "not: 1234567890123, DE89370400440532013001, 12:30:45, a::b;" in got.text
    assert got.types == "phone,phone,phone,card,card,iban,iban,phone,ssn,phone" and odd[0][0] == "1" and odd[1].startswith("900-") and odd[2].startswith("+44 ")


def test_short_addresses_are_replaced(spark):
    """Addresses are found in texts that hold nothing else of note: no three digits in a row, no other entity."""
    texts = [(60, "10.0.0.1"), (61, "at 8.8.8.8 now"), (62, "10.1.2.3 and 1.2.3.4"), (63, "version 1.2.3 of 4.5"), (64, "25.0.99.1.")]
    got = {r.doc_id: r for r in surrogates.replace_all(docs(spark, texts)).collect()}
    assert [(got[i].n_entities, got[i].types) for i, _ in texts] == [(1, "ipv4"), (1, "ipv4"), (2, "ipv4,ipv4"), (0, ""), (1, "ipv4")]
    assert all(got[i].text != t for i, t in texts if i != 63) and got[63].text == texts[3][1]


def test_surrogates_stay_distinct_under_collisions(spark):
    """One letter in the local part has 26 forms: more values must still have surrogates of their own."""
    mails = [f"{c}@{d}.de" for c in "abcdefghijklmnopqrstuvwxyz" for d in ("one", "two")]
    got = {r.doc_id: r.text for r in surrogates.replace_all(docs(spark, list(enumerate(mails)))).collect()}
    assert len(set(got.values())) == len(mails) and not set(got.values()) & set(mails)


def test_digit_permutation_is_one(spark):
    from pyspark.sql import functions as F

    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(surrogates.permuted_digits("k", F.lit("t"), F.col("d")).alias("x")).distinct().count() == 1000
