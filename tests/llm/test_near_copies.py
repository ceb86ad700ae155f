"""The near-copy stage of the pipeline against all pairs."""

import random

import corpus_pipeline
from palimpsest.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = set(near_copies.shingles(a).tolist()), set(near_copies.shingles(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_edited_copies_go(spark, tmp_path):
    """Copies with words replaced, which differ from the original in more than two bits of a fingerprint, and chains of them."""
    r = random.Random(5)
    text = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    texts = {}
    for i in range(60):
        words = text(200)
        texts[i] = " ".join(words)
        for k in range(1, 4):  # each an edit of the one before
            for at in r.sample(range(200), 1 + i % 5):
                words[at] = f"x{r.randrange(5000)}"
            texts[100 * k + i] = " ".join(words)
    shared = " ".join(text(100))  # a passage in common is no copy
    texts |= {1000 + i: shared + " " + " ".join(text(100)) for i in range(20)}
    texts |= {2000: None, 2001: " ", 2002: "two words", 2003: "Two  words", 2004: "two other"}
    ids = sorted(texts)
    root = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if jaccard(texts[i], texts[j]) >= 0.8:
                old, new = sorted((root[i], root[j]))[::-1]
                root = {k: new if v == old else v for k, v in root.items()}
    far = [i for i in range(60) if (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[100 + i])).bit_count() > 2 and jaccard(texts[i], texts[100 + i]) >= 0.8]
    assert len(far) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts.items()], DOCS)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(root.values()))
