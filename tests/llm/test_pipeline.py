"""The pipeline on small tables, stage by stage against plain Python."""

import random

import corpus_pipeline


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_pipeline(spark, tmp_path):
    r = random.Random(1)
    vocabulary = [a + b + c for a in "bcdfghkl" for b in "aeiou" for c in "nrst"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs = [(i, text(60) + ".") for i in range(300)]
    toxic = {i for i in range(0, 300, 6)}
    docs = [(i, t + " vile nasty" if i in toxic else t) for i, t in docs]
    bench = [(1, text(12)), (2, text(30))]
    docs += [(400, docs[1][1]), (401, docs[1][1]), (500, f"{text(20)} {bench[0][1]} {text(20)}"), (501, None)]
    folder = str(tmp_path)
    write(spark, folder, "documents", [(i, t, "en", "s", None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, folder, "labels", [(i, 1, int(i in toxic)) for i in range(200)], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", bench, "item_id long, text string")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    ids = lambda df: sorted(x.doc_id for x in df.collect())
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = ids(kept)
    clean = [i for i, _ in docs if i not in toxic]
    assert after["toxicity"] == clean
    assert after["simhash_dedup"] == [i for i in clean if i not in (400, 401)]
    assert after["decontamination"] == [i for i in after["simhash_dedup"] if i != 500]
    assert set(after["mixing"]) == set(after["decontamination"])
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted(x.doc_id for x in out) == after["mixing"]
    assert sorted(x.start for x in out)[0] == 0 and max(x.start + x.n_tokens for x in out) == sum(x.n_tokens for x in out)
