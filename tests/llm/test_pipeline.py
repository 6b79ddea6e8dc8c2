"""The stages against plain versions, each on what the one before kept."""

import random

import corpus_pipeline

from . import brute
from .test_decontaminate import brute as leaks


def tables(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("thenaroisl") for _ in range(rng.randrange(2, 8))) + str(rng.randrange(999))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 120))) for _ in range(150)]
    toxic = [i for i in range(150) if i % 6 == 0]
    for i in toxic:
        w = texts[i].split()
        for _ in range(6):
            w[rng.randrange(len(w))] = rng.choice(["vilorak", "grumbat"])
        texts[i] = " ".join(w)
    item = " ".join(word() for _ in range(15))
    passage = " ".join(word() for _ in range(60))
    for i in (1, 7, 13):
        texts[i] += " " + item
    for i in (25, 31, 37):
        texts[i] = texts[i] + " " + passage + " " + word()
    texts += [texts[2], texts[2] + " tail", texts[3]]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return toxic, item


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    toxic, item = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        kept[name] = got = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert len(set(got) & set(toxic)) <= 1 and len(set(range(150)) - set(toxic) - set(got)) <= 2
        if name == "near_duplicates":
            assert set(got) == {r[0] for r in brute.near_duplicates(rows) if r[3]}
        if name == "passages":
            assert set(got) == {i for i, _ in rows} and {i for i, t in rows if got[i] != t} == {31, 37} & set(got)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        if name == "decontamination":
            assert set(got) == {r[0] for r in leaks(rows, [(1, item)]) if not r[5]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(kept["decontamination"])
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, folder).collect()} == {tuple(r)[:5] for r in packed.collect()}
