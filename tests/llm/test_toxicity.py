import random
import zlib

import numpy as np
import pyarrow as pa

from corpusloom.llm import toxicity


def corpus(n=900):
    """Texts of invented words; a third has insults, some disguised."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("thenaroisl") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        w, bad = [word() for _ in range(rng.randrange(20, 80))], i % 3 == 0
        if bad:
            for _ in range(rng.randrange(3, 7)):
                w[rng.randrange(len(w))] = rng.choice(["vilorak", "grumbat", "snorfel", "vil0rak"])
            w.insert(0, "You")
        rows.append((i, " ".join(w), int(bad)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t, _ in rows], "doc_id long, text string, lang string, score int").repartition(3)
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    extra = spark.createDataFrame([(5000, None, "x", 1), (5001, "", "x", 1), (None, "vilorak", "x", 1), (0, rows[0][1], "x", 1)], docs.schema)
    got = toxicity.score(docs.union(extra), labels).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    assert abs(kept.count() - 600) < 20


def test_real_tables(spark):
    folder = "/root/testdata/sf0.01"
    got = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in got.collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_no_labels_and_no_rows(spark):
    docs, labels = tables(spark, corpus(30))
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    one = toxicity.score(docs, labels.withColumn("toxic", labels.toxic * 0)).collect()
    assert {r.score for r in one} == {0.0}
    assert toxicity.score(docs.limit(0), labels).collect() == []


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in corpus(60)] + ["", None, "A!!!", "l0ser l.o.s.e.r looooser", "É" * 50]
    lex = toxicity._lexicon(toxicity._hashes(["vilorak", "loser"]), np.array([50, 50]), np.array([0, 0]), 100, 100)
    whole = toxicity.features(pa.array(texts, pa.string()), lex, lex)
    alone = np.concatenate([toxicity.features(pa.array([t], pa.string()), lex, lex) for t in texts])
    assert np.allclose(whole, alone)
    assert whole[-2, toxicity.FEATURES.index("disguised")] == 2


def test_isotonic():
    x, v = toxicity.isotonic(np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0]), np.ones(6))
    assert (np.diff(v) >= 0).all() and v[0] == 0 and v[-1] == 1 and abs(np.interp(2, x, v) - 1 / 3) < 1e-9
