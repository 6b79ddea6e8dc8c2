"""Literal cases with answers worked out by hand, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import lexicon, text
from corpusloom.functions import vectors as vx
from corpusloom.operators import aggregates, clustering, clusters, features, filters, joins, loops, metrics, ranking
from corpusloom.operators import vectors as vo
from corpusloom.sources import readers


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a [MATH_tex=x[1]] b", "a [MATH]] b"), ("none", "none")],
)
def test_math_mask(spark, raw, want):
    assert one(spark, text.mask_math_tags(F.col("t")), t=raw) == want


def test_tail_after_bracket(spark):
    assert one(spark, text.classifier_input(F.col("s"), F.col("t")), s="S", t="we [12] used it") == "S -  used it"


def test_clean(spark):
    assert one(spark, text.clean(F.col("t")), t="$x$ see (Smith 2019) http://u Figure") == "see <CIT> Figure"
    assert one(spark, text.clean(F.col("t")), t="Figure 3 text\nbody") == "body"
    assert one(spark, text.clean(F.col("t")), t="(NGC 1234) x") == "<CIT> x"
    assert spark.range(1).select(text.clean(F.lit(None).cast("string"))).first()[0] == ""


def test_paragraph_ids_count_survivors(spark):
    rows = spark.createDataFrame([("p", "x" * 200 + "\nshort\n" + "y" * 200)], "paper_id string, text string")
    assert [r.para_id for r in filters.method_paragraphs(rows).collect()] == ["p::p0000", "p::p0001"]


def test_heading_is_a_substring(spark):
    rows = spark.createDataFrame([("Our Methodology", "x"), ("Results", "Data were collected."), ("Results", "nothing"), (None, "we derived it")], "h string, t string")
    got = [r[0] for r in rows.select(filters.heuristic_label(F.col("h"), F.col("t"))).collect()]
    assert got == ["methodology", "methodology", "not_methodology", "methodology"]


def test_noise_cases(spark):
    rows = spark.createDataFrame([(1, "a", -1), (2, "a", -1), (3, "b", -1), (4, "b", 0), (5, "b", 0)], "para_id long, paper_id string, cluster int")
    got = {r.paper_id: r for r in clusters.profile(rows).collect()}
    assert got["a"].noise_ratio == 1.0 and got["a"].isolate and not got["b"].isolate
    with_, without = ({r.paper_id: r.cluster_0 for r in aggregates.bag_of_clusters(rows, [-1, 0], exclude_noise=e).collect()} for e in (False, True))
    assert with_["b"] == pytest.approx(0.666667) and without["b"] == 1.0 and without["a"] == 0.0
    assert {(r.paper_id, r.isolates) for r in aggregates.isolates(rows).withColumn("paper_id", F.lit("all")).collect()} == {("all", 1)}


def test_mixture_sums_to_one_and_ties_go_to_the_lower_cluster(spark):
    rows = spark.createDataFrame([(1, 5), (1, 3), (2, 1), (2, 1), (2, 2)], "paper_id long, cluster int")
    mix = aggregates.mixture(rows)
    assert all(abs(r[1] - 1) < 1e-5 for r in mix.groupBy("paper_id").agg(F.sum("prop")).collect())
    assert {r.paper_id: r.cluster for r in ranking.dominant(mix).collect()} == {1: 3, 2: 1}


def test_kv_and_pairs(spark):
    a, b = (spark.createDataFrame([("k", v), (v, v)], "key string, value string") for v in ("x", "y"))
    assert {r.key: r.value for r in joins.kv_merge([a, b]).collect()} == {"k": "y", "x": "x", "y": "y"}
    assert {r.key: r.value for r in joins.kv_merge([a, b], last=False).collect()} == {"k": "x", "x": "x", "y": "y"}
    assert one(spark, joins.unordered_key("a", "b"), a="p", b="q") == one(spark, joins.unordered_key("a", "b"), a="q", b="p")


def test_identical_labelings(spark):
    rows = spark.createDataFrame([(i % 3, i % 3, 0) for i in range(12)], "a int, b int, c int")
    assert set(metrics.agreement(rows, "a", "b").first()) == {1.0}
    assert metrics.adjusted_mutual_information(rows, "a", "b").first()[0] == 1.0
    assert metrics.agreement(rows, "a", "c").first().ari == 0.0
    assert metrics.agreement(rows, "a", "c").first().nmi == metrics.agreement(rows, "c", "a").first().nmi


def test_log_factorials():
    n = np.array([0, 1, 5, 31, 32, 33, 1000, 10**9])
    assert np.allclose(metrics._log_factorial(n), [math.lgamma(int(i) + 1) for i in n], rtol=1e-14, atol=1e-14)


def test_bootstrap_does_not_follow_the_partitions(spark):
    rows = spark.createDataFrame([(i, float(i * i % 17)) for i in range(200)] + [(None, 3.0), (5, None)], "id long, v double")
    answers = {tuple(metrics.bootstrap_ci(rows.repartition(n), "id", "v", rounds=50).first()) for n in (1, 4)}
    assert len(answers) == 1
    lo, hi = answers.pop()
    assert lo < 7.8 < hi


def test_splits_and_samples_keep_null_labels(spark):
    rows = spark.createDataFrame([(i, None if i < 10 else "a" if i < 40 else "b") for i in range(100)], "id long, label string")
    sample = {tuple(r) for r in ranking.balanced_sample(rows, "label", "id").groupBy("label").count().collect()}
    assert sample == {(None, 10), ("a", 10), ("b", 10)}
    split = {tuple(r) for r in ranking.stratified_split(rows, "label", "id").where("split = 'train'").groupBy("label").count().collect()}
    assert split == {(None, 8), ("a", 24), ("b", 48)}


def test_quality_range_of_few_rows(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.7)], "id long, q double")
    assert {(r.id, r.part) for r in ranking.quality_range(rows, "id", "q", 9).collect()} == {(1, "best"), (3, "best")}


def test_zero_vectors_and_single_clusters(spark):
    assert one(spark, vx.l2_normalise(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0])], "id long, cluster int, v array<double>")
    assert metrics.silhouette(rows).first()[0] is None
    assert metrics.calinski_harabasz(rows).first()[0] is None


def test_confidence_rules(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate([0.95, 0.96, 0.97, 0.99])], "doc_id long, confidence double")
    assert filters.confident(rows, 0.95).count() == 3
    assert filters.confident(rows, 0.95, least=5).count() == 0
    assert [r.doc_id for r in filters.confident(rows, 0.9, least=1, most=2).collect()] == [3, 2]


def test_weighted_mean(spark):
    rows = spark.createDataFrame([(1.0, None), (3.0, None)], "v double, w double")
    assert rows.agg(aggregates.weighted_mean(F.col("v"), F.col("w"))).first()[0] is None


def test_equal_values_make_fewer_bins(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 9 else 2.0) for i in range(10)], "id long, s double")
    assert 1 <= ranking.one_of_each_bin(rows, "id", "s").count() < 5


def test_splits_are_disjoint(spark):
    s = ranking.hash_split(spark.range(500), "id")
    assert s.count() == 500 and s.select("id").distinct().count() == 500
    assert {r[0] for r in s.select("split").distinct().collect()} == {"train", "dev", "test"}


def test_lexicon_counts(spark):
    lex = {"f": ["ab", "b"], "g": ["zz"]}
    assert one(spark, lexicon.match_scores(F.col("t"), lex), t="ab ab") == {"f": 2}
    assert one(spark, lexicon.match_scores(F.col("t"), lex, fused=False), t="ab ab") == {"f": 4}
    assert one(spark, lexicon.first_family(F.col("t"), lex), t="q") is None


def test_latex(spark):
    assert one(spark, text.escape_latex(F.col("t")), t="a\\b & 5%_") == "a\\textbackslash b \\& 5\\%\\_"


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.05, (40, 2)) for c in (0, 3, 6)] + [rng.uniform(-2, 8, (8, 2))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    truth = spark.createDataFrame([(i, i // 40) for i in range(120)], "id long, truth int")
    for found in (clustering.hdbscan(rows, 10), clustering.dbscan(rows, 0.3, 5), clustering.k_means(rows.where("id < 120"), 3, (1, 2, 3))[0]):
        assert metrics.agreement(found.join(truth, "id"), "cluster", "truth").first().ari > 0.95
    merged = clustering.merge_clusters(rows.where("id < 120"), spark.createDataFrame([(i, i // 20) for i in range(120)], "id long, cluster int"), 3)
    assert metrics.agreement(merged.join(truth, "id"), "cluster", "truth").first().ari == 1.0


def test_decompositions(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 6)) + 5
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = np.array([r.v for r in features.pca(rows, 3).orderBy("id").collect()])
    c = x - x.mean(0)
    want = np.linalg.svd(c, full_matrices=False)[1] ** 2
    assert np.allclose((got**2).sum(0), want[:3], rtol=1e-6)
    got = np.array([r.v for r in features.svd(rows, 2).orderBy("id").collect()])
    assert np.allclose((got**2).sum(0), np.linalg.svd(x, compute_uv=False)[:2] ** 2, rtol=1e-6)
    spec = {r.threshold: r.components for r in features.spectrum(rows).collect()}
    assert spec[0.99] <= 3


def test_margin_and_pair_mean(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 4))
    rows = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, cluster int, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in vo.quality(rows).collect():
        k = u[r.cluster :: 3]
        s = k @ k.T
        assert r.mean_pair_cosine == pytest.approx((s.sum() - len(k)) / (len(k) * (len(k) - 1)), abs=2e-6)
        assert r.margin == pytest.approx(r.mean_to_centroid - r.nearest_other_centroid, abs=2e-6)


def test_xml(spark):
    words = " ".join(["w"] * 30)
    xml = f"<d><section><title>Intro</title><para><p>{words} <Math tex='\\a{{b}}'>z</Math> t</p><p>more</p></para><section><para><p>{words}</p></para><para><p>few</p></para></section></section></d>"
    got = readers.paper_paragraphs("p", xml.encode())
    assert [(g[1], g[2], g[3]) for g in got] == [("Intro", 0, 0), ("", 1, 0)]
    assert "[MATH_tex=ab] t more" in got[0][4] and " z " not in got[0][4]
    assert readers.paper_paragraphs("p", b"<d><section>") == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int", strict=True).collect()
    (tmp_path / "m.json").write_text('{"p1": "x/1.xml"}')
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.json")).collect()] == [("p1", "x/1.xml")]
    np.save(tmp_path / "x.npy", np.arange(6).reshape(3, 2))
    assert [r.v for r in readers.matrix(spark, str(tmp_path)).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    (tmp_path / "l.csv").write_text("id,label\na,1\nb,-1\n")
    assert {r.id: r.label for r in readers.labels(spark, str(tmp_path / "l.csv")).collect()} == {"a": 1, "b": -1}
    (tmp_path / "l.json").write_text('{"labels": {"a": 3}}')
    assert {r.id: r.label for r in readers.labels(spark, str(tmp_path / "l.json")).collect()} == {"a": 3}
    with pytest.raises(ValueError):
        readers.csv_table(spark, str(tmp_path / "l.csv"), "id string", ["nope"])
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.q.txt").write_text("hello")
    assert [tuple(r) for r in readers.text_folder(spark, str(tmp_path / "t")).collect()] == [("p.q", "hello")]


def test_streaming(spark, tmp_path):
    from corpusloom.streaming.paragraphs import label_new_files

    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), "section string, paragraph string", str(tmp_path / "out"), str(tmp_path / "cp"))
    (tmp_path / "in" / "1.json").write_text('{"section": "Method", "paragraph": "x"}\n')
    label_new_files(*args)
    (tmp_path / "in" / "2.json").write_text('{"section": "End", "paragraph": "x"}\n')
    label_new_files(*args)
    got = sorted((r.section, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("End", "not_methodology"), ("Method", "methodology")]


def test_rouge_l(spark):
    rows = spark.createDataFrame([(1, "a b c d", "a x c d"), (2, "", "a")], "id long, summary string, reference string")
    assert {r.id: r.f1 for r in metrics.rouge_l(rows).collect()} == {1: 0.75, 2: 0.0}


def test_votes_and_knees():
    assert clustering.vote([3, 3, 5]) == 3 and clustering.vote([]) == 8 and clustering.vote([2, 4, 9]) == 4
    assert clustering.knee([1, 2, 3, 4, 5], [100, 20, 15, 12, 10]) == 2


def test_predictions(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 2.0],)], "logits array<double>")
    r = loops.predictions(rows).first()
    assert r.predicted == 1 and r.confidence == pytest.approx(math.exp(3) / (math.e + math.exp(3) + math.exp(2)))


def test_assignment_is_the_best():
    from itertools import permutations

    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 3), (4, 6), (5, 5)):
        cost = rng.integers(-9, 9, (n, m)).astype(float)
        got = metrics.assignment(cost)
        assert len(set(got)) == n
        assert sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))


def test_ranks_over_whole_tables(spark):
    values = [5, 1, 1, 3, 3, 3, 9, 7] * 40
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v int").repartition(5)
    ranks = {r.value: (r.n, r.rank) for r in ranking.value_ranks(rows, "v").collect()}
    for v in set(values):
        assert ranks[v] == (values.count(v), sum(x < v for x in values) + (values.count(v) + 1) / 2)
    assert sorted((r.at, r.id) for r in ranking.row_numbers(rows, "id", "at").collect()) == [(i + 1, i) for i in range(320)]
    assert ranking.row_numbers(rows.limit(0), "id", "at").count() == 0
