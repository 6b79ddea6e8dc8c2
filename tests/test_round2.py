"""Cases of the second round of findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import clustering, joins, metrics
from corpusloom.operators import vectors as vo


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_label_of_an_empty_text(spark):
    rows = spark.createDataFrame([(0, "", 0), (1, None, None), (-1, None, None), (2, "a b c d", 7)], "c long, t string, n int")
    got = [r[0] for r in rows.select(text.cluster_label(F.col("c"), F.split("t", " "), F.col("n"))).collect()]
    assert got == ["0__n=0", None, "-1_Noise", "2_a_b_c_n=7"]


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_co_association_by_classes(spark, least):
    rng = np.random.default_rng(1)
    runs = [[(i, int(c)) for i, c in enumerate(rng.integers(0, 3, 40)) if c + k != 2] for k in range(3)]
    tables = [spark.createDataFrame(r, "id long, cluster int") for r in runs]
    want = {(a, b): n for a in range(40) for b in range(a + 1, 40) if (n := sum(dict(r).get(a, -1) == dict(r).get(b, -2) for r in runs)) and n / 3 >= least}
    df = clustering.co_association(tables, least, 4)
    got = df.collect()
    assert {(r.a, r.b): r.share for r in got} == {k: pytest.approx(n / 3) for k, n in want.items()} and len(got) == len(want)
    assert "Aggregate" not in _plan(df).split("Generate explode")[0]  # pairs are written out, not counted


def test_median_of_many_and_of_equal_values(spark):
    for x in ([3.0], [1.0, 2.0], [5.0] * 9, list(np.random.default_rng(2).normal(size=501)), [0.0] * 7 + [1.0, 2.0]):
        assert vo.median(spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double"), "x").first()[0] == pytest.approx(np.median(x))


def test_diversity_has_no_exact_percentile_and_no_global_window(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(40)], "id long, v array<double>")
    plan = _plan(vo.diversity(rows, 3))
    assert "percentile(d" not in plan and "row_number() windowspecdefinition(id" not in plan


def test_draws_are_dealt_before_they_are_made(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 4.0)], "k long, v double")
    plan = _plan(metrics.bootstrap_ci(rows, "k", "v", 10))
    assert "RepartitionByExpression" in plan.split("Generate explode")[1]


def test_fragments_search_a_word_once(spark):
    rows = spark.createDataFrame([("the the cat sat the", "THE catalogue"), ("", "x"), ("a", None)], "s string, t string")
    coverage, density = text.extractive_fragments(F.col("s"), F.col("t"))
    df = rows.select(F.round(coverage, 6).alias("c"), F.round(density, 6).alias("d"))
    assert (df.first().c, df.first().d) == (0.8, 2.0)
    assert "array_distinct" in _plan(df)


def test_steps_of_a_fuzzy_join_change_nothing(spark, monkeypatch):
    left = spark.createDataFrame([(1, "abcdefghij" * 3), (2, "zz"), (3, "abcdefghix" * 3), (4, "")], "id long, text string")
    right = spark.createDataFrame([(9, "abcdefghij" * 3), (5, "abcdefghxx" * 3), (7, "abcdefghij" * 3), (6, "zy")], "other long, other_text string")
    met = lambda: {r.id: (r.other, r.ratio) for r in joins.fuzzy(left, right, 0.8).collect()}
    stepped = met()
    monkeypatch.setattr(joins, "STEPS", ())
    assert stepped == met() == {1: (7, 1.0), 3: (5, 0.9)}
