"""Counts made where the rows are read, against the plain way, and their plans."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import aggregates, metrics, terms

TEXTS = ["The cat-sat on THE mat, ab a1_ İstanbul Kelvin naïve", "the the the", "", None, "on mat\u0000mat x", "9abc -def _x y-"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(TEXTS * 2)], "id long, c int, text string")


def test_rouge_is_counted_where_it_is_read(spark, rows):
    both = rows.select("id", F.col("text").alias("summary"), F.reverse(F.array_join(F.array_repeat("text", 2), " ")).alias("reference"))
    both = both.union(spark.createDataFrame([(50, "a b a b", "a b b a b"), (51, "a", None), (52, None, None)], "id long, summary string, reference string"))
    for n in (1, 2):
        got = metrics.rouge_n(both, n)
        assert "Generate explode" not in _plan(got) and "Aggregate" not in _plan(got)
        assert Counter(metrics._rouge_rows(both, n).collect()) == Counter(metrics._rouge_groups(both, n).select("id", "hit", "s", "r").collect())
    twice = spark.createDataFrame([(1, "a b", "a c"), (1, "c", "b")], "id long, summary string, reference string")
    assert [tuple(r) for r in metrics.rouge_n(twice, 1).collect()] == [(1, 1.0, 1.0, 1.0)]


def test_counts_of_texts(spark, rows):
    tokens = rows.select("id", "c", text.tokens(F.col("text")).alias("t"))
    for by in ("id", "c"):
        want = Counter(terms.counts(tokens, by, "t").collect())
        assert Counter(terms.text_counts(rows, [by], "text").collect()) == want and want
        pairs = tokens.select(by, terms.bigrams(F.col("t")).alias("t"))
        assert Counter(terms.text_counts(rows, [by], "text", 2).collect()) == Counter(terms.counts(pairs, by, "t").collect())
    once = tokens.select("c", F.array_distinct("t").alias("t"))
    assert Counter(terms.text_counts(rows, ["c"], "text", repeats=False).collect()) == Counter(terms.counts(once, "c", "t").collect())
    assert "Aggregate" not in _plan(terms.text_counts(rows, ["id"], "text"))  # each document is one row


@pytest.mark.parametrize("many", [0, 2, 500_000])
def test_weights_by_frequent_and_rare_terms(spark, rows, many, monkeypatch):
    monkeypatch.setattr(terms, "MANY", many)
    count = terms.counts(rows.select("id", text.tokens(F.col("text")).alias("t")), "id", "t")
    want = Counter(terms.tf_idf(count, "id").collect())
    assert Counter(terms.text_tf_idf(rows, "id", "text").collect()) == want and want
    twice = rows.withColumn("id", F.col("id") % 3)  # documents of several rows
    count = terms.counts(twice.select("id", text.tokens(F.col("text")).alias("t")), "id", "t")
    assert Counter(terms.text_tf_idf(twice, "id", "text").collect()) == Counter(terms.tf_idf(count, "id").collect())
    assert "Window" in _plan(terms.text_tf_idf(rows, "id", "text")) and "Generate explode" not in _plan(terms.text_tf_idf(rows, "id", "text"))


def test_association_from_counts(spark, rows):
    d = rows.where(F.col("text").rlike("[A-Za-z]"))
    long = d.select("id", "c", F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("term"))
    both = terms.text_counts(d, ["c"], "text", word="[A-Za-z]+", repeats=False)
    got = aggregates.pmi_of_counts(both, d.groupBy("c").agg(F.count(F.lit(1)).alias("fdf")), "term", "c", 1, 0.0)
    want = Counter(aggregates.pmi(long, "id", "term", "c", 1, 0.0).collect())
    assert Counter(got.collect()) == want and want


def test_keyphrases_of_texts(spark, rows):
    want = Counter(terms.keyphrases(rows.select("id", text.tokens(F.col("text")).alias("t")), "id", "t").collect())
    got = terms.text_keyphrases(rows, "id", "text")
    assert Counter(got.collect()) == want and want
    assert "Generate explode" not in _plan(got)
