"""Aggregations over paragraphs, clusters and ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered_concat(rows: DataFrame, by: str, order: Sequence[str], text: str) -> DataFrame:
    """Texts of a group in order, joined by spaces."""
    item = F.struct(*order, F.col(text).alias("__t"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["__t"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))


def crosstab(rows: DataFrame, by: str, column: str, values: Sequence) -> DataFrame:
    """A count column for each value; the values are given, so no extra pass finds them."""
    return rows.groupBy(by).pivot(column, list(values)).count().na.fill(0)


def isolates(assigned: DataFrame) -> DataFrame:
    """Papers whose paragraphs are all noise: their number, all papers, and the percentage."""
    per = assigned.groupBy("paper_id").agg(F.bool_and(F.col("cluster") == -1).alias("alone"))
    return per.agg(F.count_if("alone").alias("isolates"), F.count(F.lit(1)).alias("papers"), F.round(100 * F.count_if("alone") / F.count(F.lit(1)), 6).alias("percent"))


def bag_of_clusters(assigned: DataFrame, clusters: Sequence[int], exclude_noise: bool = False, normalise: bool = True) -> DataFrame:
    """Wide bag: per paper the share of each cluster in its paragraphs; with exclude_noise in those that are not noise
    (1 at least)."""
    noise = F.count_if(F.col("cluster") == -1)
    total = F.count(F.lit(1))
    base = F.greatest(total - noise, F.lit(1)) if exclude_noise else total if normalise else F.lit(1)
    return assigned.groupBy("paper_id").agg(
        total.alias("total_paragraphs"),
        noise.alias("noise_paragraphs"),
        F.round(noise / total, 6).alias("noise_ratio"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("unique_clusters"),
        (total - noise).alias("non_noise_paragraphs"),
        *[F.round(F.count_if(F.col("cluster") == c) / base, 6).alias(f"cluster_{c}") for c in clusters if not (exclude_noise and c == -1)],
    )


def noise_thresholds(profiles: DataFrame, thresholds: Sequence[float] = (0.5, 0.7, 0.8, 0.9, 1.0)) -> DataFrame:
    """Papers with at least so much noise, their percentage, and mean, median and deviation of the ratio."""
    t = profiles.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    met = profiles.crossJoin(F.broadcast(t))  # a handful of constants
    stats = [F.round(f("noise_ratio"), 6).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))]
    return met.groupBy("threshold").agg(F.count_if(F.col("noise_ratio") >= F.col("threshold")).alias("n"), F.round(100 * F.avg((F.col("noise_ratio") >= F.col("threshold")).cast("double")), 6).alias("percent"), *stats)


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """Points, clusters, noise, its percentage, and mean, median, least and greatest cluster size."""
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("cluster") != -1, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("cluster") == -1, F.col("n"))), F.lit(0))
    return sizes.agg(F.sum("n").alias("n_points"), F.count(own).alias("n_clusters"), noise.alias("n_noise"), F.round(100 * noise / F.sum("n"), 6).alias("noise_percent"), F.round(F.avg(own), 6).alias("mean_size"), F.median(own).alias("median_size"), F.min(own).alias("min_size"), F.max(own).alias("max_size"))


def cluster_characteristics(rows: DataFrame) -> DataFrame:
    """Per cluster (cluster, paper_id, text): size, papers, mean and deviation of the length, and paragraphs per paper."""
    per = rows.groupBy("cluster", "paper_id").agg(F.count(F.lit(1)).alias("k"), F.sum(F.length("text")).alias("l"), F.sum(F.length("text") * F.length("text").cast("double")).alias("q"))
    size, mean = F.sum("k"), F.sum("l") / F.sum("k")
    return per.groupBy("cluster").agg(
        size.alias("size"),
        F.count(F.lit(1)).alias("papers"),
        F.round(mean, 4).alias("mean_length"),
        F.round(F.sqrt(F.greatest(F.sum("q") / size - mean * mean, F.lit(0.0))), 4).alias("std_length"),
        F.round(F.avg("k"), 6).alias("mean_per_paper"),
        F.max("k").alias("max_per_paper"),
        F.min("k").alias("min_per_paper"),
        F.round(size / F.count(F.lit(1)), 2).alias("papers_per_para"),
    )


def mixture(assigned: DataFrame) -> DataFrame:
    """Long form: paper, cluster, count and its share of the paper."""
    counts = assigned.groupBy("paper_id", "cluster").agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("prop", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("paper_id")), 6))


def weighted_mean(value, weight):
    """Null weights count as 0; null where they sum to 0."""
    w = F.coalesce(weight, F.lit(0))
    return F.sum(value * w) / F.nullif(F.sum(F.when(value.isNotNull(), w)), F.lit(0))


def ratings_by_cluster(ratings: DataFrame) -> DataFrame:
    """Per method, K and cluster: count, mean, median, deviation of the ratings, and the size."""
    return ratings.groupBy("method", "K", "cluster_id").agg(
        F.count("rating").alias("n"), F.avg("rating").alias("rating_mean"), F.median("rating").alias("rating_median"), F.stddev_samp("rating").alias("rating_std"), F.min("cluster_size").alias("cluster_size")
    )


def rating_summary(by_cluster: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per method and K: spread of the mean ratings, shares of low (2 and less) and high (4 and more), the mean weighted by
    size, and which part of the clusters and points (method, K, cluster_id, n) is rated."""
    r = F.col("rating_mean")
    q = lambda p: F.percentile(r, p)
    rated = by_cluster.groupBy("method", "K").agg(
        F.count(F.lit(1)).alias("n_clusters_rated"), F.round(F.avg(r), 6).alias("mean_rating"), F.round(F.median(r), 6).alias("median_rating"), F.round(F.stddev_samp(r), 6).alias("std_rating"),
        F.round(q(0.75) - q(0.25), 6).alias("iqr_rating"), F.round(F.avg((r <= 2).cast("double")), 6).alias("frac_low"), F.round(F.avg((r >= 4).cast("double")), 6).alias("frac_high"),
        F.median("cluster_size").alias("median_cluster_size"), F.round(weighted_mean(r, F.col("cluster_size")), 6).alias("size_weighted_mean"),
    )
    there = sizes.join(by_cluster.select("method", "K", "cluster_id", F.lit(1).alias("hit")), ["method", "K", "cluster_id"], "left")
    cover = there.groupBy("method", "K").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("coverage_clusters"), F.round(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("coverage_points"), F.count(F.lit(1)).alias("total_clusters"))
    return rated.join(cover, ["method", "K"], "left")


def size_balance(assigned: DataFrame) -> DataFrame:
    """Mean, median, deviation (population), variation, entropy in nats, greatest share and quartiles of cluster sizes,
    without noise."""
    sizes = assigned.where("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    q = lambda p: F.percentile("n", p)
    return sizes.agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_points"), F.round(F.avg("n"), 6).alias("mean_size"), F.round(F.stddev_pop("n"), 6).alias("std_size"), F.round(F.var_pop("n"), 6).alias("var_size"),
        F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.round(F.stddev_pop("n") / F.avg("n"), 6).alias("variation"), F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"),
        F.round(F.max("p"), 6).alias("largest_share"), q(0.25).alias("q25"), q(0.5).alias("median_size"), q(0.75).alias("q75"),
    )


def label_papers(rows: DataFrame, most: int = 5) -> DataFrame:
    """Per label: distinct papers, and the first ids."""
    distinct = rows.select("label", "paper_id").distinct()
    ranked = distinct.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("paper_id")))
    return ranked.groupBy("label").agg(F.count(F.lit(1)).alias("papers"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("rn") <= most, F.col("paper_id")))).cast("array<string>"), ",").alias("first_ids"))


def metric_averages(rows: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means of the metrics over rows without an error, and the counts of both kinds."""
    ok = F.col("evaluation_error").isNull()
    return rows.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("failed"), *[F.round(F.avg(F.when(ok, F.col(m))), 6).alias(f"mean_{m}") for m in metrics])


def describe_by(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, median, least, greatest and number of a value by group."""
    return rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.round(F.median(value), 6).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))


def per_paper(rows: DataFrame) -> DataFrame:
    """Paragraphs, and mean, greatest and least number per paper."""
    per = rows.groupBy("paper_id").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.sum("k").alias("total"), F.round(F.avg("k"), 6).alias("mean"), F.max("k").alias("max"), F.min("k").alias("min"))


def category_purity(rows: DataFrame, category: str, cluster: str) -> DataFrame:
    """Per category: its dominant cluster (ties to the smaller), purity, coverage and the clusters it spans. Swap the
    columns for the view by cluster."""
    table = rows.groupBy(category, cluster).agg(F.count(F.lit(1)).alias("n"))
    table = table.withColumns({"total": F.sum("n").over(Window.partitionBy(category)), "of_cluster": F.sum("n").over(Window.partitionBy(cluster))})
    ranked = table.withColumns({"rn": F.row_number().over(Window.partitionBy(category).orderBy(F.col("n").desc(), cluster)), "spans": F.count(F.lit(1)).over(Window.partitionBy(category))})
    return ranked.where("rn = 1").select(category, F.col(cluster).alias("dominant"), "total", F.col("n").alias("dominant_count"), F.round(F.col("n") / F.col("total"), 6).alias("purity"), F.round(F.col("n") / F.col("of_cluster"), 6).alias("coverage"), "spans")


def best_experiments(rows: DataFrame, higher: Sequence[str], lower: Sequence[str]) -> DataFrame:
    """For each metric the experiment of the greatest (or least) value; ties to the smaller name."""
    long = rows.select("name", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) if m in higher else -F.col(m)).cast("double").alias("v")) for m in (*higher, *lower)])).alias("x")).select("name", "x.metric", "x.v").where("v IS NOT NULL")
    ranked = long.withColumn("rn", F.row_number().over(Window.partitionBy("metric").orderBy(F.col("v").desc(), "name")))
    return ranked.where("rn = 1").select("metric", "name", F.round(F.abs("v"), 6).alias("value"))


def pmi(rows: DataFrame, doc: str, term: str, family: str, least_df: int = 2, least: float = 0.0) -> DataFrame:
    """term, family, df, co, pmi (base 2) over documents: rows hold a document's terms and families."""
    n = rows.select(doc).distinct().agg(F.count(F.lit(1)).alias("total"))
    terms = rows.select(doc, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least_df)
    fams = rows.select(doc, family).distinct().groupBy(family).agg(F.count(F.lit(1)).alias("fdf"))
    both = rows.select(doc, term, family).distinct().groupBy(term, family).agg(F.count(F.lit(1)).alias("co"))
    return _pmi(both.join(terms, term).join(fams, family).join(F.broadcast(n)), term, family, least)


def pmi_of_counts(both: DataFrame, fams: DataFrame, term: str, family: str, least_df: int = 2, least: float = 0.0) -> DataFrame:
    """The same of documents of one family each: both (term, family, n documents) and fams (family, fdf documents)."""
    both = both.select(term, family, F.col("n").alias("co")).persist()  # read twice
    terms = both.groupBy(term).agg(F.sum("co").alias("df")).where(F.col("df") >= least_df)
    fams = fams.where(F.col(family).isNotNull()).crossJoin(F.broadcast(fams.agg(F.sum("fdf").alias("total"))))
    return _pmi(both.join(terms, term).join(F.broadcast(fams), family), term, family, least)


def _pmi(met: DataFrame, term: str, family: str, least: float) -> DataFrame:
    value = F.log2(F.col("co") * F.col("total") / (F.col("df") * F.col("fdf")))
    return met.withColumn("pmi", F.round(value, 6)).where(F.col("pmi") >= least).select(term, family, "df", "co", "pmi")
