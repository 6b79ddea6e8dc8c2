"""Rankings, samples and bins. Ties go to the smaller id, so every result is fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _bucketed(rows: DataFrame, value: str, buckets: int = 256) -> DataFrame:
    """Adds __b, the number of approximate quantiles below the value: buckets in the order of the value, so that ranks over
    a whole table need no window over all of it. The quantiles are one row."""
    cuts = rows.agg(F.array_distinct(F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 10_000)).alias("__cuts"))
    below = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(value)))
    return rows.join(F.broadcast(cuts)).withColumn("__b", below).drop("__cuts")


def row_numbers(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the place of each row, from 1, in the order of a numeric key."""
    dealt = _bucketed(rows, key)
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("__b").agg(F.count(F.lit(1)).alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))  # a row per bucket
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return dealt.join(F.broadcast(offsets), "__b").withColumn(name, inside + F.col("__o")).drop("__b", "__o")


def value_ranks(rows: DataFrame, value: str) -> DataFrame:
    """value, n, rank: the mean rank of each distinct value among all rows, and how many rows have it."""
    counts = _bucketed(rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")), "value")
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.groupBy("__b").agg(F.sum("n").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))  # a row per bucket
    upto = F.sum("n").over(Window.partitionBy("__b").orderBy("value"))
    return counts.join(F.broadcast(offsets), "__b").select("value", "n", (F.col("__o") + upto - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def dominant(mixture: DataFrame) -> DataFrame:
    """The cluster of the greatest share of each paper."""
    order = Window.partitionBy("paper_id").orderBy(F.col("prop").desc(), "cluster")
    return mixture.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def top_k(rows: DataFrame, by: Sequence[str], value: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(value).desc() if descending else F.col(value), tie)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def largest_clusters(assigned: DataFrame, k: int) -> DataFrame:
    sizes = assigned.where("cluster <> -1").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return sizes.orderBy(F.col("size").desc(), "cluster").limit(k)


def quality_range(rows: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """A third of the best, a third of the worst, and the rest nearest to the median of what remains. Keys are unique.
    Each part is a top-n, so no window runs over the whole table."""
    third = max(1, n // 3)
    valid = rows.where(F.col(score).isNotNull()).select(key, score)
    best = valid.orderBy(F.col(score).desc(), key).limit(third).withColumn("part", F.lit("best"))
    low = valid.orderBy(score, key).limit(third).withColumn("part", F.lit("worst"))
    ends = best.union(low.join(F.broadcast(best.select(key)), key, "left_anti"))  # 2 * third rows at most
    rest = valid.join(F.broadcast(ends.select(key)), key, "left_anti")
    mid = rest.agg(F.percentile(score, 0.5).alias("m"))
    near = rest.join(F.broadcast(mid)).withColumn("d", F.abs(F.col(score) - F.col("m"))).orderBy("d", key).limit(max(0, n - 2 * third))
    return ends.union(near.select(key, score, F.lit("middle")))


def one_of_each_bin(rows: DataFrame, key: str, score: str, bins: int = 5) -> DataFrame:
    """Quantile bins with equal edges merged, and of each the row nearest to its median."""
    valid = rows.where(F.col(score).isNotNull()).select(key, F.col(score).cast("double").alias(score))
    edges = valid.agg(F.array_distinct(F.percentile(score, [i / bins for i in range(bins + 1)])).alias("edges"))
    # right-closed bins; the first one holds its left edge too
    binned = valid.join(F.broadcast(edges)).withColumn("bin", F.greatest(F.size(F.filter("edges", lambda e: e < F.col(score))), F.lit(1)))
    mid = binned.groupBy("bin").agg(F.percentile(score, 0.5).alias("m"))
    near = binned.join(F.broadcast(mid), "bin").withColumn("d", F.abs(F.col(score) - F.col("m")))
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("bin").orderBy("d", key)))
    return ranked.where("rn = 1").select("bin", key, score)


def hash_rank(key: str, seed: int):
    """A fixed pseudo-random order that other engines can repeat."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_per_group(rows: DataFrame, by: str, key: str, k: int, seed: int = 42) -> DataFrame:
    order = Window.partitionBy(by).orderBy(hash_rank(key, seed), key)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).drop("rn")


def _hash_places(rows: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Adds rn, the place of each row within its label in hash order, and n, the rows of the label. Rows are dealt by label
    and the hash's first digits, so a label that most rows have is not one task."""
    dealt = rows.withColumn("__h", hash_rank(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    counts = dealt.groupBy(F.col(label).alias("__label"), F.col("__b").alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy("__label")  # at most 4,096 rows a label
    before = F.sum("__n").over(own.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__label", "__bucket", F.coalesce(before, F.lit(0)).alias("__o"), F.sum("__n").over(own).alias("n"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key))
    placed = dealt.withColumn("__i", inside).join(offsets, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__bucket")))
    return placed.withColumn("rn", F.col("__i") + F.col("__o")).drop("__h", "__b", "__i", "__o", "__label", "__bucket")


def balanced_sample(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has."""
    least = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return _hash_places(rows, label, key, seed).join(F.broadcast(least)).where("rn <= least").drop("rn", "n", "least")


def stratified_split(rows: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds split: 'train' for that share of each label, in hash order, else 'test'."""
    ranked = _hash_places(rows, label, key, seed)
    return ranked.withColumn("split", F.when(F.col("rn") <= F.round(F.col("n") * share), "train").otherwise("test")).drop("rn", "n")


def proportional_sample(assigned: DataFrame, key: str, target: int, seed: int = 42) -> DataFrame:
    """About `target` rows, one of each cluster at least, by the clusters' shares; what rounding leaves goes to the
    largest cluster. Noise is left out."""
    own = assigned.where("cluster <> -1")
    sizes = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    quota = sizes.withColumn("q", F.greatest(F.floor(F.col("n") / F.sum("n").over(everything) * target), F.lit(1)))
    largest = F.row_number().over(Window.orderBy(F.col("n").desc(), "cluster")) == 1
    quota = quota.withColumns({"rest": F.greatest(F.lit(target) - F.sum("q").over(everything), F.lit(0)), "largest": largest})
    quota = quota.select("cluster", (F.col("q") + F.when(F.col("largest"), F.col("rest")).otherwise(0)).alias("q"))
    ranked = own.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(hash_rank(key, seed), key)))
    return ranked.join(F.broadcast(quota), "cluster").where("rn <= q").drop("rn", "q")


def every_nth(rows: DataFrame, key: str, n: int, block: int = 50_000) -> DataFrame:
    """Rows 0, n, 2n... of each block of rows in the order of the key."""
    return row_numbers(rows, key, "__at").where(((F.col("__at") - 1) % block) % n == 0).drop("__at")


def first_reaching(values: DataFrame, order: str, value: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold the first place where the running share reaches it."""
    run = values.select(order, (F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy())).alias("c"))
    t = values.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    return run.crossJoin(F.broadcast(t)).where("c >= threshold - 1e-12").groupBy("threshold").agg(F.min(order).alias("place"))


def hash_split(rows: DataFrame, key: str, parts: Sequence[tuple[str, int]] = (("train", 80), ("dev", 10), ("test", 10))) -> DataFrame:
    """Adds split by a hash of the key: disjoint shares of ids, in percent."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % 100
    out, upto = None, 0
    for name, share in parts:
        upto += share
        out = F.when(bucket < upto, name) if out is None else out.when(bucket < upto, name)
    return rows.withColumn("split", out)
