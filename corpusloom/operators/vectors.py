"""Centroids, neighbours and pair statistics of vectors: rows (id, cluster, v array<double>).

Every row carries its id; nothing is aligned by position. Within-cluster pair means come from sums of vectors, not from
pairs, so they are linear in the rows; pair extremes and quantiles meet in blocks of a cluster, quadratic in its size but
bounded in memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx
from . import blocks
from .ranking import row_numbers


def long(rows: DataFrame) -> DataFrame:
    return rows.select("id", "cluster", F.posexplode("v").alias("pos", "x"))


def centroids(rows: DataFrame) -> DataFrame:
    """cluster, n, c: the mean vector. Partial sums by cluster and place, so no cluster's rows meet in one task."""
    mean = long(rows).groupBy("cluster", "pos").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("cluster").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p.x).alias("c"))


def normalised(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", vx.l2_normalise(F.col("v")))


def to_centroid(rows: DataFrame) -> DataFrame:
    """Rows with cosine and distance to their cluster's centroid. There are few centroids, but nothing bounds them, so
    the join is left to the planner."""
    met = rows.join(centroids(rows).drop("n"), "cluster")
    return met.withColumns({"cosine": vx.cosine(F.col("v"), F.col("c")), "distance": vx.euclidean(F.col("v"), F.col("c"))})


def nearest_members(rows: DataFrame, k: int, by: str = "cosine") -> DataFrame:
    """The k members of each cluster nearest to its centroid; ties to the smaller id."""
    order = F.round(F.col(by), 9).desc() if by == "cosine" else F.round(F.col(by), 9)
    ranked = to_centroid(rows).withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(order, "id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("cluster", "rank", "id", F.round(by, 6).alias(by))


def representatives(rows: DataFrame) -> DataFrame:
    return nearest_members(rows, 1, "distance").select("cluster", "id", "distance")


def reassign_noise(rows: DataFrame) -> DataFrame:
    """id, cluster: noise rows go to the nearest centroid of the other clusters (ties to the smaller). Centroids travel
    to the noise rows as one array, whose size is clusters x dimensions."""
    cents = centroids(rows.where("cluster >= 0")).agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
    noise = rows.where("cluster < 0").join(F.broadcast(cents))
    near = F.array_min(F.transform("cs", lambda c: F.struct(F.round(vx.euclidean(F.col("v"), c.c), 9).alias("d"), c.cluster.alias("cluster"))))
    return rows.where("cluster >= 0").select("id", "cluster").union(noise.select("id", near.cluster))


#: Cells of the range of cosines that pairs are counted in, to find the quartiles.
CELLS = 1 << 15


def pair_statistics(rows: DataFrame, quartiles: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """Per cluster: size, and mean, deviation (population), least, greatest and quartiles of the cosine of all pairs. Pairs
    meet in blocks and never leave their task: it counts them by cells of the cosine, and a second pass over the blocks
    gives the distinct values of the few cells that hold the quartiles, with their numbers."""
    unit = rows.select("id", "cluster", vx.l2_normalise(F.col("v")).alias("v"))
    kind = rows.schema["cluster"].dataType.simpleString()

    def cosines(x: np.ndarray, y: np.ndarray | None) -> Iterator[np.ndarray]:
        for a, b in blocks.tiles(len(x), len(x if y is None else y), y is None):
            s = x[a] @ (x if y is None else y)[b].T
            yield s[np.triu_indices(len(s), 1)] if y is None and a == b else s.ravel()

    cell = lambda s: np.clip((s + 1) * (CELLS / 2), 0, CELLS - 1).astype(np.int64)

    def count(x, y, first):
        n, total, square, lo, hi = np.zeros(CELLS, np.int64), 0.0, 0.0, np.inf, -np.inf
        for s in cosines(x, y):
            if len(s):
                n += np.bincount(cell(s), minlength=CELLS)
                total, square, lo, hi = total + s.sum(), square + s @ s, min(lo, s.min()), max(hi, s.max())
        at = np.nonzero(n)[0]
        out = pd.DataFrame({"cluster": first["cluster"], "cell": at, "n": n[at], "s": 0.0, "ss": 0.0, "lo": lo, "hi": hi})
        out.loc[:0, ["s", "ss"]] = total, square
        return out

    def values(x, y, first):
        wanted, found, parts = np.zeros(CELLS, bool), [], []
        wanted[list(first["cells"])] = True
        for s in cosines(x, y):
            found.append(s[wanted[cell(s)]])
            if sum(map(len, found)) > 1 << 21:
                parts, found = [_distinct(parts, found)], []
        v, n = _distinct(parts, found)
        return pd.DataFrame({"cluster": first["cluster"], "cell": cell(v), "value": v, "n": n})

    counted = blocks.in_clusters(unit, count, f"cluster {kind}, cell int, n long, s double, ss double, lo double, hi double").persist()
    cells = counted.groupBy("cluster", "cell").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stats = counted.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    place = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    ranks = stats.select("cluster", F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in quartiles])))).alias("rank"))
    held = cells.join(ranks, "cluster").where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("cluster", "rank", "cell", "before").persist()
    asked = unit.join(held.groupBy("cluster").agg(F.array_sort(F.collect_set("cell")).alias("cells")), "cluster")
    near = blocks.in_clusters(asked, values, f"cluster {kind}, cell int, value double, n long").groupBy("cluster", "cell", "value").agg(F.sum("n").alias("n"))
    near = near.withColumn("upto", F.sum("n").over(Window.partitionBy("cluster", "cell").orderBy("value")))
    picked = held.join(near, ["cluster", "cell"]).where(F.col("before") + F.col("upto") > F.col("rank")).groupBy("cluster", "rank").agg(F.min("value").alias("value"))
    picked = picked.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def quantile(q: float):
        low, high = F.element_at("at", F.floor(place(q))), F.element_at("at", F.ceil(place(q)))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    r = lambda x, name: F.round(x, 6).alias(name)
    mean = F.col("s") / F.col("n")
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    named = [r(quantile(q), f"q{round(q * 100)}") for q in quartiles]
    return sizes.join(stats, "cluster").join(picked, "cluster").select("cluster", "size", r(mean, "mean"), r(F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))), "std"), r(F.col("lo"), "min"), r(F.col("hi"), "max"), *named)


def _distinct(parts: list[tuple[np.ndarray, np.ndarray]], found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, in order, of counted parts (values, numbers) and of single values, with their numbers."""
    v = np.concatenate([p[0] for p in parts] + found) if parts or found else np.zeros(0)
    n = np.concatenate([p[1] for p in parts] + [np.ones(len(f), np.int64) for f in found]) if parts or found else np.zeros(0, np.int64)
    each, at = np.unique(v, return_inverse=True)
    return each, np.bincount(at, n, len(each)).astype(np.int64)


def centroid_pairs(rows: DataFrame) -> DataFrame:
    """a, b, cosine, distance of every two centroids, a below b. Clusters are few; blocks of them meet by an equi-join
    on a constant key only because the pairs themselves are the result."""
    c = centroids(rows).drop("n")
    pair = c.select(F.col("cluster").alias("a"), F.col("c").alias("ca")).join(c.select(F.col("cluster").alias("b"), F.col("c").alias("cb")), F.col("a") < F.col("b"))
    return pair.select("a", "b", vx.cosine(F.col("ca"), F.col("cb")).alias("cosine"), vx.euclidean(F.col("ca"), F.col("cb")).alias("distance"))


def separation(rows: DataFrame) -> DataFrame:
    """One row: distances between centroids (mean, deviation, least, greatest), the mean distance of pairs inside
    clusters, and the ratio of the means."""

    def sums(x, y, first):
        total, n = 0.0, len(x) * (len(x) - 1) // 2 if y is None else len(x) * len(y)
        for a, b in blocks.tiles(len(x), len(x if y is None else y), y is None):
            d = blocks.distances(x[a], (x if y is None else y)[b])
            total += d.sum() / (2 if y is None and a == b else 1)
        return pd.DataFrame({"s": [total], "n": [n]})

    inside = blocks.in_clusters(rows.select("id", "cluster", "v"), sums, "s double, n long").agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("intra"))
    between = centroid_pairs(rows).agg(F.avg("distance").alias("mean"), F.stddev_pop("distance").alias("std"), F.min("distance").alias("min"), F.max("distance").alias("max"))
    return between.crossJoin(inside).select(
        F.round("mean", 6).alias("mean_inter"), F.round("std", 6).alias("std_inter"), F.round("min", 6).alias("min_inter"), F.round("max", 6).alias("max_inter"), F.round("intra", 6).alias("mean_intra"), F.round(F.col("mean") / F.col("intra"), 6).alias("ratio")
    )


def quality(rows: DataFrame) -> DataFrame:
    """Per cluster: size, mean cosine of its pairs, mean cosine to its centroid, the greatest cosine of its centroid and
    another, and the margin between the last two. The pair mean is (|sum of unit vectors|^2 - n) / (n (n - 1))."""
    unit = rows.select("id", "cluster", vx.l2_normalise(F.col("v")).alias("v"))
    c = centroids(unit).withColumn("len", vx.norm(F.col("c")))
    n = F.col("n")
    own = c.select("cluster", n.alias("size"), F.when(n > 1, (n * n * F.col("len") * F.col("len") - n) / (n * (n - 1))).alias("pairs"), F.when(n > 1, F.col("len")).alias("to_centroid"))
    both = centroid_pairs(unit)
    near = both.select(F.col("a").alias("cluster"), "cosine").union(both.select("b", "cosine")).groupBy("cluster").agg(F.max("cosine").alias("near"))
    met = own.join(near, "cluster", "left")
    r = lambda x, name: F.round(x, 6).alias(name)
    return met.select("cluster", "size", r("pairs", "mean_pair_cosine"), r("to_centroid", "mean_to_centroid"), r("near", "nearest_other_centroid"), r(F.col("to_centroid") - F.col("near"), "margin"))


def density(rows: DataFrame) -> DataFrame:
    """Per cluster: 1 / (1 + mean distance to the centroid), and that mean as compactness."""
    return to_centroid(rows).groupBy("cluster").agg(F.round(1 / (1 + F.avg("distance")), 6).alias("density"), F.round(F.avg("distance"), 6).alias("compactness"))


def inertia(rows: DataFrame) -> DataFrame:
    return to_centroid(rows).agg(F.round(F.sum(F.col("distance") * F.col("distance")), 6).alias("inertia"))


def diversity(rows: DataFrame, pairs: int = 20) -> DataFrame:
    """One row: statistics of the cosine distance of each row and the `pairs` rows after it in id order, and of the
    norms. A bounded number of pairs per row stands for all; rows are numbered and the median is found in many tasks."""
    ranked = row_numbers(rows.select("id", "v"), "id", "rn")
    a = ranked.withColumn("to", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + pairs)))
    b = ranked.select(F.col("rn").alias("to"), F.col("v").alias("w"))
    d = a.join(b, "to").select((1 - vx.cosine(F.col("v"), F.col("w"))).alias("d")).persist()
    norms = rows.agg(F.round(F.avg(vx.norm(F.col("v"))), 6).alias("mean_norm"), F.round(F.stddev_pop(vx.norm(F.col("v"))), 6).alias("std_norm"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean"), F.round(F.stddev_pop("d"), 6).alias("std"), F.round(F.min("d"), 6).alias("min"), F.round(F.max("d"), 6).alias("max")).crossJoin(median(d, "d").select(F.round("median", 6).alias("median"))).crossJoin(norms)


def median(rows: DataFrame, value: str) -> DataFrame:
    """One row: the median. Values are counted by cells between the least and the greatest; the values of the cells that
    hold the middle ones are then told apart, each with its number."""
    v = rows.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    span = v.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * CELLS)).otherwise(0).alias("cell")
    celled = v.crossJoin(F.broadcast(span)).select("x", at)
    upto = lambda by: F.sum("n").over(Window.orderBy(by)) - F.col("n")
    cells = celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", "n", upto("cell").alias("before"))  # CELLS + 1 rows at most
    ranks = cells.agg(F.sum("n").alias("all")).select(F.explode(F.array_distinct(F.array(F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)))).alias("rank"))
    held = cells.join(F.broadcast(ranks), (F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n"))).select("cell", "before", "rank")
    near = celled.join(F.broadcast(held.select("cell").distinct()), "cell").groupBy("cell", "x").agg(F.count(F.lit(1)).alias("n"))
    near = near.select("cell", "x", F.sum("n").over(Window.partitionBy("cell").orderBy("x")).alias("upto"))
    picked = held.join(near, "cell").where(F.col("before") + F.col("upto") > F.col("rank")).groupBy("rank").agg(F.min("x").alias("x"))
    return picked.agg(F.avg("x").alias("median"))


def pair_gap(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: mean cosine of the pairs (a, b), of pairs shuffled by one place in order, and the gap."""
    w = Window.orderBy("a", "b")
    moved = pairs.withColumn("other", F.coalesce(F.lead("b").over(w), F.first("b").over(w)))
    side = lambda c, n: vectors.select(F.col("id").alias(c), F.col("v").alias(n))
    met = moved.join(side("a", "va"), "a").join(side("b", "vb"), "b").join(side("other", "vo"), "other")
    pos, neg = F.avg(vx.cosine(F.col("va"), F.col("vb"))), F.avg(vx.cosine(F.col("va"), F.col("vo")))
    return met.agg(F.round(pos, 6).alias("positive"), F.round(neg, 6).alias("shuffled"), F.round(pos - neg, 6).alias("gap"))
