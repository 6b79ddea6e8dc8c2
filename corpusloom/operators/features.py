"""Scaling, decomposition and selection of vectors: rows (id, v array<double>), results keyed by id."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx


def _stats(rows: DataFrame) -> DataFrame:
    """pos, and mean, deviation (population), least, greatest and quartiles of each component."""
    each = rows.select(F.posexplode("v").alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.percentile_approx("x", [0.25, 0.5, 0.75], 10_000).alias("q"))


def scale(rows: DataFrame, how: str) -> DataFrame:
    """id, v: 'standard' (population deviation), 'minmax' or 'robust' (median and quartile range, to 1/10,000 of the
    ranks); a component without spread becomes 0. 'l1' and 'l2' scale rows. The statistics are one row per component and
    come back as one array, whose size is the number of components."""
    if how in ("l1", "l2"):
        return rows.select("id", (vx.l1_normalise if how == "l1" else vx.l2_normalise)(F.col("v")).alias("v"))
    s = _stats(rows)
    shift, spread = {"standard": (F.col("mean"), F.col("std")), "minmax": (F.col("lo"), F.col("hi") - F.col("lo")), "robust": (F.element_at("q", 2), F.element_at("q", 3) - F.element_at("q", 1))}[how]
    one = s.agg(F.sort_array(F.collect_list(F.struct("pos", shift.alias("a"), F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias("b")))).alias("s"))
    return rows.join(F.broadcast(one)).select("id", F.zip_with("v", "s", lambda x, p: (x - p.a) / p.b).alias("v"))


def pca(rows: DataFrame, k: int) -> DataFrame:
    """id, v: the first k principal components of centred vectors; the sign makes each axis's largest loading positive."""
    v = rows.select("id", array_to_vector("v").alias("features"))
    mean = v.select(Summarizer.mean(F.col("features"))).first()[0].toArray()
    model = PCA(k=k, inputCol="features", outputCol="p").fit(v)
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return _project(rows, axes, mean)


def _project(rows: DataFrame, axes: np.ndarray, mean: np.ndarray) -> DataFrame:
    """One dot product per axis, in expressions, of vectors less the mean."""
    m = F.lit([float(x) for x in mean])
    centred = rows.select("id", F.zip_with("v", m, lambda x, y: x - y).alias("v"))
    return centred.select("id", F.array(*[vx.dot(F.col("v"), F.lit([float(x) for x in a])) for a in axes.T]).alias("v"))


def svd(rows: DataFrame, k: int) -> DataFrame:
    """id, v: projection on the first k right singular vectors (not centred)."""
    matrix = RowMatrix(rows.select("v").rdd.map(lambda r: OldVectors.dense(r[0])))  # the library has this on RDDs alone
    right = np.asarray(matrix.computeSVD(k).V.toArray())
    right = right * np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])
    return _project(rows, right, np.zeros(right.shape[0]))


def nmf(rows: DataFrame, k: int, rounds: int = 30, seed: int = 42) -> DataFrame:
    """id, v: non-negative weights of k parts (negative components count as 0), by multiplicative updates. Each round
    sums two small matrices over the rows; the weights stay with the rows."""

    d = len(rows.select("v").first()[0])
    h = np.random.default_rng(seed).random((k, d)) + 0.1
    clipped = rows.select("id", F.transform("v", lambda x: F.greatest(x, F.lit(0.0))).alias("v"))

    def weights(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        w = np.full((len(x), k), 0.5)
        for _ in range(20):
            w *= (x @ h.T) / (w @ (h @ h.T) + 1e-9)
        return w

    for _ in range(rounds):

        def sums(frames, h=h):
            for f in frames:
                if len(f):
                    x = np.stack(f["v"])
                    w = weights(x, h)
                    yield pd.DataFrame({"a": [(w.T @ x).ravel().tolist()], "b": [(w.T @ w).ravel().tolist()]})

        parts = clipped.mapInPandas(sums, "a array<double>, b array<double>")
        add = lambda c: parts.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
        a, b = ({r.i: r.x for r in add(c).collect()} for c in ("a", "b"))  # k x d and k x k numbers
        wx = np.array([a[i] for i in range(k * d)]).reshape(k, d)
        ww = np.array([b[i] for i in range(k * k)]).reshape(k, k)
        h = h * wx / (ww @ h + 1e-9)

    def out(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"id": f["id"], "v": list(weights(np.stack(f["v"]), h))})

    return clipped.mapInPandas(out, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>")


def spectrum(rows: DataFrame, thresholds: Sequence[float] = (0.5, 0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """threshold, components, participation_ratio of standardised vectors."""
    v = scale(rows, "standard").select(array_to_vector("v").alias("features"))
    d = v.first()[0].size
    share = PCA(k=d, inputCol="features", outputCol="p").fit(v).explainedVariance.toArray()
    run = np.cumsum(share)
    ratio = float(share.sum() ** 2 / (share**2).sum())
    data = [(float(t), int(np.argmax(run >= t - 1e-12)) + 1 if run[-1] >= t - 1e-12 else d, round(ratio, 6)) for t in thresholds]
    return rows.sparkSession.createDataFrame(data, "threshold double, components int, participation_ratio double")


def importance(rows: DataFrame) -> DataFrame:
    """pos, f, ratio: ANOVA F of each component against the cluster, and the share of its variance between clusters."""
    each = rows.select("cluster", F.posexplode("v").alias("pos", "x"))
    g = each.groupBy("pos", "cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy("pos")
    g = g.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    t = g.groupBy("pos").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    f = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))
    return t.select("pos", F.round(f, 6).alias("f"), F.round(F.col("b") / (F.col("b") + F.col("w")), 6).alias("ratio"))




def hashed_embedding(rows: DataFrame, doc: str, tokens: str, dims: int = 256) -> DataFrame:
    """id, v: documents as vectors of length 1, the default in place of a sentence model: each token adds one, with a sign,
    at a place that its MD5 names. Documents without tokens give zeros."""
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 7), 16, 10).cast("long")
    cells = rows.select(doc, F.explode(tokens).alias("t")).select(doc, (h % dims).cast("int").alias("pos"), (1 - 2 * (F.floor(h / dims) % 2)).alias("x"))
    sums = cells.groupBy(doc, "pos").agg(F.sum("x").cast("double").alias("x"))
    held = sums.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    norm = F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    at = lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(0.0)) / norm
    return rows.select(F.col(doc)).join(held, doc, "left").select(F.col(doc).alias("id"), F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), at).alias("v"))
