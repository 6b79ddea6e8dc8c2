"""Metrics of clusterings and classifications. Pair metrics come from one contingency table, never from pairs."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as vx
from . import blocks
from .ranking import value_ranks
from .terms import once
from .vectors import centroid_pairs, centroids, to_centroid


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ARI, NMI (arithmetic), homogeneity, completeness, V and Fowlkes-Mallows of two labelings. Of identical
    trivial labelings all are 1; null labels are a label."""
    t = contingency(rows, a, b)
    t = t.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    c2 = lambda x: x * (x - 1) / 2.0
    n = F.col("n").cast("double")
    cells = t.agg(F.sum(n).alias("N"), F.sum(c2(n)).alias("ij"), F.sum(n * F.ln("n")).alias("hij"), F.sum(n * F.ln("na")).alias("ha_"), F.sum(n * F.ln("nb")).alias("hb_"), F.sum(n / F.col("na") * c2(F.col("na"))).alias("ai"), F.sum(n / F.col("nb") * c2(F.col("nb"))).alias("bj"))
    N = F.col("N")
    ha, hb, hab = F.ln(N) - F.col("ha_") / N, F.ln(N) - F.col("hb_") / N, F.ln(N) - F.col("hij") / N
    v = cells.select("*", ha.alias("ha"), hb.alias("hb"), F.greatest(ha + hb - hab, F.lit(0.0)).alias("mi"), (F.col("ai") * F.col("bj") / F.greatest(c2(N), F.lit(1e-300))).alias("e"))
    one = F.lit(1.0)
    hom = F.when(F.col("ha") < 1e-15, one).otherwise(F.col("mi") / F.col("ha"))
    com = F.when(F.col("hb") < 1e-15, one).otherwise(F.col("mi") / F.col("hb"))
    mean, low = (F.col("ai") + F.col("bj")) / 2, F.abs((F.col("ai") + F.col("bj")) / 2 - F.col("e")) < 1e-15
    r = lambda x, name: F.round(x, 6).alias(name)
    return v.select(
        r(F.when(low, one).otherwise((F.col("ij") - F.col("e")) / (mean - F.col("e"))), "ari"),
        r(F.when(F.col("ha") + F.col("hb") < 1e-15, one).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))), "nmi"),
        r(hom, "homogeneity"),
        r(com, "completeness"),
        r(F.when(hom + com == 0, F.lit(0.0)).otherwise(2 * hom * com / (hom + com)), "v_measure"),
        r(F.when(F.col("ai") * F.col("bj") == 0, F.lit(0.0)).otherwise(F.col("ij") / F.sqrt(F.col("ai") * F.col("bj"))), "fmi"),
    )


#: Terms of the expected information that are in memory at once.
STRETCH = 1 << 20


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln(n!) of whole numbers: a table of the first, Stirling's series beyond."""
    table = np.array([math.lgamma(i + 1) for i in range(32)])
    x = np.maximum(n, 31) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 32, table[np.minimum(n, 31)], series)


def adjusted_mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ami. The expected information is a sum over the two labelings' sizes, as a Python step on one row of
    distinct sizes with their counts, which are far fewer than the labels."""
    t = contingency(rows, a, b)
    ta = t.groupBy("a").agg(F.sum("n").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    tb = t.groupBy("b").agg(F.sum("n").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    pack = lambda d, name: d.agg(F.sort_array(F.collect_list(F.struct("s", "k"))).alias(name))
    t = t.withColumns({"na": F.sum("n").over(Window.partitionBy("a")), "nb": F.sum("n").over(Window.partitionBy("b"))})
    n = F.col("n").cast("double")
    cells = t.agg(F.sum("n").alias("N"), F.sum(n * F.ln("n")).alias("hij"), F.sum(n * F.ln("na")).alias("ha"), F.sum(n * F.ln("nb")).alias("hb"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f.itertuples():
                N = x.N
                ha, hb = math.log(N) - x.ha / N, math.log(N) - x.hb / N
                mi = ha + hb - (math.log(N) - x.hij / N)
                expected = 0.0
                for p in x.sa:
                    for q in x.sb:
                        s, u = p["s"], q["s"]
                        fixed = float(_log_factorial(np.array([s, u, N - s, N - u, N])) @ np.array([1, 1, 1, 1, -1]))
                        for at in range(max(1, s + u - N), min(s, u) + 1, STRETCH):
                            nij = np.arange(at, min(at + STRETCH, min(s, u) + 1))
                            w = fixed - sum(_log_factorial(m) for m in (nij, s - nij, u - nij, N - s - u + nij))
                            expected += p["k"] * q["k"] * float((nij / N * (np.log(N * nij.astype(float)) - math.log(s) - math.log(u)) * np.exp(w)).sum())
                gap = (ha + hb) / 2 - expected
                yield pd.DataFrame({"ami": [round(1.0 if abs(gap) < 1e-15 else (mi - expected) / gap, 6)]})

    return cells.crossJoin(pack(ta, "sa")).crossJoin(pack(tb, "sb")).mapInPandas(run, "ami double")


def confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n and the share of n in its row."""
    return contingency(rows, a, b).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("a")), 6))


def classification(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro F1 over the labels of either column; a label without predictions has F1 0."""
    t = contingency(rows, truth, predicted)
    labels = t.select(F.col("a").alias("l"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit")).union(t.select("b", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    per = labels.groupBy("l").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("hit").alias("hit"))
    return per.agg(F.round(F.sum("hit") / F.sum("t"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("hit") / (F.col("t") + F.col("p"))), 6).alias("macro_f1"))


def calinski_harabasz(rows: DataFrame) -> DataFrame:
    """One row: the score over clusters that are not noise; null for a single one."""
    own = rows.where("cluster >= 0")
    c = centroids(own)
    total = centroids(own.withColumn("cluster", F.lit(0))).select(F.col("c").alias("m"), F.col("n").alias("n_all"))
    between = c.join(F.broadcast(total)).agg(F.sum(F.col("n") * F.pow(vx.euclidean(F.col("c"), F.col("m")), 2)).alias("b"), F.count(F.lit(1)).alias("k"), F.max("n_all").alias("n_all"))
    within = to_centroid(own).agg(F.sum(F.col("distance") * F.col("distance")).alias("w"))
    k, n = F.col("k"), F.col("n_all")
    return between.crossJoin(within).select(F.round(F.when((k > 1) & (F.col("w") > 0), F.col("b") / (k - 1) / (F.col("w") / (n - k))), 6).alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame) -> DataFrame:
    own = rows.where("cluster >= 0")
    s = to_centroid(own).groupBy("cluster").agg(F.avg("distance").alias("s"))
    both = centroid_pairs(own).join(s.select(F.col("cluster").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("cluster").alias("b"), F.col("s").alias("sb")), "b")
    r = both.select("a", "b", ((F.col("sa") + F.col("sb")) / F.col("distance")).alias("r"))
    worst = r.select("a", "r").union(r.select("b", "r")).groupBy("a").agg(F.max("r").alias("r"))
    return worst.agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


def silhouette(rows: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """One row: the mean silhouette (euclidean) of all points that are not noise, or of a fixed sample of `most`. A single
    cluster gives null; a point alone in its cluster counts 0. Each point meets every other, in pairs of blocks, and
    leaves a sum for each large cluster and one number for all small ones; the sample spares the quadratic work."""
    own = rows.where("cluster >= 0")
    if most is not None:
        own = own.orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), "id").limit(most)
    mine = F.col("other") == F.col("cluster")
    parts = blocks.cluster_means(own).groupBy("id", "cluster").agg(
        F.max(F.when(mine, F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(F.col("other") == -1, F.col("s")).when(~mine, F.col("s") / F.col("n"))).alias("b"), F.max(F.when(mine, F.col("n"))).alias("n")
    )
    s = F.when(F.col("b").isNotNull() & (F.col("n") == 1), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return parts.agg(F.round(F.avg(s), 6).alias("silhouette"))



def coverage(assigned: DataFrame) -> DataFrame:
    noise = F.avg((F.col("cluster") == -1).cast("double"))
    return assigned.agg(F.round(noise, 6).alias("noise_ratio"), F.round(1 - noise, 6).alias("coverage"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation, ties at their mean rank. Equal pairs are counted once, with their number."""
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("k"))
    x, y = (value_ranks(both, c).select(F.col("value").alias(n), F.col("rank").alias(r)) for c, n, r in ((a, "a", "x"), (b, "b", "y")))
    met = pairs.join(x, "a").join(y, "b")
    k = F.col("k").cast("double")
    s = met.agg(*[F.sum(k * e).alias(n) for n, e in (("n", F.lit(1.0)), ("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
    c = lambda p, q, r: F.col(p) - F.col(q) * F.col(r) / F.col("n")
    return s.select(F.round(c("xy", "x", "y") / F.sqrt(c("xx", "x", "x") * c("yy", "y", "y")), 6).alias("rho"), F.col("n").cast("long").alias("n"))


def _ranked_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """g, v, k, rank: rows of a group with a value, and the value's mean rank among all rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    return counts.join(value_ranks(rows, value).select(F.col("value").alias("v"), "rank"), "v")


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: the Kruskal-Wallis H with the correction for ties, and the degrees of freedom."""
    per = _ranked_groups(rows, group, value).groupBy("g").agg(F.sum(F.col("k") * F.col("rank")).alias("s"), F.sum("k").alias("n"))
    per = per.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n_all"), (F.count(F.lit(1)) - 1).alias("df"))
    t = F.col("n").cast("double")
    ties = value_ranks(rows, value).agg(F.sum(F.pow(t, 3) - t).alias("ties"))
    n = F.col("n_all").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (F.pow(n, 3) - n))
    return per.crossJoin(ties).select(F.round(h, 6).alias("h"), "df")


def mann_whitney(rows: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """One row: U of the first group against the second, and both sizes."""
    met = _ranked_groups(rows.where(F.col(group).isin(first, second)), group, value)
    own = F.col("g") == first
    s = met.agg(F.sum(F.when(own, F.col("k") * F.col("rank"))).alias("s"), F.sum(F.when(own, F.col("k")).otherwise(0)).alias("n1"), F.sum(F.when(~own, F.col("k")).otherwise(0)).alias("n2"))
    return s.select(F.round(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, 6).alias("u"), "n1", "n2")


def rouge_n(rows: DataFrame, n: int) -> DataFrame:
    """id, precision, recall, f1 of the n-grams (as multisets, lower-cased words of letters and digits) of summary
    against reference. Both texts of a row are counted where it is read, and only the summary's n-grams are looked up;
    rows that share an id are counted together, by a shuffle."""
    t = _rouge_rows(rows, n) if once(rows, ["id"]) else _rouge_groups(rows, n)
    p, q = F.when(F.col("s") > 0, F.col("hit") / F.col("s")).otherwise(0.0), F.when(F.col("r") > 0, F.col("hit") / F.col("r")).otherwise(0.0)
    return t.select("id", F.round(p, 6).alias("precision"), F.round(q, 6).alias("recall"), F.round(F.when(p + q > 0, 2 * p * q / (p + q)).otherwise(0.0), 6).alias("f1"))


def _rouge_rows(rows: DataFrame, n: int) -> DataFrame:
    """id, hit, s, r: common n-grams and those of either side, of rows with n-grams."""
    find = re.compile("[a-z0-9]+").findall
    grams = lambda x: list(zip(*[w[k:] for w in [find(x.lower()) if x else []] for k in range(n)], strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, tuple[int, Counter]] = {}  # of the last batch's summaries
        for batch in batches:
            out, old, sides = [], sides, {}
            for x, y in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                if x not in sides:
                    own = old.get(x)
                    sides[x] = own or (len(g := grams(x)), Counter(g))
                (s, own), other = sides[x], grams(y)
                seen = Counter(g for g in other if g in own)
                out.append((sum(min(k, own[g]) for g, k in seen.items()), s, len(other)))
            hit, s, r = (pa.array(c, pa.int64()) for c in zip(*out, strict=True)) if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), hit, s, r], ["id", "hit", "s", "r"])

    found = rows.select("id", "summary", "reference").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, hit long, s long, r long")
    return found.where("s > 0 OR r > 0")


def _rouge_groups(rows: DataFrame, n: int) -> DataFrame:
    """The same of ids that several rows share."""
    toks = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    side = lambda c, name: rows.select("id", toks(F.col(c)).alias("w")).where(F.size("w") >= n).select("id", F.explode(grams(F.col("w"))).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias(name))
    met = side("summary", "s").join(side("reference", "r"), ["id", "g"], "full")
    return met.groupBy("id").agg(F.sum(F.least(F.coalesce("s", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("hit"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))


def rouge_l(rows: DataFrame) -> DataFrame:
    """id, f1 by the longest common subsequence of words; an Arrow UDF, for the recurrence has no SQL form."""

    def lcs(a: list[str], b: list[str]) -> int:
        ids: dict[str, int] = {}
        x, y = (np.array([ids.setdefault(w, len(ids)) for w in t]) for t in (a, b))
        row = np.zeros(len(y) + 1, np.int64)
        for w in x:
            diag = np.concatenate([[0], np.where(y == w, row[:-1] + 1, 0)])
            row = np.maximum.accumulate(np.maximum(row, diag))
        return int(row[-1])

    @F.pandas_udf("double")
    def score(summary: pd.Series, reference: pd.Series) -> pd.Series:
        out = []
        for s, r in zip(summary, reference, strict=True):
            a, b = str(s or "").lower().split(), str(r or "").lower().split()
            n = lcs(a, b) if a and b else 0
            out.append(round(2 * n / (len(a) + len(b)), 6) if n else 0.0)
        return pd.Series(out)

    return rows.select("id", score("summary", "reference").alias("f1"))


def bootstrap_ci(rows: DataFrame, key: str, value: str, rounds: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: lo and hi of the mean by resampling. Every draw is a Poisson weight from an MD5 of key, round and seed, so
    one aggregation gives all rounds' means, the same ones however the rows are dealt. Rows of equal or null key share
    their draws; null values stay out."""
    valid = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("i"))
    parts = max(32, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: few bytes and much work, so rows leave the one file they come in
    each = valid.repartition(parts, "i", "v").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.conv(F.substring(F.md5(F.concat("i", F.lit(":"), F.col("round").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    acc, p, weight = math.exp(-1), math.exp(-1), F.lit(0)
    for k in range(1, 8):
        weight = weight + (u >= acc).cast("int")
        p /= k
        acc += p
    means = each.withColumn("w", weight).groupBy("round").agg((F.sum(F.col("v") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    cut = (1 - level) / 2
    return means.agg(F.round(F.percentile("m", cut), 6).alias("lo"), F.round(F.percentile("m", 1 - cut), 6).alias("hi"))


def interpretation(score, steps=((0.7, "strong"), (0.5, "reasonable"), (0.25, "weak")), below: str = "none"):
    """The text of the first threshold that the score reaches."""
    out = None
    for t, text in steps:
        out = F.when(score >= t, text) if out is None else out.when(score >= t, text)
    return out.otherwise(below)


def assignment(cost: np.ndarray) -> list[int]:
    """The column of each row in an assignment of least total cost, for at most as many rows as columns: shortest
    augmenting paths with potentials."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            used[at] = True
            gap = cost[owner[at] - 1] - u[owner[at]] - v[1:]
            better = ~used[1:] & (gap < least[1:])
            least[1:][better], back[1:][better] = gap[better], at
            nxt = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            step = least[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [0] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def aligned_confusion(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, share (in its row) and aligned: whether b is the cluster matched to a by the assignment that keeps the most
    rows together. The table of counts, a row per pair of labels that occurs, is matched in one place."""
    table = confusion(rows, a, b).withColumn("one", F.lit(1))
    schema = table.drop("one").schema.add("aligned", "boolean")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = sorted(frame["a"].unique()), sorted(frame["b"].unique())
        count = np.zeros((len(left), len(right)))
        count[[left.index(x) for x in frame["a"]], [right.index(x) for x in frame["b"]]] = frame["n"]
        flip = count.shape[0] > count.shape[1]
        match = assignment(-(count.T if flip else count))
        pairs = {(left[j], right[i]) if flip else (left[i], right[j]) for i, j in enumerate(match)}
        return frame.drop(columns="one").assign(aligned=[(x, y) in pairs for x, y in zip(frame["a"], frame["b"], strict=True)])

    return table.groupBy("one").applyInPandas(run, schema)


def compare(pipelines: dict[str, DataFrame]) -> DataFrame:
    """first, second and agreement of every two clusterings (id, cluster), joined on the id."""
    out = None
    names = sorted(pipelines)
    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            met = pipelines[x].join(pipelines[y].withColumnRenamed("cluster", "other"), "id")
            one = agreement(met, "cluster", "other").select(F.lit(x).alias("first"), F.lit(y).alias("second"), "*")
            out = one if out is None else out.union(one)
    return out


def perturbed_silhouette(rows: DataFrame, noise: float = 0.1, rounds: int = 3, most: int | None = 500, seed: int = 42) -> DataFrame:
    """round, silhouette of the labels on vectors with normal noise; round 0 has none."""
    out = None
    for r in range(rounds + 1):
        moved = rows if r == 0 else rows.withColumn("v", F.transform("v", lambda x, i: x + noise * F.sqrt(-2 * F.ln((F.pmod(F.xxhash64("id", i, F.lit(seed + r)), F.lit(1_000_003)) + 1) / 1_000_004.0)) * F.cos(2 * math.pi * F.pmod(F.xxhash64(i, "id", F.lit(seed + r)), F.lit(1_000_003)) / 1_000_003.0)))  # noqa: B023
        one = silhouette(moved, most).select(F.lit(r).alias("round"), "silhouette")
        out = one if out is None else out.union(one)
    return out
