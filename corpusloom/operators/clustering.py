"""Clusterings of vectors (id, v array<double>) and the choice of their number. Results are (id, cluster)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import blocks, metrics
from .vectors import centroids


ONE_TASK = 1_000_000  # links that one task may hold


def _features(rows: DataFrame) -> DataFrame:
    return rows.select("id", "v", array_to_vector("v").alias("features"))


def k_means(rows: DataFrame, k: int, seeds: Sequence[int] = (42,), cosine: bool = False, rounds: int = 20) -> tuple[DataFrame, float, np.ndarray]:
    """(id, cluster), cost and centres of the best of several seeded runs. cosine: on the sphere."""
    data = _features(rows)
    best = None
    for s in seeds:
        model = KMeans(k=k, seed=s, maxIter=rounds, distanceMeasure="cosine" if cosine else "euclidean").fit(data)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(data).select("id", F.col("prediction").alias("cluster")), float(best.summary.trainingCost), np.array(best.clusterCenters())


def gaussian_mixture(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    data = _features(rows)
    return GaussianMixture(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def bisecting(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Top-down hierarchical clustering; the bottom-up one over centroids is merge_clusters."""
    data = _features(rows)
    return BisectingKMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def spectral(links: DataFrame, k: int) -> DataFrame:
    """Power iteration over weighted links (src, dst, weight)."""
    return PowerIterationClustering(k=k, maxIter=20, weightCol="weight").assignClusters(links)


def spectral_within(rows: DataFrame, eps: float, k: int, rounds: int = 20) -> DataFrame:
    """id, cluster as spectral() gives over the links of weight 1 / (1 + d) of rows at most eps apart, which are not made:
    power iteration by blocks, then k-means of its values. Rows without a link are left out. Starts are drawn by the ids."""
    kind, spark = rows.schema["id"].dataType.simpleString(), rows.sparkSession
    ids, values = blocks.power(rows, eps, rounds)
    if not len(ids):
        return spark.createDataFrame([], f"id {kind}, cluster int")
    data = spark.createDataFrame(pd.DataFrame({"id": ids, "x": values}), f"id {kind}, x double").repartition(8, "id").sortWithinPartitions("id")
    data = data.select("id", array_to_vector(F.array("x")).alias("features")).persist()
    return KMeans(k=k, seed=0, maxIter=20).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def near_pairs(rows: DataFrame, eps: float) -> DataFrame:
    """a, b, d: pairs within eps, a below b. Every two rows meet, in blocks: in many dimensions no axis parts them. The
    work is quadratic, the memory is not."""
    return blocks.near(rows, eps)


def _kept(df: DataFrame) -> DataFrame:
    """The table computed once: in the checkpoint folder where there is one."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def _smallest(links: DataFrame) -> DataFrame:
    """id, cluster: the smallest id that links (id, other) reach, of every id that has a link to another. Rounds link the
    larger neighbours of a row, then the smaller ones, to the smallest; they end when a round changes nothing, or when no
    more than ONE_TASK links are left, which one task can finish."""
    kind = links.schema["id"].dataType.simpleString()

    def finish(edges: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
        label = np.arange(len(ids))
        blocks.merge(label, at[: len(edges)], at[len(edges) :])
        return pd.DataFrame({"id": ids, "cluster": ids[label]})

    edges, before = _kept(links.where("id <> other").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")).distinct()), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state[0] <= ONE_TASK:
            return edges.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(finish, f"id {kind}, cluster {kind}")
        if state == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("cluster")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, before = _kept(small.union(least).distinct()), state


def dbscan(rows: DataFrame, eps: float, least: int) -> DataFrame:
    """id, cluster: -1 for noise; clusters carry the smallest id of their core points. Core points have `least`
    neighbours, themselves included; a border point joins its nearest core point's cluster. Pairs are counted, and then
    linked, in the task where their blocks meet; a row leaves one number there, so no table of pairs is made. Of a core
    row's smallest rows in all its tasks, the smallest stands for the others, so only those are left to be linked."""
    rows = rows.select("id", "v")
    near = _kept(blocks.degrees(rows, eps))
    dense = rows.join(near, "id", "left").select("id", "v", (F.coalesce("n", F.lit(0)) + 1 >= least).alias("core"))
    other, core = F.min_by("other", F.struct("d", "other")).alias("other"), (F.min("d") < 0).alias("core")
    reach = F.collect_set(F.when(F.col("d") == -1, F.col("other"))).alias("reach")  # one of each task
    met = _kept(blocks.density_links(dense, eps).groupBy("id").agg(other, core, reach))
    roots = _smallest(met.where("core").select(F.explode("reach").alias("id"), "other"))
    label = met.where("core").join(roots.withColumnRenamed("id", "other"), "other", "left").select("id", F.coalesce("cluster", "other").alias("cluster"))
    border = met.where("NOT core").select(F.col("id").alias("at"), F.col("other").alias("id")).join(label, "id").select(F.col("at").alias("id"), "cluster")
    return rows.select("id").join(label.union(border), "id", "left").fillna(-1, ["cluster"])


def _condensed(edges: list[tuple[float, int, int]], n: int, size: int, leaf: bool, epsilon: float) -> np.ndarray:
    """Labels of n points by the spanning tree's edges (weight, end, end): the tree condensed at `size` and the clusters
    of the greatest excess of mass, or its leaves; clusters born below epsilon give way to the first ancestor above it."""
    if n < max(2, size):
        return np.full(n, -1)
    edges = sorted(edges)
    parent, kids, weight, count = list(range(2 * n - 1)), {}, {}, [1] * n + [0] * (n - 1)

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j, (w, a, b) in enumerate(edges):
        a, b, m = top(a), top(b), n + j
        kids[m], weight[m], count[m] = (a, b), w, count[a] + count[b]
        parent[a] = parent[b] = m

    def leaves(i: int) -> list[int]:
        out, stack = [], [i]
        while stack:
            k = stack.pop()
            if k < n:
                out.append(k)
            else:
                stack += kids[k]
        return out

    # condensed tree: cluster -> (birth, parent); mass of each
    birth, up, mass, under, members = {0: 0.0}, {0: None}, {0: 0.0}, {0: []}, {0: []}
    stack, next_id = [(2 * n - 2, 0)], 1
    while stack:
        node, c = stack.pop()
        while node >= n:
            lam = 1 / max(weight[node], 1e-12)
            a, b = kids[node]
            big = [k for k in (a, b) if count[k] >= size]
            if len(big) == 2:
                for k in (a, b):
                    mass[c] += count[k] * (lam - birth[c])
                    birth[next_id], up[next_id], mass[next_id], under[next_id], members[next_id] = lam, c, 0.0, [], []
                    under[c].append(next_id)
                    stack.append((k, next_id))
                    next_id += 1
                break
            for k in (a, b):
                if k not in big:
                    mass[c] += count[k] * (lam - birth[c])
                    members[c] += leaves(k)
            if not big:
                break
            node = big[0]
        else:
            members[c].append(node)
    chosen, best = set(), {}
    for c in sorted(birth, reverse=True):
        below = sum(best[k] for k in under[c])
        if c != 0 and (not under[c] if leaf else mass[c] >= below):
            best[c] = mass[c]
            todo = list(under[c])
            while todo:
                k = todo.pop()
                chosen.discard(k)
                todo += under[k]
            chosen.add(c)
        else:
            best[c] = below
    if epsilon > 0:
        risen = set()
        for c in chosen:
            while 1 / birth[c] < epsilon and up[c]:
                c = up[c]
            risen.add(c)
        chosen = set()
        for c in risen:
            above = up[c]
            while above and above not in risen:
                above = up[above]
            if not above:
                chosen.add(c)
    label = np.full(n, -1)
    for number, c in enumerate(sorted(chosen)):
        todo = [c]
        while todo:
            k = todo.pop()
            label[members[k]] = number
            todo += under[k]
    return label


def hdbscan(rows: DataFrame, size: int = 10, samples: int | None = None, leaf: bool = False, epsilon: float = 0.0) -> DataFrame:
    """id, cluster (-1: noise) of all rows: core distances and the spanning tree of mutual reachability by pairs of
    blocks, the same at every size; the tree is condensed in one task, which holds an edge (two ids and a weight) for
    each row and no vectors. leaf takes the finest clusters instead of those of the greatest excess of mass; epsilon
    merges those that part below that distance. Fewer rows than `size`: all noise."""
    kind = rows.schema["id"].dataType.simpleString()

    def cut(edges: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
        tree = list(zip(edges["w"].tolist(), at[: len(edges)].tolist(), at[len(edges) :].tolist(), strict=True))
        return pd.DataFrame({"id": ids, "cluster": _condensed(tree, len(ids), size, leaf, epsilon)})

    tree = blocks.spanning_tree(rows, samples or size)
    found = tree.withColumn("one", F.lit("all")).groupBy("one").applyInPandas(cut, f"id {kind}, cluster int")
    return rows.select("id").join(found, "id", "left").fillna(-1, ["cluster"])


def merge_clusters(rows: DataFrame, assigned: DataFrame, k: int) -> DataFrame:
    """id, cluster: micro clusters merged to k by average linkage of their centroids, and noise attached to the nearest
    merged centroid. The centroids, a row per micro cluster, are merged in one place."""
    met = rows.join(assigned, "id")
    cents = centroids(met.where("cluster >= 0")).orderBy("cluster").toPandas()
    c = np.stack(cents["c"])
    groups = [[i] for i in range(len(c))]
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    while len(groups) > max(1, k):
        best = min(((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    of = {int(cents["cluster"][i]): g for g, members in enumerate(groups) for i in members}
    table = F.create_map(*[F.lit(x) for p in of.items() for x in p])
    from .vectors import reassign_noise

    merged = met.withColumn("cluster", F.when(F.col("cluster") < 0, -1).otherwise(table[F.col("cluster")]))
    return reassign_noise(merged.select("id", "cluster", "v"))


def sweep(rows: DataFrame, ks: Sequence[int], seed: int = 42, sample: int | None = None) -> DataFrame:
    """k, cost, silhouette for each k; the silhouette is over all rows, or over a fixed sample."""
    out = []
    for k in ks:
        assigned, cost, _ = k_means(rows, k, (seed,))
        s = metrics.silhouette(rows.select("id", "v").join(assigned, "id"), sample).first()[0]
        out.append((int(k), round(cost, 6), None if s is None else float(s)))
    return rows.sparkSession.createDataFrame(out, "k int, cost double, silhouette double")


def knee(ks: Sequence[int], costs: Sequence[float]) -> int:
    """The k farthest below the line from the first to the last cost."""
    x, y = np.array(ks, float), np.array(costs, float)
    x, y = (x - x[0]) / max(x[-1] - x[0], 1e-12), (y - y[-1]) / max(y[0] - y[-1], 1e-12)
    return int(ks[int(np.argmax(1 - x - y))])


def gap_statistic(rows: DataFrame, ks: Sequence[int], draws: int = 3, seed: int = 42) -> DataFrame:
    """k, gap: mean log cost of uniform tables over the data's box less the log cost of the data."""
    d = len(rows.select("v").first()[0])
    box = rows.select(F.posexplode("v").alias("p", "x")).groupBy("p").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("p").collect()  # a row per component
    out = []
    for k in ks:
        own = np.log(max(k_means(rows, k, (seed,))[1], 1e-12))
        refs = []
        for r in range(draws):
            uniform = rows.select("id", F.array(*[F.lit(box[i].lo) + F.rand(seed * 1000 + r * d + i) * (box[i].hi - box[i].lo) for i in range(d)]).alias("v"))
            refs.append(np.log(max(k_means(uniform, k, (seed,))[1], 1e-12)))
        out.append((int(k), round(float(np.mean(refs) - own), 6)))
    return rows.sparkSession.createDataFrame(out, "k int, gap double")


def stability(rows: DataFrame, k: int, rounds: int = 3, seed: int = 42) -> DataFrame:
    """One row: mean ARI of clusterings of halves of the rows, assigned to all rows, against that of all rows."""
    whole, _, _ = k_means(rows, k, (seed,))
    scores = []
    for r in range(rounds):
        part = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + r)), F.lit(2)) == 0)
        model = KMeans(k=k, seed=seed, maxIter=20).fit(_features(part))
        other = model.transform(_features(rows)).select("id", F.col("prediction").alias("other"))
        scores.append(metrics.agreement(whole.join(other, "id"), "cluster", "other").first()[0])
    return rows.sparkSession.createDataFrame([(k, round(float(np.mean(scores)), 6))], "k int, mean_ari double")


def prediction_strength(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """One row: the least share, over clusters of one half, of pairs that the other half's centres keep together. Pairs
    are counted from the contingency table."""
    half = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2))
    train, test = rows.where(half == 0), rows.where(half == 1)
    own, _, _ = k_means(test, k, (seed,))
    other = KMeans(k=k, seed=seed, maxIter=20).fit(_features(train)).transform(_features(test)).select("id", F.col("prediction").alias("other"))
    t = own.join(other, "id").groupBy("cluster", "other").agg(F.count(F.lit(1)).cast("double").alias("n"))
    per = t.groupBy("cluster").agg(F.sum("n").alias("s"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p")).where("s > 1")
    return per.agg(F.round(F.min(F.col("p") / (F.col("s") * (F.col("s") - 1))), 6).alias("strength")).select(F.lit(k).alias("k"), "strength")


def co_association(assignments: Sequence[DataFrame], least: float = 0.5, width: int = 1024) -> DataFrame:
    """a, b, share: pairs together in at least that share of several clusterings (each id once in each). Rows of the same
    clusters everywhere are a class; shares are counted between classes, and members are written out from chunks of
    `width` ids that meet as a whole, so no pair is shuffled or counted. Without equal rows every row is a class."""
    parts = None
    for i, a in enumerate(assignments):
        p = a.select("id", F.lit(i).alias("run"), F.col("cluster").cast("string").alias("cluster")).where("cluster IS NOT NULL")
        parts = p if parts is None else parts.union(p)
    signed = parts.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("run", "cluster"))).alias("sig"))
    classes = signed.groupBy("sig").agg(F.min("id").alias("class"), F.ceil(F.count(F.lit(1)) / width).alias("chunks")).persist()
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk")
    chunks = signed.join(classes, "sig").select("class", chunk, "id").groupBy("class", "chunk").agg(F.collect_list("id").alias("ids"))
    of = lambda n: classes.select(F.col("class").alias(n), F.explode("sig").alias("s"))
    share = F.count(F.lit(1)) / len(assignments)
    met = of("x").join(of("y"), "s").where("x < y").groupBy("x", "y").agg(share.alias("share"))
    own = classes.select(F.col("class").alias("x"), F.col("class").alias("y"), (F.size("sig") / len(assignments)).alias("share"))
    linked = met.union(own).where(F.col("share") >= least)
    side = lambda n: chunks.select(F.col("class").alias(n), F.col("chunk").alias(f"{n}_at"), F.col("ids").alias(f"{n}_ids"))
    blocks_of = linked.join(side("x"), "x").join(side("y"), "y").where("x <> y OR x_at <= y_at")
    spread = max(32, int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: a few bytes here are many pairs
    pairs = blocks_of.repartition(spread, "x", "y", "x_at", "y_at").withColumn("same", (F.col("x") == F.col("y")) & (F.col("x_at") == F.col("y_at")))
    pairs = pairs.select("share", "same", "y_ids", F.explode("x_ids").alias("p")).select("share", "same", "p", F.explode("y_ids").alias("q")).where("NOT same OR p < q")
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "share")


def vote(choices: Sequence[int], default: int = 8) -> int:
    """The most frequent choice; the median where none repeats; the default without choices."""
    if not choices:
        return default
    values, n = np.unique(choices, return_counts=True)
    return int(values[n.argmax()]) if n.max() > 1 else int(np.median(choices))


def hdbscan_search(rows: DataFrame, sizes: Sequence[int], most: int | None = None) -> DataFrame:
    """size, n_clusters, noise_ratio, silhouette (of the rows that are not noise), best of each least cluster size, on all
    rows or a fixed sample of `most`. best marks the greatest silhouette among settings that leave noise and more than
    one cluster; ties to the smaller size."""
    sample = rows.select("id", "v")
    if most is not None:
        sample = sample.orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)
    out = []
    for size in sizes:
        met = sample.join(hdbscan(sample, size), "id").persist()
        n, noise = met.agg(F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))), F.avg((F.col("cluster") < 0).cast("double"))).first()
        out.append((int(size), int(n), None if noise is None else round(noise, 6), metrics.silhouette(met).first()[0] if n > 1 else None))
        met.unpersist()
    fit = [r for r in out if r[2] and r[3] is not None]
    best = max(fit, key=lambda r: (r[3], -r[0]))[0] if fit else None
    return rows.sparkSession.createDataFrame([(*r, r[0] == best) for r in out], "size int, n_clusters int, noise_ratio double, silhouette double, best boolean")


def mixture_clusters(mixture: DataFrame, clusters: Sequence, k: int, seed: int = 42) -> DataFrame:
    """id, cluster: k-means of papers by their mixture (paper_id, cluster, prop) over the given clusters."""
    wide = mixture.groupBy("paper_id").agg(F.array(*[F.coalesce(F.max(F.when(F.col("cluster") == c, F.col("prop"))), F.lit(0.0)) for c in clusters]).alias("v"))
    return k_means(wide.withColumnRenamed("paper_id", "id"), k, (seed,))[0]
