"""Exact top-k search by inner product (operator 6): a cover tree over the queries against a cover tree over the data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

LEAF = 64


class Node:
    """rows: the points below (indices); centre and radius: every point below lies within radius of the centre, which
    is a point itself; children: none for a leaf."""

    __slots__ = ("rows", "centre", "norm", "radius", "children", "worst")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, gap: np.ndarray):
        self.rows, self.centre, self.radius = rows, x[centre], float(gap.max(initial=0.0))
        self.norm = float(np.sqrt(self.centre @ self.centre))
        self.children: list[Node] = []
        self.worst = -np.inf


def cover_tree(x: np.ndarray) -> Node | None:
    """A cover tree: the children of a node of radius r have centres more than r / 2 apart, and each point hangs below
    the first centre within r / 2. Equal points (radius 0) stay together in one leaf, whatever their number."""
    if not len(x):
        return None
    gap = np.sqrt(((x - x[0]) ** 2).sum(1))
    root = Node(x, np.arange(len(x)), 0, gap)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.rows) <= LEAF or node.radius == 0:
            continue
        rows, half = node.rows, node.radius / 2
        while len(rows):
            points = x[rows]
            gap = np.sqrt(((points - points[0]) ** 2).sum(1))
            near = gap <= half
            if not node.children and near.all() and len(rows) == len(node.rows):
                half /= 2  # cannot happen with a centre at distance `radius`, but rounding might make it
                near = gap <= half
            node.children.append(Node(x, rows[near], rows[0], gap[near]))
            rows = rows[~near]
        # single points far from each other would be leaves of one row: gather them into leaves of LEAF
        small = [c for c in node.children if len(c.rows) < 8]
        if len(small) > 1:
            rest = np.concatenate([c.rows for c in small])
            node.children = [c for c in node.children if len(c.rows) >= 8]
            for at in range(0, len(rest), LEAF):
                part = rest[at : at + LEAF]
                node.children.append(Node(x, part, part[0], np.sqrt(((x[part] - x[part[0]]) ** 2).sum(1))))
        todo += [c for c in node.children if len(c.rows) < len(node.rows)]
    return root


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products: by float64 where every partial sum is exact there, else by 64-bit integers."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def dual_search(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, d_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query index, data id, score): the k best of data for each query, its own id left out; ties to smaller ids.

    A pair of nodes is left when even its bound, qc.dc + rq |dc| + rd |qc| + rq rd, is below the worst kth score of the
    query node's queries."""
    nq = len(queries)
    best_s = np.full((nq, k), np.iinfo(np.int64).min)
    best_i = np.full((nq, k), np.iinfo(np.int64).max)
    qx, dx = queries.astype(np.float64), data.astype(np.float64)
    qroot, droot = cover_tree(qx), cover_tree(dx)
    if qroot is None or droot is None:
        return (np.zeros(0, np.int64),) * 3
    slack = 1e-9

    def bound(a: Node, b: Node) -> float:
        v = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
        return v + slack * (1 + abs(v))

    def worst(a: Node) -> float:
        return float(best_s[a.rows, k - 1].min())

    stack = [(bound(qroot, droot), qroot, droot)]
    while stack:
        top, a, b = stack.pop()
        if top < worst(a):
            continue
        if not a.children and not b.children:
            for at in range(0, len(b.rows), 4096):  # a leaf of equal points may be long
                rows = b.rows[at : at + 4096]
                score = _exact(queries[a.rows], data[rows])
                ids = np.broadcast_to(d_ids[rows], score.shape)
                own = ids == q_ids[a.rows][:, None]
                s = np.concatenate([best_s[a.rows], np.where(own, np.iinfo(np.int64).min, score)], 1)
                i = np.concatenate([best_i[a.rows], np.where(own, np.iinfo(np.int64).max, ids)], 1)
                order = np.lexsort((i, -s.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else ~s), axis=1)[:, :k]
                best_s[a.rows], best_i[a.rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            continue
        if b.children and (not a.children or b.radius >= a.radius):
            pairs = [(bound(a, c), a, c) for c in b.children]
        else:
            pairs = [(bound(c, b), c, b) for c in a.children]
        pairs.sort(key=lambda p: p[0])  # the best last, so it is taken first
        stack += pairs
    there = best_i != np.iinfo(np.int64).max
    at = np.nonzero(there)
    return at[0], best_i[there], best_s[there]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k highest integer inner
    products with all other rows (all of them, if fewer).

    Components are floor(scale * x), x as double. Rows that are null, hold a null or a non-finite component, or lack an
    id take no part. Only vectors of one length are compared. A candidate row with the query's own id counts as the
    query's own row; a query id on several rows is answered once, from its smallest vector. Repeated candidate rows
    each take a place. Extra columns are ignored; an empty table gives an empty result.

    Both sides are packed into blocks of `block` vectors, and every query block meets every data block by an equi-join
    on the query block's number and a salt of the data block. Python holds two blocks at a time. A ranking window over k
    rows of each data block ends it."""
    spark = vectors.sparkSession
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = (
        vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("id").isNotNull() & ok)
        .select("id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v"))
        .withColumn("dim", F.size("v"))
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one length and query block number as blocks."""
        held: dict[tuple[int, int], list] = {}

        def out(key):
            ids, vs = zip(*held.pop(key), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vs).tobytes()], pa.binary())], names=["dim", "qb", "ids", "vs"])

        for b in batches:
            dims, qbs = np.asarray(b.column(2)), np.asarray(b.column(3))
            for key in sorted(set(zip(dims.tolist(), qbs.tolist(), strict=True))):
                part = b.filter(pa.array((dims == key[0]) & (qbs == key[1])))
                for at in range(0, part.num_rows, block):
                    p = part.slice(at, block)
                    held.setdefault(key, []).append((np.asarray(p.column(0), np.int64), np.asarray(p.column(1).flatten(), np.int64)))
                    if sum(len(i) for i, _ in held[key]) >= block:
                        yield out(key)
        for key in list(held):
            yield out(key)

    shape = "dim int, qb long, ids binary, vs binary"
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = rows.where((F.col("id") % every) == 0)
    blocks = max(1, -(-asked.count() // block))
    salts = max(1, -(-tasks // blocks))  # few query blocks: each is copied, so that its data blocks spread over the tasks
    queries = asked.groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")).withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = (
        queries.repartition(blocks, "qb").mapInArrow(pack, shape)
        .select("dim", "qb", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))
        .repartition(tasks, "dim", "qb", "salt")
    )
    data = (
        rows.withColumn("qb", F.lit(0).cast("long")).mapInArrow(pack, shape)
        .select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int").alias("salt"), "ids", "vs")
        .repartition(tasks, "dim", "qb", "salt")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, q_ids, q_vs, ids, vs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                qi, di = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, i, s = dual_search(np.frombuffer(q_vs, np.int64).reshape(len(qi), dim), qi, np.frombuffer(vs, np.int64).reshape(len(di), dim), di, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    met = data.join(packed, ["dim", "qb", "salt"]).select("dim", "q_ids", "q_vs", "ids", "vs").mapInArrow(search, found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
