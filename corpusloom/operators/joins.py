"""Joins with rules of precedence: fallbacks, first or last of duplicates, bands, fuzzy matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def left_with_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    return left.join(right, on, "left").fillna(defaults)


def ordered_fallback(left: DataFrame, right: DataFrame, strategies: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Inner join by the first strategy (a pair of key columns of left and right) that matches any row at all; it then
    holds for the whole table. Adds strategy, from 1. One pass over each side: the keys of all strategies are joined at
    once and the least number that matched anywhere decides."""
    keyed = lambda side, at: side.withColumn("__k", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("s"), s[at].alias("key")) for i, s in enumerate(strategies)])))
    met = keyed(left, 0).join(keyed(right, 1), "__k").where("__k.key IS NOT NULL").withColumn("strategy", F.col("__k.s")).drop("__k")
    best = met.agg(F.min("strategy").alias("__best"))
    return met.join(F.broadcast(best), F.col("strategy") == F.col("__best")).drop("__best")


def row_fallback(left: DataFrame, right: DataFrame, id_column: str, key: str, value: str, default: str = "") -> DataFrame:
    """value of right for each row of left: by the id as it is, else with '_' as '/', else with '/' as '_', else the
    default. One join: each row asks with its distinct forms and the best answer stays."""
    forms = F.array_distinct(F.array(F.col(id_column), F.translate(id_column, "_", "/"), F.translate(id_column, "/", "_")))
    asked = left.withColumn("__form", F.explode_outer(F.transform(forms, lambda x, i: F.struct(i.alias("i"), x.alias("x")))))
    met = asked.join(right.select(F.col(key).alias("__key"), F.col(value).alias("__value")), F.col("__form.x") == F.col("__key"), "left")
    best = met.groupBy(*left.columns).agg(F.min_by("__value", F.when(F.col("__key").isNotNull(), F.col("__form.i"))).alias(value))
    return best.withColumn(value, F.coalesce(value, F.lit(default)))


def last_wins(left: DataFrame, right: DataFrame, on: Sequence[str], order: str) -> DataFrame:
    """Left join to the last row of right for each key."""
    return left.join(first_by(right, on, [F.col(order).desc()]).drop(order), list(on), "left")


def prefix_lookup(left: DataFrame, right: DataFrame, text: str, other: str, n: int = 200) -> DataFrame:
    """Left join on the first n characters; of several rows the smallest id."""
    key = right.select(F.substring(other, 1, n).alias("__p"), F.col("id").alias("match_id")).groupBy("__p").agg(F.min("match_id").alias("match_id"))
    return left.join(key, F.substring(text, 1, n) == F.col("__p"), "left").drop("__p")


#: Ratios that a fuzzy join asks for before the least one. Few edits leave long pieces, which few heads share.
STEPS = (0.93, 0.9, 0.87, 0.84)


def fuzzy(left: DataFrame, right: DataFrame, least: float = 0.8, n: int = 100) -> DataFrame:
    """Left rows (id, text) with the right row (other, other_text) of the greatest Levenshtein ratio on the first n
    characters, if it is above `least`; ties to the smaller id. No pair is lost: all pairs above a high ratio are found
    first, and what has one has its best among them; only the other heads go on to the next lower ratio."""
    if least <= 0.5:
        raise ValueError("pieces are no bound for ratios of one half and less")
    parts = max(32, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: heads are few bytes and much work, so they stay apart
    heads = lambda d, text, name: d.select(F.substring(text, 1, n).alias(name)).where(F.col(name).isNotNull()).repartition(parts, name).distinct()
    first = right.groupBy(F.substring("other_text", 1, n).alias("y")).agg(F.min("other").alias("other"))
    todo, others, best = heads(left, "text", "x").persist(), heads(right, "other_text", "y").persist(), None
    for ratio in [*(r for r in STEPS if r > least), least]:
        met = _alike(todo, others, ratio, n).join(first, "y")
        found = met.groupBy("x").agg(F.min_by(F.struct("other", "ratio"), F.struct(-F.col("ratio"), F.col("other"))).alias("best")).persist()
        best = found if best is None else best.union(found)
        todo = todo.join(found, "x", "left_anti").repartition(parts, "x").persist()
    return left.select("id", F.substring("text", 1, n).alias("x")).join(best, "x").select("id", "best.other", F.round("best.ratio", 6).alias("ratio"))


def _alike(lefts: DataFrame, rights: DataFrame, least: float, n: int) -> DataFrame:
    """x, y, ratio: every pair of heads (x; y) with a ratio above `least`. Such a ratio allows k edits at most, so of c > k
    pieces of the right head c - k stand unchanged in the left head, moved by k places at most. Pieces meet by an
    equi-join on piece and stretch of places; a left head gives pieces of those lengths alone that right heads of like
    length have."""
    parts = max(32, int(lefts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    edits = lambda m: int((1 - least) * min(n, max(m, int(m / least))) + 1e-9)
    width = int((1 - least) * n + 1e-9) + 1  # a stretch of places; k is below it, so a piece moves to the next stretch at most
    k = F.array(*[F.lit(edits(m)) for m in range(n + 1)])
    m = F.length("y")
    sized = rights.withColumn("k", F.get(k, m)).withColumn("q", F.floor(m / (F.col("k") + 1)).cast("int")).withColumn("c", F.when(m > 0, F.floor(m / F.col("q"))).otherwise(1).cast("int"))
    stretch = lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda t: (F.floor(i * F.col("q") / width) + t).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda i: F.struct(i.alias("i"), F.substr("y", i * F.col("q") + 1, F.col("q")).alias("piece"), stretch(i).alias("ats")))
    pieces = sized.select("y", "k", (F.col("c") - F.col("k")).alias("need"), F.explode(cut).alias("p")).select("y", "k", "need", "p.i", "p.piece", F.explode("p.ats").alias("at"))
    lengths = F.array(*[F.array(*[F.lit(q) for q in sorted({j // (edits(j) + 1) for j in range(max(0, size - width), min(n, size + width) + 1)})]) for size in range(n + 1)])
    places = F.sequence(F.lit(0), F.greatest(F.length("x") - 1, F.lit(0)))
    asked = F.flatten(F.transform(places, lambda p: F.transform(F.get(lengths, F.length("x")), lambda q: F.struct(F.substr("x", p + 1, q).alias("piece"), F.floor(p / width).cast("int").alias("at")))))
    asked = F.array_distinct(F.filter(asked, lambda s: (F.length(s.piece) > 0) | (F.length("x") == 0)))
    probes = lefts.select("x", F.explode(asked).alias("p")).select("x", "p.piece", "p.at")
    longer = F.greatest(F.length("x"), F.length("y"), F.lit(1))
    near = F.abs(F.length("x") - F.length("y")) <= F.col("k")
    met = probes.repartition(parts, "piece", "at").join(pieces.repartition(parts, "piece", "at"), ["piece", "at"]).where(near).groupBy("x", "y", "need").agg(F.count_distinct("i").alias("kept")).where("kept >= need")
    met = met.withColumn("d", F.levenshtein("x", "y", width)).where("d >= 0")
    return met.withColumn("ratio", 1 - F.col("d") / longer).where(F.col("ratio") > least).select("x", "y", "ratio")


def cross_pairs(scored: DataFrame, partners: int = 3) -> DataFrame:
    """Pairs of papers of a family (family, paper_id, score): each with the next `partners` in the order of score
    (greatest first, ties by id). A band join on the rank, written as an equi-join on it."""
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.col("score").desc(), "paper_id")))
    a = ranked.withColumn("want", F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + partners)))
    b = ranked.select("family", F.col("rn").alias("want"), F.col("paper_id").alias("paper_b"), F.col("score").alias("score_b"))
    return a.join(b, ["family", "want"]).select("family", F.col("paper_id").alias("paper_a"), "paper_b", F.least("score", "score_b").alias("confidence"))


def unordered_key(a, b) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.sha1(F.array_join(F.array_sort(F.array(a, b)), "||"))


def kv_merge(stores: Sequence[DataFrame], last: bool = True) -> DataFrame:
    """key, value of several stores; of equal keys the last store's (or the first's). Within a store the greatest value
    stands for a repeated key."""
    parts = [s.groupBy("key").agg(F.max("value").alias("value")).withColumn("__o", F.lit(i)) for i, s in enumerate(stores)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg((F.max_by if last else F.min_by)("value", "__o").alias("value"))


def align(ids: DataFrame, texts: DataFrame, key: str, order: str) -> DataFrame:
    """Left join to the first text of each key, with a hit flag."""
    one = first_by(texts, [key], [F.col(order)]).withColumn("hit", F.lit(True))
    return ids.join(one, key, "left").fillna({"hit": False})


def remaining(todo: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    return todo.join(done, list(on), "left_anti")


def move(train: DataFrame, pool: DataFrame, chosen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The chosen rows go from the pool to the training rows."""
    return train.unionByName(pool.join(chosen.select(key), key, "left_semi")), pool.join(chosen.select(key), key, "left_anti")


def gather(picked: DataFrame, metadata: DataFrame, abstracts: DataFrame) -> DataFrame:
    """cluster_id, papers: for clusters with an array of picked indices, their papers with abstracts, in index order."""
    rows = picked.select("cluster_id", F.explode("picked").alias("idx")).join(metadata, "idx").join(abstracts, "paper_id", "left")
    item = F.struct("idx", "paper_id", F.coalesce("abstract", F.lit("Abstract not found")).alias("abstract"))
    return rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(item)).alias("papers"))
