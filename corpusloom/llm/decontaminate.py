"""Benchmark decontamination (operator 4): a prefix-filtered join of word shingles, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, column_name

#: Words of a window, and of a shingle, the token of the join.
WINDOW, SHINGLE = 10, 3
#: Up to so many distinct benchmark shingles (or windows) are sent to every executor: some 150 bytes each, 30 MB in all.
#: A larger benchmark is joined by a shuffle.
BROADCAST_ROWS = 200_000

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. ASCII texts take the fast path of lower(), which would fold other letters
    elsewhere."""
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _DOWN))
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(_WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ANY_CASE))


def _small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its number of rows is within the bound; df is staged, so counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _key(size: int, at) -> Column:
    return F.xxhash64(F.lit(size), *[F.element_at("words", at + i) for i in range(size)])


def _shingle(array: str, at, size: int) -> Column:
    return F.concat_ws(" ", *[F.element_at(array, at + i) for i in range(size)])


def windows(benchmark: DataFrame) -> DataFrame:
    """item, w (offset of the window in its item, in words), n (its length), j, size and shingle: every shingle of every
    window. A window has WINDOW words; an item of fewer, but not none, is one window. A shingle has SHINGLE words, or
    those of a shorter window."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("words")).distinct()
    items = items.where(F.size("words") > 0).withColumn("row", F.xxhash64("words"))  # an id may stand on several texts
    items = items.withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    items = items.withColumn("w", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n")))).withColumn("size", F.least(F.col("n"), F.lit(SHINGLE)))
    items = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    return items.select("item", "row", "w", "n", "j", "size", F.array_join(F.slice("words", F.col("w") + F.col("j") + 1, F.col("size")), " ").alias("shingle"))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), item, start, n: the verified occurrences of benchmark windows in documents; start
    counts words from 0."""
    grams = Staged(windows(benchmark), "windows")
    distinct = Staged(grams.df.select("shingle", "size").distinct(), "shingles")
    sizes = sorted(r[0] for r in distinct.df.select("size").distinct().collect())  # at most SHINGLE values
    if not sizes:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("th"), F.lit("").alias("item"), F.lit(0).alias("start"), F.lit(0).alias("n"))
    known = distinct.df.select("shingle", F.col("size").alias("k"), F.split("shingle", " ").alias("ws"))
    known = known.select("shingle", "k", F.expr("CASE k " + " ".join(f"WHEN {s} THEN xxhash64({s}, {', '.join(f'ws[{i}]' for i in range(s))})" for s in sizes) + " END").alias("key"))
    # every place in every text where a benchmark shingle stands
    text = F.col("text").cast("string")
    base = docs.select("doc_id", F.xxhash64(text).alias("th"), words(text).alias("words")).withColumn("total", F.size("words"))
    found = None
    for s in sizes:
        at = base.where(F.col("total") >= s).withColumn("pos", F.explode(F.sequence(F.lit(1), F.col("total") - (s - 1))))
        part = at.withColumn("key", _key(s, F.col("pos"))).join(_small(known.where(F.col("k") == s)), "key").where(_shingle("words", F.col("pos"), s) == F.col("shingle"))
        part = part.select("doc_id", "th", "total", (F.col("pos") - 1).alias("pos"), "shingle")
        found = part if found is None else found.union(part)
    hits = Staged(found, "shingle-hits")
    # rarity over all documents; a window with a shingle that no document has cannot occur
    counts = hits.df.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    each = grams.df.join(counts, "shingle", "left")
    window = ["item", "row", "w", "n"]
    # containment needs every shingle, so the prefix that must be joined is one: the rarest
    prefix = each.groupBy(*window).agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "j")).alias("p"), F.count(F.lit(1)).alias("need")).where("p.df > 0")
    prefix = Staged(prefix.select(*window, "need", F.col("p.shingle").alias("shingle"), F.col("p.j").alias("j")), "prefix")
    tried = hits.df.join(_small(prefix.df), "shingle").withColumn("start", F.col("pos") - F.col("j")).where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("total")))
    # one candidate per place and content: the same window in several items is verified once per item's row
    tried = tried.select("doc_id", "th", *window, "need", "start").distinct()
    # verification: every shingle of the window at its own place
    want = tried.join(_small(grams.df.select(*window, "j", "shingle")), window).withColumn("pos", F.col("start") + F.col("j"))
    here = hits.df.select("doc_id", "th", "pos", "shingle").distinct()  # equal rows of documents count once
    met = want.join(here, (want.doc_id.eqNullSafe(here.doc_id)) & (want.th == here.th) & (want.pos == here.pos) & (want.shingle == here.shingle)).select(want.doc_id, want.th, *window, "need", "start")
    full = met.groupBy("doc_id", "th", *window, "need", "start").agg(F.count(F.lit(1)).alias("there")).where("there = need")
    return full.select("doc_id", "th", "item", "start", "n")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs (doc_id, text).

    Words: runs of letters, digits and characters beyond ASCII, A-Z lower-cased. n_hit: words inside any occurrence of a
    benchmark window; n_items: items with an occurring window; items_sha256: of their ids, sorted as strings and joined
    by commas ('' if none). Null, empty and wordless texts and items have no words and no hits; items without an id are
    left out; an id on several items counts once. Repeated documents get a row each; a null doc_id is a value like
    others. Extra columns are ignored; empty tables give no hits. Texts are read whole, whatever their length."""
    text = F.col("text").cast("string")
    spans = Staged(contaminated_spans(docs, benchmark), "spans").df
    covered = spans.select("doc_id", "th", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct()
    covered = covered.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_hit"))
    items = spans.select("doc_id", "th", "item").distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list("item")).alias("items"))
    marks = covered.join(items, covered.doc_id.eqNullSafe(items.doc_id) & (covered.th == items.th)).select(covered.doc_id.alias("d"), covered.th.alias("h"), "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64(text).alias("th"), n_words(text).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(marks, base.doc_id.eqNullSafe(F.col("d")) & (base.th == F.col("h")), "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark window occurs."""
    d, h = column_name(docs, "d"), column_name(docs, "h")
    spans = contaminated_spans(docs.select("doc_id", "text"), benchmark)
    bad = Staged(spans.select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct(), "contaminated").df
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(h)), "left_anti")
