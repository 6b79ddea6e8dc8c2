"""Filters, labels and keys over rows of texts and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

# fixed values: the default headings and phrases of the methodology rule
HEADINGS = ("method", "approach", "observations", "data reduction", "instrumentation", "analysis", "procedure", "data processing", "experimental setup", "technique", "telescope configuration", "modelling", "measurement", "pipeline")
PHRASES = (r"\bwe observed\b", r"\bdata (were|was) collected\b", r"\bspectra (were|was) reduced\b", r"\bmodel(l)?ed\b", r"\bwe derived\b", r"\bdata analysis (was|were)? performed\b", r"\bexposure time\b", r"\buncertainty estimation\b")


def heuristic_label(heading: Column, text: Column, headings: Sequence[str] = HEADINGS, phrases: Sequence[str] = PHRASES) -> Column:
    """'methodology' if the lower-cased heading holds any of the headings, or the text any phrase; else
    'not_methodology'. The phrases are one fused pattern."""
    low = F.lower(F.coalesce(heading, F.lit("")))
    named = F.lit(False)
    for h in headings:
        named = named | F.contains(low, F.lit(h))
    said = F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(phrases))
    return F.when(named | said, "methodology").otherwise("not_methodology")


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Count and percentage of each value."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(column, "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


def least_words(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(tx.n_words(F.col("text")) >= n)


def method_paragraphs(papers: DataFrame, least: int = 200) -> DataFrame:
    """paper_id, para_id, text of the cleaned paragraphs of `least` characters; para_id counts survivors."""
    parts = papers.select("paper_id", F.posexplode(tx.paragraphs(F.col("text"), least)).alias("i", "text"))
    return parts.select("paper_id", F.format_string("%s::p%04d", F.col("paper_id").cast("string"), "i").alias("para_id"), "text")


def keep_methodology(rows: DataFrame) -> DataFrame:
    """Rows whose prediction, or else label, is 'methodology' or 1."""
    return rows.where(F.coalesce(F.col("predicted_label").cast("string"), F.col("label").cast("string")).isin("methodology", "1"))


def char_limit(rows: DataFrame, most: int) -> DataFrame:
    """doc_id, n, place of the texts of `most` characters at most, shortest first (ties by doc_id). The place is global,
    so the ranking is over the short texts alone."""
    short = rows.select("doc_id", F.length("text").cast("long").alias("n")).where(F.col("n") <= most)
    return short.withColumn("place", F.row_number().over(Window.orderBy("n", "doc_id")).cast("long"))


def confident(scored: DataFrame, threshold: float, least: int | None = None, most: int | None = None) -> DataFrame:
    """Rows of a confidence above the threshold. With `least`: none at all if there are fewer; with `most`: the most
    confident (ties by doc_id)."""
    rows = scored.where(F.col("confidence") > threshold)
    if least is not None and least > 1:  # one row or none: nothing to count, which would score all rows again
        enough = rows.agg((F.count(F.lit(1)) >= least).alias("enough"))
        rows = rows.join(F.broadcast(enough.where("enough")), how="cross").drop("enough")
    if most is not None:
        rows = rows.orderBy(F.col("confidence").desc(), "doc_id").limit(most)
    return rows


def not_noise(assigned: DataFrame) -> DataFrame:
    return assigned.where(F.col("cluster") >= 0)


def top_scored(rows: DataFrame, least: float, most: int) -> DataFrame:
    """The `most` rows of the greatest score among those of `least` and more (ties by cluster_id)."""
    return rows.where(F.col("score") >= least).orderBy(F.col("score").desc(), "cluster_id").limit(most)


def status(text: Column) -> Column:
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "empty").otherwise("process")


def clean_truth(rows: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """Rows with an id and a value, and id_clean without the prefix 'arXiv:'."""
    kept = rows.where(F.col(id_column).isNotNull() & (F.trim(id_column) != "") & F.col(value_column).isNotNull() & (F.trim(value_column) != ""))
    return kept.withColumn("id_clean", F.trim(F.regexp_replace(id_column, "arXiv:", "")))


def composite_key(*columns) -> Column:
    return F.concat_ws("|", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def safe_id(column: Column) -> Column:
    return F.translate(column, "/", "_")


def label_code(column: Column, codes: Mapping[str, int]) -> Column:
    """The code of a label; null for others."""
    out = F.lit(None).cast("int")
    for label, code in codes.items():
        out = F.when(column == label, code).otherwise(out)
    return out


def coerce(rows: DataFrame, names: Mapping[str, str], kinds: Mapping[str, str], defaults: Mapping[str, object], need: Sequence[str]) -> DataFrame:
    """Columns renamed, cast where the value allows it (else null), missing ones added with a default, and rows without
    the needed ones dropped."""
    out = rows.withColumnsRenamed(dict(names))
    for c, v in defaults.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(v))
    return out.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items()}).na.drop(subset=list(need))


def validate(rows: DataFrame, need: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """One row: rows, missing columns, and for the numeric columns the counts of nulls, negatives and zeros."""
    missing = [c for c in need if c not in rows.columns]
    there = [c for c in numbers if c in rows.columns]
    total = lambda f: sum((F.count_if(f(F.col(c))) for c in there), F.lit(0).cast("long"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(",".join(missing)).alias("missing"),
        total(lambda c: c.isNull()).alias("n_null"),
        total(lambda c: c < 0).alias("n_negative"),
        total(lambda c: c == 0).alias("n_zero"),
    )
