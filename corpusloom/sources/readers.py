"""Readers and writers of the formats the analysis takes in and gives out."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARAGRAPH = "paper_id string, section string, section_index int, paragraph_index int, paragraph string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """paper_id, path from a JSON object of paths by id."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("paper_id", "path"))


def flat_text(element: ET.Element | None) -> str:
    """The text below an element with its tail, parts trimmed and joined by spaces; a formula as [MATH_tex=...] of its
    tex attribute without backslashes and braces, and nothing of its own text."""
    if element is None:
        return ""
    out: list[str] = []
    todo: list[tuple[ET.Element, bool]] = [(element, False)]
    while todo:
        e, closing = todo.pop()
        if closing:
            out.append((e.tail or "").strip())
            continue
        if isinstance(e.tag, str) and e.tag.lower() == "math":
            tex = re.sub(r"[\\{}]", "", e.get("tex", "").strip())
            out.append(f"[MATH_tex={tex}]" if tex else "")
        else:
            out.append((e.text or "").strip())
        todo.append((e, True))
        todo += [(c, False) for c in reversed(e)]
    return " ".join(p for p in out if p)


def paper_paragraphs(paper_id: str, content: bytes, least: int = 25) -> list[tuple]:
    """Rows of PARAGRAPH: sections at every depth in document order, their direct para elements, and of those the direct
    p elements; paragraphs of fewer words are left out. XML that does not parse gives none."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return []
    out = []
    for i, section in enumerate(root.iter("section")):
        title = flat_text(section.find("title"))
        for j, para in enumerate(section.findall("para")):
            text = " ".join(flat_text(p) for p in para.findall("p"))
            if len(text.split()) >= least:
                out.append((paper_id, title, i, j, text))
    return out


def xml_paragraphs(papers: DataFrame, least: int = 25) -> DataFrame:
    """Paragraphs of XML papers (paper_id, content binary)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARAGRAPH.split(", ")]
        for f in frames:
            rows = [r for p, c in zip(f["paper_id"], f["content"], strict=True) for r in paper_paragraphs(p, bytes(c), least)]
            yield pd.DataFrame(rows, columns=names)

    return papers.select("paper_id", "content").mapInPandas(run, PARAGRAPH)


def xml_files(spark: SparkSession, path: str, suffix: str = ".xml") -> DataFrame:
    """paper_id (the file's stem), content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*" + suffix).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("paper_id"), "content")


def xml_front(papers: DataFrame) -> DataFrame:
    """paper_id, title, abstract: the root's child of that name, in any case; their text without separators."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["paper_id"], f["content"], strict=True):
                try:
                    root = ET.fromstring(bytes(c))
                except ET.ParseError:
                    continue
                found = {}
                for want in ("title", "abstract"):
                    e = root.find(want)
                    if e is None:
                        e = next((k for k in root if isinstance(k.tag, str) and k.tag.lower() == want), None)
                    found[want] = "".join(e.itertext()).strip() if e is not None else ""
                rows.append((p, found["title"], found["abstract"]))
            yield pd.DataFrame(rows, columns=["paper_id", "title", "abstract"])

    return papers.select("paper_id", "content").mapInPandas(run, "paper_id string, title string, abstract string")


def xml_references(papers: DataFrame) -> DataFrame:
    """paper_id, title, authors of every bibitem: the text in italics and the block of the bibliography."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["paper_id"], f["content"], strict=True):
                try:
                    items = ET.fromstring(bytes(c)).iter("bibitem")
                    for item in items:
                        italic = next((e for e in item.iter() if e.get("font") == "italic" or e.tag == "emph"), None)
                        block = item.find(".//bibblock")
                        rows.append((p, "".join(italic.itertext()).strip() if italic is not None else None, "".join(block.itertext()).strip() if block is not None else None))
                except ET.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["paper_id", "title", "authors"])

    return papers.select("paper_id", "content").mapInPandas(run, "paper_id string, title string, authors string")


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """JSON lines. strict: a bad line ends the read; else blank and malformed lines are left out, and a file without any
    good line is an error."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if rows.isEmpty():
        raise ValueError(f"no valid line in {path}")
    return rows


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """paper_id (the stem), text of the .txt files of a folder."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(.*)\.txt$", 1).alias("paper_id"), F.col("value").alias("text"))


def csv_table(spark: SparkSession, path: str | list[str], schema: str, need: Sequence[str] = ()) -> DataFrame:
    """A CSV file, folder or glob with a header; a missing needed column is an error before any row is read."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in need if c not in header]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """row, v: the rows of .npy files (file name, then place), read whole file by file; pickled content is refused."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, c in zip(f["path"], f["content"], strict=True):
                x = np.load(io.BytesIO(c), allow_pickle=False)
                yield pd.DataFrame({"file": p.rsplit("/", 1)[-1], "row": np.arange(len(x)), "v": list(x.astype(float))})

    return files.select("path", "content").mapInPandas(run, "file string, row long, v array<double>")


def chunk_folders(spark: SparkSession, path: str) -> DataFrame:
    """id, v, chunk from Parquet folders chunk_0000, chunk_0001...; vectors of unequal length are an error."""
    rows = spark.read.parquet(f"{path}/chunk_[0-9][0-9][0-9][0-9]").withColumn("chunk", F.regexp_extract(F.col("_metadata.file_path"), r"chunk_(\d{4})", 1).cast("int"))
    sizes = rows.select(F.size("v").alias("n")).distinct().limit(2).collect()
    if len(sizes) != 1:
        raise ValueError(f"{path} has no vectors of one length")
    return rows


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, label from .csv (id, label), .json (an object, or one under 'labels', 'y' or 'cluster_labels') or .npy."""
    if path.endswith(".csv"):
        return csv_table(spark, path, "id string, label int", ["id", "label"])
    if path.endswith(".npy"):
        return matrix(spark, path).select(F.col("row").cast("string").alias("id"), F.element_at("v", 1).cast("int").alias("label"))
    if path.endswith(".json"):
        text = spark.read.text(path, wholetext=True)
        inner = F.coalesce(*[F.get_json_object("value", f"$.{k}") for k in ("labels", "y", "cluster_labels")], F.col("value"))
        return text.select(F.explode(F.from_json(inner, "map<string,int>")).alias("id", "label"))
    raise ValueError(f"no reader for {path}")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv_parts(rows: DataFrame, path: str, most: int = 100_000) -> None:
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", most).csv(path)


def write_texts(rows: DataFrame, path: str) -> int:
    """Append the papers (paper_id, text) that the folder lacks, a partition each; returns how many were written."""
    spark = rows.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    safe = rows.withColumn("paper", F.translate("paper_id", "/", "_")).select("paper", "text")
    if there:
        safe = safe.join(spark.read.parquet(path).select(F.col("paper").cast("string").alias("paper")), "paper", "left_anti")
    safe = safe.persist()
    n = safe.count()
    safe.write.mode("append").partitionBy("paper").parquet(path)
    safe.unpersist()
    return n


def write_pairs(rows: DataFrame, path: str, key: str, value: str) -> None:
    """A store of key and value (labels, tokens): Parquet in ranges of the key, sorted, so that a lookup reads few row
    groups. The greatest value stands for a repeated key; rows without a key are left out."""
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value))
    one.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def tokens_or_else(rows: DataFrame, store: DataFrame, make) -> DataFrame:
    """chunks of each row by key from a store (key, chunks), computed where the store lacks them."""
    return rows.join(store, "key", "left").withColumn("chunks", F.coalesce("chunks", make))


def latex_table(rows: DataFrame, columns: Sequence[str], most: int = 100) -> str:
    """A LaTeX table of the first rows: presentation, so a bounded number comes to the driver."""
    from ..functions.text import escape_latex

    data = rows.select(*[escape_latex(F.col(c).cast("string")).alias(c) for c in columns]).limit(most).collect()
    body = " \\\\\n".join(" & ".join(str(x) for x in r) for r in data)
    return "\\begin{tabular}{" + "l" * len(columns) + "}\n" + " & ".join(columns) + " \\\\\n\\hline\n" + body + " \\\\\n\\end{tabular}"


def markdown_table(rows: DataFrame, columns: Sequence[str], most: int = 100) -> str:
    data = rows.select(*columns).limit(most).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(str(x) for x in r) + " |" for r in data]])
