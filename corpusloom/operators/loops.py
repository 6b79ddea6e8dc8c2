"""Supervised steps and loops: a classifier slot, splits, pseudo-labelling, experiment grids, weight averages."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from .filters import confident
from .joins import move
from .ranking import row_numbers

Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def logistic_scorer(features: int = 1 << 12, rounds: int = 20) -> Scorer:
    """The default slot: (train with label, rows) -> rows with predicted and confidence, by hashed words and logistic
    regression."""

    return lambda train, rows: classify(fit_logistic(train, features, rounds), rows)


def fit_logistic(train: DataFrame, features: int = 1 << 12, rounds: int = 20) -> PipelineModel:
    """A model of label by the hashed words of text."""
    stages = [HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(maxIter=rounds, regParam=0.01)]
    return Pipeline(stages=stages).fit(train.withColumn("words", tx.tokens(F.col("text"))))


def classify(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with predicted and confidence."""
    p = vector_to_array("probability")
    scored = model.transform(rows.withColumn("words", tx.tokens(F.col("text"))))
    return scored.withColumns({"predicted": vx.argmax(p), "confidence": F.array_max(p)}).drop("words", "features", "rawPrediction", "probability", "prediction")


def save_model(model: PipelineModel, config: Mapping[str, object], path: str) -> None:
    """The model and its configuration (values that JSON holds) in one folder, over what is there."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(dict(config), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/config").first().value)


def pseudo_label(train: DataFrame, pool: DataFrame, scorer: Scorer, keep: Callable[[DataFrame, int], DataFrame], threshold: float = 0.95, least: int = 1, most: int | None = None, rounds: int = 3) -> DataFrame:
    """train grown by the pool's confident predictions: train, score, filter, move, until a round finds fewer than
    `least`. keep(df, round) stores and returns a table, which cuts the lineage. Adds round, 0 for the given rows."""
    train = train.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        scored = keep(confident(scorer(train, pool), threshold, least, most), r)
        if scored.isEmpty():
            break
        chosen = scored.select("doc_id", "text", F.col("predicted").cast("int").alias("label"), F.lit(r).alias("round"))
        train, pool = train.unionByName(chosen), move(train.select("doc_id"), pool.select("doc_id"), chosen, "doc_id")[1].join(pool, "doc_id")
    return train


def predictions(logits: DataFrame) -> DataFrame:
    """predicted and confidence from an array of logits."""
    p = vx.softmax(F.col("logits"))
    return logits.withColumns({"predicted": vx.argmax(p), "confidence": F.array_max(p)})


def average_weights(states: DataFrame) -> DataFrame:
    """name, pos, w: the elementwise mean of the weights (name, w array) of several models."""
    return states.select("name", F.posexplode("w").alias("pos", "w")).groupBy("name", "pos").agg(F.avg("w").alias("w"))


def grid(rows: DataFrame, steps: Mapping[str, Callable[[DataFrame], DataFrame]], algorithms: Mapping[str, Callable[[DataFrame], DataFrame]], measure: Callable[[DataFrame], float]) -> DataFrame:
    """A row for each preprocessing and algorithm: the measure of its clusters, or the error it ended with."""
    out = []
    for s, prepare in steps.items():
        for a, cluster in algorithms.items():
            try:
                ready = prepare(rows)
                out.append((s, a, measure(ready.join(cluster(ready), "id")), None))
            except Exception as e:  # noqa: BLE001  a failed experiment is a result
                out.append((s, a, None, type(e).__name__))
    return rows.sparkSession.createDataFrame(out, "preprocessing string, algorithm string, value double, error string")


def summary_or_text(words: int = 30):
    """The summary slot's rule: texts of fewer words stay as they are; of others the leading fifth of the sentences."""
    sentences = F.split("text", r"(?<=[.!?])\s+")
    lead = F.array_join(F.slice(sentences, 1, F.greatest(F.lit(1), F.ceil(F.size(sentences) * 0.2).cast("int"))), " ")
    return F.when(tx.n_words(F.col("text")) < words, F.col("text")).otherwise(lead)


def route_errors(rated: DataFrame) -> DataFrame:
    """A rating that failed (null score) becomes 0 with the label LLM_error."""
    return rated.withColumns({"label": F.when(F.col("score").isNull(), "LLM_error").otherwise(F.col("label")), "score": F.coalesce("score", F.lit(0))})


def parts(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Adds part: n parts of equal length in the order of a numeric key, the last one shorter."""
    size = rows.agg(F.ceil(F.count(F.lit(1)) / n).alias("__size"))
    return row_numbers(rows, key, "__at").join(F.broadcast(size)).withColumn("part", F.floor((F.col("__at") - 1) / F.col("__size")).cast("int")).drop("__at", "__size")


def run_or_load(spark, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at a path, made and written there if it is not complete (or if forced)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if force or not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def progress(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """status, n: how many of the keys are completed and how many pending."""
    met = todo.select(key).join(done.select(key, F.lit("completed").alias("status")), key, "left")
    return met.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pooled(windows: DataFrame) -> DataFrame:
    """id, v: the mean of a text's window vectors (id, v)."""
    mean = windows.select("id", F.posexplode("v").alias("pos", "x")).groupBy("id", "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p.x).alias("v"))
