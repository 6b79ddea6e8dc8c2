"""Queries of fitted models, loops and readers. Most have no SQL; tests hold them against plain versions or invariants."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import functions as F

from ..operators import clustering, features, joins, loops, metrics
from ..operators import vectors as vo
from ..sources import readers
from ..sources.tables import table
from ..streaming.paragraphs import windowed_counts
from .registry import query

_E = "SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))


def _long(df):
    return df.select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


_S = f"WITH e AS (SELECT id, generate_subscripts(v, 1)::INT - 1 AS pos, unnest(v) AS x FROM ({_E})), s AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS d, min(x) AS lo, max(x) AS hi FROM e GROUP BY 1) SELECT id, pos, "


@query(_S + "round((x - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) AS x FROM e JOIN s USING (pos)")
def standard_scale(spark, sf_dir):
    return _long(features.scale(_rows(spark, sf_dir), "standard"))


@query(_S + "round((x - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 6) AS x FROM e JOIN s USING (pos)")
def minmax_scale(spark, sf_dir):
    return _long(features.scale(_rows(spark, sf_dir), "minmax"))


@query()
def robust_scale(spark, sf_dir):
    return _long(features.scale(_rows(spark, sf_dir), "robust"))


@query(f"SELECT id, i::INT - 1 AS pos, round(v[i] / list_sum(list_transform(v, lambda x: abs(x))), 6) AS x FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM ({_E}))")
def l1_scale(spark, sf_dir):
    return _long(features.scale(_rows(spark, sf_dir), "l1"))


@query(f"SELECT id, i::INT - 1 AS pos, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM (SELECT *, unnest(generate_series(1, len(v))) AS i FROM ({_E}))")
def l2_scale(spark, sf_dir):
    return _long(features.scale(_rows(spark, sf_dir), "l2"))


@query()
def pca(spark, sf_dir):
    return features.pca(_rows(spark, sf_dir), 10)


@query()
def truncated_svd(spark, sf_dir):
    return features.svd(_rows(spark, sf_dir), 10)


@query()
def nmf(spark, sf_dir):
    return features.nmf(_rows(spark, sf_dir), 5, rounds=10)


@query()
def pca_spectrum(spark, sf_dir):
    return features.spectrum(_rows(spark, sf_dir))


@query("WITH e AS (SELECT label AS c, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), g AS (SELECT pos, c, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM e GROUP BY 1, 2), t AS (SELECT *, sum(n * m) OVER (PARTITION BY pos) / sum(n) OVER (PARTITION BY pos) AS mm FROM g), z AS (SELECT pos, sum(n * pow(m - mm, 2)) AS b, sum(n * v) AS w, sum(n) AS n, count(*) AS k FROM t GROUP BY 1) SELECT pos, round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 6) AS ratio FROM z")
def feature_importance(spark, sf_dir):
    return features.importance(_rows(spark, sf_dir))


@query()
def k_means(spark, sf_dir):
    return clustering.k_means(_rows(spark, sf_dir), 10, (42, 43))[0]


@query()
def k_means_cosine(spark, sf_dir):
    return clustering.k_means(_rows(spark, sf_dir), 10, cosine=True)[0]


@query()
def gaussian_mixture(spark, sf_dir):
    return clustering.gaussian_mixture(features.pca(_rows(spark, sf_dir), 5), 5)


@query()
def bisecting_k_means(spark, sf_dir):
    return clustering.bisecting(_rows(spark, sf_dir), 8)


@query()
def dbscan(spark, sf_dir):
    return clustering.dbscan(_rows(spark, sf_dir), 1.1, 4)


@query()
def hdbscan(spark, sf_dir):
    return clustering.hdbscan(_rows(spark, sf_dir), 8)


@query()
def spectral(spark, sf_dir):
    return clustering.spectral_within(_rows(spark, sf_dir), 1.2, 5)


@query(f"WITH e AS ({_E}) SELECT a.id AS a, b.id AS b, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS d FROM e a JOIN e b ON a.id < b.id WHERE sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) <= 1.1")
def eps_neighbours(spark, sf_dir):
    return clustering.near_pairs(_rows(spark, sf_dir), 1.1).withColumn("d", F.round("d", 6))


@query()
def merge_micro_clusters(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    micro = rows.select("id", F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")).alias("cluster"))
    return clustering.merge_clusters(rows.select("id", "v"), micro, 4)


@query()
def k_sweep(spark, sf_dir):
    return clustering.sweep(_rows(spark, sf_dir), [4, 8, 12])


@query()
def gap_statistic(spark, sf_dir):
    return clustering.gap_statistic(_rows(spark, sf_dir), [2, 10], draws=1)


@query()
def bootstrap_stability(spark, sf_dir):
    return clustering.stability(_rows(spark, sf_dir), 10, rounds=2)


@query()
def prediction_strength(spark, sf_dir):
    return clustering.prediction_strength(_rows(spark, sf_dir), 10)


@query("SELECT a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id % 7 = b.vec_id % 7 THEN 1.0 ELSE 0.5 END::DOUBLE AS share FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label UNION ALL SELECT a.vec_id, b.vec_id, 0.5::DOUBLE FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label AND a.vec_id % 7 = b.vec_id % 7")
def consensus_pairs(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return clustering.co_association([rows.select("id", "cluster"), rows.select("id", (F.col("id") % 7).cast("int").alias("cluster"))], 0.5)


@query()
def seed_robustness(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    a, b = (clustering.k_means(rows, 10, (s,))[0] for s in (1, 2))
    return metrics.agreement(a.join(b.withColumnRenamed("cluster", "other"), "id"), "cluster", "other")


@query()
def experiment_grid(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("id", "v")
    steps = {"raw": lambda r: r, "l2": lambda r: features.scale(r, "l2")}
    algorithms = {"k_means": lambda r: clustering.k_means(r, 10)[0], "broken": lambda r: r.select("nothing")}
    return loops.grid(rows, steps, algorithms, lambda r: float(vo.inertia(r).first()[0]))


@query()
def bootstrap_loop(spark, sf_dir):
    train = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("label"))
    pool = joins.remaining(table(spark, sf_dir, "documents").select("doc_id", "text"), train, ["doc_id"])
    folder = _folder()
    keep = lambda df, r: (df.write.parquet(f"{folder}/round-{r}"), spark.read.parquet(f"{folder}/round-{r}"))[1]
    return loops.pseudo_label(train, pool, loops.logistic_scorer(512, 5), keep, 0.9, rounds=2).select("doc_id", "label", "round")


@query("SELECT vec_id AS id, list_position(v, list_max(v))::INT - 1 AS predicted, round(exp(0) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS confidence FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)")
def logits_to_labels(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("id", F.col("v").alias("logits"))
    return loops.predictions(rows).select("id", "predicted", F.round("confidence", 6).alias("confidence"))


@query("SELECT CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS name, pos::INT - 1 AS pos, round(avg(x), 6) AS w FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def weight_average(spark, sf_dir):
    states = _rows(spark, sf_dir).select(F.when(F.col("cluster") < 5, "a").otherwise("b").alias("name"), F.col("v").alias("w"))
    return loops.average_weights(states).select("name", "pos", F.round("w", 6).alias("w"))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN NULL ELSE toxic END IS NULL AS failed, coalesce(CASE WHEN quality = 1 THEN NULL ELSE toxic END, 0) AS score, CASE WHEN quality = 1 THEN 'LLM_error' ELSE 'ok' END AS label FROM labels")
def rating_errors(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") != 1, F.col("toxic")).alias("score"), F.lit("ok").alias("label"))
    return loops.route_errors(rated.withColumn("failed", F.col("score").isNull()))


@query("SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\\S+')) < 30 THEN text ELSE 'long' END AS short FROM documents")
def summary_fallback(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", "text", loops.summary_or_text().alias("s"))
    return s.select("doc_id", F.when(F.regexp_count("text", F.lit(r"\S+")) < 30, F.col("s")).otherwise("long").alias("short"))


@query("SELECT doc_id, floor((row_number() OVER (ORDER BY doc_id) - 1) / ceil(count(*) OVER () / 7.0))::INT AS part FROM documents")
def split_into_parts(spark, sf_dir):
    return loops.parts(table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type AS cluster, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("cluster"), "value"))


# readers and writers, as round trips of the base tables


def _folder() -> str:
    """A folder for a round trip: in spark.checkpoint.dir, or a temporary one in local sessions alone."""
    from pyspark.sql import SparkSession

    conf = SparkSession.getActiveSession().conf
    root, master = conf.get("spark.checkpoint.dir", None), conf.get("spark.master", "")
    if root:
        import uuid

        return f"{root.rstrip('/')}/round-trip-{uuid.uuid4().hex}"
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master!r})")
    folder = tempfile.mkdtemp(prefix="corpusloom-rt-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_lines_round_trip(spark, sf_dir):
    path = f"{_folder()}/rows"
    readers.write_json_lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), path)
    return readers.json_lines(spark, path, "doc_id long, lang string, n_chars long", strict=True)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_parts_round_trip(spark, sf_dir):
    path = f"{_folder()}/rows"
    readers.write_csv_parts(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, 1000)
    return readers.csv_table(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderkey"])


@query("SELECT lang || '_' || source AS paper_id, sum(length(text))::BIGINT AS n FROM documents GROUP BY 1")
def text_sink_round_trip(spark, sf_dir):
    path = f"{_folder()}/papers"
    papers = table(spark, sf_dir, "documents").groupBy(F.concat_ws("/", "lang", "source").alias("paper_id")).agg(F.sum(F.length("text")).cast("string").alias("text"))
    readers.write_texts(papers.where("paper_id LIKE 'en%'"), path)
    readers.write_texts(papers, path)
    return spark.read.parquet(path).select(F.col("paper").alias("paper_id"), F.col("text").cast("long").alias("n"))


@query("SELECT doc_id AS paper_id, 'T ' || lang AS section, 0 AS section_index, 0 AS paragraph_index, len(regexp_extract_all(text, '\\S+')) + 2 AS words FROM documents WHERE len(regexp_extract_all(text, '\\S+')) + 2 >= 25")
def xml_paragraphs(spark, sf_dir):
    esc = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<paper><section><title>T "), "lang", F.lit("</title><para><p>"), esc, F.lit(" <Math tex='\\a{b}'>ab</Math> end</p></para><other><para><p>no</p></para></other></section></paper>"))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.encode(xml, "UTF-8").alias("content"))
    rows = readers.xml_paragraphs(papers)
    return rows.select(F.col("paper_id").cast("long").alias("paper_id"), "section", "section_index", "paragraph_index", F.regexp_count("paragraph", F.lit(r"\S+")).cast("long").alias("words"))


@query("SELECT doc_id AS paper_id, lang AS title, source AS abstract FROM documents")
def xml_front_matter(spark, sf_dir):
    xml = F.concat(F.lit("<paper><Title>"), "lang", F.lit("</Title><abstract>"), "source", F.lit("</abstract></paper>"))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.encode(xml, "UTF-8").alias("content"))
    return readers.xml_front(papers).withColumn("paper_id", F.col("paper_id").cast("long"))


@query("SELECT doc_id AS paper_id, lang AS title, 'by ' || source AS authors FROM documents")
def xml_citations(spark, sf_dir):
    xml = F.concat(F.lit("<paper><bibitem><bibblock>by "), "source", F.lit("</bibblock><text font='italic'>"), "lang", F.lit("</text></bibitem></paper>"))
    papers = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), F.encode(xml, "UTF-8").alias("content"))
    return readers.xml_references(papers).withColumn("paper_id", F.col("paper_id").cast("long"))


@query("SELECT doc_id::VARCHAR AS key, CASE WHEN quality IS NULL THEN 'made' ELSE 'stored' END AS chunks FROM documents LEFT JOIN labels USING (doc_id)")
def token_store_lookup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))
    store = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.lit("stored").alias("chunks"))
    return readers.tokens_or_else(rows, store, F.lit("made"))


@query()
def aligned_confusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return metrics.aligned_confusion(docs, "lang", "source")


@query()
def pipeline_comparison(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return metrics.compare({"given": rows.select("id", "cluster"), "halves": rows.select("id", (F.col("cluster") % 2).alias("cluster")), "rest": rows.select("id", (F.col("id") % 7).alias("cluster"))})


@query()
def perturbation_stability(spark, sf_dir):
    return metrics.perturbed_silhouette(_rows(spark, sf_dir), rounds=1, most=None)


@query()
def hdbscan_search(spark, sf_dir):
    return clustering.hdbscan_search(_rows(spark, sf_dir), [3, 8])


@query()
def mixture_k_means(spark, sf_dir):
    from ..operators import aggregates

    mix = aggregates.mixture(table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("cluster")))
    return clustering.mixture_clusters(mix, ["click", "view", "purchase", "error", "signup"], 4)


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'pending' ELSE 'completed' END AS status, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def job_progress(spark, sf_dir):
    return loops.progress(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT vec_id % 10 AS id, pos::INT - 1 AS pos, round(avg(x), 6) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def window_mean_pooling(spark, sf_dir):
    return _long(loops.pooled(_rows(spark, sf_dir).select((F.col("id") % 10).alias("id"), "v")))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def run_or_load(spark, sf_dir):
    path = f"{_folder()}/step"
    make = lambda: table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    loops.run_or_load(spark, path, make)
    return loops.run_or_load(spark, path, make)


@query("SELECT vec_id AS id, vec_id % 3 AS chunk, len(embedding) AS dim FROM embeddings")
def chunk_folder_scan(spark, sf_dir):
    path = _folder()
    rows = _rows(spark, sf_dir).select("id", "v")
    for c in range(3):
        rows.where(F.col("id") % 3 == c).write.parquet(f"{path}/chunk_{c:04d}")
    return readers.chunk_folders(spark, path).select("id", F.col("chunk").cast("long").alias("chunk"), F.size("v").cast("long").alias("dim"))


@query("SELECT doc_id AS id, max(quality) AS label FROM labels GROUP BY 1")
def label_sink_round_trip(spark, sf_dir):
    path = f"{_folder()}/labels"
    readers.write_pairs(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), path, "id", "label")
    return spark.read.parquet(path)


@query("SELECT doc_id::VARCHAR AS key, array_to_string(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+'), ' ') AS chunks FROM documents")
def token_sink_round_trip(spark, sf_dir):
    path = f"{_folder()}/tokens"
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z][A-Za-z0-9_\-]+"), F.lit(0))
    readers.write_pairs(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), found.alias("chunks")), path, "key", "chunks")
    return spark.read.parquet(path).select("key", F.array_join("chunks", " ").alias("chunks"))


@query("SELECT doc_id, true AS same, 512 AS features FROM documents")
def model_round_trip(spark, sf_dir):
    """Whether a model says the same of every document once it was saved and loaded, and what its configuration says."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), f"{_folder()}/model"
    train = docs.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    model = loops.fit_logistic(train, 512, 5)
    loops.save_model(model, {"features": 512, "rounds": 5}, path)
    loaded, config = loops.load_model(spark, path)
    said = lambda m, name: loops.classify(m, docs).select("doc_id", F.struct("predicted", "confidence").alias(name))
    return said(model, "a").join(said(loaded, "b"), "doc_id").select("doc_id", F.col("a").eqNullSafe(F.col("b")).alias("same"), F.lit(config["features"]).alias("features"))
