"""Queries with joins, aggregations, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as ag
from ..operators import clusters, filters, joins, ranking, terms
from ..sources.tables import assignments, table
from .profile_queries import ASSIGN
from .registry import query

_MIX = "SELECT paper_id, cluster, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY paper_id), 6) AS prop FROM (SELECT user_id AS paper_id, event_type AS cluster FROM events) GROUP BY paper_id, cluster"
_PROFILE = f"SELECT paper_id, round(count(*) FILTER (cluster = -1) / count(*)::DOUBLE, 6) AS noise_ratio FROM ({ASSIGN}) GROUP BY paper_id"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("cluster"), "event_id", "value")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_concat(spark, sf_dir):
    return ag.ordered_concat(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'signup') AS signup FROM events GROUP BY user_id")
def crosstab_events(spark, sf_dir):
    return ag.crosstab(table(spark, sf_dir, "events"), "user_id", "event_type", ["click", "view", "purchase", "error", "signup"])


@query(f"SELECT count(*) FILTER (alone) AS isolates, count(*) AS papers, round(100 * count(*) FILTER (alone) / count(*)::DOUBLE, 6) AS percent FROM (SELECT paper_id, bool_and(cluster = -1) AS alone FROM ({ASSIGN}) GROUP BY paper_id)")
def isolate_papers(spark, sf_dir):
    return ag.isolates(assignments(spark, sf_dir))


def _bag_sql(exclude: bool) -> str:
    base = "greatest(count(*) FILTER (cluster <> -1), 1)" if exclude else "count(*)"
    cols = ", ".join(f'round(count(*) FILTER (cluster = {c}) / {base}::DOUBLE, 6) AS "cluster_{c}"' for c in range(-1, 10) if c != 0 and not (exclude and c == -1))
    return f"SELECT paper_id, count(*) AS total_paragraphs, count(*) FILTER (cluster = -1) AS noise_paragraphs, round(count(*) FILTER (cluster = -1) / count(*)::DOUBLE, 6) AS noise_ratio, count(DISTINCT cluster) FILTER (cluster <> -1) AS unique_clusters, count(*) FILTER (cluster <> -1) AS non_noise_paragraphs, {cols} FROM ({ASSIGN}) GROUP BY paper_id"


@query(_bag_sql(False))
def bag_of_clusters(spark, sf_dir):
    return ag.bag_of_clusters(assignments(spark, sf_dir), [-1, *range(1, 10)])


@query(_bag_sql(True))
def bag_without_noise(spark, sf_dir):
    return ag.bag_of_clusters(assignments(spark, sf_dir), [-1, *range(1, 10)], exclude_noise=True)


@query(f"SELECT t AS threshold, count(*) FILTER (noise_ratio >= t) AS n, round(100 * avg((noise_ratio >= t)::INT), 6) AS percent, round(avg(noise_ratio), 6) AS mean, round(median(noise_ratio), 6) AS median, round(stddev_samp(noise_ratio), 6) AS std FROM ({_PROFILE}), (SELECT unnest([0.5, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS t) GROUP BY t")
def noise_thresholds(spark, sf_dir):
    return ag.noise_thresholds(clusters.profile(assignments(spark, sf_dir)))


@query(f"SELECT paper_id, noise_ratio, CASE WHEN noise_ratio = 1 THEN -2 ELSE 0 END AS mark FROM ({_PROFILE})")
def full_noise_mark(spark, sf_dir):
    return clusters.profile(assignments(spark, sf_dir)).select("paper_id", "noise_ratio", F.when(F.col("noise_ratio") == 1, -2).otherwise(0).alias("mark"))


@query(f"SELECT para_id, cluster FROM ({ASSIGN}) WHERE cluster >= 0")
def noise_mask(spark, sf_dir):
    return filters.not_noise(assignments(spark, sf_dir)).select("para_id", "cluster")


@query(f"WITH s AS (SELECT cluster, count(*) AS n FROM ({ASSIGN}) GROUP BY cluster) SELECT sum(n)::BIGINT AS n_points, count(*) FILTER (cluster <> -1) AS n_clusters, coalesce(sum(n) FILTER (cluster = -1), 0)::BIGINT AS n_noise, round(100 * coalesce(sum(n) FILTER (cluster = -1), 0) / sum(n), 6) AS noise_percent, round(avg(n) FILTER (cluster <> -1), 6) AS mean_size, median(n) FILTER (cluster <> -1) AS median_size, min(n) FILTER (cluster <> -1) AS min_size, max(n) FILTER (cluster <> -1) AS max_size FROM s")
def cluster_summary(spark, sf_dir):
    return ag.cluster_summary(assignments(spark, sf_dir))


@query("""
WITH p AS (SELECT source AS cluster, lang AS paper_id, count(*) AS k, sum(length(text)) AS l, sum(length(text)::DOUBLE * length(text)) AS q FROM documents GROUP BY 1, 2)
SELECT cluster, sum(k)::BIGINT AS size, count(*) AS papers, round(sum(l) / sum(k)::DOUBLE, 4) AS mean_length, round(sqrt(greatest(sum(q) / sum(k)::DOUBLE - (sum(l) / sum(k)::DOUBLE) * (sum(l) / sum(k)::DOUBLE), 0)), 4) AS std_length,
       round(avg(k), 6) AS mean_per_paper, max(k) AS max_per_paper, min(k) AS min_per_paper, round(sum(k) / count(*)::DOUBLE, 2) AS papers_per_para FROM p GROUP BY cluster
""")
def cluster_characteristics(spark, sf_dir):
    return ag.cluster_characteristics(table(spark, sf_dir, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("paper_id"), "text"))


@query(_MIX)
def mixture(spark, sf_dir):
    return ag.mixture(_events(spark, sf_dir))


@query(f"SELECT paper_id, cluster, count, prop FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY prop DESC, cluster) AS rn FROM ({_MIX})) WHERE rn = 1")
def dominant_topic(spark, sf_dir):
    return ranking.dominant(ag.mixture(_events(spark, sf_dir)))


@query(f"SELECT cluster, c_mktsegment, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY prop DESC, cluster) AS rn FROM ({_MIX})) d JOIN customer ON d.paper_id = c_custkey WHERE rn = 1 GROUP BY ALL")
def topic_by_label(spark, sf_dir):
    top = ranking.dominant(ag.mixture(_events(spark, sf_dir)))
    return top.join(table(spark, sf_dir, "customer"), F.col("paper_id") == F.col("c_custkey")).groupBy("cluster", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


_RATED = "SELECT 'm' || (doc_id % 2) AS method, CAST(doc_id % 3 AS INT) AS K, CAST(doc_id % 17 AS INT) AS cluster_id, (quality * 3 + toxic + doc_id % 3)::DOUBLE AS rating, doc_id % 17 * 10 AS cluster_size FROM labels"


def _rated(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("m"), (d % 2).cast("string")).alias("method"), (d % 3).cast("int").alias("K"), (d % 17).cast("int").alias("cluster_id"), (F.col("quality") * 3 + F.col("toxic") + d % 3).cast("double").alias("rating"), (d % 17 * 10).alias("cluster_size"))


@query(f"SELECT method, K, cluster_id, count(rating) AS n, round(avg(rating), 6) AS rating_mean, median(rating) AS rating_median, round(stddev_samp(rating), 6) AS rating_std, min(cluster_size) AS cluster_size FROM ({_RATED}) GROUP BY method, K, cluster_id")
def ratings_by_cluster(spark, sf_dir):
    r = ag.ratings_by_cluster(_rated(spark, sf_dir))
    return r.withColumns({"rating_mean": F.round("rating_mean", 6), "rating_std": F.round("rating_std", 6)})


@query(f"""
WITH c AS (SELECT method, K, cluster_id, avg(rating) AS r, min(cluster_size) AS s FROM ({_RATED}) GROUP BY ALL),
z AS (SELECT DISTINCT method, K, g AS cluster_id, g * 10 AS n FROM (SELECT DISTINCT method, K FROM c), (SELECT unnest(range(20)) AS g)),
a AS (SELECT method, K, count(*) AS n_clusters_rated, round(avg(r), 6) AS mean_rating, round(median(r), 6) AS median_rating, round(stddev_samp(r), 6) AS std_rating, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr_rating,
   round(avg((r <= 2)::INT), 6) AS frac_low, round(avg((r >= 4)::INT), 6) AS frac_high, median(s) AS median_cluster_size, round(sum(r * s) / nullif(sum(s), 0), 6) AS size_weighted_mean FROM c GROUP BY ALL),
v AS (SELECT z.method, z.K, round(count(c.cluster_id) / count(*)::DOUBLE, 6) AS coverage_clusters, round(sum(CASE WHEN c.cluster_id IS NOT NULL THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS coverage_points, count(*) AS total_clusters FROM z LEFT JOIN c USING (method, K, cluster_id) GROUP BY ALL)
SELECT * FROM a LEFT JOIN v USING (method, K)
""")
def rating_summary(spark, sf_dir):
    by = ag.ratings_by_cluster(_rated(spark, sf_dir))
    sizes = by.select("method", "K").distinct().withColumn("cluster_id", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("n", F.col("cluster_id") * 10)
    return ag.rating_summary(by, sizes)


@query(f"""
WITH s AS (SELECT cluster, count(*) AS n FROM ({ASSIGN}) WHERE cluster >= 0 GROUP BY cluster), t AS (SELECT *, n / sum(n) OVER () AS p FROM s)
SELECT count(*) AS n_clusters, sum(n)::BIGINT AS n_points, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size, round(var_pop(n), 6) AS var_size, min(n) AS min_size, max(n) AS max_size, round(stddev_pop(n) / avg(n), 6) AS variation,
       round(-sum(p * ln(p)), 6) AS entropy, round(max(p), 6) AS largest_share, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS median_size, quantile_cont(n, 0.75) AS q75 FROM t
""")
def size_balance(spark, sf_dir):
    return ag.size_balance(assignments(spark, sf_dir))


@query("SELECT label, count(*) AS papers, array_to_string(list(paper_id ORDER BY paper_id)[1:5], ',') AS first_ids FROM (SELECT DISTINCT event_type AS label, user_id AS paper_id FROM events) GROUP BY label")
def label_papers(spark, sf_dir):
    return ag.label_papers(table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("user_id").alias("paper_id")))


@query("SELECT count(*) FILTER (NOT bad) AS valid, count(*) FILTER (bad) AS failed, round(avg(v) FILTER (NOT bad), 6) AS mean_v FROM (SELECT event_type = 'error' OR event_id % 10 = 0 AS bad, value AS v FROM events)")
def metric_averages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when((F.col("event_type") == "error") | (F.col("event_id") % 10 == 0), "x").alias("evaluation_error"), F.col("value").alias("v"))
    return ag.metric_averages(e, ["v"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(median(value), 6) AS median, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY event_type")
def score_statistics(spark, sf_dir):
    return ag.describe_by(table(spark, sf_dir, "events"), ["event_type"], "value")


@query(f"SELECT sum(k)::BIGINT AS total, round(avg(k), 6) AS mean, max(k) AS max, min(k) AS min FROM (SELECT paper_id, count(*) AS k FROM ({ASSIGN}) GROUP BY paper_id)")
def paragraphs_per_paper(spark, sf_dir):
    return ag.per_paper(assignments(spark, sf_dir))


def _purity_sql(a: str, b: str) -> str:
    return f"WITH t AS (SELECT {a}, {b}, count(*) AS n FROM documents GROUP BY 1, 2), w AS (SELECT *, sum(n) OVER (PARTITION BY {a})::BIGINT AS total, sum(n) OVER (PARTITION BY {b}) AS oc, row_number() OVER (PARTITION BY {a} ORDER BY n DESC, {b}) AS rn, count(*) OVER (PARTITION BY {a}) AS spans FROM t) SELECT {a}, {b} AS dominant, total, n AS dominant_count, round(n / total, 6) AS purity, round(n / oc, 6) AS coverage, spans FROM w WHERE rn = 1"


@query(_purity_sql("lang", "source"))
def category_purity(spark, sf_dir):
    return ag.category_purity(table(spark, sf_dir, "documents"), "lang", "source")


@query(_purity_sql("source", "lang"))
def cluster_purity(spark, sf_dir):
    return ag.category_purity(table(spark, sf_dir, "documents"), "source", "lang")


@query("""
WITH e AS (SELECT event_type AS name, avg(value) AS silhouette, stddev_samp(value) AS davies FROM events GROUP BY 1)
SELECT 'silhouette' AS metric, name, round(silhouette, 6) AS value FROM (SELECT * FROM e ORDER BY silhouette DESC, name LIMIT 1)
UNION ALL SELECT 'davies', name, round(davies, 6) FROM (SELECT * FROM e ORDER BY davies, name LIMIT 1)
""")
def best_experiments(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("silhouette"), F.stddev_samp("value").alias("davies"))
    return ag.best_experiments(e, ["silhouette"], ["davies"])


@query("""
WITH r AS (SELECT DISTINCT doc_id, lower(t) AS term, lang AS family FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM documents)),
n AS (SELECT count(DISTINCT doc_id) AS total FROM r), t AS (SELECT term, count(DISTINCT doc_id) AS df FROM r GROUP BY 1 HAVING df >= 20), f AS (SELECT family, count(DISTINCT doc_id) AS fdf FROM r GROUP BY 1), b AS (SELECT term, family, count(*) AS co FROM r GROUP BY 1, 2)
SELECT term, family, df, co, round(log2(co * total / (df * fdf)::DOUBLE), 6) AS pmi FROM b JOIN t USING (term) JOIN f USING (family), n WHERE round(log2(co * total / (df * fdf)::DOUBLE), 6) >= 1.0
""")
def lexicon_pmi(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    d = d.select("doc_id", F.col("lang").alias("family"), "text").where(F.col("text").rlike("[A-Za-z]"))  # those with a term
    if not terms.once(d.select("doc_id"), ["doc_id"]):
        return ag.pmi(terms.text_counts(d, ["doc_id", "family"], "text", word="[A-Za-z]+"), "doc_id", "term", "family", 20, 1.0)
    both = terms.text_counts(d, ["family"], "text", word="[A-Za-z]+", repeats=False)
    return ag.pmi_of_counts(both, d.groupBy("family").agg(F.count(F.lit(1)).alias("fdf")), "term", "family", 20, 1.0)


# joins


@query("SELECT d.doc_id, vec_id, label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def inner_join(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "vec_id", "label")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_default(spark, sf_dir):
    return joins.left_with_default(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", {"quality": -1})


@query("SELECT doc_id, quality, 2 AS strategy FROM documents JOIN labels USING (doc_id)")
def fallback_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p_"), F.col("doc_id").cast("string")).alias("k"))
    g = table(spark, sf_dir, "labels").select(F.concat(F.lit("q_"), F.col("doc_id").cast("string")).alias("k1"), F.concat(F.lit("p_"), F.col("doc_id").cast("string")).alias("k2"), "quality")
    return joins.ordered_fallback(d, g, [(F.col("k"), F.col("k1")), (F.col("k"), F.col("k2"))]).select("doc_id", "quality", "strategy")


@query("SELECT doc_id, CASE WHEN l.quality IS NULL THEN '' ELSE l.quality::VARCHAR END AS quality FROM documents LEFT JOIN labels l USING (doc_id)")
def row_fallback(spark, sf_dir):
    part = lambda s: F.concat(F.lit("a"), F.when(F.col("doc_id") % 3 == 0, s).otherwise("-"), F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", part("_").alias("id"))
    m = table(spark, sf_dir, "labels").select(part("/").alias("key"), F.col("quality").cast("string").alias("quality"))
    return joins.row_fallback(d, m, "id", "key", "quality").select("doc_id", "quality")


@query("SELECT l.doc_id, e.v FROM labels l LEFT JOIN (SELECT user_id, max_by(value, event_id) AS v FROM events GROUP BY user_id) e ON l.doc_id = e.user_id")
def last_duplicate_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", F.col("value").alias("v"))
    return joins.last_wins(table(spark, sf_dir, "labels").select("doc_id"), e, ["doc_id"], "event_id")


@query("SELECT a.doc_id, min(b.doc_id) AS match_id FROM documents a JOIN documents b ON substr(a.text, 1, 200) = substr(b.text, 1, 200) GROUP BY a.doc_id")
def prefix_lookup(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return joins.prefix_lookup(d.select("doc_id", "text"), d.select(F.col("doc_id").alias("id"), F.col("text").alias("other")), "text", "other").select("doc_id", "match_id")


_HEADS = "SELECT DISTINCT substr(text, 1, 100) AS x FROM documents"


@query(f"""
WITH h AS ({_HEADS}), o AS (SELECT substr(replace(text, 'a', 'o'), 1, 100) AS y, min(doc_id) AS other FROM documents GROUP BY 1),
  m AS (SELECT x, other, 1 - levenshtein(x, y) / greatest(length(x), length(y), 1)::DOUBLE AS r FROM h, o),
  b AS (SELECT x, other, r, row_number() OVER (PARTITION BY x ORDER BY r DESC, other) AS rn FROM m WHERE r > 0.8)
SELECT d.doc_id AS id, other, round(r, 6) AS ratio FROM documents d JOIN b ON substr(d.text, 1, 100) = x WHERE rn = 1
""")
def fuzzy_join(spark, sf_dir):
    """Every document against all documents with each a misspelt as o."""
    d = table(spark, sf_dir, "documents")
    return joins.fuzzy(d.select(F.col("doc_id").alias("id"), "text"), d.select(F.col("doc_id").alias("other"), F.replace("text", F.lit("a"), F.lit("o")).alias("other_text")), 0.8)


@query("SELECT e.event_id, coalesce(c.c_name, '?') AS name, c.c_custkey IS NOT NULL AS hit FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")
def alignment_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return joins.align(e, c, "k", "name").select("event_id", F.coalesce("name", F.lit("?")).alias("name"), "hit")


_SCORED = "SELECT event_type AS family, user_id AS paper_id, count(*) AS score FROM events GROUP BY 1, 2"


@query(f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, paper_id) AS rn FROM ({_SCORED})) SELECT a.family, a.paper_id AS paper_a, b.paper_id AS paper_b, least(a.score, b.score) AS confidence FROM r a JOIN r b ON a.family = b.family AND b.rn BETWEEN a.rn + 1 AND a.rn + 3")
def positive_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("family"), F.col("user_id").alias("paper_id")).agg(F.count(F.lit(1)).alias("score"))
    return joins.cross_pairs(s, 3)


@query("SELECT sha1(least(a, b) || '||' || greatest(a, b)) AS k, count(*) AS n FROM (SELECT event_type AS a, CAST(user_id % 7 AS VARCHAR) AS b FROM events UNION ALL SELECT CAST(user_id % 7 AS VARCHAR), event_type FROM events) GROUP BY 1")
def pair_dedup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("a"), (F.col("user_id") % 7).cast("string").alias("b"))
    return e.union(e.select("b", "a")).groupBy(joins.unordered_key("a", "b").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c.label AS cluster_id, string_agg(d.doc_id || ':' || coalesce(l.quality::VARCHAR, 'Abstract not found'), ',' ORDER BY c.vec_id) AS papers FROM embeddings c JOIN documents d ON c.vec_id = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def gather_abstracts(spark, sf_dir):
    picked = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.collect_list("vec_id").alias("picked"))
    meta = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("doc_id").alias("paper_id"))
    texts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").cast("string").alias("abstract"))
    out = joins.gather(picked, meta, texts)
    return out.select("cluster_id", F.array_join(F.transform("papers", lambda p: F.concat(p.paper_id.cast("string"), F.lit(":"), p.abstract)), ",").alias("papers"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf_dir):
    return joins.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT s.doc_id, coalesce(b.text, '') AS source FROM labels s LEFT JOIN benchmark b ON s.doc_id = b.item_id")
def summary_source_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("source"))
    return joins.left_with_default(table(spark, sf_dir, "labels").select("doc_id"), b, "doc_id", {"source": ""})


_KV = "SELECT doc_id AS k, text AS v FROM documents UNION ALL SELECT item_id, text FROM benchmark"


def _stores(spark, sf_dir):
    return [table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("value"))]


@query("SELECT coalesce(b.item_id, d.doc_id) AS key, coalesce(b.text, d.text) AS value FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id")
def kv_merge_last(spark, sf_dir):
    return joins.kv_merge(_stores(spark, sf_dir))


@query("SELECT coalesce(d.doc_id, b.item_id) AS key, coalesce(d.text, b.text) AS value FROM documents d FULL JOIN benchmark b ON d.doc_id = b.item_id")
def kv_merge_first(spark, sf_dir):
    return joins.kv_merge(_stores(spark, sf_dir), last=False)


_CONF = "SELECT doc_id, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS confidence FROM documents"


def _confidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 37 % 1000) / 1000.0).alias("confidence"))


@query(f"SELECT * FROM ({_CONF}) WHERE confidence > 0.95")
def confidence_filter(spark, sf_dir):
    return filters.confident(_confidence(spark, sf_dir), 0.95)


@query(f"SELECT * FROM ({_CONF}) WHERE confidence > 0.9 ORDER BY confidence DESC, doc_id LIMIT 40")
def confidence_floor_and_cap(spark, sf_dir):
    return filters.confident(_confidence(spark, sf_dir), 0.9, least=10, most=40)


@query(f"""
WITH pick AS (SELECT * FROM ({_CONF}) WHERE confidence > 0.9 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY confidence DESC, doc_id LIMIT 20)
SELECT 'train' AS part, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM pick)
UNION ALL SELECT 'pool', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM pick)
""")
def pseudo_label_step(spark, sf_dir):
    train = table(spark, sf_dir, "labels").select("doc_id")
    pool = joins.remaining(table(spark, sf_dir, "documents").select("doc_id"), train, ["doc_id"])
    chosen = filters.confident(_confidence(spark, sf_dir).join(pool, "doc_id"), 0.9, most=20)
    train, pool = joins.move(train, pool, chosen, "doc_id")
    return train.agg(F.count(F.lit(1)).alias("n")).select(F.lit("train").alias("part"), "n").union(pool.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pool"), "n"))


@query("SELECT id, replace(src, 'arXiv:', '') AS id_clean FROM (SELECT 'arXiv:' || doc_id AS src, doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE lang END AS v FROM documents) WHERE trim(v) <> ''")
def ground_truth_clean(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("arXiv:"), F.col("doc_id").cast("string")).alias("src"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("lang")).alias("obs"))
    return filters.clean_truth(d, "src", "obs").select("id", "id_clean")


@query("SELECT cluster_id, score FROM (SELECT DISTINCT doc_id AS cluster_id, CAST(doc_id % 6 AS INT) AS score FROM documents) WHERE score >= 4 ORDER BY score DESC, cluster_id LIMIT 25")
def score_filter_cap(spark, sf_dir):
    return filters.top_scored(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cluster_id"), (F.col("doc_id") % 6).cast("int").alias("score")), 4, 25)


@query("SELECT count(*) AS n_rows, 'nope' AS missing, count(*) FILTER (n_chars IS NULL) AS n_null, count(*) FILTER (n_chars < 0) AS n_negative, count(*) FILTER (n_chars = 0) AS n_zero FROM documents")
def validation(spark, sf_dir):
    return filters.validate(table(spark, sf_dir, "documents"), ["doc_id", "nope"], ["n_chars"])


@query("SELECT try_cast(d AS INT) AS cluster_id, try_cast(s AS DOUBLE) AS score, 'none' AS rater FROM (SELECT CAST(doc_id AS VARCHAR) AS d, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id / 2.0 AS VARCHAR) END AS s FROM documents) WHERE try_cast(s AS DOUBLE) IS NOT NULL")
def schema_coercion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise((F.col("doc_id") / 2.0).cast("string")).alias("rating"))
    return filters.coerce(d, {"id": "cluster_id", "rating": "score"}, {"cluster_id": "int", "score": "double"}, {"rater": "none"}, ["cluster_id", "score"])


# sets


@query("SELECT text, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) GROUP BY text")
def union_bag(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return d.unionByName(b, allowMissingColumns=True).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT text, lang FROM documents")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text", "lang").dropDuplicates()


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


_BUCKET = "('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 100"


@query(f"SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, {_BUCKET} AS b FROM documents)")
def hash_split(spark, sf_dir):
    return ranking.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(f"WITH s AS (SELECT doc_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, {_BUCKET} AS b FROM documents)) SELECT a.doc_id AS a, b.doc_id AS b, a.split FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND a.split = b.split")
def same_split_pairs(spark, sf_dir):
    s = ranking.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return s.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), "split").join(s.select(F.col("doc_id").alias("b"), "split"), ["b", "split"]).select("a", "b", "split")


# rankings


@query("SELECT user_id, event_id, value, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def top_k_per_group(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "value", "event_id", 3)


@query(f"SELECT cluster, count(*) AS size FROM ({ASSIGN}) WHERE cluster <> -1 GROUP BY 1 ORDER BY size DESC, cluster LIMIT 4")
def largest_clusters(spark, sf_dir):
    return ranking.largest_clusters(assignments(spark, sf_dir), 4)


@query("""
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS hi, row_number() OVER (ORDER BY n_chars, doc_id) AS lo FROM documents), x AS (SELECT *, CASE WHEN hi <= 3 THEN 'best' WHEN lo <= 3 THEN 'worst' END AS part FROM r),
m AS (SELECT quantile_cont(n_chars, 0.5) AS m FROM x WHERE part IS NULL)
SELECT doc_id, n_chars, part FROM x WHERE part IS NOT NULL UNION ALL SELECT doc_id, n_chars, 'middle' FROM (SELECT doc_id, n_chars FROM x, m WHERE part IS NULL ORDER BY abs(n_chars - m), doc_id LIMIT 4)
""")
def quality_range(spark, sf_dir):
    return ranking.quality_range(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 10)


@query("""
WITH e AS (SELECT list_distinct(quantile_cont(n_chars::DOUBLE, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS edges FROM documents), b AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, greatest(len(list_filter(edges, lambda x: x < n_chars)), 1) AS bin FROM documents, e),
m AS (SELECT bin, quantile_cont(n_chars, 0.5) AS m FROM b GROUP BY bin)
SELECT bin::INT AS bin, doc_id, n_chars FROM (SELECT b.*, row_number() OVER (PARTITION BY b.bin ORDER BY abs(n_chars - m), doc_id) AS rn FROM b JOIN m ON b.bin = m.bin) WHERE rn = 1
""")
def qcut_examples(spark, sf_dir):
    return ranking.one_of_each_bin(table(spark, sf_dir, "documents"), "doc_id", "n_chars")


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality FROM r WHERE rn <= (SELECT min(n) FROM r)")
def balanced_sample(spark, sf_dir):
    return ranking.balanced_sample(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || ':42'), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, CASE WHEN rn <= round(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r")
def stratified_split(spark, sf_dir):
    return ranking.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(f"SELECT para_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY md5(para_id || ':42'), para_id) AS rn FROM ({ASSIGN})) WHERE rn <= 5")
def random_per_cluster(spark, sf_dir):
    return ranking.sample_per_group(assignments(spark, sf_dir).select("para_id", "cluster"), "cluster", "para_id", 5)


@query(f"""
WITH s AS (SELECT cluster, count(*) AS n FROM ({ASSIGN}) WHERE cluster <> -1 GROUP BY 1), q AS (SELECT cluster, n, greatest(floor(n / sum(n) OVER () * 60), 1) AS q FROM s), z AS (SELECT cluster, q + CASE WHEN row_number() OVER (ORDER BY n DESC, cluster) = 1 THEN greatest(60 - sum(q) OVER (), 0) ELSE 0 END AS q FROM q)
SELECT para_id, cluster FROM (SELECT a.*, row_number() OVER (PARTITION BY a.cluster ORDER BY md5(para_id || ':42'), para_id) AS rn FROM ({ASSIGN}) a) JOIN z USING (cluster) WHERE rn <= q
""")
def proportional_sample(spark, sf_dir):
    return ranking.proportional_sample(assignments(spark, sf_dir).select("para_id", "cluster"), "para_id", 60)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE (i % 50000) % 7 = 0")
def every_nth_row(spark, sf_dir):
    return ranking.every_nth(table(spark, sf_dir, "events").select("event_id"), "event_id", 7)


@query("SELECT doc_id, lang, source, row_number() OVER (ORDER BY lang, source, doc_id) AS place FROM documents")
def multi_key_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").withColumn("place", F.row_number().over(Window.orderBy("lang", "source", "doc_id")).cast("long"))


@query("WITH c AS (SELECT row_number() OVER (ORDER BY n DESC, source)::INT AS i, n FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)), r AS (SELECT i, sum(n) OVER (ORDER BY i) / sum(n) OVER () AS c FROM c) SELECT t AS threshold, min(i) AS place FROM r, (SELECT unnest([0.5, 0.8, 0.95])::DOUBLE AS t) WHERE c >= t - 1e-12 GROUP BY t")
def cumulative_share(spark, sf_dir):
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    c = c.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "source")).alias("i"), "n")
    return ranking.first_reaching(c, "i", "n", [0.5, 0.8, 0.95])
