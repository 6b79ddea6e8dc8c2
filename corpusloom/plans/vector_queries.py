"""Queries over vectors and metrics of clusterings. Sums of floats are rounded to six places on both sides."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import features, metrics, terms
from ..operators import vectors as vo
from ..sources.tables import table
from .registry import query

_E = "SELECT vec_id AS id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"
_O = f"SELECT * FROM ({_E}) WHERE cluster >= 0"
#: cluster, pos, x of the centroids, and the centroids as arrays.
_CP = "SELECT cluster, pos, avg(x) AS x, count(*) AS n FROM (SELECT cluster, generate_subscripts(v, 1) AS pos, unnest(v) AS x FROM ({src})) GROUP BY 1, 2"
_C = "SELECT cluster, any_value(n) AS n, list(x ORDER BY pos) AS c FROM (" + _CP + ") GROUP BY cluster"
_DIST = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
_COS = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


def _rows(spark, sf_dir, noise: bool = False):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"), F.col("embedding").cast("array<double>").alias("v"))
    return e if noise else e.where("cluster >= 0")


@query(f"SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round({_COS.format(a='v', b='list_reverse(v)')}, 6) AS mirrored, list_position(v, list_max(v))::INT - 1 AS top, round(exp(list_max(v)) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS confidence FROM ({_E})")
def vector_scalars(spark, sf_dir):
    v = F.col("v")
    r = lambda x, n: F.round(x, 6).alias(n)
    return _rows(spark, sf_dir, True).select("id", r(vx.norm(v), "norm"), r(F.element_at(vx.l2_normalise(v), 1), "first"), r(vx.cosine(v, F.reverse(v)), "mirrored"), vx.argmax(v).alias("top"), r(F.array_max(vx.softmax(v)), "confidence"))


@query(f"SELECT id, len(v) + 2 AS dim, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1 FROM ({_E})")
def vector_append(spark, sf_dir):
    v = F.concat(F.col("v"), F.array(F.lit(0.0), F.lit(float("nan"))))
    rows = _rows(spark, sf_dir, True).select("id", vx.finite(v).alias("w"))
    return rows.select("id", F.size("w").cast("long").alias("dim"), F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + F.abs(x)), 6).alias("l1"))


@query(f"SELECT cluster, pos::INT - 1 AS pos, round(x, 6) AS x, n FROM ({_CP.format(src=_O)})")
def centroids(spark, sf_dir):
    return vo.centroids(_rows(spark, sf_dir)).select("cluster", "n", F.posexplode("c").alias("pos", "x")).select("cluster", "pos", F.round("x", 6).alias("x"), "n")


@query(f"WITH c AS ({_C.format(src=_O)}), m AS (SELECT e.cluster, e.id, {_COS.format(a='e.v', b='c.c')} AS s FROM ({_O}) e JOIN c USING (cluster)) SELECT cluster, rn AS rank, id, round(s, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, id) AS rn FROM m) WHERE rn <= 5")
def nearest_members(spark, sf_dir):
    return vo.nearest_members(_rows(spark, sf_dir), 5)


@query(f"WITH c AS ({_C.format(src=_O)}), m AS (SELECT e.cluster, e.id, {_DIST.format(a='e.v', b='c.c')} AS d FROM ({_O}) e JOIN c USING (cluster)) SELECT cluster, id, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(d, 9), id) AS rn FROM m) WHERE rn = 1")
def representatives(spark, sf_dir):
    return vo.representatives(_rows(spark, sf_dir))


@query(f"WITH c AS ({_C.format(src=_O)}), m AS (SELECT e.id, c.cluster, round({_DIST.format(a='e.v', b='c.c')}, 9) AS d FROM ({_E}) e, c WHERE e.cluster = -1) SELECT id, cluster FROM ({_O}) UNION ALL SELECT id, arg_min(cluster, (d, cluster)) FROM m GROUP BY id")
def noise_reassign(spark, sf_dir):
    return vo.reassign_noise(_rows(spark, sf_dir, True))


_PAIRS = f"SELECT a.cluster, a.id AS a, b.id AS b, {_COS.format(a='a.v', b='b.v')} AS s, {_DIST.format(a='a.v', b='b.v')} AS d FROM ({_O}) a JOIN ({_O}) b ON a.cluster = b.cluster AND a.id < b.id"
_CC = f"WITH c AS ({_C.format(src=_O)}) SELECT x.cluster AS a, y.cluster AS b, {_COS.format(a='x.c', b='y.c')} AS cosine, {_DIST.format(a='x.c', b='y.c')} AS distance FROM c x JOIN c y ON x.cluster < y.cluster"


@query(f"WITH p AS ({_PAIRS}), z AS (SELECT cluster, count(*) AS size FROM ({_O}) GROUP BY 1) SELECT cluster, size, round(avg(s), 6) AS mean, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS min, round(max(s), 6) AS max, round(quantile_cont(s, 0.25), 6) AS q25, round(quantile_cont(s, 0.75), 6) AS q75 FROM p JOIN z USING (cluster) GROUP BY cluster, size")
def pair_coherence(spark, sf_dir):
    return vo.pair_statistics(_rows(spark, sf_dir))


@query(f"SELECT a, b, round(cosine, 6) AS cosine, round(distance, 6) AS distance FROM ({_CC})")
def centroid_similarity(spark, sf_dir):
    return vo.centroid_pairs(_rows(spark, sf_dir)).select("a", "b", F.round("cosine", 6).alias("cosine"), F.round("distance", 6).alias("distance"))


@query(f"WITH p AS ({_PAIRS}), c AS ({_CC}) SELECT round(avg(distance), 6) AS mean_inter, round(stddev_pop(distance), 6) AS std_inter, round(min(distance), 6) AS min_inter, round(max(distance), 6) AS max_inter, round((SELECT avg(d) FROM p), 6) AS mean_intra, round(avg(distance) / (SELECT avg(d) FROM p), 6) AS ratio FROM c")
def separation(spark, sf_dir):
    return vo.separation(_rows(spark, sf_dir))


_UNIT = f"SELECT id, cluster, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM ({_O})"


@query(f"""
WITH c AS ({_C.format(src=_UNIT)}), cc AS (SELECT x.cluster AS a, y.cluster AS b, {_COS.format(a='x.c', b='y.c')} AS s FROM c x JOIN c y ON x.cluster <> y.cluster),
p AS (SELECT a.cluster, avg(list_dot_product(a.v, b.v)) AS pairs FROM ({_UNIT}) a JOIN ({_UNIT}) b ON a.cluster = b.cluster AND a.id < b.id GROUP BY 1),
t AS (SELECT u.cluster, avg({_COS.format(a='u.v', b='c.c')}) AS own, count(*) AS size FROM ({_UNIT}) u JOIN c USING (cluster) GROUP BY 1), n AS (SELECT a AS cluster, max(s) AS near FROM cc GROUP BY 1)
SELECT cluster, size, round(pairs, 6) AS mean_pair_cosine, round(own, 6) AS mean_to_centroid, round(near, 6) AS nearest_other_centroid, round(own - near, 6) AS margin FROM t JOIN p USING (cluster) JOIN n USING (cluster)
""")
def cluster_quality(spark, sf_dir):
    return vo.quality(_rows(spark, sf_dir))


_TO = f"WITH c AS ({_C.format(src=_O)}), m AS (SELECT e.cluster, e.id, {_DIST.format(a='e.v', b='c.c')} AS d FROM ({_O}) e JOIN c USING (cluster))"


@query(_TO + " SELECT cluster, round(1 / (1 + avg(d)), 6) AS density, round(avg(d), 6) AS compactness FROM m GROUP BY 1")
def cluster_density(spark, sf_dir):
    return vo.density(_rows(spark, sf_dir))


@query(_TO + " SELECT round(sum(d * d), 6) AS inertia FROM m")
def inertia(spark, sf_dir):
    return vo.inertia(_rows(spark, sf_dir))


@query(f"WITH r AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM ({_E})), p AS (SELECT 1 - {_COS.format(a='a.v', b='b.v')} AS d FROM r a JOIN r b ON b.rn BETWEEN a.rn + 1 AND a.rn + 20) SELECT round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(min(d), 6) AS min, round(max(d), 6) AS max, round(quantile_cont(d, 0.5), 6) AS median, (SELECT round(avg(sqrt(list_dot_product(v, v))), 6) FROM r) AS mean_norm, (SELECT round(stddev_pop(sqrt(list_dot_product(v, v))), 6) FROM r) AS std_norm FROM p")
def embedding_diversity(spark, sf_dir):
    return vo.diversity(_rows(spark, sf_dir, True))


@query(f"WITH p AS (SELECT id AS a, id + 10 AS b FROM ({_E}) WHERE id + 10 IN (SELECT id FROM ({_E}))), m AS (SELECT *, coalesce(lead(b) OVER (ORDER BY a, b), first(b) OVER (ORDER BY a, b)) AS o FROM p), s AS (SELECT {_COS.format(a='x.v', b='y.v')} AS pos, {_COS.format(a='x.v', b='z.v')} AS neg FROM m JOIN ({_E}) x ON m.a = x.id JOIN ({_E}) y ON m.b = y.id JOIN ({_E}) z ON m.o = z.id) SELECT round(avg(pos), 6) AS positive, round(avg(neg), 6) AS shuffled, round(avg(pos) - avg(neg), 6) AS gap FROM s")
def pair_gap(spark, sf_dir):
    e = _rows(spark, sf_dir, True)
    pairs = e.select(F.col("id").alias("a"), (F.col("id") + 10).alias("b")).join(e.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    return vo.pair_gap(pairs, e)


# metrics


@query("SELECT lang AS a, source AS b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def contingency(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "documents"), "lang", "source")


@query("""
WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), A AS (SELECT a, sum(n) AS s FROM t GROUP BY 1), B AS (SELECT b, sum(n) AS s FROM t GROUP BY 1),
k AS (SELECT sum(n)::DOUBLE AS N, sum(n * (n - 1) / 2.0) AS ij, sum(n * ln(n)) AS h FROM t), x AS (SELECT sum(s * (s - 1) / 2.0)::DOUBLE AS p, sum(s * ln(s)) AS h FROM A), y AS (SELECT sum(s * (s - 1) / 2.0)::DOUBLE AS p, sum(s * ln(s)) AS h FROM B),
m AS (SELECT N, ij, x.p AS ap, y.p AS bp, ln(N) - x.h / N AS ha, ln(N) - y.h / N AS hb, ln(N) - k.h / N AS hab FROM k, x, y), v AS (SELECT *, ha + hb - hab AS mi, ap * bp / (N * (N - 1) / 2) AS e FROM m)
SELECT round((ij - e) / ((ap + bp) / 2 - e), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(ij / sqrt(ap * bp), 6) AS fmi FROM v
""")
def agreement(spark, sf_dir):
    return metrics.agreement(table(spark, sf_dir, "documents"), "lang", "source")


@query("""
WITH t AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), A AS (SELECT sum(n)::DOUBLE AS s FROM t GROUP BY a), B AS (SELECT sum(n)::DOUBLE AS u FROM t GROUP BY b),
k AS (SELECT sum(n)::DOUBLE AS m, sum(n * ln(n)) AS h FROM t), x AS (SELECT sum(s * ln(s)) AS h FROM A), y AS (SELECT sum(u * ln(u)) AS h FROM B),
v AS (SELECT m, ln(m) - x.h / m AS ha, ln(m) - y.h / m AS hb, ln(m) - k.h / m AS hab FROM k, x, y),
c AS (SELECT s, u, m, unnest(range(greatest(1, s + u - m)::BIGINT, least(s, u)::BIGINT + 1))::DOUBLE AS i FROM A, B, k),
e AS (SELECT sum(i / m * ln(m * i / (s * u)) * exp(lgamma(s + 1) + lgamma(u + 1) + lgamma(m - s + 1) + lgamma(m - u + 1) - lgamma(m + 1) - lgamma(i + 1) - lgamma(s - i + 1) - lgamma(u - i + 1) - lgamma(m - s - u + i + 1))) AS e FROM c)
SELECT round((ha + hb - hab - e) / ((ha + hb) / 2 - e), 6) AS ami FROM v, e
""")
def adjusted_mutual_information(spark, sf_dir):
    return metrics.adjusted_mutual_information(table(spark, sf_dir, "documents"), "lang", "source")


@query("WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), l AS (SELECT DISTINCT unnest([a, b]) AS l FROM t), p AS (SELECT l, (SELECT coalesce(sum(n), 0) FROM t WHERE a = l) AS ta, (SELECT coalesce(sum(n), 0) FROM t WHERE b = l) AS tb, (SELECT coalesce(sum(n), 0) FROM t WHERE a = l AND b = l) AS h FROM l) SELECT round(sum(h) / sum(ta), 6) AS accuracy, round(avg(2 * h / (ta + tb)), 6) AS macro_f1 FROM p")
def classification_metrics(spark, sf_dir):
    return metrics.classification(table(spark, sf_dir, "labels"), "quality", "toxic")


@query(f"WITH c AS ({_C.format(src=_O)}), g AS ({_C.format(src=f'SELECT id, 0 AS cluster, v FROM ({_O})')}), b AS (SELECT sum(c.n * pow({_DIST.format(a='c.c', b='g.c')}, 2)) AS b, count(*) AS k, any_value(g.n) AS n FROM c, g), w AS (SELECT sum(pow({_DIST.format(a='e.v', b='c.c')}, 2)) AS w FROM ({_O}) e JOIN c USING (cluster)) SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w")
def calinski_harabasz(spark, sf_dir):
    return metrics.calinski_harabasz(_rows(spark, sf_dir))


@query(f"{_TO}, s AS (SELECT cluster, avg(d) AS s FROM m GROUP BY 1), r AS (SELECT x.cluster AS a, max((sx.s + sy.s) / {_DIST.format(a='x.c', b='y.c')}) AS r FROM c x JOIN c y ON x.cluster <> y.cluster JOIN s sx ON sx.cluster = x.cluster JOIN s sy ON sy.cluster = y.cluster GROUP BY 1) SELECT round(avg(r), 6) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf_dir):
    return metrics.davies_bouldin(_rows(spark, sf_dir))


@query(f"WITH m AS (SELECT a.id, a.cluster, b.cluster AS c2, avg({_DIST.format(a='a.v', b='b.v')}) AS d FROM ({_O}) a JOIN ({_O}) b ON a.id <> b.id GROUP BY 1, 2, 3), p AS (SELECT id, cluster, max(d) FILTER (c2 = cluster) AS a, min(d) FILTER (c2 <> cluster) AS b FROM m GROUP BY 1, 2) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM p")
def silhouette_exact(spark, sf_dir):
    return metrics.silhouette(_rows(spark, sf_dir))


@query(f"SELECT round(avg((cluster = -1)::INT), 6) AS noise_ratio, round(1 - avg((cluster = -1)::INT), 6) AS coverage FROM ({_E})")
def noise_coverage(spark, sf_dir):
    return metrics.coverage(_rows(spark, sf_dir, True))


@query("WITH r AS (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS x, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS y FROM customer) SELECT round(corr(x, y), 6) AS rho, count(*) AS n FROM r")
def spearman(spark, sf_dir):
    return metrics.spearman(table(spark, sf_dir, "customer"), "c_acctbal", "c_nationkey")


_RANK = "rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0"


@query(f"WITH r AS (SELECT c_mktsegment AS g, c_nationkey AS v, {_RANK} AS r FROM customer), p AS (SELECT sum(s * s / n) AS q, sum(n)::DOUBLE AS N, count(*) - 1 AS df FROM (SELECT g, sum(r)::DOUBLE AS s, count(*) AS n FROM r GROUP BY 1)), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)) SELECT round((12 / (N * (N + 1)) * q - 3 * (N + 1)) / (1 - ties / (pow(N, 3) - N)), 6) AS h, df FROM p, t")
def kruskal_wallis(spark, sf_dir):
    return metrics.kruskal(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey")


@query(f"WITH r AS (SELECT c_mktsegment AS g, {_RANK} AS r FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT round((sum(r) FILTER (g = 'BUILDING') - count(*) FILTER (g = 'BUILDING') * (count(*) FILTER (g = 'BUILDING') + 1) / 2)::DOUBLE, 6) AS u, count(*) FILTER (g = 'BUILDING') AS n1, count(*) FILTER (g <> 'BUILDING') AS n2 FROM r")
def mann_whitney(spark, sf_dir):
    return metrics.mann_whitney(table(spark, sf_dir, "customer"), "c_mktsegment", "c_nationkey", "BUILDING", "MACHINERY")


def _rouge_sql(n: int) -> str:
    g = lambda c: f"SELECT id, array_to_string(w[i : i + {n - 1}], ' ') AS g, count(*) AS k FROM (SELECT id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT id, regexp_extract_all(lower({c}), '[a-z0-9]+') AS w FROM p) WHERE len(w) >= {n}) GROUP BY 1, 2"
    return f"WITH p AS (SELECT d.doc_id AS id, b.text AS summary, d.text AS reference FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id), s AS ({g('summary')}), r AS ({g('reference')}), m AS (SELECT coalesce(s.id, r.id) AS id, sum(least(coalesce(s.k, 0), coalesce(r.k, 0))) AS h, sum(coalesce(s.k, 0)) AS s, sum(coalesce(r.k, 0)) AS r FROM s FULL JOIN r ON s.id = r.id AND s.g = r.g GROUP BY 1), q AS (SELECT id, CASE WHEN s > 0 THEN h / s ELSE 0 END AS p, CASE WHEN r > 0 THEN h / r ELSE 0 END AS q FROM m) SELECT id, round(p, 6)::DOUBLE AS precision, round(q, 6)::DOUBLE AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6)::DOUBLE AS f1 FROM q"


def _summaries(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("summary"))
    return table(spark, sf_dir, "documents").join(b, F.col("doc_id") % 40 == F.col("item_id")).select(F.col("doc_id").alias("id"), "summary", F.col("text").alias("reference"))


@query(_rouge_sql(1))
def rouge_1(spark, sf_dir):
    return metrics.rouge_n(_summaries(spark, sf_dir), 1)


@query(_rouge_sql(2))
def rouge_2(spark, sf_dir):
    return metrics.rouge_n(_summaries(spark, sf_dir), 2)


@query()
def rouge_l(spark, sf_dir):
    return metrics.rouge_l(_summaries(spark, sf_dir))


# weights: how many of the Poisson distribution's first cumulated shares a draw reaches
_SHARES = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(7)]


@query(f"""
WITH r AS (SELECT c_acctbal::DOUBLE AS v, i, ('0x' || substr(md5(c_custkey || ':' || i || ':42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM customer, range(1, 1001) q(i) WHERE c_acctbal IS NOT NULL),
w AS (SELECT i, v, {" + ".join(f"(u >= {s!r}::DOUBLE)::INT" for s in _SHARES)} AS w FROM r), m AS (SELECT sum(v * w) / nullif(sum(w), 0) AS m FROM w GROUP BY i)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m
""")
def bootstrap_ci(spark, sf_dir):
    return metrics.bootstrap_ci(table(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


@query("SELECT event_type, round(avg(value) / max(value), 6) AS score, CASE WHEN avg(value) / max(value) >= 0.7 THEN 'strong' WHEN avg(value) / max(value) >= 0.5 THEN 'reasonable' WHEN avg(value) / max(value) >= 0.25 THEN 'weak' ELSE 'none' END AS reading FROM events GROUP BY 1")
def interpretation(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("event_type").agg((F.avg("value") / F.max("value")).alias("score"))
    return s.select("event_type", F.round("score", 6).alias("score"), metrics.interpretation(F.col("score")).alias("reading"))


# terms

_TOK = "SELECT {by}, t AS term, count(*) AS n FROM (SELECT {by}, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+'))) AS t FROM documents) WHERE length(t) > 2 GROUP BY 1, 2"
_CTF = f"WITH c AS ({_TOK.format(by='lang')}), df AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT c.*, df, sum(n) OVER (PARTITION BY lang) AS s FROM c JOIN df USING (term)), z AS (SELECT lang, term, n / (s + 1e-9) * (ln((1 + (SELECT count(DISTINCT lang) FROM c)) / (1 + df)::DOUBLE) + 1) AS score FROM k), top AS (SELECT lang, term, round(score, 6) AS score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rn FROM z) WHERE rn <= 10)"


def _counts(spark, sf_dir, by):
    return terms.text_counts(table(spark, sf_dir, "documents"), [by], "text")


@query(_CTF + " SELECT * FROM top")
def ctfidf_terms(spark, sf_dir):
    return terms.top_terms(terms.class_tf_idf(_counts(spark, sf_dir, "lang"), "lang"), "lang")


@query(_CTF + ", kw AS (SELECT DISTINCT d.lang, lower(unnest(regexp_extract_all(b.text, '[A-Za-z][A-Za-z0-9_\\-]+'))) AS term FROM benchmark b JOIN documents d ON b.item_id = d.doc_id), own AS (SELECT * FROM kw WHERE length(term) > 2), m AS (SELECT lang, count(*) AS m FROM own GROUP BY 1), h AS (SELECT lang, count(*) AS h FROM top JOIN own USING (lang, term) GROUP BY 1), tk AS (SELECT lang, count(*) AS k FROM top GROUP BY 1), q AS (SELECT lang, coalesce(h, 0) / greatest(k, 1)::DOUBLE AS p, coalesce(h, 0) / greatest(coalesce(m, 0), 1)::DOUBLE AS r FROM tk LEFT JOIN m USING (lang) LEFT JOIN h USING (lang)) SELECT lang, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM q")
def keyword_f1(spark, sf_dir):
    tops = terms.top_terms(terms.class_tf_idf(_counts(spark, sf_dir, "lang"), "lang"), "lang")
    b = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang"), "item_id")
    return terms.keyword_f1(tops, b.select("lang", F.explode(tx.tokens(F.col("text"))).alias("keyword")), "lang")


@query(f"WITH c AS ({_TOK.format(by='doc_id')}), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(DISTINCT doc_id) FROM c)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN d USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w")
def tf_idf(spark, sf_dir):
    return terms.text_tf_idf(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH c AS ({_TOK.format(by='source')}) SELECT source, round(sum(n) FILTER (rn <= 10) / sum(n), 6) AS coherence FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rn FROM c) GROUP BY 1")
def keyword_coherence(spark, sf_dir):
    return terms.coherence(_counts(spark, sf_dir, "source"), "source")


@query(f"WITH c0 AS ({_TOK.format(by='doc_id')}), nd AS (SELECT count(*) AS total FROM documents), d0 AS (SELECT term, count(*) AS df FROM c0 GROUP BY 1), c AS (SELECT c0.* FROM c0 JOIN d0 USING (term), nd WHERE df >= 3 AND df <= 0.95 * nd.total), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(DISTINCT doc_id) FROM c)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN d USING (term)), x AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS w FROM w), s AS (SELECT lang, count(*) AS size FROM documents GROUP BY 1), z AS (SELECT lang, term, sum(w) / any_value(size) AS score FROM x JOIN documents USING (doc_id) JOIN s USING (lang) GROUP BY 1, 2) SELECT lang, term, round(score, 6) AS score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rn FROM z) WHERE rn <= 5")
def mean_tfidf_terms(spark, sf_dir):
    return terms.top_terms(terms.mean_tf_idf(table(spark, sf_dir, "documents"), "doc_id", "lang", _counts(spark, sf_dir, "doc_id")), "lang", 5)


_WORDS = "SELECT doc_id, source, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_\\-]+'), lambda x: lower(x)), lambda x: length(x) > 2) AS t FROM documents"
_PAIRS = "list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])"


def _words(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns, tx.tokens(F.col("text")).alias("tokens"))


@query(f"""
WITH u AS (SELECT doc_id, unnest(t) AS a, generate_subscripts(t, 1) AS p FROM ({_WORDS})),
  l AS (SELECT doc_id, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
  c AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, a AS term FROM l UNION ALL SELECT doc_id, a || ' ' || b FROM l UNION ALL SELECT doc_id, a || ' ' || b || ' ' || c FROM l) WHERE term IS NOT NULL GROUP BY 1, 2),
  d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
  w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(DISTINCT doc_id) FROM c)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN d USING (term)),
  x AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS score FROM w)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM x) WHERE rank <= 10
""")
def keyphrases(spark, sf_dir):
    return terms.text_keyphrases(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH g AS (SELECT source, doc_id, unnest(list_concat(t, {_PAIRS})) AS term FROM ({_WORDS})), c AS (SELECT source, doc_id, term, count(*) AS n FROM g GROUP BY ALL),
  h AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 10),
  s AS (SELECT source, 1 + least(count(*), 10) AS d FROM documents GROUP BY 1 HAVING count(*) > 1),
  o AS (SELECT source, term, sum(n) AS n, sum(CASE WHEN h.doc_id IS NULL THEN n ELSE 2 * n END) AS every, 1 + count(h.doc_id) AS df FROM c LEFT JOIN h ON c.doc_id = h.doc_id GROUP BY 1, 2),
  k AS (SELECT source, term, n * (ln((1 + d) / (1 + df)::DOUBLE) + 1) AS w, row_number() OVER (PARTITION BY source ORDER BY every DESC, term) AS rn FROM o JOIN s USING (source) WHERE df <= 0.8 * d),
  x AS (SELECT source, term, w / sqrt(sum(w * w) OVER (PARTITION BY source)) AS score FROM k WHERE rn <= 1000)
SELECT source, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 9) DESC, term) AS rank FROM x) WHERE rank <= 3
""")
def class_keywords(spark, sf_dir):
    return terms.class_keywords(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query(f"""
WITH h AS (SELECT doc_id, ('0x' || substr(md5(x), 1, 7))::BIGINT AS h FROM (SELECT doc_id, unnest(t) AS x FROM ({_WORDS}))),
  s AS (SELECT doc_id, (h % 256)::INT AS pos, sum(1 - 2 * ((h // 256) % 2))::DOUBLE AS x FROM h GROUP BY 1, 2)
SELECT doc_id AS id, pos, round(x / norm, 6) AS x FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS norm FROM s) WHERE x <> 0
""")
def hashed_embedding(spark, sf_dir):
    v = features.hashed_embedding(_words(spark, sf_dir), "doc_id", "tokens")
    return v.select("id", F.posexplode("v").alias("pos", "x")).where("x <> 0").select("id", "pos", F.round("x", 6).alias("x"))
