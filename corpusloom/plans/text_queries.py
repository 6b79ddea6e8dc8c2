"""Queries over texts: cleaning, splitting, tagging and counting. Marked texts get a literal with the constructs (formulas,
citations, captions) that the base table lacks, the same in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import text as tx
from ..operators import filters
from ..sources.tables import table
from .registry import query

MARK = "a [MATH_tex=x[1]] b $y$ (Smith 2019) see [12] http://a.b/c d\nFigure 3 cut\n"
LEXICON = {"articles": [" the ", " a "], "joins": [" and ", " und ", " et "], "ends": ["tion[ .,]", "ment[ .,]", "ing[ .,]"], "rare": ["worthless"]}
HEADINGS = ["src1", "src7"]
PHRASES = [" the of ", " de (la|le) ", " und (die|der) "]


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(MARK), "text").alias("text"))


_MARKED = "SELECT doc_id, '" + MARK.replace("\n", "' || chr(10) || '") + "' || text AS text FROM documents"


def _sql_clean(x: str) -> str:
    body = f"regexp_replace(regexp_replace(regexp_replace({x}, '(\\$[^$]+\\$)|\\\\\\[[\\s\\S]*?\\\\\\]|\\\\\\([\\s\\S]*?\\\\\\)', ' ', 'g'), '\\(([^()]*\\d{{4}}[^()]*)\\)|\\[[0-9,\\s;]+\\]', ' <CIT> ', 'g'), 'https?://\\S+', ' ', 'g')"
    lines = f"list_filter(string_split({body}, chr(10)), lambda l: NOT regexp_matches(l, '(?i)^\\s*(Figure|Table)\\s+\\d+'))"
    return f"trim(regexp_replace(array_to_string({lines}, ' '), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, regexp_replace(text, '\\[MATH_tex=.*?\\]', '[MATH]', 'g') AS masked FROM ({_MARKED})")
def math_mask(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", tx.mask_math_tags(F.col("text")).alias("masked"))


@query(f"SELECT doc_id, 'S - ' || list_extract(string_split(replace(text, '[MATH_tex=', '[MATH]'), ']'), -1) AS input FROM ({_MARKED})")
def classifier_input(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", tx.classifier_input(F.lit("S"), F.col("text")).alias("input"))


@query(f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM ({_MARKED})")
def clean_text(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@query(
    f"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(CASE WHEN len(regexp_split_to_array(trim(text), '\\n\\s*\\n')) = 1
            THEN list_filter(string_split(trim(text), chr(10)), lambda l: trim(l) <> '') ELSE regexp_split_to_array(trim(text), '\\n\\s*\\n') END,
            lambda x: {_sql_clean("x")}), lambda x: length(x) >= 200) AS parts FROM documents)
    SELECT doc_id, doc_id || '::p' || lpad((i - 1)::VARCHAR, 4, '0') AS para_id, parts[i] AS text
    FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM p)
    """
)
def split_paragraphs(spark, sf_dir):
    return filters.method_paragraphs(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "paper_id")).withColumnRenamed("paper_id", "doc_id")


@query(
    """
    SELECT doc_id, parts[i] AS text, i - 1 AS paragraph_index, length(parts[i]) AS para_length
    FROM (SELECT doc_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
        SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS parts FROM documents))
    """
)
def plain_paragraphs(spark, sf_dir):
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.plain_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("i", "text"))
    return parts.select("doc_id", "text", F.col("i").cast("long").alias("paragraph_index"), F.length("text").cast("long").alias("para_length"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_words, length(text) AS n_chars FROM documents WHERE len(regexp_extract_all(text, '\\S+')) >= 25")
def min_words(spark, sf_dir):
    return filters.least_words(table(spark, sf_dir, "documents"), 25).select("doc_id", tx.n_words(F.col("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"))


_SQL_LABEL = "CASE WHEN contains(lower(source), 'src1') OR contains(lower(source), 'src7') OR regexp_matches(lower(text), ' the of | de (la|le) | und (die|der) ') THEN 'methodology' ELSE 'not_methodology' END"


@query(f"SELECT doc_id, {_SQL_LABEL} AS label FROM documents")
def heuristic_label(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", filters.heuristic_label(F.col("source"), F.col("text"), HEADINGS, PHRASES).alias("label"))


@query(f"SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT {_SQL_LABEL} AS label FROM documents) GROUP BY label")
def label_distribution(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return filters.distribution(docs.select(filters.heuristic_label(F.col("source"), F.col("text"), HEADINGS, PHRASES).alias("label")), "label")


@query(
    """
    SELECT doc_id, round(((length(l) - length(replace(l, 'tion', ''))) / 4 + (length(l) - length(replace(l, 'the', ''))) / 3) * 2.0 / greatest(w, 1), 6) AS first_score,
           round(((length(l) - length(replace(l, 'ment', ''))) / 4) * 1.5 / greatest(w, 1), 6) AS second_score
    FROM (SELECT doc_id, lower(text) AS l, len(regexp_extract_all(text, '\\S+')) AS w FROM documents)
    """
)
def keyword_density(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(tx.keyword_density(t, ["tion", "the"], 2.0), 6).alias("first_score"), F.round(tx.keyword_density(t, ["ment"], 1.5), 6).alias("second_score"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '[\x{2010}-\x{2015}]', '-', 'g'), '[^a-z0-9+\-.\s]', ' ', 'g'), '\s+', ' ', 'g')) AS keyword FROM documents")
def keyword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalise_keyword(F.col("text")).alias("keyword"))


_STOP = ["the", "and", "for", "que", "les", "der", "die", "und"]
_SQL_TOKENS = "list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9_\\-]+'), lambda t: lower(t)), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'for', 'que', 'les', 'der', 'die', 'und'))"


@query(f"SELECT doc_id, array_to_string({_SQL_TOKENS.format(x='text')}, ' ') AS tokens FROM documents")
def token_extract(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.tokens(F.col("text"), _STOP), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(flatten(list_transform(regexp_split_to_array(replace(text, '.', ';'), '[;,/|]'), lambda p: {_SQL_TOKENS.format(x='p')})), ' ') AS keywords FROM documents")
def author_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.author_keywords(F.replace("text", F.lit("."), F.lit(";")), _STOP), " ").alias("keywords"))


_HIT = {f: "regexp_matches(text, '(?i)(?:" + "|".join(p) + ")')" for f, p in LEXICON.items()}


@query("SELECT doc_id, CASE " + " ".join(f"WHEN {c} THEN '{f}'" for f, c in _HIT.items()) + " END AS family FROM documents")
def family_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lx.first_family(F.col("text"), LEXICON).alias("family"))


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in _HIT.items()) + "], lambda x: x IS NOT NULL), ',') AS families FROM documents")
def family_multi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lx.families(F.col("text"), LEXICON), ",").alias("families"))


def _sql_counts(fused: bool) -> str:
    one = lambda p: f"len(regexp_extract_all(text, '(?i){p}'))"
    cols = ", ".join((one("(?:" + "|".join(p) + ")") if fused else " + ".join(one(x) for x in p)) + f" AS {f}" for f, p in LEXICON.items())
    return f"SELECT doc_id, f AS family, n AS score FROM (UNPIVOT (SELECT doc_id, {cols} FROM documents) ON {', '.join(LEXICON)} INTO NAME f VALUE n) WHERE n > 0"


@query(_sql_counts(True))
def family_scores(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(lx.match_scores(F.col("text"), LEXICON)).alias("family", "score")).withColumn("score", F.col("score").cast("long"))


@query(_sql_counts(False))
def family_scores_by_pattern(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(lx.match_scores(F.col("text"), LEXICON, fused=False)).alias("family", "score")).withColumn("score", F.col("score").cast("long"))


@query(
    "WITH k AS (SELECT doc_id, list_distinct(list_transform(string_split(text, ' '), lambda w: lower(w))) AS ws FROM documents) SELECT doc_id, f AS family, n AS score FROM (UNPIVOT (SELECT doc_id, "
    + ", ".join(f"len(list_filter(ws, lambda w: regexp_matches(w, '(?i)(?:{'|'.join(p)})'))) AS {f}" for f, p in LEXICON.items())
    + f" FROM k) ON {', '.join(LEXICON)} INTO NAME f VALUE n) WHERE n > 0"
)
def family_keyword_scores(spark, sf_dir):
    words = F.transform(F.split("text", " "), F.lower)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(lx.keyword_scores(words, LEXICON)).alias("family", "score")).withColumn("score", F.col("score").cast("long"))


@query(
    """
    SELECT doc_id, i AS chunk, len(c) AS n, array_to_string(c, ' ') AS words FROM (
      SELECT doc_id, i, t[i * 60 + 1 : i * 60 + 100] AS c FROM (
        SELECT doc_id, t, unnest(generate_series(0, greatest(0, ceil((len(t) - 100) / 60.0)::INT))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)))
    """
)
def overlap_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks(F.split("text", " "), 100, 60)).alias("chunk", "c"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.size("c").cast("long").alias("n"), F.array_join("c", " ").alias("words"))


@query(
    """
    SELECT doc_id, i AS chunk, array_to_string(t[i * 64 + 1 : i * 64 + 64], ' ') AS words FROM (
      SELECT doc_id, t, unnest(generate_series(0, greatest(0, ceil(len(t) / 64.0)::INT - 1))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))
    """
)
def token_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.chunks(F.split("text", " "), 64)).alias("chunk", "c"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.array_join("c", " ").alias("words"))


@query(
    """
    SELECT doc_id, (i // 150) AS win, array_to_string(t[i + 1 : i + 180], ' ') AS words FROM (
      SELECT doc_id, t, unnest(generate_series(0, greatest(1, len(t) - 180 + 1) - 1, 150)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))
    """
)
def token_windows(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.windows(F.split("text", " "), 180, 150)).alias("win", "c"))
    return c.select("doc_id", F.col("win").cast("long").alias("win"), F.array_join("c", " ").alias("words"))


@query(r"SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE regexp_replace(substr(t, 1, 80), ' [^ ]*$', '') || '...' END AS short FROM (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS t FROM documents)")
def truncate_at_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_at_word(F.col("text"), 80).alias("short"))


@query(
    r"""
    SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN strpos(h, ' ') > 0 AND length(h) - strpos(reverse(h), ' ') > 80 THEN regexp_replace(h, ' [^ ]*$', '') || '...' ELSE h || '...' END AS short
    FROM (SELECT doc_id, text, substr(text, 1, 97) AS h FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\.([A-Z])', '. \1', 'g') AS text FROM documents))
    """
)
def display_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.truncate_for_display(tx.for_display(F.col("text")), 100).alias("short"))


@query(
    """
    WITH p AS (SELECT d.doc_id, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '') AS w, lower(d.text) AS s FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id),
    t AS (SELECT doc_id, len(w) AS n, i, contains(s, w[i]) AS hit, CASE WHEN i > 1 THEN contains(s, w[i - 1]) ELSE false END AS before FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM p))
    SELECT doc_id, round(count(*) FILTER (hit) / any_value(n)::DOUBLE, 6) AS coverage, round(CASE WHEN count(*) FILTER (hit AND NOT before) = 0 THEN 0 ELSE count(*) FILTER (hit) / count(*) FILTER (hit AND NOT before)::DOUBLE END, 6) AS density FROM t GROUP BY doc_id
    """
)
def extractive_fragments(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("summary"))
    met = table(spark, sf_dir, "documents").join(b, F.col("doc_id") % 40 == F.col("item_id"))
    coverage, density = tx.extractive_fragments(F.col("summary"), F.col("text"))
    return met.select("doc_id", F.round(coverage, 6).alias("coverage"), F.round(density, 6).alias("density"))


@query(
    """
    SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, length(text) AS chars, round(length(substr(text, 1, 100)) / length(text)::DOUBLE, 6) AS compression,
           CASE WHEN trim(text) = '' THEN 'empty' ELSE 'process' END AS status FROM documents WHERE length(text) BETWEEN 11 AND 20000
    """
)
def text_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text").between(11, 20000))
    return docs.select("doc_id", tx.n_words(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.round(F.length(F.substring("text", 1, 100)) / F.length("text"), 6).alias("compression"), filters.status(F.col("text")).alias("status"))


@query("SELECT doc_id, coalesce(predicted_label, label) AS label FROM (SELECT doc_id, CASE WHEN quality = 1 THEN '1' WHEN toxic = 1 THEN 'not_methodology' END AS predicted_label, CASE WHEN doc_id % 2 = 0 THEN 'methodology' ELSE '0' END AS label FROM labels) WHERE coalesce(predicted_label, label) IN ('methodology', '1')")
def keep_methodology(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "1").when(F.col("toxic") == 1, "not_methodology").alias("predicted_label"), F.when(F.col("doc_id") % 2 == 0, "methodology").otherwise("0").alias("label"))
    return filters.keep_methodology(p).select("doc_id", F.coalesce("predicted_label", "label").alias("label"))


@query("SELECT doc_id, length(text) AS n, row_number() OVER (ORDER BY length(text), doc_id) AS place FROM documents WHERE length(text) <= 400")
def char_limit_sorted(spark, sf_dir):
    return filters.char_limit(table(spark, sf_dir, "documents"), 400)


@query("SELECT doc_id, CASE WHEN cluster = -1 THEN '-1_Noise' ELSE cluster || '_' || kw || '_n=' || n END AS label FROM (SELECT doc_id, (doc_id % 5) - 1 AS cluster, array_to_string(string_split(text, ' ')[1:3], '_') AS kw, length(text) AS n FROM documents)")
def cluster_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.cluster_label((F.col("doc_id") % 5) - 1, F.split("text", " "), F.length("text")).alias("label"))


@query("SELECT conv_id, string_agg('[' || rn || '] ' || s, chr(10) || chr(10) ORDER BY rn) AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn, CASE WHEN length(t) <= 60 THEN t ELSE regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') || '...' END AS s FROM (SELECT conv_id, turn, text, trim(replace(text, chr(10), ' ')) AS t FROM conversations)) GROUP BY conv_id")
def prompt_block(spark, sf_dir):
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("texts"))
    return texts.select("conv_id", tx.numbered_block(F.col("texts"), 60).alias("prompt"))


@query("SELECT doc_id, array_to_string(p[1:6], '[MASK]') || CASE WHEN len(p) > 6 THEN 'th' || array_to_string(p[7:], 'th') ELSE '' END AS masked FROM (SELECT doc_id, string_split(text, 'th') AS p FROM documents)")
def span_mask(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.span_mask(F.col("text"), "th").alias("masked"))


@query("SELECT event_id, user_id || '|' || event_type || '|' || (event_id % 7) AS key, replace('a/' || event_type, '/', '_') AS safe_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS code FROM events")
def composite_key(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", filters.composite_key("user_id", "event_type", (F.col("event_id") % 7)).alias("key"), filters.safe_id(F.concat(F.lit("a/"), "event_type")).alias("safe_id"), filters.label_code(F.col("event_type"), {"click": 1, "view": 0}).alias("code"))


@query("SELECT event_id, CAST(props ->> '$.k' AS VARCHAR) AS k, props AS again FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").alias("again"))
