"""Column functions over text. Whitespace and word classes are ASCII, as in Java regexes, unless a docstring says else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns of the cleaning rules
MATH_TAG = r"\[MATH_tex=.*?\]"
MATH = r"(\$[^$]+\$)|\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)"
CITATION = r"\(([^()]*\d{4}[^()]*)\)|\[[0-9,\s;]+\]"
CAPTION = r"(?i)^\s*(Figure|Table)\s+\d+"
URL = r"https?://\S+"
TOKEN = r"[A-Za-z][A-Za-z0-9_\-]+"


def mask_math_tags(text: Column) -> Column:
    """[MATH_tex=...] becomes [MATH]. The match ends at the first bracket, so a formula with one leaves a tail."""
    return F.regexp_replace(text, MATH_TAG, "[MATH]")


def classifier_input(section: Column, paragraph: Column) -> Column:
    """'section - tail': what follows the paragraph's last ']' after masking, so all before a bracket is lost."""
    return F.concat(section, F.lit(" - "), F.substring_index(F.replace(paragraph, F.lit("[MATH_tex="), F.lit("[MATH]")), "]", -1))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean(text: Column) -> Column:
    """Formulas to a space, citations to <CIT> (any parenthesis with four digits counts), URLs to a space, caption lines
    dropped, white space collapsed; in this order. Null gives an empty text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), MATH, " ")
    t = F.regexp_replace(t, CITATION, " <CIT> ")
    t = F.regexp_replace(t, URL, " ")
    lines = F.filter(F.split(t, "\r\n|\n|\r"), lambda x: ~x.rlike(CAPTION))
    return collapse(F.array_join(lines, " "))


def n_words(text: Column) -> Column:
    """Words parted by white space; 0 for an empty text."""
    return F.regexp_count(text, F.lit(r"\S+"))


def paragraphs(text: Column, least: int = 200, cleaned: bool = True) -> Column:
    """Paragraphs of a text as an array: parts between blank lines, or lines if there is one part; cleaned; those of
    `least` characters and more. Places in the array count survivors."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    parts = F.split(raw, r"\n\s*\n")
    parts = F.when(F.size(parts) == 1, F.filter(F.split(raw, "\n"), lambda x: F.trim(x) != "")).otherwise(parts)
    return F.filter(F.transform(parts, clean if cleaned else collapse_ends), lambda x: F.length(x) >= least)


def collapse_ends(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def plain_paragraphs(text: Column) -> Column:
    """Parts between two line feeds that hold more than white space, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), collapse_ends), lambda x: x != "")


def normalise_keyword(text: Column) -> Column:
    """Lower case, dashes made alike, all but a-z, 0-9, '+', '-', '.' and white space to spaces, collapsed."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    t = F.regexp_replace(t, "[‐-―]", "-")
    return collapse(F.regexp_replace(t, r"[^a-z0-9+\-.\s]", " "))


def tokens(text: Column, stop: list[str] | None = None, least: int = 3) -> Column:
    """Lower-cased word tokens, without stop words, of `least` characters and more."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)
    keep = F.filter(found, lambda x: F.length(x) >= least)
    return F.filter(keep, lambda x: ~x.isin(stop)) if stop else keep


def author_keywords(text: Column, stop: list[str] | None = None) -> Column:
    """Tokens of each part of a keyword list parted by ';', ',', '/' or '|'."""
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), r"[;,/|]"), lambda p: tokens(p, stop)))


def count_substring(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def keyword_density(text: Column, words: list[str], weight: float) -> Column:
    """Occurrences of the words in the lower-cased text, times the weight, by the number of words (1 at least)."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [count_substring(low, w) for w in words]) * F.lit(weight) / F.greatest(n_words(text), F.lit(1))


def windows(items: Column, size: int, step: int) -> Column:
    """Windows of `size` items every `step`; a tail shorter than a step is dropped; a short array is one window."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size(items) - size + 1) - 1, F.lit(step))
    return F.transform(starts, lambda i: F.slice(items, i + 1, F.lit(size)))


def chunks(items: Column, size: int, step: int | None = None) -> Column:
    """Chunks of `size` items every `step` (default: size), the tail kept; an empty array is one empty chunk. With a
    step below the size, no chunk begins once one has reached the end."""
    step = step or size
    last = F.greatest(F.lit(0), F.ceil((F.size(items) - size) / F.lit(step)).cast("int")) if step < size else F.greatest(F.lit(0), F.ceil(F.size(items) / F.lit(step)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * step + 1, F.lit(size)))


def truncate_at_word(text: Column, limit: int) -> Column:
    """Line feeds to spaces, trimmed; beyond the limit cut at the last space before it, with '...'."""
    t = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), " [^ ]*$", ""), F.lit("...")))


def truncate_for_display(text: Column, limit: int) -> Column:
    """Beyond the limit: cut three characters before it, at a word's end if that lies in the last fifth, with '...'."""
    head = F.substring(text, 1, limit - 3)
    space = F.length(head) - F.instr(F.reverse(head), " ")  # place of the last space, from 0; the length if none
    if limit > 10:
        at_word = (F.instr(head, " ") > 0) & (space > limit * 0.8)
        head = F.when(at_word, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit("...")))


def for_display(text: Column) -> Column:
    """White space collapsed, and a space between a full stop and a capital."""
    return F.regexp_replace(collapse(F.coalesce(text, F.lit(""))), r"\.([A-Z])", r". $1")


def extractive_fragments(summary: Column, source: Column) -> tuple[Column, Column]:
    """(coverage, density): the share of summary words that the source holds as substrings, and their number by run."""
    words = F.filter(F.split(F.lower(summary), r"\s+"), lambda x: x != "")
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("runs"), F.lit(False).alias("on"))

    def found(words, low):
        """Whether the text holds each word; a word that comes again is looked up, not searched again."""
        each = F.array_distinct(words)
        return F.map_from_arrays(each, F.transform(each, lambda w: F.contains(low, w)))

    def step(acc, here):
        return F.struct((acc.hits + here.cast("int")).alias("hits"), (acc.runs + (here & ~acc.on).cast("int")).alias("runs"), here.alias("on"))

    def scores(words, low):
        hits = F.transform(F.array(found(words, low)), lambda held: F.transform(words, lambda w: F.coalesce(F.try_element_at(held, w), F.lit(False))))[0]
        done = F.aggregate(hits, start, step)
        return F.transform(F.array(done), lambda d: F.array(F.when(F.size(words) > 0, d.hits / F.size(words)).otherwise(F.lit(0.0)), F.when(d.runs > 0, d.hits / d.runs).otherwise(F.lit(0.0))))[0]

    # bound in arrays of one: a plain column would be lowered again for each word
    both = F.transform(F.arrays_zip(F.array(words).alias("w"), F.array(F.lower(source)).alias("low")), lambda x: scores(x.w, x.low))[0]
    return both[0], both[1]


def cluster_label(cluster: Column, keywords: Column, size: Column) -> Column:
    """'3_kw1_kw2_kw3_n=12', and '-1_Noise' for noise; '3_n=12' without keywords, an empty keyword being one. Null if any
    part is."""
    joined = F.array_join(F.slice(keywords, 1, 3), "_")
    known = cluster.isNotNull() & keywords.isNotNull() & size.isNotNull()
    return F.when(cluster == -1, F.lit("-1_Noise")).when(known, F.concat_ws("_", cluster.cast("string"), F.when(F.size(keywords) > 0, joined), F.concat(F.lit("n="), size.cast("string"))))


def numbered_block(texts: Column, limit: int) -> Column:
    """'[1] text' lines of an array, parted by blank lines, each cut at the limit."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), truncate_at_word(t, limit))), "\n\n")


def escape_latex(text: Column) -> Column:
    """LaTeX's special characters escaped, the backslash first, so nothing is escaped twice."""
    for c, by in (("\\", "\\textbackslash "), ("&", "\\&"), ("%", "\\%"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("~", "\\textasciitilde "), ("^", "\\textasciicircum ")):
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def span_mask(text: Column, pattern: str, most: int = 5) -> Column:
    """The first `most` matches of a pattern become [MASK]."""
    found = F.slice(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), 1, most)
    start = F.struct(F.lit("").alias("done"), text.alias("rest"))

    def step(acc, m):
        at = F.position(m, acc.rest)
        return F.struct(F.concat(acc.done, F.substr(acc.rest, F.lit(1), at - 1), F.lit("[MASK]")).alias("done"), F.substr(acc.rest, at + F.length(m)).alias("rest"))

    out = F.aggregate(found, start, step)
    return F.concat(out.done, out.rest)
