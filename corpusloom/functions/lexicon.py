"""Tagging of texts by a lexicon: families of regular expressions, in the order in which they decide ties."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Lexicon = Mapping[str, Sequence[str]]


def union(patterns: Sequence[str]) -> str:
    """One pattern that ignores case and matches what any of them does."""
    return "(?i)(?:" + "|".join(patterns) + ")"


def first_family(text: Column, lexicon: Lexicon) -> Column:
    """The first family that the text hits; null if none."""
    return F.coalesce(*[F.when(text.rlike(union(p)), F.lit(f)) for f, p in lexicon.items()])


def families(text: Column, lexicon: Lexicon) -> Column:
    """All families that the text hits, in lexicon order."""
    return F.array_compact(F.array(*[F.when(text.rlike(union(p)), F.lit(f)) for f, p in lexicon.items()]))


def keyword_scores(keywords: Column, lexicon: Lexicon, distinct: bool = True) -> Column:
    """family -> number of keywords that hit it, without zeros. distinct: equal keywords count once."""
    words = F.array_distinct(keywords) if distinct else keywords
    hits = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern)))
    return _scores({f: hits(union(p)) for f, p in lexicon.items()})


def match_scores(text: Column, lexicon: Lexicon, fused: bool = True) -> Column:
    """family -> number of matches, without zeros. fused: of the union of a family's patterns, so overlapping matches
    count once; else summed over the patterns."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    if fused:
        return _scores({f: count(union(p)) for f, p in lexicon.items()})
    return _scores({f: sum((count("(?i)" + x) for x in p[1:]), count("(?i)" + p[0])) for f, p in lexicon.items()})


def _scores(by: dict[str, Column]) -> Column:
    full = F.create_map(*[x for f, n in by.items() for x in (F.lit(f), n)])
    return F.map_filter(full, lambda _, n: n > 0)
