"""URL filter (operator 1): glob rules as one bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A glob over the canonical URL, '.' + host + '#' + path, in which '#' stands once. name: what a decided URL reports; None for the method's own
    rules, which decide only where no named rule fits."""

    glob: str
    verdict: str
    name: str | None = None


def prefix_rule(rule: str, verdict: str) -> Rule:
    """host/path: fits the host, its subdomains and every path that starts so."""
    host, slash, path = rule.partition("/")
    return Rule(f"*.{host}#{slash}{path}*", verdict, rule)


#: The production rules.
RULES = (
    prefix_rule("com/en/", "block"),
    prefix_rule("example.com/en/7", "allow"),
    prefix_rule("net/de/", "allow"),
    prefix_rule("example.net/de/8", "block"),
    prefix_rule("org/es/", "block"),
    Rule("*.spam-*#*", "block"),
    Rule("*cheap-pills.*#*", "block"),
    Rule("*casino*#*", "block"),
    Rule("*#*/wp-login.php*", "block"),
)


class Automaton:
    """Multiword Shift-And over all globs at once. Each pattern owns consecutive bits: one for its start, one for each
    literal. A '*' is a self-loop on the bit before it, '?' a literal that takes any character. One step for a
    character c over all words: D = ((D << 1) & takes[c]) | (D & loops), with the carry moved between words. Characters
    that no pattern names share one class."""

    def __init__(self, globs: Sequence[str]):
        literals = sorted({ord(c) for g in globs for c in g if c not in "*?"})
        self.alphabet = np.array(literals, np.uint32)
        bits: list[tuple[str | None, bool]] = []
        self.accept: list[int] = []
        begin: list[int] = []
        for g in globs:
            begin.append(len(bits))
            bits.append((None, g[:1] == "*"))
            for i, c in enumerate(g):
                if c != "*":
                    bits.append((c, g[i + 1 : i + 2] == "*"))
            self.accept.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.takes = np.zeros((len(literals) + 1, self.words), np.uint64)
        self.loops, self.start = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        where = {c: i for i, c in enumerate(literals)}
        for i, (c, loop) in enumerate(bits):
            w, bit = i // 64, np.uint64(1 << (i % 64))
            if loop:
                self.loops[w] |= bit
            if c == "?":
                self.takes[:, w] |= bit
            elif c is not None:
                self.takes[where[ord(c)], w] |= bit
        for i in begin:
            self.start[i // 64] |= np.uint64(1 << (i % 64))

    def matches(self, texts: list[str]) -> np.ndarray:
        """texts x globs: does the whole text fit the glob? All texts of a batch step together, longest first."""
        n = len(texts)
        out = np.zeros((n, len(self.accept)), bool)
        if not n:
            return out
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        size = np.array([len(c) for c in codes])
        order = np.argsort(-size, kind="stable")
        active = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
        flat = np.concatenate([codes[i] for i in order]) if size.sum() else np.zeros(0, np.uint32)
        at = np.concatenate([[0], np.cumsum(size[order])])[:-1]
        cls = np.minimum(np.searchsorted(self.alphabet, flat), max(0, len(self.alphabet) - 1))
        cls = np.where(self.alphabet[cls] == flat, cls, len(self.alphabet)) if len(self.alphabet) else np.zeros(len(flat), np.int64)
        d = np.tile(self.start, (n, 1))
        for j, k in enumerate(active):
            now = d[:k]
            moved = now << np.uint64(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[:k] = (moved & self.takes[cls[at[:k] + j]]) | (now & self.loops)
        for g, i in enumerate(self.accept):
            out[order, g] = (d[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) != 0
        return out


_UPPER, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url):
    """Host and path columns of a URL column. Host: after the first '://' up to '/', '?', '#' or the end, A-Z
    lower-cased; path: from there up to '?', '#' or the end; null or no '://': both empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _DOWN)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    The longest named rule that fits decides (ties: the smaller name); else the method's own globs: any that blocks
    blocks; else `default`. Null, empty and malformed URLs have host and path '' and get the default. Repeated rows are
    judged each; other columns are ignored; an empty table gives an empty result. URLs of any length are read whole."""
    automaton = Automaton([r.glob for r in rules])
    ranked = sorted((i for i, r in enumerate(rules) if r.name is not None), key=lambda i: (len(rules[i].name), [-ord(c) for c in rules[i].name]))
    own = [i for i, r in enumerate(rules) if r.name is None and r.verdict == "block"]
    names = pa.array([rules[i].name for i in ranked], pa.string())
    verdicts = [rules[i].verdict for i in ranked]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                fits = automaton.matches([f".{h}#{p}" for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)])
                best = np.full(part.num_rows, -1)
                for k, i in enumerate(ranked):
                    best[fits[:, i]] = k
                method = np.where(fits[:, own].any(1), "block", default) if own else np.full(part.num_rows, default)
                verdict = np.where(best >= 0, np.array([*verdicts, ""])[best], method)
                rule = names.take(pa.array(best, mask=best < 0)) if len(names) else pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, rule, pa.array(verdict.tolist(), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = canonical(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
