"""Removal of repeated byte strings by suffix order and longest-previous-factor arrays (operator 8)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, _powers, mix, pieces, utf8

#: Bytes of a match, and of the grams among which each match chooses its anchor.
MATCH, GRAM = 100, 18
#: Occurrences of an anchor beyond which its windows are judged one by one, each by its own hash: so many spans of one
#: anchor, of less than two matches each, are what a task holds at most besides a chunk.
HOT = 20_000
#: Bytes of spans whose suffixes are sorted at once.
CHUNK = 1 << 20
_BLOCK = 1 << 23
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _gram_hashes(data: np.ndarray, seed: np.uint64) -> np.ndarray:
    n = len(data) - GRAM + 1
    up, down = _powers(len(data) + 1)
    table = mix(np.arange(1, 257, dtype=np.uint64) * seed)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[GRAM:] - total[:n]) * down[:n])


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window start, the place of the leftmost gram of least hash in the window. The order is by 40 bits of the
    hash, so it depends on content alone."""
    w = MATCH - GRAM + 1
    key = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
    low, step = key, 1
    while 2 * step <= w:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    n = len(key) - w + 1
    return (np.minimum(low[:n], low[w - step : w - step + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts of one text that share their anchor: text number, first and last start (in data), hash of
    the anchor's gram."""
    out: list[tuple[np.ndarray, ...]] = []
    ends = offs[1:]
    at = 0
    while at + MATCH <= len(data):  # in blocks that overlap by a window less one byte, for texts beyond the key's 24 bits
        part = data[at : at + _BLOCK + MATCH - 1]
        hashes = _gram_hashes(part, _SEEDS[0])
        anchor = _anchors(hashes)
        start = np.arange(len(anchor)) + at
        text = np.searchsorted(offs, start, "right") - 1
        ok = np.flatnonzero(start + MATCH <= ends[text])
        if len(ok):
            a, t = anchor[ok], text[ok]
            new = np.ones(len(ok), bool)
            new[1:] = (a[1:] != a[:-1]) | (ok[1:] != ok[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(ok)) - 1
            out.append((t[first], start[ok[first]], start[ok[last]], hashes[a[first]]))
        at += _BLOCK
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _window_hashes(data: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of the MATCH bytes from each place on."""
    n = len(data) - MATCH + 1
    up, down = _powers(len(data) + 1)
    table = mix(np.arange(1, 257, dtype=np.uint64) * (seed ^ np.uint64(MATCH)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[MATCH:] - total[:n]) * down[:n]).view(np.int64)


def suffix_ranks(data: np.ndarray, depth: int = MATCH) -> dict[int, np.ndarray]:
    """Ranks of all suffixes of data by their first 8, 16, ... and `depth` bytes (data must go on for `depth` bytes behind
    each place that is looked at; missing bytes count as zeros): prefix doubling from 8-byte words, exact."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = (word << np.uint64(8)) | padded[j : j + n]
    rank = np.unique(word, return_inverse=True)[1].astype(np.int64)
    have = 8
    out = {have: rank.astype(np.int32)}
    while have < depth:
        step = min(have, depth - have)
        behind = np.concatenate([rank[step:], np.full(min(step, n), -1, np.int64)])[:n] + 1
        rank = np.unique(rank * np.int64(n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        have += step
        out[have] = rank.astype(np.int32)
    return out


def common_prefixes(data: np.ndarray, ranks: dict[int, np.ndarray], at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at `at` and `to` share, up to the depth of the ranks: by equal ranks of 64, 32, 16 and
    8 bytes, then byte by byte."""
    depth = max(ranks)
    out = np.where(ranks[depth][at] == ranks[depth][to], depth, 0)
    rest = np.flatnonzero(out == 0)
    a, b, end = at[rest], to[rest], len(data)
    shared = np.zeros(len(rest), np.int64)
    for step in sorted((k for k in ranks if k < depth), reverse=True):
        ok = np.maximum(a, b) + shared < end
        ok[ok] = ranks[step][a[ok] + shared[ok]] == ranks[step][b[ok] + shared[ok]]
        shared[ok] += step
    open_ = np.ones(len(rest), bool)
    for _ in range(7):
        open_ &= np.maximum(a, b) + shared < end
        open_[open_] = data[a[open_] + shared[open_]] == data[b[open_] + shared[open_]]
        shared[open_] += 1
    out[rest] = np.minimum(shared, depth)
    return out


def _smaller_before(place: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For every suffix (in suffix order), the common prefix with the nearest one before it of a smaller place, 0 where
    there is none; shared[i]: of suffix i with the one before. Each suffix looks at its left neighbour and, while that
    is of no smaller place, at the one it looks at: all suffixes at once, so paths halve each round."""
    n = len(place)
    to = np.arange(n) - 1
    low = shared.copy()
    active = np.arange(n)
    while True:
        active = active[to[active] >= 0]
        active = active[place[to[active]] >= place[active]]
        if not len(active):
            break
        by = to[active]
        low_by, to_by = low[by], to[by]
        low[active] = np.minimum(low[active], low_by)
        to[active] = to_by
    low[to < 0] = 0
    return low


def longest_previous_factors(data: np.ndarray, ranks: dict[int, np.ndarray], at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For the suffixes of data at `at`, in the order of their places in the corpus, the length of the longest match that
    starts earlier, up to the depth of the ranks: the larger of the common prefixes with the suffixes of the previous and
    the next smaller place in suffix order."""
    order = np.lexsort((place, ranks[max(ranks)][at]))
    a, p = at[order], place[order]
    shared = np.zeros(len(at), np.int64)
    shared[1:] = common_prefixes(data, ranks, a[:-1], a[1:])
    before = _smaller_before(p, shared)
    after = _smaller_before(p[::-1], np.concatenate([[0], shared[:0:-1]]))[::-1]
    out = np.zeros(len(at), np.int64)
    out[order] = np.maximum(before, after)
    return out


def _judge(rows: list[tuple[int, bool, int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """Spans (key, none, doc, rid, start, bytes) in, repeated parts (rid, doc, start, end) out."""
    out = []
    first: dict[tuple[int, bytes], tuple[bool, int, int, int]] = {}
    rows.sort(key=lambda r: r[1:5])
    for key, *own, span in rows:
        own = tuple(own)
        if first.setdefault((key, span), own) != own:
            out.append((own[2], own[1], own[3], own[3] + len(span)))
    by: dict[int, list] = {}
    for (key, span), own in first.items():
        by.setdefault(key, []).append((own, span))
    some = [x for xs in by.values() if len(xs) > 1 for x in xs]
    some += [x for xs in by.values() if len(xs) == 1 and len(xs[0][1]) > MATCH for x in xs]  # a span may repeat itself
    some.sort(key=lambda x: x[0])
    if some:
        sizes = np.array([len(s) for _, s in some])
        data = np.frombuffer(b"".join(s for _, s in some), np.uint8)
        begin = np.cumsum(sizes) - sizes
        windows = sizes - MATCH + 1
        at = np.arange(windows.sum()) + np.repeat(begin - np.cumsum(windows) + windows, windows)
        # places in the order of (none, doc, rid, start): a place is its row's number and start
        number = {d: i for i, d in enumerate(sorted({o[:3] for o, _ in some}))}
        of = np.array([number[o[:3]] for o, _ in some])
        start = np.array([o[3] for o, _ in some])
        place = np.repeat((of << 36) + start - begin, windows) + at
        hit = longest_previous_factors(data, suffix_ranks(data), at, place) >= MATCH
        edge = np.concatenate([[0], np.cumsum(windows)])
        padded = np.concatenate([[False], hit, [False]])
        cut = np.zeros(len(padded), bool)
        cut[edge + 1] = True  # runs end with their span
        on = np.flatnonzero(padded[1:-1] & (~padded[:-2] | cut[1:-1]))
        off = np.flatnonzero(padded[1:-1] & (~padded[2:] | cut[2:]))
        which = np.searchsorted(edge, on, "right") - 1
        for i, a, b in zip(which.tolist(), (on - edge[which]).tolist(), (off - edge[which]).tolist(), strict=True):
            (_, doc, rid, s0), _ = some[i]
            out.append((rid, doc, s0 + a, s0 + b + MATCH))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """rid (a hash of id and text, which tells the rows of one id apart), none (whether the id is null), doc (0 then),
    t (a hash of the text), text."""
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.xxhash64("doc_id", text).alias("rid"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))


#: What the windows around repeated anchors give: a span of windows (key: the anchor), a part that a span before it in the
#: same batch settles, or a window of a hot anchor (key and stop: two hashes of it).
_SPAN, _SETTLED, _WINDOW = 0, 1, 2
_MADE = "kind int, key long, none boolean, doc long, rid long, start long, stop long, span binary"
_PARTS = "rid long, doc long, start long, stop long"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, k in zip(cols, types, strict=True)], names=list(names))


def _gram_counts(rows: DataFrame) -> DataFrame:
    """h, t, n: the distinct anchors of each text and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                text, _, _, h = _runs(*utf8(p.column(1)))
                if not len(h):
                    continue
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), p.column(0).take(pa.array(text[at])), pa.array(np.diff(np.append(at, len(h))))], names=["h", "t", "n"])

    return rows.select("t", "text").mapInArrow(run, "h long, t long, n long")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, none, doc, text, hs, hots) in, _MADE out."""
    for b in batches:
        for p in pieces(b, "text", 1 << 20):
            data, offs = utf8(p.column(3))
            text, lo, hi, h = _runs(data, offs)
            edge = np.searchsorted(text, np.arange(p.num_rows + 1))
            raw = data.tobytes()
            seen: dict[tuple[int, bytes], tuple] = {}
            made, single = [], []
            owners = list(zip(*(p.column(c).to_pylist() for c in (1, 2, 0)), strict=True))
            for i in sorted(range(p.num_rows), key=owners.__getitem__):
                k = slice(edge[i], edge[i + 1])
                hs = h[k].view(np.int64)
                keep = np.isin(hs, np.asarray(p.column(4)[i].values))
                hot = np.isin(hs, np.asarray(p.column(5)[i].values))
                for key, a, z, alone in zip(hs[keep].tolist(), lo[k][keep].tolist(), hi[k][keep].tolist(), hot[keep].tolist(), strict=True):
                    span = raw[a : z + MATCH]
                    own = (*owners[i], a - int(offs[i]))
                    # within this batch an equal span that stands earlier settles it; only the first travels
                    if seen.setdefault((key, span), own) != own:
                        made.append((_SETTLED, None, *own, own[3] + len(span), None))
                    elif not alone:
                        made.append((_SPAN, key, *own, None, span))
                    else:
                        single.append((own, a, z))
            yield _batch(_MADE, made)
            for own, a, z in single:
                part = data[a : z + MATCH]
                n = z - a + 1
                one = pa.array(np.ones(n, np.int32) * _WINDOW)
                cols = [one, pa.array(_window_hashes(part, _SEEDS[0])), *(pa.array([x], k).take(pa.array(np.zeros(n, np.int32))) for x, k in zip(own[:3], (pa.bool_(), pa.int64(), pa.int64()), strict=True))]
                cols += [pa.array(own[3] + np.arange(n)), pa.array(_window_hashes(part, _SEEDS[1])), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _MADE.split(", ")])


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    size = 0
    for b in batches:
        parts = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if size > CHUNK and held[-1][0] != row[0]:  # rows come by key
                parts += _judge(held)
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
        yield _batch(_PARTS, parts)
    yield _batch(_PARTS, _judge(held) if held else [])


def repeated_parts(docs: DataFrame) -> Staged:
    """rid, doc, start, stop: bytes of documents covered by matches that start earlier. The parts may overlap."""
    rows = _keyed(docs)
    facts = Staged(rows.select("rid", "none", "doc", "t", F.md5("text").alias("same"), F.octet_length("text").cast("long").alias("n")), "facts")
    # Of equal texts the first stands for all: the others are repeats from end to end.
    first = facts.df.where(F.col("n") >= MATCH).groupBy("same").agg(F.min(F.struct("none", "doc", "rid")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    copies = Staged(facts.df.join(first, "same").where("rid <> first.rid OR doc <> first.doc").select("rid", "doc", "n"), "copies")

    found = _gram_counts(rows)
    counts = found.groupBy("h").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("n").alias("most"), F.sum("n").alias("total"))
    counts = Staged(counts.where("low < high OR most > 1").select("h", (F.col("total") > HOT).alias("hot")), "anchors")  # written first, so that Spark can split the large partitions of the join
    marks = found.select("h", "t").join(counts.df, "h").groupBy("t").agg(F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hots"))  # at most one for each of the text's anchors
    marks = Staged(marks, "marks")
    counts.drop()
    judged = facts.df.join(copies.df.select("rid"), "rid", "left_anti").select("rid", "t").distinct().join(marks.df, "t").drop("t")
    marked = rows.drop("t").join(judged, "rid")
    made = Staged(marked.select("rid", "none", "doc", "text", "hs", "hots").mapInArrow(_spans, _MADE), "spans")
    marks.drop()
    facts.drop()

    spans = made.df.where(F.col("kind") == _SPAN).select("key", "none", "doc", "rid", "start", "span")
    parts = spans.repartition("key").sortWithinPartitions("key").mapInArrow(_judged, _PARTS)
    windows = made.df.where(F.col("kind") == _WINDOW).select("key", F.col("stop").alias("more"), "none", "doc", "rid", "start")
    least = Staged(windows.groupBy("key", "more").agg(F.min(F.struct("none", "doc", "rid", "start")).alias("first"), F.max(F.struct("none", "doc", "rid", "start")).alias("last")).where("first <> last").select("key", "more", "first"), "hot-windows")
    single = windows.join(least.df, ["key", "more"]).where("struct(none, doc, rid, start) <> first").select("rid", "doc", "start", (F.col("start") + MATCH).alias("stop"))
    settled = made.df.where(F.col("kind") == _SETTLED).select("rid", "doc", "start", "stop")
    whole = copies.df.select("rid", "doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    out = Staged(parts.union(single).union(settled).union(whole), "parts")
    for x in (made, least, copies):
        x.drop()
    return out


def deduplicate(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text); keep_text adds kept, the
    bytes left.

    A byte goes if a string of MATCH bytes that covers it also starts earlier: in a row of a smaller doc_id, or earlier
    in its own. Strings are judged on the input. Rows of one doc_id with different texts count as documents in the order
    of a hash; equal rows count as one document and get the same result each; a null doc_id comes after all others. Null
    and empty texts have no bytes. Extra columns are ignored; an empty table gives an empty result.

    Equal strings choose the same anchor, the gram of least hash among their own, so only places that share an anchor
    are brought together: counts by anchor find those that occur twice, the windows around them travel as spans, and
    each task computes the longest previous factors of its spans' suffixes. Of equal texts, and of equal spans, the first
    stands for all. Each window of a very frequent anchor is a group of its own, by two hashes of its bytes, so no
    anchor's places meet in one task."""
    rows = _keyed(docs)
    parts = repeated_parts(docs).df.groupBy("rid").agg(F.collect_set(F.struct("doc", "start", "stop")).alias("parts"))  # of one text
    met = rows.join(parts, "rid", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            none, text, parts = b.column(1).to_pylist(), b.column(2).cast(pa.binary()), b.column(3)
            for i, doc in enumerate(b.column(0).to_pylist()):
                raw = text[i].as_buffer()
                n = raw.size
                left, removed, spans, end = [], 0, 0, 0
                view = memoryview(raw)
                if parts[i].is_valid:
                    v = parts[i].values
                    own = np.asarray(v.field(0)) == doc
                    s, e = np.asarray(v.field(1))[own], np.asarray(v.field(2))[own]
                    order = np.argsort(s, kind="stable")
                    at = -1
                    for a, z in zip(s[order].tolist(), e[order].tolist(), strict=True):
                        if a > at:  # a new maximal run
                            left.append(view[end:a])
                            spans += 1
                            removed += z - a
                            at = end = z
                        elif z > at:
                            removed += z - at
                            at = end = z
                left.append(view[end:n])
                total = hashlib.sha256()
                for x in left:
                    total.update(x)
                row = (None if none[i] else doc, n, removed, spans, total.hexdigest())
                made.append(row + ((b"".join(left),) if keep_text else ()))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            cols = list(zip(*made, strict=True)) if made else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return met.select("doc", "none", "text", "parts").mapInArrow(run, schema)
