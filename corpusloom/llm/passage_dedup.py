"""Near-duplicate passages by compact windows of token min-hashes (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain as chain_of

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Staged, column_name, mix, pieces, shingle_hashes, small, span_hashes, utf8, word_spans
from .common import _powers as powers

#: Words of the shortest passage, and of a shingle.
WORDS, SHINGLE = 50, 5
#: Shingles of such a passage.
SIZE = WORDS - SHINGLE + 1
#: Hash functions, and how many of them must agree on a common region. At a similarity of 0.75 fewer than 2 of 7 agree
#: with a chance of 0.13 %, at 0.8 of 0.04 %.
FUNCTIONS, ENOUGH = 7, 2
#: Runs of equal shingles by which regions meet: (length, successive runs of which the least hash is taken). Of any
#: stretch of length + among - 1 equal shingles one run at least is taken, the same one wherever the stretch stands. A
#: passage of WORDS words has a stretch of 46, and 40 of 46 equal shingles are near enough (40 / 52); two near ones have
#: one of 20 in common at least, for no more than a seventh of either may differ.
LONG, SHORT = (40, 7), (12, 9)
#: Jaccard index of the shingle sets from which passages are near-duplicates, in hundredths.
SIMILAR = 75
#: Shingles without a match that a passage may hold in a row, and the shift between its parts.
GAP = 12
#: Equal places that the runs of a passage have at least: 40 of SIZE shingles, less what may stand elsewhere.
EQUAL = 40 - GAP
#: Shingles on either side of a shared one within which every passage through it has WORDS words at least, and how many
#: of them a passage of up to four times that length shares at least (a seventh of it may differ).
REACH, SHARED = WORDS - SHINGLE, 20
def compact_windows(h: np.ndarray, size: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compact windows of at least `size` values: (first, least, last) indices, where h[least] is the least value of
    h[first..last] (the leftmost of equals) and neither end can move outward. Zeros in h part the texts and are in no
    window. most (`size` - 1 at least): ends farther than that from the least value may be cut short.

    These are the nodes of the Cartesian tree of h whose ranges are long enough. Such a node is least over `size` / 2
    values on one side at least, which leaves few candidates; their nearest smaller values are found by descending a
    table of minima of doubling spans, for all candidates at once."""
    n, half = len(h), (size + 1) // 2
    if n < size:
        return (np.zeros(0, np.int64),) * 3
    levels = [h]
    while 2 << (len(levels) - 1) <= n and (most is None or 1 << (len(levels) - 1) <= most):
        low, step = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(low[:-step], low[step:]))
    k = max(0, half.bit_length() - 1)
    while (1 << k) > half:
        k -= 1
    row = levels[k]
    span = np.minimum(row[: n - half + 1], row[half - (1 << k) : half - (1 << k) + n - half + 1])
    least = np.zeros(n, bool)
    least[: len(span)] |= h[: len(span)] == span
    least[half - 1 :] |= h[half - 1 :] == span
    at = np.flatnonzero(least & (h != 0))
    value = h[at]
    left, right = at.copy(), at.copy()
    for j in range(len(levels) - 1, -1, -1):
        row, step = levels[j], 1 << j
        to = left - step
        ok = to >= 0
        ok[ok] = row[to[ok]] > value[ok]  # an equal value on the left ends the window
        left[ok] = to[ok]
        ok = right + step < n
        ok[ok] = row[right[ok] + 1] >= value[ok]
        right[ok] += step
    keep = right - left + 1 >= size
    return left[keep], at[keep], right[keep]


def _shingled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and their offsets."""
    data, offs = utf8(column)
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs)
    return shingle_hashes(span_hashes(low, starts, ends), at, SHINGLE)


def _signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, signature and window of every compact window of all hash functions. The signature is of the function
    and the least shingle. A window is one number: the place of its least shingle, the function, and how far it reaches
    to either side (REACH at most, for no passage of WORDS words through that shingle reaches farther)."""
    # a single word repeated at length gives equal shingles at every place: nothing to do, ties take the leftmost
    sh, to = _shingled(column)
    n = np.diff(to)
    long = n >= SIZE
    owner = np.repeat(np.arange(len(n)), n)
    keep = long[owner]
    sh, owner = sh[keep], owner[keep]
    if not len(sh):
        return (np.zeros(0, np.int64),) * 3
    place = np.arange(len(keep))[keep] - to[owner]
    # a zero before every text
    texts = np.flatnonzero(long)
    spot = np.arange(len(sh)) + np.searchsorted(texts, owner) + 1
    spread = np.zeros(len(sh) + len(texts), np.uint32)
    back = np.zeros(len(spread), np.int64)
    back[spot] = np.arange(len(sh))
    out = []
    for k in range(FUNCTIONS):
        spread[spot] = np.maximum(mix(sh ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))) >> np.uint64(32), 1).astype(np.uint32)
        first, least, last = compact_windows(spread, SIZE, REACH)
        c = back[least]
        window = (place[c] << 15) | (k << 12) | (np.minimum(least - first, REACH) << 6) | np.minimum(last - least, REACH)
        out.append((owner[c], mix(sh[c] + np.uint64(k)).view(np.int64), window))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _regions(windows: np.ndarray, text: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For the shingles of several texts (offsets to), and the windows whose signatures other texts have too (of the texts
    with numbers text): which shingles are in a region of SIZE or more that windows of ENOUGH functions have in common,
    that is, in a passage of which ENOUGH functions' signatures occur elsewhere. An interval join: windows of two
    functions meet if both least shingles are in both."""
    c = (windows >> 15) + to[text]
    order = np.argsort(c, kind="stable")
    windows, text, c = windows[order], text[order], c[order]
    f, lo, hi = windows >> 12 & 7, c - (windows >> 6 & 63), c + (windows & 63)
    edge = np.zeros(to[-1] + 1, np.int64)
    for d in range(1, len(c)):
        near = c[d:] - c[:-d] <= REACH
        if not near.any():
            break
        low, high = np.maximum(lo[d:], lo[:-d]), np.minimum(hi[d:], hi[:-d])
        ok = near & (f[d:] != f[:-d]) & (text[d:] == text[:-d]) & (low <= c[:-d]) & (c[d:] <= high) & (high - low + 1 >= SIZE)
        edge += np.bincount(low[ok], minlength=len(edge)) - np.bincount(high[ok] + 1, minlength=len(edge))
    return np.cumsum(edge[:-1]) > 0


def _runs(sh: np.ndarray, to: np.ndarray, inside: np.ndarray, length: int, among: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the runs taken of several texts' shingles, of those that lie inside regions. Which runs are
    taken depends on the texts' shingles around them, not on the regions."""
    n = len(sh) - length + 1
    if n < among:
        return (np.zeros(0, np.int64),) * 2
    up, down = powers(len(sh) + 1)
    total = np.zeros(len(sh) + 1, np.uint64)
    np.cumsum(sh * up[: len(sh)], out=total[1:])
    key = mix((total[length:] - total[:n]) * down[:n] + np.uint64(length))
    best, least = key[: n - among + 1].copy(), np.arange(n - among + 1)
    for j in range(1, among):
        less = key[j : j + len(best)] < best
        best[less] = key[j : j + len(best)][less]
        least[less] = np.flatnonzero(less) + j
    end = np.repeat(to[1:], np.diff(to))[: len(best)]
    least = least[np.arange(len(best)) + among - 1 + length <= end]  # windows within one text
    at = np.unique(least)
    covered = np.concatenate([[0], np.cumsum(inside)])
    at = at[covered[at + length] - covered[at] == length]
    return key[at].view(np.int64), at


def _partners(at: np.ndarray, key: np.ndarray, n: np.ndarray, of: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the runs of one text that earlier texts have (place, key, length, first text, place there): those that say whom
    to compare it with, and keys and places of pairs of runs.

    The first text with a long run has a passage that nearly repeats it, so shorter runs within say nothing more. Short
    runs within a passage's length that first occur in different texts, or far apart in one, are paired: who holds both
    may be a third text, the first that has the pair."""
    order = np.argsort(at, kind="stable")
    at, key, n, of, to = (x[order] for x in (at, key, n, of, to))
    size = int(at[-1]) + LONG[0] + 2
    long = n == LONG[0]
    edge = np.bincount(at[long], minlength=size) - np.bincount(at[long] + LONG[0], minlength=size)
    sure = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
    keep = long | (sure[at + n] - sure[at] < n)
    short = keep & ~long
    a, k, o, shift = at[short], key[short].view(np.uint64), of[short], (at - to)[short]
    keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, len(a)):
        near = a[d:] - a[:-d] <= SIZE - SHORT[0]
        if not near.any():
            break
        ok = np.flatnonzero(near & ((o[d:] != o[:-d]) | (np.abs(shift[d:] - shift[:-d]) > GAP)) & (k[d:] != k[:-d]))
        keys.append(mix(mix(k[ok]) + k[ok + d]).view(np.int64))
        places.append(a[ok])
    pair, one = np.unique(np.concatenate(keys), return_index=True)
    return order[keep], pair, np.concatenate(places)[one]


def _places(a: np.ndarray, b: np.ndarray, s: int, spots: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Those of the places of a[s] in b around which enough of what stands around s occurs too, best first. Where either
    side repeats shingles, all are kept. again: running counts of the places of b that repeat one shortly before."""
    if len(spots) < 2:
        return spots
    around = a[max(0, s - REACH) : s + REACH + 1]
    sums = np.concatenate([[0], np.cumsum(np.isin(b, around))])
    lo, hi = np.maximum(spots - REACH, 0), np.minimum(spots + REACH + 1, len(b))
    n = sums[hi] - sums[lo]
    keep = (n >= SHARED) | (again[hi] > again[lo]) | (len(np.unique(around)) < len(around))
    order = np.argsort(-n, kind="stable")
    return spots[order[keep[order]]]


def _around(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the shingles within REACH of each place, and of where the text ends among them."""
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[: len(b)], out=total[1:])
    lo, hi = np.maximum(at - REACH, 0), np.minimum(at + REACH + 1, len(b))
    return mix((total[hi] - total[lo]) * down[lo]) + (at - lo).astype(np.uint64) * np.uint64(128) + (hi - at).astype(np.uint64)


def _clustered(equal: np.ndarray, gap: int) -> np.ndarray:
    """For every place, how many equal ones the cluster has that it is in: places with at most `gap` between them."""
    out = np.zeros(len(equal), np.int64)
    at = np.flatnonzero(equal)
    if len(at):
        number = np.concatenate([[0], np.cumsum(np.diff(at) > gap + 1)])
        out[at] = np.bincount(number)[number]
    return out


def _longest(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """The longest stretch of successive runs whose sets are alike, and the longest ones before and after it."""
    size = SIZE
    out: list[tuple[int, int, int, int, float]] = []
    todo = [chain]
    while todo:
        c = todo.pop()
        best: tuple[int, int, int, float] | None = None
        a_end, b_end = np.array([r[1] for r in c]), np.array([r[1] + r[2] for r in c])
        parts = a[c[0][0] : a_end.max() + 1], b[min(r[0] + r[2] for r in c) : b_end.max() + 1]
        plain = all(len(np.unique(x)) == len(x) for x in parts)  # nothing repeats: runs do not overlap and count as sets
        sums = np.concatenate([[0], np.cumsum([r[1] - r[0] + 1 for r in c])])
        for i in range(len(c)):
            a0, b0 = c[i][0], c[i][0] + c[i][2]
            to_a, to_b = np.maximum.accumulate(a_end[i:]), np.maximum.accumulate(b_end[i:])
            if to_a[-1] - a0 + 1 < size or (best and to_a[-1] - a0 < best[0]):
                break
            if plain:
                both = sums[i + 1 :] - sums[i]
                union = to_a - a0 + 1 + to_b - b0 + 1 - both
                good = np.flatnonzero((100 * both >= SIMILAR * union) & (to_a - a0 + 1 >= size) & (to_b - b0 + 1 >= size))
                if len(good) and (not best or to_a[good[-1]] - a0 > best[0]):
                    g = int(good[-1])
                    best = (int(to_a[g]) - a0, i, i + g, both[g] / union[g])
                    found = (a0, int(to_a[g]), b0, int(to_b[g]), float(best[3]))
                continue
            x, at_x = np.unique(a[a0 : to_a[-1] + 1], return_index=True)
            y, at_y = np.unique(b[b0 : to_b[-1] + 1], return_index=True)
            _, k, l = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            in_x, in_y = np.searchsorted(to_a - a0, at_x), np.searchsorted(to_b - b0, at_y)  # the run by which each is in
            count = lambda v: np.cumsum(np.bincount(v, minlength=len(to_a)))
            both = count(np.maximum(in_x[k], in_y[l]))
            union = count(in_x) + count(in_y) - both
            good = np.flatnonzero((100 * both >= SIMILAR * union) & (to_a - a0 + 1 >= size) & (to_b - b0 + 1 >= size))
            if len(good) and (not best or to_a[good[-1]] - a0 > best[0]):
                g = int(good[-1])
                best = (int(to_a[g]) - a0, i, i + g, both[g] / union[g])
                found = (a0, int(to_a[g]), b0, int(to_b[g]), float(best[3]))
        if best:
            out.append(found)
            todo += [part for part in (c[: best[1]], c[best[2] + 1 :]) if part]
    return out


def _widened(first: int, last: int, n: int) -> tuple[int, int]:
    """A stretch of n shingles' places widened to SIZE where there is room: to the right, then to the left."""
    last = min(n - 1, max(last, first + SIZE - 1))
    return max(0, min(first, last - SIZE + 1)), last


def _passages(a: np.ndarray, b: np.ndarray, seeds: np.ndarray, to: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """Near-duplicate passages of two sequences of shingles: (first, last of a, first, last of b, Jaccard index). seeds:
    places in a whose shingle b has too; to: a place of each in b to try first.

    From each seed all its places in b are looked at, around which enough is alike, until a passage covers it. Runs of equal shingles on the
    diagonals at most GAP from that through seed and place, at most GAP apart, make one passage, widened to SIZE shingles
    where it is shorter (its ends may be what differs); its sets decide, and
    where they differ too much, the longest stretches of successive runs whose sets are alike. What recurs elsewhere in
    b lies on other diagonals and parts nothing."""
    size = SIZE
    order = np.argsort(b, kind="stable")
    sorted_b = b[order]
    again = np.zeros(len(b) + 1, np.int64)
    again[order[1:][(sorted_b[1:] == sorted_b[:-1]) & (np.diff(order) <= 2 * REACH)] + 1] = 1
    again = np.cumsum(again)
    lines: dict[int, list[tuple[int, int, int]]] = {}
    out: dict[tuple[int, int, int, int], float] = {}

    left, right = np.searchsorted(sorted_b, a, "left"), np.searchsorted(sorted_b, a, "right")
    many = right - left
    few = int(many.sum()) <= 4 * (len(a) + len(b))
    if few:  # all equal pairs of places, as runs by diagonal; texts that repeat themselves at length go line by line
        i = np.repeat(np.arange(len(a)), many)
        j = order[np.arange(len(i)) + np.repeat(left - np.cumsum(many) + many, many)]
        by = np.lexsort((i, j - i))
        i, shift = i[by], (j - i)[by]
        new = np.ones(len(i), bool)
        new[1:] = (shift[1:] != shift[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        run_at, run_shift = i[first], shift[first]
        run_end = i[np.append(first[1:], len(i)) - 1] if len(first) else first
        sums = np.concatenate([[0], np.cumsum(run_end - run_at + 1)])

    def line(d: int) -> list[tuple[int, int, int]]:
        if d not in lines:
            i0, i1 = max(0, -d), min(len(a), len(b) - d)
            same = a[i0:i1] == b[i0 + d : i1 + d] if i1 > i0 else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            lines[d] = [(x, y, d) for x, y in zip((edge[::2] + i0).tolist(), (edge[1::2] + i0 - 1).tolist(), strict=True)]
        return lines[d]

    def near(d: int) -> list[tuple[int, int, int]]:
        if not few:
            return sorted(r for e in range(d - GAP, d + GAP + 1) for r in line(e))
        k = slice(*np.searchsorted(run_shift, [d - GAP, d + GAP + 1]))
        return sorted(zip(run_at[k].tolist(), run_end[k].tolist(), run_shift[k].tolist(), strict=True))

    chains: dict[int, list[list[tuple[int, int, int]]]] = {}

    def band(d: int) -> list[list[tuple[int, int, int]]]:
        if d not in chains:
            made: list[list[tuple[int, int, int]]] = []
            last = 0
            for r in near(d):
                if made and r[0] <= last + GAP + 1:
                    made[-1].append(r)
                    last = max(last, r[1])
                else:
                    made.append([r])
                    last = r[1]
            chains[d] = made
        return chains[d]

    judged: set[tuple[tuple[int, int, int], ...]] = set()
    alike_a, alike_b = _clustered(many > 0, GAP), _clustered(np.isin(b, a), 3 * GAP)
    enough = alike_a[seeds] >= EQUAL
    seeds, to = seeds[enough], to if to is None else to[enough]
    begun = [] if to is None else zip(seeds.tolist(), ([t] for t in to.tolist()), strict=True)
    for s, spots in chain_of(begun, ((s, None) for s in seeds.tolist())):
        if spots is None:
            if any(x <= s <= y for x, y, _, _ in out):
                continue
            spots = order[left[s] : right[s]]
            spots = spots[alike_b[spots] >= EQUAL]
            if len(spots) > 4:  # places of b with equal surroundings are tried once
                spots = spots[np.unique(_around(b, spots), return_index=True)[1]]
            if few:  # diagonals with enough equal places in all
                lo, hi = np.searchsorted(run_shift, spots - s - GAP, "left"), np.searchsorted(run_shift, spots - s + GAP, "right")
                spots = spots[sums[hi] - sums[lo] >= EQUAL]
            spots = _places(a, b, s, spots, again).tolist()
        for t in spots:
            if any(x <= s <= y and z <= t <= w for x, y, z, w in out):
                continue
            for chain in band(t - s):
                if chain[0][0] > s:
                    break
                if max(r[1] for r in chain) < s or tuple(chain) in judged:
                    continue
                judged.add(tuple(chain))
                if sum(r[1] - r[0] + 1 for r in chain) < EQUAL:
                    continue
                a0, a1 = chain[0][0], max(r[1] for r in chain)
                b0, b1 = min(r[0] + r[2] for r in chain), max(r[1] + r[2] for r in chain)
                if min(a1 - a0, b1 - b0) + 1 < size:
                    a0, a1 = _widened(a0, a1, len(a))
                    b0, b1 = _widened(b0, b1, len(b))
                if min(a1 - a0, b1 - b0) + 1 < size:
                    continue
                x, y = np.unique(a[a0 : a1 + 1]), np.unique(b[b0 : b1 + 1])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= SIMILAR * (len(x) + len(y) - both):
                    out[a0, a1, b0, b1] = both / (len(x) + len(y) - both)
                    continue
                for *found, share in _longest(a, b, chain):
                    out[tuple(found)] = share
    return [(*k, v) for k, v in sorted(out.items())]


def _keyed(docs: DataFrame) -> DataFrame:
    """rid (a hash of id and text, which tells the rows of one id apart), none (whether the id is null), doc (0 then),
    text."""
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.xxhash64("doc_id", text).alias("rid"), own.isNull().alias("none"), F.coalesce(own, F.lit(0)).alias("doc"), text.alias("text"))


#: Whether a key's first holder, a struct `first`, is of a smaller id than the row. A null id is after all others.
_LATER = "NOT first.none AND (none OR doc > first.doc)"


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of _keyed, equal ones once; and rid, none, doc, of_rid, of, n_words: those whose whole text, of WORDS
    words at least, is that of a row with a smaller id."""
    rows = _keyed(docs)
    facts = Staged(rows.select("rid", "none", "doc", F.md5("text").alias("same"), F.octet_length("text").alias("n")), "facts")
    if not facts.df.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["rid"])
    texts = facts.df.where(F.col("n") >= 2 * WORDS - 1)
    first = texts.groupBy("same").agg(F.min(F.struct("none", "doc", "rid")).alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1")
    equal = Staged(texts.join(first, "same").where(_LATER).select("rid", F.col("first.rid").alias("of_rid"), F.col("first.doc").alias("of")).distinct(), "equal")
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    copies = rows.join(small(equal.df), "rid").select("rid", "none", "doc", "of_rid", "of", n_words.alias("n_words")).where(F.col("n_words") >= WORDS)
    out = Staged(copies, "copies").df
    equal.drop()
    facts.drop()
    return rows, out


def _first_holders(runs: DataFrame) -> DataFrame:
    """runs (key, rid, none, doc, at) of all rows but the first of each key, with first: its none, doc, rid and at."""
    first = runs.groupBy("key").agg(F.min(F.struct("none", "doc", "rid", "at")).alias("first"), F.max(F.struct("none", "doc")).alias("last"))
    first = Staged(first.where("first.none < last.none OR first.doc < last.doc").select("key", "first"), "first-holders")
    met = Staged(runs.join(first.df.hint("shuffle_hash"), "key").where(_LATER), "met")
    first.drop()
    return met


_RUN = "key long, rid long, none boolean, doc long, at int, n int"
_PASSAGES = "rid long, none boolean, doc long, start long, n_words long, of long, of_start long, of_words long, similarity double"


def _candidates(rows: DataFrame, copies: DataFrame) -> Staged:
    """rid, of_rid, seeds: rows of which passages may nearly repeat one of an earlier row, and the places (in shingles, in
    either) where runs that both have begin."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                text, key, window = _signatures(p.column(1))
                if len(text):
                    yield pa.RecordBatch.from_arrays([pa.array(key), p.column(0).take(pa.array(text)), pa.array(window)], names=["g", "rid", "w"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                text, key, _ = _signatures(p.column(1))
                if len(text):
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["g", "n"])

    texts = rows.select("rid", "text")
    shared = texts.mapInArrow(distinct, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").select("g")
    shared = Staged(shared, "signatures")  # written first, so that Spark can split the large partitions of the join
    held = Staged(texts.mapInArrow(sign, "g long, rid long, w long").join(shared.df.hint("shuffle_hash"), "g").groupBy("rid").agg(F.collect_list("w").alias("windows")), "windows")  # of one text
    shared.drop()
    marked = held.df.join(copies.select("rid"), "rid", "left_anti").join(rows, "rid")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text", 1 << 20):
                sh, to = _shingled(p.column(4))
                lists = p.column(1)
                text = np.repeat(np.arange(p.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                inside = _regions(np.asarray(lists.flatten()), text, to)
                for length, among in (LONG, SHORT):
                    key, at = _runs(sh, to, inside, length, among)
                    text = np.searchsorted(to, at, "right") - 1
                    order = np.lexsort((at, key, text))  # of equal runs of one text, the first place
                    key, at, text = key[order], at[order], text[order]
                    new = np.ones(len(key), bool)
                    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                    key, at, text = key[new], at[new], text[new]
                    which = pa.array(text)
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(p.column(c).take(which) for c in (0, 2, 3)), pa.array(at - to[text], pa.int32()), pa.array(np.full(len(key), length), pa.int32())], names=["key", "rid", "none", "doc", "at", "n"])

    runs = Staged(marked.select("rid", "windows", "none", "doc", "text").mapInArrow(sample, _RUN), "runs")
    held.drop()
    met = _first_holders(runs.df)
    runs.drop()

    lists = met.df.groupBy("rid", "none", "doc").agg(F.collect_list(F.struct("at", "key", "n", F.col("first.rid").alias("of"), F.col("first.at").alias("to"))).alias("list"))  # of one text

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, key, n, of, to = (np.asarray(x).astype(np.int64) for x in b.column(3)[i].values.flatten())
                keep, pair, places = _partners(at, key, n, of, to)
                own = pa.array(np.full(len(keep) + len(pair), i))
                after, before = pa.nulls(len(keep), pa.int64()), pa.nulls(len(pair), pa.int64())
                cols = [pa.concat_arrays([after, pa.array(pair)]), *(b.column(c).take(own) for c in (0, 1, 2)), pa.array(np.concatenate([at[keep], places]), pa.int32()), pa.array(np.full(len(own), SHORT[0]), pa.int32())]
                cols += [pa.concat_arrays([pa.array(of[keep]), before]), pa.concat_arrays([pa.array(to[keep]), before])]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "rid", "none", "doc", "at", "n", "of_rid", "to"])

    chosen = Staged(lists.mapInArrow(choose, _RUN + ", of_rid long, to long"), "chosen")
    met.drop()
    again = _first_holders(chosen.df.where("key IS NOT NULL").drop("of_rid", "to"))
    links = chosen.df.where("key IS NULL").select("rid", "of_rid", "at", "to").union(again.df.select("rid", "first.rid", "at", F.col("first.at").cast("long")))
    out = Staged(links.groupBy("rid", "of_rid").agg(F.collect_set(F.struct("at", "to")).alias("seeds")), "links")  # of one text
    chosen.drop()
    again.drop()
    return out


def passages(docs: DataFrame) -> DataFrame:
    """rid, none, doc, start, n_words, of, of_start, of_words, similarity: passages of rows that nearly repeat one of an
    earlier row; places and lengths in words."""
    rows, copies = _copies(docs)
    links = _candidates(rows, copies).df
    # One exchange of the texts serves both joins: they read the same columns.
    mine, other = rows.alias("mine"), rows.alias("other")
    both = links.join(mine, links.rid == F.col("mine.rid")).select(links.rid.alias("a"), "of_rid", "seeds", F.col("none").alias("a_none"), F.col("doc").alias("a_doc"), F.col("text").alias("a_text"))
    both = both.join(other, F.col("of_rid") == F.col("rid")).select("a", "of_rid", "seeds", "a_none", "a_doc", "a_text", F.col("doc").alias("of"), F.col("text").alias("of_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the shingles of the last earlier text: pairs often come by it
        for batch in (p for b in batches for p in pieces(b, "a_text", 1 << 20)):
            made = []
            sh, to = _shingled(batch.column(5))
            rid, of_rid, none, doc, of = (batch.column(c).to_pylist() for c in (0, 1, 3, 4, 6))
            for i in range(batch.num_rows):
                if of_rid[i] not in held:
                    held = {of_rid[i]: _shingled(batch.column(7).slice(i, 1))[0]}
                at, other = (np.asarray(x).astype(np.int64) for x in batch.column(2)[i].values.flatten())
                order = np.argsort(at, kind="stable")
                for a0, a1, b0, b1, s in _passages(sh[to[i] : to[i + 1]], held[of_rid[i]], at[order], other[order]):
                    made.append((rid[i], none[i], doc[i], a0, a1 - a0 + SHINGLE, of[i], b0, b1 - b0 + SHINGLE, s))
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.float64()]
            cols = list(zip(*made, strict=True)) if made else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in _PASSAGES.split(", ")])

    zero = F.lit(0).cast("long")
    whole = copies.select("rid", "none", "doc", zero.alias("start"), "n_words", "of", zero.alias("of_start"), F.col("n_words").alias("of_words"), F.lit(1.0).alias("similarity"))
    return both.mapInArrow(verify, _PASSAGES).union(whole)


def near_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, of_doc_id, of_start, of_words, similarity: each passage of at least WORDS words of a row
    that nearly repeats one of a row with a smaller doc_id (places in words parted by ASCII white space, from 0;
    similarity: the Jaccard index of the sets of 5-word shingles, 0.75 or more).

    A whole text that an earlier row has too is one passage. Else each passage is linked to the first row that holds one
    of its runs of shingles, at three lengths, and to the first that holds two runs which first occur in different rows:
    representatives, so the links of a passage that many rows share are as many as the rows. Null, empty
    and shorter texts have no passages. Rows of one doc_id are not compared with each other; equal rows give their
    passages each; a null doc_id comes after all others and is returned as null. Extra columns are ignored; an empty
    table gives an empty result."""
    return passages(docs).select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "start", "n_words", F.col("of").alias("of_doc_id"), "of_start", "of_words", "similarity")


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs with every such passage cut out of the row that comes later; the first copy stays. Of the text around a cut
    nothing changes. Rows keep their columns and their number; a text that is one repeated passage becomes empty."""
    names, rid, found = docs.columns, column_name(docs, "rid"), column_name(docs, "parts")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    parts = passages(docs).groupBy(F.col("rid").alias(rid)).agg(F.collect_set(F.struct("start", "n_words")).alias(found))  # of one text
    met = docs.withColumn(rid, F.xxhash64(F.col("doc_id"), text)).join(parts, rid, "left").select(*names, found)
    at = [n.lower() for n in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            found = cols.pop()
            text = cols[at].to_pylist()
            for i in np.flatnonzero(np.asarray(found.is_valid())).tolist():
                data, offs = utf8(pa.array([text[i]], pa.string()))
                starts, ends, _ = word_spans(data, offs)
                raw, left, end = data.tobytes(), [], 0
                for p in sorted((x["start"], x["n_words"]) for x in found[i].as_py()):
                    a, z = int(starts[p[0]]), int(ends[p[0] + p[1] - 1])
                    if a > end:
                        left.append(raw[end:a])
                    end = max(end, z)
                text[i] = b"".join([*left, raw[end:]]).decode()
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return met.mapInArrow(run, docs.schema)
