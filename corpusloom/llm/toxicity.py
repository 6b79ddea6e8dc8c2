"""Toxicity by gradient-boosted trees over dense text features (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, pieces, span_hashes, utf8, word_spans

#: Labelled rows that the model is fitted on, at most, of either class; the class weights restore the true rates.
MOST_TOXIC, MOST_CLEAN = 3000, 5000
#: Entries of a lexicon, at most, and the bytes of a word's beginning in the lexicon of beginnings.
LEXICON, PREFIX = 4096, 5
FOLDS = 5
STRONG = 2.0
NEAR = 5

# fixed values: second-person words of the four languages
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinem deinen ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes vosotros ti tus tú vuestro os".split()
# fixed values: characters that stand for letters in disguised words
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK = ~_LETTER & ~_SPACE
_PUNCT = _MARK.copy()
_PUNCT[48:58] = False
_FOLD = LOWER.copy()
for _a, _b in LEET.items():
    _FOLD[ord(_a)] = ord(_b)

FEATURES = (
    "log_words", "lexicon", "distinct", "strongest", "second", "beginnings", "strongest_beginning", "mean_odds",
    "near_second_person", "second_person", "capitals", "capital_words", "punctuation", "exclamations", "inner_marks", "repeats", "disguised",
)


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends))


_SECOND = _hashes(SECOND_PERSON)


def _words(data: np.ndarray, offs: np.ndarray):
    """Hashes of the words (runs of letters, A-Z lower-cased), of the beginnings of the longer ones (0 for others), and
    the word offsets of the texts."""
    low = LOWER[data]
    starts, ends, at = word_spans(data, offs, ~_LETTER)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), at, starts, ends
    begin = span_hashes(low, starts, np.minimum(ends, starts + PREFIX))
    begin[ends - starts <= PREFIX] = 0
    return span_hashes(low, starts, ends), begin, at, starts, ends


@dataclass
class Lexicon:
    """Log-odds of toxic against clean by hash, sorted by hash."""

    keys: np.ndarray
    odds: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.odds[at], 0.0)


def _lexicon(keys: np.ndarray, pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> Lexicon:
    """The keys of the greatest log-odds among those that enough toxic texts hold."""
    odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
    keep = np.flatnonzero((pos >= max(3, 0.002 * n_pos)) & (odds > 1.0) & (keys != 0))
    keep = keep[np.argsort(-odds[keep], kind="stable")][:LEXICON]
    keep = keep[np.argsort(keys[keep])]
    return Lexicon(keys[keep], odds[keep])


def features(column: pa.Array, words: Lexicon, begins: Lexicon) -> np.ndarray:
    """Texts x FEATURES. Rates are of words or characters, so texts of any length compare; an empty text has zeros."""
    data, offs = utf8(column)
    n = len(offs) - 1
    hashes, begin, at, starts, ends = _words(data, offs)
    count = np.maximum(np.diff(at), 1)
    size = np.maximum(np.diff(offs), 1)
    doc = np.repeat(np.arange(n), np.diff(at))

    def words_of(x):
        return np.bincount(doc, weights=x, minlength=n) if len(doc) else np.zeros(n)

    def bytes_of(x):
        c = np.concatenate([[0], np.cumsum(x)])
        return (c[offs[1:]] - c[offs[:-1]]).astype(float)

    odds, head = words.of(hashes), begins.of(begin)
    strong, strong_head = odds >= STRONG, head >= STRONG
    hit = np.flatnonzero(strong | strong_head)
    top, top_head, second, distinct = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    np.maximum.at(top, doc[hit], odds[hit])
    np.maximum.at(top_head, doc[hit], head[hit])
    if len(hit):
        pairs = np.unique(np.stack([doc[hit].astype(np.uint64), hashes[hit]]), axis=1)
        distinct = np.bincount(pairs[0].astype(np.int64), minlength=n).astype(float)
        np.maximum.at(second, doc[hit], np.where(odds[hit] < top[doc[hit]], odds[hit], 0))
    you = np.zeros(len(hashes), bool)
    if len(hashes):
        p = np.minimum(np.searchsorted(_SECOND, hashes), len(_SECOND) - 1)
        you = _SECOND[p] == hashes
    total = np.concatenate([[0], np.cumsum(you)])
    near = np.zeros(n)
    if len(hit):
        lo, hi = np.maximum(hit - NEAR, at[doc[hit]]), np.minimum(hit + NEAR + 1, at[doc[hit] + 1])
        np.add.at(near, doc[hit], (total[hi] > total[lo]).astype(float))
    letter, mark = _LETTER[data], _MARK[data]
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = mark[1:-1] & letter[:-2] & letter[2:]
        # a mark run of two or three between letters counts too
        inner[1:-2] |= mark[1:-2] & mark[2:-1] & letter[:-3] & letter[3:]
    low = LOWER[data]
    again = np.zeros(len(data), bool)
    if len(data) > 2:
        again[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
    caps = _CAPITAL[data]
    cum = np.concatenate([[0], np.cumsum(caps)])
    shout = ((cum[ends] - cum[starts]) == (ends - starts)) & (ends - starts > 1)
    inner_n = bytes_of(inner)
    disguised = np.zeros(n)
    some = np.flatnonzero(inner_n > 0)
    if len(some):  # only texts with marks inside words are looked at again
        sub = np.concatenate([data[offs[i] : offs[i + 1]] for i in some])
        to = np.concatenate([[0], np.cumsum(np.diff(offs)[some])])
        fold = _FOLD[sub]
        keep = _LETTER[fold] | _SPACE[fold]
        moved = np.concatenate([[0], np.cumsum(keep)])
        s, e, w_at = word_spans(fold[keep], moved[to], _SPACE)
        if len(s):
            raw_s, raw_e, raw_at = word_spans(sub, to, _SPACE)
            raw_inner = np.concatenate([[0], np.cumsum(np.concatenate([inner[offs[i] : offs[i + 1]] for i in some]))])
            # of the tokens as they stand, only those that keep a letter remain after folding
            kept = (moved[raw_e] - moved[raw_s]) > 0
            odd = (raw_inner[raw_e] - raw_inner[raw_s] > 0)[kept]
            found = (words.of(span_hashes(fold[keep], s, e)) >= STRONG) & odd
            disguised[some] = np.bincount(np.repeat(np.arange(len(some)), np.diff(w_at)), weights=found, minlength=len(some))
    return np.stack([
        np.log1p(np.diff(at)), words_of(strong) / count, distinct, top, second, words_of(strong_head) / count, top_head, words_of(odds) / count,
        near / count, words_of(you) / count, bytes_of(caps) / size, words_of(shout) / count, bytes_of(_PUNCT[data]) / size, bytes_of(data == 33) / size, inner_n / count, bytes_of(again) / size, disguised,
    ], 1)


class Boosting:
    """Gradient-boosted regression trees for the logistic loss, over features cut into bins at quantiles."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosting:
        q = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(v[v != 0] if (v != 0).any() else v, q)) for v in x.T]
        rate = float((w * y).sum() / w.sum())
        self.base = np.log((rate + 1e-6) / (1 - rate + 1e-6))
        b, f = self._binned(x), np.full(len(x), self.base)
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = w * (y - p), w * p * (1 - p)
            size = 1 << (self.depth + 1)
            feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
            node = np.ones(len(x), np.int64)
            for level in range(self.depth + 1):
                for k in range(1 << level, 2 << level):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    sg, sh = g[rows].sum(), h[rows].sum()
                    value[k] = self.rate * sg / (sh + self.ridge)
                    if level == self.depth or sh < 2 * self.least * 0.05:
                        continue
                    best = (1e-6, -1, 0)
                    for j in range(x.shape[1]):
                        m = len(self.edges[j]) + 1
                        hg, hh = np.cumsum(np.bincount(b[rows, j], g[rows], m))[:-1], np.cumsum(np.bincount(b[rows, j], h[rows], m))[:-1]
                        n = np.cumsum(np.bincount(b[rows, j], minlength=m))[:-1]
                        ok = (n >= self.least) & (len(rows) - n >= self.least)
                        if ok.any():
                            gain = np.where(ok, hg**2 / (hh + self.ridge) + (sg - hg) ** 2 / (sh - hh + self.ridge) - sg**2 / (sh + self.ridge), -1)
                            if gain.max() > best[0]:
                                best = (float(gain.max()), j, int(gain.argmax()))
                    if best[1] >= 0:
                        feature[k], cut[k] = best[1], best[2]
                        node[rows] = 2 * k + (b[rows, best[1]] > best[2])
            f += value[node]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.base)
        row = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                j = feature[node]
                go = np.flatnonzero(j >= 0)
                node[go] = 2 * node[go] + (b[row[go], j[go]] > cut[node[go]])
            f += value[node]
        return f


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (scores, rates) of the non-decreasing fit of y, by pooling adjacent violators."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v, k in zip(score[order], y[order], w[order], strict=True):
        blocks.append([v * k, k, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    x = np.array([p for b in blocks for p in (b[2], b[3])])
    v = np.array([p for b in blocks for p in (b[0] / b[1],) * 2])
    return x, v


def _counts(column: pa.Array, y: np.ndarray, fold: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (kind 0) or beginnings (1) that three toxic texts or more hold, by hash, and for each fold the numbers of
    toxic and of clean texts with them. Texts are read a few hundred at a time, and clean ones only for these words."""

    def distinct(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(rows), 256):
            part = rows[i : i + 256]
            found = _words(*utf8(column.take(pa.array(part))))
            for j, r in enumerate(part):
                yield np.unique(found[kind][found[2][j] : found[2][j + 1]]), fold[r]

    toxic = list(distinct(np.flatnonzero(y == 1)))
    keys, n = np.unique(np.concatenate([k for k, _ in toxic]), return_counts=True)
    keys = keys[n >= 3]
    out = np.zeros((2 * FOLDS, len(keys)), np.int64)
    for c, texts in ((0, toxic), (1, distinct(np.flatnonzero(y == 0)))):
        for k, f in texts:
            at = np.minimum(np.searchsorted(keys, k), max(0, len(keys) - 1))
            out[2 * f + c, at[keys[at] == k] if len(keys) else []] += 1
    return keys, out


class Model:
    """Lexicons, trees and calibration, fitted on a bounded sample; small enough to go with every task."""

    def __init__(self, column: pa.Array, y: np.ndarray, w: np.ndarray):
        self.rate = float((w * y).sum() / w.sum()) if len(y) else 0.0
        self.constant = len(set(y.tolist())) < 2 or int(min(y.sum(), len(y) - y.sum())) < 10
        if self.constant:
            return
        fold = np.arange(len(y)) % FOLDS  # the sample comes in hash order
        tables = [_counts(column, y, fold, kind) for kind in (0, 1)]
        classes = np.array([[((fold == f) & (y == c)).sum() for c in (1, 0)] for f in range(FOLDS)])

        def lexicons(without: int | None):
            use = [f for f in range(FOLDS) if f != without]
            n_pos, n_neg = classes[use].sum(0)
            return [_lexicon(k, sum(t[2 * f] for f in use), sum(t[2 * f + 1] for f in use), n_pos, n_neg) for k, t in tables]

        x = np.zeros((len(y), len(FEATURES)))
        for f in range(FOLDS):  # a row's features never come from lexicons that saw its label
            rows, lexica = np.flatnonzero(fold == f), lexicons(f)
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                x[part] = features(column.take(pa.array(part)), *lexica)
        margin = np.zeros(len(y))
        for half in (0, 1):  # calibration on margins from trees that did not see the row
            rows = fold % 2 == half
            margin[rows] = Boosting().fit(x[~rows], y[~rows], w[~rows]).margin(x[rows])
        self.words, self.begins = lexicons(None)
        self.trees = Boosting().fit(x, y, w)
        self.knots = isotonic(margin, y.astype(float), w)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant:
            return np.full(len(column), self.rate)
        margin = self.trees.margin(features(column, self.words, self.begins))
        smooth = 1 / (1 + np.exp(-margin))  # orders what isotonic steps tie
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 * smooth, 0, 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the labels outside the held-out fifth, fitted on MOST_TOXIC and MOST_CLEAN rows at most, the first by
    a hash of the id. A doc_id with several labels is toxic if any says so; one with several texts gives the smallest."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {int(r[0] > 0): r[1] for r in known.groupBy((F.col("toxic") > 0).cast("int")).count().collect()}
    order = F.xxhash64("doc_id")
    part = lambda c, n: known.where((F.col("toxic") > 0) == bool(c)).orderBy(order, "doc_id").limit(n)
    ids = part(1, MOST_TOXIC).union(part(0, MOST_CLEAN))
    ids = spark.createDataFrame(ids.toArrow()) if sizes else known.limit(0)  # at most 8000 pairs of numbers
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    table = sample.orderBy(order, "doc_id").toArrow()
    y = np.asarray(table["toxic"]) > 0 if table.num_rows else np.zeros(0, bool)
    w = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            w[y == c] = sizes[c] / (y == c).sum()
    w /= w.mean() if len(w) else 1
    return Model(table["text"].combine_chunks(), y.astype(int), w)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    score: the calibrated probability that labels.toxic marks the text; predicted: 1 from 0.5. The score depends on the
    text alone. Null and empty texts are scored as texts without words. Repeated rows are scored each; a null doc_id is
    not held out. With fewer than 10 rows of either class every score is the labelled rate (0 without labels). Extra
    columns are ignored; an empty table gives an empty result. Texts are read whole, whatever their length."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two lexicons of at most LEXICON entries and the trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                s = shared.value.score(p.column(2))
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the model does not reject (score below 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, "text"):
                yield p.filter(pa.array(shared.value.score(p.column(at).cast(pa.string())) < 0.5))

    return docs.mapInArrow(run, docs.schema)
