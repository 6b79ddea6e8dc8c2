"""Best-fit packing of tokenized documents into sequences (operator 5)."""

from __future__ import annotations

import base64
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, pieces, span_hashes, utf8

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 2048, 0
#: Pieces that one task packs, about. Each group leaves at most a few sequences part full.
GROUP = 16_384
#: Slots of the table of known chunks (a power of 2), which begins anew when half full.
SLOTS = 1 << 21


@dataclass(frozen=True)
class Capacities:
    """What a sequence can hold in each dimension, and the weights of the dimensions in the choice of a bin. cost is the
    sum of the squares of the pieces' lengths, what attention within pieces costs."""

    tokens: int = LENGTH
    docs: int = LENGTH
    cost: int = LENGTH * LENGTH
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "norm"  # or "dot"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _added(path: str) -> list[dict]:
    """The tokens that the file adds to the vocabulary: `tokenizers` takes them from raw text before all else."""
    return json.load(open(path, encoding="utf-8")).get("added_tokens", [])  # noqa: SIM115


def _encoder(path: str):
    """str -> ids. Where the vocabulary also lies beside the file as ranks, tiktoken does the merges: the same ids some six
    times faster than `tokenizers`, which the tests compare. Texts are parted at the added tokens first."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    added = _added(path)
    if os.path.exists(ranks) and not any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}  # noqa: SIM115
        plain = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        ids = {a["content"]: a["id"] for a in added}
        if not ids:
            return plain
        parts = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")

        def encode(text: str) -> list[int]:
            cut = parts.split(text)
            return plain(text) if len(cut) == 1 else [i for p in cut for i in ([ids[p]] if p in ids else plain(p))]

        return encode
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    return lambda text: whole.encode(text, add_special_tokens=False).ids


class ChunkTokenizer:
    """Token ids of many texts, each distinct chunk encoded once.

    A token of this vocabulary may begin with a space but never holds one after another character, and of a run of white
    space the last space goes to the word that follows. So a text may be cut before every space that something other
    than white space or an added token follows, and the ids of its chunks in order are the ids of the text: white space
    before an added token ends a part of the text and keeps its last space. Chunks are told apart by 64-bit hashes, found for whole batches at once in an open-addressed table."""

    def __init__(self, path: str):
        self.encode = _encoder(path)
        self.added = [a["content"].encode() for a in _added(path)]
        # never cut before a space that one of these bytes follows: ASCII white space, and first bytes of other white space
        self.joins = np.zeros(256, bool)
        self.joins[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True
        self._reset()

    def _reset(self) -> None:
        self.keys, self.vals, self.n = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 0
        self.starts, self.sizes, self.flat, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint32), 0

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the chunks, -1 for those not known."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            there = self.keys[slot]
            hit = there == hashes[todo]
            out[todo[hit]] = self.vals[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + 1) & (SLOTS - 1)
        return out

    def _add(self, hashes: np.ndarray, chunks: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, chunks), np.int32, len(chunks))
        n, total = self.n + len(chunks), self.used + int(sizes.sum())
        for name, need in (("starts", n), ("sizes", n), ("flat", total)):
            old = getattr(self, name)
            if need > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(need, 2 * len(old)) - len(old), old.dtype)]))
        self.sizes[self.n : n] = sizes
        self.starts[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : total] = np.fromiter(itertools.chain.from_iterable(chunks), np.uint32, total - self.used)
        todo, slot = np.arange(len(chunks)), (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[todo[free]]  # of several for one slot the last stays
            won = self.keys[slot] == hashes[todo]
            self.vals[slot[won]] = self.n + todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (SLOTS - 1)
        self.n, self.used = n, total

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column, one after another, and their n + 1 offsets."""
        data, offs = utf8(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & ~self.joins[data[1:]]
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                if at:
                    cut[at - 1] = False
                at = raw.find(token, at + 1)
        ends = offs[1:-1]
        cut[ends[ends > 0] - 1] = False  # a text's last byte has nothing after it
        cut[offs] = True
        starts = np.flatnonzero(cut)
        starts, ends = starts[:-1], starts[1:]
        hashes = span_hashes(data, starts, ends)
        hashes[hashes == 0] = 1
        at = self._find(hashes)
        if (at < 0).any():
            new, first = np.unique(hashes[at < 0], return_index=True)
            first = np.flatnonzero(at < 0)[first]
            if self.n + len(new) > SLOTS // 2:
                self._reset()
                new, first = np.unique(hashes, return_index=True)
            encode = self.encode
            self._add(new, [encode(raw[a:b].decode()) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            at = self._find(hashes)
        size = self.sizes[at].astype(np.int64)
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.arange(to[-1]) + np.repeat(self.starts[at] - to[:-1], size)]
        return ids, to[np.searchsorted(starts, offs)]


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def cut(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, salt: the pieces of every document, its ids ended by END_ID. Only longer
    documents are cut, into pieces of `length` of which the first may be shorter. salt numbers a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = _tokenizer(path), 0
        for b in batches:
            for p in pieces(b, "text"):
                tokens, to = encode(p.column(1))
                n = np.diff(to) + 1  # with the end id
                many = -(-n // length)
                doc = np.repeat(np.arange(len(n)), many)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                over = np.repeat(many * length - n, many)  # what the first piece is shorter by
                start, end = np.maximum(k * length - over, 0), (k + 1) * length - over
                crc = []
                for i, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
                    piece = tokens[to[i] + a : to[i] + b]
                    if b == n[i]:
                        piece = np.append(tokens[to[i] + a : to[i + 1]], np.uint32(END_ID))
                    crc.append(zlib.crc32(np.ascontiguousarray(piece, "<u4")))
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(doc)), pa.array(k, pa.int32()), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64()), pa.array(salt + doc)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
                salt += len(n)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def pack(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: best fit, longest first. A bin is open to a piece if the piece fits its residual in
    every dimension; among those the one with the least weighted norm of what would be left is taken ("norm"), or the
    greatest weighted dot product of piece and residual ("dot"); ties to the oldest bin. A piece that no open bin takes
    opens one; a piece too large for an empty bin is an error."""
    total = np.array([caps.tokens, caps.docs, caps.cost], np.float64)
    weight = np.array(caps.weights) / (total**2 if caps.rule == "dot" else total)
    left = np.zeros((max(1, len(lengths)), 3))
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    live = np.zeros(len(left), np.int64)  # bins with room, oldest first
    n_live = n = 0
    order = np.argsort(-lengths, kind="stable")
    smallest = float(lengths.min(initial=1))
    for i in order:
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        if (need > total).any():
            raise ValueError(f"a piece of {lengths[i]} tokens exceeds an empty sequence")
        rest = left[live[:n_live]] - need
        fits = (rest >= 0).all(1)
        if fits.any():
            value = (((rest * weight) ** 2).sum(1)) if caps.rule == "norm" else -((rest + need) * need * weight).sum(1)
            at = int(np.argmin(np.where(fits, value, np.inf)))
            k = live[at]
        else:
            k = n
            left[k] = total
            live[n_live] = k
            at, n_live, n = n_live, n_live + 1, n + 1
        bins[i], offsets[i] = k, int(total[0] - left[k, 0])
        left[k] -= need
        if left[k, 0] < smallest or left[k, 1] < 1 or left[k, 2] < smallest**2:
            live[at : n_live - 1] = live[at + 1 : n_live]
            n_live -= 1
    return bins, offsets


def best_fit(docs: DataFrame, path: str | None = None, caps: Capacities = Capacities(), group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    Null and empty texts have one piece, the end id. A repeated or null doc_id gives its pieces each time. Texts of any
    length are cut whole. Extra columns are ignored; an empty table gives an empty result. Pieces are dealt by a hash to
    groups of about `group`, packed each on its own, so no task grows with the input and no key is hot; each group can
    end with a few sequences that another could have filled, a few in ten thousand at the default size."""
    made = Staged(cut(docs, path or tokenizer_path(), caps.tokens), "pieces").df
    groups = max(1, -(-made.count() // group))
    dealt = made.withColumn("g", F.pmod(F.xxhash64("doc_id", "salt", "piece", "ids_crc32"), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lengths = np.asarray(t["length"]).astype(np.int64)
        order = np.lexsort((np.asarray(t["salt"]), np.asarray(t["piece"]), np.asarray(t["doc_id"].fill_null(0)), -lengths))
        t, lengths = t.take(pa.array(order)), lengths[order]
        bins, offsets = pack(lengths, caps)
        g = key[0].as_py()
        out = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return out.append_column("sequence_id", pa.array(bins + (g << 32))).append_column("offset", pa.array(offsets))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInArrow(run, schema)


