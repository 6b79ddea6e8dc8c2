"""Main text of HTML pages by a recurrent block labeller (operator 2)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, span_hashes, word_spans
from .html_blocks import Block, blocks

PATHS, WORDS, NUMBERS, HIDDEN = 96, 64, 6, 20
WEIGHTS = Path(__file__).with_name("block_labeller.npz")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_TAGS: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Signed hashed counts of the path's tags and names, those of the leaf apart."""
    v = _TAGS.get(path)
    if v is None:
        v = np.zeros(PATHS, np.float32)
        last = max((i for i, x in enumerate(path) if x[0] != "."), default=0)
        for i, x in enumerate(path):
            for key in (x, "leaf " + x) if i >= last else (x,):
                h = zlib.crc32(key.encode())
                v[h % PATHS] += 1.0 if h & 0x10000 else -1.0
        v = np.tanh(v)
        if len(_TAGS) > 20_000:
            _TAGS.clear()
        _TAGS[path] = v
    return v


def vectors(page_blocks: list[list[Block]]) -> np.ndarray:
    """A row for each block of all pages, page after page: tag path, hashed words, and numbers."""
    flat = [b for p in page_blocks for b in p]
    out = np.zeros((len(flat), PATHS + WORDS + NUMBERS), np.float32)
    if not flat:
        return out
    raw = [b.text.encode("utf-8", "surrogatepass") for b in flat]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, at = word_spans(data, offs, ~_LETTER)
    n = np.diff(at)
    if len(starts):
        bucket = (span_hashes(LOWER[data], starts, ends) % np.uint64(WORDS)).astype(np.int64)
        bag = np.bincount(np.repeat(np.arange(len(flat)), n) * WORDS + bucket, minlength=len(flat) * WORDS).reshape(-1, WORDS)
        out[:, PATHS : PATHS + WORDS] = bag / np.maximum(np.sqrt((bag**2).sum(1, keepdims=True)), 1)
    out[:, :PATHS] = np.stack([_path_vector(b.path) for b in flat])
    size = np.array([len(b.text) for b in flat])
    ends_well = np.array([b.text[-1] in ".!?:;\"'”»…" for b in flat])
    count = np.concatenate([np.arange(len(p)) / max(1, len(p) - 1) for p in page_blocks if p])
    linked = np.array([b.linked for b in flat])
    out[:, PATHS + WORDS :] = np.stack([np.log1p(n) / 5, np.log1p(size) / 8, np.minimum(1, linked / np.maximum(size, 1)), ends_well, count, n <= 3], 1)
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output for each block. Sequences run together, longest first, so a step
    touches only the pages that still have blocks."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}

    @classmethod
    def load(cls) -> Labeller:
        with np.load(WEIGHTS) as z:
            return cls(dict(z))

    def _direction(self, x: np.ndarray, rows: list[np.ndarray], d: str) -> np.ndarray:
        wx, wh, b = (self.w[f"{k}{d}"] for k in ("wx", "wh", "b"))
        gates = x @ wx + b
        out = np.zeros((len(x), HIDDEN), np.float32)
        n = len(rows[0]) if rows else 0
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for at in rows:
            k = len(at)
            z = gates[at] + h[:k] @ wh
            ifo = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            c[:k] = ifo[:, HIDDEN : 2 * HIDDEN] * c[:k] + ifo[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
            h[:k] = ifo[:, 2 * HIDDEN :] * np.tanh(c[:k])
            out[at] = h[:k]
        return out

    def main(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Probability of main text for each row of x, given the number of rows of each page."""
        n = np.array(sizes, np.int64)
        order = np.argsort(-n, kind="stable")
        begin = (np.cumsum(n) - n)[order]
        n = n[order]
        live = [int(np.searchsorted(-n, -t, "left")) for t in range(int(n.max(initial=0)))]
        forward = [begin[:k] + t for t, k in enumerate(live)]
        backward = [begin[:k] + n[:k] - 1 - t for t, k in enumerate(live)]
        both = np.concatenate([self._direction(x, forward, "f"), self._direction(x, backward, "b")], 1)
        return 1 / (1 + np.exp(-(both @ self.w["wo"] + self.w["bo"])))


def main_text(pages: list[str | None], labeller: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    keep = labeller.main(vectors(found), [len(f) for f in found]) >= 0.5 if any(found) else []
    out, at = [], 0
    for f in found:
        out.append("\n\n".join(b.text for b, k in zip(f, keep[at : at + len(f)], strict=True) if k))
        at += len(f)
    return out


_LOADED: list[Labeller] = []


def extract(pages: DataFrame, batch_chars: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    text: the blocks that the labeller takes for main text, in page order, joined by two line feeds; '' if there are
    none, and for null or empty html. n_chars: its code points. Every block of a page is read and labelled, whatever the
    page's length. Repeated rows are extracted each; extra columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LOADED:
            _LOADED.append(Labeller.load())
        for b in batches:
            at = 0
            sizes = np.cumsum([len(h) if h else 0 for h in b.column(2).to_pylist()])
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + batch_chars, "right")))
                part = b.slice(at, to - at)
                text = main_text(part.column(2).to_pylist(), _LOADED[0])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                at = to

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
