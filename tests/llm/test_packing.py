import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing


def test_ids_are_those_of_tokenizers():
    import pyarrow as pa

    rng = random.Random(4)
    raw, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkTokenizer(packing.tokenizer_path())
    texts = ["", " ", "a", " a  b", "a \n b", "it's  don't 'll x", "日本 語 é", "a\u00a0 b\u2003 c \u3000d", "x" * 3000, "\U0001f600 \U0001f600", "a\x85b \x85 c"]
    texts += ["".join(rng.choice(" a\nB'é.\t1 s\u00a0\u2003ñ") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for part in (texts, texts[::-1]):
        ids, to = fast(pa.array(part))
        for i, t in enumerate(part):
            assert ids[to[i] : to[i + 1]].tolist() == raw.encode(t, add_special_tokens=False).ids


def test_added_tokens_in_texts():
    import pyarrow as pa

    rng = random.Random(5)
    raw, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkTokenizer(packing.tokenizer_path())
    end = "<|endoftext|>"
    texts = [f"see {end} here", end, f" {end}", f"a  {end}  b", f"{end}{end} {end}", f"a\n {end}\n b", "a <|endof", "text|> b", f"x{end}y it{end}'s", "a<|endoftext |>"]
    texts += ["".join(rng.choice([*" a\nB'é\ts", "  ", end, "<|", "endoftext|>", "\u00a0"]) for _ in range(rng.randrange(1, 20))) for _ in range(2000)]
    ids, to = fast(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[to[i] : to[i + 1]].tolist() == raw.encode(t, add_special_tokens=False).ids


def test_a_full_table_begins_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SLOTS", 64)
    raw, fast = Tokenizer.from_file(packing.tokenizer_path()), packing.ChunkTokenizer(packing.tokenizer_path())
    for k in range(5):
        t = " ".join(f"w{k}{i}" for i in range(20))
        assert fast(pa.array([t]))[0].tolist() == raw.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 800)
    caps = packing.Capacities(tokens=100, docs=4, cost=5000 + 100 * 100, rule=rule)
    bins, offsets = packing.pack(lengths, caps)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own] ** 2).sum() <= caps.cost
        order = own[np.argsort(offsets[own])]
        assert offsets[order].tolist() == (np.cumsum(lengths[order]) - lengths[order]).tolist()
    with pytest.raises(ValueError):
        packing.pack(np.array([101]), caps)
    assert len(packing.pack(np.zeros(0, np.int64), caps)[0]) == 0


def test_pieces_and_sequences(spark):
    raw = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(6)
    texts = [None, "", "a b", "word " * 5000, " ".join(f"x{rng.randrange(99999)}" for _ in range(3000))] + ["t" * rng.randrange(1, 900) for _ in range(60)]
    rows = [(i, t, "c") for i, t in enumerate(texts)] + [(3, "again", "c"), (None, "none", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)
    got = packing.best_fit(df, group=40).collect()
    want = []
    for i, t, _ in rows:
        ids = [*raw.encode(t or "", add_special_tokens=False).ids, 0]
        first, at, k = len(ids) % 2048 or 2048, 0, 0
        while at < len(ids):
            part = ids[at : at + (first if not k else 2048)]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
            at, k = at + len(part), k + 1
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.best_fit(df.limit(0)).collect() == []


def test_few_sequences(spark):
    n = packing.best_fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total, used = n.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert used <= 1.005 * total / 2048 + 2
