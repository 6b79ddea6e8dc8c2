import random

from corpusloom.llm import suffix_dedup

from . import brute


def corpus(seed, n=60):
    rng, rows = random.Random(seed), []
    vocab = ["".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passages = [text(rng.randrange(15, 60)) for _ in range(6)]
    for i in range(n):
        t = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            t += p[a : a + rng.randrange(60, 300)] + text(rng.randrange(0, 10))
        rows.append((i * 3, t))
    rows += [(1, rows[5][1]), (2, None), (4, ""), (5, "a" * 350), (7, "ab" * 200 + "a" * 120), (8, "word " * 100), (10, "x" * 99), (11, "x" * 99), (13, "x" * 100), (14, "x" * 100)]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    return [tuple(r) for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]


def test_against_every_window(spark):
    rows = corpus(3)
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert set(got) == brute.repeated_bytes(rows)


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    rows = corpus(4)
    assert set(run(spark, rows)) == brute.repeated_bytes(rows)


def test_empty_equal_and_null_ids(spark):
    assert run(spark, []) == []
    t = "".join(chr(97 + i * i % 26) for i in range(60)) + "".join(chr(97 + i * i * i % 25) for i in range(90))
    got = run(spark, [(1, t), (1, t), (None, t), (2, "z" + t)])
    by = sorted((str(r[0]), r[2], r[3]) for r in got)
    assert by == [("1", 0, 0), ("1", 0, 0), ("2", len(t), 1), ("None", len(t), 1)]


def test_longest_previous_factors():
    import numpy as np

    rng = np.random.default_rng(2)
    for trial in range(30):
        n = int(rng.integers(1, 200))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        if trial % 3 == 0 and n > 120:
            data[n // 2 : n // 2 + 60] = data[:60]
        padded = np.concatenate([data, np.zeros(100, np.uint8)])
        place = rng.permutation(n)
        got = suffix_dedup.longest_previous_factors(padded, suffix_dedup.suffix_ranks(padded), np.arange(n), place)
        raw = padded.tobytes()

        def shared(i, j, raw=raw):
            k = 0
            while k < 100 and max(i, j) + k < len(raw) and raw[i + k] == raw[j + k]:
                k += 1
            return k

        assert got.tolist() == [max((shared(i, j) for j in range(n) if place[j] < place[i]), default=0) for i in range(n)]


def test_one_line_in_many_contexts(spark, monkeypatch):
    """A line of 172 bytes in texts that differ around it: its windows are dealt out one by one."""
    monkeypatch.setattr(suffix_dedup, "HOT", 500)
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = some(172)
    rows = [(i, some(rng.randrange(60, 150)) + line + some(rng.randrange(60, 150))) for i in range(2000)]
    assert set(run(spark, rows)) == brute.repeated_bytes(rows)


def test_the_largest_id(spark):
    t = "".join(chr(97 + i * i % 26) for i in range(60)) + "".join(chr(97 + i * i * i % 25) for i in range(90))
    got = run(spark, [((1 << 63) - 1, t), (3, t + "z"), (None, "y" + t)])
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == [("3", 0, 0), (str((1 << 63) - 1), len(t), 1), ("None", len(t), 1)]
