import random

import numpy as np

from corpusloom.llm import passage_dedup as pd_

from . import brute


def test_compact_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for n, top in [(1, 5), (30, 4), (200, 1 << 30), (500, 40)]:
        h = rng.integers(1, top, n).astype(np.uint32)
        h[rng.integers(0, n, n // 60)] = 0
        for size in (1, 2, 5, 46):
            want = set()
            for p in range(n):
                if h[p] == 0:
                    continue
                a = b = p
                while a > 0 and h[a - 1] > h[p]:
                    a -= 1
                while b + 1 < n and h[b + 1] >= h[p]:
                    b += 1
                if b - a + 1 >= size:
                    want.add((a, p, b))
            assert set(zip(*(x.tolist() for x in pd_.compact_windows(h, size)), strict=True)) == want


def corpus(seed):
    """Texts with passages of 50 to 120 words in common, exact or with a few words changed, and clean ones."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    shared = [[word() for _ in range(rng.randrange(52, 120))] for _ in range(8)]
    rows, holders, clean = [], {}, []
    for i in range(120):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 3 == 0:
            k = rng.randrange(len(shared))
            p = list(shared[k])
            if i % 2:
                p[rng.randrange(len(p))] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = p
            holders.setdefault(k, []).append(i)
        else:
            clean.append(i)
        rows.append((i, " ".join(body)))
    return rows, holders, clean


def test_planted_passages(spark):
    rows, holders, clean = corpus(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pd_.near_passages(df).collect()
    linked = {(r.doc_id, r.of_doc_id) for r in got}
    for ids in holders.values():
        assert {(i, ids[0]) for i in ids[1:]} <= linked
    assert not {i for p in linked for i in p} & set(clean)
    texts = dict(rows)
    for r in got:  # each link holds by definition
        a, b = (t.split()[s : s + n] for t, s, n in ((texts[r.doc_id], r.start, r.n_words), (texts[r.of_doc_id], r.of_start, r.of_words)))
        x, y = brute.shingle_set(" ".join(a)), brute.shingle_set(" ".join(b))
        assert len(a) >= 50 and 100 * len(x & y) >= 75 * len(x | y)
        assert abs(r.similarity - len(x & y) / len(x | y)) < 1e-12
    left = {r.doc_id: r.text for r in pd_.remove_passages(df).collect()}
    assert len(left) == len(rows)
    for i in clean:
        assert left[i] == texts[i]
    for ids in holders.values():
        assert left[ids[0]] == texts[ids[0]]
        for i in ids[1:]:
            assert len(left[i].split()) <= len(texts[i].split()) - 45


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pd_.near_passages(empty).collect() == [] and pd_.remove_passages(empty).collect() == []
    t = " ".join(f"x{i}" for i in range(60))
    rows = [(1, t, "a"), (1, t, "b"), (None, t, "c"), (2, None, "d"), (3, "", "e"), (4, "go " * 500, "f"), (5, "go " * 400, "g"), (6, " ".join(f"x{i}" for i in range(49)), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = {(r.doc_id, r.of_doc_id) for r in pd_.near_passages(df).collect()}
    assert got == {(None, 1), (5, 4)}
    left = {r.row: r.text for r in pd_.remove_passages(df).collect()}
    assert left["a"] == left["b"] == t and left["c"] == "" and left["d"] is None and left["g"].strip() == ""


def found(a, b, seeds):
    import pyarrow as pa

    from corpusloom.llm import common

    x, y = (common.shingles(pa.array([" ".join(t)]))[0] for t in (a, b))
    seeds = [i for i in seeds if x[i] in set(y.tolist())]
    return [r[:4] for r in pd_._passages(x, y, np.array(seeds))]


def test_what_recurs_elsewhere_parts_no_passage():
    p = [f"p{i}" for i in range(70)]
    q = p[:35] + ["changed"] + p[36:]
    far = [f"f{i}" for i in range(100)]
    for again in ([], p[20:28]):  # in the earlier document, after the passage
        assert (0, 65, 0, 65) in found(q, p + far + again, [3, 22, 50])


def test_a_good_stretch_beside_poor_ones():
    p = [f"p{i}" for i in range(160)]
    q = p[:40] + ["changed"] + p[41:80] + [w for i in range(80, 160, 8) for w in (*p[i : i + 6], f"n{i}", f"m{i}")]  # then two words in eight differ
    got = found(q, p, [20, 60])
    assert got and all(r[0] == 0 and r[1] >= 75 for r in got)


def test_every_place_of_a_common_shingle_is_tried():
    head = "this is the common header of every single section".split()
    sections = [[*head, *(f"s{k}w{i}" for i in range(55))] for k in range(300)]
    for k in (0, 20, 150, 280):
        assert found(sections[k], [w for x in sections for w in x], [2])


def test_an_earlier_holder_of_signatures_hides_no_pair(spark):
    """Passages with one word changed (B) and one more (C): C is near B, but not near the first text."""
    rows, want = [], set()
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    for k in range(40):
        p = [word() for _ in range(60)]
        q = [*p[:20], word(), *p[21:]]
        r = [*q[:40], word(), *q[41:]]
        for i, t in enumerate((p, q, r)):
            rows.append((10 * k + i, " ".join([*(word() for _ in range(30)), *t, *(word() for _ in range(30))])))
        want |= {(10 * k + 1, 10 * k), (10 * k + 2, 10 * k + 1)}
    got = pd_.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert want <= {(r.doc_id, r.of_doc_id) for r in got}


def test_passages_at_the_threshold_are_found(spark):
    """Passages of 50 words with one word in the middle changed (0.8), in texts of their own."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(150):
        p = [word() for _ in range(50)]
        for i, t in enumerate((p, [*p[:25], word(), *p[26:]])):
            rows.append((2 * k + i, " ".join([*(word() for _ in range(20)), *t, *(word() for _ in range(20))])))
    got = pd_.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.of_doc_id) for r in got} == {(2 * k + 1, 2 * k) for k in range(150)}


def family(rng, k, near):
    """A0 and A1 hold parts of a passage of 60 words, B the whole, C the whole or with one word changed."""
    word = lambda: f"w{rng.randrange(10**6)}"
    p = [word() for _ in range(60)]
    last = [*p[:30], word(), *p[31:]] if near else p
    around = lambda t: " ".join([*(word() for _ in range(30)), *t, *(word() for _ in range(30))])
    return [(10 * k + i, around(t)) for i, t in enumerate((p[:40], p[20:], p, last))]


def test_holders_of_parts_hide_no_whole(spark):
    rng = random.Random(11)
    rows = [r for k in range(150) for r in family(rng, k, False)]
    got = pd_.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = {(r.doc_id, r.of_doc_id) for r in got if r.n_words >= 59}
    assert {(10 * k + 3, 10 * k + 2) for k in range(150)} <= whole


def test_holders_of_both_halves_hide_no_near_passage(spark):
    """Each half of the changed passage stands in an earlier text of its own: only who holds two runs is the partner."""
    rng, rows = random.Random(12), []
    word = lambda: f"w{rng.randrange(10**6)}"
    around = lambda t: " ".join([*(word() for _ in range(30)), *t, *(word() for _ in range(30))])
    for k in range(100):
        p = [word() for _ in range(60)]
        for i, t in enumerate((p[:30], p[31:], p, [*p[:30], word(), *p[31:]])):
            rows.append((10 * k + i, around(t)))
    got = {(r.doc_id, r.of_doc_id) for r in pd_.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((10 * k + 3, 10 * k + 2) in got for k in range(100)) >= 97


def test_brute_force_over_all_pairs(spark):
    """Texts that are their passages: the pairs at 0.75 and more by brute force are linked, or in one chain of links."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(40):
        p = [word() for _ in range(rng.randrange(50, 90))]
        for i in range(5):
            q = list(p)
            for _ in range(rng.randrange(3)):
                q[rng.randrange(len(q))] = word()
            rows.append((10 * k + i, " ".join(q)))
    sets = {i: brute.shingle_set(t) for i, t in rows}
    want = [(a, b) for a in sets for b in sets if b < a and a // 10 == b // 10 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {(r.doc_id, r.of_doc_id) for r in pd_.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a // 10 == b // 10 for a, b in got)
    of = brute.groups(sets, got)
    assert sum(of[a] == of[b] for a, b in want) >= 0.99 * len(want) and len({a for a, _ in want} - {a for a, _ in got}) <= 0.01 * len(want)


def test_clashing_columns_and_the_largest_id(spark):
    t = " ".join(f"x{i}" for i in range(60))
    rows = [(1, t, "a", 1), ((1 << 63) - 1, t, "b", 2), (None, t + " y", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, parts string, rid int")
    assert {(r.doc_id, r.of_doc_id) for r in pd_.near_passages(df).collect()} == {((1 << 63) - 1, 1), (None, 1)}
    left = pd_.remove_passages(df)
    assert left.columns == df.columns and {r.parts: r.text.strip() for r in left.collect()} == {"a": t, "b": "", "c": "y"}
