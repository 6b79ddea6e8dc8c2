import hashlib
import random
import re

from corpusloom.llm import decontaminate

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, own in wins.items():
            n = len(win)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == win:
                    hit.update(range(k, k + n))
                    ids |= own
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, words string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n int")
    return [tuple(r) for r in decontaminate.decontaminate(d, b).collect()], d, b


def test_against_every_window(spark):
    rng = random.Random(2)
    vocab = ["the", "of", "É1", "x9", "straße", *(f"w{i}" for i in range(12))]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "!", "-"]) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([15, 12, 10, 9, 4, 3, 2, 1, 20, 11])] + [(20, None), (21, ""), (22, "..."), (3, "of of of of")]
    items.append((30, items[0][1]))
    docs = []
    for i in range(60):
        t = text(rng.randrange(0, 60))
        if i % 2:
            p = words(rng.choice(items[:6] + items[8:10])[1])
            a = rng.randrange(len(p))
            t += " " + " ".join(p[a:]).upper() + " " + " ".join(p) + " " + text(3)
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "?!"), (5, docs[7][1]), (None, docs[9][1]), (7, docs[7][1]), (7, docs[7][1])]
    got, d, b = run(spark, docs, items)
    want = brute(docs, items)
    assert sorted(got, key=str) == sorted(want, key=str)
    clean = decontaminate.uncontaminated(d, b)
    assert clean.columns == d.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in want if not r[5])


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(1, " ".join(f"q{i}" for i in range(14)))]
    docs = [(1, "a " + items[0][1]), (2, " ".join(f"q{i}" for i in range(9)))]
    got, _, _ = run(spark, docs, items)
    assert sorted(got) == sorted(brute(docs, items))


def test_empty_tables(spark):
    got, d, _ = run(spark, [(1, "a b c")], [])
    assert got == [(1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert run(spark, [], [(1, "a b")])[0] == []


def test_no_python_in_the_plan(spark):
    _, d, b = run(spark, [(1, "a b c")], [(1, "a b c")])
    plan = decontaminate.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_uncontaminated_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 5, "p"), (2, "clean", 6, "q")], "doc_id long, text string, d int, th string")
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.uncontaminated(docs, items).collect()] == [(2, "clean", 6, "q")]
