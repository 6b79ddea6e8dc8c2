import random
import re

from corpusloom.llm.url_filter import Automaton, Rule, filter_urls, prefix_rule


def test_automaton_against_regexes():
    rng = random.Random(1)
    globs = ["", "*", "?", "a*b", "*ab", "ab*", "a?c*", "**a**", "*a?*b", "é*", "a" * 70, "*" + "ab" * 40 + "*c"]
    globs += ["".join(rng.choice("ab*?c") for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    texts = ["", "a", "ab", "éb", "a" * 70, "x" + "ab" * 40 + "zzc"] + ["".join(rng.choice("abcdé\U0001f600") for _ in range(rng.randrange(0, 12))) for _ in range(300)]
    got = Automaton(globs).matches(texts)
    for j, g in enumerate(globs):
        want = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
        for i, t in enumerate(texts):
            assert got[i, j] == bool(want.fullmatch(t)), (g, t)


def test_hosts_paths_and_rules(spark):
    urls = [
        (1, "HTTPS://WWW.Example.COM/en/7/x?q#f", "www.example.com", "/en/7/x", "example.com/en/7", "allow"),
        (2, "http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
        (3, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        (4, "http://example.net/de/8", "example.net", "/de/8", "example.net/de/8", "block"),
        (5, "http://example.net/de/9", "example.net", "/de/9", "net/de/", "allow"),
        (6, "http://com/en/", "com", "/en/", "com/en/", "block"),
        (7, "no scheme", "", "", None, "allow"),
        (8, None, "", "", None, "allow"),
        (9, "", "", "", None, "allow"),
        (10, "http://www.cheap-pills.example.org/fr/1", "www.cheap-pills.example.org", "/fr/1", None, "block"),
        (11, "http://É.com?x/en/", "É.com", "", None, "allow"),
        (12, "x://y://z.com/en/1", "y:", "//z.com/en/1", None, "allow"),
        (12, "x://y://z.com/en/1", "y:", "//z.com/en/1", None, "allow"),
        (None, "http://q.org/es/" + "a" * 5000, "q.org", "/es/" + "a" * 5000, "org/es/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "h") for i, u, *_ in urls], "page_id long, url string, host string")
    assert sorted(map(tuple, filter_urls(df).collect()), key=str) == sorted([(i, h, p, r, v) for i, _, h, p, r, v in urls], key=str)
    assert filter_urls(df.limit(0)).collect() == []


def test_longest_rule_and_ties(spark):
    rules = [prefix_rule("b.org/x", "block"), prefix_rule("b.org/xy", "allow"), Rule("*#/xyz", "block")]
    df = spark.createDataFrame([(1, "h://b.org/xyz"), (2, "h://c.org/xyz"), (3, "h://b.org/xz")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, rules).collect()} == {1: ("b.org/xy", "allow"), 2: (None, "block"), 3: ("b.org/x", "block")}
