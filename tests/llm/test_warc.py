import gzip
import hashlib

import pytest

from corpusloom.llm import warc


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark, tmp_path, monkeypatch):
    big = "é<p>" * 400_000
    same = "same payload " * 20
    rows = [(5, "http://a", same), (3, "http://b/ä b", same), (9, None, same), (1, "u", "short"), (2, "u", "short"), (4, "x", None), (6, "x", ""), (7, "x", big), (8, "x", big), (7, "again", "x" * 200), (None, "x", same)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, warc.round_trip(df, f"file://{tmp_path}/w").collect()))
    n = len(big.encode())
    want = [
        (1, 5, sha("short"), "response", None), (2, 5, sha("short"), "response", None), (3, len(same), sha(same), "response", None), (4, 0, sha(""), "response", None),
        (5, len(same), sha(same), "revisit", 3), (6, 0, sha(""), "response", None), (7, 200, sha("x" * 200), "response", None), (7, n, sha(big), "response", None),
        (8, n, sha(big), "revisit", 7), (9, len(same), sha(same), "revisit", 3),
    ]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))
    text = b"".join(gzip.open(f).read() for f in (tmp_path / "w").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\n") == 10 and text.count(b"WARC-Type: revisit") == 3


def test_chunks_carry_running_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "a" * (2 * warc.CHUNK + 5))], "page_id long, url string, html string")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w")
    manifest = spark.createDataFrame(manifest.collect(), warc.MANIFEST)
    chunks = sorted(warc.read_chunks(manifest).collect(), key=lambda r: r.chunk)
    assert len(chunks) >= 2 and sum(c.bytes for c in chunks) == 2 * warc.CHUNK + 5
    at = 0
    for c in chunks:
        at += c.bytes
        assert c.digest == sha("a" * at)


def test_damage_is_an_error(tmp_path):
    w = warc.Writer(f"file://{tmp_path}/d")
    w.add(warc._head(1, "u", "response", None, sha("abc"), 3 + len(warc._http(3))) + warc._http(3), iter([b"abc"]))
    w.close()
    (row,) = w.rows().to_pylist()
    assert list(warc._chunk_rows(**row))[0][2:4] == (3, sha("abc"))
    with pytest.raises(ValueError):
        list(warc._chunk_rows(**(row | {"records": 2})))


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, f"file://{tmp_path}/e").collect() == []
