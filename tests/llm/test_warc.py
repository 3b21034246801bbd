"""Archives: round trip, revisits, and payloads that hold records themselves."""

import hashlib

from cartolith.llm.warc import reachable, read_archives, round_trip, write_archives

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def brute(rows):
    first = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 100 and p is not None:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        f = first.get(h or "")
        again = f is not None and (p is None or p > f)
        out.append((p, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", ("é" * 60 + FAKE * (i % 3)) if i % 2 else f"page {i}") for i in range(300)]
    rows += [(300, None, None), (301, "u\r\nX: y", ""), (None, "n", "é" * 60), (7, "again", "é" * 60 + FAKE), (302, "m", "WARC/1.1\r\n" * 50), (303, "m", "\r\n\r\n" * 50), (304, "m", FAKE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for file_bytes in (1 << 20, 2000):
        assert sorted((tuple(r) for r in round_trip(pages, file_bytes).collect()), key=str) == brute(rows)
    write_archives(pages.where("page_id < 3"), f"{tmp_path}/a")
    assert read_archives(spark, f"{tmp_path}/a").count() == 3


def test_long_url(spark):
    rows = [(1, "http://h/1", "first"), (2, "http://h/" + "u" * 100_000, "é" * 60), (3, "http://h/WARC/1.1", FAKE), (4, "http://h/4", "xWARC/1.1\r\n" * 20_000), (5, "http://h/5", "last")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert sorted((tuple(r) for r in round_trip(pages).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_chain(spark):
    # 0 > 10 > 20 > 35 is the chain; 12 and 15 lie in a payload, 12 even meets the chain
    d = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 12, 20), ("a", 15, 17), ("a", 20, 35), ("b", 3, 9)], "file string, at long, next long")
    assert sorted(tuple(r) for r in reachable(d).collect()) == [("a", 0), ("a", 10), ("a", 20)]
