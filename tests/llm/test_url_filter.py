"""URL rules and reputations."""

from cartolith.llm.url_filter import domain_of, host_of, named, path_of, reputations, suffix_of, url_filter
from pyspark.sql import functions as F

URLS = {
    1: ("http://A.Example.ORG:80/es/x?q#f", "a.example.org:80", "/es/x", None),
    2: ("https://www.example.org/es/x", "www.example.org", "/es/x", "example.org/es/"),
    3: ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1"),
    4: ("https://example.org", "example.org", "", None),
    5: ("https://b.org/", "b.org", "/", "org/"),
    6: ("x://a.com/fr/?y://z", "a.com", "/fr/", "com/fr/"),
    7: ("x://a.com#/de/", "a.com", "", None),
    8: ("no scheme", "", "", None),
    9: (None, "", "", None),
    10: ("http://ÄX.com/de/\n1", "Äx.com", "/de/\n1", "com/de/"),
    11: ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
    12: ("a://b://c", "b:", "//c", None),
}


def test_parse_and_rules(spark):
    pages = spark.createDataFrame([(k, v[0], "h") for k, v in URLS.items()], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_filter(pages, spark.createDataFrame([], "page_id long, good int")).collect()}
    for k, (_, host, path, rule) in URLS.items():
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), k
        assert got[k].verdict in ("allow", "block")
    assert [got[k].verdict for k in (2, 3, 5, 6, 10)] == ["block", "block", "allow", "allow", "block"]


def test_domains(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("com",), ("x.y.z.net",), ("",)], "h string")
    got = [(r.s, r.d) for r in d.select(suffix_of(F.col("h")).alias("s"), domain_of(F.col("h")).alias("d")).collect()]
    assert got == [("co.uk", "b.co.uk"), ("com", "b.com"), ("com", "com"), ("net", "z.net"), ("", "")]
    addresses = ["10.0.0.4", "99.1.0.4", "[2001:db8::1]"]
    own = spark.createDataFrame([(a,) for a in addresses], "h string").select(suffix_of(F.col("h")), domain_of(F.col("h"))).collect()
    assert [tuple(r) for r in own] == [(a, a) for a in addresses]


def test_suffix_table(spark):
    """The longest listed suffix counts; hosts that none ends, and addresses, go by the built-in rule."""
    hosts = spark.createDataFrame([("a.github.io",), ("github.io",), ("x.b.co.uk",), ("10.0.0.4",), ("one.io",), ("",)], "host string")
    table = spark.createDataFrame([("github.io",), ("io",), ("4",), (None,), ("IO",)], "suffix string")
    got = {r.host: (r.suffix, r.domain) for r in named(hosts, table).collect()}
    assert got == {"a.github.io": ("github.io", "a.github.io"), "github.io": ("github.io", "github.io"), "x.b.co.uk": ("co.uk", "b.co.uk"), "10.0.0.4": ("10.0.0.4", "10.0.0.4"), "one.io": ("io", "one.io"), "": ("", "")}


def test_addresses_are_judged_apart(spark):
    """Bad pages of one address leave another one alone; ports do not part a host."""
    pages = [(k, f"http://10.0.0.4:{80 + k}/p") for k in range(40)] + [(100 + k, "http://good.net/p") for k in range(200)] + [(500, "http://99.1.0.4/x"), (501, "http://[2001:db8::1]:8080/x"), (502, "http://10.0.0.4/new")]
    good = [(k, 0) for k in range(40)] + [(100 + k, 1) for k in range(200)]
    for table in (None, spark.createDataFrame([("net",)], "suffix string")):
        got = {r.page_id: r.verdict for r in url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int"), suffixes=table).collect()}
        assert (got[500], got[501], got[502]) == ("allow", "allow", "block")


def test_shrinkage(spark):
    rows = [("good.a.net", 1)] * 80 + [("good.a.net", 0)] * 4 + [("bad.b.net", 0)] * 60 + [("bad.b.net", 1)] * 4 + [("one.a.net", 0), ("one.c.net", 0)] + [("x.d.net", 1)] * 30
    h, d, s, overall = reputations(spark.createDataFrame(rows, "host string, good int"), 1.0)
    by = {r.host: r.by_host for r in h.collect()}
    assert by["good.a.net"] > 0.8 > 0.3 > by["bad.b.net"]
    assert by["one.a.net"] > by["one.c.net"]  # the better domain lifts its host
    assert 0 < overall < 1 and d.count() == 4 and s.count() == 1


def test_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://q.net/a/1"), (1, "http://q.net/a/1"), (None, "http://q.net/")], "page_id long, url string")
    assert url_filter(pages, spark.createDataFrame([(1, 1), (1, 1), (None, 0)], "page_id long, good int")).count() == 3
