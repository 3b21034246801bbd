"""The queries over whole tables against plain Python, at the smallest scale."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq

from cartolith.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def read(name, *columns):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()]


def rows(spark, name, *columns):
    return Counter(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect())


def test_union_feeds(spark):
    feeds = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    assert rows(spark, "union_feeds_whole", "feed", "id", "name") == Counter((t, *r) for t, c in feeds.items() for r in read(t, *c))


def test_nearest_number(spark):
    known = defaultdict(set)
    for nation, key in read("customer", "c_nationkey", "c_custkey"):
        known[nation].add(key % 200)
    want = set()
    for order, line, supplier in read("lineitem", "l_orderkey", "l_linenumber", "l_suppkey"):
        n, street = supplier % 100, order % 25
        gap, found = min(((abs(n - f) + (0.0 if n % 2 == f % 2 else 0.5), f) for f in known[street]), default=(99.0, 0))
        if gap <= 10:
            want.add((line, order, n, street, found, gap))
    assert rows(spark, "nearest_number_whole", "line", "orderkey", "number", "street", "found", "gap") == Counter(want)


def test_way_lines(spark):
    nodes = {k for (k,) in read("part", "p_partkey") if k % 9}
    ways = defaultdict(list)
    for order, part in read("lineitem", "l_orderkey", "l_partkey"):
        ways[order].append(part)
    want = Counter((k, len(v)) for k, v in ways.items() if nodes.issuperset(v))
    assert max(n for _, n in want) > 2 and rows(spark, "way_lines_whole", "way_id", "points") == want


def test_tile_plan(spark):
    tiles = {(((k * 7919) % 100003 - 50000) // 8192, ((k * 104729) % 85009 - 42500) // 8192) for (k,) in read("customer", "c_custkey")}
    boxes = [(c * 8192.0, r * 8192.0, f"l1_{c}_{r}") for c, r in tiles]
    near = sorted(((x + 4096 - 5500) ** 2 + (z + 4096 + 5000) ** 2, t) for x, z, t in boxes if x + 8192 > -9000 and x < 20000 and z + 8192 > -15000 and z < 5000)
    assert [r.tile_id for r in QUERIES["tile_plan_whole"](spark, SF).collect()] == [t for _, t in near[:12]]
