"""Importance resampling against plain Python on small tables and against SQL on the given ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from cartolith.llm import importance as m
from cartolith.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def grams(text, most=3):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def plain(docs, target, most=3, buckets=10_000, share=5, least=20, seed=42):
    s, t, rows = Counter(), Counter(), []
    for _, text in docs:
        s.update(bucket(g, buckets) for g in grams(text, most)[1])
    for text in target:
        t.update(bucket(g, buckets) for g in grams(text, most)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    for i, text in docs:
        n, found = grams(text, most)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in (bucket(g, buckets) for g in found))
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, n >= least and i is not None])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0]))
    drawn = [id(r) for r in able[: share * len(able) // 100]]
    return [(*r[:4], drawn.index(id(r)) + 1 if id(r) in drawn else None) for r in rows]


@given(st.text(alphabet=st.sampled_from("aBé 9_-\t\n\x85中'"), max_size=60))
def test_features_of_any_text(text):
    n, found = m.Scanner(3, 65536).of(text.encode())
    words, expected = grams(text)
    assert n == words and sorted(found.tolist()) == sorted(bucket(g, 65536) for g in expected)


def test_blocks_join(monkeypatch):
    text = " ".join(f"w{i}" for i in range(50))
    whole = np.sort(m.Scanner(3, 10_000).of(text.encode())[1])
    for size in (1, 2, 7, 49, 50):
        monkeypatch.setattr(m, "BLOCK", size)
        assert np.array_equal(np.sort(m.Scanner(3, 10_000).of(text.encode())[1]), whole)
    for most in (1, 2, 5):
        assert sorted(m.Scanner(most, 10_000).of(text.encode())[1].tolist()) == sorted(bucket(g, 10_000) for g in grams(text, most)[1])


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = con.sql(ORACLES["op13_importance_sample"]).fetchall()
    got = QUERIES["op13_importance_sample"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sum(r[4] is not None for r in want) > 3


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns; other parameters."""
    docs = [(None, "a b c d e " * 5), (1, None), (2, ""), (3, " -- \n"), (4, "Wörter " * 25), (5, "x y z " * 9), (5, "x y z " * 9), (6, "q " * 120_000)]
    docs += [(10 + i, f"one two three {i} " * 6) for i in range(40)]
    target = ["one two three four", None, "", "x y"]
    frame = spark.createDataFrame([(*d, 1, "s") for d in docs], "doc_id long, text string, weight int, score string").repartition(5)
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for changed in ({}, {"most": 2, "buckets": 100, "share": 50, "least": 3, "seed": 7}):
        names = {"least": "least_words"}
        got = m.importance_sample(frame, aims, **{names.get(k, k): v for k, v in changed.items()})
        want = plain(docs, target, **changed)
        rows = [tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert m.importance_sample(frame.limit(0), aims).count() == 0
    none = m.importance_sample(frame, aims.limit(0)).collect()
    assert len(none) == len(docs)


def test_ranks_over_many_ranges(spark):
    """Scores that tie, over more ranges than one: ranks are those of one sort."""
    rows = [(i, (i * 7919) % 13, i % 3 > 0) for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = m.ranked(spark.createDataFrame(rows, "doc_id long, score long, able boolean").repartition(7), 30).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    able = sorted((-s, i) for i, s, a in rows if a)[:600]
    assert {r.doc_id: r.rank for r in got if r.rank} == {i: k + 1 for k, (_, i) in enumerate(able)} and len(got) == 3000
