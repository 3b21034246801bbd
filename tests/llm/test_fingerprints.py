"""Sketches and the edited-text query against sets of shingles."""

import hashlib

from pyspark.sql import functions as F

from cartolith.llm import fingerprints as fp

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_edited_likeness(spark):
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9001, "x y"), (9002, "w " * 50000), (None, "null id")], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(extra)
    got = fp.edited_likeness(docs).collect()
    assert len(got) == docs.count()
    texts = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null and doc_id <> 9001").orderBy(F.desc("doc_id")).collect()]
    where = {d: i for i, (d, _) in enumerate(texts)}
    for r in got:
        if r.doc_id in (None, 9001, 9002, 0):  # neighbours of the rows that tie
            continue
        t, nxt = texts[where[r.doc_id]][1], texts[where[r.doc_id] + 1][1]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(t), shingles(edited))) < 0.2
        assert abs(r.near_next - jaccard(shingles(t), shingles(nxt))) < 0.2
    by_text = {}
    for r in got:
        if r.doc_id in where:
            assert by_text.setdefault(texts[where[r.doc_id]][1], r.fingerprint) == r.fingerprint


def test_ranges_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    def pairs(rows):
        d, w = fp.in_order(docs, rows=rows)
        return {(r.doc_id, r.nxt) for r in d.withColumn("nxt", F.lead("doc_id").over(w)).where("not guest").collect()}

    ids = sorted((r.doc_id for r in docs.collect()), reverse=True)
    assert pairs(7) == pairs(10**6) == set(zip(ids, ids[1:] + ids[:1]))


def test_merge_and_containment(spark):
    a, b = " ".join(f"a{i}" for i in range(3000)), " ".join(f"a{i}" for i in range(1500, 3000))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(fp.words(F.col("a"))).alias("a"), fp.sketch(fp.words(F.col("b"))).alias("b"))
    r = row.select("a", fp.merge(F.col("a"), F.col("b")).alias("m"), fp.containment(F.col("b"), F.col("a")).alias("c"), fp.likeness(F.col("a"), F.col("b")).alias("j"), fp.distinct_shingles(F.col("a")).alias("n")).first()
    assert r.m == r.a and r.c > 0.85 and abs(r.j - 0.5) < 0.15 and abs(r.n / 2996 - 1) < 0.3


def test_empty(spark):
    assert fp.edited_likeness(spark.createDataFrame([], "doc_id long, text string")).count() == 0
