"""The character model against direct formulas, and held-out accuracy."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartolith.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_grams():
    texts = ["ab", "", "É\n1", "x" * 50]
    gram, owner = q.grams(texts)
    want = []
    for k, t in enumerate(texts):
        s = [0, 0, 0] + [int(q._CLASSES[ord(c)]) for c in t]
        want += [(k, sum(s[i + j] * 40 ** (3 - j) for j in range(4))) for i in range(len(t))]
    assert list(zip(owner.tolist(), gram.tolist())) == want


def test_model_is_a_distribution():
    rng = np.random.default_rng(1)
    counts = np.zeros(q.SYMBOLS**q.ORDER)
    counts[rng.integers(0, 500, 4000) * 4001 % len(counts)] += rng.integers(1, 9, 4000)
    p = np.exp(-q.kneser_ney(counts).astype(np.float64)).reshape(-1, q.SYMBOLS)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    scored = q.quality(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r.keep for r in scored if r.quality == 1]
    bad = [r.keep for r in scored if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "c"), (2, "", None, "c"), (3, " \n", "xx", "c"), (3, "word", "xx", "c"), (None, "z" * 60000, "en", "c")], "doc_id long, text string, lang string, keep string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.keep) for r in q.quality(docs, none).collect()]
    assert sorted(got, key=str) == sorted([(1, False), (2, False), (3, False), (3, True), (None, True)], key=str)
    assert q.good_documents(docs, none).columns == docs.columns and q.good_documents(docs, none).count() == 2
    assert q.quality(docs.where("false"), none).count() == 0
    twice = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert q.trusted_ids(twice).count() == 0


@pytest.mark.parametrize("keep", [True])
def test_filter_agrees(spark, keep):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in q.quality(docs, labels).where(F.col("keep") == keep).select("doc_id").collect()}
    assert {r.doc_id for r in q.good_documents(docs, labels).select("doc_id").collect()} == kept


def test_toxic_is_rejected(spark):
    """Held-out toxic documents go, held-out clean ones stay; quality() alone keeps the toxic ones."""
    docs, labels = spark.read.parquet(f"{SF[:-2]}1/documents.parquet"), spark.read.parquet(f"{SF[:-2]}1/labels.parquet")
    held = q.judged(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1 and quality = 1"), "doc_id").collect()
    keep = lambda toxic: np.mean([r.keep for r in held if r.toxic == toxic])
    assert keep(1) < 0.25 and keep(0) > 0.97


def test_toxic_edges(spark):
    docs = spark.createDataFrame([(k, f"plain words {k} {'vile' if k % 2 else 'kind'}", "xx") for k in range(40)] + [(None, "VILE!", "yy"), (50, None, "xx"), (50, "vile", None), (50, "kind", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    got = q.judged(docs, labels)
    assert got.count() == docs.count()
    bad = {(r.doc_id, r.n_chars) for r in got.where("toxic_ratio is not null").collect()}
    assert {(None, 5), (50, 4)} <= bad and len([r for r in got.where("doc_id = 50 and toxic_ratio is null").collect()]) == 2
    assert q.judged(docs, labels.where("toxic = 0")).where("toxic_ratio is not null").count() == 0


def test_counts_of_many_languages():
    """Each language's characters are counted as its own, whatever their number and order in a task."""
    langs = [f"l{k % 45}" for k in range(90)]
    batch = pa.RecordBatch.from_pydict({"lang": langs, "fold": pa.array([0] * 90, pa.int32()), "text": [f"text {'x' * (k % 45)}" for k in range(90)]})
    got = Counter()
    for part in q._count(iter([batch, batch])):
        for lang, n in zip(part.column("lang").to_pylist(), part.column("n").to_pylist()):
            got[lang] += n
    assert got == {f"l{k}": 4 * (5 + k) for k in range(45)}


def _prose(k, words="the quick brown fox and the lazy dog walk along the river in the morning sun while birds sing above old stone walls".split()):
    return " ".join(words[(k * 7 + i * (k % 5 + 1)) % len(words)] for i in range(60))


def test_a_language_trusted_in_one_fold(spark):
    """One trusted text of a language lies in one half of the documents: its junk is held against the overall quantile."""
    rng = np.random.default_rng(3)
    noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 300)) + "qzx jkv" for _ in range(10)]
    docs = [(k, _prose(k), "en") for k in range(60)] + [(100, _prose(100), "xx")]
    docs += [(200 + k, noise[k], "en" if k < 5 else "xx") for k in range(10)] + [(300, _prose(4), "xx")]
    labels = spark.createDataFrame([(k, 1, 0) for k in (*range(60), 100)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()}
    assert {r.model for r in got.values() if r.lang == "xx"} == {"xx"}
    assert not any(got[200 + k].keep for k in range(10)) and got[300].keep and got[100].keep
    assert all(r.threshold is not None for r in got.values())


def test_thresholds_by_hand(spark):
    """Each model's limit: the quantile of its held-out texts, drawn to the overall one by their number, times the margin."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    models, limits = q.fitted(docs, labels, 0.9, 1.1)
    d = docs.select("doc_id", "lang", "text", q.fold().alias("fold"), F.xxhash64("text").alias("row_key")).join(q.trusted_ids(labels), "doc_id").where("text is not null")
    rows = q.score(q.placed(d.withColumn("fold", 1 - F.col("fold")), models), models).where("perplexity is not null and modelled").collect()
    level = lambda values: np.sort(np.log(values))[int(np.ceil(0.9 * len(values))) - 1]
    overall = level([r.perplexity for r in rows])
    for row in limits.collect():
        own = [r.perplexity for r in rows if r.model == row.model]
        own = [r.perplexity for r in rows] if row.model == q.ALL else own
        share = len(own) / (len(own) + q.PRIOR_DOCS)
        assert row.threshold == pytest.approx(1.1 * np.exp(share * (level(own) if own else 0) + (1 - share) * overall), rel=1e-3)


def test_toxic_labels_in_one_fold(spark):
    """Toxic labels of one half of the documents only still reject toxic documents."""
    ids = [r.doc_id for r in spark.range(400).select(F.col("id").alias("doc_id")).select("doc_id", q.fold().alias("fold")).where("fold = 0").collect()]
    docs = spark.createDataFrame([(k, _prose(k) + (" vile" if k in set(ids[::4]) or k in (1000, 1001) else ""), "en") for k in (*range(400), 1000, 1001)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, int(k in set(ids[::4]))) for k in range(400)], "doc_id long, quality int, toxic int")
    bad = {r.doc_id for r in q.judged(docs, labels).where("toxic_ratio is not null").collect()}
    assert bad == {*ids[::4], 1000, 1001}
    kept = {r.doc_id for r in q.good_documents(docs, labels, toxic=True).collect()}
    assert not kept & bad and len(kept) > 250
