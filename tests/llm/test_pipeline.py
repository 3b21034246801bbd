"""The pipeline, stage by stage, against plain Python."""

import re

import corpus_pipeline
from cartolith.llm.decontaminate import budget, myers, normalise
from cartolith.llm.quality import judged

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = [r.asDict() for r in out.collect()]
        kept[name] = len(after)
        ids = {r["doc_id"] for r in after}
        if name == "quality":
            want = {r.doc_id for r in judged(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("keep").collect()}
            assert ids == want and 0.5 * len(before) < len(ids) < len(before)
        elif name == "near_duplicates":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before}
            near = lambda a, b: sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            order = sorted(sets)
            label = {d: d for d in order}
            for _ in range(10):
                for i, a in enumerate(order):
                    for b in order[:i]:
                        if near(a, b):
                            label[a] = label[b] = min(label[a], label[b])
            assert ids == {d for d in order if label[d] == d}
        elif name == "decontamination":
            items = [normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

            def leaks(text):
                text = normalise(text)
                for item in items:
                    masks = {}
                    for i, c in enumerate(item):
                        masks[c] = masks.get(c, 0) | 1 << i
                    if item in text or len(text) < 3000 and myers(masks, len(item), text) <= budget(len(item), 0.06):
                        return True
                return False

            assert ids == {r["doc_id"] for r in before if not leaks(r["text"])}
        elif name == "pii":
            assert ids == {r["doc_id"] for r in before}
            assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in after)
            assert any("<email>" in r["text"] for r in after)
        else:
            assert ids <= {r["doc_id"] for r in before} and max(r["copy"] for r in after) <= 2
            words = sum(len(r["text"].split()) for r in after)
            assert abs(words / sum(len(r["text"].split()) for r in before) - 1.5) < 0.1
        if name != "mixing":
            assert out.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == kept["mixing"]
