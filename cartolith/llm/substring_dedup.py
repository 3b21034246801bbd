"""Substring dedup with difference-cover anchors.

A window is ``length`` consecutive words of one document. A word goes if a window that covers it
also starts in a document with a smaller id; windows are judged on the input.

Anchors are the runs of ``length - PERIOD + 1`` words that start at positions p with p mod PERIOD in
a difference cover. For any two positions i and j some shift k < PERIOD takes both i+k and j+k
into the cover, so any two equal windows hold, at the same shift, an anchor that both documents
emit. Anchors that occur in two different texts mark the windows around them; those windows are then
extended to their full length by a 128-bit hash, and the smallest id of each decides. No pair of
documents is ever formed, so a passage shared by n documents costs n rows a window.

Exact copies are settled beforehand: only the first document of each text has its windows examined.

Null texts have no words. Rows with a null id neither lose words nor make others lose them. Rows that
repeat an id are judged each by itself, against smaller ids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .textnum import spans_hash, windows, words_of

#: Every difference modulo PERIOD occurs between two members of COVER.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)


def _anchors(length: int):
    size = length - PERIOD + 1
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id"), batch.column("row_key")
            for words in words_of(batch.column("text")):
                begin, owner = windows(words, size)
                at = begin - words.first[owner]
                # only documents that hold a whole window can share one
                keep = cover[at % PERIOD] & (words.counts()[owner] >= length)
                begin, owner, at = begin[keep], owner[keep], at[keep]
                if len(begin):
                    anchor = spans_hash(words.hashes(0), begin, begin + size, 1)
                    take = pa.array(owner + words.rows[0])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), ids.take(take), rows.take(take), pa.array(at.astype(np.int32))], names=["anchor", "doc_id", "row_key", "at"])

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, hits = batch.column("doc_id"), batch.column("row_key"), batch.column("hits")
            for words in words_of(batch.column("text")):
                first, second = words.hashes(0), words.hashes(1)
                begin, owner = [], []
                for k, row in enumerate(words.rows):
                    last = words.first[k + 1] - words.first[k] - length
                    near = np.asarray(hits[row].as_py(), dtype=np.int64)
                    wanted = np.zeros(last + 1, dtype=bool)
                    for shift in range(PERIOD):
                        start = near - shift
                        wanted[start[(start >= 0) & (start <= last)]] = True
                    found = np.flatnonzero(wanted)
                    begin.append(found + words.first[k])
                    owner.append(np.full(len(found), k))
                begin, owner = np.concatenate(begin), np.concatenate(owner)
                if len(begin):
                    take = pa.array(owner + words.rows[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(spans_hash(first, begin, begin + length, 1).view(np.int64)), pa.array(spans_hash(second, begin, begin + length, 0).view(np.int64)), ids.take(take), rows.take(take), pa.array((begin - words.first[owner]).astype(np.int32))],
                        names=["w1", "w2", "doc_id", "row_key", "at"],
                    )

    return run


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, starts = batch.column("is_copy").to_pylist(), batch.column("starts")
            total, removed, digest, texts = [], [], [], []
            for words in words_of(batch.column("text")):
                raw = words.data.tobytes()
                for k, row in enumerate(words.rows):
                    low, n = words.first[k], int(words.first[k + 1] - words.first[k])
                    gone = np.zeros(n + 1, dtype=np.int64)
                    if copies[row] and n >= length:
                        gone[0] = 1
                    elif starts[row].is_valid:
                        at = np.asarray(starts[row].as_py(), dtype=np.int64)
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + length, -1)
                    stay = np.flatnonzero(np.cumsum(gone)[:n] == 0) + low
                    kept = b" ".join([raw[a:b] for a, b in zip(words.starts[stay].tolist(), words.ends[stay].tolist())])
                    total.append(n)
                    removed.append(n - len(stay))
                    digest.append(hashlib.sha256(kept).hexdigest())
                    texts.append(kept.decode("utf-8", "replace") if with_text else "")
            columns = {"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return run


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, row_key, starts): first words of the windows that also start in a smaller document.

    docs has doc_id, row_key (a hash of the text) and text; of equal texts only the first is listed."""
    firsts = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min_by(F.struct("doc_id", "row_key"), "doc_id").alias("r")).select("r.*")
    anchors = docs.mapInArrow(_anchors(length), "anchor long, doc_id long, row_key long, at int")
    # the sides with one row a key are tables, so that joins can split the keys of passages that many documents share
    shared = materialise(anchors.groupBy("anchor").agg(F.min("row_key").alias("a"), F.max("row_key").alias("b")).where("a <> b").select("anchor"), "op1-shared")
    hits = anchors.join(shared, "anchor").groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("hits"))
    # rows equal in id and text are one here: they share their hits
    hits = materialise(hits.join(firsts.distinct(), ["doc_id", "row_key"], "left_semi"), "op1-hits")
    found = materialise(docs.join(hits, ["doc_id", "row_key"]).mapInArrow(_windows(length), "w1 long, w2 long, doc_id long, row_key long, at int"), "op1-windows")
    smallest = found.groupBy("w1", "w2").agg(F.min("doc_id").alias("smallest"), F.max("doc_id").alias("largest")).where("smallest < largest").drop("largest")
    smallest = materialise(smallest, "op1-smallest")
    starts = found.join(smallest, ["w1", "w2"]).where("doc_id > smallest").groupBy("doc_id", "row_key").agg(F.collect_set("at").alias("starts"))
    out = materialise(starts, "op1-starts")
    discard(shared, hits, found, smallest)
    return out


def substring_dedup(documents: DataFrame, length: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text, the
    kept words joined by one space."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    sound = docs.where("doc_id is not null and text is not null")
    starts = repeated_windows(sound, length)
    digests = sound.select("doc_id", "row_key", F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    firsts = materialise(firsts, "op1-firsts")
    copies = digests.join(firsts, "digest").where("doc_id > first_id").select("doc_id", "row_key", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("is_copy"))
    touched = starts.withColumn("is_copy", F.lit(False)).unionByName(copies).groupBy("doc_id", "row_key").agg(F.max("is_copy").alias("is_copy"), F.first("starts", ignorenulls=True).alias("starts"))
    joined = docs.join(touched, ["doc_id", "row_key"], "left").withColumn("is_copy", F.coalesce("is_copy", F.lit(False)))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return joined.select("doc_id", "text", "is_copy", "starts").mapInArrow(_cut(length, with_text), schema)
