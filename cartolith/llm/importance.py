"""Importance resampling of documents towards a target text, by hashed n-gram features.

Separators are collapsed to single spaces; one overlapped scan of a regular expression with lookarounds at both ends then
yields, at each word, the spans of that word and of the words after it. A checksum runs on from span to span, so it is taken of the n-grams' bytes
as they stand in the text; modulo the number of buckets it is the feature. A bucket's gain is the logarithm of its smoothed share of the
target against that of the documents, a document's weight the sum of the gains of its features; adding Gumbel noise to weights and taking the
largest draws without replacement.

Texts are scanned once: a document's buckets, sorted and held as differences, are kept in a table of about a byte a feature. Each task counts
them into one vector before anything is shuffled; the gains are as many numbers as there are buckets, a parameter. Ranks come from one
range-partitioned sort of (score, doc_id): a row's rank is its place in its range plus the rows of the ranges before, so no task sees more than a range.

Null texts have no words. A null id has no score and is never drawn. Rows that repeat an id are scored each by itself and share their
noise; ties go to the smaller id. Empty documents give an empty result; with an empty target, gains favour what is rare. Very long texts are
scanned in blocks of words. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import batched
from operator import methodcaller

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, freed_shuffles, materialise

#: Bytes of words stay, A-Z in lower case; every other byte separates.
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Words scanned at a time, and rows of a batch.
BLOCK, ROWS = 1 << 16, 2000


class Scanner:
    """Buckets of all runs of 1 to most words of a text."""

    def __init__(self, most: int, buckets: int):
        import regex

        if not 0 < buckets <= 1 << 16 or most < 1:
            raise ValueError("n-grams of one word at least, buckets of 16 bits at most")
        self.scan = regex.compile(rb"(?<= )([^ ]++)" + rb"( [^ ]++)?+" * (most - 1) + rb"(?= )")
        self.spans = methodcaller("group", *range(1, most + 1)) if most > 1 else lambda match: (match[1],)
        self.buckets = np.uint32(buckets)

    def of(self, text: bytes) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each feature."""
        line = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
        words, found = 0, []
        for block in batched(map(self.spans, self.scan.finditer(line, overlapped=True)), BLOCK):
            words += len(block)
            sums = None
            for group in zip(*block):
                # spans are missing at the end of the text alone
                whole = group[: len(group) - group.count(None)]
                sums = list(map(zlib.crc32, whole) if sums is None else map(zlib.crc32, whole, sums))
                found.append(np.array(sums, dtype=np.uint32) % self.buckets)
        return words, np.concatenate(found).astype(np.uint16) if found else np.zeros(0, np.uint16)


def _scan(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(most, buckets)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                words, steps = [], []
                for text in part.column("text").cast(pa.large_binary()):
                    n, found = scanner.of(text.as_py() or b"")
                    words.append(n)
                    steps.append(np.diff(np.sort(found), prepend=np.uint16(0)).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words, pa.int64()), pa.array(steps, pa.binary())], names=["doc_id", "n_words", "steps"])

    return run


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows, one after another, and the number of each row's."""
    steps = [np.frombuffer(x.as_py(), dtype=np.uint16) for x in column]
    sizes = np.array([len(x) for x in steps], dtype=np.int64)
    return np.concatenate([np.cumsum(x, dtype=np.uint16) for x in steps] or [np.zeros(0, np.uint16)]), sizes


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_rows(batch.column("steps"))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = _rows(batch.column("steps"))
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(sizes), pa.array(sums[ends] - sums[ends - sizes])], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def features(texts: DataFrame, most: int, buckets: int) -> DataFrame:
    """doc_id, n_words and steps: the row's sorted buckets as differences, 16 bits each."""
    return texts.mapInArrow(_scan(most, buckets), "doc_id long, n_words long, steps binary")


def bucket_counts(found: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features."""
    return found.select("steps").mapInArrow(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """1000 times the logarithm of each bucket's share of the target against that of the source, rounded down."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # as many rows as buckets at the most
    s, t = np.zeros(buckets), np.zeros(buckets)
    for row in counts:
        s[row.bucket], t[row.bucket] = row.s, row.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def ranked(scored: DataFrame, share: int) -> DataFrame:
    """Adds rank: 1, 2, 3, ... of the share of a hundred of the rows with able that have the highest scores; ties to the smaller doc_id."""
    ordered = scored.orderBy(F.col("able").desc(), F.col("score").desc_nulls_last(), "doc_id").withColumn("place", F.monotonically_increasing_id())
    ordered = materialise(ordered, "ranked")
    # one row a range of the sort: its number and its rows
    ranges = ordered.where("able").groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", before.alias("before"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.col("able") & (rank <= F.floor(F.col("n") * share / 100))
    out = ordered.join(ranges, F.shiftright("place", 33) == ranges["range"], "left")
    return out.withColumn("rank", F.when(drawn, rank).cast("long")).drop("place", "range", "before", "n")


def importance_sample(documents: DataFrame, target: DataFrame, most: int = 3, buckets: int = 10_000, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score and rank, null for documents that aren't drawn.

    documents have doc_id and text, target has text; share is the drawn part, in percent, of documents with least_words words."""
    spark = documents.sparkSession
    found = materialise(features(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), most, buckets), "features")
    aims = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets)
    with freed_shuffles(spark):
        gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(aims, buckets), buckets)
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + F.lit(0.5)) / F.lit(4294967296.0))))
    weighed = found.mapInArrow(_weigh(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", (F.col("weight") + gumbel).cast("long")).withColumn("able", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    out = ranked(scored, share)
    discard(found)
    return out.select("doc_id", "n_words", "n_features", "weight", "score", "rank")
