"""Periodic runs: stretches of words that repeat with a period, at least four times.

A run is a longest stretch of words in which words ``period`` apart are equal, with its smallest
period and at least max(LEAST_LENGTH, EXPONENT * period) words.

Periods up to SHORT are found by direct scans: one comparison of the words with themselves, so many
places later. Longer ones are found by minimizers, a scale for each doubling: scale ``top`` serves the
periods in (top/2, top]. Its keys are hashes of ``top`` words; a place is kept where its key is the smallest
of some window of top/2 + 1 keys. Inside a run of such a period q, the window q places on has the same
keys, so the places kept repeat at distance q; and as a key covers a whole period, it occurs nowhere between. The run
holds such a window and its successor (top + top/2 + q words, fewer than 4 q + 1), so the next place with an equal key, where it
lies at a distance in the scale's range, is a seed with the right period. Seeds are extended to both sides by bisection over
prefix hashes; each stretch is compared word by word before it counts. Scales keep about 4/top of the places, so
all of them together cost a few sorted places a word.

Each document is read in its own row: nothing is shuffled, and a task holds one text beside its batch.

Null texts have no words and no runs. Empty tables give empty results; very long texts are one unit; rows that
repeat an id or a text are judged each by itself. Other columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let
from .textnum import Words, powers, spans_hash, words_of

#: Periods found by direct scans; longer ones have minimizers.
SHORT = 8
#: A run holds its period so many times, and so many words.
EXPONENT, LEAST_LENGTH = 4, 6
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"


def lag_stretches(values: np.ndarray, first: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches with this period, long enough for a run; none crosses a document's bounds."""
    if len(values) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(values) - lag + 2, dtype=np.int8)
    same[1:-1] = values[:-lag] == values[lag:]
    crossing = (first[1:, None] - 1 - np.arange(lag)).ravel()
    same[crossing[(crossing >= 0) & (crossing < len(values) - lag)] + 1] = 0
    steps = np.diff(same)
    begin, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1) + lag
    keep = end - begin >= max(LEAST_LENGTH, EXPONENT * lag)
    return begin[keep], end[keep]


def _window_extreme(keys: np.ndarray, width: int, pick: np.ufunc, filler: int) -> np.ndarray:
    """pick over each window of so many keys: the rest of one block and the beginning of the next."""
    blocks = -(-len(keys) // width)
    padded = np.full((blocks, width), filler, dtype=np.uint64)
    padded.ravel()[: len(keys)] = keys
    ahead = pick.accumulate(padded, axis=1).ravel()
    behind = pick.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def minimizer_pairs(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal minimizers that follow each other at a distance in (top/2, top], and these distances."""
    width = top // 2 + 1
    n = len(values) - top + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    keys = spans_hash(values, at, at + top, 0)
    least = _window_extreme(keys, width, np.minimum, 2**64 - 1)
    # a key is kept that equals the largest of the minima of the windows around it
    around = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    kept = np.flatnonzero(_window_extreme(around, width, np.maximum, 0) == keys)
    order = np.argsort(keys[kept], kind="stable")
    place, key = kept[order], keys[kept][order]
    gap = np.diff(place)
    pair = (key[1:] == key[:-1]) & (gap > top // 2) & (gap <= top)
    return place[:-1][pair], gap[pair]


def _extended(values: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest stretches with period lag around the equal places at and at + lag, within [low, high), by prefix hashes."""
    up, down = powers(1, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])

    def equal(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (sums[a + size] - sums[a]) * down[a] == (sums[b + size] - sums[b]) * down[b]

    def longest(most: np.ndarray, fits) -> np.ndarray:
        good, bad = np.zeros_like(most), most + 1
        while (bad - good > 1).any():
            half = (good + bad) // 2
            ok = fits(half)
            good, bad = np.where(ok, half, good), np.where(ok, bad, half)
        return good

    right = longest(high - at - lag, lambda size: equal(at, at + lag, size))
    left = longest(at - low, lambda size: equal(at - size, at + lag - size, size))
    return at - left, at + lag + right


def find_runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start, then period; values are word hashes of documents that begin at first."""
    found = [np.stack([begin, end, np.full(len(begin), lag)]) for lag in range(1, SHORT + 1) for begin, end in [lag_stretches(values, first, lag)]]
    sizes, top = np.diff(first), 2 * SHORT
    while len(sizes) and sizes.max() >= EXPONENT * (top // 2 + 1):
        at, lag = minimizer_pairs(values, top)
        owner = np.searchsorted(first, at, side="right") - 1
        inside = at + lag + top <= first[owner + 1]
        at, lag, owner = at[inside], lag[inside], owner[inside]
        if len(at):
            begin, end = _extended(values, first[owner], first[owner + 1], at, lag)
            long = end - begin >= EXPONENT * lag
            for b, e, q, k in np.unique(np.stack([begin, end, lag, owner])[:, long], axis=1).T:
                if np.array_equal(values[b : e - q], values[b + q : e]):
                    found.append(np.array([[b], [e], [q]]))
                else:  # two different stretches of equal hash: scan the document
                    base = first[k]
                    b, e = lag_stretches(values[base : first[k + 1]], np.array([0, sizes[k]]), int(q))
                    found.append(np.stack([b + base, e + base, np.full(len(b), q)]))
        top *= 2
    begin, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    # a stretch has its smallest period; multiples of it have the same bounds
    once = np.ones(len(begin), dtype=bool)
    once[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[once], end[once], period[once]
    order = np.lexsort((period, begin))
    return begin[order], end[order], period[order]


def _collapsed(words: Words, stay: np.ndarray) -> list[bytes]:
    """For each document, its words that stay, joined by one space: their bytes and one separator each, but for the last."""
    starts, ends = words.starts[stay], words.ends[stay]
    owner = np.searchsorted(words.first, np.flatnonzero(stay), side="right") - 1
    ends = ends + np.append(owner[1:] == owner[:-1], False) if len(owner) else ends
    steps = np.zeros(len(words.data) + 1, dtype=np.int32)
    steps[starts] += 1
    steps[ends] -= 1
    kept = words.data[np.cumsum(steps[:-1]) > 0]
    sizes = np.bincount(owner, weights=ends - starts, minlength=len(words.rows)).astype(np.int64) if len(owner) else np.zeros(len(words.rows), np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    kept = np.where((kept >= 9) & (kept <= 13), np.uint8(32), kept).tobytes()
    return [kept[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column("text")):
            begin, end, period = find_runs(words.hashes(), words.first)
            owner = np.searchsorted(words.first, begin, side="right") - 1
            gone = np.zeros(len(words.starts) + 1, dtype=np.int64)
            np.add.at(gone, begin + period, 1)
            np.add.at(gone, end, -1)
            texts = _collapsed(words, np.cumsum(gone[:-1]) == 0)
            runs = pa.StructArray.from_arrays([pa.array(begin - words.first[owner]), pa.array(end - begin), pa.array(period)], fields=list(_RUN))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words.rows) + 1)).astype(np.int32)), runs)
            ids = batch.column("doc_id").slice(words.rows.start, len(words.rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts().astype(np.int64)), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])


def periodic_runs(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed_text,
    the words that no run holds after its first period, joined by one space."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge, _SCHEMA)


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text; texts of a tenth of the ids, by checksum, are made periodic from some word on, with words joined by one space."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    draw = F.floor(checksum / 10).cast("long")

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        begin = draw % n
        period = F.lit(1).cast("long") + F.floor((n - begin) / (3 + draw % 8)).cast("long")
        place = lambda p: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at(words, F.when(i < p["begin"], i).otherwise(p["begin"] + (i - p["begin"]) % p["period"]).cast("int") + 1))
        return F.when(n > 0, F.array_join(let(F.struct(begin.alias("begin"), period.alias("period")), place), " ")).otherwise(F.lit(""))

    chosen = F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (checksum % 10 == 0)
    return documents.select("doc_id", F.when(chosen, let(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), periodic)).otherwise(F.col("text")).alias("text"))


def run_digests(judged: DataFrame) -> DataFrame:
    """Per document of periodic_runs(): the run of greatest length/period (ties: smallest start, then period) and digests of runs and text.

    Quotients of word counts below 2**26 that differ, differ as doubles too."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("q"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    return judged.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
