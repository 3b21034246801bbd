"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

Item and document are compared in lower case, with every run of white space and ASCII punctuation as one
space. An item with an error budget of e edits is cut into e + 1 pieces; if the item occurs in a document
with at most e edits, one piece at least occurs unchanged. Pieces are a table, keyed by a hash of their first
characters (of the longest of SEEDS lengths that fits). Documents are read once, whatever the benchmark's size: a task hashes
every place of a text at these lengths and keeps those that a bit filter over all keys lets through; they join the pieces. Where the
whole piece stands there, Myers' bit-vector recurrence gives the least edit distance of the item to any part of the document
around it.

The filter has BITS bits a key, at most MOST_BITS in all (it lets more through beyond, and still loses nothing); it is summed by tasks, and is all of the
benchmark that the driver holds. Only texts with a place that joined are moved.

Items without a word match nothing; null texts have no matches. Repeated rows of documents give repeated rows; items that
repeat an id count by themselves. Very long texts and items are read whole. Columns of decontaminate() may have any name; empty tables give no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .textnum import mix, powers

#: Lengths of the beginnings of pieces that are hashed.
SEEDS = (1, 2, 3, 4, 6, 8, 10, 14, 20, 32)
BITS, MOST_BITS, PARTS = 16, 1 << 30, 64
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20
#: Pieces are no shorter than this, which lowers the budget of short items.
LEAST_PIECE = 10
_PLAIN = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normalise(text: str) -> str:
    """Lower case, single spaces for runs of white space and ASCII punctuation; one character per UTF-8 byte."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()).decode("latin-1")


def budget(length: int, rate: float) -> int:
    return max(0, min(int(rate * length), length // LEAST_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], length: int, text: str) -> int:
    """Least edit distance of the pattern to any substring of text; masks: the pattern's positions by character."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score, best = full, 0, length, length
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | down
        horizontal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | (full & ~(horizontal | up)), up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
    return best


def seed(length: int) -> int:
    return max(n for n in SEEDS if n <= length)


class Hashed:
    """Hashes of all runs of bytes, of any size, read off prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(0, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def runs(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) + np.uint64(size)


_ITEM = "item_id long, item_key long, item string"
_PIECE = "code long, size int, item_key long, piece string, at int"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normalise(t.as_py() or "") for t in batch.column("text")]
        keep = [i for i, t in enumerate(texts) if t]
        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(keep, pa.int64())), batch.column("item_key").take(pa.array(keep, pa.int64())), pa.array([texts[i] for i in keep], pa.string())], names=["item_id", "item_key", "item"])


def _pieces(rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, item in zip(batch.column("item_key").to_pylist(), batch.column("item").to_pylist()):
                for at, piece in pieces(item, budget(len(item), rate)):
                    size = seed(len(piece))
                    code = Hashed(np.frombuffer(piece[:size].encode("latin-1"), np.uint8)).runs(size)
                    rows.append((int(code.view(np.int64)[0]), size, key, piece, at))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()))], names=["code", "size", "item_key", "piece", "at"])

    return run


def _filter(bits: int):
    """A bit filter over the codes of a task, in PARTS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for batch in batches:
            slot = batch.column("code").to_numpy().view(np.uint64) % np.uint64(bits)
            have = np.zeros(bits // 8, np.uint8) if have is None else have
            np.bitwise_or.at(have, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(1, (slot & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in have.reshape(PARTS, -1)], pa.binary())], names=["part", "bits"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist()):
            more = np.frombuffer(bits, np.uint8)
            parts[part] = parts[part] | more if part in parts else more
    yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])


def _places(shared, sizes: list[int]):
    """(doc_id, row_key, code, place): places of whole texts whose hash the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(shared.value, np.uint8)
        bits = np.uint64(8 * len(have))
        for batch in batches:
            texts = [normalise(t.as_py() or "").encode("latin-1") for t in batch.column("text")]
            for low, run_of in _runs(texts):
                hashed = Hashed(np.frombuffer(b"".join(run_of), np.uint8))
                ends = np.cumsum([len(t) for t in run_of])
                for size in sizes:
                    code = hashed.runs(size)
                    slot = code % bits
                    starts = np.flatnonzero((have[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
                    owner = np.searchsorted(ends, starts, side="right")
                    whole = starts + size <= ends[owner]
                    starts, owner = starts[whole], owner[whole]
                    code = code[starts]
                    if len(code):
                        rows = pa.array(owner + low)
                        place = starts - np.concatenate([[0], ends])[owner]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("row_key").take(rows), pa.array(code.view(np.int64)), pa.array(place.astype(np.int32))], names=["doc_id", "row_key", "code", "place"])

    return run


def _runs(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about CHUNK bytes, with the row of the first; a longer text is one run."""
    run, low, size = [], 0, 0
    for i, text in enumerate(texts):
        if run and size + len(text) > CHUNK:
            yield low, run
            run, low, size = [], i, 0
        run.append(text)
        size += len(text)
    if run:
        yield low, run


def occurrence(item: str, errors: int, masks: dict[str, int], text: str, starts: list[int]) -> int:
    """Least distance of the item to a part of the text around one of the starts, or errors + 1."""
    if item in text:
        return 0
    best, done = errors + 1, None
    for start in sorted(starts):
        if done is not None and start <= done:  # seen within the last part
            continue
        # one part takes in all starts up to errors further
        best = min(best, myers(masks, len(item), text[max(0, start - errors) : start + len(item) + 2 * errors]))
        done = start + errors
    return best


def _verify(rate: float):
    """Over rows of a document's text and an item with the pieces that may stand in it: those within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, far, last = [], [], (None, "")
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py()
                last = last if last[0] == raw else (raw, normalise(raw))
                text, item = last[1], batch.column("item")[i].as_py()
                errors = budget(len(item), rate)
                starts = [h["place"] - h["at"] for h in batch.column("hits")[i].as_py() if text.startswith(h["piece"], h["place"])]
                if not starts:
                    continue
                masks: dict[str, int] = {}
                for k, c in enumerate(item):
                    masks[c] = masks.get(c, 0) | 1 << k
                best = occurrence(item, errors, masks, text, starts)
                if best <= errors:
                    keep.append(i)
                    far.append(best)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in ("doc_id", "row_key", "item_id")), pa.array(far, pa.int64())], names=["doc_id", "row_key", "item_id", "distance"])

    return run


def matches(documents: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """A table of doc_id, row_key (hash of the text), item_id, distance: one row for each pair of different rows."""
    spark = documents.sparkSession
    keyed = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("item_key")).where("text is not null")
    items = materialise(keyed.mapInArrow(_items, _ITEM), "op9-items")
    parts = materialise(items.mapInArrow(_pieces(rate), _PIECE).distinct(), "op9-pieces")
    empty = spark.createDataFrame([], "doc_id long, row_key long, item_id long, distance long")
    sizes = sorted(r["size"] for r in parts.select("size").distinct().collect())  # of SEEDS
    if not sizes:
        return empty
    bits = 1 << 16
    while bits < min(MOST_BITS, BITS * parts.count()):
        bits *= 2
    bloom = parts.select("code").mapInArrow(_filter(bits), "part int, bits binary")
    for keys in (["part", F.pmod(F.spark_partition_id(), F.lit(32))], ["part"]):
        bloom = bloom.repartition(*keys).mapInArrow(_either, "part int, bits binary")
    shared = spark.sparkContext.broadcast(b"".join(r["bits"] for r in sorted(bloom.collect(), key=lambda r: r["part"])))
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row_key")).where("text is not null")
    places = docs.mapInArrow(_places(shared, sizes), "doc_id long, row_key long, code long, place int")
    hit = F.struct("place", "at", "piece")
    found = places.join(parts.select("code", "item_key", "piece", "at"), "code").groupBy("doc_id", "row_key", "item_key").agg(F.collect_set(hit).alias("hits"), F.lit(1).alias("wanted"))
    found = materialise(found, "op9-hits")
    key = lambda d: F.struct(d["doc_id"], d["row_key"])
    wanted = found.where("wanted > 0")
    joined = docs.join(wanted, (docs["row_key"] == wanted["row_key"]) & key(docs).eqNullSafe(key(wanted))).select(docs["doc_id"], docs["row_key"], "text", "item_key", "hits")
    checked = joined.join(items, "item_key").select("doc_id", "row_key", "text", "item_id", "item", "hits").mapInArrow(_verify(rate), "doc_id long, row_key long, item_id long, distance long")
    out = materialise(checked, "op9-matches")
    discard(items, parts, found)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """doc_id, item_id, distance: every document and item that occurs in it with at most rate times its length edits."""
    return matches(documents, benchmark, rate).select("doc_id", "item_id", "distance")


def decontaminate(documents: DataFrame, benchmark: DataFrame, rate: float = 0.06) -> DataFrame:
    """The documents in which no item occurs, all columns."""
    bad = matches(documents, benchmark, rate).select(F.struct("doc_id", "row_key").alias("key")).distinct()
    # the row travels as one column, beside which any name is free; a struct as key lets null ids meet
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("row_key")).alias("key"))
    return rows.join(bad, rows["key"].eqNullSafe(bad["key"]), "left_anti").select("row.*")
