"""Packing examples into sequences under simultaneous limits on tokens, segments and loss-bearing tokens.

An example is a prompt, which bears no loss and may be missing, its text, and one closing id. Sequences are filled one at a time
from a pool of waiting pieces: of the pieces that still fit whole, the one with the largest dot product of its demands with what is left of the
limits goes in, each limit weighed by the pool's demand for it. When none fits, the piece of largest product is cut to what is
left and its rest waits on. A sequence ends full, or at a power of two, which needs no padding either: one that ran out of segments, of
loss-bearing tokens or of input gives back what exceeds the power below. So no sequence is padded, and at most one cut a sequence is made beside the cuts that long
examples need.

Each task packs what it reads, in one pass without a shuffle: its pool is bounded, tokens leave with their sequence, and
the input's end costs a task a few short sequences. Ids of sequences hold the task's number in their upper bits. A task that is
repeated over the same rows packs them alike; sequences never cross tasks.

Ids come from a tokenizers file. Texts of plain Latin characters are cut by the tokenizer's own pattern and looked up by
pre-token, each new one encoded once by the library; all others are encoded whole. The file's path is a parameter; every worker must have it.

Null texts and prompts are empty: the closing id is left. Empty tables give empty results; very long examples are cut; rows that repeat are
packed each by itself; other columns are left alone, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of byte-level pair encodings, the commonest kind first; for texts without NOT_PLAIN characters only, as letters, digits and
#: white space are settled there.
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ſ"
PRETOKEN = re.compile(rf" ?[{_LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e\xa1\xa7\xab\xb0\xb7\xbb\xbf\xd7\xf7{_LETTER}]")
#: Pre-tokens remembered by a worker, twice so many at the most, and characters of a text whose pre-tokens are listed at once.
REMEMBERED, LISTED = 1 << 19, 1 << 20
#: Pieces that wait in a task; packing starts at so many and stops at half.
POOL = 2048
_OUT = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
_DDL = ", ".join(f"{name} long" for name, _ in _OUT)


@dataclass(frozen=True)
class Limits:
    """Of one sequence."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024


class _Ids(dict):
    """Little-endian 32-bit ids of a text, by pre-tokens. A full memory becomes the older one; what is still in use moves on from there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids = self.older.get(piece) or self.encoded(piece)
        return ids

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_PLAIN.search(text):
            return self.encoded(text)
        pieces = PRETOKEN.findall(text) if len(text) < LISTED else (m[0] for m in PRETOKEN.finditer(text))
        return b"".join(map(self.__getitem__, pieces))


@cache
def _known(path: str) -> _Ids:
    """One a worker process, whose tasks share it."""
    return _Ids(path)


@dataclass
class _Example:
    key: int | None
    ids: bytes
    prompt: int  # ids that bear no loss

    def loss(self, start: int, size: int) -> int:
        return size - max(0, min(self.prompt - start, size))

    def room(self, start: int, size: int, tokens: int, loss: int) -> int:
        """Longest part that fits, from its start on, of a piece."""
        return min(size, tokens, max(0, self.prompt - start) + loss)


class Packer:
    """Fills sequences from a bounded pool. A piece is (example, start, length)."""

    def __init__(self, limits: Limits):
        if limits.tokens < 1 or limits.segments < 1 or limits.loss < 1:
            raise ValueError("limits are 1 or more")
        self.limits = limits
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.pieces: list[tuple[_Example, int, int]] = []
        self.demand = np.ones((3, 2 * POOL))

    def add(self, example: _Example, start: int, size: int) -> None:
        if len(self.pieces) == self.demand.shape[1]:
            self.demand = np.concatenate([self.demand, np.ones_like(self.demand)], axis=1)
        self.demand[:, len(self.pieces)] = size, 1, example.loss(start, size)
        self.pieces.append((example, start, size))

    def take(self, k: int) -> tuple[_Example, int, int]:
        piece, last = self.pieces[k], self.pieces.pop()
        if k < len(self.pieces):
            self.pieces[k], self.demand[:, k] = last, self.demand[:, len(self.pieces)]
        return piece

    def sequence(self) -> list[tuple[_Example, int, int]]:
        """One sequence from the pool, which holds a piece at least."""
        left, chosen = self.caps.copy(), []
        weights = self.demand[:, : len(self.pieces)].sum(axis=1) / self.caps
        weights /= weights.max()
        while self.pieces and left.min() >= 1:
            tokens, _, loss = self.demand[:, : len(self.pieces)]
            # every piece is one segment: that term of the product is the same for all
            rate = weights * left / self.caps**2
            product = tokens * rate[0] + loss * rate[2]
            fits = product * ((tokens <= left[0]) & (loss <= left[2]))
            k = int(fits.argmax())
            if not fits[k]:
                k = int(product.argmax())
            example, start, size = self.take(k)
            room = example.room(start, size, int(left[0]), int(left[2]))
            if room < size:
                self.add(example, start + room, size - room)
            chosen.append((example, start, room))
            left -= room, 1, example.loss(start, room)
        used = int(self.limits.tokens - left[0])
        excess = used - (used if used == self.limits.tokens else 1 << (used.bit_length() - 1))
        while excess:
            example, start, size = chosen.pop()
            back = min(size, excess)
            self.add(example, start + size - back, back)
            if back < size:
                chosen.append((example, start, size - back))
            excess -= back
        return chosen

    def sequences(self, examples: Iterator[_Example]) -> Iterator[list[tuple[_Example, int, int]]]:
        for example in examples:
            start, size = 0, len(example.ids) // 4
            while (room := example.room(start, size - start, self.limits.tokens, self.limits.loss)) == self.limits.tokens:
                yield [(example, start, room)]
                start += room
            if start < size:
                self.add(example, start, size - start)
            if len(self.pieces) >= POOL:
                while len(self.pieces) > POOL // 2:
                    yield self.sequence()
        while self.pieces:
            yield self.sequence()


def _pack(path: str, limits: Limits, end_id: int, with_ids: bool):
    schema = pa.schema(_OUT + [("ids", pa.list_(pa.int64()))] * with_ids)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)

        def examples() -> Iterator[_Example]:
            for batch in batches:
                for key, prompt, text in zip(batch.column("doc_id").to_pylist(), batch.column("prompt"), batch.column("text")):
                    before = known.of(prompt.as_py())
                    yield _Example(key, before + known.of(text.as_py()) + end, len(before) // 4)

        number, rows = TaskContext.get().partitionId() << 33, []
        for sequence in Packer(limits).sequences(examples()):
            offset = 0
            for example, start, size in sequence:
                ids = memoryview(example.ids)[4 * start : 4 * (start + size)]
                row = (example.key, start, size, zlib.crc32(ids), len(example.ids) // 4, example.loss(start, size), number, offset)
                rows.append(row + (np.frombuffer(ids, dtype="<u4").tolist(),) if with_ids else row)
                offset += size
            number += 1
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def packed(examples: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 0, prompt: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of an example: doc_id, start (the example's ids before it), length, ids_crc32, doc_tokens (of the
    example, with its end), loss_tokens, sequence_id and offset (in its sequence, gapless); with_ids adds the ids.

    tokenizer is the path of a tokenizers file that every worker has; prompt names the column of prompts."""
    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt"), "text")
    return rows.mapInArrow(_pack(tokenizer, limits, end_id, with_ids), _DDL + ", ids array<long>" * with_ids)
