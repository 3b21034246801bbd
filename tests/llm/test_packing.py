"""Packing: every id once, limits kept, no padding; the greedy rule against plain Python; ids against the library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartolith.llm import packing as m
from cartolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def held(rows, examples, limits):
    """rows hold each id of examples (key, prompt ids, all ids) once, in sequences within limits that need no padding."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_key) == {k for k, _, _ in examples}
    for key, prompt, ids in examples:
        at = 0
        for r in sorted(by_key[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            part = ids[at : at + r.length]
            assert r.ids_crc32 == crc(part)
            assert r.loss_tokens == sum(i >= prompt for i in range(at, at + r.length))
            at += r.length
        assert at == len(ids)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and (at == limits.tokens or at & (at - 1) == 0)
        assert len(sequence) <= limits.segments and sum(r.loss_tokens for r in sequence) <= limits.loss
    return by_sequence


def test_query(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op12_packing"](spark, SF).collect()
    examples = [(d.doc_id, 0, tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0]) for d in docs]
    sequences = held(rows, examples, m.Limits())
    assert len(sequences) <= sum(len(ids) for _, _, ids in examples) / 1024 + 11 * 4
    assert sorted(map(tuple, rows)) == sorted(map(tuple, QUERIES["op12_packing"](spark, SF).collect()))


def test_ids_of_whole_texts(spark, tokenizer):
    known = m._Ids(PATH)
    for row in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert known.of(row.text) == np.array(tokenizer.encode(row.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


PAIR = (m._Ids(PATH), Tokenizer.from_file(PATH))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sté ñÖ1²\t\n\r\x0b\x1c _-.«¿×\xa0中́ŉ"), max_size=40))
def test_ids_of_any_text(text):
    known, whole = PAIR
    assert known.of(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_memory_of_pretokens_is_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(m, "REMEMBERED", 5)
    monkeypatch.setattr(m, "LISTED", 10)
    known, text = m._Ids(PATH), "the quick brown fox jumps over the lazy dog " * 3
    assert known.of(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() and len(known) <= 5 and len(known.older) <= 5


def greedy(sizes, limits):
    """The rule in plain Python for pieces without prompts that never need a cut: (index of piece) by sequence."""
    waiting, out = dict(enumerate(sizes)), []
    while waiting:
        total = [sum(waiting.values()) / limits.tokens, len(waiting) / limits.segments, sum(waiting.values()) / limits.loss]
        left, chosen = [limits.tokens, limits.segments, limits.loss], []
        while True:
            fits = {k: v for k, v in waiting.items() if v <= left[0] and left[1] and v <= left[2]}
            if not fits:
                break
            score = lambda v: sum(w * r * d / c**2 for w, r, d, c in zip(total, left, (v, 1, v), (limits.tokens, limits.segments, limits.loss)))
            best = max(score(v) for v in fits.values())
            k = next(k for k, v in fits.items() if abs(score(v) - best) < 1e-12)
            v = waiting.pop(k)
            chosen.append(v)
            left = [left[0] - v, left[1] - 1, left[2] - v]
        out.append(sorted(chosen))
    return out


def test_largest_dot_product_goes_in():
    """64 + 32 + 16 + 16 fill a sequence of 128 in the order of the rule; all sizes sum to full sequences, so nothing is cut."""
    sizes = [16, 64, 32, 16, 64, 64, 32, 16, 64, 16]
    limits = m.Limits(tokens=128, segments=8, loss=128)
    packer = m.Packer(limits)
    examples = (m._Example(k, b"\0" * 4 * n, 0) for k, n in enumerate(sizes))
    got = [sorted(n for _, _, n in s) for s in packer.sequences(examples)]
    assert got == greedy(sizes, limits)


def test_segments_steer_the_choice():
    """Few segments left weigh small pieces down; the two long pieces meet, the short ones share the rest."""
    limits = m.Limits(tokens=64, segments=2, loss=64)
    got = [sorted(n for _, _, n in s) for s in m.Packer(limits).sequences(m._Example(k, b"\0" * 4 * n, 0) for k, n in enumerate([1, 1, 32, 32, 1, 1]))]
    assert got == [[32, 32], [1, 1], [1, 1]]


@pytest.mark.parametrize("limits", [m.Limits(128, 4, 128), m.Limits(128, 64, 50), m.Limits(100, 3, 70), m.Limits(1, 1, 1)])
def test_limits_of_random_examples(limits):
    rng = random.Random(limits.tokens + limits.loss)
    examples = []
    for k in range(500):
        n = rng.choice([1, 2, 5, 40, 130, 700])
        examples.append(m._Example(k, np.arange(n, dtype="<u4").tobytes(), rng.choice([0, 0, n // 2, n - 1])))
    seen = defaultdict(list)
    for sequence in m.Packer(limits).sequences(iter(examples)):
        total = sum(n for _, _, n in sequence)
        assert total == limits.tokens or total & (total - 1) == 0
        assert total <= limits.tokens and len(sequence) <= limits.segments and sum(e.loss(s, n) for e, s, n in sequence) <= limits.loss
        for e, s, n in sequence:
            seen[e.key].append((s, n))
    for e in examples:
        at = 0
        for s, n in sorted(seen[e.key]):
            assert s == at and n > 0
            at += n
        assert at == len(e.ids) // 4


def test_pool_stays_bounded(monkeypatch):
    monkeypatch.setattr(m, "POOL", 16)
    packer, most = m.Packer(m.Limits(64, 8, 64)), 0
    for _ in packer.sequences(m._Example(k, b"\0" * 4 * (k % 60 + 1), 0) for k in range(2000)):
        most = max(most, len(packer.pieces))
    assert most <= 16


def test_instruction_data(spark, tokenizer):
    """Turns of conversations: the question is the prompt, the answer bears the loss; ids come back whole."""
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    pairs = turns.selectExpr("conv_id", "turn + 1 turn", "text question").join(turns, ["conv_id", "turn"]).selectExpr("conv_id * 1000 + turn doc_id", "question", "text")
    limits = m.Limits(tokens=512, segments=6, loss=200)
    rows = m.packed(pairs, PATH, limits, prompt="question", with_ids=True).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids
    examples = [(r.doc_id, len(ids(r.question)), ids(r.question) + ids(r.text) + [0]) for r in pairs.collect()]
    held(rows, examples, limits)
    back = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.start):
        back[r.doc_id] += r.ids
    assert dict(back) == {k: i for k, _, i in examples}


def test_edges(spark, tokenizer):
    """Null and empty texts, null and repeated ids, a very long text, clashing columns, an empty table."""
    long = "word and another, 12 " * 60_000
    frame = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "null id", 5), (3, "twice", 5), (3, "twice", 5), (4, long, 5)], "doc_id long, text string, start int").withColumn("prompt", F.lit("not a prompt unless named"))
    rows = m.packed(frame, PATH).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert total == {1: 1, 2: 1, None: n("null id"), 3: 2 * n("twice"), 4: n(long)}
    assert m.packed(frame.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        m.Packer(m.Limits(tokens=0))

