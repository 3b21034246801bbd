"""Periodic runs against a search of all periods, and the registered query's columns against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cartolith.llm import periodic_runs as m
from cartolith.llm.queries import QUERIES
from cartolith.llm.textnum import mix

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs by every period; smallest period of equal bounds."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def runs_of(docs):
    values = mix(np.array([x for d in docs for x in d], dtype=np.uint64) + np.uint64(1))
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    out = [[] for _ in docs]
    for b, e, q in zip(*m.find_runs(values, first)):
        k = int(np.searchsorted(first, b, side="right")) - 1
        assert e <= first[k + 1]
        out[k].append((int(b - first[k]), int(e - b), int(q)))
    return out


def periodic(rng, alphabet, n):
    out = []
    while len(out) < n:
        q = rng.choice([1, 2, 3, 7, 8, 9, 12, 16, 17, 31, 33, 40, 65])
        block = [rng.randrange(alphabet) for _ in range(q)]
        out += (block * 7)[: rng.randrange(3 * q, 7 * q)]
        out += [rng.randrange(alphabet) for _ in range(rng.randrange(4))]
    return out[:n]


def test_all_runs_of_random_periodic_texts():
    for seed in range(120):
        rng = random.Random(seed)
        docs = [periodic(rng, rng.choice([2, 3, 50]), rng.randrange(0, 700)) for _ in range(rng.randrange(1, 6))]
        assert runs_of(docs) == [brute(d) for d in docs], seed


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=90), min_size=1, max_size=4))
def test_all_runs_of_two_words(docs):
    assert runs_of(docs) == [brute(d) for d in docs]


def test_nested_runs_and_wide_periods():
    inner = ([1] * 9 + [2, 3]) * 6  # runs of one word within runs of eleven
    wide = list(range(100, 700)) * 4 + [5]
    assert runs_of([inner, wide, [7] * 5, [7] * 6]) == [brute(inner), [(0, 2400, 600)], [], [(0, 6, 1)]]
    assert len(brute(inner)) == 7


def test_a_collision_of_hashes_is_caught(monkeypatch):
    """With bisection led astray, the words are compared and the document is scanned."""
    doc = list(range(20)) * 5 + list(range(90, 99))
    monkeypatch.setattr(m, "_extended", lambda values, low, high, at, lag: (low, high))
    assert runs_of([[1, 2], doc]) == [[], [(0, 100, 20)]]


def want(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(collapse(words, runs))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_periodic_runs"](spark, SF).select(COLUMNS).collect()
    expected = sorted(want(r.doc_id, r.text) for r in docs)
    assert sorted(tuple(r) for r in got) == expected
    assert sum(r[1] > 0 for r in expected) > 10


def test_edges(spark):
    """Nulls, empty and blank texts, repeated rows, separators of all kinds, wide characters, a very long text, clashing columns."""
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(None, "a b " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x\ty\x0bx y\nx y  x y"), (4, "x\ty\x0bx y\nx y  x y"), (5, "é ü " * 5 + "ß"), (30, "a b c d e f g"), (6, long)]
    rows += [(i, "p q r s t u v w") for i in range(100, 140)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, runs int, period string")
    out = m.run_digests(m.periodic_runs(m.planted(frame))).collect()
    key = repr
    expected = [want(i, t) for i, t in rows if t != long]
    assert sorted((tuple(r) for r in out if r.doc_id != 6), key=key) == sorted(expected, key=key)
    six = next(r for r in out if r.doc_id == 6)
    assert (six.n_runs, six.start, six.length, six.period) == (1, 0, 60_000, 5003) or zlib.crc32(b"6") % 10 == 0
    texts = {r.doc_id: r.collapsed_text for r in m.periodic_runs(frame).collect()}
    assert texts[5] == "é ü ß" and texts[1] == texts[3] == "" and len(texts[6].split()) == 5003
    assert m.run_digests(m.periodic_runs(m.planted(frame.limit(0)))).count() == 0
