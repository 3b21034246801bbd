"""Substring dedup, Jaccard components and connected components against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from cartolith.llm import substring_dedup as sd
from cartolith.operators.graph import components
from cartolith.llm.jaccard_join import jaccard_components, one_of_each, spare

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_cover():
    assert {(a - b) % sd.PERIOD for a in sd.COVER for b in sd.COVER} == set(range(sd.PERIOD))


def brute_windows(rows, n=50):
    first = {}
    cut = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, cut):
        for i in range(len(w) - n + 1) if d is not None else ():
            k = tuple(w[i : i + n])
            first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), w in zip(rows, cut):
        gone = set()
        for i in range(len(w) - n + 1) if d is not None else ():
            if first[tuple(w[i : i + n])] < d:
                gone |= set(range(i, i + n))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(3)
    say = lambda n: [rng.choice(["é", "ab", "c!", "dd", "e"]) + str(rng.randrange(400)) for _ in range(n)]
    shared = [say(n) for n in (49, 50, 51, 60, 81, 130)]
    rows = []
    for i in range(120):
        w = say(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 12)
            w += s[a:] + say(rng.randrange(30))
        rows.append((rng.randrange(200), rng.choice([" ", "\n", "  ", "\x0b"]).join(w)))
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1]), (None, " ".join(shared[5])), (503, "ha " * 5000), (499, "ha " * 60), (1, " ".join(shared[5] * 3))]
    return rows


def test_substring_dedup(spark, passages):
    d = spark.createDataFrame([(*r, 1) for r in passages], "doc_id long, text string, at int")
    got = sd.substring_dedup(d)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_windows(passages)
    texts = sd.substring_dedup(d, with_text=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in texts)
    assert sd.substring_dedup(d.where("false")).count() == 0


def brute_sets(rows, size, percent):
    sets = []
    for d, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, size, percent):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, passage = [], say(60)
    for _ in range(12):
        base = say(rng.choice([3, 7, 12, 40, 90, 300]))
        for _ in range(rng.choice([1, 3, 25])):
            w = list(base)
            for _ in range(rng.randrange(1 + len(w) // 25 + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.2:
                w += passage
            rows.append((rng.randrange(10**6), " ".join(w).title() if rng.random() < 0.3 else " ".join(w)))
    chain = say(200)  # each one near the next only
    for i in range(8):
        rows.append((2 * 10**6 - i, " ".join(chain)))
        for k in range(4):
            chain[5 + 11 * i + k] = "x" + str(i * 10 + k)
    rows += [(5, None), (6, ""), (7, rows[0][1]), (7, rows[0][1]), (7, "solo one two three four five six"), (None, rows[0][1]), (8, "ho " * 9000), (9, "ho")]
    d = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d, size, percent).collect()), key=str)
    assert got == brute_sets(rows, size, percent)
    kept = one_of_each(d, size, percent)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id not in (5, 6, None)]
    # id 7 has two unlike texts, which are in two components: a row of each stays
    assert sorted(ids) == sorted([*{r[2] for r in got if r[1] and r[2] is not None}, 7])


def test_one_of_each_loses_no_text(spark):
    """Of repeated ids with unlike texts, each text's component keeps one row; of equal rows one stays."""
    x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    rows = [(7, x), (7, y), (9, x + " more"), (9, y), (7, x), (3, "a b c d e f g"), (4, None), (4, None), (None, x), (5, "")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_key int")
    want = [(7, x), (7, y), (3, "a b c d e f g"), (4, None), (4, None), (None, x), (5, "")]
    assert sorted(((r.doc_id, r.text) for r in one_of_each(d).collect()), key=str) == sorted(want, key=str)
    near = [(1, x + " one"), (1, x), (2, x + " two")]
    assert [r.doc_id for r in one_of_each(spark.createDataFrame(near, "doc_id long, text string")).collect()] == [1]


def test_spare_is_monotone():
    for percent in (80, 85):
        assert all(0 <= spare(n + 1, percent) - spare(n, percent) <= 1 for n in range(1, 2000))


def test_no_links(spark):
    d = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_components(d).collect()) == [(1, 1), (2, 2)]
    assert jaccard_components(d.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(70):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
