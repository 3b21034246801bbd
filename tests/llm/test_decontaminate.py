"""Piece hits and bit-parallel distances against plain dynamic programming."""

import random

from cartolith.llm.decontaminate import budget, contaminated, decontaminate, myers, normalise, pieces

SF = "/root/testdata/sf0.001"


def least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, n))) for n in (12, 40))
        masks = {}
        for i, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << i
        assert myers(masks, len(p), t) == least(p, t)


def test_pieces():
    assert "".join(x for _, x in pieces("abcdefghij", 3)) == "abcdefghij" and len(pieces("abcdefghij", 3)) == 4


def brute(docs, bench, rate):
    out = []
    for d, text in docs:
        for k, item in bench:
            a, b = normalise(item or ""), normalise(text or "")
            e = budget(len(a), rate)
            if a and b and (x := least(a, b)) <= e:
                out.append((d, k, x))
    return sorted(out, key=str)


def test_contaminated(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, say(n)) for i, n in enumerate((3, 8, 20, 30, 30))] + [(90, None), (91, ""), (92, "!!"), (0, "again")]
    docs = []
    for i in range(60):
        item = list(rng.choice(bench[:5])[1])
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(item))
            item[k : k + 1] = rng.choice([[], ["x"], [item[k], "y"]])
        docs.append((i, say(20) + " " + "".join(item).upper() + ", " + say(20)))
    docs += [(100, None), (101, ""), (102, bench[3][1]), (102, bench[3][1]), (None, bench[2][1]), (103, "x" * 40000)]
    d = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((tuple(r) for r in contaminated(d, b).collect()), key=str)
    assert got == brute([x for x in docs if x[0] != 103], bench, 0.06)
    hit = {r[0] for r in got}
    assert sorted(str(r.doc_id) for r in decontaminate(d, b).collect()) == sorted(str(x[0]) for x in docs if x[0] not in hit)
    assert contaminated(d, b.where("false")).count() == 0 and contaminated(d.where("false"), b).count() == 0
