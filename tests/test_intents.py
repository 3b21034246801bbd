"""Category phrases against a plain reading of the rules."""

import random

from pyspark.sql import functions as F

from cartolith.operators import intents as I

PHRASES = [("gas station", "fuel"), ("station", "train"), ("gare", "train"), ("chateau", "castle"), ("chateaux", "castle"), ("chateau", "winery"), ("bus", "bus"), ("hotel de ville", "town_hall"), ("hotel", "hotel"), ("garer", "parking"), ("pharmacie", "pharmacy"), ("gas", "fuel")]


def plain(tokens, prefix):
    entries = sorted({(tuple(p.split()), c) for p, c in PHRASES}, key=lambda e: (-len(e[0]), -len(" ".join(e[0])), " ".join(e[0]), e[1]))
    used, spans, found = set(), set(), []
    for begun in (False, True) if prefix else (False,):
        for words, category in entries:
            for start in range(len(tokens) - len(words) + 1):
                here = range(start, start + len(words))
                if used & set(here) and (start, len(words)) not in spans:
                    continue

                def fits(i, w):
                    t = tokens[i]
                    return t in (w, w + "s") or t + "s" == w or begun and i == len(tokens) - 1 and len(t) >= 4 and w.startswith(t)

                if all(fits(i, w) for i, w in zip(here, words)):
                    used |= set(here)
                    spans.add((start, len(words)))
                    if category not in [f[0] for f in found]:
                        found.append((category, start, len(words)))
    return found


def test_intents(spark):
    rng = random.Random(1)
    words = ["gas", "station", "stations", "gare", "gares", "garer", "chateau", "chateaus", "bus", "hotel", "de", "ville", "pharm", "pharmacies", "auch", "stat", "gar", "hotels"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randrange(6))]) for i in range(300)]
    q = spark.createDataFrame(rows, "query_id long, tokens array<string>")
    p = spark.createDataFrame(PHRASES, "phrase string, category string")
    for prefix in (True, False):
        got = {r.query_id: [(f.category, f.start, f.n) for f in r.found] for r in I.intents(q, p, prefix).collect()}
        assert got == {i: plain(t, prefix) for i, t in rows}


def test_labels_and_pure(spark):
    p = spark.createDataFrame(PHRASES, "phrase string, category string")
    labels = [(1, ["relais", "de", "la", "gare"]), (2, ["hotel", "de", "ville"]), (3, ["hotel", "de", "la", "gare"]), (4, ["rien"])]
    q = spark.createDataFrame(labels, "query_id long, tokens array<string>")
    assert {r.query_id: r.category for r in I.label_category(q, p).collect()} == {1: None, 2: "town_hall", 3: "hotel", 4: None}
    asked = spark.createDataFrame([(1, ["gares"]), (2, ["pharmacie", "de", "auch"]), (3, ["gas", "station", "de"])], "query_id long, tokens array<string>")
    got = I.intents(asked, p).select("query_id", I.pure(F.col("found"), F.col("tokens")).alias("pure"), I.house_numbers(F.array(F.lit("12bis"), F.lit("rue"), F.lit("9"))).alias("n")).collect()
    assert {r.query_id: r.pure for r in got} == {1: True, 2: False, 3: True} and got[0].n == ["12bis"]
    rows = spark.createDataFrame([(1, "Église", None), (2, "Divers", "Gare SNCF"), (3, "Château fort", "x")], "query_id long, nature string, label string")
    known = spark.createDataFrame([("eglise", "worship")], "nature string, category string")
    assert {r.query_id: r.category for r in I.nature_category(rows, known, p).collect()} == {1: "worship", 2: "train", 3: "castle"}
