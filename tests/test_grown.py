"""What went wrong on larger tables, in small."""

import math
import random
import threading
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from cartolith.functions import coerce, text
from cartolith.operators import conflate, graph, index, intents, joins
from cartolith.operators.search_index import build_index, search_many
from cartolith.plans.queries import QUERIES
from cartolith.plans.tables import SPREAD


def test_kilometres_as_printf(spark):
    metres = [5550.0, 9250.0, 250.0, 1850.0, 0.0, 9999.0, *[37.0 * k for k in range(271)], *[k / 8 for k in range(0, 79000, 50)]]
    got = spark.createDataFrame([(m,) for m in metres], "m double").select("m", coerce.kilometres(F.col("m")).alias("k")).collect()
    assert [r.k for r in got] == [f"{r.m / 1000:.1f} km" if r.m < 10000 else f"{int(r.m / 1000 + 0.5)} km" for r in got]


def test_equal_records_tie(spark, tmp_path):
    name = "ndshhe thhein nderor ththre"
    records = spark.range(600).select(F.col("id").alias("record_id"), F.lit(name).alias("name"), F.lit("5").alias("house"), F.lit(44.0).alias("boost"), F.lit(0.0).alias("x"), F.lit(0.0).alias("z"))
    built = build_index(records, str(tmp_path / "index"), ("name",), "house")
    queries = spark.createDataFrame([(q, "5 thhheon th", None, None) for q in range(4)], "query_id long, query string, near_x double, near_z double")
    hits = search_many(built, queries, 600).orderBy("query_id", "place").collect()
    assert [(h.query_id, h.record_id) for h in hits] == [(q, r) for q in range(4) for r in range(600)]
    assert len({h.score for h in hits}) == 1


def sides_sent(df):
    """What is below the broadcasts of a plan."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*()0123456789"))
        depth = None if depth is not None and at <= depth else depth
        depth = at if depth is None and "BroadcastExchange" in line else depth
        out += [line] if depth is not None else []
    return "\n".join(out)


def test_queries_are_not_sent(spark, tmp_path):
    asked, phrases = str(tmp_path / "asked"), str(tmp_path / "phrases")
    spark.range(4000).select(F.col("id").alias("query_id"), F.array(F.lit("w7"), F.lit("x")).alias("tokens")).coalesce(1).write.parquet(asked)
    spark.range(4000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("phrase"), F.sha2(F.col("id").cast("string"), 256).alias("category")).coalesce(1).write.parquet(phrases)
    q, p = spark.read.parquet(asked), spark.read.parquet(phrases)
    assert "tokens" not in sides_sent(intents.matches(q, p))
    found = intents.intents(q, p, prefix=False)
    assert found.where("found[0].start = 0 and size(found) = 1").count() == 4000


@contextmanager
def within(spark, seconds):
    """Cancels what still runs after so many seconds."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()


def test_first_of_a_frequent_name(spark):
    n = 150_000
    at = lambda k: [(k * 7919 % 401).cast("double").alias("x"), (k * 3079 % 409).cast("double").alias("z")]
    k = F.col("id")
    known = spark.range(n).select(k.alias("known_id"), F.when(k % 3 == 0, "S").alias("siret"), F.lit("Café").alias("name"), F.lit("1 rue A").alias("address"), *at(k))
    rows = spark.range(n).select(k.alias("row_id"), F.when(k % 2 == 0, "S").alias("siret"), F.lit("cafe").alias("name"), F.when(k % 5 > 0, "Rue A").alias("address"), *at(k * 31 + 7))
    with within(spark, 100):
        met = {r.row_id: r.known_id for r in conflate.registered_or_near(rows, known).collect()}
        pages = rows.select(F.col("row_id").alias("page_id"), "name", F.when(F.col("row_id") % 7 > 0, F.col("x")).alias("x"), "z")
        found = {r.page_id: r.known_id for r in conflate.enriched(pages, known).collect()}
    near = lambda i, j: math.hypot((i * 31 + 7) * 7919 % 401 - j * 7919 % 401, (i * 31 + 7) * 3079 % 409 - j * 3079 % 409) <= 150
    for i in range(0, n, 97):
        want = 0 if i % 2 == 0 else next((j for j in range(n) if j % 3 and near(i, j)), None) if i % 5 else None
        assert met.get(i) == want
        assert found.get(i) == (0 if i % 7 == 0 else next((j for j in range(n) if near(i, j)), None))


def test_nearest_of_many(spark):
    n = 60_000
    side = lambda name, a: spark.range(n).select(F.col("id").alias(name), (F.col("id") * a % 997).alias("x"), (F.col("id") * (a + 2) % 991).alias("z"))
    far = spark.createDataFrame([(n, 10**6, 0)], "l long, x long, z long")
    with within(spark, 100):
        found = joins.nearest_within(side("l", 31).union(far), side("r", 57).union(side("r", 57)), "l", "r", 1000).collect()
        few = joins.nearest_within(side("l", 31).where("l % 1000 = 0"), side("r", 57), "l", "r", 1000).collect()
    met = {f.l: (f.r, f.d2) for f in found}
    assert len(found) == n and set(met) == set(range(n)) and all(met[f.l] == (f.r, f.d2) for f in few) and len(few) == 60
    for i in range(0, n, 3001):
        d2, j = min(((i * 31 % 997 - j * 57 % 997) ** 2 + (i * 33 % 991 - j * 59 % 991) ** 2, j) for j in range(n))
        assert met[i] == (j, d2)


def test_nearest_number_of_a_frequent_number(spark):
    n = 200_000
    wanted = spark.range(n).select("id", F.lit(1).alias("street"), (F.col("id") % 5).alias("number"))
    known = spark.range(n).select(F.lit(1).alias("street"), (F.col("id") * 2 + 3).alias("number"))
    with within(spark, 60):
        found = joins.nearest_number(wanted, known, ["street"]).groupBy("number").agg(F.count("*"), F.min("found"), F.max("found"), F.max("gap")).collect()
    assert {tuple(r) for r in found} == {(0, n // 5, 3, 3, 3.5), (1, n // 5, 3, 3, 2.0), (2, n // 5, 3, 3, 1.5), (3, n // 5, 3, 3, 0.0), (4, n // 5, 3, 3, 1.5)}


def test_conflation_by_blocks(spark):
    """Blocks find the pairs of all near cells, and where many lie in one cell far fewer candidates."""
    rng, rows = random.Random(7), []
    for i in range(600):
        kind = ("business", "address", "building", "road", "water")[i % 5]
        rows.append((i, kind, ("osm", "ban")[i // 5 % 2], rng.uniform(0, 150), rng.uniform(0, 150), str(i // 20) if i % 3 else None, str(i // 15) if i % 4 else None, ("", "Café A", "café-a", "B")[i // 3 % 4], "12 rue x" if i % 7 else None, ("track", "primary", None)[i // 4 % 3], ("river", "lake", None)[i // 6 % 3], i // 2 % 2 == 0))
    f = spark.createDataFrame(rows, "id long, kind string, source string, x double, z double, siret string, register_id string, name string, address string, road_class string, water_type string, area boolean")
    near = lambda l, r: F.greatest(F.lit(0.0), 1 - F.hypot(l("x") - r("x"), l("z") - r("z")) / 30)
    rules = {
        "business": conflate.same_business, "address": conflate.same_address, "building": lambda l, r, d: conflate.same_building(l, r, d, near(l, r)),
        "road": lambda l, r, d: conflate.same_road(l, r, d), "water": lambda l, r, d: conflate.same_water(l, r, d, near(l, r), d),
    }
    pairs = lambda **more: sorted((p.a, p.b) for p in conflate.conflated(f, rules, **more).collect())
    every = pairs()
    kinds = {r[0]: r[1] for r in rows}
    assert pairs(blocks=conflate.BLOCKS) == every and {kinds[a] for a, _ in every} == set(rules)
    met = lambda *blocks: sum(conflate.candidates(f.where("kind = 'road'"), block=b).count() for b in blocks)
    assert met(*conflate.BLOCKS["road"]) * 20 < met(conflate.Block())


def test_serial_match_in_few_rounds(spark, monkeypatch):
    """Many left rows that want the same few right ones: pairs that cannot match leave at once."""
    rng = random.Random(5)
    wishes = {a: rng.sample(range(30), 20) for a in range(400)}
    rows = [(a, b, k // 3) for a, bs in wishes.items() for k, b in enumerate(bs)]
    rounds, write = [], conflate.materialise
    monkeypatch.setattr(conflate, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    got = {(r.a, r.b) for r in conflate.serial_match(spark.createDataFrame(rows, "a long, b long, w long"), "a", "b", F.col("a"), F.col("w")).collect()}
    taken, want = set(), set()
    for a, bs in wishes.items():
        free = sorted((k // 3, b) for k, b in enumerate(bs) if b not in taken)
        if free:
            want.add((a, free[0][1]))
            taken.add(free[0][1])
    assert got == want and len(rounds) <= 12


def test_establishments_by_turns(spark, monkeypatch):
    rng = random.Random(6)
    at = lambda n, name: [(i, name, rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(n)]
    places, shops = spark.createDataFrame(at(60, "Bar du Gers"), "place_id long, name string, x double, z double"), spark.createDataFrame(at(500, "Bar Gers"), "business_id long, name string, x double, z double").withColumn("brand", F.lit(None).cast("string"))
    found = lambda: {(r.business_id, r.place_id) for r in conflate.establishments(places, shops).collect()}
    whole = found()
    monkeypatch.setattr(conflate, "SETTLED", 40)
    monkeypatch.setattr(conflate, "IDS", 100)
    assert found() == whole and len(whole) == 60


def in_turn(rows):
    """(a, b) of rows (a, b, wish), one after the other."""
    a, b, out = set(), set(), set()
    for i, j, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if i not in a and j not in b:
            a.add(i), b.add(j), out.add((i, j))
    return out


def test_serial_match_of_a_long_chain(spark, monkeypatch):
    """Each left row wants first what the one before it gets: the rounds do not follow the chain."""
    rows = [(0, 0, 0), *[(a, a - 1 + w, w) for a in range(1, 150) for w in (0, 1)]]
    rounds, write = [], conflate.materialise
    monkeypatch.setattr(conflate, "materialise", lambda df, name: rounds.append(name) or write(df, name))
    match = lambda pairs: {(r.a, r.b) for r in conflate.serial_match(pairs, "a", "b", F.col("a"), F.col("w")).collect()}
    assert match(spark.createDataFrame(rows, "a long, b long, w long")) == in_turn(rows) == {(a, a) for a in range(150)} and len(rounds) <= 3
    rng = random.Random(3)
    rows = [(a, b, rng.randrange(4)) for a in range(60) for b in rng.sample(range(50), 12)]
    monkeypatch.setattr(conflate, "AT_ONCE", 20)
    assert match(spark.createDataFrame([*rows, (None, 3, 0), (2, None, 0)], "a long, b long, w long")) == in_turn(rows)


@pytest.mark.parametrize("wishes", [1, 3, 32])
def test_establishments_with_few_wishes(spark, monkeypatch, wishes):
    rng = random.Random(11)
    at = lambda n, names: [(i, rng.choice(names), rng.choice([400.0, rng.uniform(0, 800)]), rng.choice([400.0, rng.uniform(0, 800)])) for i in range(n)]
    places, shops = at(90, ("Bar du Gers", "Bar", "Café Auch", "bar auch")), at(260, ("Bar Gers", "BAR AUCH", "Café", "Bar Auch Sud"))
    monkeypatch.setattr(conflate, "WISHES", wishes)
    monkeypatch.setattr(conflate, "SETTLED", 40)
    monkeypatch.setattr(conflate, "IDS", 100)
    words = lambda n: [w for w in n.lower().split() if w != "du"]
    share = lambda x, y: len([w for w in x if w in y]) / len(x) if len(x) <= len(y) else len([w for w in y if w in x]) / len(y)
    rows = []
    for i, shop, x, z in shops:
        for j, place, u, v in places:
            d, score = math.hypot(x - u, z - v), share(words(place), words(shop))
            if score >= 0.8 and d <= (300 if shop.lower() == place.lower() else 150):
                rows.append((i, j, (-score, d)))
    p, b = spark.createDataFrame(places, "place_id long, name string, x double, z double"), spark.createDataFrame(shops, "business_id long, name string, x double, z double")
    got = {(r.business_id, r.place_id) for r in conflate.establishments(p, b.withColumn("brand", F.lit(None).cast("string"))).collect()}
    assert got == in_turn(rows) and len(got) > 50


@pytest.mark.parametrize("name", ["bbox_iou", "line_in_polygon", "polygon_anchors", "polygon_contains", "polygon_overlap", "polygon_problems", "shown_names", "simplified_lines", "tile_fragments"])
def test_few_rows_use_all_cores(spark, name):
    """Rows that cost much are not left to the one task that reads their few bytes."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({SPREAD * spark.sparkContext.defaultParallelism})" in plan


def test_dealt_rows_are_not_sent(spark, tmp_path):
    spark.range(20000).select("id", F.col("id").alias("x"), F.col("id").alias("z")).coalesce(1).write.parquet(str(tmp_path / "points"))
    p = spark.read.parquet(str(tmp_path / "points"))
    many, few = joins.blocked_pairs(p, p, 2), joins.blocked_pairs(p.where("id < 9"), p, 2)
    assert not sides_sent(many) and sides_sent(few)
    assert many.count() == 20000 + 2 * 19999 and few.count() == 27 - 1


def test_dense_points_are_matched_by_turns(spark, monkeypatch):
    rng, seen, own = random.Random(9), [], joins.one_to_one
    sides = [[(i, rng.randrange(60), rng.randrange(60)) for i in range(n)] for n in (400, 300)]
    left, right = (spark.createDataFrame(rows, f"{c} long, x long, z long") for c, rows in zip("ab", sides))
    monkeypatch.setattr(joins, "one_to_one", lambda pairs, *names: seen.append(pairs.count()) or own(pairs, *names))
    got = {(r.a, r.b, r.d2) for r in joins.one_to_one_within(left, right, "a", "b", 40).collect()}
    every = sorted(((x - u) ** 2 + (z - v) ** 2, i, j) for i, x, z in sides[0] for j, u, v in sides[1])
    want, a, b = set(), set(), set()
    for d2, i, j in every:
        if d2 <= 1600 and i not in a and j not in b:
            a.add(i), b.add(j), want.add((i, j, d2))
    assert got == want and sum(seen) < 10_000 < sum(d2 <= 1600 for d2, *_ in every)


def test_records_of_one_name_are_taken_by_turns(spark, monkeypatch):
    rng, seen, own = random.Random(4), [], index.first_kept
    rows = [(i, "Café Rond", rng.choice(["poi", "business", "place"]), rng.choice(["village", "park"]), rng.uniform(0, 3500), rng.uniform(0, 3500), rng.choice([None, None, 400.0, 900.0]), i % 7, i % 5) for i in range(600)]
    monkeypatch.setattr(index, "first_kept", lambda pairs, nodes: seen.append(pairs.count()) or own(pairs, nodes))
    records = spark.createDataFrame(rows, "record_id long, name string, kind string, category string, x double, z double, reach double, boost int, richness int")
    got = {r.record_id: r.boost for r in index.distinct_records(records).collect()}
    kept, boost, pairs = [], {}, 0
    for r in sorted(rows, key=lambda r: (-r[8], -r[7], r[0])):
        place, lived = r[2] == "place", r[2] == "place" and r[3] == "village"
        for q in kept:
            both = place and q[2] == "place"
            apart = (q[2] == "place") != place and (lived or q[2] == "place" and q[3] == "village")
            if not apart and math.hypot(r[4] - q[4], r[5] - q[5]) <= (1500 if both else max(150, r[6] or 0, q[6] or 0)):
                boost[q[0]] = max(boost[q[0]], r[7])
                break
        else:
            kept.append(r)
            boost[r[0]] = r[7]
    assert got == boost and sum(seen) < 10_000


def test_close_boxes_are_clustered_without_their_pairs(spark, monkeypatch):
    rng, seen, own = random.Random(8), [], graph.components
    at = [(rng.choice([0, 300, 620]) + rng.uniform(0, 90), rng.uniform(0, 60)) for _ in range(900)] + [(rng.uniform(2000, 9000), rng.uniform(0, 9000)) for _ in range(200)]
    rows = [(i, "ab"[i % 2], x, z, x + rng.uniform(0, 200), z + rng.uniform(0, 90)) for i, (x, z) in enumerate(at)] + [(5000, "a", None, 0.0, 1.0, 1.0), (5001, "a", None, 0.0, 1.0, 1.0), (5002, None, 0.0, 0.0, 1.0, 1.0)]
    monkeypatch.setattr(graph, "components", lambda links: seen.append(links.count()) or own(links))
    got = {r.box_id: r.cluster for r in graph.clusters(spark.createDataFrame(rows, "box_id long, name string, x0 double, z0 double, x1 double, z1 double"), 100).collect()}
    near = lambda a, b: math.hypot(max(0, a[2] - b[4], b[2] - a[4]), max(0, a[3] - b[5], b[3] - a[5])) < 100
    want = {}
    for r in rows:
        if r[0] not in want:
            want[r[0]], todo = r[0], [r]
            while todo and None not in r:
                b = todo.pop()
                for q in rows:
                    if q[0] not in want and None not in q and q[1] == b[1] and near(q, b):
                        want[q[0]] = r[0]
                        todo.append(q)
    assert got == want and len(set(want.values())) > 50 and sum(seen) < 2_000


def test_tiles_of_few_files_are_made_by_all_cores(spark):
    df = QUERIES["sql_tile_cover"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {SPREAD * spark.sparkContext.defaultParallelism}" in plan and df.count() > 0


def parts(spark, folder, rows):
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    return QUERIES["name_similarity"](spark, str(folder))


def test_pairs_of_equal_names_are_scored_once(spark, tmp_path, monkeypatch):
    n, names, calls = 1200, ["red bolt", "Red gear", "old red plate"], spark.sparkContext.accumulator(0)

    def share(x, y):
        calls.add(1)
        return len([w for w in x if w in y]) / len(x) if len(x) <= len(y) else len([w for w in y if w in x]) / len(y)

    monkeypatch.setattr(text, "similarity", F.udf(share, "double"))
    found = parts(spark, tmp_path, [(k, names[k % 3], "B", 1) for k in range(n)]).agg(F.count("similarity").alias("n"), F.sum("similarity").alias("s")).first()
    m = n // 3  # each other pair shares one word of two
    assert found.n == n * (n - 1) // 2 and found.s == 3 * m * (m - 1) / 2 + 3 * m * m / 2 and 0 < calls.value < 1000


def test_scored_pairs_over_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK", 7)
    rng, names = random.Random(15), ["red bolt", "bolt red", "red red bolt", "bolt bolt red", "", None, "é bolt", "a b c d"]
    rows = [(k * 3 - 50, rng.choice(names), rng.choice(["B", "B", "C", None]), rng.choice([1, 1, 2, None])) for k in range(150)] + [(None, "red bolt", "B", 1)]
    got = sorted((r.a, r.b, -1.0 if r.similarity is None else r.similarity) for r in parts(spark, tmp_path, rows).collect())
    t = spark.read.parquet(f"{tmp_path}/part.parquet").select("p_partkey", "p_brand", "p_size", text.name_tokens(F.col("p_name")).alias("w"))
    l, r = t.select(F.col("p_partkey").alias("a"), "p_brand", "p_size", F.col("w").alias("x")), t.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("w").alias("y"))
    plain = l.join(r, ["p_brand", "p_size"]).where("a < b").select("a", "b", F.round(text.similarity(F.col("x"), F.col("y")), 6).alias("s"))
    assert got == sorted((p.a, p.b, -1.0 if p.s is None else p.s) for p in plain.collect()) and len(got) > 1000


def overlap(a, b):
    side = lambda i, j: max(0.0, min(a[j], b[j]) - max(a[i], b[i]))
    both, area = side(0, 2) * side(1, 3), lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - both
    return both / union if union > 0 else 0.0


def boxes_of(spark, rows):
    return spark.createDataFrame([(i, None if b is None else tuple(b)) for i, b in rows], "id long, box struct<x0: double, y0: double, x1: double, y1: double>")


def best_overlaps(left, right, reach, least):
    """l_id, r_id, iou by all pairs."""
    out = []
    for i, a in left:
        found = [(-overlap(a, b), j) for j, b in right if a and b and math.dist(((a[0] + a[2]) / 2, (a[1] + a[3]) / 2), ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)) <= reach]
        best = min((f for f in found if -f[0] >= least), default=None)
        out.append((i, best[1] if best else None, -best[0] if best else None))
    return sorted(out)


@pytest.mark.parametrize("reach,least", [(30.0, 0.2), (30.0, 0.0), (500.0, 0.6), (3.0, 0.2)])
def test_best_overlap_by_all_pairs(spark, reach, least):
    rng = random.Random(int(reach) + int(least * 10))

    def box(spread, sizes):
        x, y = rng.uniform(-spread, spread), rng.uniform(-spread, spread)
        return x, y, x + rng.choice(sizes), y + rng.choice(sizes)

    def side(first):
        near = [box(20, (10, 20, 40)) for _ in range(150)] + [tuple(map(float, map(round, box(60, (8, 12))))) for _ in range(120)] + [box(900, (5, 60, 300)) for _ in range(60)]
        near += [(5.0, 5.0, 15.0, 15.0)] * 20 + [(7.0, 7.0, 7.0, 9.0), (9.0, 9.0, 4.0, 3.0), None]
        return [(first + i, b) for i, b in enumerate(near)]

    left, right = side(0), side(1000)
    got = joins.best_overlap(boxes_of(spark, left), boxes_of(spark, right), reach, least)
    assert sorted((r.l_id, r.r_id, r.iou) for r in got.collect()) == best_overlaps(left, right, reach, least)


def test_best_overlap_does_not_try_all_pairs(spark, monkeypatch):
    from cartolith.functions import geometry

    rng, tried, own = random.Random(26), spark.sparkContext.accumulator(0), geometry.bbox_iou
    count = F.udf(lambda x: tried.add(1) or 0.0, "double")
    monkeypatch.setattr(geometry, "bbox_iou", lambda a, b: own(a, b) + count(a["x0"] + b["x0"]))
    side = lambda first: [(first + i, (x, y, x + rng.choice((30, 35, 40)), y + rng.choice((25, 30)))) for i, (x, y) in enumerate((rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(1500))]
    left, right = side(0), side(10_000)
    got = joins.best_overlap(boxes_of(spark, left), boxes_of(spark, right), 60.0, 0.2).collect()
    assert sorted((r.l_id, r.r_id, r.iou) for r in got) == best_overlaps(left, right, 60.0, 0.2) and 0 < tried.value < 250_000


@pytest.mark.parametrize("listed", [(3, 3), (16, 4096)])
def test_crowded_pairs_by_all_pairs(spark, monkeypatch, listed):
    monkeypatch.setattr(joins, "LISTED", listed)
    rng = random.Random(33)
    side = lambda first, n: [(first + i, rng.choice([rng.uniform(-90, 90), 20.0, rng.uniform(0, 9)]), rng.choice([rng.uniform(-90, 90), -40.0]), rng.choice("ab")) for i in range(n)] + [(first + 900, None, 1.0, "a"), (first + 901, 20.0, None, "a")]
    left, right = side(0, 150), side(1000, 190)
    frames = [spark.createDataFrame(rows, "id long, x double, z double, c string") for rows in (left, right)]
    want = sorted((a[0], b[0], a[3] + b[3], (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) for a in left for b in right if None not in a + b and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 400)
    got = sorted((r.l_id, r.r_id, r.l_c + r.r_c, r.d2) for r in joins.crowded_pairs(*frames, 20).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and len(got) > 1000 and all(math.isclose(g[3], w[3]) for g, w in zip(got, want))
    assert joins.crowded_pairs(frames[0].where("false"), frames[1], 20).count() == 0


def test_pairs_of_boxes_come_from_lists(spark):
    """The join makes a row for two lists, not for two boxes."""
    plan = QUERIES["bbox_iou"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin [_cx")]
    assert "Generate explode(_l" in above and "Generate explode(_r" in above


def test_rounded_as_round(spark):
    from cartolith.functions import geometry

    rng = random.Random(7)
    values = [rng.random() * 10 ** rng.randrange(-7, 3) for _ in range(3000)] + [k / 10**6 + s * 5e-7 for k in rng.sample(range(10**6), 2000) for s in (-1, 0, 1)] + [float(f"0.{k:06d}5") for k in rng.sample(range(10**6), 2000)] + [0.0, -0.0, 1.0, 0.2, -0.1234565, float("nan"), float("inf")]
    d = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select(F.round("v", 6).alias("a"), geometry.rounded(F.col("v"), 6).alias("b"))
    assert d.where("not (a <=> b)").count() == 0
