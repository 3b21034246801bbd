"""Blocked joins: pairs within a distance, best matches, nearest numbers, containment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(v: Column | str, size: float) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / F.lit(float(size))).cast("long")


def blocked_pairs(left: DataFrame, right: DataFrame, radius: float, on: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows within radius of each other; both sides have x and z, their columns come as l_* and r_*.

    Cells are as wide as the radius. The left side is dealt to its nine neighbour cells, so the join is an
    equi-join on the cell (and on further columns) with the distance as a residual; put the smaller
    side left. It is sent to every task only if it is counted to be small: the size of its files says little of nine times its rows."""
    from cartolith.plans.tables import SENT

    l = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    l = l.withColumn("_n", F.explode(near)).withColumn("_cx", cell("l_x", radius) + F.col("_n.dx")).withColumn("_cz", cell("l_z", radius) + F.col("_n.dz")).drop("_n")
    r = r.withColumn("_cx", cell("r_x", radius)).withColumn("_cz", cell("r_z", radius))
    for c in on:
        l, r = l.withColumn(f"_{c}", F.col(f"l_{c}")), r.withColumn(f"_{c}", F.col(f"r_{c}"))
    dx, dz = F.col("l_x") - F.col("r_x"), F.col("l_z") - F.col("r_z")
    keys = ["_cx", "_cz", *[f"_{c}" for c in on]]
    l = l.hint("broadcast" if left.limit(SENT // 9 + 1).count() <= SENT // 9 else "shuffle_merge")
    return l.join(r, keys).drop(*keys).withColumn("d2", dx * dx + dz * dz).where(F.col("d2") <= float(radius) ** 2)


#: rows of a left and of a right list in crowded_pairs(): all pairs of two lists wait in memory until they are read
LISTED = (16, 4096)


def crowded_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """The pairs of blocked_pairs(), for rows that have many: lists of the rows of a cell meet, and loops over two lists make the pairs.

    A cell has as many lists as keep each to about LISTED rows. One right list meets the left lists of nine cells in a task, one after the other, so its memory does
    not grow with a crowd; no row is copied for each of its pairs, and pairs that lie too far apart are never made. All pairs are returned: they grow with the square of the density."""
    from cartolith.plans.tables import SPREAD, sent

    keys = ["_cx", "_cz"]
    at = lambda d: d.where("x is not null and z is not null").withColumn("_cx", cell("x", radius)).withColumn("_cz", cell("z", radius))
    parts = lambda d, rows: sent(at(d).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_k")), "pair-lists")
    lists = lambda d, k: at(d).join(k, keys).withColumn("_i", F.pmod(F.xxhash64(*d.columns), "_k")).groupBy(*keys, "_i").agg(F.collect_list(F.struct(*d.columns)).alias("_rows"))
    near = F.array(*[F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cz") + j).alias("_cz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    k = parts(right, LISTED[1])
    l = lists(left, parts(left, LISTED[0])).select(F.col("_rows").alias("_l"), F.explode(near).alias("_n")).select("_l", "_n.*")
    l = l.join(k, keys).select("_l", *keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)).alias("_i"))
    # few bytes become many pairs: a fixed number of tasks, which are not merged by their size
    n, of = SPREAD * left.sparkSession.sparkContext.defaultParallelism, lambda d, s: [F.col(f"_{s}.{c}").alias(f"{s}_{c}") for c in d.columns]
    met = l.repartition(n, *keys, "_i").join(lists(right, k).withColumnRenamed("_rows", "_r").repartition(n, *keys, "_i").hint("shuffle_merge"), [*keys, "_i"])
    pairs = met.select("_r", F.explode("_l").alias("_l")).select("_r", *of(left, "l")).select(*[f"l_{c}" for c in left.columns], F.explode("_r").alias("_r"))
    pairs = pairs.select(*[f"l_{c}" for c in left.columns], *of(right, "r"))
    dx, dz = F.col("l_x") - F.col("r_x"), F.col("l_z") - F.col("r_z")
    return pairs.withColumn("d2", dx * dx + dz * dz).where(F.col("d2") <= float(radius) ** 2)


def best_match(pairs: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first by order."""
    columns = pairs.columns
    return pairs.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_b")).select("_b.*")


def one_to_one(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Matching in which each side is used once: in every turn, pairs that are best for both sides are
    taken and their rows leave, until none is left. Pairs are ordered by score (higher first), left, right; the result is that of
    taking pairs greedily in this order. The best pair of all is taken in each turn, so the turns end."""
    from cartolith.plans.tables import discard, materialise

    order = F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r"))
    rest, taken = materialise(pairs.withColumn("_o", order), "one-rest"), None
    while True:
        by_left = rest.groupBy(left).agg(F.min("_o").alias("_o"))
        by_right = rest.groupBy(right).agg(F.min("_o").alias("_o"))
        mutual = rest.join(by_left, [left, "_o"], "left_semi").join(by_right, [right, "_o"], "left_semi")
        mutual = materialise(mutual, "one-taken")
        taken = mutual if taken is None else taken.unionByName(mutual)
        old, rest = rest, materialise(rest.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti"), "one-rest")
        discard(old)
        if not rest.limit(1).count():
            return taken.drop("_o")


def one_to_one_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float) -> DataFrame:
    """left_id, right_id, d2: one_to_one() of all pairs within radius, the nearer first; both sides have x and z, ids are unique.

    The radius doubles from one whose cells hold few rows of a side. Who is matched within the smaller one leaves, and the nearest pairs first is the
    order of one_to_one(), so pairs are only made of rows that found nobody nearer, not of all rows within the radius."""
    from cartolith.plans.tables import discard, materialise

    side = lambda d, key: materialise(d.where("x is not null and z is not null").select(key, "x", "z"), "one-side")
    l, r = side(left, left_id), side(right, right_id)
    out = None
    for half in range(halvings(r, radius, FEW), -1, -1):
        near = float(radius) / 2**half
        small, large = (l, r) if l.count() <= r.count() else (r, l)
        pairs = blocked_pairs(small, large, near)
        ids = [F.col(f"{'l' if c in small.columns else 'r'}_{c}").alias(c) for c in (left_id, right_id)]
        found = materialise(one_to_one(pairs.select(*ids, "d2", (-F.col("d2")).alias("score")), left_id, right_id, "score").drop("score"), "one-found")
        out = found if out is None else out.unionByName(found)
        if half:
            old, l = l, materialise(l.join(found.select(left_id), left_id, "left_anti"), "one-side")
            discard(old)
            old, r = r, materialise(r.join(found.select(right_id), right_id, "left_anti"), "one-side")
            discard(old)
    return out


def contained(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Points with the first box (by its box_id) that holds them; boxes: box_id, x0, z0, x1, z1 (half open).

    Boxes are dealt to the cells they touch."""
    cells = boxes.withColumn("_cx", F.explode(F.sequence(cell("x0", size), cell("x1", size)))).withColumn("_cz", F.explode(F.sequence(cell("z0", size), cell("z1", size))))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("z") >= F.col("z0")) & (F.col("z") < F.col("z1"))
    p = points.withColumn("_cx", cell("x", size)).withColumn("_cz", cell("z", size))
    hit = p.join(cells, ["_cx", "_cz"]).where(inside)
    return hit.groupBy(*points.columns).agg(F.min("box_id").alias("box_id"))


def nearest_number(wanted: DataFrame, known: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """For each wanted (key, number) the known number of the key with the smallest gap (half a point more if one
    is odd and the other even), at most ``most``; ties go to the smaller number."""
    from cartolith.plans.tables import sent

    k = known.select(*key, F.col("number").alias("found")).distinct()
    gap = F.abs(F.col("number") - F.col("found")) + F.when(F.col("number") % 2 == F.col("found") % 2, 0.0).otherwise(0.5)
    asked = wanted.select(*key, "number").distinct()
    pairs = asked.join(k, key).withColumn("gap", gap).where(F.col("gap") <= most)
    best = pairs.groupBy(*key, "number").agg(F.min(F.struct("gap", "found")).alias("b"))
    # each number of a key is answered once; rows only meet their answer
    return wanted.distinct().join(sent(best, "numbers"), [*key, "number"]).select(*wanted.columns, "b.found", "b.gap")


#: right rows of a cell that the first turn of first_within reads; each further turn ends at so many times as many
FIRST, TURN = 8, 4


def first_within(left: DataFrame, right: DataFrame, on: str, left_id: str, right_id: str, radius: float, fits: Column | None = None) -> DataFrame:
    """left_id, right_id: for each left row the smallest id of the right rows of its ``on`` within radius that fit; both sides have ``on``, x and z, and
    fits reads the right one's columns as r_*.

    Right rows are dealt to the nine cells around them and ranked by id in each; a left row reads its cell's ranks by turns and is done with the first
    turn that has a match, so frequent values of ``on`` cost a few candidates a row instead of all pairs. Only rows without any match read a
    whole cell. Every turn is a join on equal keys and one aggregation."""
    from cartolith.plans.tables import discard, materialise, sent

    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = right.groupBy([c for c in right.columns if c != right_id]).agg(F.min(right_id).alias(right_id))
    r = r.select([F.col(c).alias(f"r_{c}") for c in right.columns]).where(f"r_{on} is not null and r_x is not null and r_z is not null").withColumn("_n", F.explode(near))
    r = r.withColumn("_cx", cell("r_x", radius) + F.col("_n.dx")).withColumn("_cz", cell("r_z", radius) + F.col("_n.dz")).drop("_n").withColumnRenamed(f"r_{on}", on)
    keys = [on, "_cx", "_cz"]
    r = materialise(r.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(f"r_{right_id}"))), "first-right")
    rest = left.where(f"{on} is not null and x is not null and z is not null").withColumn("_cx", cell("x", radius)).withColumn("_cz", cell("z", radius))
    rest = materialise(rest.withColumn("_row", F.monotonically_increasing_id()), "first-left")
    met = F.hypot(F.col("x") - F.col("r_x"), F.col("z") - F.col("r_z")) <= float(radius)
    done, read, out = 0, FIRST, None
    while True:
        now = sent(r.where((F.col("_rank") > done) & (F.col("_rank") <= read)), "first-turn")
        pairs = rest.join(now, keys).where(met if fits is None else met & fits)
        hits = materialise(pairs.groupBy("_row", left_id).agg(F.min(f"r_{right_id}").alias(right_id)), "first-hits")
        out = hits if out is None else out.unionByName(hits)
        more = sent(r.where(F.col("_rank") == read + 1).select(keys), "first-more")
        old, rest = rest, materialise(rest.join(hits.select("_row"), "_row", "left_anti").join(more, keys, "left_semi"), "first-left")
        discard(old)
        if not rest.limit(1).count():
            return out.groupBy(left_id).agg(F.min(right_id).alias(right_id))
        done, read = read, read * TURN


#: right rows of a cell in the first turn of nearest_within and of one_to_one_within, at most; and how often the radius is halved for that
CROWD, FEW, HALVES = 32, 8, 16


def halvings(places: DataFrame, radius: float, most: int) -> int:
    """How often radius is halved until a cell as wide holds at most so many places (x, z)."""
    for halves in range(HALVES):
        wide = float(radius) / 2**halves
        if (places.groupBy(F.floor(F.col("x") / wide), F.floor(F.col("z") / wide)).count().agg(F.max("count")).first()[0] or 0) <= most:
            return halves
    return HALVES


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius: float) -> DataFrame:
    """left_id, right_id, d2: for each left row the nearest right row within radius, the smallest id of equals; both sides have x and z.

    The radius is halved until cells as wide hold few places of the right side, and doubled in each turn for the left rows that have found nothing: the
    nearest row within a smaller radius is the nearest of all. A row so meets a few candidates however dense the right side is."""
    from cartolith.plans.tables import discard, materialise, sent

    places = materialise(right.where("x is not null and z is not null").groupBy("x", "z").agg(F.min(right_id).alias(right_id)), "nearest-places")
    many = places.count()
    halves = halvings(places, radius, CROWD)
    rest = materialise(left.where("x is not null and z is not null").select(left_id, "x", "z").withColumn("_row", F.monotonically_increasing_id()), "nearest-left")
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dx, dz, out = F.col("x") - F.col("r_x"), F.col("z") - F.col("r_z"), None
    for half in range(halves, -1, -1):
        r = float(radius) / 2**half
        at = lambda d, x, z, r=r: d.withColumn("_cx", cell(x, r)).withColumn("_cz", cell(z, r))
        deal = lambda d: d.withColumn("n", F.explode(near)).withColumn("_cx", F.col("_cx") + F.col("n.dx")).withColumn("_cz", F.col("_cz") + F.col("n.dz")).drop("n")
        l, p = at(rest, "x", "z"), at(places.withColumnsRenamed({"x": "r_x", "z": "r_z"}), "r_x", "r_z")
        # the side of fewer rows is dealt to the neighbours
        l, p = (deal(l), p.hint("shuffle_merge")) if rest.count() < many else (l, sent(deal(p), "nearest-dealt"))
        pairs = l.join(p, ["_cx", "_cz"]).withColumn("d2", dx * dx + dz * dz).where(F.col("d2") <= r**2)
        hits = materialise(pairs.groupBy("_row", left_id).agg(F.min(F.struct("d2", right_id)).alias("b")), "nearest-hits")
        out = hits if out is None else out.unionByName(hits)
        if half:
            old, rest = rest, materialise(rest.join(hits.select("_row"), "_row", "left_anti"), "nearest-left")
            discard(old)
    return out.groupBy(left_id).agg(F.min("b").alias("b")).select(left_id, f"b.{right_id}", "b.d2")


def holds_all(rows: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """Relational division: keys that have every wanted value. The count of wanted is one number."""
    n = wanted.select(value).distinct().count()
    return rows.select(key, value).distinct().join(wanted.select(value).distinct(), value).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select(key)


def first_wins(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: rows of a group that scored_pairs() deals to one block, on the mean
BLOCK = 1024


def scored_pairs(rows: DataFrame, key: str, on: list[str], value: str, read: Callable[[Column], Column], score: Callable[[Column, Column], Column]) -> DataFrame:
    """a, b, score: all pairs of keys (a < b) of rows that are equal in ``on``, with score(read(value of a), read(value of b)).

    A value is read once a block, and a pair of values scored once a pair of blocks; only then are their rows paired, so a pair of rows costs a loop over two
    lists of keys. Large groups are dealt to blocks by their keys, which should be unique; two blocks meet in one task, so its memory does not grow with
    the group. All pairs are returned: they grow with the square of a group."""
    from cartolith.plans.tables import SPREAD, materialise, sent

    blocks = sent(rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_k")), "pair-blocks")
    dealt = rows.join(blocks, on).withColumn("_i", F.expr(f"pmod(xxhash64({key}), _k)"))
    lists = dealt.groupBy(*on, "_k", "_i", value).agg(F.collect_list(key).alias("_keys"))
    lists = materialise(lists.select(*on, "_k", "_i", read(F.col(value)).alias("_v"), "_keys", F.array_min("_keys").alias("_lo"), F.array_max("_keys").alias("_hi")), "pair-lists")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    # few bytes become many pairs: a fixed number of tasks, which are not merged by their size
    meet, n = [*on, "_i", "_j"], SPREAD * rows.sparkSession.sparkContext.defaultParallelism
    l = lists.select(*on, "_i", every.alias("_j"), F.col("_v").alias("_x"), F.col("_keys").alias("_a"), "_lo").repartition(n, *meet)
    r = lists.select(*on, every.alias("_i"), F.col("_i").alias("_j"), F.col("_v").alias("_y"), F.col("_keys").alias("_b"), "_hi").repartition(n, *meet)
    met = l.join(r.hint("shuffle_merge"), meet).where("_lo < _hi").select("_a", "_b", score(F.col("_x"), F.col("_y")).alias("score"))
    return met.select(F.explode("_a").alias("a"), "_b", "score").select("a", F.explode("_b").alias("b"), "score").where("a < b")


#: right boxes that share a cell in the first turn of best_overlap, at most on the mean; cells that a left box meets in the second, on the mean and at most
SHARE, COPIES, COPIES_MOST = 64, 9, 1024


def best_overlap(left: DataFrame, right: DataFrame, reach: float, least: float) -> DataFrame:
    """l_id, r_id, iou: each left box with the right box of the greatest overlap (then the smallest id) whose centre lies within reach; null where
    none overlaps by least. Both sides: id, box (struct of x0, y0, x1, y1).

    The boxes of a small cell give each left box an overlap that its best one reaches. Where boxes of width w overlap by a share s of their union, their
    centres lie at most w * (1 - s) / (2 * s) apart, whatever the other's width, and so with their heights. The left box then meets the cells so near, which are
    as small as leaves it few of them, and only pairs that overlap as much are sorted for the best."""
    from cartolith.functions.geometry import bbox_iou
    from cartolith.plans.tables import materialise

    corners, reach = ("x0", "y0", "x1", "y1"), float(reach)
    of = lambda side: {c: F.col(f"{side}_{c}") for c in corners}
    flat = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), *[F.col(f"box.{c}").alias(f"{side}_{c}") for c in corners])
    centred = lambda d, s: d.withColumn(f"{s}_x", (F.col(f"{s}_x0") + F.col(f"{s}_x1")) / 2).withColumn(f"{s}_z", (F.col(f"{s}_y0") + F.col(f"{s}_y1")) / 2).where(f"{s}_x is not null and {s}_z is not null")
    at = lambda d, side, wide: d.withColumn("_cx", cell(f"{side}_x", wide)).withColumn("_cz", cell(f"{side}_z", wide))
    keys, dx, dz = ["_cx", "_cz"], F.col("l_x") - F.col("r_x"), F.col("l_z") - F.col("r_z")
    met, iou = dx * dx + dz * dz <= reach**2, bbox_iou(of("l"), of("r"))

    r = materialise(centred(flat(right, "r").groupBy(*of("r").values()).agg(F.min("r_id").alias("r_id")), "r"), "overlap-right")
    for halves in range(HALVES + 1):
        wide = reach / 2**halves
        if (at(r, "r", wide).groupBy(*keys).count().agg(F.sum(F.col("count") * F.col("count")) / F.sum("count")).first()[0] or 0) <= SHARE:
            break
    pairs = at(centred(flat(left, "l"), "l"), "l", wide).join(at(r, "r", wide).hint("shuffle_merge"), keys, "left")
    l = centred(pairs.groupBy("l_id", *of("l").values()).agg(F.greatest(F.lit(float(least)), F.max(F.when(met, iou))).alias("_least")), "l")

    def far(c, lo, hi):
        side, share = F.col(f"l_{hi}") - F.col(f"l_{lo}"), F.col("_least")
        # beyond the bound by more than doubles are rounded
        bound = F.greatest(F.lit(0.0), side) * (1 - share) / (2 * share) + (F.abs(c) + F.abs(side)) * 1e-9
        return F.when(share > 0, F.least(F.lit(reach), bound)).otherwise(reach)

    l = materialise(l.withColumn("_fx", far("l_x", "x0", "x1")).withColumn("_fz", far("l_z", "y0", "y1")), "overlap-left")
    copies = [(1 + 2 * F.col("_fx") * 2**k / reach) * (1 + 2 * F.col("_fz") * 2**k / reach) for k in range(HALVES + 1)]
    fits = l.agg(*[((F.avg(c) <= COPIES) & (F.max(c) <= COPIES_MOST)) for c in copies]).first()
    wide = reach / 2 ** max([0, *[k for k, fit in enumerate(fits) if fit]])
    cells = lambda c, by: F.explode(F.sequence(cell(F.col(c) - F.col(by), wide), cell(F.col(c) + F.col(by), wide)))
    l = l.withColumn("_cx", cells("l_x", "_fx")).withColumn("_cz", cells("l_z", "_fz"))
    pairs = l.join(at(r, "r", wide).hint("shuffle_merge"), keys).where(met).withColumn("iou", iou).where(F.col("iou") >= F.col("_least"))
    best = pairs.groupBy("l_id").agg(F.min(F.struct((-F.col("iou")).alias("o"), F.col("r_id"))).alias("b")).select("l_id", "b.r_id", (-F.col("b.o")).alias("iou"))
    return left.select(F.col("id").alias("l_id")).join(best, "l_id", "left")
