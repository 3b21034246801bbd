"""Rings of relations from their ways, without a group in one task.

Ways are links between end points. Where every point of a relation's role ends two ways, each way runs on into one other, in both directions,
and the runs are cycles: a direction of a way is a dart, each dart knows the next. Darts of BLOCK ways that follow each other among the members meet in one task, which
joins those that run on within the block to chains; chains then know the next chain, and pointer doubling finds in log2(chains) rounds the first
way of their cycle and how far away that is, which orders the ring. Members in order leave a few chains a block; in any other order the result is the same and the rounds
are as many as the ways ask for. A relation leaves the rounds as soon as they cover its chains. A point where an odd number
of ways end leaves its relation open. What hangs together with points of four or more ends is walked in the order of the members, the one step that
takes a relation's ways at once, as pairs of ends without their lines.

Rings lie on the first exterior of their relation, in the order of its members, that holds their first point; that is counted by the
parity of crossings, over bins of edges.
"""

from __future__ import annotations

from collections import deque
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.functions import geometry
from cartolith.operators.containment import binned_boxes, in_box, parity
from cartolith.plans.tables import discard, materialise

KEY = ["relation_id", "role"]
#: ways of a block, as a power of two
BLOCK = 13
_WALK = "relation_id long, role string, lead int, seq int, pos int, reversed boolean"
#: what may be wrong with a relation, the gravest first
PROBLEMS = ("no ways", "missing way", "short outer way", "short inner way", "open outer ring", "short outer ring", "open inner ring", "short inner ring", "no outer ring", "hole outside")


def _problem(name: str) -> Column:
    return F.lit(PROBLEMS.index(name))


def _of_role(kind: str) -> Column:
    return F.when(F.col("role") == "outer", _problem(f"{kind[0]} outer {kind[1]}")).otherwise(_problem(f"{kind[0]} inner {kind[1]}"))


def walked(ends: list[tuple]) -> list[list[tuple[int, bool]]] | None:
    """Closed walks over (head, tail) pairs as lists of (index, reversed): each starts at the first pair left and goes on with the
    first one that has an end where it stands. None if a walk cannot close."""
    at: dict = {}
    for i, (head, tail) in enumerate(ends):
        for point in {head, tail}:
            at.setdefault(point, deque()).append(i)
    used, walks = [False] * len(ends), []
    for first, (start, here) in enumerate(ends):
        if used[first]:
            continue
        used[first], walk = True, [(first, False)]
        while here != start:
            waiting = at[here]
            while waiting and used[waiting[0]]:
                waiting.popleft()
            if not waiting:
                return None
            i = waiting.popleft()
            used[i], back = True, ends[i][0] != here
            walk.append((i, back))
            here = ends[i][0] if back else ends[i][1]
        walks.append(walk)
    return walks


def _walk(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("pos")
    pos = part.pos.tolist()
    walks = walked(list(zip(zip(part.hx, part.hy), zip(part.tx, part.ty)))) or []
    rows = [(part.relation_id.iloc[0], part.role.iloc[0], pos[walk[0][0]], seq, pos[i], back) for walk in walks for seq, (i, back) in enumerate(walk)]
    return pd.DataFrame(rows, columns=["relation_id", "role", "lead", "seq", "pos", "reversed"])


def _chains(block: pa.Table) -> pa.Table:
    """The darts of a block with the head of their chain and their place on it; a head's row has the chain's exit (the next dart, its own in a cycle), steps, least dart and the place of that."""
    block = block.sort_by("dart")
    dart, nxt = block.column("dart").to_numpy(), block.column("nxt").to_numpy()
    at = np.minimum(np.searchsorted(dart, nxt), len(dart) - 1)
    within = dart[at] == nxt
    after, first = np.where(within, at, -1).tolist(), np.ones(len(dart), bool)
    first[at[within]] = False
    head, place, heads = [-1] * len(after), [0] * len(after), []
    for h in chain(np.flatnonzero(first).tolist(), range(len(after))):
        if head[h] >= 0:
            continue
        i, steps, low = h, 0, h
        while i >= 0 and head[i] < 0:
            head[i], place[i], low = h, steps, min(low, i)
            last, i, steps = i, after[i], steps + 1
        heads.append((h, nxt[last] if i < 0 else dart[h], steps, dart[low], place[low]))
    out = {"exit": None, "steps": None, "low": None, "at": None}
    rows, *found = (np.array(v, np.int64) for v in zip(*heads))
    others = np.ones(len(after), bool)
    others[rows] = False
    for name, values in zip(out, found):
        out[name] = np.zeros(len(after), np.int64)
        out[name][rows] = values
    cells = [pa.array(v, pa.int64(), mask=others) for v in out.values()]
    return pa.table([*(block.column(k) for k in KEY), pa.array(dart), pa.array(dart[np.array(head)]), pa.array(np.array(place, np.int64)), *cells], names=[*KEY, "dart", "head", "place", *out])


def _cycles(darts: DataFrame) -> DataFrame | None:
    """relation_id, role, lead, seq, pos, reversed of the ways whose darts (relation_id, role, dart, nxt) run in cycles.

    low is the least dart on the next ``span`` chains and at the ways to it, over as many ways as steps; links: the chains of a relation's role."""
    schema = T.StructType([*(darts.schema[k] for k in KEY), *(T.StructField(c, T.LongType()) for c in ("dart", "head", "place", "exit", "steps", "low", "at"))])
    block = F.shiftright("dart", BLOCK + 1).alias("block")
    placed = materialise(darts.select(*KEY, "dart", "nxt").groupBy(*KEY, block).applyInArrow(_chains, schema), "ring-chains")
    heads = placed.where("exit is not null")
    links = heads.groupBy(*KEY).agg(F.count(F.lit(1)).alias("links"))
    span, done = 1, []
    now = materialise(heads.join(links, KEY).select(*KEY, "links", "head", F.col("exit").alias("nxt"), "low", "at", "steps", F.col("steps").alias("own")), "ring-darts")
    while now.limit(1).count():
        done.append(materialise(now.where(F.col("links") <= span).select(*KEY, "head", "low", "at", "own"), "ring-cycles"))
        later = now.select(*KEY, F.col("head").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"))
        ahead = now.where(F.col("links") > span).join(later, [*KEY, "nxt"])
        nearer = F.col("low") <= F.col("low2")
        ahead = ahead.select(
            *KEY, "links", "head", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), F.when(nearer, F.col("at")).otherwise(F.col("at2") + F.col("steps")).alias("at"),
            (F.col("steps") + F.col("steps2")).alias("steps"), "own",
        )
        old, now = now, materialise(ahead, "ring-darts")
        discard(old)
        span *= 2
    if not done:
        return None
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    # both directions of a ring are cycles: the one that runs its first way forwards stays
    found = found.where("low % 2 = 0")
    sizes = found.groupBy(*KEY, "low").agg(F.sum("own").alias("n"))
    found = materialise(found.join(sizes, [*KEY, "low"]).select(*KEY, "head", "low", "at", "n"), "ring-heads")
    seq = F.pmod(F.col("place") - F.col("at"), F.col("n")).cast("int")
    whole = lambda c: F.shiftright(c, 1)
    met = placed.select(*KEY, "dart", "head", "place").join(found, [*KEY, "head"])
    return met.select(*KEY, whole("low").cast("int").alias("lead"), seq.alias("seq"), whole("dart").cast("int").alias("pos"), (F.col("dart") % 2 == 1).alias("reversed"))


def chained(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rings of ways (relation_id, role, pos, hx, hy, tx, ty), and (relation_id, role) of what stays open.

    A ring is named by lead, its first way's pos; seq is the place of a way on it, reversed whether it runs from tail to head there."""
    # an end is twice its way's pos, and one more at the tail
    spot = lambda side, x, y: F.struct((F.col("pos").cast("long") * 2 + side).alias("end"), F.col(x).alias("x"), F.col(y).alias("y"))
    spots = ends.select(*KEY, F.explode(F.array(spot(0, "hx", "hy"), spot(1, "tx", "ty"))).alias("e")).select(*KEY, "e.*")
    points = materialise(spots.groupBy(*KEY, "x", "y").agg(F.count(F.lit(1)).alias("ends"), F.min("end").alias("a"), F.max("end").alias("b")), "ring-points")
    odd = materialise(points.where("ends % 2 = 1").select(*KEY).distinct(), "ring-open")
    sound = points.where("ends = 2").join(odd, KEY, "left_anti")
    # a dart leaves by the end that it does not enter by: forwards (even) by the tail
    pair = lambda out, into: F.struct(F.col(out).bitwiseXOR(F.lit(1)).alias("dart"), F.col(into).alias("nxt"))
    cycles = _cycles(sound.select(*KEY, F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("p")).select(*KEY, "p.*"))
    branching = ends.join(points.where("ends > 2").select(*KEY).distinct(), KEY, "left_semi").join(odd, KEY, "left_anti")
    if cycles is None:
        return branching.groupBy(*KEY).applyInPandas(_walk, _WALK), odd
    left = branching.join(cycles.select(*KEY, "pos"), [*KEY, "pos"], "left_anti")
    return cycles.unionByName(left.groupBy(*KEY).applyInPandas(_walk, _WALK)), odd


def _homes(rings: DataFrame, pieces: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, lead, polygon of the holes that an exterior holds; rings: one row a ring with its first point and, if outer, its polygon."""
    holes = rings.where("role = 'inner'").select("relation_id", F.col("lead").alias("hole"), "x", "z")
    outer = rings.where("role = 'outer'").join(holes.select("relation_id").distinct(), "relation_id", "left_semi").select("relation_id", "lead", F.struct("relation_id", "polygon").alias("polygon_id"))
    flat = pieces.where("role = 'outer'").join(outer, ["relation_id", "lead"]).join(lines.select("way_id", F.explode(geometry.edges(F.col("line"))).alias("e")), "way_id")
    edges = flat.select("polygon_id", F.lit(False).alias("hole"), F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by")).where("ax <> bx or ay <> by")
    edges = materialise(edges, "ring-edges")
    boxes = materialise(binned_boxes(edges), "ring-boxes")
    # a relation's extent is cut into about as many cells as it has exteriors
    extent = boxes.groupBy(F.col("polygon_id.relation_id").alias("relation_id")).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("int").alias("g"), *[f(c).alias(f"r_{c}") for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "y0"), (F.max, "y1"))])

    def at(v: str, axis: str) -> Column:
        wide = F.col(f"r_{axis}1") - F.col(f"r_{axis}0")
        place = F.when(wide > 0, F.floor((F.col(v) - F.col(f"r_{axis}0")) / wide * F.col("g"))).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.col("g") - 1, place)).cast("int")

    cells = boxes.withColumn("relation_id", F.col("polygon_id.relation_id")).join(extent, "relation_id")
    cells = cells.withColumn("cx", F.explode(F.sequence(at("x0", "x"), at("x1", "x")))).withColumn("cy", F.explode(F.sequence(at("y0", "y"), at("y1", "y"))))
    cells = cells.select("relation_id", "cx", "cy", *boxes.columns)
    p = holes.join(extent, "relation_id").select("relation_id", F.struct("relation_id", "hole").alias("id"), "x", "z", at("x", "x").alias("cx"), at("z", "y").alias("cy"))
    met = parity(p.join(cells, ["relation_id", "cx", "cy"]).where(in_box()), boxes, edges).where("odd")
    return met.groupBy("id").agg(F.min("polygon_id.polygon").alias("polygon")).select("id.relation_id", F.col("id.hole").alias("lead"), "polygon")


def relation_rings(members: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, polygon, ring, seq, way_id, reversed, problem: the ways of each ring in order, or one row with the relation's problem.

    members: relation_id, pos, role, way_id; lines: way_id, line. Polygons are numbered by their first member, ring 0 is the exterior and runs
    counter-clockwise, holes after it clockwise. A way that a role lists again is passed over, as are other roles; null roles are none. A relation
    without ways in either role, or with what PROBLEMS names, has no rings. Numbering sorts one narrow row a ring within a relation."""
    once = members.where(F.col("role").isin("outer", "inner")).groupBy(*KEY, "way_id").agg(F.min("pos").cast("int").alias("pos"))
    shape = lines.select("way_id", F.size("line").alias("n"), F.get("line", F.lit(0)).alias("h"), F.element_at(F.when(F.size("line") > 0, F.col("line")), -1).alias("t"), geometry.signed_area(F.col("line")).alias("area"))
    ends = once.join(shape, "way_id", "left").select(*KEY, "pos", "way_id", "n", "area", F.col("h.x").alias("hx"), F.col("h.y").alias("hy"), F.col("t.x").alias("tx"), F.col("t.y").alias("ty"))
    ends = materialise(ends, "ring-ends")
    bad = F.when(F.coalesce("n", F.lit(-1)) < 0, _problem("missing way")).when(F.col("n") < 2, _of_role(("short", "way")))
    none = members.select("relation_id").distinct().join(ends, "relation_id", "left_anti").select("relation_id", _problem("no ways").alias("code"))
    wrong = materialise(ends.groupBy("relation_id").agg(F.min(bad).alias("code")).where("code is not null").unionByName(none), "ring-wrong")
    sound = ends.join(wrong, "relation_id", "left_anti")
    chains, odd = chained(sound)
    pieces = materialise(chains.join(sound, [*KEY, "pos"]), "ring-pieces")
    signed = F.when(F.col("reversed"), -F.col("area")).otherwise(F.col("area"))
    first = lambda c: F.max(F.when(F.col("seq") == 0, F.col(c)))  # noqa: E731  # a ring's first way is never reversed
    rings = pieces.groupBy(*KEY, "lead").agg(F.sum(signed).alias("area"), F.count(F.lit(1)).cast("int").alias("ways"), F.sum(F.col("n") - 1).alias("points"), first("hx").alias("x"), first("hy").alias("z"))
    turn = F.coalesce(F.col("area") * F.when(F.col("role") == "outer", 1).otherwise(-1) < 0, F.lit(False))
    order = Window.partitionBy("relation_id", "role").orderBy("lead")
    rings = rings.select(*KEY, "lead", "ways", "points", turn.alias("turn"), "x", "z", F.when(F.col("role") == "outer", F.row_number().over(order) - 1).alias("polygon"))
    rings = materialise(rings, "rings")
    homes = materialise(_homes(rings, pieces, lines), "ring-homes")
    holes = rings.where("role = 'inner'").drop("polygon").join(homes, ["relation_id", "lead"], "left")
    number = F.row_number().over(Window.partitionBy("relation_id", "polygon").orderBy("lead"))
    placed = holes.where("polygon is not null").withColumn("ring", number).unionByName(rings.where("role = 'outer'").withColumn("ring", F.lit(0)))
    codes = (
        odd.select("relation_id", _of_role(("open", "ring")).alias("code"))
        .unionByName(rings.where("points < 3").select("relation_id", _of_role(("short", "ring")).alias("code")))
        .unionByName(holes.where("polygon is null").select("relation_id", _problem("hole outside").alias("code")))
        .unionByName(sound.groupBy("relation_id").agg(F.max("role").alias("role")).where("role = 'inner'").select("relation_id", _problem("no outer ring").alias("code")))
    )
    problems = materialise(wrong.unionByName(codes).groupBy("relation_id").agg(F.min("code").alias("code")), "ring-problems")
    out = pieces.join(placed.select(*KEY, "lead", "ways", "turn", "polygon", "ring"), [*KEY, "lead"]).join(problems, "relation_id", "left_anti")
    seq = F.when(F.col("turn"), F.col("ways") - 1 - F.col("seq")).otherwise(F.col("seq"))
    out = out.select("relation_id", "polygon", "ring", seq.alias("seq"), "way_id", (F.col("reversed") != F.col("turn")).alias("reversed"), F.lit(None).cast("string").alias("problem"))
    text = F.element_at(F.array(*[F.lit(p) for p in PROBLEMS]), F.col("code") + 1)
    return out.unionByName(problems.select("relation_id", text.alias("problem")), allowMissingColumns=True)
