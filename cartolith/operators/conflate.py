"""Conflation: candidates of different sources, rules by kind, serial matching, and merges by source priority."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.functions import geometry, names, text
from cartolith.plans.tables import discard, materialise, spread

from .graph import components
from .joins import cell, first_within
from .lines import close_lines

Rule = Callable[[Callable[[str], Column], Callable[[str], Column], Column], Column]


class Block(NamedTuple):
    """Pairs that a rule may accept: those of features that fit ``of``, with one ``key``, at most ``most`` apart, that ``pair`` allows; None: all."""

    of: Callable[[Callable[[str], Column]], Column] | None = None
    key: Callable[[Callable[[str], Column]], Column] | None = None
    most: float | None = None
    pair: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None


def candidates(features: DataFrame, width: float = 100, reach: int = 2, block: Block = Block()) -> DataFrame:
    """Pairs of features of one kind and of different sources whose cells of ``width`` lie at most ``reach`` apart, the smaller id
    left; features: id, kind, source, x, z and more, which come as l_* and r_*. d is their distance.

    Wide cells of reach + 1 small ones, or as wide as the block allows, are joined with their neighbours, so nine rows a feature find all pairs."""
    wide = width * (reach + 1) if block.most is None else min(block.most, width * (reach + 1))
    if block.of:
        features = features.where(block.of(F.col))
    l, r = (features.select([F.col(c).alias(f"{s}_{c}") for c in features.columns]) for s in "lr")
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    l = l.withColumn("_n", F.explode(near)).withColumn("_cx", cell("l_x", wide) + F.col("_n.dx")).withColumn("_cz", cell("l_z", wide) + F.col("_n.dz")).withColumn("_k", F.col("l_kind")).drop("_n")
    r = r.withColumn("_cx", cell("r_x", wide)).withColumn("_cz", cell("r_z", wide)).withColumn("_k", F.col("r_kind"))
    keys = ["_k", "_cx", "_cz"]
    if block.key:
        l, r, keys = l.withColumn("_key", block.key(lambda c: F.col(f"l_{c}"))), r.withColumn("_key", block.key(lambda c: F.col(f"r_{c}"))), [*keys, "_key"]
    # rows are dealt by cells: the nine copies of a side may not be sent to every task
    pairs = l.join(r.hint("shuffle_merge"), keys).drop(*keys)
    apart = lambda c: F.abs(cell(f"l_{c}", width) - cell(f"r_{c}", width)) <= reach
    pairs = pairs.where((F.col("l_id") < F.col("r_id")) & (F.col("l_source") != F.col("r_source")) & apart("x") & apart("z"))
    pairs = pairs.withColumn("d", F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_z") - F.col("r_z")))
    if block.most is not None:
        pairs = pairs.where(F.col("d") <= block.most)
    return pairs.where(block.pair(lambda c: F.col(f"l_{c}"), lambda c: F.col(f"r_{c}"))) if block.pair else pairs


def same_business(l, r, d: Column) -> Column:
    """Equal registry numbers; without any, equal names, evidence in the addresses, and 150 m."""
    none = l("siret").isNull() & r("siret").isNull()
    key = names.match_key(l("name"))
    alike = (key != "") & (key == names.match_key(r("name"))) & text.address_evidence(names.match_key(l("address")), names.match_key(r("address")))
    return F.when(l("siret").isNotNull() & r("siret").isNotNull(), l("siret") == r("siret")).otherwise(none & alike & (d <= 150))


def same_address(l, r, d: Column) -> Column:
    """Equal register ids; else equal names and 15 m."""
    known = l("register_id").isNotNull() & r("register_id").isNotNull()
    return F.when(known, l("register_id") == r("register_id")).otherwise((names.match_key(l("name")) == names.match_key(r("name"))) & (d <= 15))


def same_building(l, r, d: Column, iou: Column, least: float = 0.35, most: float = 20) -> Column:
    return (iou >= least) & (d <= most)


def same_road(l, r, far: Column, survey: str = "IGN BD TOPO", most: float = 4) -> Column:
    """Equal names, or classes that agree (track and path do), or one side of the survey; and lines at most 4 m apart."""
    n, a, b = names.match_key(l("name")), names.match_key(l("road_class")), names.match_key(r("road_class"))
    named = (n != "") & (n == names.match_key(r("name")))
    classed = (a != "") & (b != "") & ((a == b) | a.isin("track", "path") & b.isin("track", "path"))
    return (named | classed | (l("source") == survey) | (r("source") == survey)) & (far <= most)


def same_water(l, r, d: Column, iou: Column, far: Column) -> Column:
    """Both areas or both lines, of one type (all rivers are one); areas overlap by a quarter within 50 m, lines lie within 10 m."""
    a, b = names.match_key(l("water_type")), names.match_key(r("water_type"))
    typed = (a == "") | (b == "") | (a == b) | a.contains("river") & b.contains("river")
    return (l("area") == r("area")) & typed & F.when(l("area"), (iou >= 0.25) & (d <= 50)).otherwise(far <= 10)


#: for each rule of this module, disjoint blocks that together hold all pairs that it accepts
BLOCKS = {
    "business": (Block(lambda f: f("siret").isNotNull(), lambda f: f("siret")), Block(lambda f: f("siret").isNull() & (names.match_key(f("name")) != ""), lambda f: names.match_key(f("name")), 150)),
    "address": (
        Block(lambda f: f("register_id").isNotNull(), lambda f: f("register_id")),
        Block(None, lambda f: names.match_key(f("name")), 15, lambda l, r: l("register_id").isNull() | r("register_id").isNull()),
    ),
    "building": (Block(most=20),), "road": (Block(most=4),), "water": (Block(lambda f: f("area"), None, 50), Block(lambda f: ~f("area"), None, 10)),
}


def conflated(features: DataFrame, rules: dict[str, Rule], width: float = 100, reach: int = 2, blocks: dict[str, tuple[Block, ...]] | None = None) -> DataFrame:
    """(a, b): pairs of ids that the rule of their kind accepts; a kind without a rule has none.

    blocks: by kind, disjoint blocks that hold all pairs that its rule accepts; a kind without any has all pairs of near cells as candidates."""
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    found, features = None, materialise(spread(features.where(F.col("kind").isin(*rules))), "conflated")
    for kind, rule in rules.items():
        for block in (blocks or {}).get(kind, (Block(),)):
            pairs = candidates(features.where(F.col("kind") == kind), width, reach, block).where(F.coalesce(rule(l, r, F.col("d")), F.lit(False)))
            pairs = pairs.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
            found = pairs if found is None else found.unionByName(pairs)
    return found


def conflated_lines(features: DataFrame, rules: dict[str, tuple[float, Rule]], width: float = 100, reach: int = 2) -> DataFrame:
    """(a, b, d): pairs of line features of one kind and different sources whose boxes overlap, whose cells of ``width`` lie at most ``reach`` apart, that lie at
    most as far apart (d) as their kind allows, and that its rule accepts; features: id, kind, source, x, z, parts (lines of x and y) and what the rules read.

    rules: kind -> (most, rule); a kind without a rule has no pairs. Rules are asked before distances are known and are given one of 0."""
    found = None
    points = F.flatten("parts")
    for kind, (most, rule) in rules.items():
        own = features.where(F.col("kind") == kind).withColumn("box", geometry.bbox(points))
        over = lambda a, b, lo, hi: (a[lo] <= b[hi]) & (a[hi] >= b[lo])

        def alike(l, r, rule=rule) -> Column:
            near = lambda c: F.abs(cell(l(c), width) - cell(r(c), width)) <= reach
            boxes = over(l("box"), r("box"), "x0", "x1") & over(l("box"), r("box"), "y0", "y1")
            return (l("source") != r("source")) & near("x") & near("z") & boxes & F.coalesce(rule(l, r, F.lit(0.0)), F.lit(False))

        pairs = close_lines(own, most, alike)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def merged(features: DataFrame, links: DataFrame, priority: Column, reference: Column) -> DataFrame:
    """group_id, winner, members, sources of the groups that links make: the winner has the highest priority, then the smallest id;
    sources are the distinct references of all members."""
    groups = components(links)
    d = features.join(groups.select(F.col("node").alias("id"), F.col("comp").alias("group_id")), "id", "left").withColumn("group_id", F.coalesce("group_id", "id"))
    best = F.struct(priority.alias("p"), (-F.col("id")).alias("i"))
    return d.groupBy("group_id").agg(F.max_by("id", best).alias("winner"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set(reference)).alias("sources"))


#: pairs that serial_match() settles in one task
AT_ONCE = 2_000_000


def _in_turn(left: str, right: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs in the order of turns and wishes, those whose left and right row both are still free."""

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        pairs = pa.Table.from_batches(got)
        a, b = (pairs.column(c).combine_chunks().dictionary_encode().indices.to_pylist() for c in (left, right))
        settled, taken, kept = set(), set(), []
        for i, (l, r) in enumerate(zip(a, b)):
            if l not in settled and r not in taken:
                settled.add(l)
                taken.add(r)
                kept.append(i)
        yield from pairs.take(kept).combine_chunks().to_batches()

    return free


def serial_match(pairs: DataFrame, left: str, right: str, turn: Column, *wish: Column) -> DataFrame:
    """One-to-one matching in which each left row, in the order of ``turn``, takes what is left of its wishes (the least first).

    That is the one stable matching, so pairs that cannot be in it leave in every round: a right row that is the first wish of some left row is lost to all
    later turns, and a left row that has the earliest turn of some right row needs no wish after that one. The earliest left row that is not settled always
    settles, so the rounds end. What is left of AT_ONCE pairs or fewer is settled in one task, pair by pair; more than that is never gathered."""
    order = F.struct(*[w.alias(f"w{i}") for i, w in enumerate(wish)], F.col(right).alias("r"))
    rest = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    rest = materialise(rest.withColumn("_wish", order).withColumn("_turn", F.struct(turn.alias("t"), F.col(left).alias("l"))), "match-rest")
    columns, plain = rest.columns, rest.drop("_wish", "_turn").schema
    n, before = rest.count(), None
    while n > AT_ONCE and n != before:
        first = rest.groupBy(left).agg(F.min("_wish").alias("_first"))
        asked = rest.join(first, left).groupBy(right).agg(F.min("_turn").alias("_earliest"), F.min(F.when(F.col("_wish") == F.col("_first"), F.col("_turn"))).alias("_asked"))
        wanted = rest.join(asked, right).where(F.col("_asked").isNull() | (F.col("_turn") <= F.col("_asked")))
        sure = wanted.where(F.col("_turn") == F.col("_earliest")).groupBy(left).agg(F.min("_wish").alias("_sure"))
        kept = wanted.join(sure, left, "left").where(F.col("_sure").isNull() | (F.col("_wish") <= F.col("_sure")))
        old, rest = rest, materialise(kept.select(columns), "match-rest")
        discard(old)
        n, before = rest.count(), n
    if n > AT_ONCE:  # no pair leaves any more: each is the only one of its rows
        return rest.select(plain.names)
    out = materialise(rest.coalesce(1).sortWithinPartitions("_turn", "_wish").select(plain.names).mapInArrow(_in_turn(left, right), plain), "match")
    discard(rest)
    return out


#: establishments that establishments() settles in its first turn, at least; each further turn has twice as many. And how many ids decide where turns end
SETTLED, IDS = 1000, 10_000
#: wishes that an establishment has in a turn
WISHES = 32


def establishments(places: DataFrame, businesses: DataFrame, radius: float = 150, exact_radius: float = 300, least: float = 0.8) -> DataFrame:
    """(business_id, place_id, score, d): each establishment in its order takes the most similar place near it that is not taken.

    places: place_id, name, x, z; businesses: business_id, name, brand, x, z. Names that fold alike may lie exact_radius apart.
    Establishments come in turns by their order, and places that are taken leave before the next turn: most establishments of a crowd then meet few places.
    In a turn each has its first WISHES wishes; the first one that loses as many begins the next turn, with twice as many wishes."""
    places, businesses = materialise(places.where("name is not null"), "match-places"), materialise(businesses, "match-businesses")
    many = businesses.count()
    ids = businesses.where(F.pmod(F.xxhash64("business_id"), F.lit(max(1, many // IDS))) == 0).select("business_id").orderBy("business_id").collect() if many > SETTLED else []
    step, until, cuts = max(SETTLED, places.count() // 8), 0, []
    while (until := until + step) < many and (at := until * len(ids) // many) < len(ids):
        cuts.append(ids[at][0])
        step *= 2
    found, own, cuts, low, wishes = None, F.col("business_id"), [*cuts, None], None, WISHES
    order = Window.partitionBy("business_id").orderBy(F.desc("score"), "d", "place_id")
    while cuts:
        turn = businesses.where((F.lit(True) if low is None else own >= low) & (F.lit(True) if cuts[0] is None else own < cuts[0]))
        near = _similar(places if found is None else places.join(found, "place_id", "left_anti"), turn, radius, exact_radius, least)
        lists = materialise(near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= wishes), "match-lists")
        taken = serial_match(lists.drop("_place"), "business_id", "place_id", own, -F.col("score"), F.col("d"))
        # the first that lost as many wishes as it had may have more: what comes before it stands
        low = lists.where(F.col("_place") == wishes).join(taken, "business_id", "left_anti").agg(F.min("business_id")).first()[0]
        discard(lists)
        if low is None:
            low, wishes = cuts.pop(0), WISHES
        else:
            taken, wishes = taken.where(own < low), wishes * 2
        found = taken if found is None else found.unionByName(taken)
    return found


def _similar(places: DataFrame, businesses: DataFrame, radius: float, exact_radius: float, least: float) -> DataFrame:
    """(business_id, place_id, score, d): similar names near each other. Names that fold alike meet by their fold in cells of exact_radius, others in cells of radius."""
    wide = lambda df, s: df.select([F.col(c).alias(f"{s}_{c}") for c in df.columns])
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dz")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    words = lambda c: text.name_tokens(F.coalesce(F.col(c), F.lit("")))
    p = wide(places, "p").withColumn("p_words", words("p_name")).withColumn("p_fold", text.fold_text(F.col("p_name")))
    b = wide(spread(businesses), "b").withColumn("b_words", words("b_name")).withColumn("b_brands", words("b_brand")).withColumn("b_fold", text.fold_text(F.coalesce("b_name", F.lit(""))))
    alike, found = F.col("p_fold") == F.col("b_fold"), None
    for most, fits in ((radius, ~alike), (exact_radius, alike)):
        l = p.withColumn("_n", F.explode(near)).withColumn("_cx", cell("p_x", most) + F.col("_n.dx")).withColumn("_cz", cell("p_z", most) + F.col("_n.dz")).drop("_n")
        r = b.withColumn("_cx", cell("b_x", most)).withColumn("_cz", cell("b_z", most))
        pairs = l.alias("l").join(r.alias("r"), (F.col("l._cx") == F.col("r._cx")) & (F.col("l._cz") == F.col("r._cz")) & fits)
        pairs = pairs.withColumn("d", F.hypot(F.col("p_x") - F.col("b_x"), F.col("p_z") - F.col("b_z"))).where(F.col("d") <= most)
        found = pairs.drop("_cx", "_cz") if found is None else found.unionByName(pairs.drop("_cx", "_cz"))
    score = F.greatest(text.similarity(F.col("p_words"), F.col("b_words")), text.similarity(F.col("p_words"), F.col("b_brands")))
    pairs = found.withColumn("score", score).where(F.col("score") >= least)
    return pairs.select(F.col("b_business_id").alias("business_id"), F.col("p_place_id").alias("place_id"), "score", "d")


def registered_or_near(rows: DataFrame, known: DataFrame, most: float = 150) -> DataFrame:
    """(row_id, known_id): the known establishment that each row belongs to. By registry number, or, for rows without one, the first known one
    without a number that has its name, evidence in the address, and lies within most; rows: row_id, siret, name, address, x, z; known: known_id and the same."""
    first = known.where("siret is not null").groupBy("siret").agg(F.min("known_id").alias("known_id"))
    by_number = rows.where("siret is not null").join(first, "siret").groupBy("row_id").agg(F.min("known_id").alias("known_id"))
    key = lambda c: names.match_key(F.col(c))
    k = known.where("siret is null").select("known_id", key("name").alias("key"), key("address").alias("where"), "x", "z").where("where <> ''")
    r = rows.where("siret is null").select("row_id", key("name").alias("key"), key("address").alias("there"), "x", "z").where("there <> ''")
    return by_number.unionByName(first_within(r, k, "key", "row_id", "known_id", most, text.address_evidence(F.col("there"), F.col("r_where"))))


def enriched(pages: DataFrame, known: DataFrame, most: float = 150) -> DataFrame:
    """(page_id, known_id): the first establishment of a page's name, within most where the page has a position; pages: page_id, name, x, z."""
    key = lambda c: names.match_key(F.col(c))
    k = known.select("known_id", key("name").alias("key"), "x", "z")
    p = pages.select("page_id", key("name").alias("key"), "x", "z").where("key <> ''")
    nowhere = "x is null or z is null"
    first = lambda d: d.groupBy("key").agg(F.min("known_id").alias("known_id"))
    # a side without a position is near everything
    found = p.where(nowhere).join(first(k), "key").select("page_id", "known_id").unionByName(p.join(first(k.where(nowhere)), "key").select("page_id", "known_id"))
    found = found.unionByName(first_within(p, k, "key", "page_id", "known_id", most))
    return found.groupBy("page_id").agg(F.min("known_id").alias("known_id"))


def field_merge(rows: DataFrame, key: str, fields: list[str], priority: Column, arrival: Column, source: str) -> DataFrame:
    """One row a key: each field's value from the highest priority, the earliest among equals, where that came from, and all sources.

    A later value replaces an earlier one only from a strictly higher source, which is what the maximum by (priority, first come) gives."""
    place = F.struct(priority.alias("p"), (-arrival).alias("a"))
    out = []
    for f in fields:
        filled = F.coalesce(F.col(f) != "", F.lit(False))
        out += [F.max_by(f, F.when(filled, place)).alias(f), F.max_by(source, F.when(filled, place)).alias(f"{f}_source")]
    return rows.groupBy(key).agg(*out, F.array_sort(F.collect_set(source)).alias("sources"))


def repaired_streets(rows: DataFrame, spellings: DataFrame) -> DataFrame:
    """rows with shown: the spelling that the register gives for a postcode and folded street, of several the last by row_no; else the street itself."""
    last = spellings.groupBy("postcode", text.fold_text(F.col("street")).alias("_key")).agg(F.max_by("street", "row_no").alias("_shown"))
    return rows.withColumn("_key", text.fold_text(F.col("street"))).join(last, ["postcode", "_key"], "left").withColumn("shown", F.coalesce("_shown", "street")).drop("_key", "_shown")


def overlaid_tags(elements: DataFrame) -> DataFrame:
    """One row an element (type, id): the tags of all its rows, later rows (seq, then the greater value) over earlier ones; elements: type, id, seq, tags.

    Tags are dealt out by key, so an element that comes in many files is no list in one task."""
    each = elements.select("type", "id", "seq", F.explode_outer("tags").alias("key", "value"))
    last = each.groupBy("type", "id", "key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
    kept = F.filter(F.collect_list(F.struct("key", "value")), lambda t: t["key"].isNotNull())
    return last.groupBy("type", "id").agg(F.map_from_entries(F.array_sort(kept)).alias("tags"))


def unseen(objects: DataFrame, extract: DataFrame, ids: Column) -> DataFrame:
    """Objects none of whose canonical ids the extract has; objects: source_id; extract: element_id."""
    seen = objects.select("source_id", F.explode(ids).alias("element_id")).join(extract.select("element_id"), "element_id", "left_semi").select("source_id").distinct()
    return objects.join(seen, "source_id", "left_anti")
