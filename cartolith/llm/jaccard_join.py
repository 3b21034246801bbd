"""Exact Jaccard join of documents on word shingles, and the components that its links make.

The distance 1 - J is a metric. A region is the Voronoi cell of a pivot, and a document that may have
partners beyond its own region is replicated into all regions where one can be.

First come pivots of a single shingle: the distance of a document to {s} tells whether it holds s, so its
regions are its shingles, and the window that a threshold t opens is its prefix: two sets that
link share a shingle among the first n - ceil(t n) + 1 of each in any common order. The order puts the
shingles that many documents hold last. It comes from a table of counts of fixed size; a set may leave
out as many of its commonest as its prefix was made longer by, which loses no link:
let l(n) = floor((1-t) n), and let the prefix have 2 l(n) + 1 shingles in hash order. Two linked sets share
at least l(the smaller n) + 1 of them; each leaves out l(ceil(t n)) at most, and no partner has
fewer than ceil(t n) shingles, so the rarest shared one stays on both sides.

Inside a region the join goes on with documents. Its pivot, the document that lies in most regions, meets every
other one; those within 1 - t of it are connected. Regions with one pivot then form its cell. What is
left in a cell, pairs that are not connected yet, is taken block by block: two documents whose distances to the pivot differ by more than 1 - t cannot link, nor
can two whose numbers of shingles in SKETCH slots differ too much. Only pairs that pass these bounds become
rows, and their sets decide. Copies of a set are one node, so a group of n near copies of one document
costs about n pairs; documents of a group that are not connected with it are compared by their sketches.

Sets are keyed by 64-bit hashes. A document without words links with nothing. Null ids have no component.
Rows that share an id count as documents of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.graph import components

from .common import discard, materialise
from .textnum import Words, mix, windows, words_of

TABLE_BITS, PARTS, SKETCH, BLOCK = 20, 64, 512, 1024
_COEFFICIENTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document; fewer words than size make one shingle."""
    h = words.hashes()
    begin, owner = windows(words, size)
    sums = np.zeros(len(begin), dtype=np.uint64)
    for k in range(size):
        sums += h[begin + k] * _COEFFICIENTS[k]
    codes, bounds = mix(sums), np.searchsorted(owner, np.arange(len(words.rows) + 1))
    out = []
    for k in range(len(words.rows)):
        if bounds[k] < bounds[k + 1]:
            out.append(np.unique(codes[bounds[k] : bounds[k + 1]]))
        else:
            few = h[words.first[k] : words.first[k + 1]]
            out.append(mix((few * _COEFFICIENTS[: len(few)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(few))) if len(few) else few)
    return out


def set_key(codes: np.ndarray) -> int:
    return int(mix(codes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(codes) else 0


def spare(n: int, percent: int) -> int:
    """How many shingles of a set of n a linked set may lack."""
    return n - (percent * n + 99) // 100


def _prefix(codes: np.ndarray, percent: int) -> np.ndarray:
    return codes[: 2 * spare(len(codes), percent) + 1]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(64 - TABLE_BITS)).astype(np.int64) ^ (codes & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def _keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, sketch = [], [], []
            for words in words_of(batch.column("text"), lower=True):
                for codes in shingle_sets(words, size):
                    node.append(set_key(codes))
                    n.append(len(codes))
                    slots = np.bincount((codes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
                    sketch.append(np.minimum(slots, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "row_key", "node", "n", "sketch"])

    return run


def _table(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                parts = [_prefix(codes, percent) for codes in shingle_sets(words, size)]
                counts += np.bincount(_slot(np.concatenate(parts)), minlength=len(counts))
        if counts.any():
            rows = np.minimum(counts, 2**31 - 1).astype(np.int32).reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["part", "counts"])

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            more = np.frombuffer(counts, dtype=np.int32).astype(np.int64)
            sums[part] = sums[part] + more if part in sums else more
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(s, 2**31 - 1).astype(np.int32).tobytes() for s in sums.values()], pa.binary())], names=["part", "counts"])


def commonness(docs: DataFrame, size: int, percent: int) -> np.ndarray:
    """Log-scaled counts by slot; a table of 2 ** TABLE_BITS entries whatever the input."""
    parts = docs.mapInArrow(_table(size, percent), "part int, counts binary")
    # first sums within a few dozen groups, then over them: no task takes the tables of all others
    for keys in (["part", F.pmod(F.spark_partition_id(), F.lit(32))], ["part"]):
        parts = parts.repartition(*keys).mapInArrow(_sum, "part int, counts binary")
    counts = np.zeros((PARTS, (1 << TABLE_BITS) // PARTS), dtype=np.int64)
    for row in parts.collect():  # PARTS rows of fixed size
        counts[row.part] += np.frombuffer(row["counts"], dtype=np.int32)
    return np.log2(counts.ravel() + 1).astype(np.uint8)


def _tokens(size: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                token, node, n = [], [], []
                for codes in shingle_sets(words, size):
                    if len(codes):
                        long = _prefix(codes, percent)
                        stay = len(long) - spare((percent * len(codes) + 99) // 100, percent)
                        order = np.argsort(common[_slot(long)], kind="stable")[:stay]
                        token.append(long[order])
                        node.append(np.full(stay, set_key(codes), dtype=np.int64))
                        n.append(np.full(stay, len(codes), dtype=np.int64))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(n))], names=["token", "node", "n"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column("text"), lower=True):
                sets = shingle_sets(words, size)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(words.rows[0], len(words.rows)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "codes"])

    return run


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [
            len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True))
            for x, y in zip(batch.column("codes_a"), batch.column("codes_b"))
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int64())], names=["a", "b", "na", "nb", "both"])


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int64) for c in ("sketch_a", "sketch_b"))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(np.abs(x - y).sum(axis=1))], names=["a", "b", "na", "nb", "apart"])


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds apart, a lower bound of the symmetric difference, to pairs of a, b, na, nb; nodes: node, sketch."""
    rows = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b")), "b")
    return rows.mapInArrow(_apart, "a long, b long, na long, nb long, apart long")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Adds both (shared shingles), far (distance) and link to distinct pairs of a, b, na, nb."""
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("codes_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("codes").alias("codes_b")), "b")
    d = rows.select("a", "b", "na", "nb", "codes_a", "codes_b").mapInArrow(_overlap, "a long, b long, na long, nb long, both long")
    union = F.col("na") + F.col("nb") - F.col("both")
    return d.withColumn("far", 1 - F.col("both") / union).withColumn("link", 100 * F.col("both") >= percent * union)


def with_partners(regions: DataFrame, percent: int) -> DataFrame:
    """Rows that have another node of linkable size in their region. Sizes are cut into classes whose bounds
    differ by the factor t, each taken together with the next."""
    # a little wider than t asks for, so that rounding never puts linkable sizes two classes apart
    level = F.floor(F.log(F.col("n").cast("double")) / (-math.log(percent / 100) * (1 + 1e-6)))
    d = regions.withColumn("span", F.explode(F.array(level, level - 1)))
    # as in the other joins by token, the side with one row a key is a table, so that hot keys of the other can be split
    full = materialise(d.groupBy("token", "span").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token", "span"), "op5-full")
    out = materialise(d.join(full, ["token", "span"], "left_semi").select("token", "node", "n").distinct(), "op5-regions")
    discard(full)
    return out


def _survivors(rows: pa.Table, percent: int, same: bool) -> tuple[np.ndarray, ...]:
    """a, b, na, nb of the pairs between the two sides of a block that may link and are not yet connected."""
    get = lambda c: rows.column(c).to_numpy()
    node, n, comp, low, high, side = (get(c) for c in ("node", "n", "comp", "low", "high", "side"))
    left, right = (np.arange(len(node)), np.arange(len(node))) if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    x, y = left[:, None], right[None, :]
    reach = 1 - percent / 100 + 1e-9
    may = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
    may &= (low[x] - high[y] <= reach) & (low[y] - high[x] <= reach)
    if same:
        may &= x < y
    k, l = np.nonzero(may)
    k, l = left[k], right[l]
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH).astype(np.int16)
    keep = np.zeros(len(k), dtype=bool)
    for at in range(0, len(k), 1 << 13):
        part = slice(at, at + (1 << 13))
        apart = np.abs(sketch[k[part]] - sketch[l[part]]).sum(axis=1, dtype=np.int64)
        total = n[k[part]] + n[l[part]]
        keep[part] = 100 * (total - apart) >= percent * (total + apart)
    k, l = k[keep], l[keep]
    return node[k], node[l], n[k], n[l]


def _blocks(percent: int):
    """Over rows sorted by token, i, j: the surviving pairs of each block; a block may run across batches."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [table.column(c).to_numpy() for c in ("token", "i", "j")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        found = [_survivors(table.slice(a, b - a), percent, bool(keys[1][a] == keys[2][a])) for a, b in zip([0, *new.tolist()], [*new.tolist(), len(table)])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(4)], names=["a", "b", "na", "nb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            keys = [rest.column(c).to_numpy() for c in ("token", "i", "j")]
            whole = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            if len(whole):
                yield from pairs(rest.slice(0, int(whole[-1]) + 1))
                rest = rest.slice(int(whole[-1]) + 1).combine_chunks()
        if rest is not None and len(rest):
            yield from pairs(rest)

    return run


def surviving_pairs(regions: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs a, b, na, nb of a region that may link. Regions are cut into blocks of about BLOCK nodes by a
    hash, and blocks meet two at a time, so a task never holds a whole region and only pairs that pass
    every bound become rows."""
    sizes = materialise(regions.groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "op5-sizes")
    d = regions.join(nodes.select("node", "sketch"), "node").join(sizes, "token").withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "n", "comp", "low", "high", "sketch")
    dealt = d.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    found = dealt.mapInArrow(_blocks(percent), "a long, b long, na long, nb long")
    in_order = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), in_order("na", "nb").alias("na"), in_order("nb", "na").alias("nb"))
    out = materialise(pairs.distinct(), "op5-pairs")
    discard(sizes)
    return out


def linked(regions: DataFrame, nodes: DataFrame, sets_of, percent: int) -> DataFrame:
    """(node, comp) of the nodes that have links; regions: token, node, n; nodes: node, sketch; sets_of gives
    (node, codes) of a table of nodes: only sets that some pair needs are ever made."""
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    total = F.col("na") + F.col("nb")
    # the pivot of a region is its node that lies in most regions: of near copies, the one the others come from
    degree = regions.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    pivots = regions.join(degree, "node").groupBy("token").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("p"))
    pivots = materialise(pivots.select("token", F.col("p.node").alias("b"), F.col("p.n").alias("nb")), "op5-pivots")
    met = regions.join(pivots, "token").withColumnsRenamed({"node": "a", "n": "na"}).where("a <> b")
    pairs = materialise(bounded(met.where(fits).select("a", "b", "na", "nb").distinct(), nodes), "op5-pairs")
    close = pairs.where(100 * (total - F.col("apart")) >= percent * (total + F.col("apart"))).drop("apart")
    found = settled(close, sets_of, percent)
    links = found.where("link").select("a", "b")
    comps = components(links)
    # what is known of the distance to the pivot: itself, or a bound from the sketches or the sizes
    least = 1 - (total - F.col("apart")) / (total + F.col("apart"))
    known = pairs.select("a", "b", least.alias("least")).join(found.select("a", "b", "far"), ["a", "b"], "left").withColumnRenamed("a", "node")
    left = regions.join(pivots, "token").where("node <> b").join(known, ["node", "b"], "left").join(comps, "node", "left")
    size_gap = 1 - F.least("n", "nb") / F.greatest("n", "nb")
    # from here on a region is the cell of a pivot: the shingle regions that chose it become one
    cell = (F.col("b").alias("token"), "node", "n", F.coalesce("comp", "node").alias("comp"))
    left = left.select(*cell, F.coalesce("far", "least", size_gap).alias("low"), F.coalesce("far", F.lit(1.0)).alias("high"))
    left = materialise(left.distinct(), "op5-regions")
    open_ = left.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select("token")
    open_ = materialise(open_, "op5-open")
    rest = surviving_pairs(left.join(open_, "token", "left_semi"), nodes, percent)
    more = settled(rest, sets_of, percent).where("link").select("a", "b")
    out = components(more.union(comps.select("node", "comp"))) if more.limit(1).count() else comps
    discard(left, pivots, pairs, open_, rest)
    return out


def settled(pairs: DataFrame, sets_of, percent: int) -> DataFrame:
    """measured() of a table of pairs, as a table; the sets are made for it and deleted again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialise(sets_of(wanted), "op5-sets")
    out = materialise(measured(pairs, sets, percent), "op5-found")
    discard(sets)
    return out


def jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key (hash of the text), component_key: one row a document.

    Rows have one component_key if they are in one component; unlike component_id it also tells components apart
    whose smallest ids are one repeated id. It is null for rows without id or words.

    Two documents link if 100 * intersection >= percent * union of their sets of shingles of size words."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("row_key"))
    sound = docs.where("doc_id is not null and text is not null")
    keys = materialise(docs.mapInArrow(_keys(size), "doc_id long, row_key long, node long, n long, sketch binary"), "op5-keys")
    common = documents.sparkSession.sparkContext.broadcast(commonness(sound, size, percent))
    tokens = sound.mapInArrow(_tokens(size, percent, common), "token long, node long, n long")
    shared = materialise(tokens.groupBy("token").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("token"), "op5-shared")
    wide = materialise(tokens.join(shared, "token").distinct(), "op5-regions")
    discard(shared)
    regions = with_partners(wide, percent)
    firsts = keys.where("doc_id is not null and n > 0").groupBy("node").agg(F.min_by(F.struct("doc_id", "row_key", "sketch"), F.struct("doc_id", "row_key")).alias("r"))
    firsts = materialise(firsts.select("node", "r.doc_id", "r.row_key", "r.sketch"), "op5-nodes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        where = materialise(firsts.join(nodes, "node", "left_semi").select("node", "doc_id", "row_key", F.lit(1).alias("wanted")), "op5-wanted")
        # the filter is what lets Spark sift the texts before it shuffles them
        texts = sound.join(where.where("wanted > 0"), ["doc_id", "row_key"]).select("node", "text")
        # rows equal in id and text give equal sets: one is enough
        return texts.mapInArrow(_sets(size), "node long, codes binary").dropDuplicates(["node"])

    comps = linked(regions, firsts.select("node", "sketch"), sets_of, percent).join(firsts.select("node", "doc_id"), "node")
    smallest = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = comps.join(smallest, "comp").select("node", "comp", "component_id")
    ids = firsts.join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("comp", "node").alias("component_key"))
    ids = materialise(ids, "op5-components")
    discard(wide, regions)
    out = keys.drop("sketch").join(ids, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), "row_key", F.when(F.col("n") > 0, F.col("component_key")).alias("component_key"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id, and of rows that share that id and are near each other the
    one with the smallest row_key. Rows of one id with unlike texts are in different components: each is settled by itself.

    Documents without words or id stay. Columns may have any name."""
    found = materialise(jaccard_components(documents, size, percent), "op5-rows").where("doc_id is not null and n_shingles > 0")
    key = ["doc_id", "row_key"]
    # one row a component, in a table, so that a component with many of the rows can be split
    firsts = found.groupBy("component_key").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last")).where("first <> last")
    firsts = materialise(firsts.select("component_key", "first"), "op5-survivors")
    gone = found.join(firsts, "component_key").where(F.struct(*key) != F.col("first")).select(*key).distinct()
    same = found.groupBy(*key).count().where("count > 1").select(*key).join(gone, key, "left_anti")
    marks = materialise(gone.withColumn("mark", F.lit("gone")).union(same.withColumn("mark", F.lit("same"))), "op5-marks")
    # the row travels as one column, beside which any name is free
    d = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", F.xxhash64("text").alias("row_key")).join(marks, key, "left")
    # rows equal in id and text, few by nature, are settled apart
    return d.where("mark is null").unionByName(d.where("mark = 'same'").dropDuplicates(key)).select("row.*")
