"""Mixing sources to target weights by entropy balancing.

Each source gets a share of the token budget by its weight; no source may exceed ``cap`` times its own
size, and what it cannot take is shared among the others by weight, until none is above. Document rates r
minimise the token-weighted relative entropy to 1, sum size (r log r - r + 1), under one token constraint
a source; the convex dual has one multiplier a source, the rates are exp(multiplier), and Newton's
method solves it over the table of source totals, which is all that the iterations read.

Rates are rounded into copies: the whole part for every document, one more for a share of them. Within a
source documents are lined up by size, and every time the running share passes an integer one document
more is taken, so the words taken stay near the target. The line is cut by (source, size), then
by a hash of the document, so no task ever holds a whole source. Equal input gives equal output.

Null texts have size 0; sources are ordered by code point with null last; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words

LANES, PHASES = 256, 16


def source_table(sized: DataFrame) -> DataFrame:
    """Row per source: source, source_size, rank (1 first). A window over the sources, not the documents."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return totals.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds target: budget times all sizes, shared by weight under the cap.

    The shares are min(level * weight, cap * size) for one level; the sources are put in the order in which
    they reach their caps as the level rises, and running sums give the level."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    d = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    line = Window.orderBy((F.col("most") / F.col("w")), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum(F.col("source_size").cast("double")).over(everything) * budget
    d = d.withColumn("level", (total - before) / left)
    # the first source whose cap lies above the level that is left for it and its followers fixes the
    # level; it is the highest of those, as every later one gives more than its share away
    level = F.max(F.when(F.col("most") / F.col("w") >= F.col("level"), F.col("level"))).over(everything)
    return d.withColumn("target", F.least("most", F.coalesce(level * F.col("w"), F.col("most")))).drop("w", "most", "level")


def newton(sources: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Adds rate = exp(multiplier): the dual optimum of each source's token constraint.

    The dual of a source is size * exp(m) - target * m; the gradient and curvature of a step are taken
    from the table of sources, and only the largest residual passes the driver. The dual is convex and steps are held to
    a length of 1, so the residual falls until it is within the tolerance, or rounding stops it."""
    d, last = sources.withColumn("m", F.lit(0.0)), None
    size = F.greatest(F.col("source_size").cast("double"), F.lit(1.0))
    while True:
        e = size * F.exp("m")
        step = (e - F.col("target")) / e
        d = materialise(d.withColumn("m", F.when((F.col("target") > 0), F.col("m") - F.greatest(F.least(step, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(float("-inf")))), "op8-dual")
        worst = d.agg(F.max(F.when(F.col("target") > 0, F.abs(size * F.exp("m") - F.col("target")) / F.col("target")))).first()[0]
        if worst is None or worst <= tolerance or last is not None and worst >= last:
            break
        last = worst
    return d.withColumn("rate", F.exp("m")).drop("m")


def copies(d: DataFrame, cap: int) -> DataFrame:
    """Adds copies (long) to rows of doc_id, row_key, source_no, size, lane, rate and target."""
    key = ["source_no", "size"]
    cells = d.groupBy(*key, "lane").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy(*key).agg(F.sum("n").alias("n"))
    line = Window.partitionBy("source_no").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*key, F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    lanes = Window.partitionBy(*key).orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("ahead", F.coalesce(F.sum("n").over(lanes), F.lit(0))).join(groups, key).select(*key, "lane", (F.col("before") + F.col("ahead")).alias("ahead"))
    within = Window.partitionBy(*key, "lane").orderBy(F.asc_nulls_last("doc_id"), "row_key")
    d = d.withColumn("at", F.row_number().over(within)).join(cells, [*key, "lane"])
    place, share = F.col("ahead") + F.col("at"), F.col("rate") - F.floor("rate")

    def taken(phase: Column) -> Column:
        extra = F.floor(share * place + phase) - F.floor(share * (place - 1) + phase)
        return F.least(F.floor("rate") + extra, F.lit(cap)).cast("long")

    # of PHASES ways to set the marks on the line, each source takes the one that comes nearest to its target
    d = materialise(d, "op8-line")
    phases = [(2 * i + 1) / (2 * PHASES) for i in range(PHASES)]
    sums = d.groupBy("source_no").agg(F.first("target").alias("target"), *[F.sum(taken(F.lit(f)) * F.col("size")).alias(f"s{i}") for i, f in enumerate(phases)])
    off = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{i}") - F.col("target")), F.lit(f).alias("phase")) for i, f in enumerate(phases)]))
    return d.join(sums.select("source_no", off["phase"].alias("phase")), "source_no").withColumn("copies", taken(F.col("phase"))).drop("at", "ahead", "phase")


def mix(documents: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, row_key (hash of the text), size, source_size, target, taken, copies, rate: one row a document."""
    d = documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("row_key"))
    d = materialise(d, "op8-sizes")
    sources = newton(targets(source_table(d), weights, budget, float(cap)))
    sources = materialise(sources.select("source", F.col("rank").alias("source_no"), "source_size", "target", "rate"), "op8-sources")
    joined = d.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.row_key", "d.size", "s.source_no", "s.source_size", "s.target", "s.rate")
    # as many lanes as documents of one source and size may need
    lane = F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(max(LANES, d.count() >> 16))).cast("int")
    out = copies(joined.withColumn("lane", lane), cap)
    return out.select("doc_id", "row_key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, one row a copy: their columns and the copy's number from 1, as the column
    ``copy``, or with underscores after it where the documents have that name."""
    taken = mix(documents, **how).where("copies > 0").groupBy("doc_id", "row_key").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    taken = materialise(taken.select(F.struct("doc_id", "row_key").alias("key"), "copies", "rows"), "op8-taken")
    # the row travels as one column, beside which any name is free; a struct as key lets null ids meet
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.struct("doc_id", F.xxhash64("text").alias("row_key")).alias("key"))
    joined = rows.join(taken, rows["key"].eqNullSafe(taken["key"])).select("row", rows["key"], "copies", "rows")
    # rows equal in id and text stand for each other: one of them gives the copies of all
    joined = joined.where("rows = 1").unionByName(joined.where("rows > 1").dropDuplicates(["key"]))
    name = "copy"
    while name in {c.lower() for c in documents.columns}:
        name += "_"
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*", F.col("copy").alias(name))
