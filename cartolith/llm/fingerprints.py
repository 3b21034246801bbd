"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest 64-bit hashes of a document's distinct word shingles, in rising order.
Sketches of parts merge into the sketch of the whole. Two sketches give resemblance and containment,
one gives the number of distinct shingles; below k shingles all are exact.

A text is sketched in parts of PART words, which overlap by a shingle less one word; the sketches of the parts are merged.

A document of fewer words than a shingle has its whole word sequence as its one shingle; one without
words (a null or empty text) has the empty sketch, and two empty sketches have likeness 1. Very long texts are read
whole. Repeated rows and rows that share an id follow each other by the hash of their texts; null ids come
last, cut into ranges by that hash. Columns beside doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import let

SHINGLE, K, PART = 5, 128, 4096
_SPAN = float(2**64)


def words(text: Column) -> Column:
    """Words of a text, by whitespace 0x09-0x0D and space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(word_list: Column, k: int = K, shingle: int = SHINGLE, part: int = PART) -> Column:
    """Bottom-k sketch of a list of words, merged from those of its parts."""

    def of_part(h: Column) -> Column:
        # past the end there are nulls, which the hash passes over: a short text is one shingle
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))
        return F.slice(F.sort_array(F.array_distinct(many)), 1, k)

    def of(h: Column) -> Column:
        none = F.array().cast("array<long>")
        starts = F.sequence(F.lit(1), F.greatest(F.size(h) - shingle + 1, F.lit(1)), F.lit(part))
        parts = F.aggregate(starts, none, lambda have, i: merge(have, let(F.slice(h, i, part + shingle - 1), of_part), k))
        return F.when(F.size(h) == 0, none).when(F.size(h) < part + shingle, of_part(h)).otherwise(parts)

    return let(F.transform(word_list, lambda w: F.xxhash64(w)), of)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two documents' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance (Jaccard similarity) of two documents, 0 to 1."""
    joint = merge(a, b, k)
    both = F.size(F.array_intersect(joint, F.array_intersect(a, b)))
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both.cast("double") / F.size(joint))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, -1).cast("double") + _SPAN / 2
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (kth / _SPAN))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds."""
    union = distinct_shingles(merge(a, b, k), k)
    share = likeness(a, b, k) * union / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def text_form(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes' hexadecimal digits."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def fingerprints(documents: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, sketch, fingerprint (text form), distinct (estimated shingles)."""
    d = documents.select("doc_id", sketch(words(F.col("text")), k, shingle).alias("sketch"))
    return d.select("doc_id", "sketch", text_form(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("distinct"))


def in_order(documents: DataFrame, rows: int = 5000, most: int = 4096) -> tuple[DataFrame, WindowSpec]:
    """The documents dealt into ranges of ids, and the window in which each row's successor by descending
    id (null ids last, the first again after the last) follows it. Rows that share an id follow each
    other in the order of their texts' hashes. Rows marked guest only serve as successors.

    Ids are cut at approximate quantiles into ranges of about ``rows`` rows, of more where that would make over ``most`` ranges,
    and null ids by their texts' hashes, so no task sorts all rows; the head of each range (one row) is also dealt to the
    range before it. Only the quantiles and the heads pass the driver."""
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    count, known = d.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    pieces = lambda n: min(most, max(1, n // rows))
    buckets, blank = pieces(known), pieces(count - known)
    cuts = d.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets + 1)], 10 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))
    # bucket 0 has the largest ids, the last ones the null ids
    above = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<long>"), lambda c: c > F.col("doc_id")))
    share = F.least(F.floor((F.col("tie").cast("double") / _SPAN + 0.5) * blank), F.lit(blank - 1))
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), share + (len(cuts) + 1)).otherwise(above).cast("int"))
    # bitwise not puts the largest ids first
    place = F.struct(F.col("doc_id").isNull().alias("blank"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("turned"), F.col("tie").alias("tie"))
    heads = {r.bucket: r["head"] for r in d.groupBy("bucket").agg(F.min(place).alias("head")).collect()}
    order = sorted(heads)
    before, is_head = F.lit(None), F.lit(False)
    if order:
        of = F.array(*[F.lit(b) for b in order])
        get = lambda values, kind: F.element_at(F.map_from_arrays(of, F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")), F.col("bucket"))
        before = get([order[i - 1] for i in range(len(order))], "int")
        is_head = (place["turned"] == get([heads[b]["turned"] for b in order], "long")) & (F.col("tie") == get([heads[b]["tie"] for b in order], "long"))
    home = F.struct(F.col("bucket").alias("into"), F.lit(False).alias("guest"))
    away = F.struct(before.cast("int").alias("into"), F.lit(True).alias("guest"))
    dealt = d.withColumn("p", F.explode(F.when(is_head, F.array(home, away)).otherwise(F.array(home)))).select("doc_id", "text", "p.into", "p.guest", "tie")
    return dealt, Window.partitionBy("into").orderBy("guest", F.desc_nulls_last("doc_id"), "tie")


def edited_likeness(documents: DataFrame, k: int = K) -> DataFrame:
    """The fingerprint of each document and of its edited text, in which the last third of the code
    points is replaced by as many first ones of the next document (in_order); both likenesses, the share of the document's
    shingles that the next one holds, and the numbers of distinct shingles, all as estimated by the sketches.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_next, distinct, distinct_both."""
    dealt, ordered = in_order(documents)
    keys = ["doc_id", "into", "guest", "tie"]
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    # the second window finds the rows in order already: sketches are made after the shuffle, not moved by it
    d = dealt.withColumn("next_text", F.lead("text").over(ordered)).select(*keys, n.cast("long").alias("n_chars"), sketch(words(F.col("text")), k).alias("w"), F.when(~F.col("guest"), edited).alias("edited"))
    d = d.withColumn("x", F.lead("w").over(ordered)).where(~F.col("guest"))
    w, x, e = F.col("w"), F.col("x"), F.col("e")
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "w", "x", sketch(words(F.col("edited")), k).alias("e"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", text_form(w).alias("fingerprint"), text_form(e).alias("edited_fingerprint"), likeness(w, e, k).alias("near_edited"), likeness(w, x, k).alias("near_next"),
        containment(w, x, k).alias("in_next"), distinct_shingles(w, k).alias("distinct"), distinct_shingles(merge(w, x, k), k).alias("distinct_both"),
    )
