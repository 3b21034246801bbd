"""Secret scan: fixed patterns, and strings whose characters are too evenly spread to be words.

Beyond the three patterns, every run of at least WINDOW token characters that touches no pattern match is a
candidate. A window of WINDOW characters slides over it. The counts of its characters are kept, five bits each, and
a step changes two of them: that of the character that enters and that of the one that leaves. So does it the
window's Shannon entropy, whose largest value is held against the threshold of the string's character class.
Allow-listed strings (identifiers of public form, placeholders, paths) are passed over.

A null text counts as empty; empty texts have no spans. Repeated rows are judged alike. Texts and candidates are
read whole, whatever their length; every pattern runs without recursion.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from .common import let

KINDS = ("assign", "access", "hex", "entropy")
# fixed values: the base patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"

WINDOW = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: What a candidate is made of; a character's place is its code.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Bits of a count, and counts in one long.
BITS, PACKED = 5, 12
#: (class, pattern of the whole string, least entropy in bits), first that fits; numbers alone are no secrets.
CLASSES = (
    ("decimal", "^[0-9]+$", 9.0), ("hex", "^[0-9A-Fa-f]+$", 3.0), ("letters", "^([a-z]+|[A-Z]+)$", 4.1), ("base32", "^[A-Z2-7]+=*$", 3.5),
    ("mixed letters", "^[A-Za-z]+$", 4.0), ("words", "^[A-Za-z/_+=-]+$", 4.3), ("base64", "", 3.9),
)
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|placeholder|changeme|xxxx",
    r"^(sha1|sha256|sha384|sha512)[-_]",
    r"^/?+(?:[A-Za-z_-]++/)++[A-Za-z0-9_-]{0,12}+$",
)


def peak_entropy(word: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the windows of so many characters of ALPHABET; 0 for a shorter word.

    The state holds the window's character counts, packed into longs, and the sum of c log2 c over them. A step
    takes the character that leaves out of both and puts the one that enters into both."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    weight = lambda n: F.element_at(table, n + 1)
    lanes = -(-len(ALPHABET) // PACKED)

    def count(counts: Column, code: Column) -> Column:
        lane = F.get(counts, F.floor(code / PACKED).cast("int"))
        return F.call_function("shiftright", lane, (code % PACKED) * BITS).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def changed(counts: Column, code: Column, by: int) -> Column:
        unit = F.call_function("shiftleft", F.lit(by).cast("long"), (code % PACKED) * BITS)
        return F.transform(counts, lambda v, i: F.when(i == F.floor(code / PACKED).cast("int"), v + unit).otherwise(v))

    def of(codes: Column) -> Column:
        def step(state: Column, j: Column) -> Column:
            leaves, enters = F.get(codes, j - window), F.get(codes, j)
            full = j >= window
            rest = F.when(full, changed(state["counts"], leaves, -1)).otherwise(state["counts"])
            gone = F.when(full, count(state["counts"], leaves)).otherwise(F.lit(0))
            total = state["sum"] + F.when(full, weight(gone - 1) - weight(gone)).otherwise(F.lit(0.0))

            def entered(left: Column) -> Column:
                n = count(left, enters)
                after = total + weight(n + 1) - weight(n)
                best = F.when(j >= window - 1, F.greatest(state["best"], F.lit(math.log2(window)) - after / window)).otherwise(state["best"])
                return F.struct(changed(left, enters, 1).alias("counts"), after.alias("sum"), best.alias("best"))

            return let(rest, entered)

        zero = F.struct(F.array(*[F.lit(0).cast("long")] * lanes).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda s: s["best"])

    codes = F.transform(F.split(word, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return F.when(F.length(word) < window, F.lit(0.0)).otherwise(let(codes, of))


def suspicious(word: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """Whether a candidate is random enough for its character class and not allow-listed."""
    least = F.lit(CLASSES[-1][2])
    for _, pattern, bits in reversed(CLASSES[:-1]):
        least = F.when(F.regexp_like(word, F.lit(pattern)), F.lit(bits)).otherwise(least)
    listed = F.lit(False)
    for pattern in allow:
        listed = listed | F.regexp_like(word, F.lit(pattern))
    return F.when(~listed & (least <= math.log2(WINDOW)), peak_entropy(word) >= least).otherwise(F.lit(False))


def secret_spans(documents: DataFrame) -> DataFrame:
    """The documents with base and extra: sorted arrays of (start, kind, stop), kind indexing KINDS."""
    d = documents.withColumn("_t", F.coalesce("text", F.lit("")))
    parts = []
    for k, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        d = d.withColumn(f"_m{k}", S.found(F.col("_t"), pattern))
        d = d.withColumn(f"_s{k}", S.starts(F.col(f"_m{k}"), S.gaps(F.col("_t"), pattern, F.col(f"_m{k}"))))
        if k == 0:
            d = d.withColumn("_v", F.when(F.size("_m0") > 0, F.regexp_extract_all(F.col("_t"), F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")))
            parts.append(S.spans(0, F.col("_m0"), F.col("_s0"), lambda m, i: F.length(F.element_at(F.col("_v"), i + 1)) >= 6))
        else:
            parts.append(S.spans(k, F.col(f"_m{k}"), F.col(f"_s{k}"), lambda m, i: F.lit(True)))
    d = d.withColumn("base", F.array_sort(F.concat(*parts)))
    d = d.withColumn("_m3", S.found(F.col("_t"), TOKEN))
    d = d.withColumn("_s3", S.starts(F.col("_m3"), S.gaps(F.col("_t"), TOKEN, F.col("_m3"))))
    apart = lambda m, i: ~F.exists("base", lambda b: (b["start"] < F.element_at(F.col("_s3"), i + 1) + F.length(m)) & (b["stop"] > F.element_at(F.col("_s3"), i + 1)))
    d = d.withColumn("extra", S.spans(3, F.col("_m3"), F.col("_s3"), lambda m, i: F.when(apart(m, i), suspicious(m)).otherwise(F.lit(False))))
    return d.drop("_t", "_v", *[f"_{x}{k}" for x in "ms" for k in range(4)])


def secret_scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    d = secret_spans(documents.select("doc_id", "text"))
    return d.select(
        "doc_id",
        *[S.count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(S.written(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.written(F.array_sort(F.concat("base", "extra")), KINDS).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"),
    )
