"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Characters are mapped to SYMBOLS classes (letters, marks of case, digits, punctuation; letters beyond the
Latin blocks by their code), and the model predicts each from the three before it. Spark counts the 4-grams of all
trusted documents in shards and sums them by (language, gram); each language's model is fitted by a task of its
own from at most SYMBOLS ** 4 counts, and written to the shared folder cut into SHARDS pieces. A language's probabilities are drawn
towards those of all trusted text together, which count as PRIOR_CHARS characters of it, so every language is
treated alike whatever its amount of text; one without trusted text has the common model.

Documents are scored by a sharded count join: a task counts the distinct 4-grams of a run of documents, packs the
counts by shard, and each pack meets the piece of the model that it needs. The partial surprises of
a document are then added up. Texts are never moved, and no task holds a model. Packs are dealt to as many
salts as the text has gigabytes, so a language that most documents have is no hot key.

A document's score is the mean surprise of its characters, drawn towards the language's mean by
PRIOR characters, so that short texts are not judged on little evidence; its perplexity is exp(score).
It is kept up to a quantile of the trusted documents of its language, times a margin; for that quantile
each trusted document is scored by a model of the half of the trusted text that it is not part of. A language's
quantile is drawn towards the one over all languages, which counts as PRIOR_DOCS documents of it.

Texts without a word have no perplexity and are not kept. Labels of one document that disagree make it untrusted.
Without any trusted text everything with a word is kept. Repeated rows are judged alike. Columns may have any name.

judged() also rejects toxic text. A few abusive words do not move a mean, so each word counts alone: two word
models with absolute discounting, of the documents that any label calls toxic and of the trusted ones, give the log
ratio of its likelihoods, and the strongest word decides. A word counts once a document. The ratio to reject from is
the least at which, by the model of one half of the labelled documents, the words above it lie in less than a share
of 1 - quantile of the trusted documents of the other half. Counts are summed and joined by Spark over
all words; languages share the models. Phrases of harmless words are not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

SYMBOLS, ORDER = 40, 4
PRIOR, PRIOR_CHARS, PRIOR_DOCS = 60.0, 20_000, 20
SHARDS = 64
#: What a task counts before it gives out its packs: so many characters, or documents, and tables of counts.
PACK_CHARS, PACK_DOCS, TABLES = 1 << 22, 20_000, 8
ALL = "*"
CHUNK = 1 << 19
#: Characters of scripts without spaces, each of which is a word; by ranges, which are quicker to test than scripts.
_ALONE = r"\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}"
#: A run of letters, marks and digits of other scripts, or one such character.
TOXIC_WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_ALONE}]]++|[{_ALONE}]"
#: Ratios are compared in steps of this size when the limit is chosen.
STEP = 0.01


def _classes() -> np.ndarray:
    """Symbol of each code point below 0x300; 0 is the start of a text, 7 to 38 are letters."""
    table = np.full(0x300, 39, dtype=np.uint8)
    for c in range(0x300):
        x = chr(c)
        if x.isspace():
            table[c] = 1
        elif x.isdigit():
            table[c] = 3
        elif x.isupper():
            table[c] = 2
        elif "a" <= x <= "z":
            table[c] = 7 + c - 97
        elif x.isalpha():
            table[c] = 33 + c % 6
        elif x in ".,;:'\"-()?":
            table[c] = 4
        elif x == "!":
            table[c] = 6
        elif c < 0x80:
            table[c] = 5
    return table


_CLASSES = _classes()


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram code that ends at each character of the texts, and the index of its text."""
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    beyond = np.where((codes >= 0x2000) & (codes < 0x2C00), 39, 7 + codes % 32)
    symbols = np.where(codes < 0x300, _CLASSES[np.minimum(codes, 0x2FF)], beyond).astype(np.int32)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + (owner + 1) * (ORDER - 1)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    for k, n in zip(first.tolist(), sizes.tolist()):
        symbols[k - ORDER + 1 : k] = 0
    whole = symbols[: len(symbols) - 3] * SYMBOLS**3 + symbols[1:-2] * SYMBOLS**2 + symbols[2:-1] * SYMBOLS + symbols[3:]
    return whole[at - 3], owner


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters, with the row of the first; a longer text is one run."""
    run, first, size = [], 0, 0
    for i, text in enumerate(column):
        t = text.as_py() or ""
        if run and size + len(t) > CHUNK:
            yield first, run
            run, first, size = [], i, 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[str, int], np.ndarray] = {}
    size = 0
    for batch in batches:
        langs = list(zip(batch.column("lang").to_pylist(), batch.column("fold").to_pylist()))
        for first, texts in chunks(batch.column("text")):
            gram, owner = grams(texts)
            mine = langs[first : first + len(texts)]
            for lang in set(mine):
                if lang not in totals and len(totals) >= TABLES or size > 1 << 30:
                    # a task holds so many tables at a time; Spark sums what it gives out in parts
                    yield from _rows(totals)
                    totals.clear()
                    size = 0
                part = gram[np.array([x == lang for x in mine])[owner]]
                if lang not in totals:
                    totals[lang] = np.zeros(SYMBOLS**ORDER, dtype=np.int32)
                totals[lang] += np.bincount(part, minlength=SYMBOLS**ORDER).astype(np.int32)
                size += len(part)
    yield from _rows(totals)


def _rows(totals: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (lang, fold), have in totals.items():
        seen = np.flatnonzero(have)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([fold] * len(part), pa.int32()), pa.array(part.astype(np.int32)), pa.array(have[part].astype(np.int64))], names=["lang", "fold", "gram", "n"])


def _discounts(counts: np.ndarray) -> list[float]:
    n = [0] + [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [0.0] + [min(k, max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.75 for k in (1, 2, 3)]


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """-log p of every gram of a full table of counts, flat; modified discounts at each order."""
    levels = [counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)]
    while levels[-1].ndim > 1:  # how many left neighbours each shorter gram has
        levels.append((levels[-1] > 0).sum(axis=0).astype(np.float64))
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for level in reversed(levels):
        d = np.take(np.array(_discounts(level)), np.minimum(level, 3).astype(np.int64))
        total = level.sum(axis=-1, keepdims=True)
        left = np.divide(d.sum(axis=-1, keepdims=True), total, out=np.ones_like(total), where=total > 0)
        p = np.divide(np.maximum(level - d, 0), total, out=np.zeros_like(level), where=total > 0) + left * p
    return -np.log(p).ravel()


MODEL = "model string, fold int, shard int, mean double, p binary"


def _fit(key: tuple, rows: pa.Table) -> pa.Table:
    """Pieces of the probabilities of one language and fold, and the mean surprise of what it was fitted to."""
    counts = np.zeros(SYMBOLS**ORDER)
    counts[rows.column("gram").to_numpy()] = rows.column("n").to_numpy()
    surprise = kneser_ney(counts)
    p = np.exp(-surprise).astype(np.float32).reshape(SHARDS, -1)
    total, mean = float(counts.sum()), float((counts * surprise).sum() / counts.sum())
    lang, at = key[0].as_py(), key[1].as_py()
    return pa.table({"lang": [lang] * SHARDS, "fold": pa.array([at] * SHARDS, pa.int32()), "shard": pa.array(range(SHARDS), pa.int32()), "total": [total] * SHARDS, "mean": [mean] * SHARDS, "p": pa.array([x.tobytes() for x in p], pa.binary())})


def _blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """-log of each language's probabilities drawn towards the common ones; as half-precision numbers."""
    for batch in batches:
        out = []
        for own, common, total in zip(batch.column("p"), batch.column("common"), batch.column("total").to_pylist()):
            share = total / (total + PRIOR_CHARS)
            both = share * np.frombuffer(own.as_py(), np.float32) + (1 - share) * np.frombuffer(common.as_py(), np.float32)
            out.append((-np.log(both)).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("model", "fold", "shard", "mean")), pa.array(out, pa.binary())], names=["model", "fold", "shard", "mean", "p"])


def train(trusted: DataFrame) -> DataFrame:
    """A table of MODEL: surprises by language, and ALL for the common model, each fitted to fold 0, 1 or all (2) of the
    trusted documents; trusted: lang, text, fold."""
    counts = trusted.mapInArrow(_count, "lang string, fold int, gram int, n long").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "op7-counts")
    whole = counts.select("lang", F.explode(F.array("fold", F.lit(2))).alias("fold"), "gram", "n")
    every = whole.select(F.explode(F.array("lang", F.lit(ALL))).alias("lang"), "fold", "gram", "n").groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n"))
    fits = materialise(every.groupBy("lang", "fold").applyInArrow(_fit, "lang string, fold int, shard int, total double, mean double, p binary"), "op7-fits")
    common = fits.where(F.col("lang") == ALL).select("fold", "shard", F.col("p").alias("common"))
    # a language that one fold alone has is scored there by the common model
    both = fits.withColumnRenamed("lang", "model").join(common, ["fold", "shard"])
    out = materialise(both.mapInArrow(_blend, MODEL), "op7-model")
    discard(counts, fits)
    return out


PACK = "batch long, model string, fold int, shard int, rows int, size int, pack binary, who array<struct<doc_id:long,lang:string,row_key:long,model:string,fold:int,n_chars:long,blank:boolean>>"
_WHO = pa.list_(pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("row_key", pa.int64()), ("model", pa.string()), ("fold", pa.int32()), ("n_chars", pa.int64()), ("blank", pa.bool_())]))
_PACK_TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), _WHO]
_PACK_NAMES = ["batch", "model", "fold", "shard", "rows", "size", "pack", "who"]


def squeeze(gram: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """Counts in the order of gram and document, as steps from one to the next and byte plane by byte plane, compressed."""
    planes = [np.diff(gram, prepend=0).astype("<u2"), np.diff(doc, prepend=0).astype("<u2"), n.astype("<u4")]
    return pa.compress(b"".join(x.view(np.uint8).reshape(len(gram), -1).T.tobytes() for x in planes), codec="zstd", asbytes=True)


def unsqueeze(pack: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram, doc and n of squeeze()."""
    planes = np.frombuffer(pa.decompress(pack, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8).reshape(8, size)
    whole = lambda a, b, kind: np.ascontiguousarray(planes[a:b].T).view(kind).ravel()
    return np.cumsum(whole(0, 2, "<u2"), dtype=np.uint16), np.cumsum(whole(2, 4, "<u2"), dtype=np.uint16), whole(4, 8, "<u4")


def _packs(who: list[dict], codes: list[np.ndarray], owners: list[np.ndarray], number: int) -> pa.RecordBatch:
    """Distinct grams and their counts of a run of documents by model, fold and shard; and who the documents are."""
    rows = [(number, "", -1, -1 - number % SHARDS, len(who), 0, None, who)]
    owner = np.concatenate(owners)
    owners.clear()
    keys = sorted({(w["model"], w["fold"]) for w in who})
    place = {k: i for i, k in enumerate(keys)}
    of = np.array([place[w["model"], w["fold"]] for w in who])
    # in place where it can be: these are the largest arrays that a task holds
    seen = of[owner]
    seen *= SYMBOLS**ORDER
    seen += np.concatenate(codes)
    codes.clear()
    seen *= PACK_DOCS
    seen += owner
    del owner
    seen.sort()
    first = np.flatnonzero(np.diff(seen, prepend=-1))
    n = np.diff(first, append=len(seen))
    seen = seen[first]
    gram, doc = seen // PACK_DOCS, seen % PACK_DOCS
    size = SYMBOLS**ORDER // SHARDS
    piece = gram // size
    bounds = np.flatnonzero(np.diff(piece, prepend=-1)).tolist() + [len(piece)]
    for a, b in zip(bounds, bounds[1:]):
        key, shard = divmod(int(piece[a]), SHARDS)
        rows.append((number, *keys[key], shard, len(who), b - a, squeeze(gram[a:b] % size, doc[a:b], n[a:b]), None))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PACK_TYPES)], names=_PACK_NAMES)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    number, who, codes, owners, size = first, [], [], [], 0
    for batch in batches:
        ids, langs, keys, models, folds = (batch.column(c).to_pylist() for c in ("doc_id", "lang", "row_key", "model", "fold"))
        for start, texts in chunks(batch.column("text")):
            for low in range(0, len(texts), PACK_DOCS):
                part = texts[low : low + PACK_DOCS]
                if who and (size > PACK_CHARS or len(who) + len(part) > PACK_DOCS):
                    yield _packs(who, codes, owners, number)
                    number, who, codes, owners, size = number + 1, [], [], [], 0
                gram, owner = grams(part)
                codes.append(gram)
                owners.append((owner + len(who)).astype(np.int32))
                size += len(gram)
                for i, t in enumerate(part, start + low):
                    who.append({"doc_id": ids[i], "lang": langs[i], "row_key": keys[i], "model": models[i], "fold": folds[i], "n_chars": len(t), "blank": not t or t.isspace()})
    if who:
        yield _packs(who, codes, owners, number)


def _surprise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack, the surprise of each document of its run, as numbers in their order."""
    for batch in batches:
        sums = []
        for rows, size, pack, p in zip(*(batch.column(c) for c in ("rows", "size", "pack", "p"))):
            if not pack.is_valid or not p.is_valid:
                sums.append(None)
                continue
            gram, doc, n = unsqueeze(pack.as_py(), size.as_py())
            each = np.frombuffer(p.as_py(), np.float16)[gram].astype(np.float64) * n
            sums.append(np.bincount(doc, weights=each, minlength=rows.as_py()).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("batch"), pa.array(sums, pa.binary()), batch.column("who")], names=["batch", "sums", "who"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for who, parts in zip(batch.column("who"), batch.column("sums").to_pylist()):
            if who.is_valid:
                rows = pa.RecordBatch.from_struct_array(who.values)
                total = np.zeros(rows.num_rows)
                for part in parts:
                    total += np.frombuffer(part, np.float32)
                yield rows.append_column("surprise", pa.array(total))


def score(d: DataFrame, models: DataFrame) -> DataFrame:
    """A table of doc_id, lang, row_key, model, n_chars and perplexity, null without a word; d: doc_id, lang, row_key, text, and the
    model and fold to score each row by."""
    gigabytes = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = int(gigabytes >> 30) + 1
    packs = d.select("doc_id", "lang", "row_key", "model", "fold", "text").mapInArrow(_pack, PACK).withColumn("salt", F.pmod("batch", F.lit(salts)).cast("int"))
    pieces = models.select("model", "fold", "shard", "p", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    joined = packs.join(pieces, ["model", "fold", "shard", "salt"], "left").select("batch", "rows", "size", "pack", "p", "who")
    parts = joined.mapInArrow(_surprise, "batch long, sums binary, who " + PACK.split(" who ")[1])
    # a run has a part for each model and shard, of a few bytes a document
    runs = parts.groupBy("batch").agg(F.collect_list("sums").alias("sums"), F.first("who", ignorenulls=True).alias("who"))
    scored = runs.select("sums", "who").mapInArrow(_whole, PACK.split("struct<")[1].rstrip(">").replace(":", " ") + ", surprise double")
    means = models.where("shard = 0").select("model", "fold", "mean")
    scored = scored.join(means, ["model", "fold"], "left")
    level = F.exp((F.col("surprise") + PRIOR * F.coalesce("mean", F.lit(0.0))) / (F.col("n_chars") + PRIOR))
    level = F.when(~F.col("blank"), level).alias("perplexity")
    return materialise(scored.select("doc_id", "lang", "row_key", "model", "n_chars", level, F.col("mean").isNotNull().alias("modelled")), "op7-scored")


def placed(d: DataFrame, models: DataFrame) -> DataFrame:
    """The rows with their model: their language's if it has one of their fold, else ALL."""
    known = materialise(models.where("shard = 0").select(F.col("model").alias("lang_model"), F.col("fold").alias("model_fold")), "op7-known")
    joined = d.join(known, (F.coalesce("lang", F.lit("")) == F.col("lang_model")) & (F.col("fold") == F.col("model_fold")), "left")
    return joined.select(*d.columns, F.coalesce("lang_model", F.lit(ALL)).alias("model"))


def fold() -> Column:
    """The half of the documents that a row belongs to, 0 or 1."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).cast("int")


def fitted(documents: DataFrame, labels: DataFrame, quantile: float, margin: float) -> tuple[DataFrame, DataFrame]:
    """The models, and the largest perplexity to keep by model: model, threshold."""
    d = documents.select("doc_id", "lang", "text", fold().alias("fold"), F.xxhash64("text").alias("row_key"))
    ids = materialise(trusted_ids(labels), "op7-trusted")
    trusted = materialise(d.join(ids, "doc_id").where("text is not null"), "op7-texts")
    models = train(trusted.select(F.coalesce("lang", F.lit("")).alias("lang"), "text", "fold"))
    crossed = score(placed(trusted.withColumn("fold", 1 - F.col("fold")), models), models).where("perplexity is not null and modelled")
    level, n = F.percentile_approx(F.log("perplexity"), quantile, 10_000).alias("level"), F.count(F.lit(1)).alias("n")
    overall = crossed.agg(level).first()[0]
    own = crossed.groupBy("model").agg(level, n).unionByName(crossed.agg(level, n).withColumn("model", F.lit(ALL)))
    # a language whose trusted texts all lie in one half has a model but no text scored across: it has the overall quantile
    named = models.where("shard = 0").select("model").unionByName(own.select("model")).distinct().join(own, "model", "left")
    share = F.coalesce(F.col("n") / (F.col("n") + PRIOR_DOCS), F.lit(0.0))
    drawn = F.exp(share * F.coalesce("level", F.lit(0.0)) + (1 - share) * F.lit(overall).cast("double")) * margin
    limits = materialise(named.select("model", drawn.alias("threshold")), "op7-limits")
    discard(ids, trusted)
    return models, limits


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that all labels call good and none toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("ok")).where("ok").select("doc_id")


def quality(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15) -> DataFrame:
    """doc_id, lang, model, n_chars, perplexity, threshold, keep: one row a document."""
    return _quality(documents, labels, quantile, margin).drop("row_key")


def _quality(documents: DataFrame, labels: DataFrame, quantile: float, margin: float) -> DataFrame:
    models, limits = fitted(documents, labels, quantile, margin)
    d = documents.select("doc_id", "lang", "text", F.xxhash64("text").alias("row_key"), F.lit(2).alias("fold"))
    # without any model nothing is rejected but texts without a word
    scored = score(placed(d, models), models).join(limits, "model", "left")
    keep = F.when(F.col("perplexity").isNull(), F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return scored.select("doc_id", "lang", "model", "n_chars", "perplexity", "row_key", "threshold", keep.alias("keep"))


def good_documents(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15, toxic: bool = False) -> DataFrame:
    """The documents that quality() keeps, all columns; with toxic those that judged() keeps, which rejects toxic ones too."""
    found = (_judged if toxic else _quality)(documents, labels, quantile, margin)
    bad = found.where("not keep").select("doc_id", "lang", "row_key").distinct()
    bad = materialise(bad.select(F.struct("doc_id", "lang", "row_key").alias("key")), "op7-bad")
    # rows are told apart by a struct, which is never null, so that null ids and languages meet as well
    rows = documents.select(F.struct(*documents.columns).alias("row"), F.struct("doc_id", "lang", F.xxhash64("text").alias("row_key")).alias("key"))
    return rows.join(bad, rows["key"].eqNullSafe(bad["key"]), "left_anti").select("row.*")


def _words(documents: DataFrame, *columns: str) -> DataFrame:
    """The columns and word, the hash of a distinct word of the row's text."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TOXIC_WORD), F.lit(0)))
    return documents.select(*columns, F.explode(words).alias("w")).select(*columns, F.xxhash64("w").alias("word"))


def toxic_words(documents: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """word, ratio of the words that reject a text; empty without toxic or without trusted text."""
    d = documents.select("doc_id", "text", fold().alias("fold"))
    toxic = labels.where("doc_id is not null and toxic = 1").select("doc_id").distinct()
    sides = [_words(d.join(materialise(ids, "op7-side"), "doc_id"), "fold").withColumn("toxic", F.lit(k)) for k, ids in enumerate((trusted_ids(labels), toxic))]
    names = {(k, f): f"{'tr'[k]}{f}" for k in (0, 1) for f in (0, 1)}
    sums = [F.count_if((F.col("toxic") == k) & (F.col("fold") == f)).alias(n) for (k, f), n in names.items()]
    counts = materialise(sides[0].union(sides[1]).groupBy("word").agg(*sums), "op7-words")
    parts = {f"{side}{m}": F.col(f"{side}{m}") if m < 2 else F.col(f"{side}0") + F.col(f"{side}1") for side in "tr" for m in (0, 1, 2)}
    told = [a for n, c in parts.items() for a in (F.sum(c).alias(f"{n}_sum"), F.count_if(c > 0).alias(f"{n}_some"), F.count_if(c == 1).alias(f"{n}_1"), F.count_if(c == 2).alias(f"{n}_2"))]
    total = counts.agg(F.count(F.lit(1)).alias("words"), *told).first()

    def log_p(name: str) -> Column:
        once, twice = total[f"{name}_1"], total[f"{name}_2"]
        discount = once / (once + 2 * twice) if once and twice else 0.5
        rest = discount * total[f"{name}_some"] / total["words"]
        return F.log((F.greatest(parts[name] - discount, F.lit(0.0)) + rest) / float(total[f"{name}_sum"]))

    if not (total["r2_sum"] and total["t2_sum"]):
        return counts.where("false").select("word", F.lit(0.0).alias("ratio"))
    # by each half's model, in how many trusted documents of the other half the words of a ratio lie, at most; a half without
    # toxic or without trusted text has no model, and if neither has one, the whole's model is held against its own texts
    halves = [(m, 1 - m) for m in (0, 1) if total[f"r{m}_sum"] and total[f"t{m}_sum"]] or [(2, 2)]
    held = [counts.where(parts[f"r{m}"] > 0).select((log_p(f"r{m}") - log_p(f"t{m}")).alias("ratio"), parts[f"t{other}"].alias("n")) for m, other in halves]
    steps = reduce(DataFrame.union, held).groupBy(F.floor(F.col("ratio") / STEP).alias("step")).agg(F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    tried = d.where("text is not null").where(F.col("fold").isin([other for _, other in halves]) | F.lit(halves == [(2, 2)]))
    trusted = tried.join(materialise(trusted_ids(labels), "op7-side"), "doc_id").count()
    limit, hit = 0.0, 0
    for row in steps:  # as many rows as a logarithm has steps
        hit += row.n
        if row.step < 0 or hit > (1 - quantile) * trusted:
            limit = max(0.0, (row.step + 1) * STEP)
            break
    ratio = log_p("r2") - log_p("t2")
    return materialise(counts.where(parts["r2"] > 0).select("word", ratio.alias("ratio")).where(F.col("ratio") >= limit).where("ratio > 0"), "op7-toxic")


def judged(documents: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 1.15) -> DataFrame:
    """The columns of quality() and toxic_ratio, the strongest ratio of a word that rejects, or null without one; such
    documents are not kept."""
    return _judged(documents, labels, quantile, margin).drop("row_key")


def _judged(documents: DataFrame, labels: DataFrame, quantile: float, margin: float) -> DataFrame:
    found = _words(documents.select("text", F.xxhash64("text").alias("row_key")), "row_key").join(toxic_words(documents, labels, quantile), "word")
    hits = materialise(found.groupBy("row_key").agg(F.max("ratio").alias("toxic_ratio")), "op7-hits")
    d = _quality(documents, labels, quantile, margin).join(hits, "row_key", "left")
    return d.withColumn("keep", F.col("keep") & F.col("toxic_ratio").isNull())
