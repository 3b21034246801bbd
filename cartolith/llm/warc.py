"""WARC archives: writing pages as records, and reading them back by boundary chains.

Archives are written by Spark's text writer, gzipped; its line separator is the blank line that ends a
record. Files hold about ``file_bytes``, so a task reads one whole. Of records with equal payloads of REVISIT_BYTES
or more, the one with the smallest page_id is the response, the others are revisits without a payload.

To read, tasks emit for every magic string in a file, also those inside payloads, the offset where its
record would end; its header runs to the next blank line, however far that is. Those offset pairs form chains; pointer jumping from offset 0 doubles the distance in
each turn and keeps the records that the start of their file reaches, whatever payloads hold.

A null html is an empty payload, a null url an empty one. Repeated rows give repeated records; rows that
share the smallest page_id of a payload are all responses. A null page_id never is the smallest.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freed_shuffles, materialise, shared_dir

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 100


def write_archives(pages: DataFrame, path: str, file_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per row of page_id, url, html into archives under path."""
    d = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # plain equality on keys that are never null lets the join keep the partitioning below
    d = d.withColumn("pid", F.coalesce(F.col("page_id").cast("string"), F.lit(""))).withColumn("row_key", F.xxhash64("html"))
    slim = d.select("page_id", "pid", "row_key", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("bytes"))
    slim = materialise(slim, "op10-digests")
    firsts = slim.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = (F.col("first_id").isNotNull()) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id")))
    # rows equal in id and payload have equal headers
    heads = slim.join(firsts, "digest", "left").select("pid", "row_key", "digest", "bytes", F.when(again, F.col("first_id")).alias("refers")).distinct()
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    files = int(total // file_bytes) + 1
    joined = d.repartition(files, "pid", "row_key").join(heads, ["pid", "row_key"])
    revisit = F.col("refers").isNotNull()
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.col("pid"), F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html; charset=utf-8"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")), F.lit(END),
    )
    records = joined.select(F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("html"))).alias("value"))
    with freed_shuffles(pages.sparkSession):
        records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(data: bytes, at: int, stop: int) -> dict[str, tuple[int, str]]:
    """Where the last line of each name begins, and its value, after the first line of a header."""
    fields, line = {}, data.find(b"\r\n", at, stop)
    while line >= 0:
        end = data.find(b"\r\n", line + 2, stop)
        name, _, value = data[line + 2 : end if end >= 0 else stop].decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = line + 2, value.strip()
        line = end
    return fields


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of whole files: where a record would begin and end, and what its header says."""
    names = ["file", "at", "next", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            data, rows = gzip.decompress(content.as_py()), []
            at, stop = data.find(MAGIC), -1
            while at >= 0:
                # magic strings before the same blank line share its lines: those that follow each one are its header
                if stop < at:
                    stop, whole = data.find(b"\r\n\r\n", at), ""
                    if stop < 0:
                        break
                    fields = _fields(data, at, stop)
                names_here = ("content-length", "warc-type", "x-payload-length", "warc-payload-digest", "warc-record-id", "warc-refers-to")
                head = {k: fields[k][1] for k in names_here if k in fields and fields[k][0] > at}
                size = head.get("content-length", "")
                begin = stop + 4
                if size.isdigit() and data[begin + int(size) : begin + int(size) + 4] == b"\r\n\r\n":
                    kind, said = head.get("warc-type"), head.get("x-payload-length", "")
                    digest, length = head.get("warc-payload-digest", "").removeprefix("sha256:"), int(said) if said.isdigit() else None
                    if kind == "response":
                        whole = whole or hashlib.sha256(data[begin : begin + int(size)]).hexdigest()
                        digest, length = whole, int(size)
                    rows.append((path, at, begin + int(size) + 4, _page(head.get("warc-record-id")), kind, length, digest, _page(head.get("warc-refers-to"))))
                at = data.find(MAGIC, at + 1)
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the records that their file's offset 0 leads to; candidates: file, at, next."""
    d = materialise(candidates.select("file", "at", F.col("next").alias("jump"), (F.col("at") == 0).alias("on")), "op10-chain")
    while True:
        far = d.select("file", F.col("at").alias("jump"), F.col("jump").alias("further"))
        hit = d.where("on").select("file", F.col("jump").alias("at"), F.lit(True).alias("hit")).distinct()
        # a jump past the last record has no row and stays away for good
        stepped = d.join(far, ["file", "jump"], "left").select("file", "at", F.col("further").alias("jump"), "on")
        d = materialise(stepped.join(hit, ["file", "at"], "left").select("file", "at", "jump", (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on")), "op10-chain")
        if not d.where("on and jump is not null").limit(1).count():
            return d.where("on").select("file", "at")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records in the archives under path."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, at long, next long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"
    found = materialise(files.mapInArrow(_boundaries, schema), "op10-candidates")
    return found.join(reachable(found), ["file", "at"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, file_bytes: int = 16 << 20) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, file_bytes)
    return read_archives(spark, path)
