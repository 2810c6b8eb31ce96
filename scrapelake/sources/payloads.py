"""Landed payloads: files that are the response of one scrape each, or tables of payloads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrapelake.functions import messages
from scrapelake.schema import PAYLOADS, Limits


def _within_limit(files: DataFrame, limits: Limits) -> DataFrame:
    """Oversize files keep their row but not their content.

    The length filter reaches the file reader, so their bytes are never read.
    """
    columns = PAYLOADS.fieldNames()
    small = files.filter(F.col("length") <= limits.body_bytes).select(*columns)
    large = files.filter(F.col("length") > limits.body_bytes).select(
        *columns[:3], F.lit(None).cast("binary").alias("content")
    )
    return small.unionByName(large)


def read_payloads(
    spark: SparkSession, path: str, *, glob: str = "*", limits: Limits = Limits()
) -> DataFrame:
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return _within_limit(files, limits)


def stream_payloads(
    spark: SparkSession,
    path: str,
    *,
    glob: str = "*",
    max_files_per_trigger: int = 10_000,
    limits: Limits = Limits(),
) -> DataFrame:
    """The same rows as files arrive. A payload is one row, so it is never split between
    micro-batches and a scrape needs no state. Each half of the union watches the folder by
    itself; a file passes the length filter of exactly one of them."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(PAYLOADS)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
    )
    return _within_limit(files, limits)


def _without_oversize(rows: DataFrame, limits: Limits) -> DataFrame:
    """Packed payloads; oversize ones keep their row but not their content."""
    small = F.col("length") <= limits.body_bytes
    length = F.coalesce("length", F.octet_length("content").cast("bigint"))
    return rows.withColumn("length", length).withColumn("content", F.when(small, F.col("content")))


def read_packed(spark: SparkSession, path: str, *, limits: Limits = Limits()) -> DataFrame:
    """Payloads as rows of Parquet files, many scrapes to a file: the columns of
    ``read_payloads``. Listing then grows with the files, not with the scrapes."""
    return _without_oversize(spark.read.schema(PAYLOADS).parquet(path), limits)


def stream_packed(
    spark: SparkSession,
    path: str,
    *,
    max_files_per_trigger: int = 100,
    limits: Limits = Limits(),
) -> DataFrame:
    """The same as files of rows arrive. The folder is listed once for each trigger."""
    rows = (
        spark.readStream.schema(PAYLOADS)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )
    return _without_oversize(rows, limits)


def inflate(content: bytes, encoding: str, cap: int) -> bytes | None:
    """Decoded bytes, at most ``cap`` and one more, which tells that there are more; ValueError if
    they cannot be decoded. Nothing beyond that is ever held, whatever the bytes would unfold to.

    Several compressed members after each other are one body. ``deflate`` is read with or without
    its envelope, as senders differ.
    """
    if encoding not in ("gzip", "x-gzip", "deflate"):
        raise ValueError(messages.UNKNOWN_ENCODING % encoding)
    broken = ValueError(messages.NOT_DECODABLE % encoding)
    windows = (31,) if encoding != "deflate" else (15, -15)
    for window in windows:
        out, rest = bytearray(), content
        try:
            while rest and len(out) <= cap:
                member = zlib.decompressobj(window)
                out += member.decompress(rest, cap + 1 - len(out))
                if not member.eof and len(out) <= cap:
                    raise broken
                rest = member.unused_data
            return bytes(out)
        except zlib.error:
            continue
    raise broken


def decoded(payloads: DataFrame, manifest: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Payloads as their text was before the transport compressed it, by the encoding their manifest
    row names. ``length`` becomes that of the decoded bytes, as far as they were looked at; content that
    does not decode is null, with a ``payload_error``.

    Only payloads that have an encoding go through Python, in Arrow batches, one after the other; what a
    task holds beside them is one decoded payload of at most ``limits.body_bytes``.
    """
    encoding = F.lower(F.trim("content_encoding"))
    coded = manifest.select("path", encoding.alias("encoding")).filter("encoding NOT IN ('', 'identity')")
    if coded.isEmpty():
        return payloads
    # Rows that share a path are refused anyway.
    marked = payloads.join(coded.groupBy("path").agg(F.max("encoding").alias("encoding")), "path", "left")
    cap = limits.body_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("path", "length", "content", "encoding")}
                content, error = row["content"], None
                if content is not None:
                    try:
                        content = inflate(content, row["encoding"], cap)
                        row["length"] = len(content)
                        content = content if len(content) <= cap else None
                    except ValueError as fault:
                        content, error = None, str(fault)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["path"]], pa.string()),
                        batch["modificationTime"].slice(i, 1),
                        pa.array([row["length"]], pa.int64()),
                        pa.array([content], pa.binary()),
                        pa.array([error], pa.string()),
                    ],
                    [*PAYLOADS.fieldNames(), "payload_error"],
                )

    kind = T.StructType([*PAYLOADS.fields, T.StructField("payload_error", T.StringType())])
    columns = PAYLOADS.fieldNames()
    plain = marked.filter("encoding IS NULL").select(*columns, F.lit(None).cast("string").alias("payload_error"))
    return plain.unionByName(marked.filter("encoding IS NOT NULL").select(*columns, "encoding").mapInArrow(run, kind))


def response_fault(limits: Limits) -> Column:
    """Why a response is refused before its text is looked at, or NULL. The order of the
    checks is the order in which a transport would meet them."""
    url = F.col("logical_url")
    content_type = F.col("content_type")
    media_type = F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))
    is_text = F.startswith(media_type, F.lit("text/")) | (
        media_type == "application/openmetrics-text"
    )
    return (
        F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(
            ~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)),
            messages.text(messages.HTTP_STATUS, F.coalesce("http_status", F.lit(0)), url),
        )
        .when(
            content_type.isNull() & ~F.col("allow_missing_content_type"),
            messages.text(messages.NO_CONTENT_TYPE, url),
        )
        .when(
            content_type.isNotNull() & ~is_text,
            messages.text(messages.WRONG_CONTENT_TYPE, media_type, url),
        )
        .when(
            F.col("length") > limits.body_bytes,
            messages.text(messages.BODY_LIMIT, limits.body_bytes, url),
        )
    )


def payload_text() -> Column:
    """Payload as text, NULL when its bytes are not valid UTF-8."""
    return F.try_validate_utf8(F.col("content").cast("string"))
