"""Table schemas, size limits and the constants every module shares."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Identifier patterns, metric types, special numbers and component suffixes
# of the text exposition format.
METRIC_NAME = r"[A-Za-z_:][A-Za-z0-9_:]*"
LABEL_NAME = r"[A-Za-z_][A-Za-z0-9_]*"
METRIC_TYPES = ("counter", "gauge", "untyped", "histogram", "summary")
SPECIAL_VALUES = ("NaN", "+Inf", "-Inf")

DAY_MS = 86_400_000

# A write order key is scrape_id * 2^26 + line number, so a payload has fewer than 2^26 lines
# and scrape ids stay below 2^37. Last-writer-wins then compares one BIGINT.
LINE_BITS = 26
LAST_LINE = (1 << LINE_BITS) - 1
MAX_SCRAPE_ID = (1 << (63 - LINE_BITS)) - 1


@dataclass(frozen=True)
class Limits:
    """Caps that fail a scrape or a query; nothing is ever truncated to fit them."""

    # The default caps.
    body_bytes: int = 8 * 1024 * 1024
    samples: int = 25_000
    labels: int = 32
    label_value_bytes: int = 1024
    query_series: int = 1_000
    query_samples: int = 10_000
    error_chars: int = 1024

    def __post_init__(self) -> None:
        for field in fields(self):
            if getattr(self, field.name) <= 0:
                raise ValueError(f"limit {field.name} must be positive")
        if self.body_bytes > LAST_LINE - 1:
            raise ValueError(f"limit body_bytes must be below {LAST_LINE}")


def _table(**columns: str | T.DataType) -> T.StructType:
    struct = T.StructType()
    for name, kind in columns.items():
        struct.add(name, kind)
    return struct


_LABELS = T.MapType(T.StringType(), T.StringType())
_LABEL_ENTRIES = T.ArrayType(_table(name="string", value="string"))

PAYLOADS = _table(path="string", modificationTime="timestamp", length="long", content="binary")

MANIFEST = _table(
    run_id="long",
    scrape_id="long",
    scrape_ordinal="integer",
    path="string",
    system="string",
    module="string",
    job="string",
    logical_url="string",
    resolved_ip="string",
    port="integer",
    collector_labels=_LABEL_ENTRIES,
    honor_labels="boolean",
    honor_timestamps="boolean",
    allow_missing_content_type="boolean",
    content_type="string",
    http_status="integer",
    attempts="integer",
    started_at_ms="long",
    finished_at_ms="long",
    fetch_error="string",
    task_id="string",
    content_encoding="string",
)

#: Payloads that wait for their manifest row, with the batch in which they came.
PENDING = T.StructType([*PAYLOADS.fields, T.StructField("first_batch", T.LongType())])

CATALOGUE = _table(
    system="string",
    module="string",
    ordinal="integer",
    name="string",
    metric_type="string",
    required="boolean",
    task_id="string",
)

SERIES = _table(
    series_id="string",
    metric_name="string",
    family_name="string",
    metric_type="string",
    labels=_LABELS,
    labels_key="string",
)

SAMPLES = _table(
    series_id="string",
    metric_name="string",
    sample_timestamp_ms="long",
    value="double",
    value_repr="string",
    scrape_id="long",
    collected_at_ms="long",
    order_key="long",
    sample_date="date",
)

SCRAPES = _table(
    scrape_id="long",
    run_id="long",
    scrape_ordinal="integer",
    system="string",
    module="string",
    logical_url="string",
    resolved_ip="string",
    instance="string",
    started_at_ms="long",
    finished_at_ms="long",
    status="string",
    attempts="integer",
    http_status="integer",
    sample_count="long",
    error="string",
)

#: What a batch has read: the bytes of each payload as they landed, oversize ones without a hash.
LANDED = _table(path="string", length="long", content_hash="long")

#: Days of a series, 32 to a block, as bits.
ACTIVITY = _table(series_id="string", block="integer", days="long")

METADATA = _table(
    system="string",
    module="string",
    family_name="string",
    metric_type="string",
    help="string",
    unit="string",
    updated_at_ms="long",
    order_key="long",
)
