"""Small tables for the tests."""

from datetime import datetime

from pyspark.sql import functions as F

from scrapelake.functions import values as V
from scrapelake.operators.exposition import parse_payloads
from scrapelake.operators.upsert import first_series, with_identity
from scrapelake.schema import CATALOGUE, MANIFEST, PAYLOADS, SERIES

TARGET = {
    "run_id": 1,
    "system": "s",
    "module": "m",
    "job": "m",
    "logical_url": "http://h/metrics",
    "resolved_ip": "10.0.0.1",
    "port": 9090,
    "collector_labels": [("system", "s"), ("module", "m"), ("job", "m"), ("instance", "10.0.0.1:9090")],
    "honor_labels": True,
    "honor_timestamps": True,
    "allow_missing_content_type": False,
    "content_type": "text/plain",
    "http_status": 200,
    "attempts": 1,
    "started_at_ms": 7_321,
    "finished_at_ms": 7_821,
    "fetch_error": None,
    "task_id": None,
    "content_encoding": None,
}


def samples(spark, rows):
    """Rows of (name, family, type, labels, ts, value, repr, scrape_id); written in order."""
    schema = (
        "metric_name string, family_name string, metric_type string, labels map<string,string>,"
        " sample_timestamp_ms long, value double, value_repr string, scrape_id long,"
        " collected_at_ms long, order_key long"
    )
    full = [(*row, row[4] + 10, i) for i, row in enumerate(rows)]
    frame = with_identity(spark.createDataFrame(full, schema))
    return frame.withColumn("sample_date", V.sample_date(F.col("sample_timestamp_ms")))


def gauge(ts, value, labels=None, name="x", scrape_id=1):
    special = value if isinstance(value, str) else None
    number = None if special else float(value)
    return (name, name, "gauge", labels or {}, ts, number, special, scrape_id)


def series(frame):
    return first_series(frame).select(*SERIES.fieldNames())


def payload_frame(spark, texts):
    rows = []
    for i, text in enumerate(texts):
        if text is not None:
            content = text if isinstance(text, bytes) else text.encode()
            rows.append((f"p{i}", datetime(2024, 1, 1), len(content), bytearray(content)))
    return spark.createDataFrame(rows, PAYLOADS)


def manifest(spark, count, **overrides):
    """``overrides`` values may be lists, one entry per scrape."""
    rows = []
    for i in range(count):
        row = TARGET | {"scrape_id": i, "scrape_ordinal": i, "path": f"p{i}"}
        for name, value in overrides.items():
            row[name] = value[i] if isinstance(value, list) and name != "collector_labels" else value
        rows.append(tuple(row[name] for name in MANIFEST.fieldNames()))
    return spark.createDataFrame(rows, MANIFEST)


def catalogue(spark, *rules, task_id=None):
    """Rules of (name, type[, required])."""
    rows = [("s", "m", i, r[0], r[1], r[2] if len(r) > 2 else True, task_id) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, CATALOGUE)


def parse(spark, texts, rules, limits=None, **overrides):
    extra = {} if limits is None else {"limits": limits}
    return parse_payloads(
        payload_frame(spark, texts),
        manifest(spark, len(texts), **overrides),
        catalogue(spark, *rules),
        **extra,
    )


def errors(parsed):
    rows = parsed.filter("kind = 'scrape'").select("scrape_id", "scrape_error").collect()
    return {row.scrape_id: row.scrape_error for row in rows}


def sample_rows(parsed, scrape_id=0):
    rows = parsed.filter("kind = 'sample'").filter(F.col("scrape_id") == scrape_id)
    return sorted(rows.collect(), key=lambda row: row.line_no)
