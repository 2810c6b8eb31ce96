"""Metric tables derived from the driver's tables, as described in ``FIXTURES.md``.

Everything is computed by Spark from whole tables and grows with them.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrapelake.functions import labels as L
from scrapelake.functions import values as V
from scrapelake.operators.upsert import first_series, with_identity
from scrapelake.schema import DAY_MS, MANIFEST, PAYLOADS, SERIES
from scrapelake.session import materialize
from scrapelake.sources.tables import assemble_manifest

AT_MS = 1_705_276_800_000
HISTOGRAM_AT_MS = 946_684_800_000
YEAR_MS = 365 * DAY_MS
EVENTS_PER_PAYLOAD = 250
FOLDER_PAYLOADS = 100
FAULTS = 13
BOUNDS = ("10", "20", "30", "40", "+Inf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Epoch ms of a zoneless timestamp read as UTC, floored, whatever the session zone."""
    whole = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * DAY_MS
    clock = F.hour(ts) * F.lit(3_600_000) + F.minute(ts) * F.lit(60_000)
    seconds = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return whole + clock + seconds.cast("bigint")


def _strings(*pairs: tuple[str, Column]) -> Column:
    return F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])


def _with_optional(base: Column, test: Column, name: str, value: Column) -> Column:
    return F.when(test, F.map_concat(base, _strings((name, value)))).otherwise(base)


def special_value() -> Column:
    event = F.col("event_id")
    return (
        F.when(event % 97 == 0, "NaN").when(event % 101 == 0, "+Inf").when(event % 103 == 0, "-Inf")
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in ms, the labels they get and a value or special value."""
    user = F.col("user_id").cast("string")
    labels = _strings(("event_type", F.col("event_type")), ("user", user))
    repr_ = special_value()
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("value").alias("raw_value"),
        millis(F.col("ts")).alias("ts_ms"),
        _with_optional(labels, F.col("user_id") % 3 == 0, "tier", F.lit("gold")).alias("labels"),
        F.when(repr_.isNull(), F.col("value")).alias("value"),
        repr_.alias("value_repr"),
    )


def _gauge(rows: DataFrame, ts: Column) -> DataFrame:
    return with_identity(
        rows.select(
            F.lit("event_value").alias("metric_name"),
            F.lit("event_value").alias("family_name"),
            F.lit("gauge").alias("metric_type"),
            "labels",
            ts.alias("sample_timestamp_ms"),
            "value",
            "value_repr",
            F.col("event_id").alias("scrape_id"),
            (F.col("ts_ms") + 10).alias("collected_at_ms"),
            F.col("event_id").alias("order_key"),
        )
    ).withColumn("sample_date", V.sample_date(F.col("sample_timestamp_ms")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gauge(events(spark, sf_dir), F.col("ts_ms"))


def upsert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times cut to the day, so that keys collide."""
    return _gauge(events(spark, sf_dir), F.floor(F.col("ts_ms") / DAY_MS) * DAY_MS)


def series_of(rows: DataFrame) -> DataFrame:
    return first_series(rows).select(*SERIES.fieldNames())


def _components(groups: DataFrame, family: str, metric_type: str, parts: Column) -> DataFrame:
    """``parts`` is an array of (suffix, bound label or NULL, bound, value) per group."""
    rows = groups.select("labels", "ts_ms", F.inline(parts))
    labels = F.when(F.col("bound").isNull(), F.col("labels")).otherwise(
        F.map_concat("labels", F.create_map("bound_label", "bound"))
    )
    return with_identity(
        rows.select(
            F.concat(F.lit(family), "suffix").alias("metric_name"),
            F.lit(family).alias("family_name"),
            F.lit(metric_type).alias("metric_type"),
            labels.alias("labels"),
            F.col("ts_ms").alias("sample_timestamp_ms"),
            "value",
            F.lit(None).cast("string").alias("value_repr"),
            F.lit(1).cast("bigint").alias("scrape_id"),
            (F.col("ts_ms") + 10).alias("collected_at_ms"),
            F.col("ts_ms").alias("order_key"),
        )
    ).withColumn("sample_date", V.sample_date(F.col("sample_timestamp_ms")))


def _part(suffix: str, bound_label: str | None, bound: Column | None, value: Column) -> Column:
    return F.struct(
        F.lit(suffix).alias("suffix"),
        F.lit(bound_label).cast("string").alias("bound_label"),
        (F.lit(None) if bound is None else bound).cast("string").alias("bound"),
        value.cast("double").alias("value"),
    )


def _exact_sum(value: str) -> Column:
    return F.sum(F.col(value).cast("decimal(18,2)")).cast("double")


def _by_month(rows: DataFrame, ts: str) -> DataFrame:
    first_day = F.trunc(F.col(ts), "month")
    days = F.datediff(first_day, F.lit("1970-01-01").cast("date")).cast("bigint")
    return rows.withColumn("ts_ms", days * DAY_MS)


def histogram_samples(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """``line_quantity`` by return flag and line status, one histogram per ship month.

    ``broken`` puts one fault into each group, chosen by its month.
    """
    lines = _by_month(table(spark, sf_dir, "lineitem"), "l_shipdate")
    quantity = F.col("l_quantity")
    groups = lines.groupBy("l_returnflag", "l_linestatus", "ts_ms").agg(
        *[
            F.count_if(quantity <= float(b)).alias(f"le_{b}")
            for b in BOUNDS
        ],
        _exact_sum("l_quantity").alias("total"),
    )
    labels = _strings(("flag", F.col("l_returnflag")), ("status", F.col("l_linestatus")))
    count = F.col("le_+Inf")
    fault = month_fault(6) if broken else F.lit(0)
    candidates = [
        (F.lit(True), _part("_bucket", "le", F.lit(b), F.col(f"le_{b}"))) for b in BOUNDS[:-1]
    ] + [
        (fault != 1, _part("_bucket", "le", F.lit("+Inf"), count)),
        (fault != 2, _part("_count", None, None, count + F.when(fault == 4, 1).otherwise(0))),
        (fault != 3, _part("_sum", None, None, F.col("total"))),
        (fault == 5, _part("_bucket", None, None, count)),
    ]
    parts = F.array_compact(F.array(*[F.when(test, part) for test, part in candidates]))
    return _components(
        groups.withColumn("labels", labels), "line_quantity", "histogram", parts
    )


def month_fault(n: int) -> Column:
    """Which fault a month gets: its number since 1970, modulo ``n``."""
    date = F.date_from_unix_date(F.floor(F.col("ts_ms") / DAY_MS).cast("int"))
    return (F.year(date) * 12 + F.month(date)) % n


def summary_samples(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """``order_price`` by priority, one summary per month of order: the least, middle and
    greatest price as quantiles 0, 0.5 and 1, and the sum in hundreds."""
    orders = _by_month(table(spark, sf_dir, "orders"), "o_orderdate")
    groups = orders.groupBy("o_orderpriority", "ts_ms").agg(
        F.min("o_totalprice").alias("low"),
        F.max("o_totalprice").alias("high"),
        F.count("*").alias("n"),
        (_exact_sum("o_totalprice") / 100).alias("total"),
    )
    cents = F.rint(F.col("low") * 100) + F.rint(F.col("high") * 100)
    middle = F.floor(cents / 2) / 100
    fault = month_fault(5) if broken else F.lit(0)
    candidates = [
        (fault != 1, _part("", "quantile", F.lit("0"), F.col("low"))),
        (fault != 1, _part("", "quantile", F.lit("0.5"), middle)),
        (fault != 1, _part("", "quantile", F.lit("1"), F.col("high"))),
        (fault != 2, _part("_count", None, None, F.col("n"))),
        (fault != 3, _part("_sum", None, None, F.col("total"))),
        (fault == 4, _part("", None, None, F.col("low"))),
    ]
    parts = F.array_compact(F.array(*[F.when(test, part) for test, part in candidates]))
    labels = _strings(("priority", F.col("o_orderpriority")))
    return _components(groups.withColumn("labels", labels), "order_price", "summary", parts)


def payload_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn(
        "payload_no", F.floor(F.col("event_id") / EVENTS_PER_PAYLOAD)
    )


def _payload_groups(rows: DataFrame) -> DataFrame:
    value = F.col("raw_value")
    return rows.groupBy("payload_no").agg(
        F.max("ts_ms").alias("last_ms"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        *[F.count_if(value <= float(b)).alias(f"le_{b}") for b in BOUNDS],
        _exact_sum("raw_value").alias("total"),
    )


def _money(value: Column) -> Column:
    return value.cast("decimal(18,2)").cast("string")


def fault_of(broken: bool) -> Column:
    return F.col("payload_no") % FAULTS if broken else F.lit(0)


def payloads(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """One exposition text per 250 consecutive events, in the schema of landed files.

    The text holds a gauge line per event, lines outside the allow-list (some malformed), HELP
    texts that change on the way, and a histogram and a summary of the payload. ``broken``
    adds one fault per payload, chosen by its number.
    """
    rows = payload_events(spark, sf_dir)
    event, place = F.col("event_id"), F.col("event_id") % EVENTS_PER_PAYLOAD
    pairs = F.concat_ws(
        ",",
        F.concat(F.lit('event_type="'), "event_type", F.lit('"')),
        F.when(F.col("user_id") % 3 == 0, 'tier="gold"'),
        F.concat(F.lit('user="'), F.col("user_id").cast("string"), F.lit('"')),
    )
    gauge = F.concat(
        F.lit("event_value{"),
        pairs,
        F.lit("} "),
        F.coalesce("value_repr", _money(F.col("value"))),
        F.lit(" "),
        F.col("ts_ms").cast("string"),
    )
    event_lines = F.array_compact(
        F.array(
            F.when(place == 100, "# HELP event_value revised help"),
            F.when(place == 200, "# UNIT event_value points"),
            F.when(event % 10 == 0, F.concat(F.lit('ignored_total{e="'), event, F.lit('"} 1'))),
            F.when(event % 50 == 0, "ignored{not closed 2"),
            gauge,
        )
    )
    body = rows.select(
        "payload_no",
        F.lit(1).alias("section"),
        event.alias("place"),
        F.array_join(event_lines, "\n").alias("text"),
    )
    fault = fault_of(broken)
    groups = _payload_groups(rows)

    def bucket(bound: str) -> Column:
        return F.concat(F.lit(f'batch_value_bucket{{le="{bound}"}} '), F.col(f"le_{bound}"))

    histogram = F.concat_ws(
        "\n",
        F.lit("# HELP batch_value values of one payload"),
        F.lit("# TYPE batch_value histogram"),
        *map(bucket, BOUNDS),
        F.concat(F.lit("batch_value_sum "), _money(F.col("total"))),
        F.concat(
            F.lit("batch_value_count "), F.col("le_+Inf") + F.when(fault == 9, 1).otherwise(0)
        ),
    )
    quantiles = F.concat_ws(
        "\n",
        F.concat(F.lit('batch_quantile{quantile="0"} '), _money(F.col("low"))),
        F.concat(F.lit('batch_quantile{quantile="1"} '), _money(F.col("high"))),
    )
    summary = F.concat_ws(
        "\n",
        F.lit("# TYPE batch_quantile summary"),
        F.when(fault != 10, quantiles),
        F.concat(F.lit("batch_quantile_sum "), _money(F.col("total"))),
        F.concat(F.lit("batch_quantile_count "), F.col("le_+Inf")),
    )
    fault_text = (
        F.when(fault == 2, "# TYPE event_value counter")
        .when(fault == 3, 'event_value{user="1" 5')
        .when(fault == 4, F.repeat(F.lit("event_value 1\n"), 400))
        .when(fault == 5, F.concat(F.lit('event_value{note="'), F.repeat(F.lit("x"), 1025), F.lit('"} 1')))
        .when(fault == 11, 'event_value 1\n{user="1"} 5')
        .when(fault == 12, "batch_value_bucket 3")
    )
    head = F.lit("# HELP event_value value of one event\n# TYPE event_value gauge")
    texts = {0: head, 2: F.when(fault != 6, histogram), 3: summary, 4: fault_text}
    sections = F.array(
        *[F.struct(F.lit(n).alias("section"), t.alias("text")) for n, t in texts.items()]
    )
    frame = groups.select("payload_no", F.inline(sections)).filter("text IS NOT NULL")
    whole = body.unionByName(frame.withColumn("place", F.lit(0).cast("bigint")))
    # A payload holds 250 events whatever the scale, so the list is short.
    texts = whole.groupBy("payload_no").agg(
        F.sort_array(F.collect_list(F.struct("section", "place", "text"))).alias("pieces")
    )
    text = F.encode(F.array_join(F.col("pieces.text"), "\n"), "UTF-8")
    content = F.when(fault == 1, F.concat(text, F.unhex(F.lit("0AFF")))).otherwise(text)
    return texts.select(
        payload_path().alias("path"),
        F.timestamp_millis(F.col("payload_no") * 1000).alias("modificationTime"),
        F.octet_length(content).cast("bigint").alias("length"),
        content.alias("content"),
    )


def payload_path() -> Column:
    return F.concat(F.lit("landed/payload_no="), F.col("payload_no").cast("string"))


def manifest(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """One scrape per payload, eight to a run. With ``broken`` some responses were refused
    and some targets never resolved."""
    number = F.col("payload_no")
    fault = fault_of(broken)
    unresolved = (number % 17 == 16) if broken else F.lit(False)
    groups = payload_events(spark, sf_dir).groupBy("payload_no").agg(
        F.max("ts_ms").alias("last_ms")
    )
    pair = "struct<name: string, value: string>"

    def entry(name: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))

    ip = F.when(number % 5 == 0, F.concat(F.lit("2001:db8::"), number)).otherwise(
        F.concat(F.lit("10.0."), F.floor(number / 200) % 200, F.lit("."), number % 200)
    )
    targets = groups.select(
        F.floor(number / 8).alias("run_id"),
        number.alias("scrape_id"),
        (number % 8).cast("int").alias("scrape_ordinal"),
        F.when(~unresolved, payload_path()).alias("path"),
        F.lit("shop").alias("system"),
        F.concat(F.lit("m"), number % 4).alias("module"),
        F.lit(None).cast("string").alias("job"),
        F.concat(F.lit("http://t"), number, F.lit(".example/metrics")).alias("logical_url"),
        F.when(unresolved, "").otherwise(ip).alias("resolved_ip"),
        F.lit(9090).alias("port"),
        entry("cluster", F.concat(F.lit("c"), number % 3)).alias("task_labels"),
        entry("role", F.lit("primary")).cast(f"array<{pair}>").alias("target_labels"),
        (number % 2 == 0).alias("honor_labels"),
        (number % 7 != 0).alias("honor_timestamps"),
        F.lit(False).alias("allow_missing_content_type"),
        F.when(~unresolved, F.when(fault == 7, "application/json").otherwise("text/plain; version=0.0.4")).alias("content_type"),
        F.when(~unresolved, F.when(fault == 8, 503).otherwise(200)).alias("http_status"),
        (number % 3 + 1).cast("int").alias("attempts"),
        (F.col("last_ms") + 1000).alias("started_at_ms"),
        (F.col("last_ms") + 1100 + number % 50).alias("finished_at_ms"),
        F.when(unresolved, F.concat(F.lit("cannot resolve t"), number)).alias("fetch_error"),
    )
    return assemble_manifest(targets)


def catalogue(spark: SparkSession) -> DataFrame:
    """The allow-list of the four modules: configuration, not data."""
    modules = F.explode(F.array(*[F.lit(f"m{i}") for i in range(4)])).alias("module")
    rules = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                F.lit(name).alias("name"),
                F.lit(kind).alias("metric_type"),
                F.lit(required).alias("required"),
            )
            for i, (name, kind, required) in enumerate(
                [
                    ("event_value", "gauge", True),
                    ("batch_value", "histogram", True),
                    ("batch_quantile", "summary", False),
                ]
            )
        ]
    )
    one = spark.range(1).select(F.lit("shop").alias("system"), modules)
    return one.select("system", "module", F.inline(rules))


def rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows from ``part``, with bad and repeated ones among them."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.when(key % 11 == 0, "").otherwise(F.col("p_brand")).alias("system"),
        F.concat(F.lit("m"), key % 7).alias("module"),
        key.cast("int").alias("ordinal"),
        F.when(key % 13 == 0, F.concat(F.lit("9bad-"), key % 50))
        .otherwise(F.concat(F.lit("metric_"), key % 50))
        .alias("name"),
        F.when(key % 17 == 0, "rate").otherwise("gauge").alias("metric_type"),
        F.lit(True).alias("required"),
    )


def target_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows from ``customer``, with bad ones among them."""
    key = F.col("c_custkey")
    names = F.array(
        F.lit("region"),
        F.when(key % 7 == 0, "9bad").otherwise("role"),
        F.when(key % 9 == 0, "region").otherwise("zone"),
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("scrape_id"),
        F.concat(F.lit("landed/"), F.floor(key / 2) * 2 + F.when(key % 10 == 1, 0).otherwise(key % 2)).alias("path"),
        F.when(key % 11 == 0, " ").otherwise(F.concat(F.lit("Brand#"), key % 30)).alias("system"),
        F.concat(F.lit("m"), key % 9).alias("module"),
        F.concat(
            F.when(key % 13 == 0, "ftp").otherwise("http"), F.lit("://t"), key, F.lit("/metrics")
        ).alias("logical_url"),
        F.transform(
            names, lambda n: F.struct(n.alias("name"), F.lit("v").alias("value"))
        ).alias("collector_labels"),
    )


#: Bytes a decoded payload may have in the query of compressed payloads.
BODY_CAP = 100_000


def compressed(rows: DataFrame) -> DataFrame:
    """Payloads as a transport would pack them, by ``scrape_id`` modulo 6: plain, gzip, deflate, gzip
    cut short, gzip of far more than the cap, and bytes of some other encoding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for number, content in zip(batch["scrape_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                kind = number % 6
                if kind == 2:
                    content = zlib.compress(content)
                elif kind in (1, 3, 4):
                    content = gzip.compress(content + b"#" * (50 * BODY_CAP if kind == 4 else 0))
                packed.append(content[: len(content) // 2] if kind == 3 else content)
            columns = [batch["path"], batch["modificationTime"], pa.array(map(len, packed), pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, PAYLOADS.fieldNames())

    return rows.mapInArrow(run, PAYLOADS)


def land(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Writes every payload as a text file of its own and the manifest of the files beside
    them, and returns the manifest. Files stand in folders of ``FOLDER_PAYLOADS``: what lists them
    takes a task for each."""
    number = F.regexp_extract("path", "payload_no=([0-9]+)", 1)
    rows = payloads(spark, sf_dir).select(
        F.floor(number.try_cast("bigint") / FOLDER_PAYLOADS).alias("group_no"),
        number.alias("payload_no"),
        F.col("content").cast("string").alias("value"),
    )
    rows.write.partitionBy("group_no", "payload_no").text(folder)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.txt")
        .load(folder)
        .select("path", F.regexp_extract("path", "payload_no=([0-9]+)", 1).alias("landed_no"))
    )
    planned = manifest(spark, sf_dir).drop("path")
    joined = planned.join(files, planned["scrape_id"].cast("string") == files["landed_no"])
    return materialize(joined.select(*MANIFEST.fieldNames()), f"{folder}-manifest")
