"""Exposition text to samples, with one verdict per scrape.

Everything runs in one pass: the payloads are shuffled a single time, whole, by scrape, and then
split, and lines outside the allow-list are dropped at once. So the work on lines is spread however
few files the payloads came in, and no line is shuffled with the columns it carries. A scrape is
bounded by the payload cap, so no scrape can make a task grow with the data. The later windows all
partition by the scrape first and need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from scrapelake.functions import labels as L
from scrapelake.functions import lines as X
from scrapelake.functions import messages as M
from scrapelake.functions import values as V
from scrapelake.schema import LAST_LINE, LINE_BITS, Limits
from scrapelake.sources.payloads import payload_text, response_fault
from scrapelake.sources.tables import expand_rules, required_families, with_defaults

SCRAPE = ["scrape_id"]

# The first error of a scrape is the one with the lowest key: phase, then place in the payload.
_RESPONSE, _LINE, _REQUIRED, _HISTOGRAM, _SUMMARY, _MERGED = range(6)


def _error_key(phase: int, place: Column) -> Column:
    return F.lit(phase << 32).cast("bigint") + place.cast("bigint")


def _error(phase: int, place: Column, text: Column) -> Column:
    return F.when(
        text.isNotNull(),
        F.struct(_error_key(phase, place).alias("at"), text.alias("text")),
    )


#: Bytes of payloads whose lines one task sorts.
TASK_BYTES = 8 << 20


def parse_tasks(payloads: DataFrame, limits: Limits = Limits()) -> int:
    """How many tasks should share the lines of ``payloads``, by their lengths, which are read for it:
    the payloads should be stored. Never fewer than a shuffle has."""
    read = F.when(F.col("length") <= limits.body_bytes, F.col("length"))
    total = payloads.agg(F.sum(read)).first()[0] or 0
    return max(int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def payload_lines(
    payloads: DataFrame,
    manifest: DataFrame,
    catalogue: DataFrame,
    limits: Limits = Limits(),
    tasks: int | None = None,
) -> DataFrame:
    """One row per line worth keeping, with the rule it falls under. The rows of a scrape are in one
    partition, of which there are ``tasks``, if given.

    Every payload also gives one row of kind ``scrape`` (line 0), which carries the refusal of
    the response if there is one, and one row of kind ``require`` per required family.
    """
    if "payload_error" not in payloads.columns:
        payloads = payloads.withColumn("payload_error", F.lit(None).cast("string"))
    named = payloads.join(with_defaults(manifest), "path").join(
        required_families(catalogue), "task_id", "left"
    )
    dealt = named.repartition(*SCRAPE) if tasks is None else named.repartition(tasks, *SCRAPE)
    attributed = (
        dealt
        .withColumn("refused", F.coalesce(response_fault(limits), "payload_error"))
        .withColumns(
            {
                "text": F.when(F.col("refused").isNull(), payload_text()),
                "own_labels": L.own_labels(F.col("collector_labels"), F.col("resolved_ip")),
            }
        )
        .withColumn(
            "refused",
            F.coalesce("refused", F.when(F.col("text").isNull(), F.lit(M.NOT_UTF8))),
        )
        .withColumn("required", F.coalesce("required", F.array().cast("array<string>")))
    )
    carried = [
        "system",
        "module",
        "honor_labels",
        "honor_timestamps",
        "resolved_ip",
        "collector_labels",
        "own_labels",
        "started_at_ms",
        "finished_at_ms",
        "refused",
    ]
    pieces = F.concat(
        F.array(F.lit("")),
        F.when(F.col("refused").isNull(), F.concat("required", F.split("text", "\n"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    pos, n_required = F.col("pos"), F.col("n_required")
    lines = attributed.select(
        *SCRAPE, "task_id", *carried, F.size("required").alias("n_required"), F.posexplode(pieces)
    ).withColumns(
        {
            "line": F.col("col"),
            "line_no": F.when(pos <= n_required, pos).otherwise(pos - n_required),
            "section": F.when(pos == 0, "scrape").when(pos <= n_required, "require"),
        }
    )
    name = X.metric_name(F.col("line"))
    is_text = F.col("section").isNull()
    directive = F.regexp_extract("line", X.DIRECTIVE, 1)
    classified = (
        lines.filter(~is_text | ~F.col("line").rlike(X.BLANK))
        .withColumn(
            "kind",
            F.coalesce(
                "section",
                F.when(
                    F.col("line").rlike(X.COMMENT),
                    F.when(directive != "", "directive").otherwise("comment"),
                ),
                F.when(name == "", "unnamed"),
                F.lit("sample"),
            ),
        )
        .filter("kind <> 'comment'")
        .withColumns(
            {
                "lookup": F.when(F.col("kind") == "sample", "sample").when(
                    F.col("kind") == "directive", "family"
                ),
                "lookup_name": F.when(F.col("kind") == "sample", name).when(
                    F.col("kind") == "directive", F.regexp_extract("line", X.DIRECTIVE, 2)
                ),
            }
        )
    )
    return (
        classified.join(
            expand_rules(catalogue), ["task_id", "lookup", "lookup_name"], "left"
        )
        .filter("kind <> 'sample' OR rule IS NOT NULL")
        .select(
            *SCRAPE,
            *carried,
            "line_no",
            "kind",
            "line",
            F.col("lookup_name").alias("metric_name"),
            F.when(F.col("kind") == "require", F.col("line"))
            .otherwise(F.col("rule.family_name"))
            .alias("family_name"),
            F.col("rule.metric_type").alias("metric_type"),
            F.col("rule.component").alias("component"),
        )
    )


def _directive_fault() -> Column:
    """Only directives that name a selected family can fail."""
    word, rest = F.col("directive"), F.col("directive_text")
    observed = X.first_word(rest)
    return F.when(
        F.col("family_name").isNotNull(),
        F.when(
            word.isin("TYPE", "UNIT") & (rest == ""),
            M.text(M.INVALID_DIRECTIVE, word, F.col("family_name")),
        ).when(
            (word == "TYPE") & (observed != F.col("metric_type")),
            M.text(M.TYPE_MISMATCH, F.col("family_name"), F.col("metric_type"), observed),
        ),
    )


def read_lines(lines: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Sample lines to labels, value and timestamp; directive lines to their text.

    ``error`` holds what is wrong with the line alone.
    """
    is_sample = F.col("kind") == "sample"
    is_directive = F.col("kind") == "directive"
    line = F.col("line")

    split = lines.withColumn("well_formed", is_sample & X.is_sample(line)).withColumns(
        {
            "tokens": F.when(F.col("well_formed"), X.sample_tokens(line)),
            "label_text": F.when(F.col("well_formed"), X.label_text(line)),
            "directive": F.when(is_directive, F.regexp_extract(line, X.DIRECTIVE, 1)),
            "directive_text": F.when(is_directive, F.regexp_extract(line, X.DIRECTIVE, 3)),
        }
    )
    tokens = split.withColumns(
        {
            "label_names": X.label_names(F.col("label_text")),
            "label_values": X.label_values(F.col("label_text")),
            "number": V.number_from_text(F.get("tokens", F.lit(0))),
            "time_number": V.number_from_text(F.get("tokens", F.lit(1))),
            "has_time": F.size("tokens") > 1,
        }
    )
    names = F.col("label_names")
    syntax_ok = (
        F.col("well_formed")
        & F.col("number").isNotNull()
        & (~F.col("has_time") | F.col("time_number").isNotNull())
        & (F.size(names) == F.size(F.array_distinct(names)))
    )
    syntax_ok = F.coalesce(syntax_ok, F.lit(False))
    labelled = tokens.withColumns(
        {
            "syntax_ok": syntax_ok,
            "labels": F.when(syntax_ok, F.map_from_arrays("label_names", "label_values")),
            "source_ms": X.timestamp_ms(F.col("time_number")),
        }
    ).withColumns(
        {
            "label_fault": L.label_fault(F.col("labels"), limits),
            "merged_labels": L.merge_labels(
                F.col("labels"),
                F.col("collector_labels"),
                F.col("honor_labels"),
                F.col("resolved_ip"),
                F.col("own_labels"),
            ),
        }
    )
    honored = F.col("has_time") & F.col("honor_timestamps")
    sample_fault = (
        F.when(~F.col("syntax_ok"), M.text(M.INVALID_TEXT, line))
        .when(F.col("label_fault").isNotNull(), F.col("label_fault"))
        .when(honored & F.col("source_ms").isNull(), M.text(M.INVALID_TEXT, line))
    )
    component_fault = F.when(
        (F.col("metric_type") == "histogram")
        & (F.col("component") == "bucket")
        & ~F.map_contains_key("labels", F.lit("le")),
        M.text(M.BUCKET_WITHOUT_LE, F.col("family_name")),
    ).when(
        (F.col("metric_type") == "summary")
        & (F.col("component") == "")
        & ~F.map_contains_key("labels", F.lit("quantile")),
        M.text(M.SAMPLE_WITHOUT_QUANTILE, F.col("family_name")),
    )
    compound = F.col("metric_type").isin("histogram", "summary")
    group_labels = F.when(
        F.col("component") == "bucket", L.without_label(F.col("labels"), "le")
    ).when(F.col("component") == "", L.without_label(F.col("labels"), "quantile")).otherwise(
        F.col("labels")
    )
    return labelled.select(
        *SCRAPE,
        "system",
        "module",
        "line_no",
        "kind",
        F.when(F.col("kind") == "unnamed", line).alias("line"),
        "metric_name",
        "family_name",
        "metric_type",
        "component",
        F.col("merged_labels").alias("labels"),
        F.when(is_sample & compound, L.labels_key(group_labels)).alias("group_key"),
        F.when(is_sample & (F.col("component") == "bucket"), F.col("labels")["le"]).alias("le"),
        "number",
        F.when(honored, F.col("source_ms"))
        .otherwise(F.col("started_at_ms"))
        .alias("sample_timestamp_ms"),
        F.col("finished_at_ms").alias("collected_at_ms"),
        "directive",
        "directive_text",
        F.coalesce(
            _error(_RESPONSE, F.col("line_no"), F.col("refused")),
            _error(_LINE, F.col("line_no"), F.when(is_directive, _directive_fault())),
            _error(_LINE, F.col("line_no"), F.when(is_sample, sample_fault)),
        ).alias("error"),
        # Checked after the running sample count, which comes before it in the payload's order.
        F.when(is_sample, component_fault).alias("component_fault"),
        _error(
            _MERGED,
            F.col("line_no"),
            F.when(is_sample, L.label_fault(F.col("merged_labels"), limits, merged=True)),
        ).alias("merged_error"),
    )


def judge(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Whole-scrape checks. ``scrape_error`` is the first error of the scrape, on every row."""
    scrape = W.partitionBy(*SCRAPE)
    in_order = scrape.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    family = W.partitionBy(*SCRAPE, "family_name")
    group = W.partitionBy(*SCRAPE, "family_name", "group_key", "sample_timestamp_ms")
    line_no, kind = F.col("line_no"), F.col("kind")
    is_sample = kind == "sample"
    selects = F.when(kind.isin("sample", "directive"), F.col("family_name").isNotNull())

    ordered = rows.withColumns(
        {
            "in_selected": F.last(selects, ignorenulls=True).over(in_order),
            "sample_no": F.count(F.when(is_sample, 1)).over(in_order),
        }
    ).withColumn(
        "error",
        F.coalesce(
            "error",
            _error(
                _LINE,
                line_no,
                F.when(
                    (kind == "unnamed") & F.col("in_selected"),
                    M.text(M.INVALID_TEXT, F.col("line")),
                )
                .when(
                    is_sample & (F.col("sample_no") > limits.samples),
                    M.text(M.SAMPLE_LIMIT, limits.samples),
                )
                .when(is_sample, F.col("component_fault")),
            ),
            "merged_error",
        ),
    )

    def latest(component: str, extra: Column | None = None) -> Column:
        here = F.col("component") == component
        return F.when(is_sample & (here if extra is None else here & extra), line_no)

    number = F.col("number")
    in_compound = is_sample & F.col("group_key").isNotNull()
    grouped = ordered.withColumns(
        {
            "first_line": F.min(F.when(in_compound, line_no)).over(group),
            "inf_line": F.max(latest("bucket", F.col("le") == "+Inf")).over(group),
            "inf_number": F.max_by(number, latest("bucket", F.col("le") == "+Inf")).over(group),
            "count_line": F.max(latest("count")).over(group),
            "count_number": F.max_by(number, latest("count")).over(group),
            "sum_line": F.max(latest("sum")).over(group),
            "quantile_line": F.max(latest("")).over(group),
        }
        # In a step of its own, above: the sort for the groups then serves the families too.
    ).withColumn("family_seen", F.max(is_sample).over(family))
    has_total = F.col("count_line").isNotNull() & F.col("sum_line").isNotNull()
    histogram_fault = F.when(
        F.col("inf_line").isNull() | ~has_total, M.text(M.INCOMPLETE_HISTOGRAM, F.col("family_name"))
    ).when(
        ~F.col("inf_number").eqNullSafe(F.col("count_number")),
        M.text(M.COUNT_MISMATCH, F.col("family_name")),
    )
    summary_fault = F.when(
        F.col("quantile_line").isNull() | ~has_total,
        M.text(M.INCOMPLETE_SUMMARY, F.col("family_name")),
    )
    structure_error = F.coalesce(
        _error(
            _REQUIRED,
            line_no,
            F.when(
                (kind == "require") & ~F.col("family_seen"),
                M.text(M.MISSING_FAMILY, F.col("family_name")),
            ),
        ),
        _error(
            _HISTOGRAM,
            F.col("first_line"),
            F.when(in_compound & (F.col("metric_type") == "histogram"), histogram_fault),
        ),
        _error(
            _SUMMARY,
            F.col("first_line"),
            F.when(in_compound & (F.col("metric_type") == "summary"), summary_fault),
        ),
    )
    errors = F.array_min(F.array_compact(F.array(F.col("error"), structure_error)))
    judged = grouped.withColumn("row_error", errors).withColumns(
        {
            "scrape_error": F.min("row_error").over(scrape),
            "sample_count": F.count(F.when(is_sample, 1)).over(scrape),
        }
    )
    return judged.filter(kind.isin("scrape", "sample", "directive")).select(
        *SCRAPE,
        "system",
        "module",
        "line_no",
        "kind",
        "metric_name",
        "family_name",
        "metric_type",
        "labels",
        L.labels_key(F.col("labels")).alias("labels_key"),
        V.finite_value(number).alias("value"),
        V.special_text(number).alias("value_repr"),
        "sample_timestamp_ms",
        "collected_at_ms",
        "directive",
        "directive_text",
        F.substring("scrape_error.text", 1, limits.error_chars).alias("scrape_error"),
        "sample_count",
    )


def parse_payloads(
    payloads: DataFrame,
    manifest: DataFrame,
    catalogue: DataFrame,
    limits: Limits = Limits(),
    tasks: int | None = None,
) -> DataFrame:
    """All rows the sinks need: one ``scrape`` row per payload with its verdict and sample
    count, and its ``sample`` and ``directive`` rows. Labels are already merged. ``tasks``, as
    ``parse_tasks`` tells, keeps what a task sorts bounded as the payloads grow."""
    return judge(
        read_lines(payload_lines(payloads, manifest, catalogue, limits, tasks), limits), limits
    )


def accepted_samples(parsed: DataFrame) -> DataFrame:
    """Samples of the scrapes without any error, with identity and write order."""
    return parsed.filter("kind = 'sample' AND scrape_error IS NULL").select(
        "system",
        "module",
        L.series_id(F.col("metric_name"), F.col("labels_key")).alias("series_id"),
        "metric_name",
        "family_name",
        "metric_type",
        "labels_key",
        "sample_timestamp_ms",
        "value",
        "value_repr",
        "scrape_id",
        "collected_at_ms",
        order_key(F.col("scrape_id"), F.col("line_no")).alias("order_key"),
    )


def order_key(scrape_id: Column, line_no: Column) -> Column:
    """Write order as one number. Scrape ids ascend in write order; lines follow the payload,
    and generated samples (no line) come last."""
    place = F.coalesce(line_no.cast("bigint"), F.lit(LAST_LINE).cast("bigint"))
    return F.shiftleft(scrape_id.cast("bigint"), LINE_BITS) + place


def _directive_texts() -> dict[str, Column]:
    text = F.col("directive_text")
    return {
        "help": F.when((F.col("directive") == "HELP") & (text != ""), text),
        "unit": F.when(F.col("directive") == "UNIT", X.first_word(text)),
    }


def _accepted_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(
        "kind <> 'scrape' AND family_name IS NOT NULL AND scrape_error IS NULL"
    )


def with_help(parsed: DataFrame) -> DataFrame:
    """Adds the HELP and UNIT texts in force at each sample of an accepted scrape."""
    carried = (
        W.partitionBy(*SCRAPE, "family_name")
        .orderBy("line_no")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    texts = _directive_texts()
    return (
        _accepted_lines(parsed)
        .withColumns({n: F.last(t, ignorenulls=True).over(carried) for n, t in texts.items()})
        .filter("kind = 'sample'")
    )


def last_metadata(parsed: DataFrame) -> DataFrame:
    """Type, help and unit of every family as of its last sample; a missing help or unit
    replaces an earlier one, as any other text would.

    The samples are only searched for the last one of each family, by a hash aggregate. The
    texts in force there come from the few directives of that one scrape, so no sample is
    shuffled with its texts.
    """
    family = ["system", "module", "family_name"]
    lines = _accepted_lines(parsed)
    order = order_key(F.col("scrape_id"), F.col("line_no"))
    last = (
        lines.filter("kind = 'sample'")
        .groupBy(*family, "metric_type")
        .agg(
            F.max(order).alias("order_key"),
            F.max_by("collected_at_ms", order).alias("updated_at_ms"),
        )
        .withColumn(
            "place",
            F.row_number().over(W.partitionBy(*family).orderBy(F.col("order_key").desc())),
        )
        .filter("place = 1")
    )
    directives = lines.filter("kind = 'directive'").select(
        "family_name",
        "scrape_id",
        order.alias("said_at"),
        *[text.alias(name) for name, text in _directive_texts().items()],
    )
    said_at = F.col("said_at")
    before = F.when(said_at < F.col("order_key"), said_at)
    return (
        last.withColumn("scrape_id", F.shiftright("order_key", LINE_BITS))
        .join(directives, ["family_name", "scrape_id"], "left")
        .groupBy(*family, "metric_type", "updated_at_ms", "order_key")
        .agg(
            *[
                F.max_by(name, F.when(F.col(name).isNotNull(), before)).alias(name)
                for name in ("help", "unit")
            ]
        )
    )
