"""Scrape manifest and metric catalogue, and the data-quality jobs over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from scrapelake.functions.labels import collector_labels, usable_entries
from scrapelake.schema import (
    CATALOGUE,
    LABEL_NAME,
    MANIFEST,
    MAX_SCRAPE_ID,
    METRIC_NAME,
    METRIC_TYPES,
)


def _read(spark: SparkSession, path: str, format: str, schema: T.StructType) -> DataFrame:
    return spark.read.format(format).schema(schema).load(path)


def read_manifest(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, format, MANIFEST)


def read_catalogue(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, path, format, CATALOGUE)


def _task(rows: DataFrame) -> Column:
    given = F.col("task_id") if "task_id" in rows.columns else F.lit(None).cast("string")
    named = F.concat_ws("/", F.coalesce("system", F.lit("")), F.coalesce("module", F.lit("")))
    return F.coalesce(given, named)


def with_task(rows: DataFrame) -> DataFrame:
    """Manifest or catalogue rows with their ``task_id``. Tasks may share a system and module;
    where none is given, these two name the task."""
    return rows.withColumn("task_id", _task(rows))


def assemble_manifest(targets: DataFrame) -> DataFrame:
    """Manifest rows from target rows: ``job`` defaults to ``module``, and the collector
    labels are put together from ``task_labels`` and ``target_labels``."""
    job = F.coalesce(F.nullif(F.col("job"), F.lit("")), F.col("module"))
    labels = collector_labels(
        F.col("task_labels"),
        F.col("system"),
        F.col("module"),
        job,
        F.col("target_labels"),
        F.col("resolved_ip"),
        F.col("port"),
    )
    with_labels = targets.withColumns({"collector_labels": labels, "job": job})
    for optional in ("fetch_error", "content_encoding"):
        if optional not in targets.columns:
            with_labels = with_labels.withColumn(optional, F.lit(None).cast("string"))
    return with_task(with_labels).select(*MANIFEST.fieldNames())


def with_defaults(manifest: DataFrame) -> DataFrame:
    """Manifest rows as the jobs use them: absent settings take their defaults, and collector
    labels are usable. What is wrong with a row is for ``manifest_violations`` to say; it must
    not stop the other scrapes."""
    return with_task(manifest).withColumns(
        {
            "resolved_ip": F.coalesce("resolved_ip", F.lit("")),
            "honor_labels": F.coalesce("honor_labels", F.lit(True)),
            "honor_timestamps": F.coalesce("honor_timestamps", F.lit(True)),
            "allow_missing_content_type": F.coalesce("allow_missing_content_type", F.lit(False)),
            "collector_labels": usable_entries(F.col("collector_labels")),
        }
    )


def expand_rules(catalogue: DataFrame) -> DataFrame:
    """One row per name a line may start with, with the family that owns it.

    ``lookup`` is ``sample`` for sample names and ``family`` for the names in directives.
    Where two families of a task claim a name, the one listed first owns it.
    """
    base, suffixes = F.col("name"), F.col("metric_type")
    sample_components = (
        F.when(suffixes == "histogram", F.array(*map(F.lit, ("bucket", "sum", "count"))))
        .when(suffixes == "summary", F.array(*map(F.lit, ("", "sum", "count"))))
        .otherwise(F.array(F.lit("")))
    )
    expanded = with_task(catalogue).select(
        "task_id",
        "ordinal",
        base.alias("family_name"),
        "metric_type",
        F.explode(F.concat(F.array(F.lit("family")), sample_components)).alias("component"),
    ).withColumns(
        {
            "lookup": F.when(F.col("component") == "family", "family").otherwise("sample"),
            "lookup_name": F.when(
                F.col("component").isin("family", ""), F.col("family_name")
            ).otherwise(F.concat_ws("_", "family_name", "component")),
        }
    )
    return expanded.groupBy("task_id", "lookup", "lookup_name").agg(
        F.min_by(F.struct("family_name", "metric_type", "component"), "ordinal").alias("rule")
    )


def required_families(catalogue: DataFrame) -> DataFrame:
    """Per task the families a payload must contain, in catalogue order."""
    return (
        with_task(catalogue)
        .filter("required")
        .groupBy("task_id")
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("rules"))
        .select("task_id", F.col("rules.name").alias("required"))
    )


def _blank(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""


def _faults(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken rule: ``keys`` and ``violation``."""
    broken = F.array_compact(F.array(*[F.when(test, F.lit(v)) for v, test in checks.items()]))
    return rows.select(*keys, F.explode(broken).alias("violation"))


def _rule_checks() -> dict[str, Column]:
    return {
        "empty system": _blank("system"),
        "empty module": _blank("module"),
        "invalid metric name": ~F.coalesce(F.col("name"), F.lit("")).rlike(
            rf"\A(?:{METRIC_NAME})\z"
        ),
        "invalid metric type": ~F.coalesce(F.col("metric_type"), F.lit("")).isin(*METRIC_TYPES),
    }


def _label_names() -> Column:
    return F.transform("collector_labels", lambda e: e["name"])


def _target_checks() -> dict[str, Column]:
    return {
        "empty system": _blank("system"),
        "empty module": _blank("module"),
        "invalid target URL": ~F.coalesce(F.col("logical_url"), F.lit("")).rlike(
            r"\A(?i:https?)://(?:[^/?#]*@)?(?![^/?#]*@)(?:\[[^\]/?#]+\]|[^/?#@:\[\]])"
        ),
        "invalid label name": F.exists(_label_names(), lambda n: ~n.rlike(rf"\A(?:{LABEL_NAME})\z")),
    }


def _first_fault(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(text)) for text, test in checks.items()])


def _repeated_rules(catalogue: DataFrame) -> DataFrame:
    keys = ["system", "module", "name"]
    repeated = with_task(catalogue).groupBy("task_id", *keys).count().filter(F.col("count") > 1)
    return repeated.select("task_id", *keys, F.lit("family declared more than once").alias("violation"))


def catalogue_violations(catalogue: DataFrame) -> DataFrame:
    """Bad rules, and families a task declares more than once."""
    bad = _faults(catalogue, ["system", "module", "name"], _rule_checks())
    return bad.unionByName(_repeated_rules(catalogue).drop("task_id"))


def task_faults(catalogue: DataFrame) -> DataFrame:
    """``task_id`` and ``fault`` of every task of a catalogue: null, or what is wrong with the first,
    by name, of its bad rules."""
    rules = with_task(catalogue).withColumn("violation", _first_fault(_rule_checks()))
    every = rules.select("task_id", "name", "violation").unionByName(
        _repeated_rules(catalogue).select("task_id", "name", "violation")
    )
    bad = F.col("violation").isNotNull()
    text = F.format_string("rule %s: %s", F.coalesce("name", F.lit("")), "violation")
    return every.groupBy("task_id").agg(F.min(F.when(bad, text)).alias("fault"))


def checked_manifest(manifest: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that may be read, and the rest with a ``violation``: what ``split_manifest`` refuses, targets
    with a bad URL, label name or identity, and targets of tasks that have no metric or a bad rule. A bad
    row or task refuses its own scrapes and no others. Of a repeated label the last value is taken."""
    usable, refused = split_manifest(manifest)
    faults = task_faults(catalogue).select(F.col("task_id").alias("_task"), "fault", F.lit(True).alias("_known"))
    columns = manifest.columns
    named = usable.withColumns({"_task": _task(usable), "_target": _first_fault(_target_checks())})
    judged = named.join(faults, "_task", "left").withColumn(
        "violation",
        F.coalesce(
            "_target",
            F.when(F.col("_known").isNull(), F.lit("task requires at least one metric")),
            "fault",
        ),
    )
    good = judged.filter("violation IS NULL").select(*columns)
    bad = judged.filter("violation IS NOT NULL").select(*columns, "violation")
    return good, refused.select(*columns, "violation").unionByName(bad)


def split_manifest(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that name one payload each, and the rest with a ``violation``: a scrape id that is
    absent, out of range or used more than once, or a path used more than once. To read those
    would merge payloads into one scrape, or count one twice."""
    scrape, path = F.col("scrape_id"), F.col("path")
    # Rows without a path or an id share none, so none of them meet.
    by_path = F.coalesce(path, F.concat(F.lit("\0"), F.coalesce(scrape.cast("string"), F.lit(""))))
    by_id = F.coalesce(scrape.cast("string"), F.concat(F.lit("\0"), F.coalesce(path, F.lit(""))))
    marked = manifest.withColumns(
        {
            "_same_id": F.count(F.lit(1)).over(W.partitionBy(by_id)),
            "_same_path": F.count(F.lit(1)).over(W.partitionBy(by_path)),
        }
    ).withColumn(
        "violation",
        F.when(scrape.isNull() | ~scrape.between(0, MAX_SCRAPE_ID), "scrape id out of range")
        .when(F.col("_same_id") > 1, "scrape id used more than once")
        .when(path.isNotNull() & (F.col("_same_path") > 1), "payload path used more than once"),
    ).drop("_same_id", "_same_path")
    return marked.filter("violation IS NULL").drop("violation"), marked.filter("violation IS NOT NULL")


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """Bad targets, by ``scrape_id``. One scrape is one payload file, both ways."""
    checks, names = _target_checks(), _label_names()
    checks["repeated label name"] = F.size(names) != F.size(F.array_distinct(names))
    checks["scrape id out of range"] = ~F.col("scrape_id").between(0, MAX_SCRAPE_ID)
    bad = _faults(manifest, ["scrape_id"], checks)
    shared = (
        manifest.filter(F.col("path").isNotNull())
        .groupBy("path")
        .agg(F.count("*").alias("n"), F.min("scrape_id").alias("scrape_id"))
        .filter("n > 1")
        .select("scrape_id", F.lit("payload path used more than once").alias("violation"))
    )
    repeated = (
        manifest.groupBy("scrape_id")
        .count()
        .filter("count > 1")
        .select("scrape_id", F.lit("scrape id used more than once").alias("violation"))
    )
    return bad.unionByName(shared).unionByName(repeated)


def task_violations(manifest: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Tasks with targets but no metrics, and tasks with metrics but no targets."""
    task = ["task_id", "system", "module"]
    targets, rules = (with_task(t).select(*task).distinct() for t in (manifest, catalogue))
    return reduce(
        DataFrame.unionByName,
        [
            have.join(need, "task_id", "left_anti")
            .drop("task_id")
            .withColumn("violation", F.lit(text))
            for have, need, text in (
                (targets, rules, "task requires at least one metric"),
                (rules, targets, "task requires at least one target"),
            )
        ],
    )
