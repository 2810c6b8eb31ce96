"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    Only a session on a local master, as in tests, may do without that setting and then gets a
    local folder. No setting is changed.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="scrapelake-")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(frame: DataFrame, folder: str, *partition_by: str) -> DataFrame:
    """Writes a frame once and reads it back, so that later steps neither repeat the work
    nor depend on the executors that did it."""
    frame.write.partitionBy(*partition_by).parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes an intermediate table that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[str]:
    """A scratch folder that is removed on the way out, also after an error."""
    folder = scratch_folder(spark, purpose)
    try:
        yield folder
    finally:
        discard(spark, folder)
