"""The days on which series have samples, as bitmaps that merge: one row per series and block of 32
days, bit ``i`` for day ``i`` of the block. Days count from 1970-01-01; blocks before it are negative."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_DAYS = 32
_EPOCH = date(1970, 1, 1)


def active_days(samples: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps of samples, for each value of ``keys`` if there are any. All buffers are one BIGINT, so
    a hot series is one row per block and task before the shuffle."""
    block = F.expr("shiftright(unix_date(sample_date), 5)").alias("block")
    bits = F.expr("bit_or(shiftleft(1L, unix_date(sample_date) & 31))").alias("days")
    return samples.groupBy(*keys, "series_id", block).agg(bits)


def merged_days(activity: DataFrame) -> DataFrame:
    """One bitmap per series and block from those of several batches."""
    return activity.groupBy("series_id", "block").agg(F.bit_or("days").alias("days"))


def _place(day: date) -> tuple[int, int]:
    return divmod((day - _EPOCH).days, BLOCK_DAYS)


def days_through(day: date) -> Column:
    """The bits of days up to ``day``."""
    block, bit = _place(day)
    upto = F.col("days").bitwiseAND(F.lit((2 << bit) - 1).cast("bigint"))
    return F.when(F.col("block") < block, F.col("days")).when(F.col("block") == block, upto).otherwise(F.lit(0))


def days_after(day: date) -> Column:
    """The bits of days after ``day``."""
    return F.col("days").bitwiseXOR(days_through(day))


def bit_of(day: date) -> tuple[Column, int]:
    """Whether a row has the day in its block, and the day's bit."""
    block, bit = _place(day)
    return F.col("block") == block, 1 << bit


def day_spans(activity: DataFrame) -> DataFrame:
    """First and last day of every series and the number of its days, from merged bitmaps."""
    start = F.col("block") * BLOCK_DAYS
    lowest = F.expr("bit_count((days & -days) - 1)")
    highest = F.length(F.bin("days")) - 1
    return activity.groupBy("series_id").agg(
        F.min(start + lowest).cast("bigint").alias("first_day"),
        F.max(start + highest).cast("bigint").alias("last_day"),
        F.sum(F.bit_count("days")).cast("bigint").alias("n_days"),
    )
