"""Sample values: one DOUBLE for computing, a (value, value_repr) pair for storing."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrapelake.schema import DAY_MS, SPECIAL_VALUES

# The number syntax a payload, an `le` bound or a quantile may use.
FINITE_NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
NOT_A_NUMBER = r"(?i)\A[+-]?nan\z"
POSITIVE_INFINITY = r"(?i)\A\+?inf(?:inity)?\z"
NEGATIVE_INFINITY = r"(?i)\A-inf(?:inity)?\z"


def number_from_text(text: Column) -> Column:
    """Number behind a text token, NULL when it is none.

    The pattern guards the cast: Spark alone would also read ``1d`` or ``1.5f``.
    """
    return (
        F.when(text.rlike(FINITE_NUMBER), text.try_cast("double"))
        .when(text.rlike(NOT_A_NUMBER), F.lit(float("nan")))
        .when(text.rlike(POSITIVE_INFINITY), F.lit(float("inf")))
        .when(text.rlike(NEGATIVE_INFINITY), F.lit(float("-inf")))
    )


def number(value: Column, value_repr: Column) -> Column:
    """Stored pair as one DOUBLE. Fixed width keeps aggregation in HashAggregate."""
    return F.coalesce(
        value,
        F.when(value_repr == "NaN", F.lit(float("nan")))
        .when(value_repr == "+Inf", F.lit(float("inf")))
        .when(value_repr == "-Inf", F.lit(float("-inf"))),
    )


def finite_value(num: Column) -> Column:
    special = F.isnan(num) | (F.abs(num) == F.lit(float("inf")))
    return F.when(~special, num)


def special_text(num: Column) -> Column:
    return (
        F.when(F.isnan(num), F.lit("NaN"))
        .when(num == F.lit(float("inf")), F.lit("+Inf"))
        .when(num == F.lit(float("-inf")), F.lit("-Inf"))
    )


def value_fault(value: Column, value_repr: Column) -> Column:
    """Why a stored pair is invalid, or NULL."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return (
        F.when(
            value.isNull() == value_repr.isNull(),
            F.lit("exactly one of value and value_repr must be present"),
        )
        .when(value.isNotNull() & ~finite, F.lit("value must be a finite number"))
        .when(
            value_repr.isNotNull() & ~value_repr.isin(*SPECIAL_VALUES),
            F.lit("value_repr must be NaN, +Inf, or -Inf"),
        )
    )


def display_value(value: Column, value_repr: Column) -> Column:
    """Text of a sample value: plain decimals from 1e-4 up to 1e16, exponents outside.

    Spark's own cast turns to exponents at 1e7 and 1e-3, so those digits are respelled.
    """
    text = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+\z", ""),
        r"\.\z",
        ".0",
    )
    exponent = F.regexp_replace(text, r"(?:\.0)?E", "e")
    exponent = F.regexp_replace(exponent, r"e([0-9])", "e+$1")
    exponent = F.regexp_replace(exponent, r"e([+-])([0-9])\z", r"e$1\0$2")
    spelled = (
        F.when((value == 0) | ((size >= 1e-3) & (size < 1e7)), text)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )
    return F.coalesce(value_repr, spelled)


# Days outside the years 1 to 9999 share the first or the last partition: a payload may carry
# any timestamp, and none may fail the job.
FIRST_DAY, LAST_DAY = -719_162, 2_932_896


def sample_date(timestamp_ms: Column) -> Column:
    """UTC day of a sample, whatever the session time zone."""
    day = F.floor(timestamp_ms / DAY_MS)
    return F.date_from_unix_date(
        F.least(F.greatest(day, F.lit(FIRST_DAY)), F.lit(LAST_DAY)).cast("int")
    )


def date_of(timestamp_ms: int) -> date:
    """The same day for a constant, to compare the partition column with."""
    day = min(max(timestamp_ms // DAY_MS, FIRST_DAY), LAST_DAY)
    return date(1970, 1, 1) + timedelta(days=day)
