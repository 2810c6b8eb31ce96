"""Texts stored in the ``error`` column of the scrape audit and raised by the views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stored error texts, as printf patterns.
HTTP_STATUS = "metrics endpoint returned HTTP %d: %s"
NO_CONTENT_TYPE = "metrics endpoint omitted Content-Type: %s"
WRONG_CONTENT_TYPE = "metrics endpoint returned non-text Content-Type '%s': %s"
BODY_LIMIT = "metrics response exceeds %d decompressed bytes: %s"
NOT_DECODABLE = "metrics response is not valid %s data"
UNKNOWN_ENCODING = "metrics response has an unsupported Content-Encoding '%s'"
NOT_UTF8 = "metrics response is not valid UTF-8"
NO_PAYLOAD = "no payload was landed: %s"
INVALID_DIRECTIVE = "invalid %s declaration for selected metric %s"
TYPE_MISMATCH = "type mismatch for %s: configured %s, endpoint %s"
INVALID_TEXT = "invalid selected Prometheus text: %s"
SAMPLE_LIMIT = "sample limit (%d) exceeded"
LABEL_LIMIT = "%s limit (%d) exceeded"
LABEL_VALUE_LIMIT = "%s value limit (%d) exceeded for %s"
MISSING_FAMILY = "required metric family is missing: %s"
INCOMPLETE_HISTOGRAM = "incomplete histogram %s"
BUCKET_WITHOUT_LE = "incomplete histogram %s: bucket lacks le"
COUNT_MISMATCH = "histogram %s +Inf bucket does not equal _count"
INCOMPLETE_SUMMARY = "incomplete summary %s"
SAMPLE_WITHOUT_QUANTILE = "incomplete summary %s: sample lacks quantile"
VIEW_BUCKET_WITHOUT_LE = "histogram bucket is missing its le label"
VIEW_INCOMPLETE_HISTOGRAM = "incomplete stored histogram group"
VIEW_NO_INFINITY = "incomplete stored histogram group: missing +Inf bucket"
VIEW_COUNT_MISMATCH = "histogram +Inf bucket does not equal _count"
VIEW_QUANTILE_MISSING = "summary sample is missing its quantile label"
VIEW_INCOMPLETE_SUMMARY = "incomplete stored summary group"
VIEW_UNEXPECTED = "unexpected %s sample '%s'"


def text(pattern: str, *args: Column | str | int) -> Column:
    """One of the patterns above, filled from columns and constants."""
    return F.format_string(pattern, *[a if isinstance(a, Column) else F.lit(a) for a in args])


def label_count(kind: str, cap: int) -> Column:
    return text(LABEL_LIMIT, kind, cap)


def label_size(kind: str, cap: int, name: Column) -> Column:
    return text(LABEL_VALUE_LIMIT, kind, cap, name)
