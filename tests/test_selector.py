import itertools
import random
import re

import pytest
from build import gauge, samples, series
from pyspark.sql import functions as F

from scrapelake.operators.results import flat_result, nested_result, selector_document
from scrapelake.operators.selector import (
    Matcher,
    ResultLimitError,
    SelectorError,
    full_match_pattern,
    in_result_order,
    instant,
    limited,
    range_samples,
)


def ask(spark, rows, *matchers, metric="x", **kwargs):
    table = samples(spark, rows)
    kind = range_samples if "range_ms" in kwargs else instant
    result = kind(series(table), table, metric, matchers, **kwargs)
    return sorted(result.collect(), key=lambda r: (r.labels_key, r.sample_timestamp_ms))


def test_range_is_open_below_and_closed_above(spark):
    stamps = [39, 40, 41, 77, 100, 101]
    rows = [gauge(ts, ts, {"shard": "s1"}) for ts in stamps]
    found = ask(spark, rows, at_ms=100, range_ms=60)
    assert [r.sample_timestamp_ms for r in found] == [41, 77, 100]


def test_instant_takes_the_latest_without_a_lookback_bound(spark):
    (found,) = ask(spark, [gauge(73, 1), gauge(81, 2), gauge(3, 9)], at_ms=80)
    assert (found.sample_timestamp_ms, found.age_ms, found.collected_at_ms) == (73, 7, 83)
    (old,) = ask(spark, [gauge(-6_000_000_000, 1)], at_ms=2)
    assert old.age_ms == 6_000_000_002


def test_instant_over_a_log_takes_the_last_write_of_the_latest_time(spark):
    rows = [gauge(7, 1), gauge(7, 5, scrape_id=9), gauge(6, 8), gauge(9, 2)]
    (found,) = ask(spark, rows, at_ms=8)
    assert (found.value, found.scrape_id) == (5.0, 9)


def test_max_age_drops_old_samples(spark):
    rows = [gauge(60, 1, {"shard": "s1"}), gauge(63, 2, {"shard": "s2"}), gauge(99, 2, {"shard": "s1"})]
    assert [r.labels["shard"] for r in ask(spark, rows, at_ms=70, max_age_ms=7)] == ["s2"]
    assert ask(spark, rows, at_ms=70, max_age_ms=6) == []


def test_special_values_come_back(spark):
    rows = [gauge(1, v, {"v": v}) for v in ("NaN", "+Inf", "-Inf")] + [gauge(1, -0.5, {"v": "f"})]
    found = {r.labels["v"]: (r.value, r.value_repr) for r in ask(spark, rows, at_ms=1)}
    assert found == {"NaN": (None, "NaN"), "+Inf": (None, "+Inf"), "-Inf": (None, "-Inf"), "f": (-0.5, None)}


def test_matchers(spark):
    rows = [gauge(1, 1, {"job": "ant"}), gauge(1, 1, {"job": "db", "zone": "west"}), gauge(1, 1, {"job": "a\n"})]

    def jobs(*matchers):
        return sorted(r.labels["job"] for r in ask(spark, rows, *matchers, at_ms=1))

    assert jobs(Matcher("zone", "!=", "west")) == ["a\n", "ant"]
    assert jobs(Matcher("zone", "=", "")) == ["a\n", "ant"]
    assert jobs(Matcher("job", "=~", "a|db")) == ["db"], "a trailing newline is part of the value"
    assert jobs(Matcher("job", "=~", "a.*")) == ["ant"], "a dot matches no newline"
    assert jobs(Matcher("job", "!~", "a.*")) == ["a\n", "db"]
    assert jobs(Matcher("job", "=~", "(?P<x>a)nt"), Matcher("job", "!=", "db")) == ["ant"]
    assert jobs(Matcher("zone", "=~", "")) == ["a\n", "ant"]
    assert jobs(Matcher("job", "=", "ant"), Matcher("job", "=", "db")) == []


def test_patterns_mean_what_python_means(spark):
    """Fixed and random patterns over short texts, against the re module."""
    random.seed(11)
    fixed = ["[a&&b]", "[a[b]]", r"\(?P<q>", r"(?P<my_name>a)(?P=my_name)", "[]a]", "[^]a]", r"[\]&]", "[a-]", r"\x61|\u0062", r"(a)(b)\2\1", "a{,2}", "a{x}", "{", "}", r"[\d\w]&", r"a\Z", r"\101", "(?#note)b", r"[\b]", "[a^]", r"[&~|]", "[[:x]", r"a\&b"]
    atoms = ["a", "b", "&", "[ab]", "[^a]", "[a&&b]", "[[a]", r"[\]&]", r"\[", r"\(", ".", r"\w", r"\s", "(a|b)", "(?:&|a)", "(?P<n_1>b)", "", "-", "]", "^", "$"]
    for _ in range(60):
        pattern = "".join(random.choice(atoms) + random.choice(["", "", "", "*", "?", "+"]) for _ in range(3))
        try:
            re.compile(pattern)
        except re.error:
            continue
        fixed.append(pattern)
    texts = sorted({"".join(t) for n in range(4) for t in itertools.product("ab&[](", repeat=n)} | {"(P<q>", "(?P<q>", "a{x}", "{", "}", "A", "\x08", "a\n", "-", "^", "1&", "abba", "a&b", "[:x"})
    table = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for pattern in fixed:
        try:
            java = full_match_pattern(pattern)
        except SelectorError:
            continue
        found = {r.t for r in table.filter(F.col("t").rlike(java)).collect()}
        assert found == {t for t in texts if re.fullmatch(pattern, t)}, pattern
    table.unpersist()


def test_arguments_are_checked_before_planning(spark):
    with pytest.raises(SelectorError):
        Matcher("a", "==", "b")
    with pytest.raises(SelectorError):
        full_match_pattern("(")
    with pytest.raises(SelectorError):
        full_match_pattern(r"(a)(?(1)b|c)")
    rows = [gauge(1, 1)]
    with pytest.raises(SelectorError):
        ask(spark, rows, at_ms=1, max_age_ms=-1)
    with pytest.raises(SelectorError):
        ask(spark, rows, at_ms=1, range_ms=0)


def test_limits_fail_instead_of_truncating(spark):
    table = samples(spark, [gauge(1, 1, {"i": "a"}), gauge(2, 1, {"i": "a"}), gauge(1, 1, {"i": "b"})])
    result = range_samples(series(table), table, "x", at_ms=9, range_ms=9)
    with pytest.raises(ResultLimitError, match="series limit"):
        limited(result, 1, 10)
    with pytest.raises(ResultLimitError, match="sample limit"):
        limited(result, 2, 2)
    with pytest.raises(SelectorError):
        limited(result, 0, 1)
    assert limited(result, 2, 3).count() == 3


def test_result_shapes(spark):
    table = samples(spark, [gauge(2, 12345678.5, {"b": "2", "a": "1"}), gauge(1, "NaN", {"a": "1", "b": "2"})])
    result = in_result_order(range_samples(series(table), table, "x", at_ms=10, range_ms=10))
    flat = flat_result(result).collect()
    assert [(r.labels, r.sample_ms, r.value) for r in flat] == [
        ('{"a":"1","b":"2"}', 1, "NaN"),
        ('{"a":"1","b":"2"}', 2, "12345678.5"),
    ]
    (document,) = nested_result(result).collect()
    assert '"samples":[{"timestamp_ms":1,"value":null,"value_repr":"NaN"' in document.series_json
    assert selector_document("x", [Matcher("a", "=", "1")], 10)["selector"]["matchers"][0]["value"] == "1"


def test_value_text(spark):
    values = [0.0, -0.0, 1.0, 0.1, 0.001, 0.0001, 0.00012, 1e-5, 1.5e-7, 9999999.0, 1e7, 12345678.9, 1e15, 123456789012345.6, 1e16, 1.5e16, 1e22, 1e100, -2.5e-10, -1e9]
    table = samples(spark, [gauge(i, v) for i, v in enumerate(values)])
    result = range_samples(series(table), table, "x", at_ms=99, range_ms=100)
    found = [r.value for r in flat_result(in_result_order(result)).collect()]
    assert found == [str(v) for v in values]
