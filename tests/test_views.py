import json

import pytest
from build import samples, series

from scrapelake.operators.results import flat_view, nested_view, view_document_lines, write_lines
from scrapelake.operators.selector import Matcher
from scrapelake.operators.views import histogram_view, in_group_order, summary_view


def part(family, kind, suffix, labels, ts, value):
    special = value if isinstance(value, str) else None
    return (f"{family}{suffix}", family, kind, labels, ts, None if special else float(value), special, 1)


def histogram(ts=1, job="api", bounds=(("0.5", 3), ("+Inf", 5)), count=5, total=1.25):
    rows = [part("l", "histogram", "_bucket", {"job": job, "le": le}, ts, v) for le, v in bounds]
    if count is not None:
        rows.append(part("l", "histogram", "_count", {"job": job}, ts, count))
    if total is not None:
        rows.append(part("l", "histogram", "_sum", {"job": job}, ts, total))
    return rows


def view(spark, rows, *args, kind=histogram_view, family="l", **kwargs):
    table = samples(spark, rows)
    return in_group_order(kind(series(table), table, family, *args, **{"at_ms": 100} | kwargs))


def test_histogram_group(spark):
    bounds = (("+Inf", 5), ("10", 4), ("0.50", 2), ("0.5", 3), ("1e1", 4), ("weird", 1), ("2", 3))
    (group,) = view(spark, histogram(bounds=bounds)).collect()
    assert [b.le for b in group.buckets] == ["0.5", "0.50", "2", "10", "1e1", "weird", "+Inf"]
    assert group.labels == {"job": "api"}
    assert (group["count"].value, group["sum"].value, group.timestamp_ms) == (5.0, 1.25, None)


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        ([part("l", "histogram", "_bucket", {"le": "+Inf"}, 1, 1)], "incomplete stored histogram group"),
        (histogram(bounds=()), "incomplete stored histogram group"),
        (histogram(count=None), "incomplete stored histogram group"),
        (histogram(total=None), "incomplete stored histogram group"),
        (histogram(bounds=(("1", 5),)), "incomplete stored histogram group: missing +Inf bucket"),
        (histogram(count=6), "histogram +Inf bucket does not equal _count"),
        (histogram() + [part("l", "histogram", "_bucket", {"job": "api"}, 1, 1)], "histogram bucket is missing its le label"),
        (histogram() + [part("l", "histogram", "_max", {"job": "api"}, 1, 1)], "unexpected histogram sample 'l_max'"),
    ],
)
def test_broken_histograms(spark, rows, error):
    (group,) = view(spark, rows, strict=False).collect()
    assert group.error == error
    strict = view(spark, rows)
    for use in (strict.collect, strict.count, nested_view(strict, "buckets", "le").collect, flat_view(strict, "buckets", "le").collect):
        with pytest.raises(Exception, match=error.split("'")[0].replace("+", r"\+")):
            use()


def test_an_unexpected_series_counts_only_with_a_sample_in_the_window(spark):
    late = part("l", "histogram", "_max", {"job": "api"}, 500, 1)
    assert view(spark, histogram() + [late]).count() == 1
    assert view(spark, histogram() + [late], range_ms=100).count() == 1
    with pytest.raises(Exception, match="unexpected"):
        view(spark, histogram(ts=500) + [late], at_ms=500).count()


def test_nan_counts_are_equal(spark):
    rows = histogram(bounds=(("+Inf", "NaN"),), count="NaN")
    assert view(spark, rows, strict=False).first().error is None


def test_instant_view_mixes_times_and_range_view_groups_by_time(spark):
    rows = histogram(ts=1) + histogram(ts=2) + [part("l", "histogram", "_sum", {"job": "api"}, 3, 9)]
    (group,) = view(spark, rows).collect()
    assert group["sum"].sample_timestamp_ms == 3 and group["count"].sample_timestamp_ms == 2
    ranged = view(spark, rows, range_ms=99, strict=False).collect()
    assert [(g.timestamp_ms, g.error) for g in ranged] == [
        (2, None),
        (3, "incomplete stored histogram group"),
    ]


def test_matcher_on_le_filters_buckets(spark):
    (group,) = view(spark, histogram(), [Matcher("le", "=~", "|\\+Inf")]).collect()
    assert [b.le for b in group.buckets] == ["+Inf"]


def test_groups_are_ordered_by_labels(spark):
    groups = view(spark, histogram(job="b") + histogram(job="B") + histogram(job="a")).collect()
    assert [g.labels["job"] for g in groups] == ["B", "a", "b"]


def summary(quantiles=(("0.9", 2), ("0.5", 0.2), ("p99", 3)), count=4, total=1.1):
    rows = [part("r", "summary", "", {"quantile": q}, 1, v) for q, v in quantiles]
    rows += [part("r", "summary", "_count", {}, 1, count)] if count is not None else []
    rows += [part("r", "summary", "_sum", {}, 1, total)] if total is not None else []
    return rows


def test_summary_group(spark):
    (group,) = view(spark, summary(), kind=summary_view, family="r").collect()
    assert [q.quantile for q in group.quantiles] == ["0.5", "0.9", "p99"]
    assert (group.labels, group["count"].value) == ({}, 4.0)


@pytest.mark.parametrize(
    ("rows", "error"),
    [
        (summary(quantiles=()), "incomplete stored summary group"),
        (summary(count=None), "incomplete stored summary group"),
        (summary(total=None), "incomplete stored summary group"),
        (summary() + [part("r", "summary", "", {}, 1, 1)], "summary sample is missing its quantile label"),
        (summary() + [part("r", "summary", "_bucket", {}, 1, 1)], "unexpected summary sample 'r_bucket'"),
    ],
)
def test_broken_summaries(spark, rows, error):
    (group,) = view(spark, rows, kind=summary_view, family="r", strict=False).collect()
    assert group.error == error


def test_a_view_as_a_document_of_lines(spark, tmp_path):
    jobs = [f"j{i}" for i in range(40)] + ["b", "B"]
    groups = view(spark, [row for job in jobs for row in histogram(job=job)], [Matcher("job", "!=", "j7")])
    lines = view_document_lines(groups, "histogram", "l", [Matcher("job", "!=", "j7")], 100)
    assert "collect_list" not in lines._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")[0]
    write_lines(lines, str(tmp_path / "document"))
    parts = sorted((tmp_path / "document").glob("part-*.txt"))
    head, *found = [json.loads(line) for part in parts for line in part.read_text().splitlines()]
    assert (head["kind"], head["at_ms"]) == ("histogram", 100)
    assert head["selector"]["matchers"] == [{"name": "job", "operator": "!=", "value": "j7"}]
    assert [g["labels"]["job"] for g in found] == sorted(set(jobs) - {"j7"})


def test_documents_and_flat_rows(spark):
    groups = view(spark, histogram())
    document = json.loads(nested_view(groups, "buckets", "le").first().group_json)
    assert document["labels"] == {"job": "api"} and document["timestamp_ms"] is None
    assert document["buckets"][1] == {
        "le": "+Inf",
        "sample": {"timestamp_ms": 1, "value": 5.0, "value_repr": None, "scrape_id": 1, "collected_at_ms": 11, "age_ms": 99},
    }
    rows = flat_view(groups, "buckets", "le").collect()
    assert [(r.component, r.bound, r.value) for r in rows] == [
        ("bucket", "0.5", "3.0"),
        ("bucket", "+Inf", "5.0"),
        ("count", "", "5.0"),
        ("sum", "", "1.25"),
    ]
    quantiles = flat_view(view(spark, summary(), kind=summary_view, family="r"), "quantiles", "quantile")
    assert [(r.component, r.quantile) for r in quantiles.collect()][-1] == ("sum", "")
