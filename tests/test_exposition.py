import random
import re

from build import errors, parse, sample_rows
from pyspark.sql import functions as F

from scrapelake.functions import lines as X
from scrapelake.operators.exposition import accepted_samples, with_help
from scrapelake.schema import Limits

COUNTER = ("hits_total", "counter")


def test_source_timestamp_and_help(spark):
    text = (
        "# HELP hits_total calls so far\n# TYPE hits_total counter\n"
        'hits_total{rack="r7"} 9 4821\n'
    )
    parsed = parse(spark, [text], [COUNTER])
    (sample,) = sample_rows(with_help(parsed))
    assert (sample.metric_name, sample.sample_timestamp_ms, sample.value) == ("hits_total", 4821, 9.0)
    assert sample.help == "calls so far"
    assert sample.labels["rack"] == "r7"


def test_special_values_at_collection_time(spark):
    text = "# TYPE pressure_ratio gauge\npressure_ratio NaN 4821\n"
    parsed = parse(spark, [text], [("pressure_ratio", "gauge")], honor_timestamps=False)
    (sample,) = sample_rows(parsed)
    assert (sample.value, sample.value_repr, sample.sample_timestamp_ms) == (None, "NaN", 7_321)


def test_directive_faults(spark):
    good = "hits_total 1\n"
    texts = [
        "# TYPE hits_total gauge\n" + good,
        "# TYPE hits_total\n" + good,
        "# UNIT hits_total\n" + good,
        "# HELP hits_total\n# TYPE other gauge\n# TYPE\n#TYPE hits_total gauge\n" + good,
    ]
    found = errors(parse(spark, texts, [COUNTER]))
    assert found[0] == "type mismatch for hits_total: configured counter, endpoint gauge"
    assert found[1] == "invalid TYPE declaration for selected metric hits_total"
    assert found[2] == "invalid UNIT declaration for selected metric hits_total"
    assert found[3] is None


def test_only_selected_lines_can_fail(spark):
    texts = [
        "# TYPE chosen gauge\nchosen 1\nskipped{bad-name 6\n",
        "# TYPE chosen gauge\nchosen{bad-name 6\n",
        'chosen 1\n{a="b"} 2\n',
        'chosen 1\n# TYPE other gauge\n{a="b"} 2\n',
        '{a="b"} 2\nchosen 1\n',
    ]
    found = errors(parse(spark, texts, [("chosen", "gauge")]))
    assert found[0] is None
    assert found[1].startswith("invalid selected Prometheus text")
    assert found[2].startswith("invalid selected Prometheus text")
    assert found[3] is None
    assert found[4] is None


def test_compound_families_must_be_complete(spark):
    histogram = 'l_bucket{le="0.5"} 3\nl_bucket{le="+Inf"} 5\nl_sum 1.25\nl_count 5\n'
    summary = 'r{quantile="0.5"} 0.2\nr_sum 1\nr_count 5\n'
    texts = [
        histogram + summary,
        'l_bucket{le="+Inf"} 2\n',
        histogram.replace("l_count 5", "l_count 6"),
        histogram.replace(" 5\n", " NaN\n"),
        "l_bucket 1\n" + histogram,
        "r_sum 1\nr_count 5\n",
        "r 1\nr_sum 1\nr_count 5\n",
        histogram + 'l_bucket{le="+Inf",a="b"} 5\n',
        histogram + "l_count 7\nl_count 5\n",
    ]
    found = errors(parse(spark, texts, [("l", "histogram", False), ("r", "summary", False)]))
    assert found[0] is None
    assert found[1] == "incomplete histogram l"
    assert found[2] == "histogram l +Inf bucket does not equal _count"
    assert found[3] is None, "NaN equals NaN"
    assert found[4] == "incomplete histogram l: bucket lacks le"
    assert found[5] == "incomplete summary r"
    assert found[6] == "incomplete summary r: sample lacks quantile"
    assert found[7] == "incomplete histogram l"
    assert found[8] is None, "the last write of a component counts"


def test_groups_are_told_apart_by_time_and_endpoint_labels(spark):
    split = 'l_bucket{le="+Inf"} 5 1\nl_sum 1 1\nl_count 5 2\n'
    # Both label sets merge to the same stored labels, yet are two groups of the payload.
    hidden = 'l_bucket{le="+Inf",job="m"} 5\nl_sum 1\nl_count 5\n'
    found = errors(parse(spark, [split, hidden], [("l", "histogram")]))
    assert found == {0: "incomplete histogram l", 1: "incomplete histogram l"}


def test_limits(spark):
    limits = Limits(samples=2, labels=2, label_value_bytes=4)
    texts = [
        "x 1\nx 2\nx 3\n",
        'x{a="1",b="2",c="3"} 1\n',
        'x{a="ééé"} 1\n',
        "x 1\nx 2\n",
        "x 1\nx 2\nx{ 3\n",
    ]
    found = errors(parse(spark, texts, [("x", "gauge")], limits, collector_labels=[]))
    assert found[0] == "sample limit (2) exceeded"
    assert found[1] == "label limit (2) exceeded"
    assert found[2] == "label value limit (4) exceeded for a"
    assert found[4].startswith("invalid selected Prometheus text"), "syntax comes before the cap"
    assert found[3] == "merged label value limit (4) exceeded for resolved_ip"


def test_required_families_in_catalogue_order(spark):
    rules = [("a", "gauge"), ("b", "gauge"), ("c", "gauge", False)]
    found = errors(parse(spark, ["", "a 1\n", "a 1\nb 1\n", "b 1\nc 1\n"], rules))
    assert found == {
        0: "required metric family is missing: a",
        1: "required metric family is missing: b",
        2: None,
        3: "required metric family is missing: a",
    }


def test_first_owner_of_a_name_wins(spark):
    rules = [("x_count", "gauge", False), ("x", "summary", False)]
    parsed = parse(spark, ["x_count 1\n"], rules)
    assert errors(parsed) == {0: None}
    assert sample_rows(parsed)[0].family_name == "x_count"


def test_utf8_and_responses(spark):
    texts = [b"x 1\xff\n", "x 1\n", "x 1\n", "x 1\n", "x 1\n", "x 1\n"]
    found = errors(
        parse(
            spark,
            texts,
            [("x", "gauge")],
            content_type=["text/plain", None, None, "application/json", "Application/OpenMetrics-Text; v=1", "text/plain"],
            allow_missing_content_type=[False, False, True, False, False, False],
            http_status=[200, 200, 200, 200, 200, 404],
        )
    )
    assert found[0] == "metrics response is not valid UTF-8"
    assert found[1] == "metrics endpoint omitted Content-Type: http://h/metrics"
    assert found[2] is None
    assert "non-text Content-Type 'application/json'" in found[3]
    assert found[4] is None
    assert found[5] == "metrics endpoint returned HTTP 404: http://h/metrics"


def test_body_limit(spark):
    found = errors(parse(spark, ["x 1\n"], [("x", "gauge")], Limits(body_bytes=3)))
    assert found[0].startswith("metrics response exceeds 3 decompressed bytes")


def test_long_error_is_cut(spark):
    found = errors(parse(spark, ["x " + "y" * 5000 + "\n"], [("x", "gauge")]))
    assert len(found[0]) == 1024


def test_help_and_unit_stick(spark):
    text = "x 1\n# HELP x first\n# UNIT x seconds more\nx 2\n# HELP x second  one \n# HELP y other\nx 3\n"
    rows = sample_rows(with_help(parse(spark, [text], [("x", "gauge"), ("y", "gauge", False)])))
    assert [(r.help, r.unit) for r in rows] == [
        (None, None),
        ("first", "seconds"),
        ("second  one", "seconds"),
    ]


def test_timestamps(spark):
    text = "x 1 4821.5\nx 1 4822.5\nx 1 -3\nx 1\n"
    rows = sample_rows(parse(spark, [text, "x 1 NaN\n", "x 1 1e30\n", "x 1 z\n"], [("x", "gauge")]))
    assert [r.sample_timestamp_ms for r in rows] == [4822, 4822, -3, 7_321]
    found = errors(parse(spark, [text, "x 1 NaN\n", "x 1 1e30\n", "x 1 z\n"], [("x", "gauge")]))
    assert found[0] is None and None not in (found[1], found[2], found[3])
    ignored = errors(parse(spark, ["x 1 NaN\n"], [("x", "gauge")], honor_timestamps=False))
    assert ignored == {0: None}


LINES = [
    ("x 1", [{}, 1.0]),
    ("  x\t2.5 ", [{}, 2.5]),
    ("x{} 1", [{}, 1.0]),
    ("x{}1", [{}, 1.0]),
    ('x{a="b",} 1', [{"a": "b"}, 1.0]),
    ('x { a = "b" , c = "d" } 1e3', [{"a": "b", "c": "d"}, 1000.0]),
    ('x{a="}",b="\\"",c="\\\\n",d="\\n",e="\\q"} .5', [{"a": "}", "b": '"', "c": "\\n", "d": "\n", "e": "\\q"}, 0.5]),
    ('x{a="\x00"} 5.', [{"a": "\x00"}, 5.0]),
    ("x +Inf\r", [{}, float("inf")]),
    ("x -inf", [{}, float("-inf")]),
    ("x 1e400", [{}, float("inf")]),
    ("x", None),
    ("x{", None),
    ('x{a="b"', None),
    ('x{a="b" c="d"} 1', None),
    ('x{,} 1', None),
    ('x{a="1",a="2"} 1', None),
    ("x{a=b} 1", None),
    ('x{1a="b"} 1', None),
    ("x 1d", None),
    ("x 0x1", None),
    ("x 1_000", None),
    ("x 1 2 3", None),
    ("x-y 1", None),
    ("x+5", None),
    ("x one", None),
    ("x\x001\x002", None),
]


def test_line_grammar(spark):
    parsed = parse(spark, [line + "\n" for line, _ in LINES], [("x", "gauge")], collector_labels=[])
    found = errors(parsed)
    rows = {r.scrape_id: r for r in parsed.filter("kind = 'sample'").collect()}
    for i, (line, expected) in enumerate(LINES):
        if expected is None:
            assert found[i] is not None, line
            continue
        assert found[i] is None, line
        labels = {k: v for k, v in rows[i].labels.items() if k != "resolved_ip"}
        special = {"+Inf": float("inf"), "-Inf": float("-inf")}
        value = rows[i].value if rows[i].value_repr is None else special[rows[i].value_repr]
        assert [labels, value] == expected, line


def test_very_long_label_value_does_not_overflow_the_stack(spark):
    text = 'x{a="' + "y\\n" * 1_000_000 + '"} 1\n'
    assert errors(parse(spark, [text], [("x", "gauge")])) == {0: "label value limit (1024) exceeded for a"}


def test_random_samples_survive_text(spark):
    random.seed(7)
    alphabet = 'ab"\\\n{}=, é#\t'
    expected, lines = [], []
    for i in range(300):
        labels = {
            name: "".join(random.choices(alphabet, k=random.randrange(8)))
            for name in random.sample(["a", "b_1", "_c", "d"], random.randrange(5))
        }
        value, ts = random.choice([1.5, -2e-7, 3e20, 0.1]), random.randrange(10**12)
        escaped = ",".join(
            '{}="{}"'.format(k, v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n"))
            for k, v in labels.items()
        )
        lines.append(f"x{{{escaped}}} {value!r} {ts}")
        expected.append((labels, value, ts))
    parsed = parse(spark, ["\n".join(lines)], [("x", "gauge")], collector_labels=[])
    assert errors(parsed) == {0: None}
    got = [
        ({k: v for k, v in r.labels.items() if k != "resolved_ip"}, r.value, r.sample_timestamp_ms)
        for r in sample_rows(parsed)
    ]
    assert got == expected


def test_space_class_is_the_one_of_text_stripping(spark):
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = spark.createDataFrame([(c,) for c in spaces + ["a", "\x00", "​"]], "c string")
    blank = {r.c for r in rows.filter(F.col("c").rlike(X.BLANK)).collect()}
    assert blank == set(spaces)
    assert re.fullmatch(r"\s", "\x1c")


def test_result_does_not_depend_on_partitioning(spark):
    from build import catalogue, manifest, payload_frame
    from scrapelake.operators.exposition import parse_payloads

    texts = [f"# HELP x h{i}\nx 1 5\nx {i} 5\ny{{a=\"b\"}} 2\n" for i in range(20)]
    rules = catalogue(spark, ("x", "gauge"), ("y", "gauge"))
    results = []
    for n in (1, 7):
        frame = payload_frame(spark, texts).repartition(n, F.rand(n))
        parsed = parse_payloads(frame, manifest(spark, 20).repartition(n), rules)
        results.append(sorted(map(str, accepted_samples(parsed).collect())))
    assert results[0] == results[1]
