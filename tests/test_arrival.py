"""Payloads that come compressed or before their manifest row, and rows that may not be read."""

import gzip
import zlib

import pytest
from build import catalogue, errors, manifest, payload_frame
from pyspark.sql import functions as F

from scrapelake.operators.exposition import parse_payloads
from scrapelake.plans.ingest import ingest_batch, ingest_unlanded
from scrapelake.plans.lake import Lake
from scrapelake.plans.upkeep import compact
from scrapelake.schema import Limits
from scrapelake.sources.payloads import decoded, inflate
from scrapelake.sources.tables import checked_manifest

RULE = ("x", "gauge")


def gauges(lake):
    return sorted((r.labels["n"], r.value) for r in lake.instant("x", at_ms=1 << 40).collect())


def audit(lake):
    return sorted((r.scrape_id, r.status, r.error) if r.scrape_id is not None else (-1, r.logical_url, r.error) for r in lake.scrapes().collect())


def run(spark, lake, batch_id, payloads, named, wait=2):
    """``payloads`` and ``named`` are numbers of scrapes; a payload's value is its number."""
    every = payload_frame(spark, [f'x{{n="{i}"}} {i}\n' for i in range(6)])
    paths = [f"p{i}" for i in payloads]
    rows = manifest(spark, 6).filter(F.col("scrape_id").isin(list(named)))
    return ingest_batch(
        lake, batch_id, every.filter(F.col("path").isin(paths)), rows, catalogue(spark, RULE), landed_only=True, wait_batches=wait
    )


def test_a_payload_waits_for_its_row(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    run(spark, lake, 0, [0, 1, 2], [0])
    assert gauges(lake) == [("0", 0.0)] and [a[0] for a in audit(lake)] == [0]
    assert sorted(r.path for r in lake.pending().collect()) == ["p1", "p2"]
    run(spark, lake, 1, [3], [0, 3])
    run(spark, lake, 2, [4], [1, 4])
    assert gauges(lake) == [("0", 0.0), ("1", 1.0), ("3", 3.0), ("4", 4.0)]
    # Two more batches were all that the other one waited for.
    assert audit(lake)[0] == (-1, "p2", "payload has no manifest row")
    assert lake.pending().count() == 0
    run(spark, lake, 3, [5], [2])
    assert [n for n, _ in gauges(lake)] == ["0", "1", "3", "4"], "its row came too late"


def test_a_rerun_finds_what_was_held_before(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    run(spark, lake, 0, [0, 1], [0])
    for _ in range(3):
        run(spark, lake, 1, [2], [1, 2])
        assert gauges(lake) == [("0", 0.0), ("1", 1.0), ("2", 2.0)]
        assert lake.pending().count() == 0
    assert [a[1] for a in audit(lake)] == ["success"] * 3
    assert lake.partition_folders("pending") in ([], ["batch_id=0"])


def test_what_waits_survives_compaction_and_is_settled_at_the_end(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    run(spark, lake, 0, [0, 1, 2], [0], wait=9)
    lake = compact(lake, str(tmp_path / "packed"))
    run(spark, lake, 1, [3], [1, 3], wait=9)
    assert [n for n, _ in gauges(lake)] == ["0", "1", "3"]
    assert [r.path for r in lake.pending().collect()] == ["p2"]
    run(spark, lake, 2, [5], [], wait=9)
    rows = manifest(spark, 5)
    for _ in range(2):
        ingest_unlanded(lake, rows, catalogue(spark, RULE))
        assert [n for n, _ in gauges(lake)] == ["0", "1", "2", "3"]
        found = audit(lake)
        assert found[0] == (-1, "p5", "payload has no manifest row")
        assert [a[:2] for a in found[1:]] == [(0, "success"), (1, "success"), (2, "success"), (3, "success"), (4, "failed")]
    assert lake.pending().count() == 0


BAD = {
    "logical_url": ["http://h/m", "ftp://h/m", "http:///m", "http://h/m", "http://h/m", "http://h/m", "http://h/m"],
    "module": ["m", "m", "m", " ", "m", "other", "broken"],
}


def test_bad_targets_and_tasks_get_a_failed_row(spark, tmp_path):
    rows = manifest(spark, 7, **BAD).withColumn(
        "collector_labels",
        F.when(F.col("scrape_id") == 4, F.expr("array(named_struct('name', '1x', 'value', 'v'))")).otherwise(F.col("collector_labels")),
    )
    rules = catalogue(spark, RULE).unionByName(
        catalogue(spark, ("x", "gauge"), ("y", "speed")).withColumn("module", F.lit("broken"))
    )
    want = {
        1: "invalid target URL",
        2: "invalid target URL",
        3: "empty module",
        4: "invalid label name",
        5: "task requires at least one metric",
        6: "rule y: invalid metric type",
    }
    good, bad = checked_manifest(rows, rules)
    assert [r.scrape_id for r in good.collect()] == [0] and good.columns == rows.columns
    assert {r.scrape_id: r.violation for r in bad.collect()} == want
    lake = Lake(spark, str(tmp_path / "lake"))
    ingest_batch(lake, 0, payload_frame(spark, ['x{n="1"} 1\n'] * 7), rows, rules)
    assert {a[0]: a[2] for a in audit(lake) if a[1] == "failed"} == want
    assert lake.samples().filter("metric_name = 'x'").count() == 1


def test_a_rule_listed_twice_refuses_its_task_only(spark):
    rules = catalogue(spark, RULE, RULE).unionByName(catalogue(spark, RULE).withColumn("module", F.lit("n")))
    good, bad = checked_manifest(manifest(spark, 2, module=["m", "n"]), rules)
    assert [r.scrape_id for r in good.collect()] == [1]
    assert [r.violation for r in bad.collect()] == ["rule x: family declared more than once"]


def test_rows_without_an_id_are_set_aside_one_by_one(spark):
    rows = manifest(spark, 3).withColumn("scrape_id", F.lit(None).cast("bigint"))
    good, bad = checked_manifest(rows, catalogue(spark, RULE))
    assert good.count() == 0
    assert [r.violation for r in bad.collect()] == ["scrape id out of range"] * 3


def test_inflation_stops_at_the_cap():
    text = b"x 1\n" * 1000
    for pack, name in ((gzip.compress, "gzip"), (gzip.compress, "x-gzip"), (zlib.compress, "deflate")):
        assert inflate(pack(text), name, 4000) == text
        assert len(inflate(pack(text), name, 3999)) == 4000
        assert len(inflate(pack(b"\0" * 50_000_000), name, 100)) == 101
        for broken in (pack(text)[:-9], pack(text)[:5], b"\x1f\x8bnone", b"plain"):
            with pytest.raises(ValueError, match=f"not valid {name} data"):
                inflate(broken, name, 4000)
        assert inflate(pack(b""), name, 10) == b"" == inflate(b"", name, 10)
    raw = zlib.compressobj(wbits=-15)
    assert inflate(raw.compress(text) + raw.flush(), "deflate", 9999) == text
    assert inflate(gzip.compress(b"a") + gzip.compress(b"b"), "gzip", 10) == b"ab"
    with pytest.raises(ValueError, match="unsupported"):
        inflate(b"x", "br", 10)


def test_compressed_payloads_are_read_and_bombs_fail(spark):
    text = b"x 1\n"
    bodies = [text, gzip.compress(text), zlib.compress(text), gzip.compress(text)[:-4], gzip.compress(text + b"#" * 10**6), gzip.compress(b"\xff"), text]
    kinds = [None, "gzip", " Deflate", "gzip", "gzip", "gzip", "identity"]
    rows = manifest(spark, 7, content_encoding=kinds)
    limits = Limits(body_bytes=1000)
    payloads = payload_frame(spark, bodies)
    found = errors(parse_payloads(decoded(payloads, rows, limits), rows, catalogue(spark, RULE), limits))
    assert found == {
        0: None,
        1: None,
        2: None,
        3: "metrics response is not valid gzip data",
        4: "metrics response exceeds 1000 decompressed bytes: http://h/metrics",
        5: "metrics response is not valid UTF-8",
        6: None,
    }
    plain = rows.withColumn("content_encoding", F.lit(None).cast("string"))
    assert decoded(payloads, plain, limits) is payloads, "no Python without an encoding"
