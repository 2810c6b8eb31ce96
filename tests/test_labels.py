import random

from pyspark.sql import functions as F

from scrapelake.functions import labels as L
from scrapelake.schema import Limits

INPUT = "endpoint map<string,string>, collector array<struct<name:string,value:string>>, honor boolean, ip string"


def merge(spark, cases):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {INPUT}")
    merged = L.merge_labels(F.col("endpoint"), F.col("collector"), F.col("honor"), F.col("ip"))
    return [r.m for r in frame.select("i", merged.alias("m")).orderBy("i").collect()]


def test_merges_as_tables(spark):
    """Each case with its whole result."""
    cases = {
        "endpoint kept": ({"zone": "z9"}, [("zone", "own"), ("shard", "4")], True, "::7"),
        "endpoint moved": ({"zone": "z9", "le": "2"}, [("zone", "own")], False, "10.1.2.3"),
        "next free name": ({"zone": "z9", "exported_zone": "old"}, [("zone", "own")], False, "10.1.2.3"),
        "own exported name": ({"zone": "z9"}, [("exported_zone", "mine"), ("zone", "own")], False, "10.1.2.3"),
        "address forced": ({"resolved_ip": "elsewhere", "q": ""}, [], False, "10.1.2.3"),
        "nothing": ({}, [], True, ""),
    }
    expected = {
        "endpoint kept": {"zone": "z9", "shard": "4", "resolved_ip": "::7"},
        "endpoint moved": {"exported_zone": "z9", "le": "2", "zone": "own", "resolved_ip": "10.1.2.3"},
        "next free name": {"exported_exported_zone": "z9", "exported_zone": "old", "zone": "own", "resolved_ip": "10.1.2.3"},
        "own exported name": {"exported_exported_zone": "z9", "exported_zone": "mine", "zone": "own", "resolved_ip": "10.1.2.3"},
        "address forced": {"resolved_ip": "10.1.2.3", "q": ""},
        "nothing": {"resolved_ip": ""},
    }
    assert dict(zip(cases, merge(spark, list(cases.values())), strict=True)) == expected


def test_random_merges_lose_no_value(spark):
    random.seed(3)
    names = ["u", "exported_u", "exported_exported_u", "v", "exported_v"]
    cases = []
    for _ in range(400):
        endpoint = {n: f"e{n}" for n in random.sample(names, random.randrange(6))}
        collector = [(n, f"c{n}") for n in random.sample(names, random.randrange(5))]
        cases.append((endpoint, collector, random.random() < 0.3, "ip"))
    for (endpoint, collector, honor, ip), merged in zip(cases, merge(spark, cases), strict=True):
        assert merged["resolved_ip"] == ip
        values = sorted(v for n, v in merged.items() if n != "resolved_ip")
        if honor:
            assert merged == dict(collector) | endpoint | {"resolved_ip": ip}
            continue
        assert values == sorted([*endpoint.values(), *(v for _, v in collector)]), "each value once"
        assert all(merged[n] == v for n, v in collector)
        for name, value in endpoint.items():
            (place,) = [n for n, v in merged.items() if v == value]
            prefixes = place.removesuffix(name)
            assert prefixes == "exported_" * (len(prefixes) // 9)
            assert bool(prefixes) == (name in dict(collector))


def test_key_ignores_order_and_escapes(spark):
    frame = spark.createDataFrame(
        [({"b": "2", "a": '"\\\n/é'},), ({"a": '"\\\n/é', "b": "2"},), ({},)], "m map<string,string>"
    )
    keys = [r.k for r in frame.select(L.labels_key(F.col("m")).alias("k")).collect()]
    assert keys == ['{"a":"\\"\\\\\\n/é","b":"2"}'] * 2 + ["{}"]


def test_collector_labels(spark):
    schema = "task array<struct<name:string,value:string>>, target array<struct<name:string,value:string>>, ip string, port int"
    frame = spark.createDataFrame(
        [
            ([("cluster", "c"), ("job", "no")], [("role", "r"), ("module", "own")], "10.0.0.1", 80),
            ([], [("instance", "mine")], "::1", 9090),
            ([], [], "2001:db8::1", 443),
        ],
        schema,
    )
    column = L.collector_labels(
        F.col("task"), F.lit("s"), F.lit("m"), F.lit("j"), F.col("target"), F.col("ip"), F.col("port")
    )
    first, second, third = [[tuple(e) for e in r.l] for r in frame.select(column.alias("l")).collect()]
    assert first == [("cluster", "c"), ("job", "j"), ("system", "s"), ("module", "own"), ("role", "r"), ("instance", "10.0.0.1:80")]
    assert second == [("system", "s"), ("module", "m"), ("job", "j"), ("instance", "mine")]
    assert third[-1] == ("instance", "[2001:db8::1]:443")


def test_label_caps(spark):
    frame = spark.createDataFrame([({"a": "é" * 3},), ({"a": "12345"},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    fault = L.label_fault(F.col("m"), Limits(labels=1, label_value_bytes=5), merged=True)
    assert [r.f for r in frame.select(fault.alias("f")).collect()] == [
        "merged label value limit (5) exceeded for a",
        None,
        "merged label limit (1) exceeded",
    ]
