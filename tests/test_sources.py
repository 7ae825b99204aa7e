"""Vocabularies from files, ground truth, delivery in batches, the stream listener and folders."""

import json

import pytest
from pyspark.sql import functions as F

from logquill.operators import counting
from logquill.operators.parse import parse
from logquill.sources import loglines, outbox, tables
from logquill.sources import vocabulary as voc
from logquill.streaming import monitor


def test_vocabulary_from_files(tmp_path):
    yaml = pytest.importorskip("yaml")
    catalog = {
        "services": {"AAA": {"name": "first"}},
        "components": {"BBB": {"service": "AAA", "criticality": 0.5, "name": "part"}, "CCC": {"service": "AAA", "criticality": 0.9, "name": "other"}},
        "codes": {"E0001": {"component": "BBB", "weight": 1.0, "latency_ms": 5, "latency_min_ms": 1, "template": "FAILED n={n}"}},
    }
    platform = {
        "components": {"BBB": {"rps": 10, "err": 0.01, "p50_ms": 5}, "CCC": {"rps": 1, "err": 0.02, "warn": 0.1, "p50_ms": 9}},
        "propagation": [{"from": "AAA.BBB", "to": "AAA.CCC", "coupling": 0.5, "lag_s": 2}],
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(catalog))
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(platform))
    got = voc.load_yaml(str(tmp_path / "c.yaml"), str(tmp_path / "p.yaml"))
    assert [r[1] for r in got.component_rows()] == ["AAA.BBB", "AAA.CCC"] and got.code_rows()[0][1] == "AAA.BBB"
    del platform["components"]["CCC"]
    (tmp_path / "p.yaml").write_text(yaml.safe_dump(platform))
    with pytest.raises(voc.ConfigError):
        voc.load_yaml(str(tmp_path / "c.yaml"), str(tmp_path / "p.yaml"))


def test_truth_records(spark, tmp_path):
    rows = [{"seq": 1, "event": "start", "target": "CLM.STR", "at_ms": 5, "detail": {"rate": "0.25"}}, {"seq": 2, "event": "end", "target": "CLM.STR", "at_ms": 9}]
    (tmp_path / "truth.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = loglines.read_truth(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["event"], r["at_ms"]) for r in got] == [("start", 5), ("end", 9)] and got[0]["detail"] == {"rate": "0.25"} and got[1]["detail"] is None


def test_delivery_in_batches(spark):
    seen = []
    deliver = outbox.deliver_batches(lambda df: seen.append(sorted((r["batch_id"], r["created_s"]) for r in df.collect())))
    alerts = spark.createDataFrame([("a", "fast", 5), ("a", "fast", 5), ("b", "slow", 7)], "key string, rule string, opened_sec long")
    deliver(alerts, 3)
    assert seen == [[(3, 5), (3, 7)]]


def test_listener_counts_rows(spark, tmp_path):
    listener = monitor.Progress()
    spark.streams.addListener(listener)
    try:
        (tmp_path / "in").mkdir()
        (tmp_path / "in" / "a.log").write_text("x\ny\nz\n")
        stream = spark.readStream.text(str(tmp_path / "in"))
        query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        for _ in range(100):
            if listener.queries.get(str(query.id), {}).get("ended"):
                break
            __import__("time").sleep(0.1)
        assert listener.queries[str(query.id)]["rows"] == 3 and listener.queries[str(query.id)]["ended"]
    finally:
        spark.streams.removeListener(listener)


def test_future_lines_are_told_apart(spark):
    near, far = monitor.split_future(spark.createDataFrame([(1, 100), (2, 400), (3, 401), (4, None)], "event_id long, sec long"), 100)
    assert {r["event_id"] for r in near.collect()} == {1, 2, 4} and {r["event_id"] for r in far.collect()} == {3}


def test_parsing_by_hand(spark):
    """Lines with literal answers, invalid UTF-8 and a carriage return among them."""
    head = b"1700000000123|E|CLM|STR|E4410|000042|0000abcd|"
    lines = [head + b"CLAIM_DB_TIMEOUT", head + b"bad \xff byte", head + b"kept\r", head[:30] + b"00x042" + head[36:] + b"m", b"short", head[:16] + b"ZZZ|QQQ" + head[23:] + b"m"]
    got = parse(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)], "event_id int, value binary")).orderBy("event_id").collect()
    assert [r["class"] for r in got] == ["valid", "non_utf8_message", "valid", "valid", "malformed_header", "unknown_component"]
    assert (got[0]["ts_ms"], got[0]["sec"], got[0]["level_class"], got[0]["key"], got[0]["code"], got[0]["latency_ms"], got[0]["trace"], got[0]["message"]) == (1700000000123, 1700000000, 2, "CLM.STR", "E4410", 42, "0000abcd", "CLAIM_DB_TIMEOUT")
    assert got[2]["message"] == "kept" and got[3]["latency_ms"] == -1


def test_median_lies_in_any_hour(spark):
    import random

    rng = random.Random(3)
    for _ in range(4):
        seconds = [rng.choice([0, 7200, 7200, 90000]) + rng.randint(0, 5000) for _ in range(rng.randint(1, 60))]
        df = spark.createDataFrame([(x,) for x in seconds], "sec long").groupBy("sec").agg(F.count("*").alias("n"))
        assert counting.median_second(df).first()["median_sec"] == sorted(seconds)[len(seconds) // 2]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_folder(Session())
