"""Registered queries against DuckDB over the smallest tables, the streams against the batch, and the
library without its training-data part."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from logquill.operators import detectors
from logquill.plans import oracle, queries
from logquill.sources import loglines
from logquill.streaming import alerts, per_second
from logquill.streaming.timed import stream_session

SF = "/root/testdata/sf0.001"
SOME = [
    "parse_lines", "line_classes", "reject_reasons", "unknown_component_anti", "component_counts", "latency_histogram", "skew_filter_median", "sliding_sums",
    "service_system_rollup", "unidentified_ratio_60s", "zscore_fast", "absolute_threshold", "cusum_drift", "alerts_opened", "moved_code", "p95_upper", "latency_shift",
    "silence_runs", "severity_level", "alert_reasons", "redact_documents", "phi_flags", "redact_stats", "origin_closure", "ramp_value", "propagation_rate", "daily_curve_join",
    "ewma_adaptive", "baseline_band", "learned_alerts", "component_table", "alerting_components", "rolling_rate", "breach_severity", "redacted_reasons", "incident_records",
    "advanced_alerts", "severity_hold", "stream_alerts", "stream_learned_alerts", "parser_health", "metric_events", "hour_of_week_baseline", "trace_fanout", "ewma_static", "outbox_stats", "stream_per_second",
    "adopt_candidates", "truth_scores", "merged_incidents", "outbox_after_replay", "stream_clock_guard", "stream_incidents",
]


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        yield con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_duckdb(spark, duck, name):
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = duck.execute(oracle.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]
    assert sorted(names) == columns
    assert sorted((repr([r[c] for c in columns]) for r in frame.collect())) == sorted(repr([r[c] for c in columns]) for r in want)


def test_every_query_with_sql_is_registered():
    assert set(oracle.ORACLE_SQL) <= set(queries.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    """Lines in files of ten seconds each, with a silent component and an error burst."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id < 9000")
    lines = loglines.lines_from_events(events).collect()
    own, folder = stream_session(spark), tmp_path / "log"
    folder.mkdir()
    for k in range(0, 9000, 1500):
        part = [r["value"] for r in sorted(lines, key=lambda r: r["event_id"]) if k <= r["event_id"] < k + 1500]
        (folder / f"part-{k:05d}.log").write_text("\n".join(part) + "\n")
        os.utime(folder / f"part-{k:05d}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    counts = per_second.per_second_stream(per_second.read_log_stream(own, str(folder)))
    table, path = per_second.drained(counts, "t")
    got = {(r["key"], r["sec"]): (r["tot"], r["err"]) for r in table.collect()}
    batch = queries.counting.per_second(queries.parse(loglines.lines_from_events(events)))
    want = {(r["key"], r["sec"]): (r["tot"], r["err"]) for r in batch.collect()}
    last = max(s for _, s in want)
    assert got == {k: v for k, v in want.items() if k[1] <= last - 2}
    opened, _ = per_second.drained(alerts.fast_alerts(own.readStream.schema(table.schema).parquet(path)), "a")
    rows = detectors.with_baseline(queries.windows.sliding(queries.windows.dense(batch.where(f"sec <= {last - 2}"))))
    rows = detectors.hysteresis(rows.withColumn("hit", detectors.z_rule(rows, 10, detectors.Z_FAST)), queries.F.col("hit"), queries.F.lit(detectors.K_FAST))
    expected = {(r["key"], r["sec"]) for r in rows.where("opened_now").collect()}
    assert {(r["key"], r["opened_sec"]) for r in opened.collect()} == expected and expected


def test_library_stands_without_training_data_operators():
    code = "import sys; sys.modules['logquill.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); assert 'zscore_fast' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
