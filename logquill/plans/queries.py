"""The registered queries of the log engine: the events table told as a log, run through the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.operators import baseline, counting, detectors, drift, faults, incidents, merged, redaction, reporting, seasonal, severity, truth, windows
from logquill.operators.parse import parse
from logquill.sources import outbox
from logquill.sources import vocabulary as voc
from logquill.sources.loglines import EPOCH_MS, lines_from_events, with_wrong_clocks
from logquill.sources.tables import shared_folder, written
from logquill.streaming import alerts as stream
from logquill.streaming import clock, lifecycle, monitor
from logquill.streaming.per_second import drained, event_stream, per_second_stream, settled_counts
from logquill.streaming.timed import stream_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIRST_SEC = EPOCH_MS // 1000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_events(table(spark, sf_dir, "events"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(lines(spark, sf_dir))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense calendar over per-second counts, which are written: they are as good as nothing beside
    the log, and the log is parsed once."""
    return windows.dense(written(counting.per_second(parsed(spark, sf_dir)), "per-second"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sliding(dense(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.alert_states(sums(spark, sf_dir))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(detectors.alerts(states(spark, sf_dir)), "alerts")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query
def parse_lines(spark, d):
    columns = ["event_id", "class", "ts_ms", "level", "level_class", "key", "code", "latency_ms", "trace", "raw_len"]
    return parsed(spark, d).select(*columns, F.array_join("flags", ",").alias("flags"))


@query
def line_classes(spark, d):
    return counting.line_classes(parsed(spark, d))


@query
def reject_reasons(spark, d):
    return counting.reject_reasons(lines(spark, d))


@query
def unknown_component_anti(spark, d):
    return counting.unknown_components(parsed(spark, d))


@query
def known_code_semi(spark, d):
    return counting.known_codes(parsed(spark, d))


@query
def per_second_counts(spark, d):
    return counting.per_second(parsed(spark, d))


@query
def component_counts(spark, d):
    return counting.component_counts(parsed(spark, d))


@query
def code_counts_by_component(spark, d):
    return counting.code_counts(parsed(spark, d))


@query
def code_counts_by_second(spark, d):
    return counting.code_counts(parsed(spark, d), by_second=True)


@query
def latency_histogram(spark, d):
    return counting.latency_histogram(parsed(spark, d))


@query
def unmapped_codes(spark, d):
    return counting.unmapped_codes(parsed(spark, d))


@query
def skew_filter_median(spark, d):
    return counting.skew_filter(parsed(spark, d))


@query
def sliding_sums(spark, d):
    return sums(spark, d)


@query
def error_rates(spark, d):
    rows = sums(spark, d)
    return rows.select("key", "sec", *(F.round(s.rate(F.col(f"err{w}"), F.col(f"tot{w}")), 6).alias(f"rate{w}") for w in (10, 60, 300)))


@query
def service_system_rollup(spark, d):
    return windows.rollup(sums(spark, d))


@query
def unidentified_ratio_60s(spark, d):
    return drift.unidentified_ratio(parsed(spark, d))


@query
def top_unknown_keys(spark, d):
    return counting.top_unknown_keys(parsed(spark, d))


@query
def adopt_candidates(spark, d):
    return counting.adopt_candidates(parsed(spark, d))


@query
def zscore_fast(spark, d):
    rows = detectors.with_baseline(sums(spark, d))
    z = s.binomial_z(F.col("err10"), F.col("tot10"), F.col("base"))
    return rows.select("key", "sec", "tot10", "err10", F.round(z, 6).alias("z10"), detectors.z_rule(rows, 10, detectors.Z_FAST).alias("breach"))


@query
def zscore_slow(spark, d):
    rows = detectors.with_baseline(sums(spark, d))
    z = s.binomial_z(F.col("err60"), F.col("tot60"), F.col("base"))
    return rows.select("key", "sec", "tot60", "err60", F.round(z, 6).alias("z60"), detectors.z_rule(rows, 60, detectors.Z_SLOW).alias("breach"))


@query
def wilson_low_volume(spark, d):
    rows = sums(spark, d).where(F.col("key").isin(*detectors.WILSON_KEYS))
    bound = s.wilson_lower(F.col("err30"), F.col("tot30"))
    return rows.select("key", "sec", "tot30", "err30", F.round(bound, 6).alias("lower_bound"), detectors.wilson_rule().alias("breach"))


@query
def absolute_threshold(spark, d):
    rows = detectors.with_thresholds(sums(spark, d))
    return rows.select("key", "sec", "window_s", "t_tot", "t_err", detectors.threshold_rule().alias("breach"))


@query
def cusum_drift(spark, d):
    rows = detectors.cusum(detectors.with_baseline(sums(spark, d)))
    return rows.select("key", "sec", F.round("cusum", 6).alias("cusum"), (F.round("cusum", 6) > detectors.CUSUM_LIMIT).alias("breach"))


@query
def rule_priority(spark, d):
    return detectors.rules(sums(spark, d)).where("rule IS NOT NULL").select("key", "sec", "rule")


@query
def hysteresis_open_intervals(spark, d):
    return rounded(detectors.open_intervals(states(spark, d)), "peak_z")


@query
def alerts_opened(spark, d):
    return rounded(alerts(spark, d), "observed", "z", "baseline")


@query
def rollup_alerts(spark, d):
    return rounded(detectors.rollup_alerts(windows.rollup(sums(spark, d))), "observed")


def mix(spark, d):
    per_code = written(counting.code_counts(parsed(spark, d), by_second=True), "code-seconds")
    w = sums(spark, d)
    return drift.mix_drift(drift.code_mix(per_code, w), w)


@query
def js_code_mix(spark, d):
    return mix(spark, d).select("key", "sec", "js", "drifted")


@query
def moved_code(spark, d):
    return mix(spark, d).select("key", "sec", "moved_code", "moved_by")


@query
def p95_upper(spark, d):
    return drift.percentiles(counting.latency_histogram(parsed(spark, d))).select("key", "upper_ms")


@query
def p95_lower(spark, d):
    return drift.percentiles(counting.latency_histogram(parsed(spark, d))).select("key", "lower_ms")


@query
def latency_shift(spark, d):
    return drift.latency_shift(parsed(spark, d))


@query
def silence_runs(spark, d):
    return drift.silence_runs(dense(spark, d))


@query
def new_code(spark, d):
    p = parsed(spark, d)
    return drift.new_codes(counting.code_counts(p, by_second=True), counting.per_second(p))


@query
def log_format_drift(spark, d):
    return drift.format_drift(drift.unidentified_ratio(parsed(spark, d)))


@query
def severity_score(spark, d):
    return severity.scored(alerts(spark, d)).select("key", "rule", "opened_sec", "criticality", F.round("burn_rate", 6).alias("burn_rate"), "score")


@query
def severity_level(spark, d):
    return severity.scored(alerts(spark, d), minutes_to_cutoff=75.0).select("key", "rule", "opened_sec", "score", "severity")


@query
def alert_reasons(spark, d):
    return severity.reasons(alerts(spark, d)).select("key", "rule", "opened_sec", "reason")


@query
def redact_documents(spark, d):
    return redaction.redact_column(table(spark, d, "documents").select("doc_id", "text"), "text")


@query
def redact_pages(spark, d):
    return redaction.redact_column(table(spark, d, "pages").select("page_id", "html"), "html")


@query
def phi_flags(spark, d):
    return redaction.flags(table(spark, d, "documents"), "doc_id", "text")


@query
def redact_stats(spark, d):
    return redaction.stats(table(spark, d, "documents"), "text")


@query
def origin_closure(spark, d):
    return incidents.suspected_origins(alerts(spark, d))


@query
def downstream_chain(spark, d):
    return incidents.downstream_chains(incidents.suspected_origins(alerts(spark, d)))


@query
def incident_sessions(spark, d):
    return incidents.incident_sessions(alerts(spark, d))


@query
def incident_states(spark, d):
    return incidents.incident_state(incidents.incident_sessions(alerts(spark, d)), FIRST_SEC + 400)


@query
def cascade_groups(spark, d):
    return incidents.cascades(incidents.suspected_origins(alerts(spark, d)))


@query
def fault_interval_join(spark, d):
    return faults.live_faults(dense(spark, d).select("key", "sec"), faults.scheduled(spark, FIRST_SEC)).select("key", "sec", "fault", "kind")


@query
def ramp_value(spark, d):
    return faults.fault_values(dense(spark, d).select("key", "sec"), faults.scheduled(spark, FIRST_SEC))


@query
def truth_evaluation(spark, d):
    return faults.evaluate(alerts(spark, d), faults.scheduled(spark, FIRST_SEC))


@query
def propagation_rate(spark, d):
    return faults.expected_rates(sums(spark, d))


@query
def daily_curve_join(spark, d):
    return faults.daily_volume(table(spark, d, "events"))


@query
def hour_of_week_baseline(spark, d):
    return faults.hour_of_week(table(spark, d, "events"))


@query
def seasonal_alerts(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("key"), seasonal.hour_of_week(F.col("ts")).alias("how"), "value")
    usual = written(seasonal.baseline(seasonal.summary(rows, "value", "key", "how"), "key", "how"), "seasonal")
    return rounded(seasonal.seasonal_alerts(rows, "value", usual, "key", "how"), "median", "mad", "z")


@query
def trace_fanout(spark, d):
    return counting.trace_fanout(parsed(spark, d))


@query
def ewma_static(spark, d):
    return baseline.ewma(sums(spark, d))


def learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.learned(sums(spark, sf_dir))


@query
def ewma_adaptive(spark, d):
    return rounded(learned(spark, d).select("key", "sec", "ewma", "sigma", F.col("open").alias("frozen"), F.col("z10").alias("z")), "ewma", "sigma", "z")


@query
def baseline_band(spark, d):
    return rounded(baseline.band(learned(spark, d)), "lower", "upper")


@query
def learned_alerts(spark, d):
    return rounded(detectors.alerts(learned(spark, d)), "observed", "z", "baseline")


@query
def component_table(spark, d):
    return reporting.component_table(learned(spark, d))


@query
def alerting_components(spark, d):
    return reporting.open_components(learned(spark, d))


@query
def alerts_since(spark, d):
    return reporting.alerts_since(alerts(spark, d), FIRST_SEC + 60).select("key", "rule", "opened_sec")


@query
def last_alerts(spark, d):
    return reporting.last_alerts(alerts(spark, d)).select("key", "rule", "opened_sec")


@query
def last_seconds(spark, d):
    return reporting.last_seconds(dense(spark, d))


@query
def rolling_rate(spark, d):
    return rounded(reporting.rolling_rate(counting.per_second(parsed(spark, d))), "rate")


@query
def severity_counts(spark, d):
    return reporting.severity_counts(severity.scored(alerts(spark, d)))


@query
def routed_alerts(spark, d):
    return reporting.routed(severity.scored(alerts(spark, d))).select("key", "rule", "opened_sec", "severity", "route")


@query
def alert_neighbours(spark, d):
    return reporting.neighbours(alerts(spark, d))


@query
def breach_severity(spark, d):
    rows = severity.explained(severity.scored(severity.breaches(states(spark, d))))
    return rounded(rows.select("key", "rule", "opened_sec", "seconds_in_breach", "z", "observed", "score", "severity", "reason"), "z", "observed")


@query
def redacted_reasons(spark, d):
    rows = severity.reasons(alerts(spark, d)).withColumn("reason", F.concat("reason", F.lit("; seen with MBR-"), F.col("total").cast("string")))
    return redaction.redact_all(rows.select("key", "rule", "opened_sec", "reason"), keep=("key", "rule", "opened_sec"))


@query
def incident_records(spark, d):
    found = alerts(spark, d)
    return incidents.records(incidents.incident_sessions(found), severity.scored(found), incidents.suspected_origins(found), FIRST_SEC + 400)


@query
def advanced_alerts(spark, d):
    p, every = parsed(spark, d), dense(spark, d)
    new = drift.new_codes(counting.code_counts(p, by_second=True), counting.per_second(p))
    return drift.advanced_alerts(every, mix(spark, d), drift.latency_shift(p), new, drift.silence_runs(every))


@query
def sample_summaries(spark, d):
    return reporting.sample_summaries(parsed(spark, d))


@query
def parser_health(spark, d):
    p = parsed(spark, d)
    return reporting.parser_health(p, drift.unidentified_ratio(p))


@query
def routed_lines(spark, d):
    return reporting.routed_lines(counting.reject_reasons(lines(spark, d)))


@query
def skew_kept_lines(spark, d):
    return counting.without_skew(parsed(spark, d), bound_s=30).select("event_id", "sec")


@query
def metric_events(spark, d):
    return outbox.metric_events(sums(spark, d))


@query
def severity_hold(spark, d):
    rows = sums(spark, d)
    burn = F.round(s.rate(F.col("err60"), F.col("tot60")) * 5, 6)
    return severity.hold_levels(rows.select("key", "sec", s.severity_level(burn).alias("severity")))


def outbox_rows(spark, d):
    """Outbox of all opened alerts; every fourth second's were delivered, every fifth's tried once."""
    rows = outbox.entries(alerts(spark, d).select("key", "rule", "opened_sec"))
    return rows.withColumn("status", F.when(F.col("created_s") % 4 == 0, "delivered").otherwise("pending")).withColumn("attempts", F.when(F.col("created_s") % 5 == 0, 1).otherwise(0))


@query
def outbox_pending(spark, d):
    return outbox.pending(outbox_rows(spark, d), FIRST_SEC + 100_000, limit=50).select("idempotency_key", "attempts", "next_attempt_s")


@query
def outbox_stats(spark, d):
    return outbox.stats(outbox_rows(spark, d))


@query
def alert_dedupe(spark, d):
    rows = alerts(spark, d).select("key", "rule", "opened_sec")
    return outbox.entries(rows.union(rows)).select("idempotency_key", "status", "created_s")


@query
def error_rate_alarms(spark, d):
    return outbox.alarms(dense(spark, d))


def streamed_counts(spark, d):
    return per_second_stream(lines_from_events(event_stream(spark, f"{d}/events.parquet")))


def settled(spark, d):
    """Settled counts as a stream, in a session for streams."""
    own = stream_session(spark)
    counts, path = drained(streamed_counts(own, d), "stream-counts")
    return own.readStream.schema(counts.schema).parquet(path)


@query
def stream_per_second(spark, d):
    return drained(streamed_counts(stream_session(spark), d), "stream-counts")[0]


@query
def stream_alerts(spark, d):
    return rounded(drained(stream.fast_alerts(settled(spark, d)), "stream-alerts")[0], "z")


@query
def stream_learned_alerts(spark, d):
    return rounded(drained(stream.learned_alerts(settled(spark, d)), "stream-learned")[0], "baseline")


@query
def stream_silence(spark, d):
    return rounded(drained(stream.silence_alerts(settled(spark, d)), "stream-silence")[0], "usual")


@query
def stream_clock_guard(spark, d):
    """Settled counts of lines with right clocks, and counts of those with wrong ones."""
    own = stream_session(spark)
    path = f"{shared_folder(own)}/logquill/stream-clocks-{uuid.uuid4().hex}"
    clock.guard(with_wrong_clocks(lines_from_events(event_stream(own, f"{d}/events.parquet"))), path, f"{path}/checkpoint")
    good, aside = clock.guarded(own, path)
    counts = drained(settled_counts(good), "stream-counts")[0].select(F.lit("ok").alias("clock"), "key", "sec", "tot", "err")
    return counts.unionByName(aside.groupBy("clock", "key", "sec").agg(F.count("*").alias("tot"), F.count_if(F.col("level_class").between(2, 3)).alias("err")))


def told(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Events of components over days, a second each, with k and rule: some are told as alerts, acknowledgements or faults."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("event_id", "event_type", k.alias("k"), F.pmod("user_id", F.lit(20)).cast("int").alias("idx"), (F.lit(FIRST_SEC) + F.col("event_id")).alias("sec"))
    return rows.join(F.broadcast(voc.components(spark).select("idx", "key")), "idx").withColumn("rule", F.when(F.col("k") < 3, "fast").otherwise("slow"))


def told_alerts(spark, d):
    rows = told(spark, table(spark, d, "events")).where("event_type = 'error' AND k < 30")
    return rows.select("key", "rule", F.col("sec").alias("opened_sec")).distinct()


def told_faults(spark, d):
    rows = told(spark, table(spark, d, "events")).where("event_type = 'purchase' AND k < 4")
    return rows.select("key", F.col("event_id").alias("fault"), F.col("sec").alias("start_sec"), (F.col("sec") + 120 + F.col("event_id") % 7 * 60).alias("end_sec"))


@query
def stream_incidents(spark, d):
    """Incidents' lives, from a stream of alerts and acknowledgements."""
    own = stream_session(spark)
    rows = told(own, event_stream(own, f"{d}/events.parquet"))
    life = lifecycle.incident_life(rows.where("event_type = 'error' AND k < 30"), rows.where("event_type = 'signup' AND k < 8"))
    return drained(life, "stream-incidents")[0]


@query
def merged_incidents(spark, d):
    none = spark.createDataFrame([], "key string, sec long, release string")
    return merged.merged_incidents(told_alerts(spark, d), none).drop("deploy", "deploy_sec")


@query
def incident_deploy(spark, d):
    return merged.merged_incidents(alerts(spark, d), merged.deploy_lines(parse(merged.maybe_deploys(lines(spark, d)))))


@query
def truth_pairs(spark, d):
    return truth.matched(told_alerts(spark, d), told_faults(spark, d))


@query
def truth_scores(spark, d):
    hours = table(spark, d, "events").count() / 3600
    return truth.scores(told_alerts(spark, d), told_faults(spark, d), hours)


@query
def outbox_after_replay(spark, d):
    """An outbox filled by a stream of which every batch comes twice, after one round of deliveries and cleaning."""
    own = stream_session(spark)
    rows = written(told_alerts(spark, d).repartition(3, "opened_sec"), "outbox-alerts")
    path = f"{shared_folder(own)}/logquill/outbox-{uuid.uuid4().hex}"
    record = outbox.record_batches(path)
    stream = own.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(rows.inputFiles()[0].rpartition("/")[0])
    again = lambda batch, n: (record(batch, n), record(batch, n))
    stream.writeStream.foreachBatch(again).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    every = outbox.add(outbox.stored_entries(spark, path).drop("batch"), outbox.entries(rows))  # none of them is new
    results = every.where("created_s % 4 < 2").select("idempotency_key", (F.col("created_s") % 4 == 0).alias("ok"))
    settled = outbox.settle(every, results, FIRST_SEC + 1000)
    return outbox.clean(settled, FIRST_SEC + 1000 + outbox.KEEP_DAYS * 86400).select("idempotency_key", "status", "attempts", "created_s")


@query
def future_lines(spark, d):
    """Lines of which the clock was ahead, if the log had been read when half of its time was over."""
    p = parsed(spark, d)
    now = p.agg(F.floor((F.min("sec") + F.max("sec")) / 2)).first()[0]
    return monitor.split_future(p, now, bound_s=60)[1].select("event_id", "sec")
