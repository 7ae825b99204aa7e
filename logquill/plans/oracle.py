"""DuckDB equivalents of the registered queries, put together from common table expressions."""

from __future__ import annotations

import re

from logquill.functions import redact as r
from logquill.sources import vocabulary as voc
from logquill.sources import loglines as ll
from logquill.sources.loglines import EPOCH_MS, FAULT_FIRST, FAULT_INDEX, FAULT_LAST, FAULT_SHARE

FIRST_SEC = EPOCH_MS // 1000


def _values(rows: list[tuple]) -> str:
    tell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x) + ("::DOUBLE" if isinstance(x, float) else "")
    return "VALUES " + ", ".join("(" + ", ".join(map(tell, row)) + ")" for row in rows)


def _redacted(column: str) -> str:
    for _, pattern in r.PATTERNS:
        column = f"regexp_replace({column}, '{pattern}', '{r.MARK}', 'g')"
    return column


def _z(err: str, tot: str, base: str) -> str:
    return f"CASE WHEN {tot} <= 0 THEN 0.0 WHEN {tot} * {base} * (1 - {base}) < 1e-9 THEN CASE WHEN {err} > 0 THEN 64.0 ELSE 0.0 END ELSE ({err} - {tot} * {base}) / sqrt({tot} * {base} * (1 - {base})) END"


def _rate(err: str, tot: str) -> str:
    return f"({err} / greatest({tot}, 1))"


def _r6(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def _sliding(values: tuple[str, ...], windows: tuple[int, ...], source: str, keys: str = "key") -> str:
    parts = ", ".join(f"CAST(sum({v}) OVER (PARTITION BY {keys} ORDER BY sec ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS {v}{w}" for w in windows for v in values)
    return f"SELECT *, {parts} FROM {source}"


def _during(x: tuple[int, int, int]) -> str:
    return f"(idx = {x[0]} AND event_id * 20 // 1000 BETWEEN {x[1]} AND {x[2]})"


REJECTED = "('oversized_line', 'malformed_header', 'bad_timestamp', 'bad_level', 'unknown_component')"
_SCHEDULE = [(i, kind, key, float(t), float(ramp), FIRST_SEC + 10 + i * 15, FIRST_SEC + 10 + i * 15 + int(ramp + hold)) for i, (_, kind, key, t, ramp, hold) in enumerate(voc.SCENARIOS)]
_LIMIT, _WINDOW, _LEAST = voc.DEFAULT_THRESHOLD

#: Of alerts (key, rule, opened_sec): each with the first alert of those that belong together.
_GROUPS = """
        WITH RECURSIVE n AS (SELECT *, lpad(CAST(opened_sec AS VARCHAR), 12, '0') || '|' || key || '|' || rule AS id FROM {0}),
        near AS (SELECT x.id AS a, y.id AS b FROM n x JOIN near_keys k ON k.key = x.key JOIN n y ON y.key = k.near AND abs(x.opened_sec - y.opened_sec) <= 120),
        reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
        SELECT n.key, n.opened_sec, n.id, (SELECT min(b) FROM reach WHERE a = n.id) AS root FROM n"""

#: name: (names it needs, SQL)
CTES: dict[str, tuple[str, str]] = {
    "components(idx, key, service, component, criticality, rps, err, warn, p50_ms)": ("", _values(voc.DEFAULT.component_rows())),
    "codes(code, key, level, weight, place, places, latency_min_ms, template)": ("", _values(voc.DEFAULT.code_rows())),
    "edges(src, dst, coupling, lag_s)": ("", _values([(a, b, float(c), float(x)) for a, b, c, x in voc.EDGES])),
    "thresholds(key, limit_rate, window_s, min_n)": ("", _values(list(voc.THRESHOLDS))),
    "curve(hour, volume, err_mult)": ("", _values([(h, v, e) for a, b, v, e in voc.DAILY for h in range(a, b + 1)])),
    "faults(fault, kind, key, target, ramp_s, start_sec, end_sec)": ("", _values(_SCHEDULE)),
    "lines": ("components codes", f"""
        SELECT event_id, CASE event_id % 997
            WHEN 1 THEN 'garbage line without a header'
            WHEN 2 THEN substr(line, 1, 19) || ',' || substr(line, 21)
            WHEN 3 THEN substr(line, 1, 12) || 'a' || substr(line, 14)
            WHEN 4 THEN substr(line, 1, 14) || 'X' || substr(line, 16)
            WHEN 5 THEN substr(line, 1, 16) || 'ZZZ|QQQ' || substr(line, 24)
            WHEN 6 THEN substr(line, 1, 14) || 'E' || substr(line, 16, 9) || 'E9999' || substr(line, 30)
            WHEN 7 THEN substr(line, 1, 46) || repeat('x', 9000)
            ELSE line END AS value
        FROM (
            SELECT e.event_id, CAST({EPOCH_MS} + e.event_id * 20 AS VARCHAR) || '|' || e.level || '|' || CASE WHEN e.newcomer THEN '{ll.UNKNOWN}' ELSE c.service || '|' || c.component END || '|'
                || CASE WHEN e.unlisted THEN '{ll.UNLISTED}' ELSE coalesce(k.code, '00000') END || '|'
                || lpad(CAST(CAST(floor(e.value * 10) AS BIGINT) * CASE WHEN e.slow THEN {ll.SLOWER} ELSE 1 END AS VARCHAR), 6, '0') || '|'
                || lower(lpad(hex(e.event_id // {ll.TRACED}), 8, '0')) || '|' || CASE WHEN e.event_id % 499 = 7 THEN 'DEPLOY release=R-' || e.event_id
                    ELSE replace(coalesce(k.template, 'ok event={{n}}'), '{{n}}', CAST(e.event_id AS VARCHAR)) END AS line
            FROM (
                SELECT *, {_during(ll.NEWCOMER)} AND k < 60 AS newcomer, {_during(ll.NEW_CODE)} AND k < 50 AS unlisted, {_during(ll.SLOW)} AS slow, CASE
                    WHEN {_during(ll.BURST)} AND event_type = 'view' AND k < 60 THEN 'E'
                    WHEN idx = {FAULT_INDEX} AND event_id * 20 // 1000 BETWEEN {FAULT_FIRST} AND {FAULT_LAST} AND event_type IN ('error', 'view') AND k < {FAULT_SHARE} THEN 'E'
                    WHEN event_type = 'error' AND k < 6 THEN 'E' WHEN event_type = 'purchase' AND k < 30 THEN 'W' ELSE 'I' END AS level
                FROM (SELECT event_id, event_type, value, user_id % 20 AS idx, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE NOT {_during(ll.SILENT)}
            ) e JOIN components c ON e.idx = c.idx
            LEFT JOIN codes k ON k.key = c.key AND k.level = e.level AND e.k % k.places = k.place
        )"""),
    "fields": ("lines", """
        SELECT event_id, value, length(value) AS raw_len, length(value) BETWEEN 46 AND 8192 AS whole,
            CASE WHEN length(value) BETWEEN 46 AND 8192 AND regexp_full_match(substr(value, 1, 13), '[0-9]{13}') THEN CAST(substr(value, 1, 13) AS BIGINT) END AS ts_ms,
            CASE WHEN length(value) BETWEEN 46 AND 8192 THEN substr(value, 15, 1) END AS level,
            CASE WHEN length(value) BETWEEN 46 AND 8192 THEN substr(value, 17, 3) END AS service,
            CASE WHEN length(value) BETWEEN 46 AND 8192 THEN substr(value, 21, 3) END AS component,
            CASE WHEN length(value) BETWEEN 46 AND 8192 THEN substr(value, 25, 5) END AS code,
            CASE WHEN length(value) BETWEEN 46 AND 8192 AND regexp_full_match(substr(value, 31, 6), '[0-9]{6}') THEN CAST(substr(value, 31, 6) AS INTEGER) ELSE -1 END AS latency_ms,
            CASE WHEN length(value) BETWEEN 46 AND 8192 THEN substr(value, 38, 8) END AS trace,
            substr(value, 14, 1) || substr(value, 16, 1) || substr(value, 20, 1) || substr(value, 24, 1) || substr(value, 30, 1) || substr(value, 37, 1) || substr(value, 46, 1) = '|||||||' AS parted
        FROM lines"""),
    "checked": ("fields components codes", """
        SELECT f.*, concat_ws('.', f.service, f.component) AS key,
            CASE f.level WHEN 'I' THEN 0 WHEN 'W' THEN 1 WHEN 'E' THEN 2 WHEN 'F' THEN 3 ELSE 255 END AS level_class,
            raw_len > 8192 AS oversized, raw_len < 46 OR (whole AND NOT parted) AS malformed, whole AND ts_ms IS NULL AS bad_ts,
            whole AND coalesce(f.level, '?') NOT IN ('I', 'W', 'E', 'F') AS bad_lv, whole AND c.component IS NULL AS unknown_comp,
            whole AND f.code <> '00000' AND k.code IS NULL AS unknown_cd
        FROM fields f LEFT JOIN components c ON f.service = c.service AND f.component = c.component LEFT JOIN codes k ON f.code = k.code"""),
    "parsed": ("checked", """
        SELECT *, ts_ms // 1000 AS sec, CASE WHEN oversized THEN 'oversized_line' WHEN malformed THEN 'malformed_header' WHEN bad_ts THEN 'bad_timestamp'
            WHEN bad_lv THEN 'bad_level' WHEN unknown_comp THEN 'unknown_component' WHEN unknown_cd THEN 'unknown_code' ELSE 'valid' END AS class,
            concat_ws(',', CASE WHEN oversized THEN 'oversized_line' END, CASE WHEN malformed THEN 'malformed_header' END, CASE WHEN bad_ts THEN 'bad_timestamp' END,
                CASE WHEN bad_lv THEN 'bad_level' END, CASE WHEN unknown_comp THEN 'unknown_component' END, CASE WHEN unknown_cd THEN 'unknown_code' END) AS flags
        FROM checked"""),
    "counted": ("parsed", f"SELECT * FROM parsed WHERE class NOT IN {REJECTED}"),
    "per_second": ("counted", "SELECT key, sec, count(*) AS tot, count(*) FILTER (level_class BETWEEN 2 AND 3) AS err, count(*) FILTER (level_class = 1) AS warn FROM counted GROUP BY key, sec"),
    "calendar": ("per_second", "SELECT unnest(generate_series((SELECT min(sec) FROM per_second), (SELECT max(sec) FROM per_second))) AS sec"),
    "dense": ("per_second calendar", """
        SELECT k.key, c.sec, coalesce(p.tot, 0) AS tot, coalesce(p.err, 0) AS err, coalesce(p.warn, 0) AS warn
        FROM (SELECT DISTINCT key FROM per_second) k CROSS JOIN calendar c LEFT JOIN per_second p ON p.key = k.key AND p.sec = c.sec"""),
    "sums": ("dense", _sliding(("tot", "err", "warn"), (10, 30, 60, 300), "dense")),
    "based": ("sums components thresholds", "SELECT s.*, greatest(c.err, 1e-4) AS base, coalesce(t.min_n, 20) AS least FROM sums s JOIN components c ON s.key = c.key LEFT JOIN thresholds t ON s.key = t.key"),
    "limited": ("based thresholds", f"""
        SELECT *, CASE window_s WHEN 30 THEN tot30 WHEN 60 THEN tot60 ELSE tot10 END AS t_tot, CASE window_s WHEN 30 THEN err30 WHEN 60 THEN err60 ELSE err10 END AS t_err
        FROM (SELECT b.*, coalesce(t.limit_rate, {_LIMIT}) AS limit_rate, coalesce(t.window_s, {_WINDOW}) AS window_s, coalesce(t.min_n, {_LEAST}) AS min_n FROM based b LEFT JOIN thresholds t ON b.key = t.key)"""),
    "cusums": ("limited", f"""
        SELECT * EXCLUDE (part, step, c), c - least(0.0, min(c) OVER (PARTITION BY key, part ORDER BY sec)) AS cusum FROM (
            SELECT *, sum(step) OVER (PARTITION BY key, part ORDER BY sec) AS c FROM (
                SELECT *, sum(CASE WHEN tot60 < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY sec) AS part,
                    CASE WHEN tot60 < 20 THEN 0.0 ELSE {_rate('err60', 'tot60')} - base - 0.5 * 1e-4 END AS step FROM limited))"""),
    "ruled": ("cusums", f"""
        SELECT *, {_z('err10', 'tot10', 'base')} AS z10, {_z('err60', 'tot60', 'base')} AS z60, CASE
            WHEN tot10 >= least AND {_z('err10', 'tot10', 'base')} > 6 AND {_rate('err10', 'tot10')} > base + 0.01 AND tot300 > 0 THEN 'fast'
            WHEN tot60 >= least AND {_z('err60', 'tot60', 'base')} > 4 AND {_rate('err60', 'tot60')} > base + 0.01 AND tot300 > 0 THEN 'slow'
            WHEN key = 'PAY.BNK' AND tot30 >= 5 AND greatest((err30 / tot30 + 3.8416 / (2 * tot30) - 1.96 * sqrt((err30 / tot30 * (1 - err30 / tot30) + 3.8416 / (4 * tot30)) / tot30)) / (1 + 3.8416 / tot30), 0.0) > 0.05 THEN 'wilson'
            WHEN t_tot >= min_n AND {_rate('t_err', 't_tot')} > limit_rate THEN 'threshold'
            WHEN cusum > 5 THEN 'cusum' END AS rule
        FROM cusums"""),
    "runs": ("ruled", """
        SELECT *, sum(hit) OVER (PARTITION BY key, calm ORDER BY sec) AS breach_run, sum(1 - hit) OVER (PARTITION BY key, hits ORDER BY sec) AS quiet_run FROM (
            SELECT *, sum(1 - hit) OVER (PARTITION BY key ORDER BY sec) AS calm, sum(hit) OVER (PARTITION BY key ORDER BY sec) AS hits FROM (
                SELECT *, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS hit, CASE WHEN rule IN ('slow', 'cusum') THEN 5 ELSE 2 END AS need FROM ruled))"""),
    "states": ("runs", """
        SELECT *, opened > 0 AS open, ready = 1 AND opened = 1 AS opened_now FROM (
            SELECT *, sum(ready) OVER (PARTITION BY key, segment ORDER BY sec) AS opened FROM (
                SELECT *, CASE WHEN hit = 1 AND breach_run >= need THEN 1 ELSE 0 END AS ready,
                    CAST(sum(CASE WHEN quiet_run = 31 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY sec) AS BIGINT) AS segment FROM runs))"""),
    "alerts": ("states", f"""
        SELECT *, {_rate('errors', 'total')} AS observed, {_z('errors', 'total', 'baseline')} AS z FROM (
            SELECT key, CASE rule WHEN 'wilson' THEN 'threshold' ELSE rule END AS rule, sec AS opened_sec,
                CAST(CASE rule WHEN 'fast' THEN 10 WHEN 'wilson' THEN 30 WHEN 'threshold' THEN window_s ELSE 60 END AS INTEGER) AS window_s,
                CASE rule WHEN 'fast' THEN tot10 WHEN 'wilson' THEN tot30 WHEN 'threshold' THEN t_tot ELSE tot60 END AS total,
                CASE rule WHEN 'fast' THEN err10 WHEN 'wilson' THEN err30 WHEN 'threshold' THEN t_err ELSE err60 END AS errors, base AS baseline
            FROM states WHERE opened_now)"""),
    "rolled": ("sums", """
        SELECT 'service' AS scope, split_part(key, '.', 1) AS key, sec, CAST(sum(tot60) AS BIGINT) AS tot60, CAST(sum(err60) AS BIGINT) AS err60 FROM sums GROUP BY ALL
        UNION ALL SELECT 'system', 'SYSTEM', sec, CAST(sum(tot60) AS BIGINT), CAST(sum(err60) AS BIGINT) FROM sums GROUP BY sec"""),
    "rolled_states": ("rolled", """
        SELECT *, sum(ready) OVER (PARTITION BY scope, key, segment ORDER BY sec) AS opened FROM (
            SELECT *, CASE WHEN hit = 1 AND breach_run >= 5 THEN 1 ELSE 0 END AS ready, sum(CASE WHEN quiet_run = 31 THEN 1 ELSE 0 END) OVER (PARTITION BY scope, key ORDER BY sec) AS segment FROM (
                SELECT *, sum(hit) OVER (PARTITION BY scope, key, calm ORDER BY sec) AS breach_run, sum(1 - hit) OVER (PARTITION BY scope, key, hits ORDER BY sec) AS quiet_run FROM (
                    SELECT *, sum(1 - hit) OVER (PARTITION BY scope, key ORDER BY sec) AS calm, sum(hit) OVER (PARTITION BY scope, key ORDER BY sec) AS hits FROM (
                        SELECT *, CASE WHEN tot60 >= CASE scope WHEN 'service' THEN 80 ELSE 400 END AND err60 / greatest(tot60, 1) > 0.05 THEN 1 ELSE 0 END AS hit FROM rolled))))"""),
    "warm": ("per_second", "SELECT p.key, first, sum(tot) / 60 AS usual FROM per_second p JOIN (SELECT key, min(sec) AS first FROM per_second GROUP BY key) f ON p.key = f.key WHERE sec < first + 60 GROUP BY p.key, first"),
    "low_seconds": ("sums warm", "SELECT s.key, s.sec, s.tot60, w.usual FROM sums s JOIN warm w ON s.key = w.key WHERE usual > 0.5 AND sec >= first + 60 AND tot60 < 30"),
    "histogram": ("counted", "SELECT key, CASE WHEN latency_ms < 0 THEN 19 WHEN latency_ms = 0 THEN 0 ELSE least(length(bin(latency_ms)), 18) END AS bin, sec, count(*) AS n FROM counted GROUP BY ALL"),
    "last_minutes": ("histogram", """
        SELECT d.key, d.sec, h.bin, CAST(sum(h.n) AS BIGINT) AS n FROM (SELECT key, unnest(generate_series(min(sec), max(sec))) AS sec FROM histogram GROUP BY key) d
        JOIN histogram h ON h.key = d.key AND h.sec BETWEEN d.sec - 59 AND d.sec GROUP BY ALL"""),
    "p95_seconds": ("last_minutes", """
        SELECT key, sec, CAST(max(whole) AS BIGINT) AS lines, CAST(power(2, min(CASE WHEN good > 0 AND good_upto >= 0.95 * good THEN bin END)) AS BIGINT) AS upper_ms FROM (
            SELECT *, sum(n) OVER (PARTITION BY key, sec) AS whole, sum(CASE WHEN bin <= 18 THEN n ELSE 0 END) OVER (PARTITION BY key, sec ORDER BY bin) AS good_upto,
                sum(CASE WHEN bin <= 18 THEN n ELSE 0 END) OVER (PARTITION BY key, sec) AS good FROM last_minutes) GROUP BY key, sec HAVING max(whole) >= 20"""),
    "code_seconds": ("counted", "SELECT key, code, sec, count(*) AS n FROM counted WHERE code <> '00000' GROUP BY ALL"),
    "mix": ("code_seconds sums codes", """
        SELECT *, CASE WHEN all60 > 0 THEN n60 / all60 ELSE 0.0 END AS p FROM (
            SELECT *, sum(n60) OVER (PARTITION BY key, sec) AS all60 FROM (
                SELECT *, sum(n) OVER (PARTITION BY key, code ORDER BY sec ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS n60 FROM (
                    SELECT s.key, s.sec, s.tot60, c.code, c.weight AS q, coalesce(k.n, 0) AS n
                    FROM sums s JOIN codes c ON s.key = c.key AND c.level = 'W' AND c.places > 1 LEFT JOIN code_seconds k ON k.key = s.key AND k.sec = s.sec AND k.code = c.code)))"""),
    "ratios": ("parsed", f"""
        SELECT sec, lines, bad, {_r6('bad / greatest(lines, 1)')} AS ratio FROM (
            SELECT c.sec, CAST(sum(coalesce(p.tot, 0)) OVER w AS BIGINT) AS lines, CAST(sum(coalesce(p.bad, 0)) OVER w AS BIGINT) AS bad
            FROM (SELECT unnest(generate_series((SELECT min(sec) FROM parsed), (SELECT max(sec) FROM parsed))) AS sec) c
            LEFT JOIN (SELECT sec, count(*) AS tot, count(*) FILTER (class IN ('bad_level', 'unknown_component', 'unknown_code', 'malformed_header', 'oversized_line')) AS bad FROM parsed WHERE sec IS NOT NULL GROUP BY sec) p ON p.sec = c.sec
            WINDOW w AS (ORDER BY c.sec ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""),
    "crit": ("components", "SELECT key, criticality FROM components UNION ALL SELECT service, max(criticality) FROM components GROUP BY service UNION ALL SELECT 'SYSTEM', max(criticality) FROM components"),
    "base_scores": ("alerts crit", f"""
        SELECT a.*, coalesce(c.criticality, 0.5) AS criticality, observed / 0.99 AS burn_rate,
            0.40 * (0.5 * least(greatest(z, 0.0) / 30, 1.0) + 0.5 * least(greatest((observed / baseline - 1) / 99, 0.0), 1.0))
            + 0.22 * coalesce(c.criticality, 0.5) + 0.10 * least(greatest(observed / 0.99, 0.0) / 14.4, 1.0) AS plain
        FROM alerts a LEFT JOIN crit c ON a.key = c.key"""),
    "closure": ("edges", """
        WITH RECURSIVE walk(src, dst, depth) AS (
            SELECT src, dst, 1 FROM edges UNION ALL SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN edges e ON w.dst = e.src WHERE w.depth < 8
        ) SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst"""),
    "origins": ("alerts closure", """
        SELECT key, rule, opened_sec, first.origin AS origin, first.origin_sec AS origin_sec FROM (
            SELECT key, rule, opened_sec, min({'origin_sec': origin_sec, 'origin': origin}) AS first FROM (
                SELECT a.key, a.rule, a.opened_sec, a.key AS origin, a.opened_sec AS origin_sec FROM alerts a
                UNION ALL SELECT a.key, a.rule, a.opened_sec, o.key, o.opened_sec FROM alerts a JOIN closure c ON c.dst = a.key JOIN alerts o ON o.key = c.src
                WHERE o.opened_sec < a.opened_sec AND o.opened_sec >= a.opened_sec - 120
            ) GROUP BY key, rule, opened_sec)"""),
    "sessions": ("alerts", """
        SELECT key, rule, CAST(incident AS BIGINT) AS incident, min(opened_sec) AS opened_sec, max(opened_sec) AS last_sec, count(*) AS n FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY key, rule ORDER BY opened_sec) AS incident FROM (
                SELECT *, CASE WHEN gap <= 60 OR (gap > 120 AND gap <= 420) THEN 0 ELSE 1 END AS fresh FROM (
                    SELECT *, opened_sec - lag(opened_sec) OVER (PARTITION BY key, rule ORDER BY opened_sec) AS gap FROM alerts))) GROUP BY key, rule, incident"""),
    "live": ("dense faults", """
        SELECT key, sec, max({'fault': fault, 'kind': kind, 'target': target, 'ramp_s': ramp_s, 'start_sec': start_sec}) AS f
        FROM (SELECT d.key, d.sec, f.* EXCLUDE (key) FROM dense d JOIN faults f ON d.key = f.key AND d.sec >= f.start_sec AND d.sec < f.end_sec) GROUP BY key, sec"""),
    "live_rates": ("dense faults", """
        SELECT key, sec, max({'fault': fault, 'target': target, 'ramp_s': ramp_s, 'start_sec': start_sec}) AS f
        FROM (SELECT d.key, d.sec, f.* EXCLUDE (key) FROM dense d JOIN faults f ON d.key = f.key AND d.sec >= f.start_sec AND d.sec < f.end_sec AND f.kind = 'rate') GROUP BY key, sec"""),
    "outbox": ("alerts", """
        SELECT sha256(concat_ws('|', key, rule, CAST(opened_sec AS VARCHAR))) AS idempotency_key, CASE WHEN opened_sec % 4 = 0 THEN 'delivered' ELSE 'pending' END AS status,
            CASE WHEN opened_sec % 5 = 0 THEN 1 ELSE 0 END AS attempts, opened_sec AS next_attempt_s, opened_sec AS created_s FROM alerts"""),
    "learned": ("limited components", f"""
        WITH RECURSIVE walk AS (
            SELECT l.key, min(l.sec) - 1 AS sec, any_value(c.err) AS mean, 1e-8::DOUBLE AS var, 0 AS seen, 0 AS run, 0 AS quiet, 0.0::DOUBLE AS cusum, false AS open,
                0.0::DOUBLE AS base, false AS warming, 0.0::DOUBLE AS z10, 0.0::DOUBLE AS z60, CAST(NULL AS VARCHAR) AS rule, false AS opened_now
            FROM limited l JOIN components c ON l.key = c.key GROUP BY l.key
            UNION ALL
            SELECT key, sec, CASE WHEN tot300 > 0 AND NOT now_open THEN mean + (2.0 / 301) * gap ELSE mean END,
                CASE WHEN tot300 > 0 AND NOT now_open THEN var + (2.0 / 301) * (gap * gap - var) ELSE var END,
                CASE WHEN tot300 > 0 THEN seen + 1 ELSE seen END, run, quiet, cusum, now_open, base, warming, z10, z60, rule, now_open AND NOT still
            FROM (
                SELECT *, still OR (rule IS NOT NULL AND run >= CASE WHEN rule IN ('slow', 'cusum') THEN 5 ELSE 2 END) AS now_open, err300 / greatest(tot300, 1) - mean AS gap
                FROM (
                    SELECT *, was_open AND quiet <= 30 AS still FROM (
                        SELECT *, CASE WHEN warming OR rule IS NULL THEN 0 ELSE old_run + 1 END AS run, CASE WHEN warming OR rule IS NOT NULL THEN 0 ELSE old_quiet + 1 END AS quiet
                        FROM (
                            SELECT *, CASE WHEN warming THEN NULL
                                WHEN tot10 >= least AND z10 > 6 AND {_rate('err10', 'tot10')} > base + 0.01 AND tot300 > 0 THEN 'fast'
                                WHEN tot60 >= least AND z60 > 4 AND {_rate('err60', 'tot60')} > base + 0.01 AND tot300 > 0 THEN 'slow'
                                WHEN key = 'PAY.BNK' AND tot30 >= 5 AND greatest((err30 / tot30 + 3.8416 / (2 * tot30) - 1.96 * sqrt((err30 / tot30 * (1 - err30 / tot30) + 3.8416 / (4 * tot30)) / tot30)) / (1 + 3.8416 / tot30), 0.0) > 0.05 THEN 'wilson'
                                WHEN t_tot >= min_n AND {_rate('t_err', 't_tot')} > limit_rate AND tot300 > 0 THEN 'threshold'
                                WHEN cusum > 5 THEN 'cusum' END AS rule
                            FROM (
                                SELECT *, {_z('err10', 'tot10', 'base')} AS z10, {_z('err60', 'tot60', 'base')} AS z60,
                                    CASE WHEN tot60 >= 20 AND tot300 > 0 THEN greatest(old_cusum + {_rate('err60', 'tot60')} - base - 0.5 * sqrt(greatest(var, 1e-12)), 0.0) ELSE 0.0 END AS cusum
                                FROM (
                                    SELECT l.* EXCLUDE (base), w.mean, w.var, w.seen, w.run AS old_run, w.quiet AS old_quiet, w.cusum AS old_cusum, w.open AS was_open,
                                        greatest(w.mean, 1e-4) AS base, w.seen < 120 AS warming
                                    FROM walk w JOIN limited l ON l.key = w.key AND l.sec = w.sec + 1))))))
        )
        SELECT w.key, w.sec, w.mean AS ewma, sqrt(greatest(w.var, 0.0)) AS sigma, w.warming, w.base, w.z10, w.z60, w.rule, w.open, w.opened_now,
            l.tot10, l.err10, l.tot30, l.err30, l.tot60, l.err60, l.t_tot, l.t_err, l.window_s
        FROM walk w JOIN limited l ON l.key = w.key AND l.sec = w.sec"""),
    "learned_openings": ("learned", f"""
        SELECT *, {_rate('errors', 'total')} AS observed, {_z('errors', 'total', 'baseline')} AS z FROM (
            SELECT key, CASE rule WHEN 'wilson' THEN 'threshold' ELSE rule END AS rule, sec AS opened_sec,
                CAST(CASE rule WHEN 'fast' THEN 10 WHEN 'wilson' THEN 30 WHEN 'threshold' THEN window_s ELSE 60 END AS INTEGER) AS window_s,
                CASE rule WHEN 'fast' THEN tot10 WHEN 'wilson' THEN tot30 WHEN 'threshold' THEN t_tot ELSE tot60 END AS total,
                CASE rule WHEN 'fast' THEN err10 WHEN 'wilson' THEN err30 WHEN 'threshold' THEN t_err ELSE err60 END AS errors, base AS baseline
            FROM learned WHERE opened_now)"""),
    "wrong": ("parsed", f"""
        SELECT * REPLACE (sec + off AS sec), (sec + off) // 300 AS stretch FROM (SELECT *, CASE WHEN event_id % 997 <= {len(ll.BROKEN)} AND event_id % 997 > 0 OR event_id % 997 = 0 THEN 0
            WHEN event_id % 499 = 3 THEN {ll.WRONG_S} WHEN event_id % 499 = 5 THEN -{ll.WRONG_S} ELSE 0 END AS off FROM parsed)"""),
    "clocked": ("wrong", """
        SELECT w.*, coalesce(j.clock, 'ok') AS clock FROM wrong w LEFT JOIN (
            SELECT stretch, CASE WHEN run > centre THEN 'ahead' WHEN run < centre AND own < 0.05 * total THEN 'behind' ELSE 'ok' END AS clock FROM (
                SELECT *, min(CASE WHEN upto > total // 2 THEN run END) OVER () AS centre, sum(n) OVER (PARTITION BY run) AS own FROM (
                    SELECT *, sum(fresh) OVER (ORDER BY stretch) AS run, sum(n) OVER (ORDER BY stretch) AS upto, sum(n) OVER () AS total FROM (
                        SELECT stretch, count(*) AS n, CASE WHEN stretch - lag(stretch) OVER (ORDER BY stretch) > 1 THEN 1 ELSE 0 END AS fresh FROM wrong WHERE stretch IS NOT NULL GROUP BY stretch)))) j
        ON j.stretch = w.stretch"""),
    "told_alerts": ("components", f"""
        SELECT c.key, CASE WHEN e.k < 3 THEN 'fast' ELSE 'slow' END AS rule, {FIRST_SEC} + e.event_id AS sec, e.event_type
        FROM (SELECT event_id, event_type, user_id % 20 AS idx, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e JOIN components c ON c.idx = e.idx
        WHERE event_type = 'error' AND k < 30 OR event_type = 'signup' AND k < 8"""),
    "told_openings": ("told_alerts", "SELECT DISTINCT key, rule, sec AS opened_sec FROM told_alerts WHERE event_type = 'error'"),
    "near_keys": ("components edges", "SELECT key, key AS near FROM components UNION SELECT src, dst FROM edges UNION SELECT dst, src FROM edges"),
    "told_groups": ("told_openings near_keys", _GROUPS.format("told_openings")),
    "alert_groups": ("alerts near_keys", _GROUPS.format("(SELECT DISTINCT key, rule, opened_sec FROM alerts)")),
    "told_faults": ("components", f"""
        SELECT e.event_id AS fault, c.key, {FIRST_SEC} + e.event_id AS start_sec, {FIRST_SEC} + e.event_id + 120 + e.event_id % 7 * 60 AS end_sec
        FROM (SELECT event_id, event_type, user_id % 20 AS idx, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e JOIN components c ON c.idx = e.idx WHERE event_type = 'purchase' AND k < 4"""),
    "told_order": ("told_openings", "SELECT key, opened_sec, row_number() OVER (PARTITION BY key ORDER BY opened_sec, rule) AS i FROM told_openings"),
    "told_pairs": ("told_order told_faults", """
        WITH RECURSIVE walk AS (
            SELECT key, 0::BIGINT AS i, 0::BIGINT AS opened_sec, []::BIGINT[] AS used, NULL::BIGINT AS fault FROM (SELECT DISTINCT key FROM told_order)
            UNION ALL
            SELECT key, i, opened_sec, CASE WHEN fault IS NULL THEN used ELSE list_append(used, fault) END, fault FROM (
                SELECT w.key, o.i, o.opened_sec, w.used, min({'d': f.end_sec + 60, 'fault': f.fault}).fault AS fault
                FROM walk w JOIN told_order o ON o.key = w.key AND o.i = w.i + 1
                LEFT JOIN told_faults f ON f.key = w.key AND o.opened_sec BETWEEN f.start_sec AND f.end_sec + 60 AND NOT list_contains(w.used, f.fault) GROUP BY w.key, o.i, o.opened_sec, w.used)
        ) SELECT w.key, w.fault, f.start_sec, w.opened_sec FROM walk w JOIN told_faults f ON f.fault = w.fault"""),
    "life_steps": ("told_alerts", """
        SELECT key, rule, sec, n, alert, row_number() OVER (PARTITION BY key, rule ORDER BY sec, alert) AS i FROM (
            SELECT key, rule, sec, event_type = 'error' AS alert, count(*) AS n FROM told_alerts GROUP BY ALL)"""),
    "life_walk": ("life_steps", """
        WITH RECURSIVE walk AS (
            SELECT key, rule, 0::BIGINT AS i, 0::BIGINT AS sec, NULL::BIGINT AS incident, NULL::BIGINT AS last, 0::BIGINT AS n, false AS held, 0 AS stint, '' AS event FROM (SELECT DISTINCT key, rule FROM life_steps)
            UNION ALL
            SELECT key, rule, i, sec, CASE WHEN event = 'opened' THEN sec ELSE incident END, CASE WHEN alert THEN sec ELSE last END,
                CASE WHEN event = 'opened' THEN more WHEN alert THEN n + more ELSE n END,
                CASE WHEN event IN ('opened', 'reopened') THEN false WHEN event = 'acknowledged' THEN true ELSE held END, stint + CASE WHEN event IN ('opened', 'reopened') THEN 1 ELSE 0 END, event
            FROM (
                SELECT w.key, w.rule, s.i, s.sec, s.alert, s.n AS more, w.incident, w.last, w.n, w.held, w.stint, CASE
                    WHEN s.alert AND w.incident IS NULL THEN 'opened'
                    WHEN s.alert AND NOT w.held AND s.sec - w.last > 120 THEN CASE WHEN s.sec - w.last <= 420 THEN 'reopened' ELSE 'opened' END
                    WHEN s.alert AND s.sec - w.last <= 60 THEN 'joined' WHEN s.alert THEN 'opened'
                    WHEN w.incident IS NOT NULL AND NOT w.held AND s.sec - w.last <= 120 THEN 'acknowledged' ELSE 'nothing' END AS event
                FROM walk w JOIN life_steps s ON s.key = w.key AND s.rule = w.rule AND s.i = w.i + 1)
        ) SELECT * FROM walk"""),
    "incident_life": ("life_walk told_alerts", """
        SELECT key, rule, incident, event, sec, n FROM life_walk WHERE event IN ('opened', 'reopened', 'acknowledged')
        UNION ALL SELECT key, rule, arg_max(incident, i), 'resolved', max(last) + 121, arg_max(n, i) FROM life_walk WHERE stint > 0
            GROUP BY key, rule, stint HAVING NOT bool_or(held) AND max(last) + 120 <= (SELECT max(sec) FROM told_alerts)"""),
    "streamed_openings": ("learned_openings counted per_second", """
        SELECT * FROM learned_openings WHERE opened_sec <= (SELECT max(sec) FROM per_second WHERE sec <= (SELECT max(sec) FROM counted) - 2)"""),
    "levels": ("sums", """
        SELECT key, sec, CASE WHEN burn >= 0.55 THEN 3 WHEN burn >= 0.35 THEN 2 WHEN burn >= 0.18 THEN 1 ELSE 0 END AS level
        FROM (SELECT key, sec, round(err60 / greatest(tot60, 1) * 5, 6) AS burn FROM sums)"""),
    "held": ("levels", """
        WITH RECURSIVE walk AS (
            SELECT key, sec, level, level AS held, 0 AS below FROM (SELECT *, min(sec) OVER (PARTITION BY key) AS first FROM levels) WHERE sec = first
            UNION ALL
            SELECT key, sec, level, CASE WHEN changes THEN level ELSE old END, CASE WHEN changes THEN 0 ELSE below END FROM (
                SELECT *, level > old OR below >= 15 AS changes FROM (
                    SELECT l.key, l.sec, l.level, w.held AS old, CASE WHEN l.level < w.held THEN w.below + 1 ELSE 0 END AS below
                    FROM walk w JOIN levels l ON l.key = w.key AND l.sec = w.sec + 1))
        ) SELECT * FROM walk"""),
    "settled": ("based counted per_second", f"""
        SELECT b.*, CASE WHEN tot10 >= least AND {_z('err10', 'tot10', 'base')} > 6 AND {_rate('err10', 'tot10')} > base + 0.01 AND tot300 > 0 THEN 1 ELSE 0 END AS hit
        FROM based b JOIN (SELECT key, min(sec) AS first FROM per_second GROUP BY key) p
        ON b.key = p.key AND b.sec BETWEEN p.first AND (SELECT max(sec) FROM per_second WHERE sec <= (SELECT max(sec) FROM counted) - 2)"""),
    "settled_states": ("settled", """
        SELECT *, sum(ready) OVER (PARTITION BY key, segment ORDER BY sec) AS opened FROM (
            SELECT *, CASE WHEN hit = 1 AND breach_run >= 2 THEN 1 ELSE 0 END AS ready, sum(CASE WHEN quiet_run = 31 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY sec) AS segment FROM (
                SELECT *, sum(hit) OVER (PARTITION BY key, calm ORDER BY sec) AS breach_run, sum(1 - hit) OVER (PARTITION BY key, hits ORDER BY sec) AS quiet_run FROM (
                    SELECT *, sum(1 - hit) OVER (PARTITION BY key ORDER BY sec) AS calm, sum(hit) OVER (PARTITION BY key ORDER BY sec) AS hits FROM settled)))"""),
    "levelled": ("base_scores", """
        SELECT *, CASE WHEN score >= 0.55 THEN 'CRITICAL' WHEN score >= 0.35 THEN 'HIGH' WHEN score >= 0.18 THEN 'WARNING' ELSE 'INFO' END AS severity
        FROM (SELECT *, round(least(greatest(plain, 0.0), 1.0), 6) AS score FROM base_scores)"""),
    "stretches": ("states crit", f"""
        SELECT *, CASE WHEN score >= 0.55 THEN 'CRITICAL' WHEN score >= 0.35 THEN 'HIGH' WHEN score >= 0.18 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (
            SELECT *, round(least(greatest(0.40 * (0.5 * least(greatest(z, 0.0) / 30, 1.0) + 0.5 * least(greatest((observed / baseline - 1) / 99, 0.0), 1.0))
                + 0.18 * least(greatest(seconds_in_breach, 0) / 120, 1.0) + 0.22 * criticality + 0.10 * least(greatest(burn_rate, 0.0) / 14.4, 1.0), 0.0), 1.0), 6) AS score
            FROM (
                SELECT t.key, rule, opened_sec, last_sec - opened_sec AS seconds_in_breach, z, observed, baseline, coalesce(c.criticality, 0.5) AS criticality, observed / 0.99 AS burn_rate FROM (
                    SELECT key, segment, min(sec) AS opened_sec, max(CASE WHEN rule IS NOT NULL THEN sec END) AS last_sec, arg_min(rule, CASE WHEN rule IS NOT NULL THEN sec END) AS rule,
                        max(z10) AS z, max({_rate('err10', 'tot10')}) AS observed, max(base) AS baseline FROM states WHERE open GROUP BY key, segment) t
                LEFT JOIN crit c ON c.key = t.key))"""),
}


def _order() -> dict[str, tuple[str, str, str]]:
    return {head.split("(")[0]: (head, needs, sql) for head, (needs, sql) in CTES.items()}


_BY_NAME = _order()


def with_ctes(final: str) -> str:
    """final with the expressions it names, and those that they need, in order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        if name not in wanted:
            for need in _BY_NAME[name][1].split():
                add(need)
            wanted.add(name)

    for name in _BY_NAME:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", final):
            add(name)
    parts = [f"{_BY_NAME[n][0]} AS MATERIALIZED ({_BY_NAME[n][2]})" for n in _BY_NAME if n in wanted]
    return f"WITH {', '.join(parts)} {final}" if parts else final


def _percentile(edge: str, share: float = 0.95, keys: str = "key", source: str = "(SELECT key, bin, sum(n) AS n FROM histogram GROUP BY ALL)") -> str:
    inner = f"""SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys}) AS whole,
        sum(CASE WHEN bin <= 18 THEN n ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY bin) AS good_upto, sum(CASE WHEN bin <= 18 THEN n ELSE 0 END) OVER (PARTITION BY {keys}) AS good FROM {source}"""
    if edge == "upper":
        return f"SELECT {keys}, CAST(power(2, min(CASE WHEN good > 0 AND good_upto >= {share} * good THEN bin END)) AS BIGINT) AS upper_ms FROM ({inner}) GROUP BY {keys}"
    return f"SELECT {keys}, CAST(CASE WHEN min(CASE WHEN upto >= {share} * whole THEN bin END) = 0 THEN 0 ELSE power(2, min(CASE WHEN upto >= {share} * whole THEN bin END) - 1) END AS BIGINT) AS lower_ms FROM ({inner}) GROUP BY {keys}"


def _stats() -> str:
    columns, text = {}, "coalesce(text, '')"
    for category, pattern in r.PATTERNS:
        columns.setdefault(category, []).append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{r.MARK}', 'g')"
    return " UNION ALL ".join(f"SELECT '{k}' AS category, CAST(coalesce(sum({' + '.join(v)}), 0) AS BIGINT) AS n FROM documents" for k, v in columns.items())


_MIX = f"""SELECT key, sec, {_r6("sum(((p + 1e-12) * ln((p + 1e-12) / ((p + q + 2e-12) / 2)) + (q + 1e-12) * ln((q + 1e-12) / ((p + q + 2e-12) / 2))) / 2)")} AS js,
    max({{'d': round(abs(p - q), 9), 'code': code}}) AS lead FROM mix WHERE all60 > 0 AND tot60 >= 50 GROUP BY key, sec"""
FINALS: dict[str, str] = {
    "parse_lines": "SELECT event_id, class, ts_ms, level, level_class, key, code, latency_ms, trace, CAST(raw_len AS INTEGER) AS raw_len, flags FROM parsed",
    "line_classes": "SELECT class, count(*) AS n FROM parsed GROUP BY class",
    "reject_reasons": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN raw_len > 8192 THEN 'oversized_line' WHEN raw_len < 46 THEN 'short_line' WHEN NOT parted THEN 'bad_separator'
        WHEN ts_ms IS NULL THEN 'bad_timestamp' WHEN level NOT IN ('I', 'W', 'E', 'F') THEN 'bad_level' END AS reason FROM fields) WHERE reason IS NOT NULL GROUP BY reason""",
    "unknown_component_anti": "SELECT key, count(*) AS n FROM parsed WHERE whole AND ts_ms IS NOT NULL AND level_class <= 3 AND NOT malformed AND key NOT IN (SELECT key FROM components) GROUP BY key",
    "known_code_semi": "SELECT key, code, count(*) AS n FROM counted WHERE code IN (SELECT code FROM codes) GROUP BY key, code",
    "per_second_counts": "SELECT * FROM per_second",
    "component_counts": """SELECT t.*, coalesce(b.by_code, '') AS by_code FROM (
        SELECT key, count(*) AS tot, count(*) FILTER (level_class BETWEEN 2 AND 3) AS err, count(*) FILTER (level_class = 1) AS warn, count(*) FILTER (level_class = 0) AS info,
            count(*) FILTER (class = 'unknown_code' AND level_class >= 2) AS unmapped_err, CAST(sum(CASE WHEN latency_ms >= 0 THEN latency_ms ELSE 0 END) AS BIGINT) AS latency_sum,
            count(*) FILTER (latency_ms >= 0) AS latency_n, min(sec) AS first_sec, max(sec) AS last_sec FROM counted GROUP BY key) t
        LEFT JOIN (SELECT key, string_agg(code || '=' || CAST(n AS VARCHAR), ',' ORDER BY code || '=' || CAST(n AS VARCHAR)) AS by_code
            FROM (SELECT key, code, sum(n) AS n FROM code_seconds GROUP BY ALL) GROUP BY key) b ON t.key = b.key""",
    "code_counts_by_component": "SELECT key, code, CAST(sum(n) AS BIGINT) AS n FROM code_seconds GROUP BY key, code",
    "code_counts_by_second": "SELECT key, code, sec, n FROM code_seconds",
    "latency_histogram": "SELECT key, CAST(bin AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM histogram GROUP BY key, bin",
    "unmapped_codes": "SELECT code, CAST(sum(n) AS BIGINT) AS n FROM code_seconds WHERE code NOT IN (SELECT code FROM codes) GROUP BY code",
    "skew_filter_median": """SELECT median_sec, count(*) FILTER (abs(sec - median_sec) <= 300) AS kept, count(*) FILTER (abs(sec - median_sec) > 300) AS dropped
        FROM (SELECT sec, (SELECT list_sort(list(sec))[count(*) // 2 + 1] FROM parsed WHERE sec IS NOT NULL) AS median_sec FROM parsed WHERE sec IS NOT NULL) GROUP BY median_sec""",
    "sliding_sums": "SELECT * FROM sums",
    "error_rates": f"SELECT key, sec, {', '.join(f'{_r6(_rate(f"err{w}", f"tot{w}"))} AS rate{w}' for w in (10, 60, 300))} FROM sums",
    "service_system_rollup": "SELECT * FROM rolled",
    "unidentified_ratio_60s": "SELECT * FROM ratios",
    "top_unknown_keys": """SELECT key, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, array_to_string(list_transform(list_sort(list({'ts_ms': ts_ms, 'line': substr(value, 1, 200)}))[1:3], lambda x: x.line), ' / ') AS samples FROM parsed
        WHERE class = 'unknown_component' GROUP BY key ORDER BY n DESC, key LIMIT 10""",
    "adopt_candidates": """SELECT key, min(sec) AS adopted_sec, CAST(arg_min(n, sec) AS BIGINT) AS n, arg_min(first_ms, sec) AS first_ms, arg_min(last_ms, sec) AS last_ms FROM (
        SELECT key, sec, sum(n) OVER w AS n, min(first_ms) OVER w AS first_ms, max(last_ms) OVER w AS last_ms
        FROM (SELECT key, sec, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM parsed WHERE class = 'unknown_component' GROUP BY key, sec)
        WINDOW w AS (PARTITION BY key ORDER BY sec RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE n >= 20 GROUP BY key""",
    "zscore_fast": f"SELECT key, sec, tot10, err10, {_r6(_z('err10', 'tot10', 'base'))} AS z10, tot10 >= least AND {_z('err10', 'tot10', 'base')} > 6 AND {_rate('err10', 'tot10')} > base + 0.01 AND tot300 > 0 AS breach FROM based",
    "zscore_slow": f"SELECT key, sec, tot60, err60, {_r6(_z('err60', 'tot60', 'base'))} AS z60, tot60 >= least AND {_z('err60', 'tot60', 'base')} > 4 AND {_rate('err60', 'tot60')} > base + 0.01 AND tot300 > 0 AS breach FROM based",
    "wilson_low_volume": f"""SELECT key, sec, tot30, err30, {_r6('lb')} AS lower_bound, tot30 >= 5 AND lb > 0.05 AS breach FROM (
        SELECT *, CASE WHEN tot30 <= 0 THEN 0.0 ELSE greatest((err30 / tot30 + 3.8416 / (2 * tot30) - 1.96 * sqrt((err30 / tot30 * (1 - err30 / tot30) + 3.8416 / (4 * tot30)) / tot30)) / (1 + 3.8416 / tot30), 0.0) END AS lb
        FROM sums WHERE key = 'PAY.BNK')""",
    "absolute_threshold": f"SELECT key, sec, window_s, t_tot, t_err, t_tot >= min_n AND {_rate('t_err', 't_tot')} > limit_rate AS breach FROM limited",
    "cusum_drift": f"SELECT key, sec, {_r6('cusum')} AS cusum, {_r6('cusum')} > 5 AS breach FROM cusums",
    "rule_priority": "SELECT key, sec, rule FROM ruled WHERE rule IS NOT NULL",
    "hysteresis_open_intervals": f"SELECT key, segment, min(sec) AS opened_sec, max(CASE WHEN rule IS NOT NULL THEN sec END) AS last_breach_sec, count(*) AS open_seconds, {_r6('max(z10)')} AS peak_z FROM states WHERE open GROUP BY key, segment",
    "alerts_opened": f"SELECT key, rule, opened_sec, window_s, total, errors, {_r6('baseline')} AS baseline, {_r6('observed')} AS observed, {_r6('z')} AS z FROM alerts",
    "rollup_alerts": f"SELECT scope, key, sec AS opened_sec, tot60, err60, {_r6(_rate('err60', 'tot60'))} AS observed FROM rolled_states WHERE ready = 1 AND opened = 1",
    "js_code_mix": f"SELECT key, sec, js, js > 0.02 AS drifted FROM ({_MIX})",
    "moved_code": f"SELECT key, sec, lead.code AS moved_code, {_r6('lead.d')} AS moved_by FROM ({_MIX})",
    "p95_upper": _percentile("upper"),
    "p95_lower": _percentile("lower"),
    "latency_shift": f"""SELECT r.key, r.sec, r.lines, r.upper_ms, u.baseline_ms, r.upper_ms > 2.0 * u.baseline_ms AS shifted FROM p95_seconds r
        JOIN (SELECT r.key, min(r.sec) AS since, arg_min(r.upper_ms, r.sec) AS baseline_ms FROM p95_seconds r JOIN (SELECT key, min(sec) AS first FROM histogram GROUP BY key) f ON f.key = r.key AND r.sec >= f.first + 59 GROUP BY r.key) u
        ON u.key = r.key AND r.sec >= u.since""",
    "silence_runs": """SELECT key, min(sec) AS first_sec, max(sec) AS last_sec, count(*) AS seconds, count(*) >= 30 AS silent
        FROM (SELECT *, sec - row_number() OVER (PARTITION BY key ORDER BY sec) AS run FROM low_seconds) GROUP BY key, run""",
    "new_code": """SELECT key, code, sec, n, lines, n >= 5 AND n >= 0.01 * lines AS is_new FROM (
        SELECT g.key, g.code, g.sec, CAST(sum(c.n) AS BIGINT) AS n, (SELECT CAST(sum(tot) AS BIGINT) FROM per_second p WHERE p.key = g.key AND p.sec BETWEEN g.sec - 59 AND g.sec) AS lines
        FROM (SELECT DISTINCT key, code, unnest(generate_series(sec, sec + 59)) AS sec FROM code_seconds WHERE code NOT IN (SELECT code FROM codes)) g
        JOIN (SELECT key, max(sec) AS last FROM per_second GROUP BY key) e ON e.key = g.key AND g.sec <= e.last
        JOIN code_seconds c ON c.key = g.key AND c.code = g.code AND c.sec BETWEEN g.sec - 59 AND g.sec GROUP BY g.key, g.code, g.sec)""",
    "log_format_drift": "SELECT sec, ratio, CASE WHEN ratio >= 0.05 THEN 'HIGH' ELSE 'WARNING' END AS level FROM ratios WHERE ratio >= 0.005",
    "severity_score": f"SELECT key, rule, opened_sec, criticality, {_r6('burn_rate')} AS burn_rate, {_r6('least(greatest(plain, 0.0), 1.0)')} AS score FROM base_scores",
    "severity_level": f"""SELECT *, CASE WHEN score >= 0.55 THEN 'CRITICAL' WHEN score >= 0.35 THEN 'HIGH' WHEN score >= 0.18 THEN 'WARNING' ELSE 'INFO' END AS severity FROM (
        SELECT key, rule, opened_sec, {_r6('least(greatest(plain + 0.10 * 0.75, 0.0), 1.0)')} AS score FROM base_scores)""",
    "alert_reasons": """SELECT key, rule, opened_sec, concat_ws('; ', CASE WHEN z > 0 THEN 'z=' || printf('%.1f', round(z, 1)) || ' over ' || CAST(window_s AS VARCHAR) || 's' END,
        key || ' error rate ' || printf('%.1f', round(observed * 100, 1)) || '% vs baseline ' || printf('%.1f', round(baseline * 100, 1)) || '% (' || CAST(CAST(round(observed / baseline, 0) AS BIGINT) AS VARCHAR) || 'x)') AS reason FROM alerts""",
    "redact_documents": f"SELECT doc_id, {_redacted('text')} AS text FROM documents",
    "redact_pages": f"SELECT page_id, {_redacted('html')} AS html FROM pages",
    "phi_flags": "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for _, p in r.PATTERNS) + " AS has_phi FROM documents",
    "redact_stats": _stats(),
    "origin_closure": "SELECT * FROM origins",
    "downstream_chain": """SELECT o.origin, o.n, concat_ws('>', o.origin, f.chain) AS chain FROM (SELECT origin, count(*) AS n FROM origins GROUP BY origin) o
        LEFT JOIN (SELECT src, string_agg(dst, '>' ORDER BY depth, dst) AS chain FROM closure GROUP BY src) f ON o.origin = f.src""",
    "incident_sessions": "SELECT * FROM sessions",
    "incident_states": f"""SELECT *, CASE WHEN {FIRST_SEC + 400} - last_sec > 120 THEN 'RESOLVED' ELSE 'OPEN' END AS status,
        CASE WHEN {FIRST_SEC + 400} - last_sec > 120 THEN last_sec + 420 END AS cooldown_until_sec FROM sessions""",
    "cascade_groups": "SELECT origin, origin_sec, count(*) AS n, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM origins GROUP BY origin, origin_sec",
    "fault_interval_join": "SELECT key, sec, f.fault AS fault, f.kind AS kind FROM live",
    "ramp_value": f"SELECT l.key, l.sec, l.f.fault AS fault, {_r6('c.err + (l.f.target - c.err) * CASE WHEN l.f.ramp_s <= 0 THEN 1.0 ELSE least((l.sec - l.f.start_sec) / l.f.ramp_s, 1.0) END')} AS value FROM live_rates l JOIN components c ON l.key = c.key",
    "truth_evaluation": """SELECT f.fault, f.key, min(a.opened_sec) IS NOT NULL AS detected, min(a.opened_sec) - f.start_sec AS delay_s FROM faults f
        LEFT JOIN alerts a ON a.key = f.key AND a.opened_sec >= f.start_sec AND a.opened_sec <= f.end_sec + 60 GROUP BY f.fault, f.key, f.start_sec""",
    "propagation_rate": f"""SELECT key, sec, {_r6('least(base + added, 1.0)')} AS expected FROM (
        SELECT s.key, s.sec, c.err AS base, sum(e.coupling * greatest(0.0, coalesce(u.err10 / greatest(u.tot10, 1), b.err) - b.err)) AS added
        FROM sums s JOIN components c ON s.key = c.key JOIN edges e ON e.dst = s.key JOIN components b ON b.key = e.src
        LEFT JOIN sums u ON u.key = e.src AND u.sec = s.sec - CAST(ceil(e.lag_s) AS BIGINT) GROUP BY s.key, s.sec, c.err)""",
    "daily_curve_join": f"""SELECT h.hour, h.n, coalesce(c.volume, 1.0) AS volume, coalesce(c.err_mult, 1.0) AS err_mult, {_r6('h.n / coalesce(c.volume, 1.0)')} AS adjusted
        FROM (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL) h LEFT JOIN curve c ON c.hour = h.hour""",
    "hour_of_week_baseline": f"""SELECT m.how, m.n, {_r6('m.median')} AS median, {_r6('o.mad')} AS mad FROM (
        SELECT CAST(dayofweek(ts) * 24 + hour(ts) AS INTEGER) AS how, count(*) AS n, median(value) AS median FROM events GROUP BY 1) m
        JOIN (SELECT e.how, median(abs(e.value - q.median)) AS mad FROM (SELECT CAST(dayofweek(ts) * 24 + hour(ts) AS INTEGER) AS how, value FROM events) e
            JOIN (SELECT CAST(dayofweek(ts) * 24 + hour(ts) AS INTEGER) AS how, median(value) AS median FROM events GROUP BY 1) q ON e.how = q.how GROUP BY e.how) o ON m.how = o.how""",
    "trace_fanout": "SELECT trace AS trace_group, count(*) AS lines, count(DISTINCT key) AS components, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM counted GROUP BY 1",
    "ewma_static": f"""SELECT s.key, t.seconds, {_r6('sum(power(1 - 2.0 / 301, t.t1 - s.sec) * (2.0 / 301) * (s.err300 / greatest(s.tot300, 1)))')} AS ewma
        FROM sums s JOIN (SELECT key, max(sec) AS t1, count(*) AS seconds FROM sums GROUP BY key) t ON s.key = t.key GROUP BY s.key, t.seconds""",
    "ewma_adaptive": f"SELECT key, sec, {_r6('ewma')} AS ewma, {_r6('sigma')} AS sigma, open AS frozen, {_r6('z10')} AS z FROM learned",
    "baseline_band": f"SELECT key, sec, {_r6('greatest(greatest(ewma, 1e-4) - 3 * sigma, 0.0)')} AS lower, {_r6('greatest(ewma, 1e-4) + 3 * sigma')} AS upper, warming FROM learned",
    "learned_alerts": f"SELECT key, rule, opened_sec, window_s, total, errors, {_r6('baseline')} AS baseline, {_r6('observed')} AS observed, {_r6('z')} AS z FROM learned_openings",
    "component_table": f"""SELECT l.key, round({_rate('err10', 'tot10')}, 5) AS rate_10s, round({_rate('err60', 'tot60')}, 5) AS rate_60s, round(base, 5) AS baseline, round(z10, 2) AS z,
        CASE WHEN open THEN 'open' ELSE 'ok' END AS state, NOT warming AS warm, c.criticality FROM learned l JOIN components c ON l.key = c.key WHERE sec = (SELECT max(sec) FROM learned)""",
    "alerting_components": "SELECT sec, count(*) AS n_open, string_agg(key, ',' ORDER BY key) AS keys FROM learned WHERE open GROUP BY sec",
    "alerts_since": f"SELECT key, rule, opened_sec FROM alerts WHERE opened_sec > {FIRST_SEC + 60}",
    "last_alerts": "SELECT key, rule, opened_sec FROM alerts ORDER BY opened_sec DESC, key, rule LIMIT 1000",
    "last_seconds": "SELECT * FROM dense WHERE sec > (SELECT max(sec) FROM dense) - 60",
    "rolling_rate": f"""SELECT key, sec, total, {_r6('total / greatest(sec - first, 1)')} AS rate FROM (
        SELECT key, sec, CAST(sum(tot) OVER w AS BIGINT) AS total, min(sec) OVER w AS first FROM per_second WINDOW w AS (PARTITION BY key ORDER BY sec RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))""",
    "severity_counts": "SELECT 'AlertCount_' || s.severity AS metric, count(l.severity) AS n FROM (VALUES ('INFO'), ('WARNING'), ('HIGH'), ('CRITICAL')) s(severity) LEFT JOIN levelled l ON l.severity = s.severity GROUP BY s.severity",
    "routed_alerts": "SELECT key, rule, opened_sec, severity, CASE severity WHEN 'CRITICAL' THEN 'sms' WHEN 'INFO' THEN 'none' ELSE 'email' END AS route FROM levelled",
    "alert_neighbours": """SELECT a.key, a.n, coalesce(u.keys, '') AS upstream, coalesce(d.keys, '') AS downstream FROM (SELECT key, count(*) AS n FROM alerts GROUP BY key) a
        LEFT JOIN (SELECT dst, string_agg(src, ',' ORDER BY src) AS keys FROM edges GROUP BY dst) u ON u.dst = a.key
        LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS keys FROM edges GROUP BY src) d ON d.src = a.key""",
    "breach_severity": f"""SELECT key, rule, opened_sec, seconds_in_breach, {_r6('z')} AS z, {_r6('observed')} AS observed, score, severity, concat_ws('; ',
            CASE WHEN z > 0 THEN 'z=' || printf('%.1f', round(z, 1)) || ' over 10s' END,
            key || ' error rate ' || printf('%.1f', round(observed * 100, 1)) || '% vs baseline ' || printf('%.1f', round(baseline * 100, 1)) || '%',
            CASE WHEN seconds_in_breach > 0 THEN 'breaching for ' || CAST(seconds_in_breach AS VARCHAR) || 's' END,
            CASE WHEN criticality >= 0.9 THEN 'payments depend on this component' END,
            CASE WHEN burn_rate >= 14.4 THEN 'burn rate ' || printf('%.1f', round(burn_rate, 1)) || 'x: page' WHEN burn_rate >= 6 THEN 'burn rate ' || printf('%.1f', round(burn_rate, 1)) || 'x: ticket' END,
            CASE WHEN rule = 'cusum' THEN 'rates have been too high for long' END,
            'score ' || printf('%.2f', round(score, 2)) || ' -> ' || severity) AS reason FROM stretches""",
    "redacted_reasons": f"SELECT key, rule, opened_sec, {_redacted('reason')} AS reason FROM (SELECT a.key, a.rule, a.opened_sec, concat_ws('; ', CASE WHEN z > 0 THEN 'z=' || printf('%.1f', round(z, 1)) || ' over ' || CAST(window_s AS VARCHAR) || 's' END, key || ' error rate ' || printf('%.1f', round(observed * 100, 1)) || '% vs baseline ' || printf('%.1f', round(baseline * 100, 1)) || '% (' || CAST(CAST(round(observed / baseline, 0) AS BIGINT) AS VARCHAR) || 'x)') || '; seen with MBR-' || CAST(total AS VARCHAR) AS reason FROM alerts a)",
    "incident_records": f"""SELECT key, rule, opened_sec, last_sec, n, ['INFO', 'WARNING', 'HIGH', 'CRITICAL'][rank] AS max_severity, origin, 'inc_' || lpad(CAST(row_number() OVER (ORDER BY opened_sec, key, rule) AS VARCHAR), 4, '0') AS id,
        CASE WHEN {FIRST_SEC + 400} - last_sec > 120 THEN 'RESOLVED' ELSE 'OPEN' END AS status, CASE WHEN {FIRST_SEC + 400} - last_sec > 120 THEN last_sec + 420 END AS cooldown_until_sec FROM (
            SELECT s.key, s.rule, s.opened_sec, s.last_sec, s.n, max(list_position(['INFO', 'WARNING', 'HIGH', 'CRITICAL'], l.severity)) AS rank, arg_min(o.origin, o.opened_sec) AS origin
            FROM sessions s JOIN levelled l ON l.key = s.key AND l.rule = s.rule AND l.opened_sec BETWEEN s.opened_sec AND s.last_sec
            JOIN origins o ON o.key = l.key AND o.rule = l.rule AND o.opened_sec = l.opened_sec GROUP BY ALL)""",
    "metric_events": f"""SELECT key, sec, '{{"_aws":{{"Timestamp":' || CAST(sec * 1000 AS VARCHAR) || ',"CloudWatchMetrics":[{{"Namespace":"LogQuill","Dimensions":[["Service","Component"],["Service"]],"Metrics":[{{"Name":"ErrorRate","Unit":"None"}}]}}]}},"Service":"'
        || split_part(key, '.', 1) || '","Component":"' || split_part(key, '.', 2) || '","ErrorRate":' || CAST({_r6(_rate('err60', 'tot60'))} AS VARCHAR) || '}}' AS event FROM sums""",
    "sample_summaries": f"SELECT event_id, class, length(value)::INTEGER AS n_bytes, substr(value, 1, 120) AS preview FROM parsed WHERE class IN {REJECTED}",
    "parser_health": "SELECT count(*) AS lines, count(*) FILTER (class = 'valid') AS valid, count(DISTINCT CASE WHEN class = 'unknown_component' THEN key END) AS unknown_keys, (SELECT arg_max(ratio, sec) FROM ratios) AS ratio_60s FROM parsed",
    "skew_kept_lines": "SELECT event_id, sec FROM (SELECT event_id, sec, (SELECT list_sort(list(sec))[count(*) // 2 + 1] FROM parsed WHERE sec IS NOT NULL) AS median_sec FROM parsed) WHERE abs(sec - median_sec) <= 30",
    "severity_hold": "SELECT key, sec, ['INFO', 'WARNING', 'HIGH', 'CRITICAL'][level + 1] AS severity, ['INFO', 'WARNING', 'HIGH', 'CRITICAL'][held + 1] AS held FROM held",
    "stream_alerts": f"SELECT key, sec AS opened_sec, tot10 AS total, err10 AS errors, {_r6(_z('err10', 'tot10', 'base'))} AS z FROM settled_states WHERE ready = 1 AND opened = 1",
    "stream_learned_alerts": f"SELECT key, rule, opened_sec, window_s, total, errors, {_r6('baseline')} AS baseline FROM streamed_openings",
    "stream_incidents": "SELECT * FROM incident_life",
    "stream_silence": f"""SELECT key, sec AS opened_sec, tot60 AS total, {_r6('usual')} AS usual FROM (
        SELECT *, count(*) OVER (PARTITION BY key, run ORDER BY sec) AS low FROM (SELECT *, sec - row_number() OVER (PARTITION BY key ORDER BY sec) AS run FROM low_seconds))
        WHERE low = 31 AND sec <= (SELECT max(sec) FROM per_second WHERE sec <= (SELECT max(sec) FROM counted) - 2)""",
    "stream_clock_guard": """
        SELECT 'ok' AS clock, key, sec, count(*) AS tot, count(*) FILTER (level_class BETWEEN 2 AND 3) AS err FROM clocked WHERE clock = 'ok' AND class NOT IN REJECTED_CLASSES
            AND sec <= (SELECT max(sec) FROM clocked WHERE clock = 'ok' AND class NOT IN REJECTED_CLASSES) - 2 GROUP BY key, sec
        UNION ALL SELECT clock, key, sec, count(*), count(*) FILTER (level_class BETWEEN 2 AND 3) FROM clocked WHERE clock <> 'ok' GROUP BY clock, key, sec""".replace("REJECTED_CLASSES", REJECTED),
    "merged_incidents": "SELECT arg_min(key, id) AS origin, min(opened_sec) AS opened_sec, max(opened_sec) AS last_sec, count(*) AS n, array_to_string(list_sort(list(DISTINCT key)), ',') AS keys FROM told_groups GROUP BY root",
    "incident_deploy": """SELECT * FROM (
        WITH g AS (SELECT root, arg_min(key, id) AS origin, min(opened_sec) AS opened_sec, max(opened_sec) AS last_sec, count(*) AS n, list_sort(list(DISTINCT key)) AS ks FROM alert_groups GROUP BY root),
        d AS (SELECT key, sec, regexp_extract(substr(value, 47), 'release=([^ ]+)', 1) AS release FROM parsed WHERE sec IS NOT NULL AND starts_with(substr(value, 47), 'DEPLOY '))
        SELECT origin, opened_sec, last_sec, n, array_to_string(ks, ',') AS keys, f.release AS deploy, f.sec AS deploy_sec
        FROM (SELECT g.*, (SELECT max({'sec': d.sec, 'release': d.release}) FROM d WHERE list_contains(g.ks, d.key) AND d.sec <= g.opened_sec AND d.sec >= g.opened_sec - 600) AS f FROM g))""",
    "seasonal_alerts": f"""SELECT * FROM (
        WITH e AS (SELECT event_id, event_type AS key, CAST(dayofweek(ts) * 24 + hour(ts) AS INTEGER) AS how, value, CASE WHEN value > 0 THEN power(1.02, ceil(ln(value) / ln(1.02))) * 2 / 2.02 ELSE 0.0 END AS rep FROM events WHERE value IS NOT NULL),
        m AS (SELECT key, how, count(*) AS n, quantile_disc(rep, 0.5) AS median FROM e GROUP BY key, how),
        o AS (SELECT e.key, e.how, any_value(m.n) AS n, any_value(median) AS median, quantile_disc(abs(rep - median), 0.5) AS mad FROM e JOIN m ON m.key = e.key AND m.how = e.how GROUP BY e.key, e.how)
        SELECT e.event_id, e.key, e.how, e.value, o.n, {_r6('median')} AS median, {_r6('mad')} AS mad, {_r6('(value - median) / (1.4826 * mad)')} AS z
        FROM e JOIN o ON o.key = e.key AND o.how = e.how WHERE o.n >= 8 AND mad > 0 AND (value - median) / (1.4826 * mad) >= 3.5)""",
    "truth_pairs": "SELECT * FROM told_pairs",
    "truth_scores": f"""SELECT * FROM (
        WITH a AS (SELECT o.key, EXISTS (SELECT 1 FROM told_faults f WHERE f.key = o.key AND o.opened_sec BETWEEN f.start_sec AND f.end_sec + 60) AS inside FROM told_openings o),
        k AS (SELECT key FROM a UNION SELECT key FROM told_faults UNION SELECT 'ALL'),
        t AS (SELECT k.key, (SELECT count(*) FROM told_faults f WHERE k.key IN (f.key, 'ALL')) AS faults, (SELECT count(*) FROM a WHERE k.key IN (a.key, 'ALL')) AS alerts,
            (SELECT count(*) FROM told_pairs p WHERE k.key IN (p.key, 'ALL')) AS matched, (SELECT count(*) FROM a WHERE inside AND k.key IN (a.key, 'ALL')) AS in_faults,
            (SELECT quantile_cont(opened_sec - start_sec, 0.5) FROM told_pairs p WHERE k.key IN (p.key, 'ALL')) AS m, (SELECT quantile_cont(opened_sec - start_sec, 0.95) FROM told_pairs p WHERE k.key IN (p.key, 'ALL')) AS q FROM k)
        SELECT key, faults, alerts, matched, in_faults, alerts - in_faults AS false_alerts, CASE WHEN matched + alerts - in_faults > 0 THEN {_r6('matched / (matched + alerts - in_faults)')} END AS precision,
            CASE WHEN faults > 0 THEN {_r6('matched / faults')} END AS recall, CASE WHEN matched + alerts - in_faults + faults > 0 THEN {_r6('2 * matched / (matched + alerts - in_faults + faults)')} END AS f1,
            {_r6('(alerts - in_faults) / ((SELECT count(*) FROM events) / 3600)')} AS false_per_hour, CASE WHEN matched > 0 THEN {_r6('in_faults / matched')} END AS alerts_per_incident, {_r6('m')} AS delay_median, {_r6('q')} AS delay_p95 FROM t)""",
    "outbox_after_replay": f"""
        SELECT sha2_key AS idempotency_key, CASE WHEN opened_sec % 4 = 0 THEN 'delivered' ELSE 'pending' END AS status, CASE WHEN opened_sec % 4 < 2 THEN 1 ELSE 0 END AS attempts, opened_sec AS created_s
        FROM (SELECT *, sha256(key || '|' || rule || '|' || opened_sec) AS sha2_key FROM told_openings)
        WHERE NOT (opened_sec % 4 = 0 AND opened_sec < {FIRST_SEC} + 1000)""",
    "future_lines": "SELECT event_id, sec FROM parsed WHERE sec > (SELECT (min(sec) + max(sec)) // 2 FROM parsed) + 60",
    "outbox_pending": f"SELECT idempotency_key, attempts, next_attempt_s FROM outbox WHERE status = 'pending' AND next_attempt_s <= {FIRST_SEC + 100_000} ORDER BY next_attempt_s, idempotency_key LIMIT 50",
    "outbox_stats": "SELECT s.status, count(o.status) AS n FROM (VALUES ('pending'), ('in_progress'), ('delivered'), ('failed')) s(status) LEFT JOIN outbox o ON o.status = s.status GROUP BY s.status",
    "alert_dedupe": "SELECT idempotency_key, 'pending' AS status, created_s FROM outbox",
    "stream_per_second": "SELECT * FROM per_second WHERE sec <= (SELECT max(sec) FROM counted) - 2",
    "error_rate_alarms": f"SELECT key, sec // 60 * 60 AS window_start, {_r6('avg(err / greatest(tot, 1))')} AS mean_rate FROM dense GROUP BY ALL HAVING avg(err / greatest(tot, 1)) > 0.05",
}

FINALS["routed_lines"] = f"SELECT reason, 'malformed_header' AS class, n FROM ({FINALS['reject_reasons']})"
_ADVANCED = f"""
    SELECT key, 'mix' AS rule, sec FROM ({FINALS['js_code_mix']}) WHERE drifted AND key = 'CLM.EDT'
    UNION SELECT key, 'latency', sec FROM ({FINALS['latency_shift']}) WHERE shifted
    UNION SELECT key, 'new_code', sec FROM ({FINALS['new_code']}) WHERE is_new
    UNION SELECT key, 'silence', unnest(generate_series(first_sec + 29, last_sec)) FROM ({FINALS['silence_runs']}) WHERE silent"""
FINALS["advanced_alerts"] = f"""SELECT key, rule, sec AS opened_sec FROM (
    SELECT *, sum(ready) OVER (PARTITION BY key, rule, segment ORDER BY sec) AS opened FROM (
        SELECT *, CASE WHEN hit = 1 AND breach_run >= 2 THEN 1 ELSE 0 END AS ready, sum(CASE WHEN quiet_run = 31 THEN 1 ELSE 0 END) OVER (PARTITION BY key, rule ORDER BY sec) AS segment FROM (
            SELECT *, sum(hit) OVER (PARTITION BY key, rule, calm ORDER BY sec) AS breach_run, sum(1 - hit) OVER (PARTITION BY key, rule, hits ORDER BY sec) AS quiet_run FROM (
                SELECT *, sum(1 - hit) OVER (PARTITION BY key, rule ORDER BY sec) AS calm, sum(hit) OVER (PARTITION BY key, rule ORDER BY sec) AS hits FROM (
                    SELECT d.key, r.rule, d.sec, CASE WHEN h.sec IS NULL THEN 0 ELSE 1 END AS hit FROM dense d JOIN (SELECT DISTINCT key, rule FROM ({_ADVANCED})) r ON r.key = d.key
                    LEFT JOIN ({_ADVANCED}) h ON h.key = d.key AND h.rule = r.rule AND h.sec = d.sec))))) WHERE ready = 1 AND opened = 1"""

ORACLE_SQL = {name: with_ctes(sql) for name, sql in FINALS.items()}
