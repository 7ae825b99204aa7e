"""Streaming alerts: rules on settled seconds, with state by component.

Every second up to the watermark is judged for every component that has spoken in the last FORGET_S, lines or
none, so an alert that falls due in a silence is told in it. The state is what a rule needs and no more: counts of
its longest window, counters, and what the baseline's fold carries on. FORGET_S after its last line a component's
state is gone and it starts anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.functions.stats import FLOOR
from logquill.operators import baseline
from logquill.operators.detectors import K_FAST, MIN_DELTA, MIN_N, QUIET, Z_FAST
from logquill.operators.drift import ADVANCED_BREACHES, ADVANCED_QUIET, SILENT_RATE, SILENT_S, WARMUP_S
from logquill.sources import vocabulary as voc
from logquill.streaming.timed import Fold, settled_fold

OUTPUT = "key string, opened_sec long, total long, errors long, z double"
LEARNED = "key string, rule string, opened_sec long, window_s int, total long, errors long, baseline double"
SILENCE = "key string, opened_sec long, total long, usual double"
WINDOW, LONGEST, FORGET_S = 10, 300, 900
WINDOWS = (10, 30, 60, LONGEST)


def each_second(start: Callable[[str], dict], step: Callable[[dict, str, int, int, int], tuple | None], forget_s: int = FORGET_S) -> Fold:
    """A fold that hands every second from a key's first line to the last settled one to step."""

    def fold(key: tuple, state: dict | None, due: list[tuple[int, tuple]], settled: int) -> tuple[list[tuple], dict | None, int | None]:
        out, rows = [], iter([*due, (settled + 1, (0, 0))])
        at, counts = next(rows)
        sec = state["sec"] + 1 if state else at
        while sec <= settled:
            state = state or start(key[0]) | {"spoken": sec}
            now = counts if sec == at else (0, 0)
            if sec == at:
                at, counts = next(rows)
            if now[0]:
                state["spoken"] = sec
            elif sec - state["spoken"] >= forget_s:
                state, sec = None, at  # to its next line, if there is one
                continue
            state["sec"] = sec
            if found := step(state, key[0], sec, *now):
                out.append((key[0], *found))
            sec += 1
        return out, state, settled + 1 if state else None

    return fold


def slid(state: dict, windows: tuple[int, ...], now: tuple[int, ...]) -> list[list[int]]:
    """Moves a state's ring (counts of the last seconds) and its sums over each of windows, the longest last, on by a second;
    a second costs the same however long the windows are."""
    ring, sums = state["ring"], state["sums"]
    ring.append(now)
    for w, own in zip(windows, sums, strict=True):
        gone = ring[-1 - w] if len(ring) > w else None
        for i, x in enumerate(now):
            own[i] += x - gone[i] if gone else x
    if len(ring) > windows[-1]:
        ring.pop(0)
    return sums


def emptied(windows: tuple[int, ...], values: int) -> dict:
    return {"ring": [], "sums": [[0] * values for _ in windows]}


def opens(state: dict, hit: bool, needed: int, quiet: int) -> bool:
    """Moves the counters of a state on; whether an alert opens."""
    state["run"], state["quiet"] = (state["run"] + 1, 0) if hit else (0, state["quiet"] + 1)
    state["open"] = state["open"] and state["quiet"] <= quiet
    if state["open"] or state["run"] < needed:
        return False
    state["open"] = True
    return True


def _judged(counts: DataFrame, keys: list[str], fold: Fold, schema: str) -> DataFrame:
    return settled_fold(counts.where(F.col("key").isin(keys)), ("key",), ("sec",), ("tot", "err"), fold, schema)


def fast_alerts(counts: DataFrame, vocabulary: voc.Vocabulary = voc.DEFAULT) -> DataFrame:
    """Openings of the fast rule from a stream of settled counts (key, sec, tot, err)."""
    least = {key: n for key, _, _, n in voc.THRESHOLDS}
    bases = {r[1]: max(r[6], FLOOR) for r in vocabulary.component_rows()}

    def step(state: dict, key: str, sec: int, tot: int, err: int) -> tuple | None:
        n, bad = slid(state, (WINDOW,), (tot, err))[0]
        z, base = baseline._z(bad, n, bases[key]), bases[key]
        hit = n >= least.get(key, MIN_N) and z > Z_FAST and bad / max(n, 1) > base + MIN_DELTA and sec - state["spoken"] < LONGEST
        return (sec, n, bad, z) if opens(state, hit, K_FAST, QUIET) else None

    return _judged(counts, list(bases), each_second(lambda key: emptied((WINDOW,), 2) | {"run": 0, "quiet": 0, "open": False}, step), OUTPUT)


def learned_alerts(counts: DataFrame, vocabulary: voc.Vocabulary = voc.DEFAULT) -> DataFrame:
    """Openings of all rules, by the learned baseline, from a stream of settled counts (key, sec, tot,
    err). The state of a component is its counts of the last 300 seconds and what the baseline's fold
    carries on."""
    limits = {key: own for key, *own in voc.THRESHOLDS}
    rates = {r[1]: r[6] for r in vocabulary.component_rows()}
    alpha = 2 / (baseline.SPAN_S + 1)

    def step(state: dict, key: str, sec: int, tot: int, err: int) -> tuple | None:
        rate, window, least = limits.get(key, voc.DEFAULT_THRESHOLD)
        x = {"min_n": least, "limit_rate": rate, "least": limits[key][2] if key in limits else MIN_N}
        for w, own in zip(WINDOWS, slid(state, WINDOWS, (tot, err)), strict=True):
            x[f"tot{w}"], x[f"err{w}"] = own
        x["t_tot"], x["t_err"] = x[f"tot{window}"], x[f"err{window}"]
        carried = baseline._Key(**state["fold"])
        base, *_, rule, _, opened = baseline.step(carried, key, x, alpha)
        state["fold"] = asdict(carried)
        if not opened:
            return None
        size = {"fast": 10, "wilson": 30, "threshold": window}.get(rule, 60)
        return "threshold" if rule == "wilson" else rule, sec, size, x[f"tot{size}"], x[f"err{size}"], base

    return _judged(counts, list(rates), each_second(lambda key: emptied(WINDOWS, 2) | {"fold": asdict(baseline._Key(rates[key]))}, step), LEARNED)


def silence_alerts(counts: DataFrame, vocabulary: voc.Vocabulary = voc.DEFAULT) -> DataFrame:
    """Openings of the silence rule from a stream of settled counts (key, sec, tot, err): a component that had more than
    SILENT_RATE lines a second in its first minute (`usual`) has had less over the last one, for SILENT_S seconds."""

    def step(state: dict, key: str, sec: int, tot: int, err: int) -> tuple | None:
        total = slid(state, (WARMUP_S,), (tot,))[0][0]
        state["seen"] += 1
        if state["seen"] == WARMUP_S:
            state["usual"] = total / WARMUP_S
        low = state["seen"] > WARMUP_S and state["usual"] > SILENT_RATE and total < SILENT_RATE * WARMUP_S
        state["low"] = state["low"] + 1 if low else 0
        return (sec, total, state["usual"]) if opens(state, state["low"] >= SILENT_S, ADVANCED_BREACHES, ADVANCED_QUIET) else None

    start = {"seen": 0, "usual": 0.0, "low": 0, "run": 0, "quiet": 0, "open": False}
    return _judged(counts, [r[1] for r in vocabulary.component_rows()], each_second(lambda key: start | emptied((WARMUP_S,), 1), step), SILENCE)
