"""Learned baselines: exponentially weighted mean and variance of the 300 s error rate."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.operators.detectors import (
    CUSUM_LIMIT, CUSUM_SLACK, K_FAST, K_SLOW, MIN_DELTA, MIN_N, QUIET, WILSON_KEYS, WILSON_N, WILSON_RATE, Z_FAST, Z_SLOW, with_least, with_thresholds,
)
from logquill.operators.folds import TOLERANCE, fold_by_hour
from logquill.operators.windows import CHUNK_S
from logquill.sources import vocabulary as voc

SPAN_S, WARMUP_S = 300, 120


def ewma(sums: DataFrame, span_s: int = SPAN_S) -> DataFrame:
    """key, seconds and ewma at the last second, of an average that starts at 0 and never stops learning.

    The value after the last second is a weighted sum, with weights that fall by a constant factor a
    second, so it needs one aggregate with partial sums and no pass in order."""
    keep = 1 - 2 / (span_s + 1)
    span = sums.groupBy("key").agg(F.max("sec").alias("t1"), F.count("*").alias("seconds"))
    rows = sums.join(F.broadcast(span), "key")  # as many as the platform has components
    weight = F.pow(F.lit(keep), F.col("t1") - F.col("sec")) * (1 - keep)
    total = F.sum(weight * s.rate(F.col("err300"), F.col("tot300")))
    return rows.groupBy("key", "seconds").agg(F.round(total, 6).alias("ewma"))


NUMBERS = ("tot10", "err10", "tot30", "err30", "tot60", "err60", "tot300", "err300", "t_tot", "t_err", "limit_rate", "min_n", "least", "base")
FOLDED = "key string, sec long, tot10 long, err10 long, tot30 long, err30 long, tot60 long, err60 long, t_tot long, t_err long, window_s int, base double, ewma double, sigma double, warming boolean, z10 double, z60 double, cusum double, rule string, open boolean, opened_now boolean"


@dataclass
class _Key:
    """What is carried from one second of a component to the next."""

    mean: float
    var: float = s.FLOOR**2
    seen: int = 0
    run: int = 0
    quiet: int = 0
    cusum: float = 0.0
    open: bool = False


def _z(err: int, tot: int, base: float) -> float:
    spread = tot * base * (1 - base)
    return (err - tot * base) / spread**0.5 if spread >= 1e-9 else 64.0 * (err > 0 and tot > 0)


def _wilson(err: int, tot: int) -> float:
    share, zz = err / tot, 1.96**2
    return max((share + zz / (2 * tot) - 1.96 * ((share * (1 - share) + zz / (4 * tot)) / tot) ** 0.5) / (1 + zz / tot), 0.0)


def step(k: _Key, key: str, x: dict, alpha: float) -> tuple:
    """Moves k on by the second x; (base, ewma, sigma, warming, z10, z60, cusum, rule, open, opened_now).

    Every rule is judged by the baseline as it was before the second, and the baseline learns from the
    second only if no alert of the component is open."""
    base, warming, active = max(k.mean, s.FLOOR), k.seen < WARMUP_S, x["tot300"] > 0
    z10, z60 = _z(x["err10"], x["tot10"], base), _z(x["err60"], x["tot60"], base)
    rates = {w: x[f"err{w}"] / max(x[f"tot{w}"], 1) for w in (10, 60, 300)}
    k.cusum = max(k.cusum + rates[60] - base - CUSUM_SLACK * max(k.var, 1e-12) ** 0.5, 0.0) if x["tot60"] >= MIN_N and active else 0.0
    rule = None
    if not warming:
        if x["tot10"] >= x["least"] and z10 > Z_FAST and rates[10] > base + MIN_DELTA and active:
            rule = "fast"
        elif x["tot60"] >= x["least"] and z60 > Z_SLOW and rates[60] > base + MIN_DELTA and active:
            rule = "slow"
        elif key in WILSON_KEYS and x["tot30"] >= WILSON_N and _wilson(x["err30"], x["tot30"]) > WILSON_RATE:
            rule = "wilson"
        elif x["t_tot"] >= x["min_n"] and x["t_err"] / max(x["t_tot"], 1) > x["limit_rate"] and active:
            rule = "threshold"
        elif k.cusum > CUSUM_LIMIT:
            rule = "cusum"
    k.run, k.quiet = (0, 0) if warming else (min(k.run + 1, K_SLOW), 0) if rule else (0, min(k.quiet + 1, QUIET + 1))  # more make no difference
    still = k.open and k.quiet <= QUIET
    opened = not still and rule is not None and k.run >= (K_SLOW if rule in ("slow", "cusum") else K_FAST)
    k.open = still or opened
    if active:
        k.seen = min(k.seen + 1, WARMUP_S)
        if not k.open:
            gap = rates[300] - k.mean
            k.mean += alpha * gap
            k.var += alpha * (gap * gap - k.var)
    return base, k.mean, max(k.var, 0.0) ** 0.5, warming, z10, z60, k.cusum, rule, k.open, opened


def carried_on(k: _Key) -> dict:
    """k as a state. While an alert is open its run doesn't matter, and without one how long it has been quiet doesn't."""
    return asdict(k) | ({"run": 0} if k.open else {"quiet": 0})


def brief(own: pa.Table, state: dict, alpha: float) -> tuple[dict, dict]:
    """The state after an hour, and for which other states its seconds go the same way: as long as cusum before it lies between
    `above` and `upto`, cusum after it is max(cusum + plus, least). An open alert stays open until the first breach if it has been quiet for
    `quiet` seconds at most (None: no other than it was)."""
    k, before = _Key(**state), state["cusum"]
    plus, least, above, upto = 0.0, -math.inf, -math.inf, math.inf
    quiet, leading = None, k.open
    for i, (key, x) in enumerate(_seconds(own)):
        spread = CUSUM_SLACK * max(k.var, 1e-12) ** 0.5
        base, _, _, warming, _, _, _, rule, still, _ = step(k, key, x, alpha)
        if x["tot60"] >= MIN_N and x["tot300"] > 0:
            gain = x["err60"] / max(x["tot60"], 1) - base - spread
            plus, least = plus + gain, max(least + gain, 0.0)
        else:
            plus, least = -math.inf, 0.0
        if not warming and rule in (None, "cusum") and least <= CUSUM_LIMIT:  # cusum has been asked for, and what was before counts
            if rule:
                above = max(above, CUSUM_LIMIT - plus)
            else:
                upto = min(upto, CUSUM_LIMIT - plus)
        if leading and (rule or not still):
            leading, quiet = False, QUIET - i if still else None
    return carried_on(k), {"before": before, "plus": plus, "least": least, "above": above, "upto": upto, "quiet": quiet}


#: How near to a limit of cusum a state may come to be judged without its hour.
MARGIN = 1e-6


def follow(before: dict, told: tuple[dict, dict], other: dict) -> dict | None:
    """The state after an hour for another state before it; None if its seconds may go another way."""
    after, how = told
    alike = all(abs(before[c] - other[c]) <= TOLERANCE for c in ("mean", "var")) and all(before[c] == other[c] for c in ("seen", "open", "run"))
    if not alike or not (before["quiet"] == other["quiet"] or how["quiet"] is not None and other["quiet"] <= how["quiet"]):
        return None
    if abs(before["cusum"] - other["cusum"]) <= TOLERANCE:
        return after
    if how["above"] + MARGIN < other["cusum"] < how["upto"] - MARGIN:
        return after | {"cusum": max(other["cusum"] + how["plus"], how["least"])}
    return None


def _seconds(own: pa.Table) -> Iterator[tuple[str, dict]]:
    for key, *values in zip(own["key"].to_pylist(), *(own[c].to_pylist() for c in NUMBERS), strict=True):
        yield key, dict(zip(NUMBERS, values, strict=True))


STATE = "mean double, var double, seen long, run long, quiet long, cusum double, open boolean"


def learned(sums: DataFrame, span_s: int = SPAN_S, hour_s: int = CHUNK_S) -> DataFrame:
    """Every second of every component with its learned baseline (base before the second, ewma and
    sigma after it), the rule that breaches, and whether an alert is open or opens.

    Learning starts at the vocabulary's rate and stops while an alert of the component is open, which
    depends on the baseline itself, so no window can tell it. Chains of hours are folded apart, first from a guess: the vocabulary's rate and
    no alert, with the active seconds before the hour, which are counted. An hour forgets what a baseline was before it but for a
    share of (1 - alpha) ** 3600, some 1e-11, so few are folded again; cusum, which may rise for as long as an alert is open, is carried over hours
    by sums (`brief`)."""
    alpha = 2 / (span_s + 1)

    def fold(own: pa.Table, state: dict) -> tuple[pa.Table, dict]:
        carried, out = _Key(**state), []
        for k, x in _seconds(own):
            out.append(step(carried, k, x, alpha))
        told = list(zip(*out, strict=True))
        kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.bool_(), pa.bool_())
        kept = [own[c] for c in ("key", "sec", "tot10", "err10", "tot30", "err30", "tot60", "err60", "t_tot", "t_err", "window_s")]
        return pa.table([*kept, *(pa.array(c, t) for c, t in zip(told, kinds, strict=True))], names=[c.split(" ")[0] for c in FOLDED.split(", ")]), carried_on(carried)

    def guess(rows: DataFrame) -> DataFrame:
        hours = rows.groupBy("key", "_hour").agg(F.first("base").alias("mean"), F.count_if(F.col("tot300") > 0).alias("active"))
        before = F.sum("active").over(Window.partitionBy("key").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))
        zero = F.lit(0).cast("long")
        return hours.withColumns({"var": F.lit(s.FLOOR**2), "seen": F.least(F.coalesce(before, zero), F.lit(WARMUP_S)), "run": zero, "quiet": zero, "cusum": F.lit(0.0), "open": F.lit(False)})

    seed = voc.components(sums.sparkSession).select("key", F.col("err").alias("base"))
    rows = with_thresholds(with_least(sums)).join(F.broadcast(seed), "key").select("key", "sec", "window_s", *NUMBERS)
    return fold_by_hour(rows, guess, fold, STATE, FOLDED, hour_s, lambda own, state: brief(own, state, alpha), follow)


def band(states: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """key, sec, lower, upper, warming: the band around the learned baseline."""
    spread = sigmas * F.col("sigma")
    floored = F.greatest("ewma", F.lit(s.FLOOR))
    return states.select("key", "sec", F.greatest(floored - spread, F.lit(0.0)).alias("lower"), (floored + spread).alias("upper"), "warming")
