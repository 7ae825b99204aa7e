"""Statistics of error counts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-4


def rate(err: Column, tot: Column) -> Column:
    return err / F.greatest(tot, F.lit(1))


def binomial_z(err: Column, tot: Column, p0: Column) -> Column:
    """How far err is from tot * p0 in standard deviations; 64 for errors where none can vary."""
    var = tot * p0 * (1 - p0)
    return F.when(tot <= 0, 0.0).when(var < 1e-9, F.when(err > 0, 64.0).otherwise(0.0)).otherwise((err - tot * p0) / F.sqrt(var))


def wilson_lower(err: Column, tot: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of err / tot."""
    share, zz = err / tot, z * z
    middle = share + zz / (2 * tot)
    spread = z * F.sqrt((share * (1 - share) + zz / (4 * tot)) / tot)
    return F.when(tot <= 0, 0.0).otherwise(F.greatest((middle - spread) / (1 + zz / tot), F.lit(0.0)))


def js_term(p: Column, q: Column, eps: float = 1e-12) -> Column:
    """A code's share of the Jensen-Shannon divergence of two distributions."""
    p, q = p + eps, q + eps
    m = (p + q) / 2
    return (p * F.ln(p / m) + q * F.ln(q / m)) / 2


def burn_rate(r: Column, slo: float = 0.01) -> Column:
    return r / max(1 - slo, 1e-6)


def deviation_score(z: Column, r: Column, base: Column) -> Column:
    z_part = F.least(F.greatest(z, F.lit(0.0)) / 30, F.lit(1.0))
    ratio = F.least(F.greatest((r / base - 1) / 99, F.lit(0.0)), F.lit(1.0))
    return 0.5 * z_part + 0.5 * F.when(base <= 0, F.when(r > 0, 1.0).otherwise(0.0)).otherwise(ratio)


def duration_score(seconds: Column) -> Column:
    return F.least(F.greatest(seconds, F.lit(0)) / 120, F.lit(1.0))


def cycle_score(minutes: Column, cutoff_min: float) -> Column:
    """1 at the payment cutoff, falling to 0 at twice its length before; 0 without a cutoff."""
    return F.when(minutes.isNull(), 0.0).otherwise(F.least(F.greatest((2 * cutoff_min - minutes) / cutoff_min, F.lit(0.0)), F.lit(1.0)))


def severity_score(dev: Column, dur: Column, criticality: Column, burn: Column, cycle: Column) -> Column:
    total = 0.40 * dev + 0.18 * dur + 0.22 * criticality + 0.10 * F.least(F.greatest(burn, F.lit(0.0)) / 14.4, F.lit(1.0)) + 0.10 * cycle
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def severity_level(score: Column) -> Column:
    return F.when(score >= 0.55, "CRITICAL").when(score >= 0.35, "HIGH").when(score >= 0.18, "WARNING").otherwise("INFO")


def backoff_s(attempt: Column, key: Column, base: float = 60, most: float = 3600) -> Column:
    """Seconds until the next attempt: doubled each time, capped, spread by a quarter either way by a
    hash of the key."""
    spread = F.pmod(F.xxhash64(key, attempt), F.lit(10000)) / 10000
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(most)) * (1 + 0.25 * (2 * spread - 1))
