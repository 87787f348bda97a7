"""Measurement algebra as column expressions: estimates, error budgets, intervals, conformal scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error budgets in metres by tier, and confidence levels with their normal quantiles.
BUDGETS = {
    "lidar": {"bias": 0.003, "drift": 0.002, "definition": 0.003, "jamb": 0.015, "level": 0.003, "unobserved": 0.08},
    "video": {"bias": 0.010, "drift": 0.010, "definition": 0.005, "jamb": 0.03, "level": 0.010, "unobserved": 0.15},
    "photo": {"bias": 0.020, "drift": 0.015, "definition": 0.008, "jamb": 0.04, "level": 0.015, "unobserved": 0.25},
}
Z = {0.8: 1.2816, 0.9: 1.6449, 0.95: 1.96}
LENGTHS = ("wall_length", "ceiling_height", "opening_width", "opening_height", "damage_extent")
AREAS = ("floor_area", "footprint_area")
SQUARE_FEET, FEET = 10.7639, 3.28084


def z_for(confidence: float) -> float:
    """Two-sided normal quantile; beyond the listed levels by bisection of the error function."""
    import math

    if confidence in Z:
        return Z[confidence]
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < confidence else (low, mid)
    return low


def interval(value: Column, sigma_abs: Column, sigma_log: Column, abs_mult: Column, abs_floor: Column,
             log_mult: Column, log_floor: Column, z: float = Z[0.9]) -> tuple[Column, Column]:
    """(lo, hi): absolute and logarithmic spread, scaled by calibration, combined in quadrature on each side; lo isn't negative."""
    a = F.hypot(sigma_abs * abs_mult, abs_floor)
    g = sigma_log * log_mult + log_floor
    low = value - F.hypot(z * a, F.abs(value - value * F.exp(-z * g)))
    high = value + F.hypot(z * a, F.abs(value * F.exp(z * g) - value))
    return F.greatest(low, F.lit(0.0)), high


def covered(truth: Column, lo: Column, hi: Column) -> Column:
    return truth.between(lo, hi)


def error(value: Column, truth: Column) -> Column:
    return value - truth


def relative_error(value: Column, truth: Column) -> Column:
    """Null for a truth of zero."""
    return F.try_divide(value - truth, truth)


def edge_sigma(sigma: Column, observed: Column, bias: Column, drift: Column, unobserved: Column) -> Column:
    return F.when(observed, F.sqrt(sigma * sigma + bias * bias + drift * drift)).otherwise(F.hypot(sigma, unobserved))


def conformal_score(truth: Column, value: Column, lo: Column, hi: Column) -> Column:
    """Error in units of the half width on the truth's side."""
    half = F.when(truth >= value, hi - value).otherwise(value - lo)
    return F.abs(truth - value) / F.greatest(half, F.lit(1e-9))


def scale_power(kind: Column, ratio: Column) -> Column:
    """What a length scale does to a kind: lengths once, areas twice, others not at all."""
    return F.when(kind.isin(*LENGTHS), ratio).when(kind.isin(*AREAS), ratio * ratio).otherwise(F.lit(1.0))


def imperial(value: Column, unit: Column) -> Column:
    return F.round(value * F.when(unit == "m2", SQUARE_FEET).when(unit == "m", FEET).otherwise(1.0), 2)


def shown(value: Column, lo: Column, hi: Column, unit: Column) -> Column:
    """`v [lo, hi] unit`."""
    return F.format_string("%.2f [%.2f, %.2f] %s", value, lo, hi, unit)
