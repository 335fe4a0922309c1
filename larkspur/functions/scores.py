"""Numeric functions as columns."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Click-through rates by position, and how they fade beyond the table.
CTR_CLEAN = {1: 0.264, 2: 0.121, 3: 0.067, 4: 0.048, 5: 0.034, 6: 0.029, 7: 0.020, 8: 0.014, 9: 0.012, 10: 0.010}
CTR_WORKING = {1: 0.28, 2: 0.15, 3: 0.10, 4: 0.07, 5: 0.05, 6: 0.04, 7: 0.03, 8: 0.025, 9: 0.02, 10: 0.018}
PRIORS = {"first_page_sage": CTR_CLEAN, "working": CTR_WORKING}
TAIL_DECAY, TAIL_FLOOR = 0.85, 0.003


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ctr_curve(calibrated: Mapping[int, float] | None = None, prior: str = "first_page_sage", aio: bool = False, aio_multiplier: float = 0.39) -> dict[int, float]:
    """Rates for positions 1 to 10: the calibrated one where there is one, else the prior, times the multiplier on pages with an AI overview."""
    base = PRIORS[prior] | {k: v for k, v in (calibrated or {}).items() if k in range(1, 11)}
    return {k: v * (aio_multiplier if aio else 1.0) for k, v in base.items()}


def expected_ctr(position: Column, curve: Mapping[int, float] | None = None) -> Column:
    """Rate at the rounded position (half to even), at least 1; beyond the table it fades to the floor."""
    curve = curve or CTR_CLEAN
    last = max(curve)
    p = F.greatest(F.lit(1), F.bround(position).cast("int"))
    table = F.create_map(*[x for k, v in sorted(curve.items()) for x in (F.lit(k), F.lit(float(v)))])
    tail = F.greatest(F.lit(TAIL_FLOOR), F.lit(curve[last]) * F.pow(F.lit(TAIL_DECAY), p - last))
    return F.when(position.isNull(), F.lit(None).cast("double")).when(p <= last, F.element_at(table, p)).otherwise(tail)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; an error if the lengths differ or one is zero, null if one is null."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    wrong = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("embedding dimensions differ")).cast("double")).when(size == 0, F.raise_error(F.lit("zero-magnitude embedding")).cast("double"))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(wrong, dot(a, b) / size))


def gap_score(volume: Column, expected: Column, actual: Column, effort: Column) -> Column:
    """Volume times unclaimed share over effort, the effort scaled to 1..2."""
    return volume * F.greatest(expected - actual, F.lit(0.0)) / (F.lit(1.0) + effort)


def priority(volume: Column, ctr_modifier: Column, value: Column, winnability: Column) -> Column:
    return volume * ctr_modifier * value * winnability


def publish_by(peak: Column, lead_weeks: int = 8) -> Column:
    """Date by which to publish for a seasonal peak."""
    return F.date_sub(peak, 7 * lead_weeks)


def max_wip(capacity_per_week: Column, cycle_weeks: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(capacity_per_week * cycle_weeks).cast("int"))


def membership(overlap: Column, depth: int) -> Column:
    return F.round(F.least(overlap / F.lit(float(depth)), F.lit(1.0)), 4)


def z_score(value: Column, median: Column, mad: Column) -> Column:
    """Robust z; null if the spread is 0."""
    return F.try_divide(value - median, F.lit(1.4826) * mad)


LOG2 = math.log(2.0)
