"""Scalar expressions: stretches, radiometry, gates, features, labels, formats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo, hi) -> Column:
    """x held within [lo, hi]; null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stretch(x: Column, lo: Column, hi: Column) -> Column:
    """Linear stretch of [lo, hi] to [0, 1]; an empty range is widened by 1e-6."""
    top = F.when(hi <= lo, lo + 1e-6).otherwise(hi)
    return clip((x - lo) / (top - lo), 0, 1)


def to_uint8(x: Column) -> Column:
    return F.rint(255 * x).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def log_compress(v: Column) -> Column:
    """log(1 + 4v) / log 5, which keeps 0 and 1."""
    return F.log1p(4 * F.greatest(v, F.lit(0.0))) / math.log(5)


def smoothstep_gate(r: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, 3t^2 - 2t^3 between."""
    t = clip((r - low) / max(high - low, 1e-6), 0, 1)
    return t * t * (3 - 2 * t)


def subpixel_peak(left: Column, centre: Column, right: Column) -> Column:
    """Offset of the vertex of a parabola through three samples, within 0.75; 0 where it is flat."""
    d = left - 2 * centre + right
    return F.when(F.abs(d) <= 1e-6, F.lit(0.0)).otherwise(clip(0.5 * (left - right) / F.when(F.abs(d) <= 1e-6, F.lit(1.0)).otherwise(d), -0.75, 0.75))


def endpoint_scale(source: Column, target: Column) -> Column:
    """Step that maps the first and last of target samples to those of source samples."""
    return F.when((target <= 1) | (source <= 1), F.lit(0.0)).otherwise((source - 1) / F.greatest(target - 1, F.lit(1)))


def rgb_features(r: Column, g: Column, b: Column) -> Column:
    """Fifteen features of a colour: channels, luma, chromaticities, logs, products and squares."""
    total = F.greatest(r + g + b, F.lit(1e-6))
    log = lambda v: F.log(F.greatest(v, F.lit(0.0)) + 1e-3)
    return F.array(r, g, b, luma709(r, g, b), r / total, g / total, log(r), log(g), log(b), r * g, r * b, g * b, r * r, g * g, b * b)


def wavelength_of(label: Column) -> Column:
    """The number in a label like "2201.0nm"; null when it has another form."""
    return F.regexp_extract(label, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*nm\s*$", 1).try_cast("double")


def improvement_percent(new: Column, base: Column, direction: Column, target: Column) -> Column:
    """Relative gain in percent: for "higher", "lower", or closeness to "target"; null on a baseline near 0."""
    higher = 100 * F.try_divide(new - base, F.abs(base))
    lower = 100 * F.try_divide(base - new, F.abs(base))
    near = 100 * F.try_divide(F.abs(base - target) - F.abs(new - target), F.abs(base - target))
    return F.when(direction == "target", F.when(F.abs(base - target) > 1e-12, near)).when(F.abs(base) <= 1e-12, None).when(direction == "higher", higher).otherwise(lower)


def raw_change_percent(new: Column, base: Column) -> Column:
    return F.when(F.abs(base) > 1e-12, 100 * F.try_divide(new - base, F.abs(base)))


def cosine_taper(w: Column, lo: float, hi: float) -> Column:
    """1 below lo, 0 above hi, half a cosine between."""
    p = clip((w - lo) / max(hi - lo, 1e-6), 0, 1)
    return F.when(w < lo, F.lit(1.0)).when(w > hi, F.lit(0.0)).otherwise(0.5 + 0.5 * F.cos(math.pi * p))


def water_absorption(w: Column) -> Column:
    return w.between(1340.0, 1450.0) | w.between(1800.0, 1960.0)


def number_text(x: Column, digits: int) -> Column:
    """A number with so many places; null stays null, what isn't finite is a dash."""
    return F.when(x.isNotNull(), F.when(finite(x).isNull(), F.lit("-")).otherwise(F.format_string(f"%.{digits}f", x)))


def percent_text(x: Column, digits: int = 1) -> Column:
    """A percentage with its sign."""
    return F.when(x.isNotNull(), F.when(finite(x).isNull(), F.lit("-")).otherwise(F.format_string(f"%+.{digits}f %%", x)))
