"""Scalar column helpers used across the package."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import functions as F

# Fixed value: smallest positive normal double.
TINY = 2.2250738585072014e-308


def clamp_variance(v: F.Column) -> F.Column:
    return F.greatest(v, F.lit(TINY))


def rbf(squared_distance: F.Column, bandwidth: float) -> F.Column:
    return F.exp(F.lit(-bandwidth) * squared_distance)


def dot(x: F.Column, y: F.Column) -> F.Column:
    """Inner product of two array columns."""
    return F.aggregate(F.zip_with(x, y, lambda u, v: (u * v).cast("double")), F.lit(0.0), lambda s, v: s + v)


def running_sum(x: F.Column) -> F.Column:
    """Cumulative sum of an array column."""
    return F.aggregate(
        x, F.array().cast("array<double>"),
        lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) + v)))


def positions(x: F.Column, test) -> F.Column:
    """0-based positions of the elements that pass ``test``."""
    flags = F.transform(x, lambda v, i: F.when(test(v), i))
    return F.filter(flags, lambda v: v.isNotNull())


def recode(col: F.Column, names: Mapping[str, str]) -> F.Column:
    """Replace names by their display form; others stay."""
    out = col
    for raw, shown in names.items():
        out = F.when(col == raw, F.lit(shown)).otherwise(out)
    return out


def half_even(x: F.Column, digits: int) -> F.Column:
    """x, with an exact tie at ``digits`` decimals moved to the even side.

    Java formats ties upwards; printed tables elsewhere round them to even.
    """
    tie = F.abs(x * F.lit(2.0 * 10**digits)) % 2 == 1
    return F.when(tie, F.bround(x, digits)).otherwise(x)


def mean_se_text(mean: F.Column, se: F.Column, digits: int = 3) -> F.Column:
    return F.format_string(f"%.{digits}f (%.{digits}f)", half_even(mean, digits), half_even(se, digits))
