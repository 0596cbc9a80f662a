"""Arithmetic shared by the operators: guarded ratios, adjusted moments, safe correlation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is no whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def score(value: Column) -> Column:
    """Clamp to 0..100 and round to two digits; NULL stays NULL."""
    return F.when(value.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)), 2))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.count_if(condition), F.lit(0).cast("long"))


def adjusted_skew(value: Column, n: Column | None = None) -> Column:
    """Bias-corrected skewness; 0 for a constant column, NULL below three values."""
    n = F.count(value) if n is None else n
    n = n.cast("double")
    factor = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(value) * factor, F.lit(0.0)))


def adjusted_kurtosis(value: Column, n: Column | None = None) -> Column:
    """Bias-corrected excess kurtosis; 0 for a constant column, NULL below four values."""
    n = F.count(value) if n is None else n
    n = n.cast("double")
    corrected = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n >= 4, F.coalesce(corrected, F.lit(0.0)))


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present.

    NULL for a constant side; the built-in ``corr`` raises there under ANSI.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))
    # greatest and least skip NULL, which must stay NULL here.
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def correlation_strength(r: Column) -> Column:
    a = F.abs(r)
    return (
        F.when(a.isNull(), "unknown")
        .when(a >= 0.80, "very strong")
        .when(a >= 0.60, "strong")
        .when(a >= 0.40, "moderate")
        .when(a >= 0.20, "weak")
        .otherwise("very weak")
    )


def correlation_direction(r: Column) -> Column:
    return (
        F.when(r.isNull(), "unknown").when(r > 0, "positive").when(r < 0, "negative").otherwise("none")
    )


def distribution_shape(skew: Column) -> Column:
    return (
        F.when(skew.isNull(), "unknown")
        .when(skew > 1, "highly right-skewed")
        .when(skew > 0.5, "moderately right-skewed")
        .when(skew < -1, "highly left-skewed")
        .when(skew < -0.5, "moderately left-skewed")
        .otherwise("approximately symmetric")
    )


def right_closed_bin(value: Column, low: float, width: float, bins: int) -> Column:
    """Index of the equal-width bin ``(left, right]``; the lowest value belongs to bin 0."""
    raw = F.ceil((value - F.lit(low)) / F.lit(width)).cast("int") - 1
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)))
