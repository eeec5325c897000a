"""Numeric coercions and small formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Normal quantile for a 95 % interval, and two-sided t quantiles for 1..20 degrees of freedom.
Z95 = 1.96
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
]


def finite(c: Column) -> Column:
    """Double, with NaN and infinities as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def whole_number(c: Column) -> Column:
    """Long for integral finite numbers, null for anything with a fraction."""
    d = finite(c)
    return F.when(d == F.floor(d), d.cast("long"))


def text_to_int(c: Column) -> Column:
    """Long from text: blanks and non-numbers are null, fractions are cut off."""
    d = finite(F.trim(c).try_cast("double"))
    return d.cast("long")


def to_percent(c: Column) -> Column:
    """Values up to 1 are read as shares and scaled, larger ones pass."""
    d = finite(c)
    return F.when(d <= 1, d * 100).otherwise(d)


def price_value(c: Column) -> Column:
    """Non-negative price, else null. Accepts text or numbers."""
    d = finite(c.try_cast("double"))
    return F.when(d >= 0, d)


def price_text(c: Column) -> Column:
    """Price written on a page: ``$1,200.5``; dashes and N/A are null."""
    t = F.trim(c)
    cleaned = F.regexp_replace(t, r"[$,]", "")
    return F.when(~t.isin("", "-", "—", "N/A", "NA"), cleaned.try_cast("double"))


def optional_rate(c: Column) -> Column:
    """Rate from provider metadata; text with an asterisk counts as unknown."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & ~F.contains(t, F.lit("*")), finite(t.try_cast("double")))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    """Bounded value; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def non_negative(c: Column) -> Column:
    """Missing and negative counts are read as zero."""
    return F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0))


def t_critical(n: Column) -> Column:
    """Two-sided 95 % t quantile for a sample of ``n``; null below two values."""
    table = F.array(*[F.lit(v) for v in T95])
    df = (n - 1).cast("int")
    inside = (df >= 1) & (df <= len(T95))
    return F.when(inside, F.get(table, F.when(inside, df - 1).otherwise(0))).when(df > len(T95), F.lit(Z95))


def wald_low(metric: Column, n: Column) -> Column:
    return F.when(metric.isNotNull() & (n > 1), F.greatest(F.lit(0.0), metric - _wald_margin(metric, n)))


def wald_high(metric: Column, n: Column) -> Column:
    return F.when(metric.isNotNull() & (n > 1), F.least(F.lit(100.0), metric + _wald_margin(metric, n)))


def _wald_margin(metric: Column, n: Column) -> Column:
    p = clamp(metric / 100, 0.0, 1.0)
    return F.sqrt(F.try_divide(p * (1 - p), n)) * (Z95 * 100)


def half_width_variance(low: Column, high: Column) -> Column:
    """Squared standard error implied by a stored interval (already clamped to 0..100)."""
    return F.pow((high - low) / 2 / Z95 / 100, F.lit(2.0))


def combined_low(mean: Column, var_sum: Column, rows: Column) -> Column:
    return F.greatest(F.lit(0.0), mean - _combined_margin(var_sum, rows))


def combined_high(mean: Column, var_sum: Column, rows: Column) -> Column:
    return F.least(F.lit(100.0), mean + _combined_margin(var_sum, rows))


def _combined_margin(var_sum: Column, rows: Column) -> Column:
    return F.try_divide(F.sqrt(var_sum), rows) * (Z95 * 100)


def symlog(x: Column, constant: Column) -> Column:
    c = F.greatest(constant, F.lit(1e-9))
    v = F.coalesce(finite(x), F.lit(0.0))
    return F.signum(v) * F.log1p(F.abs(v) / c)


def symlog_inverse(x: Column, constant: Column) -> Column:
    c = F.greatest(constant, F.lit(1e-9))
    v = F.coalesce(finite(x), F.lit(0.0))
    return F.signum(v) * c * F.expm1(F.abs(v))


def symlog_constant(quartile: Column) -> Column:
    """Half the lower quartile of the positive values, kept within 0.01..0.5; 0.1 where there are none."""
    return F.coalesce(clamp(quartile / 2, 0.01, 0.5), F.lit(0.1))


def profile_ratio(value: Column, axis_max: Column, metric: str, contrast: bool = False) -> Column:
    """Position of a value on its profile axis, 0..1."""
    from ratewise.operators.leaderboard import LOWER_IS_BETTER

    missing = 1.0 if metric in LOWER_IS_BETTER else 0.0
    v = finite(value)
    if metric == "cohen_kappa":
        ratio = (clamp(v, -1.0, 1.0) + 1) / 2
    else:
        top = F.greatest(F.lit(1.0), non_negative(axis_max))
        # greatest and least skip nulls, so a missing value is kept out of them.
        ratio = F.when(v.isNotNull(), clamp(F.least(top, F.greatest(v, F.lit(0.0))) / top, 0.0, 1.0))
    if contrast:
        ratio = F.pow(ratio, F.lit(2.5))
    return F.coalesce(ratio, F.lit(missing))


def effective_limit(base: float, per_retry: float, attempt: Column, truncate: bool = False) -> Column:
    """Distance limit that starts to widen on the third attempt; a base of 0 means no limit."""
    if base <= 0:
        return F.lit(0.0)
    index = F.greatest(F.coalesce(attempt.try_cast("int"), F.lit(1)), F.lit(1))
    limit = F.lit(float(base)) + F.lit(max(0.0, float(per_retry))) * F.greatest(index - 2, F.lit(0))
    return F.floor(limit).cast("double") if truncate else limit


def estimated_tokens(chars: Column, chars_per_token: float) -> Column:
    n = F.greatest(chars, F.lit(1))
    return F.greatest(F.lit(1), round_half_up(n / F.lit(float(chars_per_token)))).cast("long")
