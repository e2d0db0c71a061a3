"""Column functions: all of them built-in expressions, so that they stay inside generated code."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldspark.config import MAD_TO_SIGMA

ColumnLike = Column | str


def _col(c: ColumnLike | float) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def normalise_text(value: ColumnLike) -> Column:
    """Upper case with single spaces; empty text becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.upper(_col(value)), r"\s+", " ")), F.lit(""))


def empty_to_null(value: ColumnLike) -> Column:
    return F.nullif(_col(value), F.lit(""))


def nan_to_null(value: ColumnLike) -> Column:
    return F.when(~F.isnan(_col(value)), _col(value))


def is_finite(value: ColumnLike) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    v = _col(value)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def quotient(a: ColumnLike | float, b: ColumnLike | float) -> Column:
    """a / b in floating point, where a zero below gives an infinity with the sign of a, or NaN, and is no error."""
    x, y = _col(a).cast("double"), _col(b).cast("double")
    return F.when(y == 0, x * float("inf")).otherwise(x / F.nullif(y, F.lit(0.0)))


def quality_ok(quality: ColumnLike, mask: int) -> Column:
    return _col(quality).bitwiseAND(F.lit(mask)) == 0


def phase_fold(time: ColumnLike, period: ColumnLike | float, epoch: ColumnLike | float) -> Column:
    """Time since the nearest epoch, in [-period/2, period/2); a period that isn't positive is an error."""
    t, p, t0 = _col(time), _col(period), _col(epoch)
    good = F.when(p > 0, p).when(p.isNotNull(), F.raise_error(F.lit("period must be positive")).cast("double"))
    return F.pmod(t - t0 + good / 2, good) - good / 2


def in_transit(time: ColumnLike, period: ColumnLike | float, epoch: ColumnLike | float, duration_hours: ColumnLike | float, factor: float = 1.5) -> Column:
    """Whether a time lies strictly within factor/2 durations of an epoch."""
    return F.abs(phase_fold(time, period, epoch)) < 0.5 * factor * _col(duration_hours) / 24.0


def ephemeris(period: ColumnLike = "koi_period", epoch: ColumnLike = "koi_time0bk", duration: ColumnLike = "koi_duration") -> Column:
    """struct(period_days, epoch_bkjd, duration_hours), null without a positive period and an epoch; NaN counts as null."""
    p, t0, d = (nan_to_null(c) for c in (period, epoch, duration))
    return F.when((p > 0) & t0.isNotNull(), F.struct(p.alias("period_days"), t0.alias("epoch_bkjd"), d.alias("duration_hours")))


def in_any_transit(time: ColumnLike, ephemerides: ColumnLike, factor: float) -> Column:
    """Whether a time is in transit of any of an array of ephemerides; those without a duration are passed over."""
    hit = lambda e: F.coalesce(in_transit(time, e["period_days"], e["epoch_bkjd"], e["duration_hours"], factor), F.lit(False))
    return F.coalesce(F.exists(_col(ephemerides), hit), F.lit(False))


def trapezoid(time: ColumnLike, period, epoch, duration_hours, depth, ingress_fraction: float = 0.1) -> Column:
    """Relative flux of a symmetric trapezoid dip with a flat bottom at 1 - depth."""
    half = 0.5 * _col(duration_hours) / 24.0
    reach = (half - F.abs(phase_fold(time, period, epoch))) / (ingress_fraction * 2 * half)
    return 1.0 - _col(depth) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), reach))


def target_id(text: ColumnLike) -> Column:
    """The number in a target's name such as ``KIC 010811496``; null where the text is no such name."""
    digits = F.regexp_extract(F.trim(_col(text)), r"(?i)^(?:kic[\s_-]?)?0*(\d{1,9})$", 1)
    return F.try_to_number(F.nullif(digits, F.lit("")), F.lit("999999999")).cast("long")


def target_dirname(kepid: ColumnLike) -> Column:
    """``kic_`` and nine digits; a negative id is an error."""
    k = _col(kepid)
    name = F.format_string("kic_%09d", k)
    return F.when(k >= 0, name).when(k.isNotNull(), F.raise_error(F.lit("target ids can't be negative")))


def star_pool(stratum: ColumnLike) -> Column:
    """The pool that stars are drawn from; null for stars without a labelled signal."""
    s = _col(stratum)
    return F.when(s == "neg_only", "negative_only").when(s.isin("pos_only", "mixed"), "has_positive")


def robust_std(value: ColumnLike) -> Column:
    """Aggregate: 1.4826 times the median absolute deviation of the finite values; null without any.

    The values of a group are gathered once, as a median of deviations from a median can't be built up in parts. For
    groups of unbounded size use ``operators.statistics.robust_std``, which aggregates twice.
    """
    kept = F.filter(F.collect_list(_col(value)), lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    middle = median_of(kept)
    return F.transform(F.array(kept), lambda a: MAD_TO_SIGMA * median_of(F.transform(a, lambda v: F.abs(v - middle))))[0]


def median_of(values: Column) -> Column:
    """The median of an array without nulls; null for an empty one."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.get(ordered, F.floor((n - 1) / 2).cast("int")), F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def fractions(max_harmonic: int = 4) -> list[tuple[int, int]]:
    """Reduced fractions n/m with n, m up to ``max_harmonic``, the simplest first."""
    found = [(n, m) for n in range(1, max_harmonic + 1) for m in range(1, max_harmonic + 1) if gcd(n, m) == 1]
    return sorted(found, key=lambda f: (f[0] * f[1], f))


def relate_periods(found: ColumnLike, known: ColumnLike, rel_tol: float = 1e-3, max_harmonic: int = 4) -> Column:
    """struct(ratio, relation, harmonic, relative_error): the simplest fraction that the periods' ratio matches."""
    a, b = _col(found), _col(known)
    ratio = F.when((a > 0) & (b > 0), a / b).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("periods must be positive")).cast("double"))

    def as_struct(relation: str, harmonic: str | None, error: Column) -> Column:
        return F.struct(
            ratio.alias("ratio"), F.lit(relation).alias("relation"), F.lit(harmonic).cast("string").alias("harmonic"), error.alias("relative_error")
        )

    out = None
    for n, m in fractions(max_harmonic):
        error = F.abs(ratio - n / m) / (n / m)
        made = as_struct("match" if n == m else "harmonic", f"{n}/{m}", error)
        out = F.when(error <= rel_tol, made) if out is None else out.when(error <= rel_tol, made)
    return out.when(ratio.isNotNull(), as_struct("none", None, F.abs(ratio - 1.0)))


def bin_index(x: ColumnLike, lo: ColumnLike | float, hi: ColumnLike | float, n_bins: int) -> Column:
    """Number of the uniform bin that holds x, the upper edge inclusive; null outside [lo, hi].

    The quotient may land one bin beside the edge that is computed as lo + k * step, so both edges are checked again.
    """
    v, a, b = _col(x), _col(lo).cast("double"), _col(hi).cast("double")
    step = (b - a) / n_bins
    guess = F.floor((v - a) / step)
    guess = F.when(v < a + guess * step, guess - 1).when(v >= a + (guess + 1) * step, guess + 1).otherwise(guess)
    return F.when((v >= a) & (v <= b), F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), guess)).cast("int"))


def bin_centre(index: ColumnLike, lo: ColumnLike | float, hi: ColumnLike | float, n_bins: int) -> Column:
    a, b = _col(lo).cast("double"), _col(hi).cast("double")
    step = (b - a) / n_bins
    return 0.5 * ((a + _col(index) * step) + (a + (_col(index) + 1) * step))
