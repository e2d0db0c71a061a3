"""Cleaning, normalising, segmenting and detrending light curves in long form.

Every step needs a source's samples together and in order, so plans repartition by ``kepid`` once; windows by (kepid),
(kepid, quarter) and (kepid, segment) then all reuse that layout. A source's samples are bounded by its observing
time (about 70,000 half-hour cadences in four years), whatever the number of sources.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.config import MAD_TO_SIGMA, QUALITY_BITMASK
from foldspark.functions import in_any_transit, is_finite, nan_to_null, quality_ok, quotient
from foldspark.operators.spline import running_median, segment_kernel, spline_trend_kernel


def clean(curve: DataFrame, mask: int = QUALITY_BITMASK) -> DataFrame:
    """Samples whose time, flux and error are finite and whose quality has no bit of the mask."""
    return curve.filter(is_finite("time") & is_finite("flux") & is_finite("flux_err") & quality_ok("quality", mask))


def clean_stats(curve: DataFrame, mask: int = QUALITY_BITMASK, by: str = "kepid") -> DataFrame:
    """Samples by what became of them; one that isn't finite counts as that alone."""
    finite = is_finite("time") & is_finite("flux") & is_finite("flux_err")
    good = F.coalesce(quality_ok("quality", mask), F.lit(False))
    return curve.groupBy(by).agg(
        F.count("*").alias("input"), F.count_if(~finite).alias("non_finite"), F.count_if(finite & ~good).alias("quality_flagged"), F.count_if(finite & good).alias("kept")
    )


def by_source(curve: DataFrame) -> DataFrame:
    """The one shuffle of a plan: all later windows are by source."""
    return curve.repartition("kepid")


NOT_POSITIVE = "a quarter's median flux is not positive"


def normalize_per_quarter(curve: DataFrame, problem: str | None = None, any_median: bool = False) -> DataFrame:
    """Flux and error over the median flux of their source and quarter, kept as ``median_flux``.

    A median that isn't positive can't be divided by. It is an error, or, where a column ``problem`` is named, that
    column holds the message on all of the source's samples, and the quarter's flux is null. With ``any_median`` the
    quotients are those of floating point, infinite or NaN over a zero.
    """
    median = F.median("flux").over(Window.partitionBy("kepid", "quarter"))
    if any_median:
        curve = curve.withColumn("median_flux", median)
        return curve.withColumn("flux", quotient("flux", "median_flux")).withColumn("flux_err", quotient("flux_err", "median_flux"))
    if problem is None:
        sure = F.when(median > 0, median).otherwise(F.raise_error(F.lit(NOT_POSITIVE)).cast("double"))
    else:
        curve = curve.withColumn("_median", median)
        sure = F.when(F.col("_median") > 0, F.col("_median"))
        wrong = F.max(F.when(F.col("_median").isNull() | (F.col("_median") <= 0), NOT_POSITIVE)).over(Window.partitionBy("kepid"))
        curve = curve.withColumn(problem, wrong)
    return (
        curve.withColumn("median_flux", sure).drop("_median").withColumn("flux", F.col("flux") / F.col("median_flux")).withColumn("flux_err", F.col("flux_err") / F.col("median_flux"))
    )


def segments(curve: DataFrame, gap_days: float = 0.5, tie: str | None = None) -> DataFrame:
    """curve with ``segment``: it rises by one after each gap of more than ``gap_days``."""
    order = Window.partitionBy("kepid").orderBy("time", *([tie] if tie else []))
    gap = F.coalesce(F.col("time") - F.lag("time").over(order) > gap_days, F.lit(False)).cast("int")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(upto).cast("int")).drop("_gap")


def running_median_trend(curve: DataFrame, window_days: float = 1.5, min_points: int = 10, usable: Column | None = None, value: str = "flux", into: str = "trend", problem: str | None = None) -> DataFrame:
    """curve (with segments) with a trend: the median of usable values within half a window, both ends included.

    Where fewer than ``min_points`` are usable the trend is interpolated in time between estimates of the segment, or
    held beyond the first and last; a segment without any has its usable median, or else its median. A window's values
    stay in order while it slides, where a built-in percentile over a range frame sorts every window anew; a star's
    segments are one call, on the layout that the curve already has by star.
    """
    if window_days <= 0:
        raise ValueError("window_days must be positive")
    seen = F.col(value).isNotNull() if usable is None else F.coalesce(usable, F.lit(False)) & F.col(value).isNotNull()
    kernel = segment_kernel(lambda t, y, ok: running_median(t, y, window_days, min_points, ok), value, "_seen", into)
    marked = curve.withColumn("_seen", seen)
    if problem is not None:
        return by_star(marked, kernel, into, problem).drop("_seen")
    made = whole_stars(marked, kernel, into).drop("_seen")
    # NaN is a median of values with NaN; a segment without any value has no trend.
    return made.withColumn(into, F.when(F.col(value).isNull(), nan_to_null(into)).otherwise(F.col(into)))


def interpolate(df: DataFrame, at: str, value: str, part, into: str) -> DataFrame:
    """df with null values interpolated linearly between their neighbours in a partition, and held at its ends."""
    before = part.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    # Backwards, as a frame that starts at the row is summed anew for each row.
    after = part.orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    df = df.withColumn("_known", known).withColumn("_p", F.last("_known", ignorenulls=True).over(before)).withColumn("_n", F.last("_known", ignorenulls=True).over(after))
    slope = (F.col("_n.y") - F.col("_p.y")) / F.nullif(F.col("_n.x") - F.col("_p.x"), F.lit(0.0).cast("double"))
    between = F.coalesce(slope * (F.col(at) - F.col("_p.x")) + F.col("_p.y"), F.col("_p.y"), F.col("_n.y"))
    return df.withColumn(into, F.coalesce(F.col(value), between)).drop("_known", "_p", "_n")


def robust_spline_trend(curve: DataFrame, knot_spacing_days: float = 0.3, min_points: int = 10, sigma_lower: float = 3.0, sigma_upper: float = 3.0, max_iter: int = 3, usable: str | None = None, value: str = "flux", into: str = "trend", problem: str | None = None) -> DataFrame:
    """curve (with segments) with the trend of a clipped least-squares cubic spline, fitted to each segment.

    The fit is iterative, which no built-in expression can be; a star's segments are one call, on the layout that the
    curve already has by star. With a column ``problem`` a star that has one isn't fitted, and one whose fit fails gets it.
    """
    if knot_spacing_days <= 0:
        raise ValueError("knot_spacing_days must be positive")
    fit = spline_trend_kernel(knot_spacing_days, min_points, sigma_lower, sigma_upper, max_iter, value, usable, into)
    if problem is not None:
        return by_star(curve, fit, into, problem)
    return whole_stars(curve, fit, into).withColumn(into, nan_to_null(into))


def whole_stars(curve: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], into: str) -> DataFrame:
    """curve with what a kernel adds to many whole stars at once, as a call for each short star costs more than its samples.

    Rows come by star; the last star of a batch waits for the next one, so a task holds a batch and a star. Only the
    kernel sees pandas, where NaN and null are the same; the curve's own columns stay as they are.
    """

    def added(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        made = kernel(rows.to_pandas())[into].sort_index()
        yield from rows.append_column(into, pa.array(made.to_numpy(float))).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            star = pd.factorize(rows["kepid"].to_pandas())[0]
            others = np.flatnonzero(star != star[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            held = rows.slice(cut)
            if cut:
                yield from added(rows.slice(0, cut))
        if held is not None:
            yield from added(held)

    ordered = curve.repartition("kepid").sortWithinPartitions("kepid", "segment", "time")
    return ordered.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in curve.dtypes) + f", `{into}` double")


def by_star(curve: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], into: str, problem: str) -> DataFrame:
    """curve with what a kernel adds, star by star, where a star's failure is a message and not the job's.

    ``kernel`` takes and returns a star's samples, with the new column ``into``. Where it raises, or the star has a message
    in ``problem`` before, the samples stay with a null there and the first line of the error as the message.
    """
    columns = [*curve.columns, into]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = group[problem].dropna()
        if not len(known):
            try:
                return kernel(group)[columns]
            except MemoryError:
                raise
            except Exception as error:  # an outcome of this star
                message = next(iter(str(error).splitlines()), "") or type(error).__name__
        else:
            message = known.iloc[0]
        return group.assign(**{into: float("nan"), problem: message})[columns]

    made = curve.groupBy("kepid").applyInPandas(run, ", ".join(f"`{n}` {t}" for n, t in curve.dtypes) + f", `{into}` double")
    return made.withColumn(into, F.nanvl(into, F.lit(None).cast("double")))


def upper_outliers(curve: DataFrame, sigma: float = 5.0, value: str = "flux_detrended", into: str = "is_outlier") -> DataFrame:
    """curve with a mark on samples strictly above the source's median by ``sigma`` robust standard deviations.

    These are of the finite values; an infinite one stands above them, and NaN is neither in the median nor marked.
    """
    if sigma <= 0:
        raise ValueError("sigma must be positive")
    part = Window.partitionBy("kepid")
    number, finite = nan_to_null(value), F.when(is_finite(value), F.col(value))
    curve = curve.withColumn("_m", F.median(number).over(part)).withColumn("_f", F.median(finite).over(part))
    curve = curve.withColumn("_s", MAD_TO_SIGMA * F.median(F.abs(finite - F.col("_f"))).over(part))
    return curve.withColumn(into, F.coalesce(number > F.col("_m") + sigma * F.col("_s"), F.lit(False))).drop("_m", "_f", "_s")


def mask_transits(curve: DataFrame, ephemerides: DataFrame, factor: float = 2.0, into: str = "in_known_transit_mask") -> DataFrame:
    """curve with a mark on samples in transit of any of their source's signals.

    ``ephemerides`` is (kepid, ephemerides array), one row per source, so the curve keeps its rows and its layout.
    """
    joined = curve.join(ephemerides, "kepid", "left")
    return joined.withColumn(into, in_any_transit("time", "ephemerides", factor)).drop("ephemerides")


def point_to_point_sigma(curve: DataFrame, value: str = "flux", tie: str | None = None) -> DataFrame:
    """(kepid, n, sigma): noise from first differences of the finite values; null under three of them."""
    order = Window.partitionBy("kepid").orderBy("time", *([tie] if tie else []))
    steps = curve.filter(is_finite(value)).withColumn("_d", F.col(value) - F.lag(value).over(order))
    steps = steps.withColumn("_m", F.median("_d").over(Window.partitionBy("kepid")))
    mad = F.median(F.abs(F.col("_d") - F.col("_m")))
    return steps.groupBy("kepid").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, MAD_TO_SIGMA * mad / F.sqrt(F.lit(2.0))).alias("sigma"))
