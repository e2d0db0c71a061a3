"""Binned and folded views of light curves, their coverage, and contamination by a source's other signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions import bin_centre, bin_index, in_transit, is_finite, phase_fold


def bin_curve(df: DataFrame, keys: list[str], x: str, y: str, lo: float, hi: float, n_bins: int, statistic: str = "median", groups: DataFrame | None = None) -> DataFrame:
    """(keys, bin, centre, value, count): every bin of a uniform grid for each key, its value null where it is empty.

    Only samples with lo <= x <= hi and a finite y count. The rows of empty bins come from ``groups``, the distinct keys;
    where these aren't known they are gathered from the samples, which makes the samples anew.
    """
    if n_bins < 1 or not hi > lo or statistic not in ("median", "mean"):
        raise ValueError("bin_curve needs n_bins >= 1, lo < hi and the statistic median or mean")
    value = F.median(y) if statistic == "median" else F.avg(y)
    kept = df.filter(is_finite(y)).withColumn("bin", bin_index(x, lo, hi, n_bins)).filter(F.col("bin").isNotNull())
    made = kept.groupBy(*keys, "bin").agg(value.alias("value"), F.count("*").alias("count"))
    return all_bins(df.select(*keys).distinct() if groups is None else groups, made, keys, n_bins).withColumn("centre", bin_centre("bin", lo, hi, n_bins)).select(*keys, "bin", "centre", "value", "count")


def all_bins(groups: DataFrame, made: DataFrame, keys: list[str], n_bins: int) -> DataFrame:
    """made with a row for every bin of every group; missing ones have a null value and count 0."""
    grid = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(made, [*keys, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def windowed_median(df: DataFrame, keys: list[str], x: str, y: str, first: float, spacing: float, n_bins: int, width: float) -> DataFrame:
    """(keys, bin, value, count): median of y in [centre - width/2, centre + width/2) around each centre, where any.

    A sample is dealt to the few bins whose window may hold it, then the exact bounds decide, so the range join becomes
    a grouping: at most width / spacing + 3 rows a sample.
    """
    half = 0.5 * width
    lowest = F.floor((F.col(x) - half - first) / spacing).cast("int") - 1
    highest = F.ceil((F.col(x) + half - first) / spacing).cast("int") + 1
    low, high = F.greatest(lowest, F.lit(0)), F.least(highest, F.lit(n_bins - 1))
    # Only what is grouped goes on, whatever else the rows carry.
    dealt = df.select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), low.alias("_lo"), high.alias("_hi")).filter("_lo <= _hi")
    dealt = dealt.withColumn("bin", F.explode(F.sequence("_lo", "_hi"))).withColumn("_c", first + F.col("bin") * F.lit(spacing))
    inside = dealt.filter((F.col("_x") >= F.col("_c") - half) & (F.col("_x") < F.col("_c") + half))
    return inside.groupBy(*keys, "bin").agg(F.median("_y").alias("value"), F.count("*").alias("count"))


def global_view(df: DataFrame, keys: list[str], n_bins: int, time: str = "time", flux: str = "flux") -> DataFrame:
    """windowed_median over the whole phase [-0.5, 0.5) of each row's ephemeris (period, epoch), of flux - 1."""
    width = 1.0 / n_bins
    folded = df.withColumn("_phase", phase_fold(time, "period", "epoch") / F.col("period")).withColumn("_depth", F.col(flux) - 1.0)
    return windowed_median(folded, keys, "_phase", "_depth", -0.5 + 0.5 * width, width, n_bins, width)


def local_view(df: DataFrame, keys: list[str], n_bins: int, half_width: float, bin_width: float, time: str = "time", flux: str = "flux") -> DataFrame:
    """windowed_median around mid-transit, in transit durations; rows need a positive ``duration_hours``."""
    folded = df.withColumn("_x", phase_fold(time, "period", "epoch") * 24.0 / F.col("duration_hours")).withColumn("_depth", F.col(flux) - 1.0)
    return windowed_median(folded.filter(F.col("duration_hours") > 0), keys, "_x", "_depth", -half_width, 2.0 * half_width / (n_bins - 1), n_bins, bin_width)


def as_arrays(view: DataFrame, keys: list[str], n_bins: int, prefix: str) -> DataFrame:
    """One row per key: ``<prefix>_flux array<float>`` (NaN where empty) and ``<prefix>_count array<int>``."""
    packed = view.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("value", "count")))).alias("_bins"))
    each = lambda of: F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda b: of(F.try_element_at("_bins", b)))
    flux = each(lambda v: F.coalesce(v["value"], F.lit(float("nan"))).cast("float"))
    count = each(lambda v: F.coalesce(v["count"], F.lit(0)).cast("int"))
    return packed.select(*keys, flux.alias(f"{prefix}_flux"), count.alias(f"{prefix}_count"))


def coverage(counts: Column) -> Column:
    """Share of a view's bins that hold samples."""
    return F.size(F.filter(counts, lambda c: c > 0)) / F.size(counts)


def transit_coverage(counts: Column, period: Column, duration_hours: Column, n_bins: int) -> Column:
    """Share of the global bins inside the transit that hold samples; for a narrow transit, of the bin or two nearest."""
    half = 0.5 * duration_hours / 24.0 / period
    away = F.transform(counts, lambda c, i: F.struct(F.abs(F.lit(-0.5) + (i + 0.5) * F.lit(1.0 / n_bins)).alias("away"), (c > 0).alias("hit")))
    nearest = F.array_min(F.transform(away, lambda b: b["away"]))
    strict = F.filter(away, lambda b: b["away"] < half)
    inside = F.when(F.size(strict) > 0, strict).otherwise(F.filter(away, lambda b: b["away"] == nearest))
    return F.size(F.filter(inside, lambda b: b["hit"])) / F.size(inside)


def transits_observed(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """(keys, n_transits_observed): distinct transits with a sample within half a duration."""
    inside = F.coalesce(in_transit(time, "period", "epoch", "duration_hours", 1.0), F.lit(False))
    number = F.rint((F.col(time) - F.col("epoch")) / F.col("period"))
    return df.groupBy(*keys).agg(F.count_distinct(F.when(inside, number)).alias("n_transits_observed"))


def contamination(samples: DataFrame, signals: DataFrame, time: str = "time") -> DataFrame:
    """(kepoi_name, ...) how much of a star's other signals survives folding on each of its signals' ephemerides.

    ``samples`` is (kepid, time), ``signals`` (kepid, kepoi_name, period, epoch, duration_hours, depth); those without a
    period are left out, and so are signals of stars without samples. The phase has bins of half a duration; in each, the
    share of samples inside any other transit, and the mean dip that the others' depths would make there. The maxima over
    bins come back, that dip also within the own transit and relative to the own depth. Without a duration, or others with
    one, all are zero.

    A sample meets its star's signals once, as one array; those that it is inside of, mostly none or one, are listed. For a
    signal that isn't among them its others are the whole list, whose sum is at hand, else the list without it. So a star
    of k signals costs k steps a sample, and a row a signal holds a bin and two numbers.
    """
    known = signals.filter(F.col("period").isNotNull())
    one = F.struct("kepoi_name", "period", "epoch", "duration_hours", F.when(is_finite("depth"), F.col("depth")).alias("depth"))
    with_duration = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("duration_hours") != 0, F.lit(False)), one)))
    listed = known.groupBy("kepid").agg(with_duration.alias("_all")).filter(F.size("_all") > 1)
    met = samples.select("kepid", time).join(listed, "kepid")
    hit = lambda s: in_transit(time, s["period"], s["epoch"], s["duration_hours"], 1.0)
    marked = F.transform("_all", lambda s, i: F.when(hit(s), F.struct(i.alias("i"), F.coalesce(s["depth"], F.lit(0.0)).alias("depth"))))
    deep = lambda hits: F.aggregate(hits, F.lit(0.0), lambda total, h: total + h["depth"])
    met = met.withColumn("_hits", F.array_compact(marked)).withColumn("_depth", deep("_hits"))
    others = lambda i: F.filter("_hits", lambda h: h["i"] != i)
    inside = lambda i: F.exists("_hits", lambda h: h["i"] == i)
    n_bins = lambda s: F.greatest(F.lit(8), F.least(F.lit(4096), F.ceil(2 * s["period"] * 24.0 / s["duration_hours"]).cast("int")))
    place = lambda s: F.greatest(F.lit(0), F.least(n_bins(s) - 1, F.floor((phase_fold(time, s["period"], s["epoch"]) / s["period"] + 0.5) * n_bins(s)).cast("int")))
    each = F.transform("_all", lambda s, i: F.struct(
        s["kepoi_name"].alias("kepoi_name"), n_bins(s).alias("_n"), s["period"].alias("period"), s["duration_hours"].alias("duration_hours"), place(s).alias("_bin"),
        F.exists("_hits", lambda h: h["i"] != i).cast("double").alias("_any"), F.when(inside(i), deep(others(i))).otherwise(F.col("_depth")).alias("_dip"),
    ))
    bins = met.select(F.inline(each)).groupBy("kepoi_name", "_n", "period", "duration_hours", "_bin").agg(F.avg("_any").alias("_any"), F.avg("_dip").alias("_dip"))
    centre = F.lit(-0.5) + (F.col("_bin") + 0.5) / F.col("_n")
    own = F.abs(centre) < 0.5 * F.col("duration_hours") / 24.0 / F.col("period") + 0.5 / F.col("_n")
    top = bins.groupBy("kepoi_name").agg(F.max("_any").alias("_any"), F.max("_dip").alias("_max"), F.max(F.when(own, F.col("_dip"))).alias("_own"))
    found = known.join(samples.select("kepid").distinct(), "kepid", "left_semi").select("kepoi_name", "depth").join(top, "kepoi_name", "left")
    relative = F.when(F.col("_max").isNull(), 0.0).when(is_finite("depth") & (F.col("depth") > 0), F.col("_max") / F.col("depth"))
    return found.select(
        "kepoi_name",
        F.coalesce("_any", F.lit(0.0)).alias("contam_max_bin_fraction"),
        F.coalesce("_max", F.lit(0.0)).alias("contam_max_expected_ppm"),
        F.coalesce("_own", F.lit(0.0)).alias("contam_in_transit_expected_ppm"),
        relative.alias("contam_max_relative_to_depth"),
    )


def folded_depth(df: DataFrame, keys: list[str], time: str = "time", flux: str = "flux") -> DataFrame:
    """(keys, depth_ppm): median flux of the annulus 1 < x < 3 less the mean of x < 0.25, x in half durations from mid-transit.

    Null under 10 annulus samples or 3 inside.
    """
    x = F.abs(phase_fold(time, "period", "epoch")) * 24.0 / F.col("duration_hours")
    rows = df.withColumn("_x", x)
    around = F.when((F.col("_x") > 1) & (F.col("_x") < 3), F.col(flux))
    inside = F.when(F.col("_x") < 0.25, F.col(flux))
    depth = (F.median(around) - F.avg(inside)) * 1e6
    return rows.groupBy(*keys).agg(F.when((F.count(inside) >= 3) & (F.count(around) >= 10), depth).alias("depth_ppm"))
