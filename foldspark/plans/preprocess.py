"""From raw samples to processed light curves, and to labelled examples of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.config import DatasetConfig, PreprocessingConfig, RepresentationConfig
from foldspark.functions import ephemeris, is_finite, quotient
from foldspark.lineage import settle
from foldspark.operators import timeseries as ts
from foldspark.operators import views
from foldspark.schemas import EXAMPLE_CATALOG_COLUMNS, PROCESSED_COLUMNS


NO_SAMPLES, ALL_EMPTY = "no light-curve samples", "all quarters were empty after cleaning"
NO_EPHEMERIS = "masking known transits needs an ephemeris"


def star_ephemerides(catalog: DataFrame) -> DataFrame:
    """(kepid, ephemerides): each star's known ephemerides in one array; a star has a handful of signals."""
    known = catalog.select("kepid", "kepoi_name", ephemeris().alias("e")).filter(F.col("e").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("kepoi_name", "e")))
    return known.groupBy("kepid").agg(F.transform(ordered, lambda s: s["e"]).alias("ephemerides"))


def preprocess(curve: DataFrame, config: PreprocessingConfig | None = None, catalog: DataFrame | None = None, tie: str | None = None, any_median: bool = False) -> DataFrame:
    """Processed curves: clean, divide by each quarter's median, detrend by segment, clip upward outliers.

    One shuffle by star serves every step. With ``mask_known_transits`` samples in any known transit of their star
    never enter the trend; the catalog gives the ephemerides. A star that can't be processed is an error here;
    ``preprocess_stars`` reports it instead, and with ``any_median`` a quarter is divided by its median whatever that is.
    """
    config = config or PreprocessingConfig()
    return _processed(curve, config, catalog, tie, None, None, any_median).select(*PROCESSED_COLUMNS)


def _processed(curve: DataFrame, config: PreprocessingConfig, catalog: DataFrame | None, tie: str | None, problem: str | None, kernel, any_median: bool = False) -> DataFrame:
    """The steps of ``preprocess``. With a column ``problem`` a star's failures stand there, and its samples stay."""
    d = config.detrend
    if d.mask_known_transits and catalog is None:
        raise ValueError("mask_known_transits needs the catalog's ephemerides")
    ready = ts.normalize_per_quarter(ts.by_source(ts.clean(curve, config.quality_bitmask)), problem, any_median)
    if d.mask_known_transits:
        known = star_ephemerides(catalog)
        if problem is not None:
            ready = ready.join(known.select("kepid", F.lit(True).alias("_known")), "kepid", "left")
            ready = ready.withColumn(problem, F.coalesce(problem, F.when(F.col("_known").isNull(), NO_EPHEMERIS))).drop("_known")
        ready = ts.mask_transits(ready, known, d.mask_duration_factor)
    else:
        ready = ready.withColumn("in_known_transit_mask", F.lit(False))
    if not d.enabled:
        ready = ready.withColumn("trend", F.lit(1.0))
    else:
        ready = ts.segments(ready, d.gap_days, tie).withColumn("_usable", ~F.col("in_known_transit_mask"))
        if kernel is not None:
            ready = ts.by_star(ready, kernel, "trend", problem)
        elif d.method == "robust_spline":
            ready = ts.robust_spline_trend(ready, d.knot_spacing_days, d.min_points, d.sigma_lower, d.sigma_upper, d.max_iter, "_usable", problem=problem)
        else:
            ready = ts.running_median_trend(ready, d.window_days, d.min_points, F.col("_usable"), problem=problem)
    ready = ready.withColumn("flux_detrended", quotient("flux", "trend")).withColumn("flux_err_detrended", quotient("flux_err", "trend"))
    if config.clip_upper_sigma is not None:
        ready = ts.upper_outliers(ready, config.clip_upper_sigma).filter(~F.col("is_outlier"))
    names = {"time": "time_bkjd", "flux": "flux_norm", "flux_err": "flux_err_norm"}
    return ready.withColumnsRenamed(names).withColumn("quarter", F.col("quarter").cast("smallint"))


def preprocess_stars(curve: DataFrame, stars: DataFrame, config: PreprocessingConfig | None = None, catalog: DataFrame | None = None, tie: str | None = None, kernel=None) -> tuple[DataFrame, DataFrame]:
    """(processed curves, log): every star of ``stars`` is processed or reported, and none of them fails the job.

    The log is (kepid, status, message): ``ok``, ``no_lightcurve``, or ``preprocessing_failed`` with what the star's
    cleaning, normalising, masking or detrending raised. Curves of failed stars are left out. All steps run once, in one
    pass over the samples, whose result is settled; the log is an aggregate of it. ``kernel`` detrends a star's samples
    in place of the configured method: it takes them as a pandas frame with flux, time, segment and _usable and adds
    ``trend``.
    """
    config = config or PreprocessingConfig()
    wanted = stars.select("kepid").distinct()
    raw = curve.join(wanted, "kepid", "left_semi")
    made = settle(_processed(raw, config, catalog, tie, "_problem", kernel).select(*PROCESSED_COLUMNS, "_problem"))
    after = made.groupBy("kepid").agg(F.max("_problem").alias("_problem"), F.lit(True).alias("_clean"))
    seen = wanted.join(raw.groupBy("kepid").agg(F.lit(True).alias("_raw")), "kepid", "left").join(after, "kepid", "left")
    message = F.when(F.col("_raw").isNull(), NO_SAMPLES).when(F.col("_clean").isNull(), ALL_EMPTY).otherwise(F.coalesce("_problem", F.lit("")))
    status = F.when(F.col("_raw").isNull(), "no_lightcurve").when(F.col("_clean").isNull() | F.col("_problem").isNotNull(), "preprocessing_failed").otherwise("ok")
    return made.filter(F.col("_problem").isNull()).drop("_problem"), seen.select("kepid", status.alias("status"), message.alias("message"))


def signals_of(catalog: DataFrame) -> DataFrame:
    """Each signal with (period, epoch, duration_hours, depth) and an array of its star's other signals' ephemerides."""
    eph = catalog.withColumn("_e", ephemeris()).withColumn("_d", F.when(is_finite("koi_depth"), F.col("koi_depth")))
    one = F.struct("kepoi_name", F.col("_e.period_days"), F.col("_e.epoch_bkjd"), F.col("_e.duration_hours"), F.col("_d").alias("depth"))
    # A star has a handful of signals; the list is made per star and never per sample.
    every = F.collect_list(F.when(F.col("_e").isNotNull(), one)).over(Window.partitionBy("kepid"))
    return (
        eph.withColumn("siblings", F.filter(every, lambda s: s["kepoi_name"] != F.col("kepoi_name")))
        .withColumns({"period": F.col("_e.period_days"), "epoch": F.col("_e.epoch_bkjd"), "duration_hours": F.col("_e.duration_hours"), "depth": F.col("_d")})
        .withColumn("n_kois_on_star", F.count("*").over(Window.partitionBy("kepid")))
        .drop("_e", "_d")
    )


def example_status(r: RepresentationConfig) -> F.Column:
    """The first reason why an example can't be used, or ``ok``."""
    return (
        F.when(F.col("period").isNull() | F.col("duration_hours").isNull(), "missing_ephemeris")
        .when(F.coalesce("n_points", F.lit(0)) < r.min_valid_points, "insufficient_points")
        .when(F.col("mask_window_days") > r.max_mask_window_days, "detrend_mask_too_long")
        .when(F.coalesce("global_coverage", F.lit(0.0)) < r.min_global_coverage, "insufficient_global_coverage")
        .when(F.coalesce("transit_coverage", F.lit(0.0)) < r.min_transit_coverage, "insufficient_transit_coverage")
        .otherwise("ok")
    )


def star_diagnostics(processed: DataFrame) -> DataFrame:
    """(kepid, n_points, n_quarters, star_mask_fraction, star_trend_rms_ppm) of processed curves."""
    return processed.groupBy("kepid").agg(
        F.count("*").alias("n_points"), F.count_distinct("quarter").alias("n_quarters"),
        F.avg(F.col("in_known_transit_mask").cast("double")).alias("star_mask_fraction"), (F.stddev_pop("trend") * 1e6).alias("star_trend_rms_ppm"),
    )


def build_examples(processed: DataFrame, labelled: DataFrame, stars: DataFrame, config: DatasetConfig | None = None) -> DataFrame:
    """One row per signal of the chosen ``stars`` (kepid, split): catalog columns, diagnostics, status and view arrays.

    ``labelled`` is the catalog after the label policy. Samples meet their star's signals in one join by star, which
    the processed curves' layout serves; the views are aggregations by signal and bin, all of the same folded samples,
    which are settled in the shared checkpoint folder. Signals without samples or without an
    ephemeris keep their row.
    """
    config = config or DatasetConfig()
    r = config.representation
    for name in EXAMPLE_CATALOG_COLUMNS:
        labelled = labelled if name in labelled.columns else labelled.withColumn(name, F.lit(None).cast("double"))
    signals = settle(signals_of(labelled.join(stars.select("kepid", "split"), "kepid")).drop("siblings"))
    usable = signals.filter(F.col("period").isNotNull() & (F.col("duration_hours") > 0))
    diagnostics = settle(star_diagnostics(processed))
    enough = diagnostics.filter(F.col("n_points") >= r.min_valid_points).select("kepid")
    samples = processed.select("kepid", F.col("time_bkjd").alias("time"), F.col("flux_detrended").alias("flux"))
    keys = ["kepoi_name"]
    own = usable.join(enough, "kepid", "left_semi").select("kepid", *keys, "period", "epoch", "duration_hours", "depth")
    folded = settle(own.join(samples, "kepid"))
    wide = views.as_arrays(views.global_view(folded, keys, r.global_bins), keys, r.global_bins, "global")
    near = views.as_arrays(views.local_view(folded, keys, r.local_bins, r.local_half_width_durations, r.local_bin_width_durations), keys, r.local_bins, "local")
    rows = signals.join(diagnostics, "kepid", "left")
    for part in (wide, near, views.transits_observed(folded, keys), views.contamination(samples, own)):
        rows = rows.join(part, keys, "left")
    rows = rows.withColumns({
        "global_coverage": views.coverage(F.col("global_count")),
        "local_coverage": views.coverage(F.col("local_count")),
        "transit_coverage": views.transit_coverage(F.col("global_count"), F.col("period"), F.col("duration_hours"), r.global_bins),
        "bins_across_transit": r.global_bins * F.col("duration_hours") / 24.0 / F.col("period"),
        "mask_window_days": config.preprocessing.detrend.mask_duration_factor * F.col("duration_hours") / 24.0,
    })
    rows = rows.withColumn("example_status", example_status(r))
    empty = lambda name, n, kind: F.coalesce(name, F.array_repeat(F.lit(float("nan") if kind == "float" else 0).cast(kind), n)).alias(name)
    return rows.select(
        *EXAMPLE_CATALOG_COLUMNS, "split", "n_kois_on_star", "n_points", "n_quarters", "star_mask_fraction", "star_trend_rms_ppm", "global_coverage", "transit_coverage",
        "local_coverage", "bins_across_transit", "n_transits_observed", "mask_window_days", "contam_max_bin_fraction", "contam_max_expected_ppm",
        "contam_in_transit_expected_ppm", "contam_max_relative_to_depth", "example_status", empty("global_flux", r.global_bins, "float"),
        empty("global_count", r.global_bins, "int"), empty("local_flux", r.local_bins, "float"), empty("local_count", r.local_bins, "int"),
    )
