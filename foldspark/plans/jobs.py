"""Whole jobs: catalog, splits, dataset, period search and report, each a function over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.config import DatasetConfig, NoiseConfig, SearchConfig, SplitConfig
from foldspark.functions import relate_periods
from foldspark.lineage import settle
from foldspark.operators import labels, perturb, search, selection, splits, statistics
from foldspark.operators.ranking import running_sums, value_at
from foldspark.plans import preprocess as prep


def label_catalog(catalog: DataFrame, on_unexpected: str = "raise") -> DataFrame:
    return labels.apply_label_policy(catalog, on_unexpected)


def create_splits(catalog: DataFrame, config: SplitConfig | None = None, order: str = "md5") -> DataFrame:
    """The split manifest of a catalog, checked for leakage."""
    manifest = splits.build_split_manifest(labels.apply_label_policy(catalog), config, order)
    splits.check_no_leakage(manifest)
    return manifest


def agree(labelled: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: signals that only one side has, and labels that differ; all zero where catalog and manifest agree."""
    a = labelled.select("kepoi_name", F.col("label").alias("a"), F.lit(True).alias("in_a"))
    b = manifest.select("kepoi_name", F.col("label").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, "kepoi_name", "full")
    return both.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_in_catalog"), F.count_if(F.col("in_a").isNull()).alias("only_in_manifest"),
        F.count_if(F.col("in_a") & F.col("in_b") & ~F.col("a").eqNullSafe(F.col("b"))).alias("different_labels"),
    )


def build_dataset(curve: DataFrame, catalog: DataFrame, manifest: DataFrame, config: DatasetConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples, star log): choose stars, process those that can be, fold every signal of theirs.

    Labels, the manifest, the chosen stars and the processed curves feed several steps, so each is settled once in the
    shared checkpoint folder.
    """
    config = config or DatasetConfig()
    labelled, manifest = settle(labels.apply_label_policy(catalog)), settle(manifest)
    problems = agree(labelled, manifest).first().asDict()
    if any(problems.values()):
        raise ValueError(f"catalog and manifest differ: {problems}")
    stars = selection.select_stars(manifest, config.stars, config.splits)
    if config.max_stars is not None and not config.stars.all_eligible:
        selection.guard_size(stars, config.max_stars, "stars")
    stars = settle(stars)
    raw = curve.join(stars.select("kepid"), "kepid", "left_semi")
    processed, log = prep.preprocess_stars(raw, stars, config.preprocessing, labelled)
    log = settle(log)
    ready = log.filter("status = 'ok'").select("kepid")
    return prep.build_examples(processed, labelled, stars.join(ready, "kepid", "left_semi"), config), log


def run_search(processed: DataFrame, catalog: DataFrame, config: SearchConfig | None = None, noise: NoiseConfig | None = None) -> DataFrame:
    """One row per star and severity: status, the best box with its diagnostics, top peaks, and how its period relates
    to the star's known ones.

    All stars, severities and chunks of periods are tasks of one job.
    """
    config, noise = config or SearchConfig(), noise or NoiseConfig(severities=(0.0,))
    curve = processed.select("kepid", F.col("time_bkjd").alias("time"), F.col("flux_detrended").alias("flux"), F.col("flux_err_detrended").alias("flux_err"))
    runs = None
    for severity in noise.severities:
        made = perturb.gaussian_noise(curve, severity, noise.seed).withColumn("severity", F.lit(float(severity)))
        runs = made if runs is None else runs.unionByName(made)
    keys = ["kepid", "severity"]
    inputs = settle(search.search_inputs(runs, keys, config))
    # The grid's powers cost the most by far and are read three times.
    found = settle(search.periodogram(inputs, keys, config))
    best = search.best_peaks(found, keys)
    stats = search.box_stats(runs, best, keys)
    rows = inputs.select(*keys, "status", "n_points", F.col("baseline").alias("baseline_days")).join(best, keys, "left").join(stats, keys, "left")
    rows = rows.join(search.top_peaks(found, keys), keys, "left").withColumn("objective", F.lit(config.objective))
    return rows.join(compare_with_catalog(best, catalog, keys), keys, "left")


def compare_with_catalog(best: DataFrame, catalog: DataFrame, keys: list[str], **options) -> DataFrame:
    """(keys, comparisons, closest): every known period of the star against the found one, and the nearest of them."""
    known = catalog.filter(F.col("koi_period") > 0).select("kepid", "kepoi_name", "koi_period")
    compared = best.select(*keys, F.col("period").alias("found")).join(known, "kepid").withColumn("c", relate_periods("found", "koi_period", **options))
    one = F.struct(F.col("c.relative_error").alias("relative_error"), "kepoi_name", "koi_period", F.col("c.ratio").alias("ratio"), F.col("c.relation").alias("relation"), F.col("c.harmonic").alias("harmonic"))
    return compared.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("comparisons")).withColumn("closest", F.get("comparisons", 0))


def dataset_report(examples: DataFrame) -> dict[str, DataFrame]:
    """The tables of a dataset's report by name."""
    labelled = examples.filter(F.col("label").isNotNull())
    ok = examples.filter("example_status = 'ok'")
    flags = ["koi_fpflag_nt", "koi_fpflag_ss", "koi_fpflag_co", "koi_fpflag_ec"]
    return {
        "status": labels.value_counts(examples, "example_status"),
        "labels": labels.value_counts(examples, "split", "label_name"),
        "exclusions": labels.value_counts(examples, "exclusion_reason"),
        "bias": statistics.bias_table(labelled, list(statistics.BIAS_VARIABLES)).orderBy(F.desc("separability")),
        "signals_per_star": statistics.signals_per_star(examples),
        "flag_means": labelled.groupBy("label").agg(*(F.avg(c).alias(c) for c in flags)),
        "contamination": contamination_summary(examples),
        "missing": statistics.missing_counts(examples, ["koi_period", "koi_time0bk", "koi_duration", "koi_depth"]),
        "near_threshold": ok.agg(F.count_if(F.col("transit_coverage") < 0.6).alias("low_transit_coverage"), F.count_if(F.col("global_coverage") < 0.6).alias("low_global_coverage")),
    }


def contamination_summary(examples: DataFrame, much: float = 0.25) -> DataFrame:
    """One row: the median and the greatest contamination of usable examples, and how many have more than ``much``."""
    contam = F.nanvl("contam_max_relative_to_depth", F.lit(None).cast("double"))
    ok = examples.filter("example_status = 'ok'").select(contam.alias("contam"))
    # One count a distinct value: all three figures are made from these, and the median in as many tasks as there are buckets.
    values = settle(ok.groupBy("contam").agg(F.count("*").alias("_c")))
    seen = values.filter(F.col("contam").isNotNull()).withColumn("_all", F.lit(True))
    sizes = seen.groupBy("_all").agg(F.sum("_c").alias("_n"))
    steps = running_sums(seen, ["_all"], "contam", ["_c"]).join(F.broadcast(sizes), "_all")  # one row
    median = steps.agg(value_at("contam", "_c_upto", F.col("_n"), 0.5).alias("median"))
    rest = values.agg(F.coalesce(F.sum(F.when(F.col("contam") > much, F.col("_c"))), F.lit(0).cast("long")).alias("above_quarter"), F.max("contam").alias("max"))
    return median.join(F.broadcast(rest))  # one row each


def split_mismatches(examples: DataFrame, manifest: DataFrame) -> DataFrame:
    """(kepoi_name, split, manifest_split): examples whose split is not that of the manifest, or that it lacks."""
    known = manifest.select("kepoi_name", F.col("split").alias("manifest_split"))
    joined = examples.select("kepoi_name", "split").join(known, "kepoi_name", "left")
    return joined.filter(~F.col("split").eqNullSafe(F.col("manifest_split")))


def shown_examples(examples: DataFrame, most: int = 3) -> DataFrame:
    """(panel, place, kepoi_name, kepid): the first usable examples by name of each label, and those of one star.

    The star is the least one with three signals or more. Each panel is a bounded top-k.
    """
    ok = examples.filter("example_status = 'ok' AND training_status = 'train_eligible'")
    crowd = ok.filter("n_kois_on_star >= 3").agg(F.min("kepid").alias("kepid"))
    panels = {"positive": ok.filter("label = 1"), "negative": ok.filter("label = 0"), "multi": ok.join(F.broadcast(crowd), "kepid", "left_semi")}  # one row
    out = None
    for name, rows in panels.items():
        first = rows.select("kepoi_name", "kepid").orderBy("kepoi_name").limit(most)
        place = F.row_number().over(Window.orderBy("kepoi_name"))
        made = first.select(F.lit(name).alias("panel"), place.alias("place"), "kepoi_name", "kepid")
        out = made if out is None else out.unionByName(made)
    return out


def contaminated_stars(examples: DataFrame, most: int = 4) -> DataFrame:
    """(place, kepid, contamination): the stars with several signals whose worst contamination is the greatest."""
    worst = F.max(F.nanvl("contam_max_relative_to_depth", F.lit(None).cast("double"))).alias("contamination")
    stars = examples.filter("n_kois_on_star > 1").groupBy("kepid").agg(worst).orderBy(F.desc_nulls_last("contamination"), "kepid").limit(most)
    return stars.select(F.row_number().over(Window.orderBy(F.desc_nulls_last("contamination"), "kepid")).alias("place"), "kepid", "contamination")
