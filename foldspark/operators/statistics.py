"""Class-bias statistics, histograms and summaries of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.config import MAD_TO_SIGMA
from foldspark.functions import is_finite
from foldspark.lineage import settle
from foldspark.operators.ranking import quantiles, running_sums, value_at

#: The catalog columns whose bias is reported.
BIAS_VARIABLES = ("koi_period", "koi_depth", "koi_duration", "koi_model_snr", "koi_kepmag", "koi_prad", "koi_impact", "koi_steff", "koi_srad", "koi_count")


def robust_std(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, robust_std): 1.4826 times the median absolute deviation of the finite values; null without any.

    Two aggregations that combine before their shuffles, for groups of any size.
    """
    finite = df.withColumn("_v", F.when(is_finite(value), F.col(value)))
    middles = finite.groupBy(*keys).agg(F.median("_v").alias("_m"))
    away = finite.join(middles, keys).withColumn("_d", F.abs(F.col("_v") - F.col("_m")))
    return away.groupBy(*keys).agg((MAD_TO_SIGMA * F.median("_d")).alias("robust_std"))


def bias_table(df: DataFrame, variables: list[str], label: str = "label", least: int = 3) -> DataFrame:
    """One row per variable: how its distribution differs between label 1 and label 0.

    Counts, missing values, medians, tenth and ninetieth percentiles by class, the Kolmogorov-Smirnov distance, the
    area under the curve of the variable alone (ties count half), and the larger of that and its complement. Variables
    with under ``least`` values in a class are left out. Equal values are counted together first; running sums over the
    distinct values then give percentiles, distance and area, in as many tasks as there are buckets.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in variables)))
    long = df.filter(F.col(label).isin(0, 1)).select((F.col(label) == 1).alias("_pos"), pairs.alias("_v")).select("_pos", "_v.*")
    long = long.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    pos, seen = F.col("_pos"), F.col("x").isNotNull()
    # The table is read once; all else is made from its distinct values and their counts.
    values = settle(long.groupBy("variable", "x").agg(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q")))
    total = lambda c, there: F.coalesce(F.sum(F.when(there, F.col(c))), F.lit(0).cast("long"))
    counts = values.groupBy("variable").agg(
        total("p", seen).alias("n_pos"), total("q", seen).alias("n_neg"), total("p", ~seen).alias("missing_pos"), total("q", ~seen).alias("missing_neg")
    ).filter((F.col("n_pos") >= least) & (F.col("n_neg") >= least))
    steps = running_sums(values.filter(seen), ["variable"], "x", ["p", "q"]).join(F.broadcast(counts), "variable")  # a row a variable
    distance = F.max(F.abs(F.col("p_upto") / F.col("n_pos") - F.col("q_upto") / F.col("n_neg")))
    # A positive beats the negatives below it, and half of those that equal it.
    wins = F.sum(F.col("p") * (2 * F.col("q_upto") - F.col("q")))
    points = [
        value_at("x", f"{side}_upto", F.col(f"n_{name}"), at).alias(f"{what}_{name}")
        for side, name in (("p", "pos"), ("q", "neg")) for what, at in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))
    ]
    made = steps.groupBy("variable").agg(
        *(F.first(c).alias(c) for c in ("n_pos", "n_neg", "missing_pos", "missing_neg")), *points,
        distance.alias("ks_statistic"), (wins / (2.0 * F.first("n_pos") * F.first("n_neg"))).alias("univariate_auc"),
    )
    return made.withColumn("separability", F.greatest(F.col("univariate_auc"), 1 - F.col("univariate_auc")))


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, hi: float, n_bins: int, log: bool = False) -> DataFrame:
    """(keys, bin, n, weight): values by uniform bin (of their logarithm, if asked), the top edge inclusive.

    ``weight`` is the bin's share of the key's values within the edges.
    """
    x = F.log(F.col(value)) if log else F.col(value).cast("double")
    a, b = (F.log(F.lit(float(v))) if log else F.lit(float(v)) for v in (lo, hi))
    inside = df.filter((F.col(value) >= lo) & (F.col(value) <= hi))
    place = F.least(F.width_bucket(x, a, b, F.lit(n_bins)), F.lit(n_bins)) - 1
    counts = inside.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(totals, keys).withColumn("weight", F.col("n") / F.col("_total")).drop("_total")


def error_summary(results: DataFrame, keys: list[str], error: str = "relative_depth_error", extra: str = "trend_error_rms_ppm") -> DataFrame:
    """Mean, root mean square and greatest size of the errors of each key, and the mean of ``extra``."""
    return results.groupBy(*keys).agg(
        F.avg(error).alias("mean_error"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rms_error"), F.max(F.abs(F.col(error))).alias("max_abs_error"), F.avg(extra).alias(f"mean_{extra}")
    )


def pivot_methods(results: DataFrame, rows: str, columns: str, value: str, values: list[str]) -> DataFrame:
    return results.groupBy(rows).pivot(columns, values).agg(F.avg(value))


def ratio_summary(results: DataFrame, a: str, b: str) -> DataFrame:
    """One row: medians of both, of their ratio, and the share of rows where a exceeds b."""
    ratio = F.try_divide(F.col(a), F.col(b))
    rows = results.select(a, b, ratio.alias("ratio"))
    medians = quantiles(rows, [a, b, "ratio"], [0.5]).agg(*(F.max(F.when(F.col("variable") == c, F.col("q0"))).alias(f"median_{c}") for c in (a, b, "ratio")))
    # Both sides are one row.
    return medians.join(F.broadcast(rows.agg(F.avg((F.col("ratio") > 1).cast("double")).alias("fraction_greater"))))


def signals_per_star(catalog: DataFrame) -> DataFrame:
    """(n_signals, n_stars): how many stars have how many signals."""
    return catalog.groupBy("kepid").agg(F.count("*").alias("n_signals")).groupBy("n_signals").agg(F.count("*").alias("n_stars"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, missing): rows where each column is null or NaN, and under ``any`` rows where one of them is."""
    gone = {c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in columns}
    either = F.lit(False)
    for g in gone.values():
        either = either | g
    counts = df.agg(*(F.count_if(g).alias(c) for c, g in gone.items()), F.count_if(either).alias("any"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing")) for c in [*columns, "any"])))).select("col.*")
