"""Ranks and running sums within groups of any size.

A window over a whole group sorts it in one task. Here a group is cut into buckets; a window numbers the rows of each
bucket, and the buckets' totals, a small table, give each bucket its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.lineage import settle

#: Hex digits of the key that name a bucket: 16 ** 3 buckets a group.
PREFIX = 3


def hash_key(seed: int | str, key: str) -> F.Column:
    """A key in random but fixed order: md5 of the seed and the key's text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int | str, into: str = "rank", most: F.Column | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in its group, by ``hash_key`` and then the key itself.

    Groups are few, such as labels and strata, so that their buckets' offsets are a small table. With ``most``, which
    depends on the group alone, only rows up to that rank come back; buckets that begin beyond it are neither
    shuffled nor sorted.
    """
    df = df.withColumn("_hash", hash_key(seed, key)).withColumn("_bucket", F.substring("_hash", 1, PREFIX))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_hash", key)
    totals = df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(F.col(g).alias(f"_g_{g}") for g in group), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    # At most 16 ** PREFIX rows a group.
    joined = df.join(F.broadcast(offsets), [*same, F.col("_bucket") == F.col("_b")])
    if most is not None:
        joined = joined.filter(F.col("_before") < most)
    ranked = joined.withColumn(into, (F.row_number().over(inside) + F.col("_before")).cast("long"))
    if most is not None:
        ranked = ranked.filter(F.col(into) <= most)
    return ranked.drop("_hash", "_bucket", "_b", "_before", *(f"_g_{g}" for g in group))


def running_sums(df: DataFrame, group: list[str], order: str, measures: list[str], buckets: int = 1024) -> DataFrame:
    """df with ``<measure>_upto``: the measure's sum over the group's rows up to and with this one.

    The order column must be unique within a group, as it is after aggregation by it. Buckets are cut at approximate
    quantiles of each group, so they hold about equally many rows. ``df`` is read three times; settle what is costly.
    """
    cuts = df.groupBy(*group).agg(F.percentile_approx(order, F.array(*(F.lit(k / buckets) for k in range(1, buckets))), F.lit(10_000)).alias("_cuts"))
    # A value is placed by every step-th cut and then by the cuts of one step.
    step = max(1, int(buckets**0.5))
    cuts = cuts.withColumn("_heads", F.filter("_cuts", lambda c, k: (k + 1) % step == 0))
    cuts = cuts.withColumn("_runs", F.transform(F.sequence(F.lit(0), F.size("_heads")), lambda k: F.slice("_cuts", k * step + 1, step)))
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col(order)))
    # A row a group, and groups are few.
    placed = df.join(F.broadcast(cuts.drop("_cuts")), group).withColumn("_head", below("_heads"))
    placed = placed.withColumn("_bucket", F.col("_head") * step + below(F.get("_runs", F.col("_head")))).drop("_heads", "_runs", "_head")
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*group, "_bucket").agg(*(F.sum(m).alias(f"_t_{m}") for m in measures))
    offsets = totals.select(*group, "_bucket", *(F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures))
    summed = placed.select("*", *(F.sum(m).over(inside).alias(f"_s_{m}") for m in measures)).join(F.broadcast(offsets), [*group, "_bucket"])
    return summed.select(*df.columns, *((F.col(f"_s_{m}") + F.col(f"_o_{m}")).alias(f"{m}_upto") for m in measures))


def value_at(x: str, upto: str, count: F.Column, fraction: float) -> F.Column:
    """Aggregate: the value at this fraction of ``count`` ranked ones, linear between neighbours, from running sums."""
    place = (count - 1) * F.lit(float(fraction))
    low, high = F.floor(place), F.ceil(place)
    at = lambda rank: F.min(F.when(F.col(upto) > rank, F.col(x)))
    share = F.first(place - low)
    return at(low) + share * (at(high) - at(low))


def quantiles(df: DataFrame, columns: list[str], fractions: list[float]) -> DataFrame:
    """(variable, n, q0, q1, ...): exact quantiles of each column's values that are not null or NaN.

    Equal values are counted together before the shuffle and ranked in as many tasks as there are buckets.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns)))
    long = df.select(pairs.alias("_v")).select("_v.*").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    values = settle(long.groupBy("variable", "x").agg(F.count("*").alias("c")))
    counts = values.groupBy("variable").agg(F.sum("c").alias("n"))
    steps = running_sums(values, ["variable"], "x", ["c"]).join(F.broadcast(counts), "variable")  # a row a column
    return steps.groupBy("variable").agg(F.first("n").alias("n"), *(value_at("x", "c_upto", F.col("n"), f).alias(f"q{k}") for k, f in enumerate(fractions)))
