"""Seeded choices of signals and of stars, products and newest statuses."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.config import ProductConfig, SelectionConfig, SplitConfig, StarSelectionConfig
from foldspark.functions import star_pool
from foldspark.operators.labels import NEGATIVE, POSITIVE
from foldspark.operators.ranking import hash_rank
from foldspark.operators.splits import SPLITS, allocate, cut_sizes

POOLS = ("has_positive", "negative_only")


def select_subset(labelled: DataFrame, selection: SelectionConfig | None = None, order: str = "md5") -> DataFrame:
    """At most ``limit`` signals, evenly by label unless asked otherwise, in the order of a seeded hash of their names.

    The choice depends on the names and the seed alone. No eligible signal at all is an error. ``order="sample"`` draws
    the places in the order of names that a data frame's ``sample`` draws with this seed (NumPy's legacy generator), for
    choices that must equal earlier ones; it permutes as many numbers as a label has signals, so it is for catalogs of at
    most a million. Of signals with the same name the order is not defined there.
    """
    if order not in ("md5", "sample"):
        raise ValueError(f"unknown order {order}")
    selection = selection or SelectionConfig()
    pool = labelled if selection.include_excluded else labelled.filter(F.col("label").isNotNull())
    stratified = selection.stratify_by_label and not selection.include_excluded
    pool = pool.withColumn("_group", F.col("label").cast("int") if stratified else F.lit(0))
    sizes = {r["_group"]: r["n"] for r in pool.groupBy("_group").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        raise ValueError("no eligible signals to select from")
    groups = [POSITIVE, NEGATIVE] if stratified else [0]
    shares = dict(zip(groups, allocate(min(selection.limit, sum(sizes.values())), [sizes.get(g, 0) for g in groups])))
    if order == "sample":
        return _sampled(pool, sizes, shares, selection.seed).drop("_group")
    wanted = F.lit(0)
    for group, n in shares.items():
        wanted = F.when(F.col("_group") == group, n).otherwise(wanted)
    return hash_rank(pool, ["_group"], "kepoi_name", selection.seed, most=wanted).drop("_group", "rank")


def _sampled(pool: DataFrame, sizes: dict, shares: dict, seed: int, limit: int = 1_000_000) -> DataFrame:
    """The signals of each group at the places that the legacy generator draws; only places leave the driver."""
    if max(sizes.values()) > limit:
        raise ValueError(f"more than {limit} signals for order='sample'; use order='md5'")
    drawn = [(int(g), int(k)) for g, n in shares.items() if n for k in np.random.RandomState(seed).permutation(sizes[g])[:n]]
    places = pool.sparkSession.createDataFrame(drawn, "_group int, _place int")
    placed = pool.withColumn("_place", F.row_number().over(Window.partitionBy("_group").orderBy("kepoi_name")) - 1)
    return placed.join(places, ["_group", "_place"], "left_semi").drop("_place")


def eligible_stars(manifest: DataFrame) -> DataFrame:
    """(kepid, split, star_stratum, pool): stars with a labelled signal."""
    stars = manifest.groupBy("kepid").agg(F.min("split").alias("split"), F.min("star_stratum").alias("star_stratum"))
    return stars.withColumn("pool", star_pool("star_stratum")).filter(F.col("pool").isNotNull())


def select_stars(manifest: DataFrame, config: StarSelectionConfig | None = None, splits: SplitConfig | None = None, order: str = "md5") -> DataFrame:
    """(kepid, split, star_stratum, selection_reason): named stars, and others drawn by split and pool or all of them.

    ``order="md5"`` draws by a hash, in as many tasks as there are buckets; ``order="generator"`` draws from the sorted
    ids by the seeded generator on the driver, for choices that must equal those of another implementation, and is for
    catalogs of a few thousand stars.
    """
    if order not in ("md5", "generator"):
        raise ValueError(f"unknown order {order}")
    config, splits = config or StarSelectionConfig(), splits or SplitConfig()
    stars = manifest.groupBy("kepid").agg(F.min("split").alias("split"), F.min("star_stratum").alias("star_stratum"))
    named = stars.filter(F.col("kepid").isin([int(k) for k in config.include_kepids])) if config.include_kepids else stars.filter(F.lit(False))
    if config.include_kepids:
        known = {r["kepid"] for r in named.select("kepid").collect()}
        unknown = [k for k in config.include_kepids if k not in known]
        if unknown:
            raise ValueError(f"include_kepids not in the split manifest: {unknown}")
    pool = eligible_stars(manifest).join(named.select("kepid"), "kepid", "left_anti")
    if config.all_eligible:
        drawn = pool.withColumn("selection_reason", F.lit("all_eligible"))
    else:
        wanted = F.lit(0)
        per_split = cut_sizes(config.n_stars, splits.fractions)
        for split in SPLITS:
            for name, n in cut_sizes(per_split[split], dict.fromkeys(POOLS, 0.5)).items():
                wanted = F.when((F.col("split") == split) & (F.col("pool") == name), n).otherwise(wanted)
        ranked = hash_rank(pool, ["split", "pool"], "kepid", config.seed, most=wanted) if order == "md5" else _generated(pool, config.seed, wanted)
        drawn = ranked.filter(F.col("rank") <= wanted).withColumn("selection_reason", F.lit("sampled"))
    columns = ["kepid", "split", "star_stratum", "selection_reason"]
    return named.withColumn("selection_reason", F.lit("include_kepids")).select(columns).unionByName(drawn.select(columns))


def _generated(pool: DataFrame, seed: int, wanted, limit: int = 1_000_000) -> DataFrame:
    """pool with rank 1 for the stars that the generator of their split and pool draws, and beyond any limit for others."""
    rows = guard_size(pool, limit, "stars for order='generator'").withColumn("_wanted", wanted).orderBy("kepid").collect()
    drawn = []
    for s, split in enumerate(SPLITS):
        for p, name in enumerate(POOLS):
            mine = [r for r in rows if r["split"] == split and r["pool"] == name]
            n = min(len(mine), mine[0]["_wanted"]) if mine else 0
            drawn += [mine[k]["kepid"] for k in np.random.default_rng([seed, s, p]).choice(len(mine), size=n, replace=False)]
    return pool.filter(F.col("kepid").isin(drawn)).withColumn("rank", F.lit(1))


def select_products(products: DataFrame, config: ProductConfig | None = None) -> DataFrame:
    """Of each star's products one a quarter (the first by filename), from the wanted quarters, the first few."""
    config = config or ProductConfig()
    kept = products if config.quarters is None else products.filter(F.col("quarter").isin(list(config.quarters)))
    first = kept.withColumn("_k", F.row_number().over(Window.partitionBy("kepid", "quarter").orderBy("filename"))).filter("_k = 1")
    place = F.row_number().over(Window.partitionBy("kepid").orderBy("quarter", "filename"))
    return first.withColumn("_k", place).filter(F.col("_k") <= config.max_products_per_target).drop("_k")


def parse_products(found: DataFrame, kepid: int) -> DataFrame:
    """Search results of exactly this target: quarter from the description, masked or negative sizes null, in order."""
    exact = found.filter(F.col("target_name") == f"kplr{kepid:09d}")
    quarter = F.regexp_extract("description", r"Quarter\s+(\d+)", 1)
    return (
        exact.filter(quarter != "")
        .withColumn("quarter", quarter.cast("int"))
        .withColumn("size_bytes", F.when(F.col("size_bytes") >= 0, F.col("size_bytes")))
        .withColumn("kepid", F.lit(kepid).cast("long"))
        .orderBy("quarter", "filename")
    )


def latest_status(history: DataFrame, key: str = "kepid", newest: str = "batch") -> DataFrame:
    """The newest row of each key; of equally new ones that which sorts last.

    An aggregate, so a key with many rows is combined before the shuffle.
    """
    rest = [c for c in history.columns if c not in (key, newest)]
    last = history.groupBy(key).agg(F.max(F.struct(newest, *rest)).alias("_last"))
    return last.select(key, "_last.*").select(*history.columns)


def within_budget(sizes: Iterable[tuple[int, float]], budget: float) -> list[int]:
    """Keys that fit a budget when taken in turn; one that doesn't fit is passed over, later smaller ones may still fit."""
    taken, used = [], 0.0
    for key, size in sizes:
        if used + size <= budget:
            taken.append(key)
            used += size
    return taken


def guard_size(df: DataFrame, limit: int, what: str) -> DataFrame:
    """df, if it has at most ``limit`` rows."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} {what}; raise the limit to go on")
    return df
