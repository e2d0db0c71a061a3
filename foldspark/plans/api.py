"""The read side: what an interactive client asks of the tables, each answer a DataFrame.

Filters on ``kepid`` come first, so a table that is clustered by it reads one star's row groups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.functions import ephemeris, phase_fold
from foldspark.operators.views import bin_curve

_TARGET = re.compile(r"(?:kic[\s_-]?)?0*(\d{1,9})", re.IGNORECASE)
_DATASET = re.compile(r"[a-z0-9][a-z0-9_-]*", re.IGNORECASE)


class NotFound(LookupError):
    """Nothing is known under that name."""


def parse_target(text: str) -> int:
    """The number in a target's name; anything else is an error."""
    found = _TARGET.fullmatch(text.strip())
    if not found:
        raise ValueError(f"not a target: {text!r}")
    return int(found.group(1))


@dataclass(frozen=True)
class Tables:
    """What the queries read; tables that don't exist yet are None."""

    catalog: DataFrame
    processed: DataFrame | None = None
    products: DataFrame | None = None
    runs: DataFrame | None = None
    datasets: DataFrame | None = None


def health(tables: Tables) -> DataFrame:
    """One row: whether there is a catalog, and how many stars have a processed light curve."""
    catalog = tables.catalog.limit(1).agg((F.count("*") > 0).alias("catalog_available"))
    stars = tables.catalog.select("kepid").limit(0) if tables.processed is None else tables.processed.select("kepid").distinct()
    return catalog.join(F.broadcast(stars.agg(F.count("*").alias("n_processed"))))  # one row each


def targets(tables: Tables) -> DataFrame:
    """(kepid, target_id, n_kois, dispositions, has_lightcurve, has_bls) of every star."""
    out = tables.catalog.groupBy("kepid").agg(F.count("*").alias("n_kois"), F.array_sort(F.collect_set("koi_disposition")).alias("dispositions"))
    for name, table in (("has_lightcurve", tables.processed), ("has_bls", tables.runs)):
        if table is None:
            out = out.withColumn(name, F.lit(False))
        else:
            found = table.select("kepid").distinct().withColumn(name, F.lit(True))
            out = out.join(found, "kepid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("target_id", F.format_string("KIC %d", F.col("kepid")))


def target(tables: Tables, name: str) -> DataFrame:
    """One row: a star with its signals, products and the latest noise-free search result."""
    kepid = parse_target(name)
    signals = tables.catalog.filter(F.col("kepid") == kepid)
    listed = signals.agg(F.count("*").alias("n_kois"), F.array_sort(F.collect_list(F.struct("kepoi_name", "koi_disposition", "koi_period", "koi_time0bk", "koi_duration", "koi_depth"))).alias("kois"))
    out = listed.filter("n_kois > 0").withColumn("kepid", F.lit(kepid).cast("long"))
    if tables.products is not None:
        files = tables.products.filter(F.col("kepid") == kepid).groupBy("kepid").agg(F.array_sort(F.collect_list(F.struct("quarter", "filename", "size_bytes"))).alias("products"))
        out = out.join(files, "kepid", "left")
    if tables.runs is not None:
        out = out.join(latest_runs(tables, name).filter("severity = 0").select("kepid", F.struct("run_id", "period", "power").alias("bls_clean")), "kepid", "left")
    return out


def light_curve(tables: Tables, name: str, max_points: int | None = None) -> DataFrame:
    """A star's processed samples in time order, or, where they are more than ``max_points``, means by time bin."""
    if max_points is not None and not 100 <= max_points <= 500_000:
        raise ValueError("max_points must be within 100..500000")
    rows, span = _samples(tables, name)
    columns = ["time_bkjd", "flux_norm", "trend", "flux_detrended", "quarter"]
    if max_points is None or span["n"] <= max_points or span["lo"] == span["hi"]:
        return rows.select("kepid", *columns).orderBy("time_bkjd")
    from foldspark.functions import bin_index

    placed = rows.withColumn("bin", bin_index("time_bkjd", span["lo"], span["hi"], max_points))
    means = placed.groupBy("kepid", "bin").agg(*(F.avg(c).alias(c) for c in columns))
    return means.withColumn("quarter", F.rint("quarter").cast("int")).select("kepid", "bin", *columns).orderBy("bin")


def _samples(tables: Tables, name: str) -> tuple[DataFrame, dict]:
    kepid = parse_target(name)
    if tables.processed is None:
        raise NotFound(f"no processed light curve for KIC {kepid}")
    rows = tables.processed.filter(F.col("kepid") == kepid)
    span = rows.agg(F.count("*").alias("n"), F.min("time_bkjd").alias("lo"), F.max("time_bkjd").alias("hi")).first().asDict()
    if not span["n"]:
        raise NotFound(f"no processed light curve for KIC {kepid}")
    return rows, span


def phase_folded(tables: Tables, name: str, signal: str | None = None, source: str = "catalog", window_hours: float = 24.0, bins: int = 120) -> tuple[DataFrame, DataFrame]:
    """(folded samples by phase in hours, their binned medians) on a catalog signal's or the search's ephemeris."""
    if source not in ("catalog", "bls") or not 0 < window_hours <= 240 or not 10 <= bins <= 2000:
        raise ValueError("source is catalog or bls, window_hours within (0, 240], bins within 10..2000")
    kepid = parse_target(name)
    if source == "catalog":
        rows = tables.catalog.filter(F.col("kepid") == kepid)
        rows = rows if signal is None else rows.filter(F.col("kepoi_name") == signal)
        first = rows.select("kepoi_name", ephemeris().alias("e")).orderBy("kepoi_name").first()
        if first is None:
            raise NotFound(f"no catalog signal {signal or ''} for KIC {kepid}".replace("  ", " "))
        if first["e"] is None:
            raise NotFound("catalog ephemeris unavailable")
        period, epoch = first["e"]["period_days"], first["e"]["epoch_bkjd"]
    else:
        first = latest_runs(tables, name).filter("severity = 0 AND status = 'ok'").select("period", "transit_time").first()
        if first is None:
            raise NotFound(f"no search result for KIC {kepid}")
        period, epoch = first["period"], first["transit_time"]
    rows, _ = _samples(tables, name)
    window = min(window_hours, 12.0 * period)
    folded = rows.select("kepid", (phase_fold("time_bkjd", period, epoch) * 24.0).alias("phase_hours"), F.col("flux_detrended").alias("flux"))
    inside = folded.filter(F.abs("phase_hours") <= window)
    return inside.orderBy("phase_hours"), bin_curve(inside, ["kepid"], "phase_hours", "flux", -window, window, bins)


def latest_runs(tables: Tables, name: str) -> DataFrame:
    """All severities of the newest run that has a result for the star; run ids sort by time."""
    kepid = parse_target(name)
    if tables.runs is None:
        raise NotFound(f"no search result for KIC {kepid}")
    rows = tables.runs.filter((F.col("kepid") == kepid) & (F.col("status") == "ok"))
    newest = rows.agg(F.max("run_id").alias("run_id"))
    return rows.join(F.broadcast(newest), "run_id").orderBy("severity")  # one row


def search_result(tables: Tables, name: str) -> DataFrame:
    return latest_runs(tables, name)


def datasets(tables: Tables) -> DataFrame:
    if tables.datasets is None:
        raise NotFound("no datasets")
    return tables.datasets.orderBy("name")


def dataset(tables: Tables, name: str) -> DataFrame:
    if not _DATASET.fullmatch(name):
        raise ValueError(f"not a dataset name: {name!r}")
    return datasets(tables).filter(F.col("name") == name)
