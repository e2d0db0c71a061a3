"""Perturbations of light curves, and the registry of trend and perturbation kernels."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.timeseries import point_to_point_sigma

PERTURBATIONS: dict[str, Callable[..., DataFrame]] = {}
TRENDS: dict[str, tuple[Callable[..., DataFrame], bool]] = {}


def register_perturbation(name: str, apply: Callable[..., DataFrame]) -> None:
    """Make ``apply(curve, severity, seed)`` known by a name."""
    PERTURBATIONS[name] = apply


def register_trend(name: str, apply: Callable[..., DataFrame], masked: bool) -> None:
    """Make ``apply(curve with segments, usable column name or None)`` known by a name; ``masked`` hides known transits from it."""
    TRENDS[name] = (apply, masked)


def gaussian_noise(curve: DataFrame, severity: float, seed: int = 42, update_errors: bool = True, sigma_ref: float | None = None) -> DataFrame:
    """curve with seeded white noise of ``severity`` times each source's own point-to-point noise (or ``sigma_ref``).

    Errors grow in quadrature. Severity 0 gives the curve as it is. A source's draws come from a generator seeded by
    (seed, source, 1000 x severity) in the order of its samples, so they don't depend on partitions.
    """
    if not math.isfinite(severity) or severity < 0:
        raise ValueError(f"severity must be finite and at least 0, not {severity}")
    if severity == 0:
        return curve
    if sigma_ref is not None:
        noisy = curve.withColumn("_sigma", F.lit(float(sigma_ref)))
    else:
        levels = point_to_point_sigma(curve).withColumn("sigma", F.coalesce("sigma", F.raise_error(F.lit("at least 3 finite samples are needed to estimate noise")).cast("double")))
        noisy = curve.join(levels.select("kepid", F.col("sigma").alias("_sigma")), "kepid")
    schema = ", ".join(f"`{n}` {t}" for n, t in curve.dtypes) + ", _sigma double, _noise double"

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("time", kind="stable")
        generator = np.random.default_rng([seed, int(group["kepid"].iloc[0]), round(1000 * severity)])
        return group.assign(_noise=generator.normal(0.0, severity * float(group["_sigma"].iloc[0]), size=len(group)))

    made = noisy.groupBy("kepid").applyInPandas(draw, schema).withColumn("flux", F.col("flux") + F.col("_noise"))
    added = severity * F.col("_sigma")
    made = made.withColumn("flux_err", F.sqrt(F.col("flux_err") * F.col("flux_err") + added * added)) if update_errors else made
    return made.select(*curve.columns)


register_perturbation("gaussian_noise", gaussian_noise)
