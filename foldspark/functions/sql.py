"""The library's functions for SQL text: ``register(spark)`` makes them known to a session.

Scalar functions are SQL themselves, so Spark puts their bodies into the query's own plan and code. Robust statistics take
the values of a group as an array (``robust_std(collect_list(flux))``), and the period grid is a table function for
lateral joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from foldspark.config import MAD_TO_SIGMA, QUALITY_BITMASK

#: Finite values of an array in order, and their number.
_SORTED = "array_sort(filter(values, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')))"
_SCALARS = {
    "median_of(values ARRAY<DOUBLE>)": (
        "DOUBLE",
        f"(SELECT (get(s, greatest(size(s) - 1, 0) div 2) + get(s, size(s) div 2)) / 2 FROM (SELECT {_SORTED} AS s))",
    ),
    "robust_std(values ARRAY<DOUBLE>)": (
        "DOUBLE",
        f"{MAD_TO_SIGMA!r}D * median_of(zip_with(values, array_repeat(median_of(values), size(values)), (v, m) -> abs(v - m)))",
    ),
    "phase_fold(t DOUBLE, period DOUBLE, epoch DOUBLE)": (
        "DOUBLE",
        "CASE WHEN period > 0 THEN pmod(t - epoch + period / 2, period) - period / 2 WHEN period IS NOT NULL THEN raise_error('period must be positive') END",
    ),
    "in_transit(t DOUBLE, period DOUBLE, epoch DOUBLE, duration_hours DOUBLE, factor DOUBLE DEFAULT 1.5D)": (
        "BOOLEAN",
        "abs(CASE WHEN period > 0 THEN pmod(t - epoch + period / 2, period) - period / 2 WHEN period IS NOT NULL THEN raise_error('period must be positive') END) < 0.5D * factor * duration_hours / 24D",
    ),
    f"quality_ok(quality BIGINT, mask BIGINT DEFAULT {QUALITY_BITMASK}L)": ("BOOLEAN", "(quality & mask) = 0"),
    "trapezoid(x DOUBLE, depth DOUBLE, half DOUBLE, ingress DOUBLE)": ("DOUBLE", "1 - depth * greatest(0D, least(1D, (half - abs(x)) / ingress))"),
    "target_number(name STRING)": ("BIGINT", "try_cast(nullif(regexp_extract(trim(name), '(?i)^(?:kic[\\\\s_-]?)?0*([0-9]{1,9})$', 1), '') AS BIGINT)"),
}


@F.udtf(returnType="k bigint, period double")
class PeriodGrid:
    """The trial periods of one source: evenly spaced in the logarithm, so that a step shifts the last transit by a part
    of the least duration. A null baseline, or one that isn't positive, has no grid."""

    def eval(self, baseline: float, lo: float, hi: float, min_duration: float, oversample: float) -> Iterator[tuple[int, float]]:
        if not 0 < lo < hi:
            raise ValueError("a period grid needs 0 < lo < hi")
        if baseline is None or not baseline > 0:
            return
        n = math.ceil(math.log(hi / lo) * (oversample * baseline) / min_duration) + 1
        step = (math.log(hi) - math.log(lo)) / max(n - 1, 1)
        for k in range(n):
            yield k, math.exp(math.log(lo) + k * step)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for head, (kind, body) in _SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("period_grid", PeriodGrid)
    return [*(head.split("(")[0] for head in _SCALARS), "period_grid"]
