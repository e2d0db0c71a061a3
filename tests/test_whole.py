"""The whole job: results that no cut of rows, stars or text may change."""

from __future__ import annotations

from foldspark import queries as library
from foldspark.sources.testdata import catalog, signals

from .test_library import SF

SF10 = "/root/testdata/sf0.01"

def test_signals_are_every_order(spark):
    assert signals(spark, SF).count() == catalog(spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_search_has_a_row_for_each_field_of_eight_stars(spark):
    stars = {r["kepid"] for r in library._normalised(spark, SF10).select("kepid").distinct().collect()}
    rows = {r["kepid"]: r for r in library.bls_search(spark, SF10).collect()}
    assert set(rows) == {k // 8 for k in stars} and len(rows) > 16
    assert max(r["n_points"] for r in rows.values()) <= 8 * 99
    assert all(r["status"] == "ok" and r["power"] is not None for r in rows.values() if r["n_points"] >= 100)
