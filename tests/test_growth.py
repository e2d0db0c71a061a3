"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import labels, ranking, search, statistics
from foldspark.operators import timeseries as ts
from foldspark.plans import jobs
from foldspark.sources.testdata import catalog, table

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_label_normalises_its_texts_a_few_times(spark):
    rows = labels.apply_label_policy(catalog(spark, SF)).filter("label = 1")
    assert plan(rows).count("regexp_replace") <= 8
    assert plan(rows.groupBy("kepid").agg(F.max("label_name"), F.max("exclusion_reason"))).count("regexp_replace") <= 8


def test_first_ranks_are_those_of_the_whole_ranking(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"))
    most = F.when(F.col("g") == 1, 700).when(F.col("g") == 2, 5).otherwise(0)
    whole = ranking.hash_rank(rows, ["g"], "id", 42).filter(F.col("rank") <= most)
    first = ranking.hash_rank(rows, ["g"], "id", 42, most=most)
    assert sorted(map(tuple, first.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert first.count() == 705


def test_bias_and_contamination_read_their_table_once(spark):
    rows = table(spark, SF, "lineitem").withColumn("label", F.when(F.col("l_returnflag") == "A", 1).otherwise(0))
    assert "parquet" not in plan(statistics.bias_table(rows, ["l_tax"]))
    worst = rows.select(F.lit("ok").alias("example_status"), F.col("l_tax").alias("contam_max_relative_to_depth"))
    made = jobs.contamination_summary(worst)
    assert "parquet" not in plan(made) and "percentile(" not in plan(made) and "median(" not in plan(made)


def test_contamination_of_no_values_is_one_row(spark):
    schema = "example_status string, contam_max_relative_to_depth double"
    for rows in ([], [("ok", None), ("ok", float("nan"))], [("other", 1.0)]):
        assert [tuple(r) for r in jobs.contamination_summary(spark.createDataFrame(rows, schema)).collect()] == [(None, 0, None)]
    assert tuple(jobs.contamination_summary(spark.createDataFrame([("ok", 0.5), ("ok", 0.25)], schema)).first()) == (0.375, 1, 0.5)


def test_stars_stay_whole_across_batches(spark):
    rows = [(s, 0.1 * k, 1.0 + (7 * k + (s or 3)) % 5, k // 20) for s in (None, 1, 2, 3, 4, 5) for k in range(40)]
    curve = spark.createDataFrame(rows, "kepid long, time double, flux double, segment int")
    whole = sorted(map(str, ts.running_median_trend(curve, 1.0, 3).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, ts.running_median_trend(curve, 1.0, 3).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Many stars share a call, and null is a star of its own.
    one = ts.running_median_trend(curve.filter("kepid IS NULL"), 1.0, 3)
    assert set(map(str, one.collect())) <= set(whole) and len(whole) == 240
    assert "FlatMapGroupsInPandas" not in plan(one)


def plain_box(t, y, dy, period, durations, objective, step):
    """(power, duration, first bin) of a period's best box, from sums over the samples of every box."""
    y, w, n = y - np.median(y), 1.0 / dy**2, int(np.ceil(period / step))
    turns = (t - t.min()) * (1.0 / period)
    place = np.minimum((turns - np.floor(turns)) * (period / step), n - 1).astype(int)
    best = (-np.inf, None, None)
    for duration in durations:
        for k in range(n):
            # A box longer than the period counts samples again.
            times = sum((place == (k + j) % n).astype(int) for j in range(max(1, round(duration / step))))
            inside, outside = (times * w).sum(), w.sum() - (times * w).sum()
            if min(inside, outside) <= 1e-12 * w.sum():
                continue
            depth = ((w * y).sum() - (times * w * y).sum()) / outside - (times * w * y).sum() / inside
            goal = 0.5 * inside * depth**2 if objective == "likelihood" else depth / np.sqrt(1 / inside + 1 / outside)
            if depth >= 0 and goal > best[0] * (1 + 1e-9):
                best = (goal, duration, k)
    return best


@pytest.mark.parametrize("objective", ["likelihood", "snr"])
def test_neighbouring_periods_are_searched_together(monkeypatch, objective):
    rng = np.random.default_rng(6)
    t, durations = np.sort(rng.random(530) * 30), np.array([0.25, 0.5])
    y, dy = 1 - 0.4 * (t % 3.3 < 0.3) + rng.normal(0, 0.1, 530), 0.05 + 0.05 * rng.random(530)
    periods = np.exp(np.linspace(0, np.log(10), 829))
    calls, bincount = [], np.bincount
    monkeypatch.setattr(search.np, "bincount", lambda *a, **k: calls.append(1) or bincount(*a, **k))
    found = search.box_power(t, y, dy, periods, durations, objective, 10)
    assert len(calls) < len(periods) / 10
    for p in range(0, 829, 69):
        power, duration, k = plain_box(t, y, dy, periods[p], durations, objective, 0.025)
        assert found["power"][p] == pytest.approx(power) and found["duration"][p] == duration
        assert found["transit_time"][p] == pytest.approx(t.min() + (k * 0.025 + 0.5 * duration) % periods[p])
    monkeypatch.setattr(search, "CELLS", 1)
    single = search.box_power(t, y, dy, periods, durations, objective, 10)
    assert all(np.array_equal(found[c], single[c], equal_nan=True) for c in found)
    nothing = search.box_power(t, np.full(530, np.inf), dy, periods[:9], durations, objective, 10)
    assert np.isnan(nothing["power"]).all() and np.isnan(nothing["transit_time"]).all()


def test_short_periods_wrap_in_one_array_with_long_ones():
    rng = np.random.default_rng(9)
    t, y, dy = np.sort(rng.random(150) * 20), rng.normal(1, 0.1, 150), np.full(150, 0.1)
    periods = np.array([0.11, 2.0, 0.13, 0.52])
    found = search.box_power(t, y, dy, periods, np.array([0.1, 0.1, 0.5]), "likelihood", 2)
    for p, period in enumerate(periods):
        assert found["power"][p] == pytest.approx(plain_box(t, y, dy, period, [0.1, 0.5], "likelihood", 0.05)[0])
