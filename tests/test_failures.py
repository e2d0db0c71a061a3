"""Stars that can't be processed become rows of the log; the others finish."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import queries as library
from foldspark.config import DetrendConfig, PreprocessingConfig
from foldspark.operators import timeseries as ts
from foldspark.plans import preprocess as prep
from foldspark.sources.testdata import light_curve

from .compare import difference, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "kepid long, time double, flux double, flux_err double, quality long, quarter long"


def samples(kepid, n=60, flux=lambda k: 100.0 + k % 5, quality=0):
    return [(kepid, 0.1 * k, float(flux(k)), 1.0, quality, k // 30) for k in range(n)]


def config(**detrend):
    return PreprocessingConfig(detrend=DetrendConfig(method="robust_spline", knot_spacing_days=1.0, min_points=3, **detrend), clip_upper_sigma=None)


def stars(spark, n):
    return spark.createDataFrame([(k,) for k in range(1, n + 1)], "kepid long")


def refuse(group):
    """A kernel that can't do with some stars."""
    kepid = group["kepid"].iloc[0]
    if kepid == 2:
        raise np.linalg.LinAlgError("singular system\nwith a second line")
    if kepid == 3:
        raise ZeroDivisionError
    return group.assign(trend=1.0)


def test_failing_stars_are_rows_and_the_others_finish(spark):
    rows = samples(1) + samples(2) + samples(3) + samples(4, flux=lambda k: -1.0 if k < 30 else 5.0) + samples(5, quality=1)
    curve = spark.createDataFrame(rows, SCHEMA)
    processed, log = prep.preprocess_stars(curve, stars(spark, 6), config(), kernel=refuse)
    assert {r["kepid"]: (r["status"], r["message"]) for r in log.collect()} == {
        1: ("ok", ""), 2: ("preprocessing_failed", "singular system"), 3: ("preprocessing_failed", "ZeroDivisionError"),
        4: ("preprocessing_failed", ts.NOT_POSITIVE), 5: ("preprocessing_failed", prep.ALL_EMPTY), 6: ("no_lightcurve", prep.NO_SAMPLES),
    }
    assert {(r["kepid"], r["n"]) for r in processed.groupBy("kepid").count().withColumnRenamed("count", "n").collect()} == {(1, 60)}


def test_a_reported_run_equals_a_strict_one(spark):
    curve = spark.createDataFrame(samples(1) + samples(2, flux=lambda k: 50 + (k * 7) % 11), SCHEMA)
    processed, log = prep.preprocess_stars(curve, stars(spark, 2), config())
    assert sorted(map(tuple, processed.collect())) == sorted(map(tuple, prep.preprocess(curve, config()).collect()))
    assert {r["status"] for r in log.collect()} == {"ok"}
    bad = curve.union(spark.createDataFrame(samples(3, flux=lambda k: -1), SCHEMA))
    assert sorted(map(tuple, prep.preprocess_stars(bad, stars(spark, 3), config())[0].collect())) == sorted(map(tuple, processed.collect()))
    with pytest.raises(Exception, match="median flux is not positive"):
        prep.preprocess(bad, config()).collect()


@pytest.mark.parametrize("method", ["robust_spline", "running_median"])
def test_stars_without_an_ephemeris_are_reported(spark, method):
    curve = spark.createDataFrame(samples(1) + samples(2), SCHEMA)
    catalog = spark.createDataFrame([(1, "K1", 3.0, 0.5, 2.0), (2, "K2", None, 0.5, 2.0)], "kepid long, kepoi_name string, koi_period double, koi_time0bk double, koi_duration double")
    masked = PreprocessingConfig(detrend=DetrendConfig(method=method, min_points=3, mask_known_transits=True))
    processed, log = prep.preprocess_stars(curve, stars(spark, 2), masked, catalog)
    assert {r["kepid"]: (r["status"], r["message"]) for r in log.collect()} == {1: ("ok", ""), 2: ("preprocessing_failed", prep.NO_EPHEMERIS)}
    assert {r["kepid"] for r in processed.select("kepid").distinct().collect()} == {1}


def test_star_log_equals_its_sql(spark):
    assert difference(library.star_log(spark, SF), duck(SF), library.oracle_sql()["star_log"]) is None


def test_a_trend_of_zero_gives_infinite_values_and_no_error(spark):
    # The first half's window has a median of 0 although the quarter's median is positive.
    values = [0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 0.0] + [100.0] * 12
    curve = spark.createDataFrame([(1, 0.1 * k, v, 1.0, 0, 0) for k, v in enumerate(values)], SCHEMA)
    for clip, n in ((None, 20), (5.0, 19)):
        wanted = PreprocessingConfig(detrend=DetrendConfig(window_days=0.4, min_points=3), clip_upper_sigma=clip)
        strict = {round(10 * r["time_bkjd"]): r["flux_detrended"] for r in prep.preprocess(curve, wanted).collect()}
        assert len(strict) == n and np.isnan(strict[1]) and strict[15] == 1.0
        assert clip is not None or strict[4] == float("inf")
        processed, log = prep.preprocess_stars(curve, stars(spark, 1), wanted)
        assert [tuple(r) for r in log.collect()] == [(1, "ok", "")] and processed.count() == n


def with_zero_trends(con, folder, level):
    """events whose values begin with ``level`` in every week of a star, fewer than half of them, and are above it later."""
    kept = "PARTITION BY user_id, event_type = 'error', floor((epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE / 7)"
    low = f"2 * row_number() OVER ({kept} ORDER BY ts, event_id) < count(*) OVER ({kept})"
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN {low} THEN {level} ELSE value + 1 + {level} END AS value) FROM events) TO '{folder}/events.parquet' (FORMAT parquet)")
    for table in ("orders", "customer"):
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")


@pytest.mark.parametrize("name", ["detrend_fold_bin", "processed_curves", "star_log"])
def test_zero_trends_equal_the_sql(spark, tmp_path, name):
    with_zero_trends(duck(SF), tmp_path, 22 if name == "star_log" else 0)
    assert difference(library.queries()[name](spark, str(tmp_path)), duck(str(tmp_path)), library.oracle_sql()[name]) is None


def test_examples_of_zero_trends_are_made(spark, tmp_path):
    with_zero_trends(duck(SF), tmp_path, 0)
    made = library.queries()["examples"](spark, str(tmp_path))
    assert made.filter("n_points > 0").count() > 0 and made.count() == library.queries()["examples"](spark, SF).count()


def test_quarters_of_any_median_equal_the_sql(spark, tmp_path):
    # Whole quarters of zeros, quarters with some values above zero, and negative ones.
    con, week = duck(SF), "floor((epoch_us(ts) - 1704067200000000) / 8.64e10::DOUBLE / 7)"
    low = f"CASE WHEN user_id % 4 = 1 AND {week} = 1 OR user_id % 4 = 2 AND {week} = 2 AND event_id % 3 > 0 THEN 0 WHEN user_id % 4 = 3 AND {week} = 0 THEN -value ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({low} AS value) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    made, con, sql = library.processed_curves(spark, str(tmp_path)), duck(str(tmp_path)), library.oracle_sql()["processed_curves"]
    assert difference(made, con, sql) is None
    # That takes NaN for null; there are no nulls on either side.
    doubles = [name for name, kind in made.dtypes if kind == "double"]
    want = con.execute(f"SELECT {', '.join(f'count(*) FILTER (isnan({c}))' for c in doubles)} FROM ({sql})").fetchone()
    assert tuple(made.agg(*(F.count_if(F.isnan(c)) for c in doubles)).first()) == want and min(want[1], want[3], want[4]) > 0
    assert made.filter(" OR ".join(f"{c} IS NULL" for c in made.columns)).count() == 0
    # The library's own default stays an error.
    with pytest.raises(Exception, match="median flux is not positive"):
        prep.preprocess(light_curve(spark, str(tmp_path))).collect()
