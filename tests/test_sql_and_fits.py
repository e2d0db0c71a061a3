"""SQL functions, the FITS source, sliding medians, provenance of runs, manifest order and legacy samples."""

from __future__ import annotations

import datetime
import hashlib
import json
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark import functions as fn
from foldspark import queries as library
from foldspark import schemas
from foldspark.config import SelectionConfig
from foldspark.functions import sql as fsql
from foldspark.operators import selection, spline
from foldspark.sources import fits, tables
from foldspark.sources.fits_source import FitsReader, FitsSource

from .compare import difference, duck
from .test_library import fits_file

SF = "/root/testdata/sf0.001"


def test_sql_functions_equal_the_column_functions(spark):
    assert {"phase_fold", "in_transit", "robust_std", "period_grid"} <= set(fsql.register(spark))
    rng = np.random.default_rng(0)
    rows = [(float(t), float(p), float(e), float(d)) for t, p, e, d in zip(rng.uniform(-50, 900, 300), rng.uniform(0.3, 90, 300), rng.uniform(0, 9, 300), rng.uniform(1, 30, 300))]
    spark.createDataFrame([*rows, (None, 1.0, 0.0, 1.0), (5.0, None, 0.0, 1.0)], "t double, p double, e double, d double").createOrReplaceTempView("times")
    got = spark.sql("SELECT *, phase_fold(t, p, e) AS fold, in_transit(t, p, e, d) AS near, in_transit(t, p, e, d, 6) AS wide FROM times")
    made = got.select("fold", "near", "wide", fn.phase_fold("t", "p", "e").alias("f"), fn.in_transit("t", "p", "e", "d").alias("n"), fn.in_transit("t", "p", "e", "d", 6.0).alias("w")).collect()
    assert all((r["fold"], r["near"], r["wide"]) == (r["f"], r["n"], r["w"]) for r in made) and sum(bool(r["w"]) for r in made) > 5
    with pytest.raises(Exception, match="period must be positive"):
        spark.sql("SELECT phase_fold(1D, 0D, 0D)").collect()
    assert spark.sql("SELECT target_number('KIC 010811496') AS a, target_number('x') AS b, quality_ok(16L) AS c, quality_ok(1L) AS d").first().asDict() == {"a": 10811496, "b": None, "c": True, "d": False}


@pytest.mark.parametrize("values", [[], [None], [3.0], [1.0, 2.0, float("nan"), float("inf"), None, 9.0], np.random.default_rng(1).normal(size=101).tolist()])
def test_robust_std_in_sql(spark, values):
    fsql.register(spark)
    df = spark.createDataFrame([(values,)], "v array<double>")
    got = df.select(F.expr("robust_std(v)").alias("s")).first()["s"]
    found = np.array([v for v in values if v is not None and np.isfinite(v)])
    want = 1.4826 * np.median(np.abs(found - np.median(found))) if len(found) else None
    assert got == want or got == pytest.approx(want)


def test_period_grid_joins_laterally(spark):
    fsql.register(spark)
    spark.createDataFrame([(1, 30.0), (2, 300.0), (3, None), (4, 0.0)], "kepid long, baseline double").createOrReplaceTempView("spans")
    grid = spark.sql("SELECT kepid, k, period FROM spans, LATERAL period_grid(baseline, 0.5D, 10D, 0.5D, 2D)").toPandas()
    for kepid, baseline in ((1, 30.0), (2, 300.0)):
        n = int(np.ceil(np.log(20) / (0.5 / (2 * baseline)))) + 1
        one = grid[grid["kepid"] == kepid].sort_values("k")
        assert np.allclose(one["period"], np.exp(np.linspace(np.log(0.5), np.log(10), n)))
    assert set(grid["kepid"]) == {1, 2}
    with pytest.raises(Exception, match="0 < lo < hi"):
        spark.sql("SELECT * FROM period_grid(5D, 2D, 1D, 0.5D, 2D)").collect()


def test_sql_query_equals_its_sql(spark):
    assert difference(library.sql_functions(spark, SF), duck(SF), library.oracle_sql()["sql_functions"]) is None


def test_fits_source(spark, tmp_path, monkeypatch):
    spark.dataSource.register(FitsSource)
    for k in range(5):
        (tmp_path / f"d{k}").mkdir()
        fits_file(tmp_path / f"d{k}" / f"f{k}_llc.fits")
    (tmp_path / "note.txt").write_text("not a light curve")
    read = spark.read.format("fits").option("partitionBytes", 2 * (tmp_path / "d0/f0_llc.fits").stat().st_size)
    whole = read.load(str(tmp_path))
    assert whole.rdd.getNumPartitions() == 3 and whole.count() == 15
    columns = ["kepid", "quarter", "row", "flux", "flux_err", "quality", "file", "data_rel"]
    want = fits.read_light_curves(spark, str(tmp_path)).select("time", *columns)
    key = lambda r: (r["file"], r["row"])
    got = [tuple(r)[1:] for r in sorted(whole.select("time", *columns).collect(), key=key)]
    assert got == [tuple(r)[1:] for r in sorted(want.collect(), key=key)]
    assert [r["time"] for r in sorted(whole.filter("file = 'f0_llc.fits'").collect(), key=key)] == [1.5, None, 3.5]
    heads = read.schema("file string, kepid long, quarter long, data_rel string").load(f"file://{tmp_path}")
    assert sorted(map(tuple, heads.collect())) == [(f"f{k}_llc.fits", 757076, 4, "25") for k in range(5)]
    # Headers alone are enough for these columns: the samples may even be missing.
    data = (tmp_path / "d0/f0_llc.fits").read_bytes()
    (tmp_path / "d0/f0_llc.fits").write_bytes(data[:-2880])
    assert heads.count() == 5
    with pytest.raises(Exception, match="f0_llc.fits"):
        whole.collect()
    loose = spark.read.format("fits").option("mode", "PERMISSIVE").load(str(tmp_path))
    assert [r["file"] for r in loose.filter("error IS NOT NULL").collect()] == ["f0_llc.fits"] and loose.count() == 13
    with pytest.raises(ValueError, match="not columns"):
        from pyspark.sql.types import StructType

        FitsReader(StructType.fromDDL("colour string"), {"path": "x"})
    (tmp_path / "none").mkdir()
    assert read.load(str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("width", [3, 150, 400])
def test_sliding_medians_equal_sorted_windows(width):
    rng = np.random.default_rng(width)
    t = np.sort(np.concatenate([rng.uniform(0, 900, 900), rng.uniform(2000, 2300, 500)]))
    y = np.round(rng.normal(size=len(t)), 1)
    lo, hi = np.searchsorted(t, t - width / 2, "left"), np.searchsorted(t, t + width / 2, "right")
    got = spline.window_medians(y, lo, hi, 3)
    want = [np.median(y[a:b]) if b - a >= 3 else np.nan for a, b in zip(lo, hi)]
    assert np.array_equal(got, want, equal_nan=True)


@pytest.mark.parametrize("width", [3, 150, 400])
def test_running_medians_of_infinite_and_undefined_values(width):
    rng = np.random.default_rng(width)
    t = np.sort(np.concatenate([rng.uniform(0, 900, 900), rng.uniform(2000, 2300, 500), [1400.0, 1500.0]]))
    y = rng.choice([1.0, 2.5, -3.0, np.inf, -np.inf, np.nan], len(t), p=[0.2, 0.2, 0.1, 0.2, 0.1, 0.2])
    usable = rng.uniform(size=len(t)) < 0.9
    got = spline.running_median(t, y, width, 3, usable)
    seen, known = [np.sort(y[usable & (t >= a - width / 2) & (t <= a + width / 2)]) for a in t], {}
    with np.errstate(invalid="ignore"):
        for k, s in enumerate(seen):
            if len(s) >= 3:
                known[k] = 0.5 * (s[(len(s) - 1) // 2] + s[len(s) // 2])
        for k in range(len(t)):
            a, b = max((j for j in known if j <= k), default=None), min((j for j in known if j >= k), default=None)
            want = known[b] if a in (None, b) else known[a] if b is None else (known[b] - known[a]) / (t[b] - t[a]) * (t[k] - t[a]) + known[a]
            assert got[k] == want or np.isnan(got[k]) and np.isnan(want)


def test_sliding_medians_are_fast_on_long_windows():
    import time

    y, n = np.random.default_rng(0).normal(size=70_000), 70_000
    lo, hi = np.clip(np.arange(n) - 5000, 0, n), np.clip(np.arange(n) + 5000, 0, n)
    start = time.process_time()
    spline.window_medians(y, lo, hi, 10)
    assert time.process_time() - start < 5  # seven hundred million values if every window were sorted


def test_runs_have_names_of_their_own_and_say_where_they_come_from(spark, tmp_path):
    now, got = datetime.datetime(2024, 5, 6, 7, 8, 9, tzinfo=datetime.UTC), []
    claim = lambda: [got.append(tables.claim_run(spark, str(tmp_path / "runs"), "bls", now)) for _ in range(10)]
    threads = [threading.Thread(target=claim) for _ in range(4)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(set(got)) == 40 and "20240506T070809Z_bls" in got and "20240506T070809Z_bls_39" in got
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes(b"x" * 3_000_000)
    row = tables.write_run(spark, str(tmp_path / "runs"), got[0], "bls", spark.range(3), {"step": 2}, {"curves": str(tmp_path / "in")}).first()
    assert (row["run_id"], row["kind"], json.loads(row["config"])) == (got[0], "bls", {"step": 2}) and "spark" in json.loads(row["environment"])
    assert [(i["input"], i["length"], i["sha256"]) for i in row["inputs"]] == [("curves", 3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest())]
    assert tables.write_run(spark, str(tmp_path / "runs"), got[1], "bls", spark.range(1), {}).first()["inputs"] == []


def test_manifest_files_are_in_order(spark, tmp_path):
    row = dict.fromkeys(schemas.MANIFEST_COLUMNS)
    rng = np.random.default_rng(3)
    rows = []
    for k in rng.permutation(400).tolist():
        rows.append(row | {"kepid": k, "kepoi_name": f"K{k:05d}.01", "label": k % 2, "label_name": "", "exclusion_reason": "", "split": ("train", "val", "test")[k % 3], "star_stratum": "mixed"})
    kinds = dict(library._labelled(spark, SF).dtypes) | {"split": "string", "star_stratum": "string", "label": "tinyint"}
    manifest = spark.createDataFrame([tuple(r[c] for c in schemas.MANIFEST_COLUMNS) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in schemas.MANIFEST_COLUMNS))
    tables.write_manifest(manifest, str(tmp_path / "m"))
    parts = [[(r["split"], r["kepid"], r["kepoi_name"]) for r in part.collect()] for part in tables.read_in_order(spark, str(tmp_path / "m"))]
    flat = [r for part in parts for r in part]
    assert flat == sorted((r["split"], r["kepid"], r["kepoi_name"]) for r in rows) and len(parts) > 3


@pytest.mark.parametrize("stratify", [True, False])
def test_sampled_subset_equals_a_data_frame_sample(spark, stratify):
    names = [f"K{k:05d}.01" for k in range(300)]
    frame = pd.DataFrame({"kepoi_name": names, "label": [None if k % 7 == 0 else k % 3 % 2 for k in range(300)]})
    df = spark.createDataFrame([(n, None if pd.isna(x) else int(x)) for n, x in zip(frame["kepoi_name"], frame["label"])], "kepoi_name string, label tinyint").repartition(5)
    config = SelectionConfig(limit=31, seed=11, stratify_by_label=stratify)
    got = sorted(r["kepoi_name"] for r in selection.select_subset(df, config, order="sample").collect())
    known = frame[frame["label"].notna()]
    if stratify:
        one, zero = known[known["label"] == 1], known[known["label"] == 0]
        parts = [one.sample(n=16, random_state=11), zero.sample(n=15, random_state=11)]
    else:
        parts = [known.sample(n=31, random_state=11)]
    assert got == sorted(pd.concat(parts)["kepoi_name"])
