"""Datasets, manifests, snapshots, products and kernels that have no SQL."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark import schemas
from foldspark.config import ProductConfig, SplitConfig, StarSelectionConfig
from foldspark.operators import ranking, selection, splits, statistics
from foldspark.operators.spline import _solve_band
from foldspark.plans import benchmark
from foldspark.sources import products, tables

ROOT = Path(__file__).resolve().parents[1]


def examples(spark):
    rows = [(k, f"K{k}", ("train", "val", "test")[k % 3], "ok" if k % 4 else "insufficient_points", "train_eligible", k % 2, [float(k)] * 3) for k in range(40)]
    return spark.createDataFrame(rows, "kepid long, kepoi_name string, split string, example_status string, training_status string, label int, global_flux array<double>")


def test_dataset_round_trip_and_damage(spark, tmp_path):
    path = str(tmp_path / "set")
    log = spark.createDataFrame([(1, "ok", ""), (2, "no_lightcurve", "x")], "kepid long, status string, message string")
    document = tables.write_dataset(examples(spark), log, path, {"name": "small"})
    assert document["n_examples"] == 40 and document["n_examples_ok"] == document["n_trainable"] == 30 and document["star_status"] == {"ok": 1, "no_lightcurve": 1}
    made, stars, read = tables.load_dataset(spark, path, verify=True)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, examples(spark).collect())) and stars.count() == 2 and read["name"] == "small"
    assert not os.path.exists(path + ".building")
    with pytest.raises(FileExistsError):
        tables.write_dataset(examples(spark).limit(7), log, path)
    tables.write_dataset(examples(spark).limit(7), log, path, overwrite=True)
    assert not tables.exists(spark, f"{path}.replaced")
    assert tables.load_dataset(spark, path)[0].count() == 7
    victim = next(Path(path, "examples").glob("part-*"))
    examples(spark).limit(7).withColumn("kepid", F.col("kepid") + 1).coalesce(1).write.parquet(str(tmp_path / "other"))
    shutil.copy(next((tmp_path / "other").glob("part-*")), victim)
    for crc in Path(path, "examples").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="checksums"):
        tables.load_dataset(spark, path, verify=True)
    with pytest.raises(ValueError, match="needs examples"):
        tables.write_dataset(examples(spark).limit(0), log, str(tmp_path / "none"))


def test_manifest_of_a_subset(spark, tmp_path):
    rows = spark.createDataFrame([(1, "K1", "planet"), (1, "K2", ""), (2, "K3", "false_positive")], "kepid long, kepoi_name string, label_name string")
    document = tables.write_koi_manifest(rows, str(tmp_path / "m"), {"limit": 3}, {"table": "t", "other": 1})
    assert (document["n_kois"], document["n_targets"]) == (3, 2) and document["label_counts"] == {"planet": 1, "excluded": 1, "false_positive": 1}
    assert document["catalog"]["table"] == "t" and "other" not in document["catalog"]
    tables.verify_hashes(spark, str(tmp_path / "m/signals"), document["sha256"])


def test_snapshot_is_fetched_once_and_checked(spark, tmp_path):
    calls = []
    row = {f.name: None for f in schemas.CATALOG} | {"kepid": 7, "kepoi_name": "K7"}

    def fetch():
        calls.append(1)
        return spark.createDataFrame([tuple(row[f.name] for f in schemas.CATALOG)], schemas.CATALOG)

    path = str(tmp_path / "catalog")
    first, document, there = tables.cached_catalog(spark, path, fetch)
    again, _, cached = tables.cached_catalog(spark, path, fetch)
    assert (there, cached, len(calls)) == (False, True, 1) and first.collect() == again.collect() and document["n_rows"] == 1
    tables.cached_catalog(spark, path, fetch, refresh=True)
    assert len(calls) == 2
    with pytest.raises(schemas.SchemaError):
        tables.cached_catalog(spark, str(tmp_path / "bad"), lambda: fetch().drop("koi_period"))
    assert tables.exists(spark, path) and not tables.exists(spark, str(tmp_path / "nothing"))


def test_a_dataset_is_moved_aside_until_the_new_one_stands(spark, tmp_path):
    made, path = str(tmp_path / "made"), str(tmp_path / "data")
    for folder, n in ((path, 3), (f"{path}.replaced", 1)):
        spark.range(n).write.parquet(folder)
    with pytest.raises(FileNotFoundError):
        tables.replace(spark, made, path)  # nothing was made, so nothing is moved
    assert spark.read.parquet(path).count() == 3
    spark.range(5).write.parquet(made)
    tables.replace(spark, made, path)
    assert spark.read.parquet(path).count() == 5 and not tables.exists(spark, f"{path}.replaced")


def test_splits_of_another_snapshot_are_refused():
    tables.same_snapshot({"sha256": {"a": "1"}}, {"source_catalog": {"sha256": {"a": "1"}}})
    for other in ({"source_catalog": {"sha256": {"a": "2"}}}, {}):
        with pytest.raises(ValueError, match="another catalog snapshot"):
            tables.same_snapshot({"sha256": {"a": "1"}}, other)


def test_fetch_outcomes(spark):
    found = spark.createDataFrame([(1, 1, "a", 10), (2, 1, "b", 900), (2, 2, "c", None), (3, 1, "d", 10)], "kepid long, quarter int, filename string, size_bytes long")
    policy = products.policy_of(ProductConfig())
    manifests = spark.createDataFrame([(1, policy, "a"), (3, policy, "d"), (3, policy, "gone"), (5, "old", "a")], "kepid long, policy string, filename string")
    files = spark.createDataFrame([("a",), ("d",)], "filename string")
    targets = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "kepid long")
    got = {r["kepid"]: (r["status"], r["n_products"], r["needed_bytes"]) for r in products.fetch_status(targets, manifests, found, files, budget=500).collect()}
    assert got == {1: ("cached", 1, 0), 2: ("error", 2, 900), 3: ("download", 1, 0), 4: ("no_products", 0, 0), 5: ("no_products", 0, 0)}


@pytest.mark.parametrize("n", [1, 4, 47, 48, 49, 130, 500])
def test_band_solver_equals_a_dense_one(n):
    rng = np.random.default_rng(n)
    low = np.tril(np.triu(rng.normal(size=(n, n)), -3)) + 5 * np.eye(n)
    full, right = low @ low.T, rng.normal(size=n)
    band = np.array([[full[j + d, j] if j + d < n else 0.0 for j in range(n)] for d in range(4)])
    assert np.allclose(_solve_band(band, right), np.linalg.solve(full, right))
    band[:, n // 2] = 0
    assert _solve_band(band * 0, right) is None


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=501), 1).tolist()
    df = spark.createDataFrame([(v, None if k % 9 == 0 else v * v) for k, v in enumerate(values)], "a double, b double")
    got = {r["variable"]: r for r in ranking.quantiles(df, ["a", "b"], [0.1, 0.5, 0.93]).collect()}
    for name, known in (("a", values), ("b", [v * v for k, v in enumerate(values) if k % 9])):
        assert got[name]["n"] == len(known) and np.allclose([got[name][f"q{k}"] for k in range(3)], np.quantile(known, [0.1, 0.5, 0.93]))
    assert statistics.ratio_summary(df, "b", "a").first()["median_a"] == pytest.approx(np.median(values))


def test_generated_choice_of_stars(spark):
    labelled = spark.createDataFrame([(k, f"K{k}", ("train", "val", "test")[k % 3], ("pos_only", "neg_only")[k // 3 % 2]) for k in range(300)], "kepid long, kepoi_name string, split string, star_stratum string")
    config = StarSelectionConfig(n_stars=40, include_kepids=(5,), seed=11)
    got = {r["kepid"]: r["selection_reason"] for r in selection.select_stars(labelled, config, order="generator").collect()}
    sizes = splits.cut_sizes(40, SplitConfig().fractions)
    want = {5}
    for s, split in enumerate(splits.SPLITS):
        for p, n in enumerate(splits.cut_sizes(sizes[split], dict.fromkeys(selection.POOLS, 0.5)).values()):
            pool = sorted(k for k in range(300) if k != 5 and ("train", "val", "test")[k % 3] == split and k // 3 % 2 == p)
            want |= {pool[i] for i in np.random.default_rng([11, s, p]).choice(len(pool), size=min(n, len(pool)), replace=False)}
    assert set(got) == want and got[5] == "include_kepids"


def test_cadences_are_two_quarters():
    t = benchmark.cadences()
    assert t[0] == 0.0 and (np.diff(t) > 0).all() and (np.diff(t) > 1).sum() == 1 and t[-1] < 175.0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    for name in ("foldspark", "tests", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "foldspark" / "llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'detrend_fold_bin' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    shown = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert shown.returncode == 0 and int(shown.stdout) > 60, shown.stderr
