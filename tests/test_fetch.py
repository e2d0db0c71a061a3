"""The running budget, stored downloads and discovery."""

from __future__ import annotations

import hashlib
import json
import os
import time
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from foldspark import queries as library
from foldspark import schemas
from foldspark.config import ProductConfig
from foldspark.operators.budget import spend
from foldspark.sources import discovery, products

from .compare import difference, duck

SF = "/root/testdata/sf0.001"


def in_turn(rows: list[tuple[int, int, int]], budget: int) -> dict[int, tuple[bool, int]]:
    left, out = budget, {}
    for key, need, cost in sorted(rows):
        out[key] = need <= left, left
        left -= cost if need <= left else 0
    return out


def spent(spark, rows: list[tuple[int, int, int]], budget: int) -> dict[int, tuple[bool, int]]:
    df = spark.createDataFrame(rows, "k long, need long, cost long")
    return {r["k"]: (r["fits"], r["left_before"]) for r in spend(df, budget, "k", "need", "cost", tasks=3).collect()}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(needs=st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6)), min_size=1, max_size=60), budget=st.integers(0, 300))
def test_budget_equals_taking_rows_in_turn(spark, needs, budget):
    rows = [(7 * k, need, need + more) for k, (need, more) in enumerate(needs)]
    assert spent(spark, rows, budget) == in_turn(rows, budget)


@pytest.mark.parametrize("budget", [0, 1, 99, 100, 101, 4950, 10**12])
def test_budget_of_sizes_that_shrink_as_it_does(spark, budget):
    # After each small row the next large one just doesn't fit any more.
    rows = [row for k in range(100) for row in ((2 * k, 1, 1), (2 * k + 1, 100 - k, 100 - k))]
    assert spent(spark, rows, budget) == in_turn(rows, budget)


def test_budget_of_many_stars_takes_few_steps(spark, monkeypatch):
    from pyspark.sql import functions as F

    from foldspark.operators import budget as module

    calls, summed = [], module._upto
    monkeypatch.setattr(module, "_upto", lambda *a: calls.append(1) or summed(*a))
    rows = spark.range(1_000_000).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(9_000_000)) + 1).alias("need"))
    got = spend(rows, 2_500_000_000_000, "k", "need").agg(F.count_if("fits").alias("n"), F.sum(F.when(F.col("fits"), F.col("need"))).alias("total"), F.min("left_before").alias("least")).first()


    needs = rows.orderBy("k").toPandas()["need"]
    left, n = 2_500_000_000_000, 0
    for need in needs.tolist():
        if need <= left:
            left, n = left - need, n + 1
    assert (got["n"], 2_500_000_000_000 - got["total"]) == (n, left) and len(calls) <= 43


def test_budget_refuses_negative_needs(spark):
    with pytest.raises(ValueError):
        spend(spark.createDataFrame([(1, -1)], "k long, need long"), 5, "k", "need")
    with pytest.raises(ValueError):
        spend(spark.createDataFrame([(1, 3, 2)], "k long, need long, cost long"), 5, "k", "need", "cost")
    assert spend(spark.createDataFrame([], "k long, need long"), 5, "k", "need").count() == 0


@pytest.mark.parametrize("name", ["running_budget", "fetch_plan", "stored_fetch"])
def test_query_equals_its_sql(spark, name):
    assert difference(library.queries()[name](spark, SF), duck(SF), library.oracle_sql()[name]) is None


def test_plan_says_what_is_left(spark):
    found = spark.createDataFrame([(1, 1, "a", 3_000_000), (2, 1, "b", 9_000_000), (3, 1, "c", 2_000_000), (4, 1, "d", None)], "kepid long, quarter int, filename string, size_bytes long")
    none = spark.createDataFrame([], "kepid long, policy string, filename string")
    targets = spark.createDataFrame([(k, 10 - k) for k in (1, 2, 3, 4, 5)], "kepid long, turn long")
    files = spark.createDataFrame([], "filename string")
    got = {r["kepid"]: (r["status"], r["left_bytes"], r["message"]) for r in products.plan_fetch(targets, none, found, files, 10_000_000, ProductConfig(), order="turn").collect()}
    assert got == {
        5: ("no_products", None, ""), 4: ("download", 10_000_000, ""), 3: ("download", 10_000_000, ""),
        2: ("error", 8_000_000, "download of 9.0 MB exceeds remaining budget 8.0 MB"), 1: ("download", 8_000_000, ""),
    }


def _wanted(spark, rows):
    return spark.createDataFrame(rows, "kepid long, quarter int, filename string, data_uri string, size_bytes long")


WANTED = [(1, 1, "a.fits", "good-a", 6), (1, 2, "b.fits", "bad-b", 5), (1, 3, "c.fits", "good-c", 6), (2, 1, "d.fits", "good-d", None)]


def test_fetch_stores_files_and_goes_on_where_it_stopped(spark, tmp_path):
    root, log = f"file://{tmp_path}/store", str(tmp_path / "calls")

    def download(uri, bad=("bad-b",)):
        with open(log, "a") as out:
            out.write(f"{uri}\n")
        if uri in bad:
            raise OSError("refused")
        return (piece for piece in (uri[:2].encode(), uri[2:].encode()))

    calls = lambda: sorted(Path(log).read_text().split())
    first = {r["kepid"]: tuple(r)[1:] for r in products.fetch(_wanted(spark, WANTED), root, download, "p").collect()}
    assert first == {1: ("error", 1, 1, 6, "download failed: refused"), 2: ("downloaded", 1, 1, 6, None)}
    assert sorted(str(p.relative_to(tmp_path / "store")) for p in Path(f"{tmp_path}/store").rglob("*") if p.is_file()) == ["kic_000000001/a.fits", "kic_000000002/d.fits", "kic_000000002/products.json"]
    assert [(r["kepid"], r["filename"]) for r in products.read_manifests(spark, root).collect()] == [(2, "d.fits")]
    assert calls() == ["bad-b", "good-a", "good-d"]
    again = {r["kepid"]: tuple(r)[1:] for r in products.fetch(_wanted(spark, WANTED), root, lambda uri: download(uri, ()), "p").collect()}
    assert again == {1: ("downloaded", 3, 2, 11, None), 2: ("downloaded", 1, 0, 0, None)}
    # Only what was absent is asked for: the failed file and the one after it.
    assert calls() == ["bad-b", "bad-b", "good-a", "good-c", "good-d"]
    rows = {r["filename"]: (r["stored_bytes"], r["sha256"], r["size_bytes"], r["policy"]) for r in products.read_manifests(spark, root).collect()}
    assert rows["b.fits"] == (5, hashlib.sha256(b"bad-b").hexdigest(), 5, "p") and rows["d.fits"][2] is None and len(rows) == 4
    stored = products.stored_files(spark, root)
    assert sorted((r["kepid"], r["filename"], r["length"]) for r in stored.collect()) == [(1, "a.fits", 6), (1, "b.fits", 5), (1, "c.fits", 6), (2, "d.fits", 6)]
    manifests = products.read_manifests(spark, root)
    assert {r["kepid"]: r["n_products"] for r in products.cached_products(manifests, stored, "p").collect()} == {1: 3, 2: 1}
    assert products.damaged_files(manifests, root).count() == 0
    Path(f"{tmp_path}/store/kic_000000001/a.fits").write_bytes(b"other!")
    os.remove(f"{tmp_path}/store/kic_000000002/d.fits")
    assert sorted(map(tuple, products.damaged_files(manifests, root).collect())) == [(1, "a.fits", "differs"), (2, "d.fits", "missing")]
    assert {r["kepid"] for r in products.cached_products(manifests, products.stored_files(spark, root), "p").collect()} == {1}


def test_a_download_that_breaks_off_leaves_no_file(spark, tmp_path):
    def download(uri):
        yield b"half"
        raise OSError("line lost")

    got = products.fetch(_wanted(spark, [(3, 1, "x.fits", "u", 9)]), f"file://{tmp_path}", download).first()
    assert (got["status"], got["n_products"], got["message"]) == ("error", 0, "download failed: line lost")
    assert os.listdir(tmp_path / "kic_000000003") == []


def test_discovery_notices_changes(spark, tmp_path):
    raw, done = str(tmp_path / "raw"), str(tmp_path / "done")
    assert discovery.downloaded_stars(spark, raw).count() == 0 and discovery.processed_stars(spark, done).count() == 0
    for kepid, name in ((5, "products.json"), (6, "a.fits"), (7, "products.json")):
        os.makedirs(f"{raw}/kic_{kepid:09d}", exist_ok=True)
        Path(f"{raw}/kic_{kepid:09d}/{name}").write_text(json.dumps({"kepid": kepid}))
    os.makedirs(f"{raw}/other")
    Path(f"{raw}/other/products.json").write_text("{}")
    for kepid in (5, 8):
        spark.range(3).repartition(2).write.parquet(f"{done}/kic_{kepid:09d}/lightcurve.parquet")
    header = ",".join(schemas.CATALOG_COLUMNS)
    line = lambda kepid, name: ",".join({"kepid": str(kepid), "kepoi_name": name, "koi_disposition": "CONFIRMED", "koi_pdisposition": "CANDIDATE"}.get(c, "") for c in schemas.CATALOG_COLUMNS)
    path = tmp_path / "catalog.csv"
    found = discovery.Discovery(spark, str(path), raw, done)
    assert found.catalog() is None
    assert {tuple(r) for r in found.targets().collect()} == {(5, 0, True, True), (7, 0, True, False), (8, 0, False, True)}
    path.write_text(f"{header}\n{line(5, 'K5.01')}\n{line(5, 'K5.02')}\n{line(9, 'K9.01')}\n")
    first = found.catalog()
    assert found.catalog() is first and {r["label"] for r in first.collect()} == {1}
    assert {tuple(r) for r in found.targets().collect()} == {(5, 2, True, True), (7, 0, True, False), (8, 0, False, True), (9, 1, False, False)}
    before = spark.createDataFrame(discovery.list_files(spark, raw, "kic_*/*").collect(), discovery.FILES)
    time.sleep(0.05)
    path.write_text(f"{header}\n{line(5, 'K5.01')}\n")
    Path(f"{raw}/kic_000000006/products.json").write_text("{}")
    Path(f"{raw}/kic_000000005/products.json").write_text(json.dumps({"kepid": 5, "more": 1}))
    os.remove(f"{raw}/kic_000000007/products.json")
    assert found.catalog() is not first and {tuple(r) for r in found.targets().collect()} == {(5, 1, True, True), (6, 0, True, False), (8, 0, False, True)}
    change = discovery.changes(before, discovery.list_files(spark, raw, "kic_*/*"))
    assert {(r["kepid"], r["path"].rsplit("/", 1)[1], r["change"]) for r in change.collect()} == {(5, "products.json", "changed"), (6, "products.json", "added"), (7, "products.json", "removed")}


def test_manifests_of_given_stars_are_those_of_the_listing(spark, tmp_path):
    root = f"file://{tmp_path}/stars"
    rows = [(1, 2, "b", "x:b", 3), (1, 1, "a", "x:a", None), (2, None, "c", "x:c", 4)]
    wanted = spark.createDataFrame(rows, "kepid long, quarter int, filename string, data_uri string, size_bytes long")
    done = products.fetch(wanted, root, lambda uri: uri.encode(), "p")
    # What has just been written is hashed on its way and not read again.
    listed = sorted(map(str, products.read_manifests(spark, root).collect()))
    more = done.select("kepid").union(spark.createDataFrame([(9,)], "kepid long"))
    assert sorted(map(str, products.read_manifests(spark, root, more).collect())) == listed and len(listed) == 3
    assert {(r["filename"], r["stored_bytes"]) for r in products.read_manifests(spark, root, done).collect()} == {("a", 3), ("b", 3), ("c", 3)}
