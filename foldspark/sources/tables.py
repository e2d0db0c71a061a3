"""Catalogs, processed curves, manifests, datasets and run documents as files."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import platform
import re
import urllib.parse
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldspark import schemas

_NAME = re.compile(r"[A-Za-z0-9_]+")
_RUN = re.compile(r"[a-z0-9][a-z0-9_-]*", re.IGNORECASE)


def select_query(table: DataFrame, columns: list[str], where: str | None = None, order_by: str | None = None) -> DataFrame:
    """A projection of a source; the condition and the order are SQL text, the columns plain identifiers."""
    for name in columns:
        if not _NAME.fullmatch(name):
            raise ValueError(f"not an identifier: {name!r}")
    rows = table if where is None else table.filter(F.expr(where))
    rows = rows.select(*columns)
    return rows if order_by is None else rows.orderBy(*(F.expr(o.strip()) for o in order_by.split(",")))


def read_catalog(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """The signal catalog with its fixed types. A CSV is checked by its header and read strictly; NaN becomes null."""
    if format == "csv":
        header = spark.read.option("header", "true").option("inferSchema", "false").csv(path).columns
        found = T.StructType([f if f.name in header else None for f in schemas.CATALOG if f.name in header])
        missing = [c for c in schemas.CATALOG_COLUMNS if c not in header]
        if missing:
            raise schemas.SchemaError(f"missing columns: {missing}")
        by_name = {f.name: f for f in found}
        order = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in header])
        rows = spark.read.option("header", "true").option("mode", "FAILFAST").schema(order).csv(path)
    else:
        rows = schemas.require(spark.read.format(format).load(path), *schemas.CATALOG_COLUMNS)
    doubles = {f.name for f in schemas.CATALOG if isinstance(f.dataType, T.DoubleType)}
    return rows.select(*(F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in doubles else F.col(c) for c in schemas.CATALOG_COLUMNS))


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file under a path.

    Spark lists the files; tasks read them piece by piece, so a file of any size passes. Stores that Arrow doesn't reach
    are read by Spark, file by file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    try:
        fs.FileSystem.from_uri(_address(path))
    except (pa.ArrowInvalid, OSError):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = []
            for name in batch["path"]:
                store, place = fs.FileSystem.from_uri(name)
                hashed = hashlib.sha256()
                with store.open_input_stream(place) as stream:
                    while piece := stream.read(1 << 20):
                        hashed.update(piece)
                hashes.append(hashed.hexdigest())
            yield batch.assign(sha256=hashes)

    return files.select("path", "length").repartition("path").mapInPandas(digest, "path string, length long, sha256 string")


def _address(path: str) -> str:
    return path if re.match(r"[a-z][a-z0-9+.-]*:", path) else f"file://{path}"


def verify_hashes(spark: SparkSession, path: str, expected: dict[str, str]) -> None:
    """Compare files' hashes (by name) with the recorded ones; a difference or a missing file is an error."""
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in content_hashes(spark, path).select("path", "sha256").toLocalIterator()}
    wrong = sorted(n for n, h in expected.items() if found.get(n) != h)
    if wrong:
        raise ValueError(f"checksums differ: {wrong}")


def write_by_star(processed: DataFrame, path: str, files: int = 64) -> None:
    """Processed curves clustered by star, so that one star's read opens one file and skips its other row groups."""
    processed.repartition(files, "kepid").sortWithinPartitions("kepid", "time_bkjd").write.mode("overwrite").parquet(path)


MANIFEST_ORDER = ("split", "kepid", "kepoi_name")


def write_manifest(manifest: DataFrame, path: str, files: int = 8) -> dict:
    """The split manifest as Parquet by split, after its leakage check; an existing one is never overwritten.

    Rows are dealt to at most ``files`` files by ranges of split, star and name and sorted within them, so the files of a
    split in the order of their names hold its rows in order. ``read_in_order`` relies on it.
    """
    from foldspark.operators.splits import check_no_leakage, split_summary

    spark = manifest.sparkSession
    if exists(spark, path):
        raise FileExistsError(f"{path} exists already")
    check_no_leakage(manifest)
    ordered = manifest.repartitionByRange(files, *MANIFEST_ORDER).sortWithinPartitions(*MANIFEST_ORDER)
    ordered.write.partitionBy("split").mode("errorifexists").parquet(path)
    return {r["split"]: r.asDict() for r in split_summary(read_manifest(spark, path)).collect()}  # three rows


def read_manifest(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """A manifest back in its own column order; with ``verify`` its leakage check runs again."""
    rows = spark.read.parquet(path).withColumn("label", F.col("label").cast("tinyint"))
    for c in ("label_name", "exclusion_reason"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit("")))
    rows = rows.select(*schemas.MANIFEST_COLUMNS)
    if verify:
        from foldspark.operators.splits import check_no_leakage

        check_no_leakage(rows)
    return rows


def read_in_order(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """The files of a written manifest, one DataFrame each, in the order that makes their rows sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    for r in found.orderBy("path").collect():  # a handful of files
        yield spark.read.option("basePath", path).parquet(r["path"]).select(*schemas.MANIFEST_COLUMNS)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system): any store that Spark reads."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads exists."""
    place, store = _file_system(spark, path)
    return store.exists(place)


def replace(spark: SparkSession, made: str, path: str) -> None:
    """Put a finished folder in the place of another one, which is moved aside first and deleted last.

    If the work stops in between, the former folder is there under ``<path>.replaced``; the next call clears that up.
    """
    place, store = _file_system(spark, path)
    aside, new = _file_system(spark, f"{path}.replaced")[0], _file_system(spark, made)[0]
    if not store.exists(new):
        raise FileNotFoundError(f"{made} isn't there")
    if store.exists(place):
        if store.exists(aside):
            store.delete(aside, True)
        if not store.rename(place, aside):
            raise OSError(f"{path} could not be moved aside")
    if not store.rename(new, place):
        raise OSError(f"{made} could not be renamed to {path}")
    if store.exists(aside):
        store.delete(aside, True)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    """A JSON document as a folder of one text file, which Spark commits as a whole."""
    text = json.dumps(document, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])


def write_koi_manifest(subset: DataFrame, path: str, selection: dict, catalog: dict) -> dict:
    """The signals of a subset as CSV and, beside it, a document of where they come from; the document is returned."""
    spark = subset.sparkSession
    subset.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/signals")
    rows = spark.read.option("header", "true").csv(f"{path}/signals")
    name = F.coalesce(F.col("label_name"), F.lit("excluded")).alias("label_name")
    totals = rows.agg(F.count("*").alias("n_kois"), F.count_distinct("kepid").alias("n_targets")).first()
    document = {
        "created_at_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "selection": selection, **totals.asDict(),
        "label_counts": {r["label_name"]: r["count"] for r in rows.groupBy(name).count().collect()},
        "catalog": {k: catalog.get(k) for k in ("table", "query", "retrieved_at_utc", "sha256", "n_rows")},
        "sha256": {r["name"]: r["sha256"] for r in _checksums(spark, f"{path}/signals").collect()},
    }
    write_document(spark, f"{path}/provenance", document)
    return document


def _checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of each data file of a table."""
    files = content_hashes(spark, path).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return files.filter("NOT startswith(name, '_') AND NOT startswith(name, '.')").select("name", "sha256")


def cached_catalog(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], refresh: bool = False) -> tuple[DataFrame, dict, bool]:
    """(catalog, its document, whether it was there): a snapshot that is fetched once and then read back.

    A snapshot counts if table and document exist and no refresh is asked for; its files must match their checksums.
    """
    if exists(spark, f"{path}/table") and exists(spark, f"{path}/document") and not refresh:
        document = read_document(spark, f"{path}/document")
        verify_hashes(spark, f"{path}/table", document["sha256"])
        return read_catalog(spark, f"{path}/table", "parquet"), document, True
    fetched = schemas.require(fetch(), *schemas.CATALOG_COLUMNS)
    fetched.write.mode("overwrite").parquet(f"{path}/table")
    made = spark.read.parquet(f"{path}/table")
    totals = made.agg(F.count("*").alias("n_rows"), F.count_distinct("kepid").alias("n_unique_kepid")).first().asDict()
    document = {
        "retrieved_at_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), **totals, "columns": made.columns,
        "sha256": {r["name"]: r["sha256"] for r in _checksums(spark, f"{path}/table").collect()},
    }
    write_document(spark, f"{path}/document", document)
    return read_catalog(spark, f"{path}/table", "parquet"), document, False


def same_snapshot(catalog: dict, splits: dict) -> None:
    """Splits count only with the catalog that they were made from: the checksums of both documents must be equal."""
    if catalog.get("sha256") != splits.get("source_catalog", {}).get("sha256"):
        raise ValueError("the splits were made from another catalog snapshot")


def write_dataset(examples: DataFrame, log: DataFrame, path: str, info: dict | None = None, overwrite: bool = False) -> dict:
    """A built dataset: examples with their arrays, the log of stars, checksums and a document of counts.

    Everything is written beside the path and takes its place when it is whole, so a reader never sees a part. One that is
    there is replaced only if asked for, which is checked before anything is computed.
    """
    if not overwrite and exists(examples.sparkSession, path):
        raise FileExistsError(f"{path} exists already")
    spark, stage = examples.sparkSession, f"{path}.building"
    examples.write.mode("overwrite").parquet(f"{stage}/examples")
    log.write.mode("overwrite").parquet(f"{stage}/log")
    made, stars = spark.read.parquet(f"{stage}/examples"), spark.read.parquet(f"{stage}/log")
    counts = [r.asDict() for r in dataset_counts(made).collect()]
    total = sum(r["n"] for r in counts)
    if not total:
        raise ValueError("a dataset needs examples")
    _checksums(spark, f"{stage}/examples").write.mode("overwrite").parquet(f"{stage}/checksums")
    document = {
        **(info or {}), "created_at_utc": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds"), "n_examples": total,
        "n_examples_ok": sum(r["n"] for r in counts if r["example_status"] == "ok"), "counts": counts,
        "n_trainable": sum(r["n"] for r in counts if r["example_status"] == "ok" and r["training_status"] == "train_eligible"),
        "star_status": {r["status"]: r["count"] for r in stars.groupBy("status").count().collect()},
    }
    write_document(spark, f"{stage}/document", document)
    replace(spark, stage, path)
    return document


def load_dataset(spark: SparkSession, path: str, verify: bool = False) -> tuple[DataFrame, DataFrame, dict]:
    """(examples, log, document) of a written dataset, whose rows must be as many as the document says.

    With ``verify`` every file's checksum is compared as well, as a join of two tables.
    """
    document = read_document(spark, f"{path}/document")
    examples = spark.read.parquet(f"{path}/examples")
    if examples.count() != document["n_examples"]:
        raise ValueError("examples and document disagree on the number of examples")
    if verify:
        known = spark.read.parquet(f"{path}/checksums").withColumnRenamed("sha256", "known")
        wrong = _checksums(spark, f"{path}/examples").join(known, "name", "full").filter(~F.col("sha256").eqNullSafe(F.col("known")))
        if not wrong.isEmpty():
            raise ValueError(f"files that don't match their checksums: {[r['name'] for r in wrong.limit(20).collect()]}")
    return examples, spark.read.parquet(f"{path}/log"), document


def dataset_counts(examples: DataFrame) -> DataFrame:
    """(split, example_status, training_status, label, n, n_stars) of a built dataset."""
    return examples.groupBy("split", "example_status", "training_status", "label").agg(F.count("*").alias("n"), F.count_distinct("kepid").alias("n_stars"))


def run_id(name: str, taken: set[str] = frozenset(), now: datetime.datetime | None = None) -> str:
    """``<UTC time>_<name>``, with a number where that is taken."""
    if not _RUN.fullmatch(name):
        raise ValueError(f"not a run name: {name!r}")
    first = f"{(now or datetime.datetime.now(datetime.UTC)):%Y%m%dT%H%M%SZ}_{name}"
    found, k = first, 1
    while found in taken:
        found, k = f"{first}_{k}", k + 1
    return found


def claim_run(spark: SparkSession, root: str, name: str, now: datetime.datetime | None = None) -> str:
    """The name of a new run folder under ``root`` that no other writer has or will get.

    The folder is made by an operation that fails where it exists: a directory on a local disk, elsewhere a claim file
    created without overwriting.
    """
    taken: set[str] = set()
    now = now or datetime.datetime.now(datetime.UTC)
    while True:
        run = run_id(name, taken, now)
        if _claimed(spark, f"{root.rstrip('/')}/{run}"):
            return run
        taken.add(run)


def _claimed(spark: SparkSession, folder: str) -> bool:
    address = urllib.parse.urlparse(_address(folder))
    if address.scheme == "file":
        os.makedirs(os.path.dirname(address.path), exist_ok=True)
        try:
            os.mkdir(address.path)
        except FileExistsError:
            return False
        return True
    place, store = _file_system(spark, f"{folder}/_claim")
    try:
        store.create(place, False).close()
    except Py4JJavaError as problem:
        if "FileAlreadyExists" in str(problem.java_exception):
            return False
        raise
    return True


def write_run(spark: SparkSession, root: str, run: str, kind: str, results: DataFrame, config: dict, inputs: dict[str, str] | None = None) -> DataFrame:
    """A claimed run's results and one row of where they come from; the row is returned.

    The row has the configuration, versions of what ran, and for each input by name its files with their hashes.
    """
    folder = f"{root.rstrip('/')}/{run}"
    results.write.parquet(f"{folder}/results")
    environment = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "numpy": np.__version__, "pandas": pd.__version__, "pyarrow": pa.__version__}
    row = spark.createDataFrame([(run, kind, datetime.datetime.now(datetime.UTC), json.dumps(config, sort_keys=True, default=str), json.dumps(environment, sort_keys=True))], "run_id string, kind string, created_at timestamp, config string, environment string")
    hashes = None
    for label, path in sorted((inputs or {}).items()):
        one = content_hashes(spark, path).filter("NOT startswith(element_at(split(path, '/'), -1), '_')").select(F.lit(label).alias("input"), "path", "length", "sha256")
        hashes = one if hashes is None else hashes.unionByName(one)
    empty = F.array().cast("array<struct<input: string, path: string, length: bigint, sha256: string>>")
    if hashes is None:
        row = row.withColumn("inputs", empty)
    else:
        listed = hashes.agg(F.array_sort(F.collect_list(F.struct("input", "path", "length", "sha256"))).alias("inputs"))
        row = row.join(F.broadcast(listed))  # one row each
    row.coalesce(1).write.parquet(f"{folder}/provenance")
    return spark.read.parquet(f"{folder}/provenance")
