"""Data products of stars: which are stored already, and what fetching the others comes to.

Manifests, search results and stored files are tables; only the bytes of a product come from an injected function, and
executors write them to the shared store.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.config import ProductConfig
from foldspark.lineage import settle
from foldspark.operators.budget import spend
from foldspark.operators.selection import select_products
from foldspark.sources.discovery import list_files


def policy_of(config: ProductConfig) -> str:
    """The product policy as text: manifests made under another one don't count."""
    return ";".join(f"{k}={v}" for k, v in sorted(asdict(config).items()))


def cached_products(manifests: DataFrame, files: DataFrame, policy: str) -> DataFrame:
    """(kepid, n_products): stars whose manifest has this policy and whose products are all stored.

    ``manifests`` is (kepid, policy, filename), a row a product (null for a manifest without any), ``files`` (filename).
    """
    stored = files.select("filename").distinct().withColumn("_stored", F.lit(True))
    own = manifests.filter(F.col("policy") == policy).join(stored, "filename", "left")
    there = F.col("filename").isNull() | F.coalesce("_stored", F.lit(False))
    return own.groupBy("kepid").agg(F.every(there).alias("_all"), F.count("filename").alias("n_products")).filter("_all").drop("_all")


def fetch_status(targets: DataFrame, manifests: DataFrame, found: DataFrame, files: DataFrame, config: ProductConfig | None = None, policy: str | None = None, budget: float | None = None) -> DataFrame:
    """(kepid, status, n_products, needed_bytes) of each target.

    ``cached`` stars need nothing. Of the products found for another star those that the policy selects are wanted, and
    only files that aren't stored are needed: ``no_products`` if none is selected, ``error`` if the star needs more than
    the ``budget`` that is left (a size that is unknown counts as 0), else ``download``.
    """
    config = config or ProductConfig()
    cached = cached_products(manifests, files, policy or policy_of(config)).withColumnRenamed("n_products", "_cached")
    stored = files.select("filename").distinct().withColumn("_stored", F.lit(True))
    chosen = select_products(found.join(targets, "kepid", "left_semi"), config).join(stored, "filename", "left")
    needed = F.sum(F.when(F.col("_stored").isNull(), F.coalesce("size_bytes", F.lit(0))).otherwise(0)).alias("needed_bytes")
    wanted = chosen.groupBy("kepid").agg(F.count("*").alias("_chosen"), needed)
    rows = targets.select("kepid").distinct().join(cached, "kepid", "left").join(wanted, "kepid", "left")
    over = F.lit(False) if budget is None else F.col("needed_bytes") > budget
    status = F.when(F.col("_cached").isNotNull(), "cached").when(F.col("_chosen").isNull(), "no_products").when(over, "error").otherwise("download")
    rows = rows.withColumn("status", status)
    is_cached = F.col("status") == "cached"
    return rows.select(
        "kepid", "status", F.coalesce(F.when(is_cached, F.col("_cached")).otherwise(F.col("_chosen")), F.lit(0)).alias("n_products"),
        F.coalesce(F.when(~is_cached, F.col("needed_bytes")), F.lit(0)).cast("long").alias("needed_bytes"),
    )


def plan_fetch(targets: DataFrame, manifests: DataFrame, found: DataFrame, files: DataFrame, budget: int, config: ProductConfig | None = None, policy: str | None = None, order: str = "kepid") -> DataFrame:
    """(kepid, status, n_products, needed_bytes, left_bytes, message): what a batch does with each target in turn.

    Targets are taken by ``order``, a unique whole number. One that must be fetched needs the bytes of its files that
    aren't stored and, once it fits what is left of the ``budget``, uses up those of all its selected products; one that
    needs more is an ``error`` and is passed over, and a smaller one after it may still fit.
    """
    config = config or ProductConfig()
    rows = fetch_status(targets, manifests, found, files, config, policy)
    chosen = select_products(found.join(targets, "kepid", "left_semi"), config)
    costs = chosen.groupBy("kepid").agg(F.sum(F.coalesce("size_bytes", F.lit(0))).cast("long").alias("_cost"))
    places = targets.select("kepid", F.col(order).cast("long").alias("_place"))
    wanted = rows.filter("status = 'download'").join(places, "kepid").join(costs, "kepid")
    spent = spend(wanted, budget, "_place", "needed_bytes", "_cost")
    over = F.format_string("download of %.1f MB exceeds remaining budget %.1f MB", F.col("needed_bytes") / 1e6, F.col("left_before") / 1e6)
    status = F.when(F.col("fits"), "download").otherwise("error")
    turned = spent.select("kepid", status.alias("status"), "n_products", "needed_bytes", F.col("left_before").alias("left_bytes"), F.when(~F.col("fits"), over).otherwise(F.lit("")).alias("message"))
    others = rows.filter("status <> 'download'").select("kepid", "status", "n_products", "needed_bytes", F.lit(None).cast("long").alias("left_bytes"), F.lit("").alias("message"))
    return turned.unionByName(others)


# Stored products: <root>/kic_<nine digits>/<filename>, and a manifest beside them once all of a star's are there.

MANIFEST = "products.json"
_STORED = "filename: string, data_uri: string, quarter: int, size_bytes: long, stored_bytes: long, sha256: string"
_MANIFEST = f"kepid long, policy string, retrieved_at_utc string, products array<struct<{_STORED}>>"
_PIECE = 1 << 20


def star_folder(kepid: int) -> str:
    if kepid < 0:
        raise ValueError("a star's number can't be negative")
    return f"kic_{kepid:09d}"


def _digest(store: fs.FileSystem, path: str) -> tuple[int, str]:
    """Length and hash of a stored file, read piece by piece."""
    total, hashed = 0, hashlib.sha256()
    with store.open_input_stream(path) as stream:
        while piece := stream.read(_PIECE):
            total += len(piece)
            hashed.update(piece)
    return total, hashed.hexdigest()


def _put(store: fs.FileSystem, path: str, pieces: Iterable[bytes]) -> tuple[int, str]:
    """Write under a name of its own and rename, so that the name stands for a whole file or for none; length and hash."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    total, hashed = 0, hashlib.sha256()
    try:
        with store.open_output_stream(part) as stream:
            for piece in pieces:
                stream.write(piece)
                total += len(piece)
                hashed.update(piece)
        store.move(part, path)
    except BaseException:
        if store.get_file_info(part).type != fs.FileType.NotFound:
            store.delete_file(part)
        raise
    return total, hashed.hexdigest()


def _store_star(store: fs.FileSystem, folder: str, kepid: int, wanted: list[dict], policy: str, download: Callable[[str], bytes | Iterable[bytes]]) -> dict:
    """Store what a star still lacks and, if all is there then, its manifest; the outcome as a row."""
    row = {"kepid": kepid, "status": "downloaded", "n_products": 0, "n_new": 0, "new_bytes": 0, "message": None}
    try:
        store.create_dir(folder, recursive=True)
        stored = []
        for product in wanted:
            path = f"{folder}/{product['filename']}"
            new = store.get_file_info(path).type == fs.FileType.NotFound
            if new:
                made = download(product["data_uri"])
                length, sha256 = _put(store, path, [made] if isinstance(made, (bytes, bytearray)) else made)
            else:
                length, sha256 = _digest(store, path)
            stored.append(product | {"stored_bytes": length, "sha256": sha256})
            row["n_products"] += 1
            row["n_new"] += new
            row["new_bytes"] += length * new
        stamp = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        document = {"kepid": kepid, "policy": policy, "retrieved_at_utc": stamp, "products": stored}
        _put(store, f"{folder}/{MANIFEST}", [json.dumps(document, sort_keys=True).encode()])
    except Exception as problem:  # an outcome of this star, not of the job
        row |= {"status": "error", "message": f"download failed: {problem}"}
    return row


def fetch(wanted: DataFrame, root: str, download: Callable[[str], bytes | Iterable[bytes]], policy: str = "") -> DataFrame:
    """(kepid, status, n_products, n_new, new_bytes, message): the outcome of storing each star's products under ``root``.

    ``wanted`` is (kepid, filename, data_uri, quarter, size_bytes), ``root`` the address of a folder of any store that all
    executors reach, ``download`` gives the bytes of an address at once or in pieces. Files that are there are not fetched
    again, so a batch that was cut off goes on where it stopped, also within a star. The first failure ends a star with
    ``error`` and its message: what it has stored stays, but it gets no manifest; other stars go on. The outcomes are
    settled, so that reading them twice fetches nothing twice; a task that is repeated finds its files stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows = []
            for kepid, listed in zip(batch["kepid"].tolist(), batch["_products"]):
                # A batch with nulls holds its numbers as floats.
                number = lambda v: None if pd.isna(v) else int(v)
                whole = [{"filename": p["filename"], "data_uri": p["data_uri"], "quarter": number(p["quarter"]), "size_bytes": number(p["size_bytes"])} for p in listed]
                rows.append(_store_star(store, f"{base}/{star_folder(kepid)}", kepid, whole, policy, download))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in outcome.split(", ")])

    outcome = "kepid long, status string, n_products long, n_new long, new_bytes long, message string"
    # A row a star, whose products are a few; nulls come last, as in a sort of data frames.
    one = F.struct(F.col("quarter").isNull().alias("_late"), F.col("quarter").cast("long").alias("quarter"), "filename", "data_uri", F.col("size_bytes").cast("long").alias("size_bytes"))
    stars = wanted.groupBy(F.col("kepid").cast("long").alias("kepid")).agg(F.array_sort(F.collect_list(one)).alias("_products"))
    return settle(stars.mapInPandas(run, outcome))


def read_manifests(spark: SparkSession, root: str, stars: DataFrame | None = None) -> DataFrame:
    """(kepid, policy, retrieved_at_utc, filename, ...) of every stored star, a row a product, null for a star without any.

    With ``stars`` (kepid) the manifests of these are read where their rows are, without listing the root on the
    driver; a star without one has no row.
    """
    if stars is None:
        rows = spark.read.schema(_MANIFEST).option("multiLine", "true").json(f"{root}/kic_*/{MANIFEST}")
        return rows.select("kepid", "policy", "retrieved_at_utc", F.inline_outer("products"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            texts = []
            for kepid in batch["kepid"].tolist():
                path = f"{base}/{star_folder(kepid)}/{MANIFEST}"
                try:
                    with store.open_input_stream(path) as stream:
                        texts.append(stream.read().decode())
                except FileNotFoundError:
                    pass
            yield pd.DataFrame({"text": texts}, dtype=object)

    texts = stars.select(F.col("kepid").cast("long").alias("kepid")).filter("kepid IS NOT NULL").mapInPandas(read, "text string")
    return texts.select(F.from_json("text", _MANIFEST).alias("m")).select("m.*").select("kepid", "policy", "retrieved_at_utc", F.inline_outer("products"))


def stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(kepid, filename, length, modified) of the products under a root, by listing; no content is read."""
    return list_files(spark, root, "kic_*/*").filter(~F.col("filename").endswith(".part") & (F.col("filename") != MANIFEST))


def damaged_files(manifests: DataFrame, root: str) -> DataFrame:
    """(kepid, filename, problem): products that are missing or differ from what their manifest says.

    Files are read piece by piece in the tasks that hold their rows.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            found = []
            for r in batch.itertuples():
                path = f"{base}/{star_folder(int(r.kepid))}/{r.filename}"
                if store.get_file_info(path).type == fs.FileType.NotFound:
                    found.append((r.kepid, r.filename, "missing"))
                elif _digest(store, path) != (r.stored_bytes, r.sha256):
                    found.append((r.kepid, r.filename, "differs"))
            yield pd.DataFrame(found, columns=["kepid", "filename", "problem"])

    rows = manifests.filter(F.col("filename").isNotNull()).select("kepid", "filename", "stored_bytes", "sha256")
    return rows.repartition("kepid", "filename").mapInPandas(look, "kepid long, filename string, problem string")
