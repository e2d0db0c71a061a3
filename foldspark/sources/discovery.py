"""What is stored under a folder tree, as tables made from listings: stars with downloads, stars with processed curves.

A listing is Spark's own (it lists many folders in a job of its own and reads no content), so a tree of many stars costs
no call per star on the driver. Two listings compare by length and time of change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FILES = "kepid long, path string, filename string, length long, modified timestamp"
#: A star's folder: its number in nine digits.
_STAR = r"/kic_(\d{9})/[^/]+$"


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(kepid, path, filename, length, modified) of the files below ``root`` that match; a missing folder has none.

    ``kepid`` is null for files outside of a star's folder.
    """
    try:
        found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{pattern}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FILES)
    # The content column isn't selected, so files are listed and not opened.
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    star = F.nullif(F.regexp_extract(path, _STAR, 1), F.lit("")).cast("long")
    name = F.element_at(F.split(path, "/"), -1)
    return found.select(star.alias("kepid"), path.alias("path"), name.alias("filename"), "length", F.col("modificationTime").alias("modified"))


def downloaded_stars(spark: SparkSession, root: str) -> DataFrame:
    """(kepid, modified): stars with a manifest of stored products."""
    return list_files(spark, root, "kic_*/products.json").filter(F.col("kepid").isNotNull()).select("kepid", "modified")


def processed_stars(spark: SparkSession, root: str) -> DataFrame:
    """(kepid, n_files, length, modified): stars with a processed curve, one Parquet folder or file each."""
    files = list_files(spark, root, "kic_*/*.parquet").unionByName(_inside(spark, root)).filter(F.col("kepid").isNotNull())
    return files.groupBy("kepid").agg(F.count("*").alias("n_files"), F.sum("length").alias("length"), F.max("modified").alias("modified"))


def _inside(spark: SparkSession, root: str) -> DataFrame:
    """Files of curves that are folders, under their star's number."""
    files = list_files(spark, root, "kic_*/*.parquet/*.parquet")
    star = F.nullif(F.regexp_extract("path", r"/kic_(\d{9})/[^/]+/[^/]+$", 1), F.lit("")).cast("long")
    return files.withColumn("kepid", star)


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, kepid, change) between two listings: ``added``, ``removed`` or ``changed``; files that stayed are left out."""
    mark = lambda df, side: df.select("path", F.struct("kepid", "length", "modified").alias(side))
    both = mark(before, "old").join(mark(now, "new"), "path", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when((F.col("old.length") != F.col("new.length")) | (F.col("old.modified") != F.col("new.modified")), "changed")
    return both.select("path", F.coalesce("new.kepid", "old.kepid").alias("kepid"), change.alias("change")).filter(F.col("change").isNotNull())


class Discovery:
    """The read side's tables over a folder tree, made anew where files changed.

    ``tables()`` gives the catalog of ``catalog`` (CSV), the stars with stored products of ``raw`` and those with processed
    curves of ``processed``. The catalog is parsed and labelled when its file's time or length changes and kept between.
    """

    def __init__(self, spark: SparkSession, catalog: str, raw: str, processed: str):
        self.spark, self.catalog_path, self.raw, self.processed = spark, catalog, raw, processed
        self._seen: list | None = None
        self._catalog: DataFrame | None = None

    def catalog(self) -> DataFrame | None:
        """The labelled catalog, or None while there is no file."""
        from foldspark.operators.labels import apply_label_policy
        from foldspark.sources.tables import read_catalog

        folder, _, name = self.catalog_path.rpartition("/")
        # One file, or the part files of one table.
        found = list_files(self.spark, folder, name).select("path", "length", "modified").orderBy("path").limit(100_000).collect()
        if not found:
            self._seen = self._catalog = None
        elif found != self._seen:
            self._catalog, self._seen = apply_label_policy(read_catalog(self.spark, self.catalog_path)), found
        return self._catalog

    def targets(self) -> DataFrame:
        """(kepid, n_kois, has_products, has_lightcurve) of every star that the catalog or the tree knows."""
        known = self.catalog()
        signals = self.spark.createDataFrame([], "kepid long, n_kois long") if known is None else known.groupBy("kepid").agg(F.count("*").alias("n_kois"))
        rows = signals
        for name, stars in (("has_products", downloaded_stars(self.spark, self.raw)), ("has_lightcurve", processed_stars(self.spark, self.processed))):
            rows = rows.join(stars.select("kepid").distinct().withColumn(name, F.lit(True)), "kepid", "full").withColumn(name, F.coalesce(name, F.lit(False)))
        return rows.select("kepid", F.coalesce("n_kois", F.lit(0)).alias("n_kois"), F.coalesce("has_products", F.lit(False)).alias("has_products"), "has_lightcurve")
