"""Helpers that the training-data operators share."""

from __future__ import annotations

import bisect
import ctypes
import functools
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Bytes of text in a block of rows; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Edges that a step of connected() writes to a file, where it has more than a file for each core.
EDGES_A_FILE = 200_000


def use_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the folder of spark.checkpoint.dir.

    Only a local session, whose tasks share the driver's disk, gets a temporary folder where none is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="foldspark-"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark writes."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """The C library's call that returns free memory; one that does nothing where it has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return to the system what this process has freed.

    Spark keeps Python workers for later tasks, and more of them than work at once; without this each would stay at the
    size of its largest batch of texts while others work.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def blocks_of(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows, with at most ``size`` bytes of text unless a single row has more."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
        end = min(at + rows, max(at + 1, fits), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, rows: Callable[[list[list]], Iterator[tuple]], schema: str, batch: int = 512, size: int = BLOCK_BYTES) -> DataFrame:
    """Apply ``rows`` to blocks of at most ``batch`` rows and ``size`` bytes, given as lists by column; it yields output tuples.

    A block is one Arrow slice, so a task holds one block of Python objects at a time, whatever the texts' lengths.
    """
    struct = T.StructType.fromDDL(schema)
    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in blocks_of(whole, batch, size):
                made = list(rows([c.to_pylist() for c in part.columns]))
                columns = list(zip(*made)) if made else [()] * len(out)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)
            whole = part = made = columns = None
            give_back()
        give_back()

    return df.mapInArrow(run, struct)


def by_text(work: Callable[[list[str | None]], Iterable], kind: str) -> Callable[[F.Column], F.Column]:
    """A column function from a text to ``kind``: ``work`` gives the values of a list of texts.

    Arrow hands over up to ten thousand rows at once; only a block of them is held as Python objects.
    """
    out = to_arrow_schema(T.StructType.fromDDL(f"value {kind}")).field(0).type

    def values(texts: pa.Array) -> pa.Array:
        whole = pa.RecordBatch.from_arrays([texts], names=["text"])
        made = [pa.array(work(part.column(0).to_pylist()), out) for part in blocks_of(whole, 512, BLOCK_BYTES)]
        return pa.concat_arrays(made) if made else pa.array([], out)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = values(texts)
            texts = None
            yield made
            made = None
            give_back()
        give_back()

    return run


def union_of(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """The begins and the ends of the stretches that (kind, begin, end) spans cover together, in order."""
    begins: list[int] = []
    ends: list[int] = []
    for _, begin, end in sorted(spans, key=lambda s: s[1]):
        if ends and begin <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            begins.append(begin)
            ends.append(end)
    return begins, ends


def touches(union: tuple[list[int], list[int]], begin: int, end: int) -> bool:
    """Whether a span overlaps the union of others."""
    k = bisect.bisect_left(union[0], end) - 1
    return k >= 0 and union[1][k] > begin


def crc_of(doc_id) -> F.Column:
    """crc32 of an id's decimal text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def crc_text(doc_id: int) -> int:
    """The same in Python."""
    return zlib.crc32(str(doc_id).encode())


def sample_ids(rows: DataFrame, id_col: str, class_col: str, per_class: int) -> dict[int, object]:
    """At most ``per_class`` ids of each class, in the order of a hash; the driver gets no more than twice as many.

    Two passes over two columns, whatever the number of classes: one counts, one keeps each class's least hashes. The
    choice depends on the ids alone, so it does not change with the layout of the input.
    """
    light = rows.select(F.col(id_col).alias("id"), F.col(class_col).alias("class")).dropna()
    counts = {r["class"]: r["count"] for r in light.groupBy("class").count().collect()}
    if not counts:
        return {}
    mixed = light.withColumn("order", F.xxhash64("id", F.lit("sample")))
    below = F.lit(None).cast("long")
    for value, count in counts.items():
        # Of many ids, about 1.5 times as many as are wanted fall below the limit; repeated ids make it fewer.
        share = min(1.0, 1.5 * per_class / count + 20.0 / count)
        below = F.when(F.col("class") == F.lit(value), F.lit(int(min(2**63 - 1, -(2**63) + share * 2**64)))).otherwise(below)
    found = mixed.filter(F.col("order") <= below).distinct().collect()
    picked: dict[int, object] = {}
    taken = dict.fromkeys(counts, 0)
    for r in sorted(found, key=lambda r: (str(r["class"]), r["order"], r["id"])):
        if taken[r["class"]] < per_class:
            taken[r["class"]] += 1
            picked[r["id"]] = r["class"]
    return picked


def rows_of(df: DataFrame, id_col: str, ids: list[int], *columns: str) -> DataFrame:
    """One row for each of these (few) ids: the id and the least of its rows' values.

    Null values are the least, so a repeated id may give nulls.
    """
    found = df.filter(F.col(id_col).isin([int(i) for i in ids]))
    least = found.groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(*columns)).alias("row"))
    return least.select("id", "row.*")


def connected(edges: DataFrame, spark: SparkSession, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): (node, component), component the least node.

    Alternates the large-star and small-star steps (Kiveris et al. 2014), each a shuffle of edges that shrinks a
    path's length by a constant factor. Every step ends in a checkpoint, so plans stay short and lost executors cost
    one step; few edges go to few files. Nothing is collected but numbers of edges. An edge with a null end is ignored.
    """
    use_checkpoints(spark)
    both = edges.filter(F.col("a") != F.col("b"))
    now = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    files = max(spark.sparkContext.defaultParallelism, now.count() // EDGES_A_FILE)
    for _ in range(rounds):
        if now.isEmpty():
            break
        large = _star(now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger_only=True)
        small = _star(large, larger_only=False).coalesce(files).checkpoint()
        moved = small.exceptAll(now).limit(1).count() + now.exceptAll(small).limit(1).count()
        now = small
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    members = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node")).distinct().join(members.select("node"), "node", "left_anti")
    return members.union(roots.select("node", F.col("node").alias("component")))


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Join each node's neighbours (those above it, or all below it) to its least neighbour or itself.

    The least neighbour comes from an aggregate that combines before the shuffle; a hub's own rows are then dealt by
    the join, which adaptive execution may split.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = edges.join(least, "a")
    if larger_only:
        pairs = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The least member of each node's component, adding the edges (a, b) to those that made ``labels``."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (deeper := labels[labels]).tobytes() != labels.tobytes():
            labels = deeper
    return labels
