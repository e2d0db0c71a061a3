"""Views as model inputs: filling, normalising, filtering and batching of array columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.config import MAD_TO_SIGMA
from foldspark.functions import median_of
from foldspark.operators.ranking import hash_key


def fill_missing(df: DataFrame, keys: list[str], values: str, counts: str, circular: bool) -> DataFrame:
    """df with ``<values>_filled`` and ``<values>_observed``: empty bins interpolated between their neighbours.

    Around the ends where ``circular``, else held there; without any observed bin all zeros. All of it is array
    functions, so that no bin is shuffled. ``keys`` is unused but for a uniform signature.
    """
    n = F.size(values)
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    observed = F.transform(F.arrays_zip(F.col(values).alias("v"), F.col(counts).alias("c")), lambda b: (b["c"] > 0) & finite(b["v"]))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def points(seen: Column) -> Column:
        every = F.transform(F.col(values), lambda v, i: F.when(F.get(seen, i), point(i, v)))
        return F.filter(every, lambda p: p.isNotNull())

    def wrapped(known: Column) -> Column:
        first, last = F.get(known, 0), F.get(known, F.size(known) - 1)
        around = F.concat(F.array(point(last["x"] - n, last["y"])), known, F.array(point(first["x"] + n, first["y"])))
        return F.when(F.size(known) > 0, around).otherwise(known) if circular else known

    def passed(seen: Column) -> Column:
        """For each bin, how many points come before it; so a bin finds both neighbours at once."""
        start = F.struct(F.lit(1 if circular else 0).alias("k"), F.array().cast("array<int>").alias("ks"))
        step = lambda s, ok: F.struct((s["k"] + ok.cast("int")).alias("k"), F.array_append(s["ks"], s["k"]).alias("ks"))
        return F.aggregate(seen, start, step, lambda s: s["ks"])

    def filled(seen: Column, known: Column, before: Column) -> Column:
        def value(v: Column, i: Column) -> Column:
            k = F.get(before, i)
            a, b = F.get(known, k - 1), F.get(known, k)
            line = (b["y"] - a["y"]) / (b["x"] - a["x"]) * (i - a["x"]) + a["y"]
            return F.when(F.get(seen, i), v.cast("double")).otherwise(F.coalesce(line, a["y"], b["y"], F.lit(0.0)))

        return F.struct(F.transform(F.col(values), value).alias("filled"), F.transform(seen, lambda ok: ok.cast("float")).alias("observed"))

    whole = _let(observed, lambda s: _let(points(s), lambda p: _let(wrapped(p), lambda w: _let(passed(s), lambda k: filled(s, w, k)))))
    return df.withColumn("_whole", whole).withColumn(f"{values}_filled", F.col("_whole.filled")).withColumn(f"{values}_observed", F.col("_whole.observed")).drop("_whole")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_view(values: Column, observed: Column, method: str = "depth") -> Column:
    """(v - median) / (median - least) over the observed bins; a flat view is scaled by its deviations, or by 1."""
    if method == "none":
        return values
    if method != "depth":
        raise ValueError(f"unknown normalisation {method}")
    seen = F.transform(F.filter(F.arrays_zip(values.alias("v"), observed.alias("o")), lambda b: b["o"] > 0), lambda b: b["v"])

    def scaled(state: Column) -> Column:
        return F.transform(values, lambda v: (v - state["m"]) / state["s"])

    middle = median_of(seen)
    parts = F.transform(F.array(F.struct(middle.alias("m"), F.array_min(seen).alias("least"), seen.alias("seen"))), lambda p: F.struct(p["m"].alias("m"), _scale(p).alias("s")))
    return F.when(F.size(seen) == 0, values).otherwise(F.get(F.transform(parts, scaled), 0))


def _scale(p: Column) -> Column:
    spread = MAD_TO_SIGMA * median_of(F.transform(p["seen"], lambda v: F.abs(v - p["m"])))
    drop = p["m"] - p["least"]
    return F.when(drop > 0, drop).when(spread > 0, spread).otherwise(1.0)


def model_inputs(examples: DataFrame, split: str | None = None, views: tuple[str, ...] = ("global", "local"), normalization: str = "depth", eligible_only: bool = True) -> DataFrame:
    """Examples that are ok (and labelled, and of the split), each view as channels [flux, observed]."""
    unknown = set(views) - {"global", "local"}
    if unknown or not views:
        raise ValueError(f"views must be some of global and local, not {views}")
    rows = examples.filter(F.col("example_status") == "ok")
    rows = rows.filter(F.col("training_status") == "train_eligible") if eligible_only else rows
    rows = rows if split is None else rows.filter(F.col("split") == split)
    for view in views:
        rows = fill_missing(rows, ["kepoi_name"], f"{view}_flux", f"{view}_count", circular=view == "global")
        flux, seen = F.col(f"{view}_flux_filled"), F.col(f"{view}_flux_observed")
        rows = rows.withColumn(view, F.array(normalize_view(flux, seen, normalization).cast("array<float>"), seen)).drop(f"{view}_flux_filled", f"{view}_flux_observed")
    return rows.select("kepid", "kepoi_name", "split", "label", *views)


def batches(inputs: DataFrame, size: int, seed: int | None = None, key: str = "kepoi_name") -> Iterator[pa.RecordBatch]:
    """Arrow batches for a training loop, in the order of a seeded hash; partitions are fetched one at a time.

    Executors encode the rows, so that the driver only cuts and joins Arrow columns.
    """
    ordered = inputs if seed is None else inputs.orderBy(hash_key(seed, key), key)

    def encoded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as stream:
                    stream.write_batch(part.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["stream"])

    waiting: pa.Table | None = None
    for row in ordered.mapInArrow(encoded, "stream binary").toLocalIterator(prefetchPartitions=True):
        table = pa.ipc.open_stream(bytes(row["stream"])).read_all()
        waiting = table if waiting is None else pa.concat_tables([waiting, table])
        while waiting.num_rows >= size:
            yield waiting.slice(0, size).combine_chunks().to_batches()[0]
            waiting = waiting.slice(size)
    if waiting is not None and waiting.num_rows:
        yield waiting.combine_chunks().to_batches()[0]
