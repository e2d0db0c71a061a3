"""Near-duplicate vectors by Euclidean p-stable hashing (operator 9).

Equal vectors form one class first. The classes' normalised vectors are hashed into the buckets of several tables, each
by a row of quantised Gaussian projections; the number of projections grows with the logarithm of the table, so that
buckets of unrelated vectors stay small, and the number of tables follows from the wanted recall at the threshold.
Vectors that share a bucket are compared exactly, in double precision and in blocks. A large bucket, such as that of a
dense group of near copies, is cut into blocks and every pair of blocks is a unit of its own. A pair counts only in the
first table where it meets, and a unit returns link counts and a spanning forest, never pairs.

Edge cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing, and neither
does a row with a null id (its component is null and it is not kept); repeated rows count as vectors of their own;
a cosine that equals the threshold links; vectors of unlike lengths never link; very long vectors are hashed whole;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import connected, local_components, use_checkpoints

THRESHOLD, RECALL, WIDTH = 0.95, 0.98, 2.0
#: Vectors in a block of a bucket, rows that one task compares, and the largest bucket compared pair by pair.
BLOCK, TASK_ROWS, SMALL = 2048, 32768, 48


def collision(distance: float, width: float = WIDTH) -> float:
    """The chance that one quantised projection agrees for two points at this distance (Datar et al. 2004)."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


@dataclass(frozen=True)
class Plan:
    """Projections in a table, and tables."""

    projections: int
    tables: int

    @staticmethod
    def of(vectors: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
        near = collision(math.sqrt(2 - 2 * threshold))
        far = collision(math.sqrt(2.0))
        projections = max(4, math.ceil(math.log(max(2, 4 * vectors)) / -math.log(far)))
        return Plan(projections, math.ceil(math.log(1 - recall) / math.log(1 - near**projections)))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """The bucket of each row of unit vectors in each table."""
        rng = np.random.default_rng([9, unit.shape[1]])
        lines = rng.standard_normal((unit.shape[1], self.tables * self.projections))
        shifts = rng.random(self.tables * self.projections) * WIDTH
        mixers = rng.integers(1, 2**62, self.projections, dtype=np.int64) * 2 + 1
        cells = np.floor((unit @ lines + shifts) / WIDTH).astype(np.int64)
        return (cells.reshape(len(unit), self.tables, self.projections) * mixers).sum(axis=2)


def _unit(vectors) -> np.ndarray:
    stacked = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    scaled = stacked / np.abs(stacked).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _by_length(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for _, same in batch.groupby(batch["vector"].map(len), sort=True):
        yield same.reset_index(drop=True)


def hash_keys(classes: DataFrame, plan: Plan) -> DataFrame:
    """(table_no, bucket, node) of every class in every table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _by_length(batch):
                keys = plan.buckets(_unit(part["vector"]))
                yield pd.DataFrame({"table_no": np.tile(np.arange(plan.tables), len(part)), "bucket": keys.ravel(), "node": np.repeat(part["node"].to_numpy(), plan.tables)})

    return classes.select("node", "vector").mapInPandas(rows, "table_no int, bucket long, node long")


def _pairs(unit: np.ndarray, starts: np.ndarray, block: np.ndarray, cross: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions (i, j) of each run of rows; a run of two blocks gives only pairs across them."""
    ends = np.append(starts[1:], len(unit))
    run = np.repeat(np.arange(len(starts)), ends - starts)
    small = (ends - starts <= SMALL)[run]
    for step in range(1, SMALL):
        i = np.arange(len(unit) - step) if len(unit) > step else np.arange(0)
        i = i[small[i] & (run[i] == run[i + step])]
        if not len(i):
            break
        i = i[~cross[i] | (block[i] != block[i + step])]
        hit = np.einsum("ij,ij->i", unit[i], unit[i + step]) >= threshold
        yield i[hit], i[hit] + step
    for begin, end in zip(starts[ends - starts > SMALL], ends[ends - starts > SMALL]):
        for a in range(begin, end, 1024):
            for b in range(a, end, 1024):
                rows, columns = np.arange(a, min(end, a + 1024)), np.arange(b, min(end, b + 1024))
                hit = unit[rows] @ unit[columns].T >= threshold
                if a == b:
                    hit = np.triu(hit, 1)
                if cross[begin]:
                    hit &= block[rows][:, None] != block[columns][None, :]
                i, j = np.nonzero(hit)
                yield rows[i], columns[j]


def compare(group: pd.DataFrame, plan: Plan, threshold: float) -> pd.DataFrame:
    """Link counts by node and a spanning forest of the links that this task's buckets are the first to show."""
    group = group.sort_values(["table_no", "bucket", "low", "high", "node"], ignore_index=True)
    out = []
    for part in _by_length(group):
        unit, table = _unit(part["vector"]), part["table_no"].to_numpy()
        keys = plan.buckets(unit)
        named = part[["table_no", "bucket", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.append(True, (named[1:] != named[:-1]).any(axis=1)))
        node, codes = np.unique(part["node"].to_numpy(), return_inverse=True)
        copies, links, labels = part["copies"].to_numpy(), np.zeros(len(node)), None
        cross = (part["low"] != part["high"]).to_numpy()
        for i, j in _pairs(unit, starts, part["block"].to_numpy(), cross, threshold):
            for earlier in range(int(table.max())):
                met = (keys[i, earlier] == keys[j, earlier]) & (earlier < table[i])
                i, j = i[~met], j[~met]
            links += np.bincount(codes[i], weights=copies[j], minlength=len(node)) + np.bincount(codes[j], weights=copies[i], minlength=len(node))
            labels = local_components(len(node), codes[i], codes[j], labels)
        if labels is not None:
            told = np.flatnonzero((links > 0) | (labels != np.arange(len(node))))
            out.append(pd.DataFrame({"node": node[told], "root": node[labels[told]], "links": links[told].astype(np.int64)}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "links": []}, dtype=np.int64)


def link_classes(classes: DataFrame, plan: Plan, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root, links): partial link counts of classes (node, copies, vector), and edges that join components."""
    keys = hash_keys(classes, plan)
    sizes = keys.groupBy("table_no", "bucket").count().filter("count > 1")
    met = keys.join(sizes, ["table_no", "bucket"])
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = met.withColumn("blocks", blocks).withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("table_no", "bucket", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).checkpoint()
    parts = max(1, -(-dealt.count() // TASK_ROWS))
    full = dealt.join(classes.select("node", "copies", "vector"), "node")
    full = full.withColumn("part", F.pmod(F.xxhash64("table_no", "bucket", "low", "high"), F.lit(parts)))
    return full.groupBy("part").applyInPandas(lambda g: compare(g, plan, threshold), "node long, root long, links long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    spark = vectors.sparkSession
    use_checkpoints(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False))
    # Two 64-bit hashes stand for the vector, so that the mapping back shuffles no vectors.
    rows = rows.withColumn("k1", F.when(usable, F.xxhash64("vector"))).withColumn("k2", F.when(usable, F.xxhash64(F.lit(9), "vector")))
    classes = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")).checkpoint()
    found = link_classes(classes, Plan.of(classes.count(), threshold), threshold).checkpoint()
    components = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")), spark)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "node", "left").join(components, "node", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c")
    )
    joined = rows.select("vec_id", "k1", "k2").join(told, ["k1", "k2"], "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
