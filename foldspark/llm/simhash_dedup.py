"""SimHash near-duplicates: 64-bit fingerprints linked through vantage-point trees (operator 10).

A tree built from a bounded sample cuts the Hamming space into rings around vantage points. Each fingerprint is stored
in the one leaf that contains it and sent as a query to other leaves within reach. At the first vantage point that parts
a pair, only the nearer one visits the ring of the other, and from there on it visits every ring within the radius; so
by the triangle inequality each pair within the radius meets in one leaf. Inside a leaf a second tree, over the leaf's
own fingerprints, prunes in the same way down to small blocks that are compared exactly.

Edge cases: a null or empty text, or one without words, has fingerprint zero and links like any other; a very long text
is hashed whole; a bit that is set in exactly half the hashes is 0; equal
fingerprints form one class before any search; repeated rows keep their rows; components join fingerprints, never ids,
so rows with a null id link by their text and rows that share an id but not their text stay apart; a component's id is
its least id, null if all its ids are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import by_text, connected, local_components, map_rows, use_checkpoints

SEED = 42
#: Fingerprints in the sample that the tree of shards is built from: one of SAMPLED, at least SAMPLE and at most MOST (8 MB
#: on the driver, enough leaves for two thousand million fingerprints; beyond it leaves are cut into blocks).
SAMPLE, SAMPLED, MOST = 16384, 512, 1 << 20
#: Fingerprints that a leaf stores, and queries that one task holds, before the leaf is split into blocks.
LEAF, LEAF_QUERIES = 16384, 262144
RINGS = 4
#: Comparisons that a block inside a leaf makes at once.
BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles, as an unsigned number."""
    # bytes.lower() and bytes.split() treat ASCII letters and ASCII white space only, as the definition asks.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ones, count = np.zeros(64, dtype=np.int64), max(1, len(words) - width + 1)
    for at in range(0, count, 65536):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(at, min(count, at + 65536))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, simhash): the fingerprint as a signed long with the same bits."""

    def rows(columns: list[list]) -> Iterator[tuple]:
        for doc_id, text in zip(*columns):
            yield doc_id, _signed(fingerprint(text, width))

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), rows, "doc_id long, simhash long")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


@dataclass
class _Node:
    """Rings around a vantage point: child i holds distances in [cuts[i], cuts[i + 1])."""

    vantage: np.uint64 = np.uint64(0)
    cuts: tuple[int, ...] = ()
    children: tuple = ()
    leaf: int = 0
    stores: int = 1
    asks: int = 1


def _ring_cuts(distances: np.ndarray, rings: int) -> list[int]:
    """Distances that part the points into rings of about equal size; fewer than asked for where distances tie."""
    inner = np.quantile(distances, np.arange(1, rings) / rings, method="higher") if len(distances) else []
    cuts = sorted({int(c) for c in inner if distances.min() < c})
    return [0, *cuts, 65]


def build_tree(sample: np.ndarray, total: int, radius: int, leaf: int = LEAF, queries: int = LEAF_QUERIES) -> tuple[_Node, int]:
    """The tree over ``total`` fingerprints, from a sample of them; and its number of leaves.

    A leaf that can't be cut further but holds more than ``leaf`` fingerprints, such as a dense group of near copies,
    gets several blocks of stored fingerprints and of queries instead.
    """
    leaves = 0
    scale = total / max(1, len(sample))

    def grow(points: np.ndarray, visitors: np.ndarray, depth: int) -> _Node:
        nonlocal leaves
        if len(points) * scale > leaf and len(points) >= 8 and depth < 12:
            tried = points[:: max(1, len(points) // 16)][:16]
            vantage = max(tried, key=lambda v: (float(np.var(_distance(points, v))), int(v)))
            near, away = _distance(points, vantage).astype(int), _distance(visitors, vantage).astype(int)
            cuts = _ring_cuts(near, RINGS)
            if len(cuts) > 2:
                made = []
                for a, b in zip(cuts, cuts[1:]):
                    guests = np.concatenate([points[(near >= a - radius) & (near < a)], visitors[(away >= a - radius) & (away < b + radius)]])
                    made.append(grow(points[(near >= a) & (near < b)], guests, depth + 1))
                return _Node(vantage, tuple(cuts), tuple(made))
        leaves += 1
        return _Node(leaf=leaves - 1, stores=max(1, int(len(points) * scale / leaf + 0.999)), asks=max(1, int((len(points) + len(visitors)) * scale / queries + 0.999)))

    points = np.unique(sample)
    root = grow(points, points[:0], 0)
    return root, leaves


def _route(node: _Node, marks: np.ndarray, at: np.ndarray, homes: np.ndarray, radius: int) -> Iterator[tuple]:
    """(leaf node, positions, whether each is at home there) for all fingerprints that reach the leaf."""
    if not len(at):
        return
    if not node.children:
        yield node, at, homes
        return
    far = _distance(marks[at], node.vantage).astype(int)
    for low, high, child in zip(node.cuts, node.cuts[1:], node.children):
        reach = (far >= low - radius) & (far < np.where(homes, high, high + radius))
        yield from _route(child, marks, at[reach], homes[reach] & (far[reach] >= low) & (far[reach] < high), radius)


def pairs_within(stored: np.ndarray, asking: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in stored, in asking) of all pairs at most ``radius`` bits apart, in blocks."""
    work = [(np.arange(len(stored)), np.arange(len(asking)), 0)]
    while work:
        s, q, depth = work.pop()
        if not len(s) or not len(q):
            continue
        cuts: list[int] = []
        if len(s) * len(q) > BLOCK and len(s) > 64 and depth < 16:
            vantage = stored[s[len(s) // 2]]
            near, asked = _distance(stored[s], vantage).astype(int), _distance(asking[q], vantage).astype(int)
            cuts = _ring_cuts(near, RINGS)
        if len(cuts) > 2:
            for low, high in zip(cuts, cuts[1:]):
                work.append((s[(near >= low) & (near < high)], q[(asked >= low - radius) & (asked < high + radius)], depth + 1))
            continue
        step = max(1, BLOCK // len(s))
        for at in range(0, len(q), step):
            i, j = np.nonzero(_distance(asking[q[at : at + step], None], stored[s][None, :]) <= radius)
            if len(i):
                yield s[j], q[at : at + step][i]


def link_fingerprints(classes: DataFrame, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that span the components of classes (mark: the fingerprint, node: the class's number).

    Each leaf gives a star for each of its local components, never all pairs of a dense group.
    """
    total = classes.count()
    sample = max(sample, min(MOST, total // SAMPLED))
    marks = [r["mark"] for r in classes.select("mark").orderBy(F.xxhash64("mark", F.lit("tree")), "mark").limit(sample).collect()]
    tree, _ = build_tree(np.array(marks, dtype=np.int64).view(np.uint64), total, radius, leaf)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["mark"].to_numpy(dtype=np.int64)
            nodes, bits = batch["node"].to_numpy(), own.view(np.uint64)
            out = []
            for node, at, home in _route(tree, bits, np.arange(len(bits)), np.ones(len(bits), dtype=bool), radius):
                spread = (bits[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                store, ask = (spread % np.uint64(node.stores)).astype(int), (spread % np.uint64(node.asks)).astype(int)
                for s in range(node.stores):
                    for k in range(node.asks):
                        here, asks = home & (store == s), ask == k
                        keep = here | asks
                        shard = f"{node.leaf}:{s}:{k}"
                        out.append(pd.DataFrame({"shard": shard, "mark": own[at][keep], "node": nodes[at][keep], "stored": here[keep], "asks": asks[keep]}))
            if out:
                yield pd.concat(out)

    def match(group: pd.DataFrame) -> pd.DataFrame:
        bits, nodes = group["mark"].to_numpy(dtype=np.int64).view(np.uint64), group["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        bits, nodes = bits[order], nodes[order]
        stored, asks = np.flatnonzero(group["stored"].to_numpy()[order]), np.flatnonzero(group["asks"].to_numpy()[order])
        labels = None
        for s, q in pairs_within(bits[stored], bits[asks], radius):
            labels = local_components(len(bits), stored[s], asks[q], labels)
        if labels is None:
            return pd.DataFrame({"a": nodes[:0], "b": nodes[:0]})
        own = np.flatnonzero(labels != np.arange(len(bits)))
        return pd.DataFrame({"a": nodes[own], "b": nodes[labels[own]]})

    dealt = classes.select("mark", "node").mapInPandas(deal, "shard string, mark long, node long, stored boolean, asks boolean")
    return dealt.groupBy("shard").applyInPandas(match, "a long, b long")


def _settled(docs: DataFrame, id_col: str, text_col: str, width: int, radius: int, leaf: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, simhash) of each row; and (mark, root, component_id) of each fingerprint, root the component's least mark."""
    spark = docs.sparkSession
    use_checkpoints(spark)
    marked = with_fingerprints(docs, id_col, text_col, width).checkpoint()
    classes = marked.groupBy(F.col("simhash").alias("mark")).agg(F.min("doc_id").alias("least")).checkpoint()
    components = connected(link_fingerprints(classes.withColumn("node", F.col("mark")), radius, leaf, sample), spark)
    rooted = classes.join(components, F.col("mark") == F.col("node"), "left").select("mark", "least", F.coalesce("component", "mark").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked, rooted.join(ids, "root").select("mark", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs."""
    marked, settled = _settled(docs, id_col, text_col, width, radius, leaf, sample)
    return marked.join(settled, F.col("simhash") == F.col("mark"), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row of docs for each component: of its least id (null only if all are), then of the least fingerprint, then of
    the least text, then of the least other columns.

    Texts are shuffled once: a component's row is looked for under one fingerprint and id, by which both the join and
    the choice among equal ones are parted.
    """
    marked, settled = _settled(docs, id_col, text_col, width, radius, leaf, sample)
    # A null id meets only null ids: as two keys that are never null.
    keyed = lambda df, name: df.withColumns({"key_null": F.col(name).isNull(), "key_id": F.coalesce(name, F.lit(0))}).drop(name)
    distinct = marked.groupBy("simhash", "doc_id").count()
    least = distinct.join(settled, F.col("simhash") == F.col("mark")).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = keyed(least.groupBy("root").agg(F.min("mark").alias("key_mark"), F.first("doc_id").alias("kept_id")), "kept_id").drop("root")

    mark_of = by_text(lambda texts: [_signed(fingerprint(t, width)) for t in texts], "long")
    # The row travels as one column, so that its own columns' names can't clash.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    rows = keyed(docs.select(whole, F.col(id_col).cast("long").alias("own_id"), mark_of(F.col(text_col).cast("string")).alias("key_mark")), "own_id")
    others = [c for c, t in docs.dtypes if c != text_col and "map<" not in t and "variant" not in t]
    first = F.min_by("whole", F.struct(*(F.col("whole")[c] for c in (text_col, *others))))
    keys = ["key_mark", "key_id", "key_null"]
    return rows.join(chosen, keys).groupBy(*keys).agg(first.alias("whole")).select("whole.*")
