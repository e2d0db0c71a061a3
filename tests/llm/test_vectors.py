"""Embedding near-duplicates and components against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from foldspark.llm import common, embedding_dedup, queries

from .test_text import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = {k: np.array(v, dtype=np.float64) for k, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    links = dict.fromkeys([k for k, _ in rows], 0)
    edges = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.95:
                edges.append((a, b))
                links[a] += 1
                links[b] += 1
    return links, components(list(links), edges), len(edges)


def test_links_are_true_and_nearly_all(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    vectors = [(c + rng.normal(scale=0.12, size=32)).tolist() for c in centres for _ in range(6)] + rng.normal(size=(200, 32)).tolist()
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for k, v in enumerate(vectors)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)).collect()
    links, parts, edges = brute(rows)
    assert len(got) == len(rows)
    found = sum(r["n_links"] for r in got) / 2
    assert 0.9 * edges <= found <= edges
    assert all(r["n_links"] <= links[r["vec_id"]] for r in got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert np.mean([r["component_id"] == parts[r["vec_id"]] for r in got]) > 0.95


def test_whole_table_recall(spark):
    d = "/root/testdata/sf0.01"
    got = {r["vec_id"]: r for r in queries.op9_embedding_dedup(spark, d).collect()}
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    good = [(k, np.array(v, dtype=np.float64)) for k, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in good])
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    assert len(got) == len(rows)
    # The table has few near pairs or none; the recall of planted pairs is tested below.
    assert sum(got[k]["n_links"] for k, _ in good) >= 0.9 * want.sum()


def planted(count, others, size=48):
    """Unrelated vectors and ``count`` pairs with a cosine just above the threshold, 0.950 to 0.952."""
    rng = np.random.default_rng(17)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    first = unit(rng.normal(size=(count, size)))
    apart = rng.normal(size=(count, size))
    apart = unit(apart - (apart * first).sum(axis=1, keepdims=True) * first)
    cosine = rng.uniform(0.9501, 0.952, (count, 1))
    return np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * apart, unit(rng.normal(size=(others, size)))])


def planted_recall(spark, count=2000, others=6000):
    vectors = planted(count, others)
    rows = [(k, [float(x) for x in v.astype(np.float32)], 0) for k, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 for k in range(2 * count, len(rows)))
    return np.mean([got[k]["n_links"] == 1 and got[k + count]["component_id"] == k for k in range(count)])


def test_recall_of_pairs_just_above_the_threshold(spark, monkeypatch):
    assert planted_recall(spark) >= 0.9
    # Fewer tables lose pairs, so the figure above comes from the hashing.
    whole = embedding_dedup.Plan.of
    monkeypatch.setattr(embedding_dedup.Plan, "of", staticmethod(lambda *a: embedding_dedup.Plan(whole(*a).projections, 2)))
    assert planted_recall(spark) < 0.9


def test_empty_and_null_ids(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"] is None, r["n_links"], bool(r["kept"])) for r in got) == [(False, 1, True), (False, 1, True), (True, 0, False)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 420)]
    got = {r["node"]: r["component"] for r in common.connected(spark.createDataFrame(edges, "a long, b long"), spark).collect()}
    nodes = sorted({n for a, b in edges for n in (a, b) if a != b})
    assert got == components(nodes, edges)
