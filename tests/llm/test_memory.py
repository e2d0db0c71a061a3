"""What Python workers keep between tasks, and what the steps of components write."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from foldspark.llm.common import connected

#: A worker's task without Spark around it: a batch of 30 MB of text becomes short objects, of which the last one is
#: remembered, as a cache would; the program prints by how many MB the process has grown when the task is over.
TASK = """
import re
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from foldspark.llm import common

kept = []
KINDS = {"long": T.LongType(), "string": T.StringType()}
# Spark's own parser needs a session.
T.StructType.fromDDL = lambda ddl: T.StructType([T.StructField(name, KINDS[kind]) for name, kind in map(str.split, ddl.split(","))])

class Frame:
    def mapInArrow(self, run, schema):
        self.run = run

def parts(texts):
    made = [[t[k : k + 600].encode() for k in range(0, len(t), 600)] for t in texts]
    kept.append(b"." * 600)
    return [sum(map(len, m)) for m in made]

def grown():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def batches(columns):
    for k in range(3):
        yield columns(pa.array([str(k % 10) * 30_000] * 1_000))

def over_map_rows():
    frame = Frame()
    common.map_rows(frame, lambda columns: zip(parts(columns[0]), columns[0]), "n long, t string", batch=10_000, size=1 << 30)
    return frame.run(batches(lambda a: pa.RecordBatch.from_arrays([a], names=["t"])))

def over_by_text():
    F.arrow_udf = lambda kind: lambda run: run
    common.BLOCK_BYTES = 1 << 30
    return common.by_text(parts, "long")(batches(lambda a: a))

common.map_rows(Frame(), None, "n long")
before = grown()
for made in FORM():
    del made
print(grown() - before)
"""


@pytest.mark.parametrize("form", ["over_map_rows", "over_by_text"])
def test_a_worker_does_not_stay_at_the_size_of_its_largest_batch(form):
    said = subprocess.run([sys.executable, "-c", TASK.replace("FORM", form)], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2])
    assert float(said.stdout.split()[-1]) < 60


def test_steps_of_components_write_few_files_where_edges_are_few(spark, monkeypatch):
    parts = []
    kind = type(spark.range(1))
    checkpoint = kind.checkpoint

    def counted(self, *args):
        made = checkpoint(self, *args)
        parts.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(kind, "checkpoint", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.range(200).selectExpr("id a", "id + 1 b")
        got = {r["node"]: r["component"] for r in connected(edges, spark).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(201), 0)
    assert len(parts) > 2 and max(parts[1:]) <= spark.sparkContext.defaultParallelism
