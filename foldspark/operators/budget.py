"""A budget spent on rows in turn, where one that doesn't fit is passed over.

Whether a row fits depends on all rows before it, but the budget left needs few steps to follow. While at least half of
what a step began with is left, every row that needs at most half fits, and of the larger ones the first that fits ends
the step, as less than half is left then. So a step is one running sum over the small rows and a search for its end, and
at most as many steps are needed as the budget has bits. No row reaches the driver but the one that ends a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.lineage import settle


def _ordered(rows: DataFrame, order: str, tasks: int | None) -> DataFrame:
    """rows in blocks that follow each other by ``order``; what a block holds stays, as the table is settled."""
    n = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(n, order).withColumn("_block", F.spark_partition_id()))


def _upto(rows: DataFrame, order: str, value: str, into: str) -> DataFrame:
    """rows with the sum of a value over the rows up to and with this one: within blocks, then over blocks."""
    inside = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # A row a block.
    offsets = rows.groupBy("_block").agg(F.sum(value).alias("_sum")).select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return rows.withColumn(into, F.sum(value).over(inside)).join(F.broadcast(offsets), "_block").withColumn(into, F.col(into) + F.col("_offset")).drop("_offset")


def spend(rows: DataFrame, budget: int, order: str, need: str, cost: str | None = None, tasks: int | None = None) -> DataFrame:
    """rows with ``fits`` and ``left_before``, what the budget still held when the row's turn came.

    A row fits if its ``need`` is at most what is left; it then takes its ``cost`` (the need unless another column is
    named, which must not be less). Both are whole numbers of at least 0; a null counts as 0. ``order`` is a whole number
    and unique. What is left may fall below 0 where a cost is above its need; nothing fits after that.
    """
    given = rows.columns
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    table = _ordered(rows.withColumns({"_order": F.col(order).cast("long"), "_need": whole(need), "_cost": whole(cost or need)}), "_order", tasks)
    wrong = table.filter((F.col("_need") < 0) | (F.col("_cost") < F.col("_need"))).limit(1).count()
    if wrong:
        raise ValueError("a need must be at least 0 and a cost at least the need")
    steps: list[tuple[int | None, int, int | None, bool]] = []
    left, after = int(budget), None
    while left >= 0:
        half = left // 2
        rest = table.filter(F.col("_need") <= left)
        rest = rest if after is None else rest.filter(F.col("_order") > after)
        small = F.col("_need") <= half
        summed = _upto(rest.withColumn("_small", F.when(small, F.col("_cost")).otherwise(0)), "_order", "_small", "_upto")
        ends = summed.filter((small & (left - F.col("_upto") < half)) | (~small & (F.col("_need") <= left - F.col("_upto"))))
        end = ends.agg(F.min_by(F.struct("_order", "_need", "_cost", "_upto"), "_order").alias("end")).first()["end"]
        steps.append((after, half, None if end is None else end["_order"], end is not None and end["_need"] > half))
        if end is None:
            break
        left -= end["_upto"] + (end["_cost"] if end["_need"] > half else 0)
        after = end["_order"]
    fits = F.lit(False)
    for begin, half, end, large in steps:
        inside = F.lit(True) if begin is None else F.col("_order") > begin
        inside = inside if end is None else inside & (F.col("_order") <= end)
        taken = F.col("_need") <= half
        fits = F.when(inside, taken | (F.col("_order") == end) if large else taken).otherwise(fits)
    marked = table.withColumn("fits", fits).withColumn("_spent", F.when(F.col("fits"), F.col("_cost")).otherwise(0))
    out = _upto(marked, "_order", "_spent", "_upto")
    return out.select(*given, "fits", (F.lit(int(budget)) - F.col("_upto") + F.col("_spent")).alias("left_before"))
