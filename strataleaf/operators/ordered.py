"""Values along the order of a group, where one group may hold a large part of all rows.

Rows are ranged by (group, order), so that a hot group is spread over many tasks and each holds a run of its rows; what
a row needs from before its run is one value of each earlier run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.session import cut_lineage


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    # ranges are sampled: the rows are kept where they fell, as a second sample could place them otherwise
    return cut_lineage(rows.repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()))


def _joined(rows: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    same = None
    for k in keys:
        on = rows[k].eqNullSafe(runs[k])
        same = on if same is None else same & on
    return rows.join(runs, same)


def ranked(rows: DataFrame, group: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``rows`` with each row's place in its group, from 0, and the group's size. ``order`` must settle ties."""
    placed = _placed(rows, group, order)
    keys = [*group, "__part"]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    runs = runs.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), size: F.sum("__n").over(Window.partitionBy(*group))}).drop("__n")
    numbered = placed.withColumn("__own", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    kept = [numbered[f"`{c}`"] for c in rows.columns]
    return _joined(numbered, runs, keys).select(*kept, (F.col("__own") + F.col("__before")).alias(rank), size)


def with_last_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``value`` of an earlier row of the group, or null. ``order`` must settle ties."""
    placed = _placed(rows.withColumn("__value", value), group, order)
    keys = [*group, "__part"]
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("__value").isNotNull(), F.struct(*order, "__value")))["__value"]
    runs = placed.groupBy(*keys).agg(last.alias("__last"))
    runs = runs.select(*keys, F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("__seen", F.last("__value", ignorenulls=True).over(own))
    kept = [seen[f"`{c}`"] for c in rows.columns]
    return _joined(seen, runs, keys).select(*kept, F.coalesce("__seen", "__carried").alias(name))
