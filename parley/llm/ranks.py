"""Positions of rows within their groups, for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.store import table


def number(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``_pos``, a row's place in its group by ``order`` (nulls first, from 0), and ``_size``, the group's rows.

    Rows are dealt to ranges of (group, order), so that a large group spreads over tasks, sorted there and
    written once to the shared folder. A group has at most one run a range; the runs' sizes give each its offset. Rows
    that agree in ``order`` are numbered as they come. The runs are a table, which Catalyst broadcasts if it is small. Group columns must not be null.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_g", F.monotonically_increasing_id())
    placed = table(placed, name).withColumn("_run", F.shiftright("_g", 33))
    runs = placed.groupBy(*group, "_run").agg(F.min("_g").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*group, "_run", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    runs = table(runs, f"{name}-runs")
    return placed.join(runs, [*group, "_run"]).withColumn("_pos", F.col("_before") + F.col("_g") - F.col("_first")).select(*df.columns, "_pos", "_size")
