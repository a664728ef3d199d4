"""Order-dependent operators: filling, islands, gaps and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def forward_fill(df: DataFrame, value: Column, *, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The last value that is not null, up to each row of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, starts: Column, *, by: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers the runs of each group: a row where starts holds begins one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def changed(c: str, *, by: Sequence[str], order: Sequence[str]) -> Column:
    """Whether a row's value differs from that of the row before it in its group."""
    return ~F.col(c).eqNullSafe(F.lag(c).over(Window.partitionBy(*by).orderBy(*order))) | (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1)


def gaps(df: DataFrame, *, by: Sequence[str], start: str, end: str, least: float) -> DataFrame:
    """Stretches of at least `least` that no interval of the group covers, between its first and last one."""
    w = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = df.withColumn("_reach", F.max(end).over(w))
    return seen.filter(F.col(start) - F.col("_reach") >= least).select(*by, F.col("_reach").alias("gap_start"), F.col(start).alias("gap_end"))


def anchored_clusters(values: Column, reach: float) -> Column:
    """Arrays of sorted values: a value joins the last cluster if it lies within reach of that cluster's first one."""
    empty = F.array().cast("array<array<double>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(x - F.element_at(last, 1) <= reach, F.lit(False))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(F.concat(last, F.array(x))))).otherwise(F.concat(acc, F.array(F.array(x))))

    return F.aggregate(F.array_sort(values), empty, add)


def sessions(df: DataFrame, *, by: Sequence[str], at: str, seconds: int, order: Sequence[str] = (), name: str = "session") -> DataFrame:
    """Numbers the runs of rows that follow each other within `seconds`."""
    w = Window.partitionBy(*by).orderBy(at, *order)
    pause = F.col(at).cast("timestamp").cast("double") - F.lag(F.col(at).cast("timestamp").cast("double")).over(w)
    return islands(df.withColumn("_pause", pause), F.col("_pause").isNull() | (F.col("_pause") > seconds), by=by, order=[at, *order], name=name).drop("_pause")


def distributed_rank(df: DataFrame, order: Sequence[str], *, name: str = "rank") -> DataFrame:
    """Adds the place of each row in the total order by columns, from 1: rows are split by ranges and sorted within them,
    and each range starts where those before it end. Only one count a range reaches the driver."""
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted_.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()
    before, total = {}, 0
    for r in sizes:
        before[r["_range"]] = total
        total += r["n"]
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    start = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_range")) if before else F.lit(0)
    return sorted_.withColumn(name, start.cast("bigint") + within).drop("_range")
