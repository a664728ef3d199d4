"""Joins beyond one equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", salts: int = 16) -> DataFrame:
    """A join whose hot keys of left spread over `salts` partitions by the other columns; right, unique by key, is repeated for each salt."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in left.columns if c not in on]), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def as_of_join(rows: DataFrame, anchors: DataFrame, *, by: Sequence[str], at: str, take: Sequence[str]) -> DataFrame:
    """Each row with the columns `take` of the last anchor at or before it in its group; nulls before the first.

    One pass over the union of both, sorted within groups; anchors come before rows of the same place."""
    a = anchors.select(*by, F.col(at), F.lit(0).alias("_kind"), F.struct(*take).alias("_a"))
    rest = [c for c in rows.columns if c not in by and c != at]
    r = rows.select(*by, F.col(at), F.lit(1).alias("_kind"), F.struct(*rest).alias("_r"))
    both = a.unionByName(r, allowMissingColumns=True)
    seen = F.last("_a", ignorenulls=True).over(Window.partitionBy(*by).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_seen", seen).filter("_kind = 1")
    return out.select(*by, at, *[F.col("_r")[c].alias(c) for c in rest], *[F.col("_seen")[c].alias(f"anchor_{c}") for c in take])


def range_join(left: DataFrame, right: DataFrame, *, by: Sequence[str], left_at: str, right_at: str, reach: float) -> DataFrame:
    """Pairs of one group whose places differ by at most reach: an equi-join on cells of that width and their neighbours."""
    cell = F.floor(F.col(left_at) / reach)
    near = left.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    own = right.withColumn("_cell", F.floor(F.col(right_at) / reach))
    return near.join(own, [*by, "_cell"]).filter(F.abs(F.col(left_at) - F.col(right_at)) <= reach).drop("_cell")


def fallback_array(*found: Column) -> Column:
    """The first array that is neither null nor empty, else an empty one."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in found], F.array().cast("array<string>"))


def upsert(base: DataFrame, change: DataFrame, *, key: str, union: Sequence[str], overwrite: Sequence[str]) -> DataFrame:
    """A full outer join by key: sets are united and sorted, other columns taken from change where it has them."""
    a, b = base.alias("a"), change.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    empty = F.array().cast("array<string>")
    return joined.select(
        F.coalesce(f"a.{key}", f"b.{key}").alias(key),
        *[F.array_sort(F.array_union(F.coalesce(F.col(f"a.{c}"), empty), F.coalesce(F.col(f"b.{c}"), empty))).alias(c) for c in union],
        *[F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}")).alias(c) for c in overwrite],
    )


def guarded_narrowing(df: DataFrame, match: Column, group: Sequence[str] = (), share: int = 4) -> DataFrame:
    """Only the matching rows of each group, unless fewer than one in `share` match: then all. Counts combine first."""
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"), F.count_if(match).alias("_m"))
    joined = df.join(counts, list(group)) if group else df.crossJoin(F.broadcast(counts))  # one row of counts
    return joined.filter(match | (F.col("_m") * share < F.col("_n"))).drop("_n", "_m")
