"""Deduplication and choice of one row among several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key. Combines before the shuffle (a minimum over structs), so a hot key costs one row a task.

    order must decide ties; nulls come first."""
    cols = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *cols)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def content_duplicates(docs: DataFrame, *, content: str, name: str, rank: Sequence[Column]) -> DataFrame:
    """Adds duplicate_of: of rows with equal content all but the best by rank point to it. Null content is no duplicate."""
    best = docs.filter(F.col(content).isNotNull()).groupBy(content).agg(F.min(F.struct(*[r.alias(f"_o{i}") for i, r in enumerate(rank)], F.col(name).alias("_best")))["_best"].alias("_best"))
    return docs.join(best, content, "left").withColumn("duplicate_of", F.when(F.col("_best") != F.col(name), F.col("_best"))).drop("_best")


def superseded(docs: DataFrame, *, keys: Sequence[str], name: str, order: Sequence[Column], then: Sequence[Column] = ()) -> DataFrame:
    """Adds newest and role: of rows with equal keys the last by order, and by `then` among equals, is `latest`; rows that
    tie with it in order are `duplicate`, the others `superseded`."""
    then = [*then, F.col(name)]
    struct = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[o.alias(f"_t{i}") for i, o in enumerate(then)], F.col(name).alias("_name"))
    last = docs.groupBy(*keys).agg(F.max(struct).alias("_last"))
    joined = docs.join(last, list(keys))
    same = F.lit(True)
    for i, o in enumerate(order):
        same = same & o.eqNullSafe(F.col("_last")[f"_o{i}"])
    role = F.when(F.col("_last")["_name"] == F.col(name), "latest").when(same, "duplicate").otherwise("superseded")
    return joined.withColumn("newest", F.col("_last")["_name"]).withColumn("role", role).drop("_last")


def disambiguate(df: DataFrame, *, key: str, candidates: Sequence[Column], order: Sequence[Column], fallback: Column) -> DataFrame:
    """Adds unique_id, which no two rows share.

    The first row of a key keeps it. The others add the slug of the first candidate that is not empty and not in the
    key already, else fallback; fallback too where the result is another row's; and a number where even that is taken.
    order must decide ties."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    slugs = [F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("")) for c in candidates]
    suffix = F.coalesce(*[F.when(~F.contains(F.col(key), s), s) for s in slugs], fallback)
    rows = df.withColumn("_later", nth > 1).withColumn("_c", F.when(nth == 1, F.col(key)).otherwise(F.concat_ws("-", F.col(key), suffix)))
    again = F.row_number().over(Window.partitionBy("_c").orderBy("_later", *order))
    rows = rows.withColumn("_r", F.when(F.col("_later") & (again > 1), F.concat_ws("-", F.col(key), fallback)).otherwise(F.col("_c")))
    third = F.row_number().over(Window.partitionBy("_r").orderBy("_later", F.col("_c") != F.col("_r"), *order))
    return rows.withColumn("unique_id", F.when(third == 1, F.col("_r")).otherwise(F.concat_ws("-", "_r", third.cast("string")))).drop("_later", "_c", "_r")
