"""References to records that are missing, deleted or late (problem 2)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def normal_key(c: Column) -> Column:
    """Keys are compared without case and outer white space."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def earliest(df: DataFrame, key: str, at: str, cols: Sequence[str]) -> DataFrame:
    """One row per key: its earliest delivery. Combines before the shuffle, so a key delivered often costs one row a task."""
    return (
        df.groupBy(F.col(key).alias("_key"))
        .agg(F.min(F.struct(F.col(at).alias("_at"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(cols)])).alias("_r"))
        .select("_key", "_r.*")
    )


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    *,
    src: str,
    id_col: str,
    at_col: str,
    ref_cols: Sequence[str],
    key_cols: Sequence[str],
    arrived_col: str,
    deleted_col: str,
    match: str = "simple",
) -> DataFrame:
    """Rows (src, rec_id, ingest_month, reason) of the references in refs that have no live, timely record in targets.

    The references are grouped by their null mask. Each mask is joined with the targets projected to the mask's
    non-null columns, so a composite key with nulls in part is never compared with null. match declares what a
    partly null reference means, as in SQL: `simple` is satisfied by any null, `partial` needs a target that agrees
    on the non-null columns, `full` is satisfied only by all null or by a whole match. A wholly null reference is no
    case under any of them. reason is `missing`, else `deleted` (every match is deleted), else `late` (the first live
    match arrived after the referring row).

    Repeated deliveries of a reference count once, by the earliest; a null time is before every other. A null rec_id
    is one record. Blank references are references. Empty tables give no row, extra columns are ignored. Targets are
    unique per mask key before the join, so a hot reference key never multiplies rows, and adaptive execution splits
    its partition.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    k = len(ref_cols)
    rows = earliest(refs, id_col, at_col, ref_cols)
    rows = rows.select("_key", "_at", *[normal_key(F.col(f"_c{i}")).alias(f"_c{i}") for i in range(k)])
    known = targets.select(
        F.col(arrived_col).alias("_arrived"),
        F.col(deleted_col).isNotNull().alias("_gone"),
        *[normal_key(F.col(c)).alias(f"_c{i}") for i, c in enumerate(key_cols)],
    )
    mask = F.concat(*[F.when(F.col(f"_c{i}").isNull(), "1").otherwise("0") for i in range(k)])
    rows = rows.withColumn("_mask", mask)
    out = None
    for bits in product("01", repeat=k):
        name, held = "".join(bits), [f"_c{i}" for i in range(k) if bits[i] == "0"]
        if not held or (match == "simple" and len(held) < k):
            continue
        part = rows.filter(F.col("_mask") == name)
        if match == "full" and len(held) < k:
            part = part.select("_key", "_at", F.lit("missing").alias("reason"))
        else:
            at_key = known.groupBy(*held).agg(
                F.min(F.when(~F.col("_gone"), F.col("_arrived"))).alias("_live_at"),
                F.bool_or(~F.col("_gone")).alias("_live"),
            )
            reason = (
                F.when(F.col("_live").isNull(), "missing")
                .when(~F.col("_live"), "deleted")
                .when(F.col("_live_at") > F.col("_at"), "late")
            )
            part = part.join(at_key, held, "left").select("_key", "_at", reason.alias("reason")).filter("reason is not null")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.select("_key", "_at", F.lit("missing").alias("reason")).filter("false")
    return out.select(
        F.lit(src).alias("src"),
        F.col("_key").cast("string").alias("rec_id"),
        F.substring(F.col("_at").cast("string"), 1, 7).alias("ingest_month"),
        "reason",
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return orphans.groupBy("src", "ingest_month", "reason").agg(F.count("*").alias("n_orphans"))


def either_key(targets: DataFrame, keys: Sequence[str], as_col: str) -> DataFrame:
    """The targets once under each of several alternative keys, where the key is not null."""
    out = None
    for key in keys:
        one = targets.filter(F.col(key).isNotNull()).select(F.col(key).alias(as_col), *[c for c in targets.columns if c != as_col])
        out = one if out is None else out.unionByName(one)
    return out


def knowledge_base_orphans(table) -> DataFrame:
    """Every orphan of the knowledge base. table(name) gives a table of TESTDATA.md."""
    product, document = table("product"), table("document")
    live = {"arrived_col": "ingested_at", "deleted_col": "deleted_at", "at_col": "ingested_at"}
    books = document.select("doc_id", "path", "ingested_at", "deleted_at")
    return (
        find_orphans(table("topic_product"), product, src="topic_product", id_col="link_id", ref_cols=["product_id"], key_cols=["product_id"], **live)
        .unionAll(find_orphans(table("topic_source"), books, src="topic_source", id_col="link_id", ref_cols=["doc_id"], key_cols=["doc_id"], **live))
        .unionAll(
            find_orphans(document, either_key(books, ["doc_id", "path"], "key"), src="document", id_col="doc_id", ref_cols=["superseded_by"], key_cols=["key"], **live)
        )
        .unionAll(find_orphans(table("part_row"), product, src="part_row", id_col="part_id", ref_cols=["product_id"], key_cols=["product_id"], **live))
    )
