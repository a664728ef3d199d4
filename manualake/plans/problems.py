"""Queries of the general training-data problems, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import find_orphans, knowledge_base_orphans, orphan_report
from ..operators.units import held_out_accuracy, infer_missing_units, read_measures, stated_measures
from ..session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge_base_orphans(lambda name: table(spark, sf_dir, name))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p2_found(spark, sf_dir))


def p2_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose composite reference (brand, model_code), null in part at times, names no live product (MATCH PARTIAL)."""
    return find_orphans(
        table(spark, sf_dir, "document"), table(spark, sf_dir, "product"), src="document", id_col="doc_id", at_col="ingested_at",
        ref_cols=["brand", "model_code"], key_cols=["brand", "model_code"], arrived_col="ingested_at", deleted_col="deleted_at", match="partial",
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stated_measures(table(spark, sf_dir, "specs"))


def p3_by_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated quantities and their range in the common unit."""
    rows = read_measures(table(spark, sf_dir, "specs")).filter("quantity is not null").dropDuplicates(["spec_id", "item_no"])
    return (
        rows.join(table(spark, sf_dir, "common_unit").select("quantity", F.col("unit").alias("common_unit")), "quantity")
        .groupBy("quantity", "common_unit")
        .agg(F.count("*").alias("n"), F.min("low").alias("least"), F.max("high").alias("most"))
    )


def p3_missing_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer_missing_units(table(spark, sf_dir, "specs"))


def p3_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the classifier tells hidden units right, by route."""
    return held_out_accuracy(table(spark, sf_dir, "specs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_report, p2_composite, p3_found, p3_by_quantity, p3_missing_units, p3_held_out)}


_KEY = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"


def _orphans(src: str, rec: str, ref: str, targets: str) -> str:
    return f"""
    select '{src}' src, cast(r.id as varchar) rec_id, strftime(r.arrived, '%Y-%m') ingest_month,
           case when t.k is null then 'missing' when t.live is null then 'deleted' else 'late' end reason
    from (select {rec} id, min(ingested_at) arrived, {_KEY.format(f'arg_min({ref}, ingested_at)')} k from {src} group by 1) r
    left join (select {_KEY.format('k')} k, min(case when deleted_at is null then ingested_at end) live from ({targets}) group by 1) t on t.k = r.k
    where r.k is not null and (t.k is null or t.live is null or t.live > r.arrived)"""


_PRODUCTS = "select product_id k, ingested_at, deleted_at from product"
_BOOKS = "select doc_id k, ingested_at, deleted_at from document"
_FOUND = " union all ".join(
    [
        _orphans("topic_product", "link_id", "product_id", _PRODUCTS),
        _orphans("topic_source", "link_id", "doc_id", _BOOKS),
        _orphans("document", "doc_id", "superseded_by", f"{_BOOKS} union all select path, ingested_at, deleted_at from document"),
        _orphans("part_row", "part_id", "product_id", _PRODUCTS),
    ]
)


def oracle_sql() -> dict[str, str]:
    composite = """
    with r as (select doc_id id, min(ingested_at) arrived, lower(trim(any_value(brand))) b, lower(trim(any_value(model_code))) m from document group by 1),
    t as (select lower(trim(brand)) b, lower(trim(model_code)) m, ingested_at, deleted_at from product)
    select * from (select 'document' src, id rec_id, strftime(arrived, '%Y-%m') ingest_month,
      case when not exists (select 1 from t where (r.b is null or r.b = t.b) and (r.m is null or r.m = t.m)) then 'missing'
           when not exists (select 1 from t where (r.b is null or r.b = t.b) and (r.m is null or r.m = t.m) and deleted_at is null) then 'deleted'
           when not exists (select 1 from t where (r.b is null or r.b = t.b) and (r.m is null or r.m = t.m) and deleted_at is null and t.ingested_at <= r.arrived) then 'late' end reason
      from r where b is not null or m is not null) where reason is not null"""
    return {
        "p2_found": _FOUND,
        "p2_report": f"select src, ingest_month, reason, count(*) n_orphans from ({_FOUND}) group by all",
        "p2_composite": composite,
    }
