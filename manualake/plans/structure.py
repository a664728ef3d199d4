"""Structure of texts and pages over the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layout import columns_of, reading_order, reflow
from .registry import Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql


_MARK = "^\\s*(?:\\d{1,3}[.)]|[-–•*])\\s"


@query(f"""with l as (select text_id, unnest(string_split_regex(text, '\r?\n')) line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) i from (select distinct text_id, text from topic_text where text is not null)),
    a as (select *, trim(lag(line) over (partition by text_id order by i)) above from l), p as (select *, sum((above is null or above = '' or regexp_matches(above, '[.!?:]$') or regexp_matches(line, '{_MARK}'))::int) over (partition by text_id order by i rows unbounded preceding) p from a)
    select text_id, cast(p as bigint) paragraph, string_agg(trim(line), ' ' order by i) text from p where trim(line) <> '' group by 1, 2""")
def win10_reflowed_paragraphs(t: Tables) -> DataFrame:
    rows = t("topic_text").filter("text is not null").select("text_id", "text").dropDuplicates(["text_id"])
    return reflow(rows.select("text_id", F.posexplode(F.split("text", "\r?\n")).alias("i", "line")), by=["text_id"], order=["i"])


@query()
def srt14_reading_order(t: Tables) -> DataFrame:
    """Events of a user and day as boxes of a page."""
    box = t("events").select("user_id", F.to_date("ts").alias("page"), "event_id", F.col("value").alias("x0"), (F.col("event_id") % 700).cast("double").alias("y0"))
    box = box.withColumn("x1", F.col("x0") + 40).withColumn("y1", F.col("y0") + 9)
    return reading_order(box, ("user_id", "page")).select("user_id", "page", "event_id", "place")


@query("""with d as (select distinct user_id, value x from events), n as (select *, case when coalesce(x - lag(x) over (partition by user_id order by x), 0) > 12 then 1 else 0 end s from d)
    select user_id, round(x, 6) x, cast(sum(s) over (partition by user_id order by x rows unbounded preceding) as bigint) "column" from n""")
def win7_columns(t: Tables) -> DataFrame:
    cells = t("events").select("user_id", F.col("value").alias("x")).distinct()
    return columns_of(cells, 100, by=["user_id"]).select("user_id", F.round("x", 6).alias("x"), "column")
