"""Queries of the text problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .bilingual import align_texts
from .canonical import canonical, look_alike_pairs
from .canonical import records as look_records
from .encoding import decode, encode
from .language_id import fit_language_model, laid_out, language_segments, wrong_labels
from .leakage import leaked_passages
from .near_duplicates import classes_with_links, expand, near_duplicates, section_records
from .scan_noise import Layout, ScanNoise
from .scan_noise import records as scan_records
from .shared_spans import shared_share, shared_spans

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "topic_text"), "text_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _scan_noise(spark: SparkSession, sf_dir: str) -> ScanNoise:
    rows = scan_records(_texts(spark, sf_dir), spread(table(spark, sf_dir, "part_row"), "part_id"))
    return ScanNoise(rows, table(spark, sf_dir, "product"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_noise(spark, sf_dir).damage()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan_noise(spark, sf_dir).repaired()


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, layout = laid_out(_texts(spark, sf_dir), table(spark, sf_dir, "product"))
    return language_segments(texts, fit_language_model(texts, layout), layout)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrong_labels(_segments(spark, sf_dir))


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir).drop("n_segments").dropDuplicates(["text_id", "segment"])


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = section_records(table(spark, sf_dir, "topic"), table(spark, sf_dir, "topic_text"))
    return near_duplicates(docs, shingle=3, threshold=0.6, least_words=25)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand(*_sections(spark, sf_dir)).select(F.col("a").alias("text_id_a"), F.col("b").alias("text_id_b"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of the corpus, with production parameters: its class of equal sets and its number of links."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("head"), "text")
    return classes_with_links(*near_duplicates(docs)).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = look_records(table(spark, sf_dir, "topic"), _texts(spark, sf_dir))
    return look_alike_pairs(rows)


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = look_records(table(spark, sf_dir, "topic"), _texts(spark, sf_dir))
    return canonical(rows).distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).select("topic_id", "text_id", "lang", "text")
    manuals = table(spark, sf_dir, "topic").filter("doctype = 'um'").select("topic_id").distinct()
    model = fit_language_model(texts, Layout(frozenset(), frozenset()))
    return align_texts(texts, manuals, model).drop("score")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_documents(spark, sf_dir))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids decode to; an empty one for a null text."""
    return decode(encode(_documents(spark, sf_dir)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(_documents(spark, sf_dir), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(_documents(spark, sf_dir))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return shared_share(shared_spans(docs), docs)


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_repaired, p4_found, p4_segments, p5_found, p5_classes, p6_found, p6_forms, p7_found, p8_ids, p8_decoded,
            p9_found, p9_spans, p10_found, p10_share,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"p8_decoded": "select doc_id, coalesce(text, '') as text from documents"}
