"""The knowledge base as a library: methods that give DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leading_int, natural_key
from ..operators.inventory import picture_path
from ..operators.search import numbers_first, search
from ..session import table


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def meta(self) -> DataFrame:
        """Rows of each table."""
        names = ("product", "document", "topic", "topic_text", "part_row", "specs")
        out = None
        for name in names:
            one = self.table(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
            out = one if out is None else out.unionAll(one)
        return out

    def machines(self, brand: str | None = None) -> DataFrame:
        p = self.table("product")
        return (p.filter(F.col("brand") == brand) if brand else p).orderBy("brand", "model_code")

    def documents(self, product: str) -> DataFrame:
        """Books of a product, by brand and model."""
        p = self.table("product").filter(F.col("product_id") == product.strip().lower()).select("brand", "model_code")
        return self.table("document").drop("ingested_at").distinct().join(p, ["brand", "model_code"]).orderBy("doctype", "lang", "doc_id")

    def topics(self, *, kind: str | None = None, product: str | None = None, lang: str = "nl", fallback: str = "en") -> DataFrame:
        """Topics with title and text in a language; each column falls back on its own."""
        rows = self.table("topic")
        if kind:
            rows = rows.filter(F.col("kind") == kind)
        if product:
            links = self.table("topic_product").filter(F.lower(F.trim("product_id")) == product.strip().lower()).select("topic_id").distinct()
            rows = rows.join(links, "topic_id", "left_semi")
        texts = self.table("topic_text").withColumn("lang", F.lower("lang"))

        def side(code: str, p: str) -> DataFrame:
            return texts.filter(F.col("lang") == code).groupBy("topic_id").agg(F.lit(code).alias(f"{p}_lang"), F.min_by("title", "text_id").alias(f"{p}_title"), F.min_by("text", "text_id").alias(f"{p}_text"))

        rows = rows.select("topic_id", "kind", "section_no").join(side(lang, "w"), "topic_id", "left").join(side(fallback, "f"), "topic_id", "left")
        shown = [F.coalesce(f"w_{c}", f"f_{c}").alias(c) for c in ("lang", "title", "text")]
        return rows.select("topic_id", "kind", "section_no", *shown).orderBy(natural_key(F.col("section_no")), "topic_id")

    def faults(self, number: str | None = None, **more: str) -> DataFrame:
        """Faults, or those of a section number."""
        return self._numbered(self.topics(kind="fault", **more), number)

    def menu(self, number: str | None = None, **more: str) -> DataFrame:
        return self._numbered(self.topics(kind="menu", **more), number)

    @staticmethod
    def _numbered(rows: DataFrame, number: str | None) -> DataFrame:
        return rows.filter(F.col("section_no").startswith(number)) if number else rows

    def components(self, **more: str) -> DataFrame:
        return self.topics(kind="component", **more)

    def maintenance(self, **more: str) -> DataFrame:
        return self.topics(kind="procedure", **more)

    def part(self, number: str) -> DataFrame:
        rows = self.table("part_row").filter(F.upper("part_nr") == number.strip().upper()).drop("ingested_at").distinct()
        rows = rows.withColumn("product_id", F.lower(F.trim("product_id")))
        return rows.join(self.table("product").select("product_id", "product_name"), "product_id", "left").orderBy("product_id", "drawing", leading_int(F.col("pos")), "part_id")

    def parts(self, product: str, section: str | None = None) -> DataFrame:
        rows = self.table("part_row").filter(F.lower(F.trim("product_id")) == product.strip().lower())
        rows = rows.filter(F.col("section") == section) if section else rows
        return rows.drop("ingested_at").distinct().orderBy("section", leading_int(F.col("pos")), "part_id")

    def drawings(self, product: str) -> DataFrame:
        rows = self.parts(product).filter("drawing is not null")
        return rows.groupBy("drawing").agg(F.min("section_title").alias("title"), F.countDistinct("part_id").alias("n_parts")).orderBy("drawing")

    def _search_rows(self) -> DataFrame:
        texts = self.table("topic_text").filter("text is not null").select(F.col("text_id").alias("ref"), "topic_id", F.lower("lang").alias("lang"), "title", F.col("text").alias("body"))
        return texts.dropDuplicates(["ref"]).join(self.table("topic").select("topic_id", "kind"), "topic_id")

    def search(self, text: str, *, limit: int = 25, kinds: Sequence[str] = (), lang: str | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """Texts by BM25 over all of them, then by kind and language, with a snippet; smaller scores are better."""
        return search(self._search_rows(), text, kinds=kinds, lang=lang, weights=weights, limit=limit)

    def search_parts(self, text: str, product: str | None = None, limit: int = 120) -> DataFrame:
        """Parts by number, which beats the description, or by description and section."""
        rows = self.parts(product) if product else self.table("part_row")
        rows = rows.select("part_id", "part_nr", "description", "section").distinct()
        return numbers_first(rows, text, key="part_id", number="part_nr", text=F.concat_ws(" ", "description", "section"), limit=limit)

    def image_path(self, name: str) -> str:
        """A path as it is, a bare hash as the path of its picture."""
        return self.spark.range(1).select(picture_path(F.lit(name))).first()[0]
