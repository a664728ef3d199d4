"""Files in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def inventory(spark: SparkSession, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """Rows (path, name, bytes, modified, sha256) of the files below root whose name fits; hidden folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, schema: str, *, multi_line: bool = True) -> DataFrame:
    """JSON records, plain or gzip; unknown keys are ignored, missing ones null. A missing file is an empty table."""
    try:
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_locale(spark: SparkSession, root: str, locale: str, schema: str, default: str = "nl") -> DataFrame:
    """The rows of a locale of a tree partitioned by locale, else those of the default."""
    rows = read_json(spark, f"{root}/locale={locale}", schema, multi_line=False)
    return rows if rows.head(1) else read_json(spark, f"{root}/locale={default}", schema, multi_line=False)


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """Nulls of the named columns filled."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def write_json(df: DataFrame, path: str, *, by: Sequence[str] = (), gzip: bool = False) -> None:
    """JSON lines, one folder for each value of `by`."""
    writer = df.write.mode("overwrite").option("compression", "gzip" if gzip else "none")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_tables(tables: dict[str, DataFrame], root: str, lookups: dict[str, Sequence[str]] | None = None) -> None:
    """Every table as parquet, sorted within files by its lookup columns, so that point lookups skip row groups."""
    for name, df in tables.items():
        keys = (lookups or {}).get(name, ())
        (df.sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def content_addressed(blobs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The blobs (content) to write: one for each hash, none that is blank or already known (hash)."""
    rows = blobs.filter(F.length("content") > 0).withColumn("hash", F.sha1("content")).groupBy("hash").agg(F.any_value("content").alias("content"))
    return rows if known is None else rows.join(known.select("hash"), "hash", "left_anti")


def file_plan(docs: DataFrame, target: Column) -> DataFrame:
    """What to do with each file (path, duplicate_of): `delete` duplicates, `move` others to target, or `keep` them there.

    A plan only; nothing is touched."""
    action = F.when(F.col("duplicate_of").isNotNull(), "delete").when(F.col("path") == target, "keep").otherwise("move")
    return docs.select("path", action.alias("action"), F.when(F.col("duplicate_of").isNull(), target).alias("to"))


def markdown_index(docs: DataFrame, *, group: str, title: str, limit: int = 10_000) -> str:
    """A list of titles by group, for at most `limit` rows: a report, made by the driver."""
    out: list[str] = []
    last: object = object()
    for r in docs.select(group, title).orderBy(group, title).limit(limit).collect():
        if r[0] != last:
            out += [f"## {r[0]}", ""] if not out else ["", f"## {r[0]}", ""]
            last = r[0]
        out.append(f"- {r[1]}")
    return "\n".join(out)


def inferred_schema(df: DataFrame, json_column: str) -> str:
    """The schema of all JSON values of a column, conflicting types united; invalid JSON is left out."""
    return df.agg(F.expr(f"schema_of_variant_agg(try_parse_json({json_column}))")).first()[0]


def described_schema(df: DataFrame, comments: dict[str, str]) -> str:
    """The schema as JSON, with a comment on each described column."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns]).schema.json()


def pretty_json(df: DataFrame) -> DataFrame:
    """Rows (text) of indented JSON records; nulls are kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("text"))


def index_lines(docs: DataFrame, *, group: str, title: str) -> DataFrame:
    """The lines of a list of titles by group, as rows (group, rank, line) to be sorted by group and rank: nothing is collected."""
    rows = docs.select(F.col(group).alias("group"), F.col(title).alias("title"))
    heads = rows.select("group").distinct().select("group", F.lit(0).alias("kind"), F.concat(F.lit("## "), "group").alias("line"))
    items = rows.select("group", F.lit(1).alias("kind"), F.concat(F.lit("- "), "title").alias("line"))
    rank = F.row_number().over(Window.partitionBy("group").orderBy("kind", "line"))
    return heads.unionAll(items).filter("line is not null").select("group", rank.alias("rank"), "line")


def moves(plan: DataFrame) -> DataFrame:
    """Old and new names of the files that a plan (path, action, to) keeps or moves."""
    return plan.filter("action <> 'delete'").select(F.col("path").alias("old"), F.coalesce("to", "path").alias("new"))


def frame_stream(spark: SparkSession, root: str, schema: str, *, files: int = 1) -> DataFrame:
    """A stream of frames stored as JSON lines, `files` files a micro-batch, by age."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(root)
