"""Session helpers: tables, the shared folder and lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, named by spark.checkpoint.dir.

    Only where that is unset and all executors are threads of this machine a temporary one is made; a cluster must name its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="manualake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, whose content goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _MADE.append(path)
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    The result has no lineage before the table, every executor can read it again after a loss, and it is stored
    compressed by column. The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has gone
        pass


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scanned table split by key over all cores where its files give fewer parts than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def clear(spark: SparkSession) -> None:
    """Remove the intermediate tables of all results made so far: only once none of them is needed any more."""
    for path in list(_MADE):
        _remove(spark, path)
        _MADE.remove(path)


_MADE: list[str] = []
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each application: their Python need not find it on its own path."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        package = os.path.basename(root)
        at = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package}.zip")
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join(package, os.path.relpath(full, root)))
        spark.sparkContext.addPyFile(at)
        _SHIPPED.add(app)
    return spark
