"""Quantities in common units, and the units of values that state none (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.measures import UNITS, bare_measure, bare_number, measure

QUANTITIES = sorted({quantity for quantity, _, _ in UNITS.values()})

MEASURED = "spec_id bigint, item_no int, key string, value string, quantity string, unit string, low bigint, high bigint, bare_low double, bare_high double"


def read_measures(specs: DataFrame) -> DataFrame:
    """One row for each list entry of specs (spec_id, items array<struct<k, v>>), with the quantity that it states.

    low and high are in the common unit, converted exactly, then rounded to whole units (half to even); they, quantity
    and unit are null where value states no known quantity. bare_low and bare_high hold a number without any unit.
    Null items, k or v, and values beyond 62 bits, give null quantities; null or empty lists no row. Repeated deliveries give equal rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for spec_id, items in zip(ids, lists):
                for n, item in enumerate(items or ()):
                    k, v = (item["k"], item["v"]) if item else (None, None)
                    m = measure(k, v)
                    if m and max(-m.low, m.high) >= 1 << 62:
                        m = None
                    bare = None if m else bare_number(v)
                    out.append((spec_id, n, k, v, *((m.quantity, m.unit, round(m.low), round(m.high)) if m else (None,) * 4), *(bare or (None, None))))
            cols = list(zip(*out)) if out else [()] * 10
            types = [pa.int64(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in MEASURED.split(", ")])

    return specs.select("spec_id", "items").mapInArrow(read, MEASURED)


def stated_measures(specs: DataFrame) -> DataFrame:
    """Distinct rows (spec_id, item_no, low, high) of the entries that state a quantity."""
    return read_measures(specs).filter("quantity is not null").select("spec_id", "item_no", "low", "high").distinct()


def unit_features(specs: DataFrame) -> DataFrame:
    """Of each list entry that holds a number: its magnitude, notation, source, category and neighbouring fields.

    label is the stated unit, `none` for numbers of labels that never have a unit, null where the unit is missing.
    """
    item = F.col("item")
    shape = F.regexp_replace(F.col("value"), r"\d+", "9")
    entries = (
        read_measures(specs)
        .withColumn("stem", F.coalesce(F.lower(F.regexp_replace("key", r"\s*(\[.*\]|\(.*\)|,.*|\s(in|en|i)\s+\S+)\s*$", "")), F.lit("")))
        .withColumn("number", F.expr("try_cast(replace(regexp_extract(replace(value, ',', '.'), '([0-9]+([.][0-9]+)?)', 1), ' ', '') as double)"))
        .withColumn("shape", F.regexp_extract(shape, r"(9(?:[., ]9)?)", 1))
    )
    sources = specs.select("spec_id", "grp", "model_code", "lang").dropDuplicates(["spec_id"])
    kinds = {"imperial": ("in", "ft", "oz", "lb", "psi", "°F"), "small": ("mg", "Pa", "mbar", "ms", "mm", "ml")}
    around = entries.groupBy("spec_id").agg(F.count("unit").alias("n_units"), *[F.count_if(F.col("unit").isin(*us)).alias(f"n_{k}") for k, us in kinds.items()])
    # What a label measures, from all other entries under it: its share of each quantity.
    never = entries.groupBy("stem").agg(
        F.count("unit").alias("stem_units"), F.count("bare_low").alias("stem_bare"), F.count("*").alias("stem_all"), *[F.count_if(F.col("quantity") == q).alias(f"n_{q}") for q in QUANTITIES]
    )
    one = F.col("unit").isNotNull().cast("int")

    def others(n: Column, own: Column, of: Column) -> Column:
        """A share among the other entries: an entry's own unit, which is to be told, is no evidence."""
        return F.coalesce((n - F.coalesce(own.cast("int"), F.lit(0))) / F.nullif(of, F.lit(0)), F.lit(0.0))

    return (
        entries.filter("number is not null")
        .join(sources, "spec_id")
        .join(around, "spec_id")
        .join(never, "stem")
        .select(
            "spec_id", "item_no", "value", "bare_low", "bare_high",
            "stem", F.coalesce("grp", F.lit("")).alias("grp"),
            F.coalesce(F.substring(F.lower("lang"), 1, 2), F.lit("")).alias("lang"), F.coalesce("model_code", F.lit("")).alias("model"),
            F.log1p(F.abs("number")).alias("magnitude"), "shape",
            *[others(F.col(f"n_{k}"), F.col("unit").isin(*us), F.col("n_units") - one).alias(k) for k, us in kinds.items()],
            *[others(F.col(f"n_{q}"), F.col("quantity") == q, F.col("stem_all") - 1).alias(f"is_{q}") for q in QUANTITIES],
            F.coalesce("unit", F.when((F.col("stem_units") == 0) & (F.col("stem_bare") >= 3), "none")).alias("label"),
        )
    )


def smallest_hashes(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """The bound rows with the smallest hash _h. Only some twice as many meet in one place, however many rows there are."""
    rows = rows.withColumn("_h", F.xxhash64(key))
    share = min(1.0, 2.0 * bound / max(1, rows.count()))
    few = rows.filter(F.pmod("_h", F.lit(1 << 30)) < int(share * (1 << 30)))
    return few.orderBy("_h").limit(bound)


class UnitModel:
    """A random forest over unit_features whose confidence is calibrated by isotonic regression on held-out rows."""

    def __init__(self, labels: StringIndexerModel, forest: RandomForestClassificationModel, bounds: list[float], values: list[float]):
        self.labels, self.forest, self.bounds, self.values = labels, forest, bounds, values

    @staticmethod
    def _hashed(df: DataFrame) -> DataFrame:
        """Source and category in a few hashed columns, the rest as numbers."""
        hasher = FeatureHasher(inputCols=["grp", "lang", "model", "shape"], outputCol="_named", numFeatures=16)
        numbers = ["magnitude", "imperial", "small", *[f"is_{q}" for q in QUANTITIES]]
        return VectorAssembler(inputCols=[*numbers, "_named"], outputCol="features").transform(hasher.transform(df)).drop("_named")

    @classmethod
    def fit(cls, features: DataFrame, *, sample_bound: int = 20_000, trees: int = 30, depth: int = 12) -> UnitModel:
        """Fit on at most sample_bound labelled entries, those with the smallest hash; a fifth of them only calibrates."""
        known = smallest_hashes(features.filter("label is not null"), F.xxhash64("spec_id", "item_no"), sample_bound)
        known = cls._hashed(known).select("label", "features", "_h").persist()
        try:
            labels = StringIndexer(inputCol="label", outputCol="y", handleInvalid="skip").fit(known)
            rows = labels.transform(known)
            train, held = rows.filter(F.pmod("_h", F.lit(5)) != 0), rows.filter(F.pmod("_h", F.lit(5)) == 0)
            forest = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7, maxBins=64, featureSubsetStrategy="onethird").fit(train)
            scored = forest.transform(held).select(
                F.array_max(vector_to_array("probability")).alias("p"), (F.col("prediction") == F.col("y")).cast("double").alias("right")
            )
            iso = IsotonicRegression(featuresCol="p", labelCol="right").fit(scored)
            return cls(labels, forest, list(map(float, iso.boundaries.toArray())), list(map(float, iso.predictions.toArray())))
        finally:
            known.unpersist()

    def predict(self, features: DataFrame) -> DataFrame:
        """Adds the most likely unit and its calibrated confidence."""
        scored = self.forest.transform(self._hashed(features)).withColumn("_p", F.array_max(vector_to_array("probability")))
        back = IndexToString(inputCol="prediction", outputCol="predicted", labels=self.labels.labels).transform(scored)
        steps = F.lit(self.values[0] if self.values else 0.0)
        for bound, value in zip(self.bounds, self.values):
            steps = F.when(F.col("_p") >= bound, F.lit(value)).otherwise(steps)
        return back.withColumn("confidence", steps).drop("features", "rawPrediction", "probability", "prediction", "_p")


def _route(least: float) -> Column:
    return F.when(F.col("confidence") < least, "review").when(F.col("predicted") == "none", "none").otherwise("convert")


def held_out_accuracy(specs: DataFrame, *, least: float = 0.9, sample_bound: int = 20_000) -> DataFrame:
    """Rows (route, n, accuracy, confidence): entries with a stated unit, a tenth of all, that the classifier never saw, told
    without their unit; how many of each route it tells right, and how sure it is on average."""
    features = unit_features(specs)
    hidden = F.pmod(F.xxhash64("spec_id", "item_no", F.lit("hidden")), F.lit(10)) == 0
    model = UnitModel.fit(features.filter(~hidden), sample_bound=sample_bound)
    rows = model.predict(features.filter(hidden & F.col("label").isNotNull())).withColumn("route", _route(least))
    right = (F.col("predicted") == F.col("label")).cast("double")
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg(right), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))


@pandas_udf(T.StructType().add("quantity", T.StringType()).add("low", T.LongType()).add("high", T.LongType()))
def bare_measure_udf(values: pd.Series, units: pd.Series) -> pd.DataFrame:
    """bare_measure of two columns, rounded as stated quantities are; null beyond 62 bits."""
    out = []
    for value, unit in zip(values, units):
        m = bare_measure(value, unit)
        out.append((m.quantity, round(m.low), round(m.high)) if m and max(-m.low, m.high) < 1 << 62 else (None, None, None))
    return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=t) for i, (c, t) in enumerate((("quantity", object), ("low", "Int64"), ("high", "Int64")))})


def infer_missing_units(specs: DataFrame, *, least: float = 0.9, sample_bound: int = 20_000) -> DataFrame:
    """Numbers that state no unit, with the unit that the classifier gives them.

    Rows (spec_id, item_no, value, predicted, confidence, route, quantity, low, high): route is `convert` from the
    calibrated confidence `least` on, `none` where the confident answer is that there is no unit, else `review`.
    quantity, low and high are those of the value in the predicted unit, as read_measures gives stated ones; null
    unless route is `convert`, and beyond 62 bits.
    """
    features = unit_features(specs)
    model = UnitModel.fit(features, sample_bound=sample_bound)
    rows = model.predict(features.filter("bare_low is not null"))
    routed = rows.select("spec_id", "item_no", "value", "predicted", F.round("confidence", 4).alias("confidence"), _route(least).alias("route")).distinct()
    converted = bare_measure_udf(F.col("value"), F.when(F.col("route") == "convert", F.col("predicted")))
    return routed.withColumn("_m", converted).select(*routed.columns, "_m.quantity", "_m.low", "_m.high")
