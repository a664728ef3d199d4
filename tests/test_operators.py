from datetime import datetime

from pyspark.sql import functions as F

from manualake.functions import text as X
from manualake.operators.dedup import content_duplicates, disambiguate, first_by, superseded
from manualake.operators.fuzzy import best_hits, occurrence_distance, occurrence_distances, scan_numbers, scan_phrases
from manualake.operators.joins import as_of_join, guarded_narrowing, range_join, salted_join, upsert
from manualake.operators.search import bm25, ranked
from manualake.operators.windows import anchored_clusters, distributed_rank, gaps, sessions


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first().r


def test_scalar_functions(spark):
    assert one(spark, X.slug(F.col("a")), a="Ünïted  Parts & Co.") == "united-parts-co"
    assert one(spark, X.ocr_key(F.col("a")), a="S1-O0.B") == "51008"
    assert one(spark, X.weighted_section(F.col("a")), a="4.1.16.2") == 4011602
    assert one(spark, X.natural_key(F.col("a")), a="") == [999]
    assert one(spark, X.leading_int(F.col("a")), a="12A") == 12
    assert one(spark, X.position_key(F.col("a")), a="007B") == "7b"
    assert one(spark, X.built(F.col("a")), a="2019-23-0001") == "2019 · week 23"
    assert one(spark, X.heading(F.col("a")), a="4.1 Cleaning\nbody") == "Cleaning"
    assert one(spark, X.clean(F.col("a")), a="the ﬁlter of door- \nor panel and wa-\nter ( x ) .") == "the filter of door-\nor panel and water (x)."
    assert one(spark, X.substring_score(F.col("a"), ["water"]), a="water") == 60_000 // 45
    assert one(spark, X.near(F.col("a"), F.col("b")), a="thermostat", b="themostat")
    assert not one(spark, X.near(F.col("a"), F.col("b")), a="hose", b="hoses")


def test_choice_and_dedup(spark):
    df = spark.createDataFrame([("h", "b", 2), ("h", "a", 1), (None, "c", 1), ("i", "d", 0)], "h string, n string, r int")
    assert {r.n: r.duplicate_of for r in content_duplicates(df, content="h", name="n", rank=[F.col("r")]).collect()} == {"a": None, "b": "a", "c": None, "d": None}
    assert sorted(tuple(r) for r in first_by(df, ["h"], [F.col("r")]).select("n").collect()) == [("a",), ("c",), ("d",)]
    ed = spark.createDataFrame([("k", "1.2", "x"), ("k", "1.10", "y"), ("k", "1.10", "z"), ("q", None, "w")], "k string, v string, n string")
    roles = {r.n: r.role for r in superseded(ed, keys=["k"], name="n", order=[X.version_key(F.col("v"))]).collect()}
    assert roles == {"x": "superseded", "y": "duplicate", "z": "latest", "w": "latest"}
    ids = disambiguate(df.filter("h = 'h'"), key="h", candidates=[F.lit("")], order=[F.col("n")], fallback=F.col("n"))
    assert {r.n: r.unique_id for r in ids.collect()} == {"a": "h", "b": "h-b"}
    same = spark.createDataFrame([("h", str(i), "s1") for i in range(5)] + [("h-s1", "6", "q")], "h string, n string, s string")
    ids = disambiguate(same, key="h", candidates=[F.col("s")], order=[F.col("n")], fallback=F.lit("s1")).select("unique_id")
    assert ids.distinct().count() == 6


def test_distributed_rank(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("a"), F.lit("x").alias("b")).repartition(7)
    assert all(r["rank"] == r.a + 1 for r in distributed_rank(df, ["b", "a"]).collect())
    assert distributed_rank(df.limit(0), ["a"]).count() == 0


def test_joins(spark):
    rows = spark.createDataFrame([("u", 5, "r1"), ("u", 1, "r0"), ("v", 9, "r2")], "u string, at int, r string")
    anchors = spark.createDataFrame([("u", 2, "a"), ("u", 5, "b")], "u string, at int, a string")
    assert {r.r: r.anchor_a for r in as_of_join(rows, anchors, by=["u"], at="at", take=["a"]).collect()} == {"r0": None, "r1": "b", "r2": None}
    left, right = spark.createDataFrame([(1, 0.9), (1, 5.0)], "g int, x double"), spark.createDataFrame([(1, 1.1), (1, 9.0)], "g int, y double")
    assert [(r.x, r.y) for r in range_join(left, right, by=["g"], left_at="x", right_at="y", reach=0.5).collect()] == [(0.9, 1.1)]
    assert salted_join(rows, spark.createDataFrame([("u", 1)], "u string, z int"), ["u"]).filter("z = 1").count() == 2
    a, b = spark.createDataFrame([("k", ["x"], "old")], "k string, s array<string>, t string"), spark.createDataFrame([("k", ["y"], ""), ("l", ["z"], "new")], "k string, s array<string>, t string")
    assert {r.k: (r.s, r.t) for r in upsert(a, b, key="k", union=["s"], overwrite=["t"]).collect()} == {"k": (["x", "y"], "old"), "l": (["z"], "new")}
    df = spark.createDataFrame([(i, "m" if i < n else "o") for n, i in ((1, 0), (1, 1), (1, 2), (1, 3))], "i int, m string")
    assert guarded_narrowing(df, F.col("m") == "m").count() == 1
    assert guarded_narrowing(df.unionAll(df.filter("m = 'o'")), F.col("m") == "m").count() == 7


def test_windows(spark):
    df = spark.createDataFrame([([1.0, 4.0, 6.0, 20.0],), ([],)], "v array<double>")
    assert [r.c for r in df.select(anchored_clusters(F.col("v"), 4.5).alias("c")).collect()] == [[[1.0, 4.0], [6.0], [20.0]], []]
    iv = spark.createDataFrame([("g", 0, 5), ("g", 1, 2), ("g", 9, 10)], "g string, s int, e int")
    assert [tuple(r) for r in gaps(iv, by=["g"], start="s", end="e", least=3).collect()] == [("g", 5, 9)]
    ev = spark.createDataFrame([("u", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 5, 30)], "u string, ts timestamp_ntz")
    assert [r.session for r in sessions(ev, by=["u"], at="ts", seconds=10).orderBy("ts").collect()] == [1, 1, 2]


def test_search(spark):
    rows = spark.createDataFrame([("1", "water filter", "clean the pump"), ("2", "pump", "water water"), ("3", None, None)], "ref string, title string, body string")
    assert [r.ref for r in bm25(rows, "wat", key="ref").collect()] == ["2", "1"]
    assert bm25(rows, 'a"b', key="ref").count() == bm25(rows, "", key="ref").count() == 0
    assert [r.ref for r in ranked(rows, "Water", key="ref", title="title", body="body").collect()] == ["1", "2"]
    assert ranked(rows, "w", key="ref", title="title").count() == 0


def test_fuzzy(spark):
    assert [occurrence_distance(n, h) for n, h in (("abc", "xxabdxx"), ("abc", "zabcz"), ("", "x"), ("abc", ""))] == [1, 0, 0, 3]
    pairs = [(n, h) for n in ("abc", "filter", "", "ä") for h in ("", "abc", "the filtre", "x" * 300, "zäb")]
    assert occurrence_distances(*map(list, zip(*pairs))) == [occurrence_distance(n, h) for n, h in pairs]
    lines, parts = spark.createDataFrame([("f", "no. S0O1-B here")], "frame string, line string"), spark.createDataFrame([("5001-8",), ("x1",), (None,)], "part_nr string")
    assert [(r.part_nr, r.confidence) for r in scan_numbers(lines, parts).collect()] == [("5001-8", 80)]
    frames = spark.createDataFrame([("f", "the Water tank is empty now"), ("g", "the watr tank is empty now"), ("h", "nothing"), ("i", None)], "frame string, text string")
    found = scan_phrases(frames, spark.createDataFrame([("Water tank is empty",), ("short",)], "phrase string"))
    assert {(r.frame, r.confidence) for r in found.collect()} == {("f", 98), ("g", 92)}
    assert [(r.frame, r["rank"]) for r in best_hits(found, key="phrase", least=95).collect()] == [("f", 1)]
