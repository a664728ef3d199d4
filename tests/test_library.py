import json
import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manualake.operators.facts import TableRepair, notes, pair_legend, rest_of_notes, scrub, split_callouts
from manualake.operators.layout import columns_of, key_values, list_entries, merged_tiles, nearest_header, reading_order, reflow, xy_cut
from manualake.operators.plates import merge_plates, read_plates
from manualake.plans.knowledge_base import KnowledgeBase
from manualake.sources import files

DATA = "/root/testdata/sf0.001"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"one")
    (tmp_path / "y.pdf").write_bytes(b"one")
    (tmp_path / "z.txt").write_bytes(b"two")
    rows = files.inventory(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in rows) == ["x.PDF", "y.pdf"] and len({r.sha256 for r in rows}) == 1
    df = spark.createDataFrame([("nl", 1, None), ("en", 2, "b")], "locale string, a int, b string")
    files.write_json(df, str(tmp_path / "out"), by=["locale"], gzip=True)
    assert files.read_locale(spark, str(tmp_path / "out"), "en", "a int").first().a == 2
    assert files.read_locale(spark, str(tmp_path / "out"), "xx", "a int").first().a == 1
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert files.with_defaults(df, b="-").filter("b = '-'").count() == 1
    files.write_tables({"t": df}, str(tmp_path / "tables"), {"t": ["a"]})
    assert spark.read.parquet(str(tmp_path / "tables" / "t.parquet")).count() == 2


def test_plans_and_schemas(spark):
    docs = spark.createDataFrame([("p", None), ("q", "p"), ("new/r", None)], "path string, duplicate_of string")
    plan = {r.path: (r.action, r.to) for r in files.file_plan(docs, F.concat(F.lit("new/"), F.element_at(F.split("path", "/"), -1))).collect()}
    assert plan == {"p": ("move", "new/p"), "q": ("delete", None), "new/r": ("keep", "new/r")}
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b""),), (None,)], "content binary")
    assert files.content_addressed(blobs).count() == 1 and files.content_addressed(blobs, files.content_addressed(blobs)).count() == 0
    assert files.markdown_index(docs.withColumn("g", F.lit("G")), group="g", title="path") == "## G\n\n- new/r\n- p\n- q"
    j = spark.createDataFrame([('{"a": 1}',), ('{"a": "x", "b": [1]}',), ("no",), (None,)], "j string")
    assert "a" in files.inferred_schema(j, "j")
    assert json.loads(files.described_schema(docs, {"path": "where"}))["fields"][0]["metadata"] == {"comment": "where"}


@given(st.lists(st.tuples(*[st.integers(0, 50)] * 2), max_size=12))
def test_xy_cut_orders_every_box_once(at):
    assert sorted(xy_cut([(x, y, x + 5, y + 5) for x, y in at])) == list(range(len(at)))


def test_layout(spark):
    boxes = [("d", 1, "right", 60.0, 20.0, 100.0, 40.0), ("d", 1, "left2", 0.0, 32.0, 40.0, 40.0), ("d", 1, "left1", 0.0, 20.0, 40.0, 28.0), ("d", 1, "head", 0.0, 0.0, 100.0, 8.0)]
    df = spark.createDataFrame(boxes, "doc_id string, page int, t string, x0 double, y0 double, x1 double, y1 double")
    assert [r.t for r in reading_order(df).orderBy("place").collect()] == ["head", "left1", "left2", "right"]
    cells = spark.createDataFrame([("p", 0.0), ("p", 5.0), ("p", 50.0)], "p string, x double")
    assert [r.column for r in columns_of(cells, 100, by=["p"]).orderBy("x").collect()] == [0, 0, 1]
    heads = spark.createDataFrame([("p", "A", 0.0), ("p", "B", 10.0)], "p string, name string, header_x double")
    assert [r.name for r in nearest_header(cells, heads, by=["p"]).orderBy("x").collect()] == ["A", "B", "B"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Open the", "cover.", "", "1. Clean", "it", "- dry"])], "d string, i int, line string")
    assert [r.text for r in reflow(lines, by=["d"], order=["i"]).orderBy("paragraph").collect()] == ["Open the cover.", "1. Clean it", "- dry"]
    text = spark.createDataFrame([("intro\n1. a\n b\n2. c",), (None,)], "t string")
    assert [r.e for r in text.select(list_entries(F.col("t")).alias("e")).collect()] == [["a b", "c"], None]
    t = spark.createDataFrame([("WARNING: hot (see on page 4)\nopen it\nnoted well\nLET OP\ntip: dry",), (None,)], "t string")
    got = t.select(notes(F.col("t")).alias("n"), rest_of_notes(F.col("t")).alias("r")).collect()
    assert [(x.level, x.text) for x in got[0].n] == [("warning", "hot"), ("note", "dry")] and got[0].r == "open it\nnoted well\nLET OP"
    assert got[1].n is None and got[1].r is None
    tiles = spark.createDataFrame([("p", 3, 0.0, 0.0, 5.0, 5.0), ("p", 1, 6.0, 0.0, 9.0, 5.0), ("p", 2, 6.0, 50.0, 9.0, 55.0), ("q", 9, 0.0, 0.0, 1.0, 1.0)], "p string, k long, x0 double, y0 double, x1 double, y1 double")
    assert {r.k: r.tile for r in merged_tiles(tiles, by=["p"], key="k", reach=1.0).collect()} == {3: 1, 1: 1, 2: 2, 9: 9}


def test_scrub_reaches_nested_strings(spark):
    df = spark.createDataFrame([(" a ", [(" k ", " v ")], {"x": " y "}, 1)], "t string, l array<struct<k:string,v:string>>, m map<string,string>, n int")
    r = scrub(df, repair=F.trim, verbatim=["v"]).first()
    assert r.t == "a" and (r.l[0].k, r.l[0].v) == ("k", " v ") and r.m == {"x": "y"} and r.n == 1


def test_table_repair():
    t = TableRepair()
    for k, v in [("Size", "10"), ("1. pump", "5. hose"), ("2. ring", "1. twice"), ("mm wide", ""), ("Heading", ""), ("It is long.", ""), ("", "only a value"), ("w" * 20 + " a b c d e f " + "x" * 20, "cut in two")]:
        t.add(k, v)
    assert t.rows() == [["Size", "10"], ["1.", "pump"], ["2.", "ring"], ["5.", "hose"], ["Heading", ""], ["", "It is long."], ["", "only a value"], ["", "w" * 20 + " a b c d e f " + "x" * 20 + " cut in two"]]


def test_pure_pieces():
    assert split_callouts("3. a 4. b 9. c") == ["3. a", "4. b 9. c"]
    assert split_callouts("Parts 3. a 4. b") == ["Parts 3. a 4. b"] and split_callouts("") == [""]
    assert pair_legend(["A1", "pump", "B2", "hose", "C3", "ring", "end"]) == ["A1 — pump", "B2 — hose", "C3 — ring", "end"]
    assert pair_legend(["A1", "pump", "x"]) == ["A1", "pump", "x"]
    assert pair_legend(["A1", "p" * 81, "B2", "hose", "C3", "ring"])[1] == "p" * 81
    assert key_values([["a", "1"], ["b"], ["2"], ["c"], [], ["A", "d", "3", "4"]]) == [("a", "1"), ("b", "2"), ("c", ""), ("d", "3 4")]


def test_plates(spark):
    frames = [["Type: 9HPTX123", "Serial nr 20142386812001"], ["HPTX99 here", "1234567", "Model: Orvo HPT"], ["Serial nr"], ["clean the filter 1234567"], ["2021.14.0428.001"], [], ["Orvo 20.2 machine", "made in holland"]]
    df = spark.createDataFrame(list(enumerate(frames)), "frame int, lines array<string>")
    got = {r.frame: r.plate for r in read_plates(df, [("HPT", "orvo"), ("HP", None)], [("ORVO", "orvo")]).collect()}
    assert (got[0].build, got[0].code, got[0].serial, got[0].machine) == ("HPT", "9HPTX123", "", "orvo")
    assert (got[1].code, got[1].serial, got[1].model) == ("HPTX99", "1234567", "Orvo HPT")
    assert got[2] is not None and got[2].code == "" and got[3] is None and got[5] is None
    assert (got[4].serial, got[4].built) == ("2021.14.0428.001", "2021 · week 14")
    assert (got[6].model, got[6].machine) == ("Orvo 20.2 machine", "orvo")
    plates = read_plates(df, [("HPT", "orvo")]).filter("frame in (0, 4)").groupBy().pivot("frame", [0, 4]).agg(F.first("plate"))
    merged = plates.select(merge_plates(F.col("0"), F.col("4")).alias("m")).first().m
    assert (merged.build, merged.serial) == ("HPT", "2021.14.0428.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_knowledge_base(spark):
    kb = KnowledgeBase(spark, DATA)
    assert {r.name for r in kb.meta().collect()} >= {"topic", "part_row"}
    product = kb.machines().first().product_id
    for df in (kb.documents(product), kb.topics(product=product), kb.faults(), kb.menu(lang="de"), kb.components(), kb.maintenance(), kb.parts(product), kb.drawings(product)):
        df.collect()
    number = kb.table("part_row").filter("part_nr is not null").first().part_nr
    assert kb.part(number.lower()).count() >= 1
    assert kb.search_parts(number).first().score >= 1_000
    assert kb.search("filter", kinds=["menu", "fault", "procedure", "component"], lang="en").count() <= 25
