"""Structure of pages: reading order, rows, columns, paragraphs, lists and legends."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

MARKER = re.compile(r"^\s*(?:(\d{1,3})[.)]|[-–•*])\s+(.*)$", re.DOTALL)


def xy_cut(boxes: Sequence[tuple[float, float, float, float]], gap_y: float = 6.0, gap_x: float = 14.0, depth: int = 12) -> list[int]:
    """Reading order of boxes (x0, y0, x1, y1): cut at the first wide horizontal gap, else at vertical ones, recursively."""

    def parts(ids: list[int], lo: int, hi: int, gap: float) -> list[list[int]]:
        out, reach = [], None
        for i in sorted(ids, key=lambda k: (boxes[k][lo], boxes[k][hi], k)):
            if reach is None or boxes[i][lo] - reach >= gap:
                out.append([])
            out[-1].append(i)
            reach = boxes[i][hi] if reach is None else max(reach, boxes[i][hi])
        return out

    def order(ids: list[int], left: int) -> list[int]:
        if left and len(ids) > 1:
            for lo, hi, gap in ((1, 3, gap_y), (0, 2, gap_x)):
                cut = parts(ids, lo, hi, gap)
                if len(cut) > 1:
                    return [i for part in cut for i in order(part, left - 1)]
        return sorted(ids, key=lambda k: (boxes[k][1], boxes[k][0], k))

    return order(list(range(len(boxes))), depth)


def _per_page(rows: DataFrame, page: Sequence[str], fields: Sequence[str], new: str, of: Callable[[list[dict]], list[int]]) -> DataFrame:
    """Adds the column new, of(rows of a page) each: a page is one row of arrays, and many pages share a batch."""
    pages = rows.groupBy(*page).agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in page])).alias("_rows"))
    numbered = pages.withColumn("_places", F.pandas_udf(lambda s: s.map(lambda r: of([{f: x[f] for f in fields} for x in r])), T.ArrayType(T.LongType()))("_rows"))
    each = numbered.select(*page, F.explode(F.arrays_zip("_rows", "_places")).alias("_r"))
    return each.select(*page, "_r._rows.*", F.col("_r._places").alias(new))


def reading_order(blocks: DataFrame, page: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """Adds place, the reading order of blocks (x0, y0, x1, y1) within their page; a page fits a row."""
    sides = ("x0", "y0", "x1", "y1")

    def places(rows: list[dict]) -> list[int]:
        out = [0] * len(rows)
        for k, i in enumerate(xy_cut([tuple(float(r[s]) for s in sides) for r in rows])):
            out[i] = k
        return out

    return _per_page(blocks, page, sides, "place", places).withColumn("place", F.col("place").cast("int"))


def merged_tiles(boxes: DataFrame, *, by: Sequence[str], key: str, reach: float) -> DataFrame:
    """Adds tile, the least key of the boxes (x0, y0, x1, y1) of a page that lie within reach of each other, directly or
    through others. A page fits a row; boxes meet only while a sweep from the left holds both."""

    def tiles(rows: list[dict]) -> list[int]:
        parent = list(range(len(rows)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        held: list[int] = []
        for i in sorted(range(len(rows)), key=lambda k: rows[k]["x0"]):
            held = [j for j in held if rows[j]["x1"] + reach >= rows[i]["x0"]]
            for j in held:
                if rows[j]["y0"] - reach <= rows[i]["y1"] and rows[i]["y0"] - reach <= rows[j]["y1"]:
                    parent[root(j)] = root(i)
            held.append(i)
        least: dict[int, int] = {}
        for i, r in enumerate(rows):
            least[root(i)] = min(least.get(root(i), r[key]), r[key])
        return [least[root(i)] for i in range(len(rows))]

    return _per_page(boxes, by, ("x0", "y0", "x1", "y1", key), "tile", tiles)


def columns_of(cells: DataFrame, width: float, *, by: Sequence[str], x: str = "x", share: float = 0.12) -> DataFrame:
    """Adds column: a new one begins where the gap to the previous distinct x exceeds a share of the width."""
    w = Window.partitionBy(*by).orderBy(x)
    distinct = cells.select(*by, x).distinct().withColumn("_new", (F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0)) > share * width).cast("int"))
    numbered = distinct.withColumn("column", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return cells.join(numbered, [*by, x])


def nearest_header(cells: DataFrame, headers: DataFrame, *, by: Sequence[str], slack: float = 6.0) -> DataFrame:
    """Each cell (x) with the right-most header (name, header_x) at or before x + slack; none is a null name. The headers
    of a page travel as one array."""
    heads = headers.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("header_x", "name"))).alias("_heads"))
    found = F.try_element_at(F.filter("_heads", lambda h: h["header_x"] <= F.col("x") + slack), F.lit(-1))["name"]
    return cells.join(heads, list(by), "left").withColumn("name", found).drop("_heads")


def reflow(lines: DataFrame, *, by: Sequence[str], order: Sequence[str], text: str = "line") -> DataFrame:
    """Paragraphs of lines: a line continues the one above unless that is blank or ends a sentence, or it begins a list entry."""
    w = Window.partitionBy(*by).orderBy(*order)
    above = F.lag(F.trim(text)).over(w)
    starts = above.isNull() | (above == "") | above.rlike("[.!?:]$") | F.col(text).rlike(r"^\s*(?:\d{1,3}[.)]|[-–•*])\s")
    numbered = lines.withColumn("_p", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.trim(text) != "")
    rows = numbered.groupBy(*by, "_p").agg(F.array_sort(F.collect_list(F.struct(*order, F.trim(text).alias("_t")))).alias("_l"))
    return rows.select(*by, F.col("_p").alias("paragraph"), F.array_join(F.transform("_l", lambda x: x["_t"]), " ").alias("text"))


def list_entries(text: Column) -> Column:
    """Entries of numbered or bulleted lines, wrapped lines added to theirs; what precedes the first marker is dropped."""
    lines = F.split(text, "\n")
    marker = r"^\s*(?:\d{1,3}[.)]|[-–•*])\s+"

    def add(acc: Column, line: Column) -> Column:
        bare = F.trim(F.regexp_replace(line, marker, ""))
        last = F.try_element_at(acc, F.lit(-1))
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        grown = F.concat(head, F.array(F.concat_ws(" ", last, bare)))
        return F.when(line.rlike(marker), F.concat(acc, F.array(bare))).when((F.size(acc) > 0) & (bare != ""), grown).otherwise(acc)

    return F.when(text.isNotNull(), F.aggregate(lines, F.array().cast("array<string>"), add))


PAIRS = T.ArrayType(T.StructType().add("k", T.StringType()).add("v", T.StringType()))


@pandas_udf(PAIRS)
def key_values_udf(tables: pd.Series) -> pd.Series:
    return pd.Series([None if rows is None else [{"k": k, "v": v} for k, v in key_values(rows)] for rows in tables])


def key_values(cells: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """Rows of a table as pairs; a mark of one or two letters before two cells is left out; a lone cell fills the previous
    empty value, else it is a key without one."""
    out: list[tuple[str, str]] = []
    for row in cells:
        full = [c.strip() for c in row if c and c.strip()]
        if len(full) >= 3 and len(full[0]) <= 2:
            full = full[1:]
        key, *values = full or [""]
        if key and not values and out and not out[-1][1]:
            out[-1] = (out[-1][0], key)
        elif key:
            out.append((key, " ".join(values)))
    return out
