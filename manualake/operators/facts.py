"""Facts out of section texts: notes, labelled fields, lists, kinds, bodies by language, and repaired tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import groupby, takewhile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions.text import clean, collapse

#: Words that begin a note, by level.
NOTE_WORDS = {
    "note": "note nota opmerking let\\sop hinweis bemærk huomaa merk obs poznámka tip advice",
    "caution": "caution voorzichtig achtung forsigtig varo forsiktig var\\sförsiktig upozornění",
    "warning": "warning waarschuwing warnung advarsel varoitus varning varování",
    "danger": "danger gevaar gefahr fare vaara fara nebezpečí",
    "important": "important belangrijk wichtig vigtigt tärkeää viktigt viktig důležité",
}
#: Words before the number of a page reference.
PAGE_WORDS = "op pagina|on page|auf Seite|à la page|på side|sivulla|på sidan|na stran\\w*"
PAGE_REFERENCE = rf"(?iu)\s*\([^()]*?(?:{PAGE_WORDS})\s*\d+\)"


def without_page_references(c: Column) -> Column:
    """White space collapsed, bracketed references to pages removed."""
    return collapse(F.regexp_replace(c, PAGE_REFERENCE, ""))


def notes(text: Column, words: Mapping[str, str] = NOTE_WORDS) -> Column:
    """Array of (level, text) of the lines that begin with a note's word and go on, or end in a colon."""
    lines = F.filter(F.split(text, "\n"), lambda x: _level(x, words).isNotNull())
    every = "|".join(w for ws in words.values() for w in ws.split())
    return F.transform(lines, lambda x: F.struct(_level(x, words).alias("level"), without_page_references(F.regexp_replace(x, rf"(?iu)^\s*(?:{every})(?!\w)\s*[:!]?\s*", "")).alias("text")))


def rest_of_notes(text: Column, words: Mapping[str, str] = NOTE_WORDS) -> Column:
    """The other lines of a text."""
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: _level(x, words).isNull()), "\n"))


def _level(line: Column, words: Mapping[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for name, ws in words.items():
        out = F.when(line.rlike(rf"(?iu)^\s*(?:{'|'.join(ws.split())})(?!\w)\s*(?:[:!]?\s*\S|:)"), name).otherwise(out)
    return out


FIELDS = T.ArrayType(T.StructType().add("label", T.StringType()).add("text", T.StringType()))


@pandas_udf(FIELDS)
def split_by_labels(texts: pd.Series, labels: pd.Series) -> pd.Series:
    """The fields of a text that its label lines announce, in the order of their first one; lines before any label have the
    label `_intro`, and the first line, a heading, belongs to none. Null texts give null."""
    out = []
    for text, known in zip(texts, labels):
        if text is None or known is None:
            out.append(None)
            continue
        wanted, current, fields = set(known), "_intro", {}
        for line in text.split("\n")[1:]:
            if line.strip() in wanted:
                current = line.strip()
                fields.setdefault(current, [])
            else:
                fields.setdefault(current, []).append(line)
        out.append([{"label": k, "text": "\n".join(v).strip()} for k, v in fields.items()])
    return pd.Series(out)


def learned_labels(sections: DataFrame, *, by: Sequence[str], share: float = 0.5, words: int = 3, least: int = 2) -> DataFrame:
    """Rows (by, label, n) of the lines below the first of sections (text) that stand in a share of a group's bodies and in
    `least` at least: short, without an ending sign; each counts once a body."""
    texts = sections.filter(F.length("text") > 0).withColumn("_body", F.slice(F.split("text", "\n"), 2, 1_000_000))
    total = texts.groupBy(*by).agg(F.count("*").alias("_bodies"))
    lines = texts.select(*by, F.explode(F.array_distinct(F.transform("_body", F.trim))).alias("label"))
    short = lines.filter(F.size(F.split(F.trim("label"), r"\s+")).between(1, words) & (F.col("label") != "") & ~F.col("label").rlike("[.:,?]$"))
    counted = short.groupBy(*by, "label").agg(F.count("*").alias("n"))
    return counted.join(total, list(by)).filter(F.col("n") >= F.greatest(F.lit(least), F.col("_bodies") * share)).drop("_bodies")


def breadcrumb(text: Column, sign: str = ">", first: int = 3) -> Column:
    """The first of the first lines below the heading that holds the sign between blanks; null without one."""
    lines = F.slice(F.split(text, "\n"), 2, first)
    return F.try_element_at(F.filter(lines, lambda x: F.trim(x).rlike(rf"^.{{0,80}}?\s{re.escape(sign)}\s.{{0,120}}$")), F.lit(1))


def kind_of(doctype: Column, number: Column, *, chapters: Mapping[str, Mapping[str, str]], fixed: Mapping[str, str], leaf: Mapping[str, str], usual: Mapping[str, str]) -> Column:
    """The kind of a section: that of its kind of book, else by the chapter of its number. Of the kind `fault` are only
    sections whose number fits the leaf pattern; a numbered section without a kind has the book's usual one, else
    `other`; an unnumbered one is `front`."""
    by_chapter = F.lit(None).cast("string")
    for book, kinds in chapters.items():
        for chapter, kind in kinds.items():
            by_chapter = F.when((doctype == book) & (F.substring_index(number, ".", 1) == chapter), kind).otherwise(by_chapter)
    is_leaf = reduce(lambda a, kv: a | ((doctype == kv[0]) & number.rlike(kv[1])), leaf.items(), F.lit(False))
    by_chapter = F.when((by_chapter == "fault") & ~F.coalesce(is_leaf, F.lit(False)), "other").otherwise(by_chapter)
    own = reduce(lambda rest, kv: F.when(doctype == kv[0], kv[1]).otherwise(rest), fixed.items(), F.lit(None).cast("string"))
    default = reduce(lambda rest, kv: F.when(doctype == kv[0], kv[1]).otherwise(rest), usual.items(), F.lit("other"))
    return F.coalesce(own, by_chapter, F.when(F.length(number) > 0, default), F.lit("front"))


def meat(body: Column, title: Column) -> Column:
    """A body without its number and without the heading that repeats the title."""
    text = F.regexp_replace(F.trim(F.coalesce(body, F.lit(""))), r"^\d+(?:\.\d+)*\.?\s*", "")
    return F.when((F.length(title) > 0) & F.startswith(F.lower(text), F.lower(title)), F.trim(F.substring(text, F.length(title) + 1, F.length(text)))).otherwise(text)


def body_of(bodies: Column, title: Column, langs: Sequence[str], least: int = 25) -> Column:
    """A struct (text, lang) of the first body of a map that has `least` characters besides its heading: by the wanted
    languages, then by name. Null without one."""
    order = F.concat(F.array(*[F.lit(x) for x in langs]), F.filter(F.array_sort(F.map_keys(bodies)), lambda k: ~k.isin(*langs)))
    found = F.filter(F.transform(order, lambda k: F.struct(meat(F.try_element_at(bodies, k), title).alias("text"), k.alias("lang"))), lambda x: F.length(x["text"]) >= least)
    return F.try_element_at(found, F.lit(1))


def has_body(bodies: Column, title: Column, least: int = 25) -> Column:
    """Whether any language has a body: the same rows whatever language is shown."""
    return F.exists(F.map_values(bodies), lambda b: F.length(meat(b, title)) >= least)


def without_empty(m: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(m, lambda _, v: v.isNotNull() & (v != ""))


_CODE = re.compile(r"^(?:[A-Z0-9][A-Z0-9*/+.,()–-]{0,11}|\*{1,3}\)|[A-Z][a-z]*[A-Z][A-Za-z]{0,8})$")


def pair_legend(lines: Sequence[str], least: int = 3, longest: int = 80) -> list[str]:
    """Lines in which chains of at least `least` pairs of a code line and a description line are one line each.

    A pair is a code that does not end in a point above a line that is no code, not blank and not too long."""
    bare = [x.strip() for x in lines]
    code = [bool(_CODE.match(x)) and not x.endswith(".") for x in bare]
    starts = [i for i in range(len(lines) - 1) if code[i] and bare[i + 1] and not code[i + 1] and len(lines[i + 1]) <= longest]
    # Pairs never overlap; those of one chain lie two lines apart.
    joined: set[int] = set()
    for parity in (0, 1):
        own = [i for i in starts if i % 2 == parity]
        for _, chain in groupby(enumerate(own), lambda x: x[1] - 2 * x[0]):
            members = [i for _, i in chain]
            if len(members) >= least:
                joined.update(members)
    return [f"{bare[i]} — {bare[i + 1]}" if i in joined else lines[i] for i in range(len(lines)) if i - 1 not in joined]


_CALL = re.compile(r"(?:^|(?<=\s))(\d{1,2})\.(?=\s)")


def split_callouts(line: str) -> list[str]:
    """`3. a 4. b` as two lines, and so on as long as each next number follows the one before."""
    calls = list(_CALL.finditer(line))
    if not calls or calls[0].start():
        return [line]
    follow = [calls[0]] + [b for a, b in takewhile(lambda ab: int(ab[1][1]) == int(ab[0][1]) + 1, zip(calls, calls[1:]))]
    if len(follow) == 1:
        return [line]
    cuts = [m.start() for m in follow] + [len(line)]
    return [line[b:e].strip() for b, e in zip(cuts, cuts[1:])]


@pandas_udf(T.StringType())
def legends_paired(c: pd.Series) -> pd.Series:
    return c.map(lambda t: "\n".join(pair_legend(t.split("\n"))), na_action="ignore")


@pandas_udf(T.StringType())
def callouts_split(c: pd.Series) -> pd.Series:
    return c.map(lambda t: "\n".join(x for line in t.split("\n") for x in split_callouts(line)), na_action="ignore")


def prose(c: Column) -> Column:
    """Text repaired, its legends paired, its call-outs a line each."""
    return callouts_split(legends_paired(clean(c)))


def scrub(df: DataFrame, repair: Callable[[Column], Column] = clean, verbatim: Sequence[str] = ()) -> DataFrame:
    """repair applied to every string of df, in arrays, maps and structs too, but for those under a verbatim name."""

    def apply(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return repair(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: apply(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: apply(v, kind.valueType))
        if isinstance(kind, T.StructType):
            fields = [(c[f.name] if f.name in verbatim else apply(c[f.name], f.dataType)).alias(f.name) for f in kind.fields]
            return F.when(c.isNotNull(), F.struct(*fields))
        return c

    return df.select(*[F.col(f.name) if f.name in verbatim else apply(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def split_number(title: Column) -> Column:
    """A struct (number, title): a dotted chapter number, or a code of four or five digits, and the rest of a heading."""
    t = F.trim(title)
    number = F.coalesce(
        F.nullif(F.regexp_extract(t, r"^(\d+(?:\.\d+)+|\d{1,3}|\d{6,})\.?\s+\S", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"^(\d{4,5})\.?\s+\S", 1), F.lit(""))
    )
    return F.struct(number.alias("number"), F.when(number.isNotNull(), F.trim(F.regexp_replace(t, r"^\d+(?:\.\d+)*\.?\s+", ""))).otherwise(t).alias("title"))


def starts_alike(a: Column, b: Column, chars: int = 60) -> Column:
    """Whether a heading and a block begin alike: either begins with the other's first `chars` characters."""
    x, y = F.lower(collapse(a)), F.lower(collapse(b))
    return (F.length(x) > 0) & (F.startswith(y, F.left(x, F.lit(chars))) | (F.startswith(x, F.left(y, F.lit(chars))) & (F.length(y) > 8)))


ITEMS = T.ArrayType(T.StructType().add("k", T.StringType()).add("v", T.StringType()))
_ENTRY = re.compile(r"^(\d{1,2})[.)]\s*(.+)$")
_GOES_ON = re.compile(r"^[a-z0-9±°<>≤≥~£+–-]")
_SIGNAL = re.compile(r"^[A-ZÄÖÜ]{4,}[.:]?$")


class TableRepair:
    """Puts the pairs of a table read cell by cell back together, pair by pair.

    A pair of two numbered entries belongs to a legend printed in two columns: those are sorted by number, each number
    once, and stand where the first of them stood. A key in small letters without a value goes on with the item before.
    A key alone is a heading, or a sentence if it ends in a point or has more than eight words; so is a pair whose long
    key the column cut in two. Items without key and value go."""

    def __init__(self) -> None:
        self.items: list[list[str]] = []
        self.legend: dict[int, list[str]] = {}
        self.at = 0
        self.last: list[str] | None = None

    def add(self, key: str, value: str) -> None:
        entries = [_ENTRY.match(x) for x in (key, value)]
        if all(entries):
            self.at = self.at if self.legend else len(self.items)
            for m in entries:
                self.last = [f"{m[1]}.", m[2]]
                self.legend.setdefault(int(m[1]), self.last)
        elif self.last is not None and _GOES_ON.match(key) and (not value or _SIGNAL.match(value)):
            k = 0 if key.startswith("(") else 1
            self.last[k] = f"{self.last[k]} {key}".strip()
        else:
            self.last = self.item(key, value)
            self.items.append(self.last)

    @staticmethod
    def item(key: str, value: str) -> list[str]:
        words = len(key.split())
        if key and not value:
            return ["", key] if key.endswith(".") or words > 8 else [key, ""]
        if value and len(key) > 45 and words > 6:
            return ["", f"{key} {value}"]
        return [key, value]

    def rows(self) -> list[list[str]]:
        legend = [self.legend[n] for n in sorted(self.legend)]
        return [x for x in self.items[: self.at] + legend + self.items[self.at :] if x[0] or x[1]]


@pandas_udf(ITEMS)
def repaired_table(items: pd.Series) -> pd.Series:
    """TableRepair of lists of (k, v), white space collapsed; null lists stay null."""
    out = []
    for pairs in items:
        if pairs is None:
            out.append(None)
            continue
        table = TableRepair()
        for p in pairs:
            k, v = (" ".join((p[c] or "").split()) if p is not None else "" for c in ("k", "v"))
            if k or v:
                table.add(k, v)
        out.append([{"k": k, "v": v} for k, v in table.rows()])
    return pd.Series(out)


def parts_table(lines: DataFrame, headers: Mapping[str, str], *, page: Sequence[str], slack: float = 6.0, reach: float = 4.5) -> DataFrame:
    """The rows of tables printed as loose lines (page columns, x, y, t): (page columns, y, cells map<column, text>).

    Lines whose heights lie within reach of a row's first one are that row; a line belongs to the right-most header at
    or before its x, headers being the lines whose text is a name of `headers`, in a row that has four of them. Repeated
    header rows give no row. A page's places are gathered in one row each: they are bounded by the page."""
    from .windows import anchored_clusters

    lines = lines.select(*page, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.trim("t").alias("t")).filter("t <> ''")
    tops = lines.groupBy(*page).agg(F.transform(anchored_clusters(F.collect_set("y"), reach), lambda c: c[0]).alias("_tops"))
    placed = lines.join(tops, list(page)).withColumn("_y", F.try_element_at(F.filter("_tops", lambda a: a <= F.col("y")), F.lit(-1))).drop("_tops")
    heads = placed.filter(F.col("t").isin(*headers)).groupBy(*page, "_y").agg(F.array_sort(F.collect_list(F.struct("x", "t"))).alias("_heads")).filter(F.size("_heads") >= 4)
    first = heads.groupBy(*page).agg(F.min_by("_heads", "_y").alias("_heads"))
    names = F.create_map(*[F.lit(v) for kv in headers.items() for v in kv])
    column = F.coalesce(F.try_element_at(F.filter("_heads", lambda h: h["x"] <= F.col("x") + slack), F.lit(-1)), F.element_at("_heads", 1))["t"]
    cells = placed.join(heads.select(*page, "_y"), [*page, "_y"], "left_anti").join(first, list(page)).withColumn("_c", F.element_at(names, column))
    texts = cells.groupBy(*page, "_y", "_c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "t"))), lambda l: l["t"]), " ").alias("_t"))
    return texts.groupBy(*page, F.col("_y").alias("y")).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_t"))).alias("cells"))


def row_kind(cells: Column, *, groups: Sequence[str] = ("SETS?", "PARTS?", "KITS?", "TOOLS?", "OPTIONS?", "ACCESSOIRES?")) -> Column:
    """`group` of a heading that stands alone, `ref` of a reference to another drawing, `note` of a line under the table,
    else `part`."""
    joined = F.trim(F.array_join(F.map_values(cells), " "))
    note = reduce(lambda a, b: a | b, [F.lower(joined).startswith(x) for x in ("part numbers marked", "all rights", "no part of")])
    ref = F.coalesce(F.try_element_at(cells, F.lit("description")), F.lit("")).rlike(r"(?i)^refer to drawing\s+\d{3,5}")
    return F.when(joined.rlike(rf"(?i)^(?:{'|'.join(groups)})$"), "group").when(note, "note").when(ref, "ref").otherwise("part")


def folded_rows(rows: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """Rows (by, y, cells) with continuation rows added to the part above, and the group that a heading names.

    A row of its own has a part number and a drawing, a position, or a number that begins with a digit and is long
    enough; others add their number, description and a missing quantity to the last part, unless a reference lies
    between. A group heading does not end a part."""
    w = Window.partitionBy(*by).orderBy("y")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    cell = {c: F.nullif(F.trim(F.coalesce(F.try_element_at("cells", F.lit(c)), F.lit(""))), F.lit("")) for c in ("drawing", "pos", "stock", "part_nr", "qty", "description")}
    rows = rows.select(*by, "y", row_kind(F.col("cells")).alias("_kind"), F.upper(F.trim(F.array_join(F.map_values("cells"), " "))).alias("_all"), *[c.alias(n) for n, c in cell.items()])
    number = F.replace("part_nr", F.lit(" "), F.lit(""))
    own = number.isNotNull() & ~number.rlike(r"(?i)^[-–][A-Z0-9]{2,}$") & (F.col("drawing").isNotNull() | F.col("pos").isNotNull() | number.rlike(r"^[0-9][A-Z0-9]{5,}[A-Z0-9-]*$"))
    starts = (F.col("_kind") == "ref") | ((F.col("_kind") == "part") & own)
    rows = rows.withColumn("group", F.last(F.when(F.col("_kind") == "group", F.col("_all")), ignorenulls=True).over(up)).filter("_kind in ('part', 'ref')")
    rows = rows.withColumn("_own", starts).withColumn("_part", F.sum(F.when(starts, 1).otherwise(0)).over(up)).filter("_part > 0")
    ordered = F.array_sort(F.collect_list(F.struct("y", "part_nr", "description", "qty")))
    first = {c: F.min_by(c, "y").alias(c) for c in ("drawing", "pos", "stock", "group", "_kind")}
    out = rows.groupBy(*by, "_part").agg(F.min("y").alias("y"), ordered.alias("_l"), *first.values())
    joined = {c: F.array_join(F.filter(F.transform("_l", lambda x: x[c]), lambda x: x.isNotNull()), sep) for c, sep in (("part_nr", ""), ("description", " "))}  # noqa: B023
    told = F.filter("_l", lambda x: x["qty"].isNotNull() & F.coalesce(x["part_nr"], x["description"]).isNotNull())
    qty = F.try_element_at(told, F.lit(1))["qty"]
    return out.filter("_kind = 'part'").select(*by, "y", "group", "drawing", "pos", "stock", F.nullif(joined["part_nr"], F.lit("")).alias("part_nr"), qty.alias("qty"), F.nullif(joined["description"], F.lit("")).alias("description"))


def markers_folded(lines: DataFrame, *, by: Sequence[str], order: Sequence[str], y: str = "y", text: str = "text", reach: float = 4.5) -> DataFrame:
    """Lines that are only a marker go; the next line at the same height, else the one before, gets the marker in front,
    unless it carries one. A marker without such a line is dropped."""
    marker = r"^\s*(?:[•▪◦·‣–—-]|\d{1,2}[.)]|[a-z][.)]|\([0-9a-z]\))"
    w = Window.partitionBy(*by).orderBy(*order)
    only = F.col(text).rlike(marker + r"\s*$")
    near_next, near_before = F.abs(F.lead(y).over(w) - F.col(y)) < reach, F.abs(F.lag(y).over(w) - F.col(y)) < reach
    to = F.when(only & F.coalesce(near_next, F.lit(False)), 1).when(only & F.coalesce(near_before, F.lit(False)), -1).otherwise(0)
    rows = lines.withColumn("_only", only).withColumn("_to", to)
    from_before, from_after = F.when(F.lag("_to").over(w) == 1, F.trim(F.lag(text).over(w))), F.when(F.lead("_to").over(w) == -1, F.trim(F.lead(text).over(w)))
    rows = rows.withColumn("_mark", F.coalesce(from_before, from_after)).filter("not _only")
    carries = F.col(text).rlike(marker + r"\s+")
    return rows.withColumn(text, F.when(F.col("_mark").isNotNull() & ~carries, F.concat_ws(" ", "_mark", F.ltrim(text))).otherwise(F.col(text))).drop("_only", "_to", "_mark")
