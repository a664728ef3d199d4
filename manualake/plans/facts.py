"""Facts, lists, tables and layout of section texts over the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import facts as O
from ..operators import inventory as V
from ..operators.dedup import first_by
from ..operators.layout import list_entries
from ..operators.windows import anchored_clusters, changed, forward_fill, islands
from .registry import WS, Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql

_TEXTS = "(select distinct text_id, text from topic_text where text is not null)"


def texts(t: Tables, *more: str) -> DataFrame:
    return t("topic_text").filter("text is not null").select("text_id", "text", *more).distinct()


# Scalar functions


@query(f"""select text_id, trim(regexp_replace(regexp_replace(text, '{WS}*\\([^()]*?(?:op pagina|on page|auf Seite|à la page|på side|sivulla|på sidan|na stran[\\w]*){WS}*\\d+\\)', '', 'gi'), '{WS}+', ' ', 'g')) text from {_TEXTS}""")
def str6_page_references(t: Tables) -> DataFrame:
    return texts(t).select("text_id", O.without_page_references(F.col("text")).alias("text"))


@query("""with l as (select distinct spec_id, items from specs where len(items) > 0), n as (select spec_id, unnest(items) i, generate_subscripts(items, 1) o from l),
    x as (select spec_id, unnest([coalesce(i.k, ''), coalesce(i.v, '')]) line, o * 2 + unnest([0, 1]) p from n),
    c as (select *, regexp_matches(trim(line), '^(?:[A-Z0-9][A-Z0-9*/+.,()–-]{0,11}|\\*{1,3}\\)|[A-Z][a-z]*[A-Z][A-Za-z]{0,8})$') and not ends_with(trim(line), '.') code from x),
    s as (select *, code and coalesce(lead(trim(line)) over w <> '' and not lead(code) over w and lead(length(line)) over w <= 80, false) st from c window w as (partition by spec_id order by p)),
    g as (select *, p - 2 * row_number() over (partition by spec_id, st, p % 2 order by p) g from s), k as (select *, st and count(*) over (partition by spec_id, st, p % 2, g) >= 3 joined from g),
    r as (select *, coalesce(lag(joined) over w, false) gone, case when joined then trim(line) || ' — ' || trim(lead(line) over w) else line end shown from k window w as (partition by spec_id order by p))
    select spec_id, string_agg(shown, chr(10) order by p) text from r where not gone group by 1""")
def str7_paired_legends(t: Tables) -> DataFrame:
    """The labels and values of tables as a legend, one line each."""
    lines = F.flatten(F.transform("items", lambda i: F.array(F.coalesce(i["k"], F.lit("")), F.coalesce(i["v"], F.lit("")))))
    rows = t("specs").filter(F.size("items") > 0).select("spec_id", "items").distinct().select("spec_id", F.array_join(lines, "\n").alias("text"))
    return rows.select("spec_id", O.legends_paired("text").alias("text"))


@query("""with l as (select distinct spec_id, items from specs where len(items) > 0), n as (select spec_id, unnest(items) i, generate_subscripts(items, 1) o from l)
    select spec_id, string_agg(o || '. ' || trim(regexp_replace(coalesce(i.k, '-'), '[0-9.]', '', 'g')), chr(10) order by o) text from n where o <= 99 group by 1""")
def str8_split_callouts(t: Tables) -> DataFrame:
    """Call-outs printed on one line, `1. a 2. b`, a line each."""
    named = F.transform("items", lambda i, n: F.concat((n + 1).cast("string"), F.lit(". "), F.trim(F.regexp_replace(F.coalesce(i["k"], F.lit("-")), "[0-9.]", ""))))
    rows = t("specs").filter(F.size("items") > 0).select("spec_id", "items").distinct()
    return rows.select("spec_id", O.callouts_split(F.array_join(F.slice(named, 1, 99), " ")).alias("text"))


@query()
def str9_prose(t: Tables) -> DataFrame:
    return texts(t).select("text_id", O.prose(F.col("text")).alias("text"))


@query(f"""select distinct spec_id, grp, list_transform(items, lambda i: trim(regexp_replace(i.k, '{WS}+', ' ', 'g')) || '=' || i.v) items from specs""")
def str10_scrubbed(t: Tables) -> DataFrame:
    """White space collapsed in every nested string but those named v and grp."""
    rows = O.scrub(t("specs").select("spec_id", "grp", "items"), repair=X.collapse, verbatim=["v", "grp"])
    return rows.select("spec_id", "grp", F.transform("items", lambda i: F.concat(i["k"], F.lit("="), i["v"])).alias("items")).distinct()


@query(f"""select part_id, trim(regexp_replace(regexp_replace(description, '[0-9]', '#', 'g'), '{WS}+', ' ', 'g')) k from part_row group by all""")
def str11_margin_keys(t: Tables) -> DataFrame:
    return t("part_row").select("part_id", X.margin_key(F.col("description")).alias("k")).distinct()


@query("""with h as (select topic_id, trim(coalesce(section_no || ' ', '') || coalesce(title, '')) x from topic)
    select topic_id, nullif(regexp_extract(x, '^(\\d+(?:\\.\\d+)*)\\.?\\s+\\S', 1), '') number, case when regexp_matches(x, '^\\d+(?:\\.\\d+)*\\.?\\s+\\S') then trim(regexp_replace(x, '^\\d+(?:\\.\\d+)*\\.?\\s+', '')) else x end title from h""")
def str12_numbers_of_headings(t: Tables) -> DataFrame:
    heading = F.concat(F.coalesce(F.concat("section_no", F.lit(" ")), F.lit("")), F.coalesce("title", F.lit("")))
    return t("topic").select("topic_id", O.split_number(heading).alias("s")).select("topic_id", "s.*")


@query(f"""with x as (select distinct text_id, lower(trim(regexp_replace(coalesce(title, ''), '{WS}+', ' ', 'g'))) a, lower(trim(regexp_replace(text, '{WS}+', ' ', 'g'))) b from topic_text where text is not null)
    select text_id, a <> '' and (starts_with(b, left(a, 60)) or (starts_with(a, left(b, 60)) and length(b) > 8)) located from x""")
def str13_located_headings(t: Tables) -> DataFrame:
    return texts(t, "title").select("text_id", O.starts_alike(F.coalesce("title", F.lit("")), F.col("text")).alias("located")).distinct()


_ITEMS = "(select spec_id, trim(i.k) k, trim(i.v) v, o from (select spec_id, unnest(items) i, generate_subscripts(items, 1) o from (select distinct spec_id, items from specs)) where trim(i.k) <> '' and trim(i.v) <> '')"


@query(f"""with i as {_ITEMS}, f as (select spec_id, k, string_agg(v, chr(10) order by o) v from i group by 1, 2) select spec_id, list_sort(list(k || '=' || v)) fields from f group by 1""")
def str21_labelled_fields(t: Tables) -> DataFrame:
    """Tables written as lines of labels and values, taken apart by their labels again."""
    kept = F.filter(F.transform("items", lambda i: F.struct(F.trim(i["k"]).alias("k"), F.trim(i["v"]).alias("v"))), lambda i: (i["k"] != "") & (i["v"] != ""))
    rows = t("specs").select("spec_id", "items").distinct().withColumn("items", kept).filter(F.size("items") > 0)
    text = F.concat(F.lit("heading\n"), F.array_join(F.flatten(F.transform("items", lambda i: F.array(i["k"], i["v"]))), "\n"))
    fields = O.split_by_labels(text, F.transform("items", lambda i: i["k"]))
    return rows.select("spec_id", F.array_sort(F.transform(fields, lambda f: F.concat(f["label"], F.lit("="), f["text"]))).alias("fields"))


_LEVELS = {level: "|".join(words.split()) for level, words in O.NOTE_WORDS.items()}
_LEVEL_SQL = "case " + " ".join(f"when regexp_matches(line, '(?i)^\\s*(?:{w})(?:\\s*(?:[:!]|$)|\\s+\\S|[^\\w\\s])') then '{level}'" for level, w in reversed(_LEVELS.items())) + " end"


@query(f"""with l as (select text_id, unnest(string_split(text, chr(10))) line from {_TEXTS}), n as (select text_id, {_LEVEL_SQL} as level from l where regexp_matches(line, '(?i)^\\s*(?:{"|".join(_LEVELS.values())})(?:[^\\wæøåäöüéèáíýčěšžůďťň]|$)'))
    select level, count(*) n from n where level is not null group by 1""")
def str22_notes(t: Tables) -> DataFrame:
    """Notes by level over all texts."""
    return texts(t).select(F.explode(O.notes(F.col("text"))).alias("note")).groupBy(F.col("note.level").alias("level")).agg(F.count("*").alias("n"))


@query(f"""with l as (select text_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from {_TEXTS}), m as (select *, regexp_matches(line, '^\\s*(?:\\d{{1,3}}[.)]|[-–•*])\\s+') mark from l),
    g as (select *, sum(mark::int) over (partition by text_id order by n rows unbounded preceding) g from m), e as (select text_id, g, string_agg(trim(regexp_replace(line, '^\\s*(?:\\d{{1,3}}[.)]|[-–•*])\\s+', '')), ' ' order by n) e from g where g > 0 and (mark or trim(line) <> '') group by 1, 2)
    select text_id, coalesce(list(e order by g) filter (where e is not null), []) entries from {_TEXTS} left join e using (text_id) group by 1""")
def str23_entries_of_lists(t: Tables) -> DataFrame:
    return texts(t).select("text_id", list_entries(F.col("text")).alias("entries"))


@query(f"""with l as (select text_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n from {_TEXTS})
    select text_id, arg_min(line, n) crumb from l where n between 2 and 4 and regexp_matches(trim(line), '^.{{0,80}}?\\s\\|\\s.{{0,120}}$') group by 1""")
def str24_breadcrumbs(t: Tables) -> DataFrame:
    return texts(t).select("text_id", O.breadcrumb(F.col("text"), "|").alias("crumb")).filter("crumb is not null")


CHAPTERS = {"tm": {"1": "safety", "2": "view", "4": "component", "6": "menu", "8": "fault", "9": "spec"}, "um": {"1": "safety", "2": "view", "6": "fault", "7": "spec"}}


@query("""select topic_id, case when doctype = 'sm' then 'maintenance_step' when doctype = 'pb' then 'drawing' when doctype = 'br' then 'brochure'
    when doctype = 'tm' and c = '8' then case when regexp_matches(section_no, '^8\\.\\d+$') then 'fault' else 'other' end when doctype = 'um' and c = '6' then case when regexp_matches(section_no, '^6\\.\\d+$') then 'fault' else 'other' end
    when doctype in ('tm', 'um') and c = '1' then 'safety' when doctype in ('tm', 'um') and c = '2' then 'view' when doctype = 'tm' and c = '4' then 'component' when doctype = 'tm' and c = '6' then 'menu' when doctype = 'tm' and c = '9' then 'spec' when doctype = 'um' and c = '7' then 'spec'
    when length(section_no) > 0 then case when doctype in ('im', 'um') then 'howto' else 'other' end else 'front' end kind from (select *, split_part(section_no, '.', 1) c from topic)""")
def str25_kinds_of_sections(t: Tables) -> DataFrame:
    kind = O.kind_of(F.col("doctype"), F.col("section_no"), chapters=CHAPTERS, fixed={"sm": "maintenance_step", "pb": "drawing", "br": "brochure"}, leaf={"tm": r"^8\.\d+$", "um": r"^6\.\d+$"}, usual={"im": "howto", "um": "howto"})
    return t("topic").select("topic_id", kind.alias("kind"))


@query("""select topic_id, case when kind = 'spec' then 'electronics' when regexp_matches(lower(title), 'melk|milk|lait|mælk') then 'milk' when section_no = '4.1' or starts_with(section_no, '4.1.') then 'water' when section_no = '4.2' or starts_with(section_no, '4.2.') then 'brewer'
    when section_no = '5' or starts_with(section_no, '5.') then 'electronics' else 'other' end "group" from topic""")
def str27_component_groups(t: Tables) -> DataFrame:
    no = F.col("section_no")
    group = F.when(F.col("kind") == "spec", "electronics").when(F.lower("title").rlike("melk|milk|lait|mælk"), "milk")
    for prefix, name in (("4.1", "water"), ("4.2", "brewer"), ("5", "electronics")):
        group = group.when((no == prefix) | no.startswith(prefix + "."), name)
    return t("topic").select("topic_id", group.otherwise("other").alias("group"))


INTERVALS = {"daily": "daily", "dagelijks": "daily", "täglich": "daily", "weekly": "weekly", "wekelijks": "weekly", "monthly": "monthly", "yearly": "yearly", "annual": "yearly"}


@query("select text_id, " + "case " + " ".join(f"when contains(lower(text), '{w}') then '{k}'" for w, k in INTERVALS.items()) + f" else 'other' end \"interval\" from {_TEXTS}")
def str28_intervals(t: Tables) -> DataFrame:
    return texts(t).select("text_id", V.first_keyword(F.col("text"), INTERVALS, "other").alias("interval"))


_MEAT = "case when coalesce({1}, '') <> '' and starts_with(lower(m), lower({1})) then trim(substr(m, length({1}) + 1)) else m end"


@query(f"""select distinct text_id, {_MEAT.format('', 'title')} meat from (select text_id, title, regexp_replace(trim(coalesce(text, '')), '^\\d+(?:\\.\\d+)*\\.?\\s*', '') m from topic_text)""")
def str30_meat(t: Tables) -> DataFrame:
    return t("topic_text").select("text_id", O.meat(F.col("text"), F.col("title")).alias("meat")).distinct()


# Filters and maps by language


def bodies(t: Tables) -> DataFrame:
    """Topics with a map of their bodies by language: the first text of each."""
    rows = t("topic_text").filter("lang is not null and trim(lang) <> ''").groupBy("topic_id", F.lower(F.trim("lang")).alias("lang")).agg(F.min_by("text", "text_id").alias("text"))
    rows = rows.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("body"))
    return t("topic").select("topic_id", "kind", "title").join(rows, "topic_id")


_BODIES = """(select t.topic_id, t.kind, t.title, x.lang, x.text, regexp_replace(trim(coalesce(x.text, '')), '^\\d+(?:\\.\\d+)*\\.?\\s*', '') m from topic t join
    (select topic_id, lower(trim(lang)) lang, arg_min_null(text, text_id) text from topic_text where lang is not null and trim(lang) <> '' group by 1, 2) x using (topic_id))"""


@query(f"with b as {_BODIES} select topic_id from b group by 1 having bool_or(length({_MEAT.format('', 'title')}) >= 200)")
def flt15_any_language_has_body(t: Tables) -> DataFrame:
    return bodies(t).filter(O.has_body(F.col("body"), F.col("title"), 200)).select("topic_id")


@query(f"""with b as {_BODIES}, k as (select topic_id, lang, {_MEAT.format('', 'title')} x from b), r as (select *, row_number() over (partition by topic_id order by coalesce(list_position(['nl', 'en'], lang), 99), lang) k from k where length(x) >= 25)
    select topic_id, lang, x as text from r where k = 1""")
def map2_body_by_language(t: Tables) -> DataFrame:
    rows = bodies(t).select("topic_id", O.body_of(F.col("body"), F.col("title"), ["nl", "en"]).alias("b")).filter("b is not null")
    return rows.select("topic_id", "b.lang", "b.text")


@query(f"""with b as {_BODIES} select topic_id, list_sort(list(lang) filter (where text is not null and text <> '')) langs from b group by 1 having count(*) filter (where text is not null and text <> '') > 0""")
def map3_without_empty(t: Tables) -> DataFrame:
    rows = bodies(t).select("topic_id", F.array_sort(F.map_keys(O.without_empty(F.col("body")))).alias("langs"))
    return rows.filter(F.size("langs") > 0)


@query("""select brand, list_sort(list(distinct model_code || '=' || cabinet_size)) sizes from product where cabinet_size is not null group by 1""")
def map4_nested_maps(t: Tables) -> DataFrame:
    """brand -> code -> size, accumulated, then as text."""
    inner = t("product").filter("cabinet_size is not null").groupBy("brand", "model_code").agg(F.min("cabinet_size").alias("s"))
    nested = inner.groupBy("brand").agg(F.map_from_entries(F.collect_list(F.struct("model_code", "s"))).alias("m"))
    return nested.select("brand", F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("sizes"))


@query(f"""with l as (select text_id, unnest(string_split(text, chr(10))) line from {_TEXTS}), k as (select *, trim(regexp_replace(regexp_replace(line, '[0-9]', '#', 'g'), '{WS}+', ' ', 'g')) k from l), d as (select k from (select distinct text_id, k from k) where k <> '' group by 1 having count(*) > 2)
    select text_id, count(*) kept from k where k not in (select k from d) group by 1""")
def flt13_running_lines_rejected(t: Tables) -> DataFrame:
    lines = texts(t).select("text_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("k", X.margin_key(F.col("line")))
    drop = lines.filter("k <> ''").select("text_id", "k").distinct().groupBy("k").agg(F.count("*").alias("n")).filter("n > 2")
    return lines.join(drop, "k", "left_anti").groupBy("text_id").agg(F.count("*").alias("kept"))


@query("select distinct text_id from topic_text where (trim(coalesce(text, '')) <> '' or payload is not null) and coalesce(page, 1) > 0 and title is not null")
def flt14_empty_sections_rejected(t: Tables) -> DataFrame:
    """Sections with a heading and a text or a payload."""
    some = (F.trim(F.coalesce("text", F.lit(""))) != "") | F.col("payload").isNotNull()
    return t("topic_text").filter(some & (F.coalesce("page", F.lit(1)) > 0) & F.col("title").isNotNull()).select("text_id").distinct()


@query("""select topic_id from topic join topic_text x using (topic_id) where kind = 'menu' group by 1 having bool_or(length(trim(coalesce(x.text, ''))) >= 100 or x.page is not null or try_cast(json_extract_string(x.payload, '$.steps') as int) > 3)""")
def flt16_menu_kept(t: Tables) -> DataFrame:
    """Menu topics with a body, a page or steps in any language."""
    steps = F.from_json("payload", "steps int")["steps"] > 3
    any_ = F.bool_or(F.coalesce((F.length(F.trim(F.coalesce("text", F.lit("")))) >= 100) | F.col("page").isNotNull() | F.coalesce(steps, F.lit(False)), F.lit(False)))
    rows = t("topic").filter("kind = 'menu'").select("topic_id").join(t("topic_text").select("topic_id", "text", "page", "payload"), "topic_id")
    return rows.groupBy("topic_id").agg(any_.alias("keep")).filter("keep").select("topic_id")


# Tables of parts


HEADERS = {"Drawing": "drawing", "Pos": "pos", "S": "stock", "Part Nr": "part_nr", "Qty": "qty", "Spare Part Description": "description"}
_AT = {"drawing": 10.0, "pos": 60.0, "stock": 90.0, "part_nr": 120.0, "qty": 200.0, "description": 240.0}


def part_lines(t: Tables) -> DataFrame:
    """The rows of parts as loose lines of a page for each drawing: a header row, a cell a line, a second line of
    description below, a group heading above."""
    p = t("part_row").filter("drawing is not null").select("drawing", F.substring("part_id", 2, 20).cast("double").alias("n"), *[c for c in _AT if c != "drawing"], "grp").distinct()
    top = F.col("n") * 20
    own = [F.struct(F.lit(x).alias("x"), top.alias("y"), F.col(c).alias("t")) for c, x in _AT.items() if c != "description"]
    first, second = F.substring_index("description", "\n", 1), F.when(F.contains("description", F.lit("\n")), F.regexp_replace("description", r"^[^\n]*\n", ""))
    own += [F.struct(F.lit(240.0).alias("x"), top.alias("y"), first.alias("t")), F.struct(F.lit(240.0).alias("x"), (top + 6).alias("y"), F.regexp_replace(second, "\n", " ").alias("t"))]
    own += [F.struct(F.lit(10.0).alias("x"), (top - 7).alias("y"), F.col("grp").alias("t"))]
    cells = p.select("drawing", F.explode(F.array(*own)).alias("l")).select(F.col("drawing").alias("page"), "l.*")
    heads = p.select(F.col("drawing").alias("page")).distinct().select("page", F.explode(F.array(*[F.struct(F.lit(_AT[c]).alias("x"), F.lit(-50.0).alias("y"), F.lit(h).alias("t")) for h, c in HEADERS.items()])).alias("l"))
    return cells.unionAll(heads.select("page", "l.*")).filter("t is not null")


def part_rows(t: Tables) -> DataFrame:
    return O.parts_table(part_lines(t), HEADERS, page=["page"])


_PARTS = "(select distinct drawing, cast(substr(part_id, 2) as double) n, pos, stock, part_nr, qty, description, grp from part_row where drawing is not null)"


@query(f"select drawing as page, n * 20 y, 'drawing' as \"column\", trim(drawing) as text from {_PARTS} union all select drawing, n * 20, 'part_nr', trim(part_nr) from {_PARTS} where trim(part_nr) <> '' union all select drawing, n * 20, 'qty', trim(qty) from {_PARTS} where trim(qty) <> ''")
def arr6_columns_of_cells(t: Tables) -> DataFrame:
    """Each cell under the right-most header at or before it."""
    rows = part_rows(t).filter(O.row_kind(F.col("cells")) == "part").filter(F.try_element_at("cells", F.lit("drawing")).isNotNull())
    return rows.select("page", "y", F.explode("cells").alias("column", "text")).filter(F.col("column").isin("drawing", "part_nr", "qty"))


@query(f"""select kind, count(*) n from (select 'part' kind from {_PARTS} union all select 'part' from {_PARTS} where contains(description, chr(10)) and trim(replace(substr(description, instr(description, chr(10)) + 1), chr(10), ' ')) <> '' union all select 'group' from {_PARTS} where trim(grp) <> '') group by 1""")
def arr7_rows_by_kind(t: Tables) -> DataFrame:
    """Rows of the tables: parts, their second lines, and group headings."""
    return part_rows(t).groupBy(O.row_kind(F.col("cells")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with p as (select drawing as page, n, last_value(upper(trim(grp)) ignore nulls) over w "group", nullif(trim(pos), '') pos, nullif(replace(trim(part_nr), ' ', ''), '') part_nr, case when trim(description) <> '' or trim(part_nr) <> '' then nullif(trim(qty), '') end qty,
    count(nullif(trim(part_nr), '')) over w island from {_PARTS} window w as (partition by drawing order by n rows unbounded preceding))
    select page, min(n) * 20 y, arg_min_null("group", n) "group", arg_min_null(pos, n) pos, arg_min(part_nr, n) part_nr, arg_min(qty, n) qty from p where island > 0 group by page, island""")
def win4_continuations_folded(t: Tables) -> DataFrame:
    """Parts with their second lines folded in, and the heading above them."""
    return O.folded_rows(part_rows(t), by=["page"]).filter("part_nr is not null").select("page", "y", "group", "pos", "part_nr", "qty")


@query()
def arr4_repaired_tables(t: Tables) -> DataFrame:
    return t("specs").select("spec_id", "items").distinct().select("spec_id", O.repaired_table("items").alias("items"))


@query("""select spec_id, list(k || '=' || v order by o) pairs from (select spec_id, trim(i.k) k, coalesce(trim(i.v), '') v, o from (select spec_id, unnest(items) i, generate_subscripts(items, 1) o from (select distinct spec_id, items from specs)) where trim(i.k) <> '') group by 1""")
def arr5_key_values(t: Tables) -> DataFrame:
    """Rows of a label and a value; a lone cell fills the empty value before it."""
    from ..operators.layout import key_values_udf

    cells = F.transform("items", lambda i: F.array(i["k"], i["v"]))
    rows = t("specs").select("spec_id", "items").distinct().filter(F.exists("items", lambda i: F.trim(i["k"]) != ""))
    pairs = key_values_udf(F.filter(cells, lambda c: F.trim(c[0]) != ""))
    return rows.select("spec_id", F.transform(pairs, lambda p: F.concat(p["k"], F.lit("="), p["v"])).alias("pairs"))


@query("select spec_id, i.k k from (select spec_id, unnest(items) i from (select distinct spec_id, items from specs)) where i.k is not null")
def arr1_flattened(t: Tables) -> DataFrame:
    """Lists of lists flattened, then a row for each entry."""
    lists = t("specs").select("spec_id", "items").distinct().groupBy("spec_id").agg(F.flatten(F.collect_list("items")).alias("all"))
    return lists.select("spec_id", F.explode("all").alias("i")).select("spec_id", F.col("i.k").alias("k")).filter("k is not null")


@query("""select spec_id, (list_filter(items, lambda i: contains(i.v, 'bar')))[1].v first_bar, coalesce((list_filter(items, lambda i: i.v is not null))[1].v, '') first_v from (select distinct spec_id, items from specs)""")
def arr3_first_matching(t: Tables) -> DataFrame:
    rows = t("specs").select("spec_id", "items").distinct()
    first = lambda test: F.try_element_at(F.filter("items", test), F.lit(1))["v"]
    return rows.select("spec_id", first(lambda i: F.contains(i["v"], F.lit("bar"))).alias("first_bar"), F.coalesce(first(lambda i: i["v"].isNotNull()), F.lit("")).alias("first_v"))


# Labels and choices


@query("""with s as (select distinct spec_id, coalesce(lang, '') lang, items from specs where len(items) > 0), l as (select distinct spec_id, lang, trim(unnest(items).k) label from s), n as (select lang, count(*) n from s group by 1)
    select lang, label, count(*) n from l join n using (lang) where label <> '' and len(string_split_regex(label, '\\s+')) between 1 and 3 and not regexp_matches(label, '[.:,?]$') group by lang, label, n.n having count(*) >= greatest(2, n.n * 0.1)""")
def agg17_learned_labels(t: Tables) -> DataFrame:
    """Short lines that stand in a tenth of a language's tables, once a table."""
    s = t("specs").filter(F.size("items") > 0).select("spec_id", F.coalesce("lang", F.lit("")).alias("lang"), "items").distinct()
    text = F.concat(F.lit("heading\n"), F.array_join(F.transform("items", lambda i: F.regexp_replace(F.coalesce(i["k"], F.lit("")), "\n", " ")), "\n"))
    return O.learned_labels(s.select("spec_id", "lang", text.alias("text")), by=["lang"], share=0.1)


@query(f"""with x as (select distinct text_id, coalesce(doc_id, '') doc_id, text from topic_text where text is not null), p as (select doc_id, count(*) pages from x group by 1),
    l as (select distinct doc_id, text_id, trim(regexp_replace(regexp_replace(unnest(string_split(text, chr(10))), '[0-9]', '#', 'g'), '{WS}+', ' ', 'g')) k from x)
    select doc_id, k, count(*) n from l join p using (doc_id) where k <> '' group by doc_id, k, pages having count(*) > greatest(2, 0.4 * pages)""")
def agg18_running_lines(t: Tables) -> DataFrame:
    """Lines that recur over more than two fifths of a book's pages, and over two, digits made equal."""
    x = t("topic_text").filter("text is not null").select("text_id", F.coalesce("doc_id", F.lit("")).alias("doc_id"), "text").distinct()
    pages = x.groupBy("doc_id").agg(F.count("*").alias("pages"))
    lines = x.select("doc_id", "text_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", "text_id", X.margin_key(F.col("line")).alias("k")).distinct()
    n = lines.filter("k <> ''").groupBy("doc_id", "k").agg(F.count("*").alias("n"))
    return n.join(pages, "doc_id").filter("n > greatest(2, 0.4 * pages)").select("doc_id", "k", "n")


@query("""with s as (select distinct spec_id, lower(trim(grp)) title, model_code, items, len(items) n from specs where grp is not null), r as (select *, row_number() over (partition by title, model_code order by n desc, spec_id) k, min(spec_id) over (partition by title, model_code) ord from s)
    select title, model_code, spec_id, n, ord from r where k = 1""")
def agg15_fullest_tables(t: Tables) -> DataFrame:
    """The fullest table of each title and code, the first of equals, with the place of the first."""
    rows = t("specs").filter("grp is not null").select(F.lower(F.trim("grp")).alias("title"), "model_code", "spec_id", F.size("items").cast("bigint").alias("n")).distinct()
    ord_ = rows.groupBy("title", "model_code").agg(F.min("spec_id").alias("ord"))
    best = first_by(rows, ["title", "model_code"], [F.coalesce(-F.col("n"), F.lit(1)), F.col("spec_id")])
    return best.join(ord_.withColumnsRenamed({"title": "t2", "model_code": "m2"}), F.col("title").eqNullSafe(F.col("t2")) & F.col("model_code").eqNullSafe(F.col("m2"))).select("title", "model_code", "spec_id", F.when(F.col("n") >= 0, F.col("n")).alias("n"), "ord")


# Order-dependent


@query("""with recursive e as (select user_id, v, row_number() over (partition by user_id order by v) n from (select user_id, round(value, 3) v from events)),
    c as (select user_id, v, n, v a from e where n = 1 union all select e.user_id, e.v, e.n, case when e.v - c.a <= 4.5 then c.a else e.v end from e join c on e.user_id = c.user_id and e.n = c.n + 1)
    select user_id, a as first, count(*) n from c group by 1, 2""")
def win5_anchored_rows(t: Tables) -> DataFrame:
    """Values of a user within 4.5 of a cluster's first one; not a session, which would chain."""
    return _clusters(t, 4.5)


@query("""with recursive e as (select user_id, v, row_number() over (partition by user_id order by v) n from (select user_id, round(value, 3) v from events)),
    c as (select user_id, v, n, v a from e where n = 1 union all select e.user_id, e.v, e.n, case when e.v - c.a <= 7.999 then c.a else e.v end from e join c on e.user_id = c.user_id and e.n = c.n + 1)
    select user_id, a as first, count(*) n from c group by 1, 2""")
def win6_poster_rows(t: Tables) -> DataFrame:
    return _clusters(t, 7.999)


def _clusters(t: Tables, reach: float) -> DataFrame:
    """Equal values are counted first, so a user's array holds distinct places only."""
    n = t("events").groupBy("user_id", F.round("value", 3).alias("v")).agg(F.count("*").alias("n"))
    tops = n.groupBy("user_id").agg(F.transform(anchored_clusters(F.collect_list("v"), reach), lambda c: c[0]).alias("tops"))
    first = F.element_at(F.filter("tops", lambda a: a <= F.col("v")), -1)
    return n.join(tops, "user_id").select("user_id", first.alias("first"), "n").groupBy("user_id", "first").agg(F.sum("n").alias("n"))


@query("""select part_id, last_value(section_title ignore nulls) over (partition by doc_id order by n rows unbounded preceding) layout from (select part_id, doc_id, section_title, min(cast(substr(part_id, 2) as bigint)) n from part_row where doc_id is not null group by 1, 2, 3)""")
def win2_layout_hint(t: Tables) -> DataFrame:
    """The last layout known in a book, carried over its sections."""
    rows = t("part_row").filter("doc_id is not null").select("part_id", "doc_id", "section_title", F.substring("part_id", 2, 20).cast("bigint").alias("n")).distinct()
    return forward_fill(rows, F.col("section_title"), by=["doc_id"], order=["n"], name="layout").select("part_id", "layout")


@query("""select text_id, last_value(title ignore nulls) over (partition by doc_id order by page, text_id rows unbounded preceding) heading from (select distinct text_id, doc_id, title, page from topic_text where doc_id is not null and page is not null)""")
def win3_carried_titles(t: Tables) -> DataFrame:
    rows = t("topic_text").filter("doc_id is not null and page is not null").select("text_id", "doc_id", "title", "page").distinct()
    return forward_fill(rows, F.col("title"), by=["doc_id"], order=["page", "text_id"], name="heading").select("text_id", "heading")


@query("""with e as (select user_id, event_id, value y, case event_type when 'view' then '•' else event_type end x, row_number() over (partition by user_id order by ts, event_id) n from events),
    m as (select *, case when x = '•' and abs(lead(y) over w - y) < 4.5 then 1 when x = '•' and abs(lag(y) over w - y) < 4.5 then -1 else 0 end d from e window w as (partition by user_id order by n)),
    k as (select *, coalesce(case when lag(d) over w = 1 then '•' end, case when lead(d) over w = -1 then '•' end) mark from m window w as (partition by user_id order by n))
    select user_id, event_id, case when mark is not null then mark || ' ' || x else x end as text from k where x <> '•'""")
def win9_markers_folded(t: Tables) -> DataFrame:
    """Events as lines, views as bullets in a column of their own."""
    lines = t("events").select("user_id", "event_id", "ts", F.col("value").alias("y"), F.when(F.col("event_type") == "view", "•").otherwise(F.col("event_type")).alias("text"))
    return O.markers_folded(lines, by=["user_id"], order=["ts", "event_id"]).select("user_id", "event_id", "text")


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) n from events),
    g as (select *, sum((event_type = 'purchase')::int) over (partition by user_id order by n rows unbounded preceding) grp, sum((event_type in ('purchase', 'click'))::int) over (partition by user_id order by n rows unbounded preceding) step from e)
    select user_id, cast(grp as bigint) grp, cast(step as bigint) step, count(*) filter (where event_type not in ('purchase', 'click')) lines from g group by 1, 2, 3""")
def win11_steps_of_posters(t: Tables) -> DataFrame:
    """Titles (purchases) begin a group, numerals (clicks) a step; other lines go with the step above them."""
    order = dict(by=["user_id"], order=["ts", "event_id"])
    e = islands(t("events"), F.col("event_type") == "purchase", name="grp", **order)
    e = islands(e, F.col("event_type").isin("purchase", "click"), name="step", **order)
    return e.groupBy("user_id", "grp", "step").agg(F.count_if(~F.col("event_type").isin("purchase", "click")).alias("lines"))


@query("select doc_id, page, max(try_cast(qty as int)) most from part_row where doc_id is not null group by 1, 2")
def win17_most_of_page(t: Tables) -> DataFrame:
    return t("part_row").filter("doc_id is not null").groupBy("doc_id", "page").agg(F.max(F.col("qty").try_cast("int")).alias("most"))


@query("select topic_id, cast(i as integer) step, m from (select topic_id, unnest(string_split(platforms, ',')) m, generate_subscripts(string_split(platforms, ','), 1) i from topic)")
def win18_numbered_repeats(t: Tables) -> DataFrame:
    return t("topic").select("topic_id", F.posexplode(F.split("platforms", ",")).alias("i", "m")).select("topic_id", (F.col("i") + 1).alias("step"), "m")


# Numbers


@query("""select event_id, round(value * (1 + event_id % 50), 6) area, round(value * (1 + event_id % 50) / sum(value * (1 + event_id % 50)) over (partition by user_id), 6) share from events""")
def mth2_area_shares(t: Tables) -> DataFrame:
    """Areas of boxes (value wide) and their share of their page (a user)."""
    area = F.col("value") * (1 + F.col("event_id") % 50)
    total = t("events").groupBy("user_id").agg(F.sum(area).alias("total"))
    return t("events").join(total, "user_id").select("event_id", F.round(area, 6).alias("area"), F.round(area / F.col("total"), 6).alias("share"))


@query("select event_id, round(least(4.0, greatest(1.0, sqrt(4000000 / (1000 * greatest(value, 1.0))))), 6) scale from events")
def mth3_clamped_scale(t: Tables) -> DataFrame:
    pixels = 1000 * F.greatest(F.col("value"), F.lit(1.0))
    return t("events").select("event_id", F.round(F.least(F.lit(4.0), F.greatest(F.lit(1.0), F.sqrt(F.lit(4_000_000) / pixels))), 6).alias("scale"))


@query("select event_id, abs(value - 50) <= 4.5 near, round_even(value, 1) rounded from events")
def mth4_tolerance_and_rounding(t: Tables) -> DataFrame:
    """Rounded half to even."""
    return t("events").select("event_id", (F.abs(F.col("value") - 50) <= 4.5).alias("near"), F.bround("value", 1).alias("rounded"))


@query("""select spec_id, o item_no, try_cast(replace(nullif(regexp_extract(i.v, '(\\d+(?:[.,]\\d+)?)', 1), ''), ',', '.') as double) number from (select spec_id, unnest(items) i, generate_subscripts(items, 1) - 1 o from (select distinct spec_id, items from specs))""")
def mth5_numeric_part(t: Tables) -> DataFrame:
    number = F.replace(V.none_if_empty(F.regexp_extract("i.v", r"(\d+(?:[.,]\d+)?)", 1)), F.lit(","), F.lit(".")).try_cast("double")
    rows = t("specs").select("spec_id", "items").distinct().select("spec_id", F.posexplode("items").alias("item_no", "i"))
    return rows.select("spec_id", F.col("item_no").cast("bigint").alias("item_no"), number.alias("number"))
