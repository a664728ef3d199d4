"""Projections, filters, joins, sets and orders over the knowledge base, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.dedup import first_by
from ..operators.inventory import lookup
from ..operators.joins import as_of_join, fallback_array, guarded_narrowing, range_join, upsert
from ..operators.layout import merged_tiles
from ..operators.windows import distributed_rank
from ..sources.files import described_schema, with_defaults
from .registry import Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql

KINDS = ("component", "fault", "menu", "other", "procedure", "safety", "spec", "view")


def once(t: Tables, name: str, *cols: str) -> DataFrame:
    """The named columns of a table that takes deliveries, each content once."""
    return t(name).select(*cols).distinct()


# Projections


@query("select doc_id, doctype, brand, lang, path from document group by all")
def prj1_keep_columns(t: Tables) -> DataFrame:
    return once(t, "document", "doc_id", "doctype", "brand", "lang", "path")


@query("""select topic_id, to_json({'section_no': section_no, 'title': title, 'scope': scope, 'platforms': platforms}) payload from topic""")
def prj2_payload_of_the_rest(t: Tables) -> DataFrame:
    rest = F.to_json(F.struct("section_no", "title", "scope", "platforms"), {"ignoreNullFields": "false"})
    return t("topic").select("topic_id", rest.alias("payload"))


@query("select part_id id, part_nr nr, description d, pos p, qty q from part_row group by all")
def prj3_short_names(t: Tables) -> DataFrame:
    return once(t, "part_row", "part_id", "part_nr", "description", "pos", "qty").withColumnsRenamed({"part_id": "id", "part_nr": "nr", "description": "d", "pos": "p", "qty": "q"})


@query("""with x as (select topic_id, lower(lang) lang, title, text_id from topic_text where lang is not null and title is not null and title <> ''),
    p as (select topic_id, arg_min(struct_pack(title := title, lang := lang), struct_pack(o := case lang when 'nl' then 0 when 'en' then 1 else 2 end, i := text_id)) p from x group by 1)
    select t.topic_id, kind, section_no as number, coalesce(p.p.title, t.title) title, p.p.lang title_lang, coalesce((select list_sort(list(distinct lower(trim(doc_id)))) from topic_source s where s.topic_id = t.topic_id and doc_id is not null), []) sources from topic t left join p using (topic_id)""")
def prj4_common_projection(t: Tables) -> DataFrame:
    """What all kinds show: the title by order of languages, and the books it comes from."""
    lang = F.lower("lang")
    rank = F.struct(F.when(lang == "nl", 0).when(lang == "en", 1).otherwise(2), "text_id")
    titles = t("topic_text").filter("lang is not null and title is not null and title <> ''").groupBy("topic_id").agg(F.min_by(F.struct("title", lang.alias("lang")), rank).alias("p"))
    sources = t("topic_source").filter("doc_id is not null").groupBy("topic_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("doc_id")))).alias("sources"))
    rows = t("topic").join(titles, "topic_id", "left").join(sources, "topic_id", "left")
    return rows.select("topic_id", "kind", F.col("section_no").alias("number"), F.coalesce("p.title", "title").alias("title"), F.col("p.lang").alias("title_lang"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


_COLLECTIONS = {"fault": "faults", "menu": "menu", "component": "components", "procedure": "procedures", "spec": "specs", "safety": "safety", "view": "views"}


@query("""
    with x as (select topic_id, list_sort(list(distinct lower(lang) || '=' || coalesce(title, ''))) titles from topic_text where lang is not null group by 1)
    select case kind when 'fault' then 'faults' when 'menu' then 'menu' when 'component' then 'components' when 'procedure' then 'procedures' when 'spec' then 'specs' when 'safety' then 'safety' when 'view' then 'views' else 'other' end collection, topic_id, t.title, coalesce(x.titles, []) titles
    from topic t left join x using (topic_id) where kind not in ('drawing', 'maintenance_step')""")
def prj5_collections_by_kind(t: Tables) -> DataFrame:
    """One scan of topics feeds eight collections; each row has its titles by language."""
    by_lang = t("topic_text").filter("lang is not null").groupBy("topic_id").agg(F.array_sort(F.collect_set(F.concat(F.lower("lang"), F.lit("="), F.coalesce("title", F.lit(""))))).alias("titles"))
    empty = F.array().cast("array<string>")
    rows = t("topic").filter(~F.col("kind").isin("drawing", "maintenance_step")).join(by_lang, "topic_id", "left")
    return rows.select(F.coalesce(lookup(F.col("kind"), _COLLECTIONS), F.lit("other")).alias("collection"), "topic_id", "title", F.coalesce("titles", empty).alias("titles"))


@query("select topic_id, split_part(section_no, '.', 1) chapter from topic")
def prj6_chapter(t: Tables) -> DataFrame:
    return t("topic").select("topic_id", X.chapter(F.col("section_no")).alias("chapter"))


@query("select part_id, available = 1 and part_nr is not null orderable from part_row group by all")
def prj7_available(t: Tables) -> DataFrame:
    return t("part_row").select("part_id", ((F.col("available") == 1) & F.col("part_nr").isNotNull()).alias("orderable")).distinct()


@query("select topic_id, case when length(title) > 24 then left(title, 24) || '…' else title end teaser from topic")
def prj8_teaser(t: Tables) -> DataFrame:
    return t("topic").select("topic_id", X.teaser(F.col("title"), 24).alias("teaser"))


@query("""select spec_id, cast(i as integer) step, items[i].k k, items[i].v v from
    (select spec_id, items, unnest(range(1, len(items) + 1)) i from (select distinct spec_id, items from specs))""")
def prj9_numbered_steps(t: Tables) -> DataFrame:
    rows = t("specs").dropDuplicates(["spec_id"]).select("spec_id", F.posexplode("items").alias("i", "item"))
    return rows.select("spec_id", (F.col("i") + 1).alias("step"), F.col("item.k").alias("k"), F.col("item.v").alias("v"))


@query("select distinct spec_id, items[1].k intro, len(items[2:]) n_rest from specs where len(items) > 0")
def prj10_intro_split(t: Tables) -> DataFrame:
    rows = t("specs").filter(F.size("items") > 0)
    return rows.select("spec_id", F.element_at("items", 1)["k"].alias("intro"), F.size(F.slice("items", 2, 1_000_000)).cast("bigint").alias("n_rest")).distinct()


@query("select text_id, case when lower(lang) = 'en' then title else text end shown, case when lower(lang) = 'en' then text else title end other from topic_text group by all")
def prj11_language_swap(t: Tables) -> DataFrame:
    english = F.lower("lang") == "en"
    return t("topic_text").select("text_id", F.when(english, F.col("title")).otherwise(F.col("text")).alias("shown"), F.when(english, F.col("text")).otherwise(F.col("title")).alias("other")).distinct()


# Filters


@query("select distinct doc_id, lang from document where deleted_at is null and superseded_by is null")
def flt1_active_books(t: Tables) -> DataFrame:
    return t("document").filter("deleted_at is null and superseded_by is null").select("doc_id", "lang").distinct()


@query("select distinct doc_id from document where contains(doc_id, 'orvo') or contains(doc_id, '-en-')")
def flt2_any_of_substrings(t: Tables) -> DataFrame:
    return t("document").filter(F.contains("doc_id", F.lit("orvo")) | F.contains("doc_id", F.lit("-en-"))).select("doc_id").distinct()


@query("select topic_id, platforms from topic where list_contains(string_split(platforms, ','), 'NZL')")
def flt3_membership(t: Tables) -> DataFrame:
    return t("topic").filter(F.array_contains(F.split("platforms", ","), "NZL")).select("topic_id", "platforms")


@query("select topic_id from topic where platforms is null or platforms = '' or list_contains(string_split(platforms, ','), 'MCL')")
def flt4_for_variant(t: Tables) -> DataFrame:
    codes = F.coalesce(F.filter(F.split("platforms", ","), lambda x: x != ""), F.array().cast("array<string>"))
    return t("topic").filter((F.size(codes) == 0) | F.array_contains(codes, "MCL")).select("topic_id")


@query("""with p as (select *, count(*) over (partition by kind) n, count(*) filter (where scope = 'brand') over (partition by kind) m from topic)
    select kind, topic_id from p where scope = 'brand' or m * 4 < n""")
def flt5_guarded_narrowing(t: Tables) -> DataFrame:
    return guarded_narrowing(t("topic").select("kind", "topic_id", "scope"), F.coalesce(F.col("scope") == "brand", F.lit(False)), ["kind"]).select("kind", "topic_id")


@query("select deleted_at is null active, count(distinct doc_id) n from document group by 1")
def flt6_active_partition(t: Tables) -> DataFrame:
    return t("document").groupBy(F.col("deleted_at").isNull().alias("active")).agg(F.countDistinct("doc_id").alias("n"))


@query("select topic_id from topic where kind = 'procedure' and split_part(section_no, '.', 1) = '5'")
def flt7_equalities(t: Tables) -> DataFrame:
    return t("topic").filter((F.col("kind") == "procedure") & (X.chapter(F.col("section_no")) == "5")).select("topic_id")


@query("select distinct spec_id from specs where len(items) > 0")
def flt8_nested_not_empty(t: Tables) -> DataFrame:
    return t("specs").filter(F.size("items") > 0).select("spec_id").distinct()


@query("select distinct part_id from part_row where lower(trim(product_id)) = 'mondil.nzl' and section = '12'")
def flt9_parts_of_build(t: Tables) -> DataFrame:
    return t("part_row").filter((F.lower(F.trim("product_id")) == "mondil.nzl") & (F.col("section") == "12")).select("part_id").distinct()


@query("select distinct part_id from part_row where not (part_nr is null and pos is null and description is null)")
def flt10_not_all_null(t: Tables) -> DataFrame:
    return t("part_row").filter(~(F.col("part_nr").isNull() & F.col("pos").isNull() & F.col("description").isNull())).select("part_id").distinct()


@query("""select distinct part_id from part_row semi join (select drawing, section from part_row where drawing is not null group by 1, 2 having count(distinct part_id) >= 2) using (drawing, section)""")
def flt11_table_pages(t: Tables) -> DataFrame:
    p = t("part_row")
    pages = p.filter("drawing is not null").groupBy("drawing", "section").agg(F.countDistinct("part_id").alias("n")).filter("n >= 2")
    return p.join(pages, ["drawing", "section"], "left_semi").select("part_id").distinct()


@query("""select distinct part_id from part_row where description is not null and not starts_with(lower(description), 'service manual') and lower(description) not in ('pos nr omschrijving aantal')""")
def flt12_boilerplate_reject(t: Tables) -> DataFrame:
    d = F.lower("description")
    return t("part_row").filter(F.col("description").isNotNull() & ~d.startswith("service manual") & ~d.isin("pos nr omschrijving aantal")).select("part_id").distinct()


@query("select topic_id, kind, title from topic where kind in ('menu', 'safety') and doctype = 'um'")
def flt17_optional_predicates(t: Tables) -> DataFrame:
    """Only the conditions that are given apply; their values are bound, not interpolated."""
    given = {"kind": ["menu", "safety"], "doctype": "um", "section_no": None}
    out = t("topic")
    for c, v in given.items():
        if v is not None:
            out = out.filter(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return out.select("topic_id", "kind", "title")


@query("""select distinct spec_id from specs where len(list_filter(items, lambda x: x.k is not null and x.v is not null and x.v <> '' and length(x.k) <= 40)) >= 2""")
def flt18_valid_spec_tables(t: Tables) -> DataFrame:
    real = F.filter("items", lambda x: x["k"].isNotNull() & x["v"].isNotNull() & (x["v"] != "") & (F.length(x["k"]) <= 40))
    return t("specs").filter(F.size(real) >= 2).select("spec_id").distinct()


@query("select distinct link_id from topic_source s where doc_id is not null and not exists (select 1 from document d where d.doc_id = lower(trim(s.doc_id)))")
def flt20_orphan_reject(t: Tables) -> DataFrame:
    return t("topic_source").select("link_id", F.lower(F.trim("doc_id")).alias("doc_id")).filter("doc_id is not null").join(t("document").select("doc_id").distinct(), "doc_id", "left_anti").select("link_id").distinct()


# Joins


@query("select distinct x.text_id, d.doctype from topic_text x join document d on lower(trim(x.doc_id)) = d.doc_id")
def jn1_facts_with_meta(t: Tables) -> DataFrame:
    d = t("document").select("doc_id", "doctype").distinct()
    return t("topic_text").select("text_id", F.lower(F.trim("doc_id")).alias("doc_id")).join(d, "doc_id").select("text_id", "doctype").distinct()


@query("""select distinct p.part_id, d.title from part_row p left join (select distinct doc_id, title from document) d on lower(trim(p.doc_id)) = d.doc_id""")
def jn3_parts_left_meta(t: Tables) -> DataFrame:
    d = t("document").select("doc_id", "title").distinct()
    return t("part_row").select("part_id", F.lower(F.trim("doc_id")).alias("doc_id")).join(d, "doc_id", "left").select("part_id", "title").distinct()


@query("""
    with a as (select doc_id, count(distinct drawing) n_drawings from part_row where drawing is not null group by 1),
    b as (select doc_id, count(distinct text_id) n_texts from topic_text where doc_id is not null group by 1)
    select coalesce(a.doc_id, b.doc_id) doc_id, n_drawings, n_texts from a full join b on a.doc_id = b.doc_id where n_drawings is not null or n_texts >= 2""")
def jn4_conditional_full_outer(t: Tables) -> DataFrame:
    a = t("part_row").filter("drawing is not null").groupBy("doc_id").agg(F.countDistinct("drawing").alias("n_drawings"))
    b = t("topic_text").filter("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("text_id").alias("n_texts"))
    a, b = a.withColumnRenamed("doc_id", "a_id"), b.withColumnRenamed("doc_id", "b_id")
    both = a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").filter("n_drawings is not null or n_texts >= 2")
    return both.select(F.coalesce("a_id", "b_id").alias("doc_id"), "n_drawings", "n_texts")


@query("select distinct t.topic_id, p.product_id from (select topic_id, unnest(string_split(platforms, ',')) m from topic) t join product p on p.model_code = t.m")
def jn5_platform_expansion(t: Tables) -> DataFrame:
    codes = t("topic").select("topic_id", F.explode(F.split("platforms", ",")).alias("model_code"))
    return codes.join(t("product").select("model_code", "product_id"), "model_code").select("topic_id", "product_id").distinct()


@query("""select distinct t.topic_id, p.product_id from (select topic_id, unnest(string_split(platforms, ',')) m from topic) t join product p on p.model_code = t.m
    where p.brand in ('orvo', 'mondil')""")
def jn6_brand_restricted_expansion(t: Tables) -> DataFrame:
    codes = t("topic").select("topic_id", F.explode(F.split("platforms", ",")).alias("model_code"))
    return codes.join(t("product").filter(F.col("brand").isin("orvo", "mondil")).select("model_code", "product_id"), "model_code").select("topic_id", "product_id").distinct()


@query("""
    with d as (select distinct doc_id, brand, model_code, brewer from document),
    a as (select d.doc_id, list_sort(list(distinct p.product_id)) x from d join product p on p.brand = d.brand and p.model_code = d.model_code group by 1),
    b as (select d.doc_id, list_sort(list(distinct p.product_id)) x from d join product p on p.brand = d.brand group by 1),
    c as (select d.doc_id, list_sort(list(distinct p.product_id)) x from d join product p on p.brewer = d.brewer group by 1)
    select d.doc_id, coalesce(a.x, b.x, c.x, []) products from (select distinct doc_id from d) d left join a using (doc_id) left join b using (doc_id) left join c using (doc_id)""")
def jn7_cascading_fallback(t: Tables) -> DataFrame:
    """Products of a book: by brand and model, else by brand, else by brewer. Products per brand or brewer are few."""
    d, p = t("document").select("doc_id", "brand", "model_code", "brewer").distinct(), t("product")

    def found(on: list[str], name: str) -> DataFrame:
        sets = p.groupBy(*on).agg(F.collect_set("product_id").alias("_s"))
        return d.join(sets, on).groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias(name))

    out = d.select("doc_id").distinct()
    for on, name in ((["brand", "model_code"], "a"), (["brand"], "b"), (["brewer"], "c")):
        out = out.join(found(on, name), "doc_id", "left")
    return out.select("doc_id", fallback_array(F.col("a"), F.col("b"), F.col("c")).alias("products"))


@query("""select distinct d.doc_id, p.product_id from document d join product p on length(p.model_code) > 0 and contains(lower(d.title), lower(p.model_code)) and (d.cabinet_size is null or d.cabinet_size = p.cabinet_size)""")
def jn8_name_inside_title(t: Tables) -> DataFrame:
    """A code inside a title: an equi-join on the title's runs of letters as long as any code, then the theta condition."""
    p = t("product").select("product_id", F.lower("model_code").alias("code"), F.col("cabinet_size").alias("p_size")).filter("length(code) > 0")
    sizes = p.agg(F.collect_set(F.length("code")).alias("sizes"))  # a few lengths
    d = t("document").select("doc_id", "cabinet_size", F.lower("title").alias("low")).distinct().crossJoin(F.broadcast(sizes))
    runs = F.flatten(F.transform("sizes", lambda n: F.when(F.length("low") >= n, F.transform(F.sequence(F.lit(1), F.length("low") - n + 1), lambda i: F.substr("low", i, n))).otherwise(F.array().cast("array<string>"))))
    same = d.filter("low is not null").withColumn("code", F.explode(F.array_distinct(runs))).join(p, "code").filter(F.col("cabinet_size").isNull() | (F.col("cabinet_size") == F.col("p_size")))
    return same.select("doc_id", "product_id").distinct()


@query("""with d as (select distinct doc_id, lower(concat_ws(' ', title, case when doctype in ('tm', 'im') then brewer end)) low, cabinet_size from document), b as (select distinct brewer from product where brewer is not null), f as (select d.*, (select list_sort(list(b.brewer)) from b where contains(d.low, lower(b.brewer))) found from d)
    select doc_id, coalesce(found, []) brewers, (select count(*) from product p where (f.found is null or list_contains(f.found, p.brewer)) and (f.cabinet_size is null or f.cabinet_size = p.cabinet_size)) products from f""")
def jn8_brewers_in_titles(t: Tables) -> DataFrame:
    """The brewers named in a title and the number of products that have one of them, and the size; no name matches all.

    Counts of products by brewer and size are a dimension, asked for each distinct set of names only."""
    brewers = t("product").select("brewer").filter("brewer is not null").distinct().agg(F.array_sort(F.collect_list("brewer")).alias("all"))  # one row
    low = F.lower(F.concat_ws(" ", "title", F.when(F.col("doctype").isin("tm", "im"), F.col("brewer"))))
    d = t("document").select("doc_id", low.alias("low"), "cabinet_size").distinct().crossJoin(F.broadcast(brewers))
    d = d.select("doc_id", "cabinet_size", F.filter("all", lambda b: F.contains(F.col("low"), F.lower(b))).alias("brewers"))
    counts = t("product").groupBy(F.col("brewer").alias("b"), F.col("cabinet_size").alias("s")).agg(F.count("*").alias("n")).agg(F.collect_list(F.struct("b", "s", "n")).alias("counts"))  # one row
    fits = lambda x: ((F.size("brewers") == 0) | F.coalesce(F.array_contains("brewers", x["b"]), F.lit(False))) & (F.col("cabinet_size").isNull() | F.coalesce(F.col("cabinet_size") == x["s"], F.lit(False)))
    n = F.aggregate(F.filter("counts", fits), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return d.crossJoin(F.broadcast(counts)).select("doc_id", "brewers", n.alias("products")).distinct()


@query("""select distinct d.doc_id, coalesce(b.doc_id, d.superseded_by) successor from document d left join (select distinct doc_id, path from document) b on b.path = d.superseded_by
    where d.superseded_by is not null""")
def jn9_successor(t: Tables) -> DataFrame:
    books = t("document").select(F.col("doc_id").alias("by_path"), F.col("path").alias("superseded_by")).distinct()
    rows = t("document").filter("superseded_by is not null").select("doc_id", "superseded_by").distinct()
    return rows.join(books, "superseded_by", "left").select("doc_id", F.coalesce("by_path", "superseded_by").alias("successor"))


@query("""
    with s as (select distinct part_id, drawing, section, ltrim(lower(coalesce(pos, '')), '0') k from part_row where drawing is not null), r as (select distinct section, ltrim(lower(coalesce(pos, '')), '0') k from part_row where stock = 'x' and section is not null),
    g as (select drawing, count(*) filter (where exists (select 1 from r where r.section = s.section and r.k = s.k)) good, count(*) n from s group by 1)
    select drawing, good from g where good >= greatest(2, n // 2)""")
def jn10_semi_join_with_share(t: Tables) -> DataFrame:
    """Drawings of whose balloons half, and two, point at a part in stock of their section and position."""
    k = F.ltrim(F.lower(F.coalesce("pos", F.lit(""))), F.lit("0"))
    spots = t("part_row").filter("drawing is not null").select("part_id", "drawing", "section", k.alias("k")).distinct()
    rows = t("part_row").filter("stock = 'x' and section is not null").select("section", k.alias("k")).distinct()
    good = spots.join(rows, ["section", "k"], "left_semi").groupBy("drawing").agg(F.count("*").alias("good"))
    g = spots.groupBy("drawing").agg(F.count("*").alias("n")).join(good, "drawing")
    return g.filter("good >= greatest(2, n div 2)").select("drawing", "good")


@query("""with n as (select lower(trim(product_id)) product, section, min(drawing) d from part_row where product_id is not null and section is not null and drawing is not null group by 1, 2), l as (select lower(trim(product_id)) product, section, max(drawing) d from part_row where stock = 'x' and product_id is not null and section is not null and drawing is not null group by 1, 2)
    select n.product, n.section, coalesce(l.d, n.d) drawing, l.d is not null legacy from n left join l using (product, section)""")
def jn11_older_preferred(t: Tables) -> DataFrame:
    """The older drawing of a product's section where there is one, else the newer."""
    rows = t("part_row").filter("product_id is not null and section is not null and drawing is not null").select(F.lower(F.trim("product_id")).alias("product"), "section", "drawing", "stock")
    old = rows.filter("stock = 'x'").groupBy("product", "section").agg(F.max("drawing").alias("old"))
    new = rows.groupBy("product", "section").agg(F.min("drawing").alias("new"))
    return new.join(old, ["product", "section"], "left").select("product", "section", F.coalesce("old", "new").alias("drawing"), F.col("old").isNotNull().alias("legacy"))


@query("""with e as (select topic_id, title from topic_text where lower(lang) = 'en' and title is not null), n as (select topic_id, min(title) nl from topic_text where lower(lang) = 'nl' and title is not null group by 1), d as (select e.title, min(n.nl) nl from e join n using (topic_id) group by 1)
    select t.topic_id, coalesce(d.nl, t.title) shown from topic t left join d on d.title = t.title""")
def jn16_translated_or_original(t: Tables) -> DataFrame:
    """Titles in the dictionary's other language where it has them."""
    x = t("topic_text").filter("title is not null").withColumn("lang", F.lower("lang"))
    dutch = x.filter("lang = 'nl'").groupBy("topic_id").agg(F.min("title").alias("nl"))
    known = x.filter("lang = 'en'").select("topic_id", "title").join(dutch, "topic_id").groupBy("title").agg(F.min("nl").alias("nl"))
    return t("topic").select("topic_id", "title").join(known, "title", "left").select("topic_id", F.coalesce("nl", "title").alias("shown"))


@query("""with i as (select distinct text_id, lower(trim(doc_id)) doc_id, page from topic_text where doc_id is not null and page is not null), m as (select distinct lower(trim(doc_id)) doc_id, page, drawing hash, cast(substr(part_id, 2) as bigint) n, round(page * 1.04, 1) x from part_row where drawing is not null and doc_id is not null),
    j as (select text_id, hash, n, row_number() over (partition by text_id, hash order by n) k from i join m on i.doc_id = m.doc_id and i.page = m.page and round(i.page * 1.0401, 1) = m.x) select text_id, hash, n as first from j where k = 1""")
def jn2_placed_pictures(t: Tables) -> DataFrame:
    """Pictures of a text by book, page and place to a tenth, each content once, the first placement kept."""
    place = lambda f: F.bround(F.col("page") * f + F.lit(1e-9), 1).cast("decimal(10,1)")
    i = t("topic_text").filter("doc_id is not null and page is not null").select("text_id", F.lower(F.trim("doc_id")).alias("doc_id"), F.col("page").cast("int").alias("page")).distinct().withColumn("x", place(1.0401))
    m = t("part_row").filter("drawing is not null and doc_id is not null").select(F.lower(F.trim("doc_id")).alias("doc_id"), F.col("page").cast("int").alias("page"), F.col("drawing").alias("hash"), F.substring("part_id", 2, 20).cast("bigint").alias("n")).distinct().withColumn("x", place(1.04))
    return i.join(m, ["doc_id", "page", "x"]).groupBy("text_id", "hash").agg(F.min("n").alias("first"))


@query("""with b as (select user_id, event_id, value x, case when value - lag(value) over w <= 1 then 0 else 1 end s from events window w as (partition by user_id order by value, event_id)), i as (select *, sum(s) over (partition by user_id order by x, event_id rows unbounded preceding) i from b)
    select user_id, min(event_id) tile, count(*) n from i group by user_id, i""")
def jn30_merged_tiles(t: Tables) -> DataFrame:
    """Boxes of a page (a user) that lie within one unit of each other, directly or through others, as one tile."""
    boxes = t("events").select("user_id", "event_id", F.col("value").alias("x0"), F.col("value").alias("x1"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"))
    return merged_tiles(boxes, by=["user_id"], key="event_id", reach=1.0).groupBy("user_id", "tile").agg(F.count("*").alias("n"))


@query("""
    with c as (select lower(title) k, list_sort(list(distinct kind)) s, max(title) x from topic where doctype = 'im' and title is not null group by 1),
    g as (select lower(title) k, list_sort(list(distinct kind)) s, max(title) x from topic where doctype = 'tm' and title is not null group by 1)
    select coalesce(c.k, g.k) k, list_sort(list_distinct(list_concat(coalesce(c.s, []), coalesce(g.s, [])))) kinds, coalesce(nullif(g.x, ''), c.x) title from c full join g on c.k = g.k""")
def jn12_upsert(t: Tables) -> DataFrame:
    def side(doctype: str) -> DataFrame:
        rows = t("topic").filter((F.col("doctype") == doctype) & F.col("title").isNotNull())
        return rows.groupBy(F.lower("title").alias("k")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.max("title").alias("title"))

    return upsert(side("im"), side("tm"), key="k", union=["kinds"], overwrite=["title"])


@query("""select min(topic_id) topic_id, lower(title) k from topic where doctype = 'tm' and title is not null and lower(title) not in (select lower(title) from topic where doctype = 'im' and title is not null) group by 2""")
def jn13_anti_join_first_wins(t: Tables) -> DataFrame:
    titled = t("topic").filter("title is not null").withColumn("k", F.lower("title"))
    new = titled.filter("doctype = 'tm'").join(titled.filter("doctype = 'im'").select("k").distinct(), "k", "left_anti")
    return new.groupBy("k").agg(F.min("topic_id").alias("topic_id"))


@query("select brand, list_sort(list(product_id)) builds, count(*) n from product group by 1")
def jn14_builds_of_brand(t: Tables) -> DataFrame:
    return t("product").groupBy("brand").agg(F.array_sort(F.collect_list("product_id")).alias("builds"), F.count("*").alias("n"))


@query("select product_id from product p where not exists (select 1 from document d where d.brand = p.brand and d.model_code = p.model_code)")
def jn15_leftover_builds(t: Tables) -> DataFrame:
    return t("product").join(t("document").select("brand", "model_code").distinct(), ["brand", "model_code"], "left_anti").select("product_id")


@query("""select product_id, coalesce(own.spec_id, any_t.spec_id) spec_id from product p left join (select model_code, min(spec_id) spec_id from specs where lower(lang) = 'nl' group by 1) own using (model_code)
    left join (select model_code, min(spec_id) spec_id from specs group by 1) any_t using (model_code)""")
def jn17_preferred_match(t: Tables) -> DataFrame:
    own = t("specs").filter("lower(lang) = 'nl'").groupBy("model_code").agg(F.min("spec_id").alias("own"))
    every = t("specs").groupBy("model_code").agg(F.min("spec_id").alias("every"))
    return t("product").join(own, "model_code", "left").join(every, "model_code", "left").select("product_id", F.coalesce("own", "every").alias("spec_id"))


@query("select distinct p.product_id, d.doc_id from product p join document d on d.brand = p.brand and d.model_code = p.model_code")
def jn18_documents_of_product(t: Tables) -> DataFrame:
    return t("product").join(t("document").select("brand", "model_code", "doc_id").distinct(), ["brand", "model_code"]).select("product_id", "doc_id")


@query("""
    with x as (select topic_id, lower(lang) lang, min(title) title, min(text) text from topic_text where lower(lang) in ('nl', 'en') group by 1, 2)
    select t.topic_id, coalesce(w.lang, f.lang) lang, coalesce(w.title, f.title) title, coalesce(w.text, f.text) text
    from topic t left join x w on w.topic_id = t.topic_id and w.lang = 'nl' left join x f on f.topic_id = t.topic_id and f.lang = 'en' where t.kind = 'menu'""")
def jn19_language_fallback(t: Tables) -> DataFrame:
    """The fallback is by column: a wanted row without text takes the other language's text but keeps its title."""
    low = t("topic_text").withColumn("lang", F.lower("lang"))

    def side(lang: str, p: str) -> DataFrame:
        return low.filter(F.col("lang") == lang).groupBy("topic_id").agg(F.lit(lang).alias(f"{p}l"), F.min("title").alias(f"{p}t"), F.min("text").alias(f"{p}x"))

    rows = t("topic").filter("kind = 'menu'").select("topic_id").join(side("nl", "w"), "topic_id", "left").join(side("en", "f"), "topic_id", "left")
    return rows.select("topic_id", F.coalesce("wl", "fl").alias("lang"), F.coalesce("wt", "ft").alias("title"), F.coalesce("wx", "fx").alias("text"))


@query("""select distinct p.part_id, pr.product_name from part_row p left join product pr on pr.product_id = lower(trim(p.product_id)) where upper(p.part_nr) = 'XLKX10'""")
def jn20_part_lookup(t: Tables) -> DataFrame:
    rows = t("part_row").filter(F.upper("part_nr") == "XLKX10").select("part_id", F.lower(F.trim("product_id")).alias("product_id"))
    return rows.join(t("product").select("product_id", "product_name"), "product_id", "left").select("part_id", "product_name").distinct()


@query("""select topic_id, cast(i as integer) pos, product_id from (select topic_id, unnest(string_split(platforms, ',')) m, generate_subscripts(string_split(platforms, ','), 1) - 1 i from topic) x
    join (select model_code m, min(product_id) product_id from product group by 1) using (m)""")
def jn21_lookup_of_list(t: Tables) -> DataFrame:
    p = t("product").groupBy("model_code").agg(F.min("product_id").alias("product_id"))
    return t("topic").select("topic_id", F.posexplode(F.split("platforms", ",")).alias("pos", "model_code")).join(p, "model_code").select("topic_id", "pos", "product_id")


@query("""
    with n as (select model_code m, min(product_name) name from product group by 1),
    x as (select topic_id, unnest(string_split(platforms, ',')) m, generate_subscripts(string_split(platforms, ','), 1) i from topic)
    select t.topic_id, coalesce(string_agg(n.name, ', ' order by i), t.platforms) names from topic t left join x using (topic_id) left join n using (m) group by t.topic_id, t.platforms""")
def jn22_names_else_ids(t: Tables) -> DataFrame:
    names = t("product").groupBy("model_code").agg(F.min("product_name").alias("name"))
    listed = t("topic").select("topic_id", "platforms", F.posexplode_outer(F.split("platforms", ",")).alias("i", "model_code")).join(names, "model_code", "left")
    told = listed.groupBy("topic_id", "platforms").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("i", "name")))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["name"]), ", ")
    return told.select("topic_id", F.coalesce(F.nullif(joined, F.lit("")), "platforms").alias("names"))


@query("""
    with pins as (select * from (values ('product:orvo.hpt'), ('topic:none'), ('doc:im-orvo-vfk-da-12ab')) v(pin)), s as (select pin, split_part(pin, ':', 1) kind, split_part(pin, ':', 2) id from pins)
    select pin, product_name label from s join product on kind = 'product' and product_id = id union all
    select pin, t.title from s join topic t on s.kind = 'topic' and topic_id = id union all
    select distinct pin, d.title from s join document d on kind = 'doc' and doc_id = id""")
def jn23_tagged_lookup(t: Tables) -> DataFrame:
    pins = t("product").sparkSession.createDataFrame([("product:orvo.hpt",), ("topic:none",), ("doc:im-orvo-vfk-da-12ab",)], "pin string")
    pins = pins.withColumn("kind", F.substring_index("pin", ":", 1)).withColumn("id", F.substring_index("pin", ":", -1))
    sides = (("product", "product", "product_id", "product_name"), ("topic", "topic", "topic_id", "title"), ("doc", "document", "doc_id", "title"))
    out = None
    for kind, name, key, label in sides:
        rows = t(name).select(F.col(key).alias("id"), F.col(label).alias("label")).distinct()
        one = rows.join(F.broadcast(pins.filter(F.col("kind") == kind)), "id").select("pin", "label")  # three pins
        out = one if out is None else out.unionByName(one)
    return out


@query("select product_id from product p where exists (select 1 from part_row r where lower(trim(r.product_id)) = p.product_id)")
def jn24_products_with_parts(t: Tables) -> DataFrame:
    return t("product").join(t("part_row").select(F.lower(F.trim("product_id")).alias("product_id")).distinct(), "product_id", "left_semi").select("product_id")


@query("""with p as (select distinct part_id, section, coalesce(nullif(lower(ltrim(trim(pos), '0')), ''), '0') k from part_row where pos is not null), g as (select section, k, min(part_id) first, count(*) n from p where section is not null group by 1, 2)
    select part_id, section, k, coalesce(first, part_id) as first, coalesce(n, 1) n from p left join g using (section, k)""")
def jn25_position_join(t: Tables) -> DataFrame:
    """One row per part with its group, the parts of all sections that share section and position: its first part and its size.

    The pairs of a group are not listed, as they grow with its square. A part without a section shares it with none."""
    p = t("part_row").filter("pos is not null").select("part_id", "section", X.position_key(F.col("pos")).alias("k")).distinct()
    groups = p.filter("section is not null").groupBy("section", "k").agg(F.min("part_id").alias("first"), F.count("*").alias("n"))
    return p.join(groups, ["section", "k"], "left").select("part_id", "section", "k", F.coalesce("first", "part_id").alias("first"), F.coalesce("n", F.lit(1)).alias("n"))


@query("""select distinct p.part_nr, translate(upper(p.part_nr), 'OQDIL|SBZG-. ', '0001115826') k from part_row p where part_nr is not null""")
def jn26_folded_numbers(t: Tables) -> DataFrame:
    return t("part_row").filter("part_nr is not null").select("part_nr", X.ocr_key(F.col("part_nr")).alias("k")).distinct()


@query("""
    with e as (select event_id, user_id, ts from events where event_type <> 'purchase'), a as (select user_id, ts, max(event_id) event_id from events where event_type = 'purchase' group by 1, 2)
    select e.user_id, e.event_id, a.event_id anchor_event_id from e asof left join a on a.user_id = e.user_id and a.ts <= e.ts""")
def jn28_as_of_join(t: Tables) -> DataFrame:
    e = t("events")
    anchors = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return as_of_join(e.filter("event_type <> 'purchase'").select("user_id", "ts", "event_id"), anchors, by=["user_id"], at="ts", take=["event_id"]).select("user_id", "event_id", "anchor_event_id")


@query("""select a.event_id a, b.event_id b from events a join events b on a.user_id = b.user_id and abs(a.value - b.value) <= 0.25 where a.event_id < b.event_id""")
def jn29_range_join(t: Tables) -> DataFrame:
    e = t("events")
    left, right = e.select("user_id", F.col("event_id").alias("a"), F.col("value").alias("va")), e.select("user_id", F.col("event_id").alias("b"), F.col("value").alias("vb"))
    return range_join(left, right, by=["user_id"], left_at="va", right_at="vb", reach=0.25).filter("a < b").select("a", "b")


# Sets and orders


@query("select topic_id ref, 'topic' src from topic union all select distinct doc_id, 'document' from document union all select product_id, 'product' from product")
def set2_union_of_sources(t: Tables) -> DataFrame:
    a = t("topic").select(F.col("topic_id").alias("ref"), F.lit("topic").alias("src"))
    b = t("document").select(F.col("doc_id").alias("ref"), F.lit("document").alias("src")).distinct()
    return a.unionByName(b).unionByName(t("product").select(F.col("product_id").alias("ref"), F.lit("product").alias("src")))


@query("""select topic_id, list_sort(list_distinct(list_concat(coalesce(string_split(platforms, ','), []), coalesce(string_split(languages, ','), [])))) u from topic""")
def set3_array_union(t: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    return t("topic").select("topic_id", F.array_sort(F.array_union(F.coalesce(F.split("platforms", ","), empty), F.coalesce(F.split("languages", ","), empty))).alias("u"))


@query("select distinct brand, model_code from document where brand is not null and model_code is not null except select brand, model_code from product")
def set4_difference(t: Tables) -> DataFrame:
    return t("document").filter("brand is not null and model_code is not null").select("brand", "model_code").subtract(t("product").select("brand", "model_code"))


@query("select distinct model_code from document where model_code is not null intersect select model_code from product")
def set5_intersection(t: Tables) -> DataFrame:
    return t("document").filter("model_code is not null").select("model_code").intersect(t("product").select("model_code"))


@query("select distinct section, section_title from part_row")
def set6_distinct_pairs(t: Tables) -> DataFrame:
    return t("part_row").select("section", "section_title").distinct()


@query("""select topic_id, list_concat(['NZL'], list_filter(string_split(platforms, ','), lambda x: lower(x) <> 'nzl'))[1:8] recents from topic where platforms is not null""")
def set7_recents(t: Tables) -> DataFrame:
    rest = F.filter(F.split("platforms", ","), lambda x: F.lower(x) != "nzl")
    return t("topic").filter("platforms is not null").select("topic_id", F.slice(F.concat(F.array(F.lit("NZL")), rest), 1, 8).alias("recents"))


@query("""select topic_id, case when list_contains(string_split(platforms, ','), 'NZL') then list_filter(string_split(platforms, ','), lambda x: x <> 'NZL') else list_concat(['NZL'], string_split(platforms, ',')) end toggled
    from topic where platforms is not null""")
def set8_toggle(t: Tables) -> DataFrame:
    p = F.split("platforms", ",")
    return t("topic").filter("platforms is not null").select("topic_id", F.when(F.array_contains(p, "NZL"), F.array_remove(p, "NZL")).otherwise(F.array_prepend(p, F.lit("NZL"))).alias("toggled"))


@query("""select doc_id, row_number() over (order by coalesce(doctype, ''), coalesce(brand, ''), coalesce(model_code, ''), coalesce(lang, ''), doc_id) doc_ord from (select distinct doc_id, doctype, brand, model_code, lang from document)""")
def srt1_corpus_order(t: Tables) -> DataFrame:
    """A total order: ranges, sorted, each starting where those before it end."""
    cols = ["doctype", "brand", "model_code", "lang"]
    rows = t("document").select("doc_id", *cols).distinct().select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in cols])
    return distributed_rank(rows, [*cols, "doc_id"], name="doc_ord").select("doc_id", "doc_ord")


@query("""with k as (select distinct section_no, case when len(regexp_extract_all(section_no, '\\d+')) > 0 then list_transform(regexp_extract_all(section_no, '\\d+'), lambda x: cast(x as bigint)) else [999] end key from topic)
    select section_no, dense_rank() over (order by key) rank from k""")
def srt2_natural_order(t: Tables) -> DataFrame:
    k = t("topic").select("section_no").distinct().withColumn("key", X.natural_key(F.col("section_no")))
    ranks = distributed_rank(k.select("key").distinct(), ["key"])
    return k.join(ranks, "key").select("section_no", "rank")


@query("""select distinct section_no, list_reduce(list_prepend(0, list_transform(string_split(section_no, '.')[1:4], lambda x: coalesce(try_cast(x as bigint), 0))), lambda a, x: a * 100 + x) weight from topic where section_no is not null""")
def srt3_weighted_sections(t: Tables) -> DataFrame:
    return t("topic").filter("section_no is not null").select("section_no", X.weighted_section(F.col("section_no")).alias("weight")).distinct()


@query("""select topic_id, kind, coalesce(list_position(['procedure', 'component', 'menu', 'safety'], kind), 99) o from topic""")
def srt4_enumeration_order(t: Tables) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(x) for x in ("procedure", "component", "menu", "safety")]), F.col("kind"))
    return t("topic").select("topic_id", "kind", F.coalesce(F.nullif(at, F.lit(0).cast("bigint")), F.lit(99)).cast("int").alias("o"))


@query("""select o, kind, count(*) n from topic join (values (1, 'procedure'), (2, 'component'), (3, 'menu')) v(o, kind) using (kind) group by 1, 2""")
def srt5_fixed_groups(t: Tables) -> DataFrame:
    order = t("topic").sparkSession.createDataFrame([(1, "procedure"), (2, "component"), (3, "menu")], "o int, kind string")
    return t("topic").join(F.broadcast(order), "kind").groupBy("o", "kind").agg(F.count("*").alias("n"))  # three rows


@query("select part_id, pos, case when pos is null then null else coalesce(try_cast(regexp_extract(pos, '^\\s*([+-]?\\d+)', 1) as bigint), 0) end n from (select distinct part_id, pos from part_row)")
def srt6_prefix_integer(t: Tables) -> DataFrame:
    return t("part_row").select("part_id", "pos", X.leading_int(F.col("pos")).alias("n")).distinct()


@query("select kind, topic_id, r from (select kind, topic_id, row_number() over (partition by kind order by created_at desc, topic_id) r from topic) where r <= 3")
def srt13_newest_of_kind(t: Tables) -> DataFrame:
    """The three newest of each kind, a report of the top."""
    r = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("created_at"), "topic_id"))
    return t("topic").select("kind", "topic_id", r.cast("bigint").alias("r")).filter("r <= 3")


@query("select topic_id, min(text_id) text_id from topic_text group by 1")
def agg21_first_wins(t: Tables) -> DataFrame:
    return first_by(t("topic_text").select("topic_id", "text_id"), ["topic_id"], [F.col("text_id")])


@query("""select brand, list(doc_id order by coalesce(model_code, ''), coalesce(doc_code, ''), doc_id) cards from (select distinct doc_id, brand, model_code, doc_code from document where doctype = 'sm') group by 1""")
def srt7_cards_by_first_code(t: Tables) -> DataFrame:
    """Cards of a brand by their first machine and code, missing ones first."""
    rows = t("document").filter("doctype = 'sm'").select("doc_id", "brand", "model_code", "doc_code").distinct()
    o = F.struct(F.coalesce("model_code", F.lit("")).alias("a"), F.coalesce("doc_code", F.lit("")).alias("b"), "doc_id")
    return rows.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(o)), lambda x: x["doc_id"]).alias("cards"))


@query("""select drawing, list(part_id order by coalesce(case when regexp_full_match(pos, '[0-9]+') then cast(pos as int) end, 0), n) parts from (select distinct part_id, drawing, pos, cast(substr(part_id, 2) as bigint) n from part_row where drawing is not null) group by 1""")
def srt8_numeric_steps(t: Tables) -> DataFrame:
    """Rows of a drawing by their number, what is no number first, ties as they came."""
    rows = t("part_row").filter("drawing is not null").select("part_id", "drawing", "pos", F.substring("part_id", 2, 20).cast("bigint").alias("n")).distinct()
    o = F.struct(F.coalesce(F.when(F.col("pos").rlike("^[0-9]+$"), F.col("pos").cast("int")), F.lit(0)).alias("a"), "n", "part_id")
    return rows.groupBy("drawing").agg(F.transform(F.array_sort(F.collect_list(o)), lambda x: x["part_id"]).alias("parts"))


@query("""select brand, list(series order by coalesce(try_cast(regexp_extract(series, '[0-9]+') as int), 0), series) series from (select distinct brand, series from product where series is not null) group by 1""")
def srt9_series_by_number(t: Tables) -> DataFrame:
    """Series of a brand by the first number in their name."""
    o = F.struct(F.coalesce(F.regexp_extract("series", "[0-9]+", 0).try_cast("int"), F.lit(0)).alias("a"), "series")
    rows = t("product").filter("series is not null").select("brand", "series").distinct()
    return rows.groupBy("brand").agg(F.transform(F.array_sort(F.collect_list(o)), lambda x: x["series"]).alias("series"))


@query("select title, row_number() over (order by lower(title), title) as rank from (select distinct title from topic where kind = 'fault' and title is not null)")
def srt16_messages_without_case(t: Tables) -> DataFrame:
    rows = t("topic").filter("kind = 'fault' and title is not null").select("title", F.lower("title").alias("low")).distinct()
    return distributed_rank(rows, ["low", "title"]).select("title", "rank")


@query("""select topic_id ref, title, scope, cast(null as varchar) lang from topic union all select distinct cast(text_id as varchar), title, cast(null as varchar), lang from topic_text""")
def set1_union_all(t: Tables) -> DataFrame:
    """Curated and generated rows together; columns that one side lacks are null."""
    a = t("topic").select(F.col("topic_id").alias("ref"), "title", "scope")
    b = t("topic_text").select(F.col("text_id").cast("string").alias("ref"), "title", "lang").distinct()
    return a.unionByName(b, allowMissingColumns=True)


@query("select 'steps' name, 'BIGINT' kind from topic_text where payload is not null limit 1")
def jsn2_inferred_types(t: Tables) -> DataFrame:
    """The types of a payload's fields, from all rows."""
    rows = t("topic_text").filter("payload is not null").select(F.expr("try_parse_json(payload)").alias("v"))
    fields = rows.select(F.explode(F.expr("map_keys(cast(v as map<string, variant>))")).alias("name"), "v").select("name", F.expr("schema_of_variant(variant_get(v, '$.' || name))").alias("kind"))
    return fields.distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("kind")), " or ").alias("kind"))


@query("""select unnest(['topic_id', 'kind', 'title']) name, unnest(['key', 'what it is about', 'as printed']) description""")
def jsn4_described_fields(t: Tables) -> DataFrame:
    """Descriptions of fields that travel with the schema."""
    spark = t("topic").sparkSession
    text = described_schema(t("topic").select("topic_id", "kind", "title"), {"topic_id": "key", "kind": "what it is about", "title": "as printed"})
    return spark.createDataFrame([(f["name"], f["metadata"].get("comment")) for f in json.loads(text)["fields"]], "name string, description string")


@query("select text_id, coalesce(try_cast(json_extract_string(payload, '$.steps') as int), 0) steps, 'none' as note from topic_text group by all")
def jsn5_tolerant_decode(t: Tables) -> DataFrame:
    """Unknown keys are ignored; missing ones, and records that are no JSON, take defaults."""
    rows = t("topic_text").select("text_id", F.from_json("payload", "steps int, note string", {"mode": "PERMISSIVE"}).alias("p")).select("text_id", "p.*")
    return with_defaults(rows, steps=0, note="none").distinct()
