"""Aggregations, windows and scalar functions over the knowledge base, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators.dedup import content_duplicates, disambiguate, first_by, superseded
from ..operators.windows import changed, distributed_rank, forward_fill, gaps, islands, sessions
from .registry import WS, Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql

_FOLD = "strip_accents({})"
_SEARCH = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"

# Aggregations


@query("select kind, doctype, count(*) n from topic group by 1, 2")
def agg1_counts(t: Tables) -> DataFrame:
    return t("topic").groupBy("kind", "doctype").agg(F.count("*").alias("n"))


@query("""with p as (select distinct part_id, lower(trim(product_id)) product, section from part_row)
    select product, section, count(*) n, grouping(section) g from p group by grouping sets ((product), (product, section))""")
def agg2_counts_by_sets(t: Tables) -> DataFrame:
    p = t("part_row").select("part_id", F.lower(F.trim("product_id")).alias("product"), "section").distinct()
    return p.groupingSets([["product"], ["product", "section"]], "product", "section").agg(F.count("*").alias("n"), F.grouping("section").cast("bigint").alias("g"))


@query("select title, list(topic_id order by topic_id) variants from topic where title is not null group by 1")
def agg3_variants_of_title(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").groupBy("title").agg(F.array_sort(F.collect_list("topic_id")).alias("variants"))


@query("""select title, list_sort(list_distinct(flatten(list(string_split(platforms, ','))))) machines, bool_and(scope is not null) scoped, arg_min(kind, topic_id) first_kind from topic where title is not null and platforms is not null group by 1""")
def agg4_group_rollup(t: Tables) -> DataFrame:
    rows = t("topic").filter("title is not null and platforms is not null")
    return rows.groupBy("title").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("platforms", ","))))).alias("machines"),
        F.bool_and(F.col("scope").isNotNull()).alias("scoped"),
        F.min_by("kind", "topic_id").alias("first_kind"),
    )


@query("select count(distinct part_nr) numbers, count(distinct drawing) drawings from part_row")
def agg5_distinct_counts(t: Tables) -> DataFrame:
    return t("part_row").agg(F.countDistinct("part_nr").alias("numbers"), F.countDistinct("drawing").alias("drawings"))


@query("select doctype, sum(pages) pages, count(*) books from (select distinct doc_id, doctype, pages from document) group by 1")
def agg6_sums(t: Tables) -> DataFrame:
    return t("document").select("doc_id", "doctype", "pages").distinct().groupBy("doctype").agg(F.sum("pages").alias("pages"), F.count("*").alias("books"))


@query("""with d as (select distinct doc_id, sha256, path, superseded_by is null live, pages from document)
    select doc_id, case when first_value(path) over w <> path then first_value(path) over w end duplicate_of from d where sha256 is not null
    window w as (partition by sha256 order by live desc, pages desc, path)""")
def agg7_content_duplicates(t: Tables) -> DataFrame:
    d = t("document").select("doc_id", "sha256", "path", F.col("superseded_by").isNull().alias("live"), "pages").distinct()
    rank = [(~F.col("live")).cast("int"), F.coalesce(-F.col("pages"), F.lit(1)), F.col("path")]
    return content_duplicates(d.filter("sha256 is not null"), content="sha256", name="path", rank=rank).select("doc_id", "duplicate_of")


_VERSION = "coalesce(try_cast(regexp_extract({0}, '^(\\d+)(?:\\.(\\d+))?', 1) as integer) * 10000 + coalesce(try_cast(nullif(regexp_extract({0}, '^(\\d+)(?:\\.(\\d+))?', 2), '') as integer), 0), -1)"


@query(f"""
    with d as (select distinct doc_id, doc_code, doctype, brand, model_code, brewer, cabinet_size, lang, edition, coalesce(doc_date, '') dt, pages, path, sha256, superseded_by is null live, {_VERSION.format('edition')} v from document),
    u as (select * from d qualify sha256 is null or first_value(path) over (partition by sha256 order by live desc, pages desc, path) = path),
    k as (select *, case when doc_code is not null then 'code|' || doc_code when doctype = 'pb' and brand is not null and model_code is not null then concat_ws('|', 'parts', brand, model_code, coalesce(brewer, '-'), coalesce(cabinet_size, '-'), coalesce(lang, '-')) end key from u),
    l as (select *, first_value(doc_id) over w newest, first_value(v) over w nv, first_value(dt) over w nd from k where key is not null window w as (partition by key order by v desc, dt desc, coalesce(pages, -1) desc, doc_id desc))
    select doc_id, newest, case when doc_id = newest then 'latest' when v = nv and dt = nd then 'duplicate' else 'superseded' end role from l""")
def agg8_editions(t: Tables) -> DataFrame:
    """Editions of one book, copies left out: by its document code, or for a parts book by what it is for and its language."""
    cols = ["doc_id", "doc_code", "doctype", "brand", "model_code", "brewer", "cabinet_size", "lang", "edition", "pages", "path", "sha256"]
    d = t("document").select(*cols, F.coalesce("doc_date", F.lit("")).alias("dt"), F.col("superseded_by").isNull().alias("live")).distinct()
    rank = [(~F.col("live")).cast("int"), F.coalesce(-F.col("pages"), F.lit(1)), F.col("path")]
    d = content_duplicates(d, content="sha256", name="path", rank=rank).filter("duplicate_of is null")
    parts = (F.col("doctype") == "pb") & F.col("brand").isNotNull() & F.col("model_code").isNotNull()
    given = F.concat_ws("|", F.lit("parts"), "brand", "model_code", *[F.coalesce(c, F.lit("-")) for c in ("brewer", "cabinet_size", "lang")])
    d = d.withColumn("key", F.when(F.col("doc_code").isNotNull(), F.concat(F.lit("code|"), "doc_code")).when(parts, given)).filter("key is not null")
    return superseded(d, keys=["key"], name="doc_id", order=[X.version_key(F.col("edition")), F.col("dt")], then=[F.coalesce("pages", F.lit(-1)), F.col("doc_id")]).select("doc_id", "newest", "role")


BRANDS = "mondil fenno luxem orvo zendo belu haruk tamiq pyrel sarpo quenta kivra".split()


def _norm(c: str) -> str:
    low = f"regexp_replace(lower({c}), '[0-9][a-z][0-9]{{5}}', '', 'g')"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({low}, '\\b(?:{'|'.join(BRANDS)})\\b', '~', 'g'), '[®™]', '', 'g'), '{WS}+', ' ', 'g'))"



@query(f"select topic_id, {_norm('title')} norm from topic where title is not null")
def str2_normalised_text(t: Tables) -> DataFrame:
    """Titles without document codes, with all brands made one."""
    return t("topic").filter("title is not null").select("topic_id", X.normalised(F.col("title"), BRANDS, r"[0-9][a-z][0-9]{5}").alias("norm"))


@query(f"select topic_id, sha1({_norm('title')}) fingerprint from topic where title is not null")
def str3_fingerprints(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", X.fingerprint(F.col("title"), BRANDS, r"[0-9][a-z][0-9]{5}").alias("fingerprint"))


@query(f"""with r as (select topic_id, arg_min(text, struct_pack(o := case lower(lang) when 'en' then 0 when 'nl' then 1 else 2 end, i := text_id)) body from topic_text where text is not null and trim(text) <> '' group by 1)
    select kind, coalesce(doctype, '') doctype, coalesce(section_no, '') number, substr(sha1({_norm('body')}), 1, 16) sig, count(*) n, min(topic_id) first from topic join r using (topic_id) group by all""")
def agg9_fingerprint_groups(t: Tables) -> DataFrame:
    """Topics of one kind, book and number whose reference texts, English first, are the same but for brands and codes."""
    order = F.struct(F.when(F.lower("lang") == "en", 0).when(F.lower("lang") == "nl", 1).otherwise(2), "text_id")
    body = t("topic_text").filter("text is not null and trim(text) <> ''").groupBy("topic_id").agg(F.min_by("text", order).alias("body"))
    sig = F.substring(X.fingerprint(F.col("body"), BRANDS, r"[0-9][a-z][0-9]{5}"), 1, 16).alias("sig")
    rows = t("topic").join(body, "topic_id").select("topic_id", "kind", F.coalesce("doctype", F.lit("")).alias("doctype"), F.coalesce("section_no", F.lit("")).alias("number"), sig)
    return rows.groupBy("kind", "doctype", "number", "sig").agg(F.count("*").alias("n"), F.min("topic_id").alias("first"))


@query("""with s as (select coalesce(doctype, '') doctype, unnest(string_split(coalesce(platforms, ''), ',')) platform, kind, coalesce(section_no, '') number, case when section_no is null then coalesce(t.title, '') else '' end title, lower(x.lang) lang, text_id from topic t join topic_text x using (topic_id) where x.lang is not null)
    select doctype, platform, kind, number, title, lang, min(text_id) text_id from s group by all""")
def agg10_slots(t: Tables) -> DataFrame:
    """The first text of each slot (book, platform, kind, number, or the title where there is no number) and language."""
    slot = ["doctype", "platform", "kind", "number", "title"]
    topics = t("topic").select(
        "topic_id", F.coalesce("doctype", F.lit("")).alias("doctype"), F.explode(F.split(F.coalesce("platforms", F.lit("")), ",")).alias("platform"), "kind",
        F.coalesce("section_no", F.lit("")).alias("number"), F.when(F.col("section_no").isNull(), F.coalesce("title", F.lit(""))).otherwise("").alias("title"),
    )
    rows = topics.join(t("topic_text").filter("lang is not null").select("topic_id", F.lower("lang").alias("lang"), "text_id"), "topic_id")
    return first_by(rows.select(*slot, "lang", "text_id"), [*slot, "lang"], [F.col("text_id")])


@query(f"""with k as (select topic_id, {_norm('title')} k, platforms from topic where title is not null),
    x as (select k.k, lower(x.lang) lang, arg_min(x.text_id, x.text_id) text_id from k join topic_text x using (topic_id) where x.lang is not null group by 1, 2)
    select 't_' || substr(sha1(k), 1, 12) id, k, (select list_sort(list_distinct(flatten(list(string_split(p.platforms, ','))))) from k p where p.k = m.k and p.platforms is not null) platforms,
    coalesce((select list_sort(list(distinct lower(trim(l.product_id)))) from k p join topic_product l using (topic_id) where p.k = m.k and l.product_id is not null), []) products,
    coalesce((select list_sort(list(distinct lower(trim(s.doc_id)))) from k p join topic_source s using (topic_id) where p.k = m.k and s.doc_id is not null), []) docs,
    coalesce((select list_sort(list(lang || '=' || text_id)) from x where x.k = m.k), []) payloads from (select distinct k from k) m""")
def agg11_merge_topics(t: Tables) -> DataFrame:
    """Topics of one normalised title as one: all platforms, products and books, and the first text of each language."""
    k = t("topic").filter("title is not null").select("topic_id", X.normalised(F.col("title"), BRANDS, r"[0-9][a-z][0-9]{5}").alias("k"), "platforms")
    none = F.array().cast("array<string>")

    def sets(name: str, column: str, out: str) -> DataFrame:
        links = t(name).filter(F.col(column).isNotNull()).select("topic_id", F.lower(F.trim(column)).alias("v")).distinct()
        return links.join(k.select("topic_id", "k"), "topic_id").groupBy("k").agg(F.array_sort(F.collect_set("v")).alias(out))

    platforms = k.filter("platforms is not null").select("k", F.explode(F.split("platforms", ",")).alias("v")).groupBy("k").agg(F.array_sort(F.collect_set("v")).alias("platforms"))
    texts = t("topic_text").filter("lang is not null").select("topic_id", F.lower("lang").alias("lang"), "text_id").join(k.select("topic_id", "k"), "topic_id")
    texts = texts.groupBy("k", "lang").agg(F.min("text_id").alias("text_id")).groupBy("k").agg(F.array_sort(F.collect_list(F.concat("lang", F.lit("="), F.col("text_id").cast("string")))).alias("payloads"))
    out = k.select("k").distinct().join(platforms, "k", "left").join(sets("topic_product", "product_id", "products"), "k", "left").join(sets("topic_source", "doc_id", "docs"), "k", "left").join(texts, "k", "left")
    return out.select(F.concat(F.lit("t_"), F.substring(F.sha1("k"), 1, 12)).alias("id"), "k", "platforms", *[F.coalesce(c, none).alias(c) for c in ("products", "docs", "payloads")])


@query("""with d as (select distinct doc_id, brand, model_code, brewer from document) select brand, model_code, list_sort(list(doc_id)) docs, max(brewer) brewer, arg_min(doc_id, doc_id) first_doc from d group by 1, 2""")
def agg12_product_rollup(t: Tables) -> DataFrame:
    d = t("document").select("doc_id", "brand", "model_code", "brewer").distinct()
    return d.groupBy("brand", "model_code").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"), F.max("brewer").alias("brewer"), F.min_by("doc_id", "doc_id").alias("first_doc"))


@query("select brand, list_sort(list(distinct regexp_extract(series, '\\d+', 0))) series from product where series is not null group by 1")
def agg13_series_set(t: Tables) -> DataFrame:
    return t("product").filter("series is not null").groupBy("brand").agg(F.array_sort(F.collect_set(F.regexp_extract("series", "\\d+", 0))).alias("series"))


@query("""select grp, model_code, spec_id, n from (select grp, model_code, spec_id, len(items) n, row_number() over (partition by grp, model_code order by len(items) desc, spec_id) k from (select distinct grp, model_code, spec_id, items from specs)) where k = 1""")
def agg14_fullest_table(t: Tables) -> DataFrame:
    rows = t("specs").select("grp", "model_code", "spec_id", F.size("items").cast("bigint").alias("n")).distinct()
    return first_by(rows, ["grp", "model_code"], [-F.col("n"), F.col("spec_id")])


@query("""select brand, count(*) filter (where cabinet_size = 'Small') small, count(*) filter (where cabinet_size = 'Medium') medium, min(valves) least, max(valves) most from product group by 1""")
def agg16_pivot(t: Tables) -> DataFrame:
    counts = t("product").groupBy("brand").pivot("cabinet_size", ["Small", "Medium"]).agg(F.count(F.lit(1)))
    ends = t("product").groupBy("brand").agg(F.min("valves").alias("least"), F.max("valves").alias("most"))
    return ends.join(counts, "brand").select("brand", F.coalesce("Small", F.lit(0).cast("bigint")).alias("small"), F.coalesce("Medium", F.lit(0).cast("bigint")).alias("medium"), "least", "most")


@query("""select doctype, arg_min(lang, [-n, 0]) lang from (select doctype, lang, sum(pages) n from (select distinct doc_id, doctype, lang, pages from document where lang is not null) group by 1, 2) group by 1""")
def agg19_dominant_value(t: Tables) -> DataFrame:
    sums = t("document").filter("lang is not null").select("doc_id", "doctype", "lang", "pages").distinct().groupBy("doctype", "lang").agg(F.sum("pages").alias("n"))
    return sums.groupBy("doctype").agg(F.max_by("lang", "n").alias("lang"))


@query("""select kind, min(topic_id) topic_id, title, left(coalesce(x, ''), 400) head from (select t.topic_id, kind, t.title, min(text) x from topic t join topic_text using (topic_id) group by 1, 2, 3) group by 1, 3, 4""")
def agg20_search_rows(t: Tables) -> DataFrame:
    body = t("topic_text").groupBy("topic_id").agg(F.min("text").alias("x"))
    rows = t("topic").join(body, "topic_id").select("kind", "topic_id", "title", F.left(F.coalesce("x", F.lit("")), F.lit(400)).alias("head"))
    return first_by(rows, ["kind", "title", "head"], [F.col("topic_id")])


@query("select part_nr, min(length(description)) score, arg_min(part_id, [length(description), cast(substr(part_id, 2) as bigint)]) best from part_row where part_nr is not null and description is not null group by 1")
def agg22_best_reading(t: Tables) -> DataFrame:
    rows = t("part_row").filter("part_nr is not null and description is not null")
    score = F.struct(F.length("description"), F.substring("part_id", 2, 20).cast("bigint"))
    return rows.groupBy("part_nr").agg(F.min(F.length("description")).alias("score"), F.min_by("part_id", score).alias("best"))


@query("""select m, count(*) filter (where kind = 'fault') faults, count(*) filter (where kind = 'procedure') procedures from (select kind, unnest(string_split(platforms, ',')) m from topic) group by 1""")
def agg23_counts_if(t: Tables) -> DataFrame:
    rows = t("topic").select("kind", F.explode(F.split("platforms", ",")).alias("m"))
    return rows.groupBy("m").agg(F.count_if(F.col("kind") == "fault").alias("faults"), F.count_if(F.col("kind") == "procedure").alias("procedures"))


@query("""select drawing, count(*) filter (where available = 1) n_parts, list_sort(list(distinct part_nr) filter (where part_nr is not null)) numbers from (select distinct part_id, drawing, available, part_nr from part_row where drawing is not null) group by 1""")
def agg24_parts_of_drawing(t: Tables) -> DataFrame:
    rows = t("part_row").filter("drawing is not null").select("part_id", "drawing", "available", "part_nr").distinct()
    numbers = F.array_sort(F.collect_set("part_nr"))
    return rows.groupBy("drawing").agg(F.count_if(F.col("available") == 1).alias("n_parts"), F.when(F.size(numbers) > 0, numbers).alias("numbers"))


@query("""select doctype, kind, topic_id, row_number() over (partition by doctype, kind order by coalesce(section_no, ''), topic_id) step from topic""")
def agg25_ordered_groups(t: Tables) -> DataFrame:
    """The place of each topic in its group, from one distributed order: no group is gathered in one place."""
    rows = t("topic").select("doctype", "kind", "topic_id", F.coalesce("section_no", F.lit("")).alias("o"))
    rows = distributed_rank(rows, ["doctype", "kind", "o", "topic_id"])
    first = rows.groupBy("doctype", "kind").agg(F.min("rank").alias("first")).withColumnsRenamed({"doctype": "d", "kind": "k"})
    same = F.col("doctype").eqNullSafe(F.col("d")) & F.col("kind").eqNullSafe(F.col("k"))
    return rows.join(first, same).select("doctype", "kind", "topic_id", (F.col("rank") - F.col("first") + 1).alias("step"))


@query("select kind, round(count(*) filter (where list_contains(string_split(languages, ','), 'nl')) / count(*), 6) share from topic group by 1")
def agg27_language_share(t: Tables) -> DataFrame:
    native = F.count_if(F.array_contains(F.split("languages", ","), "nl"))
    return t("topic").groupBy("kind").agg(F.round(native / F.count("*"), 6).alias("share"))


# Windows


@query("""select part_id, last_value(grp ignore nulls) over (partition by doc_id order by n rows unbounded preceding) heading from (select part_id, doc_id, grp, min(cast(substr(part_id, 2) as bigint)) n from part_row where doc_id is not null group by 1, 2, 3)""")
def win1_forward_fill(t: Tables) -> DataFrame:
    rows = t("part_row").filter("doc_id is not null").select("part_id", "doc_id", "grp", F.substring("part_id", 2, 20).cast("bigint").alias("n")).distinct()
    return forward_fill(rows, F.col("grp"), by=["doc_id"], order=["n"], name="heading").select("part_id", "heading")


@query("""with p as (select distinct cast(substr(part_id, 2) as bigint) n, doc_id, coalesce(section, '') section from part_row where doc_id is not null),
    s as (select *, case when lag(section) over w is distinct from section or row_number() over w = 1 then 1 else 0 end st from p window w as (partition by doc_id order by n)),
    i as (select *, sum(st) over (partition by doc_id order by n rows unbounded preceding) island from s)
    select doc_id, cast(island as bigint) island, section, min(n) first, count(*) n from i group by 1, 2, 3""")
def win12_islands(t: Tables) -> DataFrame:
    rows = t("part_row").filter("doc_id is not null").select(F.substring("part_id", 2, 20).cast("bigint").alias("k"), "doc_id", F.coalesce("section", F.lit("")).alias("section")).distinct()
    starts = rows.withColumn("starts", changed("section", by=["doc_id"], order=["k"]))
    return islands(starts, F.col("starts"), by=["doc_id"], order=["k"]).groupBy("doc_id", "island", "section").agg(F.min("k").alias("first"), F.count("*").alias("n"))


@query("""with e as (select user_id, event_id, value v, max(value + 1) over (partition by user_id order by value, event_id rows between unbounded preceding and 1 preceding) reach from events)
    select user_id, round(reach, 6) gap_start, round(v, 6) gap_end from e where v - reach >= 40""")
def win8_gaps(t: Tables) -> DataFrame:
    e = t("events").select("user_id", F.col("value").alias("s"), (F.col("value") + 1).alias("e"))
    return gaps(e, by=["user_id"], start="s", end="e", least=40).select("user_id", F.round("gap_start", 6).alias("gap_start"), F.round("gap_end", 6).alias("gap_end"))


@query("""with e as (select user_id, event_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 3600 second then 0 else 1 end st from events)
    select user_id, event_id, cast(sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) session from e""")
def win10_sessions(t: Tables) -> DataFrame:
    e = t("events").select("user_id", "event_id", "ts")
    return sessions(e, by=["user_id"], at="ts", seconds=3600, order=["event_id"]).select("user_id", "event_id", "session")


@query("""with d as (select distinct doc_id, doctype || '-' || brand k, coalesce(edition, '') e, coalesce(doc_date, '') dt, coalesce(cast(pages as varchar), '') pg, left(sha256, 6) h from document where doctype is not null and brand is not null),
    s as (select *, regexp_replace(e, '[^a-z0-9]+', '-', 'g') e2, regexp_replace(dt, '[^a-z0-9]+', '-', 'g') d2 from d), n as (select *, row_number() over (partition by k order by doc_id) nth from s),
    c as (select *, case when nth = 1 then k when e2 <> '' and not contains(k, e2) then k || '-' || e2 when d2 <> '' and not contains(k, d2) then k || '-' || d2 when pg <> '' and not contains(k, pg) then k || '-' || pg else k || '-' || h end c from n),
    r as (select *, case when nth = 1 then k when row_number() over (partition by c order by nth > 1, doc_id) > 1 then k || '-' || h else c end r from c)
    select doc_id, case when row_number() over (partition by r order by nth > 1, c <> r, doc_id) = 1 then r else r || '-' || row_number() over (partition by r order by nth > 1, c <> r, doc_id) end unique_id from r""")
def win13_unique_ids(t: Tables) -> DataFrame:
    rows = t("document").filter("doctype is not null and brand is not null").select("doc_id", F.concat_ws("-", "doctype", "brand").alias("k"), "edition", "doc_date", "pages", "sha256").distinct()
    candidates = [F.col("edition"), F.col("doc_date"), F.col("pages").cast("string")]
    return disambiguate(rows, key="k", candidates=candidates, order=[F.col("doc_id")], fallback=F.left("sha256", F.lit(6))).select("doc_id", "unique_id")


@query("""with d as (select distinct doc_id, brand, pages, doctype from document where pages is not null and brand is not null), w as (select *, first_value(pages) over (partition by brand order by doctype <> 'pb', pages desc) ref from d)
    select doc_id from w where doctype = 'pb' or pages >= 0.35 * ref""")
def win14_share_of_first(t: Tables) -> DataFrame:
    d = t("document").filter("pages is not null and brand is not null").select("doc_id", "brand", "pages", "doctype").distinct()
    first = d.groupBy("brand").agg(F.min(F.struct((F.col("doctype") != "pb").alias("o"), (-F.col("pages")).alias("p")))["p"].alias("ref"))
    return d.join(first, "brand").filter((F.col("doctype") == "pb") | (F.col("pages") >= -0.35 * F.col("ref"))).select("doc_id")


@query("""select topic_id, title || case when count(*) over (partition by title) > 1 then case when ends_with(title, ')') then ' — ' || kind else ' (' || kind || ')' end else '' end label from topic where title is not null""")
def win16_label_collisions(t: Tables) -> DataFrame:
    n = t("topic").filter("title is not null").groupBy("title").agg(F.count("*").alias("n"))
    tail = F.when(F.col("title").endswith(")"), F.concat(F.lit(" — "), "kind")).otherwise(F.concat(F.lit(" ("), "kind", F.lit(")")))
    return t("topic").join(n, "title").select("topic_id", F.concat("title", F.when(F.col("n") > 1, tail).otherwise("")).alias("label"))


@query("""with g as (select title, count(*) n, count(distinct coalesce(scope, '')) = count(*) and bool_and(coalesce(scope, '') <> '') by_scope, count(distinct kind) = count(*) by_kind from topic where title is not null group by 1)
    select topic_id, case when n = 1 then title when by_scope then title || ' (' || scope || ')' when by_kind then title || ' (' || kind || ')' else title || ' (' || topic_id || ')' end label from topic join g using (title)""")
def win15_spelled_out(t: Tables) -> DataFrame:
    """The first naming that is complete and unique within the title's group; the last applies otherwise."""
    s = F.coalesce("scope", F.lit(""))
    g = t("topic").filter("title is not null").groupBy("title").agg(
        F.count("*").alias("n"), ((F.countDistinct(s) == F.count("*")) & F.bool_and(s != "")).alias("by_scope"), (F.countDistinct("kind") == F.count("*")).alias("by_kind")
    )
    name = F.when(F.col("by_scope"), F.col("scope")).when(F.col("by_kind"), F.col("kind")).otherwise(F.col("topic_id"))
    return t("topic").join(g, "title").select("topic_id", F.when(F.col("n") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" ("), name, F.lit(")"))).alias("label"))


# Scalar functions

def _compatible() -> str:
    """SQL of a map from the letters that a compatibility decomposition changes to what it leaves of them, made by rule."""
    import unicodedata

    pairs = []
    for c in map(chr, [*range(0xA0, 0x3400), *range(0xF900, 0xFFF0)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if d != c and d.isascii():
            pairs.append((c, d.replace("'", "''")))
    return "map {" + ", ".join(f"'{c}': '{d}'" for c, d in pairs) + "}"


@query(f"""with m as (select {_compatible()} m) select topic_id, trim(regexp_replace(lower(array_to_string(list_transform(string_split(strip_accents(title), ''), lambda c: case when c <= '~' then c else coalesce(m.m[c], c) end), '')), '[^a-z0-9]+', '-', 'g'), '-') slug from topic, m where title is not null""")
def str1_slug(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", X.slug(F.col("title")).alias("slug"))


@query(f"select topic_id, {_SEARCH.format('title')} k from topic where title is not null")
def str35_search_key(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", X.search_key(F.col("title")).alias("k"))


@query("select topic_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) k from topic")
def str37_plain_key(t: Tables) -> DataFrame:
    return t("topic").select("topic_id", X.plain_key(F.col("title")).alias("k"))


@query("select topic_id, regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', '', 'g') k from topic where title is not null")
def str34_match_key(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", X.match_key(F.col("title")).alias("k"))


@query("""select doc_id, trim(regexp_replace(lower(strip_accents(concat_ws('-', doctype, brand, model_code))), '[^a-z0-9]+', '-', 'g'), '-') id from document group by all""")
def str19_composite_slug(t: Tables) -> DataFrame:
    return t("document").select("doc_id", X.composite_slug(F.col("doctype"), F.col("brand"), F.col("model_code")).alias("id")).distinct()


@query(f"select distinct edition, {_VERSION.format('edition')} v from document")
def str16_version_key(t: Tables) -> DataFrame:
    return t("document").select("edition", X.version_key(F.col("edition")).alias("v")).distinct()


@query("""select distinct part_nr, case when length(upper(trim(part_nr))) between 3 and 20 and regexp_matches(part_nr, '[0-9]') and not regexp_matches(part_nr, '[=#]') then upper(trim(part_nr)) end nr from part_row""")
def str31_part_number(t: Tables) -> DataFrame:
    return t("part_row").select("part_nr", X.number_or_null(F.col("part_nr")).alias("nr")).distinct()


@query("""select distinct pos, coalesce(nullif(lower(ltrim(trim(pos), '0')), ''), '0') k from part_row""")
def str41_position_key(t: Tables) -> DataFrame:
    return t("part_row").select("pos", X.position_key(F.col("pos")).alias("k")).distinct()


@query("""select distinct product_id, split_part(product_id, '.', 1) brand, split_part(product_id, '.', 2) code from product""")
def str32_split_id(t: Tables) -> DataFrame:
    return t("product").select("product_id", F.substring_index("product_id", ".", 1).alias("brand"), F.substring_index("product_id", ".", -1).alias("code"))


@query("""select topic_id, case when regexp_matches(lower(title), 'fault|storing|störung|défaut|fejl') then 'fault' when regexp_matches(lower(title), 'clean|reinig|nettoy|rengør') then 'cleaning' else 'other' end category from topic where title is not null""")
def str26_ordered_rules(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", _category(F.lower("title")).alias("category"))


def _category(low: Column) -> Column:
    return F.when(low.rlike("fault|storing|störung|défaut|fejl"), "fault").when(low.rlike("clean|reinig|nettoy|rengør"), "cleaning").otherwise("other")


@query("select doc_id, length(text) chars, sha256(text) digest, sha1(text) sha from documents where text is not null")
def str4_digests(t: Tables) -> DataFrame:
    return t("documents").filter("text is not null").select("doc_id", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"), F.sha1("text").alias("sha"))


@query()
def str5_clean(t: Tables) -> DataFrame:
    return t("topic_text").select("text_id", X.clean(F.col("text")).alias("text")).distinct()


@query(f"""with s as (select distinct text_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') x from topic_text), h as (select text_id, regexp_replace(regexp_replace(split_part(x, chr(10), 1), '^[0-9]+(?:[.][0-9]+)*[.]?[ \\t\\f\\r\\x0b]+', ''), '^{WS}+|{WS}+$', '', 'g') h from s)
    select distinct text_id, case when length(h) between 1 and 80 and not ends_with(h, '.') then h end heading from h""")
def str29_heading(t: Tables) -> DataFrame:
    return t("topic_text").select("text_id", X.heading(F.col("text")).alias("heading")).distinct()


@query("""select text_id, len(list_filter(regexp_extract_all(text, '(?:^|\\n)[0-9]+[.] '), lambda x: true)) n from (select distinct text_id, text from topic_text where text is not null)""")
def str23_list_entries(t: Tables) -> DataFrame:
    rows = t("topic_text").filter("text is not null").select("text_id", F.size(F.regexp_extract_all("text", F.lit("((?:^|\\n)[0-9]+[.] )"), 1)).cast("bigint").alias("n"))
    return rows.distinct()


@query("select topic_id, length(title) * 1000 // (40 + least(length(title), 1200)) score from topic")
def mth1_integer_score(t: Tables) -> DataFrame:
    return t("topic").select("topic_id", F.expr("length(title) * 1000 div (40 + least(length(title), 1200))").alias("score"))


@query("select doc_id, doc_date, try_cast(doc_date as date) d, year(try_cast(doc_date as date)) y from document group by all")
def dat2_dates(t: Tables) -> DataFrame:
    d = F.col("doc_date").try_cast("date")
    return t("document").select("doc_id", "doc_date", d.alias("d"), F.year(d).cast("bigint").alias("y")).distinct()


@query("""with s as (select event_id, cast(1985 + event_id % 130 as varchar) || lpad(cast(event_id % 60 as varchar), 2, '0') || '-X' serial from events)
    select event_id, case when not (1985 + event_id % 130) between 1990 and 2100 then '' when event_id % 60 between 1 and 53 then cast(1985 + event_id % 130 as varchar) || ' · week ' || cast(event_id % 60 as varchar) else cast(1985 + event_id % 130 as varchar) end b from s""")
def dat4_built(t: Tables) -> DataFrame:
    serial = F.expr("concat(cast(1985 + event_id % 130 as string), lpad(cast(event_id % 60 as string), 2, '0'), '-X')")
    return t("events").select("event_id", X.built(serial).alias("b"))


@query("""with r as (select topic_id, regexp_extract(lower(trim(lang)), '^[a-z]{2,3}') lang, arg_min_null(title, text_id) title from topic_text where regexp_matches(lower(trim(lang)), '^[a-z]{2,3}([-_]|$)') group by 1, 2)
    select topic_id, arg_min(title, struct_pack(o := coalesce(list_position(['nl', 'en', 'de'], lang), 99), l := lang)) filter (where title is not null and title <> '') title from r group by 1""")
def map1_pick_language(t: Tables) -> DataFrame:
    """The first title by order of languages, region and case of a label aside."""
    lang = F.lower(F.trim("lang"))
    rows = t("topic_text").filter(lang.rlike("^[a-z]{2,3}([-_]|$)")).groupBy("topic_id", F.regexp_extract(lang, "^[a-z]{2,3}", 0).alias("lang")).agg(F.min_by("title", "text_id").alias("title"))
    by_lang = rows.groupBy("topic_id").agg(F.map_from_entries(F.collect_list(F.struct("lang", "title"))).alias("m"))
    return by_lang.select("topic_id", X.pick(F.col("m"), ["nl", "en", "de"]).alias("title"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def jsn1_decode(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query()
def jsn3_inferred_schema(t: Tables) -> DataFrame:
    """The schema of all payloads together, conflicting types united."""
    rows = t("topic_text").filter("payload is not null")
    return rows.agg(F.expr("schema_of_variant_agg(try_parse_json(payload))").alias("schema"))


@query("""select spec_id, bool_or(i.v like '%bar%') any_bar, bool_and(i.k is not null) all_k, count(*) filter (where i.v is null) no_v, arg_min(i.v, n) first_v from (select spec_id, unnest(items) i, generate_subscripts(items, 1) n from (select distinct spec_id, items from specs)) group by 1""")
def arr2_any_all_count(t: Tables) -> DataFrame:
    rows = t("specs").dropDuplicates(["spec_id"]).filter(F.size("items") > 0)
    return rows.select(
        "spec_id",
        F.exists("items", lambda x: F.coalesce(F.contains(x["v"], F.lit("bar")), F.lit(False))).alias("any_bar"),
        F.forall("items", lambda x: x["k"].isNotNull()).alias("all_k"),
        F.size(F.filter("items", lambda x: x["v"].isNull())).cast("bigint").alias("no_v"),
        F.try_element_at(F.filter("items", lambda x: x["v"].isNotNull()), F.lit(1))["v"].alias("first_v"),
    )


# Streams, folded over stored frames


@query("""with e as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) nx from events) select user_id, event_id from e where nx is null or nx - ts > interval 600 second""")
def stm10_debounced(t: Tables) -> DataFrame:
    """The last of events that follow each other within ten minutes."""
    after = F.lead(F.col("ts")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = t("events").withColumn("nx", after)
    return e.filter(F.col("nx").isNull() | (F.col("nx") > F.expr("ts + interval 600 second"))).select("user_id", "event_id")


@query("""select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts desc, event_id desc) k from events) where k = 1""")
def stm1_latest_of_interval(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy(F.desc("ts"), F.desc("event_id")))
    return t("events").withColumn("k", nth).filter("k = 1").select("user_id", "event_id")
