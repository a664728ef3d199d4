"""Files in and out, and what their names and properties say, over the knowledge base."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composite_slug
from ..operators import inventory as V
from ..operators.dedup import content_duplicates
from ..session import scratch
from ..sources import files as S
from .registry import Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql

DOCTYPES = {"im": "installation", "um": "user", "tm": "technical", "pb": "parts", "sm": "maintenance", "br": "brochure"}
_DOCTYPES_SQL = "case {} " + " ".join(f"when '{k}' then '{v}'" for k, v in DOCTYPES.items()) + " end"


def _path(t: Tables) -> tuple:
    spark = t("product").sparkSession
    return spark, scratch(spark)


@query("select table_name || '.parquet' as name from information_schema.tables where table_schema = 'main'")
def src1_inventory(t: Tables) -> DataFrame:
    """The data folder's own tables, each one file or a folder of part files."""
    root = re.sub("^file:/+", "file:/", unquote(t("product").inputFiles()[0].rpartition("/product.parquet")[0]))
    at = S.inventory(t("product").sparkSession, root, "*.parquet").select(F.posexplode(F.split("path", "/")).alias("n", "name"))
    return at.filter(F.col("n") == root.count("/") + 1).select("name").distinct()


@query("""with l as (select distinct text_id, text from topic_text where text is not null), b as (select text_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n, len(string_split(text, chr(10))) last from l),
    k as (select *, trim(regexp_replace(regexp_replace(line, '[0-9]', '#', 'g'), '[ \\t\\n\\x0b\\f\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) key from b),
    d as (select key from k where n in (1, last) and last > 1 group by 1 having count(*) > 2)
    select text_id, count(*) blocks from k where not (last > 1 and n in (1, last) and key in (select key from d)) group by 1""")
def src3_blocks(t: Tables) -> DataFrame:
    """Lines as blocks of a page; the first and last, its margins, go where their key recurs there."""
    from ..functions.text import margin_key

    lines = t("topic_text").filter("text is not null").select("text_id", "text").distinct()
    blocks = lines.select("text_id", F.size(F.split("text", "\n")).alias("last"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    blocks = blocks.withColumn("key", margin_key(F.col("line"))).withColumn("margin", (F.col("last") > 1) & ((F.col("n") == 0) | (F.col("n") == F.col("last") - 1)))
    drop = blocks.filter("margin").groupBy("key").agg(F.count("*").alias("c")).filter("c > 2").select("key", F.lit(True).alias("margin"))
    return blocks.join(drop, ["key", "margin"], "left_anti").groupBy("text_id").agg(F.count("*").alias("blocks"))


@query("""select topic_id, len(regexp_extract_all(section_no, '[.]')) + 1 as level, trim(title) title, greatest(0, try_cast(split_part(section_no, '.', 1) as integer) - 2) page, try_cast(nullif(regexp_extract(section_no, '[.](\\d+)', 1), '') as double) y from topic where section_no is not null""")
def src4_anchors(t: Tables) -> DataFrame:
    """Section numbers as bookmarks (level, title, page, y); a place that is not a number is null."""
    no = F.col("section_no")
    y = F.coalesce(V.none_if_empty(F.regexp_extract(no, r"[.](\d+)", 1)).try_cast("double"), F.lit(float("nan")))
    return t("topic").filter("section_no is not null").select(
        "topic_id", (F.size(F.regexp_extract_all(no, F.lit("([.])"), 1)) + 1).cast("bigint").alias("level"), F.trim("title").alias("title"),
        F.greatest(F.lit(0), F.substring_index(no, ".", 1).try_cast("int") - 2).alias("page"), F.when(~F.isnan(y), y).alias("y"),
    )


@query("select product_id, brand, valves from product")
def src5_json_or_default(t: Tables) -> DataFrame:
    """A JSON file, and a missing one as an empty table."""
    spark, at = _path(t)
    S.write_json(t("product").select("product_id", "brand", "valves"), f"{at}/product")
    schema = "product_id string, brand string, valves string"
    return S.read_json(spark, f"{at}/product", schema, multi_line=False).unionByName(S.read_json(spark, f"{at}/none", schema))


@query("select d.doctype, count(distinct doc_id) books from (select unnest(['tm', 'um', 'zz']) doctype) d left join document using (doctype) group by 1")
def src6_gzip_by_book(t: Tables) -> DataFrame:
    """Compressed JSON in a folder for each kind of book; a kind without one has no books."""
    spark, at = _path(t)
    S.write_json(t("document").select("doctype", "doc_id").distinct(), at, by=["doctype"], gzip=True)
    found = S.read_json(spark, at, "doc_id string, doctype string", multi_line=False)
    wanted = spark.createDataFrame([("tm",), ("um",), ("zz",)], "doctype string")
    return wanted.join(found, "doctype", "left").groupBy("doctype").agg(F.countDistinct("doc_id").alias("books"))


@query("select 'de' wanted, text_id, title from topic_text where lang = 'de' group by all union all select 'xx', text_id, title from topic_text where lang = 'nl' group by all")
def src8_locales(t: Tables) -> DataFrame:
    """The rows of a locale; of an unknown one those of the default."""
    spark, at = _path(t)
    S.write_json(t("topic_text").filter("lang is not null").select(F.col("lang").alias("locale"), "text_id", "title").distinct(), at, by=["locale"])
    rows = [S.read_locale(spark, at, x, "text_id bigint, title string").select(F.lit(x).alias("wanted"), "text_id", "title") for x in ("de", "xx")]
    return rows[0].unionAll(rows[1])


@query("select part_id, part_nr, qty from part_row group by all")
def src9_splittable_parts(t: Tables) -> DataFrame:
    """The large table as JSON lines, which executors split and read only when asked."""
    spark, at = _path(t)
    S.write_json(t("part_row").select("part_id", "part_nr", "qty").distinct(), at)
    return S.read_json(spark, at, "part_id string, part_nr string, qty string", multi_line=False)


@query("select user_id, count(*) frames, count(*) filter (where event_type <> 'view') lines from events group by 1")
def src10_frame_stream(t: Tables) -> DataFrame:
    """Events replayed as a stream of frames, those without lines included."""
    spark, at = _path(t)
    S.write_json(t("events").select("user_id", F.col("event_id").alias("frame"), F.when(F.col("event_type") != "view", F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("lines")), f"{at}/in")
    frames = S.frame_stream(spark, f"{at}/in", "user_id bigint, frame bigint, lines array<string>", files=4)
    run = frames.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.schema("user_id bigint, frame bigint, lines array<string>").parquet(f"{at}/out")
    return seen.groupBy("user_id").agg(F.count("*").alias("frames"), F.sum(F.size("lines")).alias("lines"))


@query("select topic_id, kind, title, platforms from topic")
def snk1_pretty_and_compact(t: Tables) -> DataFrame:
    """Rows that read back the same from indented as from compact JSON."""
    spark, at = _path(t)
    rows = t("topic").select("topic_id", "kind", "title", "platforms")
    schema = "topic_id string, kind string, title string, platforms string"
    S.write_json(rows, f"{at}/compact")
    pretty = S.pretty_json(rows).select(F.from_json("text", schema).alias("r")).select("r.*")
    return pretty.intersect(S.read_json(spark, f"{at}/compact", schema, multi_line=False))


@query("select link_id, topic_id, product_id from topic_product group by all")
def snk2_json_lines(t: Tables) -> DataFrame:
    spark, at = _path(t)
    S.write_json(t("topic_product").select("link_id", "topic_id", "product_id").distinct(), at)
    return S.read_json(spark, at, "link_id bigint, topic_id string, product_id string", multi_line=False)


@query("select doctype, doc_id, pages from document group by all")
def snk3_gzip_folders(t: Tables) -> DataFrame:
    spark, at = _path(t)
    S.write_json(t("document").select("doctype", "doc_id", "pages").distinct(), at, by=["doctype"], gzip=True)
    return S.read_json(spark, at, "doc_id string, pages int, doctype string", multi_line=False).select("doctype", "doc_id", "pages")


@query("select 'topic' as name, count(*) n from topic union all select 'product', count(*) from product union all select 'part_row', count(*) from part_row")
def snk4_gold_tables(t: Tables) -> DataFrame:
    """Tables written sorted by their lookup keys; rows of each."""
    spark, at = _path(t)
    keys = {"topic": ["topic_id"], "product": ["product_id"], "part_row": ["part_nr"]}
    S.write_tables({n: t(n) for n in keys}, at, keys)
    counts = [spark.read.parquet(f"{at}/{n}.parquet").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in keys]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("select distinct sha1(text) hash, strlen(text) bytes from documents where text <> '' and sha1(text) not in (select sha1(text) from eval_item where text is not null)")
def snk5_content_addressed(t: Tables) -> DataFrame:
    """Texts as blobs: one for each hash, none that is empty or among the known ones."""
    known = S.content_addressed(t("eval_item").select(F.col("text").cast("binary").alias("content")))
    return S.content_addressed(t("documents").select(F.col("text").cast("binary").alias("content")), known).select("hash", F.length("content").cast("bigint").alias("bytes"))


@query("select lower(lang) locale, count(distinct text_id) n from topic_text where lang is not null and lang not like '%?%' and trim(lang) <> '' group by 1")
def snk6_assets_by_locale(t: Tables) -> DataFrame:
    spark, at = _path(t)
    rows = t("topic_text").filter("lang is not null and not contains(lang, '?') and trim(lang) <> ''").select(F.lower("lang").alias("locale"), "text_id").distinct()
    S.write_json(rows, at, by=["locale"])
    return S.read_json(spark, at, "text_id bigint, locale string", multi_line=False).groupBy("locale").agg(F.count("*").alias("n"))


@query("""select "group", row_number() over (partition by "group" order by kind, line) rank, line from (select distinct doctype "group", 0 kind, '## ' || doctype line from document where doctype is not null
    union all select doctype, 1, '- ' || title from (select distinct doctype, title from document) where title is not null and doctype is not null)""")
def snk7_index_lines(t: Tables) -> DataFrame:
    return S.index_lines(t("document").select("doctype", "title").distinct(), group="doctype", title="title").select("group", F.col("rank").cast("bigint").alias("rank"), "line")


_PLAN = """with d as (select distinct doc_id, path, sha256, superseded_by is null live, pages, doctype from document), b as (select *, case when sha256 is not null then first_value(path) over (partition by sha256 order by live desc, coalesce(-pages, 1), path) end best from d),
    plan as (select path, case when best <> path then 'delete' when path = 'library/' || doctype || '/' || doc_id || '.pdf' then 'keep' else 'move' end action, case when best <> path then null else 'library/' || doctype || '/' || doc_id || '.pdf' end "to" from b)"""


def _plan(t: Tables) -> DataFrame:
    d = t("document").select("doc_id", "path", "sha256", F.col("superseded_by").isNull().alias("live"), "pages", "doctype").distinct()
    rank = [(~F.col("live")).cast("int"), F.coalesce(-F.col("pages"), F.lit(1)), F.col("path")]
    docs = content_duplicates(d, content="sha256", name="path", rank=rank)
    return S.file_plan(docs, F.concat(F.lit("library/"), "doctype", F.lit("/"), "doc_id", F.lit(".pdf")))


@query(f'{_PLAN} select path, action, "to" from plan')
def snk8_file_plan(t: Tables) -> DataFrame:
    """Copies of equal content are deleted but for the best; others move to their place in the library."""
    return _plan(t)


@query(f'{_PLAN} select path as old, coalesce("to", path) as new from plan where action <> \'delete\'')
def snk9_moves(t: Tables) -> DataFrame:
    return S.moves(_plan(t))


# Names, codes and properties


_BRANDS = "mondil fenno luxem orvo zendo belu haruk tamiq pyrel sarpo quenta kivra".split()


@query(f"""with d as (select distinct path, string_split(regexp_replace(split_part(path, '/', -1), '[.][^.]*$', ''), '_') p from document where path is not null)
    select path, {_DOCTYPES_SQL.format("split_part(path, '/', -2)")} doctype, case when list_contains({_BRANDS}, lower(p[1])) then lower(p[1]) end brand, case when upper(p[2]) in (select model_code from product) then upper(p[2]) end model, regexp_matches(p[-1], '^[0-9]$') copy from d""")
def str14_file_names(t: Tables) -> DataFrame:
    """Model codes are a dimension of products, sent as literals of the rule."""
    codes = [r[0] for r in t("product").select("model_code").filter("model_code is not null").distinct().collect()]
    said = V.parse_name(F.col("path"), brands=_BRANDS, codes=codes, langs=["en", "nl", "de", "fr", "da"], doctypes=DOCTYPES)
    rows = t("document").filter("path is not null").select("path").distinct().select("path", said.alias("s"))
    return rows.select("path", "s.doctype", "s.brand", "s.model", "s.copy")


FAMILIES, SUFFIXES = {"U": "user", "T": "technical", "P": "parts", "S": "short", "B": "book", "I": "install"}, {"0": "basic", "50": "plus", "5": "special", "09": "old"}


@query("""select distinct doc_code, case substr(doc_code, 2, 1) when 'U' then 'user' when 'T' then 'technical' when 'P' then 'parts' when 'S' then 'short' when 'B' then 'book' when 'I' then 'install' end family, substr(doc_code, 3) number,
    case when ends_with(doc_code, '09') then 'old' when ends_with(doc_code, '50') then 'plus' when ends_with(doc_code, '0') then 'basic' when ends_with(doc_code, '5') then 'special' end series from document where regexp_full_match(doc_code, '[0-9][A-Z][0-9]+')""")
def str15_document_codes(t: Tables) -> DataFrame:
    rows = t("document").filter(F.col("doc_code").rlike(r"^\d[A-Z]\d+$")).select("doc_code", V.decode_code(F.col("doc_code"), families=FAMILIES, suffixes=SUFFIXES).alias("d")).distinct()
    return rows.select("doc_code", "d.*")


@query("""select doc_id, coalesce(edition, nullif(regexp_extract(cover, '([0-9]+[.,][0-9]+)', 1), '')) edition, coalesce(doc_date, nullif(regexp_extract(cover, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1), '')) doc_date
    from (select distinct doc_id, edition, doc_date from document) left join (select doc_id, min(text) cover from topic_text where doc_id is not null group by 1) using (doc_id)""")
def str17_probed_covers(t: Tables) -> DataFrame:
    """What is unknown of a book is looked for in its first text."""
    covers = t("topic_text").filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("cover"))
    rows = t("document").select("doc_id", "edition", "doc_date").distinct().join(covers, "doc_id", "left")
    filled = [V.fill_gap(F.col(c), F.col("cover"), p).alias(c) for c, p in (("edition", "([0-9]+[.,][0-9]+)"), ("doc_date", "(20[0-9]{2}-[0-9]{2}-[0-9]{2})"))]
    return rows.select("doc_id", *filled)


TITLE_WORDS = {"short maintenance": "sm", "technical manual": "tm", "user manual": "um", "installation": "im", "parts": "pb"}


@query("""select distinct doc_id, coalesce(case when lower(title) like '%short maintenance%' then 'sm' when lower(title) like '%technical manual%' then 'tm' when lower(title) like '%user manual%' then 'um' when lower(title) like '%installation%' then 'im' when lower(title) like '%parts%' then 'pb' end, doctype) doctype,
    coalesce(lang, 'en') lang, case when brand is not null then array_to_string(list_filter([brand, lower(brewer), lower(cabinet_size)], lambda x: x is not null and x <> ''), '.') end product,
    trim(regexp_replace(lower(array_to_string(list_filter([doctype, brand, model_code, coalesce(lang, 'en'), coalesce('v' || replace(edition, '.', ''), replace(doc_date, '-', ''))], lambda x: x is not null and x <> ''), '-')), '[^a-z0-9]+', '-', 'g'), '-') made_id from document""")
def str18_enriched(t: Tables) -> DataFrame:
    """Gaps filled from titles, defaults, and the ids that follow."""
    d, lang = t("document"), F.coalesce("lang", F.lit("en"))
    product = F.concat_ws(".", *[V.none_if_empty(F.lower(c)) if c != "brand" else V.none_if_empty(F.col(c)) for c in ("brand", "brewer", "cabinet_size")])
    return d.select(
        "doc_id", F.coalesce(V.first_keyword(F.col("title"), TITLE_WORDS), "doctype").alias("doctype"), lang.alias("lang"), F.when(F.col("brand").isNotNull(), product).alias("product"),
        V.book_id(F.col("doctype"), F.col("brand"), F.col("model_code"), lang, version=F.col("edition"), date=F.col("doc_date")).alias("made_id"),
    ).distinct()


@query("select product_id, case when brand in ('orvo', 'belu') then 'old' when brand in ('zendo', 'luxem') then 'both' when brand = 'haruk' then 'new' else 'unknown' end generation from product")
def str20_generations(t: Tables) -> DataFrame:
    return t("product").select("product_id", V.member_class(F.col("brand"), {"old": ["orvo", "belu"], "both": ["zendo", "luxem"], "new": ["haruk"]}, "unknown").alias("generation"))


@query("""select brand, case when len(w) between 1 and 2 then array_to_string(w, ' / ') else '' end label from (select brand, list_sort(list(distinct concat_ws(' ', nullif(brewer, ''), nullif(cabinet_size, '')))) w from product where cabinet_size is not null group by 1, brewer)""")
def str33_labels_of_builds(t: Tables) -> DataFrame:
    sets = t("product").filter("cabinet_size is not null").groupBy("brand", "brewer").agg(F.collect_set(F.struct("brewer", F.col("cabinet_size").alias("size"))).alias("p"))
    return sets.select("brand", V.variant_label(F.col("p")).alias("label"))


@query("""select doc_id, case when words = '' then model_code else words || ' (' || model_code || ')' end label from (select distinct d.doc_id, d.model_code, concat_ws(' ', coalesce(own.brewer, g.brewer), coalesce(own.size, g.size)) words from document d
    left join (select brand, model_code, min(brewer) brewer, min(cabinet_size) size from product group by 1, 2) own using (brand, model_code) left join (select model_code, min(brewer) brewer, min(cabinet_size) size from product group by 1) g using (model_code) where d.model_code is not null)""")
def str42_code_labels(t: Tables) -> DataFrame:
    """`Brewer Size (CODE)` by the book's own brand, else by any brand's build of that code."""

    def builds(*by: str, p: str) -> DataFrame:
        return t("product").groupBy(*by).agg(F.min("brewer").alias(f"{p}b"), F.min("cabinet_size").alias(f"{p}s"))

    rows = t("document").filter("model_code is not null").select("doc_id", "brand", "model_code").distinct()
    rows = rows.join(builds("brand", "model_code", p="o"), ["brand", "model_code"], "left").join(builds("model_code", p="g"), "model_code", "left")
    words = F.concat_ws(" ", F.coalesce("ob", "gb"), F.coalesce("os", "gs"))
    return rows.select("doc_id", F.when(words == "", F.col("model_code")).otherwise(F.concat(words, F.lit(" ("), "model_code", F.lit(")"))).alias("label")).distinct()


@query("select distinct doc_id, path shown, 'media/' || sha256 || '.webp' hashed from document")
def str45_picture_paths(t: Tables) -> DataFrame:
    return t("document").select("doc_id", V.picture_path(F.col("path")).alias("shown"), V.picture_path(F.col("sha256")).alias("hashed")).distinct()


@query("""select distinct part_id, brand, nullif(regexp_extract(code, '^([0-9]{3,5})', 1), '') code from (select part_id, split_part(lower(trim(product_id)), '.', 1) brand, section || lpad(regexp_extract(drawing, '[0-9]+'), 3, '0') || 'x' code from part_row where product_id is not null and drawing is not null and section is not null)""")
def str46_drawing_keys(t: Tables) -> DataFrame:
    """`brand|product|code` keys taken apart again."""
    code = F.concat("section", F.lpad(F.regexp_extract("drawing", "[0-9]+", 0), 3, "0"), F.lit("x"))
    key = F.concat_ws("|", F.substring_index(F.lower(F.trim("product_id")), ".", 1), F.lit("any"), code)
    rows = t("part_row").filter("product_id is not null and drawing is not null and section is not null").select("part_id", V.drawing_key(key).alias("k")).distinct()
    return rows.select("part_id", "k.*")


@query("select distinct doc_id, cast(try_cast(doc_date as date) as varchar) d from document")
def dat1_token_dates(t: Tables) -> DataFrame:
    """Dates written as 2022nov25 inside a name, read back."""
    d = F.col("doc_date").try_cast("date")
    token = F.concat(F.lit("book_"), F.date_format(d, "yyyy"), F.element_at(F.array(*[F.lit(m) for m in V.MONTHS]), F.month(d)), F.dayofmonth(d).cast("string"), F.lit("_x.pdf"))
    return t("document").select("doc_id", V.token_date(F.when(d.isNotNull(), token)).alias("d")).distinct()


@query("select distinct doc_id, cast(try_cast(doc_date as date) as varchar) d from document")
def dat3_property_dates(t: Tables) -> DataFrame:
    d = F.col("doc_date").try_cast("date")
    return t("document").select("doc_id", V.property_date(F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd"), F.lit("101500Z"))).alias("d")).distinct()


@query("select count(*) n, true stamped from product")
def dat5_build_stamp(t: Tables) -> DataFrame:
    """The time of the run stands beside the rows and out of their comparison."""
    return t("product").withColumn("built_at", F.current_timestamp()).agg(F.count("*").alias("n"), F.bool_and(F.col("built_at").isNotNull()).alias("stamped"))
