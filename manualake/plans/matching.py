"""Search, matching of scans, plates and streams over the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fuzzy as Z
from ..operators import plates as P
from ..operators import search as S
from ..operators.dedup import first_by
from ..session import scratch
from ..sources.files import frame_stream, write_json, write_tables
from ..streaming.sightings import fold_plates, fold_sightings, stream_sightings
from .registry import Registry, Tables

R = Registry()
query, queries, oracle_sql = R.query, R.queries, R.oracle_sql

_SEARCH = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"

# Full-text search


def search_rows(t: Tables) -> DataFrame:
    """One row a text: (ref, kind, lang, title, body)."""
    x = t("topic_text").filter("text is not null").select(F.col("text_id").alias("ref"), "topic_id", F.lower("lang").alias("lang"), "title", F.col("text").alias("body")).distinct()
    return x.join(t("topic").select("topic_id", "kind"), "topic_id").select("ref", "kind", "lang", "title", "body")


_ROWS = "select x.text_id ref, t.kind, lower(x.lang) lang, x.title, x.text body from (select distinct text_id, topic_id, lang, title, text from topic_text where text is not null) x join topic t using (topic_id)"
_TOKENS = "list_filter(string_split_regex(lower(strip_accents(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda x: x <> '')"


def _bm25_sql(prefixes: list[str], title: float, body: float, limit: int = 25, more: str = '') -> str:
    cols = ", ".join(f"len(list_filter(tt, lambda x: starts_with(x, '{p}'))) t{i}, len(list_filter(bt, lambda x: starts_with(x, '{p}'))) b{i}" for i, p in enumerate(prefixes))
    idf = [f"case when ln((n - d{i} + 0.5) / (d{i} + 0.5)) <= 0 then 1e-6 else ln((n - d{i} + 0.5) / (d{i} + 0.5)) end" for i in range(len(prefixes))]
    f = [f"({title} * t{i} + {body} * b{i})" for i in range(len(prefixes))]
    score = " - ".join(["0.0", *[f"{idf[i]} * {f[i]} * 2.2 / ({f[i]} + 1.2 * (0.25 + 0.75 * dl / avg_dl))" for i in range(len(prefixes))]])
    tok = _TOKENS
    return f"""
    with r as ({_ROWS}), k as (select ref, {tok.format('title')} tt, {tok.format('body')} bt from r), c as (select ref, len(tt) + len(bt) dl, {cols} from k),
    a as (select count(*) n, avg(dl) avg_dl, {', '.join(f'count(*) filter (where t{i} + b{i} > 0) d{i}' for i in range(len(prefixes)))} from c)
    select ref, round({score}, 6) score from c, a where {more} {' and '.join(f't{i} + b{i} > 0' for i in range(len(prefixes)))} order by 2, 1 limit {limit}"""



@query(_bm25_sql(["filter", "pump"], 0.0, 8.0).replace("select ref, round", "select cast(ref as varchar) ref, round"))
def idx3_bm25_effective(t: Tables) -> DataFrame:
    return S.bm25(search_rows(t), "filter pump", key="ref")


@query(_bm25_sql(["clean", "valve"], 8.0, 1.0).replace("select ref, round", "select cast(ref as varchar) ref, round"))
def idx3_bm25_intended(t: Tables) -> DataFrame:
    return S.bm25(search_rows(t), "clean valve", key="ref", weights=S.INTENDED)


@query(_bm25_sql(["clean", "valve"], 8.0, 1.0, more="ref in (select ref from r where kind in ('menu', 'component') and lang = 'en') and ").replace("select ref, round", "select cast(ref as varchar) ref, round"))
def idx3_search_of_kinds(t: Tables) -> DataFrame:
    """Ranked over all rows, then only the kinds and the language asked for."""
    return S.search(search_rows(t), "clean valve", kinds=["menu", "component"], lang="en", weights=S.INTENDED).select("ref", "score")


def _index(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Postings sorted by term, and the tokens of each row, written once."""
    spark, rows = t("topic").sparkSession, search_rows(t)
    at = scratch(spark)
    lengths = rows.select("ref", (F.size(X.tokens(F.coalesce("title", F.lit("")))) + F.size(X.tokens(F.coalesce("body", F.lit(""))))).alias("tokens"))
    write_tables({"postings": S.postings(rows, key=["ref"], columns=["title", "body"]), "sizes": lengths}, at, {"postings": ["term"]})
    return spark.read.parquet(f"{at}/postings.parquet"), spark.read.parquet(f"{at}/sizes.parquet")


@query(_bm25_sql(["filter", "pump"], 0.0, 8.0).replace("select ref, round", "select cast(ref as varchar) ref, round"))
def srt11_search_from_the_index(t: Tables) -> DataFrame:
    """BM25, 25 best, from stored postings instead of the rows."""
    return S.indexed_search(*_index(t), "filter pump")


@query(f"""with r as ({_ROWS}), k as (select ref, 'title' as "column", unnest({_TOKENS.format('title')}) term from r union all select ref, 'body', unnest({_TOKENS.format('body')}) from r) select ref, "column", term, count(*) tf from k group by all""")
def idx1_postings(t: Tables) -> DataFrame:
    return S.postings(search_rows(t), key=["ref"], columns=["title", "body"])


@query("select part_id, part_nr from part_row where part_nr = 'XLKX10' group by all")
def idx2_point_lookup(t: Tables) -> DataFrame:
    """A number in a table stored sorted by it: other row groups are skipped."""
    spark, at = t("part_row").sparkSession, scratch(t("part_row").sparkSession)
    write_tables({"part": t("part_row").select("part_id", "part_nr").distinct()}, at, {"part": ["part_nr"]})
    return spark.read.parquet(f"{at}/part.parquet").filter("part_nr = 'XLKX10'")


@query()
def str43_snippets(t: Tables) -> DataFrame:
    """The twelve words of each text that hold most of the query, in brackets."""
    rows = search_rows(t)
    return rows.select("ref", S.snippet_udf("body", F.lit("filter pump"), F.lit(12)).alias("snippet")).filter("contains(snippet, '[')")


# Ranked substring search


def _score_sql(h: str, words: list[str]) -> str:
    each = " + ".join(f"(case when instr({h}, '{w}') = 0 then null when {h} = '{w}' then 60 when instr({h}, '{w}') = 1 then 40 when substr({h}, instr({h}, '{w}') - 1, 1) = ' ' then 25 else 10 end)" for w in words)
    return f"(({each}) * 1000 // (40 + least(length({h}), 1200)))"



@query(f"with r as (select topic_id, {_SEARCH.format('title')} t from topic where title is not null) select topic_id, {_score_sql('t', ['filter'])} score from r")
def idx4_substring_scores(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", X.substring_score(X.search_key(F.col("title")), ["filter"]).alias("score"))


@query(f"""with r as (select distinct text_id, {_SEARCH.format("coalesce(title, '')")} t, {_SEARCH.format("coalesce(text, '')")} b from topic_text) select text_id, greatest({_score_sql('t', ['filter'])} * 3, {_score_sql('b', ['filter'])}) score from r where greatest({_score_sql('t', ['filter'])} * 3, {_score_sql('b', ['filter'])}) is not null""")
def idx5_best_of_title_and_body(t: Tables) -> DataFrame:
    score = F.greatest(X.substring_score(X.search_key(F.coalesce("title", F.lit(""))), ["filter"]) * 3, X.substring_score(X.search_key(F.coalesce("text", F.lit(""))), ["filter"]))
    return t("topic_text").select("text_id", score.alias("score")).filter("score is not null").distinct()


def _by_kind_sql(kind: str, limit: int = 60) -> str:
    t, b = _score_sql("t", ["filter"]), _score_sql("b", ["filter"])
    return f"""select * from (select '{kind}' list, ref, greatest({t} * 3, {b}) score from (select t.topic_id ref, {_SEARCH.format("coalesce(t.title, '')")} t, {_SEARCH.format("coalesce(x.body, '')")} b from topic t left join (select topic_id, min(text) body from topic_text group by 1) x using (topic_id) where kind = '{kind}') where greatest({t} * 3, {b}) is not null order by 3 desc, 2 limit {limit})"""


_NUMBER = _SEARCH.format("coalesce(part_nr, '')")
_P = "(select distinct part_id, part_nr, description, section from part_row)"
_PARTS_SQL = f"""select part_id ref, coalesce({_score_sql('n', ['lekbak'])} + 100, {_score_sql('d', ['lekbak'])}) score from (select part_id, {_NUMBER} n, {_SEARCH.format("concat_ws(' ', description, section)")} d from {_P})"""


@query(f"""select * from (select 'fault' list, ref, score from (select min(topic_id) ref, max(score) score from (select topic_id, title, {_score_sql('k', ['filter'])} score from (select topic_id, title, {_SEARCH.format("concat_ws(' ', title, scope)")} k from topic where kind = 'fault' and title is not null)) where score is not null group by title) order by 3 desc, 2 limit 60)
    union all {' union all '.join(_by_kind_sql(k) for k in ('procedure', 'component', 'menu', 'view'))}
    union all select * from (select 'part', part_id, score from (select part_id, coalesce({_score_sql('n', ['filter'])} + 100, {_score_sql('d', ['filter'])}) score from (select part_id, {_NUMBER} n, {_SEARCH.format("concat_ws(' ', description, section)")} d from {_P})) where score is not null order by 3 desc, 2 limit 60)
    union all select 'machine', product_id, {_score_sql('m', ['filter'])} from (select product_id, {_SEARCH.format("concat_ws(' ', brand_name, series, model_code, brewer)")} m from product) where {_score_sql('m', ['filter'])} is not null""")
def idx6_ranked_search(t: Tables) -> DataFrame:
    """The best 60 of each of seven lists; faults of one message count once, before the limit; machines are not limited."""
    words, key = ["filter"], lambda *c: X.search_key(F.concat_ws(" ", *c))
    faults = t("topic").filter("kind = 'fault' and title is not null").select("topic_id", "title", X.substring_score(key("title", "scope"), words).alias("score")).filter("score is not null")
    faults = faults.groupBy("title").agg(F.min("topic_id").alias("ref"), F.max("score").alias("score")).select("ref", "score").orderBy(F.desc("score"), "ref").limit(60)
    body = t("topic_text").groupBy("topic_id").agg(F.min("text").alias("body"))
    topics = t("topic").join(body, "topic_id", "left").select("topic_id", "kind", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"))
    lists = {"fault": faults}
    for kind in ("procedure", "component", "menu", "view"):
        lists[kind] = S.ranked(topics.filter(F.col("kind") == kind), "filter", key="topic_id", title="title", body="body")
    parts = t("part_row").select("part_id", "part_nr", "description", "section").distinct()
    lists["part"] = S.numbers_first(parts, "filter", key="part_id", number="part_nr", text=F.concat_ws(" ", "description", "section"), limit=60)
    machines = t("product").select(F.col("product_id").alias("ref"), X.substring_score(key("brand_name", "series", "model_code", "brewer"), words).alias("score"))
    lists["machine"] = machines.filter("score is not null")
    out = None
    for name, rows in lists.items():
        one = rows.select(F.lit(name).alias("list"), "ref", "score")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"select * from ({_PARTS_SQL.replace(_P, _P.replace('from part_row', 'from part_row where lower(trim(product_id)) = ' + chr(39) + 'mondil.nzl' + chr(39)))}) where score is not null order by 2 desc, 1 limit 120")
def idx7_parts_of_build(t: Tables) -> DataFrame:
    """Parts of one build, numbers before descriptions."""
    rows = t("part_row").filter(F.lower(F.trim("product_id")) == "mondil.nzl").select("part_id", "part_nr", "description", "section").distinct()
    return S.numbers_first(rows, "lekbak", key="part_id", number="part_nr", text=F.concat_ws(" ", "description", "section"))


@query(f"select 'topic' src, topic_id ref, {_SEARCH.format('title')} k from topic union all select distinct 'part', part_id, {_SEARCH.format('description')} from part_row union all select 'product', product_id, {_SEARCH.format("concat_ws(' ', product_name, series)")} from product")
def idx8_search_keys(t: Tables) -> DataFrame:
    """What is searchable of each collection, normalised once."""
    a = t("topic").select(F.lit("topic").alias("src"), F.col("topic_id").alias("ref"), X.search_key(F.col("title")).alias("k"))
    b = t("part_row").select(F.lit("part").alias("src"), F.col("part_id").alias("ref"), X.search_key(F.col("description")).alias("k")).distinct()
    return a.unionAll(b).unionAll(t("product").select(F.lit("product").alias("src"), F.col("product_id").alias("ref"), X.search_key(F.concat_ws(" ", "product_name", "series")).alias("k")))


@query("""select part_nr, part_id from (select part_nr, part_id, row_number() over (partition by part_nr order by cast(substr(part_id, 2) as bigint)) k from part_row where part_nr is not null) where k = 1""")
def idx9_first_in_order(t: Tables) -> DataFrame:
    rows = t("part_row").filter("part_nr is not null").select("part_nr", "part_id", F.substring("part_id", 2, 20).cast("bigint").alias("n"))
    return first_by(rows, ["part_nr"], [F.col("n")]).select("part_nr", "part_id")


@query("select drawing, min(section_title) title, count(distinct part_id) n from part_row where lower(trim(product_id)) = 'mondil.nzl' and section = '25' and drawing is not null group by 1")
def idx10_composite_lookup(t: Tables) -> DataFrame:
    """Drawings by (product, section), with their names."""
    rows = t("part_row").filter((F.lower(F.trim("product_id")) == "mondil.nzl") & (F.col("section") == "25") & F.col("drawing").isNotNull())
    return rows.groupBy("drawing").agg(F.min("section_title").alias("title"), F.countDistinct("part_id").alias("n"))


@query("select topic_id ref, 0 score from topic where false")
def flt19_shortest_query(t: Tables) -> DataFrame:
    """A query of one letter finds nothing."""
    return S.ranked(t("topic"), " f ", key="topic_id", title="title")


@query(f"""with r as (select topic_id ref, {_SEARCH.format('title')} t from topic where title is not null) select ref, {_score_sql('t', ['water', 'filter'])} * 3 score from r where {_score_sql('t', ['water', 'filter'])} is not null order by 2 desc, 1 limit 60""")
def srt10_best_sixty(t: Tables) -> DataFrame:
    return S.ranked(t("topic").filter("title is not null"), "Wäter filter", key="topic_id", title="title")


@query(f"select topic_id, list_filter(string_split({_SEARCH.format('title')}, ' '), lambda x: x <> '') terms from topic where title is not null")
def str36_terms(t: Tables) -> DataFrame:
    return t("topic").filter("title is not null").select("topic_id", F.filter(F.split(X.search_key(F.col("title")), " "), lambda x: x != "").alias("terms"))


# Scans


@query("select distinct part_id, translate(upper(description), 'OQDIL|SBZG-. ', '0001115826') k from part_row where description is not null")
def str38_folded_text(t: Tables) -> DataFrame:
    return t("part_row").filter("description is not null").select("part_id", X.ocr_key(F.col("description")).alias("k")).distinct()


@query("select doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(upper(replace(text, 'ß', 'SS')), '[0-9A-Z][0-9A-Z.-]{3,18}'), lambda x: length(x) >= 5))) tokens from documents where text is not null")
def str39_number_tokens(t: Tables) -> DataFrame:
    return t("documents").filter("text is not null").select("doc_id", F.array_sort(Z.number_tokens(F.col("text"))).alias("tokens"))


_STOP = ", ".join(f"'{w}'" for w in Z.STOP)


@query(f"select doc_id, list_sort(list_distinct(list_filter(string_split({_PLAIN.format('text')}, ' '), lambda x: length(x) >= 4 and x not in ({_STOP})))) words from documents where text is not null")
def str40_telling_words(t: Tables) -> DataFrame:
    return t("documents").filter("text is not null").select("doc_id", F.array_sort(Z.long_words(X.plain_key(F.col("text")), Z.STOP)).alias("words"))


_FOLDED = "translate(upper({}), 'OQDIL|SBZG-. ', '0001115826')"


@query(f"""with l as (select distinct part_id frame, translate(upper(part_nr), '01', 'OI') line from part_row where part_nr is not null), p as (select distinct part_nr, split_part(lower(trim(product_id)), '.', 1) machine, cast(substr(part_id, 2) as bigint) ord, {_FOLDED.format('part_nr')} k from part_row where part_nr <> ''),
    b as (select k, arg_min(part_nr, struct_pack(o := coalesce(machine <> 'orvo', true), n := ord, p := part_nr)) part_nr, list(upper(part_nr)) every from p group by 1), t as (select distinct frame, unnest(list_filter(regexp_extract_all(line, '[0-9A-Z][0-9A-Z.-]{{3,18}}'), lambda x: length(x) >= 5)) token from l)
    select frame, token, b.part_nr, case when list_contains(every, token) then 100 else 80 end confidence from t join b on {_FOLDED.format('token')} = b.k""")
def fzy1_scanned_numbers(t: Tables) -> DataFrame:
    """Numbers misread as letters still meet their part, that of the machine in front of the camera first."""
    lines = t("part_row").filter("part_nr is not null").select(F.col("part_id").alias("frame"), F.translate(F.upper("part_nr"), "01", "OI").alias("line")).distinct()
    parts = t("part_row").select("part_nr", F.substring_index(F.lower(F.trim("product_id")), ".", 1).alias("machine"), F.substring("part_id", 2, 20).cast("bigint").alias("ord"))
    return Z.scan_numbers(lines, parts, machine="orvo")


def frames(t: Tables) -> DataFrame:
    return t("topic_text").filter("text is not null").select(F.col("text_id").alias("frame"), "text").dropDuplicates(["frame"])


def phrases(t: Tables) -> DataFrame:
    return t("topic").filter("kind = 'fault' and title is not null").select(F.col("title").alias("phrase"))


_FRAMES = f"(select distinct text_id frame, {_PLAIN.format('text')} x from topic_text where text is not null)"
_MESSAGES = f"(select distinct title phrase, {_PLAIN.format('title')} k from topic where kind = 'fault' and length({_PLAIN.format('title')}) >= 6)"


@query(f"select frame, phrase, 98 confidence from {_FRAMES} join {_MESSAGES} on contains(x, k)")
def fzy2_printed_phrases(t: Tables) -> DataFrame:
    """Titles that stand in a text as they are."""
    return Z.scan_phrases(frames(t), phrases(t), least=98).withColumn("confidence", F.col("confidence").cast("int"))


@query()
def fzy3_scanned_phrases(t: Tables) -> DataFrame:
    """Titles of faults in texts as frames, best eight a frame."""
    return Z.best_hits(Z.scan_phrases(frames(t), phrases(t)), key="phrase", least=75)


@query(f"""with k as (select topic_id, {_PLAIN.format('title')} x from topic where title is not null), p as (select topic_id, x, unnest(range(0, length(x) + 1)) b from k), s as (select topic_id, substr(x, b + 1, n) y from (select *, unnest(range(0, 25)) n from p))
    select topic_id, cast(min(levenshtein('water filter', y)) as int) distance from s group by 1""")
def fzy3_occurrence_distance(t: Tables) -> DataFrame:
    """The least edit distance of a phrase to any stretch of a title."""
    return t("topic").filter("title is not null").select("topic_id", Z.occurrence_distance_udf(F.lit("water filter"), X.plain_key(F.col("title"))).alias("distance"))


_NEAR = "({0} = {1} or (abs(length({0}) - length({1})) <= 2 and levenshtein({0}, {1}) <= case when length({0}) >= 9 then 2 when length({0}) >= 6 then 1 else 0 end))"


@query(f"""with s as (select frame, list_distinct(list_filter(string_split(x, ' '), lambda w: length(w) >= 4)) seen from {_FRAMES}), f as (select frame, unnest(seen) seen from s),
    m as (select phrase, list_distinct(list_filter(string_split(k, ' '), lambda w: length(w) >= 4 and w not in ({_STOP}))) words from {_MESSAGES}), p as (select phrase, len(words) n, unnest(words) word from m where len(words) >= 4),
    c as (select w.word, v.seen from (select distinct word from p) w join (select distinct seen from f) v on {_NEAR.format('w.word', 'v.seen')}), h as (select frame, phrase, n, count(distinct word) hits from f join c using (seen) join p using (word) group by all)
    select frame, phrase from h where hits * 100 / n >= 80""")
def fzy4_bags_of_words(t: Tables) -> DataFrame:
    """Titles of four or more telling words of which four fifths are nearly in a text, however many words it has."""
    seen = frames(t).select("frame", Z.long_words(X.plain_key(F.col("text"))).alias("seen"))
    return Z.bag_hits(seen, phrases(t).distinct().select("phrase", Z.long_words(X.plain_key(F.col("phrase")), Z.STOP).alias("words")))


@query(f"""with w as (select distinct unnest(string_split({_SEARCH.format('title')}, ' ')) w from topic where title is not null) select a.w a, b.w b from w a join w b on a.w < b.w and length(a.w) >= 5 and length(b.w) >= 5 and {_NEAR.format('a.w', 'b.w')}""")
def fzy5_near_words(t: Tables) -> DataFrame:
    """Near words of all titles."""
    w = t("topic").filter("title is not null").select(F.explode(F.split(X.search_key(F.col("title")), " ")).alias("word")).filter("length(word) >= 5").distinct()
    pairs = Z.near_words(w, w.withColumnRenamed("word", "seen"))
    return pairs.filter("word < seen").select(F.col("word").alias("a"), F.col("seen").alias("b"))


@query(f"""with h as (select frame, phrase, 98 c from {_FRAMES} join {_MESSAGES} on contains(x, k)), r as (select *, row_number() over (partition by frame order by c desc, phrase) rank from h) select frame, phrase, c confidence, rank from r where rank <= 8""")
def fzy6_best_hits(t: Tables) -> DataFrame:
    """Sure hits only, best eight a frame, each message once."""
    rows = Z.best_hits(Z.scan_phrases(frames(t), phrases(t), least=98), key="phrase", least=98)
    return rows.select("frame", "phrase", F.col("confidence").cast("int").alias("confidence"), F.col("rank").cast("bigint").alias("rank"))


@query(f"select frame, phrase, 100 * length(phrase) confidence from (select frame, phrase, row_number() over (partition by frame order by length(phrase) desc, phrase) k from {_FRAMES} join {_MESSAGES} on contains(x, k)) where k <= 8")
def srt12_top_eight(t: Tables) -> DataFrame:
    """The eight best of a frame by confidence, here the length of what was read."""
    hits = Z.scan_phrases(frames(t), phrases(t), least=98).select("frame", "phrase", (100 * F.length("phrase")).alias("confidence"))
    return Z.best_hits(hits, key="phrase", least=0).select("frame", "phrase", "confidence")


@query(f"select distinct frame, phrase from {_FRAMES} join {_MESSAGES} on contains(x, k)")
def agg28_distinct_hits(t: Tables) -> DataFrame:
    """Of several deliveries of a frame each message once."""
    twice = frames(t).unionAll(frames(t))
    return Z.best_hits(Z.scan_phrases(twice, phrases(t), least=98), key="phrase", least=98, limit=1 << 30).select("frame", "phrase")


@query(f"select phrase, count(*) frames from {_FRAMES} join {_MESSAGES} on contains(x, k) group by 1")
def jn27_frames_and_messages(t: Tables) -> DataFrame:
    """Frames joined with messages by what they hold, without meeting each other in pairs."""
    return Z.scan_phrases(frames(t), phrases(t), least=98).groupBy("phrase").agg(F.count("*").alias("frames"))


# Plates


def plate_frames(t: Tables) -> DataFrame:
    """Lines as they stand on plates, from parts and their products: some without a serial, a code, or anything."""
    n = F.substring("part_id", 2, 20).cast("bigint")
    p = t("part_row").filter("part_nr is not null").select("part_id", "part_nr", F.lower(F.trim("product_id")).alias("product_id")).distinct()
    p = p.join(t("product").select("product_id", "model_code", "product_name"), "product_id")
    lines = F.array(
        F.when(n % 2 == 0, F.concat(F.lit("9"), "model_code", "part_nr")).otherwise("label"), F.when(n % 3 == 0, F.concat(F.lit("no "), F.expr("cast(2014386812000 + part_n % 1000 as string)"))).when(n % 3 == 1, F.lit("nr 1234567")).otherwise("-"),
        F.when(n % 5 == 0, F.concat(F.lit("Model: "), "product_name")).when(n % 5 == 1, F.lit("Serial nr")).otherwise(F.concat("product_name", F.lit(" 2"))),
    )
    return p.withColumn("part_n", n).select(F.col("part_id").alias("frame"), lines.alias("lines"))


def _dimension(t: Tables) -> tuple[list, list]:
    """Builds with their machine, and the words that name machines: product is a dimension of some hundred rows."""
    rows = t("product").select("model_code", "brand", "brand_name", "product_id").filter("model_code is not null").orderBy("product_id").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10000 products: plates are read by rules made of them")
    builds = {r.model_code.upper(): r.brand for r in reversed(rows)}
    return list(builds.items()), list({r.brand_name.upper(): r.brand for r in rows if r.brand_name}.items())


_PLATE = """with p as (select distinct part_id frame, cast(substr(part_id, 2) as bigint) n, part_nr, model_code, product_name, brand from part_row r join product d on d.product_id = lower(trim(r.product_id)) where part_nr is not null),
    f as (select *, n % 2 = 0 and length(model_code) >= 3 and length(part_nr) >= 3 coded, n % 3 = 0 strict, n % 5 = 1 hinted from p)"""


@query(f"""{_PLATE} select frame, coded or strict or hinted is_plate, case when coded or strict or hinted then case when coded then model_code else '' end end build, case when coded or strict or hinted then case when coded then '9' || model_code || part_nr else '' end end code,
    case when coded or strict or hinted then case when strict then cast(2014386812000 + n % 1000 as varchar) when n % 3 = 1 then '1234567' else '' end end serial from f""")
def fzy7_plates(t: Tables) -> DataFrame:
    """What each frame reads off a plate: nothing to be seen, a plate without a field, or its fields."""
    rows = P.read_plates(plate_frames(t), _dimension(t)[0])
    return rows.select("frame", F.col("plate").isNotNull().alias("is_plate"), *[F.col(f"plate.{c}").alias(c) for c in ("build", "code", "serial")])


@query(f"{_PLATE} select frame, hinted is_plate from f")
def fzy8_looks_like_plate(t: Tables) -> DataFrame:
    return plate_frames(t).select("frame", P.looks_like_plate(F.upper(F.array_join("lines", " "))).alias("is_plate"))


@query(f"{_PLATE} select frame, case when n % 5 = 0 then product_name when n % 5 = 1 then '' else product_name || ' 2' end model from f")
def fzy9_model_lines(t: Tables) -> DataFrame:
    machines = _dimension(t)[1]
    return plate_frames(t).select("frame", P.model_line(F.col("lines"), machines).alias("model"))


@query(f"{_PLATE} select frame, case when strict then cast(2014386812000 + n % 1000 as varchar) when n % 3 = 1 and n % 2 = 0 then '1234567' end serial, case when strict then '2014 · week 38' end built from f")
def fzy10_serial_numbers(t: Tables) -> DataFrame:
    """A bare run of digits is a serial only where the frame shows a type code."""
    upper = F.upper(F.array_join("lines", " "))
    rows = plate_frames(t).select("frame", P.serial_number(upper, P.type_code(upper, [b for b, _ in _dimension(t)[0]]).isNotNull()).alias("serial"))
    return rows.select("frame", "serial", F.nullif(X.built(F.col("serial")), F.lit("")).alias("built"))


@query(f"{_PLATE} select frame, case when n % 5 <> 1 then brand end machine from f")
def fzy11_named_machines(t: Tables) -> DataFrame:
    machines = _dimension(t)[1]
    return plate_frames(t).select("frame", P.named_machine(F.upper(F.array_join("lines", " ")), machines).alias("machine"))


@query(f"""{_PLATE}, a as (select n // 2 g, min(case when coded then '9' || model_code || part_nr end) code, min(case when strict then cast(2014386812000 + n % 1000 as varchar) when n % 3 = 1 and (coded or hinted) then '1234567' end) serial, bool_or(coded or strict or hinted) seen, count(*) c from f group by 1)
    select g, coalesce(code, '') code, case when c = 1 then coalesce(serial, '') end serial from a where seen and c = 1""")
def fzy12_merged_plates(t: Tables) -> DataFrame:
    """Plates of single frames merged with an empty one: field by field what is known stays."""
    rows = P.read_plates(plate_frames(t), _dimension(t)[0]).select((F.substring("frame", 2, 20).cast("bigint") / 2).cast("bigint").alias("g"), "plate").filter("plate is not null")
    alone = plate_frames(t).select((F.substring("frame", 2, 20).cast("bigint") / 2).cast("bigint").alias("g")).groupBy("g").agg(F.count("*").alias("c")).filter("c = 1")
    none = F.struct(*[F.lit("").alias(c) for c in ("machine", "build", "code", "serial", "built", "model")])
    merged = rows.join(alone, "g").select("g", P.merge_plates(none, F.col("plate")).alias("m"))
    return merged.select("g", "m.code", "m.serial")


@query(f"{_PLATE} select frame, case when coded then '9' || model_code || part_nr end code from f")
def str44_type_codes(t: Tables) -> DataFrame:
    upper = F.upper(F.array_join("lines", " "))
    return plate_frames(t).select("frame", P.type_code(upper, [b for b, _ in _dimension(t)[0]])["code"].alias("code"))


@query("select row_number() over (order by length(b) desc, b) as rank, b from (select distinct upper(model_code) b from product where length(model_code) >= 3)")
def srt15_builds_longest_first(t: Tables) -> DataFrame:
    """The order in which builds are tried."""
    order = P.by_length([b for b, _ in _dimension(t)[0]])
    return t("product").sparkSession.createDataFrame([(i + 1, b) for i, b in enumerate(order)], "rank bigint, b string")


# Streams, folded over stored frames


def sighted(t: Tables) -> DataFrame:
    """Events as hits of sessions."""
    return t("events").select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), (60 + F.col("event_id") % 40).cast("int").alias("confidence"), "event_id")


def _sighting_sql(then: str, *, scale: int = 1, live: int = 0, tap: str = "false") -> str:
    """The fold in SQL: a hit's count starts over where the session's frame before it lies more than eight seconds after
    the hit's last sighting; at each frame the hits of the last eight seconds are shown, if they are repeated or sure."""
    return f"""with e as (select cast(user_id as varchar) session, ts whn, epoch_us(ts) / {scale} t, event_type key, 60 + event_id % 40 c, event_id, {tap} tap from events),
    g as (select *, sum(tap::int) over (partition by session order by t, tap, event_id rows unbounded preceding) seg from e), l as (select * from g where not tap),
    f as (select *, lag(t) over (partition by session, seg order by t) pf from (select session, seg, t, min(whn) whn from l group by all)),
    h as (select session, seg, t, key, max(c) c from l where c >= {live} group by all), p as (select h.*, f.pf, lag(h.t) over w t1, lead(h.t) over w nx from h join f using (session, seg, t) window w as (partition by session, seg, key order by h.t)),
    i as (select *, sum((t1 is null or coalesce(pf - t1 > 8000000, false))::int) over (partition by session, seg, key order by t rows unbounded preceding) i from p),
    s as (select *, row_number() over w times, max(c) over w best from i window w as (partition by session, seg, key, i order by t rows unbounded preceding)),
    v as (select f.session, f.seg, f.t, f.whn, s.key, s.times, s.best from f join s on f.session = s.session and f.seg = s.seg and f.t >= s.t and (s.nx is null or f.t < s.nx) and f.t - s.t <= 8000000 where s.times >= 2 or s.best >= 92),
    r as (select *, row_number() over (partition by session, seg, t order by best desc, key) k from v), b as (select session, seg, t, list(struct_pack(key := key, times := times, best := best) order by k) shown from r where k <= 8 group by 1, 2, 3),
    c as (select f.*, coalesce(shown, []) shown, coalesce(lag(shown) over (partition by f.session, f.seg order by f.t), []) before from f left join b on b.session = f.session and b.seg = f.seg and b.t = f.t),
    o as (select session, seg, t, whn, len(shown) n, unnest(shown, recursive := true) from (select * from c where shown <> before) where len(shown) > 0)
    {then}"""


@query(_sighting_sql("select session, whn as ts, key, cast(times as int) times, cast(best as int) confidence from o"))
def stm2_sightings(t: Tables) -> DataFrame:
    """Hits seen twice, or surely, within eight seconds of frames of a session."""
    return fold_sightings(sighted(t).drop("event_id")).select("session", "ts", "key", "times", "confidence")


def _near_frames(t: Tables) -> DataFrame:
    """The events of a session half a minute's worth apart, so that hits meet their time to live."""
    e = sighted(t)
    return e.withColumn("ts", F.timestamp_seconds(F.col("ts").cast("double") / 2_000))


@query(_sighting_sql("select session, count(*) as rows, cast(max(times) as int) most from o group by 1", scale=2_000))
def stm3_time_to_live(t: Tables) -> DataFrame:
    return fold_sightings(_near_frames(t).drop("event_id")).groupBy("session").agg(F.count("*").alias("rows"), F.max("times").alias("most"))


@query(_sighting_sql("select session, key, count(*) as told, cast(max(best) as int) confidence from o group by 1, 2", scale=2_000, live=75))
def stm4_shown_when_changed(t: Tables) -> DataFrame:
    """Sure or repeated hits, best eight, told only when they change."""
    return fold_sightings(_near_frames(t).drop("event_id"), live=75).groupBy("session", "key").agg(F.count("*").alias("told"), F.max("confidence").alias("confidence"))


@query()
def stm5_photo_hold(t: Tables) -> DataFrame:
    """Purchases as photos: their hits stay twenty seconds, and until a frame has its own."""
    kind = F.when(F.col("key") == "purchase", "photo").otherwise("live")
    return fold_sightings(_near_frames(t).withColumn("kind", kind).drop("event_id"), live=75, photo=60).select("session", "ts", "key", "times", "confidence")


@query(_sighting_sql("select session, arg_min(key, t) key from o where n = 1 and best >= 92 group by 1", scale=2_000, live=75))
def stm6_opened_once(t: Tables) -> DataFrame:
    """The first sure hit of a session that is shown alone."""
    return fold_sightings(_near_frames(t).drop("event_id"), live=75).filter("opens").select("session", "key")


@query()
def stm7_late_table(t: Tables) -> DataFrame:
    """Photos that found nothing are read again when the table arrives."""
    kind = F.when(F.col("key") == "purchase", "photo").when(F.col("key") == "click", "again").otherwise("live")
    rows = _near_frames(t).withColumn("kind", kind).withColumn("key", F.when(F.col("kind") != "photo", F.col("key")))
    return fold_sightings(rows.drop("event_id"), live=75, photo=60).select("session", "ts", "key", "times", "confidence")


@query(_sighting_sql("select session, key, count(*) as told, cast(max(best) as int) confidence from o group by 1, 2", scale=2_000, live=75, tap="event_type = 'purchase'"))
def stm11_reset(t: Tables) -> DataFrame:
    """Purchases as taps, which clear what is known."""
    kind = F.when(F.col("key") == "purchase", "tap").otherwise("live")
    return fold_sightings(_near_frames(t).withColumn("kind", kind).drop("event_id"), live=75).groupBy("session", "key").agg(F.count("*").alias("told"), F.max("confidence").alias("confidence"))


@query(_sighting_sql("select session, whn as ts, key, cast(times as int) times, cast(best as int) confidence from o"))
def stm2_sightings_stream(t: Tables) -> DataFrame:
    """The same fold as a stream with kept state, over frames stored in files by time."""
    spark, at = t("events").sparkSession, scratch(t("events").sparkSession)
    schema = "session string, ts timestamp, key string, confidence int"
    write_json(sighted(t).drop("event_id").repartitionByRange(4, "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), f"{at}/in")
    run = stream_sightings(frame_stream(spark, f"{at}/in", schema, files=1_000)).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{at}/out").select("session", "ts", "key", "times", "confidence")


def _plates(t: Tables) -> DataFrame:
    """Events as frames of plates: searches show none."""
    e = sighted(t)
    plate = F.col("key") != "view"
    return e.select("session", F.timestamp_seconds(F.col("ts").cast("double") / 200).alias("ts"), plate.alias("is_plate"), F.when(plate & (F.col("event_id") % 2 == 0), F.col("key")).alias("code"), F.when(plate & (F.col("event_id") % 3 == 0), F.col("event_id").cast("string")).alias("serial"))


_PLATE_FOLD = """with e as (select cast(user_id as varchar) session, epoch_us(ts) / 200 t, event_type <> 'view' p, case when event_type <> 'view' and event_id % 2 = 0 then event_type end code, case when event_type <> 'view' and event_id % 3 = 0 then cast(event_id as varchar) end serial from events),
    o as (select *, row_number() over (partition by session order by t, p desc, code nulls first, serial nulls first) n from e),
    s as (select *, last_value(case when p then t end ignore nulls) over w seen, last_value(case when not p then t end ignore nulls) over w gone from o window w as (partition by session order by n rows between unbounded preceding and 1 preceding)),
    f as (select *, p and (seen is null or coalesce(gone - seen > 30000000, false)) fresh from s), g as (select *, sum(fresh::int) over (partition by session order by n rows unbounded preceding) e from f),
    k as (select *, last_value(code ignore nulls) over (partition by session, e order by n rows between unbounded preceding and 1 preceding) known from g where p),
    m as (select *, sum((fresh or coalesce(code <> known, false))::int) over (partition by session order by n rows unbounded preceding) plate from k)"""


@query(f"""{_PLATE_FOLD} select * from (select session, cast(plate as bigint) plate, arg_min(code, n) filter (where code is not null) code, arg_min(serial, n) filter (where serial is not null) serial from m group by 1, 2) where coalesce(code, serial) is not null""")
def stm8_plates(t: Tables) -> DataFrame:
    """Plates gathered over frames, another code beginning a new one."""
    return fold_plates(_plates(t)).select("session", "plate", "code", "serial")


@query(f"{_PLATE_FOLD} select session, count(distinct e) plates from k group by 1")
def stm9_plates_that_ended(t: Tables) -> DataFrame:
    """Stretches of a session between frames without a plate for over thirty seconds."""
    once = _plates(t).withColumn("code", F.when(F.col("is_plate"), F.lit("any"))).withColumn("serial", F.lit(None).cast("string"))
    return fold_plates(once).groupBy("session").agg(F.count("*").alias("plates"))
