"""Full-text search: postings, BM25 and ranked substring search."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import search_key, substring_score, terms, tokens

#: Weights of the columns: those that the reference's index has in effect, and those that were meant.
EFFECTIVE, INTENDED = {"title": 0.0, "body": 8.0}, {"title": 8.0, "body": 1.0}


def postings(rows: DataFrame, *, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows (key, column, term, tf) of the tokens without case and accents."""
    out = None
    for c in columns:
        words = tokens(F.col(c))
        one = rows.select(*key, F.lit(c).alias("column"), F.explode(words).alias("term")).groupBy(*key, "column", "term").agg(F.count("*").alias("tf"))
        out = one if out is None else out.unionAll(one)
    return out


def bm25(rows: DataFrame, query: str, *, key: str, columns: Sequence[str] = ("title", "body"), weights: dict[str, float] | None = None, limit: int | None = 25) -> DataFrame:
    """Rows that hold a token with each prefix of query, by BM25 (smaller is better, as the reference ranks), ties by key.

    Counts each row once in a scan without a join: lengths and matches of a prefix are sums over its tokens. A query
    that is empty or has a quotation mark finds nothing."""
    weights = EFFECTIVE if weights is None else weights
    prefixes = tokens_of(query) if '"' not in query else []
    spark = rows.sparkSession
    if not prefixes:
        return spark.createDataFrame([], "ref string, score double")
    of = {c: tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns}
    length = reduce(lambda a, b: a + b, [F.size(t) for t in of.values()])

    def hits(c: str, p: str) -> Column:
        return F.size(F.filter(of[c], lambda x: x.startswith(p)))

    counted = rows.select(
        F.col(key).cast("string").alias("ref"), length.alias("_d"),
        *[reduce(lambda a, b: a + b, [hits(c, p) for c in columns]).alias(f"_n{i}") for i, p in enumerate(prefixes)],
        *[reduce(lambda a, b: a + b, [hits(c, p) * F.lit(float(weights.get(c, 0.0))) for c in columns]).alias(f"_f{i}") for i, p in enumerate(prefixes)],
    )
    totals = counted.agg(F.count("*").alias("_rows"), F.avg("_d").alias("_avg"), *[F.count_if(F.col(f"_n{i}") > 0).alias(f"_df{i}") for i in range(len(prefixes))])
    found = counted.filter(reduce(lambda a, b: a & b, [F.col(f"_n{i}") > 0 for i in range(len(prefixes))])).crossJoin(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        idf = F.log((F.col("_rows") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = F.col(f"_f{i}")
        score = score - idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("_d") / F.col("_avg")))
    out = found.select("ref", F.round(score, 6).alias("score"))
    return out if limit is None else out.orderBy("score", "ref").limit(limit)


def search_key_of(text: str) -> str:
    """search_key of a Python string."""
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]+", " ", folded).strip()


def tokens_of(text: str) -> list[str]:
    """tokens of a Python string."""
    kept = []
    for c in text:
        d = unicodedata.normalize("NFD", c)
        kept.append(d[0] if d[0].isascii() else "" if unicodedata.category(c) == "Mn" else c)
    return re.findall(r"[^\W_]+", "".join(kept).lower())


def ranked(rows: DataFrame, query: str, *, key: str, title: str, body: str | None = None, least: int = 2, limit: int = 60) -> DataFrame:
    """The best rows by substring score: three times the title's, or the body's; ties by key. Shorter queries find nothing."""
    words = terms(search_key_of(query))
    if len(search_key_of(query)) < least:
        return rows.sparkSession.createDataFrame([], "ref string, score bigint")
    score = substring_score(search_key(F.col(title)), words) * 3
    if body:
        score = F.greatest(score, substring_score(search_key(F.col(body)), words))
    return rows.select(F.col(key).cast("string").alias("ref"), score.alias("score")).filter("score is not null").orderBy(F.desc("score"), "ref").limit(limit)


@pandas_udf(T.StringType())
def snippet_udf(texts: pd.Series, prefixes: pd.Series, width: pd.Series) -> pd.Series:
    """The `width` words of a text that hold the most words with one of the prefixes (split by blanks), those in brackets, an
    ellipsis where the text goes on. Null for null."""
    out = []
    for text, wanted, n in zip(texts, prefixes, width):
        if text is None:
            out.append(None)
            continue
        starts = tuple(wanted.split(" "))
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
        hits = [any(w.startswith(starts) for w in tokens_of(text[b:e])) for b, e in spans]
        sums = np.concatenate([[0], np.cumsum(hits)])
        size = min(int(n), len(spans))
        first = int(np.argmax(sums[size:] - sums[: len(sums) - size])) if size else 0
        shown, at = [], spans[first][0] if spans else 0
        for k in range(first, first + size):
            b, e = spans[k]
            shown.append(text[at:b] + (f"[{text[b:e]}]" if hits[k] else text[b:e]))
            at = e
        out.append(("…" if first else "") + "".join(shown) + ("…" if first + size < len(spans) else ""))
    return pd.Series(out, dtype=object)


def search(rows: DataFrame, query: str, *, key: str = "ref", kinds: Sequence[str] = (), lang: str | None = None, weights: dict[str, float] | None = None, limit: int = 25, width: int = 12) -> DataFrame:
    """Rows (key, kind, lang, title, body) by BM25 over all of them, of the kinds and language asked for, with a snippet of
    the body: (ref, kind, lang, title, score, snippet)."""
    found = bm25(rows, query, key=key, weights=weights, limit=None)
    out = rows.withColumn("ref", F.col(key).cast("string")).join(found, "ref")
    out = out.filter(F.col("kind").isin(*kinds)) if kinds else out
    out = out.filter(F.col("lang") == lang) if lang else out
    best = out.select("ref", "kind", "lang", "title", "score", "body").orderBy("score", "ref").limit(limit)
    return best.select("ref", "kind", "lang", "title", "score", snippet_udf("body", F.lit(" ".join(tokens_of(query)) or "\0"), F.lit(width)).alias("snippet"))


def indexed_search(terms_: DataFrame, sizes: DataFrame, query: str, *, weights: dict[str, float] | None = None, limit: int = 25) -> DataFrame:
    """bm25 from an index: terms_ are postings (ref, column, term, tf), sizes (ref, tokens) the tokens of each row.

    Only postings that begin with a prefix of the query are read, as a range of the sorted term."""
    weights = EFFECTIVE if weights is None else weights
    prefixes = tokens_of(query) if '"' not in query else []
    if not prefixes:
        return terms_.sparkSession.createDataFrame([], "ref string, score double")
    totals = sizes.agg(F.count("*").alias("_rows"), F.avg("tokens").alias("_avg"))
    weight = reduce(lambda rest, kv: F.when(F.col("column") == kv[0], float(kv[1])).otherwise(rest), weights.items(), F.lit(0.0))
    held = reduce(lambda a, b: a | b, [F.startswith(F.col("term"), F.lit(p)) for p in prefixes])
    sums = [F.sum(F.when(F.startswith(F.col("term"), F.lit(p)), F.col("tf") * weight)).alias(f"_f{i}") for i, p in enumerate(prefixes)]
    by_row = terms_.filter(held).groupBy("ref").agg(*sums)
    found = by_row.agg(*[F.count(f"_f{i}").alias(f"_df{i}") for i in range(len(prefixes))])
    rows = by_row.filter(reduce(lambda a, b: a & b, [F.col(f"_f{i}").isNotNull() for i in range(len(prefixes))])).join(sizes, "ref")
    rows = rows.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(found))  # one row each
    score = F.lit(0.0)
    for i in range(len(prefixes)):
        idf = F.log((F.col("_rows") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        f = F.col(f"_f{i}")
        score = score - F.when(idf <= 0, 1e-6).otherwise(idf) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * F.col("tokens") / F.col("_avg")))
    return rows.select(F.col("ref").cast("string").alias("ref"), F.round(score, 6).alias("score")).orderBy("score", "ref").limit(limit)


def numbers_first(rows: DataFrame, query: str, *, key: str, number: str, text: Column, least: int = 2, limit: int = 120) -> DataFrame:
    """The best rows by their number, which counts a hundred more, or else by their text; shorter queries find nothing."""
    words = terms(search_key_of(query))
    if len(search_key_of(query)) < least:
        return rows.sparkSession.createDataFrame([], "ref string, score bigint")
    score = F.coalesce(substring_score(search_key(F.col(number)), words) + 100, substring_score(search_key(text), words))
    return rows.select(F.col(key).cast("string").alias("ref"), score.alias("score")).filter("score is not null").orderBy(F.desc("score"), "ref").limit(limit)
