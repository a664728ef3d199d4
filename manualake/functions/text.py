"""Scalar functions on text, as column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def _accents() -> tuple[str, str]:
    """Precomposed letters and their ASCII base letters, by rule."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def fold_accents(c: Column) -> Column:
    """Latin letters without accents; combining marks go. Letters that do not decompose stay."""
    return F.regexp_replace(F.translate(c, *_accents()), "\\p{Mn}+", "")


@pandas_udf(T.StringType())
def compatible(c: pd.Series) -> pd.Series:
    """Compatibility decomposition (NFKD) without combining marks; null stays null."""
    return c.map(lambda x: "".join(d for d in unicodedata.normalize("NFKD", x) if not unicodedata.combining(d)), na_action="ignore")


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column, sep: str = "-") -> Column:
    """Lower-case runs of ASCII letters and digits, joined by sep."""
    return F.regexp_replace(F.regexp_replace(F.lower(compatible(c)), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")


def composite_slug(*cols: Column, sep: str = "-") -> Column:
    """Slugs of the parts that are not empty."""
    return F.concat_ws(sep, *[F.nullif(slug(c, sep), F.lit("")) for c in cols])


def search_key(c: Column) -> Column:
    """For search: lower case, no accents, other characters as single blanks."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """For full-text search: runs of letters and digits of any script, in lower case, no accents."""
    return F.filter(F.split(F.lower(fold_accents(c)), r"[^\p{L}\p{N}\p{Co}]+"), lambda x: x != "")


def plain_key(c: Column) -> Column:
    """As search_key, but letters with accents become blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def match_key(c: Column) -> Column:
    """Lower case without anything but letters, digits and underscores; combining marks are neither."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def ocr_key(c: Column) -> Column:
    """Characters that a reader confuses become one; separators go."""
    return F.translate(F.upper(c), "OQDIL|SBZG-. ", "0001115826")


def margin_key(c: Column) -> Column:
    """Digits as #, white space collapsed: equal for running headers and footers of all pages."""
    return collapse(F.regexp_replace(c, "[0-9]", "#"))


def clean(c: Column, conjunctions: Sequence[str] = ("and", "or", "en", "of", "und", "oder", "et", "ou", "og", "eller")) -> Column:
    """Repaired extraction: ligatures, soft hyphens, words broken over lines (not before a conjunction), odd blanks,
    blanks before punctuation and inside brackets, runs of blank lines."""
    steps = [
        ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("­", ""), ("[​⁠﻿�]", ""),
        ("[   ]", " "), ("[  ]", "\n"),
        (rf"(?U)(\w)-\n(?!(?:{'|'.join(conjunctions)})\b)(\w)", "$1$2"),
        ("[ \\t]+", " "), (" +([,.;:!?])", "$1"), ("([(\\[]) +", "$1"), (" +([)\\]])", "$1"), (" *\n *", "\n"), ("\n{3,}", "\n\n"),
    ]
    return strip(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c))


def normalised(c: Column, vocabulary: Sequence[str] = (), codes: str = "") -> Column:
    """A text for comparison: lower case, document codes and trademark signs gone, the names of vocabulary made one, white
    space collapsed."""
    t = F.lower(c)
    if codes:
        t = F.regexp_replace(t, codes, "")
    if vocabulary:
        t = F.regexp_replace(t, rf"\b(?:{'|'.join(map(str.lower, vocabulary))})\b", "~")
    return collapse(F.regexp_replace(t, "[®™]", ""))


def fingerprint(c: Column, vocabulary: Sequence[str] = (), codes: str = "") -> Column:
    """SHA-1 of the normalised text."""
    return F.sha1(normalised(c, vocabulary, codes))


def chapter(number: Column) -> Column:
    return F.substring_index(number, ".", 1)


def natural_key(number: Column, empty: int = 999) -> Column:
    """The numbers in a section number, in order; arrays compare element by element."""
    found = F.transform(F.regexp_extract_all(number, F.lit(r"(\d+)"), 1), lambda x: x.cast("bigint"))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(empty).cast("bigint")))


def weighted_section(number: Column) -> Column:
    """The first four dotted parts in base 100, not padded."""
    parts = F.slice(F.split(number, "\\."), 1, 4)
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 100 + F.coalesce(x.try_cast("bigint"), F.lit(0)))


def version_key(version: Column) -> Column:
    """major * 10000 + minor of an edition such as 1.10; -1 without one."""
    major, minor = (F.regexp_extract(version, r"^(\d+)(?:\.(\d+))?", k) for k in (1, 2))
    number = major.try_cast("int") * 10000 + F.coalesce(F.nullif(minor, F.lit("")).try_cast("int"), F.lit(0))
    return F.coalesce(number, F.lit(-1))


def leading_int(c: Column) -> Column:
    """The integer that a text begins with, else 0; null stays null."""
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0)))


def position_key(pos: Column) -> Column:
    """A position without leading zeros, in lower case; 0 if nothing is left."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.trim(pos), "^0+", "")), F.lit("")), F.lit("0"))


def number_or_null(text: Column) -> Column:
    """A part number: 3 to 20 characters with a digit and neither = nor #, in upper case; else null."""
    t = F.upper(strip(text))
    return F.when(F.length(t).between(3, 20) & t.rlike("[0-9]") & ~t.rlike("[=#]"), t)


def heading(body: Column) -> Column:
    """The first line without its number, if it is 1 to 80 characters and no sentence."""
    first = strip(F.regexp_replace(F.substring_index(strip(body), "\n", 1), r"^[0-9]+(?:\.[0-9]+)*\.?\s+", ""))
    return F.when(F.length(first).between(1, 80) & ~first.endswith("."), first)


def teaser(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def built(serial: Column) -> Column:
    """Year and week, or year, that the first six digits of a serial number state; else empty."""
    digits = F.regexp_replace(serial, "[^0-9]", "")
    year, week = F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 2).try_cast("int")
    return (
        F.when(~year.between(1990, 2100) | year.isNull(), "")
        .when(week.between(1, 53), F.concat(year.cast("string"), F.lit(" · week "), week.cast("string")))
        .otherwise(year.cast("string"))
    )


def pick(by_lang: Column, order: Sequence[str]) -> Column:
    """The first value that is not empty, by order of languages, then by language name."""
    wanted = F.array(*[F.try_element_at(by_lang, F.lit(x)) for x in order])
    rest = F.transform(F.array_sort(F.map_keys(by_lang)), lambda k: F.try_element_at(by_lang, k))
    return F.try_element_at(F.filter(F.concat(wanted, rest), lambda x: x.isNotNull() & (x != "")), F.lit(1))


def terms(query: str) -> list[str]:
    return [t for t in query.split(" ") if t]


def substring_score(haystack: Column, words: Sequence[str]) -> Column:
    """Every word must occur. Each scores at its first occurrence: 60 if it is all, 40 at the start, 25 after a blank,
    else 10; the total shrinks with the length. Null without words or if one is missing."""
    if not words:
        return F.lit(None).cast("bigint")
    each = []
    for w in words:
        at = F.locate(w, haystack)
        each.append(F.when(haystack.isNull() | (at == 0), None).when(haystack == w, 60).when(at == 1, 40).when(F.substr(haystack, at - 1, F.lit(1)) == " ", 25).otherwise(10))
    total = reduce(lambda a, b: a + b, each)
    return F.floor(total * 1000 / (40 + F.least(F.length(haystack), F.lit(1200)))).cast("bigint")


def near(a: Column, b: Column) -> Column:
    """Equal, or lengths within two and an edit distance within 2 (from nine letters), 1 (from six) or 0."""
    budget = F.when(F.length(a) >= 9, 2).when(F.length(a) >= 6, 1).otherwise(0)
    close = (F.abs(F.length(a) - F.length(b)) <= 2) & (F.levenshtein(a, b) <= budget)
    return (a == b) | close
