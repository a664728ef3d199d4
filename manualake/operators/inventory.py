"""What file names, document codes, covers and properties say about a book, by rules given as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import composite_slug

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lookup(key: Column, table: Mapping[str, str]) -> Column:
    """The entry of a small fixed table; null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")


def stem(path: Column) -> Column:
    """The file's name without folders and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def name_tokens(path: Column) -> Column:
    """Runs of ASCII letters, digits and plus signs of the stem, in lower case."""
    return F.filter(F.split(F.lower(stem(path)), "[^a-z0-9+]+"), lambda x: x != "")


def last_known(tokens: Column, known: Sequence[str]) -> Column:
    """The last token that is one of known."""
    wanted = F.array(*[F.lit(x.lower()) for x in known])
    return F.try_element_at(F.filter(tokens, lambda x: F.array_contains(wanted, x)), F.lit(-1))


def parse_name(path: Column, *, brands: Sequence[str], codes: Sequence[str], langs: Sequence[str], doctypes: Mapping[str, str]) -> Column:
    """A struct of what the tokens of a file's name say: doctype (of its first token, else of its folder), brand, model,
    lang, version, whether it is a copy. A later token wins over an earlier one; what is not said is null."""
    t = name_tokens(path)
    folder = F.element_at(F.split(path, "/"), -2)
    version = F.regexp_extract(stem(path), r"(?i)(?<![a-z0-9])v(\d+)[._](\d{1,2})(?!\d)", 0)
    return F.struct(
        F.coalesce(lookup(F.try_element_at(t, F.lit(1)), doctypes), lookup(F.lower(folder), doctypes)).alias("doctype"),
        last_known(t, brands).alias("brand"),
        F.upper(last_known(t, codes)).alias("model"),
        last_known(t, langs).alias("lang"),
        none_if_empty(F.regexp_replace(F.regexp_replace(version, "(?i)^v", ""), "_", ".")).alias("version"),
        stem(path).rlike(r"_\d$").alias("copy"),
    )


def decode_code(code: Column, *, families: Mapping[str, str], suffixes: Mapping[str, str]) -> Column:
    """A struct of a positional document code, a digit, a family letter, and a number: the family's name, the number,
    and the meaning of its longest known suffix. Null fields for codes of another form."""
    fits = F.coalesce(F.upper(code).rlike(r"^\d[A-Z]\d+$"), F.lit(False))
    number = F.when(fits, F.substring(code, 3, 20))
    longest = sorted(suffixes, key=lambda s: (-len(s), s))
    meaning = reduce(lambda rest, s: F.when(number.endswith(s), suffixes[s]).otherwise(rest), reversed(longest), F.lit(None).cast("string"))
    return F.struct(F.when(fits, lookup(F.upper(F.substring(code, 2, 1)), families)).alias("family"), number.alias("number"), meaning.alias("series"))


def fill_gap(known: Column, text: Column, pattern: str, group: int = 1) -> Column:
    """known, or where it is missing what a pattern finds in a cover's text."""
    return F.coalesce(known, none_if_empty(F.regexp_extract(text, pattern, group)))


def token_date(text: Column) -> Column:
    """The first date such as 2022nov25 in a text, as yyyy-MM-dd; null without a real one."""
    parts = [F.regexp_extract(F.lower(text), rf"(20\d{{2}})({'|'.join(MONTHS)})(\d{{1,2}})", k) for k in (1, 2, 3)]
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), parts[1])
    return F.try_to_timestamp(F.concat_ws("-", parts[0], F.lpad(month.cast("string"), 2, "0"), F.lpad(parts[2], 2, "0")), F.lit("yyyy-MM-dd")).cast("date").cast("string")


def property_date(text: Column) -> Column:
    """The date of a property such as D:20221125101500, as yyyy-MM-dd."""
    return F.try_to_timestamp(none_if_empty(F.regexp_extract(text, r"^D:(\d{8})", 1)), F.lit("yyyyMMdd")).cast("date").cast("string")


def member_class(value: Column, classes: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first class that lists value."""
    return reduce(lambda rest, kv: F.when(value.isin(*kv[1]), kv[0]).otherwise(rest), reversed(list(classes.items())), F.lit(default))


def first_keyword(text: Column, words: Mapping[str, str], default: str | None = None) -> Column:
    """The entry of the first word, in the table's order, that a text contains without case."""
    low = F.lower(text)
    return reduce(lambda rest, kv: F.when(low.contains(kv[0]), kv[1]).otherwise(rest), reversed(list(words.items())), F.lit(default).cast("string"))


def book_id(doctype: Column, *names: Column, version: Column, date: Column) -> Column:
    """A slug of a book's parts that are known: doctype, names, and the version, else the date."""
    edition = F.coalesce(F.concat(F.lit("v"), F.replace(version, F.lit("."), F.lit(""))), F.replace(date, F.lit("-"), F.lit("")))
    return composite_slug(F.coalesce(doctype, F.lit("doc")), *names, edition)


def variant_label(pairs: Column) -> Column:
    """`Brewer Size` of at most two distinct pairs (array of struct brewer, size), sorted; empty for none or more."""
    words = F.array_sort(F.array_distinct(F.transform(pairs, lambda x: F.concat_ws(" ", none_if_empty(x["brewer"]), none_if_empty(x["size"])))))
    return F.when(F.size(words).between(1, 2), F.array_join(words, " / ")).otherwise("")


def picture_path(name: Column, root: str = "media/", ending: str = ".webp") -> Column:
    """A path as it is, a bare hash as the path of its picture."""
    return F.when(name.contains("/"), name).otherwise(F.concat(F.lit(root), name, F.lit(ending)))


def drawing_key(key: Column) -> Column:
    """A struct of `brand|...|code ...`: the part before the first bar, and the three to five digits that the last begins with."""
    parts = F.split(key, r"\|")
    return F.struct(F.element_at(parts, 1).alias("brand"), none_if_empty(F.regexp_extract(F.trim(F.element_at(parts, -1)), r"^(\d{3,5})", 1)).alias("code"))
