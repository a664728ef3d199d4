"""Type plates as a camera reads them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import built

#: Words that stand on a plate, and the forms of a serial number.
HINTS = ("SERIAL NR", "SERIAL NO", "SERIENR", "RATED PRESSURE", "LINE PRESSURE", "MADE IN HOLLAND", "TYPE:")
STRICT_SERIAL = r"\b((?:19|20)[0-9]{2}\.[0-9]{2}\.[0-9]{3,4}(?:\.[0-9]{1,3})?|(?:19|20)[0-9]{11})\b"
LOOSE_SERIAL = r"\b((?:19|20)[0-9]{2}\.[0-9]{3,5}|[0-9]{7,10})\b"


def looks_like_plate(upper: Column, hints: Sequence[str] = HINTS) -> Column:
    """Whether a text in upper case holds a word that stands on plates; further words, such as a maker's name, are the caller's."""
    return reduce(lambda a, b: a | b, [F.contains(upper, F.lit(h)) for h in hints])


def by_length(builds: Sequence[str]) -> list[str]:
    """Distinct builds of three letters or more, the longest first, so that a longer one wins its prefix."""
    return sorted({b.upper() for b in builds if len(b) >= 3}, key=lambda b: (-len(b), b))


def type_code(upper: Column, builds: Sequence[str]) -> Column:
    """A struct (build, code): of the first build, longest first, that begins a type code, its first code: an optional 9,
    the build, and three or more letters or digits, bounded by others. One expression finds the codes of all builds."""
    order = by_length(builds)
    if not order:
        return F.lit(None).cast("struct<build:string,code:string>")
    found = F.regexp_extract_all(upper, F.lit(r"(?<![A-Z0-9])([A-Z0-9]{6,})(?![A-Z0-9])"), 1)
    ranks = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(b).alias("build")) for n, b in enumerate(order)])

    def build_of(word: Column) -> Column:
        bare = F.when(F.startswith(word, F.lit("9")), F.substring(word, 2, 64)).otherwise(word)
        fits = F.filter(ranks, lambda r: (F.startswith(word, r["build"]) & (F.length(word) >= F.length(r["build"]) + 3)) | (F.startswith(bare, r["build"]) & (F.length(bare) >= F.length(r["build"]) + 3)))
        return F.try_element_at(fits, F.lit(1))

    codes = F.filter(F.transform(found, lambda w, i: F.struct(build_of(w).alias("r"), i.alias("i"), w.alias("code"))), lambda x: x["r"].isNotNull())
    first = F.array_min(F.transform(codes, lambda x: F.struct(x["r"]["n"].alias("n"), x["i"].alias("i"), x["code"].alias("code"), x["r"]["build"].alias("build"))))
    return F.when(first.isNotNull(), F.struct(first["build"].alias("build"), first["code"].alias("code")))


def serial_number(upper: Column, loose: Column) -> Column:
    """A serial number of the strict form; without one, where loose holds, one of the loose form."""
    strict = F.nullif(F.regexp_extract(upper, STRICT_SERIAL, 1), F.lit(""))
    return F.coalesce(strict, F.when(loose, F.nullif(F.regexp_extract(upper, LOOSE_SERIAL, 1), F.lit(""))))


def named_machine(upper: Column, machines: Sequence[tuple[str, str]]) -> Column:
    """The machine of the first word of (word, machine), three letters or more, that occurs as a whole word."""
    out = F.lit(None).cast("string")
    words: dict[str, str] = {}
    for word, machine in machines:
        if len(word) >= 3:
            words.setdefault(word.upper(), machine)
    if not words:
        return out
    found = F.array(*[F.lit(w) for w in words])
    padded = F.concat(F.lit(" "), F.regexp_replace(upper, r"[^\w]+", " "), F.lit(" "))
    first = F.try_element_at(F.filter(found, lambda w: F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(w, r"[^\w]+", " "), F.lit(" ")))), F.lit(1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), first)


def model_line(lines: Column, machines: Sequence[tuple[str, str]], longest: int = 60) -> Column:
    """What follows the colon of the first line that says MODEL, else the first line that holds a digit and names a
    machine; empty without one."""
    labelled = F.try_element_at(F.filter(lines, lambda x: F.contains(F.upper(x), F.lit("MODEL"))), F.lit(1))
    after = F.trim(F.when(F.contains(labelled, F.lit(":")), F.regexp_replace(labelled, r"^[^:]*:", "")).otherwise(labelled))
    naming = F.try_element_at(F.filter(lines, lambda x: x.rlike("[0-9]") & named_machine(F.upper(x), machines).isNotNull()), F.lit(1))
    return F.left(F.when((F.length(after) > 0) & (F.lower(after) != "model"), after).otherwise(F.coalesce(F.trim(naming), F.lit(""))), F.lit(longest))


def read_plates(frames: DataFrame, builds: Sequence[tuple[str, str | None]], machines: Sequence[tuple[str, str]] = (), *, hints: Sequence[str] = HINTS) -> DataFrame:
    """Rows (frame, plate): a null plate where the frame (frame, lines array<string>) shows none, else a struct of what was
    read: machine, build, code, serial, built and model, each empty if unread.

    builds are (build, machine or null), machines (word, machine): dimensions of some hundred entries, part of the plan."""
    upper = F.upper(F.array_join("lines", " "))
    found = type_code(upper, [b for b, _ in builds])
    of_build = F.try_element_at(F.create_map(*[F.lit(x) for b, m in reversed(builds) if m for x in (b.upper(), m)]), F.col("_found.build")) if any(m for _, m in builds) else F.lit(None).cast("string")
    rows = frames.select("frame", "lines", upper.alias("_u"), found.alias("_found")).withColumn("_plate", looks_like_plate(F.col("_u"), hints))
    rows = rows.withColumn("_serial", serial_number(F.col("_u"), F.col("_plate") | F.col("_found").isNotNull()))
    e = F.lit("")
    plate = F.struct(
        F.coalesce(of_build, named_machine(F.col("_u"), machines)).alias("machine"), F.coalesce("_found.build", e).alias("build"), F.coalesce("_found.code", e).alias("code"),
        F.coalesce("_serial", e).alias("serial"), F.coalesce(built(F.col("_serial")), e).alias("built"), model_line(F.col("lines"), machines).alias("model"),
    )
    seen = F.coalesce(F.col("_plate"), F.lit(False)) | F.col("_found").isNotNull() | F.col("_serial").isNotNull()
    return rows.select("frame", F.when(seen, plate).alias("plate"))


def merge_plates(a: Column, b: Column) -> Column:
    """Field by field the first value that is not empty."""
    return F.struct(*[F.coalesce(F.nullif(a[c], F.lit("")), b[c]).alias(c) for c in ("machine", "build", "code", "serial", "built", "model")])
