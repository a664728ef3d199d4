"""Noise in text from scanned pages (problem 1).

A first pass over all records counts words, hyphenated forms and the lines that stand alone. In SQL, rare words meet the
frequent words from which their anagram hash differs by known confusions of characters; ranked by the number of
confusions and by frequency, the first that the confusions really turn into the rare word is its correction. Lines
that recur alone, and nowhere inside sentences, are running headers. A second pass removes the edge lines, joins the
words that the hyphen evidence shows to be broken, and replaces misread words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .canonical import table_form

#: What a scanner reads for what is printed, in lower case.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("i", "1"), ("l", "1"), ("t", "†"), ("a", "@"), ("e", "€"), ("n", "ri"), ("o", "0"), ("h", "li"), ("u", "ii"),
    ("ü", "ii"), ("d", "cl"), ("g", "9"), ("g", "6"), ("é", "6"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("s", "5"), ("b", "8"), ("z", "2"),
    ("o", "q"), ("s", "$"), ("ø", "o/"), ("ä", "a'"),
)
#: Words of page numbers, and what stands between the two numbers.
PAGE_WORDS = "page|pagina|seite|side|pag|blz"
OF_WORDS = "of|van|von|sur|af|de"
#: Words, with the signs that stand for letters inside them: o/ for ø, a' for ä.
WORD = re.compile(r"[\w†€@$£¢]+(?:(?:(?<=[oO])/|(?<=[aA])')(?=[^\W\d_])[\w†€@$£¢]+)*")
_SPACE = r"[\s\-–—·|\[\]()/:.]*"
PAGE_LINE = re.compile(rf"^{_SPACE}(?:(?:{PAGE_WORDS})\.?\s*)?\d{{1,4}}(?:\s*(?:{OF_WORDS}|/)\s*\d{{1,4}})?[\s\-–—·|\[\]()]*$", re.IGNORECASE)
PAGE_PART = re.compile(
    rf"(?<!\w)(?:{PAGE_WORDS})\.?\s*\d{{1,4}}(?:\s*(?:{OF_WORDS}|/)\s*\d{{1,4}})?(?!\w)|(?<![\w/])\d{{1,4}}\s*/\s*\d{{1,4}}(?![\w/])"
    r"|^\s*[-–—\[(]?\s*\d{1,4}\s*[-–—\])]?\s*(?=[|·]|\s{2})|(?:[|·]|\s{2})\s*[-–—\[(]?\s*\d{1,4}\s*[-–—\])]?\s*$",
    re.IGNORECASE,
)
EDITION = re.compile(r"(?<!\w)(?:rev|vers|version|ver|edition|ed)\.?\s*\w{1,3}(?!\w)", re.IGNORECASE)
LINE = re.compile(r"\r\n|\r|\n")
HYPHENS = "-¬‐‑"
HEAD = re.compile(r"^\s*([\u0300-\u036f]*[\w†€@$£¢]+)")  # an accent may be parted from its letter
HYPHEN = re.compile(r"(?<=[^\W\d_])- ?(?=[^\W\d_])")
AFTER = re.compile(r"[^\W\d_]+")
_INNER = frozenset("_†€@$£¢")
_MARKS = tuple(HYPHENS)
ENDS = (".", "!", "?", ";", ",", ":")
_DIGIT = re.compile(r"\d")
_PRIME = 0x9E3779B97F4A7C15


def residue(line: str, brands: frozenset[str]) -> tuple[str, bool, bool]:
    """What is left of a line without page numbers, editions and product names, in lower case; whether it had a page
    number, or a product name."""
    rest = PAGE_PART.sub(" | ", line) if _DIGIT.search(line) else line
    paged = rest != line
    rest = EDITION.sub(" ", rest)
    words = WORD.findall(rest)
    out, named, i = [], False, 0
    while i < len(words):
        if words[i].lower() in brands:
            named = True
            i += 2 if i + 1 < len(words) and words[i + 1].isupper() and len(words[i + 1]) <= 4 else 1
        else:
            out.append(words[i].lower())
            i += 1
    return " ".join(out), paged, named


def _begin(text: str, end: int, inner: frozenset[str] | None = None) -> int:
    """Where the word that ends at `end` begins: letters, or with inner also digits and those signs."""
    at = end
    while at and text[at - 1].isalnum() and (inner is not None or not text[at - 1].isdecimal()) or at and inner is not None and text[at - 1] in inner:
        at -= 1
    return at


def _alone(line: str) -> bool:
    """Whether a line may be an edge line: not blank, and not the end of a clause."""
    s = line.rstrip()
    if len(s) > 1 and s[-1] in HYPHENS and s[-2].isalpha():
        return False
    return bool(s.strip()) and (not s.endswith(ENDS) or bool(EDITION.search(s[-12:])))


def records(topic_text: DataFrame, part_row: DataFrame) -> DataFrame:
    """Rows (src, rec_id, text) of all texts and descriptions that are not null."""
    texts = topic_text.select(F.lit("topic_text").alias("src"), F.col("text_id").cast("string").alias("rec_id"), "text")
    parts = part_row.select(F.lit("part_row").alias("src"), F.col("part_id").cast("string").alias("rec_id"), F.col("description").alias("text"))
    return texts.unionAll(parts).filter("text is not null")


def brand_words(product: DataFrame, *, bound: int = 100_000) -> frozenset[str]:
    """Names of brands in lower case. Brands are a dimension; more than bound of them are an error, not a cut."""
    found = product.select(F.lower("brand_name")).filter("brand_name is not null").distinct().limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"more than {bound} brands")
    return frozenset(r[0] for r in found)


def statistics(rows: DataFrame, brands: frozenset[str]) -> DataFrame:
    """Rows (kind, key, n) over all records: `w` words, `h` words with a hyphen inside, `s` words with a hanging hyphen,
    `r` residues of lines that stand alone. Combined within each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws: Counter[str] = Counter()
            other: Counter[tuple[str, str]] = Counter()
            for text in batch.column(0).to_pylist():
                text = table_form(text)
                ws.update(WORD.findall(text.lower()))
                if "\n" in text or "\r" in text:
                    lines = LINE.split(text)
                    for above, line in zip(lines, lines[1:]):
                        if above.rstrip().endswith(_MARKS):  # parts of a word are no words
                            ws.subtract([*WORD.findall(above.lower())[-1:], *WORD.findall(line.lower())[:1]])
                    if sum(1 for line in lines if line.strip()) > 1:
                        # A line after a hyphen may begin with the rest of a word.
                        seen = {
                            residue(line, brands)[0]
                            for above, line in zip(["", *lines], lines)
                            if _alone(line) and not above.rstrip().endswith(_MARKS) and not PAGE_LINE.match(line)
                        }
                        other.update(("r", r) for r in seen if r)
                if "-" in text:
                    for m in HYPHEN.finditer(text):
                        a, b = text[_begin(text, m.start()) : m.start()], AFTER.match(text, m.end())
                        other[("s" if m[0] == "- " else "h", f"{a}{m[0]}{b[0]}".lower())] += 1
            ws = +ws
            kinds = ["w"] * len(ws) + [k for k, _ in other]
            keys = [*ws, *(key for _, key in other)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array([*ws.values(), *other.values()], pa.int64())], names=["kind", "key", "n"])

    return rows.select("text").mapInArrow(count, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def header_residues(stats: DataFrame, misread: DataFrame | None = None, *, least: int = 3, share: float = 0.4) -> DataFrame:
    """Distinct residues (key) of running headers and table heads: those that recur alone at least `least` times, however
    many lines there are, and hold a word of letters, not among misread (word), that stands mostly in such a line."""
    words = stats.filter((F.col("kind") == "w") & F.col("key").rlike("^\\p{L}+$")).select(F.col("key").alias("word"), F.col("n").alias("n_word"))
    if misread is not None:
        words = words.join(misread.select("word"), "word", "left_anti")
    keys = stats.filter((F.col("kind") == "r") & (F.col("n") >= least)).select("key", "n")
    telling = keys.withColumn("word", F.explode(F.array_distinct(F.split("key", " ")))).join(words, "word").filter(F.col("n") >= share * F.col("n_word"))
    return telling.select("key").distinct()


def with_headers(rows: DataFrame, ids: list[str], brands: frozenset[str], headers: DataFrame, *, bound: int = 100_000) -> tuple[DataFrame, frozenset[str]]:
    """rows (..., text) with a column headers, and the headers that all rows share.

    Up to bound headers are sent to all rows, and the column is null; beyond, each row of several lines gets those of
    its own lines by a join, and nothing is sent.
    """
    shared = headers.limit(bound + 1).collect()
    if len(shared) <= bound:
        return rows.withColumn("headers", F.lit(None).cast("array<string>")), frozenset(r.key for r in shared)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(ids)).to_pylist()
            found = [(i, r) for i, t in enumerate(texts) for r in {residue(x, brands)[0] for x in LINE.split(table_form(t))} if r]
            at = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(ids))), pa.array([r for _, r in found], pa.string())], names=[*ids, "key"])

    several = rows.filter(F.col("text").rlike("[\\r\\n]")).select(*ids, "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in several.schema if f.name in ids)
    lines = several.mapInArrow(own, f"{schema}, key string").join(headers, "key", "left_semi")
    return rows.join(lines.groupBy(*ids).agg(F.collect_set("key").alias("headers")), ids, "left"), frozenset()


def anagram_hash(word: str) -> int:
    """A number that depends on the characters only, not on their order: the sum of theirs, 55 bits each."""
    total = 0
    for c in word:
        x = (ord(c) * _PRIME) & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        total += (x * x * x >> 7) & ((1 << 55) - 1)
    return total


def turns_into(printed: str, read: str, most: int) -> bool:
    """Whether at most `most` confusions turn printed into read."""
    if not most:
        return printed == read
    if printed == read:
        return True
    k = 0
    while k < min(len(printed), len(read)) and printed[k] == read[k]:
        k += 1
    # The first confusion begins at the first difference or shortly before it.
    for at in range(max(0, k - 1), k + 1):
        for p, r in CONFUSIONS:
            if printed.startswith(p, at) and read.startswith(r, at) and turns_into(printed[at + len(p) :], read[at + len(r) :], most - 1):
                return True
    return False


def correct(words: DataFrame, lexicon: DataFrame, *, most: int = 2, ratio: int = 8, least: int = 4, support: int = 5) -> DataFrame:
    """Rows (word, correction) of the words (word, n) that are likely misreadings of a word of lexicon (word, n).

    The correction has at least `least` letters, no digit or symbol, occurs `support` times and ratio times as often as
    the word (which must hold two letters), and at most `most` confusions turn it into the word. Ranked by the number of
    confusions, then by frequency.
    """
    hashed = F.udf(anagram_hash, T.LongType(), useArrow=True)
    singles = [(anagram_hash(p) - anagram_hash(r), [r]) for p, r in CONFUSIONS]
    steps = [(d, r, 1) for d, r in singles]
    if most > 1:
        steps += [(a[0] + b[0], a[1] + b[1], 2) for a, b in combinations_with_replacement(singles, 2)]
    spark = lexicon.sparkSession
    table = spark.createDataFrame(steps, "difference bigint, signs array<string>, confusions int")
    signs = sorted({r for _, r in CONFUSIONS})
    holds = reduce(lambda a, b: a | b, [F.contains(F.col("word"), F.lit(s)) for s in signs])
    rare = words.filter(F.col("word").rlike("\\p{L}.*\\p{L}") & holds & (F.length("word") >= least)).withColumn("h", hashed("word"))
    # The table of differences is fixed: a few hundred rows.
    asked = rare.join(F.broadcast(table), F.forall("signs", lambda s: F.contains(F.col("word"), s))).select(
        "word", "n", "confusions", (F.col("h") + F.col("difference")).alias("h")
    )
    common = lexicon.filter((F.col("n") >= support) & (F.length("word") >= least) & F.col("word").rlike("^\\p{L}+$")).select(
        F.col("word").alias("correction"), F.col("n").alias("times"), hashed("word").alias("h")
    )
    found = asked.join(common, "h").filter((F.col("times") >= ratio * F.col("n")) & (F.col("word") != F.col("correction")))
    really = F.udf(lambda p, r, k: turns_into(p, r, k), T.BooleanType(), useArrow=True)
    found = found.filter(really("correction", "word", "confusions"))
    return found.groupBy("word").agg(F.min_by("correction", F.struct("confusions", -F.col("times"), "correction")).alias("correction"))


def bloom(words: DataFrame, *, bits_a_word: int = 12, most_bits: int = 1 << 27) -> bytes | None:
    """A Bloom filter of the column word, made by the executors and sized by their count. None, which holds everything,
    where it would need more than most_bits (16 MB): what is sent to the executors is bounded, and an exact join follows."""
    n = words.count()
    size = 1 << max(16, (max(1, n) * bits_a_word - 1).bit_length())
    if size > most_bits:
        return None
    h = F.xxhash64("word")
    at = F.explode(F.array(h.bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(size - 1))))
    parts = words.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at & 7 as int)))").alias("bits")).toArrow()
    out = np.zeros(size // 8, dtype=np.uint8)
    out[parts.column("byte").to_numpy()] = parts.column("bits").to_numpy()
    return out.tobytes()


class Bloom:
    def __init__(self, bits: bytes | None):
        self.bits, self.mask = bits, len(bits or b"") * 8 - 1
        self._known: dict[str, bool] = {}

    def __contains__(self, word: str) -> bool:
        if self.bits is None:
            return True
        seen = self._known.get(word)
        if seen is None:
            if len(self._known) > 300_000:
                self._known.clear()
            h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
            a, b = h & self.mask, (h >> 32) & self.mask
            seen = self._known[word] = bool(self.bits[a >> 3] >> (a & 7) & 1 and self.bits[b >> 3] >> (b & 7) & 1)
        return seen


class Layout:
    """The lines of a record: which are edge lines, and which words break over a line end."""

    def __init__(self, brands: frozenset[str], headers: frozenset[str]):
        self.brands, self.headers = brands, headers
        self.telling = brands | {w for h in headers for w in h.split(" ")}

    def of(self, headers: list[str] | None) -> Layout:
        """This layout, or that of a record that brings its own headers."""
        return Layout(self.brands, frozenset(headers)) if headers else self

    def edge(self, line: str) -> tuple[bool, bool]:
        """Whether a line is a running header, and whether it holds a page number."""
        if PAGE_LINE.match(line):
            return False, True
        if not _alone(line):
            return False, False
        if self.telling.isdisjoint(WORD.findall(line.lower())):
            return False, False
        rest, paged, named = residue(line, self.brands)
        header = rest in self.headers if rest else named
        return header, paged and (header or not rest)

    def read(self, text: str) -> tuple[list[str], bool, bool]:
        """The lines without edge lines, and whether there were headers or page numbers. A record of one line has none."""
        lines = LINE.split(text)
        if sum(1 for line in lines if line.strip()) < 2:
            return lines, False, False
        kept, header, page, removed = [], False, False, False
        for line in lines:
            h, p = self.edge(line)
            header, page = header or h, page or p
            if h or p:
                removed = True
            elif removed and not line.strip() and kept and kept[-1].rstrip().endswith(_MARKS):
                continue  # the blank line belonged to the page's edge
            else:
                kept.append(line)
                removed = False
        return kept, header, page

    @staticmethod
    def breaks(lines: list[str]) -> list[tuple[int, str, str, str]]:
        """(line, first part, hyphen, rest) of the words that may break over the end of a line."""
        out = []
        for i in range(len(lines) - 1):
            s = lines[i].rstrip()
            if s and s[-1] in HYPHENS:
                a, b = s[_begin(s, len(s) - 1, _INNER) : -1], HEAD.match(lines[i + 1])
                if a and b and not (a[-1].isdigit() and b[1][0].isdigit()) and AFTER.search(a) and AFTER.search(b[1]):
                    out.append((i, a, s[-1], b[1]))
        return out


FINDINGS = "src string, rec_id string, kind string, a string, b string, mark string"


def findings(rows: DataFrame, brands: frozenset[str], headers: frozenset[str], misread: bytes | None) -> DataFrame:
    """Of rows (src, rec_id, text, headers) rows (src, rec_id, kind, a, b, mark): `header`, `page`, `break` with the two parts of a word and the hyphen, `word`
    with a word that may be misread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, suspects = Layout(brands, headers), Bloom(misread)
        for batch in batches:
            out: list[tuple] = []
            for src, rec, text, own in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                text = table_form(text)
                if "\n" in text or "\r" in text:
                    lines, header, page = layout.of(own).read(text)
                    if header:
                        out.append((src, rec, "header", None, None, None))
                    if page:
                        out.append((src, rec, "page", None, None, None))
                    skip: set[tuple[int, bool]] = set()
                    for i, a, mark, b in layout.breaks(lines):
                        out.append((src, rec, "break", a, b, mark))
                        skip |= {(i, True), (i + 1, False)}
                    found = set()
                    for i, line in enumerate(lines):
                        ws = WORD.findall(line.lower())
                        found.update(ws[(i, False) in skip : len(ws) - ((i, True) in skip)])
                else:
                    found = set(WORD.findall(text.lower()))
                out += [(src, rec, "word", w, None, None) for w in found if w in suspects]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=[x.split()[0] for x in FINDINGS.split(", ")])

    return rows.select("src", "rec_id", "text", "headers").mapInArrow(run, FINDINGS)


class ScanNoise:
    """What the corpus shows about its noise, and the damage of each record."""

    def __init__(self, rows: DataFrame, product: DataFrame, *, header_bound: int = 100_000):
        self.brands = brand_words(product)
        self.stats = cut(statistics(rows, self.brands))
        self.lexicon = self.stats.filter("kind = 'w'").select(F.col("key").alias("word"), "n")
        self.corrections = cut(correct(self.lexicon, self.lexicon))
        self.rows, self.headers = with_headers(rows, ["src", "rec_id"], self.brands, header_residues(self.stats, self.corrections), bound=header_bound)
        self.found = cut(findings(self.rows, self.brands, self.headers, bloom(self.corrections)))
        self.breaks = cut(self._breaks())

    def _breaks(self) -> DataFrame:
        """Distinct breaks (a, b, mark) with the word that they make, whether they are damage, and its correction."""
        seen = self.found.filter("kind = 'break'").select("a", "b", "mark").distinct()
        seen = seen.withColumn("word", F.lower(F.concat("a", "b"))).withColumn("inner", F.lower(F.concat_ws("-", "a", "b"))).withColumn("hung", F.lower(F.concat_ws("- ", "a", "b")))

        def counted(kind: str, key: str, name: str) -> DataFrame:
            return self.stats.filter(F.col("kind") == kind).select(F.col("key").alias(key), F.col("n").alias(name))

        seen = seen.join(counted("w", "word", "n_word"), "word", "left").join(counted("h", "inner", "n_inner"), "inner", "left").join(counted("s", "hung", "n_hung"), "hung", "left")
        fixed = correct(seen.select("word", F.coalesce("n_word", F.lit(1)).alias("n")).distinct(), self.lexicon)
        seen = seen.join(fixed, "word", "left")
        joined = F.greatest(F.coalesce("n_word", F.lit(0)), F.when(F.col("correction").isNotNull(), 1).otherwise(0))
        kept = F.greatest(F.coalesce("n_inner", F.lit(0)), F.coalesce("n_hung", F.lit(0)))
        # Without any evidence a hyphen before a small letter, or between capitals, breaks a word.
        alike = F.col("b").rlike("^[\\p{Ll}†€@0-9]") | (F.col("a").rlike("^\\P{Ll}+$") & F.col("b").rlike("^\\P{Ll}+$") & (F.length("word") >= 7))
        damage = (F.col("mark") == "¬") | F.when(joined > kept, True).when(kept > 0, False).otherwise(alike & ~F.col("a").rlike("\\d$"))
        return seen.select("a", "b", "mark", "word", damage.alias("damage"), "correction")

    def damage(self) -> DataFrame:
        """Distinct (src, rec_id, defect) with defect `hyphen`, `misread`, `header` or `page`.

        Null and empty texts have none; a line of a record of one line is no edge line; list numbers and line breaks
        between words are no damage. Repeated deliveries count once.
        """
        edges = self.found.filter("kind in ('header', 'page')").select("src", "rec_id", F.col("kind").alias("defect"))
        words = self.found.filter("kind = 'word'").select("src", "rec_id", F.col("a").alias("word"))
        misread = words.join(self.corrections, "word", "left_semi").select("src", "rec_id", F.lit("misread").alias("defect"))
        broken = self.found.filter("kind = 'break'").select("src", "rec_id", "a", "b", "mark").join(self.breaks, ["a", "b", "mark"])
        hyphen = broken.filter("damage").select("src", "rec_id", F.lit("hyphen").alias("defect"))
        inside = broken.filter("damage and correction is not null").select("src", "rec_id", F.lit("misread").alias("defect"))
        return edges.unionAll(misread).unionAll(hyphen).unionAll(inside).distinct()

    def repaired(self) -> DataFrame:
        """Rows (src, rec_id, text): each record as continuous paragraphs, edge lines removed, words joined and corrected."""
        words = self.found.filter("kind = 'word'").select("src", "rec_id", F.col("a").alias("word")).distinct().join(self.corrections, "word")
        broken = self.found.filter("kind = 'break'").select("src", "rec_id", "a", "b", "mark").distinct().join(self.breaks.filter("damage"), ["a", "b", "mark"])
        fixes = words.select("src", "rec_id", F.col("word").alias("k"), F.col("correction").alias("v")).unionAll(
            broken.select("src", "rec_id", F.concat("a", "mark", "b").alias("k"), F.coalesce("correction", "word").alias("v"))
        )
        fixes = fixes.groupBy("src", "rec_id").agg(F.collect_list(F.struct("k", "v")).alias("fixes"))
        brands, headers = self.brands, self.headers

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layout = Layout(brands, headers)
            for batch in batches:
                columns = (batch.column(k).to_pylist() for k in (2, 3, 4))
                out = [repair(text, layout.of(own), {f["k"]: f["v"] for f in fixed or ()}) for text, own, fixed in zip(*columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["src", "rec_id", "text"])

        return self.rows.join(fixes, ["src", "rec_id"], "left").select("src", "rec_id", "text", "headers", "fixes").mapInArrow(run, "src string, rec_id string, text string").distinct()


def _in_case(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and like[:1].isupper() else word


def repair(text: str, layout: Layout, fixes: dict[str, str]) -> str:
    """One record's text with its fixes: words to their corrections, and breaks (first part, hyphen, rest) to whole words."""
    text = table_form(text)
    if not fixes and "\n" not in text and "\r" not in text:
        return text.strip()
    lines, _, _ = layout.read(text)
    joined: list[str] = []
    whole = {(i, a, b): fixes.get(a + mark + b) for i, a, mark, b in layout.breaks(lines)}
    by_line = {i: (a, b, word) for (i, a, b), word in whole.items() if word}
    for i, line in enumerate(lines):
        if i - 1 in by_line and joined:
            a, b, word = by_line[i - 1]
            rest = line.lstrip()[len(b) :]
            last = joined[-1].rstrip()[:-1]
            joined[-1] = last[: len(last) - len(a)] + _in_case(word, a if len(a) > 1 else a + b) + rest
        else:
            joined.append(line)
    fixed = [WORD.sub(lambda m: _in_case(fixes[m[0].lower()], m[0]) if m[0].lower() in fixes else m[0], line) for line in joined] if fixes else joined
    paragraphs: list[list[str]] = [[]]
    for line in fixed:
        s = line.strip()
        if not s:
            paragraphs.append([])
        elif re.match(r"\d+[.)]\s", s) and paragraphs[-1]:
            paragraphs.append([s])
        else:
            paragraphs[-1].append(s)
    return "\n".join(" ".join(p) for p in paragraphs if p)
