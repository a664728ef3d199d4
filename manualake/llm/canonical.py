"""One form for text that looks the same (problem 6).

A token with odd characters walks a trie of the corpus's vocabulary under a weighted edit automaton, in which
look-alikes and ignorable characters cost nothing; the cheapest, then most frequent, word that it reaches is its
spelling. A token that reaches none is normalised by the same table. Tokens and the words that they may look like are
brought together by a skeleton in which all look-alikes are one, so each trie holds the words of some tokens only and
no vocabulary is sent anywhere whole. Every other edit is a visible difference here, so the automaton's budget is 0.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Letters of other scripts and the Latin letters that they look like.
LOOK_ALIKES = dict(
    zip(
        "АВСЕНІЈКМОРЅТУХ" "асеһіјорѕухԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "οϲϳν",
        "ABCEHIJKMOPSTYX" "acehijopsyxdqw" "ABEZHIKMNOPTYX" "ocjv",
        strict=True,
    )
)
#: Letters that look like more than one Latin letter, the table's choice first.
AMBIGUOUS = {"Ӏ": "Il", "ӏ": "lI", "ı": "i"}
HYPHENS = "‐‑﹣－"
#: Letters whose form depends on the word, and the class of Latin letters that they stand for.
UNSURE = "".join(c for c, to in AMBIGUOUS.items() if len(to) > 1)
_CLASS = str.maketrans({x: min(to) for to in AMBIGUOUS.values() if len(to) > 1 for x in to})
_UNSURE = re.compile(f"[{UNSURE}]")


def _table() -> dict[str, str]:
    rows: dict[str, str] = {}
    for cp in [*range(0x80, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE00, 0x10000), *range(0xE0000, 0xE0200)]:
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind == "Zs":
            rows[c] = " "
        elif kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp == 0x034F:
            rows[c] = ""
        elif 0xFF01 <= cp <= 0xFF5E or 0xFB00 <= cp <= 0xFB06 or cp in (0x0132, 0x0133):
            rows[c] = unicodedata.normalize("NFKC", c)
    return rows | dict.fromkeys(HYPHENS, "-") | LOOK_ALIKES | {k: v[0] for k, v in AMBIGUOUS.items()}


TABLE = _table()
_TRANSLATE = str.maketrans(TABLE)
#: What is never odd: ASCII, most of the precomposed Latin letters and common punctuation.
ODD = re.compile("[^\x00-\x7f\xa1-\xac\xae-İĴ-ſ–—‘-•…‰€]")
_BLANK = re.compile("([" + "".join(re.escape(c) for c, to in TABLE.items() if to == " ") + "\\s]+)")


def table_form(text: str) -> str:
    """text normalised by table alone."""
    if text.isascii() or not ODD.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TRANSLATE))


def skeleton(token: str) -> str:
    """A form that all readings of a token share: that by table, with the letters of one class as one."""
    return table_form(token).translate(_CLASS)


class Vocabulary:
    """A trie of words, walked by tokens under the weighted edit automaton."""

    def __init__(self, words: Iterable[tuple[str, int]], budget: int = 0):
        self.budget = budget
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for c in unicodedata.normalize("NFD", word):
                node = node.setdefault(c, {})
            if node.get("", (0, ""))[0] < n:
                node[""] = (n, word)
        self._known: dict[str, str] = {}

    @staticmethod
    def _steps(c: str) -> tuple[str, ...]:
        """What c may stand for at no cost; the empty string for an ignorable character."""
        if c in AMBIGUOUS:
            return (*AMBIGUOUS[c], c)
        to = TABLE.get(c)
        if to is None:
            return (c,)
        to = unicodedata.normalize("NFD", to)
        return (to, c) if to else (to,)

    def spelling(self, token: str) -> str:
        """The vocabulary's word that token looks like, else its form by table."""
        found = self._known.get(token)
        if found is None:
            if len(self._known) > 200_000:
                self._known.clear()
            found = self._known[token] = self._walk(token) or table_form(token)
        return found

    def _walk(self, token: str) -> str | None:
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}
        for c in unicodedata.normalize("NFD", token):
            after: dict[int, tuple[int, dict]] = {}

            def reach(cost: int, node: dict | None) -> None:
                if node is not None and cost <= self.budget and after.get(id(node), (self.budget + 1,))[0] > cost:
                    after[id(node)] = (cost, node)
                    if cost < self.budget:  # a letter that token lacks
                        for letter, child in node.items():
                            if letter:
                                reach(cost + 1, child)

            for cost, node in states.values():
                for step in self._steps(c):
                    at: dict | None = node
                    for letter in step:
                        at = at.get(letter) if at is not None else None
                    reach(cost, at)
                if cost < self.budget:
                    reach(cost + 1, node)  # a letter that token has too many
                    for letter, child in node.items():
                        if letter:
                            reach(cost + 1, child)
            states = after
            if not states:
                return None
        ends = [(cost, -node[""][0], node[""][1]) for cost, node in states.values() if "" in node]
        return min(ends)[2] if ends else None

    def form(self, text: str) -> str:
        """The consistent form of a text: odd blanks become blanks, odd tokens their spelling."""
        return spelled(text, self.spelling)


def spelled(text: str, spelling: Callable[[str], str]) -> str:
    """The form of a text whose odd tokens are spelled by `spelling`, and whose other characters by the table."""
    if text.isascii() or not ODD.search(text):
        return text
    parts = _BLANK.split(text)
    for i, part in enumerate(parts):
        if part and ODD.search(part):
            token = part.strip(string.punctuation)
            at = part.index(token)
            parts[i] = part[:at] + spelling(token) + part[at + len(token) :] if i % 2 == 0 else part.translate(_TRANSLATE)
    return unicodedata.normalize("NFC", "".join(parts))


def records(topic: DataFrame, topic_text: DataFrame) -> DataFrame:
    """Rows (src, rec_id, text) of all titles and texts that are not null."""
    titles = topic.select(F.lit("topic").alias("src"), F.col("topic_id").cast("string").alias("rec_id"), F.col("title").alias("text"))
    texts = topic_text.select(F.lit("topic_text").alias("src"), F.col("text_id").cast("string").alias("rec_id"), "text")
    return titles.unionAll(texts).filter("text is not null")


def corpus_tokens(rows: DataFrame) -> DataFrame:
    """Counts (token, skeleton, odd, n) of the tokens of all texts, combined within each batch before the shuffle. Of the
    plain ones only those that hold a letter of an unsure class can decide anything."""
    classes = re.compile(f"[{''.join(sorted({x for c in UNSURE for x in AMBIGUOUS[c]}))}]")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(text.split())
            for w in [w for w in seen if w[0] in string.punctuation or w[-1] in string.punctuation]:
                seen[w.strip(string.punctuation)] += seen.pop(w)
            odd = {w: not w.isascii() and ODD.search(w) is not None for w in seen}
            kept = [w for w in seen if odd[w] or classes.search(w)]
            cols = [kept, [skeleton(w) for w in kept], [odd[w] for w in kept], [seen[w] for w in kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.int64()))], names=["token", "skeleton", "odd", "n"])

    return rows.select("text").mapInArrow(count, "token string, skeleton string, odd boolean, n bigint").groupBy("token", "skeleton", "odd").agg(F.sum("n").alias("n"))


def spellings(rows: DataFrame, *, trie_tokens: int = 20_000) -> DataFrame:
    """Rows (token, spelling) of the odd tokens that the vocabulary spells otherwise than the table does.

    Odd tokens meet the plain words of their skeleton, some trie_tokens of them in a trie at a time.
    """
    tokens = cut(corpus_tokens(rows))
    odd = tokens.filter("odd").select("token", "skeleton")
    words = tokens.filter("not odd").join(odd.select("skeleton").distinct(), "skeleton", "left_semi")
    tries = F.pmod(F.xxhash64("skeleton"), F.lit(1 + odd.count() // trie_tokens))

    def walk(asked: pa.Table, known: pa.Table) -> pa.Table:
        trie = Vocabulary(zip(known.column("word").to_pylist(), known.column("n").to_pylist()))
        found = [(t, trie.spelling(t)) for t in asked.column("token").to_pylist()]
        found = [(t, s) for t, s in found if s != table_form(t)]
        return pa.table([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["token", "spelling"])

    return cut(
        odd.select("token", tries.alias("trie")).groupBy("trie").cogroup(words.select(F.col("token").alias("word"), "n", tries.alias("shelf")).groupBy("shelf")).applyInArrow(walk, "token string, spelling string")
    )


def _formed(rows: DataFrame, out: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], schema: str) -> DataFrame:
    """out of each batch of rows (src, rec_id, text) and the consistent forms of its texts.

    Only texts with a letter of more than one reading ask for spellings; all others have the form by table.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield out(batch, [table_form(t) for t in batch.column(2).to_pylist()])

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixes = [{x["token"]: x["spelling"] for x in f or ()} for f in batch.column(3).to_pylist()]
            yield out(batch, [spelled(t, lambda w: f.get(w) or table_form(w)) for t, f in zip(batch.column(2).to_pylist(), fixes)])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, r, w) for s, r, t in zip(*[batch.column(k).to_pylist() for k in range(3)]) for w in {x.strip(string.punctuation) for x in t.split() if _UNSURE.search(x)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(3)], names=["src", "rec_id", "token"])

    rows = rows.select("src", "rec_id", "text")
    several = F.col("text").rlike(f"[{UNSURE}]")
    tokens = rows.filter(several).mapInArrow(asked, "src string, rec_id string, token string").distinct()
    fixes = tokens.join(spellings(rows), "token").groupBy("src", "rec_id").agg(F.collect_list(F.struct("token", "spelling")).alias("fixes"))
    with_fixes = rows.filter(several).join(fixes, ["src", "rec_id"], "left").select("src", "rec_id", "text", "fixes")
    return rows.filter(~several).mapInArrow(plain, schema).unionAll(with_fixes.mapInArrow(unsure, schema))


def canonical(rows: DataFrame) -> DataFrame:
    """rows (src, rec_id, text) with the consistent form of text. Null texts are no rows here; empty ones stay empty."""

    def out(batch: pa.RecordBatch, forms: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], names=["src", "rec_id", "form"])

    return _formed(rows, out, "src string, rec_id string, form string")


def fingerprints(rows: DataFrame) -> DataFrame:
    """Rows (src, rec_id, form, raw, odd): 128-bit hashes of the form and the string, and whether they differ."""

    def digest(text: str) -> bytes:
        return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()

    def out(batch: pa.RecordBatch, forms: list[str]) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        raw, odd = [digest(t) for t in texts], [f != t for f, t in zip(forms, texts)]
        form = [digest(f) if o else r for f, o, r in zip(forms, odd, raw)]
        arrays = [batch.column(0), batch.column(1), pa.array(form, pa.binary()), pa.array(raw, pa.binary()), pa.array(odd, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["src", "rec_id", "form", "raw", "odd"])

    return _formed(rows, out, "src string, rec_id string, form binary, raw binary, odd boolean").distinct()


def look_alike_pairs(rows: DataFrame, *, group_rows: int = 2_000) -> DataFrame:
    """Pairs (src, rec_id_a, rec_id_b) of records that look the same but are different strings, smaller id first.

    Of any such pair one string at least differs from its form, so only those rows meet their group: equal strings
    never meet each other. A group of more than group_rows rows is salted, its odd rows being repeated for each salt.
    Null texts are no records; empty ones look like themselves only. Repeated deliveries count once.
    """
    prints = cut(fingerprints(rows))
    odd = prints.filter("odd")
    # Only groups with an odd row matter; their sizes set the salts.
    sizes = prints.join(odd.select("src", "form").distinct(), ["src", "form"], "left_semi").groupBy("src", "form").agg(F.count("*").alias("n"))
    salts = F.ceil(F.col("n") / group_rows).cast("int")
    left = odd.join(sizes, ["src", "form"]).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("n")
    right = (
        prints.join(sizes, ["src", "form"])
        .withColumn("salt", F.pmod(F.xxhash64("rec_id"), salts).cast("int"))
        .select("src", "form", "salt", F.col("rec_id").alias("other"), F.col("raw").alias("other_raw"), F.col("odd").alias("other_odd"))
    )
    pairs = left.join(right, ["src", "form", "salt"]).filter((F.col("raw") != F.col("other_raw")) & (~F.col("other_odd") | (F.col("rec_id") < F.col("other"))))
    return pairs.select("src", F.least("rec_id", "other").alias("rec_id_a"), F.greatest("rec_id", "other").alias("rec_id_b"))


def hash64(word: str) -> int:
    """A signed 64-bit hash, the same in every process, equal to Spark's xxhash64 of the string."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h
