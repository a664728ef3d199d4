"""Sentences that are translations of each other in documents of two languages (problem 7).

Sentences with the same, otherwise unique, numbers teach a table of word translations. Each sentence is translated into
a weighted bag of the other language's words and retrieves sentences of the other text through an inverted index of its
words; both directions are intersected, and sentences left over join a pair that holds their neighbour.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut
from .canonical import table_form
from .language_id import BROKEN, LanguageModel, sentences
from .near_duplicates import mix
from .scan_noise import Bloom, bloom

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[,;:–—](?=\s)")
BREAK = "|"


def tokens(sentence: str) -> list[str]:
    """Lower-case words and numbers, letters and digits apart, a decimal comma being a point; a bar between clauses."""
    found = TOKEN.findall((BROKEN.sub("", sentence) if "\n" in sentence else sentence).lower())
    return [BREAK if t in ",;:–—" else t.replace(",", ".") if t[0].isdigit() else t for t in found]


def pattern(clause: list[str]) -> str:
    return " ".join("#" if t[0].isdigit() else t for t in clause)


def clauses(sentence: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in sentence:
        if t == BREAK:
            out.append([])
        else:
            out[-1].append(t)
    return [c for c in out if c]


def endings(clause: list[str]) -> list[str]:
    """Patterns of the clause and of its ends of three to eight tokens, the longest first."""
    whole = pattern(clause)
    parts = whole.split(" ")
    return [whole] + [" ".join(parts[-k:]) for k in range(min(8, len(parts) - 1), 2, -1)]


def compact(line: str, known: frozenset[str]) -> str:
    """A sentence's distinct words on one line: its own, a bar, those of formulas."""
    own: set[str] = set()
    every: set[str] = set()
    for c in clauses(line.split()):
        every.update(c)
        n = next((len(e.split(" ")) for e in endings(c) if e in known), 0)
        own.update(c[: len(c) - n])
    return f"{' '.join(sorted(own))}|{' '.join(sorted(every - own))}"


def formulas(rows: DataFrame, *, share: float = 0.004) -> dict[str, frozenset[str]]:
    """Of each language the clauses and ends of clauses, numbers left open, that occur in a share of its sentences. Each
    sentence counts for a few of them, so the share bounds their number whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str | None]] = Counter()
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for line in body.split("\n"):
                    seen[(lang, None)] += 1
                    seen.update((lang, p) for p in {e for c in clauses(line.split()) for e in endings(c)})
            langs, keys = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(seen.values(), pa.int64())], names=["lang", "clause", "n"])

    counts = cut(rows.select("lang", "body").mapInArrow(count, "lang string, clause string, n bigint").groupBy("lang", "clause").agg(F.sum("n").alias("n")))
    total = counts.filter("clause is null").select("lang", F.col("n").alias("total"))
    often = counts.filter("clause is not null and n >= 3").join(total, "lang").filter(F.col("n") >= share * F.col("total"))
    out: dict[str, set[str]] = defaultdict(set)
    for r in often.collect():
        out[r.lang].add(r.clause)
    return {lang: frozenset(c) for lang, c in out.items()}


def tokenised(texts: DataFrame, topics: DataFrame, model: LanguageModel) -> DataFrame:
    """Rows (topic_id, text_id, lang, body) of the texts of topics (topic_id): the language found, and the tokens of each
    sentence on a line of its own. A Bloom filter of the topics, where they are few enough for one, spares the other
    texts a shuffle; the join after it is exact."""
    wanted = bloom(topics.select(F.col("topic_id").alias("word")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bloom(wanted)
        for batch in batches:
            batch = batch.filter(pa.array([t in known for t in batch.column(0).to_pylist()], pa.bool_()))
            texts_ = [table_form(t) for t in batch.column(2).to_pylist()]
            langs = model.batch_languages(texts_)
            bodies = ["\n".join(" ".join(tokens(t[b:e])) for b, e in sentences(t)) for t in texts_]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(bodies, pa.string())], names=["topic_id", "text_id", "lang", "body"])

    rows = texts.select("topic_id", "text_id", "text").filter("text is not null and topic_id is not null and text_id is not null")
    return rows.mapInArrow(run, "topic_id string, text_id bigint, lang string, body string").filter("lang is not null").join(topics.select("topic_id").distinct(), "topic_id", "left_semi")


def compacted(rows: DataFrame, known: dict[str, frozenset[str]]) -> DataFrame:
    """rows with a body of distinct words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            out = ["\n".join(compact(line, known.get(lang, frozenset())) for line in body.split("\n")) for lang, body in zip(langs, bodies)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.string())], names=batch.schema.names)

    return rows.select("topic_id", "text_id", "lang", "body").mapInArrow(run, "topic_id string, text_id bigint, lang string, body string")


def bilingual_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of texts of one topic in different languages: lang_a < lang_b."""
    a = rows.select("topic_id", *[F.col(c).alias(f"{c}_a") for c in ("text_id", "lang", "body")])
    b = rows.select("topic_id", *[F.col(c).alias(f"{c}_b") for c in ("text_id", "lang", "body")])
    return a.join(b, "topic_id").filter("lang_a < lang_b").drop("topic_id")


class Side:
    """One side of a batch of pairs of texts: its sentences, and its words as numbers in the order of the sentences.

    pair and place give of each sentence its pair and its number in the text; sent and free of each word its sentence
    and whether it stands only in formulas.
    """

    def __init__(self, bodies: pa.Array):
        lines = pc.split_pattern(bodies, "\n")
        counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        halves = pc.split_pattern(pc.list_flatten(lines), "|")
        words = pc.split_pattern(pc.list_flatten(halves), " ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = pc.list_flatten(words)
        full = pc.not_equal(self.words, "").to_numpy(zero_copy_only=False)
        half = np.repeat(np.arange(len(sizes)), sizes)[full]
        self.words = self.words.filter(pa.array(full))
        self.pair = np.repeat(np.arange(len(counts)), counts)
        self.first = np.cumsum(counts) - counts
        self.place = np.arange(len(self.pair)) - np.repeat(self.first, counts)
        self.sent, self.free = half // 2, half % 2 == 1
        self.word = np.zeros(0, dtype=np.int64)


class Bitext:
    """A batch of pairs of texts, the words of both sides numbered together."""

    def __init__(self, bodies_a: pa.Array, bodies_b: pa.Array):
        self.a, self.b = Side(bodies_a), Side(bodies_b)
        coded = pa.concat_arrays([self.a.words, self.b.words]).dictionary_encode()
        self.names = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.a.word, self.b.word = codes[: len(self.a.words)], codes[len(self.a.words) :]
        self.number = pc.match_substring_regex(self.names, r"^\pN").to_numpy(zero_copy_only=False).astype(bool)

    def anchored(self) -> tuple[np.ndarray, np.ndarray]:
        """Sentences whose numbers are the same and unique in either text."""
        keys = []
        for side in (self.a, self.b):
            use = np.flatnonzero(self.number[side.word])
            n = np.zeros(len(side.pair), dtype=np.uint64)
            # Sets are equal if the sums of their members' hashes are.
            np.add.at(n, side.sent[use], mix(side.word[use].astype(np.uint64) + np.uint64(1)))
            has = np.flatnonzero(np.bincount(side.sent[use], minlength=len(side.pair)))
            key = mix(n[has] + mix(side.pair[has].astype(np.uint64) + np.uint64(1)))
            key, at, times = np.unique(key, return_index=True, return_counts=True)
            keys.append((key[times == 1], has[at[times == 1]]))
        both, i, j = np.intersect1d(keys[0][0], keys[1][0], assume_unique=True, return_indices=True)
        return keys[0][1][i], keys[1][1][j]


class Translations:
    """What the words of a batch may be translated by, one direction: rows (word, means, weight, strength) of a table."""

    def __init__(self, bitext: Bitext, table: pa.Table | None, *, numbers: float = 3.0, unknown: float = 0.5):
        n = len(bitext.names)
        self.weight = np.where(bitext.number, numbers, unknown)
        known = np.zeros(n, dtype=bool)
        of = to = np.zeros(0, dtype=np.int64)
        strength = np.zeros(0)
        if table is not None and table.num_rows and n:
            of, to = (pc.fill_null(pc.index_in(table.column(c), value_set=bitext.names), -1).to_numpy().astype(np.int64) for c in ("word", "means"))
            here = of >= 0
            self.weight[of[here]] = table.column("weight").to_numpy()[here]
            known[of[here]] = True
            here &= to >= 0
            of, to, strength = of[here], to[here], table.column("strength").to_numpy()[here]
        same = np.flatnonzero(~known)  # a number or an unknown word stands for itself
        of, to, strength = np.concatenate([of, same]), np.concatenate([to, same]), np.concatenate([strength, np.ones(len(same))])
        order = np.argsort(of, kind="stable")
        self.means, self.strength = to[order], strength[order]
        self.count = np.bincount(of, minlength=n)
        self.first = np.cumsum(self.count) - self.count


def _ragged(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners and members of the runs first, first + 1, ... of count members each."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]


def retrieved(bitext: Bitext, a: Side, b: Side, means: Translations, *, bonus: float = 3.0, formula: float = 0.15, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(key, share): key is i * sentences of b + j, ascending, for each sentence i of a whose translated bag meets sentence j of b's
    inverted index; share is how much of the bag's weight it finds there.

    Words of formulas weigh little; their numbers weigh only where they are found, as a formula may be missing. The
    index is asked in blocks of some `block` hits, however long a text is.
    """
    n_b, size = max(1, len(b.pair)), max(1, len(bitext.names))
    # The inverted index: by pair and word, the sentences of b.
    posted = b.pair[b.sent] * size + b.word
    order = np.argsort(posted, kind="stable")
    posted, sentence = posted[order], b.sent[order]
    numeric = bitext.number[a.word]
    weight = np.where(a.free, np.where(numeric, 0.0, formula * means.weight[a.word]), means.weight[a.word])
    extra = np.where(a.free & numeric, bonus, 0.0)
    bag = np.bincount(a.sent, weight, len(a.pair))
    asked, at = _ragged(means.first[a.word], means.count[a.word])
    wanted = a.pair[a.sent[asked]] * size + means.means[at]
    low = np.searchsorted(posted, wanted, "left")
    count = np.searchsorted(posted, wanted, "right") - low
    asked, at, low, count = (x[count > 0] for x in (asked, at, low, count))
    keys, shares = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    ends = np.cumsum(count)
    begin = 0
    while begin < len(asked):
        stop = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + block, "right"))
        stop = max(stop, begin + 1)
        # A block ends with a sentence.
        stop = int(np.searchsorted(a.sent[asked], a.sent[asked[stop - 1]], "right"))
        hit, place = _ragged(low[begin:stop], count[begin:stop])
        word, j, strength = asked[begin:stop][hit], sentence[place], means.strength[at[begin:stop][hit]]
        # Of several translations of a word in a sentence the strongest counts.
        order = np.lexsort((strength, j, word))
        word, j, strength = word[order], j[order], strength[order]
        best = np.flatnonzero(np.concatenate([(word[1:] != word[:-1]) | (j[1:] != j[:-1]), [True]]))
        word, j, strength = word[best], j[best], strength[best]
        key, inverse = np.unique(a.sent[word] * n_b + j, return_inverse=True)
        plus = np.bincount(inverse, extra[word] * strength, len(key))
        found = np.bincount(inverse, weight[word] * strength, len(key)) + plus
        keys.append(key)
        shares.append(found / np.maximum(bag[key // n_b] + plus, 1e-9))
        begin = stop
    return np.concatenate(keys), np.concatenate(shares)


def align(bitext: Bitext, there: pa.Table | None, back: pa.Table | None, *, sure: float = 0.6, part: float = 0.3, least: float = 1.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the sentences of both sides that say the same, or one a part of the other.

    Both directions are retrieved and intersected: pairs that are each other's best. Then sentences left over join the
    pair of a neighbouring sentence, or one that holds them nearly whole.
    """
    a, b = bitext.a, bitext.b
    n_a, n_b = max(1, len(a.pair)), max(1, len(b.pair))
    key, share = retrieved(bitext, a, b, Translations(bitext, there))
    other, other_share = retrieved(bitext, b, a, Translations(bitext, back))
    other = other % n_a * n_b + other // n_a
    every = np.union1d(key, other)
    ab, ba = np.zeros(len(every)), np.zeros(len(every))
    ab[np.searchsorted(every, key)] = share
    ba[np.searchsorted(every, other)] = other_share
    i, j = every // n_b, every % n_b
    score, low = np.round(ab + ba, 9), np.minimum(ab, ba)

    def top(of: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """The place of each sentence's best, the first of equals; -1 for a sentence without any."""
        out = np.full(n, -1)
        order = np.lexsort((-np.arange(len(of)), value, of))
        out[of[order]] = order  # the last one written is the best
        return out

    best_a, best_b = top(i, score, n_a), top(j, score, n_b)
    good = (np.maximum(ab, ba) >= sure) & (low >= part) & (score >= least)
    mutual = np.flatnonzero(good & (best_a[i] == np.arange(len(i))) & (best_b[j] == np.arange(len(j))))
    partner_a, partner_b = np.full(n_a, -2), np.full(n_b, -2)
    partner_a[i[mutual]], partner_b[j[mutual]] = j[mutual], i[mutual]
    out = [mutual]
    for mine, own, held, holder, value, n in ((i, partner_a, j, partner_b, ab, n_a), (j, partner_b, i, partner_a, ba, n_b)):
        at = top(mine, np.round(value, 9), n)
        at = at[(at >= 0) & (own == -2)]
        beside = (holder[held[at]] >= 0) & (np.abs(holder[held[at]] - mine[at]) == 1)
        fits = (value[at] >= np.where(beside, sure, 0.8)) & (low[at] >= 0.15) & ((holder[held[at]] >= 0) | (score[at] >= least))
        out.append(at[fits])
    at = np.unique(np.concatenate(out))
    return i[at], j[at], score[at] / 2


def _crossed(bitext: Bitext, i: np.ndarray, j: np.ndarray, block: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of a, word of b, times) of the words, without numbers, of paired sentences; -1 stands for any word."""

    def runs(side: Side, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        use = ~bitext.number[side.word]
        word, sent = side.word[use], side.sent[use]
        n = len(side.pair)
        flat = np.concatenate([word, np.full(n, -1)])
        order = np.argsort(np.concatenate([sent, np.arange(n)]), kind="stable")
        count = np.bincount(sent, minlength=n) + 1
        return flat[order], (np.cumsum(count) - count)[of], count[of]

    wa, first_a, n_a = runs(bitext.a, i)
    wb, first_b, n_b = runs(bitext.b, j)
    size = len(bitext.names) + 1
    ends = np.cumsum(n_a * n_b)
    codes, counts, begin = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], 0
    while begin < len(i):  # in blocks, however long the sentences are
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + block, "right")))
        own = slice(begin, stop)
        pair, cell = _ragged(np.zeros(stop - begin, dtype=np.int64), (n_a * n_b)[own])
        code, times = np.unique((wa[first_a[own][pair] + cell // n_b[own][pair]] + 1) * size + wb[first_b[own][pair] + cell % n_b[own][pair]] + 1, return_counts=True)
        codes.append(code)
        counts.append(times)
        begin = stop
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code // size - 1, code % size - 1, np.bincount(inverse, np.concatenate(counts), len(code)).astype(np.int64)


COUNTS = "lang_a string, lang_b string, word_a string, word_b string, n bigint"
PAIRS = "part bigint, text_id_a bigint, lang_a string, body_a string, text_id_b bigint, lang_b string, body_b string"
#: Pairs of texts whose sentences are scored together, and whose word pairs are counted together.
TOGETHER = 4_000


def _counted(of: Iterator[tuple[str, str, Bitext, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for la, lb, bitext, i, j in of:
        wa, wb, n = _crossed(bitext, i, j)
        names = pa.concat_arrays([pa.nulls(1, pa.string()), bitext.names])
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(la, len(n)), pa.repeat(lb, len(n)), names.take(pa.array(wa + 1)), names.take(pa.array(wb + 1)), pa.array(n, pa.int64())], names=["lang_a", "lang_b", "word_a", "word_b", "n"]
        )


def _groups(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[str, str, pa.Table]]:
    """Rows of pairs in groups of equal languages, TOGETHER at most."""
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    langs = table.group_by(["lang_a", "lang_b"]).aggregate([])
    for la, lb in zip(langs.column("lang_a").to_pylist(), langs.column("lang_b").to_pylist()):
        own = table.filter(pc.and_(pc.equal(table.column("lang_a"), la), pc.equal(table.column("lang_b"), lb)))
        for at in range(0, own.num_rows, TOGETHER):
            yield la, lb, own.slice(at, TOGETHER)


def _bitext(rows: pa.Table) -> Bitext:
    return Bitext(*(rows.column(c).combine_chunks() for c in ("body_a", "body_b")))


def _summed(rows: DataFrame) -> DataFrame:
    return cut(rows.groupBy("lang_a", "lang_b", "word_a", "word_b").agg(F.sum("n").alias("n")))


def anchored_counts(pairs: DataFrame) -> DataFrame:
    """Rows (lang_a, lang_b, word_a, word_b, n) of words in sentences anchored by numbers; a null word stands for any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for la, lb, rows in _groups(batch):
                bitext = _bitext(rows)
                yield from _counted([(la, lb, bitext, *bitext.anchored())])

    return _summed(pairs.select(*[x.split()[0] for x in PAIRS.split(", ")]).mapInArrow(count, COUNTS))


def aligned_counts(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """anchored_counts of the sentences that the translations of the pairs' parts align."""

    def count(pairs_: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        for la, lb, rows in _groups(pairs_):
            bitext = _bitext(rows)
            i, j, _ = align(bitext, *_directions(known, la, lb), sure=0.4, part=0.1, least=0.7)
            out += _counted([(la, lb, bitext, i, j)])
        return pa.Table.from_batches(out)

    return _summed(pairs.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(count, COUNTS))


def _directions(known: pa.Table, la: str, lb: str) -> tuple[pa.Table, pa.Table]:
    return known.filter(pc.equal(known.column("of"), la)), known.filter(pc.equal(known.column("of"), lb))


def vocabularies(pairs: DataFrame) -> DataFrame:
    """Distinct (part, of, to, word): the words that each part of the pairs asks translations for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for part in pc.unique(batch.column("part")).to_pylist():
                for la, lb, rows in _groups(table.filter(pc.equal(table.column("part"), part))):
                    bitext = _bitext(rows)
                    for side, of, to in ((bitext.a, la, lb), (bitext.b, lb, la)):
                        used = np.unique(side.word)
                        names = bitext.names.take(pa.array(used[~bitext.number[used]]))
                        yield pa.RecordBatch.from_arrays([pa.repeat(part, len(names)).cast(pa.int64()), pa.repeat(of, len(names)), pa.repeat(to, len(names)), names], names=["part", "of", "to", "word"])

    return pairs.select(*[x.split()[0] for x in PAIRS.split(", ")]).mapInArrow(run, "part bigint, of string, to string, word string").distinct()


def translation_table(counts: DataFrame, *, best: int = 5, least: float = 0.1) -> DataFrame:
    """Rows (of, to, word, means, weight, strength) in both directions, of all words.

    The strength of a translation is its Dice coefficient, relative to the word's best; a word's weight falls with its
    frequency. A word keeps its `best` translations of a Dice coefficient of `least`.
    """
    total = counts.filter("word_a is null and word_b is null").select("lang_a", "lang_b", F.col("n").alias("total"))
    one = counts.filter("word_a is not null and word_b is null").select("lang_a", "lang_b", "word_a", F.col("n").alias("n_a"))
    two = counts.filter("word_a is null and word_b is not null").select("lang_a", "lang_b", "word_b", F.col("n").alias("n_b"))
    both = counts.filter("word_a is not null and word_b is not null").join(one, ["lang_a", "lang_b", "word_a"]).join(two, ["lang_a", "lang_b", "word_b"])
    # One row for each pair of languages.
    both = both.withColumn("dice", 2 * F.col("n") / (F.col("n_a") + F.col("n_b"))).filter(F.col("dice") >= least).join(F.broadcast(total), ["lang_a", "lang_b"])
    ways = F.array(
        *[
            F.struct(F.col(f"lang_{x}").alias("of"), F.col(f"lang_{y}").alias("to"), F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("means"), F.col(f"n_{x}").alias("n_word"))
            for x, y in (("a", "b"), ("b", "a"))
        ]
    )
    own = Window.partitionBy("of", "to", "word")
    return (
        both.select(F.explode(ways).alias("way"), "total", "dice")
        .select("way.*", "total", "dice")
        .withColumn("k", F.row_number().over(own.orderBy(F.desc("dice"), "means")))
        .filter(F.col("k") <= best)
        .select("of", "to", "word", "means", (F.log((F.col("total") + 1) / F.col("n_word")) + 0.1).alias("weight"), (F.col("dice") / F.max("dice").over(own)).alias("strength"))
    )


def aligned_sentences(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Rows (text_id_a, sent_a, text_id_b, sent_b, score) of all pairs of texts, smaller text_id first; sentences from 0."""
    schema = "text_id_a bigint, sent_a int, text_id_b bigint, sent_b int, score double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(pairs_: pa.Table, known: pa.Table) -> pa.Table:
        out: list[pa.RecordBatch] = []
        for la, lb, rows in _groups(pairs_):
            bitext = _bitext(rows)
            i, j, score = align(bitext, *_directions(known, la, lb))
            ia, ib = (rows.column(c).to_numpy()[side.pair[x]] for c, side, x in (("text_id_a", bitext.a, i), ("text_id_b", bitext.b, j)))
            sa, sb = bitext.a.place[i].astype(np.int32), bitext.b.place[j].astype(np.int32)
            up = ia < ib
            cols = [np.where(up, ia, ib), np.where(up, sa, sb), np.where(up, ib, ia), np.where(up, sb, sa), score]
            out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names))
        return pa.Table.from_batches(out)

    return pairs.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(run, schema)


def align_texts(texts: DataFrame, topics: DataFrame, model: LanguageModel, *, part_pairs: int = 1_000) -> DataFrame:
    """aligned_sentences of texts (topic_id, text_id, text) of topics (topic_id), the table of translations learned from all
    of them.

    Null, empty and letterless texts have no sentence to pair; repeated deliveries give equal rows, which are dropped; texts of one language in
    one topic are no pair. A topic without a second language gives no row. The table stays distributed: pairs of equal
    languages form parts of some part_pairs pairs, and each part meets the translations of its own words only.
    """
    rows = cut(tokenised(texts, topics, model))
    pairs = bilingual_pairs(compacted(rows, formulas(rows)))
    # Pairs of languages together, so that equal word pairs meet before the shuffle; split as they grow.
    of = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each of LANGUAGES
    parts = F.lit(1)
    for la, lb in combinations(sorted(of), 2):
        parts = F.when((F.col("lang_a") == la) & (F.col("lang_b") == lb), 1 + of[la] * of[lb] // sum(of.values()) // part_pairs).otherwise(parts)
    part = F.xxhash64("lang_a", "lang_b", F.pmod(F.xxhash64("text_id_a"), parts))
    pairs = cut(pairs.withColumn("part", part).repartition("part"))
    asked = cut(vocabularies(pairs))

    def of_parts(counts: DataFrame) -> DataFrame:
        return asked.join(translation_table(counts), ["of", "to", "word"]).select("part", "of", "word", "means", "weight", "strength")

    # The second table also knows the words of sentences without numbers.
    counts = aligned_counts(pairs, of_parts(anchored_counts(pairs)))
    return aligned_sentences(pairs, of_parts(counts)).distinct()
