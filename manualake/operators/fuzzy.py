"""Matching of text as a camera reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from ..functions.text import near, ocr_key, plain_key
from ..session import cut


def occurrence_distance(needle: str, haystack: str) -> int:
    """The least edit distance of needle to any stretch of haystack: each row of the table by a prefix minimum."""
    if not needle:
        return 0
    hay = np.frombuffer(haystack.encode("utf-32-le"), dtype=np.uint32)
    at = np.arange(len(hay) + 1)
    row = np.zeros(len(hay) + 1, dtype=np.int64)
    for c in map(ord, needle):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (hay != c))
        row = np.minimum.accumulate(step - at) + at
    return int(row.min())


def occurrence_distances(needles: list[str], haystacks: list[str]) -> list[int]:
    """occurrence_distance of pairs: those of needles of one length share the table's rows, haystacks being padded."""
    out = [0] * len(needles)
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(needles):
        by_length.setdefault(len(n), []).append(i)
    for size, every in by_length.items():
        every.sort(key=lambda i: len(haystacks[i]))
        for at in range(0, len(every), 128) if size else ():
            ids = every[at : at + 128]
            width = max(1, len(haystacks[ids[-1]]))
            # No character is 0: what is padded matches nothing, and so never helps.
            hay = np.zeros((len(ids), width), dtype=np.uint32)
            for r, i in enumerate(ids):
                codes = np.frombuffer(haystacks[i].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                hay[r, : len(codes)] = codes
            need = np.array([[ord(c) for c in needles[i]] for i in ids], dtype=np.uint32)
            place = np.arange(width + 1, dtype=np.int32)
            row = np.zeros((len(ids), width + 1), dtype=np.int32)
            for k in range(size):
                step = row + 1
                np.minimum(step[:, 1:], row[:, :-1] + (hay != need[:, k : k + 1]), out=step[:, 1:])
                step -= place
                row = np.minimum.accumulate(step, axis=1) + place
            for i, least in zip(ids, row.min(1).tolist()):
                out[i] = least
    return out


@pandas_udf(T.IntegerType())
def occurrence_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """occurrence_distance of two columns; null where either is."""
    for needles, haystacks in batches:
        n, h = needles.tolist(), haystacks.tolist()
        whole = [i for i in range(len(n)) if isinstance(n[i], str) and isinstance(h[i], str)]
        out: list[int | None] = [None] * len(n)
        for i, d in zip(whole, occurrence_distances([n[i] for i in whole], [h[i] for i in whole])):
            out[i] = d
        yield pd.Series(out, dtype="Int32")


def number_tokens(text: Column) -> Column:
    """The distinct tokens of a text, in upper case, that may be part numbers: five to nineteen letters, digits, points and
    hyphens, a letter or digit first."""
    return F.filter(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"([0-9A-Z][0-9A-Z.\-]{3,18})"), 1)), lambda x: F.length(x) >= 5)


def scan_numbers(lines: DataFrame, parts: DataFrame, *, machine: str | None = None) -> DataFrame:
    """Tokens of lines (frame, line) that read as part numbers: an equi-join on the confusion-folded key.

    Rows (frame, token, part_nr, confidence): 100 where any part of that key has the token as its number, case aside,
    else 80. Of the parts (part_nr, and machine and ord where they have them) of a key the first of the given machine is
    named, else the first."""
    tokens = lines.select("frame", F.explode(number_tokens(F.col("line"))).alias("token")).distinct().withColumn("_k", ocr_key(F.col("token")))
    given = [c for c in ("machine", "ord") if c in parts.columns]
    known = parts.select("part_nr", *given).filter("part_nr is not null and part_nr <> ''").withColumn("_k", ocr_key(F.col("part_nr")))
    other = F.coalesce(F.col("machine") != machine, F.lit(True)) if "machine" in given and machine else F.lit(False)
    order = F.struct(other.alias("o"), *([F.col("ord")] if "ord" in given else []), F.col("part_nr"))
    by_key = known.groupBy("_k").agg(F.min_by("part_nr", order).alias("part_nr"), F.collect_set(F.upper("part_nr")).alias("_all"))
    found = tokens.join(by_key, "_k").withColumn("confidence", F.when(F.array_contains("_all", F.col("token")), 100).otherwise(80))
    return found.select("frame", "token", "part_nr", "confidence")


def budget(key: str) -> int:
    """The edits that a phrase of ten letters may carry."""
    return max(2, len(key) // 8)


def even_pieces(keys: list[str]) -> list[list[tuple[int, int]]]:
    """Of each key of ten letters or more, one piece (begin, end) more than its budget has edits, all about as long."""
    out: list[list[tuple[int, int]]] = []
    for key in keys:
        n = budget(key) + 1
        cuts = [len(key) * x // n for x in range(n + 1)]
        out.append(list(zip(cuts, cuts[1:])) if len(key) >= 10 else [])
    return out


def rare_pieces(keys: list[str], texts: list[str], *, shortest: int = 2, longest: int = 16) -> list[list[tuple[int, int]]]:
    """Like even_pieces, but those that occur least in some texts, by a table over the key's places; what lies between two
    is left out. The texts decide about time alone: any such pieces find every phrase."""
    flat, given = PhraseScanner.codes("".join(keys)).astype(np.uint64), PhraseScanner.codes("\n".join(texts)).astype(np.uint64)
    # How often each stretch of each key occurs in the texts, by its length and begin; few stretches share a hash of 22 bits.
    odd, times = np.uint64(0x9E3779B97F4A7C15), np.zeros((longest + 1, len(flat)), dtype=np.float32)
    own, other = np.zeros(len(flat), dtype=np.uint64), np.zeros(len(given), dtype=np.uint64)
    for size in range(1, min(longest, len(flat)) + 1):
        own = own[: len(flat) - size + 1] * odd + flat[size - 1 :]
        other = other[: max(0, len(given) - size + 1)] * odd + given[size - 1 :]
        if size >= shortest:
            there = np.bincount(((other * odd) >> np.uint64(42)).astype(np.int64), minlength=1 << 22)
            times[size, : len(own)] = there[((own * odd) >> np.uint64(42)).astype(np.int64)]
    lengths = np.array([len(k) for k in keys], dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    out: list[list[tuple[int, int]]] = [[] for _ in keys]
    sizes = np.arange(shortest, longest + 1)
    for m in np.unique(lengths[lengths >= 10]).tolist():
        every = np.flatnonzero(lengths == m)
        begin = np.arange(m + 1)[:, None] - sizes[None, :]
        for at in range(0, len(every), 2_000):
            ids = every[at : at + 2_000]
            # cost[i, e, s]: what a piece of the s-th size that ends at e costs, a little for itself.
            cost = times[sizes[None, None, :], first[ids][:, None, None] + np.maximum(begin, 0)] + np.float32(0.02)
            cost[:, begin < 0] = np.inf
            least, took, rows = np.zeros((len(ids), m + 1), dtype=np.float32), [], np.arange(len(ids))
            for _ in range(budget("x" * m) + 1):
                each = least[:, np.maximum(begin, 0)] + cost
                size = each.argmin(2)
                best = np.take_along_axis(each, size[:, :, None], 2)[:, :, 0]
                least = np.minimum.accumulate(best, axis=1)
                # The last place up to here at which a piece ends that reaches the least.
                end = np.maximum.accumulate(np.where(best == least, np.arange(m + 1), 0), axis=1)
                took.append((end, sizes[size]))
            place = np.full(len(ids), m)
            for end, size in reversed(took):
                e = end[rows, place]
                place = e - size[rows, e]
                for i, b, x in zip(ids.tolist(), place.tolist(), e.tolist()):
                    out[i].append((b, x))
    return out


class PhraseScanner:
    """Finds keys (lower-case ASCII letters, digits and blanks) in texts of the same kind, exactly or within their budget.

    Lossless: of a key one piece more is looked for than its budget has edits, so that one piece stands in the text as it
    is. The stretch around each such piece that the key can fill is asked for the key's pairs of letters, of which an edit
    spoils two at most; the distance is taken in what is left. Where exact ones alone are asked for (exact), a key is one
    piece. Other pieces than even ones (begin, end) may be given."""

    ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
    CODE = np.zeros(128, dtype=np.uint8)
    CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET)) + 1
    #: The last level of the table of pairs: a stretch is two entries of a level, so up to 128 pairs; longer ones are not asked.
    LEVEL = 6
    #: Letters of texts that are scanned at a time, for the table of their pairs, and stretches around pieces, for their arrays.
    #: A longer text is scanned in windows that overlap by all that a key can fill.
    LETTERS, STRETCHES = 200_000, 250_000

    #: The last scanner that a worker made, with its name.
    KEPT: dict[str, PhraseScanner] = {}

    @classmethod
    def kept(cls, name: str, make: Callable[[], PhraseScanner]) -> PhraseScanner:
        """The scanner of a block of phrases, made once by a worker for all its tasks in a row."""
        if name not in cls.KEPT:
            cls.KEPT.clear()
            cls.KEPT[name] = make()
        return cls.KEPT[name]

    @classmethod
    def codes(cls, text: str) -> np.ndarray:
        """The number of each letter, from 1; 0 for what is no letter."""
        return cls.CODE[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]

    @staticmethod
    def pairs(codes: np.ndarray) -> np.ndarray:
        """Each letter and the next as one of 128 bits, in two words."""
        h = ((codes[:-1].astype(np.uint32) * 38 + codes[1:]) * np.uint32(2654435761)) >> np.uint32(25)
        out = np.zeros((len(h), 2), dtype=np.uint64)
        out[np.arange(len(h)), h >> 6] = np.uint64(1) << (h & 63).astype(np.uint64)
        return out

    def __init__(self, keys: list[str], *, exact: bool = False, pieces: list[list[tuple[int, int]]] | None = None):
        self.keys, self.exact = keys, exact
        if exact:
            self.pieces = ahocorasick.Automaton()
            for i, key in enumerate(keys):
                self.pieces.add_word(key, i)
            if keys:
                self.pieces.make_automaton()
            return
        owners: dict[str, list[tuple[int, int]]] = {}
        for i, (key, own) in enumerate(zip(keys, even_pieces(keys) if pieces is None else pieces)):
            for b, e in own:
                owners.setdefault(key[b:e], []).append((i, b))
        number = {key: i for i, key in enumerate(keys)}
        words = list(owners | number)
        # One pass over a text finds all pieces and all whole keys in it.
        self.words = ahocorasick.Automaton()
        for n, x in enumerate(words):
            self.words.add_word(x, n)
        if words:
            self.words.make_automaton()
        self.word_size = np.array([len(x) for x in words], dtype=np.int64)
        self.whole = np.array([number.get(x, -1) for x in words], dtype=np.int64)
        self.count = np.array([len(owners.get(x, ())) for x in words], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.owner = np.array([i for x in owners.values() for i, _ in x], dtype=np.int64)
        self.offset = np.array([b for x in owners.values() for _, b in x], dtype=np.int64)
        self.size = np.array([len(k) for k in keys], dtype=np.int64)
        self.edits = np.array([budget(k) for k in keys], dtype=np.int64)
        self.reach = int((self.size + self.edits).max(initial=0))
        # The pairs of letters of each key and of each quarter of it, and the stretch that holds them if they are intact.
        flat, begin = self.codes("".join(keys)), np.cumsum(self.size) - self.size
        owner = np.repeat(np.arange(len(keys)), self.size)
        place = np.arange(len(flat)) - begin[owner]
        inside = np.flatnonzero(place[1:] > 0)
        pairs = self.pairs(flat)[inside]
        quarter = place[inside] * 4 // np.maximum(self.size[owner[inside]] - 1, 1)
        cuts = (np.arange(5)[:, None] * (self.size - 1) + 3) // 4
        self.quarters = [self._stretch(cuts[x], cuts[x + 1], owner[inside][quarter == x], pairs[quarter == x]) for x in range(4)]
        self.all_pairs = self._stretch(cuts[0], cuts[4], owner[inside], pairs)
        # The places of each letter in each key, up to 64, as bits; letter 0 is no letter.
        early = place < 64
        self.bits = np.zeros((len(keys), len(self.ALPHABET) + 1), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (owner[early], flat[early]), np.uint64(1) << place[early].astype(np.uint64))

    def _stretch(self, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each key its pairs from begin to end, as bits, and where the table has those of a stretch in which they stand
        whatever edits there are: its level, and the places of its two entries."""
        bits = np.zeros((len(self.keys), 2), dtype=np.uint64)
        np.bitwise_or.at(bits, owner, pairs)
        fill = end - begin + 2 * self.edits
        level = np.minimum(np.log2(fill).astype(np.int64), self.LEVEL)
        bits[fill > 2 << self.LEVEL] = 0
        return bits, level, begin, begin + np.minimum(fill, 2 << level) - (1 << level)

    def windows(self, text: str) -> list[str]:
        """Stretches of a text, of which one holds whatever a key can be found in."""
        width = max(self.LETTERS, 2 * self.reach)
        return [text] if len(text) <= width else [text[at : at + width] for at in range(0, len(text) - self.reach, width - self.reach)]

    def scan(self, texts: list[str], longest: int | None = None) -> list[tuple[int, int, int]]:
        """Triples (text, key, confidence): 98 where the text contains the key, 92 within its budget of edits (ten
        letters; where longest is given, texts up to that alone)."""
        if self.exact:
            return [(f, k, 98) for f, text in enumerate(texts if self.keys else ()) for k in sorted({k for _, k in self.pieces.iter(text)})]
        best: dict[tuple[int, int], int] = {}
        part: list[tuple[int, str]] = []
        letters = 0

        def read() -> None:
            for x, k, c in self._scan([window for _, window in part]):
                best[part[x][0], k] = max(c, best.get((part[x][0], k), 0))

        for f, text in enumerate(texts if self.keys else ()):
            if longest is not None and len(text) > longest:
                best.update({(f, int(self.whole[n])): 98 for _, n in self.words.iter(text) if self.whole[n] >= 0})
                continue
            for window in self.windows(text):
                if part and letters + len(window) > self.LETTERS:
                    read()
                    part, letters = [], 0
                part.append((f, window))
                letters += len(window) + 1
        if part:
            read()
        return [(f, k, c) for (f, k), c in best.items()]

    def _scan(self, texts: list[str]) -> list[tuple[int, int, int]]:
        n, size = len(self.keys), np.array([len(t) + 1 for t in texts], dtype=np.int64)
        base = np.cumsum(size) - size
        # No piece has what parts two texts: places in all of them are as in one.
        every = "\n".join([*texts, ""])
        found = np.fromiter(chain.from_iterable(self.words.iter(every)), np.int64)
        word, place = found[1::2], found[::2] + 1
        place -= self.word_size[word]
        text = np.repeat(np.arange(len(texts)), size)[place]
        sure = self.whole[word] >= 0
        whole = np.unique(text[sure] * n + self.whole[word[sure]])
        some = self.count[word] > 0
        word, text, place = word[some], text[some], place[some]
        close = np.zeros(0, dtype=np.int64)
        flat = self.codes(every)
        table, sums = self._table(flat), np.cumsum(self.count[word])
        at = 0
        while at < len(word):
            end = max(at + 1, int(np.searchsorted(sums, sums[at] - self.count[word[at]] + self.STRETCHES)))
            key, where, begin = self._asked(word[at:end], text[at:end], place[at:end], table)
            pair = where * n + key
            open_ = ~np.isin(pair, whole) & ~np.isin(pair, close)
            key, where, begin = key[open_], where[open_], begin[open_]
            hit = self._within(key, begin, base[where], (base + size - 1)[where], flat)
            close = np.union1d(close, where[hit] * n + key[hit])
            at = end
        return [(*divmod(p, n), c) for c, ps in ((98, whole), (92, close)) for p in ps.tolist()]

    def _table(self, flat: np.ndarray) -> np.ndarray:
        """Of each level the 2 ** level pairs from each letter on."""
        out = np.empty((self.LEVEL + 1, len(flat) + (1 << self.LEVEL), 2), dtype=np.uint64)
        out[:, len(flat) - 1 :] = 0
        out[0, : len(flat) - 1] = self.pairs(flat)
        for level in range(1, self.LEVEL + 1):
            step = 1 << level - 1
            np.bitwise_or(out[level - 1, : len(flat)], out[level - 1, step : step + len(flat)], out=out[level, : len(flat)])
        return out

    @staticmethod
    def _missing(stretch: tuple[np.ndarray, ...], key: np.ndarray, place: np.ndarray, table: np.ndarray) -> np.ndarray:
        """How many of the pairs that a stretch of the key asks for are not where it would be, the key beginning at place."""
        bits, level, one, other = stretch
        size, rows = table.shape[1], table.reshape(-1, 2)
        # A stretch that begins before all texts may be taken for more than it is, never for less.
        at = level[key] * size
        there = rows.take(at + np.clip(place + one[key], 0, size - 1), axis=0)
        there |= rows.take(at + np.clip(place + other[key], 0, size - 1), axis=0)
        return np.bitwise_count(bits.take(key, axis=0) & ~there) @ np.ones(2, dtype=np.uint8)

    def _asked(self, word: np.ndarray, text: np.ndarray, place: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches (key, text, begin) around pieces that hold enough of the key's pairs of letters; each once."""
        times = self.count[word]
        every = np.repeat(self.first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        key = self.owner[every]
        begin = np.repeat(place, times) - self.offset[every] - self.edits[key]
        left = np.flatnonzero(self._missing(self.all_pairs, key, begin, table) <= 2 * self.edits[key])
        key, begin, text = key[left], begin[left], np.repeat(text, times)[left]
        missing = np.zeros(len(key), dtype=np.int64)
        for x in self.quarters:
            missing += self._missing(x, key, begin, table)
        left = missing <= 2 * self.edits[key]
        x = np.stack([key[left], text[left], begin[left]])
        x = x[:, np.lexsort(x)]
        x = x[:, np.append(True, (x[:, 1:] != x[:, :-1]).any(0))[: x.shape[1]]]
        return x[0], x[1], x[2]

    def _within(self, key: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Whether key occurs within its budget in the stretch from start on of a text from first to last: Myers' bit
        vectors, all pairs at once. Of keys of more than 64 letters their first 64, then the whole of those that are left."""
        if not len(key):
            return np.zeros(0, dtype=bool)
        one, size, edits = np.uint64(1), np.minimum(self.size[key], 64), self.edits[key]
        top = (size - 1).astype(np.uint64)
        up, down = np.full(len(key), ~np.uint64(0)), np.zeros(len(key), dtype=np.uint64)
        score = size.copy()
        least = score.copy()
        # Around a key's own stretch there is no letter, which never helps.
        end = np.minimum(last, start + size + 2 * edits)
        for j in range(int((size + 2 * edits).max())):
            q = start + j
            c = np.where((q >= first) & (q < end), flat[np.clip(q, 0, len(flat) - 1)], 0)
            eq = self.bits[key, c]
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            rise, fall = down | ~(h | up), up & h
            score += ((rise >> top) & one).astype(np.int64) - ((fall >> top) & one).astype(np.int64)
            np.minimum(least, score, out=least)
            rise, fall = rise << one, fall << one
            up, down = fall | ~(v | rise), rise & v
        out = least <= edits
        rows = np.flatnonzero(out & (self.size[key] > 64))
        if len(rows):
            letters = np.array(list("\n" + self.ALPHABET))
            spans = zip(np.maximum(first, start)[rows].tolist(), np.minimum(last, start + self.size[key] + 2 * edits)[rows].tolist())
            around = ["".join(letters[flat[b:e]]) for b, e in spans]
            out[rows] = np.array(occurrence_distances([self.keys[k] for k in key[rows].tolist()], around), dtype=np.int64) <= edits[rows]
        return out


#: Words that say nothing about a message.
STOP = "machine koffiemachine coffee niet the een van voor door worden wordt deze your please with".split()


def long_words(plain: Column, stop: Sequence[str] = ()) -> Column:
    """The distinct words of a plain text that have four letters or more and say something."""
    words = F.array_distinct(F.filter(F.split(plain, " "), lambda x: F.length(x) >= 4))
    return F.array_except(words, F.array(*[F.lit(x) for x in stop])) if stop else words


class BagScanner:
    """Finds bags (lists of word numbers) of which four fifths are among a frame's words. A bag that is found has one of its
    rarest words there, one more than it may miss: only the bags of such words are counted."""

    #: Pairs of a frame and a bag that are counted at a time, for their arrays, and words of frames that are looked up.
    PAIRS, WORDS = 500_000, 1_000_000

    def __init__(self, bags: list[list[int]], n_words: int):
        self.n_words = n_words
        size = np.array([len(b) for b in bags], dtype=np.int64)
        self.need = (4 * size + 4) // 5
        self.words = np.full((len(bags), int(size.max(initial=1))), n_words, dtype=np.int64)  # word n_words is never there
        use = np.bincount([w for b in bags for w in b], minlength=n_words)
        of: list[list[int]] = [[] for _ in range(n_words)]
        for i, b in enumerate(bags):
            self.words[i, : len(b)] = b
            for w in sorted(b, key=lambda w: use[w])[: len(b) - int(self.need[i]) + 1]:
                of[w].append(i)
        self.count = np.array([len(x) for x in of], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.of = np.array([i for x in of for i in x], dtype=np.int64)

    def scan(self, there: list[int]) -> np.ndarray:
        """The bags found among the words that are there."""
        return self.scan_frames(np.zeros(len(there), dtype=np.int64), np.array(there, dtype=np.int64), 1)[1]

    def scan_frames(self, frame: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (frame, bag) of the bags found among the words of n frames."""
        mask = np.zeros((n, self.n_words + 1), dtype=bool)
        mask[frame, word] = True
        frame, word = np.nonzero(mask)
        times = self.count[word]
        # Where each frame's words begin, and the pairs before them.
        begin = np.searchsorted(frame, np.arange(n + 1))
        sums = np.append(0, np.cumsum(times))[begin]
        out, at = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))], 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(sums, sums[at] + self.PAIRS, side="right")) - 1)
            own = slice(begin[at], begin[end])
            out.append(self._count(frame[own], word[own], times[own], mask))
            at = end
        return np.concatenate([f for f, _ in out]), np.concatenate([b for _, b in out])

    def _count(self, frame: np.ndarray, word: np.ndarray, times: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.repeat(self.first[word] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        frame, bag = np.divmod(np.unique(np.repeat(frame, times) * len(self.need) + self.of[every]), max(1, len(self.need)))
        left = mask[frame[:, None], self.words[bag]].sum(1) >= self.need[bag]
        return frame[left], bag[left]


def bag_hits(seen: DataFrame, bags: DataFrame, *, block: int = 50_000) -> DataFrame:
    """Pairs (frame, phrase) of seen (frame, seen array) and bags (phrase, words array): four fifths of a bag of four or more
    words are near some word seen. The bags are sent in blocks of some `block`, with the words that are near theirs."""
    bags = bags.filter(F.size("words") >= 4).distinct()
    each = bags.select(F.explode("words").alias("word")).distinct()
    close = near_words(each, seen.select(F.explode("seen").alias("seen")).distinct())
    schema = T.StructType([seen.schema["frame"], T.StructField("phrase", T.StringType())])

    def reader(phrases: list[str], words: list[list[int]], near_: dict[str, list[int]], n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner, known, names = BagScanner(words, n_words), pa.array(list(near_), pa.string()), pa.array(phrases, pa.string())
            times = np.array([len(x) for x in near_.values()], dtype=np.int64)
            first, close = np.cumsum(times) - times, np.array([w for x in near_.values() for w in x], dtype=np.int64)
            # So many frames at a time as have a table of their words of some ten million places.
            step = max(1, min(500, 10_000_000 // (n_words + 1)))
            for batch in batches:
                size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
                sums, end = np.cumsum(size), 0
                while end < batch.num_rows:
                    at = end
                    end = min(at + step, max(at + 1, int(np.searchsorted(sums, sums[at] - size[at] + scanner.WORDS, side="right"))))
                    part = batch.slice(at, end - at)
                    x = pc.index_in(part.column(1).flatten(), value_set=known)
                    frame = np.repeat(np.arange(part.num_rows), size[at:end])[x.is_valid().to_numpy(zero_copy_only=False)]
                    x = x.drop_null().to_numpy()
                    every = np.repeat(first[x] - (np.cumsum(times[x]) - times[x]), times[x]) + np.arange(times[x].sum())
                    frame, bag = scanner.scan_frames(np.repeat(frame, times[x]), close[every], part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(frame)), names.take(pa.array(bag))], names=["frame", "phrase"])

        return run

    blocks = 1 + bags.count() // block
    if blocks > 1:
        close = cut(close)
    out = seen.sparkSession.createDataFrame([], schema)
    for n in range(blocks):
        own = bags.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == n)
        rows = own.collect()
        if not rows:
            continue
        number = {w: i for i, w in enumerate(sorted({w for r in rows for w in r.words}))}
        near_: dict[str, list[int]] = {}
        for r in (close.join(own.select(F.explode("words").alias("word")).distinct(), "word", "left_semi") if blocks > 1 else close).collect():
            near_.setdefault(r.seen, []).append(number[r.word])
        out = out.unionAll(seen.select("frame", "seen").mapInArrow(reader([r.phrase for r in rows], [[number[w] for w in r.words] for r in rows], near_, len(number)), schema))
    return out


def scan_phrases(frames: DataFrame, phrases: DataFrame, *, least: int = 80, block: int = 50_000) -> DataFrame:
    """Phrases (phrase) in frames (frame, text): rows (frame, phrase, confidence).

    98 where the frame contains the phrase (six letters), 92 where it does within an eighth of its length in edits (ten
    letters), 80 where four fifths of its four or more telling words are nearly there. Frames may have any length and any
    number of words, and no such pair is lost: the first two come from PhraseScanner, to which the phrases are sent in
    blocks of some `block`, cut where they are rare in a few frames; the last from near_words. Only rows with a confidence
    of `least` are looked for."""
    f = frames.select("frame", plain_key(F.col("text")).alias("text")).filter("text is not null")
    p = phrases.select("phrase", plain_key(F.col("phrase")).alias("key")).distinct().filter(F.length("key") >= 6)
    exact = least > 92
    if not exact:
        # The words are made once, for the near ones among them and for the bags.
        f = cut(f if least > 80 else f.withColumn("seen", long_words(F.col("text"))))

    schema = T.StructType([f.schema["frame"], T.StructField("key", T.StringType()), T.StructField("confidence", T.IntegerType())])

    def reader(keys: list[str], pieces: list[list[tuple[int, int]]] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = PhraseScanner.kept(name, lambda: PhraseScanner(keys, exact=exact, pieces=pieces))
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    part = batch.slice(at, 1_000)
                    found = scanner.scan(part.column(1).to_pylist())
                    ids = part.column(0).take(pa.array([x for x, _, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([keys[k] for _, k, _ in found], pa.string()), pa.array([c for _, _, c in found], pa.int32())], names=["frame", "key", "confidence"])

        return run

    # What is looked at decides about time alone: beginnings of some frames do, for the driver's memory.
    some = [] if exact else [r.text for r in f.select(F.substring("text", 1, 4_000).alias("text")).limit(1_000).collect()]
    known = p.select("key").distinct()
    blocks = 1 + known.count() // block
    read = f.sparkSession.createDataFrame([], schema)
    for n in range(blocks):
        keys = sorted(r.key for r in known.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == n).collect())
        read = read.unionAll(f.select("frame", "text").mapInArrow(reader(keys, rare_pieces(keys, some) if some else None), schema)) if keys else read
    read = read.join(p, "key").select("frame", "phrase", "confidence")
    if least > 80:
        return read.filter(F.col("confidence") >= least).groupBy("frame", "phrase").agg(F.max("confidence").alias("confidence"))

    bags = bag_hits(f.select("frame", "seen"), p.select("phrase", long_words(F.col("key"), STOP).alias("words")), block=block).withColumn("confidence", F.lit(80))
    # By frame alone, so that ranks within a frame need no other exchange.
    return read.unionByName(bags).repartition("frame").groupBy("frame", "phrase").agg(F.max("confidence").alias("confidence"))


def deletions(word: Column, most: int) -> Column:
    """The word with up to `most` of its letters left out: words within that many edits share one of them."""
    out = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1, F.length(w))))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def near_words(words: DataFrame, seen: DataFrame) -> DataFrame:
    """Pairs (word, seen) of near words of words (word) and seen (seen), both distinct.

    Words meet through the forms that are left when as many letters go as edits are allowed, two from nine letters on,
    one from six, none below: an equi-join that loses no pair and brings few others together."""

    def keyed(df: DataFrame, c: str) -> DataFrame:
        size = F.length(c)
        two, one = deletions(F.col(c), 2), deletions(F.col(c), 1)
        # A word's own length sets the edits; the other may be up to two letters longer or shorter.
        forms = F.when(size >= (9 if c == "word" else 7), two).when(size >= (6 if c == "word" else 5), one).otherwise(F.array(F.col(c)))
        return df.select(c, F.explode(forms).alias("_k"))

    met = keyed(words, "word").join(keyed(seen, "seen"), "_k").filter(near(F.col("word"), F.col("seen")))
    return met.select("word", "seen").distinct()


def best_hits(hits: DataFrame, *, key: str, least: int, limit: int = 8) -> DataFrame:
    """Of each frame the `limit` best hits of distinct keys with a confidence of least, ties by key."""
    top = hits.filter(F.col("confidence") >= least).groupBy("frame", key).agg(F.max("confidence").alias("confidence"))
    nth = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("confidence"), key))
    return top.withColumn("rank", nth).filter(F.col("rank") <= limit)
