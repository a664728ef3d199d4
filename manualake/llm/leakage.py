"""Evaluation texts inside training text (problem 9).

Each shard of the training text becomes an FM-index over words: the Burrows-Wheeler transform of its word numbers in a
wavelet matrix, whose ranks drive a backward search of all test phrases at once, and sampled suffix positions that
locate the occurrences. Overlapping occurrences merge into spans to remove.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


class WaveletMatrix:
    """Ranks of symbols below 2^bits: one bit vector for each bit, the highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        s = symbols
        for k in range(bits - 1, -1, -1):
            bit = (s >> k) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
            self.levels.append(ones)
            self.zeros.append(len(s) - int(ones[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros_like(at)
        for ones, zeros in zip(self.levels, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling until all ranks differ; the last symbol must be the least and unique."""
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(len(symbols), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], symbols[order[1:]] != symbols[order[:-1]]]))
    step = 1
    while rank.max() < len(symbols) - 1:
        key = rank * (len(symbols) + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], key[order[1:]] != key[order[:-1]]]))
        step *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Counts and locates phrases of symbols >= 1 in a sequence of them."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.tree = WaveletMatrix(bwt, max(1, int(alphabet).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))])
        self.sampled = sa % sample == 0
        self.number = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (a row), found backwards."""
        lo, hi = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.size, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            c = phrases[live, k]
            lo[live], hi[live] = self.before[c] + self.tree.rank(c, lo[live]), self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in the sequence: walk back to a sampled one."""
        out, steps, live, at = np.zeros(len(rows), dtype=np.int64), 0, np.arange(len(rows)), rows
        while len(live):
            known = self.sampled[at]
            out[live[known]] = self.positions[self.number[at[known]]] + steps
            live, at = live[~known], at[~known]
            if len(live):
                c = self.tree.access(at)
                at = self.before[c] + self.tree.rank(c, at)
            steps += 1
        return out


class Phrases:
    """All runs of `words` words of the test items, as numbers of a vocabulary that begins at 2."""

    def __init__(self, items: list[tuple[int, str]], words: int):
        self.numbers: dict[str, int] = {}
        known: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 2) for w in WORD.findall(text.lower())]
            for k in range(len(seq) - words + 1):
                known.setdefault(tuple(seq[k : k + words]), set()).add(item)
        self.rows = np.array(list(known), dtype=np.int64).reshape(len(known), words)
        owners = [sorted(x) for x in known.values()]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.items = np.array([i for x in owners for i in x], dtype=np.int64)


def leaked_passages(docs: DataFrame, items: DataFrame, *, words: int = 12, shard_words: int = 400_000, block_chars: int = 20_000_000) -> DataFrame:
    """Rows (doc_id, item_id, span_start, span_chars): the stretches of docs (doc_id, text) in which at least `words`
    consecutive words of an item (item_id, text) stand in order without a gap.

    Words are maximal runs of letters and digits, case ignored; all that stands between them is ignored. Positions
    count code points; overlapping or touching occurrences of one item are one stretch. Null or shorter texts and items
    give no row. Items are searched in blocks of at most block_chars characters, so what is sent to the executors is
    bounded whatever the size of the test set.
    """
    items = items.select(F.col("item_id").cast("bigint"), "text").filter("item_id is not null and text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_chars))
    out = None
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        found = _search(docs, Phrases([(r.item_id, r.text) for r in part], words), words, shard_words)
        out = found if out is None else out.unionAll(found)
    return out


def _search(docs: DataFrame, phrases: Phrases, words: int, shard_words: int) -> DataFrame:
    numbers, names = phrases.numbers, ["doc_id", "item_id", "span_start", "span_chars"]

    def empty() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())], names=names)

    def search(runs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(r[1]) + 1 for r in runs])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        index = FMIndex(np.concatenate([np.append(r[1], 1) for r in runs]), len(numbers) + 1)
        lo, hi = index.search(phrases.rows)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return empty()
        rows = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        place = index.locate(rows)
        run = np.searchsorted(begins, place, side="right") - 1
        at = place - begins[run]
        doc = np.array([r[0] for r in runs], dtype=np.int64)[run]
        start = np.array([runs[r][2][a] for r, a in zip(run, at)], dtype=np.int64)
        end = np.array([runs[r][3][a + words - 1] for r, a in zip(run, at)], dtype=np.int64)
        owners = phrases.first[which + 1] - phrases.first[which]
        each = np.repeat(np.arange(len(which)), owners)
        item = phrases.items[np.arange(len(each)) - np.repeat(np.cumsum(owners) - owners, owners) + phrases.first[which[each]]]
        doc, start, end = doc[each], start[each], end[each]
        order = np.lexsort((start, item, doc))
        doc, item, start, end = doc[order], item[order], start[order], end[order]
        # Ends grow with starts, all occurrences being of equally many words of one text.
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
        cols = [pa.array(doc[first]), pa.array(item[first]), pa.array(start[first].astype(np.int32)), pa.array((end[last] - start[first]).astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = text.lower()
                if len(low) != len(text):  # lower case changed the length of a letter: keep the places of the text
                    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
                found = np.array([numbers.get(w, 1) for w in WORD.findall(low)], dtype=np.int64)
                # Only runs of known words can hold a phrase; the shard's sequence is made of those.
                known = np.concatenate([[0], (found > 1).astype(np.int8), [0]])
                edges = np.flatnonzero(np.diff(known))
                begin, stop = edges[::2], edges[1::2]
                long = stop - begin >= words
                if not long.any():
                    continue
                spans = np.array([m.span() for m in WORD.finditer(low)], dtype=np.int64)
                for b, e in zip(begin[long], stop[long]):
                    runs.append((doc, found[b:e], spans[b:e, 0], spans[b:e, 1]))
                    held += int(e - b) + 1
                if held >= shard_words:
                    yield search(runs)
                    runs, held = [], 0
        if runs:
            yield search(runs)

    if not len(phrases.rows):
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, span_start int, span_chars int")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(scan, "doc_id bigint, item_id bigint, span_start int, span_chars int")
