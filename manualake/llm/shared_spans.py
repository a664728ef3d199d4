"""Long exact spans shared between records (problem 10).

Every document is cut into non-overlapping blocks of half the span's length: a span of the full length, wherever it
lies, holds one whole block of any document that has it. Each block is indexed under its least gram (a minimiser);
every rolling window of a block's length probes that index under its own least gram, so that a run of windows with one
minimiser is one row. Windows that meet a block of another document are hits.

Hits are extended without pairing the documents of a group. The spans around hits that share a minimiser are taken
together in cells of neighbouring starts: if the text around a whole cell stands elsewhere, all its spans do, and if the
text that its spans have in common does not, none does; only the cells between, at the ends of a repeat, are taken
apart into single spans. Each cell or span names one other document that has it; neighbouring ones of one other
document grow into one exact repeat, whose text is compared with that document's, letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from ..session import cut
from .near_duplicates import mix

#: Fixed odd multipliers of the rolling hashes, and their inverses modulo 2^64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of base and of its inverse below 2^bits."""
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        power = np.full(1 << bits, factor, dtype=np.uint64)
        power[0] = 1
        out.append(np.cumprod(power, dtype=np.uint64))
    return tuple(out)


class Rolling:
    """Polynomial hashes modulo 2^64 of all windows of an array of code points, each code point first mixed."""

    def __init__(self, codes: np.ndarray, base: int, salt: int):
        power, self.inverse = _powers(base, max(16, len(codes).bit_length()))
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(salt)) * power[: len(codes)], out=self.sums[1:])

    def windows(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        return mix((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of all windows of `size` elements: block prefix and suffix minima."""
    n = len(x) - size + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % size, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, size)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[size - 1 : size - 1 + n])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Shelf:
    """Texts one after the other: their code points, and of each text its beginning and its length."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = code_points("".join(texts))
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def starts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, place on the shelf) of all windows of this length within a text."""
        count = np.maximum(self.size - length + 1, 0)
        of = np.repeat(np.arange(len(count)), count)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + self.begin[of]


def shelves(batch: pa.RecordBatch, column: int, *, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, Shelf]]:
    """A batch in slices of some `chars` characters of text, a text of any length in one slice."""
    ends = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + chars, "right")))
        part = batch.slice(begin, stop - begin)
        yield part, Shelf(part.column(column).to_pylist())
        begin = stop


def anchors(shelf: Shelf, span: int, gram: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(text, key) of the blocks, and (text, key, first, last) of the runs of rolling windows with one key."""
    block = span // 2
    if len(shelf.codes) < block:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64)), (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    grams = Rolling(shelf.codes, _BASES[0], 1).windows(np.arange(len(shelf.codes) - gram + 1), gram)
    of, at = shelf.starts(block)
    least = sliding_min(grams, block - gram + 1)[at]  # of each window of a block's length
    at -= shelf.begin[of]
    fixed = np.flatnonzero(at % block == 0)
    cuts = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (of[1:] != of[:-1])])) if len(at) else at
    ends = np.concatenate([cuts[1:], [len(at)]])[: len(cuts)] - 1
    return (of[fixed], least[fixed]), (of[cuts], least[cuts], at[cuts], at[ends])


def _between(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the closed intervals, which are sorted and apart."""
    sizes = ends - starts + 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(total[-1]) - np.repeat(total[:-1] - starts, sizes)


def merge(starts: np.ndarray, ends: np.ndarray, touch: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Closed intervals joined where they overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1] + touch])
    at = np.flatnonzero(first)
    return starts[at], np.concatenate([ends[at[1:] - 1], ends[-1:]])


def minimisers(codes: np.ndarray, span: int, gram: int) -> np.ndarray:
    """Of each span the place of its least gram, the first of equals: it depends on the span's own characters only."""
    grams = Rolling(codes, _BASES[0], 1).windows(np.arange(len(codes) - gram + 1), gram)
    placed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(placed, span - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Cells:
    """Cells of the spans that start at places `at` (ascending) of the texts `of`: those with one minimiser, at `m`, and
    `width` neighbouring distances from it. Cells of equal text lie alike around it in every document."""

    def __init__(self, shelf: Shelf, of: np.ndarray, at: np.ndarray, span: int, gram: int, width: int):
        m = minimisers(shelf.codes, span, gram)[at]
        k = (m - at) // width
        cuts = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1)]))
        self.of, self.m, k = of[cuts], m[cuts], k[cuts]
        self.first, self.last = at[cuts], at[np.concatenate([cuts[1:], [len(at)]]) - 1]
        near, far = k * width, np.minimum(k * width + width, span - gram + 1) - 1
        #: What all spans of the cell have in common, and the text around all of them, where the document has it.
        self.core = self.m - near, span - far + near
        begin, end = self.m - far, self.m - near + span
        low, high = np.maximum(begin, shelf.begin[self.of]), np.minimum(end, shelf.begin[self.of] + shelf.size[self.of])
        self.around = low, high - low
        #: The minimiser's place in it, and how much of it the document lacks at either end: only cells that agree in these are compared.
        self.shape = ((low - begin) << 40) + ((end - high) << 20) + k + 1


def _lists(column: pa.Array, *fields: str) -> list[np.ndarray]:
    """Of a column of lists of structs the row of each struct, and its fields."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column)
    return [np.repeat(np.arange(len(sizes)), sizes), *(pc.struct_field(flat, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)]


def _starts(shelf: Shelf, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place on the shelf) of all starts in the closed intervals of the texts, ascending, each once."""
    keep = lo <= hi
    row, lo, hi = row[keep], lo[keep], hi[keep]
    lo, hi = merge(lo + shelf.begin[row], hi + shelf.begin[row])
    at = _between(lo, hi)
    return np.searchsorted(shelf.begin, at, "right") - 1, at


def _grouped_max(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Running maxima of x within ascending groups; x is not negative."""
    if not len(x):
        return x
    step = int(x.max()) + 1
    rank = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    return np.maximum.accumulate(rank * step + x) - rank * step


def _hashes(codes: np.ndarray) -> tuple[Rolling, Rolling]:
    return tuple(Rolling(codes, base, salt) for base, salt in zip(_BASES, (2, 3)))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def shared_spans(docs: DataFrame, *, span: int = 400, gram: int = 128, width: int = 39) -> DataFrame:
    """Rows (doc_id, span_start, span_chars): the maximal stretches of each docs.text (doc_id bigint, text string) of
    which every piece of `span` characters stands, character for character, in at least one other document.

    Positions count code points from 0. Null, empty and short texts give no row, nor do repeats within one document.
    A doc_id that comes twice with equal texts is one document. gram, the length of the minimisers, and width, the
    number of spans of a cell, set how much passes the index and how many rows extend a hit, not what is found. Groups
    of any size cost rows in proportion to their texts: documents never meet in pairs.
    """
    block = span // 2
    if not 0 < gram <= block:
        raise ValueError("gram must lie between 1 and half the span")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shelf in shelves(batch, 1):
                doc = part.column(0).to_numpy()
                (of, key), (run, keys, first, last) = anchors(shelf, span, gram)
                none = np.full(len(of), -1)
                cols = [np.concatenate([key, keys]).view(np.int64), doc[np.concatenate([of, run])], *(np.concatenate([none, x]).astype(np.int32) for x in (first, last))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "doc", "first", "last"])

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of the spans around a document's hits, with 128-bit hashes of their common and surrounding texts."""
        for batch in batches:
            for part, shelf in shelves(batch, 1):
                row, first, last = _lists(part.column(2), "first", "last")
                # A span that holds the window at w starts from w - block to w.
                lo, hi = np.maximum(first - (span - block), 0), np.minimum(last, shelf.size[row] - span)
                of, at = _starts(shelf, row, lo, hi)
                if not len(at):
                    continue
                c = Cells(shelf, of, at, span, gram, width)
                one, two = _hashes(shelf.codes)
                cols = [_int64(h.windows(*c.core)) for h in (one, two)] + [_int64(mix(h.windows(*c.around) + mix(c.shape.astype(np.uint64)))) for h in (one, two)]
                places = [_int64(x - shelf.begin[c.of]) for x in (c.m, c.first, c.last)]
                yield pa.RecordBatch.from_arrays([*cols, part.column(0).take(pa.array(c.of)), *places], names=[x.split()[0] for x in CELLS.split(", ")])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the spans of the cells that are taken apart."""
        for batch in batches:
            for part, shelf in shelves(batch, 1):
                row, first, last = _lists(part.column(2), "first", "last")
                of, at = _starts(shelf, row, first, np.minimum(last, shelf.size[row] - span))
                hashes = [_int64(h.windows(at, span)) for h in _hashes(shelf.codes)]
                yield pa.RecordBatch.from_arrays([*hashes, part.column(0).take(pa.array(of)), _int64(at - shelf.begin[of])], names=["h1", "h2", "doc", "at"])

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Repeats (doc, other, first, there, own): neighbouring evidence of one other document as one, with its text."""
        for batch in batches:
            row, other, shift, first, last = _lists(batch.column(2), "other", "shift", "first", "last")
            order = np.lexsort((first, shift, other, row))
            row, other, shift, first, last = (x[order] for x in (row, other, shift, first, last))
            ends = last + span
            # Evidence of one document and shift, in order, whose texts overlap or touch.
            group = np.cumsum(np.concatenate([[0], (row[1:] != row[:-1]) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])])) if len(row) else row
            far = _grouped_max(group, ends)
            cuts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (first[1:] > far[:-1])])) if len(row) else row
            stop = far[np.concatenate([cuts[1:], [len(row)]])[: len(cuts)] - 1]
            row, other, shift, first = (x[cuts] for x in (row, other, shift, first))
            texts = batch.column(1).to_pylist()
            own = [texts[r][b:e] for r, b, e in zip(row.tolist(), first.tolist(), stop.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(_int64, (other, first, first + shift)), pa.array(own, pa.string())], names=["doc", "other", "first", "there", "own"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The repeats whose text the other document really has."""
        for batch in batches:
            own, text, there = (batch.column(k).to_pylist() for k in (2, 3, 4))
            keep = pa.array([t.startswith(o, at) for o, t, at in zip(own, text, there)], pa.bool_())
            last = pa.array([f + len(o) - 1 for f, o in zip(batch.column(1).to_pylist(), own)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), last], names=["doc", "first", "last"]).filter(keep)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, first, last = _lists(batch.column(1), "first", "last")
            order = np.lexsort((first, row))
            row, first, last = row[order], first[order], last[order]
            far = _grouped_max(row, last)
            cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] > far[:-1] + 1)])) if len(row) else row
            stop = far[np.concatenate([cuts[1:], [len(row)]])[: len(cuts)] - 1]
            cols = [batch.column(0).take(pa.array(row[cuts])), pa.array(first[cuts].astype(np.int32)), pa.array((stop - first[cuts] + 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "span_start", "span_chars"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text")
    long = docs.filter((F.length("text") >= span) & F.col("doc").isNotNull())
    rows = cut(long.mapInArrow(index, "key bigint, doc bigint, first int, last int"))
    blocks = rows.filter("first = -1").groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    hits = rows.filter("first >= 0").join(blocks, "key").filter("low <> doc or high <> doc")
    # A document holds at most as many hits as it has characters.
    hits = hits.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("hits"))
    hit = cut(long.join(hits, "doc").select("doc", "text", "hits"))
    texts = hit.select("doc", "text").dropDuplicates(["doc"])
    cells = cut(hit.mapInArrow(celled, CELLS))
    judged = cells.join(_twice(cells, ["s1", "s2"], "m"), ["s1", "s2"], "left")
    judged = cut(judged.select("c1", "c2", "doc", "m", "first", "last", _other("m").alias("seen")))
    # Every document of a group of cells of which one is to be taken apart takes its own apart.
    apart = judged.groupBy("c1", "c2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.bool_or(F.col("seen").isNull()).alias("some")).filter("low <> high and some")
    parts = judged.join(apart.select("c1", "c2"), ["c1", "c2"], "left_semi").groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("parts"))
    spans = cut(texts.join(parts, "doc").select("doc", "text", "parts").mapInArrow(single, "h1 bigint, h2 bigint, doc bigint, at bigint"))
    spans = spans.join(_twice(spans, ["h1", "h2"], "at"), ["h1", "h2"]).select("doc", F.col("at").alias("first"), F.col("at").alias("last"), _other("at").alias("seen"), F.col("at").alias("m"))
    evidence = judged.filter("seen is not null").select("doc", "first", "last", "seen", "m").unionAll(spans)
    evidence = evidence.select("doc", F.struct("first", "last", F.col("seen.doc").alias("other"), (F.col("seen.at") - F.col("m")).alias("shift")).alias("e")).groupBy("doc").agg(F.collect_list("e").alias("e"))
    repeats = texts.join(evidence, "doc").select("doc", "text", "e").mapInArrow(grown, "doc bigint, other bigint, first bigint, there bigint, own string")
    # Many documents may name one other: its text is repeated for each salt.
    repeats = salted_join(repeats, texts.select(F.col("doc").alias("other"), "text"), ["other"], "inner", salts=8)
    checked = repeats.select("doc", "first", "own", "text", "there").mapInArrow(same, "doc bigint, first bigint, last bigint")
    return checked.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("parts")).mapInArrow(stretch, "doc_id bigint, span_start int, span_chars int")


CELLS = "c1 bigint, c2 bigint, s1 bigint, s2 bigint, doc bigint, m bigint, first bigint, last bigint"


def _twice(rows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Groups that stand in two documents, with the first and the last of their places (doc, at)."""
    place = F.struct("doc", F.col(at).alias("at"))
    return rows.groupBy(*by).agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low.doc <> high.doc")


def _other(at: str) -> Column:
    """A place of the group in another document than the row's own; null without a group."""
    return F.when(F.col("low.doc") != F.col("doc"), F.col("low")).otherwise(F.col("high"))


def shared_share(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each document how many of its characters stand elsewhere too."""
    total = spans.groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"), F.count("*").alias("n_spans"))
    sizes = docs.select("doc_id", F.length("text").alias("chars")).dropDuplicates(["doc_id"])
    return sizes.join(total, "doc_id", "left").select(
        "doc_id", "chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans")
    )
