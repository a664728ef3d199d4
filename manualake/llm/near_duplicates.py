"""Near-duplicate records by SetSketch (problem 5).

A record's set of word shingles is sketched into registers: exponentially spaced truncated minima, which merge by
maximum and agree with a probability that grows with the Jaccard similarity. Bands of registers propose pairs of
classes of equal sets; the joint likelihood of the registers' order estimates the similarity of a pair, and the exact
similarity of those that it does not rule out decides.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut
from .canonical import hash64, table_form
from .scan_noise import Bloom, bloom

WORD = re.compile(r"[^\W_]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct runs of `size` words of texts; words are maximal runs of letters and digits, case ignored."""

    def __init__(self, size: int):
        self.size = size
        self._hash: dict[str, int] = {}

    def word_hashes(self, text: str) -> list[int]:
        known, out = self._hash, []
        for w in WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                if len(known) > 500_000:
                    known.clear()
                h = known[w] = hash64(w) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    def shingles(self, words: list[int]) -> np.ndarray:
        """Sorted distinct hashes of runs of words; fewer words make one shingle of them all, none make none."""
        h = np.array(words, dtype=np.uint64)
        return np.unique(self._rolled(h, min(self.size, len(h)))) if len(h) else h

    def batch(self, docs: list[list[int]]) -> list[np.ndarray]:
        """shingles of each document, made for all of them at once."""
        long = [i for i, d in enumerate(docs) if len(d) >= self.size]
        out = [self.shingles(d) if len(d) < self.size else np.zeros(0, dtype=np.uint64) for d in docs]
        if long:
            lengths = np.array([len(docs[i]) for i in long])
            words = np.fromiter((w for i in long for w in docs[i]), np.uint64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(long)), lengths)
            own = owner[: len(owner) - self.size + 1]
            whole = own == owner[self.size - 1 :]  # runs within one document
            rolled, own = self._rolled(words, self.size)[whole], own[whole]
            order = np.lexsort((rolled, own))
            rolled, own = rolled[order], own[order]
            fresh = np.ones(len(own), dtype=bool)
            fresh[1:] = (rolled[1:] != rolled[:-1]) | (own[1:] != own[:-1])
            rolled, ends = rolled[fresh], np.cumsum(np.bincount(own[fresh], minlength=len(long)))
            for i, b, e in zip(long, [0, *ends[:-1]], ends):
                out[i] = rolled[b:e]
        return out

    @staticmethod
    def _rolled(h: np.ndarray, k: int) -> np.ndarray:
        rolled = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            rolled = mix(rolled + h[i : len(h) - k + 1 + i])
        return rolled


class SetSketch:
    """m registers K = clip(floor(1 - log_b h), 0, q + 1) of the least h of m exponential hashes of each element at rate a."""

    def __init__(self, m: int, *, b: float = 1.001, a: float = 20.0, q: int = 65_534, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.m, self.b, self.a, self.q = m, b, a, q
        self.factors = rng.integers(1 << 16, 1 << 32, size=m, dtype=np.uint32) | np.uint32(1)

    def registers(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of registers for each set; of an empty set all are 0."""
        out = np.zeros((len(sets), self.m), dtype=np.uint16)
        sizes = np.array([len(s) for s in sets])
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        scale = 1.0 / np.log(self.b)
        flat = (flat >> np.uint64(32)).astype(np.uint32)
        low = np.stack([np.minimum.reduceat(flat * factor, starts) for factor in self.factors], 1)
        # The least of exponential hashes is that of the least uniform one.
        h = -np.log1p(-(low.astype(np.float64) + 0.5) / (1 << 32)) / self.a
        out[full] = np.clip(np.floor(1.0 - np.log(h) * scale), 0, self.q + 1).astype(np.uint16)
        return out

    @staticmethod
    def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The registers of the union."""
        return np.maximum(x, y)

    def jaccard(self, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Joint maximum-likelihood similarity of pairs from their registers and set sizes, by golden-section search."""
        more, less = (ka > kb).sum(1), (ka < kb).sum(1)
        same = self.m - more - less
        u, v = na / (na + nb), nb / (na + nb)
        step = (self.b - 1) / self.b

        def likelihood(j: np.ndarray) -> np.ndarray:
            p = -np.log1p(-np.clip(u - v * j, 0, None) * step) / np.log(self.b)
            n = -np.log1p(-np.clip(v - u * j, 0, None) * step) / np.log(self.b)
            tiny = 1e-12
            return more * np.log(p + tiny) + less * np.log(n + tiny) + same * np.log(np.clip(1 - p - n, tiny, None))

        lo, hi, g = np.zeros(len(u)), np.minimum(u / v, v / u), (np.sqrt(5) - 1) / 2
        for _ in range(40):
            x, y = hi - g * (hi - lo), lo + g * (hi - lo)
            left = likelihood(x) > likelihood(y)
            lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        return (lo + hi) / 2


def _keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of `rows` registers; the band's number is part of it."""
    n, m = registers.shape
    bands = registers.reshape(n, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, i])
    # 40 bits and the band: keys that are equal by chance bring few pairs together, and those do not pass.
    return ((key >> np.uint64(24)) | (np.arange(m // rows, dtype=np.uint64) << np.uint64(40))).view(np.int64)


def _marks(registers: np.ndarray, every: int) -> np.ndarray:
    """Two 64-bit numbers of a class, four bits of each of 32 registers."""
    some = (registers[:, ::every][:, :32] & 15).astype(np.uint64)
    some = np.pad(some, ((0, 0), (0, 32 - some.shape[1]))).reshape(len(some), 2, 16)
    return np.bitwise_or.reduce(some << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def _agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their 32 places two rows of marks agree."""
    d = (x ^ y).view(np.uint64)
    d |= d >> np.uint64(2)
    d |= d >> np.uint64(1)
    return 32 - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)


def near_duplicates(
    docs: DataFrame,
    *,
    shingle: int = 5,
    threshold: float = 0.8,
    least_words: int = 0,
    bands: int = 56,
    rows: int = 5,
    passes: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of docs (id bigint, head string, text string), a record being head, a blank and text in consistent form.

    Gives (pairs, members): pairs (class_a, class_b, similarity) of classes with a Jaccard similarity of their sets of
    `shingle` words of at least threshold, class_a < class_b; members (id, class), where records of equal sets share a
    class. Only texts of at least least_words words take part, and texts of one word at least; a null head adds
    nothing, null texts and ids take no part, repeated ids of equal content count once. Candidates are not capped: a
    pair is missed only if all bands differ, at similarity s with probability (1 - s^rows)^bands, or if its marks of 32
    registers agree in 4.5 standard errors less places than is expected at the threshold (at 0.6, fewer than 8 of 32).
    Bands meet in `passes` parts one after another, so that the rows of one part at a time are on disk.
    """
    sketch = SetSketch(bands * rows)
    same = threshold + (1 - threshold) / 16
    agreed = int(np.ceil(32 * same - 4.5 * np.sqrt(32 * same * (1 - same))))

    def contents(batch: pa.RecordBatch, shingler: Shingler) -> tuple[list[int], list[np.ndarray]]:
        ids, found = [], []
        for i, head, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if i is None or text is None:
                continue
            words = shingler.word_hashes(table_form(text))
            if len(words) < max(1, least_words):
                continue
            ids.append(i)
            found.append(shingler.word_hashes(table_form(head)) + words if head is not None else words)
        return ids, shingler.batch(found)

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each record's class, and once for each class of a batch its marks and the keys of its bands, five bytes each."""
        shingler = Shingler(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                ids, sets = contents(batch.slice(at, 2_000), shingler)
                if not ids:
                    continue
                own = set_hashes(sets)
                _, first = np.unique(own, return_index=True)
                registers = sketch.registers([sets[i] for i in first])
                keys = _keys(registers, rows).view(np.uint8).reshape(len(first), bands, 8)[:, :, :5]
                marks, kept = np.zeros((len(ids), 2), dtype=np.int64), [None] * len(ids)
                marks[first] = _marks(registers, max(1, sketch.m // 32))
                for i, k in zip(first.tolist(), keys):
                    kept[i] = k.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(kept, pa.binary())], names=["id", "class", "m1", "m2", "keys"])

    def banded(part: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = np.zeros((batch.num_rows, len(part), 8), dtype=np.uint8)
                keys[:, :, :5] = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, bands, 5)[:, part]
                key = keys.view(np.int64)[:, :, 0] | (np.array(part, dtype=np.int64) << 40)
                rest = [np.repeat(batch.column(k).to_numpy(), len(part)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *map(pa.array, rest)], names=["key", "x", "m1", "m2"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of classes that share a band key and whose marks agree. The rows come sorted by key, and no more than one
        key's and one batch's are held; a key's classes meet in slices, however many they are."""

        def met(key: np.ndarray, x: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            fresh = np.ones(len(key), dtype=bool)
            fresh[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1])
            key, x, marks = key[fresh], x[fresh], marks[fresh]
            gap = 1
            while gap < len(key):  # each row with the row `gap` places on, as long as any key reaches that far
                at = np.flatnonzero(key[gap:] == key[:-gap])
                if not len(at):
                    break
                for s in range(0, len(at), 100_000):
                    some = at[s : s + 100_000]
                    some = some[_agree(marks[some], marks[some + gap]) >= agreed]
                    pairs = np.unique(np.sort(np.stack([x[some], x[some + gap]], 1), axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
                gap += 1

        key = x = np.zeros(0, dtype=np.int64)
        marks = np.zeros((0, 2), dtype=np.int64)
        for batch in batches:
            keys, xs, m1, m2 = (batch.column(k).to_numpy() for k in range(4))
            key, x, marks = np.concatenate([key, keys]), np.concatenate([x, xs]), np.concatenate([marks, np.stack([m1, m2], 1)])
            last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
            yield from met(key[:last], x[:last], marks[:last])
            key, x, marks = key[last:], x[last:], marks[last:]
        yield from met(key, x, marks)

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            ids, sets = contents(batch, shingler)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(set_hashes(sets), pa.int64()), pa.array([s.view(np.int64).tobytes() for s in sets], pa.binary())], names=["id", "cls", "shingles"]
            )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                sa, sb = ([np.frombuffer(x, dtype=np.uint64) for x in part.column(k).to_pylist()] for k in (2, 3))
                na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
                guess = sketch.jaccard(sketch.registers(sa), sketch.registers(sb), na, nb)
                # Six standard errors below the threshold: the verification decides all that come near.
                keep = np.flatnonzero(guess >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / sketch.m))
                exact = np.array([_jaccard(sa[i], sb[i]) for i in keep])
                keep, exact = (keep[exact >= threshold], exact[exact >= threshold]) if len(keep) else (keep, exact)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(exact, pa.float64())], names=["class_a", "class_b", "similarity"])

    docs = docs.select("id", "head", "text")
    sketches = cut(docs.mapInArrow(drawn, "id bigint, class bigint, m1 bigint, m2 bigint, keys binary"))
    members = cut(sketches.select("id", "class").distinct())
    drawn_once = sketches.filter("keys is not null").select("class", "m1", "m2", "keys")
    found_in = []
    for part in np.array_split(np.arange(bands), min(passes, bands)):
        met = drawn_once.mapInArrow(banded(part.tolist()), "key bigint, x bigint, m1 bigint, m2 bigint").repartition("key").sortWithinPartitions("key", "x")
        found_in.append(cut(met.mapInArrow(meet, "a bigint, b bigint")))
        del met
        gc.collect()  # the part's shuffle files go once nothing names them
        docs.sparkSession.sparkContext._jvm.System.gc()
    pairs = cut(reduce(DataFrame.unionAll, found_in).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen = members.groupBy("class").agg(F.min("id").alias("id")).join(asked, "class", "left_semi")
    # One record of each class that has a candidate is read again; a Bloom filter spares most others the way to the join.
    wanted = bloom(chosen.select(F.col("id").cast("string").alias("word")))

    @pandas_udf("boolean")
    def may_be_chosen(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Bloom(wanted)
        for ids in batches:
            yield pd.Series([i in known for i in ids.astype(str)], dtype=bool)

    near = docs.filter("id is not null").filter(may_be_chosen("id")) if wanted is not None else docs
    features = near.join(chosen.select("id"), "id", "left_semi").mapInArrow(feature, "id bigint, cls bigint, shingles binary")
    features = cut(features.dropDuplicates(["cls"]).select("cls", "shingles"))
    found = (
        pairs.join(features.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(features.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(verify, "class_a bigint, class_b bigint, similarity double")
    )
    return found, members


def set_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A signed 64-bit hash of each set, none of which is empty."""
    if not sets:
        return np.zeros(0, dtype=np.int64)
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    both = np.bitwise_xor.reduceat(mix(flat), starts) + mix(np.add.reduceat(flat, starts) + sizes.astype(np.uint64))
    return both.view(np.int64)


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs (a, b), a < b, of records of one class or of two paired classes. Only where the caller wants each pair."""
    one, two = members.select(F.col("id").alias("x"), "class"), members.select(F.col("id").alias("y"), "class")
    apart = pairs.join(one.withColumnRenamed("class", "class_a"), "class_a").join(two.withColumnRenamed("class", "class_b"), "class_b").select("x", "y")
    within = one.join(two, "class").filter("x < y").select("x", "y")
    return apart.unionAll(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes_with_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per record: its class and the number of other classes linked with it."""
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    return members.join(links, "class", "left").select("id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def section_records(topic: DataFrame, topic_text: DataFrame) -> DataFrame:
    """docs of near_duplicates for topic_text: the topic's title is the head."""
    titles = topic.groupBy("topic_id").agg(F.min("title").alias("head"))
    texts = topic_text.select(F.col("text_id").alias("id"), "topic_id", "text").filter("text is not null")
    return texts.join(titles, "topic_id", "left").select("id", "head", "text")
