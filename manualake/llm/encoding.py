"""Encoding of texts with a public byte-level BPE tokenizer (problem 8).

A text is a product of a monoid: its halves are encoded recursively, and two neighbours are joined by encoding again a
window around their boundary. Pre-tokens never share tokens, and the scan for them needs no context to its left and at
most two characters to its right; so all tokens before the last start that lies three characters before the boundary
stand, and once the window meets a start of the right neighbour, all tokens from there on stand. The window grows until
it does. Decoding concatenates the bytes of the parts.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer
from tokenizers.processors import ByteLevel

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters that the scan may look at beyond the start of a pre-token: an apostrophe and two letters.
LOOKAHEAD = 3


class Part(NamedTuple):
    """A stretch of a text: its pre-tokens' starts, the number of tokens before each, and the tokens."""

    begin: int
    end: int
    starts: list[int]
    before: list[int]
    ids: list[int]


class TreeEncoder:
    """Encodes texts as products of leaves of at most `leaf` characters; windows begin with `window` characters."""

    def __init__(self, model: str, *, leaf: int = 256, window: int = 32):
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.tokenizer.post_processor = ByteLevel(trim_offsets=False)  # pre-tokens begin where their blank does
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.leaf, self.window = max(1, leaf), max(1, window)

    @staticmethod
    def part(begin: int, end: int, encoded: Encoding) -> Part:
        """The encoding of text[begin:end] on its own."""
        words = np.array(encoded.word_ids, dtype=np.int64)
        before = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])) if len(words) else words
        offsets = encoded.offsets
        return Part(begin, end, [begin + offsets[k][0] for k in before.tolist()], before.tolist(), encoded.ids)

    def scan(self, text: str, begin: int, end: int) -> Part:
        return self.part(begin, end, self.tokenizer.encode(text[begin:end], add_special_tokens=False))

    def join(self, text: str, a: Part, b: Part) -> Part:
        """The encoding of a followed by b, which touch."""
        k = bisect_right(a.starts, a.end - LOOKAHEAD) - 1  # the last start that surely stands
        left = a.starts[k] if k >= 0 else a.begin
        k = max(k, 0)
        size = self.window
        while True:
            stop = min(b.begin + size, b.end)
            middle = self.scan(text, left, stop)
            firm = stop if stop == b.end else stop - LOOKAHEAD
            for i in range(bisect_left(middle.starts, b.begin), len(middle.starts)):
                at = middle.starts[i]
                if at > firm:
                    break
                j = bisect_left(b.starts, at)
                if j < len(b.starts) and b.starts[j] == at:
                    head, mid, cut = a.before[k] if a.starts else 0, middle.before[i], b.before[j]
                    return Part(
                        a.begin, b.end,
                        a.starts[:k] + middle.starts[:i] + b.starts[j:],
                        a.before[:k] + [head + n for n in middle.before[:i]] + [head + mid + n - cut for n in b.before[j:]],
                        a.ids[:head] + middle.ids[:mid] + b.ids[cut:],
                    )
            if stop == b.end:
                head = a.before[k] if a.starts else 0
                return Part(a.begin, b.end, a.starts[:k] + middle.starts, a.before[:k] + [head + n for n in middle.before], a.ids[:head] + middle.ids)
            size *= 2

    def tree(self, text: str, begin: int, end: int, leaves: Iterator[Part] | None = None) -> Part:
        """The encoding of text[begin:end]: that of its halves, joined. leaves are those of leaf_ends, in order."""
        if end - begin <= self.leaf:
            return next(leaves) if leaves is not None else self.scan(text, begin, end)
        middle = (begin + end) // 2
        left = self.tree(text, begin, middle, leaves)
        return self.join(text, left, self.tree(text, middle, end, leaves))

    def leaf_ends(self, begin: int, end: int) -> list[tuple[int, int]]:
        if end - begin <= self.leaf:
            return [(begin, end)]
        middle = (begin + end) // 2
        return self.leaf_ends(begin, middle) + self.leaf_ends(middle, end)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text. The leaves of all texts are encoded together."""
        ends = [self.leaf_ends(0, len(t)) for t in texts]
        pieces = [t[b:e] for t, own in zip(texts, ends) for b, e in own]
        encoded = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        places = [x for own in ends for x in own]
        leaves = (self.part(b, e, x) for (b, e), x in zip(places, encoded))
        return [self.tree(t, 0, len(t), leaves).ids for t in texts]


class TreeDecoder:
    """Bytes of tokens; a list's bytes are those of its halves, concatenated."""

    def __init__(self, model: str):
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}
        vocabulary = Tokenizer.from_str(model).get_vocab(with_added_tokens=False)
        self.bytes = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items() if all(c in byte for c in token)}

    def tree(self, ids: list[int], begin: int, end: int) -> bytes:
        if end - begin <= 4_096:
            return b"".join(self.bytes[i] for i in ids[begin:end])
        middle = (begin + end) // 2
        return self.tree(ids, begin, middle) + self.tree(ids, middle, end)

    def decode(self, ids: list[int]) -> str:
        return self.tree(ids, 0, len(ids)).decode("utf-8", "surrogatepass")


def _model(path: str) -> str:
    """The vocabulary file's text: read by the driver, a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, *, path: str = TOKENIZER, leaf: int = 256) -> DataFrame:
    """Rows (doc_id, ids array<int>) of docs (doc_id, text), without special tokens.

    The ids of an empty and of a null text are the empty list. Every row of docs gives a row, repeated ones too.
    """
    model = docs.sparkSession.sparkContext.broadcast(_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = TreeEncoder(model.value, leaf=leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, path: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); a null list gives a null text."""
    model = encoded.sparkSession.sparkContext.broadcast(_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = TreeDecoder(model.value)
        for batch in batches:
            texts = [None if ids is None else decoder.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
