"""Languages of documents and of their segments (problem 4).

Hierarchical discrimination: linear classifiers first tell the language family of a sentence, then one-versus-one linear
support vector machines separate the languages of that family. All are linear in features that are sums over words,
so a word is scored once and a sentence is a sum of its words' scores. A Viterbi pass over the sentences of a text
gives its segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.units import smallest_hashes
from ..session import cut
from .canonical import table_form
from .scan_noise import Layout, brand_words, header_residues, statistics, with_headers

#: The languages of the corpus by family.
FAMILIES: dict[str, tuple[str, ...]] = {"west germanic": ("de", "en", "nl"), "north germanic": ("da",), "romance": ("fr",)}
LANGUAGES = tuple(sorted(x for langs in FAMILIES.values() for x in langs))
END = re.compile(r"[.!?](?=\s|$)")
LETTERS = re.compile(r"[^\W\d_]+")
BROKEN = re.compile(r"(?<=\w)[-¬‐‑][^\S\n]*\r?\n[^\S\n]*(?=\w)")


Segment = tuple[int, int, int, str, float]


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences: each ends at . ! or ? before white space or the end of the text."""
    out, b = [], 0
    for e in [*(m.end() for m in END.finditer(text)), len(text)]:
        piece = text[b:e]
        bare = piece.lstrip()
        if bare:
            out.append((e - len(bare), e))
        b = e
    return out


def words(text: str) -> list[str]:
    """Lower-case words of letters, those broken over a line end joined."""
    return LETTERS.findall((BROKEN.sub("", text) if "\n" in text else text).lower())


def normal_label(c: Column) -> Column:
    """The language that a label names, without case and region; null for a missing one or a placeholder."""
    first = F.split(F.lower(F.trim(c)), "[-_]").getItem(0)
    return F.when(first.rlike("^[a-z]{2,3}$") & ~first.isin("und", "mul", "zxx", "mis", "nan", "na"), first)


def word_features(word: str, dim: int) -> np.ndarray:
    """Hashed features of a word: itself and its character runs of one to four, its ends marked."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)}
    return np.array([xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % dim for g in grams], dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class _Sparse:
    """Sentences as means of words, words as sums of features."""

    def __init__(self, word: np.ndarray, row: np.ndarray, value: np.ndarray, n: int, feature: np.ndarray, owner: np.ndarray, n_words: int, dim: int):
        self.word, self.row, self.value, self.n = word, row, value, n
        self.feature, self.owner, self.n_words, self.dim = feature, owner, n_words, dim

    def margins(self, w: np.ndarray) -> np.ndarray:
        of_word = np.bincount(self.owner, w[self.feature], self.n_words)
        return np.bincount(self.row, of_word[self.word] * self.value, self.n)

    def pulls(self, pull: np.ndarray) -> np.ndarray:
        on_word = np.bincount(self.word, pull[self.row] * self.value, self.n_words)
        return np.bincount(self.feature, on_word[self.owner], self.dim)


class LanguageModel:
    """Scores of words under each classifier: the families one against the rest, then each pair of a family's languages."""

    def __init__(self, dim: int = 1 << 15):
        self.dim = dim
        self.families = list(FAMILIES)
        self.pairs = [(a, b) for langs in FAMILIES.values() for a, b in combinations(langs, 2)]
        n = len(self.families) + len(self.pairs)
        self.weights, self.bias, self.scale = np.zeros((dim, n), dtype=np.float32), np.zeros(n), np.full(n, 4.0)
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def word(self, w: str) -> np.ndarray:
        s = self._known.get(w)
        if s is None:
            if len(self._known) > 200_000:
                self._known.clear()
            s = self._known[w] = self.weights[word_features(w, self.dim)].sum(0)
        return s

    def margins(self, ws: list[str]) -> np.ndarray:
        return np.mean([self.word(w) for w in ws], axis=0) + self.bias

    def log_probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Calibrated log probabilities of LANGUAGES: that of the family times that of the language within it."""
        z = margins * self.scale
        k = len(self.families)
        fam = _sigmoid(z[..., :k]) + 1e-9
        fam /= fam.sum(-1, keepdims=True)
        out = np.empty((*margins.shape[:-1], len(LANGUAGES)))
        for f, langs in enumerate(FAMILIES.values()):
            votes = {x: np.full(margins.shape[:-1], 1.0) for x in langs}
            for j, (a, b) in enumerate(self.pairs):
                if a in langs:
                    p = _sigmoid(z[..., k + j])
                    votes[a] = votes[a] * p
                    votes[b] = votes[b] * (1 - p)
            total = sum(votes.values())
            for x in langs:
                out[..., LANGUAGES.index(x)] = np.log(fam[..., f] * votes[x] / total + 1e-12)
        return out

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], *, dim: int = 1 << 15, rounds: int = 60, seed: int = 5) -> LanguageModel:
        """Fit on sentences with the labels of their texts; those that a first fit contradicts are left out of the second.
        A fifth of the sentences only calibrates."""
        model = cls(dim)
        known: dict[str, int] = {}
        word_of, row_of, values, labels, n = [], [], [], [], 0
        for lang, text in rows:
            for b, e in sentences(text):
                ws = words(text[b:e])
                if len(ws) < 3:
                    continue
                word_of += [known.setdefault(w, len(known)) for w in ws]
                row_of += [n] * len(ws)
                values += [1.0 / len(ws)] * len(ws)
                labels.append(lang)
                n += 1
        if not n:
            return model
        feats = [word_features(w, dim) for w in known]
        # A sentence is a mean of words, a word a sum of features: two sparse maps instead of one much larger.
        data = _Sparse(
            np.array(word_of), np.array(row_of), np.array(values), n,
            np.concatenate(feats), np.repeat(np.arange(len(feats)), [len(f) for f in feats]), len(feats), dim,
        )
        y = np.array(labels)
        family = {x: f for f, langs in FAMILIES.items() for x in langs}
        fam = np.array([family[x] for x in y])
        held = np.random.default_rng(seed).random(n) < 0.2
        clean = np.ones(n, dtype=bool)
        for turn in range(2):
            for j in range(model.weights.shape[1]):
                if j < len(model.families):
                    sign = np.where(fam == model.families[j], 1.0, -1.0)
                    use = clean & ~held
                else:
                    a, b = model.pairs[j - len(model.families)]
                    sign = np.where(y == a, 1.0, -1.0)
                    use = clean & ~held & ((y == a) | (y == b))
                model._svm(j, data, sign, use, rounds)
            margins = np.stack([data.margins(model.weights[:, j].astype(np.float64)) for j in range(model.weights.shape[1])], 1) + model.bias
            best = np.array(LANGUAGES)[model.log_probabilities(margins).argmax(1)]
            clean = best == y
        model._calibrate(margins, y, fam, held & clean)
        return model

    def _svm(self, j: int, data: _Sparse, sign: np.ndarray, use: np.ndarray, rounds: int) -> None:
        """Squared-hinge support vector machine by gradient descent with momentum, the classes weighing the same."""
        pos, neg = (use & (sign > 0)).sum(), (use & (sign < 0)).sum()
        if not pos or not neg:
            self.bias[j] = 1.0 if pos else -1.0
            return
        weight = np.where(use, np.where(sign > 0, 0.5 / pos, 0.5 / neg), 0.0)
        w, b, vw, vb = np.zeros(self.dim), 0.0, np.zeros(self.dim), 0.0
        for _ in range(rounds):
            slack = np.maximum(0.0, 1.0 - sign * (data.margins(w) + b))
            pull = 2 * weight * slack * sign
            vw, vb = 0.9 * vw + data.pulls(pull) - 1e-4 * w, 0.9 * vb + pull.sum()
            w, b = w + 0.5 * vw, b + 0.1 * vb
        self.weights[:, j], self.bias[j] = w, b

    def _calibrate(self, margins: np.ndarray, y: np.ndarray, fam: np.ndarray, held: np.ndarray) -> None:
        """The slope of each classifier's sigmoid: the most likely one on held-out sentences."""
        for j in range(margins.shape[1]):
            if j < len(self.families):
                use, up = held, fam == self.families[j]
            else:
                a, b = self.pairs[j - len(self.families)]
                use, up = held & ((y == a) | (y == b)), y == a
            if use.any():
                m, s = margins[use, j], np.where(up[use], 1.0, -1.0)
                grid = np.geomspace(1, 64, 13)
                self.scale[j] = grid[int(np.argmax([np.log(_sigmoid(g * m * s) + 1e-9).mean() for g in grid]))]

    def segments(self, text: str, *, switch: float = 3.0) -> list[Segment]:
        return self.batch_segments([text], switch=switch)[0]

    def batch_segments(self, texts: list[str], *, switch: float = 3.0) -> list[list[Segment]]:
        """Of each text (start, end, sentences, language, confidence) of the maximal runs of sentences of one language.

        Only sentences with letters count; a number of a list goes with its entry. Changing the language costs `switch`
        in log probability, so that a sentence without words of its own goes with its neighbours. Texts without letters
        have no segment.
        """
        places = [sentences(t) for t in texts]
        counts, found = [], []
        for t, at in zip(texts, places):
            for b, e in at:
                ws = words(t[b:e])
                counts.append(len(ws))
                found += ws
        if not found:
            return [[] for _ in texts]
        names = {w: i for i, w in enumerate(dict.fromkeys(found))}
        scores = np.stack([self.word(w) for w in names])
        n = np.array(counts)
        full = np.flatnonzero(n)
        starts = np.cumsum(n[full]) - n[full]
        sums = np.add.reduceat(scores[np.fromiter((names[w] for w in found), np.int64, len(found))], starts, axis=0)
        # The evidence of a sentence grows with its words, up to six, and is bounded: names of other languages occur.
        grid = np.zeros((len(n), len(LANGUAGES)))
        grid[full] = np.maximum(self.log_probabilities(sums / n[full, None] + self.bias), -8.0) * (np.minimum(n[full], 6) / 6)[:, None]
        best, out, k = grid.argmax(1), [], 0
        for at in places:
            own = slice(k, k + len(at))
            k += len(at)
            letters = n[own] > 0
            if not letters.any():
                out.append([])
                continue
            first = best[own][letters]
            path = np.full(len(at), first[0]) if (first == first[0]).all() else _viterbi(grid[own], switch)
            out.append(_runs(at, path, letters, grid[own]))
        return out

    def batch_languages(self, texts: list[str]) -> list[str | None]:
        """The language of each whole text; none of one without letters."""
        each = [words(t) for t in texts]
        full = [i for i, ws in enumerate(each) if ws]
        out: list[str | None] = [None] * len(texts)
        if full:
            names = {w: i for i, w in enumerate(dict.fromkeys(w for ws in each for w in ws))}
            scores = np.stack([self.word(w) for w in names])
            n = np.array([len(each[i]) for i in full])
            sums = np.add.reduceat(scores[[names[w] for i in full for w in each[i]]], np.cumsum(n) - n, axis=0)
            for i, k in zip(full, self.log_probabilities(sums / n[:, None] + self.bias).argmax(1)):
                out[i] = LANGUAGES[k]
        return out


def laid_out(texts: DataFrame, product: DataFrame, *, header_bound: int = 100_000) -> tuple[DataFrame, Layout]:
    """texts (text_id, ...) with their running headers, which say nothing about the language of what they interrupt."""
    brands = brand_words(product)
    # Only texts of several lines have edge lines.
    headers = header_residues(cut(statistics(texts.filter(F.col("text").rlike("[\\r\\n]")), brands)))
    rows, shared = with_headers(texts, ["text_id"], brands, headers, bound=header_bound)
    return rows, Layout(brands, shared)


def clean(text: str, layout: Layout, headers: list[str] | None = None) -> str:
    """The consistent form of a text without its edge lines."""
    text = table_form(text)
    return "\n".join(layout.of(headers).read(text)[0]) if "\n" in text or "\r" in text else text


def _viterbi(grid: np.ndarray, switch: float) -> np.ndarray:
    k = grid.shape[1]
    total, back = grid[0], np.zeros(grid.shape, dtype=np.int64)
    for i in range(1, len(grid)):
        best = int(total.argmax())
        moved = total[best] - switch
        back[i] = np.where(total >= moved, np.arange(k), best)
        total = np.maximum(total, moved) + grid[i]
    path = np.empty(len(grid), dtype=np.int64)
    path[-1] = total.argmax()
    for i in range(len(grid) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _runs(at: list[tuple[int, int]], path: np.ndarray, letters: np.ndarray, grid: np.ndarray) -> list[Segment]:
    if (path == path[0]).all():
        inner = grid.sum(0)
        return [(at[0][0], at[-1][1], int(letters.sum()), LANGUAGES[path[0]], float(1.0 / np.exp(inner - inner[path[0]]).sum()))]
    out = []
    first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
    for b, e in zip(first, [*first[1:], len(path)]):
        inner = grid[b:e].sum(0)
        inner = np.exp(inner - inner.max())
        out.append((at[b][0], at[e - 1][1], int(letters[b:e].sum()), LANGUAGES[path[b]], float(inner[path[b]] / inner.sum())))
    return out


def _headers(texts: DataFrame) -> Column:
    return F.col("headers") if "headers" in texts.columns else F.lit(None).cast("array<string>")


def fit_language_model(texts: DataFrame, layout: Layout, *, sample_bound: int = 6_000) -> LanguageModel:
    """Fit on the sample_bound labelled texts of texts (text_id, lang, text) whose ids have the least hashes."""
    known = texts.select("text_id", normal_label(F.col("lang")).alias("lang"), "text", _headers(texts).alias("headers")).filter(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 0))
    rows = smallest_hashes(known, F.struct("text_id", "text"), sample_bound).select("lang", "text", "headers").collect()
    return LanguageModel.fit([(r.lang, clean(r.text, layout, r.headers)) for r in rows])


SEGMENTS = "text_id bigint, segment int, start int, chars int, n_sentences int, language string, confidence double, label string, n_segments int"


def language_segments(texts: DataFrame, model: LanguageModel, layout: Layout) -> DataFrame:
    """One row for each segment of each text of texts (text_id, lang, text), with its language and confidence.

    label is the language that lang names, null where it is missing. Null, blank and letterless texts give no row.
    Places count the code points of the text's consistent form without edge lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            texts_ = [clean(t, layout, own) for t, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            for text_id, label, segs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), model.batch_segments(texts_)):
                out += [(text_id, i, b, e - b, n, lang, round(conf, 6), label, len(segs)) for i, (b, e, n, lang, conf) in enumerate(segs)]
            cols = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    rows = texts.select("text_id", normal_label(F.col("lang")).alias("label"), "text", _headers(texts).alias("headers")).filter("text is not null")
    return rows.mapInArrow(run, SEGMENTS)


def wrong_labels(segments: DataFrame) -> DataFrame:
    """Distinct (text_id, lang) of the texts whose label is missing or not the text's language, or that mix languages:
    each language of at least two sentences or of the whole text. Repeated deliveries, whose segments are equal, count once."""
    by_lang = (
        segments.dropDuplicates(["text_id", "segment"])
        .groupBy("text_id", F.coalesce("label", F.lit("")).alias("label"), "n_segments", "language")
        .agg(F.sum("n_sentences").alias("n"))
        .filter((F.col("n") >= 2) | (F.col("n_segments") == 1))
        .filter((F.col("n_segments") > 1) | (F.col("label") != F.col("language")))
    )
    return by_lang.select("text_id", F.col("language").alias("lang")).distinct()
