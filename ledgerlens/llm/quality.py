"""Problem 3: text quality statistics, and a Gaussian mixture that tells prose from lists, tables and junk.

Texts are read once: a pass turns every line into a key (for lines that return through a file) and
a few counts. All else works on those counts. The statistics of a chunk are reported as they are. The
mixture works on its segments (runs of lines of one shape), since a chunk may hold prose and a
table; a chunk is what most of its words belong to. Components take their class from labelled rows:
segments of a bounded sample whose statistics leave no doubt (``label``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.lines import MIN_CHUNKS, MIN_SHARE, chunk_totals, count_delta, crossed, with_lines
from ledgerlens.llm.neardup import words_of
from ledgerlens.runtime import stored

CLASSES = ("prose", "list", "table", "junk")
COMPONENTS, ROUNDS, RIDGE = 32, 20, 0.05
#: A statistic that hardly varies is not blown up beyond this.
LEAST_SCALE = 0.03
#: Rows the starting means are chosen from and, where ``label`` knows them, the components' classes; the fit passes over every segment.
SAMPLE_ROWS = 8_192
#: A component's class needs so many labelled rows and such a share of them; else that of the nearest component that has both.
LEAST_LABELS, MARGIN = 3.0, 0.8
#: Components with labelled rows of several classes are split and the fit goes on, so often and with so many rounds.
SPLITS, SPLIT_ROUNDS = 3, 8
FEATURES = ("words_per_unit", "word_length", "symbols", "digit_words", "common", "ends", "distinct", "markers", "cells", "wide_gaps", "long_words", "pairs", "letters", "items")
COMMON = FEATURES.index("common")
#: What is kept of a line; after these come the common words of each language.
FACTS = ("words", "chars", "symbols", "digits", "long", "pairs", "letters", "ends", "marked", "cells", "gaps", "length", "first", "distinct", "again", "shape")
TEXT, ITEM, MARKED, CELLS = range(4)
#: Cells of more words are no cells: the gaps between them are chance.
CELL_WORDS = 8

_MARK = re.compile("^\\s*([-*•–—+]|\\(?[0-9]{1,3}[.)]|\\(?[a-zA-Z][.)])\\s")
_CELL = re.compile("[|;\t]|(?<=\\S) {2,}(?=\\S)|\\S=")
_ENDS = re.compile("[.!?…][\"'”’»)\\]]*\\s*$")
_DIGIT = re.compile("[0-9]")
_SYMBOL = re.compile("[^\\w\\s]")
_GAP = re.compile("(?<=\\S) {2,}(?=\\S)")
_PAIR = re.compile("[\"']?\\w+[\"']?[=:][\"']?\\S")
_LETTER = re.compile("[^\\W\\d_]")


class WordFacts(dict):
    """word -> its facts as fields of one integer, so that a sum over words adds all of them up at once.

    Fields of FIELD bits: characters, symbols, has a digit, is long, is key and value, is a letter, is common
    in each language.
    """

    FIELD = 32

    def __init__(self, common: dict[str, frozenset]):
        self.common = list(common.values())
        self.shifts = [self.FIELD * i for i in range(6 + len(self.common))]

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]|").lower()
        facts = [len(word), len(_SYMBOL.findall(word)), bool(_DIGIT.search(word)), len(word) > 18, bool(_PAIR.match(word)), len(word) == 1 and word.isalpha()]
        facts += [bare in c for c in self.common]
        value = self[word] = sum(int(v) << s for v, s in zip(facts, self.shifts))
        return value

    def totals(self, words: list[str]) -> list[int]:
        total = sum(map(self.__getitem__, words))
        return [(total >> s) & 0xFFFFFFFF for s in self.shifts]


def hash64(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def line_facts(text: str, facts: WordFacts) -> tuple[list[int | None], list[int]]:
    """Of the lines that are not blank: keys (of words in lower case, digits dropped; null where no letter is left), FACTS and common words, flat."""
    keys, flat = [], []
    seen: set[str] = set()
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
    for line in text.split("\n"):
        words = words_of(line) if odd else line.split()
        if not words:
            continue
        tight, form, n = line.strip(), " ".join(words), len(words)
        chars, symbols, digits, long_, pairs, letters, *common = facts.totals(words)
        again = form in seen
        seen.add(form)
        if digits:
            form = " ".join(_DIGIT.sub("", form).split())
        keys.append(hash64(form.lower()) if _LETTER.search(form) else None)
        wide = "  " in tight
        if wide and n >= 3 and 2 * digits < n and "=" not in tight and len(_GAP.findall(tight)) >= 0.6 * (n - 1):
            tight, wide = " ".join(words), False  # every space is wide: no columns
        cells = len(_CELL.findall(tight)) if wide or "|" in tight or ";" in tight or "\t" in tight or "=" in tight else 0
        inner = cells - (cells and tight[-1] == ";")
        gaps = len(_GAP.findall(tight)) if wide else 0
        marked = bool(_MARK.match(line))
        shape = CELLS if inner >= 2 and n <= CELL_WORDS * (inner + 1) else MARKED if marked else ITEM if n <= 9 and len(line) <= 58 and not tight[0].islower() else TEXT
        flat += (n, chars, symbols, digits, long_, pairs, letters, bool(_ENDS.search(tight)), marked, cells, gaps, len(tight), len(words[0]), len(set(words)), again, shape, *common)
    return keys, flat


def segments(shapes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where each segment begins: runs of lines of one owner and one shape; fewer than three items in a row count as text."""
    if not len(shapes):
        return np.empty(0, np.int64)
    begins = np.flatnonzero(np.concatenate(([True], (shapes[1:] != shapes[:-1]) | (owner[1:] != owner[:-1]))))
    size = np.diff(np.append(begins, len(shapes)))
    kind = np.where((shapes[begins] == ITEM) & (size < 3), TEXT, shapes[begins])
    whose = owner[begins]
    return begins[np.concatenate(([True], (kind[1:] != kind[:-1]) | (whose[1:] != whose[:-1])))]


def units(length: np.ndarray, first: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Lines of each segment, counting those that a line width has broken as one: there the next word would not have fitted."""
    n = np.diff(np.append(begins, len(length)))
    seg = np.repeat(np.arange(len(begins)), n)
    width = length[np.lexsort((length, seg))][begins + np.where(n < 10, n - 1, (0.9 * (n - 1)).astype(np.int64))]
    same = seg[1:] == seg[:-1]
    broken = np.bincount(seg[:-1], same & (length[:-1] + 1 + first[1:] > width[seg[:-1]]), len(begins)).astype(np.int64) if len(seg) > 1 else np.zeros(len(begins), np.int64)
    return np.where((n > 1) & (width >= 30) & (broken >= 0.6 * (n - 1)), n - broken, n)


def features(lines: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The statistics of every segment, in the order of FEATURES, from the facts of the lines."""
    k = np.diff(np.append(begins, len(lines)))
    total = np.add.reduceat(lines.astype(np.int64), begins, axis=0)
    fact = dict(zip(FACTS, total.T))
    n, common = np.maximum(1, fact["words"]), total[:, len(FACTS) :]
    return np.stack([
        np.log1p(n / units(lines[:, FACTS.index("length")], lines[:, FACTS.index("first")], begins)), np.minimum(fact["chars"] / n, 20.0), fact["symbols"] / np.maximum(1, fact["chars"]),
        fact["digits"] / n, common.max(axis=1) / n if common.shape[1] else 0.0 * n, fact["ends"] / k, fact["distinct"] / n * (1 - fact["again"] / k), fact["marked"] / k,
        np.minimum(2.0, fact["cells"] / n), np.minimum(2.0, fact["gaps"] / n), fact["long"] / n, fact["pairs"] / n, fact["letters"] / n, np.add.reduceat((lines[:, FACTS.index("shape")] == ITEM).astype(np.int64), begins) / k,
    ], axis=1)


def label(x: np.ndarray, words: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The class (its place in CLASSES) of segments whose statistics leave no doubt, -1 for all others.

    Found by reading segments of every shape in five languages. ``usual`` is the mean share of common
    words in the segment's language.
    """
    f = dict(zip(FEATURES, x.T))
    unit, share = np.expm1(f["words_per_unit"]), f["common"] / np.maximum(usual, 1e-9)
    out = np.full(len(x), -1)
    plain = (f["cells"] < 0.05) & (f["symbols"] < 0.2) & (f["distinct"] > 0.4) & (f["word_length"] < 9)
    spelt = (f["letters"] > 0.5) & (f["digit_words"] < 0.3) & (f["symbols"] < 0.2)
    out[plain & (f["letters"] < 0.3) & (f["digit_words"] < 0.35) & (((unit >= 14) & (share > 0.7)) | ((unit >= 10.5) & (share > 0.9) & (f["markers"] < 0.2))) | spelt] = 0
    entries = plain & (f["letters"] < 0.3) & (f["common"] > 0.01) & (f["digit_words"] < 0.5) & (words >= 20)
    out[entries & (((f["markers"] > 0.9) & (unit <= 9)) | ((f["markers"] < 0.1) & (unit <= 7)))] = 1
    out[(f["cells"] > 0.25) & (f["digit_words"] > 0.2) & (f["symbols"] < 0.3) & (f["distinct"] > 0.4) & (f["word_length"] < 12) & (words >= 12)] = 2
    noise = (f["symbols"] > 0.45) | (f["word_length"] > 14) | (f["distinct"] < 0.25) | ((f["common"] < 0.01) & (f["digit_words"] < 0.15) & (f["cells"] < 0.05) & (f["letters"] < 0.3) & (f["markers"] < 0.1))
    noise |= (f["pairs"] > 0.5) & (f["symbols"] > 0.25)
    noise |= (f["digit_words"] > 0.9) & (f["cells"] < 0.05) & (unit > 5)
    out[noise & (words >= 12)] = 3
    return out


def _common(common_words: DataFrame) -> dict[str, frozenset]:
    """Per language its common words; the table is fixed and small (a few hundred rows)."""
    out: dict[str, set] = {}
    for lang, word in common_words.select("lang", "word").collect():
        if word is not None:
            out.setdefault(lang or "", set()).add(word.lower())
    return {k: frozenset(v) for k, v in out.items()}


def spread_out(x: np.ndarray, means: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """means and more rows of x, k in all, far ones first, as k-means++ does."""
    far = np.min([((x - m) ** 2).sum(axis=1) for m in means], axis=0) if len(means) else np.ones(len(x))
    while len(means) < k:
        means = np.vstack([means, x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[0]])
        far = np.minimum(far if len(means) > 1 else np.inf, ((x - means[-1]) ** 2).sum(axis=1))
    return means


class Mixture:
    """A Gaussian mixture on standardised statistics, fitted by expectation-maximisation over a DataFrame.

    A column of flat lists holds the rows: the statistics, then the place of the row's language. The share of
    common words is standardised within its language. Every round is one pass over all rows: tasks return
    the moments of their rows, Spark adds them up, and the driver sees K * (1 + d + d * d) numbers however
    many rows there are.
    """

    def __init__(self, components: int = COMPONENTS, rounds: int = ROUNDS, ridge: float = RIDGE, seed: int = 5, languages: int = 1):
        self.components, self.rounds, self.ridge, self.seed, self.languages = components, rounds, ridge, seed, max(1, languages)

    def fit(self, rows: DataFrame, sample: np.ndarray, words: np.ndarray | None = None, column: str = "xs") -> Mixture:
        """sample: rows the starting means are chosen from, half of them from rows whose class is known (words: their sizes)."""
        d, n_lang = len(FEATURES), self.languages

        def moments(flat: np.ndarray) -> np.ndarray:
            x, lang = flat[:, :d], flat[:, d].astype(np.int64)
            c = x[:, COMMON]
            return np.concatenate(([len(x)], x.sum(axis=0), (x * x).sum(axis=0), np.bincount(lang, minlength=n_lang), np.bincount(lang, c, n_lang), np.bincount(lang, c * c, n_lang)))

        total = self._sum(rows, column, d + 1, moments, 1 + 2 * d + 3 * n_lang)
        n = max(total[0], 1)
        spread = lambda m, q: np.maximum(np.sqrt(np.maximum(q - m * m, 0)), LEAST_SCALE)
        self.mean, square = total[1 : 1 + d] / n, total[1 + d : 1 + 2 * d] / n
        self.scale = spread(self.mean, square)
        seen, c1, c2 = total[1 + 2 * d :].reshape(3, n_lang)
        # a language with few rows is drawn to the mean of all
        seen, c1, c2 = seen + 50, c1 + 50 * self.mean[COMMON], c2 + 50 * square[COMMON]
        self.usual = c1 / seen
        self.usual_scale = spread(self.usual, c2 / seen)
        if not len(sample):
            self.weights, self.means, self.chols = np.ones(1), np.zeros((1, d)), np.eye(d)[None]
            return self
        x = self.standard(sample)
        rng, k = np.random.default_rng(self.seed), min(self.components, len(x))
        known = self.known(sample, words) if words is not None else np.full(len(x), -1)
        means = np.empty((0, d))
        for own in [x[known == c] for c in range(len(CLASSES))]:
            means = np.vstack([means, spread_out(own, np.empty((0, d)), min(k // (2 * len(CLASSES)), len(own)), rng)])
        means = spread_out(x, means, k, rng)
        self.weights, self.means, self.chols = np.full(k, 1 / k), means, np.repeat(np.eye(d)[None] * 0.7, k, axis=0)
        self._rounds(rows, column, n, self.rounds)
        for _ in range(SPLITS if words is not None else 0):
            if not self._split(x, known):
                break
            self._rounds(rows, column, n, SPLIT_ROUNDS)
        return self

    def _rounds(self, rows: DataFrame, column: str, n: float, rounds: int) -> None:
        d = len(FEATURES)
        upper = np.triu_indices(d)
        last = -np.inf
        for _ in range(rounds):
            mixture, k = self.frozen(), len(self.means)

            def expected(flat: np.ndarray) -> np.ndarray:
                p, r, ll = mixture(flat)
                return np.append((r.T @ p).ravel(), ll.sum())

            total = self._sum(rows, column, d + 1, expected, k * (1 + d + len(upper[0])) + 1)
            sums, likelihood = total[:-1].reshape(k, -1), total[-1] / n
            size = np.maximum(sums[:, 0], 1e-9)
            square = np.zeros((k, d, d))
            square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = sums[:, 1 + d :] / size[:, None]
            self.weights = np.maximum(size / size.sum(), 1e-9)
            self.means = sums[:, 1 : 1 + d] / size[:, None]
            self.chols = self._spread(square - self.means[:, :, None] * self.means[:, None, :])
            if likelihood - last < 1e-3:
                break
            last = likelihood

    def _spread(self, cov: np.ndarray) -> np.ndarray:
        cov = cov + self.ridge * np.eye(cov.shape[-1])
        return np.linalg.cholesky(cov + np.maximum(0, 1e-6 - np.linalg.eigvalsh(cov).min(axis=1))[:, None, None] * 1.01 * np.eye(cov.shape[-1]))

    def _split(self, x: np.ndarray, known: np.ndarray) -> bool:
        """Components that hold labelled rows of several classes become one for each of these classes; whether there were any."""
        r = self._responsible(x)
        votes = np.stack([r[known == c].sum(axis=0) for c in range(len(CLASSES))], axis=1)
        parts = []
        for k, own in enumerate(votes):
            several = np.flatnonzero((own >= LEAST_LABELS) & (own >= (1 - MARGIN) / 4 * own.sum()))
            if len(several) < 2:
                parts.append((self.weights[k], self.means[k], self.chols[k]))
                continue
            for c in several:
                w = r[:, k] * (known == c)
                mean = w @ x / w.sum()
                cov = (w[:, None] * (x - mean)).T @ (x - mean) / w.sum()
                parts.append((self.weights[k] * own[c] / own[several].sum(), mean, self._spread(cov[None])[0]))
        more = len(parts) > len(self.means)
        self.weights, self.means, self.chols = (np.array(p) for p in zip(*parts))
        return more

    def known(self, sample: np.ndarray, words: np.ndarray) -> np.ndarray:
        d = len(FEATURES)
        return label(sample[:, :d], words, self.usual[sample[:, d].astype(np.int64)])

    def standard(self, rows: np.ndarray) -> np.ndarray:
        d = len(FEATURES)
        x, lang = (rows[:, :d] - self.mean) / self.scale, rows[:, d].astype(np.int64)
        x[:, COMMON] = (rows[:, COMMON] - self.usual[lang]) / self.usual_scale[lang]
        return np.clip(x, -8, 8)

    def frozen(self):
        """A function of rows: (1, x and the products of x), responsibilities, log-likelihoods; one matrix product."""
        d = len(FEATURES)
        i, j = np.triu_indices(d)
        back = np.linalg.inv(self.chols)
        precision = np.einsum("kij,kil->kjl", back, back)
        at = np.einsum("kij,kj->ki", precision, self.means)
        const = np.log(self.weights) - 0.5 * np.einsum("ki,ki->k", at, self.means) - np.log(np.diagonal(self.chols, axis1=1, axis2=2)).sum(axis=1) - 0.5 * d * np.log(2 * np.pi)
        pairs = -precision[:, i, j] * np.where(i == j, 0.5, 1.0)
        weigh = np.concatenate([const[:, None], at, pairs], axis=1).T
        standard = self.standard

        def run(rows: np.ndarray, ready: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = rows if ready else standard(rows)
            p = np.concatenate([np.ones((len(x), 1)), x, x[:, i] * x[:, j]], axis=1)
            joint = p @ weigh
            top = joint.max(axis=1, keepdims=True)
            r = np.exp(joint - top)
            total = r.sum(axis=1, keepdims=True)
            return p, r / total, (top + np.log(total))[:, 0]

        return run

    def _responsible(self, x: np.ndarray) -> np.ndarray:
        return self.frozen()(x, True)[1]

    @staticmethod
    def _sum(rows: DataFrame, column: str, width: int, part, size: int) -> np.ndarray:
        """The sum of part(rows as a matrix) over all rows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)
                for at in range(0, len(flat), 8192):  # stays in the processor's cache
                    total += part(flat[at : at + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

        got = rows.select(column).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[got["i"].to_numpy()] = got["v"].to_numpy()
        return out

    def name_components(self, sample: np.ndarray, words: np.ndarray) -> Mixture:
        """Each component takes the classes of the labelled rows in it, by their shares; without enough of them, or
        with no class that prevails, those of the nearest component that has both.

        Nearness is by the mean covariance of all components: a small component's own is too tight to compare.
        """
        k = len(self.means)
        self.classes = np.eye(len(CLASSES))[np.zeros(k, int)]
        if not len(sample):
            return self
        known = self.known(sample, words)
        _, r, _ = self.frozen()(sample)
        self.votes = np.stack([r[known == c].sum(axis=0) for c in range(len(CLASSES))], axis=1)
        n = self.votes.sum(axis=1)
        sure = (n >= LEAST_LABELS) & (self.votes.max(axis=1) >= MARGIN * n)
        pooled = np.einsum("k,kij,klj->il", self.weights / self.weights.sum(), self.chols, self.chols)
        at = self.means @ np.linalg.inv(np.linalg.cholesky(pooled)).T
        for c in range(k):
            pick = c
            if not sure[c] and sure.any():
                far = np.where(sure, ((at - at[c]) ** 2).sum(axis=1), np.inf)
                pick = int(far.argmin())
            if self.votes[pick].sum() > 0:
                self.classes[c] = self.votes[pick] / self.votes[pick].sum()
        return self


def _lines(chunks: DataFrame, common: dict[str, frozenset]) -> DataFrame:
    """chunk_id, source, the five statistics, keys and facts of the lines; one row per chunk_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        facts = WordFacts(common)
        width = len(FACTS) + len(common)
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in ("keys", "facts", "n_words", "mean_word_length", "symbol_share", "punctuated_lines", "common_words")}
            for text in pdf["content"]:
                keys, flat = line_facts(text, facts)
                m = np.array(flat, np.int32).reshape(-1, width)
                n, chars, symbols, ends = (int(m[:, FACTS.index(c)].sum(dtype=np.int64)) for c in ("words", "chars", "symbols", "ends"))
                best = int(m[:, len(FACTS) :].sum(axis=0, dtype=np.int64).max(initial=0))
                row = (keys, m.ravel(), n, chars / max(1, n), symbols / max(1, chars), ends / max(1, len(m)), best / max(1, n))
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"], "source": pdf["source"], **out})

    rows = chunks.select("chunk_id", F.when(F.col("metadata.filename").isNotNull(), F.xxhash64("metadata.filename")).alias("source"), "content").filter(F.col("chunk_id").isNotNull() & F.col("content").isNotNull())
    shape = "chunk_id string, source long, keys array<bigint>, facts array<int>, n_words int, mean_word_length double, symbol_share double, punctuated_lines double, common_words double"
    return rows.mapInPandas(run, shape).dropDuplicates(["chunk_id"])


STATISTICS = ("n_words", "mean_word_length", "symbol_share", "punctuated_lines", "common_words")


def text_statistics(chunks: DataFrame, common_words: DataFrame) -> DataFrame:
    """(chunk_id, n_words, mean_word_length, symbol_share, punctuated_lines, common_words) of every chunk with content.

    symbol_share: of the characters that are not white; punctuated_lines: of the lines that are not blank;
    common_words: of the words, in the language that has most. Blank content has zeros.
    """
    return _lines(chunks, _common(common_words)).select("chunk_id", *STATISTICS)


def _returning(lined: DataFrame, everywhere: DataFrame) -> DataFrame:
    """lined with ``gone``: for each line whether it returns through the chunk's file. ``everywhere``: chunks per source."""
    repeated = stored(crossed(count_delta(lined.filter(F.col("source").isNotNull())), everywhere, MIN_CHUNKS, MIN_SHARE), "repeated")
    rows = with_lines(lined, repeated, "left")
    return rows.withColumn("gone", F.transform("keys", lambda k: F.coalesce(F.array_contains("lines", k), F.lit(False))))


def text_quality(chunks: DataFrame, common_words: DataFrame, min_words: int = 20) -> DataFrame:
    """One row per chunk with content: its statistics, the share of its words in each class, and its class.

    Columns: chunk_id, n_words, mean_word_length, symbol_share, punctuated_lines, common_words, prose,
    list, table, junk, kind. Statistics are of the whole content; classes leave aside lines that
    return through the chunk's file. kind is null below min_words. Null content and null ids
    give no row, blank content a row of zeros. Rows that repeat a chunk_id count once.
    """
    common = _common(common_words)
    d, width = len(FEATURES), len(FACTS) + len(common)
    lined = stored(_lines(chunks, common), "lines")
    empty = chunks.filter(F.col("content").isNull() & F.col("chunk_id").isNotNull() & F.col("metadata.filename").isNotNull())
    empty = empty.select("chunk_id", F.xxhash64("metadata.filename").alias("source")).distinct()
    # chunks without content count in the file's total
    totals = chunk_totals(lined.filter(F.col("source").isNotNull()).select("source").unionAll(empty.select("source")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = ~np.concatenate([np.asarray(g, dtype=bool) for g in pdf["gone"]] or [np.empty(0, bool)])
            lines = np.concatenate([np.asarray(x, np.int32) for x in pdf["facts"]] or [np.empty(0, np.int32)]).reshape(-1, width)[keep]
            owner = np.repeat(np.arange(len(pdf)), pdf["gone"].map(len))[keep]
            begins = segments(lines[:, FACTS.index("shape")], owner)
            sizes, xs = [np.empty(0, np.int32)] * len(pdf), [np.empty(0, np.float32)] * len(pdf)
            if len(begins):
                x, whose = features(lines, begins), owner[begins]
                words = np.add.reduceat(lines[:, 0].astype(np.int64), begins)
                by_chunk = np.zeros((len(pdf), max(1, len(common))), np.int64)
                np.add.at(by_chunk[:, : len(common)], owner, lines[:, len(FACTS) :])
                x = np.concatenate([x, by_chunk.argmax(axis=1)[whose][:, None]], axis=1).astype(np.float32)
                first = np.flatnonzero(np.concatenate(([True], whose[1:] != whose[:-1])))
                for at, part, w in zip(whose[first], np.split(x, first[1:]), np.split(words.astype(np.int32), first[1:])):
                    sizes[at], xs[at] = w, part.ravel()
            yield pdf[["chunk_id", *STATISTICS]].assign(sizes=sizes, xs=xs)

    numbers = "n_words int, mean_word_length double, symbol_share double, punctuated_lines double, common_words double"
    measured = stored(_returning(lined, totals).select("chunk_id", *STATISTICS, "facts", "gone").mapInPandas(measure, f"chunk_id string, {numbers}, sizes array<int>, xs array<float>"), "measured")
    # about twice as many are looked at, so that tasks do not each send as many as are wanted
    share = min(1.0, 2.0 * SAMPLE_ROWS / max(1, measured.count()))
    drawn = measured.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select("sizes", "xs").orderBy(F.xxhash64("chunk_id")).limit(SAMPLE_ROWS).toPandas()
    sample = np.concatenate([np.empty(0), *drawn["xs"]]).reshape(-1, d + 1)[:SAMPLE_ROWS]
    words = np.concatenate([np.empty(0), *drawn["sizes"]])[:SAMPLE_ROWS]
    mixture = Mixture(languages=len(common)).fit(measured, sample, words).name_components(sample, words)
    classes, judge = mixture.classes, mixture.frozen()

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = pdf["sizes"].map(len).to_numpy()
            shares = np.zeros((len(pdf), len(CLASSES)))
            if counts.sum():
                _, r, _ = judge(np.concatenate(list(pdf["xs"])).reshape(-1, d + 1).astype(np.float64))
                sizes = np.concatenate(list(pdf["sizes"])).astype(float)
                np.add.at(shares, np.repeat(np.arange(len(pdf)), counts), (r @ classes) * sizes[:, None])
                shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-12)
            out = pdf.drop(columns=["sizes", "xs"])
            for i, c in enumerate(CLASSES):
                out[c] = shares[:, i]
            kind = np.where(shares[:, 0] >= 0.5, 0, 1 + shares[:, 1:].argmax(axis=1))
            ok = (pdf["n_words"].to_numpy() >= min_words) & (counts > 0)
            out["kind"] = [CLASSES[k] if o else None for k, o in zip(kind, ok)]
            yield out

    shares = ", ".join(f"`{c}` double" for c in CLASSES)
    return measured.mapInPandas(classify, f"chunk_id string, {numbers}, {shares}, kind string")
