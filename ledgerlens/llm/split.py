"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 50
PIECES = "chunk_id string, piece_index int, content string, page_number int, chunk_index int, start_word int, end_word int, n_words int, boundary string"
KINDS = ("paragraph", "row", "sentence", "line", "word", "end")
LINE, WORD, END = 3, 4, 5
#: Cost of a cut of each kind; a cut inside a sentence outweighs any imbalance.
CUT_COST = np.array([0.0, 0.15, 0.3, 1.0, 6.0, 0.0])

_WORDS = re.compile("[^\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_SENTENCE = re.compile("[.!?\u2026][\"'\u201d\u2019\u00bb)\\]]*$")
_ENTRY = re.compile("^\\s*([-*\u2022\u2013\u2014|+]|\\(?[0-9]{1,3}[.)]|\\(?[a-zA-Z][.)])(\\s|$)|^\\s*\\|")
_CELLS = re.compile("\\||\t|;.*;|\\S {2,}\\S.* {2,}\\S|=\\S+.*=")


def wrapped_ends(text: str) -> set[int]:
    """Where the line ends lie that only a line width has made: there the next word would not have fitted."""
    out: set[int] = set()
    block: list[tuple[str, int]] = []
    at = 0
    for line in (*text.split("\n"), ""):
        tight = line.strip()
        if tight:
            block.append((tight, at + len(line)))
        elif block:
            size = sorted(len(x) for x, _ in block)
            width = size[-1] if len(size) < 10 else size[int(0.9 * (len(size) - 1))]
            broken = [end for (x, end), (y, _) in zip(block, block[1:]) if len(x) + 1 + len(y.split(None, 1)[0]) > width and not x.endswith(";")]
            if width >= 30 and len(broken) >= 0.6 * (len(block) - 1):
                out.update(broken)
            block = []
        at += len(line) + 1
    return out


def gap_kinds(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """For the gap after each word but the last, the index in KINDS of the boundary there."""
    kinds = np.full(len(starts) - 1, WORD, dtype=np.int8)
    wrapped = wrapped_ends(text)
    entry: dict[int, bool] = {}

    def is_entry(at: int) -> bool:
        begin = text.rfind("\n", 0, at) + 1
        if begin not in entry:
            end = text.find("\n", at)
            line = text[begin : len(text) if end < 0 else end]
            entry[begin] = bool(_ENTRY.match(line) or _CELLS.search(line))
        return entry[begin]

    for i in range(len(starts) - 1):
        a, b = ends[i], starts[i + 1]
        newlines = text.count("\n", a, b)
        if newlines >= 2:
            kinds[i] = 0
        elif newlines and (is_entry(a - 1) or is_entry(b)):
            kinds[i] = 1
        elif text[a - 1] in ".!?\u2026\"'\u201d\u2019\u00bb)]" and _SENTENCE.search(text[max(starts[i], a - 6) : a]) and not text[b].islower():
            kinds[i] = 1 if newlines else 2
        elif newlines and text.find("\n", a, b) not in wrapped:
            kinds[i] = LINE
    return kinds


def cut_positions(n: int, kinds: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The cuts (words before the cut, kind) of least total cost; the last one is (n, end).

    Dynamic programming over boundary positions: a piece that ends at p and follows a cut at q
    holds the words q - overlap .. p. Its cost is that of its cut plus the squared relative
    deviation from an even split. Where natural boundaries lie further apart than a piece
    may advance, every word in between is a position too, so a cut always exists.
    """
    step = limit - overlap
    natural = np.flatnonzero(kinds < WORD) + 1
    natural = natural[natural >= overlap]
    edges = np.concatenate(([0], natural, [n]))
    wide = np.flatnonzero(np.diff(edges) > step)
    extra = [np.arange(max(edges[w] + 1, overlap), edges[w + 1]) for w in wide]
    pos = np.unique(np.concatenate([edges, *extra])).astype(np.int64)
    kind = np.full(len(pos), END, dtype=np.int64)
    kind[1:-1] = kinds[pos[1:-1] - 1]
    pieces = max(1, -(-(n - overlap) // step))
    even = (n - overlap) / pieces
    best = np.full(len(pos), np.inf)
    best[0] = 0.0
    back = np.zeros(len(pos), dtype=np.int64)
    lows = np.searchsorted(pos, pos - step)
    for i in range(1, len(pos)):
        low = 0 if pos[i] <= limit else max(1, lows[i])
        advance = (pos[i] - pos[low:i]).astype(np.float64)
        if low == 0:
            advance[0] -= overlap  # the first piece repeats nothing
            advance[1:][advance[1:] > step] = np.inf
        cost = best[low:i] + ((advance - even) / even) ** 2
        j = int(np.argmin(cost))
        best[i] = cost[j] + CUT_COST[kind[i]]
        back[i] = low + j
    cuts, i = [], len(pos) - 1
    while i > 0:
        cuts.append((int(pos[i]), int(kind[i])))
        i = back[i]
    return cuts[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int, int, str]]:
    """Pieces (content, first word, word after the last, boundary at its end); [] unless text has more than limit words."""
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and 0 <= overlap < limit")
    spans = [m.span() for m in _WORDS.finditer(text)]
    n = len(spans)
    if n <= limit:
        return []
    starts, ends = [s for s, _ in spans], [e for _, e in spans]
    out, before = [], 0
    for at, kind in cut_positions(n, gap_kinds(text, starts, ends), limit, overlap):
        first = max(0, before - overlap)
        out.append((text[starts[first] : ends[at - 1]], first, at, KINDS[kind]))
        before = at
    return out


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every chunk whose content has more than ``limit`` words.

    Needs chunk_id, content, page_number, chunk_index; other columns are ignored. One row per
    piece, in the order piece_index, with the page and index of its chunk. Consecutive pieces
    share exactly ``overlap`` words; content is the text as it stands, white space included.
    Null and blank content has no words and gives no row. Of rows that repeat a chunk_id one is
    cut; rows without chunk_id are each cut for themselves only if the id is not null, and left
    out otherwise. An empty table gives no rows.
    """
    if limit <= 0 or not 0 <= overlap < limit:
        raise ValueError("limit must be positive and 0 <= overlap < limit")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["chunk_id", "piece_index", "content", "page_number", "chunk_index", "start_word", "end_word", "n_words", "boundary"]
        for pdf in batches:
            rows = []
            for cid, text, page, index in zip(pdf["chunk_id"], pdf["content"], pdf["page_number"], pdf["chunk_index"]):
                for k, (piece, a, b, kind) in enumerate(split_text(text, limit, overlap)):
                    rows.append((cid, k, piece, page, index, a, b, b - a, kind))
            yield pd.DataFrame(rows, columns=columns).astype({"page_number": "Int32", "chunk_index": "Int32"})

    def oversized(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # str.split parts at a few characters more, so it never counts too few
            yield pdf[[len(t.split()) > limit and sum(1 for _ in _WORDS.finditer(t)) > limit for t in pdf["content"]]]

    rows = chunks.select("chunk_id", "content", "page_number", "chunk_index").filter(F.col("chunk_id").isNotNull() & (F.length("content") > 2 * limit))
    large = rows.mapInPandas(oversized, "chunk_id string, content string, page_number int, chunk_index int")
    return large.dropDuplicates(["chunk_id"]).mapInPandas(cut, PIECES)
