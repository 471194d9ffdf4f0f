"""Problem 8: texts that stop before their author's text does.

A backward n-gram model reads the last characters of a text and the words before them, and
compares how often that context ends a text or paragraph with how often the text goes on
after it. The log-odds are smoothed from short to long contexts. To them come what the model cannot
see: lengths that pile up at a source's field limit (in characters or UTF-8 bytes), marks and
debris left by a cut, and a last table row with fewer cells than the rows above. Their weights
are found by expectation-maximisation, and a text is cut where its log-odds pass the
threshold of its language.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.neardup import mix
from ledgerlens.runtime import stored

LEVELS = 7
#: Weight of the shorter context when a longer one is smoothed.
KAPPA = 4.0
#: The contexts that end some text, as a bit map: others need not be counted. It has eight bits for each, and as a
#: power of two between these; with more than an eighth of 2^MOST_BITS contexts it lets more of the others pass, and none is lost.
LEAST_BITS, MOST_BITS = 20, 29
#: The map is put together from pieces of 2^PIECE_BITS bits.
PIECE_BITS = 16
#: Contexts that end more texts than this are joined by broadcast: there are at most LEVELS * texts / HOT of them.
HOT = 50_000
#: Words of a text's end that are kept: more than its contexts reach back, and enough to tell copies.
TAIL_WORDS = 40
#: Characters handled at a time.
STRIDE = 150_000
#: Hashes a task holds before it counts them.
HELD = 3_000_000
#: Contexts of the shortest level fall into so many cells.
SHORT_CELLS = 1 << 18
#: Ends are weighed again until no text changes sides, in so many rounds at least and at most.
LEAST_ROUNDS, MOST_ROUNDS = 3, 10

_BREAK = "\n\n\x01 \x01 \x01 \x01 \x01\n\n"
_MARKS = re.compile("(\\s*(…|\\.\\.\\.|\\[\\s*(\\.\\.\\.|…|truncated|cut|more|tronqué|gekürzt|cortado|truncado)\\s*\\]|\\(\\s*(\\.\\.\\.|…|truncated|more|cont\\.?)\\s*\\)|<\\s*(truncated|cut|/?[a-z]{0,8})\\s*>?|&[a-z#0-9]{0,6};?|�+))\\s*$", re.IGNORECASE)
#: Kinds of debris at the end.
NONE, SPACE, LINES, ELLIPSIS, BRACKET, BROKEN = range(6)
#: Last table row: no table, as many cells, fewer cells or shorter, closed by its delimiter.
NO_TABLE, EVEN_ROW, SHORT_ROW, CLOSED_ROW = range(4)


def bare_end(text: str) -> tuple[str, int]:
    """The text without what a cut leaves behind, and the kind of that debris."""
    body = text.rstrip()
    tail = text[len(body) :]
    kind = LINES if "\n" in tail else SPACE if tail else NONE
    found = _MARKS.search(body, max(0, len(body) - 60))
    if found:
        mark = found.group(1).strip()
        kind = BROKEN if "�" in mark else ELLIPSIS if mark in ("…", "...") else BRACKET
        body = body[: found.start()].rstrip()
    return body, kind


def last_row(text: str) -> int:
    """What the last line's cells say, against the lines right above it."""
    lines = text.rsplit("\n", 7)
    if len(lines) < 3:
        return NO_TABLE
    last, above = lines[-1], [x for x in lines[-7:-1]]
    for mark in ("|", "\t", ";"):
        counts = [x.count(mark) for x in above[-2:]]
        if min(counts) >= 1 and counts[0] == counts[1] and (mark != ";" or counts[0] >= 2 or last.count(";") == 1):
            if mark == ";" and all(x.rstrip().endswith(";") for x in above[-2:]) and counts[0] == 1:
                return NO_TABLE  # entries of a list, each with its semicolon
            if last.count(mark) > counts[0] + 1:
                return NO_TABLE
            if last.count(mark) < counts[0]:
                return SHORT_ROW if last.count(mark) or mark != "|" and len(last) < max(map(len, above[-2:])) and last.count(".") == 0 else NO_TABLE
            return CLOSED_ROW if mark == "|" and last.rstrip().endswith("|") else EVEN_ROW
    fields = [len(re.findall("(?<=\\S)=", x)) for x in above[-2:]]
    if min(fields) >= 2:
        return SHORT_ROW if len(re.findall("(?<=\\S)=", last)) < fields[-1] else EVEN_ROW
    gaps = [len(re.findall("\\S {2,}(?=\\S)", x)) for x in above[-2:]]
    if min(gaps) >= 1 and abs(len(above[-1]) - len(above[-2])) <= 1:  # columns set flush right
        if len(last) < len(above[-1]) - 1 and (re.search("\\S {2,}\\S", last) or len(last.split()) <= 6):
            return SHORT_ROW
        return EVEN_ROW if re.search("\\S {2,}\\S", last) else NO_TABLE
    return NO_TABLE


def long_hash(h: np.ndarray) -> np.ndarray:
    """63 bits, never below SHORT_CELLS, so that hashes of the shortest level stand apart."""
    return (h >> np.uint64(1)) | np.uint64(1 << 20)


def contexts(text: str) -> tuple[np.ndarray, Callable[[int, np.ndarray], np.ndarray], np.ndarray]:
    """The places of the non-white characters; the hashes, at a level, of the contexts that end with some of them; how the text goes on.

    Contexts: the last three characters (with whether their word is capitalised); these with one to four
    words before; the whole last word with two or three words before. Digits are alike, words with digits
    are alike, and so are capitalised words within a sentence. What follows: 0 more of the
    word, 1 white space, 2 a line end, 3 a blank line.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    digit = (a >= 48) & (a <= 57)
    a[digit] = 48
    white = (a == 32) | ((a >= 9) & (a <= 13)) | (a == 160) | (a == 0x202F)
    solid = ~white
    at = np.flatnonzero(solid)
    if not len(at):
        return at, lambda k, where: np.empty(0, np.uint64), np.empty(0, np.int8)
    begins = solid & np.concatenate(([True], white[:-1]))
    start = np.flatnonzero(begins)
    word = np.cumsum(begins)[at] - 1
    chars = mix(a[at].astype(np.uint64), 3)
    inside = np.minimum(at - start[word], 63)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        run = np.cumsum(chars * power[inside])
        first = np.searchsorted(at, start)
        before = np.concatenate((np.zeros(1, np.uint64), run))[first]
        prefix = run - before[word]
        last = np.concatenate((first[1:], [len(at)])) - 1
        whole = prefix[last]
        head = a[start]
        capital = ((head >= 65) & (head <= 90)) | ((head >= 0xC0) & (head <= 0xDE))
        # the gap before a word: white space, a line end, a blank line
        lines = np.cumsum(a == 10)
        newlines = lines[start] - np.concatenate(([0], lines[at[last[:-1]]]))
        gap = np.minimum(newlines, 2).astype(np.uint64)
        tail = a[at[last]]
        stop = np.concatenate(([True], np.isin(tail[:-1], [46, 33, 63, 58, 34, 1])))
        name = capital & ~stop & (gap == 0) & (last - first >= 2)
        numbers = np.maximum.reduceat(digit[at].astype(np.int8), first) > 0
        sort = np.where(numbers, np.uint64(7), np.where(name, np.uint64(11), whole))
        # names and numbers keep what closes them
        closing = np.isin(tail, [46, 44, 59, 58, 41, 63, 37])
        sort = np.where((numbers | name) & closing, sort + tail.astype(np.uint64) * np.uint64(131), sort)
        cls = mix(sort * np.uint64(4) + gap, 5)
        earlier = [np.concatenate((np.zeros(k, np.uint64), cls[:-k])) if k < len(cls) else np.zeros(len(cls), np.uint64) for k in (1, 2, 3, 4)]
        back = [earlier[0]]
        for e in earlier[1:]:
            back.append(mix(back[-1], 9) + e)
        one = np.concatenate((np.zeros(1, np.uint64), chars[:-1]))
        two = np.concatenate((np.zeros(2, np.uint64), chars[:-2])) if len(chars) > 1 else np.zeros(len(chars), np.uint64)
        one[inside < 1] = 17
        two[inside < 2] = 17
        own = chars + one * np.uint64(31) + two * np.uint64(1009) + (capital[word].astype(np.uint64) * np.uint64(4) + gap[word]) * np.uint64(0x5851F42D4C957F2D)
        own = mix(own, 13)
    before_last = [mix(back[k], 20 + k) for k in range(4)] + [mix(back[k], 30 + k) for k in (1, 2)]

    def level(k: int, where: np.ndarray) -> np.ndarray:
        if k == 0:
            return own[where] >> np.uint64(64 - 18)
        w = word[where]
        if k <= 4:
            return long_hash(own[where] ^ before_last[k - 1][w])
        with np.errstate(over="ignore"):
            return long_hash(mix(prefix[where] * np.uint64(4) + gap[w], 15) ^ before_last[k - 1][w])

    goes = np.zeros(len(at), np.int8)
    ends = np.zeros(len(start), np.int8)
    ends[:-1] = 1 + np.minimum(newlines[1:], 2)
    ends[-1] = 3
    goes[last] = ends
    return at, level, goes


def _language(lang) -> str:
    code = (lang or "und").strip().lower()[:2]
    return code if code.isalpha() and code != "un" and len(code) == 2 else "und"


_BLANK = re.compile("\n[ \t\r]*\n\\s*")
_LISTED = re.compile("\\s*([-*•–—|+]|\\(?\\w{1,3}[.)]\\s)")


def unwrapped(text: str) -> str:
    """The text with lines that only a line width has broken joined again: there the next word would not have fitted."""
    if "\n" not in text:
        return text
    out = []
    for block in _BLANK.split(text):
        lines = block.split("\n")
        if len(lines) > 1:
            size = [len(x) for x in lines]
            width = max(size) if len(size) < 10 else sorted(size)[int(0.9 * (len(size) - 1))]
            if width >= 40 and not any(_LISTED.match(x) for x in lines[1:4]):
                broken = sum(n + 1 + len(x.split(" ", 1)[0]) > width for n, x in zip(size, lines[1:]))
                if broken >= 0.6 * (len(lines) - 1):
                    block = " ".join(lines)
        out.append(block)
    return "\n\n".join(out)


def text_end(body: str) -> str:
    """The last TAIL_WORDS words as they stand, lines joined as in the whole text: from a blank line that has so many words after it."""
    at, step = len(body), 2_000
    while at > 0:
        low = max(0, at - step)
        for found in reversed(list(_BLANK.finditer(body, low))):
            if len(body[found.end() :].split(None, TAIL_WORDS)) > TAIL_WORDS:
                at, low = found.end(), -1
                break
        if low < 0:
            break
        at, step = low, step * 4
    text = unwrapped(body[at:])
    return text[len(text.rsplit(None, TAIL_WORDS)[0]) :] if len(text.split(None, TAIL_WORDS)) > TAIL_WORDS else text


def _tails(documents: DataFrame, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                rows, ends = [], []
                part = pdf.iloc[at : at + 512]
                for k, t, lang, source in zip(part["k"], part["t"], part["lang"], part["source"]):
                    body, debris = bare_end(t)
                    if not body:
                        continue
                    ends.append(text_end(body))
                    tail = int(mix(np.array([hash_of(ends[-1])], np.uint64), 1).view(np.int64)[0])
                    rows.append((k, tail, _language(lang), source, debris, last_row(body), len(t), len(t.encode("utf-8", "surrogatepass"))))
                out = pd.DataFrame(rows, columns=["k", "tail", "lang", "source", "debris", "row", "chars", "bytes"])
                if ends:
                    spots, level, _ = contexts(_BREAK + _BREAK.join(ends) + _BREAK)
                    last = np.searchsorted(spots, places(ends)[1]) - 1
                    out["levels"] = list(np.stack([level(k, last) for k in range(LEVELS)], axis=1).view(np.int64))
                    yield out

    cols = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), "lang", "source").filter(F.col("k").isNotNull() & F.col("t").isNotNull())
    kind = documents.schema[key].dataType.simpleString()
    return cols.mapInPandas(run, f"k {kind}, tail long, lang string, source string, debris int, row int, chars int, bytes int, levels array<bigint>")


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def context_map(contexts_: DataFrame, bits: int) -> np.ndarray:
    """2^bits bits: those of the leading bits of every h are set. Pieces of it are made by the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces: dict[int, np.ndarray] = {}
        for pdf in batches:
            cell = pdf["h"].to_numpy() >> (63 - bits)
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            piece = cell >> PIECE_BITS
            for part in np.split(cell, np.flatnonzero(np.diff(piece)) + 1) if len(cell) else []:
                own = pieces.setdefault(int(part[0] >> PIECE_BITS), np.zeros(1 << (PIECE_BITS - 3), np.uint8))
                inner = part & ((1 << PIECE_BITS) - 1)
                np.bitwise_or.at(own, inner >> 3, (1 << (inner & 7)).astype(np.uint8))
        yield pd.DataFrame({"piece": list(pieces), "bits": [p.tobytes() for p in pieces.values()]}).astype({"piece": "int32"})

    # all contexts of a piece come to one task; a piece is 8 KB, and all of them are the map
    laid = contexts_.select("h").repartition(F.shiftright("h", 63 - bits + PIECE_BITS))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for piece, part in laid.mapInPandas(run, "piece int, bits binary").toLocalIterator():
        out[piece << (PIECE_BITS - 3) : (piece + 1) << (PIECE_BITS - 3)] = np.frombuffer(part, np.uint8)
    return out


def _counts(documents: DataFrame, text: str, bitmap, map_bits: int) -> DataFrame:
    """(h, e, i): how often a context that ends some text ends a line or paragraph within a text, and how often the text goes on."""

    def part(texts: list[str], bits: np.ndarray, out: list, short: np.ndarray) -> None:
        spots, level, goes = contexts(_BREAK + _BREAK.join(texts) + _BREAK)
        start, stop = places(texts)
        # the last character of a text is its end, which the tails count
        step = np.zeros(len(spots) + 1, np.int8)
        np.add.at(step, np.searchsorted(spots, start), 1)
        np.add.at(step, np.maximum(np.searchsorted(spots, stop) - 1, 0), -1)
        inside = np.flatnonzero(np.cumsum(step[:-1]) > 0)
        ends = (goes >= 2).astype(np.uint64)
        short += np.bincount(((level(0, inside) << np.uint64(1)) | ends[inside]).astype(np.int64), minlength=len(short))

        def known(k: int, where: np.ndarray) -> np.ndarray:
            """Of these places those where the context ends some text; they are noted, and only there a longer one can."""
            h = level(k, where)
            cell = h >> np.uint64(63 - map_bits)
            hit = np.flatnonzero((bits[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1)
            where = where[hit]
            out.append((h[hit] << np.uint64(1)) | ends[where])
            return where

        two = known(2, known(1, inside))
        known(5, two)
        three = known(3, two)
        known(6, three)
        known(4, three)

    def summed(parts: list) -> pd.DataFrame:
        """Runs of equal hashes, counted; the lowest bit says whether the line ended there."""
        x = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(x)))
        return counted(x[first], n)

    def counted(x: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        end = (x & np.uint64(1)).astype(np.int64)
        return pd.DataFrame({"h": (x >> np.uint64(1)).view(np.int64), "e": n * end, "i": n * (1 - end)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, out, held, texts, size = bitmap.value, [], 0, [], 0
        short = np.zeros(2 * SHORT_CELLS, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                body = unwrapped(bare_end(t)[0])
                if not body:
                    continue
                texts.append(body)
                size += len(body)
                if size >= STRIDE:
                    part(texts, bits, out, short)
                    held += sum(map(len, out[1 - LEVELS :]))
                    texts, size = [], 0
                    if held > HELD:
                        yield summed(out)
                        out, held = [], 0
        if texts:
            part(texts, bits, out, short)
        if out:
            yield summed(out)
        hit = np.flatnonzero(short)
        yield counted(hit.astype(np.uint64), short[hit])

    rows = documents.select(F.col(text).alias("t")).filter(F.col("t").isNotNull()).mapInPandas(run, "h long, e long, i long")
    return rows.groupBy("h").agg(F.sum("e").alias("e"), F.sum("i").alias("i"))


def places(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin and end in _BREAK + _BREAK.join(texts)."""
    size = np.array([len(t) for t in texts])
    start = len(_BREAK) + np.concatenate(([0], np.cumsum(size + len(_BREAK))[:-1]))
    return start, start + size


def _spikes(tails: DataFrame) -> DataFrame:
    """(source, chars, bytes -> log ratio): how far the texts of a source pile up at this length.

    Counts per source and length, so a window holds at most as many rows as there are lengths.
    """
    def ratio(unit: str) -> DataFrame:
        n = tails.groupBy("source", F.col(unit).alias("len")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("source").orderBy("len")
        near, wide = w.rangeBetween(-6, 6), w.rangeBetween(-80, 80)
        n = n.withColumn("near", F.sum("n").over(near)).withColumn("wide", F.sum("n").over(wide))
        rate = (F.col("wide") - F.col("near") + 0.5) / 148.0
        exact = F.log(F.col("n") / (rate + 0.25))
        soft = F.log(F.col("near") / (13 * rate + 1.5)) - 0.5
        return n.select("source", F.col("len").alias(unit), F.greatest(F.when(F.col("n") >= 3, exact).otherwise(0.0), F.when(F.col("near") >= 6, soft).otherwise(0.0)).alias(f"s_{unit}"))

    lengths = tails.select("source", "chars", "bytes").distinct()
    a, b = ratio("chars"), ratio("bytes")
    out = lengths.join(a, ["source", "chars"]).join(b, ["source", "bytes"])
    return out.select("source", "chars", "bytes", F.greatest("s_chars", "s_bytes").alias("spike"))


def _weights(cells: pd.DataFrame, rounds: int = 40) -> tuple[dict, dict]:
    """Log-odds of each kind of debris, row and spike, and of a cut per language, from counts of like texts.

    cells: lang, debris, row, spike, odds (of the model, binned) and n. Naive Bayes, whose classes
    are inferred: the model's odds start it, and the features are independent within a class.
    """
    base = {lang: -2.0 for lang in cells["lang"].unique()}
    tables = {"debris": np.array([-0.5, 1.5, 1.0, 3.0, 3.0, 4.0]), "row": np.array([0.0, 0.0, 4.0, -3.0]), "spike": np.array([-0.3, 1.0, 2.0, 3.0, 4.0])}
    n = cells["n"].to_numpy(float)
    for _ in range(rounds):
        z = cells["lang"].map(base).to_numpy(float) - cells["odds"].to_numpy(float)
        for f, t in tables.items():
            z = z + t[cells[f].to_numpy(int)]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for f, t in tables.items():
            k = cells[f].to_numpy(int)
            cut = np.bincount(k, n * p, len(t)) + 0.5
            kept = np.bincount(k, n * (1 - p), len(t)) + 0.5
            new = np.log(cut / cut.sum()) - np.log(kept / kept.sum())
            most = 8 if f == "debris" else 5  # a mark settles the matter, a length or a row does not
            tables[f] = np.clip(0.5 * t + 0.5 * new, -most, most)
        for lang in base:
            own = (cells["lang"] == lang).to_numpy()
            share = ((n * p)[own].sum() + 2.0) / (n[own].sum() + 20.0)
            base[lang] = float(np.log(share / (1 - share)))
    return base, tables


SPIKE_STEPS = (0.8, 1.6, 2.4, 3.4)


def truncated(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, source, lang, log_odds, is_cut): one row for each row whose key and text are not null and not blank.

    Needs key, text, lang, source. log_odds over 0 mean cut. Null and odd languages count as one
    language, null sources as one source. Texts that end alike (copies) train the model once, and
    a text's own end never speaks for itself. An empty table gives no rows.
    """
    spark = documents.sparkSession
    docs = documents.select(key, text, "lang", F.coalesce("source", F.lit("")).alias("source"))
    tails = stored(_tails(docs, key, text), "tails")
    one = tails.dropDuplicates(["tail"]).select("tail", "levels")
    each = stored(one.select("tail", F.posexplode("levels").alias("level", "h")), "ends")
    words = each.filter("level > 0").groupBy("h").agg(F.count("*").alias("tails"))
    words = stored(words, "words")
    n_words = words.count()
    map_bits = int(np.clip(np.ceil(np.log2(max(1, 8 * n_words))), LEAST_BITS, MOST_BITS))
    bitmap = spark.sparkContext.broadcast(context_map(words, map_bits))  # at most 2^MOST_BITS / 8 bytes
    model = stored(_counts(docs, text, bitmap, map_bits), "contexts")
    total = model.filter((F.col("h") >= 0) & (F.col("h") < SHORT_CELLS)).agg(F.sum("e").alias("e"), F.sum("i").alias("i")).first()
    n_tails = one.count()
    rate = ((total["e"] or 0) + n_tails + 1.0) / ((total["e"] or 0) + (total["i"] or 0) + n_tails + 2.0)
    base = float(np.log(rate / (1 - rate)))
    # the cells of the shortest level and contexts that end very many texts: joined by broadcast, the others by shuffle
    hot = F.broadcast(words.filter(F.col("tails") > HOT).select("h"))
    often = F.broadcast(model.filter((F.col("h") >= 0) & (F.col("h") < SHORT_CELLS)).unionByName(model.join(hot, "h", "left_semi")))
    far = each.filter("level > 0").join(hot.withColumn("hot", F.lit(True)), "h", "left")
    near = each.filter("level = 0").withColumn("hot", F.lit(True)).unionByName(far.filter("hot")).join(often, "h", "left")
    levels = near.unionByName(far.filter("hot IS NULL").withColumn("hot", F.lit(False)).join(model, "h", "left"))
    levels = stored(levels.select("tail", "level", "h", "hot", F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("i", F.lit(0)).alias("i")), "levels")
    spikes = _spikes(tails)
    known = tails.join(spikes, ["source", "chars", "bytes"]).select("k", "tail", "lang", "source", "debris", "row", sum((F.col("spike") >= s).cast("int") for s in SPIKE_STEPS).alias("spike"))
    known = stored(known.withColumn("was", F.lit(None).cast("boolean")), "known")
    weight = None
    for turn in range(MOST_ROUNDS):
        each = levels.withColumn("w", F.lit(1.0)) if weight is None else levels.join(weight, "tail")
        ends = each.groupBy("hot", "h").agg(F.sum("w").alias("ew"))
        seen = each.filter("hot").join(F.broadcast(ends.filter("hot").drop("hot")), "h").unionByName(each.filter("NOT hot").join(ends.filter("NOT hot").drop("hot"), "h"))
        e = F.greatest(F.col("ew") - F.col("w"), F.lit(0.0)) + F.col("e")
        seen = seen.select("tail", F.struct("level", e.cast("double").alias("e"), F.col("i").cast("double").alias("i")).alias("c"))
        fold = F.aggregate(F.sort_array(F.collect_list("c")), F.lit(rate), lambda p, c: (c["e"] + F.lit(KAPPA) * p) / (c["e"] + c["i"] + F.lit(KAPPA)))
        odds = seen.groupBy("tail").agg(F.least(F.greatest(fold, F.lit(1e-12)), F.lit(1 - 1e-12)).alias("p")).select("tail", (F.log(F.col("p") / (1 - F.col("p"))) - F.lit(base)).alias("odds"))
        scored = stored(known.join(odds, "tail"), "odds")
        binned = F.least(F.greatest(F.round(F.col("odds") * 2) / 2, F.lit(-12.0)), F.lit(12.0)).alias("odds")
        # bounded: languages x kinds x bins
        cells = scored.dropDuplicates(["tail", "source"]).groupBy("lang", "debris", "row", "spike", binned).agg(F.count("*").alias("n")).toPandas()
        if not len(cells):
            break
        langs, tables = _weights(cells)
        z = -F.col("odds")
        for f, t in tables.items():
            z = z + F.element_at(F.array(*[F.lit(float(x)) for x in t]), F.col(f) + 1)
        prior = F.create_map(*[x for lang, b in langs.items() for x in (F.lit(lang), F.lit(b))])
        scored = scored.withColumn("log_odds", z + prior[F.col("lang")])
        known = scored.select("k", "tail", "lang", "source", "debris", "row", "spike", (F.col("log_odds") > 0).alias("was"))
        moved = scored.agg(F.count_if(~F.col("was").eqNullSafe(F.col("log_odds") > 0))).first()[0]
        if turn + 1 >= LEAST_ROUNDS and not moved:
            break
        if turn + 1 == MOST_ROUNDS:
            warnings.warn(f"{moved} texts still change sides after {MOST_ROUNDS} rounds", stacklevel=2)
            break
        weight = stored(scored.groupBy("tail").agg(F.avg(1 / (1 + F.exp(F.greatest(F.least("log_odds", F.lit(30.0)), F.lit(-30.0))))).alias("w")), "weights")
    if "log_odds" not in scored.columns:
        scored = scored.withColumn("log_odds", F.lit(0.0))
    return scored.select(F.col("k").alias(key), F.when(F.col("source") != "", F.col("source")).alias("source"), "lang", "log_odds", (F.col("log_odds") > 0).alias("is_cut"), "odds", "debris", "row", "spike")


def truncation_by_source(documents: DataFrame, found: DataFrame) -> DataFrame:
    """(source, documents, cut, share): for every source, how many of all its rows are cut."""
    n = documents.groupBy("source").agg(F.count("*").alias("documents"))
    cut = found.filter("is_cut").groupBy(F.col("source").alias("s")).agg(F.count("*").alias("cut"))
    return n.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "documents", F.coalesce("cut", F.lit(0)).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("documents")).alias("share"))
