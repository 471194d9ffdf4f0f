"""Problem 4: records that are the same but for small edits.

Sketch after Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017): in round i
every element falls into a hashed bin with the value i + fraction; rounds t..2t-1 send every element
to bin i - t, so each of the t bins is filled in the end. A bin keeps its least value. Equal bins
estimate the Jaccard similarity with Chernoff-like concentration. Most sets are done after
a few rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import stored

SHINGLE, THRESHOLD, MIN_MEMBERS = 5, 0.8, 1
#: Byte-equal texts up to this many are paired with each other; of more the first alone is paired with all others.
PAIRED_COPIES = 1000
#: A bucket of more classes is met in shares of this many, each pair of shares in a task of its own.
BUCKET_SHARE = 1_000
#: Up to this many candidate rows (16 bytes each) are broadcast as a filter; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000
#: A pair at the threshold is missed with this probability at most (less for more similar ones), by so many bands.
MISS, MAX_BANDS = 1e-4, 120
#: Coordinates of which one bit each is kept, to drop chance candidates before their texts are fetched.
BITS = 128
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), vectorised."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def words_of(text: str) -> list[str]:
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space, Unicode doesn't
        return [w for w in text.translate({ord(c): " " for c in _WHITE}).split(" ") if w]
    return text.split()


def shingles(text: str, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words of the lower-cased text."""
    words = words_of(text.lower())
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        run = h[:n].copy()
        for k in range(1, size):
            run = mix(run, k) + h[k : n + k]
    return np.unique(mix(run, size))


def sketch(members: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes.

    Rounds are computed several at a time: a later one never changes a bin that an earlier one has filled.
    """
    if bins > 1 << 11:
        raise ValueError("at most 2048 bins: the round takes 12 bits")
    values = np.full(bins, _EMPTY)
    at, step = 0, int(min(bins, max(1, np.ceil(bins * (np.log(bins) + 1) / len(members)))))
    while at < bins:
        rounds = np.arange(at, min(bins, at + step), dtype=np.uint64)
        h = mix_rounds(members, rounds)
        np.minimum.at(values, (h % np.uint64(bins)).astype(np.int64).ravel(), ((rounds[:, None] << np.uint64(52)) | (h >> np.uint64(12))).ravel())
        if values.max() != _EMPTY:
            return values
        at, step = at + step, max(1, min(step, 65_536 // len(members)))
    empty = np.flatnonzero(values == _EMPTY)
    for some in np.array_split(empty, max(1, len(empty) * len(members) // 65_536)):
        rounds = (some + bins).astype(np.uint64)
        values[some] = ((rounds << np.uint64(52)) | (mix_rounds(members, rounds) >> np.uint64(12)).min(axis=1)) if len(some) else values[some]
    return values


def mix_rounds(x: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """mix(x, i + 1) for each round i, a row each."""
    with np.errstate(over="ignore"):
        seeds = (rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        h = x[None, :] ^ seeds[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def bands_for(threshold: float) -> tuple[int, int]:
    """(bands, rows): of at most MAX_BANDS bands the longest rows that miss a pair at the threshold with MISS at most.

    Long rows matter more than few bands: pairs of little similarity meet with its rows-th power,
    and their number grows with the square of the collection.
    """
    for rows in range(12, 0, -1):
        need = 1 if threshold >= 1 else int(np.ceil(np.log(MISS) / np.log1p(-(threshold**rows))))
        if need <= MAX_BANDS:
            return need, rows
    return MAX_BANDS, 1


def least_agreement(threshold: float) -> int:
    """Of BITS one-bit coordinates, how many agree at least at the threshold, but for four standard deviations."""
    p = (1 + threshold) / 2
    return int(np.floor(BITS * p - 4 * np.sqrt(BITS * p * (1 - p))))


def _sets(chunks: DataFrame, size: int, min_members: int, bins: tuple[int, int] | None) -> DataFrame:
    """With bins: chunk_id, sig and text (128-bit hashes of the set and of the text), bands, bits; without: chunk_id, members."""

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        bands, rows = bins
        for pdf in batches:
            ids, sigs, texts, keys, bits = [], [], [], [], []
            for cid, text in zip(pdf["chunk_id"], pdf["content"]):
                s = shingles(text, size, hashes)
                if len(s) < max(1, min_members):
                    continue
                k = sketch(s, max(BITS, bands * rows))
                bits.append(np.packbits((k[:BITS] >> np.uint64(7)).astype(np.uint8) & 1).view(np.int64))
                k = k[: bands * rows].reshape(bands, rows)
                band = mix(np.arange(bands, dtype=np.uint64), 77)
                for r in range(rows):
                    band = mix(band ^ k[:, r], r)
                ids.append(cid)
                sigs.append(xxhash.xxh3_128_digest(s.tobytes()))
                texts.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                keys.append(band.view(np.int64))
            yield pd.DataFrame({"chunk_id": pd.Series(ids, dtype=str), "sig": pd.Series(sigs, dtype=object), "text": pd.Series(texts, dtype=object), "bands": pd.Series(keys, dtype=object), "bits": pd.Series(bits, dtype=object)})

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in batches:
            sets = [shingles(t, size, hashes).view(np.int64) for t in pdf["content"]]
            yield pd.DataFrame({"chunk_id": pdf["chunk_id"].astype(str), "members": pd.Series(sets, dtype=object)})

    rows = chunks.select("chunk_id", "content").filter(F.col("chunk_id").isNotNull() & (F.length("content") > 2 * size - 2))
    if bins:
        return rows.mapInPandas(sketched, "chunk_id string, sig binary, text binary, bands array<bigint>, bits array<bigint>")
    return rows.mapInPandas(listed, "chunk_id string, members array<bigint>")


def _meetings(keyed: DataFrame) -> DataFrame:
    """(id, other): each two ids of a bucket (band), id < other; buckets may hold a third of all ids.

    A large bucket is cut into shares; each two shares (and each share with itself) meet under a key of their own.
    """
    # most buckets hold one id: what is left is a small table, from one pass over the sorted buckets
    counted = stored(keyed.withColumn("m", F.count("*").over(Window.partitionBy("band"))).filter("m > 1"), "buckets")
    light = counted.filter(F.col("m") <= BUCKET_SHARE).select("id", "band")
    twin = light.select(F.col("id").alias("other"), "band")
    few = light.join(twin, "band").filter(F.col("id") < F.col("other")).select("id", "other")
    shares = F.ceil(F.col("m") / BUCKET_SHARE).cast("int")
    heavy = counted.filter(F.col("m") > BUCKET_SHARE).withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("id", "band"), F.col("shares")).cast("int"))
    spread = heavy.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    spread = spread.select("id", "band", "own", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"))
    # under the key (p, q) the share p meets the share q
    left, right = spread.filter(F.col("own") == F.col("p")), spread.filter(F.col("own") == F.col("q")).withColumnRenamed("id", "other")
    many = left.drop("own").join(right.drop("own"), ["band", "p", "q"]).filter((F.col("id") < F.col("other")) | (F.col("p") < F.col("q")))
    return few.unionByName(many.select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other")))


class NearDuplicates:
    """Groups of chunks whose word-shingle sets have a Jaccard similarity of at least ``threshold``.

    ``links``: (a, b, similarity) between class representatives, one chunk_id for each different
    set, a < b. ``members``: (chunk_id, rep): every chunk with at least min_members shingles.
    Chunks with the same shingle set are one class and are never compared. Null, blank and
    too short texts have no shingles and take no part. Rows that repeat a chunk_id count once.
    """

    def __init__(self, chunks: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, min_members: int = MIN_MEMBERS):
        bins = bands_for(threshold)
        sketched = stored(_sets(chunks, size, min_members, bins), "sketches")
        first = sketched.groupBy("sig").agg(F.min("chunk_id").alias("rep"), F.first("bands").alias("bands"))
        reps = sketched.groupBy("sig").agg(F.min("chunk_id").alias("rep"), F.first("bits").alias("bits"))
        self.members = sketched.select("chunk_id", "sig", "text").dropDuplicates(["chunk_id"]).join(reps.select("sig", "rep"), "sig").select("chunk_id", "rep", "text")
        keyed = first.select(F.xxhash64("rep").alias("id"), F.explode("bands").alias("band"))
        pairs = _meetings(keyed).distinct()
        bits = reps.select(F.xxhash64("rep").alias("id"), F.col("bits")[0].alias("p"), F.col("bits")[1].alias("q"))
        pairs = pairs.join(bits, "id").join(bits.toDF("other", "r", "s"), "other")
        agree = F.lit(BITS) - F.bit_count(F.col("p").bitwiseXOR(F.col("r"))) - F.bit_count(F.col("q").bitwiseXOR(F.col("s")))
        pairs = stored(pairs.filter(agree >= least_agreement(threshold)).select("id", "other"), "candidates")
        ids = pairs.select("id").union(pairs.select("other")).distinct()
        if pairs.count() <= BROADCAST_IDS // 2:
            ids = F.broadcast(ids)
        texts = chunks.select("chunk_id", "content").withColumn("id", F.xxhash64("chunk_id")).join(ids, "id", "left_semi").dropDuplicates(["chunk_id"])
        # an id that two chunks share by chance only adds a comparison, since the sets decide
        sets = stored(_sets(texts, size, min_members, None).withColumn("id", F.xxhash64("chunk_id")), "sets")
        a = sets.select("id", F.col("chunk_id").alias("x"), F.col("members").alias("mx"))
        b = sets.select(F.col("id").alias("other"), F.col("chunk_id").alias("y"), F.col("members").alias("my"))
        both = pairs.join(a, "id").join(b, "other")
        shared = F.size(F.array_intersect("mx", "my"))
        scored = both.select("x", "y", F.size("mx").alias("nx"), F.size("my").alias("ny"), shared.alias("n"))
        scored = scored.withColumn("similarity", F.col("n") / (F.col("nx") + F.col("ny") - F.col("n")))
        self.links = scored.filter((F.col("similarity") >= threshold) & (F.col("nx") >= min_members) & (F.col("ny") >= min_members)).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity"
        )

    def pairs(self) -> DataFrame:
        """(chunk_id_a, chunk_id_b): all pairs of similar chunks, the smaller id first.

        Every two different texts are paired. Byte-equal texts are paired with each other up to
        PAIRED_COPIES of them; of more than that the first one alone stands for its text, and is
        paired with each of its copies. ``membership`` has the classes of all.
        """
        members = stored(self.members, "members")
        copies = members.groupBy("rep", "text").agg(F.count("*").alias("n"), F.min("chunk_id").alias("lead"))
        crowds = copies.filter(F.col("n") > PAIRED_COPIES).select("rep", "text", "lead")
        # chunks that are paired in full: all but the copies in crowds, and the first of each crowd
        out = members.join(crowds, ["rep", "text"], "left_anti").select("chunk_id", "rep").unionByName(crowds.select(F.col("lead").alias("chunk_id"), "rep"))
        left, right = out.select(F.col("rep").alias("a"), F.col("chunk_id").alias("p")), out.select(F.col("rep").alias("b"), F.col("chunk_id").alias("q"))
        across = self.links.select("a", "b").join(left, "a").join(right, "b").select("p", "q")
        several = out.groupBy("rep").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("rep")
        inner = out.join(several, "rep", "left_semi")
        within = _meetings(inner.select(F.col("chunk_id").alias("id"), F.col("rep").alias("band"))).toDF("p", "q")
        star = members.join(crowds, ["rep", "text"]).filter("chunk_id <> lead").select(F.col("lead").alias("p"), F.col("chunk_id").alias("q"))
        return across.unionByName(within).unionByName(star).select(F.least("p", "q").alias("chunk_id_a"), F.greatest("p", "q").alias("chunk_id_b"))

    def membership(self) -> DataFrame:
        """(chunk_id, rep): for every chunk the first one with the same set of shingles."""
        return self.members.select("chunk_id", "rep")

    def groups(self, max_rounds: int = 50) -> DataFrame:
        """(chunk_id, group_id, n_links): connected classes, by the least chunk_id that links reach.

        Min-label rounds with pointer jumping; each round is a written table.
        """
        edges = self.links.select("a", "b").union(self.links.select("b", "a")).toDF("node", "to")
        edges = stored(edges, "edges")
        degree = edges.groupBy("node").agg(F.count("*").alias("n_links"))
        label = stored(edges.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "labels")
        for _ in range(max_rounds):
            near = edges.join(label.select(F.col("node").alias("to"), F.col("label").alias("seen")), "to").groupBy("node").agg(F.min("seen").alias("seen"))
            step = label.join(near, "node").select("node", "label", F.least("label", "seen").alias("low"))
            jump = label.select(F.col("node").alias("low"), F.col("label").alias("far"))
            new = stored(step.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("next")), "labels")
            if new.filter("label <> next").isEmpty():
                break
            label = new.select("node", F.col("next").alias("label"))
        else:
            raise RuntimeError(f"labels still changed after {max_rounds} rounds")
        found = label.join(degree, "node").withColumnRenamed("node", "rep")
        return self.members.join(found, "rep", "left").select("chunk_id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
