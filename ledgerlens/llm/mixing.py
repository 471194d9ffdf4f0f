"""Problem 7: mix sources to target shares of the total size.

Each source's documents fall into blocks. A mix takes so many whole blocks of each source (all
of them once per full repeat, and a part of a permutation of them for the rest); a
splitting tree halves the output shards again and again, drawing from the multivariate
hypergeometric distribution how many blocks of each source go to either half. Every shard then
takes its numbers of blocks from the sources' permutations, disjoint by construction, and
shuffles its documents on its own.

The driver holds a few numbers per mix and source. Blocks are rows of a table; where a block
stands in its permutation comes from running sums in two steps, and its shard from walking the
tree, whose draws depend on their place in it alone, so that every task can repeat them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import stored

#: Documents of a block at least; blocks of a source at most, but always so many for each shard of the largest mix.
BLOCK_DOCS, BLOCKS, SHARD_BLOCKS = 8, 1_024, 8
#: Documents a shard should hold.
SHARD_DOCS = 50_000
#: Permuted blocks are summed up in so many runs before the running sums.
RUNS = 1_024
#: Up to this many rows the drawn blocks are broadcast, else joined by shuffle.
BROADCAST_ROWS = 200_000


def shards_of(counts: list[int], shards: int, source: np.ndarray, position: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """The shard of each block, from its source and its place in the permutation of that source's blocks.

    counts: blocks of each source. Shards differ by one block at most. A node of the tree draws from
    the seed and its own place (first shard, number of shards), so nothing has to be handed around.
    """
    out = np.empty(len(position), np.int64)

    def walk(have: np.ndarray, first: int, n: int, rows: np.ndarray, place: np.ndarray) -> None:
        if not len(rows):
            return
        if n == 1:
            out[rows] = first
            return
        left = n // 2
        total = int(have.sum())
        rng = np.random.default_rng([*seed, first, n])
        drawn = rng.multivariate_hypergeometric(have, total * left // n, method="marginals") if total else np.zeros_like(have)
        low = place < drawn[source[rows]]
        walk(drawn, first, left, rows[low], place[low])
        walk(have - drawn, first + left, n - left, rows[~low], (place - drawn[source[rows]])[~low])

    walk(np.asarray(counts, np.int64), 0, shards, np.arange(len(position)), np.asarray(position, np.int64))
    return out


def running(rows: DataFrame, by: list[str], order: Column, sums: dict[str, str]) -> DataFrame:
    """rows with, for each (name: column) of sums, the sum of the column over earlier rows of the group.

    order: a 64-bit hash (ties by the columns source, repeat_no, block). Runs of the hash's leading bits are summed first, so that no
    group has to be sorted in one task however many rows it has.
    """
    bits = RUNS.bit_length() - 1
    rows = rows.withColumn("__at", order).withColumn("__run", F.shiftrightunsigned(F.col("__at").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int"))
    ahead = Window.partitionBy(*by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    # at most RUNS rows for each group
    per = rows.groupBy(*by, "__run").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    per = per.select(*by, "__run", *[F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy(*by, "__run").orderBy("__at", "source", "repeat_no", "block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = rows.join(per, [*by, "__run"])
    return joined.select(*[c for c in rows.columns if not c.startswith("__") and c not in sums], *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def quotas(shares: list[float], caps: list[int | None], available: list[int], total: float | None = None) -> list[float]:
    """Tokens of each source: its share of the largest total at which no source has to be used beyond its cap.

    Shares may be fractions or percent and need not add up. A source without documents gets
    none, and the others keep their proportions. Without any cap, every source is used
    at least once in full. A given total is reached as far as the caps allow.
    """
    live = [s if s and s > 0 and a > 0 and (c is None or c > 0) else 0.0 for s, c, a in zip(shares, caps, available)]
    whole = sum(live)
    if not whole:
        return [0.0] * len(live)
    part = [s / whole for s in live]
    most = [c * a / p for p, c, a in zip(part, caps, available) if p and c is not None]
    size = min(most) if most else max(a / p for p, a in zip(part, available) if p)
    if total is not None:
        size = total
    return [min(p * size, c * a) if c is not None else p * size for p, c, a in zip(part, caps, available)]


def mix_sources(sizes: DataFrame, mixes: DataFrame, key: str = "doc_id", total_tokens: float | None = None, seed: int = 20) -> DataFrame:
    """(mix_id, shard, position, key, source, repeat_no, tokens): the documents of every mix, shard by shard.

    ``sizes`` has key, source, tokens; ``mixes`` (a small table of parameters) mix_id, source, target_share, max_repeats;
    a null max_repeats means no cap. A document occurs at most max_repeats times in a mix, its occurrences
    numbered by repeat_no from 1. The last document of a source is taken if that comes closer to the quota.
    Documents without key, source or tokens are never drawn; shares that are null or not positive ask for
    nothing; a source named twice in a mix counts with the sum of its shares and its least cap.
    """
    spark = sizes.sparkSession
    asked: dict = {}
    for m, s, share, cap in mixes.select("mix_id", "source", "target_share", "max_repeats").collect():
        if m is None or s is None:
            continue
        old = asked.setdefault(m, {}).get(s)
        if old:
            share, cap = (old[0] or 0) + (share or 0), cap if old[1] is None else old[1] if cap is None else min(cap, old[1])
        asked[m][s] = (share, cap)
    named = sorted({s for v in asked.values() for s in v})
    kind = sizes.schema[key].dataType.simpleString()
    mkind = mixes.schema["mix_id"].dataType.simpleString()
    docs = sizes.select(key, "source", F.col("tokens").cast("long").alias("tokens")).filter(F.col(key).isNotNull() & F.col("source").isin(named) & (F.col("tokens") > 0))
    per = {r["source"]: (r["t"], r["n"]) for r in docs.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}  # one row per named source
    shape = f"mix_id {mkind}, shard int, position int, {key} {kind}, source string, repeat_no int, tokens bigint"
    if not per:
        return spark.createDataFrame([], shape)
    plan, shards = [], {}
    for m in sorted(asked):
        names = [s for s in sorted(asked[m]) if s in per]
        want = quotas([asked[m][s][0] for s in names], [asked[m][s][1] for s in names], [per[s][0] for s in names], total_tokens)
        documents = 0
        for s, q in zip(names, want):
            have, n = per[s]
            full, cap = int(q / have + 1e-9), asked[m][s][1]
            rest = q - full * have if q > 0 and (cap is None or full < cap) else 0.0
            documents += -(-int(n * q) // have)
            if q > 0:
                plan.append((m, s, full, rest if rest > 0.5 else 0.0))
        shards[m] = max(1, -(-documents // SHARD_DOCS))
    if not plan:
        return spark.createDataFrame([], shape)
    most = max(shards.values())
    blocks_of = {s: max(1, min(max(BLOCKS, SHARD_BLOCKS * most), n // BLOCK_DOCS)) for s, (_, n) in per.items()}
    n_blocks = F.create_map(*[x for s, b in blocks_of.items() for x in (F.lit(s), F.lit(b))])[F.col("source")]
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), key), n_blocks).cast("int"))
    blocks = stored(docs.groupBy("source", "block").agg(F.sum("tokens").alias("t")), "blocks")
    # one row for each named source of each mix
    steps = F.broadcast(spark.createDataFrame(plan, f"mix_id {mkind}, source string, full int, rest double"))
    each = blocks.join(steps, "source")
    # whole repeats, and of one more so many blocks of a permutation as fit, with the one at the edge
    whole = each.filter("full > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("full")))).select("mix_id", "source", "block", "repeat_no", F.lit(None).cast("double").alias("room"))
    part = each.filter("rest > 0").withColumn("repeat_no", F.col("full") + 1)
    part = running(part, ["mix_id", "source"], F.xxhash64(F.lit(seed + 2), "mix_id", "source", "block"), {"before": "t"}).filter(F.col("before") < F.col("rest"))
    part = part.select("mix_id", "source", "block", "repeat_no", F.when(F.col("before") + F.col("t") > F.col("rest"), F.col("rest") - F.col("before")).alias("room"))
    drawn = stored(whole.unionByName(part).withColumn("one", F.lit(1)), "drawn")
    counts: dict = {m: {} for m in shards}
    for m, s, n in drawn.groupBy("mix_id", "source").count().collect():  # one row for each named source of each mix
        counts[m][s] = n
    placed = running(drawn, ["mix_id", "source"], F.xxhash64(F.lit(seed + 3), "mix_id", "source", "repeat_no", "block"), {"place": "one"}).drop("one")

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf), np.int64)
            for m, rows in pdf.groupby("mix_id").indices.items():
                names = sorted(counts[m])
                at = {s: i for i, s in enumerate(names)}
                own = pdf.iloc[rows]
                nth = sorted(shards).index(m)
                out[rows] = shards_of([counts[m][s] for s in names], shards[m], own["source"].map(at).to_numpy(), own["place"].to_numpy(), (seed, nth))
            yield pdf.drop(columns="place").assign(shard=out.astype(np.int32))

    placed = stored(placed.mapInPandas(shard, f"mix_id {mkind}, source string, block int, repeat_no int, room double, shard int"), "placed")
    if placed.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    drawn = docs.join(placed, ["source", "block"])
    taken = Window.partitionBy("mix_id", "source", "repeat_no").orderBy(F.xxhash64(F.lit(seed), "mix_id", key), key)
    # of the one block at the edge so many documents as fit, and one over it if that comes closer
    edges = drawn.filter(F.col("room").isNotNull()).withColumn("upto", F.sum("tokens").over(taken))
    edges = edges.filter((F.col("upto") <= F.col("room")) | (F.col("upto") - F.col("room") < F.col("room") - (F.col("upto") - F.col("tokens")))).drop("upto")
    rows = drawn.filter(F.col("room").isNull()).unionByName(edges)
    shuffled = Window.partitionBy("mix_id", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mix_id", key, "repeat_no"), key, "repeat_no")
    return rows.select("mix_id", "shard", (F.row_number().over(shuffled) - 1).alias("position"), key, "source", "repeat_no", "tokens")


def reached_shares(selection: DataFrame, mixes: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, max_repeats, documents, most_repeats, tokens, reached_share) for every row of the mixes."""
    per = selection.groupBy("mix_id", "source").agg(F.count("*").alias("documents"), F.max("repeat_no").alias("most_repeats"), F.sum("tokens").alias("tokens"))
    total = selection.groupBy("mix_id").agg(F.sum("tokens").alias("total"))
    out = mixes.select("mix_id", "source", "target_share", "max_repeats").join(per, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    w = Window.partitionBy("mix_id")
    return out.select(
        "mix_id", "source", (F.col("target_share") / F.sum("target_share").over(w)).alias("target_share"), "max_repeats",
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("reached_share"),
    )
