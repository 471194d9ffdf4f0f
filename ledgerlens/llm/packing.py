"""Problem 6: fill containers of fixed capacity with items, splitting only what exceeds the capacity.

Bulk-synchronous best fit. Items of one size are interchangeable, and so are containers with one
gap: the rounds run over sizes and gaps (at most as many as the capacity) instead of over
items. In a round each size finds its successor, the least gap it fits in, by one sweep over
the sorted gaps; sizes that want the same gap are served by rank, the larger first; gaps are
brought up to date, and the rest waits for the next round. What a round decides is a run of ranks
within a size that goes to a run of containers, so that every item finds its container from its rank.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import stored

#: Items of one size that are numbered together in one task.
RANKED_TOGETHER = 50_000
#: Runs of all plans are broadcast up to this many (32 bytes each), else joined by shuffle.
BROADCAST_RUNS = 2_000_000


def most_runs(sizes: int, capacity: int) -> int:
    """A bound on the runs of a plan, whatever the number of items.

    A run either uses up a size (at most once for each, and leaves up to four runs of containers) or fills a run of
    containers up to a smaller gap; a gap shrinks by an item at a time, so at most capacity times.
    """
    return 4 * sizes * (capacity + 1)


def plan_containers(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, items per container, first container), and how many containers there are.

    sizes are distinct, between 1 and capacity; counts are how many items have each.
    """
    left = {int(s): int(n) for s, n in zip(sizes, counts) if n > 0}
    done = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of containers (first, how many)
    total = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                insort(gaps, gap)
                open_[gap] = []
            open_[gap].append((first, n))

    def place(size: int, first: int, gap: int, n: int) -> int:
        """Items of a size into n containers of a gap from first on, as many in each as it holds; returns the containers used."""
        each = gap // size
        full = min(n, left[size] // each)
        if full:
            runs.append((size, done[size], each, first))
            put(gap - each * size, first, full)
            done[size] += full * each
            left[size] -= full * each
        if full < n and left[size]:  # fewer than a container holds are left
            runs.append((size, done[size], left[size], first + full))
            put(gap - left[size] * size, first + full, 1)
            done[size] += left[size]
            left[size] = 0
            full += 1
        return full

    while left:
        largest = max(left)
        # smaller sizes wait, lest they take what only larger ones could still use; but none waits if it fits exactly
        round_sizes = sorted((s for s in left if 2 * s > largest or s in open_), reverse=True)
        wanted: dict[int, list[int]] = {}
        alone = []
        for s in round_sizes:  # the sweep, against the gaps as the round found them
            at = bisect_left(gaps, s)
            if at < len(gaps):
                wanted.setdefault(gaps[at], []).append(s)
            elif 2 * s > capacity or s == largest:
                alone.append(s)
        for gap, ranked in wanted.items():
            free = open_.pop(gap)
            gaps.remove(gap)
            for s in ranked:
                while left[s] and free:
                    first, n = free.pop()
                    used = place(s, first, gap, n)
                    if used < n:
                        free.append((first + used, n - used))
            for first, n in free:
                put(gap, first, n)
        for s in alone:
            n = -(-left[s] // (capacity // s))
            place(s, total, capacity, n)
            total += n
        left = {s: n for s, n in left.items() if n}
    return runs, total


def pack(items: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "tokens", window: str = "window_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(window, key, part, tokens, container_id): where each item goes, for each capacity.

    An item larger than the capacity comes in parts of the capacity and one rest; all others stay
    whole, with part 0. container_id counts from 0 within a window. Items of size 0 or null
    take no space: container_id null, tokens 0. Null keys are items too. Null or non-positive
    capacities give no rows. ``capacities`` is a small table of parameters.
    """
    spark = items.sparkSession
    windows = {r[0]: int(r[1]) for r in capacities.select(window, capacity).distinct().collect() if r[0] is not None and r[1] and r[1] > 0}
    kind, wkind = items.schema[key].dataType.simpleString(), capacities.schema[window].dataType.simpleString()
    shape = f"{window} {wkind}, {key} {kind}, part int, tokens int, container_id bigint"
    if not windows:
        return spark.createDataFrame([], shape)
    base = items.select(key, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    each = F.array(*[F.struct(F.lit(w).cast(wkind).alias("w"), F.lit(c).cast("long").alias("c")) for w, c in windows.items()])
    rows = base.withColumn("x", F.explode(each)).select(F.col("x.w").alias("w"), F.col("x.c").alias("c"), key, "n")
    whole = F.when(F.col("n") > 0, F.ceil(F.col("n") / F.col("c"))).otherwise(1).cast("int")
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), whole - 1)))
    parts = parts.select("w", key, "part", F.least(F.col("n") - F.col("part") * F.col("c"), F.col("c")).cast("int").alias("tokens"))
    n = base.count()
    shards = max(1, -(-n // RANKED_TOGETHER))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64(key, "part"), F.lit(shards)).cast("int"))
    counts = stored(parts.filter("tokens > 0").groupBy("w", "tokens", "shard").agg(F.count("*").alias("n")), "sizes")
    # at most as many rows as the capacities add up to
    table = counts.groupBy("w", "tokens").agg(F.sum("n").alias("n")).toPandas()
    plans = {}
    for w, c in windows.items():
        own = table[table["w"] == w].sort_values("tokens")
        runs, _ = plan_containers(own["tokens"].to_numpy(), own["n"].to_numpy(), c)
        plans[w] = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    before = Window.partitionBy("w", "tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("w", "tokens", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("w", "tokens", "shard").orderBy(F.xxhash64(key, "part"), key, "part")
    ranked = parts.withColumn("nth", F.row_number().over(within)).join(starts, ["w", "tokens", "shard"], "left")
    ranked = ranked.select("w", key, "part", "tokens", (F.coalesce("start", F.lit(0)) + F.col("nth") - 1).alias("rank"))

    if sum(map(len, plans.values())) > BROADCAST_RUNS:
        return _joined(ranked, plans, wkind).select(F.col("w").alias(window), key, "part", "tokens", "container_id")
    sent = spark.sparkContext.broadcast({w: (a[:, 0] * (1 << 40) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]) for w, a in plans.items()})

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            box = pd.Series(pd.NA, index=pdf.index, dtype="Int64")
            for w, own in pdf[pdf["tokens"] > 0].groupby("w"):
                at, low, share, first = sent.value[w]
                rank = own["rank"].to_numpy(np.int64)
                k = np.searchsorted(at, own["tokens"].to_numpy(np.int64) * (1 << 40) + rank, side="right") - 1
                box[own.index] = first[k] + (rank - low[k]) // share[k]
            yield pd.DataFrame({window: pdf["w"], key: pdf[key], "part": pdf["part"], "tokens": pdf["tokens"], "container_id": box})

    return ranked.mapInPandas(assign, shape)


def _joined(ranked: DataFrame, plans: dict, wkind: str) -> DataFrame:
    """ranked with container_id, by a join on the size; each size has its runs in one array, in order of their first ranks."""
    rows = [(w, int(s), a[a[:, 0] == s, 1:].tolist()) for w, a in plans.items() for s in np.unique(a[:, 0])]
    runs = ranked.sparkSession.createDataFrame(rows, f"w {wkind}, tokens int, runs array<array<bigint>>")
    joined = ranked.join(runs, ["w", "tokens"], "left")
    run = F.element_at(F.filter("runs", lambda r: r[0] <= F.col("rank")), -1)
    return joined.withColumn("run", F.when(F.col("runs").isNotNull(), run)).withColumn("container_id", F.expr("run[2] + (rank - run[0]) div run[1]"))


def fill_report(packed: DataFrame, capacities: DataFrame, window: str = "window_id", capacity: str = "capacity_tokens") -> DataFrame:
    """(window, capacity, containers, tokens, unused_share) of a packing."""
    used = packed.filter(F.col("container_id").isNotNull()).groupBy(window).agg((F.max("container_id") + 1).alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(capacities.select(window, capacity).distinct()), window).select(window, capacity, "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col(capacity))).alias("unused_share"))
