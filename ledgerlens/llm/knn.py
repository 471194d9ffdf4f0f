"""Problem 2: the k most similar vectors for every vector, as a block matrix join.

Vectors are brought to unit length. Query and base blocks meet as tiles; a tile quantises both to int8,
and the int8 product gives every cosine with a bound on its error. Pairs that may still be
among the k best (or reach min_cosine) survive and are recomputed from the floats in the tile, which hands on
k for each query; the k best of all tiles are merged. Blocks are cells around centroids; a query visits the
``probes`` nearest cells, or all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import stored

#: Vectors the cells' centroids are fitted on: so many, and for many cells FIT_PER_CELL for each (the index; every vector is then assigned).
FIT_ROWS, FIT_PER_CELL = 32_768, 8
#: Rows a cell should have. Beyond MANY_CELLS cells both their number and their rows grow as the root of the collection, so that
#: finding a vector's cells costs as much as searching them.
CELL_ROWS, MANY_CELLS = 2_000, 4_096
#: Probes are measured on so many queries: the least number of cells that finds RECALL of their exact neighbours, LEAST_PROBES at least.
PROBE_QUERIES, RECALL, LEAST_PROBES = 512, 0.995, 3
#: Base rows of one tile, and query rows multiplied at a time.
TILE_ROWS, QUERY_ROWS = 4_096, 1_024
#: Surviving pairs recomputed at a time.
SURVIVORS = 200_000


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, dim, unit array<float>): one row per key whose vector is not null, empty, zero, or not finite."""

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, dims, units = [], [], []
            for cid, v in zip(pdf["id"], pdf["v"]):
                v = np.asarray([np.nan if x is None else x for x in v] if v.dtype == object else v, dtype=np.float64)
                top = np.abs(v).max() if len(v) else 0.0
                if not np.isfinite(v).all() or not top > 0:
                    continue
                v = v / top  # neither overflows nor vanishes
                ids.append(cid)
                dims.append(len(v))
                units.append((v / np.sqrt(v @ v)).astype(np.float32))
            yield pd.DataFrame({"id": pd.Series(ids, dtype=str), "dim": pd.Series(dims, dtype="int32"), "unit": pd.Series(units, dtype=object)})

    rows = df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & (F.size("v") > 0))
    return rows.mapInPandas(unit, "id string, dim int, unit array<float>")


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what quantising lost."""
    scale = np.maximum(np.abs(units).max(axis=1), 1e-12) / 127.0
    q = np.rint(units / scale[:, None]).astype(np.int8)
    return q, scale.astype(np.float32), np.linalg.norm(units - q * scale[:, None], axis=1).astype(np.float32)


def centroids(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), cells, replace=len(sample) < cells)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[i : i + 8192] @ c.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        empty = ~total.any(axis=1)
        total[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def cell_count(n: int) -> int:
    cells = max(1, round(n / CELL_ROWS))
    return cells if cells <= MANY_CELLS else round(MANY_CELLS * (cells / MANY_CELLS) ** 0.5)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32)


def _tile(k: int, min_cosine: float | None):
    """The tile's k best of each query, ties by id: survivors of the int8 bounds, recomputed from the floats."""

    def join(key: tuple, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(base):
            bu, bid, bids = _matrix(base["unit"]), base["id"].to_numpy(), base["ids"].to_numpy()
            bq, bs, be = quantise(bu)
            bq = bq.astype(np.float32).T.copy()
            index = pd.Index(bid)
            for at in range(0, len(queries), QUERY_ROWS):
                part = queries.iloc[at : at + QUERY_ROWS]
                qu, qid = _matrix(part["unit"]), part["id"].to_numpy()
                qq, qs, qe = quantise(qu)
                # integers below 2^24, so the float product is the exact integer product
                cos = (qq.astype(np.float32) @ bq) * qs[:, None] * bs[None, :]
                # |ab - a'b'| <= |a - a'| |b| + |a'| |b - b'|, and |a'| <= 1 + |a - a'|
                bound = qe[:, None] + (1 + qe[:, None]) * be[None, :] + 1e-6
                order = index.get_indexer(qid)
                hit = np.flatnonzero(order >= 0)
                cos[hit, order[hit]] = -9  # itself
                least = np.full(len(part), -8.0 if min_cosine is None else min_cosine - 1e-6, np.float32)
                if cos.shape[1] > k:
                    low = cos - bound
                    least = np.maximum(least, -np.partition(-low, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(cos + bound >= least[:, None])
                for some in range(0, len(i), SURVIVORS):  # a crowd of close vectors survives whole
                    a, b = i[some : some + SURVIVORS], j[some : some + SURVIVORS]
                    exact = np.einsum("nd,nd->n", qu[a].astype(np.float64), bu[b].astype(np.float64))
                    out.append(pd.DataFrame({"id": qid[a], "cosine": np.minimum(exact, 1.0), "at": b}))
                    if len(out) > 1 and sum(map(len, out)) > 2 * SURVIVORS:
                        out = [heads(pd.concat(out), bids)]
        if not out:
            return pd.DataFrame({"id": np.empty(0, np.int64), "ids": pd.Series([], dtype=object), "cosine": np.empty(0)})
        best = heads(pd.concat(out), bids)
        return pd.DataFrame({"id": best["id"].to_numpy(), "ids": bids[best["at"].to_numpy()], "cosine": best["cosine"].to_numpy()})

    def heads(rows: pd.DataFrame, bids: np.ndarray) -> pd.DataFrame:
        if min_cosine is not None:
            rows = rows[rows["cosine"] >= min_cosine]
        first = np.array([x[0] for x in bids[rows["at"].to_numpy()]], dtype=object)
        rows = rows.assign(first=first).sort_values(["id", "cosine", "first"], ascending=[True, False, True])
        return rows[rows.groupby("id").cumcount() < k].drop(columns="first")

    return join


def _measured_probes(spark, heads: DataFrame, fits: dict, n: int, k: int, min_cosine: float | None) -> int:
    """The least number of cells in which RECALL of the exact neighbours of PROBE_QUERIES points lie."""
    share = min(1.0, 2.0 * PROBE_QUERIES / n)
    drawn = heads.filter(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int(share * (1 << 30))).select("point", "dim", "unit").orderBy(F.xxhash64("point")).limit(PROBE_QUERIES).toPandas()
    asked = {int(d): (g["point"].to_numpy(), _matrix(g["unit"])) for d, g in drawn.groupby("dim")}
    sent = spark.sparkContext.broadcast((asked, fits))  # bounded: PROBE_QUERIES vectors and the centroids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, fits = sent.value
        for pdf in batches:
            for d, part in pdf.groupby("dim"):
                if int(d) not in asked:
                    continue
                ids, q = asked[int(d)]
                u, own, c = _matrix(part["unit"]), part["point"].to_numpy(), fits[int(d)]
                s = q @ u.T
                s[ids[:, None] == own[None, :]] = -9
                take = min(k, s.shape[1])
                j = np.argpartition(-s, take - 1, axis=1)[:, :take]
                i = np.repeat(np.arange(len(ids)), take)
                j = j.ravel()
                ok = s[i, j] >= (-8 if min_cosine is None else min_cosine)
                i, j = i[ok], j[ok]
                mine = (u[j] @ c.T).argmax(axis=1)
                near = q[i] @ c.T
                rank = (near > near[np.arange(len(i)), mine][:, None]).sum(axis=1)
                yield pd.DataFrame({"id": ids[i], "cosine": s[i, j].astype(float), "rank": rank.astype(np.int32)})

    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "rank")
    found = heads.select("point", "dim", "unit").mapInPandas(run, "id long, cosine double, rank int").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k)
    ranks = np.sort(found.select("rank").toPandas()["rank"].to_numpy())  # k rows for each of PROBE_QUERIES
    if not len(ranks):
        return LEAST_PROBES
    return max(LEAST_PROBES, int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))) - 1)]) + 1)


def nearest(
    df: DataFrame,
    key: str = "chunk_id",
    vector: str = "embedding",
    k: int = 5,
    queries: DataFrame | None = None,
    min_cosine: float | None = None,
    probes: int | str | None = "measured",
) -> DataFrame:
    """(id, neighbour, cosine, rank): for each query the k rows of highest cosine, ties by id.

    ``queries`` (a column named as ``key``) limits whose neighbours are sought, never among whom.
    ``probes=None`` visits every cell: exact; "measured" so many as find RECALL of the neighbours of a sample. ``min_cosine`` drops neighbours below it, and lets tiles
    discard more. Vectors that are null, empty, zero or not finite take no part, nor do null keys; vectors
    of different length never meet. Repeated keys count once. Equal vectors (however many) are one point;
    neighbours among them are those of least id.
    """
    spark = df.sparkSession
    unit = usable(df, key, vector).dropDuplicates(["id"]).withColumn("point", F.xxhash64("unit"))
    unit = stored(unit, "units")
    # of each group of equal vectors the k + 1 least ids can be anyone's neighbours; ranks are cut before the shuffle
    member = Window.partitionBy("point", "dim").orderBy("id")
    heads = stored(unit.withColumn("nth", F.row_number().over(member)).filter(F.col("nth") <= k + 1).groupBy("point", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("unit").alias("unit")), "points")
    n = heads.count()
    if n == 0:
        return spark.createDataFrame([], "id string, neighbour string, cosine double, rank int")
    asked = unit if queries is None else unit.join(queries.select(F.col(key).cast("string").alias("id")).distinct(), "id", "left_semi")
    if queries is None:
        points = heads
    else:
        points = heads.join(asked.select("point", "dim").distinct(), ["point", "dim"], "left_semi")
    cells = cell_count(n)
    fit_rows = max(FIT_ROWS, FIT_PER_CELL * cells)
    fits = {}
    for d, m in sorted((r[0], r[1]) for r in heads.groupBy("dim").count().collect()):  # one row per length of vector
        sample = heads.filter(F.col("dim") == d).select("unit").sample(min(1.0, 1.2 * fit_rows / m), seed=11).limit(fit_rows).toPandas()["unit"]
        c = max(1, round(cells * m / n))
        fits[d] = centroids(np.stack(sample.to_numpy()).astype(np.float32), c) if len(sample) and c > 1 else np.zeros((1, d), np.float32)
    if probes == "measured":
        probes = _measured_probes(spark, heads, fits, n, k, min_cosine)
    sent = spark.sparkContext.broadcast(fits)

    def assign(copies: int | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for d, part in pdf.groupby("dim"):
                    c = sent.value[int(d)]
                    take = len(c) if copies is None else min(copies, len(c))
                    if take == len(c):
                        near = np.tile(np.arange(take, dtype=np.int32), (len(part), 1))
                    else:
                        near = np.argpartition(-(_matrix(part["unit"]) @ c.T), take - 1, axis=1)[:, :take].astype(np.int32)
                    yield part.assign(cells=list(near))

        return run

    base = heads.select("point", "dim", "unit", "ids").mapInPandas(assign(1), "point long, dim int, unit array<float>, ids array<string>, cells array<int>")
    base = stored(base.select(F.col("point").alias("id"), "dim", "unit", "ids", F.col("cells")[0].alias("cell")), "base")
    # one row for each cell
    sizes = stored(base.groupBy("dim", "cell").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles")), "sizes")
    base = base.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    visits = points.select("point", "dim", "unit").mapInPandas(assign(probes), "point long, dim int, unit array<float>, cells array<int>")
    visits = visits.select(F.col("point").alias("id"), "dim", "unit", F.explode("cells").alias("cell"))
    visits = visits.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # queries of a busy cell are spread as well: each share of them meets the cell's tile on its own
    load = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.max("tiles") / (8 * TILE_ROWS)).cast("int").alias("shares"))
    load = stored(load, "load")
    visits = visits.join(F.broadcast(load), ["dim", "cell"]).withColumn("share", F.pmod(F.xxhash64("id", "cell"), F.col("shares")).cast("int"))
    base = base.join(F.broadcast(load), ["dim", "cell"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    by = ["dim", "cell", "tile", "share"]
    met = visits.select(*by, "id", "unit").groupBy(*by).cogroup(base.select(*by, "id", "unit", "ids").groupBy(*by))
    near = met.applyInPandas(_tile(k, min_cosine), "id long, ids array<string>, cosine double")
    # members of other points, the k best per point
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    near = near.select("id", "cosine", F.explode("ids").alias("neighbour")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    near = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("minus"), "neighbour"))).alias("far"))
    # a member's neighbours: the least ids of its own point (cosine 1), then those of other points
    points = heads.select("point", "ids").join(near.withColumnRenamed("id", "point"), "point", "left")
    # a group of equal vectors may hold a third of all rows, so its row is copied and its members spread
    spread = 16
    points = points.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.size("ids") > k, spread - 1).otherwise(0))))
    asked = asked.select("id", "point")
    salted = points.withColumn("many", F.size("ids") > k)
    plain = asked.join(salted.filter(~F.col("many")).drop("salt"), "point")
    crowd = asked.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")).join(salted.filter("many"), ["point", "salt"])
    rows = plain.select("id", "ids", "far").unionByName(crowd.select("id", "ids", "far"))
    own = F.transform(F.filter("ids", lambda x: x != F.col("id")), lambda x: F.struct(F.lit(-1.0).alias("minus"), x.alias("neighbour")))
    far = F.coalesce("far", F.array().cast("array<struct<minus:double,neighbour:string>>"))
    both = F.slice(F.array_sort(F.concat(own, far)), 1, k)
    out = rows.select("id", F.posexplode(both).alias("pos", "x"))
    return out.select("id", F.col("x.neighbour").alias("neighbour"), (-F.col("x.minus")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
