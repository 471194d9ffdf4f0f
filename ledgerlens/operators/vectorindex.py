"""An index over the vectors of a collection: rows lie in cells around centroids, and a search reads a few cells."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.vectors import usable
from ledgerlens.operators.retrieval import batch_topk, cosine_topk
from ledgerlens.runtime import filesystem

#: Rows of a cell, the most cells (a folder each), and the vectors the centroids are fitted on at most. Every vector is indexed.
CELL_ROWS, MOST_CELLS, FIT_ROWS = 5_000, 4_096, 65_536


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Unit vectors around which the sample falls into cells: k-means by cosine."""
    rng = np.random.default_rng(seed)
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    c = x[rng.choice(len(x), cells, replace=cells > len(x))]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        lost = np.flatnonzero(~sums.any(axis=1))
        sums[lost] = x[rng.integers(len(x), size=len(lost))]
        c = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return c


class VectorIndex:
    """Rows of a table by the cell of their vector, one folder for each cell; vectors of one length.

    Rows whose vector is null, empty, zero or not finite, or of another length, are never found and are not in it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        at, fs = filesystem(spark, f"{path}/centroids.json")
        stream = fs.open(at)
        kept = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        self.centroids, self.schema = np.array(kept["centroids"]), StructType.fromJson(kept["schema"])

    @classmethod
    def build(cls, rows: DataFrame, path: str, column: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Write the index; ``cells`` is chosen from the number of rows (their root at the least)."""
        spark = rows.sparkSession
        good = rows.filter(usable(F.col(column)))
        per = good.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
        d, n = (per[0], per[1]) if per else (1, 0)
        good = good.filter(F.size(column) == d)
        cells = cells or int(min(MOST_CELLS, max(1, round(n / CELL_ROWS), round(n**0.5 / 4))))
        sample = good.select(F.col(column).cast("array<double>").alias("v")).sample(min(1.0, 1.2 * FIT_ROWS / max(1, n)), seed=4).limit(FIT_ROWS).toPandas()["v"]
        centroids = fit_centroids(np.stack(sample.to_numpy()), cells) if len(sample) else np.ones((1, d)) / d**0.5
        sent = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors

        @F.pandas_udf("int")
        def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                yield pd.Series((np.stack(v.to_numpy()) @ sent.value.T).argmax(axis=1).astype(np.int32) if len(v) else [], dtype="int32")

        # rows of a busy cell are written by several tasks
        laid = good.withColumn("cell", cell(F.col(column).cast("array<double>"))).repartition("cell", F.pmod(F.xxhash64(column), F.lit(4)))
        laid.write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        at, fs = filesystem(spark, f"{path}/centroids.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"centroids": centroids.tolist(), "schema": laid.schema.jsonValue()}).encode()))
        out.close()
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def near(self, vector: list[float], probes: int) -> list[int]:
        """The cells whose centroids are nearest."""
        return [int(c) for c in np.argsort(-(self.centroids @ np.asarray(vector, dtype=float)), kind="stable")[:probes]]

    def search(self, vector: list[float], k: int = 5, key: str = "vec_id", probes: int = 16, column: str = "embedding", filters: dict | None = None) -> DataFrame:
        """The k rows of highest cosine among those of the ``probes`` nearest cells; other cells are not read."""
        return cosine_topk(self.rows().filter(F.col("cell").isin(self.near(vector, probes))), vector, k, key, column, filters)

    def search_all(self, queries: DataFrame, k: int = 5, key: str = "vec_id", probes: int = 16, column: str = "embedding", exclude_self: bool = True) -> DataFrame:
        """(query, key, score, rank) for a bounded set of query vectors: the rows of all cells that one of them visits, in blocks."""
        asked = queries.filter(usable(F.col(column))).select(column).toPandas()[column]
        visited = sorted({c for v in asked for c in self.near(v, probes) if len(v) == self.centroids.shape[1]})
        return batch_topk(self.rows().filter(F.col("cell").isin(visited)), queries, k, key, column, exclude_self)
