"""The collection of chunks and search over its vectors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.functions.text import word_count
from ledgerlens.functions.vectors import cosine, usable
from ledgerlens.runtime import filesystem, stored

#: Query vectors that are sent to every task at a time.
QUERY_BLOCK = 8_192
#: Buckets of a collection; an update writes those again that it touches.
BUCKETS = 64
FILTERS = ("source_document", "doc_type", "page_number", "label")


def one_per_chunk(chunks: DataFrame) -> DataFrame:
    """One row per chunk_id; copies differ in their ingestion time only. Rows without chunk_id are left out."""
    return chunks.filter(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])


def points(chunks: DataFrame) -> DataFrame:
    """The rows of the vector collection: chunks with a vector, and what a search returns of them."""
    rows = chunks.select("chunk_id", F.col("content").alias("text"), F.col("metadata.filename").alias("source_document"), "page_number", "chunk_index", "embedding")
    rows = one_per_chunk(rows.filter(F.size("embedding") > 0))
    return rows.select("chunk_id", "text", F.coalesce(word_count(F.col("text")), F.lit(0)).alias("word_count"), "source_document", "page_number", "chunk_index", "embedding")


def create_collection(spark: SparkSession, name: str, schema: str, overwrite: bool = False) -> None:
    """An empty table for points; an existing one stays unless it is to be replaced."""
    if overwrite:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def delete_collection(spark: SparkSession, path: str, really: bool = False) -> bool:
    """Remove the collection at path with all its versions; ``really`` has to be said. Whether there was one."""
    if not really:
        raise ValueError(f"say really=True to delete {path}")
    at, fs = filesystem(spark, path)
    return bool(fs.exists(at) and fs.delete(at, True))


def _manifests(spark: SparkSession, path: str) -> list[int]:
    at, fs = filesystem(spark, f"{path}/_manifest")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def _manifest(spark: SparkSession, path: str) -> dict:
    """{schema, key, parts: {bucket: folder}} of the newest version; empty where there is none."""
    versions = _manifests(spark, path)
    if not versions:
        return {}
    at, fs = filesystem(spark, f"{path}/_manifest/{versions[-1]}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _folders(path: str, manifest: dict, buckets: list[int] | None = None) -> list[str]:
    return [f"{path}/{v}/bucket={b}" for b, v in manifest["parts"].items() if buckets is None or int(b) in buckets]


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """The points of the newest complete version."""
    manifest = _manifest(spark, path)
    if not manifest:
        raise FileNotFoundError(f"no collection at {path}")
    schema = StructType.fromJson(manifest["schema"])
    folders = _folders(path, manifest)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def store_points(new: DataFrame, path: str, document: str = "source_document") -> int:
    """Add points to the collection at path; returns how many it holds.

    A document that ``new`` brings is replaced as a whole, so that what a longer earlier version left behind is gone;
    without a column of that name, points are replaced by their chunk_id. The collection lies in buckets of the document, and
    only buckets that ``new`` touches are written again. Data are written beside the old ones; the new version
    exists once its manifest does, which is created in one step: whatever fails before leaves the old version to all readers. Two
    writers at a time: the second fails. The version before the last is kept for readers that are at work, older ones are removed.
    """
    spark = new.sparkSession
    key = document if document in new.columns else "chunk_id"
    versions, old = _manifests(spark, path), _manifest(spark, path)
    if old and old["key"] != key:
        raise ValueError(f"the collection at {path} is kept by {old['key']}")
    version = versions[-1] + 1 if versions else 1
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    rows = stored(new, "points")
    touched = {int(r[0]) for r in rows.select(bucket.alias("b")).distinct().collect()}  # at most BUCKETS
    merged, parts = rows, {b: v for b, v in (old.get("parts") or {}).items() if int(b) not in touched}
    kept = _folders(path, old, sorted(touched)) if old else []
    if kept:
        before = spark.read.schema(StructType.fromJson(old["schema"])).parquet(*kept)
        merged = before.join(rows.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(rows)
    merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
    parts |= {str(b): folder for b in touched}
    _publish(spark, path, version, {"schema": new.schema.jsonValue(), "key": key, "parts": parts})
    _drop_unused(spark, path, versions)
    return open_collection(spark, path).count()


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    at, fs = filesystem(spark, f"{path}/_manifest/{version}")
    side, _ = filesystem(spark, f"{path}/_manifest/.{version}-{uuid.uuid4().hex}")
    out = fs.create(side, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    # renaming to a name that exists fails, so a version is written once
    if fs.exists(at) or not fs.rename(side, at):
        fs.delete(side, False)
        raise OSError(f"version {version} of {path} exists already")


def _drop_unused(spark: SparkSession, path: str, before: list[int]) -> None:
    """Manifests but the last two, and folders that neither of these names."""
    root, fs = filesystem(spark, path)
    for v in before[:-1]:
        fs.delete(filesystem(spark, f"{path}/_manifest/{v}")[0], False)
    used = set()
    for v in _manifests(spark, path):
        stream = fs.open(filesystem(spark, f"{path}/_manifest/{v}")[0])
        used |= set(json.loads(bytes(stream.readAllBytes()).decode())["parts"].values())
        stream.close()
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if name.startswith("v") and name not in used:
            fs.delete(f.getPath(), True)


def filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality filters, applied before any ranking; an unknown name is an error."""
    for name, value in (filters or {}).items():
        if name not in FILTERS or name not in df.columns:
            raise ValueError(f"cannot filter by {name}")
        df = df.filter(F.col(name) == value)
    return df


def cosine_topk(df: DataFrame, vector: list[float], k: int = 5, key: str = "vec_id", column: str = "embedding", filters: dict | None = None) -> DataFrame:
    """The k rows of highest cosine to one vector, ties by key; fewer where there are fewer."""
    if not 1 <= k <= 50:
        raise ValueError("k must be between 1 and 50")
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = filtered(df, filters).filter(usable(F.col(column))).withColumn("score", F.round(cosine(F.col(column), q), 6))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), key).limit(k)


def nearest_rows(df: DataFrame, vector: list[float], k: int = 5, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """(key, score, and all columns of df): the k keys of highest cosine, where df may hold several copies of a key.

    Keys and scores are ranked alone, without a shuffle; a few more than k are looked at until k are different. The
    whole rows of these few are read then.
    """
    narrow = scores(df.filter(F.col(key).isNotNull()), vector, key, column)
    most, found = 2 * k, {}
    while True:
        top = narrow.orderBy(F.desc("score"), key).limit(most).collect()  # a small multiple of k
        found = dict((r[0], r[1]) for r in reversed(top))
        if len(found) >= k or len(top) < most:
            break
        most *= 4
    best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]
    rows = df.filter(F.col(key).isin([x for x, _ in best])).dropDuplicates([key])
    if not best:
        return rows.withColumn("score", F.lit(None).cast("double"))
    return rows.withColumn("score", F.create_map(*[F.lit(x) for pair in best for x in pair])[F.col(key)])


def scores(df: DataFrame, vector: list[float], key: str, column: str) -> DataFrame:
    """(key, score): the rounded cosine of every usable vector of the same length, in Arrow batches."""
    q = np.asarray(vector, dtype=np.float64)
    q = q / np.linalg.norm(q)
    d = len(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            same = pc.fill_null(pc.equal(pc.list_value_length(v), d), False)
            keys = batch.column(0).filter(same)
            x = v.filter(same).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            x = x[good]
            yield pa.RecordBatch.from_arrays([keys.filter(pa.array(good)), pa.array(np.round(x @ q / np.sqrt(np.einsum("nd,nd->n", x, x)), 6))], names=[key, "score"])

    return df.select(key, column).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, score double")


def batch_topk(base: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", column: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """(query, key, score, rank): for every query the k base rows of highest cosine, exact, ties by key.

    A block of query vectors meets each batch of base rows in one matrix product; each task keeps the k
    best per query and batch, so what is shuffled is small. Queries beyond QUERY_BLOCK take further passes.
    """
    spark = base.sparkSession
    good = base.filter(F.col(key).isNotNull() & usable(F.col(column))).select(key, F.col(column).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(key).isNotNull() & usable(F.col(column))).select(key, F.col(column).cast("array<double>").alias("v")).dropDuplicates([key])
    kind = base.schema[key].dataType.simpleString()
    shape = f"query {kind}, {key} {kind}, score double"
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)))
    out = None
    for b in range(blocks):
        pdf = asked.filter(F.col("block") == b).select(key, "v").toPandas()  # about QUERY_BLOCK vectors
        by_dim = {d: (g[key].to_numpy(), np.stack(g["v"].to_numpy())) for d, g in pdf.groupby(pdf["v"].map(len))} if len(pdf) else {}
        sent = spark.sparkContext.broadcast({d: (ids, v / np.linalg.norm(v, axis=1, keepdims=True)) for d, (ids, v) in by_dim.items()})

        def score(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for rows in batches:
                for d, part in rows.groupby(rows["v"].map(len)):
                    if d not in sent.value:
                        continue
                    ids, q = sent.value[d]
                    x = np.stack(part["v"].to_numpy())
                    own = part[key].to_numpy()
                    for at in range(0, len(x), 2048):
                        cut, names = x[at : at + 2048], own[at : at + 2048]
                        s = np.round(q @ (cut / np.linalg.norm(cut, axis=1, keepdims=True)).T, 6)
                        if exclude_self:
                            s[ids[:, None] == names[None, :]] = -9
                        least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
                        i, j = np.nonzero((s >= least[:, None]) & (s > -9))  # ties stay, for the order by key
                        yield pd.DataFrame({"query": ids[i], key: names[j], "score": s[i, j]})

        found = good.mapInPandas(score, shape)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def collection_stats(pts: DataFrame) -> DataFrame:
    return pts.agg(F.count("*").alias("points"), F.min(F.size("embedding")).alias("least_dimension"), F.max(F.size("embedding")).alias("most_dimension"), F.sum("word_count").alias("words"))


def list_documents(pts: DataFrame) -> DataFrame:
    return pts.groupBy("source_document").agg(
        F.count("*").alias("chunks"), F.countDistinct("page_number").alias("pages"), F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.sum("word_count").alias("words")
    )


def document_chunks(pts: DataFrame, document: Column | str, first_page: int | None = None, last_page: int | None = None) -> DataFrame:
    out = pts.filter(F.col("source_document") == document)
    if first_page is not None:
        out = out.filter(F.col("page_number") >= first_page)
    if last_page is not None:
        out = out.filter(F.col("page_number") <= last_page)
    return out.select("chunk_id", "page_number", "chunk_index", "word_count").orderBy("chunk_index")
