"""Session helpers: the folder all executors share, and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Unicode White_Space as a regex class body that Java, Python and RE2 read alike.
WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
WORD = f"[^{WHITE}]+"


#: Tables this process has written into shared folders, until they are released.
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may leave it unset: then it is a folder of this process, removed with it."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
    own = spark.conf.get("ledgerlens.shared.dir", None)
    if not own:
        own = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, own, True)
        spark.conf.set("ledgerlens.shared.dir", own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> int:
    """Delete the tables written so far in this session: when the results that read them are done. Returns how many there were."""
    mine = [x for x in _MADE if x[0] is spark]
    for _, path in mine:
        at, fs = filesystem(spark, path)
        fs.delete(at, True)
    _MADE[:] = [x for x in _MADE if x[0] is not spark]
    return len(mine)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
