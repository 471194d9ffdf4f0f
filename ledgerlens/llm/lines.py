"""Problem 5: lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.runtime import fresh_path, stored

MIN_CHUNKS, MIN_SHARE = 5, 0.2
#: A source may hold a third of all rows; joins on the source are spread over this many keys.
SALT = 16
#: Repeated lines of all sources are broadcast up to this many (8 bytes each), else joined by shuffle.
BROADCAST_LINES = 2_000_000
#: Buckets of the ledger's tables; loads kept apart before they are written as one; loads of a first filling.
BUCKETS, MOST_LOADS, LOADS = 16, 8, 2


def compared_form(line: Column) -> Column:
    """The line without digits, white runs as one space, trimmed, in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.translate(line, "0123456789", ""), "[ \\t\\r\\x{a0}]+", " ")))


def line_keys(chunks: DataFrame) -> DataFrame:
    """(chunk_id, source, keys): one row per chunk_id, with a 64-bit key per line, null where no letter is left.

    source is a 64-bit hash of metadata.filename; keys are compared within one source only, so a
    chance collision needs some 10^9 different lines in one source. Rows without chunk_id or
    filename belong to no source and are left out; null content has no lines.
    """

    def key(line: Column) -> Column:
        form = compared_form(line)
        return F.when(form.rlike("\\p{L}"), F.xxhash64(form))

    return (
        chunks.select("chunk_id", F.col("metadata.filename").alias("filename"), "content")
        .filter(F.col("chunk_id").isNotNull() & F.col("filename").isNotNull())
        .select("chunk_id", F.xxhash64("filename").alias("source"), F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), key).alias("keys"))
        .dropDuplicates(["chunk_id"])
    )


def count_delta(keyed: DataFrame) -> DataFrame:
    """(source, key, n): in how many chunks of a source each line occurs; a chunk counts once."""
    each = keyed.select("source", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("key"))
    return each.groupBy("source", "key").agg(F.count("*").alias("n"))


def chunk_totals(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("source").agg(F.count("*").alias("total"))


def merge(state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    return state.unionByName(delta).groupBy(*keys).agg(F.sum(value).alias(value))


def crossed(counts: DataFrame, totals: DataFrame, min_chunks: int, min_share: float) -> DataFrame:
    """(source, lines): per source the keys at or over both thresholds.

    At least min_share of the chunks hold each of them, so there are at most 1 / min_share times
    as many as a chunk has lines on average: the array stays small whatever the source's size.
    """
    often = counts.filter(F.col("n") >= min_chunks).join(totals, "source")
    often = often.filter(F.col("n") >= F.lit(min_share) * F.col("total") - 1e-9)
    return often.groupBy("source").agg(F.sort_array(F.collect_list("key")).alias("lines"))


def with_lines(rows: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """rows (with chunk_id and source) joined to the lines of their source: by broadcast up to BROADCAST_LINES lines, beyond by a salted shuffle."""
    n = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    if n <= BROADCAST_LINES:
        return rows.join(F.broadcast(lines), "source", how)
    spread = lines.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.lit(SALT)).cast("int"))
    return salted.join(spread.hint("merge"), ["source", "salt"], how).drop("salt")


def locate(keyed: DataFrame, lines: DataFrame) -> DataFrame:
    """(chunk_id, source, line_no): where the given lines of each source stand; line_no counts from 1."""
    hits = with_lines(keyed, lines, "inner")
    at = hits.select("chunk_id", "source", "lines", F.posexplode("keys").alias("pos", "key"))
    return at.filter(F.array_contains("lines", F.col("key"))).select("chunk_id", "source", (F.col("pos") + 1).alias("line_no"))


class LineLedger:
    """Per-source line counts, kept as tables and brought up to date by deltas.

    ``update(chunks)`` counts only the new chunks, adds them to the counts, compares which lines
    are over the thresholds before and after, and returns the located lines of just those chunks
    that must be rebuilt: the new ones, and old ones of a source in which they hold a line that
    crossed a threshold in either direction. A chunk_id seen before is ignored.

    All tables are laid out by BUCKETS of the source. An update rewrites the counts of the buckets its
    chunks fall into and looks for stale chunks in these alone; other buckets are not read.
    """

    def __init__(self, spark: SparkSession, min_chunks: int = MIN_CHUNKS, min_share: float = MIN_SHARE):
        self.spark, self.min_chunks, self.min_share = spark, min_chunks, min_share
        self.root, self.version = fresh_path(spark, "lines"), 0
        self.loads: list[str] = []  # paths of keyed chunks
        self.tables: dict[str, dict[int, str]] = {"counts": {}, "totals": {}, "crossed": {}}  # bucket -> path

    _SHAPES = {"keyed": "chunk_id string, source long, keys array<bigint>, bucket int", "counts": "source long, key long, n long", "totals": "source long, total long", "crossed": "source long, lines array<bigint>"}

    @staticmethod
    def _bucket():
        return F.pmod(F.xxhash64("source"), F.lit(BUCKETS)).cast("int")

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/{self.version}/{name}"
        df = df.withColumn("bucket", self._bucket())
        if name != "keyed":  # a bucket's counts come to few tasks, spread by the rest of the key
            df = df.repartition("bucket", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(4)))
        df.write.partitionBy("bucket").parquet(path)
        return path

    def _keyed(self, paths: list[str], touched: list[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self._SHAPES["keyed"])
        for p in paths:
            rows = self.spark.read.schema(self._SHAPES["keyed"]).parquet(p)
            out = out.unionByName(rows if touched is None else rows.filter(F.col("bucket").isin(touched)))
        return out.drop("bucket")

    def _table(self, name: str, touched: list[int] | None = None) -> DataFrame:
        own = self.tables[name]
        paths = [f"{own[b]}/bucket={b}" for b in sorted(own) if touched is None or b in touched]
        return self.spark.read.schema(self._SHAPES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self._SHAPES[name])

    def _replace(self, name: str, df: DataFrame, touched: list[int]) -> None:
        """The table of the touched buckets, anew; a bucket without rows has none."""
        path = self._write(df, name)
        have = {r[0] for r in self.spark.read.schema(self._SHAPES[name] + ", bucket int").parquet(path).select("bucket").distinct().collect()} if name == "crossed" else set(touched)  # at most BUCKETS
        for b in touched:
            if b in have:
                self.tables[name][b] = path
            else:
                self.tables[name].pop(b, None)

    @property
    def lines(self) -> DataFrame:
        """(source, lines): the lines over the thresholds as the state stands."""
        return self._table("crossed")

    def update(self, chunks: DataFrame) -> DataFrame:
        self.version += 1
        keyed = line_keys(chunks)
        if self.loads:
            keyed = keyed.join(self._keyed(self.loads).select("chunk_id"), "chunk_id", "left_anti")
        new_path = self._write(keyed, "keyed")
        new = self._keyed([new_path])
        touched = sorted(r[0] for r in self.spark.read.schema(self._SHAPES["keyed"]).parquet(new_path).select("bucket").distinct().collect())  # at most BUCKETS
        old = self.loads
        self.loads = old + [new_path]
        if not touched:
            self.loads, self.stale = old, new.select("chunk_id")
            return locate(new, self.lines)
        before = self._table("crossed", touched)
        self._replace("counts", merge(self._table("counts", touched), count_delta(new), ["source", "key"], "n"), touched)
        self._replace("totals", merge(self._table("totals", touched), chunk_totals(new), ["source"], "total"), touched)
        self._replace("crossed", crossed(self._table("counts", touched), self._table("totals", touched), self.min_chunks, self.min_share), touched)
        after = self._table("crossed", touched)
        none = F.array().cast("array<bigint>")
        flips = after.withColumnRenamed("lines", "now").join(before.withColumnRenamed("lines", "then"), "source", "full")
        flips = flips.select("source", F.coalesce("now", none).alias("now"), F.coalesce("then", none).alias("then"))
        flips = flips.select("source", F.array_union(F.array_except("now", "then"), F.array_except("then", "now")).alias("lines")).filter(F.size("lines") > 0)
        earlier = self._keyed(old, touched)
        self.stale = locate(earlier, flips).select("chunk_id").distinct()
        rebuild = new.unionByName(earlier.join(self.stale, "chunk_id", "left_semi"))
        located = locate(rebuild, after)
        if len(self.loads) > MOST_LOADS:
            self.version += 1
            self.loads = [self._write(self._keyed(self.loads), "keyed")]
        return located

    def located(self) -> DataFrame:
        """All located lines as the state stands."""
        return locate(self._keyed(self.loads), self.lines)


def repeated_lines(chunks: DataFrame, min_chunks: int = MIN_CHUNKS, min_share: float = MIN_SHARE, loads: int = LOADS) -> DataFrame:
    """(chunk_id, line_no) of every line that returns in at least min_chunks chunks and min_share of the chunks of its file.

    The chunks are brought into a ledger as so many loads, by the month of their ingestion, so that
    thresholds are crossed by deltas. Lines are counted from 1 over content split at LF. Rows that repeat a chunk_id count once;
    chunks without content count in the file's total; lines without a letter never count. Rows
    without chunk_id or filename are left out. An empty table gives no rows.
    """
    ledger = LineLedger(chunks.sparkSession, min_chunks, min_share)
    for part in by_month(chunks, loads):
        ledger.update(part)
    return ledger.located().select("chunk_id", "line_no")


def by_month(chunks: DataFrame, parts: int) -> list[DataFrame]:
    """The chunks in parts of about the same number of rows, by the first seven characters of their ingestion time; rows without one come first."""
    month = F.coalesce(F.substring("metadata.ingestion_timestamp", 1, 7), F.lit(""))
    counts = sorted((m, n) for m, n in chunks.groupBy(month.alias("m")).count().collect())  # one row per month
    total, upto, bounds = sum(n for _, n in counts), 0, []
    for m, n in counts:
        if len(bounds) < parts - 1 and upto and upto >= total * (len(bounds) + 1) / parts:
            bounds.append(m)
        upto += n
    edges = [None, *bounds, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        part = chunks
        if low is not None:
            part = part.filter(month >= low)
        if high is not None:
            part = part.filter(month < high)
        out.append(part)
    return out


def without_lines(chunks: DataFrame, located: DataFrame) -> DataFrame:
    """(chunk_id, content, n_removed): the chunks that hold located lines, without them; other chunks stay as they are."""
    gone = located.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    one = chunks.select("chunk_id", "content").filter(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
    kept = F.filter(F.split("content", "\n"), lambda line, i: ~F.array_contains("gone", i + 1))
    return one.join(gone, "chunk_id", "left").select(
        "chunk_id",
        F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"),
    )
