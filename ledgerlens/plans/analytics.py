"""Time series, entities, graph and event queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.operators import entities as E
from ledgerlens.operators import graph as G
from ledgerlens.operators import retrieval as R
from ledgerlens.operators import timeseries as S
from ledgerlens.plans.registry import ONE, query
from ledgerlens.plans.registry import words as sql_words
from ledgerlens.runtime import read
from ledgerlens.streaming import streams as T


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("timestamp_ntz").cast("date"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    """(priority, month, m, value): order value by month, m counted from the year 0."""
    o = _orders(spark, d).groupBy(F.col("o_orderpriority").alias("priority"), F.date_format("day", "yyyy-MM").alias("month"), (F.year("day") * 12 + F.month("day") - 1).alias("m"))
    return o.agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def _quarterly(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).groupBy(F.col("o_orderpriority").alias("priority"), F.concat(F.year("day"), F.lit("-Q"), F.quarter("day")).alias("quarter"))
    return o.agg(F.round(F.sum("o_totalprice"), 2).alias("value"), F.count("*").alias("orders"))


_M = "mo AS (SELECT o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS m, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY ALL)"
_Q = "qu AS (SELECT o_orderpriority AS priority, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, round(sum(o_totalprice), 2) AS value, count(*) AS orders FROM orders GROUP BY ALL)"


@query(f"WITH {_Q} SELECT * FROM qu")
def quarterly_series(spark: SparkSession, d: str) -> DataFrame:
    return _quarterly(spark, d)


def _growth(lag: int) -> str:
    return f"WITH {_Q}, l AS (SELECT *, lag(value, {lag}) OVER (PARTITION BY priority ORDER BY quarter) AS previous FROM qu) SELECT priority, quarter, value, previous, round(value - previous, 2) AS change, round((value - previous) / nullif(abs(previous), 0) * 100, 4) AS growth FROM l"


def _grown(spark: SparkSession, d: str, lag: int) -> DataFrame:
    g = S.growth(_quarterly(spark, d), "priority", "quarter", "value", lag)
    return g.select("priority", "quarter", "value", "previous", F.round("change", 2).alias("change"), F.round("growth", 4).alias("growth"))


@query(_growth(1))
def qoq_growth(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d, 1)


@query(_growth(4))
def yoy_growth(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d, 4)


@query("WITH y AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) <= 2000 GROUP BY ALL), e AS (SELECT priority, arg_min(v, y) AS a, arg_max(v, y) AS b, max(y) - min(y) AS n FROM y GROUP BY priority) SELECT priority, CAST(n AS INTEGER) AS years, round((pow(b / a, 1.0 / n) - 1) * 100, 4) AS cagr FROM e WHERE a > 0 AND n > 0")
def cagr(spark: SparkSession, d: str) -> DataFrame:
    """Yearly growth between the first and the last whole year."""
    y = _orders(spark, d).filter(F.year("day") <= 2000).groupBy(F.col("o_orderpriority").alias("priority"), F.year("day").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    e = y.groupBy("priority").agg(F.min_by("v", "y").alias("a"), F.max_by("v", "y").alias("b"), (F.max("y") - F.min("y")).alias("years")).filter("a > 0 AND years > 0")
    return e.select("priority", "years", F.round((F.pow(F.col("b") / F.col("a"), 1 / F.col("years")) - 1) * 100, 4).alias("cagr"))


@query(f"WITH {_M}, s AS (SELECT priority, avg(value) AS mean, stddev_pop(value) AS dev FROM mo GROUP BY 1) SELECT priority, month, value, round((value - mean) / nullif(dev, 0), 4) AS z, CASE WHEN abs((value - mean) / nullif(dev, 0)) > 3 THEN 'critical' ELSE 'moderate' END AS severity FROM mo JOIN s USING (priority) WHERE abs((value - mean) / nullif(dev, 0)) > 2")
def zscore_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return S.zscores(_monthly(spark, d), "priority", "value").select("priority", "month", "value", F.round("z", 4).alias("z"), "severity")


@query(f"WITH {_M}, s AS (SELECT priority, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM mo GROUP BY 1) SELECT priority, month, value, round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high FROM mo JOIN s USING (priority) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def iqr_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return S.outside_quartiles(_monthly(spark, d), "priority", "value").select("priority", "month", "value", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"WITH {_M} SELECT priority, count(*) AS n, round(regr_slope(value, m), 3) AS slope, round(regr_intercept(value, m), 1) AS intercept, round(regr_r2(value, m), 6) AS r2 FROM mo GROUP BY priority")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    t = S.trend(_monthly(spark, d), "priority", "m", "value")
    return t.select("priority", "n", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(
    f"""WITH {_M}, f AS (SELECT priority, count(*) AS n, max(m) AS last, regr_slope(value, m) AS s, regr_intercept(value, m) AS i, sqrt(greatest(regr_syy(value, m) - regr_sxy(value, m) * regr_sxy(value, m) / regr_sxx(value, m), 0) / (count(*) - 2)) AS sd FROM mo GROUP BY priority HAVING count(*) >= 8),
    e AS (SELECT *, unnest([1, 2, 3, 4]) AS step FROM f) SELECT priority, step, round(i + s * (last + step), 1) AS forecast, round(i + s * (last + step) - 1.96 * sd, 1) AS low, round(i + s * (last + step) + 1.96 * sd, 1) AS high FROM e"""
)
def linear_forecast(spark: SparkSession, d: str) -> DataFrame:
    f = S.forecast(_monthly(spark, d), "priority", "m", "value")
    return f.select("priority", "step", *[F.round(c, 1).alias(c) for c in ("forecast", "low", "high")])


@query(f"WITH {_M}, l AS (SELECT value, lag(value) OVER (PARTITION BY priority ORDER BY m) AS p FROM mo), k AS (SELECT * FROM l WHERE p IS NOT NULL) SELECT round(avg(abs(value - p)), 3) AS mae, round(sqrt(avg((value - p) * (value - p))), 3) AS rmse, round(avg(abs(value - p) / nullif(abs(value), 0)) * 100, 4) AS mape, coalesce(avg(abs(value - p) / nullif(abs(value), 0)) * 100 <= 15, false) AS passed FROM k")
def forecast_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The month before as a forecast, held against 15 %."""
    w = Window.partitionBy("priority").orderBy("m")
    rows = _monthly(spark, d).withColumn("p", F.lag("value").over(w)).filter(F.col("p").isNotNull())
    e = S.forecast_errors(rows, "value", "p")
    return e.select(F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("mape", 4).alias("mape"), F.coalesce(F.col("mape") <= 15, F.lit(False)).alias("passed"))


_DAILY = "da AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))


@query(f"WITH {_DAILY} SELECT event_type, strftime(day, '%Y-%m-%d') AS day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS average FROM da")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-6, 0)
    return _daily(spark, d).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round(F.avg("n").over(w), 6).alias("average"))


@query(f"WITH {_DAILY} SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW) AS BIGINT) AS last_days FROM da")
def range_frame_sum(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.unix_date("day")).rangeBetween(-3, 0)
    return _daily(spark, d).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.sum("n").over(w).alias("last_days"))


@query(f"WITH {_DAILY}, t AS (SELECT event_type, sum(n) AS n FROM da GROUP BY 1) SELECT event_type, CAST(n AS BIGINT) AS n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank, CAST(dense_rank() OVER (ORDER BY n DESC) AS INTEGER) AS dense, CAST(ntile(2) OVER (ORDER BY n DESC, event_type) AS INTEGER) AS half, lead(event_type) OVER (ORDER BY n DESC, event_type) AS next_type, round(cume_dist() OVER (ORDER BY n), 6) AS share FROM t")
def ranked_types(spark: SparkSession, d: str) -> DataFrame:
    """Rank functions over the few event types."""
    t = _daily(spark, d).groupBy("event_type").agg(F.sum("n").alias("n"))
    down, named = Window.orderBy(F.desc("n")), Window.orderBy(F.desc("n"), "event_type")
    return t.select("event_type", "n", F.rank().over(down).alias("rank"), F.dense_rank().over(down).alias("dense"), F.ntile(2).over(named).alias("half"), F.lead("event_type").over(named).alias("next_type"), F.round(F.cume_dist().over(Window.orderBy("n")), 6).alias("share"))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count_if(event_type = 'view') AS a, count_if(event_type = 'purchase') AS b FROM events GROUP BY 1) SELECT round(corr(a, b), 6) AS correlation, count(*) AS days FROM d")
def metric_correlation(spark: SparkSession, d: str) -> DataFrame:
    day = read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_type") == "purchase").alias("b"))
    return S.correlation(day, "a", "b").select(F.round("correlation", 6).alias("correlation"), F.col("n").alias("days"))


@query("WITH r AS (SELECT l_returnflag AS flag, year(l_shipdate) AS y, sum(l_extendedprice * (1 - l_discount)) AS actual, sum(l_extendedprice) * 0.95 AS budget FROM lineitem GROUP BY ALL) SELECT flag, CAST(y AS INTEGER) AS y, round(actual, 4) AS actual, round(budget, 4) AS budget, round(actual - budget, 4) AS variance, round((actual - budget) / nullif(budget, 0) * 100, 4) AS percent, CASE WHEN actual >= budget THEN 'over' ELSE 'under' END AS direction FROM r")
def budget_variance(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("y")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), (F.sum("l_extendedprice") * 0.95).alias("b"))
    return r.select("flag", "y", F.round("a", 4).alias("actual"), F.round("b", 4).alias("budget"), F.round(F.col("a") - F.col("b"), 4).alias("variance"), F.round((F.col("a") - F.col("b")) / F.nullif("b", F.lit(0.0)) * 100, 4).alias("percent"), F.when(F.col("a") >= F.col("b"), "over").otherwise("under").alias("direction"))


@query(f"WITH {_M}, s AS (SELECT priority, avg(value) AS mean, stddev_pop(value) AS dev FROM mo GROUP BY 1), z AS (SELECT priority, month, round(abs((value - mean) / nullif(dev, 0)), 4) AS weight FROM mo JOIN s USING (priority)) SELECT priority, month, weight, CASE WHEN weight > 3 THEN 3 WHEN weight > 2 THEN 2 ELSE 1 END AS level FROM z ORDER BY level DESC, weight DESC, priority, month LIMIT 10")
def ranked_insights(spark: SparkSession, d: str) -> DataFrame:
    """The ten most striking months: by level, then by how far they are off."""
    m = _monthly(spark, d)
    stats = m.groupBy("priority").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"))
    z = m.join(stats, "priority").select("priority", "month", F.round(F.abs((F.col("value") - F.col("mean")) / F.nullif("dev", F.lit(0.0))), 4).alias("weight"))
    return z.withColumn("level", F.when(F.col("weight") > 3, 3).when(F.col("weight") > 2, 2).otherwise(1)).orderBy(F.desc("level"), F.desc("weight"), "priority", "month").limit(10)


# entities: names out of dictionaries, and the kinds that a pattern can tell

#: What the queries below pass to the operator; companies come from the documents' own table.
METRICS = "net debt,working capital,gross margin,EBITDA,headcount,freight cost,insurance cost,power cost per ton,kiln fuel cost,clinker output,sales volume,dust emissions,water use,overtime,rent".split(",")
DEPARTMENTS = "finance committee,audit team,plant manager,treasurer,controller,planning desk,sales director,reporting desk".split(",")


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([("metric", x) for x in METRICS] + [("department", x) for x in DEPARTMENTS], "kind string, name string")
    companies = read(spark, d, "documents").filter(F.col("company").isNotNull()).select(F.lit("company").alias("kind"), F.col("company").alias("name")).distinct()
    return own.unionByName(companies)


def entities(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, kind, entity): each once per chunk."""
    return E.extract(R.one_per_chunk(read(spark, d, "chunks")).select("chunk_id", "content"), _dictionary(spark, d))


_TICK = chr(39)
_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, xs in (("metric", METRICS), ("department", DEPARTMENTS)) for x in xs) + ") t(kind, name) UNION SELECT DISTINCT 'company', company FROM documents WHERE company IS NOT NULL)"
_ENT = f"""{ONE}, {_NAMES}, bare AS (SELECT chunk_id, list_transform({sql_words('lower(content)')}, lambda x: trim(x, '.,;:!?"()')) AS w FROM one WHERE content IS NOT NULL),
    grams AS (SELECT chunk_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS gram FROM bare),
    en AS (SELECT DISTINCT chunk_id, kind, name AS entity FROM grams JOIN names ON gram = lower(name) UNION ALL {' UNION ALL '.join(f'SELECT chunk_id, {_TICK}{k}{_TICK}, unnest(list_distinct(regexp_extract_all(content, {_TICK}{p}{_TICK}))) FROM one' for k, p in E.PATTERNS.items())})"""


@query(f"WITH {_ENT} SELECT * FROM en")
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d)


@query(f"WITH {_ENT}, m AS (SELECT chunk_id, entity FROM en WHERE kind = 'metric') SELECT a.entity AS a, b.entity AS b, count(*) AS chunks FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.entity < b.entity GROUP BY ALL")
def entity_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of metrics named in one chunk: formed within the chunk, at most the square of the few metrics."""
    return E.co_mentions(entities(spark, d), "metric").withColumnRenamed("texts", "chunks")


@query(f"WITH {_ENT} SELECT entity, CASE WHEN regexp_matches(entity, '^Q[1-4] [0-9]{{4}}$') THEN substring(entity, 4, 4) || '-' || substring(entity, 1, 2) WHEN entity LIKE '% Quarter %' THEN right(entity, 4) || '-Q' || list_position(['Fi','Se','Th','Fo'], substring(entity, 1, 2)) WHEN entity LIKE 'Q%' THEN '20' || substring(entity, 6, 2) || '-' || substring(entity, 1, 2) WHEN entity LIKE 'H%' THEN substring(entity, 4, 4) || '-' || substring(entity, 1, 2) ELSE '20' || substring(entity, 5, 2) || '-' || printf('%02d', list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], substring(entity, 1, 3))) END AS normal, count(*) AS chunks FROM en WHERE kind = 'period' GROUP BY ALL")
def normalize_entities(spark: SparkSession, d: str) -> DataFrame:
    """Periods under one name."""
    from ledgerlens.functions.text import fiscal_period

    e = entities(spark, d).filter("kind = 'period'").groupBy("entity").agg(F.count("*").alias("chunks"))
    return e.select("entity", F.coalesce(fiscal_period(F.col("entity")), F.col("entity")).alias("normal"), "chunks")


@query(
    """SELECT DISTINCT filename, nullif(regexp_extract(filename, '^([0-9]{4}-[0-9]{2}) ', 1), '') AS month, nullif(regexp_extract(filename, '^[0-9]{4}-[0-9]{2} (.+?) [A-Z][a-z]+[ _]', 1), '') AS kind, nullif(regexp_extract(filename, '([A-Z][a-z]+)(?:_v2| CONSO| final)*_[0-9]+[.][a-z]+$', 1), '') AS unit, lower(regexp_extract(filename, '[.]([A-Za-z]+)$', 1)) AS suffix FROM files WHERE filename IS NOT NULL"""
)
def extract_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Month, kind, unit and suffix from the names of files."""

    def part(pattern: str):
        return F.nullif(F.regexp_extract("filename", pattern, 1), F.lit(""))

    names = read(spark, d, "files").select("filename").filter(F.col("filename").isNotNull()).distinct()
    return names.select(
        "filename", part("^([0-9]{4}-[0-9]{2}) ").alias("month"), part("^[0-9]{4}-[0-9]{2} (.+?) [A-Z][a-z]+[ _]").alias("kind"),
        part("([A-Z][a-z]+)(?:_v2| CONSO| final)*_[0-9]+[.][a-z]+$").alias("unit"), F.lower(F.regexp_extract("filename", "[.]([A-Za-z]+)$", 1)).alias("suffix"),
    )


_EDGES = "ed AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    def edge(table: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return read(spark, d, table).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"))

    return edge("nation", "r", "n_regionkey", "n", "n_nationkey").unionByName(edge("supplier", "n", "s_nationkey", "s", "s_suppkey")).unionByName(edge("customer", "n", "c_nationkey", "c", "c_custkey"))


@query(f"WITH RECURSIVE {_EDGES}, w(start, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT start, dst, hops + 1 FROM w JOIN ed ON node = src WHERE hops < 3) SELECT start, hops, count(DISTINCT node) AS nodes FROM w GROUP BY ALL")
def graph_hops(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.hops(_edges(spark, d), starts).groupBy("start", "hops").agg(F.count("*").alias("nodes"))


@query(f"WITH {_EDGES}, x AS (SELECT dst AS node, src AS region FROM ed WHERE src LIKE 'r%' UNION ALL SELECT DISTINCT src, src FROM ed WHERE src LIKE 'r%' UNION ALL SELECT e.dst, n.src FROM ed e JOIN ed n ON n.dst = e.src WHERE n.src LIKE 'r%'), m AS (SELECT region, min(node) AS component FROM x GROUP BY 1) SELECT node, component FROM x JOIN m USING (region)")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return G.components(_edges(spark, d))


# events in windows, as the streams compute them

_BUCKET = "strftime(time_bucket(INTERVAL {w}, ts), '%Y-%m-%d %H:%M')"


@query(f"SELECT event_type, {_BUCKET.format(w=chr(39) + '1 hour' + chr(39))} AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return T.tumbling(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("WITH e AS (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events), w AS (SELECT event_type, b - to_minutes(15 * unnest([0, 1, 2, 3])) AS start FROM e) SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY ALL")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return T.sliding(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER o + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, nth")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return T.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS t, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), w AS (SELECT t, n, lag(t) OVER (ORDER BY t) AS pt, lag(n) OVER (ORDER BY t) AS pn FROM b) SELECT strftime(t, '%Y-%m-%d %H:%M') AS start, n AS errors FROM w WHERE n > 1 AND pn > 1 AND pt = t - INTERVAL 1 HOUR")
def error_alarm(spark: SparkSession, d: str) -> DataFrame:
    """Windows over the limit of errors, the second in a row: a self-join by the time before instead of an ordered pass."""
    e = read(spark, d, "events").filter("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    n = e.groupBy(F.window("ts", "1 hour")["start"].alias("t")).agg(F.count("*").alias("n")).filter("n > 1")
    before = n.select((F.col("t") + F.expr("INTERVAL 1 HOUR")).alias("t"))
    return n.join(before, "t", "left_semi").select(F.date_format("t", "yyyy-MM-dd HH:mm").alias("start"), F.col("n").alias("errors"))


@query("WITH f AS (SELECT DISTINCT filename, doc_type, ingestion_timestamp, page_count, chunk_count, try_cast(substring(replace(ingestion_timestamp, 'T', ' '), 1, 19) AS TIMESTAMP) AS t FROM files WHERE filename IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY t DESC NULLS LAST, chunk_count DESC NULLS LAST, page_count DESC NULLS LAST, ingestion_timestamp DESC NULLS LAST, doc_type DESC NULLS LAST) AS back, count(*) OVER (PARTITION BY filename) AS versions FROM f) SELECT filename, ingestion_timestamp, page_count, chunk_count, versions FROM r WHERE back = 1")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """The last ingestion of every file; times in several forms, or none."""
    f = read(spark, d, "files").filter(F.col("filename").isNotNull()).select("filename", "doc_type", "ingestion_timestamp", "page_count", "chunk_count").distinct()
    t = F.try_to_timestamp(F.substring(F.regexp_replace("ingestion_timestamp", "T", " "), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    order = F.struct(t.isNotNull(), t, F.coalesce("chunk_count", F.lit(-1)), F.coalesce("page_count", F.lit(-1)), F.coalesce("ingestion_timestamp", F.lit("")), F.coalesce("doc_type", F.lit("")))
    return f.groupBy("filename").agg(F.max_by(F.struct("ingestion_timestamp", "page_count", "chunk_count"), order).alias("x"), F.count("*").alias("versions")).select("filename", "x.*", "versions")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value FROM events")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    return T.ingest_events(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("SELECT event_id, any_value(event_type) AS event_type FROM events GROUP BY event_id")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return T.distinct_events(spark, d)


#: The watermark stands ten minutes before the last event; what ends after it is still open.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTES FROM events)"


@query(f"SELECT event_type, {_BUCKET.format(w=chr(39) + '1 hour' + chr(39))} AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, time_bucket(INTERVAL '1 hour', ts) HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return T.streamed(T.tumbling, spark, d)


@query(f"WITH e AS (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) AS b FROM events), w AS (SELECT event_type, b - to_minutes(15 * unnest([0, 1, 2, 3])) AS start FROM e) SELECT event_type, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w WHERE w.start + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY event_type, w.start")
def stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    return T.streamed(T.sliding, spark, d)


@query(f"WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER o + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, nth HAVING max(ts) + INTERVAL 30 MINUTES <= {_CLOSED}")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.streamed(T.sessions, spark, d)


@query("SELECT category, count(*) AS total, count_if(coalesce(retrieval.pass_, false)) AS passed, round(100.0 * count_if(coalesce(retrieval.pass_, false)) / count(*), 6) AS accuracy FROM eval_results WHERE category IS NOT NULL GROUP BY category")
def stream_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The running accuracy of each category after the last micro-batch."""
    schema = spark.read.parquet(f"{d}/eval_results.parquet").schema
    results = T.table_stream(spark, d, "eval_results", schema).filter("category IS NOT NULL").select("category", F.col("retrieval.pass_").alias("passed"))
    return T.latest_per_batch(T.running_accuracy(results), "category", "accuracy").withColumn("accuracy", F.round("accuracy", 6))


@query()
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    from ledgerlens.functions.embedding import embed

    return R.one_per_chunk(read(spark, d, "chunks")).select("chunk_id", embed(F.col("content")).alias("embedding"))
