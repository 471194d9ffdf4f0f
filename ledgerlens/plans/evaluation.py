"""Accuracy, latency and ground-truth checks over evaluation results, questions, elements and the tracking log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import normalize_numbers
from ledgerlens.operators import retrieval as R
from ledgerlens.operators.statistics import order_statistics
from ledgerlens.plans.registry import ELEMENTS, EVAL, LOG, ONE, normal, query
from ledgerlens.runtime import read

#: Limits the results are held against, and how the questions should be distributed.
RETRIEVAL_TARGET, ATTRIBUTION_TARGET, P50_LIMIT, P95_LIMIT, EARLY_WARNING = 90.0, 95.0, 5000.0, 15000.0, 70.0
DIFFICULTIES = {"easy": 20, "medium": 20, "hard": 10}
#: How many questions of each category the set should have.
CATEGORIES = {"unit_costs": 12, "profitability": 8, "cash_and_debt": 8, "staffing": 6, "overheads": 8, "plant_safety": 8}


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluated question once; rows are logged again at times."""
    return read(spark, d, "eval_results").distinct()


def _log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "tracking_log").distinct()


def _passed() -> Column:
    return F.coalesce(F.col("retrieval.pass_"), F.lit(False))


def _sourced() -> Column:
    return F.coalesce(F.col("attribution.pass_"), F.lit(False))


def _percent(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 6)


_R, _A = "coalesce(retrieval.pass_, false)", "coalesce(attribution.pass_, false)"
_P = "list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))"


def _place(share: float, where: str = "l") -> str:
    return f"{where}[least(CAST(floor(len({where}) * {share}) AS BIGINT) + 1, len({where}))]"


@query(
    f"""WITH {EVAL}, a AS (SELECT count(*) AS total_queries, count_if({_R}) AS retrieval_pass, count_if({_A}) AS attribution_pass, count(error) AS errors, {_P} AS l, avg(latency_ms) AS m FROM er)
    SELECT total_queries, retrieval_pass, attribution_pass, errors, round(100.0::DOUBLE * retrieval_pass / total_queries, 6) AS retrieval_accuracy, round(100.0::DOUBLE * attribution_pass / total_queries, 6) AS attribution_accuracy,
    {_place(0.5)} AS p50_latency_ms, {_place(0.95)} AS p95_latency_ms, {_place(0.99)} AS p99_latency_ms, l[1] AS min_latency_ms, l[len(l)] AS max_latency_ms, round(m, 6) AS avg_latency_ms FROM a"""
)
def performance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors stay in the denominators and keep their latency; null latencies count in no figure of latency."""
    er = _results(spark, d)
    n = er.agg(F.count("*").alias("total_queries"), F.count_if(_passed()).alias("retrieval_pass"), F.count_if(_sourced()).alias("attribution_pass"), F.count("error").alias("errors"), F.min("latency_ms").alias("min_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"))
    n = n.withColumn("retrieval_accuracy", _percent(F.col("retrieval_pass"), F.col("total_queries"))).withColumn("attribution_accuracy", _percent(F.col("attribution_pass"), F.col("total_queries")))
    return n.crossJoin(order_statistics(er, "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}).drop("n"))  # one row each


@query(f"WITH {EVAL}, g AS (SELECT category, {_P} AS l FROM er GROUP BY category) SELECT category, len(l) AS n, {_place(0.5)} AS p50, {_place(0.95)} AS p95, {_place(0.99)} AS p99 FROM g WHERE len(l) > 0")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return order_statistics(_results(spark, d), "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=["category"])


@query(
    f"""WITH {EVAL}, g AS (SELECT strftime(make_timestamp(epoch_us(run_at)), '%Y-%m-%d') AS day, count(*) AS n, count_if({_R}) AS r, count_if({_A}) AS a, count(error) AS errors, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL AND error IS NULL)) AS l FROM er GROUP BY 1)
    SELECT day, n AS queries, round(100.0::DOUBLE * r / n, 6) AS retrieval_accuracy, round(100.0::DOUBLE * a / n, 6) AS attribution_accuracy, errors, coalesce({_place(0.5)}, 0) AS p50, coalesce({_place(0.95)}, 0) AS p95 FROM g"""
)
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    """By day of the run; latency without the rows that failed."""
    er = _results(spark, d).withColumn("day", F.date_format("run_at", "yyyy-MM-dd"))
    n = er.groupBy("day").agg(F.count("*").alias("queries"), F.count_if(_passed()).alias("r"), F.count_if(_sourced()).alias("a"), F.count("error").alias("errors"))
    p = order_statistics(er.filter(F.col("error").isNull()), "latency_ms", {"p50": 0.5, "p95": 0.95}, by=["day"]).drop("n")
    zero = F.lit(0.0)
    return n.join(p, "day", "left").select("day", "queries", _percent(F.col("r"), F.col("queries")).alias("retrieval_accuracy"), _percent(F.col("a"), F.col("queries")).alias("attribution_accuracy"), "errors", F.coalesce("p50", zero).alias("p50"), F.coalesce("p95", zero).alias("p95"))


_GROUPED = f"count(*) AS total, count_if({_R}) AS retrieval_pass, count_if({_A}) AS attribution_pass, count_if(NOT ({_R} AND {_A})) AS failures"


def _grouped(g) -> DataFrame:
    return g.agg(F.count("*").alias("total"), F.count_if(_passed()).alias("retrieval_pass"), F.count_if(_sourced()).alias("attribution_pass"), F.count_if(~(_passed() & _sourced())).alias("failures"))


@query(f"WITH {EVAL} SELECT category, {_GROUPED} FROM er GROUP BY category")
def accuracy_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(_results(spark, d).groupBy("category")).orderBy("category")


@query(f"WITH {EVAL} SELECT category, difficulty, {_GROUPED} FROM er GROUP BY ROLLUP (category, difficulty)")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(_results(spark, d).rollup("category", "difficulty"))


@query(f"WITH {EVAL} SELECT category, difficulty, {_GROUPED} FROM er GROUP BY CUBE (category, difficulty)")
def accuracy_cube(spark: SparkSession, d: str) -> DataFrame:
    return _grouped(_results(spark, d).cube("category", "difficulty"))


@query(f"WITH {EVAL} SELECT category, difficulty, {_GROUPED} FROM er GROUP BY GROUPING SETS ((category), (difficulty))")
def accuracy_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    er = _results(spark, d)
    return _grouped(er.groupingSets([["category"], ["difficulty"]], "category", "difficulty"))


@query()
def approx_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query(f"WITH {EVAL} SELECT id, q.category, count(e.query_id) AS runs, count_if(coalesce(retrieval.pass_, false)) AS retrieval_pass, count_if(coalesce(attribution.pass_, false)) AS attribution_pass, coalesce(max(num_results), 0) AS most_results FROM questions q LEFT JOIN er e ON e.query_id = q.id GROUP BY ALL")
def accuracy_eval(spark: SparkSession, d: str) -> DataFrame:
    """Every question with its runs; one without any run stays."""
    er = _results(spark, d).select("query_id", _passed().alias("r"), _sourced().alias("a"), "num_results")
    per = er.groupBy("query_id").agg(F.count("*").alias("runs"), F.count_if("r").alias("r"), F.count_if("a").alias("a"), F.max("num_results").alias("m"))
    zero = F.lit(0)
    return read(spark, d, "questions").join(per, F.col("id") == F.col("query_id"), "left").select("id", "category", F.coalesce("runs", zero).alias("runs"), F.coalesce("r", zero).alias("retrieval_pass"), F.coalesce("a", zero).alias("attribution_pass"), F.coalesce("m", zero).alias("most_results"))


_SHARE = "CASE WHEN len(retrieval.expected_keywords) > 0 THEN len(coalesce(retrieval.matched_keywords, []))::DOUBLE / len(retrieval.expected_keywords) ELSE 0 END"


@query(f"WITH {EVAL} SELECT category, count(*) AS total, count_if({_SHARE} >= 0.3) AS successes, round(avg(top_score), 10) AS mean_score, round(avg({_SHARE}), 6) AS mean_match FROM er GROUP BY category")
def spike_success(spark: SparkSession, d: str) -> DataFrame:
    """By category: how many results match at least 30 % of the keywords."""
    n = F.coalesce(F.size("retrieval.expected_keywords"), F.lit(0))
    share = F.when(n > 0, F.coalesce(F.size("retrieval.matched_keywords"), F.lit(0)) / n).otherwise(0.0)
    er = _results(spark, d).withColumn("share", F.greatest(share, F.lit(0.0)))
    return er.groupBy("category").agg(F.count("*").alias("total"), F.count_if(F.col("share") >= 0.3).alias("successes"), F.round(F.avg("top_score"), 10).alias("mean_score"), F.round(F.avg("share"), 6).alias("mean_match"))


@query("SELECT 'category' AS kind, category AS value, count(*) AS n FROM questions GROUP BY category UNION ALL SELECT 'difficulty', difficulty, count(*) FROM questions GROUP BY difficulty UNION ALL SELECT 'source_document', source_document, count(*) FROM questions GROUP BY source_document")
def ground_truth_distribution(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "questions")
    return reduce(DataFrame.unionByName, [q.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "value", "n") for c in ("category", "difficulty", "source_document")])


_FIELDS = "id question expected_answer expected_keywords source_document expected_page_number expected_section category difficulty".split()


@query(
    f"""SELECT 'count' AS check_name, count(*) >= 50 AS ok FROM questions UNION ALL SELECT 'fields', count_if({" OR ".join(f + " IS NULL" for f in _FIELDS)}) = 0 FROM questions
    UNION ALL SELECT 'unique_ids', count(*) = count(DISTINCT id) FROM questions UNION ALL SELECT 'categories', count(DISTINCT category) = {len(CATEGORIES)} AND {" AND ".join(f"count_if(category = '{k}') = {n}" for k, n in CATEGORIES.items())} FROM questions
    UNION ALL SELECT 'difficulties', count_if(difficulty = 'easy') = 20 AND count_if(difficulty = 'medium') = 20 AND count_if(difficulty = 'hard') = 10 FROM questions
    UNION ALL SELECT 'pages', count_if(coalesce(expected_page_number, 0) < 1) = 0 FROM questions UNION ALL SELECT 'keywords', count_if(coalesce(len(expected_keywords), 0) = 0) = 0 FROM questions
    UNION ALL SELECT 'sources', count(DISTINCT source_document) >= 1 FROM questions"""
)
def validate_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """One row for each check, from one pass."""
    null = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in _FIELDS])
    hard = reduce(lambda a, b: a & b, [F.count_if(F.col("difficulty") == k) == n for k, n in DIFFICULTIES.items()])
    exact = reduce(lambda a, b: a & b, [F.count_if(F.col("category") == k) == n for k, n in CATEGORIES.items()], F.countDistinct("category") == len(CATEGORIES))
    checks = {
        "count": F.count("*") >= 50, "fields": F.count_if(null) == 0, "unique_ids": F.count("*") == F.countDistinct("id"), "categories": exact, "difficulties": hard,
        "pages": F.count_if(F.coalesce("expected_page_number", F.lit(0)) < 1) == 0, "keywords": F.count_if(F.coalesce(F.size("expected_keywords"), F.lit(0)) <= 0) == 0, "sources": F.countDistinct("source_document") >= 1,
    }
    one = read(spark, d, "questions").agg(*[c.alias(k) for k, c in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("ok")) for k in checks])).alias("x")).select("x.*")


@query("SELECT id, len(expected_keywords) AS keywords, len(list_filter(expected_keywords, lambda k: contains(lower(question || ' ' || expected_answer), lower(k)))) AS found, len(list_filter(expected_keywords, lambda k: contains(lower(question || ' ' || expected_answer), lower(k)))) >= greatest(1, 0.3 * len(expected_keywords)) AS relevant FROM questions")
def keyword_relevance(spark: SparkSession, d: str) -> DataFrame:
    q = read(spark, d, "questions").withColumn("t", F.lower(F.concat_ws(" ", "question", "expected_answer")))
    found = F.size(F.filter("expected_keywords", lambda k: F.contains(F.col("t"), F.lower(k)))).cast("bigint")
    return q.select("id", F.size("expected_keywords").cast("bigint").alias("keywords"), found.alias("found"), (found >= F.greatest(F.lit(1.0), 0.3 * F.size("expected_keywords"))).alias("relevant"))


@query(
    f"""WITH {EVAL}, f AS (SELECT category, query_id, run_id, make_timestamp(epoch_us(run_at)) AS t, {_R} AS retrieval_pass, {_A} AS attribution_pass FROM er WHERE NOT ({_R} AND {_A})),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY t, query_id, run_id, retrieval_pass, attribution_pass) AS INTEGER) AS nth FROM f)
    SELECT category, query_id, run_id, retrieval_pass, attribution_pass, nth FROM r WHERE nth <= 5"""
)
def top_failures(spark: SparkSession, d: str) -> DataFrame:
    """The first five failures of each category."""
    er = _results(spark, d).select("category", "query_id", "run_id", "run_at", _passed().alias("retrieval_pass"), _sourced().alias("attribution_pass")).filter(~(F.col("retrieval_pass") & F.col("attribution_pass")))
    w = Window.partitionBy("category").orderBy("run_at", "query_id", "run_id", "retrieval_pass", "attribution_pass")
    return er.withColumn("nth", F.row_number().over(w)).filter("nth <= 5").drop("run_at")


@query(
    f"""WITH {LOG}, w AS (SELECT logged, retrieval_accuracy AS r, attribution_accuracy AS a, lag(retrieval_accuracy) OVER o AS p, first_value(retrieval_accuracy) OVER o AS f, row_number() OVER (ORDER BY logged DESC, subset_size DESC) AS back FROM log WINDOW o AS (ORDER BY logged, subset_size))
    SELECT logged, round(r, 6) AS retrieval_accuracy, round(r - p, 6) AS change, round(r - f, 6) AS since_first, coalesce(r - p < -5, false) AS regression FROM w WHERE back <= 10"""
)
def accuracy_trend(spark: SparkSession, d: str) -> DataFrame:
    """The last ten runs against the one before and the first; one row for each run, a few a day."""
    w, back = Window.orderBy("logged", "subset_size"), Window.orderBy(F.desc("logged"), F.desc("subset_size"))
    r = F.col("retrieval_accuracy")
    rows = _log(spark, d).select("logged", r, F.lag(r).over(w).alias("p"), F.first(r).over(w).alias("f"), F.row_number().over(back).alias("back")).filter("back <= 10")
    return rows.select("logged", F.round(r, 6).alias("retrieval_accuracy"), F.round(r - F.col("p"), 6).alias("change"), F.round(r - F.col("f"), 6).alias("since_first"), F.coalesce(r - F.col("p") < -5, F.lit(False)).alias("regression"))


@query(f"WITH {LOG}, x AS (SELECT arg_min(retrieval_accuracy, logged || subset_size) AS base, arg_max(retrieval_accuracy, logged || subset_size) AS latest FROM log) SELECT round(base, 6) AS base, round(latest, 6) AS latest, round((latest - base) / (90.0::DOUBLE - base) * 100, 6) AS progress FROM x")
def progress_to_target(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("logged", F.col("subset_size").cast("string"))
    x = _log(spark, d).agg(F.min_by("retrieval_accuracy", key).alias("base"), F.max_by("retrieval_accuracy", key).alias("latest"))
    return x.select(F.round("base", 6).alias("base"), F.round("latest", 6).alias("latest"), F.round((F.col("latest") - F.col("base")) / F.nullif(F.lit(RETRIEVAL_TARGET) - F.col("base"), F.lit(0.0)) * 100, 6).alias("progress"))


@query(
    f"""WITH {LOG}, f AS (SELECT *, row_number() OVER (PARTITION BY subset_size ORDER BY logged) AS nth, row_number() OVER (PARTITION BY subset_size ORDER BY logged DESC) AS back FROM log)
    SELECT a.subset_size, a.logged AS first_logged, b.logged AS last_logged, round(b.retrieval_accuracy - a.retrieval_accuracy, 6) AS retrieval_change, round(b.attribution_accuracy - a.attribution_accuracy, 6) AS attribution_change FROM f a JOIN f b USING (subset_size) WHERE a.nth = 1 AND b.back = 1"""
)
def compare_checkpoints(spark: SparkSession, d: str) -> DataFrame:
    """The first run of each size against the last one."""
    log = _log(spark, d)
    a = log.groupBy("subset_size").agg(F.min_by(F.struct("logged", "retrieval_accuracy", "attribution_accuracy"), "logged").alias("a"), F.max_by(F.struct("logged", "retrieval_accuracy", "attribution_accuracy"), "logged").alias("b"))
    return a.select("subset_size", F.col("a.logged").alias("first_logged"), F.col("b.logged").alias("last_logged"), F.round(F.col("b.retrieval_accuracy") - F.col("a.retrieval_accuracy"), 6).alias("retrieval_change"), F.round(F.col("b.attribution_accuracy") - F.col("a.attribution_accuracy"), 6).alias("attribution_change"))


@query(f"WITH {LOG} SELECT logged, subset_size, retrieval_accuracy >= 90 AS retrieval_ok, attribution_accuracy >= 95 AS attribution_ok, p50_latency_ms < 5000 AS p50_ok, p95_latency_ms < 15000 AS p95_ok FROM log")
def nfr_compliance(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select(
        "logged", "subset_size", (F.col("retrieval_accuracy") >= RETRIEVAL_TARGET).alias("retrieval_ok"), (F.col("attribution_accuracy") >= ATTRIBUTION_TARGET).alias("attribution_ok"),
        (F.col("p50_latency_ms") < P50_LIMIT).alias("p50_ok"), (F.col("p95_latency_ms") < P95_LIMIT).alias("p95_ok"),
    )


@query(f"WITH {LOG} SELECT logged, subset_size, coalesce(retrieval_accuracy < 70, false) AS warning FROM log")
def early_warning(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("logged", "subset_size", F.coalesce(F.col("retrieval_accuracy") < EARLY_WARNING, F.lit(False)).alias("warning"))


@query(
    """WITH r AS (SELECT id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY md5(CAST(id AS VARCHAR))) AS nth FROM questions)
    SELECT id, difficulty FROM r WHERE nth <= CASE difficulty WHEN 'easy' THEN 9 WHEN 'medium' THEN 4 WHEN 'hard' THEN 2 ELSE 0 END"""
)
def stratified_sample(spark: SparkSession, d: str, n: int = 15) -> DataFrame:
    """60 % easy, 30 % medium and the rest hard, in a fixed order by hash."""
    easy, medium = int(n * 0.6), int(n * 0.3)
    size = F.when(F.col("difficulty") == "easy", easy).when(F.col("difficulty") == "medium", medium).when(F.col("difficulty") == "hard", n - easy - medium).otherwise(0)
    w = Window.partitionBy("difficulty").orderBy(F.md5(F.col("id").cast("string")))
    return read(spark, d, "questions").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= size).select("id", "difficulty")


@query("SELECT id, question FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) AS nth FROM questions WHERE category = 'unit_costs') WHERE nth <= 5")
def filter_questions(spark: SparkSession, d: str) -> DataFrame:
    """A category's questions, and of them a sample of five."""
    return read(spark, d, "questions").filter(F.col("category") == "unit_costs").orderBy(F.md5(F.col("id").cast("string"))).limit(5).select("id", "question")


@query("SELECT chunk_id, count(*) AS copies FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").filter(F.col("chunk_id").isNotNull()).groupBy("chunk_id").agg(F.count("*").alias("copies")).filter("copies > 1")


@query("SELECT * FROM (VALUES ('cash_and_debt'), ('unit_costs'), ('unheard_of')) t(category) EXCEPT SELECT DISTINCT category FROM questions")
def missing_categories(spark: SparkSession, d: str) -> DataFrame:
    expected = spark.createDataFrame([("cash_and_debt",), ("unit_costs",), ("unheard_of",)], "category string")
    return expected.subtract(read(spark, d, "questions").select("category"))


@query("SELECT category FROM questions INTERSECT SELECT category FROM eval_results")
def common_categories(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "questions").select("category").intersect(read(spark, d, "eval_results").select("category"))


@query("SELECT id, question, category FROM questions UNION ALL SELECT DISTINCT query_id, question, category FROM eval_results")
def union_questions(spark: SparkSession, d: str) -> DataFrame:
    asked = read(spark, d, "eval_results").select(F.col("query_id").alias("id"), "question", "category").distinct()
    return read(spark, d, "questions").select("id", "question", "category").unionByName(asked)


@query(f"WITH {ONE} SELECT metadata.filename AS filename, min(page_number) AS first_page, max(page_number) AS last_page, count(DISTINCT page_number) AS pages, count(*) AS chunks, count_if(page_number < 1) AS under, count_if(page_number > metadata.page_count) AS over FROM one GROUP BY 1")
def page_bounds(spark: SparkSession, d: str) -> DataFrame:
    one = R.one_per_chunk(read(spark, d, "chunks"))
    p = F.col("page_number")
    return one.groupBy(F.col("metadata.filename").alias("filename")).agg(F.min(p).alias("first_page"), F.max(p).alias("last_page"), F.countDistinct(p).alias("pages"), F.count("*").alias("chunks"), F.count_if(p < 1).alias("under"), F.count_if(p > F.col("metadata.page_count")).alias("over"))


@query(f"WITH {ELEMENTS} SELECT filename, count(*) AS items, count(page_no) AS with_page, round(100.0::DOUBLE * count(page_no) / count(*), 6) AS coverage FROM el GROUP BY filename")
def provenance_coverage(spark: SparkSession, d: str) -> DataFrame:
    one = read(spark, d, "elements").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    n = one.groupBy("filename").agg(F.count("*").alias("items"), F.count("page_no").alias("with_page"))
    return n.withColumn("coverage", _percent(F.col("with_page"), F.col("items")))


@query(f"WITH {ONE} SELECT chunk_id, metadata.filename AS filename, chunk_index FROM one WHERE page_number = 12")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.one_per_chunk(read(spark, d, "chunks").filter("page_number = 12")).select("chunk_id", F.col("metadata.filename").alias("filename"), "chunk_index")


#: What the literal search looks for.
LITERALS = ("EUR/t", "Group", "net debt", "Q3 FY24", "no such value")


@query(f"WITH {ONE}, v AS (SELECT unnest({list(LITERALS)}) AS value) SELECT value, count(chunk_id) AS chunks, count(DISTINCT metadata.filename) AS files, count(chunk_id) > 0 AS found FROM v LEFT JOIN one ON contains(content, value) GROUP BY value")
def literal_search(spark: SparkSession, d: str) -> DataFrame:
    """In how many chunks and files each value stands as it is; one pass, counting per value."""
    one = R.one_per_chunk(read(spark, d, "chunks")).select(F.col("metadata.filename").alias("filename"), "content")
    hits = one.select("filename", F.explode(F.filter(F.array(*[F.lit(v) for v in LITERALS]), lambda v: F.contains(F.coalesce("content", F.lit("")), v))).alias("value"))
    n = hits.groupBy("value").agg(F.count("*").alias("chunks"), F.countDistinct("filename").alias("files"))
    values = spark.createDataFrame([(v,) for v in LITERALS], "value string")
    zero = F.lit(0)
    return values.join(n, "value", "left").select("value", F.coalesce("chunks", zero).alias("chunks"), F.coalesce("files", zero).alias("files"), F.col("chunks").isNotNull().alias("found"))


@query(
    f"""WITH {ONE}, hits AS (SELECT q.id, o.page_number, q.expected_page_number AS expected, len(list_filter(q.expected_keywords, lambda k: contains({normal("lower(coalesce(o.content, ''))")}, {normal("lower(k)")}))) AS n
      FROM questions q JOIN one o ON o.metadata.filename = q.source_document AND o.page_number BETWEEN greatest(1, q.expected_page_number - 10) AND q.expected_page_number + 10)
    SELECT q.id, coalesce(count_if(n >= 2), 0) AS chunks, coalesce(bool_or(n >= 2 AND page_number = expected), false) AS valid FROM questions q LEFT JOIN hits USING (id) GROUP BY q.id"""
)
def window_keyword_check(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the expected document within ten pages of the expected one that hold two keywords; valid if on the page itself."""
    q = F.broadcast(read(spark, d, "questions").select("id", "expected_keywords", "expected_page_number", "source_document"))  # a fixed table of 50 rows
    one = R.one_per_chunk(read(spark, d, "chunks")).select(F.col("metadata.filename").alias("source_document"), "page_number", "content")
    near = one.join(q, "source_document").filter(F.col("page_number").between(F.greatest(F.lit(1), F.col("expected_page_number") - 10), F.col("expected_page_number") + 10))
    near = near.withColumn("t", normalize_numbers(F.lower(F.coalesce("content", F.lit("")))))
    n = F.size(F.filter("expected_keywords", lambda k: F.contains(F.col("t"), normalize_numbers(F.lower(k)))))
    per = near.withColumn("n", n).filter("n >= 2").groupBy("id").agg(F.count("*").alias("chunks"), F.bool_or(F.col("page_number") == F.col("expected_page_number")).alias("valid"))
    return read(spark, d, "questions").select("id").join(per, "id", "left").select("id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("valid", F.lit(False)).alias("valid"))


@query(
    f"""WITH {EVAL}, {LOG}, runs AS (SELECT run_id, min(make_timestamp(epoch_us(run_at))) AS t FROM er GROUP BY run_id)
    SELECT run_id, arg_max(retrieval_accuracy, (logged, subset_size, retrieval_accuracy)) AS retrieval_accuracy FROM runs LEFT JOIN log ON CAST(logged AS TIMESTAMP) <= t GROUP BY run_id"""
)
def asof_latest_metric(spark: SparkSession, d: str) -> DataFrame:
    """For each run the last accuracy logged before it: both on one time line, the last value carried on.

    Carried within days first and from day to day then, so that no task sees the whole time line.
    """
    er = _results(spark, d).groupBy("run_id").agg(F.min("run_at").alias("t"))
    log = _log(spark, d).select(F.col("logged").cast("timestamp").alias("t"), "subset_size", F.col("retrieval_accuracy").alias("v"))
    line = er.select("t", "run_id", F.lit(None).cast("int").alias("subset_size"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind")).unionByName(log.select("t", F.lit(None).cast("bigint").alias("run_id"), "subset_size", "v", F.lit(0).alias("kind")))
    line = line.withColumn("day", F.to_date("t"))
    w = Window.partitionBy("day").orderBy("t", "kind", "subset_size", "v").rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("seen", F.last("v", ignorenulls=True).over(w))
    days = log.groupBy(F.to_date("t").alias("day")).agg(F.max_by("v", F.struct("t", "subset_size", "v")).alias("v"))
    every = line.select("day").distinct().join(days, "day", "left").withColumn("carried", F.last("v", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "carried")
    return line.filter("kind = 1").join(every, "day", "left").select("run_id", F.coalesce("seen", "carried").alias("retrieval_accuracy"))
