"""Sources, the collection, chunking and text transforms."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.engine import Engine, QueryError, QueryRequest, Settings
from ledgerlens.functions.text import citation, fiscal_period, normalize_numbers, query_keywords, word_count
from ledgerlens.operators import chunking as C
from ledgerlens.operators import retrieval as R
from ledgerlens.plans.registry import ELEMENTS, LOG, ONE, POINTS, WHITE, normal, query, strip, words
from ledgerlens.runtime import filesystem, fresh_path, read, stored
from ledgerlens.sources.files import append_json_lines, read_json_lines, read_workbooks, reader_of, write_workbook
from ledgerlens.sources.tables import markdown_table
from ledgerlens.streaming.streams import upsert_stream

BOOK = "Group Performance Book Consolidated.pdf"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").withColumn("page_count", F.ceil(F.col("n_chars") / 2000).cast("int"))


@query("SELECT DISTINCT filename, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.xlsx' OR lower(filename) LIKE '%.xls' THEN 'excel' ELSE 'unsupported' END AS reader FROM files WHERE filename IS NOT NULL")
def ingest_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "files").select("filename").filter(F.col("filename").isNotNull()).distinct().withColumn("reader", reader_of(F.col("filename")))


@query(f"WITH {ELEMENTS} SELECT filename, count(*) AS elements, count(page_no) AS with_page, count_if(is_table) AS tables, count(DISTINCT page) AS pages FROM filled GROUP BY filename")
def ingest_elements(spark: SparkSession, d: str) -> DataFrame:
    one = read(spark, d, "elements").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    filled = C.fill_forward(one.withColumn("page", F.col("page_no")), "filename", "item_seq", "page", 1)
    return filled.groupBy("filename").agg(F.count("*").alias("elements"), F.count("page_no").alias("with_page"), F.count_if("is_table").alias("tables"), F.countDistinct("page").alias("pages"))


_NATION = "'| ' || n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |'"
_REGION = "'| ' || r_regionkey || ' | ' || r_name || ' |'"


@query(f"SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg({_NATION}, chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return markdown_table(read(spark, d, "nation"), ["n_nationkey", "n_name", "n_regionkey"], "n_nationkey")


@query(
    f"""WITH a AS (SELECT '## Sheet 1: region' || chr(10) || '| r_regionkey | r_name |' || chr(10) || '|---|---|' || chr(10) || string_agg({_REGION}, chr(10) ORDER BY r_regionkey) AS s FROM region),
    b AS (SELECT '## Sheet 3: nation' || chr(10) || '| n_nationkey | n_name | n_regionkey |' || chr(10) || '|---|---|---|' || chr(10) || string_agg({_NATION}, chr(10) ORDER BY n_nationkey) AS s FROM nation)
    SELECT a.s || chr(10) || chr(10) || b.s AS content, 2 AS page_count FROM a, b"""
)
def sheet_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A workbook is written and read: its sheets are numbered over all of it; the second is empty and left out, but keeps its number."""
    region, nation = read(spark, d, "region").orderBy("r_regionkey"), read(spark, d, "nation").orderBy("n_nationkey")
    # the tables of regions and nations do not grow with the data
    sheets = [("region", region.select("r_regionkey", "r_name")), ("empty", nation.select("n_name").limit(0)), ("nation", nation.select("n_nationkey", "n_name", "n_regionkey"))]
    data = io.BytesIO()
    write_workbook(data, [(name, [df.columns, *map(list, df.collect())]) for name, df in sheets])
    path = fresh_path(spark, "books")
    at, fs = filesystem(spark, f"{path}/book.xlsx")
    out = fs.create(at)
    out.write(bytearray(data.getvalue()))
    out.close()
    blocks = read_workbooks(spark, path).groupBy("filename").agg(F.array_sort(F.collect_list(F.struct("sheet_number", "content"))).alias("b"))
    return blocks.select(F.array_join(F.transform("b", lambda x: x["content"]), "\n\n").alias("content"), F.size("b").alias("page_count"))


@query(
    """WITH x AS (SELECT doc_id, text, CAST(ceil(n_chars / 2000) AS INTEGER) AS p FROM documents WHERE text IS NOT NULL AND n_chars > 0),
    y AS (SELECT *, length(text) // p AS size, unnest(range(1, p + 1)) AS page_number FROM x)
    SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CASE WHEN page_number = p THEN substring(text, (page_number - 1) * size + 1) ELSE substring(text, (page_number - 1) * size + 1, size) END AS content FROM y"""
)
def pseudo_pages(spark: SparkSession, d: str) -> DataFrame:
    return C.pseudo_pages(_docs(spark, d))


@query(f"WITH {LOG} SELECT logged, subset_size, retrieval_accuracy, attribution_accuracy, p50_latency_ms, p95_latency_ms, errors, CAST(len(query_ids) AS INTEGER) AS n_queries FROM log")
def load_tracking_log(spark: SparkSession, d: str) -> DataFrame:
    """The log is appended run by run as JSON lines and read back, with a blank and a broken line among them."""
    path = fresh_path(spark, "log")
    log = read(spark, d, "tracking_log").withColumnRenamed("logged", "timestamp")
    append_json_lines(log.filter("subset_size < 50"), path)
    append_json_lines(log.filter("NOT coalesce(subset_size < 50, false)"), path)
    at, fs = filesystem(spark, f"{path}/more.json")
    out = fs.create(at)
    out.write(bytearray(b'\n{"timestamp": "2024-01\n'))
    out.close()
    log = read_json_lines(spark, path).distinct().withColumnRenamed("timestamp", "logged")
    return log.select("logged", "subset_size", "retrieval_accuracy", "attribution_accuracy", "p50_latency_ms", "p95_latency_ms", "errors", F.size("query_ids").alias("n_queries")).orderBy("logged")


@query(f"WITH {POINTS} SELECT chunk_id, source_document, page_number, chunk_index FROM points")
def collection_scan(spark: SparkSession, d: str) -> DataFrame:
    """The whole collection without its vectors and texts."""
    return R.points(read(spark, d, "chunks")).select("chunk_id", "source_document", "page_number", "chunk_index")


@query(f"WITH {POINTS} SELECT chunk_id, word_count, source_document, page_number, chunk_index, CAST(len(embedding) AS INTEGER) AS dimension FROM points")
def store_points(spark: SparkSession, d: str) -> DataFrame:
    """Points are written to a collection in two loads (pages after the tenth again with the second) and read back."""
    points = R.points(read(spark, d, "chunks"))
    path = fresh_path(spark, "collection")
    R.store_points(points, path)
    again = points.join(points.filter("page_number > 10").select("source_document").distinct(), "source_document", "left_semi")
    R.store_points(again, path)
    return R.open_collection(spark, path).select("chunk_id", "word_count", "source_document", "page_number", "chunk_index", F.size("embedding").alias("dimension"))


@query(f"WITH {POINTS} SELECT * FROM (SELECT 1 AS step, 'missing' AS state, CAST(0 AS BIGINT) AS points UNION ALL SELECT 2, 'stored', count(*) FROM points UNION ALL SELECT 3, 'stored again', count(*) FROM points UNION ALL SELECT 4, 'refused', count(*) FROM points UNION ALL SELECT 5, 'deleted', 0)")
def collection_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """What a collection holds as it is made, filled, filled again, kept from an unconfirmed deletion, and deleted."""
    path = fresh_path(spark, "collection")
    engine = Engine(spark, Settings(path))
    points = stored(R.points(read(spark, d, "chunks")), "points")
    steps = [("missing", engine.health()["points"]), ("stored", R.store_points(points, path)), ("stored again", R.store_points(points, path))]
    try:
        R.delete_collection(spark, path)
    except ValueError:
        steps.append(("refused", engine.health()["points"]))
    R.delete_collection(spark, path, really=True)
    steps.append(("deleted", engine.health()["points"]))
    return spark.createDataFrame([(i, state, n) for i, (state, n) in enumerate(steps, 1)], "step int, state string, points long")


@query("SELECT * FROM (VALUES ('', 5, 'Query cannot be empty'), ('   ', 5, 'Query cannot be empty'), ('net debt', 0, 'top_k must be between 1 and 50'), ('net debt', 51, 'top_k must be between 1 and 50')) t(question, top_k, error)")
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """Questions that cannot be put, and why."""
    rows = []
    for question, k in (("", 5), ("   ", 5), ("net debt", 0), ("net debt", 51)):
        try:
            QueryRequest(question, k)
        except QueryError as e:
            rows.append((question, k, str(e)))
    return spark.createDataFrame(rows, "question string, top_k int, error string")


_SHORTER = ELEMENTS.replace("FROM elements WHERE", "FROM (SELECT e.* FROM elements e JOIN (SELECT filename AS f, max(item_seq) AS top FROM elements GROUP BY 1) ON f = filename WHERE NOT filename LIKE '%.pdf' OR item_seq <= top / 2) WHERE")


@query(f"WITH {_SHORTER}, texts AS (SELECT filename, page, string_agg(text, ' ' ORDER BY item_seq) AS content FROM (SELECT DISTINCT filename, item_seq, page, text FROM filled) WHERE {strip('text')} <> '' GROUP BY filename, page), n AS (SELECT *, len({words('content')}) AS n FROM texts), c AS (SELECT filename, CAST(sum(CASE WHEN n <= 500 THEN 1 ELSE CAST(ceil(n / 450) AS BIGINT) END) AS BIGINT) AS chunks FROM n WHERE n > 0 GROUP BY filename) SELECT filename AS source_document, chunks FROM c")
def reingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Documents arrive as a stream and, the PDF files among them, once more in a shorter version: the chunks of the longer one are gone."""
    elements = read(spark, d, "elements")
    top = elements.groupBy("filename").agg(F.max("item_seq").alias("top"))
    shorter = elements.filter(F.col("filename").endswith(".pdf")).join(top, "filename").filter("item_seq <= top / 2").drop("top")
    source, path, state = fresh_path(spark, "arriving"), fresh_path(spark, "collection"), fresh_path(spark, "state")
    schema = "chunk_id string, source_document string, page_number int, chunk_index int, content string"
    for part in (elements, shorter):
        C.chunk_by_page(part).select("chunk_id", F.col("filename").alias("source_document"), "page_number", "chunk_index", "content").coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), path, state).awaitTermination()
    return R.open_collection(spark, path).groupBy("source_document").agg(F.count("*").alias("chunks"))


@query(f"WITH {POINTS} SELECT count(*) AS points, CAST(min(len(embedding)) AS INTEGER) AS least_dimension, CAST(max(len(embedding)) AS INTEGER) AS most_dimension, CAST(sum(word_count) AS BIGINT) AS words FROM points")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.collection_stats(R.points(read(spark, d, "chunks")))


@query(f"WITH {POINTS} SELECT source_document, count(*) AS chunks, count(DISTINCT page_number) AS pages, min(page_number) AS first_page, max(page_number) AS last_page, CAST(sum(word_count) AS BIGINT) AS words FROM points GROUP BY source_document")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return R.list_documents(R.points(read(spark, d, "chunks")))


@query(f"WITH {POINTS} SELECT chunk_id, page_number, chunk_index, word_count FROM points WHERE source_document = '{BOOK}' AND page_number >= 10")
def get_document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One document's chunks: its name and pages are filtered in the scan, before copies are dropped."""
    rows = read(spark, d, "chunks").filter((F.col("metadata.filename") == BOOK) & (F.col("page_number") >= 10))
    return R.document_chunks(R.points(rows), BOOK, first_page=10)


@query(f"WITH {ONE} SELECT metadata.filename AS filename, CAST((page_number - 1) // 40 AS INTEGER) AS part, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS chunks FROM one WHERE page_number >= 1 GROUP BY ALL")
def page_partitions(spark: SparkSession, d: str) -> DataFrame:
    one = R.one_per_chunk(read(spark, d, "chunks")).filter(F.col("page_number") >= 1)
    part = F.floor((F.col("page_number") - 1) / 40).cast("int").alias("part")
    return one.groupBy(F.col("metadata.filename").alias("filename"), part).agg(F.min("page_number").alias("first_page"), F.max("page_number").alias("last_page"), F.count("*").alias("chunks"))


@query(
    """SELECT id, expected_page_number, CASE WHEN expected_page_number BETWEEN 1 AND 160 THEN printf('pages-%03d-%03d', (expected_page_number - 1) // 40 * 40 + 1, (expected_page_number - 1) // 40 * 40 + 40) END AS part FROM questions"""
)
def range_partition_lookup(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor((F.col("expected_page_number") - 1) / 40).cast("int") * 40
    part = F.when(F.col("expected_page_number").between(1, 160), F.format_string("pages-%03d-%03d", start + 1, start + 40))
    return read(spark, d, "questions").select("id", "expected_page_number", part.alias("part"))


_CHUNKS = f"""WITH x AS (SELECT doc_id, text, CAST(ceil(n_chars / 2000) AS INTEGER) AS p, {words('text')} AS w FROM documents),
    y AS (SELECT *, list_transform(range(0, CAST(ceil(len(w) / 450) AS BIGINT)), lambda k: length(array_to_string(list_slice(w, k * 450 + 1, k * 450 + 450), ' '))) AS steps FROM x WHERE len(w) > 0),
    z AS (SELECT *, CASE WHEN len(w) <= 500 THEN 0 ELSE unnest(range(0, CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil(len(w) / 450) AS BIGINT) END)) END AS k FROM y),
    placed AS (SELECT *, CASE WHEN k = 0 THEN 0 ELSE list_sum(list_slice(steps, 1, k)) + k - 1 END AS pos FROM z)"""


@query(
    f"""{_CHUNKS} SELECT doc_id, doc_id || '_' || k AS chunk_id, CAST(k AS INTEGER) AS chunk_index,
    CAST(CASE WHEN len(w) <= 500 THEN least(coalesce(p, 0), 1) ELSE greatest(least(floor(pos / (CAST(length(text) AS DOUBLE) / greatest(coalesce(p, 0), 1))) + 1, coalesce(p, 0)), 1) END AS INTEGER) AS page_number,
    CASE WHEN len(w) <= 500 THEN {strip('text')} ELSE array_to_string(list_slice(w, k * 450 + 1, k * 450 + 500), ' ') END AS content FROM placed"""
)
def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_words(_docs(spark, d))


@query(
    f"""WITH x AS (SELECT doc_id, {words('text')} AS w FROM documents), y AS (SELECT *, unnest(range(0, CAST(ceil(len(w) / 450) AS BIGINT))) AS k FROM x WHERE len(w) > 0)
    SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(ceil(len(w) / 450) AS INTEGER) AS total_chunks, CAST(k * 450 AS INTEGER) AS start_word, CAST(least(k * 450 + 500, len(w)) AS INTEGER) AS end_word,
    array_to_string(list_slice(w, k * 450 + 1, k * 450 + 500), ' ') AS content FROM y"""
)
def chunk_words_spike(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_words_plain(read(spark, d, "documents"))


@query(f"WITH {ELEMENTS} SELECT DISTINCT filename, item_seq, page_no, page AS filled FROM filled")
def page_forward_fill(spark: SparkSession, d: str) -> DataFrame:
    return C.page_forward_fill(read(spark, d, "elements"))


_PAGES = f"""WITH {ELEMENTS}, texts AS (SELECT filename, page, string_agg(text, ' ' ORDER BY item_seq) AS content FROM (SELECT DISTINCT filename, item_seq, page, text FROM filled) WHERE {strip('text')} <> '' GROUP BY filename, page),
    w AS (SELECT *, {words('content')} AS w FROM texts), n AS (SELECT *, CASE WHEN len(w) <= 500 THEN 1 ELSE CAST(ceil(len(w) / 450) AS BIGINT) END AS n FROM w WHERE len(w) > 0),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY filename ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM n), e AS (SELECT *, unnest(range(0, n)) AS k FROM s)"""


@query(
    f"""{_PAGES} SELECT filename || '_' || CAST(start + k AS BIGINT) AS chunk_id, filename, page AS page_number, CAST(start + k AS INTEGER) AS chunk_index,
    CASE WHEN len(w) <= 500 THEN content ELSE array_to_string(list_slice(w, k * 450 + 1, k * 450 + 500), ' ') END AS content FROM e"""
)
def chunk_by_page(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_by_page(read(spark, d, "elements"))


@query(f"WITH {ONE} SELECT count(*) AS chunks, CAST(min(len({words('content')})) AS INTEGER) AS least_words, CAST(max(len({words('content')})) AS INTEGER) AS most_words, round(avg(len({words('content')})), 6) AS mean_words, CAST(min(length(content)) AS INTEGER) AS least_chars, CAST(max(length(content)) AS INTEGER) AS most_chars, CAST(sum(length(content)) AS BIGINT) AS chars FROM one WHERE content IS NOT NULL")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    one = R.one_per_chunk(read(spark, d, "chunks")).filter(F.col("content").isNotNull()).select(word_count(F.col("content")).alias("w"), F.length("content").alias("c"))
    return one.agg(F.count("*").alias("chunks"), F.min("w").alias("least_words"), F.max("w").alias("most_words"), F.round(F.avg("w"), 6).alias("mean_words"), F.min("c").alias("least_chars"), F.max("c").alias("most_chars"), F.sum("c").alias("chars"))


@query(
    f"""WITH {ELEMENTS}, k AS (SELECT * FROM filled WHERE {strip('text')} <> ''), t AS (SELECT * FROM k WHERE is_table),
    j AS (SELECT t.filename, t.item_seq, t.page, t.text, string_split(coalesce(b.text, ''), '. ') AS b, string_split(coalesce(a.text, ''), '. ') AS a FROM t
      LEFT JOIN (SELECT filename, item_seq, CASE WHEN NOT is_table THEN text END AS text FROM k) b ON b.filename = t.filename AND b.item_seq = t.item_seq - 1
      LEFT JOIN (SELECT filename, item_seq, CASE WHEN NOT is_table THEN text END AS text FROM k) a ON a.filename = t.filename AND a.item_seq = t.item_seq + 1)
    SELECT filename, item_seq, page AS page_number, array_to_string(list_slice(b, len(b) - least(len(b), 2) + 1, len(b)), '. ') || chr(10) || chr(10) || text || chr(10) || chr(10) || array_to_string(list_slice(a, 1, 2), '. ') AS content FROM j"""
)
def table_aware_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.table_aware_chunks(read(spark, d, "elements"))


@query(
    f"""WITH {ELEMENTS}, k AS (SELECT DISTINCT * FROM filled WHERE {strip('text')} <> ''), r AS (SELECT *, coalesce(sum(CASE WHEN is_table THEN 1 ELSE 0 END) OVER (PARTITION BY filename ORDER BY item_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k),
    t AS (SELECT filename, run, page, min(item_seq) AS item_seq, string_agg(text, ' ' ORDER BY item_seq) AS content FROM r WHERE NOT coalesce(is_table, false) GROUP BY ALL), n AS (SELECT *, len({words('content')}) AS n FROM t)
    SELECT filename, 'table' AS chunk_type, page AS page_number, item_seq, CAST(1 AS BIGINT) AS parts FROM k WHERE is_table
    UNION ALL SELECT filename, 'text', page, item_seq, CASE WHEN n <= 500 THEN 1 ELSE CAST(ceil(n / 450) AS BIGINT) END FROM n WHERE n > 0"""
)
def typed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as chunks of tables and of the text between them."""
    return C.typed_chunks(read(spark, d, "elements")).groupBy("filename", "chunk_type", "page_number", "item_seq").agg(F.count("*").alias("parts"))


@query(
    f"""WITH {ELEMENTS} SELECT filename, item_seq, page AS page_number, {strip("string_split(string_split(text, chr(10))[1], '|')[2]")} AS label, len(string_split(string_split(text, chr(10))[1], '|')) - 2 AS columns,
    len(string_split(rtrim(text, chr(10)), chr(10))) - 2 AS rows FROM filled WHERE is_table AND text LIKE '|%'"""
)
def table_structure(spark: SparkSession, d: str) -> DataFrame:
    """Of each markdown table the first header, and how many columns and rows it has."""
    one = read(spark, d, "elements").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    filled = C.fill_forward(one.withColumn("page_number", F.col("page_no")), "filename", "item_seq", "page_number", 1).filter("is_table AND text LIKE '|%'")
    head = F.split(F.split("text", "\n")[0], "\\|")
    return filled.select("filename", "item_seq", "page_number", F.regexp_replace(head[1], f"^[{WHITE}]+|[{WHITE}]+$", "").alias("label"), (F.size(head) - 2).cast("bigint").alias("columns"), (F.size(F.split(F.regexp_replace("text", "\n+$", ""), "\n")) - 2).cast("bigint").alias("rows"))


@query(f"SELECT doc_id, len({words('text')}) AS words FROM documents", name="word_count")
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", word_count(F.col("text")).cast("bigint").alias("words"))


@query(f"SELECT id, unnest(expected_keywords) AS keyword, {normal('unnest(expected_keywords)')} AS normalized FROM questions", name="normalize_numbers")
def normalize_keywords(spark: SparkSession, d: str) -> DataFrame:
    each = read(spark, d, "questions").select("id", F.explode("expected_keywords").alias("keyword"))
    return each.withColumn("normalized", normalize_numbers(F.col("keyword")))


@query(f"SELECT doc_id, {normal('text')} AS text FROM documents")
def normalize_text_numbers(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", normalize_numbers(F.col("text")).alias("text"))


@query(f"WITH {POINTS} SELECT chunk_id, coalesce(text, '') || chr(10) || chr(10) || '(Source: ' || source_document || ', page ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ', chunk ' || chunk_index || ')' AS text FROM points")
def citations(spark: SparkSession, d: str) -> DataFrame:
    return R.points(read(spark, d, "chunks")).select("chunk_id", citation(F.col("text"), F.col("source_document"), F.col("page_number"), F.col("chunk_index")).alias("text"))


@query(f"WITH {ONE} SELECT chunk_id, substring(content, 1, 200) AS preview FROM one")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return R.one_per_chunk(read(spark, d, "chunks")).select("chunk_id", F.substring("content", 1, 200).alias("preview"))


@query("SELECT try_cast(substring(ingestion_timestamp, 1, 10) AS DATE)::VARCHAR AS day, count(DISTINCT filename) AS files, count(*) AS ingestions FROM files GROUP BY 1")
def daily_bucket(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format(F.try_to_date(F.substring("ingestion_timestamp", 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd")
    return read(spark, d, "files").groupBy(day.alias("day")).agg(F.countDistinct("filename").alias("files"), F.count("*").alias("ingestions"))


_STOP = "['the','is','are','what','how','where','when','who','a','an','and','or','but','in','on','at','to','for']"


@query(
    f"""WITH w AS (SELECT id, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') AS w FROM questions),
    p AS (SELECT id, w, list_transform(range(1, len(w)), lambda i: CASE WHEN NOT list_contains({_STOP}, w[i]) AND NOT list_contains({_STOP}, w[i + 1]) THEN w[i] || ' ' || w[i + 1] END) AS pairs FROM w)
    SELECT id, array_to_string(list_concat(list_filter(w, lambda x: NOT list_contains({_STOP}, x)), list_filter(pairs, lambda x: x IS NOT NULL)), '; ') AS keywords FROM p""", name="query_keywords")
def keywords_of_questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "questions").select("id", F.array_join(query_keywords(F.col("question")), "; ").alias("keywords"))


@query(f"WITH {ONE} SELECT chunk_id, 'From ' || metadata.filename || ', page ' || coalesce(CAST(page_number AS VARCHAR), 'unknown') || '.' || chr(10) || chr(10) || content AS content FROM one WHERE {strip('content')} <> ''")
def contextual_prefix(spark: SparkSession, d: str) -> DataFrame:
    one = R.one_per_chunk(read(spark, d, "chunks")).filter(F.regexp_replace("content", f"^[{WHITE}]+|[{WHITE}]+$", "") != "")
    prefix = F.concat(F.lit("From "), F.col("metadata.filename"), F.lit(", page "), F.coalesce(F.col("page_number").cast("string"), F.lit("unknown")), F.lit(".\n\n"))
    return one.select("chunk_id", F.concat(prefix, "content").alias("content"))


_MONTH = "list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], substring(fiscal_period, 1, 3))"


@query(
    f"""SELECT fiscal_period, CASE WHEN regexp_matches(fiscal_period, '^Q[1-4] FY[0-9]{{2}}$') THEN '20' || substring(fiscal_period, 6, 2) || '-' || substring(fiscal_period, 1, 2)
    WHEN regexp_matches(fiscal_period, '^H[12] [0-9]{{4}}$') THEN substring(fiscal_period, 4, 4) || '-' || substring(fiscal_period, 1, 2)
    WHEN regexp_matches(fiscal_period, '^[A-Z][a-z]{{2}}-[0-9]{{2}}$') THEN '20' || substring(fiscal_period, 5, 2) || '-' || printf('%02d', {_MONTH})
    WHEN regexp_matches(fiscal_period, '^[0-9]{{4}}-[0-9]{{2}}$') THEN fiscal_period END AS period, count(*) AS documents FROM documents GROUP BY ALL""", name="fiscal_period")
def fiscal_periods(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").groupBy("fiscal_period", fiscal_period(F.col("fiscal_period")).alias("period")).agg(F.count("*").alias("documents"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
