"""Vector search, keyword search, re-ranking and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.text import citation, normalize_numbers, query_keywords, words
from ledgerlens.functions.vectors import cosine, usable
from ledgerlens.operators import ranking as K
from ledgerlens.operators import retrieval as R
from ledgerlens.plans.registry import ONE, query
from ledgerlens.plans.registry import words as sql_words
from ledgerlens.operators.vectorindex import VectorIndex
from ledgerlens.runtime import fresh_path, read, stored


def _vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of vec_id 0: one row."""
    return read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6)"
_Q0 = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
_S0 = f"{_Q0}, s AS (SELECT vec_id, label, {_COS.format(a='embedding', b='q')} AS score FROM embeddings, q WHERE vec_id <> 0)"


@query(f"WITH {_S0} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5", name="cosine_topk")
def _cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.cosine_topk(read(spark, d, "embeddings").filter("vec_id <> 0"), _vector(spark, d)).select("vec_id", "score")


@query(f"WITH {_S0} SELECT vec_id, score FROM s WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 5")
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.cosine_topk(read(spark, d, "embeddings").filter("vec_id <> 0"), _vector(spark, d), filters={"label": 3}).select("vec_id", "score")


@query(f"WITH {_S0} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, coalesce(label, 0) AS label FROM s ORDER BY score DESC, vec_id LIMIT 10")
def topk_with_defaults(spark: SparkSession, d: str) -> DataFrame:
    top = R.cosine_topk(read(spark, d, "embeddings").filter("vec_id <> 0"), _vector(spark, d), k=10).withColumn("all", F.lit(0))
    return K.best(top, "all", "score", "vec_id", 10).select("vec_id", "score", "rank", F.coalesce("label", F.lit(0)).alias("label"))


_MULTI = f"m AS (SELECT a.vec_id AS query, b.vec_id, {_COS.format(a='a.embedding', b='b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM m)"


@query(f"WITH {_MULTI} SELECT query, vec_id, score, rank FROM r WHERE rank <= 5")
def multi_query_topk(spark: SparkSession, d: str) -> DataFrame:
    base = read(spark, d, "embeddings")
    return R.batch_topk(base, base.filter("vec_id % 100 = 0"))


_USABLE = "len(embedding) > 0 AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding) AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0"
_USED = f"{ONE}, used AS (SELECT *, lower(metadata.doc_type) AS kind FROM one WHERE {_USABLE})"


def _used(spark: SparkSession, d: str) -> DataFrame:
    return R.one_per_chunk(read(spark, d, "chunks")).filter(usable(F.col("embedding")))


@query(
    f"""WITH {_USED}, q AS (SELECT embedding AS q FROM used ORDER BY chunk_id LIMIT 1), first AS (SELECT chunk_id, min(metadata.ingestion_timestamp) AS since FROM chunks GROUP BY chunk_id)
    SELECT chunk_id, {_COS.format(a='embedding', b='q')} AS score, metadata.filename AS source_document, page_number FROM used JOIN first USING (chunk_id), q
    WHERE kind = 'pdf' AND substring(since, 1, 10) BETWEEN '2024-03-01' AND '2025-03-31' ORDER BY score DESC, chunk_id LIMIT 10"""
)
def filtered_topk_range(spark: SparkSession, d: str) -> DataFrame:
    """Filters on type and date (of the first copy) before the ranking; what holds for every copy is filtered in the scan."""
    vector = _first_vector(spark, d)
    pdf = read(spark, d, "chunks").filter(F.col("chunk_id").isNotNull() & (F.lower("metadata.doc_type") == "pdf"))
    one = pdf.groupBy("chunk_id").agg(F.min("metadata.ingestion_timestamp").alias("since"), F.first("embedding").alias("embedding"), F.first("metadata.filename").alias("source_document"), F.first("page_number").alias("page_number"))
    kept = one.filter(F.substring("since", 1, 10).between("2024-03-01", "2025-03-31"))
    return R.cosine_topk(kept, vector, k=10, key="chunk_id").select("chunk_id", "score", "source_document", "page_number")


@query(f"WITH {_USED}, q AS (SELECT embedding AS q FROM used ORDER BY chunk_id LIMIT 1) SELECT chunk_id, {_COS.format(a='embedding', b='q')} AS score, page_number IS NULL AS page_missing, score NOT BETWEEN 0 AND 1 AS out_of_range FROM used, q")
def result_projection(spark: SparkSession, d: str) -> DataFrame:
    """Every scored row: negative scores and missing pages are flagged, never an error."""
    used = _used(spark, d)
    vector = F.array(*[F.lit(float(x)) for x in _first_vector(spark, d)])
    score = F.round(cosine(F.col("embedding"), vector), 6)
    return used.select("chunk_id", score.alias("score"), F.col("page_number").isNull().alias("page_missing"), (~score.between(0, 1)).alias("out_of_range"))


@query(
    f"""WITH {_USED}, q AS (SELECT embedding AS q FROM used ORDER BY chunk_id LIMIT 1), t AS (SELECT *, {_COS.format(a='embedding', b='q')} AS score FROM used, q ORDER BY score DESC, chunk_id LIMIT 5)
    SELECT chunk_id, score, coalesce(content, '') || chr(10) || chr(10) || '(Source: ' || metadata.filename || ', page ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ', chunk ' || chunk_index || ')' AS text FROM t"""
)
def cited_answer(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the five chunks nearest to one vector, with citations."""
    top = R.nearest_rows(read(spark, d, "chunks"), _first_vector(spark, d))
    return top.select("chunk_id", "score", citation(F.col("content"), F.col("metadata.filename"), F.col("page_number"), F.col("chunk_index")).alias("text"))


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of the first chunk that has one; copies have the same, so none need be dropped."""
    rows, first = read(spark, d, "chunks").select("chunk_id", "embedding").filter(F.col("chunk_id").isNotNull() & (F.size("embedding") > 0)), 16
    while True:  # the first few by id, more only if none of them will do
        some = rows.orderBy("chunk_id").limit(first)
        got = some.filter(usable(F.col("embedding"))).orderBy("chunk_id").limit(1).collect()
        if got:
            return got[0][1]
        if some.count() < first:
            raise ValueError("no chunk has a vector")
        first *= 8


@query(f"WITH {_S0} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 5", name="indexed_topk")
def _indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """Through the index, all of whose cells are visited here, so that the answer is the exact one."""
    index = VectorIndex.build(read(spark, d, "embeddings"), fresh_path(spark, "index"))
    found = index.search(_vector(spark, d), k=6, probes=len(index.centroids)).filter("vec_id <> 0")
    return found.orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", "score")


@query(f"WITH {_MULTI} SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM r WHERE r.vec_id = doc_id AND rank <= 5)")
def docs_with_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose number is among the neighbours that multi_query_topk finds."""
    base = read(spark, d, "embeddings")
    hits = R.batch_topk(base, base.filter("vec_id % 100 = 0")).select(F.col("vec_id").alias("doc_id"))
    return read(spark, d, "documents").select("doc_id", "source").join(hits, "doc_id", "left_semi")


@query("SELECT id, question FROM questions WHERE NOT EXISTS (SELECT 1 FROM eval_results e WHERE e.query_id = id AND e.retrieval.pass_ AND e.attribution.pass_ AND e.top_score > 0.7)")
def unanswered_questions(spark: SparkSession, d: str) -> DataFrame:
    passed = read(spark, d, "eval_results").filter("retrieval.pass_ AND attribution.pass_ AND top_score > 0.7").select(F.col("query_id").alias("id"))
    return read(spark, d, "questions").select("id", "question").join(passed, "id", "left_anti")


# keyword search of all questions over all chunks


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "questions").select(F.col("id").alias("qid"), "question", "expected_keywords", "expected_page_number", "source_document", "category")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return R.one_per_chunk(read(spark, d, "chunks"))


def _bm25(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return K.best(K.bm25(_texts(spark, d).select("chunk_id", "content"), _questions(spark, d)), "qid", "score", "chunk_id", k)


_BM25 = f"""{ONE}, tok AS (SELECT chunk_id, coalesce({sql_words('content')}, []) AS w FROM one), tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
    qt AS (SELECT DISTINCT id AS qid, unnest({sql_words('question')}) AS term FROM questions),
    post AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    bm AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.7 / (tf + 1.7 * (1 - 0.6 + 0.6 * length / mean))), 6) AS score FROM post JOIN dfs USING (term) JOIN qt USING (term), tot GROUP BY qid, chunk_id),
    bmr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bm), bm20 AS (SELECT * FROM bmr WHERE rank <= 20)"""


@query(f"WITH {_BM25} SELECT qid, chunk_id, score, rank FROM bm20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("qid", "chunk_id", "score", "rank")


def _semantic(spark: SparkSession, d: str, bm: DataFrame, k: int = 20) -> DataFrame:
    """Without a text model a question's vector is that of its best keyword hit that has one."""
    used = _used(spark, d).select("chunk_id", "embedding")
    lead = K.best(bm.join(used.select("chunk_id"), "chunk_id", "left_semi").drop("rank"), "qid", "score", "chunk_id", 1)
    vectors = lead.select("qid", "chunk_id").join(used, "chunk_id").select("qid", "embedding")
    near = R.batch_topk(used.withColumnRenamed("chunk_id", "id"), vectors.withColumnRenamed("qid", "id").select(F.col("id").cast("string").alias("id"), "embedding"), k=k, key="id", exclude_self=False)
    return near.select(F.col("query").cast("int").alias("qid"), F.col("id").alias("chunk_id"), "score", "rank")


_SEM = f"""{_BM25}, used AS (SELECT * FROM one WHERE {_USABLE}),
    lead AS (SELECT qid, arg_max(embedding, (score, -rank)) AS q FROM bm20 JOIN used USING (chunk_id) GROUP BY qid),
    sem AS (SELECT qid, chunk_id, {_COS.format(a='embedding', b='q')} AS score FROM lead, used),
    semr AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sem), sem20 AS (SELECT * FROM semr WHERE rank <= 20)"""


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    bm = stored(_bm25(spark, d), "keyword").select("qid", "chunk_id", "score", "rank")
    return _semantic(spark, d, bm), bm


_HYBRID = """hy AS (SELECT qid, chunk_id, round(0.7 * coalesce(s.score, 0) + (1 - 0.7) * CASE WHEN top > 0 THEN coalesce(b.score, 0) / top ELSE 0 END, 9) AS score
    FROM sem20 s FULL JOIN bm20 b USING (qid, chunk_id) LEFT JOIN (SELECT qid, max(score) AS top FROM bm20 GROUP BY qid) USING (qid))"""


def _top(relation: str, k: int) -> str:
    return f"SELECT qid, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM {relation}) WHERE rank <= {k}"


@query(f"WITH {_SEM}, {_HYBRID} {_top('hy', 5)}")
def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    semantic, keyword = _lists(spark, d)
    return K.best(K.weighted_fusion(semantic, keyword), "qid", "score", "chunk_id", 5)


@query(f"WITH {_SEM}, f AS (SELECT qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT qid, chunk_id, rank FROM sem20 UNION ALL SELECT qid, chunk_id, rank FROM bm20) GROUP BY ALL) {_top('f', 10)}")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return K.best(K.reciprocal_ranks(list(_lists(spark, d))), "qid", "score", "chunk_id", 10)


@query(f"WITH {_SEM}, f AS (SELECT qid, chunk_id, max(score) AS score FROM (SELECT qid, chunk_id, score FROM sem20 UNION ALL SELECT qid, chunk_id, score FROM bm20) GROUP BY ALL) {_top('f', 10)}")
def max_score_fusion(spark: SparkSession, d: str) -> DataFrame:
    return K.best(K.highest_score(list(_lists(spark, d))), "qid", "score", "chunk_id", 10)


_KEYS = "kw AS (SELECT id AS qid, list_distinct(list_filter(regexp_extract_all(lower(question), '[\\p{L}\\p{N}_]+'), lambda x: NOT list_contains(['the','is','are','what','how','where','when','who','a','an','and','or','but','in','on','at','to','for'], x))) AS ks FROM questions)"


@query(
    f"""WITH {_SEM}, {_KEYS}, rr AS (SELECT s.qid, s.chunk_id, round(0.7 * s.score + 0.3 * CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda x: contains(lower(coalesce(content, '')), x))) / len(ks)::DOUBLE ELSE 0 END, 9) AS score
    FROM sem20 s JOIN one USING (chunk_id) JOIN kw USING (qid)) {_top('rr', 5)}"""
)
def keyword_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Of four times as many candidates, those that also hold the question's words."""
    semantic, _ = _lists(spark, d)
    keys = _questions(spark, d).select("qid", F.array_distinct(F.filter(query_keywords(F.col("question")), lambda x: ~F.contains(x, F.lit(" ")))).alias("ks"))
    rows = semantic.join(F.broadcast(keys), "qid").join(_texts(spark, d).select("chunk_id", "content"), "chunk_id")
    hits = F.size(F.filter("ks", lambda k: F.contains(F.lower(F.coalesce("content", F.lit(""))), k)))
    share = F.when(F.size("ks") > 0, hits / F.size("ks")).otherwise(0.0)
    return K.best(rows.select("qid", "chunk_id", F.round(0.7 * F.col("score") + 0.3 * share, 9).alias("score")), "qid", "score", "chunk_id", 5)


@query(f"WITH {_SEM}, tb AS (SELECT qid, chunk_id, round(s.score * CASE WHEN coalesce(contains(content, '|---'), false) THEN 1.2 ELSE 1 END, 9) AS score FROM sem20 s JOIN one USING (chunk_id)) {_top('tb', 10)}")
def table_boost(spark: SparkSession, d: str) -> DataFrame:
    semantic, _ = _lists(spark, d)
    rows = semantic.join(_texts(spark, d).select("chunk_id", "content"), "chunk_id")
    boost = F.when(F.coalesce(F.contains("content", F.lit("|---")), F.lit(False)), 1.2).otherwise(1.0)
    return K.best(rows.select("qid", "chunk_id", F.round(F.col("score") * boost, 9).alias("score")), "qid", "score", "chunk_id", 10)


_CLASSES = """dc AS (SELECT q.id AS qid, coalesce(round(b.s, 6), 0) AS bm25_score, coalesce(s.s, 0) AS semantic_score, b.s IS NULL AS missing FROM questions q
    LEFT JOIN (SELECT qid, max(score) / 20 AS s FROM bm20 GROUP BY qid) b ON b.qid = q.id LEFT JOIN (SELECT qid, avg(score) AS s FROM sem20 GROUP BY qid) s ON s.qid = q.id),
    dd AS (SELECT qid, bm25_score, round(semantic_score, 6) AS semantic_score, CASE WHEN missing THEN 'semantic' WHEN bm25_score > 1.5 * semantic_score THEN 'bm25' WHEN semantic_score > 1.5 * bm25_score THEN 'semantic' ELSE 'balanced' END AS dominant,
    round(CASE WHEN missing THEN 1 WHEN bm25_score > 1.5 * semantic_score THEN bm25_score / greatest(semantic_score, 0.01) WHEN semantic_score > 1.5 * bm25_score THEN semantic_score / greatest(bm25_score, 0.01) ELSE 1 END, 4) AS ratio FROM dc)"""


def _dominance(spark: SparkSession, d: str) -> DataFrame:
    """Per question the keyword score (best, scaled by 20), the mean semantic score, and which of the two prevails."""
    semantic, keyword = _lists(spark, d)
    b = keyword.groupBy("qid").agg((F.max("score") / 20).alias("b"))
    s = semantic.groupBy("qid").agg(F.avg("score").alias("s"))
    rows = _questions(spark, d).select("qid").join(b, "qid", "left").join(s, "qid", "left")
    rows = rows.select("qid", F.col("b").isNull().alias("missing"), F.coalesce(F.round("b", 6), F.lit(0.0)).alias("b"), F.coalesce("s", F.lit(0.0)).alias("s"))

    def case(none, bm, sem, other) -> Column:
        return F.when(F.col("missing"), none).when(F.col("b") > 1.5 * F.col("s"), bm).when(F.col("s") > 1.5 * F.col("b"), sem).otherwise(other)

    floor = F.lit(0.01)
    ratio = case(F.lit(1.0), F.col("b") / F.greatest("s", floor), F.col("s") / F.greatest("b", floor), F.lit(1.0))
    return rows.select("qid", F.col("b").alias("bm25_score"), F.round("s", 6).alias("semantic_score"), case(F.lit("semantic"), F.lit("bm25"), F.lit("semantic"), F.lit("balanced")).alias("dominant"), F.round(ratio, 4).alias("ratio"))


@query(f"WITH {_SEM}, {_CLASSES} SELECT * FROM dd")
def dominance_class(spark: SparkSession, d: str) -> DataFrame:
    return _dominance(spark, d)


@query(f"WITH {_SEM}, {_CLASSES}, n AS (SELECT count_if(dominant = 'bm25') AS bm25, count_if(dominant = 'semantic') AS semantic, count_if(dominant = 'balanced') AS balanced, count(*) AS n FROM dd) SELECT bm25, semantic, balanced, round(greatest(least(0.5 + (semantic / n - 0.5) * 0.4, 0.7), 0.3), 6) AS alpha FROM n")
def fusion_alpha(spark: SparkSession, d: str) -> DataFrame:
    n = _dominance(spark, d).agg(*[F.count_if(F.col("dominant") == c).alias(c) for c in ("bm25", "semantic", "balanced")], F.count("*").alias("n"))
    return n.select("bm25", "semantic", "balanced", F.round(F.greatest(F.least(0.5 + (F.col("semantic") / F.col("n") - 0.5) * 0.4, F.lit(0.7)), F.lit(0.3)), 6).alias("alpha"))


def _part(columns: str) -> str:
    return f"SELECT a.vec_id AS qid, b.vec_id, {_COS.format(a=columns.format('a'), b=columns.format('b'))} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


_VECTORS = {"entire": "{}.embedding", "front": "list_slice({}.embedding, 1, 32)", "back": "list_slice({}.embedding, 33, 64)"}


@query(
    "WITH "
    + ", ".join(f"{n} AS ({_part(c)}), {n}r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM {n})" for n, c in _VECTORS.items())
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT qid, vec_id, rank FROM {n}r WHERE rank <= 10" for n in _VECTORS)
    + "), f AS (SELECT qid, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM u GROUP BY ALL) SELECT qid, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM f) WHERE rank <= 5"
)
def multi_vector_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Three collections of the same rows under different vectors, twice as many from each, fused by rank."""
    base = read(spark, d, "embeddings").select("vec_id", "embedding")
    lists = []
    for part in (F.col("embedding"), F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)):
        vectors = base.select("vec_id", part.alias("embedding"))
        lists.append(R.batch_topk(vectors, vectors.filter("vec_id % 100 = 0"), k=10).select(F.col("query").alias("qid"), "vec_id", "rank"))
    return K.best(K.reciprocal_ranks(lists, key="vec_id"), "qid", "score", "vec_id", 5)


#: Words of questions and others for them: what the query below passes to the operator.
SYNONYMS = (("rent", "lease"), ("headcount", "staff"), ("kiln", "furnace"), ("budget", "plan"), ("cost", "expense"))


@query(
    f"""WITH {ONE}, tok AS (SELECT chunk_id, coalesce({sql_words('content')}, []) AS w FROM one), tot AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tok),
    syn AS (SELECT * FROM (VALUES {", ".join(str(x) for x in SYNONYMS)}) t(word, other)),
    var AS (SELECT id * 10 AS qid, question FROM questions UNION ALL SELECT q.id * 10 + CAST(row_number() OVER (PARTITION BY q.id ORDER BY word) AS INTEGER), replace(question, word, other) FROM questions q JOIN syn ON list_contains({sql_words('question')}, word)),
    qt AS (SELECT DISTINCT qid, unnest({sql_words('question')}) AS term FROM var),
    post AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS length, unnest(w) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    bm AS (SELECT qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.7 / (tf + 1.7 * (1 - 0.6 + 0.6 * length / mean))), 6) AS score FROM post JOIN dfs USING (term) JOIN qt USING (term), tot GROUP BY qid, chunk_id),
    bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm),
    f AS (SELECT qid // 10 AS qid, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM bmr WHERE rank <= 10 GROUP BY ALL) {_top('f', 5)}"""
)
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Every question and its variations with another word, fused by rank."""
    table = spark.createDataFrame(list(SYNONYMS), "word string, other string")
    return K.expanded_search(_texts(spark, d).select("chunk_id", "content"), _questions(spark, d).select("qid", "question"), table, k=5)


_NAMES = "names AS (SELECT DISTINCT lower(company) AS name FROM documents WHERE company IS NOT NULL UNION SELECT DISTINCT lower(regexp_extract(company, '^[^ ]+')) FROM documents WHERE company IS NOT NULL UNION SELECT lower(n_name) FROM nation)"


@query(
    f"""WITH {_NAMES}, hits AS (SELECT id, count(DISTINCT name) AS n FROM questions JOIN names ON list_contains(list_transform({sql_words('lower(question)')}, lambda x: trim(x, '.,;:!?"()')), name) GROUP BY id),
    f AS (SELECT id, regexp_matches(lower(question), '(correlat|relat|connect|depend|between|together)') AS graph_words, coalesce(n, 0) >= 2 AS entities,
    regexp_matches(lower(question), '(through|via|leads to|because of|caused)') AS hops FROM questions LEFT JOIN hits USING (id)) SELECT id, CASE WHEN graph_words OR entities OR hops THEN 'graph' ELSE 'vector' END AS route FROM f"""
)
def query_router(spark: SparkSession, d: str) -> DataFrame:
    """Questions with words of relation, of several hops, or with two known names go to the graph."""
    company = read(spark, d, "documents").filter(F.col("company").isNotNull()).select("company").distinct()
    names = company.select(F.lower("company").alias("name")).union(company.select(F.lower(F.regexp_extract("company", "^[^ ]+", 0)))).union(read(spark, d, "nation").select(F.lower("n_name")))
    return K.route(_questions(spark, d).select(F.col("qid").alias("id"), "question"), names.distinct())


@query()
def rerank_udf(spark: SparkSession, d: str) -> DataFrame:
    """Candidates scored anew by a pluggable model over batches; here the overlap of character trigrams."""
    _, keyword = _lists(spark, d)
    rows = keyword.join(F.broadcast(_questions(spark, d).select("qid", "question")), "qid").join(_texts(spark, d).select("chunk_id", "content"), "chunk_id")

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def grams(t: str) -> set:
            t = (t or "").lower()
            return {t[i : i + 3] for i in range(len(t) - 2)}

        for a, b in batches:
            yield pd.Series([len(grams(x) & grams(y)) / max(1, len(grams(x))) for x, y in zip(a, b)], dtype=float)

    return K.best(rows.select("qid", "chunk_id", F.round(score("question", "content"), 6).alias("score")), "qid", "score", "chunk_id", 5)


# evaluation of what was found

ALPHAS = (0.0, 0.3, 0.5, 0.7, 1.0)


def keyword_verdict(found: DataFrame, questions: DataFrame, texts: DataFrame, normal: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, qid, expected, matched, passed): a question passes if at least half of its keywords are in the cited results.

    Questions without results fail; without keywords they pass if there are results.
    """
    form = normalize_numbers if normal else (lambda x: x)
    cited = found.join(texts.select("chunk_id", citation(F.col("content"), F.col("metadata.filename"), F.col("page_number"), F.col("chunk_index")).alias("cited")), "chunk_id")
    joined = cited.groupBy(*by, "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cited"))), lambda x: F.lower(x["cited"])), " ").alias("all"))
    rows = F.broadcast(questions.select("qid", "expected_keywords")).join(joined, "qid", "left" if not by else "inner")
    keys = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    text = form(F.col("all"))
    hit = F.coalesce(F.size(F.filter(keys, lambda k: F.contains(F.col("text"), form(F.lower(k))))), F.lit(0))
    rows = rows.withColumn("text", text)
    return rows.select(*by, "qid", F.size(keys).alias("expected"), F.when(F.col("text").isNull(), 0).otherwise(hit).alias("matched"), (F.col("text").isNotNull() & (hit >= 0.5 * F.size(keys))).alias("passed"))


_CITED = "cited AS (SELECT qid, string_agg(lower(coalesce(content, '') || chr(10) || chr(10) || '(Source: ' || metadata.filename || ', page ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ', chunk ' || chunk_index || ')'), ' ' ORDER BY rank) AS body FROM bm20 JOIN one USING (chunk_id) WHERE rank <= {k} GROUP BY qid)"


def _verdict(normal: bool, k: int = 5) -> str:
    from ledgerlens.plans.registry import normal as fix

    body, key = (fix("body"), fix("lower(k)")) if normal else ("body", "lower(k)")
    return f"""{_BM25}, {_CITED.format(k=k)}, norm AS (SELECT qid, {body} AS body FROM cited),
    keys AS (SELECT id AS qid, unnest(expected_keywords) AS k FROM questions), hits AS (SELECT qid, count_if(contains(body, {key})) AS matched FROM keys JOIN norm USING (qid) GROUP BY qid),
    verdict AS (SELECT q.id AS qid, CAST(len(expected_keywords) AS INTEGER) AS expected, CAST(coalesce(matched, 0) AS INTEGER) AS matched, n.body IS NOT NULL AND coalesce(matched, 0) >= 0.5 * len(expected_keywords) AS passed FROM questions q LEFT JOIN norm n ON n.qid = q.id LEFT JOIN hits h ON h.qid = q.id)"""


@query(f"WITH {_verdict(True)} SELECT * FROM verdict")
def retrieval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return keyword_verdict(_bm25(spark, d, 5), _questions(spark, d), _texts(spark, d))


@query(f"WITH {_verdict(False)} SELECT * FROM verdict")
def retrieval_accuracy_raw(spark: SparkSession, d: str) -> DataFrame:
    return keyword_verdict(_bm25(spark, d, 5), _questions(spark, d), _texts(spark, d), normal=False)


@query(f"WITH {_verdict(True, 1)} SELECT qid, matched >= 1 AS hit FROM verdict")
def top1_keyword_hit(spark: SparkSession, d: str) -> DataFrame:
    return keyword_verdict(_bm25(spark, d, 1), _questions(spark, d), _texts(spark, d)).select("qid", (F.col("matched") >= 1).alias("hit"))


@query(
    f"WITH {_BM25} SELECT q.id AS qid, q.expected_page_number AS expected_page, coalesce(bool_or(abs(page_number - q.expected_page_number) <= 1), false) AS passed, coalesce(bool_or(abs(page_number - q.expected_page_number) <= 1 AND metadata.filename = q.source_document), false) AS passed_in_document FROM questions q LEFT JOIN (SELECT * FROM bm20 JOIN one USING (chunk_id) WHERE rank <= 5) r ON r.qid = q.id GROUP BY ALL"
)
def attribution_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Any result within one page of the expected one; strictly also in the expected document."""
    found = _bm25(spark, d, 5).join(_texts(spark, d).select("chunk_id", "page_number", F.col("metadata.filename").alias("filename")), "chunk_id").select("qid", "page_number", "filename")
    rows = F.broadcast(_questions(spark, d)).join(found, "qid", "left")
    near = F.abs(F.col("page_number") - F.col("expected_page_number")) <= 1
    return rows.groupBy("qid", F.col("expected_page_number").alias("expected_page")).agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("passed"), F.coalesce(F.bool_or(near & (F.col("filename") == F.col("source_document"))), F.lit(False)).alias("passed_in_document"))


@query(f"WITH {_BM25}, r AS (SELECT coalesce(content, '') || chr(10) || chr(10) || '(Source: ' || metadata.filename || ', page ' || coalesce(CAST(page_number AS VARCHAR), 'N/A') || ', chunk ' || chunk_index || ')' AS text FROM bm20 JOIN one USING (chunk_id) WHERE rank <= 5) SELECT count(*) AS results, round(avg(CASE WHEN contains(text, '(Source: ') THEN 100.0 ELSE 0 END), 6) AS coverage, round(avg(CASE WHEN regexp_matches(text, '\\(Source: .+, page ([0-9]+|N/A), chunk [0-9]+\\)$') THEN 100.0 ELSE 0 END), 6) AS well_formed FROM r")
def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    cited = _bm25(spark, d, 5).join(_texts(spark, d), "chunk_id").select(citation(F.col("content"), F.col("metadata.filename"), F.col("page_number"), F.col("chunk_index")).alias("text"))
    return cited.agg(F.count("*").alias("results"), F.round(F.avg(F.when(F.contains("text", F.lit("(Source: ")), 100.0).otherwise(0.0)), 6).alias("coverage"), F.round(F.avg(F.when(F.col("text").rlike("\\(Source: .+, page ([0-9]+|N/A), chunk [0-9]+\\)$"), 100.0).otherwise(0.0)), 6).alias("well_formed"))


@query(
    f"""WITH {_SEM}, al AS (SELECT unnest({list(ALPHAS)}::DOUBLE[]) AS alpha),
    hy AS (SELECT alpha, qid, chunk_id, round(alpha * coalesce(s.score, 0) + (1 - alpha) * CASE WHEN top > 0 THEN coalesce(b.score, 0) / top ELSE 0 END, 9) AS score FROM al, (sem20 s FULL JOIN bm20 b USING (qid, chunk_id) LEFT JOIN (SELECT qid, max(score) AS top FROM bm20 GROUP BY qid) USING (qid))),
    r AS (SELECT *, row_number() OVER (PARTITION BY alpha, qid ORDER BY score DESC, chunk_id) AS rank FROM hy),
    pages AS (SELECT alpha, qid, bool_or(abs(page_number - expected_page_number) <= 1) AS ok FROM r JOIN one USING (chunk_id) JOIN questions q ON q.id = qid WHERE rank <= 5 GROUP BY ALL)
    SELECT alpha, count(*) AS questions, count_if(ok) AS passed FROM pages GROUP BY alpha"""
)
def fusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """Which weight of the semantic score finds the expected page most often."""
    semantic, keyword = _lists(spark, d)
    semantic = stored(semantic, "semantic")
    out = None
    for alpha in ALPHAS:
        top = K.best(K.weighted_fusion(semantic, keyword, alpha), "qid", "score", "chunk_id", 5).withColumn("alpha", F.lit(alpha))
        out = top if out is None else out.unionByName(top)
    rows = out.join(_texts(spark, d).select("chunk_id", "page_number"), "chunk_id").join(F.broadcast(_questions(spark, d).select("qid", "expected_page_number")), "qid")
    per = rows.groupBy("alpha", "qid").agg(F.bool_or(F.abs(F.col("page_number") - F.col("expected_page_number")) <= 1).alias("ok"))
    return per.groupBy("alpha").agg(F.count("*").alias("questions"), F.count_if("ok").alias("passed"))


K1S, BS = (1.2, 1.7, 2.0), (0.4, 0.6, 0.75)


@query(
    f"""WITH {_BM25}, gr AS (SELECT unnest({list(K1S)}::DOUBLE[]) AS k1), gb AS (SELECT unnest({list(BS)}::DOUBLE[]) AS b),
    sc AS (SELECT k1, b, qid, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))), 6) AS score FROM post JOIN dfs USING (term) JOIN qt USING (term), tot, gr, gb GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, qid ORDER BY score DESC, chunk_id) AS rank FROM sc),
    pages AS (SELECT k1, b, qid, bool_or(abs(page_number - expected_page_number) <= 1) AS ok FROM r JOIN one USING (chunk_id) JOIN questions q ON q.id = qid WHERE rank <= 5 GROUP BY ALL)
    SELECT k1, b, count(*) AS questions, count_if(ok) AS passed FROM pages GROUP BY ALL"""
)
def bm25_grid(spark: SparkSession, d: str) -> DataFrame:
    """Which k1 and b find the expected page most often: the postings are counted once for all of them."""
    scored = K.bm25_settings(_texts(spark, d).select("chunk_id", "content"), _questions(spark, d), [(k1, b) for k1 in K1S for b in BS])
    top = K.best(scored.withColumn("by", F.struct("k1", "b", "qid")), "by", "score", "chunk_id", 5).select("k1", "b", "qid", "chunk_id")
    rows = top.join(_texts(spark, d).select("chunk_id", "page_number"), "chunk_id").join(F.broadcast(_questions(spark, d).select("qid", "expected_page_number")), "qid")
    per = rows.groupBy("k1", "b", "qid").agg(F.bool_or(F.abs(F.col("page_number") - F.col("expected_page_number")) <= 1).alias("ok"))
    return per.groupBy("k1", "b").agg(F.count("*").alias("questions"), F.count_if("ok").alias("passed"))


@query(
    f"WITH {_BM25}, {{}}, keys AS (SELECT id AS qid, unnest(expected_keywords) AS k FROM questions), hit AS (SELECT DISTINCT qid, chunk_id FROM keys JOIN (SELECT * FROM bm20 JOIN one USING (chunk_id) WHERE rank <= 5) r USING (qid) WHERE contains(lower(coalesce(content, '')), lower(k))), n AS (SELECT qid, count(*) AS n FROM hit GROUP BY qid) SELECT id AS qid, coalesce(n, 0) AS results, round(coalesce(n, 0) / len(expected_keywords), 6) AS ratio FROM questions LEFT JOIN n ON qid = id WHERE len(expected_keywords) > 0".replace(", {}", "")
)
def quick_keyword_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Results that hold any keyword, over the number of keywords: quick, and no recall."""
    asked = _questions(spark, d).select("qid", "expected_keywords").filter(F.size("expected_keywords") > 0)
    found = _bm25(spark, d, 5).join(_texts(spark, d).select("chunk_id", "content"), "chunk_id").select("qid", F.lower(F.coalesce("content", F.lit(""))).alias("t"))
    rows = F.broadcast(asked).join(found, "qid", "left")
    hit = F.coalesce(F.exists("expected_keywords", lambda k: F.contains(F.col("t"), F.lower(k))), F.lit(False))
    per = rows.groupBy("qid", F.size("expected_keywords").alias("n")).agg(F.count_if(hit).alias("results"))
    return per.select("qid", "results", F.round(F.col("results") / F.col("n"), 6).alias("ratio"))
