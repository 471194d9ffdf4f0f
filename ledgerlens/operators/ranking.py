"""Keyword search, re-ranking and fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import words
from ledgerlens.runtime import stored

K1, B = 1.7, 0.6
#: Different words of the queries up to which each text's array is filtered by them, and those that are broadcast at most; more are joined by shuffle.
SCANNED_TERMS, BROADCAST_TERMS = 5_000, 500_000
_MARK = " "


def best(df: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    """The k rows of highest score in each group with their rank, ties by key; ranks are cut before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _postings(docs: DataFrame, queries: DataFrame, key: str, text: str, qkey: str, query: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, term, tf, df, length) of the words of queries; (n, mean) of all documents; (qkey, term)."""
    terms = queries.select(F.col(qkey), F.explode(F.array_distinct(words(F.col(query)))).alias("term"))
    terms = stored(terms, "terms")
    vocabulary = terms.select("term").distinct()
    n_terms = vocabulary.count()
    base = docs.select(key, F.coalesce(words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    base = base.select(key, F.size("w").alias("length"), "w")
    if n_terms <= SCANNED_TERMS:  # the words of queries are picked out of each text's array
        known = [r[0] for r in vocabulary.collect()]
        base = base.select(key, "length", F.filter("w", lambda x: x.isin(known)).alias("w"))
    # one pass over the texts: a mark that is no word stands once in every document, for how many there are and how long
    kept = base.select(key, "length", F.explode(F.concat("w", F.array(F.lit(_MARK)))).alias("term"))
    if n_terms > SCANNED_TERMS:
        vocabulary = vocabulary.unionByName(queries.sparkSession.createDataFrame([(_MARK,)], "term string"))
        kept = kept.join(F.broadcast(vocabulary) if n_terms <= BROADCAST_TERMS else vocabulary, "term", "left_semi")
    tf = stored(kept.groupBy(key, "length", "term").agg(F.count("*").alias("tf")), "postings")
    totals = tf.filter(F.col("term") == _MARK).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    tf = tf.filter(F.col("term") != _MARK)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each word of the queries
    # words that many documents hold stay where they are, unless the queries have too many words
    small = terms.count() <= BROADCAST_TERMS
    return tf.join(F.broadcast(df) if small else df, "term"), totals, F.broadcast(terms) if small else terms


def _weight(k1, b):
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "chunk_id", text: str = "content", qkey: str = "qid", query: str = "question", k1: float = K1, b: float = B) -> DataFrame:
    """(qkey, key, score): Okapi BM25 over white-space words as they are, with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    Only words of the queries are counted: they filter the postings before anything is shuffled. Documents without words
    count in N with length 0. Repeated words of a query count once.
    """
    tf, totals, terms = _postings(docs, queries, key, text, qkey, query)
    weighted = tf.crossJoin(F.broadcast(totals)).select(key, "term", _weight(k1, b).alias("w"))
    return weighted.join(terms, "term").groupBy(qkey, key).agg(F.round(F.sum("w"), 6).alias("score"))


def bm25_settings(docs: DataFrame, queries: DataFrame, settings: list[tuple[float, float]], key: str = "chunk_id", text: str = "content", qkey: str = "qid", query: str = "question") -> DataFrame:
    """(k1, b, qkey, key, score) for each of a few settings of k1 and b, from one count of the postings."""
    tf, totals, terms = _postings(docs, queries, key, text, qkey, query)
    each = F.explode(F.array(*[F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for k1, b in settings])).alias("s")
    rows = tf.crossJoin(F.broadcast(totals)).select("*", each).select(key, "term", "s.k1", "s.b", _weight(F.col("s.k1"), F.col("s.b")).alias("w"))
    return rows.join(terms, "term").groupBy("k1", "b", qkey, key).agg(F.round(F.sum("w"), 6).alias("score"))


def expanded_search(docs: DataFrame, queries: DataFrame, synonyms: DataFrame, k: int = 5, candidates: int = 10) -> DataFrame:
    """(qid, key, score, rank): queries (qid int, question) and their variations with one word replaced, fused by rank.

    ``synonyms`` (word, other) is a table of the user's. Variations are numbered by word and other.
    """
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("word", "other"))
    more = queries.join(synonyms.dropDuplicates(["word", "other"]), F.array_contains(words(F.col("question")), F.col("word")))
    more = more.select("qid", nth.alias("nth"), F.expr("replace(question, word, other)").alias("question"))
    every = stored(queries.select("qid", F.lit(0).alias("nth"), "question").unionByName(more).select(F.struct("qid", "nth").alias("qid"), "question"), "variations")
    ranked = best(bm25(docs, every), "qid", "score", "chunk_id", candidates)
    return best(reciprocal_ranks([ranked.withColumn("qid", F.col("qid.qid"))]), "qid", "score", "chunk_id", k)


#: Words of questions about relations, and about several steps.
RELATION, STEPS = "(correlat|relat|connect|depend|between|together)", "(through|via|leads to|because of|caused)"


def route(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(id, route): graph for questions with words of relation or of several steps, or with two of the names; else vector.

    ``names`` (name, in lower case, one word) is a table of the user's.
    """
    low = F.lower("question")
    parts = F.transform(words(low), lambda x: F.trim(x, F.lit('.,;:!?"()')))
    hits = questions.select("id", F.explode(F.array_distinct(parts)).alias("name")).join(names.select("name").distinct(), "name").groupBy("id").agg(F.count("*").alias("n"))
    rows = questions.join(hits, "id", "left")
    return rows.select("id", F.when(low.rlike(RELATION) | low.rlike(STEPS) | (F.coalesce("n", F.lit(0)) >= 2), "graph").otherwise("vector").alias("route"))


def weighted_fusion(semantic: DataFrame, keyword: DataFrame, alpha: float = 0.7, by: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(by, key, score): alpha * semantic + (1 - alpha) * keyword / highest keyword score of the query; absent is 0."""
    a = semantic.select(by, key, F.col("score").alias("s"))
    b = keyword.select(by, key, F.col("score").alias("b"))
    top = keyword.groupBy(by).agg(F.max("score").alias("top"))
    both = a.join(b, [by, key], "full").join(top, by, "left")
    scaled = F.when(F.col("top") > 0, F.coalesce("b", F.lit(0.0)) / F.col("top")).otherwise(0.0)
    return both.select(by, key, F.round(alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * scaled, 9).alias("score"))


def reciprocal_ranks(lists: list[DataFrame], constant: int = 60, by: str = "qid", key: str = "chunk_id") -> DataFrame:
    """(by, key, score): the sum of 1 / (constant + rank) over the lists that hold the key."""
    out = lists[0].select(by, key, "rank")
    for x in lists[1:]:
        out = out.unionByName(x.select(by, key, "rank"))
    return out.groupBy(by, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))


def highest_score(lists: list[DataFrame], by: str = "qid", key: str = "chunk_id") -> DataFrame:
    out = lists[0].select(by, key, "score")
    for x in lists[1:]:
        out = out.unionByName(x.select(by, key, "score"))
    return out.groupBy(by, key).agg(F.max("score").alias("score"))
