"""The pN_ queries over whole tables, with production parameters, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.knn import nearest
from ledgerlens.llm.lines import repeated_lines, without_lines
from ledgerlens.llm.mixing import mix_sources, reached_shares
from ledgerlens.llm.neardup import NearDuplicates
from ledgerlens.llm.packing import fill_report, pack
from ledgerlens.llm.quality import text_quality, text_statistics
from ledgerlens.llm.split import split_oversized
from ledgerlens.llm.tokens import token_counts
from ledgerlens.llm.truncation import truncated, truncation_by_source
from ledgerlens.runtime import WORD, read, stored


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "chunks"))


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces say put together again: of each cut chunk its words, by their hash, and whether every piece keeps to the limits."""
    pieces = p1_pieces(spark, d).withColumn("w", F.regexp_extract_all("content", F.lit(f"({WORD})"), 1))
    own = F.when(F.col("piece_index") == 0, F.col("w")).otherwise(F.slice("w", 51, F.greatest(F.size("w") - 50, F.lit(0))))
    follows = Window.partitionBy("chunk_id").orderBy("piece_index")
    shared = F.slice("w", 1, 50) == F.slice(F.lag("w").over(follows), -50, 50)
    rows = pieces.withColumn("ok", (F.size("w") <= 500) & F.coalesce(shared, F.lit(True))).withColumn("own", own)
    whole = rows.groupBy("chunk_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_index", "own"))), lambda x: x["own"])).alias("all"), F.bool_and("ok").alias("limits_kept"))
    return whole.select("chunk_id", F.size("all").alias("n_words"), F.md5(F.array_join("all", " ")).alias("words_md5"), "limits_kept")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(read(spark, d, "chunks")).select("chunk_id").distinct()


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every chunk whose index is divisible by 100, against all rows, exact."""
    chunks = read(spark, d, "chunks")
    near = nearest(chunks, k=5, queries=chunks.filter(F.col("chunk_index") % 100 == 0), probes=None)
    return near.withColumn("cosine", F.round("cosine", 4))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = nearest(read(spark, d, "chunks"), k=5, min_cosine=0.90).filter(F.col("cosine") >= 0.90)
    return near.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    out = text_statistics(read(spark, d, "chunks"), read(spark, d, "common_words"))
    return out.select("chunk_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_share", "punctuated_lines", "common_words")])


def p3_quality(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(read(spark, d, "chunks"), read(spark, d, "common_words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_quality(spark, d).filter(F.col("kind") != "prose").select("chunk_id")


def _near_duplicates(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(read(spark, d, "chunks"), size=3, threshold=0.60, min_members=40)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _near_duplicates(spark, d).pairs()


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The classes of p4_found: every chunk beside the first one with the same set."""
    return _near_duplicates(spark, d).membership()


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(read(spark, d, "chunks")).groups()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(read(spark, d, "chunks"))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "chunks")
    return without_lines(chunks, stored(repeated_lines(chunks), "located"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = stored(token_counts(read(spark, d, "documents")), "tokens")
    return pack(sizes, read(spark, d, "context_windows"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """Per window the documents that are placed, and how many containers hold too much and documents are split without need."""
    windows = read(spark, d, "context_windows").select("window_id", "capacity_tokens").distinct()
    placed = stored(p6_containers(spark, d), "containers").filter(F.col("container_id").isNotNull()).join(F.broadcast(windows), "window_id")
    boxes = placed.groupBy("window_id", "container_id", "capacity_tokens").agg(F.sum("tokens").alias("t")).groupBy("window_id").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    docs = placed.groupBy("window_id", "doc_id", "capacity_tokens").agg(F.sum("tokens").alias("t"), F.count("*").alias("parts"))
    docs = docs.groupBy("window_id").agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("capacity_tokens"))).alias("split_without_need"))
    return docs.join(boxes, "window_id").select("window_id", "documents", "overfull", "split_without_need")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_containers(spark, d), read(spark, d, "context_windows"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    sizes = stored(token_counts(read(spark, d, "documents"), keep=("source",)), "tokens")
    return mix_sources(sizes, read(spark, d, "source_mix"))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Per mix how many documents are used too often, twice under one number, or for a source that is not theirs."""
    caps = read(spark, d, "source_mix").groupBy("mix_id", "source").agg(F.min("max_repeats").alias("cap"))
    drawn = stored(p7_selection(spark, d), "selection")
    per = drawn.groupBy("mix_id", "source", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("repeat_no").alias("numbers"))
    per = per.join(F.broadcast(caps), ["mix_id", "source"]).join(read(spark, d, "documents").select("doc_id", F.col("source").alias("own")), "doc_id")
    return per.groupBy("mix_id").agg(F.count_if(F.col("n") > F.col("cap")).alias("overused"), F.count_if(F.col("n") > F.col("numbers")).alias("doubled"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("strays"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(stored(p7_selection(spark, d), "selection"), read(spark, d, "source_mix"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated(read(spark, d, "documents")).filter("is_cut").select("doc_id")


def p8_by_source(spark: SparkSession, d: str) -> DataFrame:
    documents = read(spark, d, "documents")
    return truncation_by_source(documents, truncated(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_nearest, p3_found, p3_quality, p3_statistics, p4_found, p4_groups, p4_members, p5_found, p5_cleaned, p6_containers, p6_check, p6_fill, p7_selection, p7_check, p7_shares, p8_found, p8_by_source)
}

_WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_ONE = "one AS (SELECT chunk_id, any_value(content) AS content, any_value(metadata.filename) AS filename, any_value(embedding) AS embedding, any_value(chunk_index) AS chunk_index FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"

_UNIT = f"""{_ONE}, used AS (SELECT chunk_id, chunk_index, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM one WHERE len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        unit AS (SELECT chunk_id, chunk_index, len(v) AS d, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM used)"""

_REPEATED = f"""lines AS (SELECT chunk_id, filename, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, unnest(string_split(content, chr(10))) AS line
                  FROM one WHERE filename IS NOT NULL),
        forms AS (SELECT chunk_id, filename, line_no,
                         lower(trim(regexp_replace(translate(line, '0123456789', ''), '[ \\t\\r\\x{{a0}}]+', ' ', 'g'), ' ')) AS form FROM lines),
        lettered AS (SELECT * FROM forms WHERE regexp_matches(form, '\\p{{L}}')),
        totals AS (SELECT filename, count(*) AS total FROM one GROUP BY filename),
        counts AS (SELECT filename, form, count(DISTINCT chunk_id) AS n FROM lettered GROUP BY filename, form),
        found AS (SELECT chunk_id, CAST(line_no AS INTEGER) AS line_no
        FROM lettered JOIN counts USING (filename, form) JOIN totals USING (filename) WHERE n >= 5 AND n >= 0.2 * total)"""

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_ONE} SELECT chunk_id FROM one WHERE len(regexp_extract_all(content, '[^{_WHITE}]+')) > 500",
    "p1_rebuilt": f"WITH {_ONE}, w AS (SELECT chunk_id, regexp_extract_all(content, '[^{_WHITE}]+') AS w FROM one) SELECT chunk_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS words_md5, true AS limits_kept FROM w WHERE len(w) > 500",
    "p5_found": f"WITH {_ONE}, {_REPEATED} SELECT chunk_id, line_no FROM found",
    "p5_cleaned": f"""
        WITH {_ONE}, {_REPEATED},
        kept AS (SELECT l.chunk_id, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE f.line_no IS NULL) AS text, count(f.line_no) AS n FROM lines l LEFT JOIN found f ON f.chunk_id = l.chunk_id AND f.line_no = l.line_no GROUP BY l.chunk_id)
        SELECT chunk_id, CASE WHEN coalesce(n, 0) = 0 THEN content ELSE coalesce(text, '') END AS content, CAST(coalesce(n, 0) AS INTEGER) AS n_removed FROM one LEFT JOIN kept USING (chunk_id)""",
    "p6_check": "SELECT window_id, count(*) AS documents, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS split_without_need FROM (SELECT DISTINCT window_id FROM context_windows WHERE capacity_tokens > 0) w, documents WHERE length(text) > 0 GROUP BY window_id",
    "p7_check": "SELECT DISTINCT mix_id, CAST(0 AS BIGINT) AS overused, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS strays FROM source_mix m WHERE target_share > 0 AND coalesce(max_repeats, 1) > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = m.source AND length(text) > 0)",
    "p2_found": f"""
        WITH {_UNIT},
        near AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.u, b.u) AS cosine FROM unit a JOIN unit b ON a.d = b.d AND a.chunk_id <> b.chunk_id WHERE list_dot_product(a.u, b.u) >= 0.90),
        best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS nth FROM near)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM best WHERE nth <= 5""",
    "p2_nearest": f"""
        WITH {_UNIT}, near AS (SELECT a.chunk_id AS id, b.chunk_id AS neighbour, round(list_dot_product(a.u, b.u), 9) AS cosine FROM unit a JOIN unit b ON a.d = b.d AND a.chunk_id <> b.chunk_id WHERE a.chunk_index % 100 = 0),
        best AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY cosine DESC, neighbour) AS INTEGER) AS rank FROM near)
        SELECT id, neighbour, round(cosine, 4) AS cosine, rank FROM best WHERE rank <= 5""",
    "p3_statistics": f"""
        WITH {_ONE}, w AS (SELECT chunk_id, content, regexp_extract_all(content, '[^{_WHITE}]+') AS w FROM one WHERE content IS NOT NULL),
        each AS (SELECT chunk_id, unnest(w) AS word FROM w),
        c AS (SELECT chunk_id, lang, count(*) AS n FROM each JOIN (SELECT DISTINCT coalesce(lang, '') AS lang, lower(word) AS common FROM common_words WHERE word IS NOT NULL) ON lower(trim(word, '.,;:!?"''()[]|')) = common GROUP BY ALL),
        most AS (SELECT chunk_id, max(n) AS n FROM c GROUP BY chunk_id),
        l AS (SELECT chunk_id, list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '[^{_WHITE}]')) AS ls FROM w),
        s AS (SELECT chunk_id, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars, list_sum(list_transform(w, lambda x: length(regexp_replace(x, '[\\p{{L}}\\p{{N}}_]', '', 'g')))) AS symbols FROM w)
        SELECT chunk_id, CAST(s.n AS INTEGER) AS n_words, round(CASE WHEN s.n > 0 THEN chars / s.n ELSE 0 END, 6) AS mean_word_length, round(CASE WHEN s.n > 0 THEN symbols / chars ELSE 0 END, 6) AS symbol_share,
        round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(x, '[.!?…]["''”’»)\\]]*[{_WHITE}]*$'))) / len(ls) ELSE 0 END, 6) AS punctuated_lines, round(CASE WHEN s.n > 0 THEN coalesce(most.n, 0) / s.n ELSE 0 END, 6) AS common_words
        FROM s JOIN l USING (chunk_id) LEFT JOIN most USING (chunk_id)""",
    "p4_found": f"""
        WITH {_ONE}, w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[^{_WHITE}]+') AS w FROM one),
        s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 42),
        n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id HAVING count(*) >= 40), k AS (SELECT s.chunk_id, s.s, n.n FROM s JOIN n USING (chunk_id)),
        p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS m
              FROM k a JOIN k b ON a.s = b.s AND a.chunk_id < b.chunk_id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY 1, 2)
        SELECT a AS chunk_id_a, b AS chunk_id_b FROM p WHERE m / (na + nb - m) >= 0.6""",
    "p4_groups": f"""
        WITH RECURSIVE {_ONE}, w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[^{_WHITE}]+') AS w FROM one),
        s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))) AS s FROM w WHERE len(w) >= 5),
        m AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY s) AS rep, s FROM s),
        k AS (SELECT chunk_id AS rep, unnest(s) AS s, len(s) AS n FROM m WHERE chunk_id = rep),
        rare AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY s) AS df FROM k) QUALIFY row_number() OVER (PARTITION BY rep ORDER BY df, s) <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
        c AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.s = b.s AND a.rep < b.rep),
        l AS (SELECT a, b FROM c JOIN m x ON x.chunk_id = a JOIN m y ON y.chunk_id = b WHERE len(list_intersect(x.s, y.s)) >= 0.8 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        walk AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM walk w JOIN e ON e.a = w.seen),
        g AS (SELECT node, min(seen) AS label FROM walk GROUP BY node), n AS (SELECT a AS node, count(*) AS n FROM e GROUP BY a)
        SELECT chunk_id, coalesce(label, rep) AS group_id, coalesce(n, 0) AS n_links FROM m LEFT JOIN g ON g.node = rep LEFT JOIN n ON n.node = rep""",
    "p4_members": f"""
        WITH {_ONE}, w AS (SELECT chunk_id, regexp_extract_all(lower(content), '[^{_WHITE}]+') AS w FROM one),
        s AS (SELECT chunk_id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w WHERE len(w) >= 42)
        SELECT chunk_id, min(chunk_id) OVER (PARTITION BY s) AS rep FROM s WHERE len(s) >= 40""",
}
