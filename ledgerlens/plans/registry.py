"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def narrow_counts(sql: str) -> str:
    """count_if(x) as count(*) FILTER (WHERE x): the same number as a BIGINT, which count_if isn't in DuckDB."""
    out, rest = "", sql
    while "count_if(" in rest:
        before, rest = rest.split("count_if(", 1)
        depth, i = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[i], 0)
            i += 1
        out += f"{before}count(*) FILTER (WHERE {narrow_counts(rest[: i - 1])})"
        rest = rest[i:]
    return out + rest


def query(sql: str | None = None, name: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame under its function's name or the one given, with its SQL if SQL can state it."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = narrow_counts(sql)
        return f

    return keep


#: Pieces of SQL that several queries share.
WHITE = "\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{WHITE}]+')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{WHITE}]+|[{WHITE}]+$', '', 'g')"


def normal(text: str) -> str:
    """Numbers in one form; a following letter is looked for by hand, since RE2 has no lookahead."""
    one = f"regexp_replace({text}, '([0-9]+),([0-9]{{1,2}})([^\\p{{L}}0-9_]|$)', '\\1.\\2\\3', 'g')"
    two = f"regexp_replace({one}, '([0-9])[{WHITE}]+([0-9]{{3}})', '\\1\\2', 'g')"
    return f"regexp_replace({two}, '([0-9]+),([0-9]{{3}})', '\\1\\2', 'g')"


ONE = "one AS (SELECT chunk_id, any_value(content) AS content, any_value(metadata) AS metadata, any_value(page_number) AS page_number, any_value(chunk_index) AS chunk_index, any_value(embedding) AS embedding FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
POINTS = f"{ONE}, points AS (SELECT chunk_id, content AS text, CAST(coalesce(len({words('content')}), 0) AS INTEGER) AS word_count, metadata.filename AS source_document, page_number, chunk_index, embedding FROM one WHERE len(embedding) > 0)"
EVAL = "er AS (SELECT DISTINCT * FROM eval_results)"
LOG = "log AS (SELECT DISTINCT * FROM tracking_log)"
ELEMENTS = "el AS (SELECT DISTINCT filename, item_seq, text, page_no, is_table FROM elements WHERE filename IS NOT NULL AND item_seq IS NOT NULL), filled AS (SELECT *, coalesce(last_value(page_no IGNORE NULLS) OVER (PARTITION BY filename ORDER BY item_seq ROWS UNBOUNDED PRECEDING), 1) AS page FROM el)"
