"""Ingest files into a collection and answer questions from it with citations."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions.embedding import embed, hashing_model
from ledgerlens.functions.text import citation, word_count
from ledgerlens.operators.chunking import chunk_by_page
from ledgerlens.log import get_logger
from ledgerlens.operators.entities import co_mentions, extract
from ledgerlens.operators.retrieval import FILTERS, cosine_topk, open_collection, store_points
from ledgerlens.operators.timeseries import forecast, growth, zscores
from ledgerlens.sources.files import ELEMENTS, read_workbooks, reader_for, workbook_elements


log = get_logger(__name__)


class QueryError(ValueError):
    """A question that cannot be answered as it is put."""


@dataclass(frozen=True)
class QueryRequest:
    query: str
    top_k: int = 5
    filters: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.query or not self.query.strip():
            raise QueryError("Query cannot be empty")
        if not 1 <= self.top_k <= 50:
            raise QueryError("top_k must be between 1 and 50")
        unknown = set(self.filters) - set(FILTERS)
        if unknown:
            raise QueryError(f"unknown filters: {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class Settings:
    """Where the points are, and the sizes of chunks."""

    collection: str
    chunk_words: int = 500
    overlap_words: int = 50


class Engine:
    """``load`` makes the text model once per worker; documents and questions go through the same one."""

    def __init__(self, spark: SparkSession, settings: Settings, load: Callable[[], Callable[[list[str]], np.ndarray]] | None = None):
        self.spark, self.settings, self.load = spark, settings, load

    def ingest(self, path: str) -> dict:
        """Read a workbook into the collection. PDF needs a parser that is not part of this engine: pass its elements to ingest_elements."""
        if reader_for(path) != "excel" or path.lower().endswith(".xls"):
            raise ValueError(f"{path} has to be parsed into elements first: see ingest_elements")
        sheets = read_workbooks(self.spark, path)
        out = self.ingest_elements(workbook_elements(sheets))
        return out | {"page_count": sheets.filter("sheet_number > 0").count()}

    def ingest_elements(self, elements: DataFrame) -> dict:
        """Chunk parsed elements (filename, item_seq, text, page_no, is_table) by page, embed them and add them; a file ingested again is replaced as a whole."""
        chunks = chunk_by_page(elements, self.settings.chunk_words, self.settings.overlap_words)
        points = chunks.select(
            "chunk_id", F.col("content").alias("text"), word_count(F.col("content")).alias("word_count"), F.col("filename").alias("source_document"), "page_number", "chunk_index",
            embed(F.col("content"), self.load).alias("embedding"),
        )
        n = chunks.count()
        log.info("ingested %d chunks into %s", n, self.settings.collection)
        return {"chunk_count": n, "points": store_points(points, self.settings.collection) if n else self._count()}

    def query(self, query: str, top_k: int = 5, filters: dict | None = None) -> dict:
        """The top_k chunks of highest cosine, each with its citation, and the time it took."""
        request, began = QueryRequest(query, top_k, filters or {}), time.perf_counter()
        model = self.load() if self.load else hashing_model
        vector = model([request.query])[0]
        points = open_collection(self.spark, self.settings.collection)
        top = cosine_topk(points, list(vector), request.top_k, key="chunk_id", filters=request.filters)
        text = citation(F.col("text"), F.col("source_document"), F.col("page_number"), F.col("chunk_index"))
        rows = top.select("score", text.alias("text"), "source_document", "page_number", "chunk_index", "chunk_id", "word_count").collect()  # at most 50
        return {"query": query, "results": [r.asDict() for r in rows], "retrieval_time_ms": (time.perf_counter() - began) * 1000}

    def query_with_graph(self, query: str, names: DataFrame, top_k: int = 5, filters: dict | None = None) -> dict:
        """As query; each result with the entities it names, and of these the pairs that stand together in several chunks of the collection.

        ``names`` (kind, name) is the dictionary of entities.
        """
        found = self.query(query, top_k, filters)
        points = open_collection(self.spark, self.settings.collection).select("chunk_id", "text")
        ids = [r["chunk_id"] for r in found["results"]]
        rows = extract(points.filter(F.col("chunk_id").isin(ids)), names, text="text").collect()  # of at most 50 chunks
        own: dict[str, list[str]] = {i: sorted({r.entity for r in rows if r.chunk_id == i}) for i in ids}
        mentioned = sorted({e for x in own.values() for e in x})
        together: list = []
        if mentioned:
            known = names.filter(F.col("name").isin(mentioned))
            pairs = co_mentions(extract(points, known, text="text").filter(F.col("entity").isin(mentioned)))
            together = pairs.filter("texts > 1").orderBy(F.desc("texts"), "a", "b").limit(20 * top_k).collect()
        for r in found["results"]:
            have = own[r["chunk_id"]]
            r["graph_context"] = {"entities": have, "relationships": [f"{p.a} - {p.b} ({p.texts} chunks)" for p in together if p.a in have and p.b in have]}
        return found | {"graph_enhanced": True}

    def analyze(self, query: str, series: DataFrame, by: str, order: str, value: str, lag: int = 4, limit_ms: float = 30_000) -> dict:
        """The growth of every key's last period against ``lag`` periods before, step by step, with the chunks that bear on the question.

        Where the series cannot be worked on or it takes too long, the chunks alone (status fallback).
        """
        began, request = time.perf_counter(), QueryRequest(query)
        steps = [f"1. looked for chunks about: {request.query}"]
        sources = self.query(query)["results"]
        try:
            rows = growth(series, by, order, value, lag)
            last = rows.groupBy(by).agg(F.max_by(F.struct(order, value, "previous", "change", "growth"), order).alias("x")).select(by, "x.*").orderBy(by)
            findings = [r.asDict() for r in last.collect()]  # one row for each key of a series
            steps += [f"{i}. {f[by]}: {f[value]} in {f[order]}, {f['previous']} before, change {f['change']}" for i, f in enumerate(findings, 2)]
            status = "success" if (time.perf_counter() - began) * 1000 <= limit_ms else "fallback"
        except Exception as e:  # noqa: BLE001
            log.warning("analysis failed: %s", type(e).__name__)
            findings, status = [], "fallback"
            steps.append("2. the series could not be worked on")
        cited = [f"{r['source_document']} (page {r['page_number'] if r['page_number'] is not None else 'N/A'})" for r in sources]
        return {"query": query, "findings": findings if status == "success" else [], "reasoning_steps": steps, "sources": cited, "workflow_status": status, "execution_time_ms": (time.perf_counter() - began) * 1000}

    def forecast(self, series: DataFrame, by: str, order: str, value: str, periods: int = 4) -> dict:
        """Of each key what was and what the line through it says for the next periods, with a range of 95 %; short series have no forecast."""
        if not 1 <= periods <= 50:
            raise QueryError("periods must be between 1 and 50")
        past = [r.asDict() for r in series.select(by, order, value).orderBy(by, order).collect()]  # a series of periods
        ahead = [r.asDict() for r in forecast(series, by, order, value, periods).orderBy(by, "step").collect()]
        return {"historical_data": past, "forecast": ahead, "basis": "straight line by least squares"}

    def insights(self, series: DataFrame, by: str, order: str, value: str, limit: int = 5) -> dict:
        """The values furthest from their key's mean, the most striking first."""
        if not 1 <= limit <= 50:
            raise QueryError("limit must be between 1 and 50")
        odd = zscores(series, by, value)
        top = odd.orderBy(F.desc(F.abs("z")), by, order).limit(limit).collect()
        rows = [{"priority": i, "category": r["severity"], "summary": f"{r[by]} {r[order]}: {r[value]} against a mean of {r['mean']:.6g}", "z": r["z"]} for i, r in enumerate(top, 1)]
        return {"insights": rows, "total_insights_generated": odd.count()}

    def health(self) -> dict:
        """What works, without ever failing."""
        try:
            return {"status": "ok", "points": self._count()}
        except Exception as e:  # noqa: BLE001
            return {"status": "unavailable", "reason": type(e).__name__, "points": 0}

    def _count(self) -> int:
        return open_collection(self.spark, self.settings.collection).count()


__all__ = ["ELEMENTS", "Engine", "QueryError", "QueryRequest", "Settings"]
