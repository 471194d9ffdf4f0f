import pytest
from test_analytics import workbook

from ledgerlens.engine import ELEMENTS, Engine, QueryError, Settings


def test_ingest_and_query(spark, tmp_path):
    (tmp_path / "book.xlsx").write_bytes(workbook())
    engine = Engine(spark, Settings(str(tmp_path / "points")))
    assert engine.health()["status"] == "unavailable"
    assert engine.ingest(str(tmp_path / "book.xlsx")) == {"chunk_count": 1, "points": 1, "page_count": 1}
    rows = [("a.pdf", 0, "net debt rose in the north", 3, False), ("a.pdf", 1, "headcount stayed flat", 4, False), ("b.pdf", 0, "net debt fell", None, False)]
    assert engine.ingest_elements(spark.createDataFrame(rows, ELEMENTS))["points"] == 4
    assert engine.ingest_elements(spark.createDataFrame(rows, ELEMENTS))["points"] == 4  # nothing doubles
    got = engine.query("net debt rose in the north", top_k=2)
    assert got["results"][0]["text"] == "net debt rose in the north\n\n(Source: a.pdf, page 3, chunk 0)" and got["results"][0]["score"] == 1.0 and len(got["results"]) == 2
    assert [r["chunk_id"] for r in engine.query("net debt", filters={"source_document": "b.pdf"})["results"]] == ["b.pdf_0"]
    assert engine.health() == {"status": "ok", "points": 4}


@pytest.mark.parametrize("args", [("",), (" \n",), ("x", 0), ("x", 51), ("x", 5, {"colour": 1})])
def test_bad_questions(spark, tmp_path, args):
    with pytest.raises(QueryError):
        Engine(spark, Settings(str(tmp_path))).query(*args)


def test_graph_analysis_forecast_and_insights(spark, tmp_path):
    engine = Engine(spark, Settings(str(tmp_path / "points")))
    rows = [(f"{k}.pdf", i, f"net debt of Orrivik Lime rose in part {i}", 3, False) for k in "ab" for i in range(2)]
    engine.ingest_elements(spark.createDataFrame(rows, ELEMENTS))
    names = spark.createDataFrame([("metric", "net debt"), ("company", "Orrivik Lime"), ("metric", "rent")], "kind string, name string")
    got = engine.query_with_graph("net debt", names, top_k=1)
    assert got["graph_enhanced"] and got["results"][0]["graph_context"] == {"entities": ["Orrivik Lime", "net debt"], "relationships": ["Orrivik Lime - net debt (2 chunks)"]}
    series = spark.createDataFrame([("rent", i, 10.0 + i) for i in range(12)] + [("short", 0, 1.0)], "key string, quarter int, value double")
    analysis = engine.analyze("how did rent grow", series, "key", "quarter", "value")
    assert analysis["workflow_status"] == "success" and {f["key"]: f["change"] for f in analysis["findings"]} == {"rent": 4.0, "short": None} and analysis["sources"]
    assert engine.analyze("rent", series.drop("value"), "key", "quarter", "value")["workflow_status"] == "fallback"
    ahead = engine.forecast(series, "key", "quarter", "value", 2)
    assert [round(r["forecast"], 6) for r in ahead["forecast"]] == [22.0, 23.0] and len(ahead["historical_data"]) == 13
    odd = series.union(spark.createDataFrame([("rent", 12, 900.0)], series.schema))
    assert engine.insights(odd, "key", "quarter", "value")["insights"][0]["summary"].startswith("rent 12")
    for bad in (lambda: engine.forecast(series, "key", "quarter", "value", 0), lambda: engine.insights(series, "key", "quarter", "value", 0)):
        with pytest.raises(QueryError):
            bad()


def test_models_are_made_once_in_a_worker():
    from ledgerlens.functions import embedding

    made = []

    def load():
        made.append(1)
        return lambda texts: [[0.0]] * len(texts)

    assert embedding.model_of("a", load) is embedding.model_of("a", load) and len(made) == 1
    embedding.model_of("b", load)
    assert len(made) == 2 and list(embedding._MODELS) == ["b"]
