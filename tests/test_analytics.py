import io
import zipfile

import numpy as np
import pytest

from ledgerlens.functions.embedding import hashing_model
from ledgerlens.operators import graph as G
from ledgerlens.operators import timeseries as S
from ledgerlens.sources import files


def test_growth_and_anomalies(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([10, 20, 0, 5])] + [("c", i, 3.0) for i in range(3)], "k string, t int, v double")
    g = {(r.k, r.t): (r.change, r.growth) for r in S.growth(df, "k", "t", "v", 1).collect()}
    assert g["a", 0] == (None, None) and g["a", 1] == (10.0, 100.0) and g["a", 3] == (5.0, None)
    wild = spark.createDataFrame([("a", i, 1.0) for i in range(20)] + [("a", 20, 100.0), ("c", 0, 3.0), ("c", 1, 3.0)], "k string, t int, v double")
    assert [(r.t, r.severity) for r in S.zscores(wild, "k", "v").collect()] == [(20, "critical")]
    assert [r.t for r in S.outside_quartiles(wild, "k", "v").collect()] == [20]


def test_forecast_of_a_line(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + 1) for i in range(10)] + [("short", float(i), 1.0) for i in range(7)], "k string, t double, v double")
    rows = sorted(S.forecast(df, "k", "t", "v").collect(), key=lambda r: r.step)
    assert {r.k for r in rows} == {"a"} and [round(r.forecast, 6) for r in rows] == [21.0, 23.0, 25.0, 27.0] and abs(rows[0].high - rows[0].low) < 1e-4


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("x", None)], "src string, dst string")
    hops = {(r.node, r.hops) for r in G.hops(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert hops == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    parts = {r.node: r.component for r in G.components(edges).collect()}
    assert parts == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}
    assert G.components(edges.limit(0)).count() == 0


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="Revenue" sheetId="1" r:id="r1"/><sheet name="Empty" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Quarter</t></si><si><t>Q1</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Cost</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    rows = {r.filename: r for r in files.read_workbooks(spark, str(tmp_path)).collect()}
    assert rows["a.xlsx"].content == "## Sheet 1: Revenue\n| Quarter |  | Cost |\n|---|---|---|\n| Q1 |  | 2 |" and rows["a.xlsx"].row_count == 1
    assert rows["broken.xlsx"].sheet_number == 0
    assert files.workbook_elements(files.read_workbooks(spark, str(tmp_path))).count() == 1


def test_dispatch(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.reader_for(str(tmp_path / "missing.txt"))
    (tmp_path / "a.TXT").write_text("x")
    (tmp_path / "b.XLSX").write_bytes(b"")
    with pytest.raises(ValueError):
        files.reader_for(str(tmp_path / "a.TXT"))
    assert files.reader_for(str(tmp_path / "b.XLSX")) == "excel"


def test_json_lines(spark, tmp_path):
    path = tmp_path / "log"
    assert files.read_json_lines(spark, str(path)).count() == 0
    rows = spark.createDataFrame([("2024-01-02", 5, 1.0), ("2024-01-01", 3, 2.0)], "timestamp string, subset_size int, retrieval_accuracy double")
    files.append_json_lines(rows, str(path))
    files.append_json_lines(rows.limit(1), str(path))
    (path / "more.json").write_text('\n{"timestamp": "2023-12-31"}\nbroken\n')
    assert [r.timestamp for r in files.read_json_lines(spark, str(path)).collect()] == ["2023-12-31", "2024-01-01", "2024-01-02", "2024-01-02"]
    assert [r.line for r in files.broken_json_lines(spark, str(path)).collect()] == ["broken"]
    assert files.broken_json_lines(spark, str(tmp_path / "none")).count() == 0


def test_hashing_model():
    a, b, blank = hashing_model(["net debt", "net debt", " "])
    assert (a == b).all() and abs((a * a).sum() - 1) < 1e-6 and not blank.any()


def test_reports(spark, tmp_path):
    from ledgerlens.sources import reports

    metrics = spark.createDataFrame([(3, None)], "total int, errors int")
    groups = spark.createDataFrame([("b", 2), ("a", None)], "category string, n int")
    assert reports.markdown_report("Run", metrics, groups) == "# Run\n\n| metric | value |\n|-|-|\n| total | 3 |\n| errors |  |\n\n| category | n |\n|-|-|\n| a |  |\n| b | 2 |\n"
    assert reports.markdown_report("Run", metrics, groups, limit=1).endswith("1 more rows\n")
    reports.write_results(groups, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_forecast_by_any_model(spark):
    df = spark.createDataFrame([("a", float(i), float(i)) for i in range(8)] + [("short", 1.0, 1.0), ("short", 2.0, None)], "k string, t double, v double")
    got = [tuple(r) for r in S.forecast_with(df, "k", "t", "v", lambda x, y, n: [y[-1]] * n, periods=2).collect()]
    assert sorted(got) == [("a", 1, 7.0), ("a", 2, 7.0)]


def test_written_workbooks_are_read(spark, tmp_path):
    files.write_workbook(str(tmp_path / "w.xlsx"), [("A & B", [["x", "y"], [1, "<&>"], [None, " 2 "]]), ("none", [])])
    rows = files.read_workbooks(spark, str(tmp_path)).collect()
    assert [(r.sheet_number, r.content) for r in rows] == [(1, "## Sheet 1: A & B\n| x | y |\n|---|---|\n| 1 | <&> |\n|  |  2  |")]


def test_entities_of_dictionaries_and_forms(spark, monkeypatch):
    from ledgerlens.operators import entities as E

    texts = spark.createDataFrame([("a", "Net  Debt of (Orrivik Lime), Q3 FY24: 12.5 M EUR; Third Quarter 2024"), ("b", None), ("c", ""), (None, "net debt"), ("d", "debt net lime")], "chunk_id string, content string")
    names = spark.createDataFrame([("metric", "net debt"), ("company", "Orrivik Lime"), ("company", None), ("company", " ")], "kind string, name string")
    got = {tuple(r) for r in E.extract(texts, names).collect()}
    assert got == {("a", "metric", "net debt"), ("a", "company", "Orrivik Lime"), ("a", "period", "Q3 FY24"), ("a", "period", "Third Quarter 2024"), ("a", "amount", "12.5 M EUR")}
    for bound in ("SCANNED_NAMES", "BROADCAST_NAMES"):
        monkeypatch.setattr(E, bound, 0)
        assert {tuple(r) for r in E.extract(texts, names).collect()} == got
    assert {tuple(r) for r in E.extract(texts, names.limit(0)).collect()} == {x for x in got if x[1] in E.PATTERNS}
    assert [tuple(r) for r in E.co_mentions(E.extract(texts, names)).filter("a = 'Orrivik Lime'").collect()]


def test_periods_spelt_out(spark):
    from pyspark.sql import functions as F

    from ledgerlens.functions.text import fiscal_period

    forms = {"Q3 FY24": "2024-Q3", "Q3 2024": "2024-Q3", "Q3 FY2024": "2024-Q3", "Third Quarter 2024": "2024-Q3", "third quarter of FY2024": "2024-Q3", "H1 2026": "2026-H1", "May-21": "2021-05", "2021-05": "2021-05", "Fifth Quarter 2024": None}
    rows = spark.createDataFrame([(k,) for k in forms], "p string").select("p", fiscal_period(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == forms


def test_correlation_and_how_likely(spark):
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 6, 5])] + [(1.0, None)], "a double, b double")
    r = S.correlation(df, "a", "b").first()
    assert (round(r.correlation, 4), r.n) == (round(np.corrcoef(range(7), [1, 3, 2, 5, 4, 6, 5])[0, 1], 4), 7) and 0.005 < r.p_value < 0.02
    assert abs(S.student_tail(2.228, 10) - 0.05) < 1e-4 and abs(S.student_tail(1.0, 1) - 0.5) < 1e-9 and S.student_tail(0.0, 5) == 1.0
    assert S.correlation(df.limit(2), "a", "b").first().p_value is None


def test_tables_are_released(spark):
    from ledgerlens import runtime

    df = runtime.stored(spark.range(3), "mine")
    path = runtime._MADE[-1][1]
    at, fs = runtime.filesystem(spark, path)
    assert df.count() == 3 and fs.exists(at)
    assert runtime.release(spark) >= 1 and not fs.exists(at) and runtime.release(spark) == 0
