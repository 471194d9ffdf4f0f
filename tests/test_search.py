import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ranking as K
from ledgerlens.operators import retrieval as R
from ledgerlens.operators.statistics import order_statistics


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_topk_edges(spark):
    nan = float("nan")
    df = vectors(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, []), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 0.0, 0.0])])
    got = [(r.vec_id, r.score) for r in R.cosine_topk(df, [1.0, 0.0], k=50).collect()]
    assert got == [(1, 1.0), (2, 1.0), (8, round(math.sqrt(0.5), 6)), (3, -1.0)]
    for k in (0, 51):
        with pytest.raises(ValueError):
            R.cosine_topk(df, [1.0, 0.0], k=k)
    with pytest.raises(ValueError):
        R.cosine_topk(df, [1.0, 0.0], filters={"colour": "red"})
    assert R.cosine_topk(df.limit(0), [1.0, 0.0]).count() == 0


def test_batch_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8)).round(1)
    v[50] = v[10]
    df = vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)])
    got = {}
    for r in R.batch_topk(df, df.filter("vec_id % 5 = 0"), k=4).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id, r.score))
    f = v.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for q in range(0, 120, 5):
        best = sorted((-s[q, i], i) for i in range(120) if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, i, -m) for k, (m, i) in enumerate(best)]


def test_points_are_replaced_not_doubled(spark, tmp_path):
    path = str(tmp_path / "points")
    a = spark.createDataFrame([("c1", 1), ("c2", 2)], "chunk_id string, n int")
    assert R.store_points(a, path) == 2
    assert R.store_points(spark.createDataFrame([("c2", 9), ("c3", 3)], "chunk_id string, n int"), path) == 3
    assert sorted(tuple(r) for r in R.open_collection(spark, path).collect()) == [("c1", 1), ("c2", 9), ("c3", 3)]
    with pytest.raises(ValueError):
        R.store_points(spark.createDataFrame([("c", "d", 1)], "chunk_id string, source_document string, n int"), path)
    assert R.store_points(a.limit(0), path) == 3


DOCS = "chunk_id string, source_document string, n int"


def test_a_shorter_version_leaves_nothing_of_the_longer_one(spark, tmp_path):
    path = str(tmp_path / "points")
    R.store_points(spark.createDataFrame([(f"{d}_{i}", d, 1) for d in ("a", "b", "c") for i in range(4)], DOCS), path)
    assert R.store_points(spark.createDataFrame([("b_0", "b", 2), ("b_1", "b", 2)], DOCS), path) == 10
    assert {r.chunk_id for r in R.open_collection(spark, path).filter("source_document = 'b'").collect()} == {"b_0", "b_1"}
    for n in range(5):  # old versions are removed, all but one
        R.store_points(spark.createDataFrame([("d_0", "d", n)], DOCS), path)
    assert len(list((tmp_path / "points" / "_manifest").glob("[0-9]*"))) == 2
    assert R.open_collection(spark, path).count() == 11


def test_a_failed_swap_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "points")
    R.store_points(spark.createDataFrame([("a_0", "a", 1)], DOCS), path)
    reader = R.open_collection(spark, path)

    def fails(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(R, "_publish", fails)
        with pytest.raises(OSError):
            R.store_points(spark.createDataFrame([("a_0", "a", 2)], DOCS), path)
    assert [tuple(r) for r in R.open_collection(spark, path).collect()] == [("a_0", "a", 1)]
    with pytest.raises(OSError):  # of two writers of one version the second fails
        R._publish(spark, path, 1, {"parts": {}})
    R.store_points(spark.createDataFrame([("a_0", "a", 3)], DOCS), path)
    assert [r.n for r in reader.collect()] == [1] and [r.n for r in R.open_collection(spark, path).collect()] == [3]
    with pytest.raises(ValueError):
        R.delete_collection(spark, path)
    assert R.delete_collection(spark, path, really=True) and not R.delete_collection(spark, path, really=True)
    with pytest.raises(FileNotFoundError):
        R.open_collection(spark, path)


def test_nearest_rows_among_many_copies(spark):
    rows = [(f"c{i}", [1.0, i / 10]) for i in range(6)]
    df = spark.createDataFrame([*rows * 9, (None, [1.0, 0.0]), ("n", None)], "chunk_id string, embedding array<float>").withColumn("text", F.concat(F.lit("t"), "chunk_id"))
    got = sorted(((r.chunk_id, r.text) for r in R.nearest_rows(df, [1.0, 0.0], k=3).collect()))
    assert got == [("c0", "tc0"), ("c1", "tc1"), ("c2", "tc2")]
    assert R.nearest_rows(df.limit(0), [1.0, 0.0]).count() == 0
    plan = R.nearest_rows(df, [1.0, 0.0], k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan  # what is ranked is ranked before, and narrow


def test_index_reads_few_cells_and_finds_most(spark, tmp_path):
    from ledgerlens.operators.vectorindex import VectorIndex

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    v = np.concatenate([centres + 0.4 * rng.normal(size=centres.shape) for _ in range(40)])
    nan = float("nan")
    odd = [(9000, None), (9001, []), (9002, [0.0] * 16), (9003, [nan] * 16), (9004, [1.0, 2.0])]
    df = vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)] + odd)
    index = VectorIndex.build(df, str(tmp_path / "index"), cells=20)
    assert index.rows().count() == len(v)
    exact = {(r["query"], r.vec_id) for r in R.batch_topk(df, df.filter("vec_id % 40 = 0")).collect()}
    few = {(r["query"], r.vec_id) for r in index.search_all(df.filter("vec_id % 40 = 0"), probes=4).collect()}
    assert len(few & exact) >= 0.95 * len(exact)
    one = index.search(v[0].tolist(), probes=4)
    assert [r.vec_id for r in one.collect()] == [r.vec_id for r in R.cosine_topk(df, v[0].tolist()).collect()]
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()
    assert VectorIndex.build(df.limit(0), str(tmp_path / "none")).search([1.0], probes=3).count() == 0


def test_collection_is_kept_or_replaced(spark):
    R.create_collection(spark, "points_t", "chunk_id string", overwrite=True)
    spark.sql("INSERT INTO points_t VALUES ('a')")
    R.create_collection(spark, "points_t", "chunk_id string")
    assert spark.table("points_t").count() == 1
    R.create_collection(spark, "points_t", "chunk_id string", overwrite=True)
    assert spark.table("points_t").count() == 0
    spark.sql("DROP TABLE points_t")


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "net debt net"), ("b", "debt"), ("c", None), ("d", "other words here now")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "net debt debt"), (2, "absent")], "qid int, question string")
    got = {(r.qid, r.chunk_id): r.score for r in K.bm25(docs, asked).collect()}
    n, mean = 4, 2.0

    def part(df, tf, length):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.7 / (tf + 1.7 * (0.4 + 0.6 * length / mean))

    assert got == {(1, "a"): round(part(1, 2, 3) + part(2, 1, 3), 6), (1, "b"): round(part(2, 1, 1), 6)}


def test_fusion(spark):
    s = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", 0.5, 2)], "qid int, chunk_id string, score double, rank int")
    k = spark.createDataFrame([(1, "b", 4.0, 1), (1, "c", 2.0, 2), (2, "x", 0.0, 1)], "qid int, chunk_id string, score double, rank int")
    w = {(r.qid, r.chunk_id): r.score for r in K.weighted_fusion(s, k).collect()}
    assert w == {(1, "a"): 0.63, (1, "b"): 0.65, (1, "c"): 0.15, (2, "x"): 0.0}
    r = {(x.qid, x.chunk_id): x.score for x in K.reciprocal_ranks([s, k]).collect()}
    assert r[1, "b"] == round(1 / 62 + 1 / 61, 6) and r[1, "a"] == round(1 / 61, 6)
    assert {tuple(x) for x in K.reciprocal_ranks([k, s]).collect()} == {tuple(x) for x in K.reciprocal_ranks([s, k]).collect()}
    assert {(x.chunk_id, x.score) for x in K.highest_score([s, k]).filter("qid = 1").collect()} == {("a", 0.9), ("b", 4.0), ("c", 2.0)}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 50, 333])
def test_order_statistics(spark, n):
    rng = np.random.default_rng(n)
    x = rng.choice([0.0, 1.5, 7.0, 1e6, -3.25], n).tolist() if n % 2 else rng.normal(size=n).tolist()
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "v double")
    got = order_statistics(df, "v", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).first()
    y = sorted(x)
    assert (got.n, got.p50, got.p95, got.p100) == (n, y[min(int(n * 0.5), n - 1)], y[min(int(n * 0.95), n - 1)], y[-1])


def test_order_statistics_of_nothing(spark):
    assert order_statistics(spark.createDataFrame([], "v double"), "v", {"p": 0.5}).count() == 0


def test_far_outliers_do_not_put_all_values_into_one_task(spark, monkeypatch):
    from ledgerlens.operators import statistics

    monkeypatch.setattr(statistics, "SORTED", 20)
    values = [float(i) for i in range(1000)] + [1e15, -1e300, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = order_statistics(df, "v", {"p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
    s = sorted(values)
    assert (got.n, got.p50, got.p99, got.p100) == (1003, s[501], s[int(1003 * 0.99)], 1e300)
    q = statistics.quantiles(df, "v", {"q1": 0.25, "q3": 0.75}).first()
    assert np.allclose((q.q1, q.q3), np.quantile(values, [0.25, 0.75]))


def test_words_of_many_queries_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "net debt rose"), ("b", "rent fell and fell"), ("c", None), ("d", "")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "net rent"), (2, "fell fell"), (3, None)], "qid int, question string")
    one = {tuple(r) for r in K.bm25(docs, asked).collect()}
    assert {(q, c) for q, c, _ in one} == {(1, "a"), (1, "b"), (2, "b")}
    for bound in ("SCANNED_TERMS", "BROADCAST_TERMS"):
        monkeypatch.setattr(K, bound, 0)
        assert {tuple(r) for r in K.bm25(docs, asked).collect()} == one
