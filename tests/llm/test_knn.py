import numpy as np
import pandas as pd
import pytest

from ledgerlens.llm import knn


def brute(v, k, least=None):
    u = v.astype(np.float32).astype(float)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for i in range(len(v)):
        best = sorted((-round(s[i, j], 9), f"v{j:04d}") for j in range(len(v)) if j != i)[:k]
        out[f"v{i:04d}"] = [(n, -m) for m, n in best if least is None or -m >= least]
    return out


def frame(spark, v):
    return spark.createDataFrame([(f"v{i:04d}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, embedding array<float>")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, []).append((r["rank"], r.neighbour, r.cosine))
    return {k: [(n, c) for _, n, c in sorted(x)] for k, x in out.items()}


def test_exact_over_all_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 40)
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    v = np.random.default_rng(0).normal(size=(300, 16))
    got, want = found(knn.nearest(frame(spark, v), probes=None)), brute(v, 5)
    assert got.keys() == want.keys()
    for i in want:
        assert [n for n, _ in got[i]] == [n for n, _ in want[i]]
        assert np.allclose([c for _, c in got[i]], [c for _, c in want[i]], atol=1e-6)


def test_recall_of_few_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 32))
    v = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape)])
    got = found(knn.nearest(frame(spark, v), min_cosine=0.9, probes=8))
    want = {k: x for k, x in brute(v, 5, 0.9).items() if x}
    pairs = lambda d: {(a, n) for a, x in d.items() for n, _ in x}
    assert pairs(got) <= pairs(want) and len(pairs(got)) >= 0.97 * len(pairs(want))


def test_cells_grow_with_the_root_beyond_a_number(monkeypatch):
    assert knn.cell_count(0) == 1 and knn.cell_count(200_000) == 100
    assert knn.cell_count(4 * knn.MANY_CELLS * knn.CELL_ROWS) == 2 * knn.MANY_CELLS


@pytest.mark.parametrize("many", [1 << 20, 20])
def test_measured_probes_find_enough_in_very_many_cells(spark, monkeypatch, many):
    monkeypatch.setattr(knn, "CELL_ROWS", 3)
    monkeypatch.setattr(knn, "MANY_CELLS", many)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    v = np.concatenate([centres + 0.3 * rng.normal(size=centres.shape) for _ in range(10)])
    got, want = found(knn.nearest(frame(spark, v))), brute(v, 5)
    hits = sum(len({n for n, _ in got[i]} & {n for n, _ in want[i]}) for i in want)
    assert hits >= 0.95 * 5 * len(v)


def test_a_crowd_of_close_vectors_is_cut_in_its_tile(spark, monkeypatch):
    monkeypatch.setattr(knn, "SURVIVORS", 500)
    rng = np.random.default_rng(7)
    v = np.ones((150, 16)) + 1e-4 * rng.normal(size=(150, 16))  # closer than the int8 bounds can tell
    df = frame(spark, v)
    got, want = found(knn.nearest(df, probes=None)), brute(v, 5)
    assert all(np.allclose([c for _, c in got[i]], [c for _, c in want[i]], atol=1e-9) for i in want)
    tile = pd.DataFrame({"id": np.arange(150), "unit": list((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)), "ids": [[f"v{i:04d}"] for i in range(150)]})
    assert len(knn._tile(5, None)((16, 0, 0, 0), tile, tile)) == 5 * 150


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 24)).astype(np.float32)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q, scale, lost = knn.quantise(a)
    near = (q.astype(np.float32) * scale[:, None]) @ (q.astype(np.float32) * scale[:, None]).T
    bound = lost[:, None] + (1 + lost[:, None]) * lost[None, :] + 1e-6
    assert (np.abs(near - a @ a.T) <= bound).all()


def test_crowds_of_equal_vectors(spark):
    rows = [(f"c{i:03d}", [1.0, 2.0]) for i in range(40)] + [("far", [2.0, -1.0]), ("near", [1.0, 2.1])]
    got = found(knn.nearest(spark.createDataFrame(rows, "chunk_id string, embedding array<float>"), probes=None))
    assert [n for n, _ in got["c000"]] == ["c001", "c002", "c003", "c004", "c005"]
    assert [n for n, _ in got["c039"]] == ["c000", "c001", "c002", "c003", "c004"]
    assert [n for n, _ in got["near"]] == ["c000", "c001", "c002", "c003", "c004"]
    assert len(got) == 42


def test_unusable_vectors_and_lengths(spark):
    nan = float("nan")
    rows = [("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [3.0, 0.1]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [nan, 1.0]), ("g", [float("inf"), 1.0]), (None, [1.0, 0.0]), ("h", [1.0, 0.0, 0.0]), ("i", [1e-30, 0.0])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "chunk_id string, embedding array<float>, id string, cell int")
    got = found(knn.nearest(df, probes=None))
    assert {k: [n for n, _ in x] for k, x in got.items()} == {"a": ["i", "b"], "i": ["a", "b"], "b": ["a", "i"]}
    assert knn.nearest(df.limit(0)).count() == 0
    assert knn.nearest(df.filter("chunk_id = 'e'")).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_stated_queries(spark, k):
    v = np.random.default_rng(3).normal(size=(90, 8))
    df = frame(spark, v)
    got = found(knn.nearest(df, k=k, queries=df.filter("chunk_id < 'v0010'"), probes=None))
    want = brute(v, k)
    assert got.keys() == {f"v{i:04d}" for i in range(10)} and all([n for n, _ in got[i]] == [n for n, _ in want[i]] for i in got)
