import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import packing as P
from ledgerlens.llm import mixing as M
from ledgerlens.llm.mixing import mix_sources, quotas, reached_shares, shards_of
from ledgerlens.llm.tokens import FOLDER, VOCABULARY, token_counts


def unfold(runs, sizes, counts):
    """Container of every item, from the plan."""
    starts = {}
    for s, low, each, first in sorted(runs):
        starts.setdefault(s, []).append((low, each, first))
    out = []
    for s, n in zip(sizes, counts):
        for rank in range(n):
            low, each, first = max(x for x in starts[s] if x[0] <= rank)
            out.append((first + (rank - low) // each, s))
    return out


def best_fit_decreasing(sizes, counts, capacity):
    gaps = []
    for s, n in sorted(zip(sizes, counts), reverse=True):
        for _ in range(n):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
            gaps.append((min(fit) if fit else capacity) - s)
    return len(gaps)


def test_close_to_best_fit_decreasing():
    rng = np.random.default_rng(8)
    for _ in range(150):
        capacity = int(rng.integers(10, 80))
        sizes = np.unique(rng.integers(1, capacity + 1, rng.integers(1, 25)))
        counts = rng.integers(1, 40, len(sizes))
        assert P.plan_containers(sizes, counts, capacity)[1] <= 1.03 * best_fit_decreasing(sizes.tolist(), counts.tolist(), capacity) + 1


def test_plans_do_not_grow_with_the_items():
    rng = np.random.default_rng(9)
    sizes = np.unique(rng.integers(1, 2049, 900))
    counts = rng.integers(1, 50, len(sizes))
    few, many = (len(P.plan_containers(sizes, counts * scale, 2048)[0]) for scale in (1, 10**7))
    assert many <= 4 * few and many < P.most_runs(len(sizes), 2048)


@settings(max_examples=80, deadline=None)
@given(st.integers(5, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plan_fills_and_never_overfills(capacity, hist):
    sizes = sorted(s for s in hist if s <= capacity)
    counts = [hist[s] for s in sizes]
    runs, total = P.plan_containers(np.array(sizes), np.array(counts), capacity)
    load = {}
    for c, s in unfold(runs, sizes, counts):
        load[c] = load.get(c, 0) + s
    assert len(load) == total and all(0 < x <= capacity for x in load.values())
    assert total <= 11 / 9 * best_fit_decreasing(sizes, counts, capacity) + 2


def test_items(spark):
    rows = [(1, 10), (2, 10), (3, 5), (4, 5), (5, 0), (6, None), (7, 27), (8, 3), (9, 20)]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, tokens int, part string, container_id int")
    windows = spark.createDataFrame([(1, 10), (2, 100), (3, None), (4, 0), (None, 5)], "window_id int, capacity_tokens int")
    got = P.pack(df, windows).collect()
    for w, c in ((1, 10), (2, 100)):
        mine = [r for r in got if r.window_id == w]
        assert {r.doc_id for r in mine} == set(range(1, 10))
        load = {}
        for r in mine:
            if r.container_id is not None:
                load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= c and sorted(load) == list(range(len(load))) and sum(load.values()) == 80
        assert sorted((r.part, r.tokens) for r in mine if r.doc_id == 7) == ([(0, 10), (1, 10), (2, 7)] if c == 10 else [(0, 27)])
        assert len(load) == (8 if c == 10 else 1)
    assert {r.window_id for r in got} == {1, 2}
    report = {r.window_id: (r.containers, r.unused_share) for r in P.fill_report(P.pack(df, windows), windows).collect()}
    assert report[1] == (8, 0.0)
    assert P.pack(df.limit(0), windows).count() == 0 and P.pack(df, windows.limit(0)).count() == 0


def test_equal_sizes_are_ranked_apart(spark, monkeypatch):
    monkeypatch.setattr(P, "RANKED_TOGETHER", 10)
    df = spark.range(200).selectExpr("id AS doc_id", "3 AS tokens")
    windows = spark.createDataFrame([(1, 10)], "window_id int, capacity_tokens int")
    load = {}
    for r in P.pack(df, windows).collect():
        load[r.container_id] = load.get(r.container_id, 0) + 1
    assert sorted(load.values()) == [2] + [3] * 66


def test_plans_too_large_to_broadcast(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS doc_id", "CAST(1 + id * id % 23 AS INT) AS tokens").union(spark.createDataFrame([(900, 0), (901, 70)], "doc_id long, tokens int"))
    windows = spark.createDataFrame([(1, 23), (2, 50)], "window_id int, capacity_tokens int")
    one = {tuple(r) for r in P.pack(df, windows).collect()}
    monkeypatch.setattr(P, "BROADCAST_RUNS", 0)
    assert {tuple(r) for r in P.pack(df, windows).collect()} == one


def test_splitting_tree_is_exact():
    counts = [1000, 37, 0, 5]
    source = np.repeat(np.arange(4), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    shard = shards_of(counts, 13, source, place, (1,))
    per = np.bincount(shard, minlength=13)
    assert per.sum() == 1042 and per.max() - per.min() <= 1
    part = np.random.default_rng(0).permutation(len(place))[:100]  # any task finds the same
    assert (shards_of(counts, 13, source[part], place[part], (1,)) == shard[part]).all()
    assert (np.diff(shard[source == 0]) >= 0).all()


def test_running_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(M, "RUNS", 8)
    rows = spark.range(300).selectExpr("id % 2 AS mix_id", "'s' AS source", "1 AS repeat_no", "CAST(id AS INT) AS block", "id AS t")
    got = sorted((r.mix_id, r.before, r.t) for r in M.running(rows, ["mix_id"], F.xxhash64("block"), {"before": "t"}).collect())
    for m in (0, 1):
        mine = [(b, t) for k, b, t in got if k == m and t]
        assert all(b + t == c for (b, t), (c, _) in zip(mine, mine[1:])) and len(mine) == (149 if m == 0 else 150)


def test_many_shards_hold_every_source(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_DOCS", 100)
    monkeypatch.setattr(M, "BLOCKS", 2)  # far fewer than shards: blocks follow the shards
    sizes = spark.range(8000).selectExpr("id AS doc_id", "IF(id % 4 = 0, 'a', 'b') AS source", "10 AS tokens")
    mixes = spark.createDataFrame([(1, "a", 0.5, 3), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    got = mix_sources(sizes, mixes).toPandas()
    per = got.groupby(["shard", "source"]).size().unstack(fill_value=0)
    assert len(per) == 120 and (per.sum(axis=1) < 300).all() and (per > 0).to_numpy().mean() > 0.95
    assert (got.groupby(["source", "doc_id"]).size() <= got["source"].map({"a": 3, "b": 1}).max()).all() and not got.duplicated(["doc_id", "repeat_no"]).any()
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    assert set(map(tuple, mix_sources(sizes, mixes).toPandas().to_numpy())) == set(map(tuple, got.to_numpy()))


def test_quotas():
    assert quotas([50.0, 50.0], [1, 1], [100, 10]) == [10.0, 10.0]
    assert quotas([0.5, 0.25], [None, 4], [100, 10]) == [80.0, 40.0]
    assert quotas([1.0, 1.0], [2, 2], [0, 10]) == [0.0, 20.0]
    assert quotas([1.0, 3.0], [None, None], [10, 10]) == [10.0, 30.0]
    assert quotas([None, 0.0], [1, 1], [5, 5]) == [0.0, 0.0]
    assert quotas([1.0, 1.0], [1, 5], [10, 100], total=100) == [10, 50.0]


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ["big", "small", None, "tiny"][min(3, int(i >= 1500) + int(i >= 1700) + int(i >= 1720))], int(rng.integers(1, 50))) for i in range(1723)] + [(None, "big", 5), (5000, "big", None), (5001, "big", 0)]
    sizes = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, tokens int, block string")
    mixes = spark.createDataFrame([(1, "big", 80.0, 1), (1, "small", 20.0, 3), (1, "absent", 5.0, 1), (2, "tiny", 0.5, None), (2, "big", 0.5, 1), (3, "absent", 1.0, None), (None, "big", 1.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    picked = mix_sources(sizes, mixes)
    got = picked.collect()
    for m, caps in ((1, {"big": 1, "small": 3}), (2, {"big": 1, "tiny": 10**9})):
        mine = [r for r in got if r.mix_id == m]
        seen = {}
        for r in mine:
            seen.setdefault((r.source, r.doc_id), []).append(r.repeat_no)
        assert all(sorted(x) == list(range(1, len(x) + 1)) or len(set(x)) == len(x) for x in seen.values())
        assert all(len(x) <= caps[s] for (s, _), x in seen.items())
        assert sorted(r.position for r in mine if r.shard == 0) == list(range(sum(r.shard == 0 for r in mine)))
    shares = {(r.mix_id, r.source): r for r in reached_shares(picked, mixes).collect()}
    assert abs(shares[1, "big"].reached_share - 0.8) < 0.01 and abs(shares[1, "small"].reached_share - 0.2) < 0.01
    assert abs(shares[2, "tiny"].reached_share - 0.5) < 0.01 and shares[2, "tiny"].most_repeats > 5
    assert shares[3, "absent"].tokens == 0 and shares[1, "absent"].reached_share == 0.0
    assert mix_sources(sizes.limit(0), mixes).count() == 0 and mix_sources(sizes, mixes.limit(0)).count() == 0


def test_same_seed_same_mix(spark):
    sizes = spark.range(300).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source", "CAST(1 + id % 17 AS INT) AS tokens")
    mixes = spark.createDataFrame([(1, "a", 0.5, 1), (1, "b", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    rows = lambda: {tuple(r) for r in mix_sources(sizes.repartition(5), mixes).collect()}
    assert rows() == rows()


def test_token_counts_equal_the_tokenizer(spark):
    if not os.path.exists(f"{FOLDER}/{VOCABULARY}"):
        pytest.skip("no tokenizer")
    from ledgerlens.llm.tokens import PieceSizes

    texts = ["", " ", "Hello  world\n\n x", "Œuvre 12,5 % \t\n", "a" * 5000, "<|endoftext|>", None, "日本語 emoji 🙂  "]
    got = [r.tokens for r in token_counts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).orderBy("doc_id").collect()]
    encoding = PieceSizes(f"{FOLDER}/{VOCABULARY}").encoding
    assert got == [len(encoding.encode_ordinary(t)) if t else 0 for t in texts]
