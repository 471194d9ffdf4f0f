import random
from itertools import combinations

import numpy as np
import pytest

from ledgerlens.llm import neardup as N


def sets(text, size):
    w = text.lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    texts = {}
    for i in range(n):
        w = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40, 120))]
        texts[f"t{i:03d}a"] = " ".join(w)
        for k in range(rng.randrange(3)):
            x = list(w)
            for _ in range(rng.randrange(1, 9)):
                x[rng.randrange(len(x))] = f"e{rng.randrange(9999)}"
            texts[f"t{i:03d}{'bcd'[k]}"] = " ".join(x)
    return texts


def test_pairs_equal_brute_force(chunks_of):
    texts = corpus()
    got = {tuple(r) for r in N.NearDuplicates(chunks_of([(k, t, "f", None) for k, t in texts.items()]), size=3, threshold=0.6, min_members=40).pairs().collect()}
    s = {k: x for k, t in texts.items() if len(x := sets(t, 3)) >= 40}
    want = {(a, b) for a, b in combinations(sorted(s), 2) if jaccard(s[a], s[b]) >= 0.6}
    assert len(want) > 20 and got == want


def test_copies_case_and_repeated_ids(chunks_of, monkeypatch):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [("b", text.upper(), "f", None), ("a", text, "f", None), ("a", text, "f", None), ("c", text + " more", "g", None), ("d", other, "g", None), ("e", None, "g", None), ("f", " ", "g", None), ("g", "too short", "g", None), (None, text, "g", None)]
    near = N.NearDuplicates(chunks_of(rows), size=3, threshold=0.6, min_members=40)
    assert {tuple(r) for r in near.pairs().collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    groups = {r.chunk_id: (r.group_id, r.n_links) for r in near.groups().collect()}
    assert groups == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "d": ("d", 0)}
    assert {tuple(r) for r in near.membership().collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_crowds_lose_no_link_between_different_texts(chunks_of, monkeypatch):
    monkeypatch.setattr(N, "PAIRED_COPIES", 2)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(f"e{i}", text, "f", None) for i in range(4)] + [("a", text.upper(), "f", None), ("b", text.title(), "f", None), ("c", text + " more", "g", None), ("d", text + " more", "g", None)]
    got = {tuple(r) for r in N.NearDuplicates(chunks_of(rows), size=3, threshold=0.6, min_members=40).pairs().collect()}
    lead = ["a", "b", "c", "d", "e0"]  # the crowd of e's stands back behind its first
    assert got == {(x, y) for x, y in combinations(lead, 2)} | {("e0", f"e{i}") for i in (1, 2, 3)}


def test_large_buckets_are_met_in_shares(spark, monkeypatch):
    monkeypatch.setattr(N, "BUCKET_SHARE", 7)
    rows = [(i, 1) for i in range(40)] + [(i, 2) for i in range(5)] + [(100, 3)]
    got = [tuple(r) for r in N._meetings(spark.createDataFrame(rows, "id long, band long")).collect()]
    assert sorted(got) == sorted([*combinations(range(40), 2), *combinations(range(5), 2)])


def test_chains_are_one_group(chunks_of):
    words = [f"w{i}" for i in range(300)]
    rows = [(f"c{i}", " ".join(words[6 * i : 6 * i + 100]), "f", None) for i in range(12)]
    groups = {r.chunk_id: r.group_id for r in N.NearDuplicates(chunks_of(rows), size=3, threshold=0.8).groups().collect()}
    assert set(groups.values()) == {"c0"}


def test_nothing(chunks_of):
    near = N.NearDuplicates(chunks_of([("a", "x", "f", None)]).limit(0))
    assert near.pairs().count() == near.groups().count() == 0


@pytest.mark.parametrize("n", [1, 2, 50, 5000])
def test_sketch_fills_every_bin_and_estimates(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.concatenate([a[: len(a) // 2], rng.integers(0, 1 << 62, n - len(a) // 2).astype(np.uint64)])
    x, y = N.sketch(a, 400), N.sketch(np.unique(b), 400)
    assert (x != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (x == N.sketch(a[::-1], 400)).all()
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.12


def test_bands_miss_little():
    for t in (0.5, 0.6, 0.8, 0.95):
        bands, rows = N.bands_for(t)
        assert bands <= N.MAX_BANDS and (1 - t**rows) ** bands <= N.MISS


def test_words_split_at_unicode_white_space_only():
    assert N.words_of("a b　c") == ["a", "b", "c"] and N.words_of("a\x1cb c") == ["a\x1cb", "c"]


def test_bins_filled_in_late_rounds_keep_the_earlier_value():
    """One member and as many bins as p4_groups has: values rank as the rounds that filled their bins first."""
    bins, member = 715, np.array([12345], np.uint64)
    first = {}
    for i in range(2 * bins):
        first.setdefault(int(N.mix(member, i + 1)[0] % np.uint64(bins)) if i < bins else i - bins, i)
    values = N.sketch(member, bins)
    assert max(first.values()) >= 1024
    assert list(np.argsort(values, kind="stable")) == sorted(range(bins), key=first.__getitem__)


def test_pairs_at_the_threshold_are_missed_once_in_ten_thousand_at_most():
    for t in (0.6, 0.8):
        bands, rows = N.bands_for(t)
        assert (1 - t**rows) ** bands <= 1e-4 and bands * rows <= 1 << 11
