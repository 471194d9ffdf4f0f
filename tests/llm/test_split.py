import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm.split import KINDS, cut_positions, gap_kinds, split_oversized, split_text


def check_pieces(text, pieces, limit, overlap):
    words = text.split()
    assert pieces[0][1] == 0 and pieces[-1][2] == len(words)
    for i, (content, a, b, _) in enumerate(pieces):
        assert 0 < b - a <= limit and content.split() == words[a:b]
        if i:
            assert a == pieces[i - 1][2] - overlap  # exactly the overlap is shared
            assert b > pieces[i - 1][2]


def test_nothing_to_cut():
    for text in ("", " \n ", "word " * 500, "one"):
        assert split_text(text) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "Next", "x\n\n", "- item\n", "a\n"]), min_size=21, max_size=300), st.integers(5, 20), st.integers(0, 4))
def test_pieces_cover_the_text(tokens, limit, overlap):
    text = " ".join(tokens)
    if len(text.split()) > limit:
        check_pieces(text, split_text(text, limit, overlap), limit, overlap)


def test_cuts_stand_at_paragraphs_then_sentences():
    sentence = " ".join(["word"] * 9) + " end. "
    text = ("Start " + sentence * 40 + "\n\n") * 3
    pieces = split_text(text)
    check_pieces(text, pieces, 500, 50)
    assert [p[3] for p in pieces[:-1]] == ["paragraph"] * (len(pieces) - 1)
    capital = ("Start " + " ".join(["word"] * 8) + " end. ") * 120
    assert {p[3] for p in split_text(capital)[:-1]} == {"sentence"}


def test_wrapped_lines_are_no_boundary_but_rows_are():
    wrapped = "\n".join("some words of a long sentence that goes on" for _ in range(120))
    assert {p[3] for p in split_text(wrapped)[:-1]} == {"word"}
    rows = "\n".join(f"| item {i} | {i} | {i} |" for i in range(200))
    assert {p[3] for p in split_text(rows)[:-1]} == {"row"}


def test_cost_is_least_among_all_cuts():
    """Against trying every set of cuts on a small case."""
    from itertools import combinations

    rng = np.random.default_rng(1)
    from ledgerlens.llm.split import CUT_COST

    for _ in range(20):
        n, limit, overlap = int(rng.integers(13, 18)), 7, 2
        kinds = rng.choice([0, 1, 2], n - 1).astype(np.int8)  # everywhere natural: all positions are allowed
        pieces = -(-(n - overlap) // (limit - overlap))
        even = (n - overlap) / pieces

        def cost(cuts):
            total, before = 0.0, 0
            for p in (*cuts, n):
                advance = p - before - (overlap if before == 0 else 0)
                if p - before + (overlap if before else 0) > limit or (before and p - before < 1):
                    return np.inf
                total += ((advance - even) / even) ** 2 + (CUT_COST[kinds[p - 1]] if p < n else 0)
                before = p
            return total

        best = min(cost(c) for k in range(1, 8) for c in combinations(range(overlap, n), k))
        found = cut_positions(n, kinds, limit, overlap)
        assert abs(cost([p for p, _ in found[:-1]]) - best) < 1e-9


def test_one_very_long_text_without_boundaries():
    pieces = split_text("x " * 60_000)
    check_pieces("x " * 60_000, pieces, 500, 50)
    assert {p[3] for p in pieces[:-1]} == {"word"}


def test_rows(spark, chunks_of):
    from pyspark.sql import functions as F

    long = "word " * 1200
    df = chunks_of([("a", long, "f", None), ("a", long, "f", None), ("b", None, "f", None), ("c", "  ", "f", None), (None, long, "f", None), ("d", "x " * 500, "f", None)])
    df = df.withColumn("piece_index", F.lit("mine")).withColumn("n_words", F.lit(-1)).withColumn("page_number", F.lit(None).cast("int"))
    rows = split_oversized(df).collect()
    assert {r.chunk_id for r in rows} == {"a"} and sorted(r.piece_index for r in rows) == [0, 1, 2] and all(r.page_number is None for r in rows)
    assert split_oversized(df.limit(0)).count() == 0
    for limit, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            split_oversized(df, limit, overlap)


def test_kinds():
    text = "One two. Three four\n\nfive"
    starts, ends = [0, 4, 9, 15, 21], [3, 8, 14, 19, 25]
    assert [KINDS[k] for k in gap_kinds(text, starts, ends)] == ["word", "sentence", "word", "paragraph"]


def test_lists_without_marks_are_cut_between_entries():
    names = ["Osthestre", "Velnodal", "Tamssemund", "Vesribar"]
    plain = "\n".join(f"O stock de pecas numero {'x' * (i % 7)} - {names[i % 4]}" for i in range(200))
    closed = "\n".join(f"La plantilla {'de la zona ' * (i % 3)}- {names[i % 4]};" for i in range(200))
    for text in (plain, closed, closed.replace("\n", "\r\n")):
        pieces = split_text(text)
        check_pieces(text, pieces, 500, 50)
        assert {p[3] for p in pieces[:-1]} == {"line"}
        assert all(p[0].splitlines()[-1] in text.splitlines() for p in pieces)


def test_a_sentence_end_is_better_than_a_line_end():
    text = "\n".join(f"Some words of entry {'x' * (i % 7)}\nmore of it here. Then others" for i in range(120))
    assert {p[3] for p in split_text(text)[:-1]} == {"sentence"}
