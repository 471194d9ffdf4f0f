import pytest

from ledgerlens.operators import chunking as C


def plain_chunks(text, pages, size=500, overlap=50):
    """The windows as the semantics state them."""
    words = text.split()
    if not words:
        return []
    if len(words) <= size:
        return [(0, 1 if pages else 0, text.strip())]
    per = len(text) / max(pages, 1)
    return [(k, max(1, min(int(len(" ".join(words[:i])) / per) + 1, pages)), " ".join(words[i : i + size])) for k, i in enumerate(range(0, len(words), size - overlap))]


def numbered(n):
    return " ".join(f"word{i}" for i in range(n))


def test_windows_and_pages(spark):
    texts = [numbered(n) for n in (0, 1, 499, 500, 501, 900, 901, 950, 1000, 2000)] + ["  \n ", " a  b\n", "x " * 600]
    rows = [(i, t, p) for i, t in enumerate(texts) for p in (0,)] + [(100 + i, t, 10) for i, t in enumerate(texts)] + [(500, None, 3), (501, "one", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, page_count int")
    got = {}
    for r in C.chunk_words(df).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.page_number, r.content))
    for i, t, p in rows:
        expected = plain_chunks(t, p or 0) if t else []
        assert sorted(got.get(i, [])) == expected, i


def test_windows_without_short_case_and_bad_sizes(spark):
    df = spark.createDataFrame([(1, numbered(480))], "doc_id long, text string")
    rows = sorted(C.chunk_words_plain(df).collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_index, r.total_chunks, r.start_word, r.end_word) for r in rows] == [(0, 2, 0, 480), (1, 2, 450, 480)]
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            C.chunk_words_plain(df, size=size, overlap=overlap)


ELEMENTS = "filename string, item_seq int, text string, page_no int, is_table boolean"


def test_pages_are_carried_on_and_never_crossed(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)  # blocks end between the elements
    rows = [("a", 0, "first", None, False), ("a", 1, "x", 50, False), ("a", 2, "y", None, False), ("a", 3, " ", None, False), ("a", 4, "z", None, False), ("a", 5, "w", 51, False), ("a", 6, numbered(800), 75, False), ("a", 6, numbered(800), 75, False), ("b", 0, None, None, False)]
    df = spark.createDataFrame(rows, ELEMENTS)
    filled = {(r.filename, r.item_seq): r.filled for r in C.page_forward_fill(df).collect()}
    assert filled == {("a", 0): 1, ("a", 1): 50, ("a", 2): 50, ("a", 3): 50, ("a", 4): 50, ("a", 5): 51, ("a", 6): 75, ("b", 0): 1}
    chunks = sorted(C.chunk_by_page(df).collect(), key=lambda r: r.chunk_index)
    assert [(r.chunk_id, r.page_number) for r in chunks] == [("a_0", 1), ("a_1", 50), ("a_2", 51), ("a_3", 75), ("a_4", 75)]
    assert chunks[1].content == "x y z" and len(chunks[3].content.split()) == 500 and chunks[4].content.split()[0] == "word450"


def test_tables_keep_their_context(spark):
    rows = [("a", 0, "One. Two. Three.", 1, False), ("a", 1, "| t |", None, True), ("a", 2, "Four. Five. Six", 2, False), ("b", 0, "| u |", None, True)]
    got = {(r.filename, r.item_seq): r.content for r in C.table_aware_chunks(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got == {("a", 1): "Two. Three.\n\n| t |\n\nFour. Five", ("b", 0): "\n\n| u |\n\n"}


def test_empty_tables(spark):
    assert C.chunk_words(spark.createDataFrame([], "doc_id long, text string, page_count int")).count() == 0
    empty = spark.createDataFrame([], ELEMENTS)
    assert C.chunk_by_page(empty).count() == C.page_forward_fill(empty).count() == C.table_aware_chunks(empty).count() == 0


def test_pseudo_pages_cover_the_text(spark):
    df = spark.createDataFrame([(1, "abcdefghij", 3), (2, "ab", 5), (3, None, 2)], "doc_id long, text string, page_count int")
    got = {}
    for r in sorted(C.pseudo_pages(df).collect()):
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {1: ["abc", "def", "ghij"], 2: ["", "", "", "", "ab"]}
