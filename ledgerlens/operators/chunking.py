"""Texts and parsed elements into overlapping windows of words, with pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.text import stripped, words

#: Elements of a file whose pages are filled, and pages whose chunks are numbered, in one window.
BLOCK = 10_000


def _check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and 0 <= overlap < size")


def _windows(w: Column, size: int, overlap: int) -> Column:
    """Indexes 0 .. n of the windows over n words."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.ceil(F.size(w) / (size - overlap)).cast("int") - 1))


def chunk_words(docs: DataFrame, key: str = "doc_id", text: str = "text", pages: str = "page_count", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_id, chunk_index, page_number, content): windows of words with an estimated page.

    A text of at most ``size`` words is one chunk and keeps its white space; longer ones are joined by single spaces,
    with a last window even if the one before holds it. Blank and null texts give none. Null pages
    count as 0, which gives page 0 to short and 1 to long texts.
    """
    _check(size, overlap)
    step = size - overlap
    base = docs.select(key, F.col(text).alias("t"), F.coalesce(F.col(pages).cast("int"), F.lit(0)).alias("p")).withColumn("w", words(F.col("t"))).filter(F.size("w") > 0)
    # the length of every step of words, so that the place of a window is a sum and not a longer and longer join
    base = base.withColumn("steps", F.transform(_windows(F.col("w"), size, overlap), lambda k: F.length(F.array_join(F.slice("w", k * step + 1, F.lit(step)), " "))))
    short = F.size("w") <= size
    each = base.select("*", F.explode(F.when(short, F.array(F.lit(0))).otherwise(_windows(F.col("w"), size, overlap))).alias("k"))
    at = F.aggregate(F.slice("steps", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + x + 1) - F.when(F.col("k") > 0, 1).otherwise(0)
    per_page = F.length("t").cast("double") / F.greatest(F.col("p"), F.lit(1))
    page = F.greatest(F.least(F.floor(at / per_page).cast("int") + 1, F.col("p")), F.lit(1))
    return each.select(
        key,
        F.concat(F.col(key).cast("string"), F.lit("_"), F.col("k").cast("string")).alias("chunk_id"),
        F.col("k").alias("chunk_index"),
        F.when(short, F.least(F.col("p"), F.lit(1))).otherwise(page).alias("page_number"),
        F.when(short, stripped(F.col("t"))).otherwise(F.array_join(F.slice("w", F.col("k") * step + 1, F.lit(size)), " ")).alias("content"),
    )


def chunk_words_plain(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, total_chunks, start_word, end_word, content): windows without a case for short texts."""
    _check(size, overlap)
    step = size - overlap
    base = docs.select(key, words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    each = base.select(key, "w", F.posexplode(_windows(F.col("w"), size, overlap)).alias("chunk_index", "k"))
    return each.select(
        key, "chunk_index", F.ceil(F.size("w") / step).cast("int").alias("total_chunks"), (F.col("k") * step).alias("start_word"),
        F.least(F.col("k") * step + size, F.size("w")).alias("end_word"), F.array_join(F.slice("w", F.col("k") * step + 1, F.lit(size)), " ").alias("content"),
    )


def fill_forward(df: DataFrame, by: str, order: str, value: str, first) -> DataFrame:
    """df with nulls of value replaced by the last one before, or ``first``.

    One file may hold most rows: the last value is carried within blocks of BLOCK places, then from block to block.
    """
    block = F.floor(F.col(order) / BLOCK)
    within = Window.partitionBy(by, "__block").orderBy(order)
    df = df.withColumn("__block", block).withColumn("__seen", F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    ends = df.groupBy(by, "__block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__end"))
    across = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(across)).drop("__end")
    out = df.join(ends, [by, "__block"], "left")
    return out.withColumn(value, F.coalesce("__seen", "__carried", F.lit(first))).drop("__block", "__seen", "__carried")


def running_before(df: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the earlier rows of the group, by blocks as in fill_forward."""
    df = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    within = Window.partitionBy(by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(by, "__block").agg(F.sum(value).alias("__sum")).withColumn("__before", F.coalesce(F.sum("__sum").over(across), F.lit(0))).drop("__sum")
    df = df.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(sums, [by, "__block"], "left")
    return df.withColumn(name, F.col("__in") + F.col("__before")).drop("__block", "__in", "__before")


def page_forward_fill(elements: DataFrame) -> DataFrame:
    """(filename, item_seq, page_no, filled): elements once each, with the page carried over from before."""
    one = elements.select("filename", "item_seq", "page_no").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    return fill_forward(one.withColumn("filled", F.col("page_no")), "filename", "item_seq", "filled", 1)


def page_texts(elements: DataFrame) -> DataFrame:
    """(filename, page, content): the non-blank items of a page joined by spaces."""
    one = elements.select("filename", "item_seq", "page_no", "text").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    filled = fill_forward(one.withColumn("page", F.col("page_no")), "filename", "item_seq", "page", 1)
    kept = filled.filter(F.col("text").isNotNull() & (stripped(F.col("text")) != ""))
    return kept.groupBy("filename", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "text"))), lambda x: x["text"]), " ").alias("content"))


def chunk_by_page(elements: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(chunk_id, filename, page_number, chunk_index, content): windows that never cross a page, numbered through the file."""
    _check(size, overlap)
    step = size - overlap
    pages = page_texts(elements).withColumn("w", words(F.col("content"))).filter(F.size("w") > 0)
    pages = pages.withColumn("n", F.when(F.size("w") <= size, 1).otherwise(F.ceil(F.size("w") / step).cast("int")))
    pages = running_before(pages, "filename", "page", "n", "start")
    each = pages.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    index = (F.col("start") + F.col("k")).cast("int")
    return each.select(
        F.concat("filename", F.lit("_"), index.cast("string")).alias("chunk_id"), "filename", F.col("page").alias("page_number"), index.alias("chunk_index"),
        F.when(F.size("w") <= size, F.col("content")).otherwise(F.array_join(F.slice("w", F.col("k") * step + 1, F.lit(size)), " ")).alias("content"),
    )


def table_aware_chunks(elements: DataFrame, sentences: int = 2) -> DataFrame:
    """(filename, item_seq, page_number, content): each table whole, with the sentences before and after it.

    Context is taken from the text item right before and right after; sentences end at '. '.
    """
    one = elements.select("filename", "item_seq", "page_no", "text", "is_table").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    filled = fill_forward(one.withColumn("page_number", F.col("page_no")), "filename", "item_seq", "page_number", 1).filter(F.col("text").isNotNull() & (stripped(F.col("text")) != ""))
    plain = F.struct(F.col("filename"), F.col("item_seq"), F.when(~F.col("is_table"), F.col("text")).alias("text"))
    around = filled.select(plain.alias("x")).select("x.*")
    before = around.select("filename", (F.col("item_seq") + 1).alias("item_seq"), F.col("text").alias("before"))
    after = around.select("filename", (F.col("item_seq") - 1).alias("item_seq"), F.col("text").alias("after"))
    tables = filled.filter("is_table").join(before, ["filename", "item_seq"], "left").join(after, ["filename", "item_seq"], "left")
    tail = F.split(F.coalesce("before", F.lit("")), "\\. ")
    head = F.split(F.coalesce("after", F.lit("")), "\\. ")
    n = F.least(F.size(tail), F.lit(sentences))
    return tables.select(
        "filename", "item_seq", "page_number",
        F.concat(F.array_join(F.slice(tail, F.size(tail) - n + 1, n), ". "), F.lit("\n\n"), "text", F.lit("\n\n"), F.array_join(F.slice(head, F.lit(1), F.lit(sentences)), ". ")).alias("content"),
    )


def typed_chunks(elements: DataFrame, size: int = 500, overlap: int = 50, sentences: int = 2) -> DataFrame:
    """(filename, chunk_type, page_number, item_seq, part, content): whole documents, tables apart from text.

    A table is one chunk however long it is, with the sentences before and after it. The text between two tables, page by
    page, comes in windows of words. item_seq is the table's, or that of the first text item of the run; part counts the run's windows.
    """
    _check(size, overlap)
    tables = table_aware_chunks(elements, sentences).select("filename", F.lit("table").alias("chunk_type"), "page_number", "item_seq", F.lit(0).alias("part"), "content")
    one = elements.select("filename", "item_seq", "page_no", "text", "is_table").filter(F.col("filename").isNotNull() & F.col("item_seq").isNotNull()).distinct()
    filled = fill_forward(one.withColumn("page_number", F.col("page_no")), "filename", "item_seq", "page_number", 1).filter(F.col("text").isNotNull() & (stripped(F.col("text")) != ""))
    runs = running_before(filled.withColumn("table", F.coalesce(F.col("is_table"), F.lit(False)).cast("int")), "filename", "item_seq", "table", "run").filter("table = 0")
    texts = runs.groupBy("filename", "run", "page_number").agg(F.min("item_seq").alias("item_seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_seq", "text"))), lambda x: x["text"]), " ").alias("content"))
    step = size - overlap
    w = texts.withColumn("w", words(F.col("content"))).filter(F.size("w") > 0)
    w = w.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(F.size("w") <= size, 0).otherwise(F.ceil(F.size("w") / step).cast("int") - 1))))
    content = F.when(F.size("w") <= size, F.col("content")).otherwise(F.array_join(F.slice("w", F.col("part") * step + 1, F.lit(size)), " "))
    return tables.unionByName(w.select("filename", F.lit("text").alias("chunk_type"), "page_number", "item_seq", "part", content.alias("content")))


def pseudo_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", pages: str = "page_count") -> DataFrame:
    """(key, page_number, content): the text in as many slices of equal length as pages; the last takes the rest."""
    base = docs.select(key, F.col(text).alias("t"), F.col(pages).cast("int").alias("p")).filter(F.col("t").isNotNull() & (F.col("p") > 0))
    size = F.floor(F.length("t") / F.col("p")).cast("int")
    each = base.withColumn("size", size).select("*", F.explode(F.sequence(F.lit(1), F.col("p"))).alias("page_number"))
    at = (F.col("page_number") - 1) * F.col("size") + 1
    return each.select(key, "page_number", F.when(F.col("page_number") == F.col("p"), F.expr("substring(t, (page_number - 1) * size + 1)")).otherwise(F.substring("t", at, F.col("size"))).alias("content"))
