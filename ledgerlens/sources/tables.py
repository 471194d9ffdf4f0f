"""Tables as markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(markdown): a header row, a separator and one row per record; no row for a table without records.

    For tables a reader looks at: the whole table becomes one text.
    """
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("rows"))
    return rows.filter(F.size("rows") > 0).select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["r"]), "\n")).alias("markdown"))


def sheet_block(sheets: list[tuple[str, DataFrame, list[str], str]]) -> DataFrame:
    """(content, page_count) of a workbook: a block per sheet that is not empty, under its number among all sheets."""
    parts = []
    for i, (name, df, columns, order) in enumerate(sheets, 1):
        parts.append(markdown_table(df, columns, order).select(F.lit(i).alias("i"), F.concat(F.lit(f"## Sheet {i}: {name}\n"), "markdown").alias("block")))
    blocks = reduce(DataFrame.unionByName, parts).agg(F.array_sort(F.collect_list(F.struct("i", "block"))).alias("b"))
    return blocks.select(F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("content"), F.size("b").alias("page_count"))
