"""Results as JSON files and as a markdown report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerlens.runtime import stored


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def markdown_report(title: str, metrics: DataFrame, groups: DataFrame | None = None, limit: int = 200) -> str:
    """A page of one-row metrics, and of a table with a row per group; a report shows at most ``limit`` groups and says how many it leaves out."""
    out = [f"# {title}", ""]
    for row in metrics.limit(1).collect():
        out += ["| metric | value |", "|-|-|", *(f"| {k} | {'' if v is None else v} |" for k, v in row.asDict().items()), ""]
    if groups is not None:
        groups = stored(groups, "report")
        n = groups.count()
        out += ["| " + " | ".join(groups.columns) + " |", "|" + "-|" * len(groups.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in groups.orderBy(groups.columns[0]).limit(limit).collect()]
        if n > limit:
            out += ["", f"{n - limit} more rows"]
    return "\n".join(out).rstrip() + "\n"
