"""Order statistics that hold for any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.runtime import stored

CELLS = 4_096
#: Different values of a cell that are sorted in one task; a cell with more is cut into cells again.
SORTED = 20_000


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(*by, n, one column per share): the value at place floor(n * share) of the sorted values, the last at most.

    Neither interpolated nor collected. Nulls and NaN do not count.
    """
    return values_at(df, value, {k: F.least(F.floor(F.col("n") * s), F.col("n") - 1) for k, s in shares.items()}, by)


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(*by, n, one column per share): quantiles interpolated between the two values next to place (n - 1) * share."""
    at = {k: (F.col("n") - 1) * s for k, s in shares.items()}
    places = {f"{k}_low": F.floor(x) for k, x in at.items()} | {f"{k}_high": F.ceil(x) for k, x in at.items()}
    rows = values_at(df, value, places, by)
    return rows.select(*(by or []), "n", *[F.when(F.ceil(x) == F.floor(x), F.col(f"{k}_low")).otherwise((F.ceil(x) - x) * F.col(f"{k}_low") + (x - F.floor(x)) * F.col(f"{k}_high")).alias(k) for k, x in at.items()])


def values_at(df: DataFrame, value: str, places: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(*by, n, one column per place): the values at these places (from 0, as columns of n) of each group's sorted values.

    Values are counted; running sums over few different values find the one at a place. More counts fall into CELLS cells of equal width, and running sums over the cells find the one that holds
    the place. A cell with more than SORTED different values (far outliers leave all others in one) is cut
    into cells again, between its own least and greatest value; running sums within the last cell find the value.
    """
    by = by or []
    x = df.select(*by, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    one = F.lit(0).alias("__all")
    counts = stored(x.groupBy(*by, "v").agg(F.count("*").alias("c")).withColumn("__all", one), "counts")  # the input is read once
    keys = [*by, "__all"]
    ends = stored(counts.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n")), "ends")
    # for each group and name the stretch (lo, hi) that holds the place, and how many values come before it
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()])).alias("q")
    wanted = ends.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("before"), names).select(*keys, "lo", "hi", "before", "q.name", "q.place")
    while counts.count() > SORTED:
        width = F.col("hi") - F.col("lo")
        cell = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * CELLS), F.lit(CELLS - 1))).otherwise(0)
        inside = counts.join(wanted, keys).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).withColumn("cell", cell)
        cells = inside.groupBy(*keys, "name", "place", "before", "cell").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("different"))
        run = Window.partitionBy(*keys, "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.col("before") + F.coalesce(F.sum("c").over(run), F.lit(0)))
        cells = cells.filter((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c")))
        found = stored(cells.select(*keys, "name", "place", "before", "lo", "hi", "different"), "cells")
        wanted = found.drop("different")
        if (found.agg(F.max("different")).first()[0] or 0) <= SORTED:
            break
    inside = counts.join(wanted, keys).filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    near = Window.partitionBy(*keys, "name").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("at", F.col("before") + F.coalesce(F.sum("c").over(near), F.lit(0)))
    hit = inside.filter((F.col("place") >= F.col("at")) & (F.col("place") < F.col("at") + F.col("c")))
    values = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in places])
    return ends.select(*keys, "n").join(values, keys).drop("__all")
