"""Series of (period, value) per key: growth, anomalies, trends, forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.statistics import quantiles


def growth(series: DataFrame, by: str, order: str, value: str, lag: int) -> DataFrame:
    """series with ``previous`` (lag periods before), ``change`` and ``growth`` in percent; null where there is none or it is 0."""
    w = Window.partitionBy(by).orderBy(order)
    out = series.withColumn("previous", F.lag(value, lag).over(w))
    return out.withColumn("change", F.col(value) - F.col("previous")).withColumn("growth", (F.col(value) - F.col("previous")) / F.nullif(F.abs("previous"), F.lit(0.0)) * 100)


def zscores(series: DataFrame, by: str, value: str, limit: float = 2.0, critical: float = 3.0) -> DataFrame:
    """Values more than ``limit`` population deviations from their key's mean, with their severity. A constant series has none."""
    stats = series.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"))
    z = (F.col(value) - F.col("mean")) / F.nullif("deviation", F.lit(0.0))
    out = series.join(stats, by).withColumn("z", z).filter(F.abs("z") > limit)
    return out.withColumn("severity", F.when(F.abs("z") > critical, "critical").otherwise("moderate"))


def outside_quartiles(series: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """Values beyond ``reach`` interquartile ranges from the quartiles (interpolated)."""
    q = quantiles(series, value, {"q1": 0.25, "q3": 0.75}, [by]).drop("n")
    out = series.join(q, by).withColumn("low", F.col("q1") - reach * (F.col("q3") - F.col("q1"))).withColumn("high", F.col("q3") + reach * (F.col("q3") - F.col("q1")))
    return out.filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))


def trend(series: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, r2) of a straight line through each series."""
    return series.groupBy(by).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def forecast(series: DataFrame, by: str, x: str, y: str, periods: int = 4, least: int = 8) -> DataFrame:
    """(by, step, forecast, low, high): the line carried on, with 1.96 residual deviations either way; short series give none."""
    fit = series.groupBy(by).agg(
        F.count("*").alias("n"), F.max(x).alias("last"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.greatest(F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.nullif(F.regr_sxx(y, x), F.lit(0.0)), F.lit(0.0)).alias("rest"),
    )
    fit = fit.filter(F.col("n") >= least).withColumn("sd", F.sqrt(F.col("rest") / (F.col("n") - 2)))
    each = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    at = F.col("intercept") + F.col("slope") * (F.col("last") + F.col("step"))
    return each.select(by, "step", at.alias("forecast"), (at - 1.96 * F.col("sd")).alias("low"), (at + 1.96 * F.col("sd")).alias("high"))


def forecast_errors(series: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(mae, rmse, mape): actual values of 0 do not count in the last."""
    e = F.col(actual) - F.col(predicted)
    return series.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e) / F.nullif(F.abs(actual), F.lit(0.0))) * 100).alias("mape"))


def forecast_with(series: DataFrame, by: str, x: str, y: str, model, periods: int = 4, least: int = 8) -> DataFrame:
    """(by, step, forecast) by any model(xs, ys, periods) -> values, one series at a time; shorter series than ``least`` give none.

    A series is one key's periods, so it fits a task.
    """
    import numpy as np
    import pandas as pd

    kind = series.schema[by].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(x)
        values = list(model(pdf[x].to_numpy(), pdf[y].to_numpy(), periods)) if len(pdf) >= least else []
        return pd.DataFrame({by: pd.Series([key[0]] * len(values), dtype=pdf[by].dtype), "step": np.arange(1, len(values) + 1, dtype="int32"), "forecast": np.asarray(values, dtype=float)})

    return series.select(by, x, y).groupBy(by).applyInPandas(run, f"{by} {kind}, step int, forecast double")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """(correlation, n, p_value): Pearson's r over rows that have both, and how likely one as strong is without any relation (two-sided t test).

    Null with fewer than three rows or a constant; 0 for a perfect one.
    """
    r, n = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.corr(a, b), F.count("*")).first()
    p = None if r is None or r != r or n < 3 else 0.0 if abs(r) >= 1 else student_tail(abs(r) * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)
    return df.sparkSession.createDataFrame([(r, n, p)], "correlation double, n long, p_value double")


def student_tail(t: float, freedom: int) -> float:
    """P(|T| >= t) of Student's distribution: the regularised incomplete beta function I(x; freedom / 2, 1 / 2) by its continued fraction."""
    from math import exp, lgamma, log

    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x in (0.0, 1.0):
        return x
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    fraction = 1.0
    for m in range(400, 0, -1):  # from the inside out
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        fraction = 1 + odd / (1 + even / fraction)
    value = front / fraction
    return min(1.0, max(0.0, 1 - value if swap else value))
