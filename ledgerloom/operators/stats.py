"""Grouped statistics of holdings. Every function takes a DataFrame and the partition columns `by` and adds one shuffle on them at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import or_zero, ratio


def summary(df: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by, measure, mean, std_dev, median, min, max, n) of each measure; nulls of a measure do not count, absent statistics are 0."""
    rows = df.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.cast("double").alias("x")) for k, v in measures.items()])).alias("m")).select(*by, "m.measure", "m.x")
    g = rows.groupBy(*by, "measure").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std_dev"), F.median("x").alias("median"), F.min("x").alias("min"), F.max("x").alias("max"), F.count("x").alias("n"))
    return g.select(*by, "measure", *[or_zero(F.col(c)).alias(c) for c in ("mean", "std_dev", "median", "min", "max")], "n")


def skewness(x: str) -> Column:
    """With the sample deviation in the z-scores but n as the divisor; 0 for fewer than 3 values or no spread."""
    n = F.count(x)
    return F.when((n >= 3) & (F.stddev_samp(x) > 0), or_zero(F.skewness(x) * F.pow((n - 1) / n, 1.5))).otherwise(0.0)


def kurtosis(x: str) -> Column:
    """Excess kurtosis of the same z-scores; 0 for fewer than 4 values or no spread."""
    n = F.count(x)
    return F.when((n >= 4) & (F.stddev_samp(x) > 0), (or_zero(F.kurtosis(x)) + 3) * F.pow((n - 1) / n, 2) - 3).otherwise(0.0)


def variation(x: str) -> Column:
    """Standard deviation over mean; 0 for fewer than 2 values."""
    return F.when(F.count(x) >= 2, ratio(F.stddev_samp(x), F.avg(x))).otherwise(0.0)


def interval95(x: str, sign: int) -> Column:
    """An end of the 95 % confidence interval of the mean; 0 for fewer than 2 values."""
    n = F.count(x)
    return F.when(n >= 2, F.avg(x) + sign * 1.96 * F.stddev_samp(x) / F.sqrt(n)).otherwise(0.0)


#: How far, of their size, figures of doubles may be apart by the order of their sums.
LAST_BITS = 1e-12


def outliers(df: DataFrame, by: list[str], x: str, sigma: float = 2.0) -> DataFrame:
    """Rows farther than sigma deviations from their group's mean; groups need 3 rows and some spread.

    The groups' figures come from a pre-aggregated pass and are joined back, so that a hot group's rows need not meet in one task.
    A row at the limit itself is no outlier: mean and deviation differ in their last bits with the order of the rows, which must not decide.
    """
    g = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std_dev"), F.count(x).alias("n")).where("n >= 3 and std_dev >= 1e-9")
    off = F.abs(F.col(x) - F.col("mean"))
    return df.join(g, by).where(off - sigma * F.col("std_dev") > LAST_BITS * (off + F.abs("mean")))


def boxplot(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """q1, median, q3 (the values at n/4 and 3n/4 of the sorted row, without interpolation), iqr, whiskers within the data, and outliers outside them.

    Groups of fewer than 5 values have no box. One shuffle: positions, the box and the count of outliers share the partitioning, and sorts spill.
    """
    every = Window.partitionBy(*by)
    d = df.where(F.col(x).isNotNull()).select(*by, F.col(x).alias("v"))
    d = d.withColumns({"r": F.row_number().over(every.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(every)}).where("n >= 5")
    at = lambda i: F.max(F.when(F.col("r") == i, F.col("v"))).over(every)
    half = F.floor(F.col("n") / 2)
    d = d.withColumns({"q1": at(F.floor(F.col("n") / 4)), "q3": at(F.floor(3 * F.col("n") / 4)), "hi": at(half), "lo": at(F.when(F.col("n") % 2 == 1, half).otherwise(half - 1)), "least": F.min("v").over(every), "most": F.max("v").over(every)})
    d = d.withColumns({"median": (F.col("lo") + F.col("hi")) / 2, "iqr": F.col("q3") - F.col("q1")})
    d = d.withColumns({"low": F.greatest(F.col("q1") - 1.5 * F.col("iqr"), F.col("least")), "high": F.least(F.col("q3") + 1.5 * F.col("iqr"), F.col("most"))})
    return d.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "q1", "median", "q3", "iqr", "low", "high")], F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("n_outliers"))


def regression(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Least-squares slope, intercept and r2 of y over x for groups of 3 points or more whose x spread a day; r2 of a constant y is 0."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.min(y).alias("lo"), F.max(y).alias("hi"), (F.max(x) - F.min(x)).alias("spread"))
    return g.where("n >= 3 and spread >= 1").select(*by, "n", "slope", "intercept", F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.col("r2")).alias("r2"))
