"""Time series of portfolio totals (by, period, total): drawdown, growth, real return, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FinanceConfig


def drawdowns(series: DataFrame, by: list[str]) -> DataFrame:
    """Add the position, the running peak of positive totals and the drawdown from it in percent. Windows never span portfolios."""
    d = series.where("total > 0")
    w = Window.partitionBy(*by).orderBy("period")
    d = d.withColumns({"position": F.row_number().over(w) - 1, "peak": F.max("total").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.withColumn("drawdown", 100 * (F.col("total") - F.col("peak")) / F.col("peak"))


def max_drawdown(series: DataFrame, by: list[str]) -> DataFrame:
    """The worst drawdown and the last point's distance from the highest peak; 0 for fewer than two points."""
    g = drawdowns(series, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("drawdown").alias("worst"), F.max("total").alias("top"), F.max_by("total", "period").alias("last"))
    some = F.col("n") >= 2
    return g.select(*by, "n", F.when(some, F.col("worst")).otherwise(0.0).alias("max_drawdown"), F.when(some, 100 * (F.col("last") - F.col("top")) / F.col("top")).otherwise(0.0).alias("current_drawdown"))


def growth(series: DataFrame, by: list[str]) -> DataFrame:
    """Growth from the first to the last positive total, and annualised over the number of monthly points."""
    g = series.where("total > 0").groupBy(*by).agg(F.min_by("total", "period").alias("first"), F.max_by("total", "period").alias("last"), F.count(F.lit(1)).alias("n"))
    some = F.col("n") >= 2
    r = F.col("last") / F.col("first")
    return g.select(*by, "n", F.when(some, 100 * (r - 1)).otherwise(0.0).alias("growth_pct"), F.when(some, 100 * (F.pow(r, 12 / F.greatest(F.lit(1), F.col("n") - 1)) - 1)).otherwise(0.0).alias("annualized_pct"))


def fisher(nominal_pct: Column, config: FinanceConfig = FinanceConfig()) -> Column:
    """The return in percent after inflation."""
    return 100 * ((1 + nominal_pct / 100) / (1 + config.inflation) - 1)


def real_return(grown: DataFrame, fund: Column | None = None) -> DataFrame:
    """Of the annualised growth, or where that is 0 of the fund's return."""
    nominal = F.col("annualized_pct") if fund is None else F.when(F.col("annualized_pct") != 0, F.col("annualized_pct")).otherwise(F.coalesce(fund, F.lit(0.0)))
    return grown.withColumn("real_return_pct", fisher(nominal))


def trend(series: DataFrame, by: list[str]) -> DataFrame:
    """The change in percent from the first total, which must be above 0, to the last."""
    g = series.groupBy(*by).agg(F.min_by("total", "period").alias("first"), F.max_by("total", "period").alias("last"), F.count(F.lit(1)).alias("n")).where("n >= 2 and first > 0")
    return g.select(*by, "n", (100 * (F.col("last") - F.col("first")) / F.col("first")).alias("change_pct"), F.lit("INFO").alias("type"))


def account_totals(tx: DataFrame, by: list[str]) -> DataFrame:
    g = tx.groupBy(*by).agg(F.sum(F.coalesce("debit", F.lit(0.0))).alias("debits"), F.sum(F.coalesce("credit", F.lit(0.0))).alias("credits"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("net", F.col("credits") - F.col("debits"))


def running_balance(tx: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return tx.withColumn("balance", F.sum(F.col("credit") - F.col("debit")).over(w))
