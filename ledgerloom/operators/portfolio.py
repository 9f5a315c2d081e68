"""Yields, durations, concentration and maturities of portfolios of instruments (holder_id, market_value, rates, days)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FinanceConfig
from ..functions.numbers import or_zero, ratio


def weighted(rate: str, value: str = "market_value") -> Column:
    """A rate weighted by value; 0 if the values do not add up to more than 0."""
    return F.when(F.sum(value) > 0, ratio(F.sum(F.col(value) * F.col(rate)), F.sum(value))).otherwise(0.0)


def yields(df: DataFrame, by: list[str]) -> DataFrame:
    g = df.groupBy(*by).agg(weighted("valuation_rate").alias("weighted_yield"), weighted("face_rate").alias("face_yield"))
    return g.withColumn("spread", F.col("weighted_yield") - F.col("face_yield"))


def live(value: Column) -> Column:
    return F.when(F.col("days") > 0, value)


def macaulay() -> Column:
    """Years to maturity, weighted by value, over what has not matured."""
    return ratio(F.sum(live(F.col("market_value") * F.col("days"))), F.sum(live(F.col("market_value")))) / 365


def durations(df: DataFrame, by: list[str]) -> DataFrame:
    """Macaulay (simplified) and modified duration; the yield that discounts is that of all holdings, matured ones included."""
    g = df.groupBy(*by).agg(macaulay().alias("macaulay"), weighted("valuation_rate").alias("y"), F.count_if(F.col("days") > 0).alias("n_live"))
    return g.select(*by, "macaulay", F.when(1 + F.col("y") / 100 > 0, F.col("macaulay") / (1 + F.col("y") / 100)).otherwise(0.0).alias("modified"), "n_live")


def hhi(value: str) -> Column:
    """The Herfindahl-Hirschman index on the scale of 10,000; 0 if the values do not add up to more than 0."""
    total = F.sum(value)
    return F.when(total > 0, ratio(1e4 * F.sum(F.col(value) * F.col(value)), total * total)).otherwise(0.0)


def hhi_category(x: Column, config: FinanceConfig = FinanceConfig()) -> Column:
    return F.when(x < config.hhi_low, "bajo").when(x < config.hhi_high, "moderado").otherwise("alto")


def concentration(holdings: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    g = holdings.groupBy(*by).agg(hhi(value).alias("hhi"), F.count(F.lit(1)).alias("n_holdings"))
    return g.withColumn("category", hhi_category(F.col("hhi")))


TOPS = (1, 3, 5)


def largest(h: DataFrame, by: list[str], value: str = "value", tops: tuple[int, ...] = TOPS) -> DataFrame:
    """(by, t1, t3, t5): the sums of the largest holdings. Ranks are limited before the shuffle, so a hot group sends a few rows from each task."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value)))
    return h.withColumn("_r", rank).where(F.col("_r") <= max(tops)).groupBy(*by).agg(*[F.sum(F.when(F.col("_r") <= n, F.col(value))).alias(f"t{n}") for n in tops])


def exposure(h: DataFrame, by: list[str], value: str = "value", tops: tuple[int, ...] = TOPS) -> DataFrame:
    """The share in percent of the largest 1, 3 and 5 holdings."""
    total = h.groupBy(*by).agg(F.sum(value).alias("total"))
    return total.join(largest(h, by, value, tops), by).select(*by, *[F.when(F.col("total") > 0, 100 * F.col(f"t{n}") / F.col("total")).otherwise(0.0).alias(f"top{n}") for n in tops])


def bucket(days: Column, config: FinanceConfig = FinanceConfig()) -> Column:
    """Half-open maturity buckets."""
    return F.when(days < config.days_short, "<90d").when(days < config.days_medium, "90-365d").when(days < config.days_long, "365d-3a").otherwise(">3a")


def bucket_order(name: Column) -> Column:
    return F.when(name == "<90d", 1).when(name == "90-365d", 2).when(name == "365d-3a", 3).otherwise(4)


def ladder(df: DataFrame, by: list[str]) -> DataFrame:
    """Value and number of live instruments by bucket."""
    g = df.where("days > 0").groupBy(*by, bucket(F.col("days")).alias("bucket")).agg(F.sum("market_value").alias("amount"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ordinal", bucket_order(F.col("bucket")))


def maturities(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(ratio(F.sum(live(F.col("market_value") * F.col("days"))), F.sum(live(F.col("market_value")))).alias("mean_days"), F.count_if(F.col("days") <= 0).alias("n_matured"))


def composition(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, asset, value, pct): shares in percent, none where the total is not above 0."""
    total = F.sum("value").over(Window.partitionBy(*by))
    return df.withColumn("pct", F.when(total > 0, 100 * F.col("value") / total))


def holdings(instruments: DataFrame, funds: DataFrame, cash: DataFrame, positive: bool = False) -> DataFrame:
    """(holder_id, kind, name, value) of all three kinds. positive drops funds and cash that are not above 0, as the Pareto chart does."""
    if positive:
        funds, cash = funds.where("new_balance > 0"), cash.where("total > 0")
    fixed = instruments.select("holder_id", F.lit("RF").alias("kind"), F.col("instrument_id").alias("name"), F.col("market_value").alias("value"))
    return fixed.unionByName(other_holdings(funds, cash))


def other_holdings(funds: DataFrame, cash: DataFrame) -> DataFrame:
    f = funds.select("holder_id", F.lit("FIC").alias("kind"), "name", F.col("new_balance").alias("value"))
    return f.unionByName(cash.select("holder_id", F.lit("Efectivo").alias("kind"), F.lit("Efectivo").alias("name"), F.col("total").alias("value")))


def pareto(h: DataFrame, by: list[str]) -> DataFrame:
    """Share and cumulative share of each holding, the largest first."""
    every, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("value"), "name", "kind")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"total": F.sum("value").over(every), "rank": F.row_number().over(order), "run": F.sum("value").over(upto)}).where("total > 0")
    h = h.withColumn("cumulative_pct", 100 * F.col("run") / F.col("total"))
    return h.select(*by, "kind", "name", "value", "rank", (100 * F.col("value") / F.col("total")).alias("pct"), "cumulative_pct", (F.col("cumulative_pct") <= 80).alias("within_80"))


def suffix_duplicates(df: DataFrame, by: list[str], name: str, order: list[str], empty: str = "CDT") -> DataFrame:
    """Add `label`: names that occur more than once within `by` get ' #k'; empty names a default."""
    n = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(empty)).otherwise(F.col(name))
    d = df.withColumn("_n", n)
    w = Window.partitionBy(*by, "_n")
    label = F.when(F.count(F.lit(1)).over(w) > 1, F.concat("_n", F.lit(" #"), F.row_number().over(w.orderBy(*order)).cast("string"))).otherwise(F.col("_n"))
    return d.withColumn("label", label).drop("_n")


RF_ONLY = ["market_value", "valuation_rate", "face_rate", "days"]


def kpis(instruments: DataFrame, funds: DataFrame, cash: DataFrame, by: list[str]) -> DataFrame:
    """The wide row of a portfolio with instruments: yields, durations, concentration, exposure and maturities.

    All sums come from one pre-aggregated pass over the union of the holdings, in which funds and cash have no rates; only the largest holdings take a second one.
    """
    rest = other_holdings(funds, cash).select(*by, "value", *[F.lit(None).cast(dict(instruments.dtypes)[c]).alias(c) for c in RF_ONLY])
    every = instruments.select(*by, F.col("market_value").alias("value"), *RF_ONLY).unionByName(rest)
    total = F.sum("value")
    g = every.groupBy(*by).agg(
        weighted("valuation_rate").alias("weighted_yield"), weighted("face_rate").alias("face_yield"), macaulay().alias("macaulay"), F.count_if(F.col("days") <= 0).alias("n_matured"), F.count("days").alias("_rf"),
        ratio(F.sum(live(F.col("market_value") * F.col("days"))), F.sum(live(F.col("market_value")))).alias("mean_days"), hhi("value").alias("hhi"), F.count(F.lit(1)).alias("n_holdings"), total.alias("_total"),
    ).where("_rf > 0")
    g = g.withColumns({"spread": F.col("weighted_yield") - F.col("face_yield"), "modified": F.when(1 + F.col("weighted_yield") / 100 > 0, F.col("macaulay") / (1 + F.col("weighted_yield") / 100)).otherwise(0.0), "category": hhi_category(F.col("hhi"))})
    best = largest(every.select(*by, "value"), by)
    share = lambda n: F.when(F.col("_total") > 0, 100 * F.col(f"t{n}") / F.col("_total")).otherwise(0.0).alias(f"top{n}")
    return g.join(best, by).select(*[c for c in g.columns if c[0] != "_"], *[share(n) for n in TOPS])


def status_sharpe(x: Column) -> Column:
    return F.when(x > 1.5, "positive").when(x >= 0, "warning").otherwise("negative")


def status(kpi: Column, x: Column, category: Column) -> Column:
    """The colour class of a dashboard figure."""
    return (
        F.when(kpi == "sharpe", status_sharpe(x)).when(kpi == "max_drawdown", F.when(x < -5, "negative").otherwise("warning")).when(kpi == "real_return", F.when(x > 0, "positive").otherwise("negative"))
        .when(kpi == "hhi", F.when(category == "bajo", "positive").when(category == "moderado", "warning").otherwise("negative")).otherwise("neutral")
    )


def fund_sharpe(returns: DataFrame, by: list[str], config: FinanceConfig = FinanceConfig()) -> DataFrame:
    """From (by, horizon, pct): the annual return, the deviation of the horizons' returns and the Sharpe ratio.

    The annual return is that of the first horizon, in byte order, whose name contains 'ano' or 'ultimo año'; without one, or where it is 0, the mean.
    """
    h = F.lower("horizon")
    yearly = F.contains(h, F.lit("ano")) | F.contains(h, F.lit("ultimo año"))
    g = returns.groupBy(*by).agg(F.min_by(F.when(yearly, F.col("pct")), F.when(yearly, F.col("horizon"))).alias("picked"), F.avg("pct").alias("mean"), or_zero(F.stddev_samp("pct")).alias("sigma"), F.count(F.lit(1)).alias("n_horizons"))
    g = g.select(*by, "n_horizons", F.when(or_zero(F.col("picked")) != 0, F.col("picked")).otherwise(F.col("mean")).alias("annual_return"), "sigma")
    return g.withColumn("sharpe", ratio(F.col("annual_return") - config.risk_free * 100, F.col("sigma")))


def merge_fund_returns(returns: DataFrame, by: list[str], order: str) -> DataFrame:
    """Of several funds' returns for one horizon, the last fund's."""
    return returns.groupBy(*by, "horizon").agg(F.max_by("pct", order).alias("pct"))
