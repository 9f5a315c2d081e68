"""Portfolio analytics, series, alerts and chart data over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FinanceConfig
from ..operators import alerts, portfolio, series, stats
from ..sources import views as V
from .base import longs, query, rounded

H = ["holder_id"]
KEY = V.INSTRUMENT_KEY
CONFIG = FinanceConfig()
R = lambda x: f"round({x}, 6) + 0.0::DOUBLE"


def holdings(spark: SparkSession, d: str, positive: bool = False) -> DataFrame:
    return portfolio.holdings(V.instruments(spark, d), V.funds(spark, d), V.cash(spark, d), positive)


HOLDINGS = """holdings AS (SELECT holder_id, 'RF' AS kind, instrument_id AS name, market_value AS value FROM instruments UNION ALL SELECT holder_id, 'FIC', name, new_balance FROM funds UNION ALL SELECT holder_id, 'Efectivo', 'Efectivo', total FROM cash)"""
POSITIVE = """positive AS (SELECT holder_id, 'RF' AS kind, instrument_id AS name, market_value AS value FROM instruments UNION ALL SELECT holder_id, 'FIC', name, new_balance FROM funds WHERE new_balance > 0 UNION ALL SELECT holder_id, 'Efectivo', 'Efectivo', total FROM cash WHERE total > 0)"""
BUCKET = "CASE WHEN days < 90 THEN '<90d' WHEN days < 365 THEN '90-365d' WHEN days < 1095 THEN '365d-3a' ELSE '>3a' END"
YIELDS = "coalesce(sum(market_value * valuation_rate) / nullif(sum(market_value), 0), 0) AS wy, coalesce(sum(market_value * face_rate) / nullif(sum(market_value), 0), 0) AS fy"
LIVE = "coalesce(sum(market_value * days) FILTER (WHERE days > 0) / nullif(sum(market_value) FILTER (WHERE days > 0), 0), 0)"


# ---------------------------------------------------------------- core aggregates


@query(f"""m AS (SELECT holder_id, 'face_rate' AS measure, CASE WHEN face_rate > 0 THEN face_rate END AS x FROM instruments UNION ALL SELECT holder_id, 'negotiated_rate', CASE WHEN negotiated_rate > 0 THEN negotiated_rate END FROM instruments
UNION ALL SELECT holder_id, 'valuation_rate', CASE WHEN valuation_rate > 0 THEN valuation_rate END FROM instruments UNION ALL SELECT holder_id, 'market_value', market_value FROM instruments)
SELECT holder_id, measure, {R('coalesce(avg(x), 0)')} AS mean, {R('coalesce(stddev_samp(x), 0)')} AS std_dev, {R('coalesce(median(x), 0)')} AS median, {R('coalesce(min(x), 0)')} AS min, {R('coalesce(max(x), 0)')} AS max, count(x) AS n FROM m GROUP BY 1, 2""")
def rate_summary_stats(spark, d):
    over = lambda c: F.when(F.col(c) > 0, F.col(c))
    m = {c: over(c) for c in ("face_rate", "negotiated_rate", "valuation_rate")} | {"market_value": F.col("market_value")}
    return rounded(stats.summary(V.instruments(spark, d), H, m), "mean", "std_dev", "median", "min", "max")


@query(f"SELECT holder_id, {R('wy')} AS weighted_yield, {R('fy')} AS face_yield, {R('wy - fy')} AS spread FROM (SELECT holder_id, {YIELDS} FROM instruments GROUP BY 1)")
def weighted_yield(spark, d):
    return rounded(portfolio.yields(V.instruments(spark, d), H), "weighted_yield", "face_yield", "spread")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, instrument_id, {R('valuation_rate - face_rate')} AS spread FROM instruments")
def instrument_spread(spark, d):
    return rounded(V.instruments(spark, d).select(*KEY, "instrument_id", (F.col("valuation_rate") - F.col("face_rate")).alias("spread")), "spread")


@query(f"SELECT holder_id, {R('mac')} AS macaulay, {R('CASE WHEN 1 + wy / 100 > 0 THEN mac / (1 + wy / 100) ELSE 0 END')} AS modified, n_live FROM (SELECT holder_id, {LIVE} / 365 AS mac, {YIELDS}, count(*) FILTER (WHERE days > 0) AS n_live FROM instruments GROUP BY 1)")
def macaulay_duration(spark, d):
    return rounded(portfolio.durations(V.instruments(spark, d), H), "macaulay", "modified")


HHI = "SELECT holder_id, coalesce(CASE WHEN sum(value) > 0 THEN 1e4 * sum(value * value) / (sum(value) * sum(value)) END, 0) AS hhi, count(*) AS n_holdings FROM holdings GROUP BY 1"


@query(f"{HOLDINGS} SELECT holder_id, {R('hhi')} AS hhi, n_holdings, CASE WHEN hhi < 1500 THEN 'bajo' WHEN hhi < 2500 THEN 'moderado' ELSE 'alto' END AS category FROM ({HHI})")
def hhi_concentration(spark, d):
    return rounded(portfolio.concentration(holdings(spark, d), H), "hhi")


TOPS = "SELECT holder_id, t, " + ", ".join(f"CASE WHEN t > 0 THEN 100 * sum(value) FILTER (WHERE r <= {n}) / t ELSE 0 END AS top{n}" for n in (1, 3, 5)) + " FROM (SELECT *, sum(value) OVER (PARTITION BY holder_id) AS t, row_number() OVER (PARTITION BY holder_id ORDER BY value DESC) AS r FROM holdings) GROUP BY 1, 2"


@query(f"{HOLDINGS} SELECT holder_id, {R('top1')} AS top1, {R('top3')} AS top3, {R('top5')} AS top5 FROM ({TOPS})")
def topn_exposure(spark, d):
    return rounded(portfolio.exposure(holdings(spark, d), H), "top1", "top3", "top5")


@query(f"SELECT holder_id, {BUCKET} AS bucket, round(sum(market_value), 2) AS amount, count(*) AS n, CASE {BUCKET} WHEN '<90d' THEN 1 WHEN '90-365d' THEN 2 WHEN '365d-3a' THEN 3 ELSE 4 END AS ordinal FROM instruments WHERE days > 0 GROUP BY 1, 2")
def maturity_ladder(spark, d):
    return rounded(portfolio.ladder(V.instruments(spark, d, live=True), H), "amount", digits=2)


@query(f"SELECT holder_id, {R(LIVE)} AS mean_days, count(*) FILTER (WHERE days <= 0) AS n_matured FROM instruments GROUP BY 1")
def mean_days_to_maturity(spark, d):
    return rounded(portfolio.maturities(V.instruments(spark, d), H), "mean_days")


SHARES = "shares AS (SELECT holder_id, asset, value, 100 * value / nullif(sum(value) OVER (PARTITION BY holder_id), 0) AS pct FROM composition)"


@query(f"{SHARES} SELECT holder_id, asset, value, {R('pct')} AS pct FROM shares")
def portfolio_composition(spark, d):
    return rounded(portfolio.composition(V.composition(spark, d), H), "pct")


@query(f"""{HOLDINGS}, h AS ({HHI}), t AS ({TOPS}), i AS (SELECT holder_id, {YIELDS}, {LIVE} AS md, count(*) FILTER (WHERE days <= 0) AS n_matured FROM instruments GROUP BY 1)
SELECT holder_id, {R('wy')} AS weighted_yield, {R('fy')} AS face_yield, {R('wy - fy')} AS spread, {R('md / 365')} AS macaulay, {R('md / 365 / (1 + wy / 100)')} AS modified, {R('md')} AS mean_days, n_matured, {R('hhi')} AS hhi, n_holdings,
CASE WHEN hhi < 1500 THEN 'bajo' WHEN hhi < 2500 THEN 'moderado' ELSE 'alto' END AS category, {R('top1')} AS top1, {R('top3')} AS top3, {R('top5')} AS top5 FROM i JOIN h USING (holder_id) JOIN t USING (holder_id)""")
def portfolio_kpis(spark, d):
    k = portfolio.kpis(V.instruments(spark, d), V.funds(spark, d), V.cash(spark, d), H)
    return rounded(k, "weighted_yield", "face_yield", "spread", "macaulay", "modified", "mean_days", "hhi", "top1", "top3", "top5")


# ---------------------------------------------------------------- higher moments and charts of rates

Z = "SELECT holder_id, (valuation_rate - avg(valuation_rate) OVER w) / nullif(stddev_samp(valuation_rate) OVER w, 0) AS z, valuation_rate AS x FROM instruments WINDOW w AS (PARTITION BY holder_id)"


@query(f"""z AS ({Z}) SELECT holder_id, count(*) AS n, {R('CASE WHEN count(*) >= 3 THEN coalesce(sum(z * z * z) / count(*), 0) ELSE 0 END')} AS skewness, {R('CASE WHEN count(*) >= 4 AND max(x) > min(x) THEN sum(z * z * z * z) / count(*) - 3 ELSE 0 END')} AS kurtosis FROM z GROUP BY 1""")
def skew_kurtosis(spark, d):
    g = V.instruments(spark, d).groupBy(*H).agg(F.count("valuation_rate").alias("n"), stats.skewness("valuation_rate").alias("skewness"), stats.kurtosis("valuation_rate").alias("kurtosis"))
    return rounded(g, "skewness", "kurtosis")


@query(f"""SELECT holder_id, {R('CASE WHEN count(*) >= 2 THEN coalesce(stddev_samp(valuation_rate) / nullif(avg(valuation_rate), 0), 0) ELSE 0 END')} AS cv, {R('CASE WHEN count(*) >= 2 THEN avg(valuation_rate) - 1.96 * stddev_samp(valuation_rate) / sqrt(count(*)) ELSE 0 END')} AS ci_low,
{R('CASE WHEN count(*) >= 2 THEN avg(valuation_rate) + 1.96 * stddev_samp(valuation_rate) / sqrt(count(*)) ELSE 0 END')} AS ci_high FROM instruments GROUP BY 1""")
def cv_ci95(spark, d):
    x = "valuation_rate"
    return rounded(V.instruments(spark, d).groupBy(*H).agg(stats.variation(x).alias("cv"), stats.interval95(x, -1).alias("ci_low"), stats.interval95(x, 1).alias("ci_high")), "cv", "ci_low", "ci_high")


@query(f"""s AS (SELECT holder_id, valuation_rate AS x, row_number() OVER (PARTITION BY holder_id ORDER BY valuation_rate) - 1 AS r, count(*) OVER (PARTITION BY holder_id) AS n FROM instruments),
q AS (SELECT holder_id, n, min(x) AS lo, max(x) AS hi, max(x) FILTER (WHERE r = n // 4) AS q1, max(x) FILTER (WHERE r = 3 * n // 4) AS q3, median(x) AS m FROM s WHERE n >= 5 GROUP BY 1, 2),
b AS (SELECT *, q3 - q1 AS iqr, greatest(q1 - 1.5 * (q3 - q1), lo) AS low, least(q3 + 1.5 * (q3 - q1), hi) AS high FROM q)
SELECT b.holder_id, b.n, {R('q1')} AS q1, {R('m')} AS median, {R('q3')} AS q3, {R('iqr')} AS iqr, {R('low')} AS low, {R('high')} AS high, count(*) FILTER (WHERE x < low OR x > high) AS n_outliers FROM b JOIN s USING (holder_id) GROUP BY ALL""")
def boxplot_quartiles(spark, d):
    return rounded(stats.boxplot(V.instruments(spark, d), H, "valuation_rate"), "q1", "median", "q3", "iqr", "low", "high")


@query("SELECT holder_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, days, round(valuation_rate, 6) AS rate, CASE WHEN count(*) OVER (PARTITION BY holder_id, instrument_id) > 1 THEN instrument_id || ' #' || row_number() OVER (PARTITION BY holder_id, instrument_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) ELSE instrument_id END AS label, row_number() OVER (PARTITION BY holder_id ORDER BY days, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS position FROM instruments WHERE days > 0")
def yield_curve_points(spark, d):
    """Live instruments by days to maturity, with labels that are unique within the holder."""
    p = portfolio.suffix_duplicates(V.instruments(spark, d, live=True), H, "instrument_id", KEY)
    p = p.withColumn("position", F.row_number().over(stats.Window.partitionBy(*H).orderBy("days", *KEY)))
    return longs(p.select(*H, *KEY, "days", F.round("valuation_rate", 6).alias("rate"), "label", "position"), "position")


@query(f"SELECT holder_id, n, round(slope, 9) + 0.0::DOUBLE AS slope, {R('icept')} AS intercept, {R('r2')} AS r2 FROM (SELECT holder_id, count(*) AS n, regr_slope(valuation_rate, days) AS slope, regr_intercept(valuation_rate, days) AS icept, CASE WHEN min(valuation_rate) = max(valuation_rate) THEN 0 ELSE regr_r2(valuation_rate, days) END AS r2, max(days) - min(days) AS spread FROM instruments WHERE days > 0 GROUP BY 1) WHERE n >= 3 AND spread >= 1")
def yield_curve_regression(spark, d):
    r = stats.regression(V.instruments(spark, d, live=True), H, "valuation_rate", "days")
    return rounded(rounded(r, "intercept", "r2"), "slope", digits=9)


# ---------------------------------------------------------------- series

PEAKS = "p AS (SELECT segment, period, total, row_number() OVER w - 1 AS position, max(total) OVER w AS peak FROM history WHERE total > 0 WINDOW w AS (PARTITION BY segment ORDER BY period ROWS UNBOUNDED PRECEDING))"
S = ["segment"]


@query(f"{PEAKS} SELECT segment, period, total, position, peak, {R('100 * (total - peak) / peak')} AS drawdown FROM p", dates=("period",))
def running_peak_drawdown(spark, d):
    return rounded(longs(series.drawdowns(V.history(spark, d), S), "position"), "drawdown")


@query(f"{PEAKS} SELECT segment, count(*) AS n, {R('CASE WHEN count(*) >= 2 THEN min(100 * (total - peak) / peak) ELSE 0 END')} AS max_drawdown, {R('CASE WHEN count(*) >= 2 THEN 100 * (arg_max(total, period) - max(total)) / max(total) ELSE 0 END')} AS current_drawdown FROM p GROUP BY 1")
def max_drawdown(spark, d):
    return rounded(series.max_drawdown(V.history(spark, d), S), "max_drawdown", "current_drawdown")


GROWN = "g AS (SELECT segment, count(*) AS n, arg_max(total, period) / arg_min(total, period) AS r FROM history WHERE total > 0 GROUP BY 1)"


@query(f"{GROWN} SELECT segment, n, {R('CASE WHEN n >= 2 THEN 100 * (r - 1) ELSE 0 END')} AS growth_pct, {R('CASE WHEN n >= 2 THEN 100 * (pow(r, 12::DOUBLE / (n - 1)) - 1) ELSE 0 END')} AS annualized_pct FROM g")
def growth_annualized(spark, d):
    return rounded(series.growth(V.history(spark, d), S), "growth_pct", "annualized_pct")


@query(f"{GROWN} SELECT segment, {R('100 * (pow(r, 12::DOUBLE / (n - 1)) / 1.048::DOUBLE - 1)')} AS real_return_pct FROM g WHERE n >= 2")
def fisher_real_return(spark, d):
    return rounded(series.real_return(series.growth(V.history(spark, d), S).where("n >= 2")).select("segment", "real_return_pct"), "real_return_pct")


@query(f"SELECT segment, count(*) AS n, {R('100 * (arg_max(total, period) - arg_min(total, period)) / arg_min(total, period)')} AS change_pct, 'INFO' AS type FROM history GROUP BY 1 HAVING count(*) >= 2 AND arg_min(total, period) > 0")
def trend_alert(spark, d):
    return rounded(series.trend(V.history(spark, d), S), "change_pct")


# ---------------------------------------------------------------- funds and accounts

SHARPE = "f AS (SELECT holder_id, count(*) AS n_horizons, coalesce(nullif(arg_min(pct, horizon) FILTER (WHERE lower(horizon) LIKE '%ano%' OR lower(horizon) LIKE '%ultimo año%'), 0), avg(pct)) AS ar, coalesce(stddev_samp(pct), 0) AS sigma FROM fund_returns GROUP BY 1)"


@query(f"{SHARPE} SELECT holder_id, n_horizons, {R('ar')} AS annual_return, {R('sigma')} AS sigma, {R('coalesce((ar - 9.25) / nullif(sigma, 0), 0)')} AS sharpe FROM f")
def fund_sharpe(spark, d):
    return rounded(portfolio.fund_sharpe(V.fund_returns(spark, d), H), "annual_return", "sigma", "sharpe")


@query("SELECT event_type AS horizon, user_id % 100 AS holder_id, round(arg_max(value, user_id), 6) AS pct FROM (SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2) GROUP BY 1, 2")
def fund_returns_merge(spark, d):
    """Users modulo 100 stand for holders with several funds each; the fund of the largest id wins per horizon."""
    e = V.table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("horizon")).agg(F.max("value").alias("pct"))
    return rounded(portfolio.merge_fund_returns(e.withColumn("holder_id", F.col("user_id") % 100), H, "user_id"), "pct")


@query("SELECT account_id, round(sum(debit), 6) AS debits, round(sum(credit), 6) AS credits, count(*) AS n, round(sum(credit) - sum(debit), 6) + 0.0::DOUBLE AS net FROM transactions GROUP BY 1")
def account_totals(spark, d):
    return rounded(series.account_totals(V.transactions(spark, d), ["account_id"]), "debits", "credits", "net")


@query("SELECT account_id, event_id, round(sum(credit - debit) OVER (PARTITION BY account_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) + 0.0::DOUBLE AS balance FROM transactions")
def account_running_balance(spark, d):
    """An extension: the balance after each transaction."""
    return rounded(series.running_balance(V.transactions(spark, d), ["account_id"], ["ts", "event_id"]).select("account_id", "event_id", "balance"), "balance")


# ---------------------------------------------------------------- alerts and quality

OUT = "o AS (SELECT *, avg(valuation_rate) OVER w AS m, stddev_samp(valuation_rate) OVER w AS s, count(*) OVER w AS n FROM instruments WHERE valuation_rate > 0 WINDOW w AS (PARTITION BY holder_id)), hits AS (SELECT * FROM o WHERE n >= 3 AND s >= 1e-9 AND abs(valuation_rate - m) > 2.0 * s)"
KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"{OUT} SELECT holder_id, {KEYS}, instrument_id, round(valuation_rate, 6) AS valuation_rate FROM hits")
def outlier_alerts(spark, d):
    return rounded(alerts.outliers(V.instruments(spark, d), KEY), "valuation_rate")


@query(f"{OUT}, a AS (SELECT {KEYS}, row_number() OVER (PARTITION BY holder_id ORDER BY {KEYS}) AS pos FROM instruments WHERE valuation_rate > 0), b AS (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY {KEYS}) AS pos FROM instruments), h AS (SELECT hits.holder_id, pos FROM hits JOIN a USING ({KEYS})) SELECT holder_id, {KEYS}, instrument_id, round(valuation_rate, 6) + 0.0::DOUBLE AS valuation_rate FROM b JOIN h USING (holder_id, pos)")
def outlier_alerts_compat(spark, d):
    return rounded(alerts.outliers(V.instruments(spark, d), KEY, compat=True), "valuation_rate")


@query(f"{SHARES} SELECT holder_id, asset, value, {R('pct')} AS pct FROM shares WHERE pct > 80")
def concentration_alerts(spark, d):
    return rounded(alerts.concentrated(portfolio.composition(V.composition(spark, d), H)), "pct")


@query(f"SELECT holder_id, {KEYS}, instrument_id, round(face_rate, 6) AS face_rate FROM instruments WHERE face_rate > 0 AND face_rate < 5")
def low_rate_alerts(spark, d):
    return rounded(alerts.low_rates(V.instruments(spark, d)).select(*H, *KEY, "instrument_id", "face_rate"), "face_rate")


@query("SELECT holder_id, name, round(returns, 6) AS returns FROM funds WHERE returns < 0")
def negative_fund_alerts(spark, d):
    return rounded(alerts.negative_returns(V.funds(spark, d)).select("holder_id", "name", "returns"), "returns")


@query(f"""{OUT}, {SHARES} SELECT holder_id, 1 AS seq, 'WARNING' AS type, 'Tasa de valoracion atipica en ' || instrument_id || ': ' || printf('%.6f', valuation_rate) || '%' AS message FROM hits UNION ALL SELECT holder_id, 2, 'WARNING', 'Alta concentracion en ' || asset || ': ' || printf('%.6f', pct) || '%' FROM shares WHERE pct > 80
UNION ALL SELECT holder_id, 3, 'CRITICAL', 'Rendimiento negativo en fondo: ' || name FROM funds WHERE returns < 0 UNION ALL SELECT holder_id, 4, 'INFO', 'Tasa facial baja en ' || instrument_id || ': ' || printf('%.6f', face_rate) || '%' FROM instruments WHERE face_rate > 0 AND face_rate < 5""")
def alerts_all(spark, d):
    return alerts.messages(V.instruments(spark, d), KEY, portfolio.composition(V.composition(spark, d), H), V.funds(spark, d))


@query("""i AS (SELECT holder_id, sum(market_value) AS s FROM instruments GROUP BY 1), st AS (SELECT c_custkey AS holder_id, c_name AS client, c_acctbal AS total, s FROM customer LEFT JOIN i ON holder_id = c_custkey)
SELECT holder_id, 'Nombre del cliente no encontrado' AS rule, '' AS detail FROM st WHERE coalesce(client, '') = '' UNION ALL SELECT holder_id, 'Total portafolio es 0 o negativo', '' FROM st WHERE NOT total > 0 UNION ALL SELECT holder_id, 'No se encontraron instrumentos de renta fija', '' FROM st WHERE s IS NULL
UNION ALL SELECT holder_id, 'Suma de activos difiere del total en mas del 5%', '' FROM st WHERE total * 100 > 0 AND abs(s - total * 100) > 0.05 * total * 100 UNION ALL SELECT holder_id, 'Instrumento tiene valor mercado <= 0', instrument_id FROM instruments WHERE NOT market_value > 0""")
def validate_rules(spark, d):
    """Customers as statements: the balance is the total, and a hundred times it what the assets should add up to."""
    i = V.instruments(spark, d)
    sums = i.groupBy("holder_id").agg(F.sum("market_value").alias("assets_sum"))
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("holder_id"), F.col("c_name").alias("client"), F.col("c_acctbal").alias("total"), (F.col("c_acctbal") * 100).alias("total_assets"))
    return alerts.validate(c.join(sums, "holder_id", "left"), i)


# ---------------------------------------------------------------- holdings and chart data


@query(f"{HOLDINGS} SELECT * FROM holdings")
def holdings_union(spark, d):
    return holdings(spark, d)


@query(f"""{POSITIVE}, p AS (SELECT *, sum(value) OVER (PARTITION BY holder_id) AS t, row_number() OVER w AS rank, 100 * sum(value) OVER (PARTITION BY holder_id ORDER BY value DESC, name, kind ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY holder_id) AS c FROM positive WINDOW w AS (PARTITION BY holder_id ORDER BY value DESC, name, kind))
SELECT holder_id, kind, name, value, rank, {R('100 * value / t')} AS pct, {R('c')} AS cumulative_pct, round(c, 6) <= 80 AS within_80 FROM p WHERE t > 0""")
def pareto_cumulative(spark, d):
    p = rounded(portfolio.pareto(holdings(spark, d, positive=True), H), "pct", "cumulative_pct")
    return longs(p.withColumn("within_80", F.col("cumulative_pct") <= 80), "rank")


@query(f"SELECT holder_id, {KEYS}, CASE WHEN count(*) OVER (PARTITION BY holder_id, payment_frequency) > 1 THEN payment_frequency || ' #' || row_number() OVER (PARTITION BY holder_id, payment_frequency ORDER BY {KEYS}) ELSE payment_frequency END AS label FROM instruments")
def dedup_names(spark, d):
    return portfolio.suffix_duplicates(V.instruments(spark, d), H, "payment_frequency", KEY).select(*H, *KEY, "label")


@query(f"""{HOLDINGS}, h AS ({HHI}), i AS (SELECT holder_id, {YIELDS}, {LIVE} AS md FROM instruments GROUP BY 1), {SHARPE},
k AS (SELECT holder_id, 'weighted_yield' AS kpi, wy AS value, 'neutral' AS status FROM i UNION ALL SELECT holder_id, 'macaulay', md / 365, 'neutral' FROM i UNION ALL SELECT holder_id, 'modified', md / 365 / (1 + wy / 100), 'neutral' FROM i UNION ALL SELECT holder_id, 'spread', wy - fy, 'neutral' FROM i
UNION ALL SELECT holder_id, 'hhi', hhi, CASE WHEN hhi < 1500 THEN 'positive' WHEN hhi < 2500 THEN 'warning' ELSE 'negative' END FROM h JOIN (SELECT holder_id FROM i) USING (holder_id)
UNION ALL SELECT holder_id, 'sharpe', sh, CASE WHEN sh > 1.5 THEN 'positive' WHEN sh >= 0 THEN 'warning' ELSE 'negative' END FROM (SELECT holder_id, coalesce((ar - 9.25) / nullif(sigma, 0), 0) AS sh FROM f JOIN (SELECT holder_id FROM i) USING (holder_id)))
SELECT holder_id, kpi, {R('value')} AS value, status FROM k""")
def dashboard_kpis(spark, d):
    """The dashboard's figures, one row each, with their colour class."""
    k = portfolio.kpis(V.instruments(spark, d), V.funds(spark, d), V.cash(spark, d), H).join(portfolio.fund_sharpe(V.fund_returns(spark, d), H).select(*H, "sharpe"), H, "left")
    names = ["weighted_yield", "macaulay", "modified", "spread", "hhi", "sharpe"]
    rows = k.select(*H, "category", F.explode(F.array(*[F.struct(F.lit(n).alias("kpi"), F.col(n).alias("value")) for n in names])).alias("x")).select(*H, "x.kpi", "x.value", "category").where("value is not null")
    return rounded(rows.select(*H, "kpi", "value", portfolio.status(F.col("kpi"), F.col("value"), F.col("category")).alias("status")), "value")


# ---------------------------------------------------------------- extensions


@query(f"SELECT holder_id, {BUCKET} AS bucket, round(sum(market_value), 2) AS amount, count(*) AS n FROM instruments WHERE days > 0 GROUP BY ROLLUP (1, 2)")
def ladder_rollup(spark, d):
    """An extension: the ladder with subtotals by holder and overall."""
    g = V.instruments(spark, d, live=True).withColumn("bucket", portfolio.bucket(F.col("days"))).rollup("holder_id", "bucket").agg(F.sum("market_value").alias("amount"), F.count(F.lit(1)).alias("n"))
    return rounded(g, "amount", digits=2)


@query(f"SELECT payment_frequency, {BUCKET} AS bucket, round(sum(market_value), 2) AS amount, count(DISTINCT instrument_id) AS n_instruments FROM instruments WHERE days > 0 GROUP BY CUBE (1, 2)")
def ladder_cube(spark, d):
    """An extension: the ladder by payment frequency and bucket, with all subtotals."""
    g = V.instruments(spark, d, live=True).withColumn("bucket", portfolio.bucket(F.col("days"))).cube("payment_frequency", "bucket").agg(F.sum("market_value").alias("amount"), F.countDistinct("instrument_id").alias("n_instruments"))
    return rounded(g, "amount", digits=2)
