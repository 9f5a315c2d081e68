"""The whole analysis of JSON statements: one wide row per statement, its alerts, the data behind the charts, and exports.

Statements, however many, are processed together; each step is grouped by the statement key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FinanceConfig
from ..functions.numbers import or_zero, ratio
from ..operators import alerts, charts, portfolio, series, stats
from ..sources import statement
from . import reports, sinks

ID = ["statement_id"]


class Analysis:
    """Tables of a set of statements. `statements` has statement_id and the statement's fields; `history` has statement_id, period and total.

    Statements without a date are judged as of today.
    """

    def __init__(self, statements: DataFrame, history: DataFrame | None = None, config: FinanceConfig = FinanceConfig()):
        self.config = config
        self.statements = statements
        self.header = statement.header(statements, *ID)
        as_of = self.header.select(*ID, F.coalesce("fecha_extracto", F.current_date()).alias("as_of"))
        days = F.coalesce(F.datediff("maturity_date", "as_of"), F.lit(0))
        self.instruments = statement.instruments(statements, *ID).join(as_of, ID).withColumn("days", days).withColumn("holder_id", F.col("statement_id"))
        self.funds = statement.funds(statements, *ID)
        self.cash = statement.cash(statements, *ID)
        self.accounts = statement.accounts(statements, *ID)
        self.transactions = statement.transactions(statements, *ID)
        own = self.header.select(*ID, F.coalesce("fecha_extracto", F.current_date()).alias("period"), F.col("total_portafolio").alias("total"))
        self.series = own if history is None else history.select(*ID, "period", "total").unionByName(own)

    def holdings(self, positive: bool = False) -> DataFrame:
        f = self.funds.select(F.col("statement_id").alias("holder_id"), "name", "new_balance")
        c = self.cash.select(F.col("statement_id").alias("holder_id"), "total")
        return portfolio.holdings(self.instruments, f, c, positive).withColumnRenamed("holder_id", "statement_id")

    def composition(self) -> DataFrame:
        d = self.header.select(*ID, F.col("total_portafolio").alias("total"), F.explode("activos").alias("asset", "value"))
        return d.where("total > 0").select(*ID, "asset", "value", (100 * F.col("value") / F.col("total")).alias("pct"))

    def summaries(self) -> DataFrame:
        over = lambda c: F.when(F.col(c) > 0, F.col(c))
        return stats.summary(self.instruments, ID, {c: over(c) for c in ("valuation_rate", "negotiated_rate", "face_rate", "market_value")})

    def fund_returns(self, first_only: bool = False) -> DataFrame:
        """(statement_id, horizon, pct): of the first fund, or merged over all, where the last one wins."""
        if first_only:
            first = self.funds.groupBy(*ID).agg(F.min_by("returns_by_horizon", "pos").alias("returns_by_horizon"))
            return first.select(*ID, F.explode("returns_by_horizon").alias("horizon", "pct"))
        return portfolio.merge_fund_returns(self.funds.select(*ID, "pos", F.explode("returns_by_horizon").alias("horizon", "pct")), ID, "pos")

    def spreads(self) -> DataFrame:
        """(statement_id, spreads): valuation less face rate by instrument name, of statements whose values add up to more than 0; of rows that share a name the last one's."""
        own = F.coalesce("instrument_id", F.lit(""))
        last = self.instruments.groupBy(*ID, own.alias("name")).agg(F.max_by(F.col("valuation_rate") - F.col("face_rate"), "pos").alias("s"), F.sum("market_value").alias("value"))
        g = last.groupBy(*ID).agg(F.array_sort(F.collect_list(F.struct("name", "s"))).alias("all"), F.sum("value").alias("value"))
        return g.where("value > 0").select(*ID, F.map_from_entries("all").alias("spreads"))

    def kpis(self) -> DataFrame:
        """The wide row; figures that a statement has no basis for are 0."""
        rf = self.instruments.groupBy(*ID).agg(
            portfolio.weighted("valuation_rate").alias("weighted_yield"), portfolio.weighted("face_rate").alias("face_yield"), portfolio.macaulay().alias("macaulay"), F.count_if(F.col("days") <= 0).alias("n_matured"),
            ratio(F.sum(portfolio.live(F.col("market_value") * F.col("days"))), F.sum(portfolio.live(F.col("market_value")))).alias("mean_days"), stats.skewness("valuation_rate").alias("skewness"), stats.kurtosis("valuation_rate").alias("kurtosis"),
            stats.variation("valuation_rate").alias("cv"), stats.interval95("valuation_rate", -1).alias("ci_low"), stats.interval95("valuation_rate", 1).alias("ci_high"),
        )
        ladder = portfolio.ladder(self.instruments, ID).groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "amount"))).alias("ladder"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("ladder_counts"))
        h = self.holdings()
        parts = [
            rf, self.spreads(), ladder, portfolio.concentration(h, ID), portfolio.exposure(h, ID), portfolio.fund_sharpe(self.fund_returns(first_only=True), ID, self.config), series.max_drawdown(self.series, ID).drop("n"), series.growth(self.series, ID).withColumnRenamed("n", "n_points"),
        ]
        out = self.header.select(*ID, "nombre_cliente", "fecha_extracto", "total_portafolio")
        for p in parts:
            out = out.join(p, ID, "left")
        out = out.withColumns({"spread": F.col("weighted_yield") - F.col("face_yield"), "modified": F.when(1 + F.col("weighted_yield") / 100 > 0, F.col("macaulay") / (1 + F.col("weighted_yield") / 100)).otherwise(0.0)})
        nominal = F.when(or_zero(F.col("annualized_pct")) != 0, F.col("annualized_pct")).otherwise(or_zero(F.col("annual_return")))
        out = out.withColumn("real_return_pct", series.fisher(nominal, self.config))
        return out.na.fill(0.0, [c for c, t in out.dtypes if t == "double"])

    def alerts(self) -> DataFrame:
        """(statement_id, seq, type, message) in order of the rules, growth last."""
        shares = self.composition().withColumnRenamed("statement_id", "holder_id")
        a = alerts.messages(self.instruments, ["pos"], shares, self.funds.withColumnRenamed("statement_id", "holder_id")).withColumnRenamed("holder_id", "statement_id")
        t = series.trend(self.series, ID)
        return a.unionByName(t.select(*ID, F.lit(5).alias("seq"), "type", alerts.growth_message("change_pct", "n").alias("message")))

    def findings(self) -> DataFrame:
        total = F.aggregate(F.map_values("activos"), F.lit(0.0), lambda a, v: a + v)
        s = self.header.select(F.col("statement_id").alias("holder_id"), F.col("nombre_cliente").alias("client"), F.col("total_portafolio").alias("total"), F.col("total_activos").alias("total_assets"), total.alias("assets_sum"))
        return alerts.validate(s, self.instruments).withColumnRenamed("holder_id", "statement_id")

    def charts(self) -> dict[str, DataFrame]:
        """The data sets behind the six charts, with their notes."""
        live = self.instruments.where("days > 0")
        k = self.kpis()
        spread_out = live.groupBy(*ID).agg((F.max("days") - F.min("days")).alias("width")).where("width >= 1").select(*ID)
        return {
            "yield_curve": charts.yield_curve(self.instruments, ID, "instrument_id", ["pos"], keep=("days", "valuation_rate")),
            "yield_notes": charts.matured(self.instruments, ID),
            "yield_regression": stats.regression(live.join(spread_out, ID, "left_semi"), ID, "valuation_rate", "days"),
            "ladder": portfolio.ladder(self.instruments, ID),
            "ladder_notes": charts.ladder_notes(self.instruments, ID),
            "pareto": charts.pareto(self.instruments, self.funds, self.cash, ID, "pos"),
            "pareto_notes": charts.concentration_notes(k, ID),
            "boxplot": stats.boxplot(self.instruments, ID, "valuation_rate"),
            "boxplot_values": charts.few_values(self.instruments, ID, "valuation_rate", "instrument_id"),
            "drawdown": series.drawdowns(self.series, ID),
            "dashboard": charts.cards(k, ID),
            "dashboard_notes": k.select(*ID, charts.parameters(self.config).alias("note")),
        }

    def export(self, folder: str) -> list[str]:
        """CSV reports, and the analysis and the whole statement as JSON; returns the paths."""
        paths = sinks.export_all(folder, self.header, self.instruments, self.funds, self.alerts(), reports.analysis_lines(self))
        return [*paths, sinks.write_json_text(reports.analysis_json(self), f"{folder}/analysis"), sinks.write_json_text(reports.statement_json(self), f"{folder}/extracto_json")]
