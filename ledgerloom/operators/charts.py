"""The data behind the charts: points, bars, cards and the notes below them. Drawing is left to the reader's tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FinanceConfig
from ..functions.numbers import fixed, format_si
from . import portfolio

#: Days between the points of a curve whose instruments all mature on one day.
STEP = 30
#: A mean time to maturity beyond this many years is taken for an error in the dates.
LONG_YEARS = 30
LEAST_BOX = 5

# fixed values: texts on the charts
MATURED = (" instrumento(s) expirado(s) excluido(s) (vto <= ", " CDT vencido(s) excluido(s)")
CHECK_DATES = "[AVISO: verificar fechas de vencimiento en los datos]"
VERDICTS = {"bajo": "Diversificacion saludable", "moderado": "Concentracion moderada - vigilar", "alto": "Alta concentracion - riesgo"}
CARDS = [
    ("TOTAL PORTAFOLIO", "total_portafolio", "valor de mercado"),
    ("YIELD PONDERADO", "weighted_yield", "TIR del portafolio"),
    ("DURACION MODIFICADA", "modified", "sensibilidad a tasas"),
    ("HHI CONCENTRACION", "hhi", ""),
    ("TOP-3 EXPOSURE", "top3", "concentrado en 3 holdings"),
    ("SHARPE FIC", "sharpe", "rendimiento ajust. riesgo"),
    ("MAX DRAWDOWN", "max_drawdown", "peor caida historica"),
    ("RETORNO REAL", "real_return_pct", "ajustado por inflacion"),
]


def percent(v: Column, digits: int) -> Column:
    return F.concat(fixed(v, digits), F.lit("%"))


def yield_curve(instruments: DataFrame, by: list[str], name: str, order: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, keep, x, rate, label, degenerate): live instruments; where all of a group mature on one day, they are spread out by STEP days in their order."""
    d = portfolio.suffix_duplicates(instruments.where("days > 0"), by, name, order)
    every = Window.partitionBy(*by)
    d = d.withColumn("degenerate", F.max("days").over(every) - F.min("days").over(every) < 1)
    nth = F.row_number().over(every.orderBy(*order)) - 1
    x = F.when(F.col("degenerate"), F.min("days").over(every) + nth * STEP).otherwise(F.col("days"))
    return d.select(*by, *keep, x.alias("x"), F.col("valuation_rate").alias("rate"), "label", "degenerate")


def matured(instruments: DataFrame, by: list[str], as_of: str = "as_of") -> DataFrame:
    """(by, n_expired, note): how many instruments the curve leaves out, as of the column `as_of`."""
    g = instruments.groupBy(*by).agg(F.count_if(F.col("days") <= 0).alias("n_expired"), F.max(as_of).cast("string").alias("day")).where("n_expired > 0")
    return g.select(*by, "n_expired", F.concat(F.lit("Nota: "), F.col("n_expired").cast("string"), F.lit(MATURED[0]), "day", F.lit(")")).alias("note"))


def ladder_notes(instruments: DataFrame, by: list[str]) -> DataFrame:
    """(by, mean_years, n_matured, warns, note): the footer of the maturity ladder."""
    m = portfolio.maturities(instruments, by)
    years = F.col("mean_days") / 365
    note = F.concat(
        F.lit("Vencimiento promedio ponderado: "), fixed(years, 1), F.lit(" anos"),
        F.when(F.col("n_matured") > 0, F.concat(F.lit("  ("), F.col("n_matured").cast("string"), F.lit(MATURED[1] + ")"))).otherwise(F.lit("")),
        F.when(years > LONG_YEARS, F.lit("  " + CHECK_DATES)).otherwise(F.lit("")),
    )
    return m.select(*by, years.alias("mean_years"), "n_matured", (years > LONG_YEARS).alias("warns"), note.alias("note"))


def pareto_names(instruments: DataFrame, funds: DataFrame, cash: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, kind, name, value): instruments in their order, funds and cash above 0. A nameless instrument is RF, a fund FIC, cash is numbered; of holdings that share a name, whatever their kind, each gets its number.

    A number that a name already ends in is dropped first.
    """
    label = lambda c, empty: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(empty)).otherwise(F.col(c))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = [
        instruments.select(*by, F.lit("RF").alias("kind"), label("instrument_id", "RF").alias("name"), F.col("market_value").alias("value"), F.struct(F.lit(1).alias("k"), F.col(order).cast("long").alias("o")).alias("at")),
        funds.where("new_balance > 0").select(*by, F.lit("FIC").alias("kind"), label("name", "FIC").alias("name"), F.col("new_balance").alias("value"), F.struct(F.lit(2).alias("k"), F.col(order).cast("long").alias("o")).alias("at")),
        cash.withColumn("nth", nth).where("total > 0").select(*by, F.lit("Efectivo").alias("kind"), F.concat(F.lit("Efectivo "), F.col("nth").cast("string")).alias("name"), F.col("total").alias("value"), F.struct(F.lit(3).alias("k"), F.col(order).cast("long").alias("o")).alias("at")),
    ]
    h = rows[0].unionByName(rows[1]).unionByName(rows[2])
    h = h.withColumn("base", F.regexp_replace("name", r"(?s) #(?!.* #).*$", ""))
    same = Window.partitionBy(*by, "base")
    name = F.when(F.count(F.lit(1)).over(same) > 1, F.concat("base", F.lit(" #"), F.row_number().over(same.orderBy("at")).cast("string"))).otherwise(F.col("name"))
    return h.select(*by, "kind", name.alias("name"), "value")


def pareto(instruments: DataFrame, funds: DataFrame, cash: DataFrame, by: list[str], order: str) -> DataFrame:
    return portfolio.pareto(pareto_names(instruments, funds, cash, by, order), by)


def concentration_notes(k: DataFrame, by: list[str]) -> DataFrame:
    """(by, subtitle, verdict, status) from rows with hhi, category and the top exposures."""
    subtitle = F.concat(F.lit("HHI = "), fixed(F.col("hhi"), 0), F.lit(" ("), "category", F.lit(")  |  Top-1: "), percent(F.col("top1"), 1), F.lit("  |  Top-3: "), percent(F.col("top3"), 1), F.lit("  |  Top-5: "), percent(F.col("top5"), 1))
    verdict = F.when(F.col("category") == "bajo", VERDICTS["bajo"]).when(F.col("category") == "moderado", VERDICTS["moderado"]).otherwise(VERDICTS["alto"])
    return k.where("category is not null").select(*by, subtitle.alias("subtitle"), verdict.alias("verdict"), portfolio.status(F.lit("hhi"), F.col("hhi"), F.col("category")).alias("status"))


def few_values(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """(by, position, value, name): the single values of groups that are too small for a box, in ascending order."""
    every = Window.partitionBy(*by)
    d = df.select(*by, F.col(x).alias("value"), F.col(name).alias("name"), F.count(F.lit(1)).over(every).alias("n")).where(F.col("n") < LEAST_BOX)
    return d.select(*by, F.row_number().over(every.orderBy("value", "name")).alias("position"), "value", "name")


def parameters(config: FinanceConfig) -> Column:
    """The footer of the dashboard."""
    return F.lit(f"Parametros: tasa libre = {config.risk_free * 100:.2f}%  |  inflacion = {config.inflation * 100:.2f}%  |  benchmark = {config.benchmark * 100:.2f}%")


def cards(k: DataFrame, by: list[str]) -> DataFrame:
    """(by, position, label, kpi, value, shown, sub, status): the eight cards of the dashboard, from rows with their figures."""
    x = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    two = lambda c: fixed(x(c), 2)
    shown = {
        "total_portafolio": F.concat(F.lit("$"), format_si(x("total_portafolio"))), "weighted_yield": percent(x("weighted_yield"), 2), "modified": F.concat(two("modified"), F.lit(" anos")), "hhi": format_si(x("hhi")),
        "top3": percent(x("top3"), 1), "sharpe": two("sharpe"), "max_drawdown": percent(x("max_drawdown"), 2), "real_return_pct": percent(x("real_return_pct"), 2),
    }
    always = {"total_portafolio": "accent", "weighted_yield": "positive", "modified": "warning", "top3": "neutral"}
    category = F.coalesce("category", F.lit(""))
    kind = {"real_return_pct": "real_return"}
    colour = lambda c: F.lit(always[c]) if c in always else portfolio.status(F.lit(kind.get(c, c)), x(c), category)
    each = [
        F.struct(F.lit(n).alias("position"), F.lit(label).alias("label"), F.lit(c).alias("kpi"), x(c).alias("value"), shown[c].alias("shown"), (category if c == "hhi" else F.lit(sub)).alias("sub"), colour(c).alias("status"))
        for n, (label, c, sub) in enumerate(CARDS, 1)
    ]
    return k.select(*by, F.explode(F.array(*each)).alias("c")).select(*by, "c.*")


