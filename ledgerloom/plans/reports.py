"""Reports of analysed statements: the analysis as CSV lines and as JSON, the whole statement as JSON, and the rows of the report grids.

Every report is a table keyed by statement; texts are made by column functions within the row or after one grouping by statement.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed, format_cop_money, format_cop_percent
from ..functions.text import escape_csv

if TYPE_CHECKING:
    from .analysis import Analysis

ID = ["statement_id"]
# fixed values: headings and names in the reports
COMPOSITION, RATES, ALERTS = ("Composicion del Portafolio", "Activo,Porcentaje (%)"), ("Estadisticas de Tasas", "Metrica,Media,Desv.Est,Mediana,Min,Max,N"), ("Alertas", "Tipo,Mensaje")
MEASURES = {"valuation_rate": "Tasa Valoracion", "negotiated_rate": "Tasa Negociacion", "face_rate": "Tasa Facial", "market_value": "Valor Mercado"}
STATISTICS = {"valuation_rate": "tasas_valoracion", "negotiated_rate": "tasas_negociacion", "face_rate": "tasas_faciales", "market_value": "valores_mercado"}
FIGURES = {
    "yield_ponderado_pct": "weighted_yield", "yield_facial_ponderado_pct": "face_yield", "spread_promedio_pct": "spread", "duracion_macaulay_anos": "macaulay", "duracion_modificada": "modified", "hhi": "hhi",
    "hhi_categoria": "category", "top1_exposure_pct": "top1", "top3_exposure_pct": "top3", "top5_exposure_pct": "top5", "vencimientos_buckets": "ladder", "vencimientos_count": "ladder_counts",
    "dias_promedio_vencimiento": "mean_days", "spread_por_cdt_pct": "spreads", "sharpe_fic": "sharpe", "rentab_fic_anual_pct": "annual_return", "sigma_fic_pct": "sigma", "max_drawdown_pct": "max_drawdown",
    "current_drawdown_pct": "current_drawdown", "crecimiento_periodo_pct": "growth_pct", "crecimiento_anualizado_pct": "annualized_pct", "retorno_real_pct": "real_return_pct", "skewness_tasas": "skewness",
    "kurtosis_tasas": "kurtosis", "cv_tasas": "cv", "ci95_lower": "ci_low", "ci95_upper": "ci_high",
}


def two(x: Column | str) -> Column:
    return fixed(F.col(x) if isinstance(x, str) else x, 2)


def ordered(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """(statement_id, name): the values of each statement as one array in the order of these columns."""
    item = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], value.alias("v"))
    return df.groupBy(*ID).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))


def analysis_lines(a: Analysis) -> DataFrame:
    """(statement_id, seq, line): the CSV report of a statement: composition by asset, statistics of the rates and values, alerts."""
    shares = ordered(a.composition(), ["asset"], F.concat(escape_csv(F.col("asset")), F.lit(","), two("pct")), "shares")
    row = F.concat_ws(",", *[two(c) for c in ("mean", "std_dev", "median", "min", "max")], F.col("n").cast("string"))
    rows = a.summaries().groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("measure", row.alias("v")))).alias("rates"))
    alerts = ordered(a.alerts(), ["seq", "message"], F.concat(escape_csv(F.col("type")), F.lit(","), escape_csv(F.col("message"))), "alerts")
    d = a.header.select(*ID)
    for part in (shares, rows, alerts):
        d = d.join(part, ID, "left")
    none = F.array().cast("array<string>")
    zero = F.lit("0.00,0.00,0.00,0.00,0.00,0")
    stats = F.array(*[F.concat(F.lit(f"{shown},"), F.coalesce(F.try_element_at("rates", F.lit(m)), zero)) for m, shown in MEASURES.items()])
    lines = F.concat(F.array(*map(F.lit, COMPOSITION)), F.coalesce("shares", none), F.array(F.lit(""), *map(F.lit, RATES)), stats, F.array(F.lit(""), *map(F.lit, ALERTS)), F.coalesce("alerts", none))
    return d.select(*ID, F.posexplode(lines).alias("seq", "line"))


def analysis_json(a: Analysis) -> DataFrame:
    """(statement_id, json): composition, statistics, fund returns, alerts and all figures of each statement."""
    d = a.kpis()
    d = d.join(a.composition().groupBy(*ID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "pct")))).alias("_shares")), ID, "left")
    d = d.join(a.fund_returns().groupBy(*ID).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("horizon", "pct")))).alias("_returns")), ID, "left")
    d = d.join(a.summaries().groupBy(*ID).agg(F.map_from_entries(F.collect_list(F.struct("measure", F.struct("mean", "std_dev", "median", "min", "max", F.col("n").alias("count"))))).alias("_rates")), ID, "left")
    d = d.join(ordered(a.alerts(), ["seq", "message"], F.struct("type", "message"), "_alerts"), ID, "left")
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("mean", "std_dev", "median", "min", "max")], F.lit(0).cast("long").alias("count"))
    amounts, counts = F.create_map().cast("map<string,double>"), F.create_map().cast("map<string,bigint>")
    empty = {"ladder": amounts, "ladder_counts": counts, "spreads": amounts, "category": F.lit("")}
    figures = F.struct(
        *[(F.coalesce(F.col(c), empty[c]) if c in empty else F.col(c)).alias(n) for n, c in FIGURES.items()],
        F.struct(F.lit(a.config.risk_free).alias("tasa_libre_riesgo"), F.lit(a.config.inflation).alias("inflacion_anual"), F.lit(a.config.benchmark).alias("benchmark_rendto")).alias("config"),
    )
    tree = F.struct(
        F.coalesce("_shares", amounts).alias("composicion_porcentaje"),
        *[F.coalesce(F.try_element_at("_rates", F.lit(m)), none).alias(n) for m, n in STATISTICS.items()],
        F.coalesce("_returns", amounts).alias("rendimientos_fic"),
        F.coalesce("_alerts", F.array().cast("array<struct<type:string,message:string>>")).alias("alertas"),
        figures.alias("avanzadas"),
    )
    return d.select(*ID, F.to_json(tree).alias("json"))


def blank(c: Column) -> Column:
    """Null, which JSON leaves out, for an empty text."""
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def account_struct(s: Column) -> Column:
    """An account of a transactions section: its items, and its totals where it has any."""
    item = lambda i: F.struct(i["date"].alias("date"), i["value_date"].alias("value_date"), F.coalesce(i["description"], F.lit("")).alias("description"), blank(i["reference"]).alias("reference"), blank(i["category"]).alias("category"), *[F.coalesce(i[c], F.lit(0.0)).alias(c) for c in ("debit", "credit")], i["balance_after"].alias("balance_after"))
    totals = F.when(s["totals"].isNotNull(), F.struct(*[F.coalesce(s["totals"][c], F.lit(0.0)).alias(c) for c in ("debits", "credits", "net", "ending_balance")]))
    return F.struct(
        F.coalesce(s["account_id"], F.lit("")).alias("account_id"), blank(s["account_type"]).alias("account_type"), blank(s["title"]).alias("title"), F.coalesce(s["currency"], F.lit("COP")).alias("currency"),
        F.transform(F.coalesce(s["items"], F.array()), item).alias("items"), totals.alias("totals"),
    )


def section_of(kind: str) -> Column:
    return F.filter(F.coalesce("sections", F.array()), lambda s: s["section_type"] == kind)


def accounts_json(statements: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, account_id, json): every account of the statements' transactions sections with its totals."""
    a = statements.select(*keys, F.posexplode(section_of("transactions")).alias("pos", "s"))
    return a.select(*keys, "pos", F.col("s.account_id").alias("account_id"), F.to_json(account_struct(F.col("s"))).alias("json"))


def statement_json(a: Analysis) -> DataFrame:
    """(statement_id, json): the whole statement: summary, cash, instruments, funds, accounts and currency. Only the header is joined; all else is made within the statement's row."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = lambda c: F.coalesce(c, F.lit(0.0))
    items = lambda kind: F.flatten(F.transform(section_of(kind), lambda s: F.coalesce(s["items"], F.array())))
    who = F.col("account_holder")
    d = a.statements.join(a.header.select(*ID, "fecha_extracto", "nombre_cliente", "nit", "ciudad", F.col("currency").alias("_currency"), "activos", "total_activos", "total_pasivos", "total_portafolio"), ID)
    summary = F.struct(
        text(F.col("fecha_extracto")).alias("fecha_extracto"), "nombre_cliente", "nit", text(who["address"]).alias("direccion"), "ciudad", text(who["phone"]).alias("telefono"), text(who["advisor"]["name"]).alias("asesor"),
        text(who["advisor"]["email"]).alias("email_asesor"), "activos", "total_activos", F.create_map().cast("map<string,double>").alias("pasivos"), "total_pasivos", "total_portafolio",
    )
    cash = F.transform(items("cash_balance"), lambda i: F.struct(F.coalesce(i["account_name"], i["account_id"], F.lit("")).alias("cuenta"), number(i["available"]).alias("saldo_disponible"), number(i["in_transit"]).alias("saldo_canje"), number(i["blocked"]).alias("saldo_bloqueado"), number(i["total"]).alias("saldo_total")))
    fixed = F.transform(
        items("fixed_income"),
        lambda i: F.struct(
            text(i["instrument_id"]).alias("nemotecnico"), text(i["issue_date"]).alias("fecha_emision"), text(i["maturity_date"]).alias("fecha_vencimiento"), text(i["purchase_date"]).alias("fecha_compra"), number(i["face_rate"]).alias("tasa_facial"),
            text(i["payment_frequency"]).alias("periodicidad"), number(i["nominal_value"]).alias("valor_nominal"), number(i["negotiated_rate"]).alias("tasa_negociacion"), number(i["valuation_rate"]).alias("tasa_valoracion"), number(i["market_value"]).alias("valor_mercado"),
        ),
    )
    from ..sources.statement import RETURNS

    moves = {"saldo_anterior": "previous_balance", "adiciones": "additions", "retiros": "withdrawals", "rendimientos": "returns", "nuevo_saldo": "new_balance", "unidades": "units"}
    funds = F.transform(
        section_of("investment_fund"),
        lambda s: F.struct(
            text(s["fund"]["name"]).alias("nombre_fondo"), text(s["fund"]["code"]).alias("codigo"), text(F.col("nombre_cliente")).alias("nombre_inversionista"), text(F.col("nit")).alias("identificacion"), text(s["fund"]["objective"]).alias("objetivo_inversion"),
            text(s["fund"]["administrator"]).alias("administrador"), number(s["movements"]["unit_value_end"]).alias("valor_unidad_final"), text(F.col("period")["start_date"]).alias("fecha_inicio_extracto"), text(F.col("period")["end_date"]).alias("fecha_fin_extracto"),
            *[number(s["movements"][v]).alias(k) for k, v in moves.items()],
            F.map_from_arrays(F.array(*map(F.lit, RETURNS.values())), F.array(*[number(s["historical_returns"][c]) * 100 for c in RETURNS])).alias("rentabilidades_historicas"),
        ),
    )
    tree = F.struct(summary.alias("resumen"), cash.alias("saldos_efectivo"), fixed.alias("renta_fija"), funds.alias("fondos"), F.transform(section_of("transactions"), account_struct).alias("transacciones"), F.col("_currency").alias("currency"))
    return d.select(*ID, F.to_json(tree).alias("json"))


# ---------------------------------------------------------------- grids


def summary_grid(header: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, field, value): what identifies a statement, without empty rows, its assets and totals; liabilities only where there are any."""
    said = lambda name, c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.struct(F.lit(name).alias("field"), F.col(c).cast("string").alias("value")))
    money = lambda name, c: F.struct(F.lit(name).alias("field"), format_cop_money(F.col(c)).alias("value"))
    own = [said(n, c) for n, c in (("Fecha Extracto", "fecha_extracto"), ("Nombre Cliente", "nombre_cliente"), ("NIT", "nit"), ("Direccion", "direccion"), ("Ciudad", "ciudad"), ("Telefono", "telefono"), ("Asesor", "asesor")) if c in header.columns]
    assets = F.transform(F.array_sort(F.map_entries("activos")), lambda e: F.struct(e["key"].alias("field"), format_cop_money(e["value"]).alias("value")))
    totals = F.array(money("Total Activos", "total_activos"), F.when(F.col("total_pasivos") > 0, money("Total Pasivos", "total_pasivos")), money("TOTAL PORTAFOLIO", "total_portafolio"))
    return header.select(*keys, F.posexplode(F.array_compact(F.concat(F.array(*own), assets, totals))).alias("seq", "r")).select(*keys, "seq", "r.*")


def instrument_grid(instruments: DataFrame, *keys: str) -> DataFrame:
    pct, money = lambda c: format_cop_percent(F.col(c)).alias(c), lambda c: format_cop_money(F.col(c)).alias(c)
    return instruments.select(*keys, "instrument_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("issue_date", "maturity_date", "purchase_date") if c in instruments.columns], pct("face_rate"), "payment_frequency", money("nominal_value"), pct("negotiated_rate"), pct("valuation_rate"), money("market_value"))


def fund_grid(funds: DataFrame, *keys: str) -> DataFrame:
    """(keys, seq, field, value): what names a fund, its movements, units where above 0, and its returns by horizon."""
    said = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(F.lit(name).alias("field"), F.col(c).alias("value")))
    money = lambda name, c: F.struct(F.lit(name).alias("field"), format_cop_money(F.col(c)).alias("value"))
    more = lambda name, c: F.when(F.col(c) > 0, F.struct(F.lit(name).alias("field"), F.format_string("%.6f", F.col(c)).alias("value")))
    fixed = [said("Nombre Fondo", "name"), said("Codigo", "code"), *[money(n, c) for n, c in (("Saldo Anterior", "previous_balance"), ("Adiciones", "additions"), ("Retiros", "withdrawals"), ("Rendimientos", "returns"), ("Nuevo Saldo", "new_balance"))], more("Unidades", "units"), more("Valor Unidad", "unit_value_end")]
    returns = F.transform(F.array_sort(F.map_entries("returns_by_horizon")), lambda e: F.struct(F.concat(F.lit("Rentab. "), e["key"]).alias("field"), format_cop_percent(e["value"]).alias("value")))
    return funds.select(*keys, F.posexplode(F.array_compact(F.concat(F.array(*fixed), returns))).alias("seq", "r")).select(*keys, "seq", "r.*")


def analysis_grid(a: Analysis) -> DataFrame:
    """(statement_id, seq, field, value): composition, figures and alerts as texts."""
    shares = ordered(a.composition(), ["asset"], F.struct(F.concat(F.lit("% "), "asset").alias("field"), format_cop_percent(F.col("pct")).alias("value")), "shares")
    alerts = ordered(a.alerts(), ["seq", "message"], F.struct(F.concat(F.lit("["), "type", F.lit("]")).alias("field"), F.col("message").alias("value")), "alerts")
    kind = "array<struct<field:string,value:string>>"
    d = a.kpis().join(shares, ID, "left").join(alerts, ID, "left")
    plain = [(n, c) for n, c in FIGURES.items() if c not in ("ladder", "ladder_counts", "spreads", "category")]
    figures = F.array(*[F.struct(F.lit(n).alias("field"), F.format_string("%.4f", F.col(c)).alias("value")) for n, c in plain])
    ladder = F.transform(F.array_sort(F.map_entries(F.coalesce("ladder", F.create_map().cast("map<string,double>")))), lambda e: F.struct(F.concat(F.lit("Vence "), e["key"]).alias("field"), format_cop_money(e["value"]).alias("value")))
    rows = F.concat(F.coalesce("shares", F.array().cast(kind)), figures, ladder, F.coalesce("alerts", F.array().cast(kind)))
    return d.select(*ID, F.posexplode(rows).alias("seq", "r")).select(*ID, "seq", "r.*")
