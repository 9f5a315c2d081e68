"""Whole statements made from the star tables and analysed end to end, the data of the charts with their notes, the reports, and generated statements."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import charts, portfolio
from ..sources import generate, statement
from ..sources import views as V
from . import reports
from .analysis import Analysis
from .analytics import H, HHI, HOLDINGS, KEY, KEYS, LIVE, OUT, TOPS, YIELDS, R
from .base import longs, query, rounded

RETURN_FIELDS = {v: k for k, v in statement.RETURNS.items()}


def whole_statements(spark, d) -> DataFrame:
    """(holder_id, json): a statement per customer with instruments, cash, a fund where the key is a supplier's, and the user's transactions."""
    i = V.instruments(spark, d)
    item = F.struct(*[F.col(c) for c in KEY], F.struct("instrument_id", "issue_date", "maturity_date", "face_rate", "negotiated_rate", "valuation_rate", "payment_frequency", "nominal_value", "market_value").alias("item"))
    fixed = i.groupBy("holder_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda z: z["item"]).alias("fixed"))
    returns = V.fund_returns(spark, d).groupBy("holder_id").agg(*[(F.max(F.when(F.col("horizon") == shown, F.col("pct"))) / 100).alias(field) for shown, field in RETURN_FIELDS.items()])
    moves = F.struct((F.col("new_balance") - F.col("returns")).alias("previous_balance"), "returns", "new_balance")
    fund = V.funds(spark, d).join(returns, "holder_id", "left").select("holder_id", F.struct(F.struct("name", F.concat(F.lit("F"), F.col("holder_id").cast("string")).alias("code")).alias("fund"), moves.alias("movements"), F.struct(*RETURN_FIELDS.values()).alias("historical_returns")).alias("fund"))
    t = V.transactions(spark, d).select(F.col("account_id").alias("holder_id"), F.struct("ts", "event_id", F.struct(F.to_date("ts").alias("date"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("description"), "debit", "credit").alias("item")).alias("t"))
    moved = t.groupBy("holder_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda z: z["item"]).alias("moved"))
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("holder_id"), "c_name", "c_acctbal")
    for part in (fixed, fund, moved):
        c = c.join(part, "holder_id", "left")
    kind = lambda k, s: F.concat(F.lit('{"section_type":"' + k + '",'), F.substring(s, 2, 1 << 30))
    sections = F.array_compact(
        F.array(
            F.when(F.col("fixed").isNotNull(), kind("fixed_income", F.to_json(F.struct(F.col("fixed").alias("items"))))), F.when(F.col("fund").isNotNull(), kind("investment_fund", F.to_json("fund"))),
            kind("cash_balance", F.to_json(F.struct(F.array(F.struct(F.lit("001").alias("account_id"), F.col("c_acctbal").alias("total"))).alias("items")))),
            F.when(F.col("moved").isNotNull(), kind("transactions", F.to_json(F.struct(F.concat(F.lit("A"), F.col("holder_id").cast("string")).alias("account_id"), F.col("moved").alias("items"))))),
        )
    )
    text = F.concat(F.lit('{"schema_version":"1.0","account_holder":{"full_name":"'), "c_name", F.lit('"},"period":{"end_date":"1998-06-30"},"sections":['), F.array_join(sections, ","), F.lit("]}"))
    return c.select("holder_id", text.alias("json"))


EVEN = lambda x, n: f"printf('%.{n}f', round_even(round({x}, 6) * {10**n}, 0) / {10**n})"
R9 = lambda x: f"round({x}, 9) + 0.0::DOUBLE"  # noqa: E731  means of cents end in the seventh decimal
_MADE: dict[tuple, DataFrame] = {}


def analysed(spark, d) -> Analysis:
    """The analysis of all whole statements. Their texts are made once a session and kept where there is room, as an analysis reads them many times."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MADE:
        _MADE[key] = whole_statements(spark, d).persist(StorageLevel.MEMORY_AND_DISK)
    s = _MADE[key].select(F.col("holder_id").cast("string").alias("statement_id"), statement.parse(F.col("json")).alias("s"))
    return Analysis(s.select("statement_id", "s.*"))


# keys may repeat, so what a row holds decides between rows of one key
ORDER = [*KEY, "issue_date", "maturity_date", "face_rate", "negotiated_rate", "valuation_rate", "payment_frequency", "nominal_value", "market_value"]
POSITIONS = f"p AS (SELECT *, row_number() OVER (PARTITION BY holder_id ORDER BY {', '.join(ORDER)}) AS pos FROM instruments)"
SPREADS = f"{POSITIONS}, nm AS (SELECT holder_id, instrument_id, arg_max(valuation_rate - face_rate, pos) AS s FROM p GROUP BY 1, 2), sp AS (SELECT holder_id, count(*) AS n_spreads, sum(s) AS spread_sum FROM nm GROUP BY 1)"
# the returns of a statement's fund: an absent horizon is 0
SIX = "hz AS (SELECT unnest(['2 Años', '3 Años', 'Mensual', 'Semestral', 'Ultimo Año', 'YTD']) AS horizon), six AS (SELECT f.holder_id, hz.horizon, coalesce(r.pct, 0) AS pct FROM funds f CROSS JOIN hz LEFT JOIN fund_returns r ON r.holder_id = f.holder_id AND r.horizon = hz.horizon), fs AS (SELECT holder_id, coalesce(nullif(max(pct) FILTER (WHERE horizon = 'Ultimo Año'), 0), avg(pct)) AS ar, coalesce(stddev_samp(pct), 0) AS sigma FROM six GROUP BY 1)"
FIGURES = f"{HOLDINGS}, h AS ({HHI}), t AS ({TOPS}), i AS (SELECT holder_id, {YIELDS}, {LIVE} AS md, count(*) FILTER (WHERE days <= 0) AS n_matured FROM instruments GROUP BY 1), {SPREADS}, {SIX}"


@query(f"""{FIGURES} SELECT i.holder_id::VARCHAR AS statement_id, {R('wy')} AS weighted_yield, {R('fy')} AS face_yield, {R('wy - fy')} AS spread, {R('md / 365')} AS macaulay, {R('md / 365 / (1 + wy / 100)')} AS modified, {R('md')} AS mean_days, n_matured, {R('hhi')} AS hhi,
CASE WHEN hhi < 1500 THEN 'bajo' WHEN hhi < 2500 THEN 'moderado' ELSE 'alto' END AS category, {R('top1')} AS top1, {R('top3')} AS top3, {R('top5')} AS top5, n_spreads, {R('spread_sum')} AS spread_sum, {R9('coalesce(ar, 0)')} AS annual_return,
{R9('coalesce((ar - 9.25) / nullif(sigma, 0), 0)')} AS sharpe, {R9('100 * ((1 + coalesce(ar, 0) / 100) / 1.048::DOUBLE - 1)')} AS real_return_pct
FROM i JOIN h USING (holder_id) JOIN t USING (holder_id) JOIN sp USING (holder_id) LEFT JOIN fs USING (holder_id)""")
def analysis_kpis(spark, d):
    """All figures of whole statements, which may list an instrument more than once."""
    k = analysed(spark, d).kpis().where("n_matured is not null")
    k = k.withColumns({"n_spreads": F.size("spreads").cast("long"), "spread_sum": F.aggregate(F.map_values("spreads"), F.lit(0.0), lambda a, x: a + x)})
    names = ["weighted_yield", "face_yield", "spread", "macaulay", "modified", "mean_days", "hhi", "top1", "top3", "top5", "spread_sum"]
    returns = ["annual_return", "sharpe", "real_return_pct"]
    return rounded(rounded(k.select("statement_id", "n_matured", "category", "n_spreads", *names, *returns), *names), *returns, digits=9)


ASSETS = "a0 AS (SELECT c_custkey AS holder_id, mv, f.new_balance, c_acctbal, coalesce(mv, 0) + coalesce(f.new_balance, 0) + c_acctbal AS total FROM customer LEFT JOIN (SELECT holder_id, sum(market_value) AS mv FROM instruments GROUP BY 1) m ON m.holder_id = c_custkey LEFT JOIN funds f ON f.holder_id = c_custkey), pc AS (SELECT holder_id, u.asset, 100 * u.v / total AS pct FROM (SELECT holder_id, total, unnest([{'asset': 'FIC', 'v': new_balance}, {'asset': 'Renta Fija', 'v': mv}, {'asset': 'Saldos en Efectivo', 'v': c_acctbal}]) AS u FROM a0 WHERE total > 0) WHERE u.v IS NOT NULL)"
CENTS = lambda x: EVEN(x, 2)
ROW = lambda c: " || ',' || ".join(CENTS(f"coalesce({f}({c}), 0)") for f in ("avg", "stddev_samp", "median", "min", "max")) + f" || ',' || count({c})"
OVER = lambda c: f"{ROW(f'CASE WHEN {c} > 0 THEN {c} END')}"


@query(f"""{ASSETS}, {OUT}, st AS (SELECT holder_id, {OVER('valuation_rate')} AS va, {OVER('negotiated_rate')} AS ne, {OVER('face_rate')} AS fa, {OVER('market_value')} AS ma FROM instruments GROUP BY 1),
al AS (SELECT holder_id, 1 AS seq, 'WARNING' AS type, 'Tasa de valoracion atipica en ' || instrument_id || ': ' || printf('%.6f', valuation_rate) || '%' AS message FROM hits UNION ALL SELECT holder_id, 2, 'WARNING', 'Alta concentracion en ' || asset || ': ' || printf('%.6f', pct) || '%' FROM pc WHERE pct > 80
UNION ALL SELECT holder_id, 3, 'CRITICAL', 'Rendimiento negativo en fondo: ' || name FROM funds WHERE returns < 0 UNION ALL SELECT holder_id, 4, 'INFO', 'Tasa facial baja en ' || instrument_id || ': ' || printf('%.6f', face_rate) || '%' FROM instruments WHERE face_rate > 0 AND face_rate < 5),
g AS (SELECT c_custkey AS holder_id, list_concat(['Composicion del Portafolio', 'Activo,Porcentaje (%)'], coalesce((SELECT list(asset || ',' || {CENTS('pct')} ORDER BY asset) FROM pc WHERE pc.holder_id = c_custkey), []),
['', 'Estadisticas de Tasas', 'Metrica,Media,Desv.Est,Mediana,Min,Max,N', 'Tasa Valoracion,' || coalesce(va, '0.00,0.00,0.00,0.00,0.00,0'), 'Tasa Negociacion,' || coalesce(ne, '0.00,0.00,0.00,0.00,0.00,0'), 'Tasa Facial,' || coalesce(fa, '0.00,0.00,0.00,0.00,0.00,0'), 'Valor Mercado,' || coalesce(ma, '0.00,0.00,0.00,0.00,0.00,0'), '', 'Alertas', 'Tipo,Mensaje'],
coalesce((SELECT list(type || ',' || message ORDER BY seq, message) FROM al WHERE al.holder_id = c_custkey), [])) AS l FROM customer LEFT JOIN st ON st.holder_id = c_custkey)
SELECT holder_id::VARCHAR AS statement_id, unnest(range(len(l))) AS seq, unnest(l) AS line FROM g""")
def analysis_report(spark, d):
    """The CSV report of each statement, line by line."""
    return longs(reports.analysis_lines(analysed(spark, d)), "seq")


TREE = "resumen struct<nombre_cliente string, total_portafolio double, activos map<string,double>>, saldos_efectivo array<struct<cuenta string, saldo_total double>>, renta_fija array<struct<nemotecnico string, tasa_valoracion double, valor_mercado double>>, fondos array<struct<nombre_fondo string, nuevo_saldo double, rentabilidades_historicas map<string,double>>>, transacciones array<struct<account_id string, items array<struct<description string, debit double, credit double>>>>, currency string"


@query(f"""{ASSETS}, tx AS (SELECT account_id, count(*) AS n, sum(debit) AS debits, sum(credit) AS credits FROM transactions GROUP BY 1), ri AS (SELECT holder_id, count(*) AS n, sum(valuation_rate) AS rates FROM instruments GROUP BY 1), fr AS (SELECT holder_id, sum(pct) AS pct FROM fund_returns GROUP BY 1)
SELECT c_custkey::VARCHAR AS statement_id, c_name AS client, 'COP' AS currency, round(total, 2) AS total, 1 + (mv IS NOT NULL)::BIGINT + (f.new_balance IS NOT NULL)::BIGINT AS n_assets, round(customer.c_acctbal, 2) AS cash, coalesce(ri.n, 0) AS n_fixed, round(coalesce(mv, 0), 2) AS market_value, round(coalesce(rates, 0), 6) + 0.0::DOUBLE AS rates,
f.name AS fund, round(f.new_balance, 2) AS balance, {R('CASE WHEN f.name IS NOT NULL THEN coalesce(fr.pct, 0) END')} AS returns, coalesce(tx.n, 0) AS n_moves, {R('coalesce(debits, 0)')} AS debits, {R('coalesce(credits, 0)')} AS credits
FROM customer JOIN a0 ON a0.holder_id = c_custkey LEFT JOIN ri ON ri.holder_id = c_custkey LEFT JOIN funds f ON f.holder_id = c_custkey LEFT JOIN fr ON fr.holder_id = c_custkey LEFT JOIN tx ON tx.account_id = c_custkey""")
def statement_tree(spark, d):
    """The whole statement as JSON, read back: summary, cash, instruments, funds and accounts."""
    t = reports.statement_json(analysed(spark, d)).select("statement_id", F.from_json("json", TREE).alias("t")).select("statement_id", "t.*")
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, i: x + f(i))
    moves = F.flatten(F.transform("transacciones", lambda a: a["items"]))
    fund = F.try_element_at("fondos", F.lit(1))
    out = t.select(
        "statement_id", F.col("resumen.nombre_cliente").alias("client"), "currency", F.col("resumen.total_portafolio").alias("total"), F.size("resumen.activos").alias("n_assets"), add("saldos_efectivo", lambda i: i["saldo_total"]).alias("cash"), F.size("renta_fija").alias("n_fixed"),
        add("renta_fija", lambda i: i["valor_mercado"]).alias("market_value"), add("renta_fija", lambda i: i["tasa_valoracion"]).alias("rates"), fund["nombre_fondo"].alias("fund"), fund["nuevo_saldo"].alias("balance"), add(F.map_values(fund["rentabilidades_historicas"]), lambda v: v).alias("returns"),
        F.size(moves).alias("n_moves"), add(moves, lambda i: i["debit"]).alias("debits"), add(moves, lambda i: i["credit"]).alias("credits"),
    )
    return longs(rounded(rounded(out, "rates", "returns", "debits", "credits"), "total", "cash", "market_value", "balance", digits=2), "n_assets", "n_fixed", "n_moves")


@query("SELECT account_id::VARCHAR AS statement_id, 'A' || account_id AS account_id, 'COP' AS currency, count(*) AS n, round(sum(debit), 6) AS debits, round(sum(credit), 6) AS credits, false AS has_totals FROM transactions WHERE account_id IN (SELECT c_custkey FROM customer) GROUP BY account_id")
def account_json(spark, d):
    """Accounts with their transactions as JSON, read back; totals stand only where the statement gives them."""
    a = reports.accounts_json(analysed(spark, d).statements, "statement_id")
    kind = "account_id string, currency string, items array<struct<debit double, credit double>>, totals struct<debits double, credits double, net double, ending_balance double>"
    t = a.select("statement_id", F.from_json("json", kind).alias("t")).select("statement_id", "t.*")
    add = lambda c: F.aggregate("items", F.lit(0.0), lambda x, i: x + i[c])
    return rounded(t.select("statement_id", "account_id", "currency", F.size("items").cast("long").alias("n"), add("debit").alias("debits"), add("credit").alias("credits"), F.col("totals").isNotNull().alias("has_totals")), "debits", "credits")


COP = lambda v: f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || '$ ' || replace(replace(replace(format('{{:,.2f}}', abs({v})), ',', '#'), '.', ','), '#', '.')"


@query(f"""{ASSETS}, g AS (SELECT holder_id, list_concat([{{'field': 'Fecha Extracto', 'value': '1998-06-30'}}, {{'field': 'Nombre Cliente', 'value': c_name}}], list_filter([{{'field': CASE WHEN new_balance IS NOT NULL THEN 'FIC' END, 'value': {COP('new_balance')}}}, {{'field': CASE WHEN mv IS NOT NULL THEN 'Renta Fija' END, 'value': {COP('round(mv, 2)')}}}, {{'field': 'Saldos en Efectivo', 'value': {COP('a0.c_acctbal')}}}], lambda z: z.field IS NOT NULL),
[{{'field': 'Total Activos', 'value': '$ 0,00'}}, {{'field': 'TOTAL PORTAFOLIO', 'value': {COP('round(total, 2)')}}}]) AS l FROM a0 JOIN customer ON c_custkey = holder_id)
SELECT holder_id::VARCHAR AS statement_id, seq, r.field AS field, r.value AS value FROM (SELECT holder_id, unnest(range(len(l))) AS seq, unnest(l) AS r FROM g)""")
def summary_grid(spark, d):
    """The rows of the summary view; empty fields are left out."""
    h = analysed(spark, d).header
    h = h.withColumns({"activos": F.transform_values("activos", lambda k, v: F.round(v, 2)), "total_portafolio": F.round("total_portafolio", 2)})
    return longs(reports.summary_grid(h, "statement_id"), "seq")


# ---------------------------------------------------------------- chart data


@query(f"""q AS (SELECT *, max(days) OVER (PARTITION BY holder_id) - min(days) OVER (PARTITION BY holder_id) < 1 AS degenerate, min(days) OVER (PARTITION BY holder_id) AS first, row_number() OVER (PARTITION BY holder_id ORDER BY {KEYS}) - 1 AS nth, count(*) OVER (PARTITION BY holder_id, instrument_id) AS same, row_number() OVER (PARTITION BY holder_id, instrument_id ORDER BY {KEYS}) AS k FROM instruments WHERE days > 0)
SELECT holder_id, {KEYS}, (CASE WHEN degenerate THEN first + nth * 30 ELSE days END)::BIGINT AS x, round(valuation_rate, 6) + 0.0::DOUBLE AS rate, CASE WHEN same > 1 THEN instrument_id || ' #' || k ELSE instrument_id END AS label, degenerate FROM q""")
def yield_curve_chart(spark, d):
    """The points of the curve; those of one day are spread out."""
    c = charts.yield_curve(V.instruments(spark, d, live=True), H, "instrument_id", KEY, keep=tuple(KEY))
    return longs(rounded(c, "rate"), "x")


@query("SELECT holder_id, n AS n_expired, 'Nota: ' || n || ' instrumento(s) expirado(s) excluido(s) (vto <= 1998-06-30)' AS note FROM (SELECT holder_id, count(*) FILTER (WHERE days <= 0) AS n FROM instruments GROUP BY 1) WHERE n > 0")
def yield_curve_notes(spark, d):
    return charts.matured(V.instruments(spark, d).withColumn("as_of", F.lit(V.AS_OF)), H)


@query(f"""SELECT holder_id, {R('y')} AS mean_years, n_matured, y > 30 AS warns, 'Vencimiento promedio ponderado: ' || {EVEN('y', 1)} || ' anos' || CASE WHEN n_matured > 0 THEN '  (' || n_matured || ' CDT vencido(s) excluido(s))' ELSE '' END || CASE WHEN y > 30 THEN '  [AVISO: verificar fechas de vencimiento en los datos]' ELSE '' END AS note
FROM (SELECT holder_id, {LIVE} / 365 AS y, count(*) FILTER (WHERE days <= 0) AS n_matured FROM instruments GROUP BY 1)""")
def ladder_notes(spark, d):
    return rounded(charts.ladder_notes(V.instruments(spark, d), H), "mean_years")


NAMED = f"{POSITIONS}, n0 AS (SELECT holder_id, 'RF' AS kind, instrument_id AS name, market_value AS value, 1 AS k, pos FROM p UNION ALL SELECT holder_id, 'FIC', name, new_balance, 2, 0 FROM funds WHERE new_balance > 0 UNION ALL SELECT holder_id, 'Efectivo', 'Efectivo 1', total, 3, 0 FROM cash WHERE total > 0), nn AS (SELECT holder_id, kind, CASE WHEN count(*) OVER (PARTITION BY holder_id, name) > 1 THEN name || ' #' || row_number() OVER (PARTITION BY holder_id, name ORDER BY k, pos) ELSE name END AS name, value FROM n0)"


@query(f"""{NAMED}, c AS (SELECT *, sum(value) OVER (PARTITION BY holder_id) AS t, row_number() OVER w AS rank, 100 * sum(value) OVER (PARTITION BY holder_id ORDER BY value DESC, name, kind ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY holder_id) AS c FROM nn WINDOW w AS (PARTITION BY holder_id ORDER BY value DESC, name, kind))
SELECT holder_id, kind, name, value, rank, {R('100 * value / t')} AS pct, {R('c')} AS cumulative_pct FROM c WHERE t > 0""")
def pareto_chart(spark, d):
    """The bars of the Pareto chart with their names: instruments that share one are numbered."""
    i = V.instruments(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy(*H).orderBy(*ORDER)))
    one = lambda df: df.withColumn("pos", F.lit(0))
    return longs(rounded(charts.pareto(i, one(V.funds(spark, d)), one(V.cash(spark, d)), H, "pos").drop("within_80"), "pct", "cumulative_pct"), "rank")


@query(f"""{HOLDINGS}, h AS ({HHI}), t AS ({TOPS}), k AS (SELECT *, CASE WHEN hhi < 1500 THEN 'bajo' WHEN hhi < 2500 THEN 'moderado' ELSE 'alto' END AS category FROM h JOIN t USING (holder_id))
SELECT holder_id, 'HHI = ' || {EVEN('hhi', 0)} || ' (' || category || ')  |  Top-1: ' || {EVEN('top1', 1)} || '%  |  Top-3: ' || {EVEN('top3', 1)} || '%  |  Top-5: ' || {EVEN('top5', 1)} || '%' AS subtitle,
CASE category WHEN 'bajo' THEN 'Diversificacion saludable' WHEN 'moderado' THEN 'Concentracion moderada - vigilar' ELSE 'Alta concentracion - riesgo' END AS verdict, CASE category WHEN 'bajo' THEN 'positive' WHEN 'moderado' THEN 'warning' ELSE 'negative' END AS status FROM k""")
def concentration_notes(spark, d):
    every = portfolio.holdings(V.instruments(spark, d), V.funds(spark, d), V.cash(spark, d))
    k = portfolio.concentration(every, H).join(portfolio.exposure(every, H), H)
    return charts.concentration_notes(rounded(k, "hhi", "top1", "top3", "top5"), H)


@query("SELECT holder_id, row_number() OVER (PARTITION BY holder_id ORDER BY valuation_rate, instrument_id) AS position, round(valuation_rate, 6) + 0.0::DOUBLE AS value, instrument_id AS name FROM instruments WHERE days BETWEEN 1 AND 60 AND holder_id IN (SELECT holder_id FROM instruments WHERE days BETWEEN 1 AND 60 GROUP BY 1 HAVING count(*) < 5)")
def boxplot_values(spark, d):
    """The single rates of what matures within sixty days, of holders with too few of these for a box."""
    soon = V.instruments(spark, d, live=True).where("days between 1 and 60")
    return longs(rounded(charts.few_values(soon, H, "valuation_rate", "instrument_id"), "value"), "position")


SI = lambda v: f"CASE WHEN abs({v}) >= 1e9 THEN {EVEN(f'{v} / 1e9', 2)} || 'B' WHEN abs({v}) >= 1e6 THEN {EVEN(f'{v} / 1e6', 2)} || 'M' WHEN abs({v}) >= 1e3 THEN {EVEN(f'{v} / 1e3', 1)} || 'K' ELSE {EVEN(v, 2)} END"


@query(f"""{FIGURES}, {ASSETS}, k AS (SELECT a0.holder_id, round(a0.total, 2) AS total, round(coalesce(wy, 0), 6) AS wy, round(coalesce(md / 365 / (1 + wy / 100), 0), 6) AS mo, round(hhi, 6) AS hhi, CASE WHEN hhi < 1500 THEN 'bajo' WHEN hhi < 2500 THEN 'moderado' ELSE 'alto' END AS cat, round(top3, 6) AS top3,
round(coalesce((ar - 9.25) / nullif(sigma, 0), 0), 6) AS sh, round(100 * ((1 + coalesce(ar, 0) / 100) / 1.048::DOUBLE - 1), 6) AS re FROM a0 JOIN h USING (holder_id) JOIN t USING (holder_id) LEFT JOIN i USING (holder_id) LEFT JOIN fs USING (holder_id)),
r AS (SELECT holder_id, unnest([{{'position': 1, 'label': 'TOTAL PORTAFOLIO', 'value': total, 'shown': '$' || {SI('total')}, 'sub': 'valor de mercado', 'status': 'accent'}}, {{'position': 2, 'label': 'YIELD PONDERADO', 'value': wy, 'shown': {EVEN('wy', 2)} || '%', 'sub': 'TIR del portafolio', 'status': 'positive'}},
{{'position': 3, 'label': 'DURACION MODIFICADA', 'value': mo, 'shown': {EVEN('mo', 2)} || ' anos', 'sub': 'sensibilidad a tasas', 'status': 'warning'}}, {{'position': 4, 'label': 'HHI CONCENTRACION', 'value': hhi, 'shown': {SI('hhi')}, 'sub': cat, 'status': CASE cat WHEN 'bajo' THEN 'positive' WHEN 'moderado' THEN 'warning' ELSE 'negative' END}},
{{'position': 5, 'label': 'TOP-3 EXPOSURE', 'value': top3, 'shown': {EVEN('top3', 1)} || '%', 'sub': 'concentrado en 3 holdings', 'status': 'neutral'}}, {{'position': 6, 'label': 'SHARPE FIC', 'value': sh, 'shown': {EVEN('sh', 2)}, 'sub': 'rendimiento ajust. riesgo', 'status': CASE WHEN sh > 1.5 THEN 'positive' WHEN sh >= 0 THEN 'warning' ELSE 'negative' END}},
{{'position': 7, 'label': 'MAX DRAWDOWN', 'value': 0.0::DOUBLE, 'shown': '0.00%', 'sub': 'peor caida historica', 'status': 'warning'}}, {{'position': 8, 'label': 'RETORNO REAL', 'value': re, 'shown': {EVEN('re', 2)} || '%', 'sub': 'ajustado por inflacion', 'status': CASE WHEN re > 0 THEN 'positive' ELSE 'negative' END}}]) AS c FROM k)
SELECT holder_id::VARCHAR AS statement_id, c.position::BIGINT AS position, c.label AS label, c.value + 0.0::DOUBLE AS value, c.shown AS shown, c.sub AS sub, c.status AS status FROM r""")
def dashboard_cards(spark, d):
    """The eight cards of the dashboard of each statement."""
    k = rounded(analysed(spark, d).kpis(), "weighted_yield", "modified", "hhi", "top3", "sharpe", "max_drawdown", "real_return_pct")
    return longs(charts.cards(rounded(k, "total_portafolio", digits=2), ["statement_id"]).drop("kpi"), "position")


# ---------------------------------------------------------------- generated statements

U = lambda *name: f"('0x' || substr(md5(concat_ws(':', c_custkey::VARCHAR, {', '.join(name)})), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE"
THOUSANDS = lambda u, low, high: f"round(({low}::DOUBLE + ({u}) * ({high}::DOUBLE - {low}::DOUBLE)) / 1000) * 1000"


def rolled(*name: str) -> str:
    return U(*[n if n.startswith("i::") else f"'{n}'" for n in name])


@query(f"""n AS (SELECT c_custkey, [2, 3, 4, 5, 6, 7][1 + floor({rolled('papers')} * 6)::INT] AS papers, [0, 1, 1, 2][1 + floor({rolled('funds')} * 4)::INT] AS funds, [0, 1, 1, 2][1 + floor({rolled('cash')} * 4)::INT] AS cash FROM customer),
pa AS (SELECT c_custkey, sum({THOUSANDS(rolled('paper', 'i::VARCHAR', 'nominal'), '1e8', '2e9')}) AS nominal FROM (SELECT c_custkey, unnest(range(1, papers + 1)) AS i FROM n) GROUP BY 1),
ca AS (SELECT c_custkey, sum({THOUSANDS(rolled('balance', 'i::VARCHAR'), '1e5', '5e7')}) AS cash FROM (SELECT c_custkey, unnest(range(1, cash + 1)) AS i FROM n) GROUP BY 1),
fu AS (SELECT c_custkey, sum({THOUSANDS(rolled('fund', 'i::VARCHAR', 'previous'), '5e7', '3e9')}) AS previous FROM (SELECT c_custkey, unnest(range(1, funds + 1)) AS i FROM n) GROUP BY 1)
SELECT c_custkey AS seed, n.papers::BIGINT AS n_papers, n.funds::BIGINT AS n_funds, n.cash::BIGINT AS n_accounts, pa.nominal AS nominal, coalesce(fu.previous, 0) AS previous, coalesce(ca.cash, 0) AS cash, true AS balances_add_up, true AS total_adds_up FROM n JOIN pa USING (c_custkey) LEFT JOIN fu USING (c_custkey) LEFT JOIN ca USING (c_custkey)""")
def generated_statements(spark, d):
    """A generated statement per customer key, read by the statement loader: its parts, and whether balances and totals add up."""
    made = generate.statements(V.table(spark, d, "customer").select(F.col("c_custkey").alias("seed")))
    s = made.select("seed", statement.parse(F.col("json")).alias("s")).select("seed", "s.*")
    of = lambda kind: F.filter("sections", lambda x: x["section_type"] == kind)
    items = lambda kind: F.flatten(F.transform(of(kind), lambda x: x["items"]))
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, i: x + f(i))
    moves = F.transform(of("investment_fund"), lambda x: x["movements"])
    near = lambda a, b: F.abs(a - b) < 0.01
    value = add(items("fixed_income"), lambda i: i["market_value"]) + add(moves, lambda m: m["new_balance"]) + add(items("cash_balance"), lambda i: i["total"])
    return s.select(
        "seed", F.size(items("fixed_income")).cast("long").alias("n_papers"), F.size(moves).cast("long").alias("n_funds"), F.size(items("cash_balance")).cast("long").alias("n_accounts"), add(items("fixed_income"), lambda i: i["nominal_value"]).alias("nominal"),
        add(moves, lambda m: m["previous_balance"]).alias("previous"), add(items("cash_balance"), lambda i: i["total"]).alias("cash"),
        F.forall(moves, lambda m: near(m["previous_balance"] + m["additions"] - m["withdrawals"] + m["returns"], m["new_balance"])).alias("balances_add_up"), near(value, F.col("summary.net_worth")).alias("total_adds_up"),
    )
