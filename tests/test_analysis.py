"""The sample statement, with its history, against figures computed by hand from the formulas."""

import datetime as dt
import json

import pytest

from ledgerloom.operators import alerts
from ledgerloom.plans.analysis import Analysis
from ledgerloom.sources import statement

# fixed values: the sample statement and its history, as published
HISTORY = [6.1e9, 6.15e9, 6.2e9, 6.18e9, 6.25e9, 6.3e9, 6.28e9, 6.32e9, 6.35e9, 6.37e9, 6.38e9, 6386676308.68]
ITEMS = [("CDTBANCO01", "2026-03-15", 9.7618, 10.09, 11.6688, 1095267330), ("CDTBANCO02", "2026-04-10", 9.13, 9.85, 10.64, 1095200000), ("CDTBANCO03", "2026-05-20", 10.12, 11.5, 12.41, 1096600000), ("CDTBANCO04", "2026-06-01", 9.44, 10.4, 11.36, 1095000000)]
SAMPLE = {
    "schema_version": "1.0",
    "account_holder": {"full_name": "Cliente Demo"},
    "period": {"start_date": "2026-04-01", "end_date": "2026-04-30", "issue_date": "2026-05-01"},
    "currency": "COP",
    "summary": {"total_assets": 6386676308.68, "total_liabilities": 0, "net_worth": 6386676308.68},
    "sections": [
        {"section_type": "cash_balance", "items": [{"account_name": "Cuenta operativa", "total": 0}], "subtotal": 0},
        {"section_type": "fixed_income", "subtotal": 4382067330, "items": [dict(zip(("instrument_id", "maturity_date", "face_rate", "negotiated_rate", "valuation_rate", "market_value"), i), payment_frequency="TV", nominal_value=1e9) for i in ITEMS]},
        {"section_type": "investment_fund", "fund": {"name": "FIC Renta Liquida", "code": "FIC001"}, "movements": {"previous_balance": 1997903323.18, "additions": 0, "withdrawals": 0, "returns": 6705655.5, "new_balance": 2004608978.68},
         "historical_returns": {"monthly": 0.0335, "semi_annual": 0.0612, "ytd": 0.0451, "last_year": 0.1166, "last_2_years_annualized": 0.108, "last_3_years_annualized": 0.095}},
        {"section_type": "transactions", "account_id": "001-DEMO", "items": [{"date": "2026-04-05", "credit": 1500000}], "totals": {"debits": 1000000, "credits": 1750000, "net": 750000, "ending_balance": 750000}},
    ],
}


@pytest.fixture(scope="module")
def done(spark):
    s = spark.createDataFrame([("one", json.dumps(SAMPLE)), ("bare", '{"schema_version":"1.0","sections":[]}')], "statement_id string, j string")
    s = s.select("statement_id", statement.parse(s.j).alias("s")).select("statement_id", "s.*")
    months = [dt.date(2025 + (2 + i) // 12, (2 + i) % 12 + 1, 1) for i in range(12)]
    h = spark.createDataFrame([("one", m, t) for m, t in zip(months, HISTORY)], "statement_id string, period date, total double")
    return Analysis(s, h)


def near(x):
    return pytest.approx(x, rel=1e-9)


def test_kpis(done):
    k = {r.statement_id: r for r in done.kpis().collect()}
    r = k["one"]
    assert (r.weighted_yield, r.face_yield, r.spread) == (near(11.519994016227038), near(9.613122174915098), near(1.9068718413119399))
    assert (r.macaulay, r.modified) == (near(0.07122087572224708), near(0.06386377290504866))
    assert (r.hhi, r.category) == (near(2162.0903052948274), "moderado")
    assert (r.top1, r.top3, r.top5) == (near(31.387358334656433), near(65.7067323574338), near(100))
    assert r.ladder == {"<90d": 2191600000.0} and r.ladder_counts == {"<90d": 2} and r.mean_days == near(25.995619638620187) and r.n_matured == 2
    assert (r.annual_return, r.sigma, r.sharpe) == (near(11.66), near(3.467429403270767), near(0.6950393850057013))
    assert r.max_drawdown == near(-0.3225806451612903) and r.current_drawdown == 0 and r.growth_pct == near(4.699611617704913) and r.annualized_pct == near(4.699611617704913)
    assert r.real_return_pct == near(-0.09579044112126844)
    assert (r.skewness, r.kurtosis) == (pytest.approx(0.015295328126420423, rel=1e-8), near(-1.9394108816639308))
    assert (r.cv, r.ci_low, r.ci_high) == (near(0.06367697165572236), near(10.800831181825224), near(12.238568818174777))
    assert {n: round(v, 9) for n, v in r.spreads.items()} == {"CDTBANCO01": 1.907, "CDTBANCO02": 1.51, "CDTBANCO03": 2.29, "CDTBANCO04": 1.92}
    b = k["bare"]
    assert (b.weighted_yield, b.macaulay, b.hhi, b.sharpe, b.max_drawdown, b.growth_pct) == (0, 0, 0, 0, 0, 0)


def test_composition_and_summaries(done):
    c = {r.asset: r.pct for r in done.composition().collect()}
    assert c == {"Renta Fija": near(68.61264166534356), "FIC": near(31.387358334656433), "Saldos en Efectivo": 0}
    s = {r.measure: r for r in done.summaries().collect()}
    v = s["valuation_rate"]
    assert (v.mean, v.std_dev, v.median, v.min, v.max, v.n) == (near(11.5197), near(0.7335396103824249), near(11.5144), 10.64, 12.41, 4)
    assert (s["negotiated_rate"].std_dev, s["face_rate"].std_dev) == (near(0.7289718787443039), near(0.4252091367785968))
    assert (s["market_value"].mean, s["market_value"].std_dev, s["market_value"].median) == (near(1095516832.5), near(730981.5311563396), near(1095233665))


def test_alerts_findings_and_charts(done, tmp_path):
    assert [(r.statement_id, r.seq, r.type, r.message) for r in done.alerts().collect()] == [("one", 5, "INFO", "Crecimiento del portafolio: 4.699612% en 13 periodos")]
    assert {(r.statement_id, r.rule) for r in done.findings().collect()} == {("bare", x) for x in (alerts.NO_CLIENT, alerts.NO_TOTAL, alerts.NO_FIXED)}
    c = {n: d.where("statement_id = 'one'").collect() for n, d in done.charts().items()}
    assert sorted((r.days, r.valuation_rate) for r in c["yield_curve"]) == [(20, 12.41), (32, 11.36)] and not c["yield_regression"] and not c["boxplot"]
    assert len(c["pareto"]) == 5 and len(c["drawdown"]) == 13 and len(c["dashboard"]) == 8 and {r.kpi: r.status for r in c["dashboard"]}["hhi"] == "warning"
    a = {r.account_id: r for r in done.accounts.collect()}["001-DEMO"]
    assert (a.debits, a.credits, a.net) == (1000000, 1750000, 750000)
    assert [p.rsplit("/", 1)[1] for p in done.export(str(tmp_path))] == ["extracto", "renta_fija", "fondos", "rentabilidades", "alertas", "analisis", "analysis", "extracto_json"]
    notes = {n: d.where("statement_id = 'one'").collect() for n, d in done.charts().items()}
    assert notes["ladder_notes"][0].note == "Vencimiento promedio ponderado: 0.1 anos  (2 CDT vencido(s) excluido(s))" and notes["yield_notes"][0].n_expired == 2
    assert notes["pareto_notes"][0].verdict == "Concentracion moderada - vigilar" and [round(r.value, 2) for r in notes["boxplot_values"]] == [10.64, 11.36, 11.67, 12.41]
    assert [(r.label, r.shown, r.status) for r in sorted(notes["dashboard"], key=lambda r: r.position)][:3] == [("TOTAL PORTAFOLIO", "$6.39B", "accent"), ("YIELD PONDERADO", "11.52%", "positive"), ("DURACION MODIFICADA", "0.06 anos", "warning")]
    assert notes["dashboard_notes"][0].note == "Parametros: tasa libre = 9.25%  |  inflacion = 4.80%  |  benchmark = 11.00%"


def test_reports_and_trees(done):
    from ledgerloom.plans import reports

    lines = [r.line for r in reports.analysis_lines(done).where("statement_id = 'one'").orderBy("seq").collect()]
    assert lines[:5] == ["Composicion del Portafolio", "Activo,Porcentaje (%)", "FIC,31.39", "Renta Fija,68.61", "Saldos en Efectivo,0.00"]
    assert lines[5:9] == ["", "Estadisticas de Tasas", "Metrica,Media,Desv.Est,Mediana,Min,Max,N", "Tasa Valoracion,11.52,0.73,11.51,10.64,12.41,4"] and lines[-1] == "INFO,Crecimiento del portafolio: 4.699612% en 13 periodos"
    tree = {r.statement_id: json.loads(r.json) for r in reports.statement_json(done).collect()}
    one = tree["one"]
    assert one["resumen"]["nombre_cliente"] == "Cliente Demo" and one["resumen"]["activos"]["FIC"] == 2004608978.68 and len(one["renta_fija"]) == 4 and one["renta_fija"][0]["nemotecnico"] == "CDTBANCO01"
    assert one["fondos"][0]["rentabilidades_historicas"]["Mensual"] == near(3.35) and one["transacciones"][0]["totals"] == {"debits": 1000000.0, "credits": 1750000.0, "net": 750000.0, "ending_balance": 750000.0}
    assert one["transacciones"][0]["items"][0]["date"] == "2026-04-05" and "reference" not in one["transacciones"][0]["items"][0] and tree["bare"]["renta_fija"] == [] and one["currency"] == "COP"
    figures = {r.statement_id: json.loads(r.json) for r in reports.analysis_json(done).collect()}
    assert figures["one"]["avanzadas"]["hhi_categoria"] == "moderado" and figures["one"]["tasas_valoracion"]["count"] == 4 and figures["one"]["alertas"][0]["type"] == "INFO" and figures["one"]["avanzadas"]["config"]["tasa_libre_riesgo"] == 0.0925
    assert figures["one"]["rendimientos_fic"]["Ultimo Año"] == near(11.66) and figures["bare"]["composicion_porcentaje"] == {} and set(figures["bare"]) == set(figures["one"])
    grid = {r.field: r.value for r in reports.analysis_grid(done).where("statement_id = 'one'").collect()}
    assert grid["% FIC"] == "31,39 %" and grid["[INFO]"].startswith("Crecimiento") and grid["Vence <90d"] == "$ 2.191.600.000,00"
    fund = {r.field: r.value for r in reports.fund_grid(done.funds, "statement_id").collect()}
    assert fund["Nombre Fondo"] == "FIC Renta Liquida" and fund["Nuevo Saldo"] == "$ 2.004.608.978,68" and "Unidades" not in fund and fund["Rentab. Mensual"] == "3,35 %"
    assert "9,76 %" in {r.face_rate for r in reports.instrument_grid(done.instruments, "statement_id").collect()}


def test_an_instrument_listed_twice(spark):
    twice = SAMPLE | {"sections": [dict(SAMPLE["sections"][1], items=SAMPLE["sections"][1]["items"][:2] + [dict(SAMPLE["sections"][1]["items"][0], face_rate=1.0)])]}
    s = spark.createDataFrame([("one", json.dumps(twice))], "statement_id string, j string")
    s = s.select("statement_id", statement.parse(s.j).alias("s")).select("statement_id", "s.*")
    r = Analysis(s).kpis().first()
    assert {k: round(v, 4) for k, v in r.spreads.items()} == {"CDTBANCO01": 10.6688, "CDTBANCO02": 1.51}
