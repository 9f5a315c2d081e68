import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom import config
from ledgerloom.functions import dates, numbers, text


def one(spark, f, *values):
    """f over a one-column table of the values, in order."""
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.r for r in d.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_colombian_numbers(spark):
    assert one(spark, numbers.parse_colombian_number, "$4.382.067.330,00", "", None, "12-3", "1.000", "abc", "-5,5") == [4382067330.0, 0.0, 0.0, 12.0, 1000.0, 0.0, -5.5]
    assert one(spark, numbers.parse_colombian_percentage, "11,66 % E.A.", "4,46%", "9.761800", "1.234,5", "5,0 ea", "3 MV", "") == [11.66, 4.46, 9.7618, 1.234, 5.0, 3.0, 0.0]


def test_cop_numbers(spark):
    got = one(spark, numbers.parse_cop_number, "$1.751.945,99 $602.561.945,99", "1.846.624 461,02", "$3.728.754.322.65", "32.067 000,00", "$1.000.000", "$1.000", "100", "", None, "x")
    assert got == [1751945.99, 1846624461.02, 3728754322.65, 32067000.0, 1000000.0, 1000.0, 100.0, 0.0, 0.0, 0.0]
    assert one(spark, lambda v: numbers.parse_cop_number(v, compat=True), "$1.000.000", "$1.000", "100", "$1.234,567") == [1000.0, 1.0, 0.0, 1234.56]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=30))
def test_cop_round_trip(spark, cents):
    d = spark.createDataFrame([(c, c / 100) for c in cents], "c long, v double")
    for r in d.select("c", numbers.parse_cop_number(numbers.format_cop_money(F.col("v"))).alias("p")).collect():
        assert r.p == pytest.approx(r.c / 100, rel=1e-12)


def test_formats(spark):
    d = spark.createDataFrame([(1234567.89,), (-4.46,), (0.0,), (2.5e9,), (999.0,), (1500.0,)], "v double")
    r = d.select(numbers.format_cop_money(F.col("v")).alias("m"), numbers.format_cop_percent(F.col("v")).alias("p"), numbers.format_si(F.col("v")).alias("s")).collect()
    assert r[0].m == "$ 1.234.567,89" and r[1].p == "-4,46 %" and [x.s for x in r] == ["1.23M", "-4.46", "0.00", "2.50B", "999.00", "1.5K"]


def test_dates(spark):
    assert one(spark, dates.to_iso_date, "05/03/2026", "el 5-3-2026.", "1 2 2020", "none", None) == ["2026-03-05", "2026-03-05", "2020-02-01", "none", None]
    assert [str(x) for x in one(spark, dates.any_date, "2026-03-05", "05/03/2026", "05 de Marzo 2026", "31/02/2026", "")] == ["2026-03-05", "2026-03-05", "2026-03-05", "None", "None"]
    assert [str(x) for x in one(spark, lambda v: dates.any_date(v, compat=True), "2026-03-05", "05/03/2026")] == ["2026-03-05", "None"]
    d = spark.sql("select date'2026-01-01' a, date'2026-03-01' b, cast(null as date) c")
    assert d.select(dates.days_between(F.col("a"), F.col("b")), dates.days_between(F.col("b"), F.col("a")), dates.days_between(F.col("a"), F.col("c"), -1)).first() == (59, -59, -1)


def test_fuzzy(spark):
    f = lambda needle, k: lambda v: text.fuzzy_contains(v, needle, k)
    assert one(spark, f("RESUMEN", 2), "EL RESUBEN DEL", "RESUMEN", "NADA", "", "RESUM", None) == [True, True, False, False, True, False]
    assert one(spark, lambda v: text.contains_all(v, "RENTA", "FIJA"), "RENTA F1JA DETALLE", "RENTA", "FIJA RENTA") == [True, False, True]
    assert one(spark, text.norm_es, "ÁÉÍÓÚÑ áéíóúñ ü") == ["aeioun aeioun ü"]
    assert one(spark, text.escape_csv, 'a"b', "a,b", "ab", "a\nb") == ['"a""b"', '"a,b"', "ab", '"a\nb"']
    assert one(spark, text.file_kind, "a.PNG", "b.x.pdf", "c.txt", "d") == ["image", "pdf", None, None]
    assert one(spark, lambda v: text.fuzzy_match(v, "saldo ANTERIÓR"), "El Saldo anterior", "saldo") == [True, False]


def test_config(spark, tmp_path):
    assert config.parse('{"tasa_libre_riesgo_anual": 0.1, "umbrales_concentracion": {"hhi_alto": 3000}, "inflacion_anual": "x"}') == config.FinanceConfig(risk_free=0.1, hhi_high=3000.0)
    assert config.parse("nonsense") == config.FinanceConfig() == config.load(spark, str(tmp_path / "none.json"))
    (tmp_path / "c.json").write_text('{"umbral_outliers_sigma": 3}')
    assert config.load(spark, str(tmp_path / "c.json")).outlier_sigma == 3.0
