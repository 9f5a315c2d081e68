import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import geometry, register
from ledgerloom.operators import layout, legacy
from ledgerloom.operators import template_v1 as T1

BLOCK = "array<struct<y:int,x:int,w:int,h:int,text:string,confidence:double>>"


def row(*words):
    return [(0, i * 50, 40, 20, w, 0.8) for i, w in enumerate(words)]


def test_values_of_lines(spark):
    d = spark.createDataFrame([(1, row("CDT", "5,5", "%", "$1.000,50", "$2,00")), (2, row("x", "7%", "9", "E.A.")), (3, row("a"))], f"i int, b {BLOCK}")
    r = d.select(layout.half_text(F.col("b")).alias("l"), layout.half_text(F.col("b"), True).alias("r"), layout.first_money(F.col("b")).alias("m"), layout.last_percent(F.col("b")).alias("p"), layout.percent_text(F.col("b")).alias("t")).collect()
    assert (r[0].l, r[0].r, r[0].m, r[0].p, r[0].t) == ("CDT 5,5", "% $1.000,50 $2,00", "$1.000,50", "%", "5,5")
    assert (r[1].p, r[1].t, r[1].m) == ("7%", "7%", "") and (r[2].l, r[2].r, r[2].p, r[2].t) == ("a", "", "", None)


def test_columns_and_cells(spark):
    d = spark.sql("select array(0, 100, 200) c, array(0, 50, 100) r, array(named_struct('y', 10, 'x', 10, 'w', 60, 'h', 20, 'text', 'a', 'confidence', 0.5D), named_struct('y', 10, 'x', 80, 'w', 60, 'h', 20, 'text', 'b', 'confidence', 1D), named_struct('y', 60, 'x', 20, 'w', 20, 'h', 20, 'text', 'c', 'confidence', 1D), named_struct('y', 500, 'x', 0, 'w', 9, 'h', 9, 'text', 'out', 'confidence', 1D)) b")
    d = d.withColumn("g", layout.cells(F.col("r"), F.col("c")))
    x = d.select(F.size("g").alias("n"), layout.cell_texts(F.col("b"), F.col("g")).alias("t"), *[layout.column_at(F.lit(v), F.col("c")).alias(f"k{v}") for v in (0, 99, 100, 250)]).first()
    assert x.n == 4 and (x.k0, x.k99, x.k100, x.k250) == (0, 0, 1, 2)
    assert {(t.row, t.col): (t.text, t.confidence) for t in x.t} == {(0, 0): ("a", 0.5), (0, 1): ("b", 1.0), (1, 0): ("c", 1.0), (1, 1): ("", 0.0)}


def test_corners(spark):
    d = spark.createDataFrame([([(100.0, 0.0), (0.0, 0.0), (0.0, 50.0), (100.0, 50.0)],), ([(0.0, 0.0), (100.0, 0.0), (180.0, 50.0), (80.0, 50.0)],)], "p array<struct<x:double,y:double>>")
    r = d.select(geometry.sort_corners(F.col("p")).alias("c")).withColumn("s", geometry.rectangularity(F.col("c"))).collect()
    assert [(p.x, p.y) for p in r[0].c] == [(0, 0), (100, 0), (100, 50), (0, 50)] and r[0].s == pytest.approx(1) and r[1].s < 0.5
    t = spark.createDataFrame([("Orientation in degrees: 270\nOrientation confidence: 3.1\nPages:   12",), ("Orientation in degrees: 90\nOrientation confidence: 0.1",)], "t string")
    assert [tuple(x) for x in t.select(geometry.orientation(F.col("t")), geometry.page_count(F.col("t"))).collect()] == [(270, 12), (None, None)]


def test_label_driven_parser(spark):
    text = ["Bogota 05 de Marzo 2026", "Cliente: Ana Perez 900123456", "Ciudad: Cali", "Saldo anterior $1.000,00", "Nuevo saldo $2.500,50", "Mensual 3,35 %", "Ultimo ano 11,66% E.A.", "Mensual 4,00 %", "0012 1.000,00 0,00 5,00 1.005,00"]
    blocks = [(y * 40, x * 100, 90, 20, w, 0.9) for y, s in enumerate(text) for x, w in enumerate(s.split(" "))]
    p = T1.prepared(layout.with_lines(spark.createDataFrame([(1, blocks)], f"id int, blocks {BLOCK}"), first_fit=True))
    c = legacy.client(p, "id").first()
    assert (c.nombre_cliente, c.nit, c.ciudad, str(c.fecha)) == ("Ana Perez", "900123456", "Cali", "2026-03-05")
    assert {r.label: r.value for r in legacy.movements(p, "id").collect()} == {"saldo anterior": 1000.0, "nuevo saldo": 2500.5}
    assert {r.horizon: r.pct for r in legacy.horizon_returns(p, "id").collect()} == {"mensual": 4.0, "ultimo ano": 11.66}
    last = legacy.cash_rows(p, "id").orderBy(F.desc("pos")).first()
    assert (last.account, last.available, last.in_transit, last.blocked, last.total) == ("0012", 1000.0, 0.0, 5.0, 1005.0)


def test_misspelt_labels_and_titles(spark):
    text = ["EXTRACT0 DE INVERSIONES", "Cliemte: Ana", "NIT/CC: 1", "Periodo: 01/02/2026 - 28/02/2026", "RESUMEM P0RTAFOLIO", "TOTAL $ 1.000,00", "RENTA FIJA DETALLE", "CDT1 01/01/2025 01/01/2026 5,00% TV 6,00% $1.000.000,00 $1.100.000,00"]
    blocks = [(y * 40, x * 100, 90, 20, w, 0.9) for y, s in enumerate(text) for x, w in enumerate(s.split(" "))]
    p = T1.prepared(layout.with_lines(spark.createDataFrame([(1, blocks)], f"id int, blocks {BLOCK}"), first_fit=True))
    assert p.select(T1.score(p).alias("s")).first().s >= 5
    h = T1.header(p, "id").first()
    assert (h.client, h.nit, str(h.end_date)) == ("Ana", "1", "2026-02-28") and T1.summary(p, "id").first().total == 1000.0
    i = T1.instruments(p, "id").first()
    assert (i.name, i.face_rate, i.negotiated_rate, i.valuation_rate, i.period, i.nominal_value, i.market_value) == ("CDT1", 5.0, 6.0, None, "TV", 1e6, 1.1e6)


def test_sql_functions(spark):
    assert len(register.register(spark)) == len(register.FUNCTIONS)
    r = spark.sql("select norm_es('ÁÑo'), format_cop_money(-1234.5D), parse_colombian_number('$ 1.234,50'), to_iso_date('5/3/2026'), hhi_category(2000D), maturity_bucket(365), real_return(0.1D, 0D), sharpe_ratio(1D, 0D, 0D)").first()
    assert tuple(r)[:6] == ("ano", "-$ 1.234,50", 1234.5, "2026-03-05", "moderado", "365d-3a") and r[6] == pytest.approx(0.1) and r[7] == 0


def test_sql_functions_agree_with_the_column_functions(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import numbers, text

    register.register(spark)
    d = spark.createDataFrame([(s,) for s in ("$1.234.567,89", "$ 12 345,67", "1.000.000", "-5,5%", "abc", "", None, "7", "3.5.2020 1,25")], "s string")
    d.createOrReplaceTempView("amounts")
    both = spark.sql("SELECT s, parse_cop_number(s) AS a, parse_cop_percent(s) AS p FROM amounts").withColumn("b", numbers.parse_cop_number(F.col("s")))
    assert all(r.a == r.p == r.b for r in both.collect())
    t = spark.createDataFrame([(s,) for s in ("RESUMFN DEL PORTAFOLIO", "RESUMEN", "RESU", "otra cosa", "", None, "XRSUMENX")], "t string")
    t.createOrReplaceTempView("titles")
    for distance in (0, 1, 2):
        got = spark.sql(f"SELECT t, fuzzy_contains(t, 'RESUMEN', {distance}) AS a FROM titles").withColumn("b", text.fuzzy_contains(F.col("t"), "RESUMEN", distance))
        assert all(r.a == r.b for r in got.collect()), distance


def test_fuzzy_search_looks_at_long_lines_too(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import text

    words = " ".join(f"palabra{k}" for k in range(60))
    t = spark.createDataFrame([(f"{words} PORTAFOLO {words}",), (words,), (f"{words} POTAFLIO",)], "t string")
    assert [r[0] for r in t.select(text.fuzzy_contains(F.col("t"), "PORTAFOLIO", 2)).collect()] == [True, False, True]
