"""What only large tables showed: rows at a limit, signed zeros, pages of many lines."""

import os
import time

import duckdb
import pytest

from ledgerloom.operators import alerts, layout, stats

SF = "/root/testdata/sf0.001"


def test_rows_at_the_limit_are_no_outliers_in_any_order(spark):
    """6 lies two deviations from the mean of 6, 2, 1, 1, 1, 1."""
    orders = [[6, 1, 1, 1, 2, 1], [1, 1, 6, 1, 2, 1], [6, 1, 1, 1, 1, 2], [2, 1, 1, 1, 1, 6]]
    rows = [(h, i, f"i{i}", float(x)) for h, xs in enumerate(orders) for i, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "holder_id int, pos int, instrument_id string, valuation_rate double").coalesce(1)
    assert stats.outliers(d, ["holder_id"], "valuation_rate").collect() == []
    assert alerts.outliers(d, ["pos"], compat=True).collect() == []
    beyond = spark.createDataFrame([(1, x) for x in (1.0, 1.0, 1.0, 1.0, 2.0, 6.0001)], "h int, x double")
    assert [r.x for r in stats.outliers(beyond, ["h"], "x").collect()] == [6.0001]


@pytest.fixture(scope="module")
def zero_balances(tmp_path_factory):
    """The smallest tables, where every other customer's balance is a negative zero."""
    d = tmp_path_factory.mktemp("zero")
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", d / f)
    os.unlink(d / "customer.parquet")
    duckdb.sql(f"copy (select * replace (case when c_custkey % 2 = 0 then '-0.0'::double else c_acctbal end as c_acctbal) from '{SF}/customer.parquet') to '{d}/customer.parquet' (format parquet)")
    return str(d)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_amount_of_a_negative_zero(spark, zero_balances):
    from ledgerloom.plans import registry

    c = duckdb.connect()
    for f in os.listdir(zero_balances):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{zero_balances}/{f}'")
    want = c.execute(f"select holder_id, label_id, value from ({registry.ORACLES['nearest_right_match']})").fetchall()
    got = [(r.holder_id, r.label_id, r.value) for r in registry.QUERIES["nearest_right_match"](spark, zero_balances).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_long_pages_take_time_in_proportion():
    """Lines far above a block are not tried again."""
    n = 30_000
    began = time.perf_counter()
    lines = layout.first_fit_groups([40 * i for i in range(n)], [20] * n, [0] * n)
    assert [(y, m.tolist()) for y, m in lines] == [(40 * i + 10, [i]) for i in range(n)] and time.perf_counter() - began < 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["parse_v1_cash", "parse_v1_instruments", "parse_misread_cash", "parse_misread_instruments", "labelled_assets"])
def test_pages_are_prepared_once(spark, name):
    """No filter looks for titles again, and only numbers go to Python."""
    from ledgerloom.plans import registry

    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert not [line for line in plan.splitlines() if "Filter " in line and "levenshtein" in line]


def test_words_of_many_pages_are_those_of_each_page():
    """Lines of a whole batch at once, against the fold of each page."""
    import random

    import pyarrow as pa

    pick = random.Random(5)
    block = pa.struct([("y", pa.int32()), ("x", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("text", pa.string()), ("confidence", pa.float64())])

    def page():
        kind, n = pick.randrange(6), pick.randrange(1, 40)
        regular = lambda: dict(y=40 * pick.randrange(6) + pick.randrange(3), x=10 * pick.randrange(5), w=pick.randrange(2), h=20, text=pick.choice(["ab", "Ñá", "", "zZ", None]), confidence=0.9)
        skewed = lambda: dict(y=pick.randrange(-50, 200), x=pick.randrange(90), w=3, h=pick.choice([0, 5, 20, 20, 41]) if kind == 5 else 20, text=pick.choice("abcñ"), confidence=pick.random())
        return None if kind == 0 else [] if kind == 1 else [regular() if kind < 4 else skewed() for _ in range(n)]

    def want(blocks):
        b = sorted((b for b in blocks or [] if b["text"]), key=lambda b: (b["y"], b["x"], b["w"], b["h"], b["text"].encode(), b["confidence"]))
        words = [[b[k]["text"] for k in m] for _, m in layout.first_fit_groups([z["y"] for z in b], [z["h"] for z in b], [z["x"] for z in b])]
        return [{"i": i, "text": " ".join(t), "up": "".join(c.upper() if c.isascii() else c for c in " ".join(t)), "tokens": t} for i, t in enumerate(words)]

    for _ in range(100):
        pages = [page() for _ in range(pick.randrange(12))]
        assert layout._words_of(pa.array(pages, pa.list_(block))).to_pylist() == [want(p) for p in pages]


def test_distances_wait_for_all_needles(spark):
    """A long line that may hold one needle, but not the others, takes no distance."""
    from ledgerloom.functions.text import contains_all
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("R" * 200_000,), ("RENTA FIJA DETALE",), ("RENTA DETALLE",), (None,)], "t string").repartition(1)
    began = time.perf_counter()
    assert {(r.t or "")[:20]: r.v for r in d.select("t", contains_all(F.col("t"), "RENTA", "FIJA", "DETALLE").alias("v")).collect()} == {"R" * 20: False, "RENTA FIJA DETALE": True, "RENTA DETALLE": False, "": False}
    assert time.perf_counter() - began < 15


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["parse_v1_instruments", "parse_misread_instruments"])
def test_rows_are_read_without_functions_over_matches(spark, name):
    """What a pattern found in a row is looked up by number; functions over arrays are interpreted, match by match."""
    from ledgerloom.plans import registry

    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(" in plan and "transform(regexp_extract_all(" not in plan


def test_rows_of_odd_shapes(spark):
    """Rows with fewer dates, rates and amounts, other separators, and days that do not exist."""
    from ledgerloom.operators import template_v1 as T1

    rows = {
        "A": ["CDT A", "1-2-2020", "31.02.2021", "5,5 %", "$ 1.234,50"],
        "B": ["CDT", "B", "01/02/2020", "03/04/2021", "05/06/2021", "-1,25%", "tv", "7.5%", "12%", "$1 234 567,89", "$2.000.000,00"],
        "C": ["C", "01/02/2020", "03/04/2021", "1,00%", "XV", "1.234.567,89", "2,345,678.90"],
        "no rate": ["D", "01/02/2020", "03/04/2021", "$1,00"],
        "one date": ["E", "01/02/2020", "1,00%", "$1,00"],
        "no name": ["01/02/2020", "03/04/2021", "1,00%", "$1,00"],
        "nothing": ["F", "01/02/2020", "03/04/2021", "1,00%", "$0,00"],
    }
    page = [["RENTA", "FIJA", "DETALLE"], ["NEMOTECNICO", "F.EMI", "F.VTO"], *rows.values()]
    d = spark.createDataFrame([(1, [(i, " ".join(t), " ".join(t).upper(), t) for i, t in enumerate(page)])], "k int, ln array<struct<i:int,text:string,up:string,tokens:array<string>>>")
    dates = lambda r: [str(x) if x else None for x in (r.issue_date, r.maturity_date, r.purchase_date)]
    got = {r.name: (dates(r), r.face_rate, r.negotiated_rate, r.valuation_rate, r.period, r.nominal_value, r.market_value) for r in T1.instruments(T1.sections(d), "k").collect()}
    assert got == {
        "CDT A": (["2020-02-01", None, None], 5.5, None, None, None, 1234.5, 1234.5),
        "CDT B": (["2020-02-01", "2021-04-03", "2021-06-05"], -1.25, 7.5, 12.0, "TV", 1234567.89, 2000000.0),
        "C": (["2020-02-01", "2021-04-03", None], 1.0, None, None, "TV", 1234567.89, 2345678.9),
    }
