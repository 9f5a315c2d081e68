"""Exports. Writers write folders of CSV or JSON files; small reports go to one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CSV = {"header": "true", "quote": '"', "escape": '"'}


def write_csv(df: DataFrame, path: str, single: bool = False) -> str:
    """Fields are quoted only where they must be; quotes are doubled."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(**CSV).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_json_text(df: DataFrame, path: str) -> str:
    """Rows (statement_id, json): one line of JSON each, in the order of the statements."""
    df.orderBy("statement_id").select("json").write.mode("overwrite").text(path)
    return path


def two(c: str, digits: int = 2):
    return F.format_string(f"%.{digits}f", F.col(c)).alias(c)


def statement_report(header: DataFrame) -> DataFrame:
    """(seq, field, value) rows of each statement: identity, assets, totals."""
    fields = [(1, "fecha_extracto"), (2, "nombre_cliente"), (3, "nit"), (4, "ciudad"), (5, "currency")]
    totals = [(7, "total_activos"), (8, "total_pasivos"), (9, "total_portafolio")]
    fixed = F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for n, c in fields], *[F.struct(F.lit(n).alias("seq"), F.lit(c).alias("field"), F.format_string("%.2f", F.col(c)).alias("value")) for n, c in totals])
    assets = F.transform(F.array_sort(F.map_entries("activos")), lambda e: F.struct(F.lit(6).alias("seq"), e["key"].alias("field"), F.format_string("%.2f", e["value"]).alias("value")))
    keys = [c for c in header.columns if c == "statement_id"]
    return header.select(*keys, F.explode(F.concat(fixed, assets)).alias("r")).select(*keys, "r.seq", "r.field", "r.value")


def instruments_report(instruments: DataFrame) -> DataFrame:
    return instruments.select("instrument_id", "issue_date", "maturity_date", "purchase_date", two("face_rate", 4), "payment_frequency", two("nominal_value"), two("negotiated_rate", 4), two("valuation_rate", 4), two("market_value"))


def funds_report(funds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The funds, and their returns by horizon."""
    own = funds.select("name", "code", *[two(c) for c in ("previous_balance", "additions", "withdrawals", "returns", "new_balance")], two("units", 6), two("unit_value_end"))
    returns = funds.select("name", F.explode(F.array_sort(F.map_entries("returns_by_horizon"))).alias("e")).select("name", F.col("e.key").alias("horizon"), F.format_string("%.2f", F.col("e.value")).alias("pct"))
    return own, returns


def export_all(folder: str, header: DataFrame, instruments: DataFrame, funds: DataFrame, alerts: DataFrame, analysis: DataFrame | None = None) -> list[str]:
    """All exports; returns their paths. `analysis` has (statement_id, seq, line): the report of each statement, line by line."""
    own, returns = funds_report(funds)
    parts = {"extracto": statement_report(header), "renta_fija": instruments_report(instruments), "fondos": own, "rentabilidades": returns, "alertas": alerts}
    paths = [write_csv(df, f"{folder}/{name}", single=True) for name, df in parts.items()]
    if analysis is None:
        return paths
    analysis.orderBy("statement_id", "seq").select("line").write.mode("overwrite").text(f"{folder}/analisis")
    return [*paths, f"{folder}/analisis"]


def transaction_json(tx: DataFrame) -> DataFrame:
    """One JSON text per transaction; empty texts and absent balances are left out."""
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).alias(c)
    return tx.select(F.to_json(F.struct("date", "value_date", "description", blank("reference"), blank("category"), "debit", "credit", "balance_after")).alias("json"))
