"""JSON statements (version 1): reading, and mapping to the typed tables. Each row holds one statement, so no mapping shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fraction_to_percent, or_zero
from ..schemas import STATEMENT

# fixed values: section types, and the names under which returns are kept
SECTIONS = ["cash_balance", "fixed_income", "investment_fund", "transactions"]
RETURNS = {"monthly": "Mensual", "semi_annual": "Semestral", "ytd": "YTD", "last_year": "Ultimo Año", "last_2_years_annualized": "2 Años", "last_3_years_annualized": "3 Años"}
ASSETS = {"fixed_income": "Renta Fija", "investment_fund": "FIC", "cash_balance": "Saldos en Efectivo"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per file. Text that is no JSON, or has fields of a wrong type, is also kept in _corrupt; such fields are null, the others are read. A missing path raises."""
    return spark.read.schema(STATEMENT + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def parse(text: Column) -> Column:
    """A struct of the statement; fields of a wrong type are null."""
    return F.from_json(text, STATEMENT)


def _of(kind: str) -> Column:
    return F.filter("sections", lambda s: s["section_type"] == kind)


def _sum(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, i: a + F.coalesce(i[field], F.lit(0.0)))


def _section_total(s: Column, field: str) -> Column:
    """The subtotal if given, else the sum of the items."""
    return F.coalesce(s["subtotal"], _sum(F.coalesce(s["items"], F.array()), field))


def header(df: DataFrame, *keys: str) -> DataFrame:
    """The statement row: who, when, totals, the asset map and warnings. The total falls back to the sum of the assets."""
    add = lambda kind, field: F.aggregate(_of(kind), F.lit(0.0), lambda a, s: a + _section_total(s, field))
    last_fund = or_zero(F.try_element_at(F.transform(_of("investment_fund"), lambda s: s["movements"]["new_balance"]), F.lit(-1)))
    entries = [(ASSETS["fixed_income"], "fixed_income", add("fixed_income", "market_value")), (ASSETS["investment_fund"], "investment_fund", last_fund), (ASSETS["cash_balance"], "cash_balance", add("cash_balance", "total"))]
    pairs = F.array_compact(F.array(*[F.when(F.size(_of(kind)) > 0, F.struct(F.lit(name).alias("k"), v.alias("v"))) for name, kind, v in entries]))
    d = df.withColumn("activos", F.map_from_entries(pairs))
    total = or_zero(F.coalesce("summary.net_worth", "summary.total_assets"))
    assets = F.aggregate(F.map_values("activos"), F.lit(0.0), lambda a, v: a + v)
    warnings = F.array_compact(F.array(F.when(~F.col("schema_version").eqNullSafe("1.0"), "unknown version"), F.when(F.exists("sections", lambda s: ~s["section_type"].isin(SECTIONS)), "unknown section"), F.when(F.col("sections").isNull(), "no sections")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return d.select(
        *keys, F.col("period.end_date").alias("fecha_extracto"), text("account_holder.full_name").alias("nombre_cliente"), text("account_holder.id_number").alias("nit"), text("account_holder.city").alias("ciudad"),
        F.coalesce("currency", F.lit("COP")).alias("currency"), "activos", or_zero(F.col("summary.total_assets")).alias("total_activos"), or_zero(F.col("summary.total_liabilities")).alias("total_pasivos"),
        F.when(total == 0, assets).otherwise(total).alias("total_portafolio"), warnings.alias("warnings"),
    )


def _items(df: DataFrame, kind: str, keys: tuple[str, ...]) -> DataFrame:
    return df.select(*keys, F.posexplode(F.flatten(F.transform(_of(kind), lambda s: F.coalesce(s["items"], F.array())))).alias("pos", "i"))


def instruments(df: DataFrame, *keys: str) -> DataFrame:
    i = _items(df, "fixed_income", keys)
    rate = lambda c: or_zero(F.col(f"i.{c}")).alias(c)  # noqa: E731  already percentages, unlike funds' returns
    return i.select(*keys, "pos", "i.instrument_id", "i.issuer", "i.issue_date", "i.maturity_date", "i.purchase_date", rate("face_rate"), rate("negotiated_rate"), rate("valuation_rate"), F.coalesce("i.payment_frequency", F.lit("")).alias("payment_frequency"), or_zero(F.col("i.nominal_value")).alias("nominal_value"), or_zero(F.col("i.market_value")).alias("market_value"))


def cash(df: DataFrame, *keys: str) -> DataFrame:
    i = _items(df, "cash_balance", keys)
    return i.select(*keys, "pos", F.coalesce("i.account_name", "i.account_id", F.lit("")).alias("account"), *[or_zero(F.col(f"i.{c}")).alias(c) for c in ("available", "in_transit", "blocked", "total")])


def funds(df: DataFrame, *keys: str) -> DataFrame:
    """An absent horizon is kept as 0; returns become percentages."""
    f = df.select(*keys, F.posexplode(_of("investment_fund")).alias("pos", "s"))
    returns = F.map_from_arrays(F.array(*map(F.lit, RETURNS.values())), F.array(*[fraction_to_percent(F.col(f"s.historical_returns.{c}")) for c in RETURNS]))
    return f.select(*keys, "pos", "s.fund.name", "s.fund.code", *[or_zero(F.col(f"s.movements.{c}")).alias(c) for c in ("previous_balance", "additions", "withdrawals", "returns", "new_balance", "units", "unit_value_end")], returns.alias("returns_by_horizon"))


def accounts(df: DataFrame, *keys: str) -> DataFrame:
    """Totals as given, where an absent one of them is 0; without any, those of the transactions."""
    a = df.select(*keys, F.posexplode(_of("transactions")).alias("pos", "s"))
    items, t = F.coalesce(F.col("s.items"), F.array()), F.col("s.totals")
    debit, credit = _sum(items, "debit"), _sum(items, "credit")
    pick = lambda c, v: F.when(t.isNotNull(), or_zero(F.col(f"s.totals.{c}"))).otherwise(v).alias(c)
    return a.select(*keys, F.col("s.account_id").alias("account_id"), F.size(items).alias("n"), pick("debits", debit), pick("credits", credit), pick("net", credit - debit))


def transactions(df: DataFrame, *keys: str) -> DataFrame:
    a = df.select(*keys, F.explode(_of("transactions")).alias("s"))
    a = a.select(*keys, F.col("s.account_id").alias("account_id"), F.posexplode(F.coalesce(F.col("s.items"), F.array())).alias("pos", "i"))
    return a.select(*keys, "account_id", "pos", "i.date", "i.value_date", "i.description", "i.reference", "i.category", or_zero(F.col("i.debit")).alias("debit"), or_zero(F.col("i.credit")).alias("credit"), "i.balance_after", F.col("i.balance_after").isNotNull().alias("has_balance"))
