"""Synthetic statements from seeds: the same seed gives the same statement on every machine, without any state.

Every number is drawn from a digest of the seed and the name of what is drawn, so statements are made within their rows and however many at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUERS = ["BANCO NORTE", "BANCO DEL SUR", "FINANCIERA ORIENTE", "BANCO CENTRAL ANDINO"]
FUNDS = ["FIC Liquidez", "FIC Renta Alta", "FIC Acciones Globales"]
TERMS = [90, 180, 270, 360, 540, 720]
HORIZONS = {"monthly": (0.3, 1.2), "semi_annual": (2.5, 7.0), "ytd": (1.0, 5.0), "last_year": (5.0, 12.0), "last_2_years_annualized": (6.0, 14.0), "last_3_years_annualized": (6.0, 14.0)}


def draw(seed: Column, *name: Column | str) -> Column:
    """A number from 0 up to 1 that depends on the seed and the name alone."""
    key = F.concat_ws(":", seed.cast("string"), *[n.cast("string") if isinstance(n, Column) else F.lit(n) for n in name])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def between(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def thousands(u: Column, low: float, high: float) -> Column:
    """An amount rounded to thousands."""
    return F.round(between(u, low, high) / 1000) * 1000


def pick(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def statements(seeds: DataFrame, seed: str = "seed") -> DataFrame:
    """(seed, json): a version-1 statement for each seed, of two to seven instruments, up to two funds and up to two accounts.

    A fund's new balance is its previous one with additions and returns, less withdrawals; the net worth is the sum of all holdings.
    """
    s = F.col(seed)
    year = 2024 + F.floor(draw(s, "year") * 3).cast("int")
    month = 1 + F.floor(draw(s, "month") * 12).cast("int")
    d = seeds.select(s.alias(seed), F.make_date(year, month, F.lit(1)).alias("start"))
    d = d.withColumn("end", F.last_day("start"))

    def many(name: str, counts: list[int], item) -> Column:
        n = pick(draw(s, name), counts)
        return F.transform(F.filter(F.sequence(F.lit(1), F.lit(max(counts))), lambda i: i <= n), item)

    def paper(i: Column) -> Column:
        u = lambda what: draw(s, "paper", i, F.lit(what))
        bought = F.date_sub("start", F.floor(u("bought") * 200).cast("int"))
        face = F.round(between(u("face"), 7.0, 11.5), 4)
        traded = F.round(face + between(u("traded"), -0.5, 0.8), 2)
        valued = F.round(traded + between(u("valued"), 0.2, 1.5), 2)
        nominal = thousands(u("nominal"), 1e8, 2e9)
        issuer = pick(u("issuer"), ISSUERS)
        value = F.round(nominal * (1 + valued / 100 * (5 + F.floor(u("held") * 86)) / 365), 2)
        return F.struct(
            F.concat(F.lit("CDT "), F.split(issuer, " ")[0], F.lit("-"), i.cast("string")).alias("instrument_id"), issuer.alias("issuer"), bought.alias("issue_date"), F.date_add(bought, pick(u("term"), TERMS)).alias("maturity_date"), bought.alias("purchase_date"),
            face.alias("face_rate"), traded.alias("negotiated_rate"), valued.alias("valuation_rate"), F.lit("TV").alias("payment_frequency"), nominal.alias("nominal_value"), value.alias("market_value"),
        )

    def fund(i: Column) -> Column:
        u = lambda what: draw(s, "fund", i, F.lit(what))
        previous = thousands(u("previous"), 5e7, 3e9)
        added = F.when(u("adds") < 0.4, thousands(u("added"), 0, 2e8)).otherwise(0.0)
        taken = F.when(u("takes") < 0.3, thousands(u("taken"), 0, 1e8)).otherwise(0.0)
        earned = F.round(previous * between(u("earned"), 0.001, 0.012), 2)
        moves = F.struct(previous.alias("previous_balance"), added.alias("additions"), taken.alias("withdrawals"), earned.alias("returns"), F.round(previous + added - taken + earned, 2).alias("new_balance"))
        returns = F.struct(*[(F.round(between(u(h), *r), 2) / 100).alias(h) for h, r in HORIZONS.items()])
        return F.struct(F.lit("investment_fund").alias("section_type"), F.struct(pick(u("name"), FUNDS).alias("name"), F.concat(F.lit("F"), i.cast("string")).alias("code")).alias("fund"), moves.alias("movements"), returns.alias("historical_returns"))

    def account(i: Column) -> Column:
        return F.struct(F.lpad(F.floor(draw(s, "account", i) * 1e10).cast("string"), 10, "0").alias("account_id"), thousands(draw(s, "balance", i), 1e5, 5e7).alias("total"))

    d = d.withColumns({"papers": many("papers", [2, 3, 4, 5, 6, 7], paper), "funds": many("funds", [0, 1, 1, 2], fund), "cash": many("cash", [0, 1, 1, 2], account)})
    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda x, i: x + f(i))
    total = F.round(add("papers", lambda i: i["market_value"]) + add("funds", lambda i: i["movements"]["new_balance"]) + add("cash", lambda i: i["total"]), 2)
    part = lambda kind, items: F.to_json(F.struct(F.lit(kind).alias("section_type"), F.col(items).alias("items")))
    sections = F.concat(F.array(part("fixed_income", "papers")), F.transform("funds", lambda f: F.to_json(f)), F.when(F.size("cash") > 0, F.array(part("cash_balance", "cash"))).otherwise(F.array().cast("array<string>")))
    head = F.to_json(F.struct(F.struct(F.concat(F.lit("Cliente "), s.cast("string")).alias("full_name"), (900000000 + s).cast("string").alias("id_number")).alias("account_holder"), F.struct(F.col("start").alias("start_date"), F.col("end").alias("end_date")).alias("period"), F.struct(total.alias("total_assets"), F.lit(0.0).alias("total_liabilities"), total.alias("net_worth")).alias("summary")))
    text = F.concat(F.lit('{"schema_version":"1.0","sections":['), F.array_join(sections, ","), F.lit("],"), F.substring(head, 2, 1 << 20))  # the head without its first brace
    return d.select(seed, text.alias("json"))
