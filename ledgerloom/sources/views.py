"""The statement data model over the star-schema tables: instruments, cash, funds, history, transactions, OCR blocks.

Each view has a Spark form and the SQL of the same relation, from which the oracles are built. Only the columns a query uses reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-06-30"
INSTRUMENT_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# fixed values: which event type stands for which return horizon
HORIZONS = {"view": "Mensual", "click": "Semestral", "signup": "YTD", "purchase": "Ultimo Año", "error": "2 Años"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession, sf_dir: str, issuer: bool = False, live: bool = False) -> DataFrame:
    """One row per holding of fixed income; days are from the as-of date to maturity. `live` keeps what matures later than that, by a filter that the scan can use."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if live:
        line = line.where(F.col("l_shipdate") >= F.expr(f"timestamp_ntz'{AS_OF} 00:00:00' + interval 1 day"))
    d = line.join(orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    if issuer:
        d = d.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    due = F.to_date("l_shipdate")
    return d.select(
        *INSTRUMENT_KEY, F.col("o_custkey").alias("holder_id"), F.concat(F.lit("CDT"), "l_partkey").alias("instrument_id"), F.to_date("o_orderdate").alias("issue_date"), due.alias("maturity_date"),
        (F.col("l_tax") * 100 + 0.0).alias("face_rate"), (F.col("l_discount") * 100 + 0.0).alias("valuation_rate"), ((F.col("l_tax") + F.col("l_discount")) * 50 + 0.0).alias("negotiated_rate"),
        (F.col("l_quantity") * 1000).alias("nominal_value"), F.col("l_extendedprice").alias("market_value"), F.datediff(due, F.lit(AS_OF).cast("date")).alias("days"),
        F.when(F.col("l_returnflag") == "A", "AV").when(F.col("l_returnflag") == "N", "MV").otherwise("TV").alias("payment_frequency"), *([F.col("s_name").alias("issuer")] if issuer else []),
    )


def cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("holder_id"), F.col("c_acctbal").alias("total"))


def funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("holder_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("new_balance"), (F.col("s_acctbal") / 10).alias("returns"))


def fund_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(holder_id, horizon, pct): a user's mean event value by type, as the fund's return over a horizon."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    horizon = F.element_at(F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv]), F.col("event_type"))
    return e.where(F.col("event_type").isin(*HORIZONS)).groupBy(F.col("user_id").alias("holder_id"), horizon.alias("horizon")).agg((F.avg("value") / 100).alias("pct"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, period, total): order totals by month and market segment."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_credit = F.col("event_type").isin("purchase", "signup")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("account_id"), "ts", F.when(is_credit, F.col("value")).otherwise(0.0).alias("credit"), F.when(is_credit, 0.0).otherwise(F.col("value")).alias("debit")
    )


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(holder_id, asset, value): a holder's order totals by priority, as asset classes."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    return o.groupBy(F.col("o_custkey").alias("holder_id"), F.col("o_orderpriority").alias("asset")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks): each document as one page of word blocks on a regular grid."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    line = lambda s, y: F.transform(
        F.filter(F.split(s, " ", -1), lambda t: t != ""),
        lambda t, x: F.struct((y * 30).cast("int").alias("y"), (x * 50).cast("int").alias("x"), (F.length(t) * 10).cast("int").alias("w"), F.lit(20).alias("h"), t.alias("text"), F.lit(0.9).alias("confidence")),
    )
    return d.select("doc_id", F.flatten(F.transform("lines", line)).alias("blocks"))


#: The same views in SQL.
SQL = f"""
instruments AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey AS holder_id, 'CDT' || l_partkey AS instrument_id, o_orderdate::DATE AS issue_date, l_shipdate::DATE AS maturity_date,
    l_tax * 100 + 0.0::DOUBLE AS face_rate, l_discount * 100 + 0.0::DOUBLE AS valuation_rate, (l_tax + l_discount) * 50 + 0.0::DOUBLE AS negotiated_rate, l_quantity * 1000 AS nominal_value,
    l_extendedprice AS market_value, datediff('day', DATE '{AS_OF}', l_shipdate::DATE)::INTEGER AS days, CASE l_returnflag WHEN 'A' THEN 'AV' WHEN 'N' THEN 'MV' ELSE 'TV' END AS payment_frequency, s_name AS issuer
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey),
cash AS (SELECT c_custkey AS holder_id, c_acctbal AS total FROM customer),
funds AS (SELECT s_suppkey AS holder_id, s_name AS name, s_acctbal AS new_balance, s_acctbal / 10 AS returns FROM supplier),
fund_returns AS (SELECT user_id AS holder_id, CASE event_type WHEN 'view' THEN 'Mensual' WHEN 'click' THEN 'Semestral' WHEN 'signup' THEN 'YTD' WHEN 'purchase' THEN 'Ultimo Año' ELSE '2 Años' END AS horizon, avg(value) / 100 AS pct
    FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase', 'error') GROUP BY 1, 2),
history AS (SELECT c_mktsegment AS segment, date_trunc('month', o_orderdate)::DATE AS period, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
transactions AS (SELECT event_id, user_id AS account_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN value ELSE 0.0::DOUBLE END AS credit, CASE WHEN event_type IN ('purchase', 'signup') THEN 0.0::DOUBLE ELSE value END AS debit FROM events),
composition AS (SELECT o_custkey AS holder_id, o_orderpriority AS asset, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
ocr_lines AS (SELECT doc_id, i - 1 AS line, ls[i] AS s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
ocr_words AS (SELECT doc_id, line, k - 1 AS k, ws[k] AS text FROM (SELECT doc_id, line, ws, unnest(range(1, len(ws) + 1)) AS k FROM (SELECT doc_id, line, list_filter(string_split(s, ' '), lambda t: t <> '') AS ws FROM ocr_lines)))
"""


def sql(body: str) -> str:
    """A query over the views: `body` may begin with further `name AS (...),` and ends with a SELECT."""
    return f"WITH {SQL.strip()}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body.strip()}"
