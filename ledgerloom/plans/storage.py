"""JSON, CSV and TSV round trips over the domain views, and the event stream in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout
from ..schemas import HISTORY, TSV
from ..sources import files, statement
from ..sources import views as V
from ..streaming import events
from . import sinks
from .base import longs, query, rounded

KEY = V.INSTRUMENT_KEY
KEYS = ", ".join(KEY)
ROW = "instrument_id string, issue_date date, maturity_date date, face_rate double, market_value double"


@query(f"SELECT {KEYS}, instrument_id, issue_date, maturity_date, face_rate, market_value FROM instruments", dates=("issue_date", "maturity_date"))
def json_roundtrip(spark, d):
    i = V.instruments(spark, d)
    text = F.to_json(F.struct("instrument_id", "issue_date", "maturity_date", "face_rate", "market_value"))
    return i.select(*KEY, F.from_json(text, ROW).alias("r")).select(*KEY, "r.*")


def statements(spark, d):
    """Version-1 statement texts of all customers, with their instruments and cash."""
    i = V.instruments(spark, d, issuer=True)
    item = F.struct(*[F.col(c) for c in KEY], F.col("instrument_id"), F.col("issuer"), F.col("issue_date"), F.col("maturity_date"), F.col("face_rate"), F.col("valuation_rate"), F.col("payment_frequency"), F.col("nominal_value"), F.col("market_value"))
    per = i.groupBy("holder_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("holder_id"), "c_name", "c_acctbal").join(per, "holder_id", "left")
    fixed = F.struct(F.lit("fixed_income").alias("section_type"), F.coalesce("items", F.array()).alias("items"))
    money = F.struct(F.lit("cash_balance").alias("section_type"), F.array(F.struct(F.lit("001").alias("account_id"), F.col("c_acctbal").alias("total"))).alias("items"))
    text = F.concat(
        F.lit('{"schema_version":"1.0","account_holder":{"full_name":"'), "c_name", F.lit('"},"period":{"end_date":"1998-06-30"},"summary":{"net_worth":0},"sections":['), F.to_json(fixed), F.lit(","), F.to_json(money), F.lit("]}")
    )
    return c.select("holder_id", text.alias("json"))


@query("""i AS (SELECT holder_id, count(*) AS n, sum(market_value) AS mv, sum(face_rate) AS fr FROM instruments GROUP BY 1)
SELECT c_custkey AS holder_id, c_name AS nombre_cliente, 'COP' AS currency, DATE '1998-06-30' AS fecha_extracto, round(coalesce(mv, 0) + c_acctbal, 2) AS total_portafolio, coalesce(n, 0) AS n_instruments, round(coalesce(mv, 0), 2) AS market_value, round(coalesce(fr, 0), 6) AS face_rates, round(c_acctbal, 2) AS cash FROM customer LEFT JOIN i ON holder_id = c_custkey""", dates=("fecha_extracto",))
def load_statement_v1(spark, d):
    """Statements are parsed from their JSON and mapped; the total falls back to the assets."""
    s = statements(spark, d).select("holder_id", statement.parse(F.col("json")).alias("s")).select("holder_id", "s.*")
    h = statement.header(s, "holder_id")
    i = statement.instruments(s, "holder_id").groupBy("holder_id").agg(F.count(F.lit(1)).alias("n_instruments"), F.sum("market_value").alias("market_value"), F.sum("face_rate").alias("face_rates"))
    c = statement.cash(s, "holder_id").groupBy("holder_id").agg(F.sum("total").alias("cash"))
    out = h.select("holder_id", "nombre_cliente", "currency", "fecha_extracto", "total_portafolio").join(i, "holder_id", "left").join(c, "holder_id", "left").na.fill(0, ["n_instruments"]).na.fill(0.0, ["market_value", "face_rates", "cash"])
    return rounded(rounded(out, "face_rates"), "total_portafolio", "market_value", "cash", digits=2)


@query("SELECT segment, period, total FROM history", dates=("period",))
def history_csv(spark, d):
    line = F.concat_ws(",", F.col("period").cast("string"), F.format_string(" %.2f ", "total"), F.lit(""), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"))
    h = V.history(spark, d).select("segment", F.from_csv(line, HISTORY, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return h.select("segment", F.col("r.fecha_extracto").alias("period"), F.col("r.total_portafolio").alias("total"))


@query("SELECT doc_id, line AS line_num, k // 4 AS part, string_agg(text, ' ' ORDER BY k) AS merged, count(*) AS n_words, min(k) * 50 AS x FROM ocr_words WHERE NOT contains(text, chr(9)) GROUP BY 1, 2, 3")
def tsv_word_merge(spark, d):
    """Words written as an OCR engine's TSV, read back and merged where gaps are small: every fourth gap is wide."""
    w = V.ocr_pages(spark, d).select("doc_id", F.posexplode("blocks").alias("n", "b"))
    k = (F.col("b.x") / 50).cast("int")
    left = k * 50 + F.floor(k / 4) * 100
    line = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), (F.col("b.y") / 30).cast("int").cast("string"), k.cast("string"), left.cast("string"), F.col("b.y").cast("string"), F.lit("45"), F.lit("20"), F.lit("90.0"), F.col("b.text"))
    read = w.where(~F.contains("b.text", F.lit("\t"))).select("doc_id", k.alias("k"), F.from_csv(line, TSV, {"sep": "\t", "quote": "", "ignoreLeadingWhiteSpace": "false"}).alias("r")).select("doc_id", "k", "r.*")
    m = layout.merge_words(files.words(read), ["doc_id", "page_num", "block_num", "par_num", "line_num"])
    return m.select("doc_id", F.col("line_num").cast("long").alias("line_num"), F.floor(F.col("x") / 300).alias("part"), F.col("text").alias("merged"), F.col("n").cast("long").alias("n_words"), (F.floor(F.col("x") / 300) * 200).cast("long").alias("x"))


@query("SELECT event_id, '{\"date\":\"' || strftime(ts, '%Y-%m-%d') || '\"' || CASE WHEN event_type = 'error' THEN '' ELSE ',\"reference\":\"' || event_type || '\"' END || '}' AS json FROM events")
def transaction_json(spark, d):
    """Empty fields are left out of the JSON."""
    e = V.table(spark, d, "events")
    ref = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select("event_id", F.to_json(F.struct(F.to_date("ts").alias("date"), ref.alias("reference"))).alias("json"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, instrument_id, printf('%.2f', market_value) AS market_value, payment_frequency FROM instruments")
def instruments_export(spark, d):
    i = V.instruments(spark, d)
    return i.select(*KEY, "instrument_id", sinks.two("market_value"), "payment_frequency")


@query("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 6) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2", dates=("day",))
def events_daily(spark, d):
    """An extension: the daily activity summary whose streaming form is in `streaming.events`."""
    return rounded(events.daily(V.table(spark, d, "events"), exact=True).select(F.to_date("window.start").alias("day"), "event_type", "n", "total", "users"), "total")


@query("SELECT p_partkey, 'hit' AS found FROM part WHERE p_partkey % 2 = 0")
def anti_semi(spark, d):
    """Semi- and anti-join forms that the checks rely on: parts in an even list, none of them in the odd one."""
    p = V.table(spark, d, "part").select("p_partkey")
    even, odd = p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1")
    return longs(p.join(even, "p_partkey", "left_semi").join(odd, "p_partkey", "left_anti"), "p_partkey").withColumn("found", F.lit("hit"))
