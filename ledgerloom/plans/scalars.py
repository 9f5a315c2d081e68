"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import portfolio
from ..sources import views as V
from .base import longs, query, rounded

KEY = V.INSTRUMENT_KEY
KEYS = ", ".join(KEY)
COP = "translate(format('{:,.2f}', abs(v)), ',.', '.,')"


def prices(spark, d):
    return V.table(spark, d, "lineitem").select(*KEY, F.col("l_extendedprice").alias("v"), (F.col("l_discount") * 100 + 0.0).alias("p"))


@query(f"SELECT {KEYS}, '$ ' || {COP} AS money, translate(format('{{:,.2f}}', abs(p)), ',.', '.,') || ' %' AS percent FROM (SELECT {KEYS}, l_extendedprice AS v, l_discount * 100 + 0.0::DOUBLE AS p FROM lineitem)")
def format_cop(spark, d):
    return prices(spark, d).select(*KEY, numbers.format_cop_money(F.col("v")).alias("money"), numbers.format_cop_percent(F.col("p")).alias("percent"))


@query(f"SELECT {KEYS}, round(l_extendedprice, 2) AS value, round(l_extendedprice, 2) AS negated_twice, floor(l_extendedprice) AS whole FROM lineitem")
def parse_cop_number(spark, d):
    """Formatting and parsing back gives the amount; also of negative amounts and of whole ones with grouping only."""
    v = F.col("v")
    whole = F.concat(F.lit("$"), F.translate(F.format_number(F.floor(v), 0), ",", "."))
    return prices(spark, d).select(
        *KEY, numbers.parse_cop_number(numbers.format_cop_money(v)).alias("value"), (-numbers.parse_cop_number(F.concat(F.lit("-"), numbers.format_cop_number(v)))).alias("negated_twice"), numbers.parse_cop_number(whole).alias("whole")
    )


@query(f"SELECT {KEYS}, round(l_discount * 100 + 0.0::DOUBLE, 2) + 0.0::DOUBLE AS pct FROM lineitem")
def parse_cop_percent(spark, d):
    return prices(spark, d).select(*KEY, numbers.parse_cop_percent(numbers.format_cop_percent(F.col("p"))).alias("pct"))


@query(f"SELECT {KEYS}, round(l_extendedprice, 2) AS amount, round(l_discount * 100 + 0.0::DOUBLE, 2) + 0.0::DOUBLE AS rate FROM lineitem")
def parse_colombian(spark, d):
    return prices(spark, d).select(*KEY, numbers.parse_colombian_number(numbers.format_cop_money(F.col("v"))).alias("amount"), numbers.parse_colombian_percentage(F.concat(numbers.format_cop_percent(F.col("p")), F.lit(" E.A."))).alias("rate"))


@query("SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.2f', v / 1e9) || 'B' WHEN v >= 1e6 THEN printf('%.2f', v / 1e6) || 'M' WHEN v >= 1e3 THEN printf('%.1f', v / 1e3) || 'K' ELSE printf('%.2f', v) END AS label FROM (SELECT o_orderkey, floor(o_totalprice) * 1024 AS v FROM orders)")
def format_si(spark, d):
    """Of totals that are whole multiples of 1024, so that no rounding tie arises."""
    return V.table(spark, d, "orders").select("o_orderkey", numbers.format_si(F.floor("o_totalprice").cast("double") * 1024).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT::DOUBLE + 0.5 AS a, 0.0::DOUBLE AS b, l_linenumber::DOUBLE AS c FROM lineitem")
def number_prefix(spark, d):
    q, n = F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string")
    p = numbers.prefix_number
    return V.table(spark, d, "lineitem").select(*KEY, p(F.concat(q, F.lit(".5.6"))).alias("a"), p(F.concat(F.lit("x"), q)).alias("b"), p(F.concat(n, F.lit("-3"))).alias("c"))


@query("SELECT doc_id, md5(translate(lower(coalesce(text, '')), 'áéíóúñ', 'aeioun')) AS normal, md5(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS upper_ascii FROM documents")
def norm_es(spark, d):
    t = F.coalesce("text", F.lit(""))
    return V.table(spark, d, "documents").select("doc_id", F.md5(text.norm_es(t).cast("binary")).alias("normal"), F.md5(text.upper_ascii(t).cast("binary")).alias("upper_ascii"))


@query("SELECT p_partkey, levenshtein(p_name, p_type) AS distance, levenshtein(p_brand, 'Brand#13') <= 1 AS near_brand FROM part")
def levenshtein_match(spark, d):
    return longs(V.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), (F.levenshtein(F.col("p_brand"), F.lit("Brand#13")) <= 1).alias("near_brand")), "distance")


def fuzzy_sql(column: str, needle: str, k: int) -> str:
    n = len(needle)
    near = f"len(list_filter(range(1, length({column}) + 1), lambda i: len(list_filter(range({max(1, n - k)}, {n + k + 1}), lambda l: i + l - 1 <= length({column}) AND levenshtein(substr({column}, i::INT, l::INT), '{needle}') <= {k})) > 0)) > 0"
    return f"CASE WHEN contains({column}, '{needle}') THEN true WHEN length({column}) < {n - k} THEN levenshtein({column}, '{needle}') <= {k} ELSE {near} END"


@query(f"SELECT p_partkey, {fuzzy_sql('p_type', 'STEAL', 2)} AS steel, {fuzzy_sql('p_name', 'gren', 1)} AS green FROM part")
def fuzzy_contains(spark, d):
    return V.table(spark, d, "part").select("p_partkey", text.fuzzy_contains(F.col("p_type"), "STEAL", 2).alias("steel"), text.fuzzy_contains(F.col("p_name"), "gren", 1).alias("green"))


@query("SELECT doc_id, contains(n, 'the') AND contains(n, 'of') AS en, contains(n, 'que') AND contains(n, 'cion') AS es FROM (SELECT doc_id, translate(lower(coalesce(text, '')), 'áéíóúñ', 'aeioun') AS n FROM documents)")
def fuzzy_match(spark, d):
    t = F.coalesce("text", F.lit(""))
    return V.table(spark, d, "documents").select("doc_id", text.fuzzy_match(t, "The OF").alias("en"), text.fuzzy_match(t, "que ción").alias("es"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, o_orderdate::DATE AS parsed, strftime(o_orderdate, '%Y-%m-%d') AS long_form FROM orders", dates=("parsed",))
def iso_dates(spark, d):
    o = V.table(spark, d, "orders").withColumn("dt", F.to_date("o_orderdate"))
    written = F.concat(F.lit("Fecha: "), F.date_format("dt", "d/M/yyyy"), F.lit(" (corte)"))
    month = F.element_at(F.array(*[F.lit(m.title()) for m in dates.MONTHS]), F.month("dt"))
    spelled = F.concat_ws(" ", F.dayofmonth("dt").cast("string"), F.lit("de"), month, F.lit("de"), F.year("dt").cast("string"))
    return o.select("o_orderkey", dates.to_iso_date(written).alias("iso"), dates.any_date(F.date_format("dt", "dd-MM-yyyy")).alias("parsed"), dates.long_date(spelled).alias("long_form"))


@query(f"SELECT {KEYS}, datediff('day', issue_date, maturity_date) AS term, days FROM instruments")
def days_between(spark, d):
    i = V.instruments(spark, d).select(*KEY, dates.days_between(F.col("issue_date"), F.col("maturity_date")).alias("term"), "days")
    return longs(i, "term")


@query("f AS (SELECT holder_id, coalesce(nullif(arg_min(pct, horizon) FILTER (WHERE lower(horizon) LIKE '%ano%' OR lower(horizon) LIKE '%ultimo año%'), 0), avg(pct)) AS ar, coalesce(stddev_samp(pct), 0) AS sigma FROM fund_returns GROUP BY 1), s AS (SELECT holder_id, coalesce((ar - 9.25) / nullif(sigma, 0), 0) AS x FROM f) SELECT holder_id, CASE WHEN x > 1.5 THEN 'positive' WHEN x >= 0 THEN 'warning' ELSE 'negative' END AS status FROM s")
def kpi_status(spark, d):
    f = portfolio.fund_sharpe(V.fund_returns(spark, d), ["holder_id"])
    return f.select("holder_id", portfolio.status(F.lit("sharpe"), F.col("sharpe"), F.lit(None).cast("string")).alias("status"))


@query("""SELECT event_id, CASE WHEN regexp_matches(props, '[,"\\n\\r]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS field FROM events""")
def escape_csv(spark, d):
    return V.table(spark, d, "events").select("event_id", text.escape_csv(F.col("props")).alias("field"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' END AS kind FROM part")
def file_kind(spark, d):
    ext = F.element_at(F.array(*map(F.lit, ("PNG", "jpeg", "Pdf", "txt"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, d, "part").select("p_partkey", text.file_kind(F.concat(F.lit("/in/v1.2/"), F.col("p_partkey").cast("string"), F.lit("."), ext)).alias("kind"))


@query("SELECT p_partkey, upper(replace(p_type, ' ', '')) AS label, len(string_split(p_type, ' ')) AS n_tokens, trim(p_name) AS cleaned FROM part")
def labels_normalized(spark, d):
    t = F.concat(F.lit(" \t"), "p_name", F.lit(" \n"))
    return longs(V.table(spark, d, "part").select("p_partkey", text.normalize_label(F.col("p_type")).alias("label"), F.size(text.split_tokens(F.col("p_type"))).alias("n_tokens"), text.clean_ocr(t).alias("cleaned")), "n_tokens")


@query(r"SELECT doc_id, regexp_extract(coalesce(text, ''), '\$?\s*[\d.,]+') AS money, regexp_matches(coalesce(text, ''), '\$\s*[\d.,]+') AS has_money, regexp_matches(coalesce(text, ''), '[\d.,]+\s*%') AS has_percent FROM documents")
def money_in_text(spark, d):
    t = F.coalesce("text", F.lit(""))
    return V.table(spark, d, "documents").select("doc_id", numbers.extract_money(t).alias("money"), numbers.has_money(t).alias("has_money"), numbers.has_percent(t).alias("has_percent"))


@query("SELECT c_custkey, round(100 * coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0), 2) AS pct, coalesce(c_acctbal / nullif(c_nationkey, 0), 0) AS per_nation FROM customer")
def guarded_numbers(spark, d):
    """The guards: absent as 0 and division by 0 as 0."""
    c = V.table(spark, d, "customer")
    return rounded(c.select("c_custkey", numbers.fraction_to_percent(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))).alias("pct"), numbers.ratio(F.col("c_acctbal"), F.col("c_nationkey")).alias("per_nation")), "pct", digits=2)
