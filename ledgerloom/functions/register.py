"""The domain functions as SQL functions of a session: SELECT parse_cop_number(x), hhi_category(h), ..."""

from __future__ import annotations

from pyspark.sql import SparkSession

# the text with points for blanks between digits; the last separator of an amount with decimals marks them; else a grouped number, else plain digits
_REPAIRED = r"regexp_replace(coalesce(s, ''), '(?<=\\d) +(?=\\d)', '.')"
_HIT = rf"regexp_extract({_REPAIRED}, '(-?\\d[\\d.,]*[.,]\\d{{1,2}}(?!\\d))', 1)"
AMOUNT = (
    rf"if({_HIT} <> '', coalesce(try_cast(concat(translate(regexp_replace({_HIT}, '[.,]\\d{{1,2}}$', ''), '.,', ''), '.', regexp_extract({_HIT}, '(\\d{{1,2}})$', 1)) AS DOUBLE), 0D), "
    rf"coalesce(try_cast(translate(regexp_extract({_REPAIRED}, '(-?\\d{{1,3}}(?:[.,]\\d{{3}})+)(?!\\d)', 1), '.,', '') AS DOUBLE), try_cast(regexp_extract({_REPAIRED}, '(-?\\d+)', 1) AS DOUBLE), 0D))"
)
FUNCTIONS = {
    "norm_es(s STRING) RETURNS STRING": "translate(lower(s), 'áéíóúñ', 'aeioun')",
    "format_cop_money(v DOUBLE) RETURNS STRING": "concat(if(v < 0, '-', ''), '$ ', translate(format_number(abs(v), 2), ',.', '.,'))",
    "parse_cop_number(s STRING) RETURNS DOUBLE": AMOUNT,
    "parse_cop_percent(s STRING) RETURNS DOUBLE": AMOUNT,
    "fuzzy_contains(text STRING, needle STRING, distance INT) RETURNS BOOLEAN": "coalesce(contains(text, needle) or (length(text) < length(needle) - distance and levenshtein(text, needle) <= distance) or (distance > 0 and length(text) >= length(needle) - distance and exists(sequence(1, greatest(1, length(text))), i -> exists(sequence(greatest(1, length(needle) - distance), length(needle) + distance), k -> i + k - 1 <= length(text) and levenshtein(substr(text, i, k), needle) <= distance))), false)",
    "parse_colombian_number(s STRING) RETURNS DOUBLE": r"coalesce(try_cast(regexp_extract(regexp_replace(translate(regexp_replace(coalesce(s, ''), '[$ \\t.]', ''), ',', '.'), '[^0-9.\\-]', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)', 0) AS DOUBLE), 0D)",
    "to_iso_date(s STRING) RETURNS STRING": r"if(s RLIKE '(\\d{1,2})[-./ ](\\d{1,2})[-./ ](\\d{4})', concat_ws('-', regexp_extract(s, '(\\d{1,2})[-./ ](\\d{1,2})[-./ ](\\d{4})', 3), lpad(regexp_extract(s, '(\\d{1,2})[-./ ](\\d{1,2})[-./ ](\\d{4})', 2), 2, '0'), lpad(regexp_extract(s, '(\\d{1,2})[-./ ](\\d{1,2})[-./ ](\\d{4})', 1), 2, '0')), s)",
    "hhi_category(x DOUBLE) RETURNS STRING": "CASE WHEN x < 1500 THEN 'bajo' WHEN x < 2500 THEN 'moderado' ELSE 'alto' END",
    "maturity_bucket(d INT) RETURNS STRING": "CASE WHEN d < 90 THEN '<90d' WHEN d < 365 THEN '90-365d' WHEN d < 1095 THEN '365d-3a' ELSE '>3a' END",
    "real_return(nominal DOUBLE, inflation DOUBLE) RETURNS DOUBLE": "(1 + nominal) / (1 + inflation) - 1",
    "sharpe_ratio(r DOUBLE, sigma DOUBLE, rf DOUBLE) RETURNS DOUBLE": "coalesce(try_divide(r - rf, nullif(sigma, 0D)), 0D)",
}


def register(spark: SparkSession) -> list[str]:
    """Create them as temporary SQL functions, which the optimizer inlines; returns their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
