"""Numbers in statements: Colombian notation to doubles and back. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A plain number at the start of a string.
PREFIX = r"^[+-]?(\d+\.?\d*|\.\d+)"


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def once(value: Column) -> Column:
    """value, which the optimizer takes for not deterministic: it neither repeats it in what follows nor in filters that it would push below."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def prefix_number(s: Column) -> Column:
    """The number that a string starts with, 0.0 if it starts with none."""
    return F.coalesce(F.regexp_extract(s, PREFIX, 0).try_cast("double"), F.lit(0.0))


def parse_colombian_number(s: Column) -> Column:
    """'$4.382.067.330,00' -> 4382067330.0: dots group, a comma marks decimals, other characters do not count."""
    s = F.regexp_replace(F.coalesce(s, F.lit("")), r"[$ \t.]", "")
    return prefix_number(F.regexp_replace(F.translate(s, ",", "."), r"[^0-9.\-]", ""))


def parse_colombian_percentage(s: Column) -> Column:
    """'11,66 % E.A.' -> 11.66. A dot already marks decimals: '1.234,5' -> 1.234."""
    s = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[% \t]", "")
    s = F.regexp_replace(s, r"(e\.a|(?<=.)ea|mv).*$", "")
    return prefix_number(F.regexp_replace(F.translate(s, ",", "."), r"[^0-9.\-]", ""))


def parse_cop_number(s: Column, compat: bool = False) -> Column:
    """The first amount of an OCR text, whichever separators it has; blanks between digits stand for lost points.

    compat keeps the known mis-scaling of amounts without decimals: there the last group of a grouped integer counts as decimals ('$1.000.000' -> 1000.0) and a
    bare integer is 0.
    """
    decimal = r"(-?[\d.,]*\d[.,]\d{1,2})" if compat else r"(-?\d[\d.,]*[.,]\d{1,2}(?!\d))"

    def amount(hit: Column) -> Column:
        """The last separator marks the decimals."""
        return F.concat(F.translate(F.regexp_replace(hit, r"[.,]\d{1,2}$", ""), ".,", ""), F.lit("."), F.regexp_extract(hit, r"(\d{1,2})$", 1)).try_cast("double")

    def whole(s: Column) -> Column:
        if compat:
            return F.lit(0.0)
        grouped = F.translate(F.regexp_extract(s, r"(-?\d{1,3}(?:[.,]\d{3})+)(?!\d)", 1), ".,", "").try_cast("double")
        return F.coalesce(grouped, F.regexp_extract(s, r"(-?\d+)", 1).try_cast("double"), F.lit(0.0))

    repaired = F.regexp_replace(F.coalesce(s, F.lit("")), r"(?<=\d) +(?=\d)", ".")
    return let(repaired, lambda s: let(F.regexp_extract(s, decimal, 1), lambda hit: F.when(hit != "", F.coalesce(amount(hit), F.lit(0.0))).otherwise(whole(s))))


parse_cop_percent = parse_cop_number


def plain_number(s: Column, otherwise) -> Column:
    """`otherwise(s)`, a number as `parse_cop_number` reads it, which is only computed where s is not written as statements do: digits, maybe with points, a comma and one or two decimals, between $ and %. Null for null."""
    bare = s
    for old, new in (("$", ""), ("%", ""), (".", ""), (",", ".")):
        bare = F.replace(bare, F.lit(old), F.lit(new))
    return F.when(s.isNotNull(), F.when(s.rlike(r"^\$?-?\d[\d.]*,\d{1,2}%?$"), bare.try_cast("double")).otherwise(otherwise(s)))


def format_cop_number(v: Column, digits: int = 2) -> Column:
    """1234567.89 -> '1.234.567,89'."""
    return F.translate(F.format_number(F.abs(v), digits), ",.", ".,")


def format_cop_money(v: Column) -> Column:
    """'$ 1.234.567,89', the sign before it."""
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$ "), format_cop_number(v))


def format_cop_percent(v: Column) -> Column:
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), format_cop_number(v), F.lit(" %"))


def fixed(v: Column, digits: int) -> Column:
    """With so many decimals, ties to even. What differs in the last bits only, as sums in another order do, is written alike."""
    return F.format_string(f"%.{digits}f", F.rint(F.round(v, 6) * 10**digits) / 10**digits)


def format_si(v: Column) -> Column:
    """Billions and millions with two decimals, thousands with one, else two."""
    a = F.abs(v)
    return (
        F.when(a >= 1e9, F.concat(fixed(v / 1e9, 2), F.lit("B"))).when(a >= 1e6, F.concat(fixed(v / 1e6, 2), F.lit("M")))
        .when(a >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("K"))).otherwise(fixed(v, 2))
    )


def extract_money(s: Column) -> Column:
    return F.regexp_extract(s, r"\$?\s*[\d.,]+", 0)


def has_money(s: Column) -> Column:
    return s.rlike(r"\$\s*[\d.,]+")


def has_percent(s: Column) -> Column:
    return s.rlike(r"[\d.,]+\s*%")


def fraction_to_percent(x: Column) -> Column:
    """A decimal return as a percentage, absent as 0."""
    return F.coalesce(x, F.lit(0.0)) * 100


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0 or either is absent."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
