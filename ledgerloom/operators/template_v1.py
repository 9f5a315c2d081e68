"""The semantic parser of the version-1 statement template: pages with `lines` to header, summary, instruments, funds and cash.

A page is parsed within its row by native higher-order functions; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_iso_date
from ..functions.numbers import let, once, parse_cop_number, plain_number
from ..functions.text import contains_all, normalize_label, upper_ascii
from .layout import line_text

# fixed values: labels, header tokens, sections and return horizons of the template
LABELS = ["Cliente:", "NIT/CC:", "NIT:", "CC:", "Direccion:", "Ciudad:", "Asesor:", "Periodo:", "Codigo:", "Saldo Anterior:", "Adiciones:", "Retiros:", "Rendimientos:", "Nuevo Saldo:", "Fondo de Inversion:"]
COLUMNS = ["NEMOTECNICO", "F.EMI", "F.VTO", "F.CMP", "T.FACIAL", "PERIODICIDAD", "T.NEGOCIACION", "T.VALORACION", "VALOR NOMINAL", "VALOR MERCADO"]
SECTIONS = {"resumen": ("RESUMEN", "PORTAFOLIO"), "rf": ("RENTA", "FIJA", "DETALLE"), "saldos": ("SALDOS", "EFECTIVO"), "fondo": ("FONDO", "INVERSION")}
PERIODS = ["TV", "MV", "AV", "CV", "SV"]
HORIZONS = {"Mensual": "MENSUAL", "Trimestral": "TRIMESTRAL", "Semestral": "SEMESTRAL", "Año corrido": "(AÑO|ANO) CORRIDO", "Ultimo año": "([UÚ]LTIMO) (AÑO|ANO)", "Ultimos 2 años": "[UÚ]LTIMOS 2"}
#: A heading of the detail table shows at least so many of its columns.
LEAST_COLUMNS = 3
# fixed values: how dates, rates and amounts are written (day, month and year with one mark between; digits and separators)
DATE, PERCENT, MONEY, LOOSE = r"\d{1,2}[-./ ]\d{1,2}[-./ ]\d{4}", r"-?[\d.,]+\s*%", r"\$\s*[\d.,]+[,.]\d{2}", r"\d{1,3}(?:[.,]\d{3})+[.,]\d{2}"


def _escape(s: str) -> str:
    return s.replace(".", r"\.").replace("/", r"\/").replace(" ", r"\s*")


def _any_label() -> str:
    return "|".join(_escape(x) for x in LABELS)


def prepared(pages: DataFrame) -> DataFrame:
    """Pages with `lines`: add `ln`, (i, text, up, tokens) of each line, and where sections start."""
    ln = F.transform("lines", lambda l, i: F.struct(i.alias("i"), line_text(l["blocks"]).alias("text"), upper_ascii(line_text(l["blocks"])).alias("up"), F.transform(l["blocks"], lambda b: b["text"]).alias("tokens")))
    return sections(pages.withColumn("ln", once(ln)))


def sections(pages: DataFrame) -> DataFrame:
    """Pages with `ln`: add where sections start. Titles are looked for among the lines without amounts and rates, which are gathered once."""
    plain = F.filter("ln", lambda l: ~F.contains(l["text"], F.lit("$")) & ~F.contains(l["text"], F.lit("%")))
    d = pages.withColumn("_plain", once(F.transform(plain, lambda l: F.struct(l["i"].alias("i"), l["up"].alias("up")))))
    titles = lambda needles: F.transform(F.filter("_plain", lambda l: contains_all(l["up"], *needles)), lambda l: l["i"])
    d = d.withColumns({f"s_{k}": once(titles(v)) for k, v in SECTIONS.items()}).drop("_plain")
    first = lambda c: F.slice(c, 1, 1)
    return d.withColumn("starts", once(F.sort_array(F.array_distinct(F.concat(first("s_resumen"), first("s_rf"), first("s_saldos"), "s_fondo")))))


def end_of(start: Column) -> Column:
    """The line where the section that starts at `start` ends."""
    return F.coalesce(F.try_element_at(F.filter("starts", lambda s: s > start), F.lit(1)), F.size("ln"))


def between(start: Column) -> Column:
    """The lines of a section, without its title."""
    return F.slice("ln", start + 2, F.greatest(F.lit(0), end_of(start) - start - 1))


def first_start(name: str) -> Column:
    return F.try_element_at(F.col(f"s_{name}"), F.lit(1))


def label_distance(norm: str) -> int:
    """The edit distance at which a blank-free label still counts: a quarter of its length, two at most."""
    return min(2, len(norm) // 4)


def norm(label: str) -> str:
    return label.replace(" ", "").replace("\t", "").upper()


def starts_label(token: Column) -> Column:
    """Whether a word looks like the beginning, or the whole, of a known label."""
    up, plain = upper_ascii(token), normalize_label(token)
    out = F.lit(False)
    for first in sorted({x.split()[0].upper() for x in LABELS}):
        out = out | (F.levenshtein(up, F.lit(first)) <= (1 if len(first) >= 5 else 0))
    for whole in sorted({norm(x) for x in LABELS}):
        out = out | (F.abs(F.length(plain) - len(whole)) <= 2) & (F.levenshtein(plain, F.lit(whole)) <= label_distance(whole))
    return (plain != "") & out


def label_end(tokens: Column, label: str) -> Column:
    """The number of the word, from 1, that ends a label within a line's words, or null: the whole label as one word, exactly, else nearly; else word by word, each nearly; else run together from pieces."""
    parts, whole = label.split(), norm(label)
    most = label_distance(whole)
    at = lambda i: normalize_label(F.get(tokens, i))
    numbers = F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: i < F.size(tokens))
    first = lambda a: F.try_element_at(a, F.lit(1))
    exact = first(F.filter(numbers, lambda i: at(i) == whole))
    near = F.filter(F.transform(numbers, lambda i: F.struct(F.levenshtein(at(i), F.lit(whole)).alias("d"), i.alias("i"), F.length(at(i)).alias("n"))), lambda z: (z["n"] > 0) & (F.abs(z["n"] - len(whole)) <= 2) & (z["d"] <= most))
    found = F.coalesce(exact, F.array_min(near)["i"])
    if len(parts) > 1:
        words = F.lit(True)
        each = lambda i: [F.coalesce(F.levenshtein(at(i + j), F.lit(norm(p))) <= (2 if len(norm(p)) >= 5 else 1), F.lit(False)) for j, p in enumerate(parts)]

        def all_near(i):
            out = words
            for x in each(i):
                out = out & x
            return out

        found = F.coalesce(found, first(F.filter(numbers, all_near)) + len(parts) - 1)
    sizes = F.sequence(F.lit(2), F.lit(max(3, len(parts) + 2)))
    joined = lambda i, k: F.array_join(F.transform(F.slice(tokens, i + 1, k), lambda t: normalize_label(t)), "")
    together = F.flatten(F.transform(numbers, lambda i: F.transform(F.slice(F.filter(sizes, lambda k: (i + k <= F.size(tokens)) & (F.levenshtein(joined(i, k), F.lit(whole)) <= most)), F.lit(1), F.lit(1)), lambda k: i + k - 1)))
    return F.coalesce(found, first(together)) + 1


def label_value(lines: Column, label: str) -> Column:
    """What follows a label, up to the next one: the first that is not empty. Where no line has the label as it is written, one that is misspelt, run together or in pieces counts."""
    pattern = rf"(?i)(?:^|\s){_escape(label)}\s*(.*?)\s*(?=(?:{_any_label()})|$)"
    exact = F.filter(F.transform(lines, lambda l: F.regexp_extract(l["text"], pattern, 1)), lambda v: v != "")

    def value(l):
        rest = F.slice(l["tokens"], label_end(l["tokens"], label), F.size(l["tokens"]))
        rest = F.slice(rest, F.lit(2), F.size(l["tokens"]))
        stop = F.array_position(F.transform(rest, starts_label), True).cast("int")
        return F.array_join(F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest), " ")

    misread = F.filter(F.transform(F.filter(lines, lambda l: label_end(l["tokens"], label).isNotNull()), value), lambda v: v != "")
    return F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(misread, F.lit(1)))


def money_of(line: Column) -> Column:
    return parse_cop_number(F.regexp_extract(line, r"(\$\s*-?[\d.,]+)", 1))


def score(pages: DataFrame) -> Column:
    """How many of nine markers of the template a prepared page shows."""
    near = lambda label: F.exists("ln", lambda l: F.exists(l["tokens"], lambda t: (F.abs(F.length(normalize_label(t)) - len(label)) <= 4) & (F.levenshtein(normalize_label(t), F.lit(label)) <= 2)))
    line = lambda *n: F.exists("ln", lambda l: contains_all(l["up"], *n))
    marks = [near(x) for x in ("CLIENTE:", "NIT/CC:", "PERIODO:", "DIRECCION:", "CIUDAD:", "ASESOR:")] + [line("RESUMEN", "PORTAFOLIO"), line("RENTA", "FIJA"), line("EXTRACTO", "INVERSIONES")]
    out = F.lit(0)
    for m in marks:
        out = out + m.cast("int")
    return out


def header(d: DataFrame, *keys: str) -> DataFrame:
    head = F.slice("ln", 1, F.coalesce(F.try_element_at("starts", F.lit(1)), F.size("ln")))
    periods = F.regexp_extract_all(F.coalesce(label_value(head, "Periodo:"), F.lit("")), F.lit(f"({DATE})"), F.lit(1))
    return d.select(*keys, *[label_value(head, f"{l}:").alias(n) for n, l in (("client", "Cliente"), ("nit", "NIT/CC"), ("address", "Direccion"), ("city", "Ciudad"), ("adviser", "Asesor"))], F.to_date(to_iso_date(F.try_element_at(periods, F.lit(-1)))).alias("end_date"))


def summary(d: DataFrame, *keys: str) -> DataFrame:
    """Amounts of the summary table; a later line of a kind replaces an earlier one."""
    rows = between(first_start("resumen"))
    kind = lambda l: F.when(contains_all(l["up"], "TOTAL"), "total").when(contains_all(l["up"], "RENTA", "FIJA"), "fixed_income").when(F.contains(l["up"], F.lit("FIC")), "funds").when(contains_all(l["up"], "EFECTIVO"), "cash")
    d = d.select(*keys, F.filter(F.transform(rows, lambda l: F.struct(kind(l).alias("k"), money_of(l["text"]).alias("v"))), lambda z: z["k"].isNotNull() & (z["v"] > 0)).alias("r"))
    last = lambda k: F.coalesce(F.try_element_at(F.filter("r", lambda z: z["k"] == k), F.lit(-1))["v"], F.lit(0.0)).alias(k)
    return d.select(*keys, *[last(k) for k in ("fixed_income", "funds", "cash", "total")])


def instruments(d: DataFrame, *keys: str) -> DataFrame:
    """Rows of the detail table that have a name, two dates, an amount and a rate: below its heading, the first line with at least `LEAST_COLUMNS` of its columns, or where that was not read, below the section's title."""
    below = between(first_start("rf"))

    def shown(l):
        """Counts columns; a sum is made without arrays, which every line of a page would have."""
        n = F.lit(0)
        for c in COLUMNS:
            n = n + F.contains(l["up"], F.lit(c)).cast("int")
        return n >= LEAST_COLUMNS

    heading = lambda b: F.array_position(F.transform(b, shown), True).cast("int")
    found = let(below, lambda b: let(heading(b), lambda h: F.transform(F.filter(b, lambda l, i: i >= h), lambda l: l["tokens"])))
    rows = d.where(F.size("s_rf") > 0).select(*keys, once(found).alias("found")).select(*keys, F.posexplode("found").alias("pos", "tokens"))
    # patterns run only over words that have what they look for, and results are looked up by number outside of functions over arrays, which are interpreted
    numeric = lambda t: F.contains(t, F.lit("%")) | F.contains(t, F.lit("$")) | t.rlike(rf"{DATE}|^{LOOSE}$")
    period = F.try_element_at(F.filter("tokens", lambda t: F.length(t).between(2, 3) & F.endswith(F.upper(t), F.lit("V"))), F.lit(1))
    joined = F.array_join(F.transform("tokens", lambda t: F.when(F.contains(t, F.lit(" ")), F.regexp_replace(t, r"(?<=\d) +(?=\d)", ".")).otherwise(t)), " ")
    r = rows.select(*keys, "pos", "tokens", once(joined).alias("s"), once(F.array_position(F.transform("tokens", numeric), True).cast("int")).alias("lead"), once(F.upper(period)).alias("p"))
    r = r.withColumn("s", once(F.when(F.contains("s", F.lit("$ ")), F.regexp_replace("s", r"\$ (?=\d)", r"\$")).otherwise(F.col("s"))))
    r = r.withColumn("s", once(F.when(F.contains("s", F.lit(" %")), F.regexp_replace("s", r"(\d) %", "$1%")).otherwise(F.col("s"))))
    every = lambda p: F.regexp_extract_all("s", F.lit(f"({p})"), F.lit(1))
    r = r.withColumns({"dates": once(every(DATE)), "rates": once(every(PERCENT)), "monies": once(every(MONEY))})
    r = r.withColumn("amounts", once(F.when(F.size("monies") < 2, F.array_distinct(F.concat("monies", every(LOOSE)))).otherwise(F.col("monies"))))
    r = r.withColumn("name", once(F.array_join(F.slice("tokens", 1, F.greatest(F.lit(0), F.col("lead") - 1)), " ")))
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    day = lambda i: F.regexp_replace(at("dates", i), r"^(\d+).(\d+).(\d+)$", "$3-$2-$1").try_cast("date")
    rate = lambda i: plain_number(at("rates", i), lambda x: parse_cop_number(F.replace(x, F.lit("%"), F.lit(""))))
    amount = lambda i: plain_number(at("amounts", i), parse_cop_number)
    fields = {"name": F.col("name"), "issue_date": day(0), "maturity_date": day(1), "purchase_date": day(2), "face_rate": rate(0), "negotiated_rate": rate(1), "valuation_rate": rate(2), "period": F.when(F.col("p").isin(PERIODS), F.col("p")).when(F.col("p").isNotNull(), "TV"), "nominal_value": amount(0), "market_value": F.when(F.size("amounts") > 1, amount(1)).otherwise(amount(0))}
    item = F.struct(*[v.alias(k) for k, v in fields.items()], F.size("dates").alias("nd"), F.size("rates").alias("nr"))
    # the row is made once: a filter would be pushed below, and every pattern matched twice
    r = r.select(*keys, "pos", once(item).alias("z")).where((F.col("z.name") != "") & (F.col("z.nd") >= 2) & (F.col("z.nr") >= 1) & (F.col("z.market_value") > 0))
    return r.select(*keys, "pos", *[F.col(f"z.{k}") for k in fields])


def funds(d: DataFrame, *keys: str) -> DataFrame:
    """One row per fund section: name, code, movements and returns."""
    f = d.select(*keys, "ln", "starts", F.posexplode("s_fondo").alias("pos", "at"))
    f = f.withColumn("own", F.slice("ln", F.col("at") + 1, 1)).withColumn("rest", between(F.col("at")))
    amount = lambda label: parse_cop_number(label_value(F.col("rest"), label))
    plain = F.filter("rest", lambda l: ~l["up"].rlike("SALDO ANTERIOR|ADICIONES|RETIROS|RENDIMIENTOS|NUEVO SALDO|CODIGO") & F.contains(l["text"], F.lit("%")))
    pct = lambda l: parse_cop_number(F.regexp_extract(l["text"], r"(-?[\d.,]+)\s*%\s*$", 1))
    pairs = F.flatten(F.transform(plain, lambda l: F.array_compact(F.array(*[F.when(l["up"].rlike(p) & (pct(l) != 0), F.struct(F.lit(n).alias("k"), pct(l).alias("v"))) for n, p in HORIZONS.items()]))))
    f = f.select(
        *keys, "pos", label_value(F.col("own"), "Fondo de Inversion:").alias("name"), F.split(label_value(F.col("rest"), "Codigo:"), " ")[0].alias("code"),
        *[F.coalesce(amount(l), F.lit(0.0)).alias(n) for n, l in (("previous_balance", "Saldo Anterior:"), ("additions", "Adiciones:"), ("withdrawals", "Retiros:"), ("returns", "Rendimientos:"), ("new_balance", "Nuevo Saldo:"))], pairs.alias("horizons"),
    )
    return f.where("name is not null or new_balance > 0")


def cash(d: DataFrame, *keys: str) -> DataFrame:
    """Rows below the heading of the cash section: the first word is the account."""
    rows = d.where(F.size("s_saldos") > 0).select(*keys, once(between(first_start("saldos"))).alias("r"))
    head = F.array_position(F.transform("r", lambda l: l["up"].rlike("CUENTA|SALDO.*BANCO|BANCO.*SALDO")), True).cast("int")
    rows = rows.withColumn("h", head).where("h > 0").select(*keys, F.posexplode(F.expr("slice(r, h + 1, size(r))")).alias("pos", "l"))
    return rows.where(F.size("l.tokens") >= 2).select(*keys, F.col("l.tokens")[0].alias("account"), money_of(F.col("l.text")).alias("total")).where("total > 0")
