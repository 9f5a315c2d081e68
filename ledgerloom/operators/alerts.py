"""Rule-based alerts and data-quality checks, one row per finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stats

LOW_RATE = 5.0
CONCENTRATED = 80.0
DIFFERENCE = 0.05


def outliers(instruments: DataFrame, key: list[str], compat: bool = False) -> DataFrame:
    """Instruments whose positive valuation rate is an outlier of the holder's.

    compat looks the outlier's number among the positive rates up among all instruments, and reports what stands there, as the literal rule does; the two differ only where some rates are not positive.
    """
    positive = instruments.where("valuation_rate > 0")
    if not compat:
        return stats.outliers(positive, ["holder_id"], "valuation_rate").select("holder_id", *key, "instrument_id", "valuation_rate")
    w = Window.partitionBy("holder_id").orderBy(*key)
    hit = stats.outliers(positive.withColumn("at", F.row_number().over(w)), ["holder_id"], "valuation_rate").select("holder_id", "at")
    named = instruments.withColumn("at", F.row_number().over(w)).select("holder_id", "at", *key, "instrument_id", "valuation_rate")
    return named.join(hit, ["holder_id", "at"]).drop("at")


def concentrated(shares: DataFrame) -> DataFrame:
    return shares.where(F.col("pct") > CONCENTRATED)


def low_rates(instruments: DataFrame) -> DataFrame:
    return instruments.where((F.col("face_rate") > 0) & (F.col("face_rate") < LOW_RATE))


def negative_returns(funds: DataFrame) -> DataFrame:
    return funds.where("returns < 0")


# fixed values: the texts of alerts and findings
OUTLIER, SHARE, LOSS, LOW, GROWTH = "Tasa de valoracion atipica en ", "Alta concentracion en ", "Rendimiento negativo en fondo: ", "Tasa facial baja en ", "Crecimiento del portafolio: "
NO_CLIENT, NO_TOTAL, NO_FIXED = "Nombre del cliente no encontrado", "Total portafolio es 0 o negativo", "No se encontraron instrumentos de renta fija"
SUM_DIFFERS, NO_VALUE = "Suma de activos difiere del total en mas del 5%", "Instrumento tiene valor mercado <= 0"


def messages(instruments: DataFrame, key: list[str], shares: DataFrame, funds: DataFrame) -> DataFrame:
    """All alerts of single statements as (holder_id, seq, type, message), in their order by rule. funds has holder_id, name and returns."""
    six = lambda c: F.format_string("%.6f%%", F.col(c))
    rows = [
        (1, "WARNING", outliers(instruments, key), F.concat(F.lit(OUTLIER), "instrument_id", F.lit(": "), six("valuation_rate"))),
        (2, "WARNING", concentrated(shares), F.concat(F.lit(SHARE), "asset", F.lit(": "), six("pct"))),
        (3, "CRITICAL", negative_returns(funds), F.concat(F.lit(LOSS), "name")),
        (4, "INFO", low_rates(instruments), F.concat(F.lit(LOW), "instrument_id", F.lit(": "), six("face_rate"))),
    ]
    out = None
    for seq, kind, df, text in rows:
        part = df.select("holder_id", F.lit(seq).alias("seq"), F.lit(kind).alias("type"), text.alias("message"))
        out = part if out is None else out.unionByName(part)
    return out


def growth_message(change_pct: str, n: str):
    return F.concat(F.lit(GROWTH), F.format_string("%.6f", F.col(change_pct)), F.lit("% en "), F.col(n).cast("string"), F.lit(" periodos"))


def validate(statements: DataFrame, instruments: DataFrame) -> DataFrame:
    """(holder_id, rule, detail): the five data-quality rules over statements (holder_id, client, total, total_assets, assets_sum) and their instruments."""
    n = instruments.groupBy("holder_id").agg(F.count(F.lit(1)).alias("n_rf"))
    s = statements.join(n, "holder_id", "left")
    rules = F.array(
        F.when(F.coalesce("client", F.lit("")) == "", NO_CLIENT),
        F.when(~(F.col("total") > 0), NO_TOTAL),
        F.when(F.col("n_rf").isNull(), NO_FIXED),
        F.when((F.col("total_assets") > 0) & (F.col("assets_sum") > 0) & (F.abs(F.col("assets_sum") - F.col("total_assets")) > DIFFERENCE * F.col("total_assets")), SUM_DIFFERS),
    )
    per_statement = s.select("holder_id", F.explode(F.array_compact(rules)).alias("rule")).withColumn("detail", F.lit(""))
    per_row = instruments.where(~(F.col("market_value") > 0)).select("holder_id", F.lit(NO_VALUE).alias("rule"), F.col("instrument_id").alias("detail"))
    return per_statement.unionByName(per_row)
