"""Finance parameters, with per-key overrides from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FinanceConfig:
    # fixed values: the default parameters
    risk_free: float = 0.0925
    inflation: float = 0.048
    benchmark: float = 0.11
    hhi_low: float = 1500.0
    hhi_high: float = 2500.0
    days_short: int = 90
    days_medium: int = 365
    days_long: int = 1095
    outlier_sigma: float = 2.0


#: Where each parameter stands in the JSON file.
KEYS = {
    "risk_free": ("tasa_libre_riesgo_anual",),
    "inflation": ("inflacion_anual",),
    "benchmark": ("benchmark_rendimiento_anual",),
    "hhi_low": ("umbrales_concentracion", "hhi_bajo"),
    "hhi_high": ("umbrales_concentracion", "hhi_alto"),
    "days_short": ("umbrales_duracion_dias", "corto"),
    "days_medium": ("umbrales_duracion_dias", "medio"),
    "days_long": ("umbrales_duracion_dias", "largo"),
    "outlier_sigma": ("umbral_outliers_sigma",),
}


def parse(text: str | None) -> FinanceConfig:
    """Defaults, overridden by every key present with a number; unreadable text gives the defaults."""
    try:
        tree = json.loads(text or "")
    except ValueError:
        return FinanceConfig()
    found = {}
    for f in fields(FinanceConfig):
        x = tree
        for k in KEYS[f.name]:
            x = x.get(k) if isinstance(x, dict) else None
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            found[f.name] = type(f.default)(x)
    return replace(FinanceConfig(), **found)


def load(spark: SparkSession, path: str) -> FinanceConfig:
    """Read through Spark, so that the file may be in any store; a missing file gives the defaults."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except Exception as e:  # only a missing path is tolerated
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return FinanceConfig()
    return parse(row and row.value)
