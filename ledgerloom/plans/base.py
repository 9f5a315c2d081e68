from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
    """Register a query under its function's name; `oracle` is SQL over the domain views. The columns `dates` are given as ISO text on both sides."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def run(spark, d):
            df = f(spark, d)
            return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

        QUERIES[f.__name__] = run
        if oracle:
            sql = views.sql(oracle)
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last bits; results are compared at this precision. Adding 0.0 makes -0.0 plain."""
    return df.withColumns({n: F.round(F.col(n), digits) + F.lit(0.0) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def const(x) -> Column:
    return F.lit(x)
