"""python -m ledgerloom STATEMENTS [--history CSV] [--config JSON] [--out FOLDER]: analyse JSON statements and write all exports."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import config
from .plans.analysis import Analysis
from .session import session
from .sources import files, statement


def main() -> None:
    p = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    p.add_argument("statements")
    p.add_argument("--history", help="totals by date, for all statements")
    p.add_argument("--config")
    p.add_argument("--out", default="output")
    a = p.parse_args()
    spark = session()
    read = statement.read(spark, a.statements).withColumn("statement_id", F.col("_metadata.file_path")).where("sections is not null")
    history = None
    if a.history:
        h = files.history(spark, a.history).select(F.col("fecha_extracto").alias("period"), F.col("total_portafolio").alias("total"), F.lit(1).alias("all"))
        history = read.select("statement_id", F.lit(1).alias("all")).join(h, "all").drop("all")  # every statement has the whole history; Spark broadcasts it only if it is small
    done = Analysis(read, history, config.load(spark, a.config) if a.config else config.FinanceConfig())
    done.kpis().show(truncate=False, vertical=True)
    done.alerts().orderBy("statement_id", "seq").show(truncate=False)
    print("\n".join(done.export(a.out)))


if __name__ == "__main__":
    main()
