"""Other files: history CSV, OCR words as TSV, and documents as bytes with a seam for rasterising and OCR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind
from ..schemas import HISTORY, TSV


def history(spark: SparkSession, path: str) -> DataFrame:
    """Totals by date; a missing file gives no rows, rows without a total are dropped."""
    try:
        df = spark.read.schema(HISTORY).option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df = spark.createDataFrame([], HISTORY)
    return df.where("total_portafolio is not null")


def with_current(history: DataFrame, current: DataFrame) -> DataFrame:
    """History and the current statement as (period, total); order by period, not by position."""
    return history.select(F.col("fecha_extracto").alias("period"), F.col("total_portafolio").alias("total")).unionByName(current.select("period", "total"))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of an OCR engine's 12-column TSV, with the file they come from; headings, levels above the word and words without confidence are dropped."""
    df = spark.read.schema(TSV).option("sep", "\t").option("header", True).option("quote", "").option("mode", "DROPMALFORMED").csv(path)
    return words(df.withColumn("file", F.input_file_name()))


def words(df: DataFrame) -> DataFrame:
    return df.where((F.col("level") == 5) & (F.col("conf") >= 0) & (F.trim("text") != "")).withColumn("text", F.trim("text"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, content) of images and PDFs."""
    df = spark.read.format("binaryFile").load(path)
    return df.select("path", file_kind(F.col("path")).alias("kind"), "content").where("kind is not null")


def recognise(docs: DataFrame, engine: Callable[[bytes, str], list[tuple]], schema: str = TSV) -> DataFrame:
    """The seam for rasterising and OCR: `engine` gives the TSV rows of a document's bytes. None is part of this library."""
    import pandas as pd

    def run(it):
        for pdf in it:
            for p, k, c in zip(pdf["path"], pdf["kind"], pdf["content"]):
                rows = engine(bytes(c), k)
                out = pd.DataFrame(rows, columns=[x.strip("` ").split(" ")[0].strip("`") for x in schema.split(", ")])
                out.insert(0, "path", p)
                yield out

    return docs.mapInPandas(run, f"path string, {schema}")
