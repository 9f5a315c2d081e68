"""A corpus pipeline over `documents`: toxicity filter, near-dedup, benchmark decontamination, source mixing, token output.

Every stage but the last returns the columns of `documents`; each result is written as Parquet to the shared folder and reread.

Defined results: rows are told apart by numbers of their own, so null and shared ids and repeated rows are rows like any other. A null or empty text is scored by the model's bias
alone, is near to nothing, holds no benchmark item, and has no words, so the mix does not take it. Rows with a null id are near-duplicates of nothing, since no id says which of them stays.
Texts are read whole, however long. Columns beyond those of `documents` are dropped by the first stage, whatever their names. Without labels no document goes as toxic, without benchmark
items none as contaminated; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm import decontaminate, mixing, neardup, tokens, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents scored at or above the threshold go. The model learns from the labels of the documents at hand, but for the held-out fold."""
    model = toxicity.learn(docs, C.table(spark, sf_dir, "labels"))
    scored = toxicity.score_texts(docs.select(*COLUMNS), model, keep=tuple(c for c in COLUMNS if c != "text") + ("text",))
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of each group of near-duplicates the row with the least id stays, of equal ids the least hash. Rows are judged by a number of their own in that order, so rows that only share an id do not replace each other; rows without an id stay."""
    n, d = C.partitions(spark), docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_tie"), F.monotonically_increasing_id().alias("_at")).where("doc_id is not null")
    rows = d.repartitionByRange(n, "doc_id", "_tie", "_at").sortWithinPartitions("doc_id", "_tie", "_at").select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    rows = C.stash(rows, "near-rows")
    kept = neardup.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("_row"))
    return rows.join(kept, "_row", "left_semi").select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), C.table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: each row as often as the mix takes it, up to three times; those it does not take go. Rows are told apart by a number, so null and repeated ids are rows like any other."""
    rows = C.stash(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "mix-rows")
    times = mixing.mix_sources(rows, keep=("_row",)).where("taken > 0").select("_row", F.floor(F.col("taken") / F.col("size")).cast("int").alias("times"))
    return rows.join(times, "_row").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the mix as token ids; doc_id, start, n_tokens and ids_crc32 as read back from the files."""
    return tokens.token_output(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix), ("token_output", write_tokens)]

#: Neither the learned scores nor the tokenizer can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = C.stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
