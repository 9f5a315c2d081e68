"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id and may be read up to `max_epochs` times. A document's virtual finish time is
the source's cumulative words up to and including it, divided by the source's target. All documents (of all epochs) are range-sorted by
that time and the sorted sequence is cut where its cumulative words reach the total budget.

Defined results: a null source is a source of its own, the last in order; a null text has size 0 and takes nothing; documents that tie
(repeated rows) are each counted; an empty table gives an empty result; columns other than doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, skey, size) rows: one row per source with source_size and its target.

    The water level is the share per unit of weight at which sources capped at `max_epochs` times their size and the others, in
    proportion to their weights, add up to the size of all. The windows below run over one row per source.
    """
    s = sizes.groupBy("source", "skey").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy("skey")
    rank = F.row_number().over(every) - 1
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.col("source_size") * max_epochs).withColumn("fill", F.col("cap") / F.col("w"))
    full = Window.orderBy("fill", "skey")
    s = (
        s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("capped", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_w", F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("open_w"))
    )
    level = F.min_by(F.when(F.col("level") <= F.col("fill"), F.col("level")), F.when(F.col("level") <= F.col("fill"), F.struct("fill", "skey"))).over(Window.partitionBy())
    return s.withColumn("level", level).select("source", "skey", "source_size", "total", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs (with doc_id, source and text), and the columns named in keep."""
    spark = docs.sparkSession
    base = docs.select(
        "doc_id", "source", *(c for c in keep if c != "source"),
        F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")).alias("skey"),
        C.word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("deal"),
    )
    base = C.stash(base, "mix-sizes")
    goal = targets(base, weights, max_epochs)
    dealt = C.running_sum(base, "skey", ["deal", "doc_id", "size"], "size")
    both = dealt.join(goal.drop("source"), "skey").select("uid", "doc_id", *keep, "skey", "deal", "size", "source_size", "total", "target", "before")
    both = C.stash(both, "mix-dealt")
    turns = both.where("size > 0").select("uid", "skey", "deal", "doc_id", "size", "total", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"), "source_size", "before", "target")
    turns = turns.select("uid", "skey", "deal", "doc_id", "size", "total", "epoch", ((F.col("epoch") * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target")).alias("finish"))
    queue = C.running_sum(turns.withColumn("everything", F.lit("")).withColumnRenamed("uid", "row"), "everything", ["finish", "skey", "epoch", "deal", "doc_id", "size"], "size")
    taken = queue.where(F.col("before") + F.col("size") <= F.col("total")).groupBy(F.col("row").alias("uid")).agg(F.sum("size").alias("taken"))
    return both.join(taken, "uid", "left").select("doc_id", *keep, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce('a' || source, 'b') AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS deal,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS w FROM s0),
s2 AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w::DOUBLE AS fill FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS total,
              ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY fill, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER (ORDER BY fill, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lvl FROM s2),
s AS (SELECT skey, source_size, total, least(cap::DOUBLE, (SELECT arg_min(lvl, (fill, skey)) FROM s3 WHERE lvl <= fill) * w::DOUBLE) AS target FROM s3),
c AS (SELECT d.*, s.source_size, s.total, s.target, row_number() OVER (ORDER BY d.skey, deal, doc_id, size) AS uid,
             (sum(size) OVER (PARTITION BY d.skey ORDER BY deal, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS through
      FROM d JOIN s USING (skey)),
q AS (SELECT uid, size, total, sum(size) OVER (ORDER BY (e * source_size + through)::DOUBLE / target, skey, e, deal, doc_id, size ROWS UNBOUNDED PRECEDING) AS run
      FROM c, (SELECT unnest([0, 1, 2]) AS e) WHERE size > 0),
t AS (SELECT uid, sum(size)::BIGINT AS taken FROM q WHERE run <= total GROUP BY uid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN t USING (uid)
"""
