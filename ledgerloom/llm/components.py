"""Connected components of an undirected graph by contraction: every node points to its least neighbour, pointers are followed to
their roots, edges are carried over to the roots, until no edge is left. All state is in DataFrames; the number of rounds is logarithmic in practice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame) -> DataFrame:
    """From (a, b) rows: (id, comp) for each node with a link; comp is the least id reachable. Self-links and repeats are harmless."""
    edges = C.stash(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    both = lambda e: e.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(e.select(F.col("b").alias("id"), F.col("a").alias("to")))
    labels = None
    while True:
        point = C.stash(both(edges).groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("comp")), "cc-point")
        while True:  # follow pointers
            up = point.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
            follow = point.join(up, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"), (F.col("root") != F.col("comp")).alias("moved"))
            follow = C.stash(follow, "cc-point")
            C.discard(point)
            point = follow
            if not point.where("moved").limit(1).count():
                break
        if labels is None:
            new = point
        else:
            new = C.stash(labels.join(point.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "cc-labels")
            C.discard(labels)
        a = point.select(F.col("id").alias("a"), F.col("comp").alias("ra"))
        b = point.select(F.col("id").alias("b"), F.col("comp").alias("rb"))
        left = C.stash(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
        C.discard(edges, *([] if new is point else [point]))
        labels, edges = new, left
        if not edges.limit(1).count():
            C.discard(edges)
            return labels.select("id", "comp")
