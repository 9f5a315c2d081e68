"""Benchmark decontamination by size-partitioned MinHash containment search.

How much of a short test item lies in a document is |item ∩ document| / |item|, over n-word shingles: n is five, or the item's words if it has fewer. Plain MinHash compares by
the union and loses short items in long documents; here the items are partitioned by size, and each partition has a bottom-k sketch of its own and a cut: the largest hash that
any sketch of the partition retains. A document is sketched once per partition, by all its shingles hashed below the cut, however long it is, so every
retained value of an item that the document contains is found. The document's sketch is looked up in an inverted list of the items' retained values, and only items that it hits are counted:
the time for a document grows with its own sketch and its hits, and with the logarithm of the number of items.
An item of which the document holds at least a third of the retained values is a candidate, and exact shingle containment decides.

An item of containment 0.75 or more shows fewer than a third of k = 24 retained values with a probability below 1e-5; items of at most
k shingles are retained whole, so none is missed.

The index of items is broadcast only while its size, checked beforehand, is at most `BROADCAST_BYTES`; a larger benchmark is searched in slices of
that size, one after the other: each pass over the documents writes the few matches it finds, under the digest of the text, and lets go of its slice. The result is the same.

Defined results: items and documents without words (null, empty) match nothing; an item of fewer than five words is contained in every document that has these words in this
sequence; repeated items all match, of items contained alike the least item_id is reported; items with a null id are left out; repeated rows are judged alike, whatever their ids; an empty
table on either side means no contamination; other columns of the documents pass through `decontaminate` untouched, whatever their names, unless named contained_item, containment or contaminated,
which the results replace.
"""

from __future__ import annotations

import bisect
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 5
CONTAINED = (75, 100)
K = 24
#: Upper bounds of the items' sizes in shingles; each partition is twice as wide as the one before.
SIZES = (16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 1 << 60)
BROADCAST_BYTES = 64 << 20


class Index:
    """The items of one slice: by shingle length and size partition, inverted lists of retained values; and the full sets for verification.

    Lists are three arrays: the distinct retained values in order, where each one's items begin, and the items.
    """

    def __init__(self, rows: list[tuple[int, str | None]], k: int = K):
        rows = [(i, t) for i, t in rows if i is not None]
        off, code, names = C.split_words(pa.array([t for _, t in rows], pa.string()), lower=True)
        flat, length = C.word_hashes(names)[code], np.diff(off)
        self.items, self.sets, lengths = [], [], []
        for n in np.flatnonzero(length).tolist():
            self.items.append(rows[n][0])
            lengths.append(min(SHINGLE, int(length[n])))
            self.sets.append(np.unique(C.shingle_hashes(flat[off[n] : off[n + 1]], lengths[-1])))
        self.retained = np.array([min(k, len(s)) for s in self.sets], np.int64)
        self.least = np.maximum(1, self.retained // 3)
        self.partitions = []
        groups: dict[tuple[int, int], list[int]] = {}
        for n, s in enumerate(self.sets):
            groups.setdefault((lengths[n], bisect.bisect_left(SIZES, len(s))), []).append(n)
        for (words, _), mine in sorted(groups.items()):
            value = np.concatenate([self.sets[n][:k] for n in mine])
            order = np.argsort(value, kind="stable")
            distinct, begin = np.unique(value[order], return_index=True)
            self.partitions.append((words, distinct[-1], distinct, np.r_[begin, len(value)], np.repeat(mine, self.retained[mine])[order]))
        self.lengths = sorted(set(lengths))

    def search(self, shingles: dict[int, np.ndarray]) -> tuple[int, float] | None:
        """The contained item of the largest containment, then the least id, and that containment. `shingles` has the document's sorted set of each length."""
        best = None
        for words, cut, value, begin, owner in self.partitions:
            whole = shingles[words]
            sketch = whole[: np.searchsorted(whole, cut, side="right")]
            at = np.searchsorted(value, sketch)
            at = at[value[at] == sketch]  # below the cut, so never beyond the end
            if not len(at):
                continue
            hit, seen = np.unique(np.concatenate([owner[begin[i] : begin[i + 1]] for i in at]), return_counts=True)
            for n in hit[seen >= self.least[hit]].tolist():
                inter = len(np.intersect1d(self.sets[n], whole, assume_unique=True))
                if CONTAINED[1] * inter >= CONTAINED[0] * len(self.sets[n]):
                    found = (-inter / len(self.sets[n]), self.items[n])
                    best = found if best is None or found < best else best
        return best and (best[1], -best[0])

    def search_all(self, texts: pa.Array) -> list[tuple[int, float] | None]:
        off, code, names = C.split_words(texts, lower=True)
        flat = C.word_hashes(names)[code]
        rolled = {n: C.shingle_hashes(flat, n) for n in self.lengths}
        return [self.search({n: np.unique(r[i : max(i, j - n + 1)]) for n, r in rolled.items()}) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]


def _slices(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in slices whose sets fit the broadcast bound: a set takes about four times the bytes of its text at most."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0] * 4
    n = -(-size // BROADCAST_BYTES)
    if n <= 1:
        return [benchmark]
    n *= 2  # hashing deals unevenly
    return [benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, contained_item and containment (null where nothing is contained)."""
    spark = docs.sparkSession
    C.ship(spark)
    results = ["contained_item", "containment"]
    slices = _slices(benchmark.select("item_id", "text"))
    text, key = C.fresh("text_", keep), C.fresh("digest_", keep, results)
    d = docs.select(*keep, F.col("text").alias(text))
    kept = ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes)

    def index(part):  # of a checked size
        return spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.collect()]))

    def prober(shared, n, hits_only):
        """A batch function: the first n columns and the results for the text in column n, of all rows or of those with a match."""

        def probe(it):
            for b in it:
                found = shared.value.search_all(b.column(n))
                new = [pa.array([f and f[0] for f in found], pa.int64()), pa.array([f and f[1] for f in found], pa.float64())]
                out = pa.RecordBatch.from_arrays([*b.columns[:n], *new], names=[*b.schema.names[:n], *results])
                yield out.filter(out.column(n).is_valid()) if hits_only else out

        return C.lean(probe)

    if len(slices) == 1:
        return d.mapInArrow(prober(index(slices[0]), len(keep), False), f"{kept}{', ' if keep else ''}contained_item long, containment double")

    matches = []
    for part in slices:
        shared = index(part)
        texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text")
        matches.append(C.stash(texts.mapInArrow(prober(shared, 1, True), "digest string, contained_item long, containment double"), "leaks"))
        shared.destroy()
    union = reduce(DataFrame.unionByName, matches)
    best = union.groupBy("digest").agg(F.min(F.struct((-F.col("containment")).alias("c"), F.col("contained_item").alias("i"))).alias("b"))
    best = C.stash(best.select(F.col("digest").alias(key), F.col("b.i").alias(results[0]), (-F.col("b.c")).alias(results[1])), "leaks-best")
    C.discard(*matches)
    return d.withColumn(key, F.md5(F.col(text).cast("binary"))).join(best, key, "left").select(*keep, *results)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs (with text) and contained_item, containment, contaminated."""
    keep = [c for c in docs.columns if c not in ("contained_item", "containment", "contaminated")]
    return search(docs, benchmark, keep).withColumn("contaminated", F.col("contained_item").isNotNull())


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return search(docs, C.table(spark, sf_dir, "benchmark"), ["doc_id"]).select("doc_id", "contained_item", F.round("containment", 6).alias("containment"), F.col("contained_item").isNotNull().alias("contaminated"))


ORACLE = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
im AS (SELECT row_number() OVER () AS q, item_id, w, least(5, len(w)) AS n FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT q, item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM im),
ns AS (SELECT q, count(*) AS size FROM s GROUP BY 1),
ds AS (SELECT DISTINCT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s FROM dw, (SELECT DISTINCT n FROM im) WHERE len(w) >= n),
c AS (SELECT r, q, item_id, count(*) AS held FROM ds JOIN s USING (n, s) GROUP BY 1, 2, 3),
b AS (SELECT r, arg_min(item_id, (-held / size, item_id)) AS contained_item, max(held / size) AS containment FROM c JOIN ns USING (q) WHERE 100 * held >= 75 * size GROUP BY 1)
SELECT doc_id, contained_item, round(containment, 6) AS containment, contained_item IS NOT NULL AS contaminated FROM dw LEFT JOIN b USING (r)
"""
