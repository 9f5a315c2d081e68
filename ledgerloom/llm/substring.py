"""Substring dedup by level-wise doubling: passages of `window` words that also start in a document with a smaller id are removed.

The levels are windows of a quarter, a half and all of the length. Of the shortest windows that start in one full window, the one with the least hash stands for it, and at the next level
the window of twice the length around it, to the right where that lies within the full window, else to the left. So equal full windows are represented by equal windows at every level,
and about one position in thirteen is looked at. Windows found in one document only are dropped level by level, those found in two or
more are extended to twice the length, until no candidates survive or the full length is reached; levels beyond it could not change which words are covered.
The last doubling is done in two steps: first the whole stretch of
full windows that one window stands for is compared at once; full windows are compared singly only where documents share the
window but not the stretch.

Exact copies of a text are settled by the digest of their words; of each class only the document with the smallest id takes part in the levels.

What decides that words are removed, stretches and full windows, is compared by 128 bits, two independent hashes of 64. Defined results: a null text has no words; texts shorter than the window lose
nothing; rows with equal doc_id do not remove each other's words; repeated runs within one document stay; an empty table gives an empty
result; a null doc_id is in no order: its rows lose no words and remove none; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 50
EMPTY = hashlib.sha256(b"").hexdigest()
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def levels(window: int) -> tuple[int, int]:
    """The lengths of the windows before the full one."""
    return (window + 3) // 4, (window + 1) // 2


class Sums:
    """Hashes of any run of words of one text, from prefix sums over the words' hashes."""

    def __init__(self, flat: np.ndarray, odd: int):
        n = len(flat)
        power = np.multiply.accumulate(np.full(n, odd, np.uint64)) if n else np.empty(0, np.uint64)
        self.sum = np.r_[np.uint64(0), np.cumsum(flat * power)]
        self.undo = np.multiply.accumulate(np.full(n + 1, pow(odd, -1, 1 << 64), np.uint64))

    def hashes(self, at: np.ndarray, size) -> np.ndarray:
        return C.mix((self.sum[at + size] - self.sum[at]) * self.undo[at])


class Stretches:
    """For the flat word hashes of one text (two independent ones): the windows that stand for its full windows at each level, and the stretches they stand for.

    Stretch k covers the full windows that start at begin[k] .. last[k]; seeds[level][k] is the hash of the window that stands for them; whole[k] and check[k] are hashes of the
    words of the stretch.
    """

    def __init__(self, flat: np.ndarray, other: np.ndarray, window: int):
        self.window, n = window, len(flat)
        self.one, self.two = Sums(flat, ODD[0]), Sums(other, ODD[1])
        short, half = levels(window)
        hashes = self.one.hashes(np.arange(n - short + 1), short)
        start = np.arange(n - window + 1)
        pick = np.lib.stride_tricks.sliding_window_view(hashes, window - short + 1).argmin(axis=1) + start
        longer = np.where(pick + half <= start + window, pick, pick + short - half)
        self.begin = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (longer[1:] != longer[:-1])])
        self.last = np.r_[self.begin[1:] - 1, n - window]
        self.seeds = [hashes[pick[self.begin]], self.one.hashes(longer[self.begin], half)]
        size = self.last + window - self.begin
        salt = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        self.whole, self.check = (C.mix(x.hashes(self.begin, size) + salt) for x in (self.one, self.two))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and the two hashes of the full windows of the stretches in the mask `which`."""
        size = (self.last - self.begin + 1)[which]
        at = np.repeat(self.begin[which] - np.r_[0, np.cumsum(size)][:-1], size) + np.arange(size.sum())
        return at, self.one.hashes(at, self.window), self.two.hashes(at, self.window)


def _texts(batch: pa.Array):
    """Offsets of the texts, two hashes of each word, the words, and per text its words joined by one space."""
    off, code, names = C.split_words(batch)
    one, two = (C.word_hashes(names, key)[code] for key in C.WORD_KEYS)
    words = names.cast(pa.string()).take(pa.array(code))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), words), " ")
    return off, one, two, words, joined


MARK = ["seed0", "seed1", "whole", "check"]


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by one space) and kept_text (null where nothing was removed)."""
    C.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")

    def look(it):
        none = np.empty(0, np.uint64)
        for b in it:
            off, one, two, _, joined = _texts(b.column(1))
            sha, lists = [], [[] for _ in MARK]
            for i, j, s in zip(off[:-1].tolist(), off[1:].tolist(), joined):
                sha.append(hashlib.sha256(s.as_py().encode()).hexdigest())
                mine = [none] * len(MARK)
                if j - i >= window:
                    x = Stretches(one[i:j], two[i:j], window)
                    _, first = np.unique(x.whole, return_index=True)
                    mine = [v[first] for v in (*x.seeds, x.whole, x.check)]
                for held, v in zip(lists, mine):
                    held.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(sha), *map(C.list_array, lists)], names=["doc_id", "n_words", "sha", *MARK])

    seen = C.stash(docs.mapInArrow(C.lean(look), "doc_id long, n_words long, sha string, " + ", ".join(f"{m} array<long>" for m in MARK)), "substring-seen")
    long = seen.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).select("doc_id", "sha")
    copies = C.stash(long.groupBy("sha").agg(F.min("doc_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "substring-classes")
    later = C.stash(long.join(copies, "sha").where("doc_id > keeper").select("doc_id", "sha"), "substring-copies")
    C.discard(copies)

    marks = seen.where((F.col("n_words") >= window) & F.col("doc_id").isNotNull()).join(later, ["doc_id", "sha"], "left_anti").select("doc_id", F.explode(F.arrays_zip(*MARK)).alias("m")).select("doc_id", *(f"m.{m}" for m in MARK))
    held = None
    for seed in ("seed0", "seed1"):  # level by level: what two documents share is extended to twice the length
        last = seed == "seed1"
        many = (F.min(F.struct("whole", "check")) < F.max(F.struct("whole", "check"))).alias("differs")
        shared = marks.groupBy(seed).agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), *([many] if last else [])).where("d0 < d1").drop("d0", "d1")
        alive = C.stash(marks.join(shared, seed).drop(seed), "substring-alive")
        if held is not None:
            C.discard(held)
        held = marks = alive
        if not alive.limit(1).count():  # no candidates survive
            marks = marks.drop("seed1").withColumn("differs", F.lit(False))
            break
    # the full length, by whole stretches; where they differ, the first document with each stretch shows its windows singly
    first = C.stash(marks.groupBy("whole", "check").agg(F.min("doc_id").alias("first")), "substring-first")
    judged = C.stash(marks.join(first, ["whole", "check"]).withColumn("covered", F.col("first") < F.col("doc_id")), "substring-judged")  # the join's hot stretches can be split
    C.discard(held, first)
    todo = judged.where("covered or differs").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("covered"), F.col("whole"))).alias("covered"), F.collect_set(F.when(~F.col("covered") & F.col("differs"), F.col("whole"))).alias("single")
    )
    work = C.stash(docs.join(todo, "doc_id"), "substring-work")
    C.discard(judged)

    def show(it):
        none = np.empty(0, np.uint64)
        for b in it:
            off, one, two, _, _ = _texts(b.column(1))
            hashes, checks = [], []
            for i, j, single in zip(off[:-1].tolist(), off[1:].tolist(), b.column(3).to_pylist()):
                h = c = none
                if single and j - i >= window:
                    x = Stretches(one[i:j], two[i:j], window)
                    _, h, c = x.windows(np.isin(x.whole, np.array(single, np.int64).view(np.uint64)))
                    h, at = np.unique(h, return_index=True)
                    c = c[at]
                hashes.append(h)
                checks.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), C.list_array(hashes), C.list_array(checks)], names=["doc_id", "hash", "check"])

    shown = work.where(F.size("single") > 0).mapInArrow(C.lean(show), "doc_id long, hash array<long>, check array<long>")
    shown = C.stash(shown.select("doc_id", F.explode(F.arrays_zip("hash", "check")).alias("w")).select("doc_id", "w.hash", "w.check"), "substring-windows")
    twice = shown.groupBy("hash", "check").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("d0 < d1").select("hash", "check", "d0")
    found = C.stash(shown.join(twice, ["hash", "check"]).where("doc_id > d0").groupBy("doc_id").agg(F.collect_set("hash").alias("found")), "substring-found")
    C.discard(shown)

    def remove(it):
        for b in it:
            off, one, two, words, joined = _texts(b.column(1))
            out = []
            for k, (i, j, covered, hashes) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), b.column(2).to_pylist(), b.column(3).to_pylist())):
                n = j - i
                mark = np.zeros(n + 1, np.int64)
                if n >= window:
                    x = Stretches(one[i:j], two[i:j], window)
                    if covered:
                        k1 = np.isin(x.whole, np.array(covered, np.int64).view(np.uint64))
                        np.add.at(mark, x.begin[k1], 1)
                        np.add.at(mark, x.last[k1] + window, -1)
                    if hashes:
                        at, h, _ = x.windows(np.ones(len(x.begin), bool))
                        at = at[np.isin(h, np.array(hashes, np.int64).view(np.uint64))]
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + window, -1)
                gone = np.cumsum(mark[:-1]) > 0
                whole = joined[k].as_py()
                kept = " ".join(words.slice(i, n).filter(pa.array(~gone)).to_pylist()) if gone.any() else whole
                out.append((hashlib.sha256(whole.encode()).hexdigest(), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "sha", "gone", "kept_sha", "kept_text"])

    cut = work.select("doc_id", "text", "covered").join(found, "doc_id", "left").where(F.size("covered") + F.coalesce(F.size("found"), F.lit(0)) > 0)
    cut = cut.mapInArrow(C.lean(remove), "doc_id long, sha string, gone long, kept_sha string, kept_text string")
    cut = cut.where("gone > 0").groupBy("doc_id", "sha").agg(F.first("gone").alias("gone"), F.first("kept_sha").alias("kept_sha"), F.first("kept_text").alias("kept_text"))
    done = later.distinct().select("doc_id", "sha", F.lit(-1).cast("long").alias("gone"), F.lit(EMPTY).alias("kept_sha"), F.lit("").alias("kept_text")).unionByName(cut)
    return seen.select("doc_id", "n_words", "sha").join(done, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words", F.when(F.col("gone") < 0, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"), "kept_text"
    )


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(C.table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
h AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, w[i] AS x, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)) ANTI JOIN c USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY 1) n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
