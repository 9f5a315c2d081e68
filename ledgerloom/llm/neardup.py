"""Near-duplicate detection with bottom-k MinHash sketches of one hash function.

1. A document's set holds the hashes of its 5-word shingles; its sketch, the k least of them. Documents with equal sets form one class, which the
   least doc_id represents from here on.
2. Inverted lists of retained values: each representative is entered under its rarest values only. Two sketches that share
   `overlap(k)` values must meet in at least one list of the k - overlap + 1 rarest of each, so passages that many documents share make no long lists.
3. Round one: in each list all members are held against one hub, the member whose values are the most common. The estimate from the
   sketch of the union filters the pairs, except that the pair of a list of two, which round two leaves out, needs only share `overlap(k)` values;
   exact Jaccard similarity of the full sets confirms them.
4. Round two makes the result complete: in every list whose members are not yet one component, each member outside the list's main
   component is held against all members of other components, in blocks of bounded size: within a block the sketches' inverted lists give the overlaps, the union's sketch
   the estimates that filter the pairs, and exact Jaccard similarity confirms them. Long lists around one component are taken together. Nothing is capped, and
   a block emits a spanning forest of the links it finds, never more links than it has components.

The components of the confirmed links are the groups. Sketches of k values find a pair of similarity 0.75 unless fewer than overlap(k) of an expected 0.75 k
values are shared, which for k = 48 has a probability below 1e-6; pairs above that similarity are missed more rarely still.

Defined results: texts without words (null, empty) have an empty set, are their own component and kept; repeated rows belong to one class; rows
of one doc_id with different texts are judged row by row, under the one id; a null doc_id is a component of its own and linked with nothing; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

SHINGLE = 5
SIMILARITY = (75, 100)
K = 48
BLOCK = 512
#: Least estimated similarity of a pair that is verified: 4.6 standard errors of the estimate below the bound.
ESTIMATE = 0.46


def overlap(size: Column) -> Column:
    """Retained values that two sketches of similar documents share at least."""
    return F.greatest(F.lit(1), F.floor(size * 5 / 12)).cast("int")


def similar(inter, union):
    return SIMILARITY[1] * inter >= SIMILARITY[0] * union


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, setkey (equal for equal sets) and sketch (the k least hashes, ascending) of every row."""

    def look(it):
        for b in it:
            sets = C.shingle_sets(b.column(1), SHINGLE)
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.string()), C.list_array([s[:k] >> np.uint64(1) for s in sets])], names=["doc_id", "n_shingles", "setkey", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(C.lean(look), "doc_id long, n_shingles long, setkey string, sketch array<long>")


def estimate(a: Column, b: Column, k: int = K) -> Column:
    """The share of the union's sketch that both sketches retain."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar."""

    def judge(it):
        for batch in it:
            sa, sb = C.shingle_sets(batch.column(2), SHINGLE), C.shingle_sets(batch.column(3), SHINGLE)
            inter = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(sa, sb)], np.int64)
            union = np.array([len(x) + len(y) for x, y in zip(sa, sb)], np.int64) - inter
            keep = pa.array(similar(inter, union) & (union > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    t = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias("t" + c))
    return pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "ta", "tb").mapInArrow(C.lean(judge), "a long, b long")


def _intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of `a` with each of `b`, by products of 0/1 matrices over the values both sides have."""
    flat_a, flat_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(flat_a, flat_b)

    def cells(flat, sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        col = np.searchsorted(shared, flat)
        ok = np.isin(flat, shared)
        order = np.argsort(col[ok], kind="stable")
        return row[ok][order], col[ok][order]

    (ra, ca), (rb, cb) = cells(flat_a, a), cells(flat_b, b)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(shared), width):
        w = min(width, len(shared) - at)
        ma, mb = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        i, j = np.searchsorted(ca, [at, at + w])
        ma[ra[i:j], ca[i:j] - at] = 1
        i, j = np.searchsorted(cb, [at, at + w])
        mb[rb[i:j], cb[i:j] - at] = 1
        out += ma @ mb.T
    return out.astype(np.int64)


def _estimates(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Of each pair of sketches (rows of equal width, padded by the largest value) the share of the union's sketch that both retain."""
    pad = np.iinfo(np.uint64).max
    v = np.sort(np.concatenate([a, b], axis=1), axis=1)
    again = np.zeros(v.shape, bool)
    again[:, 1:] = (v[:, 1:] == v[:, :-1]) & (v[:, 1:] != pad)
    rank = np.cumsum(~again & (v != pad), axis=1)
    return (again & (rank <= k)).sum(axis=1) / np.maximum(1, np.minimum(rank[:, -1], k))


def _candidates(a: list[np.ndarray], b: list[np.ndarray], k: int = K, chunk: int = 20_000) -> np.ndarray:
    """Which pairs of sketches share enough retained values and pass the estimate."""
    size = lambda x: np.array([len(s) for s in x], np.int64)
    need = np.maximum(1, np.minimum(size(a)[:, None], size(b)[None, :]) * 5 // 12)
    out = _intersections(a, b) >= need
    rows, cols = np.nonzero(out)

    def padded(x):
        m = np.full((len(x), k), np.iinfo(np.uint64).max, np.uint64)
        for i, s in enumerate(x):
            m[i, : len(s)] = s
        return m

    ma, mb = padded(a), padded(b)
    for at in range(0, len(rows), chunk):
        i, j = rows[at : at + chunk], cols[at : at + chunk]
        out[i, j] = _estimates(ma[i], mb[j], k) >= ESTIMATE
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The numbers of the links (a[i], b[i]) between components that form a spanning forest of them all."""
    _, first = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
    root, out = {}, []

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for i in np.sort(first).tolist():
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            root[x] = y
            out.append(i)
    return out


def _block(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between the asking and the answering rows (id, comp, asks, text) of one block."""
    asks = np.array(group.column("asks").to_pylist(), bool)
    ids, comp = group.column("id").to_numpy(), group.column("comp").to_numpy()
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not asks.any() or asks.all():
        return empty
    sets = C.shingle_sets(group.column("text"), SHINGLE)
    a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
    may = _candidates([sets[i][:K] for i in a], [sets[i][:K] for i in b]) & (comp[a][:, None] != comp[b][None, :])
    a, b, may = a[may.any(axis=1)], b[may.any(axis=0)], may[may.any(axis=1)][:, may.any(axis=0)]
    if not len(a):
        return empty
    size = np.array([len(s) for s in sets], np.int64)
    inter = _intersections([sets[i] for i in a], [sets[i] for i in b])
    x, y = np.nonzero(may & similar(inter, size[a][:, None] + size[b][None, :] - inter))
    if not len(x):
        return empty
    keep = _forest(comp[a[x]], comp[b[y]])
    return pa.table({"a": pa.array(ids[a[x[keep]]]), "b": pa.array(ids[b[y[keep]]])})


def links_left(lists: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Round two: links between different components within the lists (v, id)."""
    m = C.stash(lists.join(labels, "id", "left").select("v", "id", F.coalesce("comp", "id").alias("comp")), "near-members")
    parts = m.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    open_lists = parts.groupBy("v").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.bit_xor("x").alias("x")).where("parts > 1 and n > 2")
    # lists of the same members are one list, and so are long lists around one main component, which share most members
    open_lists = open_lists.groupBy("n", "x", "main").agg(F.min("v").alias("v")).select("v", F.col("main.comp").alias("main"), F.when(F.col("n") > BLOCK, F.xxhash64("main.comp")).otherwise(F.col("v")).alias("g"))
    members = C.stash(m.join(open_lists, "v").select("g", "id", "comp", "main").distinct(), "near-open")
    size = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.ceil(F.count_if(F.col("comp") != F.col("main")) / BLOCK).alias("ask_blocks"))
    d = members.join(C.stash(size, "near-blocks"), "g").withColumn("h", F.xxhash64("id"))
    answer = d.select("g", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("i"), F.pmod("h", "blocks").alias("j"), "id", "comp", F.lit(False).alias("asks"))
    ask = d.where("comp <> main").select("g", F.pmod("h", "ask_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "id", "comp", F.lit(True).alias("asks"))
    rows = answer.unionByName(ask).join(texts, "id").select("g", "i", "j", "id", "comp", "asks", "text")
    found = C.stash(rows.groupBy("g", "i", "j").applyInArrow(_block, "a long, b long"), "near-more")
    C.discard(m, members)
    return found


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (with doc_id and text)."""
    C.ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    seen = C.stash(sketches(docs, k), "near-sketches")
    full = seen.where("n_shingles > 0 and doc_id is not null")
    classes = C.stash(full.groupBy("setkey").agg(F.min("doc_id").alias("id")), "near-classes")
    nodes = C.stash(full.join(classes, (full.setkey == classes.setkey) & (full.doc_id == classes.id)).select("id", full.setkey, "sketch").dropDuplicates(["id", "setkey"]), "near-nodes")

    values = nodes.select("id", F.explode("sketch").alias("v"))
    common = C.stash(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "near-common")
    # a sketch's values that occur only once fill its prefix first; common ones follow, the rarest first
    own = values.join(common, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("c"))
    own = own.join(nodes.groupBy("id").agg(F.sum(F.size("sketch")).cast("int").alias("k")), "id")
    take = F.col("k") - overlap(F.col("k")) + 1 - (F.col("k") - F.size("c"))
    own = own.select("id", (F.size("c") / F.col("k")).alias("score"), F.slice("c", F.lit(1), F.greatest(F.lit(0), F.least(take, F.size("c")))).alias("c"))
    prefixes = C.stash(own.select("id", "score", F.explode("c.v").alias("v")), "near-prefixes")
    hubs = C.stash(prefixes.groupBy("v").agg(F.max(F.struct("score", F.xxhash64("id").alias("h"), "id")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("v", F.col("hub.id").alias("hub"), (F.col("n") == 2).alias("two")), "near-hubs")
    lists = C.stash(prefixes.join(hubs, "v").select("v", "id", "hub", "two"), "near-lists")
    C.discard(common, prefixes, hubs)

    wanted = lists.select("id").distinct()
    texts = C.stash(docs.join(wanted, docs.doc_id == wanted.id, "left_semi").select(F.col("doc_id").alias("id"), "text").distinct(), "near-texts")
    pairs = lists.where("id <> hub").groupBy(F.col("id").alias("a"), F.col("hub").alias("b")).agg(F.max("two").alias("two"))
    s = lambda c: nodes.select(F.col("id").alias(c), F.col("sketch").alias("s" + c))
    sa, sb = F.col("sa"), F.col("sb")
    alone = F.col("two") & (F.size(F.array_intersect(sa, sb)) >= overlap(F.least(F.size(sa), F.size(sb))))
    pairs = C.stash(pairs.join(s("a"), "a").join(s("b"), "b").where((estimate(sa, sb, k) >= ESTIMATE) | alone).select("a", "b").distinct(), "near-pairs")
    links = C.stash(verify(pairs, texts), "near-links")
    C.discard(nodes, pairs)
    labels = components(links)
    more = links_left(lists.select("v", "id"), labels, texts)
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    C.discard(lists, texts, links, more)

    members = full.select("doc_id", "n_shingles", "setkey").join(classes, "setkey").join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "id").alias("component_id"))
    rest = seen.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS id, doc_id AS comp FROM w UNION SELECT l.b, r.comp FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(comp) AS comp FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.comp AS component_id, w.doc_id = c.comp AS kept FROM w JOIN c ON c.id = w.doc_id LEFT JOIN n USING (doc_id)
"""
