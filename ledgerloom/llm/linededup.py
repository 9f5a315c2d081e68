"""Line dedup by winnowing over line hashes, native Spark expressions only.

The lines of a text that hold a word are hashed, without the white space around them. A window is a stretch whose repetition must be found: `run` consecutive
lines, or one line of `long_line` words or more. From every window its least line hash is selected (the rightmost of equals) as its fingerprint, so equal windows select
equal fingerprints, and any repeated stretch of that length or more is guaranteed to share one. Only selected fingerprints are kept, each with its position and
the windows that selected it.

Fingerprints found at one position only are dropped; the positions of the others are joined by value, and matches are extended both ways, to the lines of the windows that selected them:
an extended match is compared, by 128 bits of hashes of all its lines, with the first place where these lines occur (least doc_id, then least hash of the text, then least line). A match with an
earlier place is a repeat, and the union of a document's repeats, thus the whole stretch that matches earlier text, is deleted. Lines without a word are neither
compared nor deleted, and stay.

No pair of positions is made: every extended match is joined with the one first place of its content. Within a text all work is linear in its lines.

Defined results: a null text stays null and has no lines; an empty text has no lines with a word; rows that share a doc_id are told apart by their texts; identical rows of one id
are one document, of which neither removes the other's lines; a null doc_id never loses lines and is no first place;
an empty table gives an empty result; other columns pass through `dedup_lines` untouched, whatever their names, unless named n_lines, n_removed or kept_text, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

RUN = 2
LONG_LINE = 8
RESULTS = ("n_lines", "n_removed", "kept_text")
_BLANKS = " \t\x0b\x0c\r"


def numbered_lines(text: Column) -> Column:
    """(s: the line without outer white space, i: its number from 0) of the lines that hold a word."""
    lines = F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(F.btrim(s, F.lit(_BLANKS)).alias("s"), i.alias("i")))
    return F.filter(lines, lambda x: F.length(x["s"]) > 0)


def fingerprints(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, t, print, windows): each selected fingerprint and the windows (at, n, a, b) that selected it; t is the hash of the text, a and b those of the window's lines."""
    none = F.array().cast("array<int>")

    def to(stop: Column) -> Column:
        return F.when(stop >= 0, F.sequence(F.lit(0), stop)).otherwise(none)

    def window(x: Column, at: Column, n: int) -> Column:
        hashes = lambda k: F.xxhash64(*[F.get(x, at + j)[k] for j in range(n)])
        return F.struct(at.alias("at"), F.lit(n).alias("n"), hashes("a").alias("a"), hashes("b").alias("b"))

    def select(x: Column) -> Column:
        least = lambda at: F.array_min(F.array(*[F.struct(F.get(x, at + j)["a"].alias("a"), F.lit(-j).alias("j")) for j in range(run)]))["j"]
        picks = F.transform(to(F.size(x) - run), lambda at: at - least(at))
        long = F.filter(to(F.size(x) - 1), lambda k: F.get(x, k)["long"])

        def selected(picks: Column) -> Column:
            around = lambda p: F.filter(F.transform(F.array(*[F.lit(j) for j in range(run)]), lambda j: p - j), lambda at: F.get(picks, at) == p)
            alone = lambda p: F.when(F.get(x, p)["long"], F.array(p)).otherwise(none)
            windows = lambda p: F.concat(F.transform(around(p), lambda at: window(x, at, run)), F.transform(alone(p), lambda at: window(x, at, 1)))
            return F.transform(F.array_distinct(F.concat(picks, long)), lambda p: F.struct(F.get(x, p)["a"].alias("print"), windows(p).alias("windows")))

        return C.let(picks, selected)

    hashed = F.transform(numbered_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x["s"]).alias("a"), F.xxhash64(F.lit(1), x["s"]).alias("b"), (F.regexp_count(x["s"], F.lit(C.WORD)) >= long_line).alias("long")))
    d = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("t"), F.explode(C.let(hashed, select)).alias("f"))
    return d.select("doc_id", "t", "f.print", "f.windows")


def repeats(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """(doc_id, t, at, n) of the windows that also occur at an earlier place."""
    every = C.stash(fingerprints(docs, run, long_line), "line-prints")
    shared = every.groupBy("print").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("print")
    alive = every.join(shared, "print").select("doc_id", "t", F.explode("windows").alias("w"))
    alive = C.stash(alive.select("doc_id", "t", "w.at", "w.n", "w.a", "w.b"), "line-matches")
    C.discard(every)
    first = alive.groupBy("a", "b").agg(F.min(F.struct("doc_id", "t", "at")).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1").select("a", "b", "first")
    found = C.stash(alive.join(first, ["a", "b"]).where(F.struct("doc_id", "t", "at") > F.col("first")).select("doc_id", "t", "at", "n"), "line-repeats")
    C.discard(alive)
    return found


def dedup_lines(docs: DataFrame, run: int = RUN, long_line: int = LONG_LINE) -> DataFrame:
    """docs (with doc_id and text) and n_lines (with a word), n_removed and kept_text."""
    docs = docs.drop(*RESULTS)
    g, g_id, g_t = (C.fresh(n, docs.columns) for n in ("gone_", "gone_id_", "gone_text_"))
    # the repeats' lines, by their rank among the lines with a word
    found = repeats(docs.select("doc_id", "text"), run, long_line).groupBy(F.col("doc_id").alias(g_id), F.col("t").alias(g_t)).agg(F.collect_set(F.struct("at", "n")).alias(g))
    found = found.withColumn(g, F.array_distinct(F.flatten(F.transform(g, lambda w: F.sequence(w["at"], w["at"] + w["n"] - 1)))))
    # merge join at every size, so that what a run needs grows as its input does
    d = docs.join(found.hint("merge"), (docs.doc_id == F.col(g_id)) & (F.xxhash64(docs.text) == F.col(g_t)), "left")

    def without(lines: Column, worded: Column) -> Column:
        gone = F.transform(F.col(g), lambda r: F.get(worded, r)["i"])
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")

    kept = C.let(F.split("text", "\n", -1), lambda lines: C.let(numbered_lines(F.col("text")), lambda worded: without(lines, worded)))
    d = d.withColumns(
        {
            "n_lines": F.coalesce(F.size(numbered_lines(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.array_size(g), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col(g).isNull(), F.col("text")).otherwise(F.coalesce(kept, F.lit(""))),
        }
    )
    return d.drop(g, g_id, g_t)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("kept_text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLE = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i - 1 AS i, trim(lines[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
w AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS r FROM l WHERE length(s) > 0),
r AS (SELECT doc_id, r AS pos, 2 AS n, s || chr(10) || lead(s, 1) OVER o AS whole FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY r)
      UNION ALL SELECT doc_id, r, 1, s FROM w WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 8),
f AS (SELECT doc_id, pos, n, min((doc_id, pos)) OVER (PARTITION BY whole) AS first FROM r WHERE whole IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS r FROM f WHERE (doc_id, pos) > first),
n AS (SELECT w.doc_id, w.i FROM w JOIN g USING (doc_id, r)),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS kept FROM (SELECT d.doc_id, u.i - 1 AS i, d.lines[u.i] AS x FROM d, unnest(range(1, len(d.lines) + 1)) AS u(i)) a ANTI JOIN n USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(a.n, 0)::BIGINT AS n_lines, coalesce(b.n, 0)::BIGINT AS n_removed, md5(coalesce(k.kept, '')) AS kept_md5
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM w GROUP BY 1) a USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM n GROUP BY 1) b USING (doc_id) LEFT JOIN k USING (doc_id)
"""
