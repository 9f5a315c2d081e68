"""Quality rules as a short-circuit cascade, native Spark expressions only.

On a bounded sample `cascade` estimates what each rule costs on each document (from the sizes of the parts of the text that the rule looks at, in nanoseconds by rates
measured once) and which documents it rejects. The rule that rejects most per cost comes first, then the one that rejects most per cost among the documents that
are left, and so on; all are evaluated as one CASE in that order, so a document that a rule rejects is not looked at by the rules after it. The order is
a matter of speed alone and the same in every run over the same rows; a document is kept if no rule rejects it.

Defined results: a null or empty text has no words, fails the base rules and is not kept; repeated rows are judged alike; an empty table
gives an empty result and the rules in their given order; other columns pass through `cascade` untouched, whatever their names, unless named like one of its results,
which then replaces them; a null doc_id is a value like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
MIN_WORDS = 20
#: So many documents at most, drawn by a hash of id and text, on which costs and rejections are estimated.
SAMPLE = 400
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
WORKING = ("_q_words", "_q_text", "_q_lines")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column  # over the columns of `measured`
    cost: Column  # nanoseconds for one document, over the same columns


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({C.WORD})"), F.lit(1))


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows that occur twice or more in the array of words `w`, first occurrences included.

    Hashes of the windows tell at once that a text repeats none, as most do; only otherwise, and only where hashes repeat, are windows compared word for word: they
    are sorted with their positions, those equal to a neighbour are marked, and the union of their spans is measured. Linear in the words but for the sorting.
    """

    def beside(a: Column, k: Column, name: str) -> Column:
        """Whether the k-th struct of the sorted `a` equals a neighbour in `name`."""
        mine = F.get(a, k)[name]
        return mine.eqNullSafe(F.get(a, k - 1)[name]) | mine.eqNullSafe(F.get(a, k + 1)[name])

    def numbers(a: Column) -> Column:
        return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        spelled = C.let(placed, lambda a: F.sort_array(F.transform(F.filter(numbers(a), lambda k: beside(a, k, "v")), lambda k: C.let(F.get(a, k)["i"], lambda i: F.struct(F.array_join(F.array(*[F.get(w, i + j) for j in range(n)]), " ").alias("s"), i.alias("i"))))))
        at = C.let(spelled, lambda a: F.sort_array(F.transform(F.filter(numbers(a), lambda k: beside(a, k, "s")), lambda k: F.get(a, k)["i"])))
        return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + n).alias("end"), (acc["n"] + i + n - F.greatest(acc["end"], i)).alias("n")), lambda acc: acc["n"])

    def found(h: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return C.let(hashes, lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0)).otherwise(covered(x)))

    return F.when(F.size(w) < n, F.lit(0)).otherwise(C.let(F.transform(w, lambda x: F.xxhash64(x)), found)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Add _q_words, _q_text, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    d = docs.withColumn("_q_text", F.coalesce("text", F.lit("")))
    d = d.withColumn("_q_words", words(F.col("_q_text")))
    w, t = F.col("_q_words"), F.col("_q_text")
    lines = F.filter(F.split(t, "\n", -1), lambda s: F.length(F.btrim(s, F.lit(" \t\x0b\x0c\r"))) > 0)
    d = d.withColumn("_q_lines", lines)
    return d.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": repeated_words(w),
        }
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rules() -> list[Rule]:
    w, n = F.col("_q_words"), F.col("n_words")
    share = lambda f: F.size(F.filter(w, f))
    each = lambda part, rate: 50 + part * rate
    lines, chars = F.size("_q_lines"), F.length("_q_text")
    return [
        Rule("words too short or too long on average", ~F.col("word_chars").between(3 * n, 10 * n), F.lit(50)),
        Rule("many symbols", 10 * F.col("n_symbols") > n, F.lit(50)),
        Rule("many repeated lines", 10 * F.col("n_dup_lines") > 3 * F.size("_q_lines"), F.lit(50)),
        Rule("few words with a letter", 10 * share(lambda x: x.rlike(r"\p{L}")) < 8 * n, each(n, 330)),
        Rule("mostly capitals", 2 * share(lambda x: (F.length(x) > 1) & (x == F.upper(x)) & (x != F.lower(x))) > n, each(n, 590)),
        Rule("many exclamation marks", 5 * F.regexp_count(F.col("_q_text"), F.lit("!")) > n, each(chars, 20)),
        Rule("few distinct words", 5 * F.size(F.array_distinct(w)) < n, each(n, 360)),
        Rule("mostly list items", (F.size("_q_lines") >= 4) & (10 * F.size(F.filter("_q_lines", lambda s: s.rlike(r"^[ \t]*[-•*]"))) > 9 * F.size("_q_lines")), each(lines, 1000)),
    ]


def order(docs: DataFrame, which: list[Rule]) -> list[tuple[Rule, float, float]]:
    """The rules in the order of the cascade, each with the share it rejects and its nanoseconds a document, of the sample's documents that reach it."""
    local = measured(C.sample(docs.select("doc_id", "text"), SAMPLE, "doc_id", "text"))
    rows = local.select(F.array(*[F.coalesce(r.rejects, F.lit(False)) for r in which]).alias("gone"), F.array(*[r.cost.cast("double") for r in which]).alias("cost"), base_failed().alias("failed")).collect()  # at most SAMPLE rows
    left, todo, out = [r for r in rows if not r.failed], list(range(len(which))), []
    while todo:
        share = {k: sum(r.gone[k] for r in left) / max(1, len(left)) for k in todo}
        cost = {k: sum(r.cost[k] for r in left) / max(1, len(left)) for k in todo}
        best = max(todo, key=lambda k: (share[k] / cost[k] if cost[k] else 0.0, -k))
        out.append((which[best], share[best], cost[best]))
        todo.remove(best)
        left = [r for r in left if not r.gone[best]]
    return out


def cascade(docs: DataFrame, which: list[Rule] | None = None, ordered: bool = True) -> DataFrame:
    """docs (with doc_id and text) with the base measures, base_failed, kept and rejected_by (the first rule in cascade order, or null)."""
    which = rules() if which is None else which
    which = [r for r, _, _ in order(docs, which)] if ordered else which
    verdict = F.when(base_failed(), F.lit("base"))
    for r in which:
        verdict = verdict.when(r.rejects, F.lit(r.name))
    docs = docs.drop(*RESULTS)
    aside = {c: C.fresh("_q_aside" + c, docs.columns) for c in docs.columns if c.lower() in WORKING}
    d = measured(docs.withColumnsRenamed(aside)).withColumn("base_failed", base_failed())
    d = d.withColumn("rejected_by", verdict)
    d = d.withColumn("kept", F.col("rejected_by").isNull()).drop(*WORKING)
    return d.withColumnsRenamed({v: k for k, v in aside.items()})


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: length(trim(s, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) > 0) AS lines FROM documents),
m AS (SELECT *, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM m)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, sum(i + 8 - greatest(i, coalesce(e, 0)))::BIGINT AS n FROM (SELECT doc_id, i, lag(i + 8) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM r) GROUP BY doc_id),
b AS (SELECT m.*, coalesce(c.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words AND 10 * n_dup_lines <= 3 * len(lines)
       AND 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) >= 8 * n_words
       AND 2 * len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) <= n_words
       AND 5 * length(regexp_replace(t, '[^!]', '', 'g')) <= n_words AND 5 * len(list_distinct(w)) >= n_words
       AND NOT (len(lines) >= 4 AND 10 * len(list_filter(lines, lambda s: regexp_matches(s, '^[ \t]*[-•*]'))) > 9 * len(lines)) AS kept
FROM f
"""
