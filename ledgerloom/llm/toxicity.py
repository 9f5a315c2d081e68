"""Toxicity scores by non-negative positive-unlabelled (PU) learning.

The classifier never sees a negative label. It is a linear model in numpy, trained on confirmed toxic texts (positives) and on texts drawn
without regard to any label (unlabelled), with the non-negative risk estimator: with class prior p, loss l and model g,

    risk = p * mean_P l(g, +1) + max(0, mean_U l(g, -1) - p * mean_P l(g, -1)).

Where the second term turns negative (the model starts to fit the positives that hide among the unlabelled), the step climbs that term instead. The
class prior is the share of toxic rows among the labelled rows, of the learning folds.

Features are the words of a text and the beginnings of words, each counted once per text, of which only those significantly commoner in positives than
in unlabelled texts are kept, at most `FEATURES`.

Only the fit works on a bounded sample, at most `MAX_POSITIVE` positives and `MAX_UNLABELLED` unlabelled texts (by a hash of their ids); the
prior is computed over all labelled rows of the learning folds. Texts are taken whole, in the fit as in the scores, however long they are. Strings are counted and ranked in Spark;
the driver sees the `FEATURES` chosen ones, and of the sampled texts which of these they hold.

Defined results: a null or empty text has no features, so its score is the model's bias; repeated rows score alike; without any
positive to learn from, every score is 0; label rows with a null or without a document are ignored; where rows of one doc_id have different labels, toxic wins; where
several texts share a doc_id, its label holds for each of them; an empty table gives an empty
result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MAX_POSITIVE = 2000
MAX_UNLABELLED = 6000
#: A sampled text's strings are handed on so many to a row.
STRINGS_A_ROW = 10_000
FEATURES = 1024
PREFIXES = (5, 6, 7)
THRESHOLD = 0.3
HELD_OUT = 2

_WORD = re.compile(r"[^\W_]+")


def strings(text: str | None) -> set[str]:
    """The words of a text in lower case, and with a mark the beginnings of longer ones."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass
class Model:
    bias: float = float("-inf")  # without anything learnt: score 0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        z = self.bias
        if z == float("-inf"):
            return 0.0
        if text:
            get = self.weights.get
            z += sum([x for x in map(get, strings(text)) if x])
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def choose_features(counts: DataFrame, n_positive: int, n_unlabelled: int, prior: float, size: int = FEATURES) -> list[str]:
    """From (s, p, u), the texts of either kind that each string occurs in: the strings commoner in positives than in negatives beyond chance.

    The rate among negatives is that among the unlabelled less the positives' share of it; the log-likelihood ratio of the two rates must exceed what the best
    of so many strings reaches by chance.
    """
    n_p, n_n = float(max(1, n_positive)), float(max(1, round((1 - prior) * n_unlabelled)))
    tiny = F.lit(1e-12)
    part = lambda k, n, q: k * F.log(F.greatest(k, tiny) / (n * q)) + (n - k) * F.log(F.greatest(n - k, tiny) / (n * F.greatest(1 - q, tiny)))
    known = C.stash(counts.where("p > 2").select("s", F.col("p").cast("double").alias("a"), F.least(F.greatest(F.col("u") - F.lit(prior * n_unlabelled / n_p) * F.col("p"), F.lit(0.0)), F.lit(n_n)).alias("b")), "toxic-strings")
    n = known.count()
    both = (F.col("a") + F.col("b")) / (n_p + n_n)
    ratio = 2 * (part(F.col("a"), n_p, both) + part(F.col("b"), n_n, both))
    found = known.where(F.col("a") / n_p > 2 * F.col("b") / n_n).select("s", ratio.alias("r")).where(F.col("r") > 2 * float(np.log(max(1, n))))
    return [x.s for x in found.orderBy(F.desc("r"), "s").limit(size).collect()]


def fit(positive: list[list[int]], unlabelled: list[list[int]], names: list[str], prior: float, epochs: int = 600, rate: float = 0.1, l2: float = 1e-4) -> Model:
    """The non-negative PU fit of a logistic model by Adam over the whole sample; rows are the numbers of the names that a text holds."""
    if not positive or not unlabelled or not 0 < prior < 1:
        return Model()
    if not names:
        return Model(bias=float(np.log(prior / (1 - prior))))
    xp, xu = _matrix(positive, len(names)), _matrix(unlabelled, len(names))
    w, b = np.zeros(len(names), np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
    for t in range(1, epochs + 1):
        gp, gu = sigmoid(xp @ w + np.float32(b)), sigmoid(xu @ w + np.float32(b))  # logistic loss: dl(g,+1) = g - 1, dl(g,-1) = g
        negative = np.mean(-np.log1p(-gu + 1e-12)) - prior * np.mean(-np.log1p(-gp + 1e-12))
        dp, du, dn = prior * (gp - 1) / len(gp), gu / len(gu), -prior * gp / len(gp)
        if negative < 0:  # the estimate of the negatives' risk fell below 0: undo
            dp, dn, du = np.zeros_like(dp), -dn, -du
        g = np.r_[(dp + dn).astype(np.float32) @ xp + du.astype(np.float32) @ xu + l2 * w, np.sum(dp + dn) + np.sum(du)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate / (1 + 2 * t / epochs) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return Model(float(b), {s: float(x) for s, x in zip(names, w) if abs(x) > 1e-3})


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        out[i, r] = 1
    return out


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, learns: F.Column | None = None) -> Model:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic); rows where the column `learns` is not true take no part."""
    learns = ~held_out() if learns is None else learns
    known = labels.where(learns & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic:
        return Model()
    prior = toxic / n
    # a bounded sample of labelled rows: the positives by label, the unlabelled drawn without looking at it
    p = C.sample(known.where("toxic = 1"), MAX_POSITIVE, "doc_id").select("doc_id", F.lit(True).alias("confirmed"))
    u = C.sample(known, MAX_UNLABELLED, "doc_id").select("doc_id", F.lit(False).alias("confirmed"))
    picked = F.broadcast(p.unionByName(u).groupBy("doc_id").agg(F.collect_list("confirmed").alias("uses")))  # at most MAX_POSITIVE + MAX_UNLABELLED rows
    texts = C.sample(docs.select("doc_id", "text").join(picked, "doc_id"), MAX_POSITIVE + MAX_UNLABELLED, "doc_id", "text").select("uses", "text")  # also where very many texts share one labelled id

    def look(it):
        task, no = TaskContext.get().partitionId(), 0
        for b in it:
            for use, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, no = sorted(strings(text)), no + 1
                chunks = [found[i : i + STRINGS_A_ROW] for i in range(0, len(found), STRINGS_A_ROW)] or [[]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 40) + no] * len(chunks)), pa.array([k == 0 for k in range(len(chunks))]), pa.array([use] * len(chunks), pa.list_(pa.bool_())), pa.array(chunks, pa.list_(pa.string()))], names=["text_no", "first", "uses", "strings"]
                )

    rows = C.stash(texts.mapInArrow(C.lean(look), "text_no long, first boolean, uses array<boolean>, strings array<string>"), "toxic-sample")
    uses = rows.where("first").select(F.explode("uses").alias("c")).agg(F.count_if("c").alias("p"), F.count_if(~F.col("c")).alias("u")).first()
    each = rows.select(F.aggregate("uses", F.lit(0), lambda a, c: a + c.cast("int")).alias("p"), F.size("uses").alias("n"), F.explode("strings").alias("s"))
    counts = each.groupBy("s").agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("u"))
    names = choose_features(counts, uses.p, uses.u, prior)
    chosen = F.array(*[F.lit(s) for s in names]).cast("array<string>")
    at = {s: i for i, s in enumerate(names)}
    held: dict[int, tuple[list, list[int]]] = {}
    for r in rows.select("text_no", "uses", F.array_intersect("strings", chosen).alias("strings")).toLocalIterator():
        held.setdefault(r.text_no, (r.uses, []))[1].extend(at[s] for s in r.strings)
    positive, unlabelled = [], []
    for use, x in held.values():
        for confirmed in use:
            (positive if confirmed else unlabelled).append(sorted(x))
    return fit(sorted(positive), sorted(unlabelled), names, prior)


def score_texts(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most FEATURES weights
    d = docs.select(*keep, "text")
    n = len(d.columns)
    schema = ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes)

    def score(it):
        m = shared.value
        for b in it:
            s = pa.array([m.score(t) for t in b.column(n - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], s], names=[*keep, "score"])

    return d.mapInArrow(C.lean(score), f"{schema}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, C.table(spark, sf_dir, "labels"))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
