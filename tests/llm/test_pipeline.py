"""The pipeline against brute force, stage by stage."""

import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
import corpus_pipeline as P
from ledgerloom.llm import queries, tokens


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    r = random.Random(8)
    v = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    items = [(i, text(30)) for i in range(6)]
    docs, labels = [], []
    for i in range(300):
        t = text(r.randint(20, 80))
        if i % 10 == 3:
            t += " idiot scum moron"
        if i % 25 == 7:
            t = f"{text(10)} {items[i % 6][1]} {text(10)}"
        if i % 20 == 9 and docs:
            t = docs[-2][1]
        docs.append((i, t, "en", None if i % 9 == 0 else f"s{i % 4}", len(t)))
        labels.append((i, 1, int(i % 10 == 3)))
    docs += [(400, "", "en", "s0", 0), (401, None, None, None, None), docs[0]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, sf_dir):
    docs = P.C.table(spark, sf_dir, "documents")
    items = [tuple(r) for r in P.C.table(spark, sf_dir, "benchmark").collect()]
    seen = {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = P.C.stash(stage(spark, docs, sf_dir), "test")
        if name != "token_output":
            assert docs.columns == P.COLUMNS
            after = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            gone = {i for i, _ in before} - set(after)
            bad = {i for i, t in before if t and "scum" in t}
            assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 3
        elif name == "near_dedup":
            assert after == sorted({i for i, _, c in brute.near_duplicates(before) if i == c})
        elif name == "decontamination":
            assert after == [i for i, item in brute.contained(before, items) if item is None]
        elif name == "mixing":
            assert max(after.count(i) for i in set(after)) <= 3 and set(after) <= {i for i, _ in before}
            words = lambda rows: sum(len((t or "").split()) for _, t in rows)
            mixed = words((r.doc_id, r.text) for r in docs.collect())
            assert words(before) - 80 <= mixed <= words(before)  # the mix is cut at the budget, one document short of it at most
            seen = [(r.doc_id, r.text) for r in docs.collect()]
    from tokenizers import Tokenizer

    tok, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    got = sorted(docs.collect(), key=lambda r: r.start)
    for (i, t), r in zip(sorted(seen), got):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_mix_takes_each_row_by_itself(spark, tmp_path):
    import duckdb

    # sizes tell the rows of one id apart; 7 is repeated, every third id is null
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 and i < 30 else i, "w " * (i + 1), "en", f"s{i % 4}", 2 * i + 2) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter((r.doc_id, len(r.text.split())) for r in P.mix(spark, P.C.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {(i, size): taken // size for i, size, _, _, taken in db.execute(P.mixing.ORACLE).fetchall() if taken}
    assert got == want and any(i is None for i, _ in got) and len({n for (i, _), n in got.items() if i == 7}) > 1


def test_near_dedup_judges_rows_not_ids(spark):
    r = random.Random(3)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d = (text() for _ in range(4))
    near = a + " end"
    rows = [(1, a), (5, near), (5, b), (5, b), (6, b + " end"), (7, c), (7, d), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((x.doc_id, x.text) for x in P.drop_near_duplicates(spark, docs, "").collect())
    assert got == Counter([(1, a), (5, b), (7, c), (7, d), (None, a), (None, None)])


def odd_tables(spark, at, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, `_row` int, times int, uid long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, doc_id long").write.parquet(f"{at}/benchmark.parquet")


def test_whole_pipeline_of_null_and_shared_ids_empty_and_long_texts_and_clashing_columns(spark, tmp_path):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, long = text(60), text(30_000)
    texts = [(1, a), (1, a), (1, text(50)), (None, text(40)), (None, a + " end"), (None, None), (2, ""), (2, long), (3, a + " end"), (4, text(40) + " q1 q2 q3 q4 q5 q6 q7 " + text(40))]
    odd_tables(spark, tmp_path, [(i, t, None, s, None, 0.5, 1, 2, 3) for k, (i, t) in enumerate(texts) for s in ["x" if k % 2 else None]], [(1, None, 0, "c"), (None, 1, 1, None), (9, 0, 1, None)], [(1, "q1 q2 q3 q4 q5 q6 q7", 5), (None, a, 1), (2, None, None)])
    docs = P.C.table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        docs = P.C.stash(stage(spark, docs, str(tmp_path)), "test")
        assert docs.columns == P.COLUMNS
        left = Counter((x.doc_id, (x.text or "")[:20]) for x in docs.collect())
        short = lambda i, t: (i, (t or "")[:20])
        if name == "toxicity":
            assert left == Counter(short(i, t) for i, t in texts)
        elif name == "near_dedup":
            assert left == Counter(short(i, t) for k, (i, t) in enumerate(texts) if k not in (1, 8))
        elif name == "decontamination":
            assert left == Counter(short(i, t) for k, (i, t) in enumerate(texts) if k not in (1, 8, 9))
    assert P.write_tokens(spark, docs, str(tmp_path)).count() == sum(left.values())
    assert P.run(spark, str(tmp_path)).count() == sum(left.values())


def test_pipeline_of_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [], [], [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] and set(queries.ORACLES) <= set(queries.QUERIES)
