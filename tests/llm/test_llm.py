import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute
from ledgerloom.llm import common as C
from ledgerloom.llm import components, decontaminate, html, linededup, mixing, neardup, quality, substring, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "size long, target double, score double, before long, uid long, pid int, `_gone` int, kept boolean, id long, v long, wrapper string"


def vocabulary(n=400, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus(seed=3, n=60):
    """Texts with exact and near copies, shared passages, empty and null texts, repeats and one very long text."""
    r, v = random.Random(seed), vocabulary()
    text = lambda k: " ".join(r.choice(v) for _ in range(k))
    passage = text(70)
    base = text(150)
    rows = [(0, base)]
    for i in range(1, n):
        kind = i % 8
        if kind == 0:
            t = base
        elif kind in (1, 2):
            w = base.split()
            for _ in range(r.randint(1, 12)):
                w[r.randrange(len(w))] = r.choice(v)
            t = " ".join(w)
        elif kind == 3:
            t = f"{text(30)}\n{passage}\n{text(20)}"
        elif kind == 4:
            t = text(r.randint(1, 9))
        elif kind == 5:
            t = rows[r.randrange(len(rows))][1]
        else:
            t = text(r.randint(40, 120)) + ("\n" + passage.upper() if kind == 6 else "")
        rows.append((i, t))
    return [*rows, (n, ""), (n + 1, None), (n + 2, " \t\n "), (n + 3, text(20_000)), (n + 3, rows[0][1]) if False else (n + 4, rows[0][1])]


def docs_frame(spark, rows, extra=False):
    d = spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)
    return spark.createDataFrame([(*r, *[None] * 11) for r in d.collect()], f"{DOCS}, {CLASH}") if extra else d


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_frame(spark, rows, extra=True).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_frame(spark, [])


# ---------------------------------------------------------------- shared helpers


def test_words_are_split_on_ascii_white_space_only():
    off, code, names = C.split_words(pa.array(["a\tb\x0bc\x0c d\r\ne", None, "", "  ", "x y z w"]))
    w = [names[c].as_py() for c in code]
    assert w == ["a", "b", "c", "d", "e", "x y", "z w"] and off.tolist() == [0, 5, 5, 5, 5, 7]


def test_words_of_a_slice_are_those_of_the_same_texts():
    texts = pa.array([f"Ä{k} Bé{k % 7} ñ" * (k % 5) for k in range(3000)])
    for lower in (False, True):
        cut = C.shingle_sets(texts.slice(1234, 700), 2, lower)
        assert all((a == b).all() for a, b in zip(cut, C.shingle_sets(pa.array(texts.slice(1234, 700).to_pylist()), 2, lower)))
    pieces = list(C.pieces([pa.RecordBatch.from_arrays([texts], names=["t"])], 500))
    assert [p.num_rows for p in pieces] == [500] * 6 and all(p.column(0).offset == 0 for p in pieces)


def test_running_sum_spans_partitions_and_groups(spark):
    rows = [(g, k, (k * 7 + len(g)) % 5) for g in ("a", "b", "hot") for k in range(300 if g == "hot" else 4)]
    got = C.running_sum(spark.createDataFrame(rows, "g string, k int, x int"), "g", ["k"], "x").collect()
    sums = {}
    for g, k, x in sorted(rows):
        sums[g, k] = sums.get(g, 0)
        sums[g] = sums.get(g, 0) + x
    assert {(r.g, r.k): r.before for r in got} == {k: v for k, v in sums.items() if isinstance(k, tuple)} and len({r.uid for r in got}) == len(rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 150), (150, 175)]
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in range(100, 130)) and got[200] == got[175] == 150


# ---------------------------------------------------------------- 1 html

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First&nbsp;  para <b>bold</b><br>next<p>Second &lt;x&gt; {n}<div class="ad">Buy</div><ul><li>one<li>two</ul></article>
<aside>Side</aside><section class="comments"><p>a comment</p></section><form><label>Name</label><input></form><footer>&copy; me</footer></body></html>"""


def test_html_main_text_of_article_pages(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", PAGE.replace("{n}", "x" * i)) for i in range(6)] + [(6, None, None), (7, "nonsense", ""), (8, "http://h1.org/cut", PAGE[: PAGE.index("Second")] + "Second<p")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == "\n".join(["Title & more", "First para bold next", f"Second <x> {'x' * i}".strip(), "one", "two"]) and got[i].n_chars == len(got[i].text)
    assert got[6].text == got[7].text == "" and got[6].n_chars == 0 and got[6].url is None
    assert got[8].text == "Title & more\nFirst para bold next\nSecond"


def test_html_wrapper_finds_the_varying_text_where_no_article_is_marked(spark):
    page = '<html><body><div id="top"><a href=1>One</a> <a href=2>Two</a></div><div id="wrap"><div id="one"><p>{a}</p><p>{b}</p></div><div id="two"><p>Always the same words here</p></div></div></body></html>'
    v = vocabulary()
    rows = [(i, "http://h.org/", page.format(a=" ".join(v[i : i + 30]), b=" ".join(v[i + 30 : i + 50]))) for i in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(v[i : i + 30]) + "\n" + " ".join(v[i + 30 : i + 50]) for i in range(12)}


TEMPLATES = {
    "blog": '<html><body class="home"><header id="masthead" class="site-header"><h1 class="site-title"><a href=/>My Site</a></h1><nav><ul><li><a>A</a></ul></nav></header><main><article id="post-{n}" class="post"><header class="entry-header"><h2>{t}</h2></header>'
    '<div class="entry-content">{p}<div class="share">Share this</div></div><footer>Posted</footer></article><div id="comments" class="comments-area"><ol class="comment-list"><li><p>{c}</p></ol></div></main><aside><h2>Recent</h2>{c}</aside></body></html>',
    "tables": '<HTML><BODY><DIV id="hdr"><A href=/>Home</A> | <A href=/a>About</A></DIV><TABLE><TR><TD class="left"><A>l1</A><BR><A>l2</A></TD><TD class="mid"><H1>{t}</H1>{p}</TD></TR></TABLE><DIV id="ftr">All rights reserved by us</DIV></BODY></HTML>',
    "named": '<html><body><div class="top-nav"><a>a</a></div><div class="wrapper"><div class="content"><h1>{t}</h1><div class="text">{p}</div><div class="ad-slot">Buy {c}</div></div><div class="sidebar"><p>{c}</p></div></div><div class="cookie-banner">Cookies</div>'
    '<form><p>Subscribe</p></form><div id="comments"><p>{c}</p></div></body></html>',
    "sections": '<html><body><section class="hero"><h1>{t}</h1></section><section class="body">{p}</section><section class="newsletter"><p>Join our list</p></section></body></html>',
}


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_html_of_other_templates(spark, name):
    r, v = random.Random(3), vocabulary()
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    rows, want = [], {}
    for i in range(20):
        title, ps = text(5), [text(r.randint(8, 50)) for _ in range(r.randint(1, 5))]
        rows.append((i, "https://site.org/x", TEMPLATES[name].format(n=i, t=title, p="".join(f"<p>{p}</p>" for p in ps), c=text(12))))
        want[i] = "\n".join([title, *ps])
    got = html.extract(spark.createDataFrame([*rows, (99, "https://copies.org/", rows[0][2])] + [(100 + k, "https://copies.org/", rows[0][2]) for k in range(7)], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.where("page_id < 99").collect()} == want
    assert all(want[0].split("\n")[-1] in r.text for r in got.where("page_id >= 99").collect())


def wrapper_of(*pages):
    w = html.parse(pages[0])
    for p in pages[1:]:
        html.align(w, html.parse(p))
    return w


def test_html_mismatches_become_optional_and_repeated_groups_and_slots():
    w = wrapper_of("<h1>a</h1><p>x</p><p>y</p><i>same</i>", "<h1>b</h1><h2>s</h2><p>z</p><i>same</i>", "<h1>c</h1><p>q</p><hr><table><tr><td>1</td></tr></table><i>same</i>")
    e = html.expression(w)
    assert e == "<h1> # </h1> ( <h2> = </h2> )? ( <p> # </p> )+ ( <table> <tr> <td> = </td> </tr> </table> )? ="
    assert html.expression(html.load(html.dump(w))) == e
    pairs = wrapper_of("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl><p>1", "<dl><dt>a<dd>b</dl><p>2", "<dl><dt>g<dd>h<dt>i<dd>j</dl><p>3")
    assert html.expression(pairs) == "<dl> ( <dt> # </dt> <dd> # </dd> )+ </dl> <p> # </p>"
    slot = wrapper_of('<div class="a post"><p>1</div><div class="end">e</div>', '<div class="b post"><p>2</div><div class="end">e</div>', '<div class="c post"><p>3</div><div class="end">e</div>')
    assert html.expression(slot) == "<div.post.*> <p> # </p> </div> <div.end> = </div>"


def test_html_wrappers_of_parts_merge_to_the_wrapper_of_all():
    r = random.Random(4)
    pages = ["<h1>t%d</h1>%s<div class=foot>end</div>" % (k, "".join(r.choice(["<p>%s</p>", "<ul><li>%s</ul>"]) % r.random() for _ in range(r.randint(1, 6)))) for k in range(30)]
    one, two, whole = wrapper_of(*pages[:15]), wrapper_of(*pages[15:]), wrapper_of(*pages)
    html.align(one, html.load(html.dump(two)))
    assert one.pages == whole.pages == 30
    for w in (one, whole):
        main = html.judge(w)
        for p in pages:
            assert html.main_text(html.parse(p), w, main).split("\n") == [x for x in html.re.split(r"<[^>]*>", p) if x][:-1]


def test_html_tags_left_open():
    alone = lambda p: html.main_text(html.parse(p), html.parse(p), set()) if False else html.main_text(html.parse(p), w := html.parse(p), html.judge(w))
    assert alone("<html><head><title>t</title><p>Hello") == "Hello"
    for tag in ("button", "select", "svg", "canvas", "object"):
        assert alone(f"<article><p>One<{tag}>x<p>Two</article>") == "One\nTwo", tag
        assert alone(f"<article><p>One<{tag}>x</{tag}><p>Two</article>") == "One\nTwo", tag
    assert alone("<article><p>A<select><option>b<option>c</select> d<ul><li>e<li>f</ul><table><tr><td>g<td>h<tr><td>i</table></article>") == "A d\ne\nf\ng\nh\ni"
    assert alone("<article><p>One<script>var x = '<p>no'") == "One" and alone(None) == alone("") == ""
    deep = alone("<div>" * 30_000 + "<p>deep")
    assert deep == "deep"


def made_host(r, style, host, n):
    """Pages of one template, and the main text of each by construction."""
    v = vocabulary()
    text = lambda k: " ".join(r.choice(v) for _ in range(k))
    motto, imprint, plea = text(9), text(12), text(10)
    pages = []
    for _ in range(n):
        blocks, want = [f"<h1>{(t := text(4))}</h1>"], [t]
        for _ in range(r.randint(2, 9)):
            kind = r.choice(["p", "p", "p", "ul", "quote", "h2"])
            t = text(r.randint(12, 40))
            if kind == "ul":
                items = [text(5) for _ in range(r.randint(1, 5))]
                blocks.append("<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")
                want += items
            else:
                blocks.append({"p": f"<p>{t}</p>", "quote": f"<blockquote><p>{t}</p></blockquote>", "h2": f"<h2>{t}</h2>"}[kind])
                want.append(t)
        if style == "article with a constant plea":
            blocks.insert(2, f"<p class='q7'>{plea}</p>")
        body = "".join(blocks)
        links = "".join(f"<li><a href=/{k}>{text(2)}</a>" for k in range(r.randint(2, 6)))
        box = {"plain": "div class='z1'", "tables": "td", "unnamed": "div"}.get(style, "article")
        main = f"<{box}>{body}</{box.split()[0]}>"
        if style == "tables":
            main = f"<table><tr><td><ul>{links}</ul></td>{main}</tr></table>"
        side = f"<div class='z9'><p>{text(4)}</p><ul>{links}</ul></div>" if style == "plain" else ""
        pages.append((f"https://{host}/{r.random()}", f"<html><body><div class='y1'>{motto}</div><div class='y2'><ul>{links}</ul></div>{main}{side}<div class='y3'>{imprint}</div></body></html>", "\n".join(want)))
    return pages


@pytest.mark.parametrize("style", ["plain", "unnamed", "tables", "article", "article with a constant plea"])
def test_html_against_texts_known_by_construction(spark, style):
    """No page has a telling class name; only the wrapper tells its parts."""
    made = made_host(random.Random(style), style, "made.org", 25)
    rows = [(k, u, p) for k, (u, p, _) in enumerate(made)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(made)}


def test_html_result_comes_through_the_wrapper():
    made = made_host(random.Random(2), "article with a constant plea", "x.org", 8)
    pages = [p for _, p, _ in made]
    w = wrapper_of(*pages)
    main = html.judge(w)
    for _, p, want in made:
        alone = html.parse(p)
        assert html.main_text(html.parse(p), w, main) == want != html.main_text(html.parse(p), alone, html.judge(alone))


def test_html_names_decide_only_what_the_wrapper_leaves_open():
    r, v = random.Random(5), vocabulary()
    text = lambda k: " ".join(r.choice(v) for _ in range(k))
    pages = [f"<article><p>{text(9)}</p><div class='notice of findings'><p>{text(8)}</p></div><div class=sidebar>The same for all.</div><div class=ad>{text(5)}</div></article>" for _ in range(6)]
    w = wrapper_of(*pages)
    assert all(len(html.main_text(html.parse(p), w, html.judge(w)).split("\n")) == 2 for p in pages)


def test_html_of_very_long_pages_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>word{k} and more</p><ul><li>{k}</ul>" for k in range(20_000)) + "</article><footer>f</footer>"
    rows = [(1, "http://h.org/1", long, "a", "b"), (2, "http://h.org/2", "<article><p>x</article>", None, None), (None, None, None, "c", "d")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, `host_` string, html_ string"), keep=("page_id", "host_", "html_"))
    out = {r.page_id: (r["host_"], r["html_"], len(r.text.split("\n")), r.text[:14]) for r in got.collect()}
    assert out == {1: ("a", "b", 40_000, "word0 and more"), 2: (None, None, 1, "x"), None: ("c", "d", 1, "")}


def test_html_of_an_empty_table(spark):
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_html_template_text_beyond_the_wrapper(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    rows, want = [], {}
    for p in range(6):
        texts = [f"page {p} says {k} of its own" for k in range(1400)]
        blocks = "".join(f'<div class="{name(p * 1400 + k)}">{t}</div>' for k, t in enumerate(texts))
        rows.append((p, "https://wide.org/", f'<html><body><div class="motto">The same words everywhere.</div>{blocks}<div class="imprint">Made by us.</div></body></html>'))
        want[p] = "\n".join(texts)
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


# ---------------------------------------------------------------- 2 quality


def test_quality_measures_against_brute_force(spark, docs, rows):
    w = vocabulary()
    more = [*rows, (900, " ".join(w[:10] * 3)), (901, "a b c\nd\n\na b c\n \n" * 6), (902, "x | y | z *** $$$ <&>" * 9), (903, " ".join(["same"] * 50)), (904, "Ä é\n" * 30)]
    got = {r.doc_id: r for r in quality.cascade(docs_frame(spark, more)).collect()}
    for i, t in more:
        ws, r = brute.words(t), got[i]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        n = brute.repeated_words(ws)
        failed = len(ws) < 20 or 100 * n > 30 * len(ws)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, failed), i
        assert not (r.kept and failed)
    assert got[0].kept and not got[902].kept and got[902].rejected_by


def test_quality_order_does_not_change_verdicts(spark, docs):
    kept = lambda d: sorted((r.doc_id, r.kept) for r in d.select("doc_id", "kept").collect())
    plain = docs.select("doc_id", "text")
    assert kept(quality.cascade(plain)) == kept(quality.cascade(plain, quality.rules()[::-1], ordered=False))


def test_quality_leaves_other_columns_alone(spark):
    d = spark.createDataFrame([(1, "a b", "mine", "yours", 7), (None, None, "x", "y", 8)], "doc_id long, text string, _q_text string, `_Q_lines` string, n_words int")
    got = quality.cascade(d).collect()
    assert {(r.doc_id, r["_q_text"], r["_Q_lines"], r.n_words, r.kept) for r in got} == {(1, "mine", "yours", 2, False), (None, "x", "y", 0, False)}


def test_quality_order_is_by_rejection_per_cost_and_repeatable(spark, docs):
    more = docs_frame(spark, [(i, " ".join(f"{w}#$" for w in vocabulary(60, i))) for i in range(30)] + [(100 + i, " ".join(vocabulary(80, 50 + i))) for i in range(30)])
    first = [(r.name, share, cost) for r, share, cost in quality.order(more, quality.rules())]
    assert first == [(r.name, share, cost) for r, share, cost in quality.order(more.repartition(7), quality.rules())]
    assert first[0][0] == "many symbols" and first[0][1] > 0
    rate = lambda r: r[1] / r[2]
    assert rate(first[0]) == max(map(rate, first))


def test_quality_of_an_empty_table(empty):
    assert quality.cascade(empty).count() == 0


# ---------------------------------------------------------------- 3 toxicity


def test_toxicity_learns_from_positives_and_unlabelled_alone(spark):
    r, v = random.Random(5), vocabulary()
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 8 == 0
        w = [r.choice(v) for _ in range(40)] + (r.sample(bad, 2) if toxic else [])
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, ""), (5001, None)]
    d = docs_frame(spark, rows)
    model = toxicity.learn(d, spark.createDataFrame([*labels, (None, 1), (7777, 1), (3, None)], "doc_id long, toxic int"))
    got = {x.doc_id: x.score for x in toxicity.score_texts(d, model).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    truth = dict(labels)
    caught = [got[i] >= toxicity.THRESHOLD for i in held if truth[i]]
    false = [got[i] >= toxicity.THRESHOLD for i in held if not truth[i]]
    assert np.mean(caught) > 0.95 and np.mean(false) < 0.02 and got[5000] == got[5001] < toxicity.THRESHOLD


def test_toxicity_without_labels_scores_zero(spark, docs, empty):
    model = toxicity.learn(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score_texts(docs, model).collect()) == 0
    assert toxicity.score_texts(empty, model).count() == 0


def test_toxicity_counts_and_scores_against_brute_force(spark, monkeypatch):
    """The chosen strings by plain counting, also of a text far longer than a row of strings, and the scores by a plain sum."""
    from math import exp, log

    monkeypatch.setattr(toxicity, "STRINGS_A_ROW", 7)
    r, v = random.Random(5), vocabulary()
    rows = [(i, " ".join([r.choice(v) for _ in range(30)] + (["idiot", "Moron!"] if i % 5 == 0 else []))) for i in range(300)] + [(300, " ".join(f"zz{k}" for k in range(30_000)) + " idiot")]
    labels = [(i, int(i % 5 == 0)) for i, _ in rows]
    model = toxicity.learn(docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.F.lit(True))
    n_p, n_u = sum(t for _, t in labels), len(labels)
    p, u = {}, {}
    for (_, text), (_, toxic) in zip(rows, labels):
        for s in toxicity.strings(text):
            u[s] = u.get(s, 0) + 1
            p[s] = p.get(s, 0) + toxic
    prior = n_p / n_u
    names = [s for s in p if p[s] > 2]
    part = lambda k, n, q: k * log(max(k, 1e-12) / (n * q)) + (n - k) * log(max(n - k, 1e-12) / (n * max(1 - q, 1e-12)))
    want = {}
    n_n = max(1, round((1 - prior) * n_u))
    for s in names:
        a, b = p[s], min(max(u[s] - prior * n_u * p[s] / n_p, 0), n_n)
        q = (a + b) / (n_p + n_n)
        if a / n_p > 2 * b / n_n and (ratio := 2 * (part(a, n_p, q) + part(b, n_n, q))) > 2 * log(len(names)):
            want[s] = ratio
    assert set(model.weights) <= set(want) and {"idiot", "moron"} <= set(model.weights)
    got = {x.doc_id: x.score for x in toxicity.score_texts(docs_frame(spark, rows), model).collect()}
    for i, text in rows:
        z = model.bias + sum(model.weights.get(s, 0) for s in toxicity.strings(text))
        assert abs(got[i] - 1 / (1 + exp(-max(-30, min(30, z))))) < 1e-9


def test_toxicity_of_texts_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 10)
    monkeypatch.setattr(toxicity, "MAX_UNLABELLED", 20)
    d = docs_frame(spark, [(1, f"idiot {k}") for k in range(200)] + [(i, f"fine {i}") for i in range(2, 60)])
    model = toxicity.learn(d, spark.createDataFrame([(i, int(i == 1)) for i in range(1, 60)], "doc_id long, toxic int"), toxicity.F.lit(True))
    assert len({r.score for r in toxicity.score_texts(d.where("doc_id = 1"), model).collect()}) >= 1


# ---------------------------------------------------------------- 4 tokens


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    r, v = random.Random(2), vocabulary()
    odd = ["It's, WELL-known; 'tis 3.14!! #tag", "Ünïcode Straße ΑΣ ẞ İstanbul W̊", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "é ́ x y z", "", None, "1234 ½ ² a1b2... ...", "日本語 テキスト 😀😀", "x|<>|y &amp;"]
    rows = [(k * 3 % 97, t) for k, t in enumerate([*odd, *(" ".join(r.choice([str.upper, str.title, str])(r.choice(v)) + r.choice(["", ",", ".", "'s"]) for _ in range(60)) for _ in range(50))])]
    got = sorted(tokens.token_output(docs_frame(spark, [*rows, rows[0]], extra=True)).collect(), key=lambda x: x.start)
    tok, start = Tokenizer.from_file(tokens.tokenizer_path()), 0
    want = sorted([*rows, rows[0]], key=lambda x: x[0])
    assert [x.doc_id for x in got] == [i for i, _ in want]
    for (i, t), x in zip(want, got):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), t
        start += len(ids)


def test_token_files_have_page_indexes_and_allow_metadata_reads(spark, docs):
    import pyarrow.parquet as pq

    at = C.scratch(spark, "t")
    tokens.write_tokens(docs, at, tokens.tokenizer_path())
    f = next(Path(at.removeprefix("file://")).glob("*.parquet"))
    g = pq.ParquetFile(f).metadata.row_group(0)
    assert all(g.column(k).has_offset_index and g.column(k).has_column_index for k in range(g.num_columns) if g.column(k).path_in_schema != "ids.list.element") and "DELTA_BINARY_PACKED" in g.column(0).encodings
    ids = next(g.column(k) for k in range(g.num_columns) if g.column(k).path_in_schema.startswith("ids"))
    assert ids.has_offset_index and {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(ids.encodings) and g.total_byte_size <= 2 * tokens.ROW_GROUP_BYTES
    assert tokens.read_tokens(spark, at).where("doc_id = 0").select("n_tokens").count() == 1


def test_tokens_of_texts_that_share_an_id_lie_alike_however_they_are_dealt(spark):
    rows = [(None if k % 2 else 5, f"text {k % 13} " * (k % 7)) for k in range(60)]
    d = docs_frame(spark, rows)
    one, many = (sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.token_output(x).collect()) for x in (d.coalesce(1), d.repartition(6)))
    assert one == many and len(one) == 60


def test_tokens_of_an_empty_table(empty):
    assert tokens.token_output(empty).count() == 0


# ---------------------------------------------------------------- 5 mixing


def test_mixing_meets_targets(spark, docs, empty):
    got = mixing.mix_sources(docs, keep=("source",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total and sum(r.taken for r in got) <= total
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows) and rows[0].target <= 3 * rows[0].source_size + 1e-9
    again = mixing.mix_sources(docs.repartition(5), keep=("source",)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert mixing.mix_sources(empty).count() == 0


# ---------------------------------------------------------------- 6, 7, 9


@pytest.mark.parametrize("seed", [3, 11])
def test_near_duplicates_against_brute_force(spark, seed):
    rows = corpus(seed, 90)
    got = neardup.near_duplicates(docs_frame(spark, [*rows, rows[4]], extra=True)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near_duplicates([*rows, rows[4]])
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_families_that_share_most_values(spark):
    """Many copies whose mutual similarity lies around the bound: links beside the hubs must be found too."""
    r, v = random.Random(9), vocabulary(900)
    base, rows = [r.choice(v) for _ in range(60)], []
    for i in range(150):
        w = list(base)
        for k in range(i % 7):
            w[r.randrange(60)] = r.choice(v)
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute.near_duplicates(rows)


def test_blocks_count_intersections():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in range(20)]
    got = neardup._intersections(sets[:8], sets[8:], width=7)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[8:]] for a in sets[:8]]


def test_blocks_estimate_by_the_sketch_of_the_union():
    r = np.random.default_rng(2)
    a, b = ([np.unique(r.integers(0, 50, r.integers(1, 30)).astype(np.uint64))[:12] for _ in range(15)] for _ in range(2))
    got = neardup._candidates(a, b, k=12, chunk=7)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            union = np.union1d(x, y)[:12]
            both = len(np.intersect1d(np.intersect1d(x, y), union))
            assert got[i, j] == (len(np.intersect1d(x, y)) >= max(1, min(len(x), len(y)) * 5 // 12) and both / len(union) >= neardup.ESTIMATE)


def test_blocks_emit_a_forest():
    a, b = np.array([1, 1, 2, 5, 3, 1, 7]), np.array([2, 2, 3, 6, 1, 3, 5])
    kept = neardup._forest(a, b)
    assert len(kept) == 4 and {frozenset((int(a[i]), int(b[i]))) for i in kept} <= {frozenset(x) for x in [(1, 2), (2, 3), (1, 3), (5, 6), (5, 7)]}


def test_near_duplicates_of_null_and_shared_ids(spark):
    v = vocabulary()
    text = lambda k: " ".join(v[k : k + 60])
    rows = [(1, text(0)), (1, text(100)), (2, text(100) + " end"), (None, text(0)), (None, None), (3, text(0) + " end")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs_frame(spark, rows)).collect()), key=str)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, None, True), (None, None, True)]


def test_near_duplicates_of_an_empty_table(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_a_lone_pair_below_the_estimate_is_judged_exactly(spark):
    sets = lambda w: C.shingle_sets(pa.array([" ".join(w)]))[0]
    a = [f"w{k}" for k in range(700)]
    whole = sets(a)
    least, b = whole[: neardup.K], list(a)
    while True:  # change the words that most of the retained shingles hold
        other = sets(b)
        shared = len(np.intersect1d(np.union1d(whole, other)[: neardup.K], np.intersect1d(whole, other)))
        if shared <= 22:
            break
        b[int(np.argmax([len(np.intersect1d(least, sets(b[max(0, k - 4) : k + 5]))) for k in range(len(b))]))] = f"other{shared}x{len(other)}"
    inter = len(np.intersect1d(whole, other))
    assert 20 <= shared and 4 * inter >= 3 * (len(whole) + len(other) - inter)
    got = neardup.near_duplicates(docs_frame(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1)]


def test_substrings_against_brute_force(spark, rows):
    more = [*rows, (500, " ".join(["a"] * 300)), (501, " ".join(["a"] * 120)), (502, " ".join(["a"] * 49)), rows[0]]
    got = substring.dedup_substrings(docs_frame(spark, more, extra=True)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.substrings(more)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got if r.kept_text is not None)


@pytest.mark.parametrize("window", [7, 12])
def test_substrings_with_short_windows(spark, window):
    r = random.Random(window)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randint(1, 60)))) for i in range(40)]
    got = substring.dedup_substrings(docs_frame(spark, rows), window).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.substrings(rows, window)


def test_substrings_of_rows_without_an_id(spark, rows):
    got = substring.dedup_substrings(docs_frame(spark, [(1, rows[0][1]), (None, rows[0][1]), (2, rows[0][1]), (None, rows[1][1] + " " + rows[0][1])])).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in got) == [("1", False), ("2", True), ("None", False), ("None", False)]


def test_substrings_stop_where_no_candidate_survives(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(80))) for i in range(5)]
    got = substring.dedup_substrings(docs_frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute.substrings(rows)


def test_substrings_of_an_empty_table(empty):
    assert substring.dedup_substrings(empty).count() == 0


def test_decontamination_against_brute_force(spark, docs, rows):
    r, v = random.Random(4), vocabulary()
    items = [(i, " ".join((rows[i % 60][1] or "").split()[i % 7 : i % 7 + r.randint(3, 60)])) for i in range(80)]
    items += [(90, ""), (91, None), (92, rows[3][1].split("\n")[1].upper()), (93, " ".join(r.choice(v) for _ in range(40))), (None, rows[0][1]), items[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted(((x.doc_id, x.contained_item) for x in got), key=lambda x: x[0]) == brute.contained(rows, items)
    assert all(x.contaminated == (x.contained_item is not None) for x in got)


def test_decontamination_in_slices_gives_the_same(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in rows if i % 3 == 0], "item_id long, text string")
    one = sorted(map(tuple, decontaminate.search(docs, bench, ["doc_id"]).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 60_000)
    assert sorted(map(tuple, decontaminate.search(docs, bench, ["doc_id"]).collect())) == one


def test_decontamination_of_clashing_columns_and_short_items(spark, monkeypatch):
    d = spark.createDataFrame([(1, "one Two three four five six", "a", "b", 1.0), (None, "x two THREE", None, None, 2.0), (None, None, "c", None, 3.0)], "doc_id long, text string, text_ string, digest_ string, containment double")
    bench = spark.createDataFrame([(7, "two three"), (8, "three two"), (9, "x two three four")], "item_id long, text string")
    for bound in (decontaminate.BROADCAST_BYTES, 300):
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        got = decontaminate.decontaminate(d, bench)
        assert set(got.columns) == {"doc_id", "text", "text_", "digest_", "contained_item", "containment", "contaminated"}
        assert {(r.doc_id, r.text_, r.contained_item, r.containment) for r in got.collect()} == {(1, "a", 7, 1.0), (None, None, 7, 1.0), (None, "c", None, None)}


def test_decontamination_time_does_not_grow_with_the_items():
    import time

    r, v = random.Random(1), vocabulary(5000)
    text = lambda n: " ".join(r.choice(v) for _ in range(n))
    docs, took = pa.array([text(400) for _ in range(200)]), {}
    for n in (400, 40_000):
        index = decontaminate.Index([(i, text(40)) for i in range(n)])
        began = time.perf_counter()
        index.search_all(docs)
        took[n] = time.perf_counter() - began
    assert took[40_000] < 4 * took[400] + 0.1, took


def test_decontamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, none).count() == 0


# ---------------------------------------------------------------- 8 lines


def brute_lines(rows, run=2, long_line=8):
    """Stretches of `run` lines, or one line of `long_line` words, that occur at an earlier place are deleted; places are ordered by id, hash of the text, and line."""
    import xxhash

    def order(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - (1 << 64) if h >> 63 else h

    def windows(w):
        for a in range(len(w)):
            if a + run <= len(w):
                yield a, run, tuple(s for _, s in w[a : a + run])
            if len(w[a][1].split()) >= long_line:
                yield a, 1, (w[a][1],)

    places, out = {}, []
    texts = [(i, [(k, s.strip(" \t\x0b\x0c\r")) for k, s in enumerate((t or "").split("\n")) if s.strip(" \t\x0b\x0c\r")], t) for i, t in rows]
    for i, w, t in texts:
        for a, _, k in windows(w):
            if i is not None:
                places[k] = min(places.get(k, (i, order(t), a)), (i, order(t), a))
    for i, w, t in texts:
        gone = {w[a + j][0] for a, n, k in windows(w) if i is not None and places[k] < (i, order(t), a) for j in range(n)}
        out.append((i, len(w), len(gone), None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out, key=str)


def found_lines(d, **more):
    return sorted(((x.doc_id, x.n_lines, x.n_removed, x.kept_text) for x in linededup.dedup_lines(d, **more).collect()), key=str)


@pytest.mark.parametrize("run", [2, 3])
def test_lines_against_brute_force(spark, empty, run):
    r = random.Random(6)
    lines = [f"line {k}" for k in range(12)] + ["", " \t", "  line 1  ", "one line of many words that is long enough", "another line of many words that is long enough too"]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 25)))) for i in range(80)] + [(90, None), (91, ""), (92, "x\n" * 40), (93, "x\ny\nx\ny")]
    rows += [(None, rows[0][1]), (None, None), (5, rows[6][1]), rows[7], (8, rows[8][1] + "\nmore\nline 3")]
    assert found_lines(docs_frame(spark, rows), run=run) == brute_lines(rows, run)
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_that_only_neighbours_tell_apart_are_extended_both_ways(spark):
    """The same selected line stands in different company: only the company decides."""
    rows = [(1, "p\nq\nr"), (2, "s\nq\nt"), (3, "s\nq\nr"), (4, "q"), (5, "x\np\nq\nr\ny")]
    assert found_lines(docs_frame(spark, rows)) == brute_lines(rows)


def test_lines_of_clashing_columns(spark):
    rows = [(1, "a\nb", 1, "x", 5), (2, "a\nb", None, None, 6), (None, "a\nb", 3, "z", 7)]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, `gone_` int, Gone_id_ string, n_lines int")).collect()
    assert {(r.doc_id, r["gone_"], r["Gone_id_"], r.n_lines, r.n_removed, r.kept_text) for r in got} == {(1, 1, "x", 2, 0, "a\nb"), (2, None, None, 2, 2, ""), (None, 3, "z", 2, 0, "a\nb")}


def test_lines_of_very_long_texts_take_linear_time_whatever_is_selected(spark):
    import time

    text = "\n".join(f"line number {k}" for k in range(40_000))
    out = linededup.dedup_lines(docs_frame(spark, [(1, text), (2, text)]))
    for columns in (["doc_id", "n_removed", "kept_text"], ["n_lines"], ["doc_id", "n_lines", "n_removed", "kept_text"]):
        began = time.perf_counter()
        got = out.select(*columns).collect()
        assert time.perf_counter() - began < 20
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == [(1, 40_000, 0, text), (2, 40_000, 40_000, "")]


# ---------------------------------------------------------------- 10 warc


def pages_frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, keeper long")


def test_warc_round_trip(spark):
    big, v = "<p>é" + "x" * 1200, vocabulary()
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, "http://c/", big), (3, None, None), (4, "u", ""), (5, "s", "small"), (6, "s", "small"), (7, "r", "<b>" * 400), (7, "r", "<b>" * 400), (None, "n", big), *[(None, "o", "null " * 1000)] * 3, (50, "long", "<i>very long</i>" * 200_000)]
    rows += [(100 + i, f"http://h/{i}", " ".join(v[i : i + 200]) * 3) for i in range(60)]
    at = C.scratch(spark, "w")
    manifest = warc.write_archives(pages_frame(spark, rows), at)
    assert sum(r.records for r in manifest.collect()) == len(rows)
    got = warc.read_archives(spark, at).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [(by[i][0].record_type, by[i][0].refers_to) for i in (1, 2, 9)] == [("revisit", 9), ("revisit", 9), ("response", None)]
    assert sorted((r.record_type, r.refers_to) for r in by[7]) == [("response", None), ("revisit", 7)]
    assert [(r.record_type, r.refers_to) for r in by[None] if r.payload_bytes == len(big.encode())] == [("revisit", 9)]
    alone = [(r.record_type, r.refers_to) for r in by[None] if r.payload_bytes == 5000]
    assert sorted(alone, key=str) == [("response", None), ("revisit", None), ("revisit", None)]
    assert [by[i][0].record_type for i in (3, 4, 5, 6)] == ["response"] * 4
    for i, u, h in rows:
        p = (h or "").encode()
        if i is None:
            continue
        assert {(r.payload_bytes, r.payload_digest) for r in by[i]} == {(len(p), hashlib.sha1(p).hexdigest())}


def test_warc_archive_layout_and_truncation():
    v = vocabulary()
    recs = [warc.record("response", i, f"http://h/{i}", (" ".join(v[i : i + 100])).encode(), "d", 1, i) for i in range(60)]
    dictionary = warc.train([r for r in recs] * 3)
    a = warc.Archive(dictionary)
    for r in recs:
        a.add(r)
    data = a.out.getvalue()
    assert dictionary and data[:4] == bytes.fromhex("5d2a4d18")
    assert [int(h["X-Page-Id"]) for h, _ in warc.read_archive(data)] == list(range(60))
    with pytest.raises(ValueError):
        list(warc.read_archive(data[:-3]))
    plain = warc.Archive(b"")
    plain.add(recs[0])
    assert len(list(warc.read_archive(plain.out.getvalue()))) == 1 and not list(warc.read_archive(b""))


def test_warc_ids_tell_rows_apart_and_settings_stay(spark):
    import re

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    at = C.scratch(spark, "w")
    warc.write_archives(pages_frame(spark, [(None, "a", "x"), (None, "b", "y"), (1, "c", "z"), (1, "d", "z")]), at).count()
    ids = []
    for f in Path(at.removeprefix("file://")).glob("*.warc.zst"):
        ids += [h["WARC-Record-ID"] for h, _ in warc.read_archive(f.read_bytes())]
    assert len(set(ids)) == 4 and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", i) for i in ids)
    assert warc.read_archives(spark, at).count() == 4 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_the_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://elsewhere:7077"
        _python_includes = ["ledgerloom.zip"]

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("conf", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(ValueError):
        C.shared_dir(Session())


def test_samples_are_bounded_and_repeatable(spark):
    d = spark.range(5000).selectExpr("id", "cast(id % 700 as string) as t")
    one, two = (sorted(map(tuple, C.sample(x, 100, "id", "t").collect())) for x in (d, d.repartition(9)))
    assert one == two and len(one) == 100 and C.sample(d.selectExpr("null id", "'x' t"), 100, "id", "t").count() <= 100


def test_warc_of_an_empty_table(spark):
    at = C.scratch(spark, "w")
    assert warc.write_archives(pages_frame(spark, []), at).count() == 0
