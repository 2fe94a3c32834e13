"""Trained operators: gradients against finite differences, held-out accuracy, edge cases."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import html_extract as H
from fleetpulse.llm import langid as G
from fleetpulse.llm import quality as Q
from fleetpulse.llm.html_blocks import leaf_blocks
from fleetpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def check_gradients(params, loss, grads, names, rng, rel=0.05):
    for name in names:
        p, g = params[name], grads[name]
        for at in [np.unravel_index(np.abs(g).argmax(), g.shape), *(tuple(rng.integers(0, s) for s in p.shape) for _ in range(3))]:
            old, step = p[at], 1e-3            # states are 32-bit
            p[at] = old + step
            up = loss()
            p[at] = old - step
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), rel=rel, abs=1e-5), name


# ---------------------------------------------------------------- language ID
def test_language_gradients():
    rng = np.random.default_rng(1)
    model = G.ByteGru(["a", "b", "c"], hidden=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, real, y = rng.integers(90, 110, (7, 5)).astype(np.uint8), np.array([7, 3, 1, 7, 5]), np.array([0, 1, 2, 0, 1])
    grads = model.gradients(x, real, y)[1]
    check_gradients(model.p, lambda: model.gradients(x, real, y)[0], grads, ["fx", "fh", "bx", "bh", "o", "ob"], rng)


def test_language_accuracy_on_held_out(spark):
    got = QUERIES["op7_language_id"](spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in got) == sorted(truth)
    held = [r for r in got if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


STRANGERS = [
    "Tämä on suomenkielinen teksti, jossa kerrotaan kaupungin kaduista ja ihmisistä, jotka kulkevat siellä joka päivä.",
    "Это обычный русский текст о городе и людях, которые там живут каждый день.", "deadbeef0123456789abcdef" * 6,
    "To jest zwykły polski tekst o mieście i ludziach, którzy tam mieszkają na co dzień.", "QWxhZGRpbjpvcGVuIHNlc2FtZQ==" * 4,
    '<div class="a"><ul><li><a href="/x">x</a></li></ul></div>' * 3, "这是一个关于城市和人们的普通文本，每天都有人住在那里。"]


def test_strangers_go_and_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    letters = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    model = G.train(docs, F.col("doc_id") % 3 != 1, strangers=True, per_language=400)
    assert model.languages[-1] == G.STRANGE
    odd = spark.createDataFrame([(-k, t, None) for k, t in enumerate(STRANGERS, 1)] + [(-98, "12 34", None), (-99, None, None)],
                                docs.schema)
    kept = {r.doc_id for r in G.keep_identified(docs.unionByName(odd), model, 0.3).select("doc_id").collect()}
    assert min(kept) >= 0
    assert len(kept) >= 0.995 * len(letters)


def test_samples_of_repeated_rows_are_bounded(spark):
    docs = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit("en").alias("lang"),
                                   F.concat(F.lit("the same words "), (F.col("id") % 3).cast("string")).alias("text"))
    for seed in range(4):                                      # all rows of a text fall in or out together
        alike = docs.withColumn("text", F.concat("text", F.lit(f" {seed}")))
        assert G.training_windows(alike, F.lit(True), per_language=20, pieces=2).count() <= 2 * 20 * 2
    labels = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    real, Q.AttentionModel.fit = Q.AttentionModel.fit, lambda self, x, n, y, **o: (seen.append(len(n)), self)[1]
    try:
        Q.train(docs, labels, F.lit(True), per_class=200)      # the whole of the id is drawn
    finally:
        Q.AttentionModel.fit = real
    assert seen == [4 * 200]


def test_language_edges(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate(
        [("the cat and the dog of that house " * 3, "en"), ("el perro que corre por la casa niño " * 3, "es")] * 30)]
    rows += [(None, "the house", "en"), (900, None, "en"), (901, "", "en"), (902, "12 34 !", None), (903, "the dog", None),
             (903, "niño que corre", None), (904, "the dog and the cat " * 9000, None), (905, "字", None)]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, lang string, k string, score double")
    model = G.train(docs, F.lit(True), per_language=40, pieces=4)
    assert model.languages == ["en", "es"]
    got = [(r.doc_id, r.lang_pred, r.score) for r in G.identify(docs, model).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, lang, s in got:
        by.setdefault(i, []).append((lang, s))
    for i in (900, 901, 902):
        assert by[i] == [("und", 0.0)]
    assert {x for x, _ in by[903]} == {"en", "es"} and by[904][0][0] == "en" and by[905][0][0] in ("en", "es")
    kept = G.keep_identified(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    none = G.train(docs.where("lang = 'xx'"), F.lit(True))
    assert {r.lang_pred for r in G.identify(docs, none).collect()} == {"und"}
    assert G.identify(docs.limit(0), model).collect() == []


def test_whole_text_counts():
    model = G.ByteGru(["a", "b"], hidden=4)
    text = "x" * 64 + "y" * 64 + "z" * 10                         # windows are independent: the means add up by bytes
    (_, whole) = model.predict([text])
    sums = sum(model.window_sums(*_packed(t)).sum(axis=0) for t in (text[:64], text[64:128], text[128:]))
    assert whole[0] == pytest.approx(float(sums.max() / len(text)), rel=1e-5)


def _packed(text):
    x, real = G.pack_windows([text.encode()])
    return x, real


# ---------------------------------------------------------------- quality
def test_attention_gradients():
    rng = np.random.default_rng(2)
    model = Q.AttentionModel(features=6, hidden=4, attention=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    x, counts, y, w = rng.standard_normal((9, 6)), np.array([1, 3, 2, 3]), np.array([0, 1, 1, 0]), np.ones(4)

    def loss():
        s = model._bag(x, np.cumsum(counts) - counts, counts)[6]
        return -float(np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))

    check_gradients(model.p, loss, model.gradients(x, counts, y, w), ["E", "e", "V", "U", "w", "c", "b"], rng)


def test_quality_on_held_out(spark):
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    held = [(got[r.doc_id].score, got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert np.mean([p == y for _, p, y in held]) > 0.97
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98         # area under the curve
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
               for i, r in got.items())


def test_quality_edges(spark):
    rows = [(k, t) for k, t in enumerate(["word and other plain words of a text here. " * 4, "spam spam spam spam !!! ### " * 9] * 20)]
    rows += [(None, "plain words"), (900, None), (901, ""), (902, " \n "), (3, "repeated id"), (903, "a longer text of words " * 30_000)]
    docs = spark.createDataFrame([(*r, "m", 2) for r in rows], "doc_id long, text string, label string, n_passages int")
    labels = spark.createDataFrame([(k, (k + 1) % 2, 0) for k in range(40)] + [(None, 1, 0), (2, None, 1), (5, 7, 1)],
                                   "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels, F.lit(True))
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[0].score > 0.8 > 0.3 > by[1].score and by[900].score == by[901].score and by[901].n_passages == 1
    assert by[903].n_passages == -(-len(rows[-1][1]) // Q.PASSAGE)
    assert Q.train(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in Q.score_quality(docs, None).collect()} == {0.5}
    assert Q.score_quality(docs.limit(0), model).collect() == []


def test_passages_do_not_depend_on_the_batch():
    texts = ["", "a", " lead and trail ", "x" * 1500, "two words " * 200, "é ü " * 300, "\n\n"]
    x, n = Q.encode(texts)
    at = 0
    for t, k in zip(texts, n):
        assert np.allclose(x[at:at + k], Q.encode([t])[0])
        at += k
    assert at == len(x)


# ---------------------------------------------------------------- HTML
PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><a href="/">Home</a></nav><!-- note --><article><h1>Head &amp; line</h1><p><b>One   two<br>three<p>Four
 five &nbsp;six</p></article><footer>&copy; me</footer>"""


def test_leaf_blocks():
    assert [b[1] for b in leaf_blocks(PAGE)] == ["Home", "Head & line", "One two three", "Four five six", "© me"]
    assert [t for t, _ in leaf_blocks(PAGE)[3][0]][-2:] == ["article", "p"]
    for odd in (None, "", "<", "<p", "</p></div>", "<a" * 2000, "<ul><li>a<li>b</ul>", "<![CDATA[x]]>", "&#xD800;&#0;"):
        leaf_blocks(odd)
    assert [b[1] for b in leaf_blocks("a<br>b<li>c<li>d")] == ["a b", "c", "d"]


@pytest.mark.parametrize(("html", "want"), [
    ("<article><p>one</p><svg><p>two</p><p>three</p>", ["one", "two", "three"]),
    ("<article><p>one <object data=x></p><p>two</p></article><p>three", ["one", "two", "three"]),
    ("<article><p>one</p><object><p>two</p></article><p>three</p>", ["one", "two", "three"]),
    ("<head><title>T<p>one</p><p>two</p>", ["one", "two"]),
    ("<html><head><title>T</title><meta charset=x><div>one</div><p>two", ["one", "two"]),
    ("<html><head><title>T</title>one <b>two</b>", ["one two"]),
    ("<head><title>T<body>one", ["one"]),
    ("<head><noscript><img src=x></noscript><title>T</title></head><p>one", ["one"]),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds", ["so x=2 holds"]),
    ("<p>a<noscript>b</noscript>c</p><iframe>d</iframe><video>e", ["a", "b", "c", "d", "e"]),
    ("<p>a<svg><title>no</title><path d=m><g/></svg>b</p>", ["ab"]),
    ("<div><template><p>no</p></div><p>a", ["a"]),
    ("<form><datalist><option>no</form><p>a", ["a"]),
])
def test_no_text_is_lost_to_an_element(html, want):
    assert [b[1] for b in leaf_blocks(html)] == want


def test_block_gradients():
    rng = np.random.default_rng(3)
    pages, labels = H.training_set([PAGE, PAGE.replace("Four", "More words stand here. " * 9)], 1)
    model = H.BlockLabeller(hidden=3)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    buckets, dense = H.page_inputs(pages, H.PathBuckets())
    args = (buckets, dense.astype(float), np.array([len(p) for p in pages]), np.array([v for x in labels for v in x], float))
    grads = model.gradients(*args)[1]
    check_gradients(model.p, lambda: model.gradients(*args)[0], grads, ["fp", "bp", "fx", "bx", "fh", "bh", "fb", "bb", "o", "ob"], rng)


@pytest.fixture(scope="module")
def labeller(spark):
    return H.train(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), train_pages=200)


def test_held_out_layouts(spark, labeller):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(150).collect()
    pages, labels = H.training_set([r.html for r in rows], 2, seed=77)
    wrong = np.concatenate([(p >= 0.5).astype(int) != np.array(y) for p, y in zip(labeller.label(pages, H.PathBuckets()), labels)])
    assert wrong.mean() < 0.01


def test_pages_give_their_articles(spark, labeller):
    docs = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(docs, labeller).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = 0
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", r.html, re.DOTALL).group(1)
        right += got[r.page_id].text == "\n\n".join(b[1] for b in leaf_blocks(inside))
    assert right / len(rows) > 0.99
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_text_in_any_element_of_the_article_stays(spark, labeller):
    words = [" ".join(f"{w}{k}" for w in "the river ran past our house and over stones".split()) + "." for k in range(6)]
    inside = ("<h1>{}</h1><p>{}</p><object><p>{}</p></object><p><math><mi>{}</mi></math></p>"
              "<noscript><p>{}</p></noscript><svg><p>{}</p>").format(*words)
    html = f"<head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article>{inside}</article></body>"
    got = H.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), labeller).first()
    assert got.text == "\n\n".join(words)


def test_sample_of_one_repeated_id_is_bounded(spark):
    page = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html").limit(1)
    many = page.crossJoin(F.broadcast(spark.range(3000))).select(F.lit(7).alias("page_id"), "url", "html")
    seen = []
    real, H.training_set = H.training_set, lambda htmls, **o: (seen.append(len(htmls)), ([], []))[1]
    try:
        H.train(many, train_pages=20)
    finally:
        H.training_set = real
    assert seen == [20]


def test_extract_edges(spark, labeller):
    long = "<html><body><article>" + "<p>Some words stand in this paragraph.</p>" * 20_000 + "</article></body></html>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE), (4, "u", long),
            (5, "u", "<script>only()</script>"), (6, "u", "<nav><a href=x>Menu</a></nav>")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in H.extract(pages, labeller).collect()]
    assert len(got) == len(rows)
    main = "Head & line\n\nOne two three\n\nFour five six"
    assert got.count((3, "u", main, len(main))) == 2 and (None, "u", main, len(main)) in got
    assert {(1, "u", "", 0), (2, None, "", 0), (5, "u", "", 0), (6, "u", "", 0)} <= set(got)
    assert next(t for i, _, t, _ in got if i == 4).count("\n\n") == 19_999
    assert H.extract(pages.limit(0), labeller).collect() == []
    assert H.extract(pages, H.train(pages.limit(0))).count() == len(rows)
