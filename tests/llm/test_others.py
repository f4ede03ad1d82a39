"""Top-k search, chat examples, pages and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np

from papyrine.llm import chat, html_text, topk


def test_top_k_matches_brute_force(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = random.Random(0)
    vectors = {i: [rng.choice([rng.gauss(0, 1), 0.0, 0.5]) for _ in range(6)] for i in range(330)}
    vectors |= {330: [], 331: [1.0, float("nan")] + [0.0] * 4, 332: None, 333: [float("inf")] * 6, 334: [None] * 6, 335: vectors[7]}
    rows = spark.createDataFrame([(k, v, "x") for k, v in vectors.items()], "vec_id long, embedding array<float>, score string")
    got = topk.top_k(rows.union(rows.filter("vec_id = 5")), F.col("vec_id") % 100 == 0, 10).toPandas()
    held = {r.vec_id: list(r.embedding) for r in rows.collect() if r.embedding is not None}
    good = {k: [math.floor(1024 * x) for x in v] for k, v in held.items() if all(x is not None and math.isfinite(x) for x in v)}
    for q in (0, 100, 200, 300):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), k) for k, v in good.items() if k != q)[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert list(zip(-own.score, own.vec_id, strict=True)) == scores
    assert topk.top_k(rows.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(rows.filter("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0).toPandas()
    assert len(few) == 2
    clashing = rows.withColumns({c: F.lit("z") for c in ("rank", "query_id", "v", "_block", "_asked")})
    assert topk.top_k(clashing, F.col("vec_id") % 100 == 0).count() == 40


def test_lists_are_read_until_outsiders_cannot_qualify():
    rng = np.random.default_rng(2)
    x = np.concatenate((np.floor(rng.normal(0, 100, (4000, 6))), np.floor(rng.normal(0, 100, (11, 6))) + 3000))
    q = np.abs(np.floor(rng.normal(0, 50, (20, 6)))) + 1
    shares = []
    for row, (left, score, stop, read) in zip(q, topk.read_lists(q, x, 11), strict=True):
        exact = x @ row
        best = np.argsort(-exact, kind="stable")[:11]
        assert set(best) <= set(left) and np.array_equal(score, exact[left])
        shares.append((stop, read))
    assert all(stop == read < 0.126 for stop, read in shares)  # the large ones are first in all lists
    for a in (rng.normal(0, 1, (500, 8)), np.ones((50, 3)), np.zeros((9, 2)), np.floor(rng.normal(0, 3, (300, 2)))):
        for row, (left, score, stop, read) in zip(a[:5], topk.read_lists(a[:5], a, 4), strict=True):
            assert set(np.flatnonzero(a @ row > np.sort(a @ row)[-4] + 1e-9)) <= set(left) and stop <= read <= 1
            assert np.allclose(score, a[left] @ row)


def test_large_components_are_exact(spark):
    from pyspark.sql import functions as F

    vectors = {0: [3e6, 1.0], 1: [5e5, 0.0], 2: [4e5, 0.0], 3: [4e5, 1 / 1024], 4: [-4e5, 0.5], 5: [3e38, 0.0], 6: [1e15, 1.0]}
    rows = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = topk.top_k(rows.filter("vec_id < 5"), F.col("vec_id") == 0).collect()
    own = [math.floor(1024 * c) for c in vectors[0]]
    exact = {k: sum(a * math.floor(1024 * c) for a, c in zip(own, v, strict=True)) for k, v in vectors.items()}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == sorted(((k, exact[k]) for k in (1, 2, 3, 4)), key=lambda x: -x[1])
    far = {r.vec_id: r.score for r in topk.top_k(rows, F.col("vec_id") == 0).collect()}
    assert far[5] == 2**63 - 1 == far[6] and far[2] == exact[2]


def test_chat_examples_can_be_read_back(spark):
    odd = "\\l \\b < </turn>\n<turn>x<text>\\"
    turns = [(1, 0, "system", "s"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"), (2, 0, "user", "only"), (3, None, None, "x"), (3, 2, "assistant", "y"), (3, 2, "assistant", "y"), (None, 0, "assistant", "n")]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    examples = chat.chat_examples(rows)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, x or "") for _, _, r, x in turns[:6]]
    assert got[1].replies == [odd, ""] and got[2].replies == [] and got[3].replies == ["y", "y"]
    assert [(t.role, t.text) for t in got[3].turns] == [("", "x"), ("assistant", "y"), ("assistant", "y")]
    assert got[None].replies == ["n"]
    assert examples.filter("conv_id = 1").count() == 3
    assert got[1].formatted_chars == sum(len(r.prompt + r.reply) for r in examples.filter("conv_id = 1").collect())
    assert chat.chat_examples(rows.filter("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><nav><a href="/">Home</a></nav></header><!-- note <p>no</p> -->
<div class="cookie-notice"><p>We use cookies on this site, as everyone does, and tell you so at length.</p></div>
<div id="page"><article><header><h1>Title &amp; more</h1></header><p>First <b>bold</b>text with&nbsp;space
 and   lines.<p>Second &lt;tag&gt; paragraph that goes on for a while, as paragraphs do.<div class="ad">Buy now</div>
<ul><li>One item of a list<li>Another item of it</ul><form><input value="x">Send</form><p>Short.</p></article>
<aside><p>Popular stories that have little to do with this one.</p></aside>
<section class="comments"><p>I disagree with all of this, and here is a long comment to say why.</p></section></div>
<footer>&copy; Site</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more First boldtext with space and lines. Second <tag> paragraph that goes on for a while, as paragraphs do. One item of a list Another item of it Short."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain 1 < 2 text") == "plain 1 < 2 text"
    assert html_text.main_text('<p title="a>b">x</p><p class=\'odd">y</p>') == "x y"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_main_text_of_sections():
    paragraph = "<p>A paragraph with enough words in it to be dense text, number {}.</p>"
    body = "".join(f"<section>{''.join(paragraph.format(10 * k + i) for i in range(4))}</section>" for k in range(3))
    page = f"<html><body><div class='menu'><a href=x>a</a></div><div>{body}</div><div>{'<a href=x>link</a> ' * 20}</div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("A paragraph") and text.endswith("number 23.") and text.count("number") == 12


def test_main_text_with_telling_names():
    one, two, three = (f"Paragraph {x} of the text, with enough words in it to be dense, as paragraphs of articles are." for x in ("one", "two", "three"))
    menu = "<div class='menu'><a href=x>Home</a></div><div class='related-posts'><a href=x>Other</a></div>"
    pages = [
        (f"<article><h2>A paper</h2><p>{one}</p><section id='discussion'><h2>Discussion</h2><p>{two}</p></section></article>", f"A paper {one} Discussion {two}"),
        (f"<article><p>{one}</p><h2 id='side-effects'>Side effects</h2><p class='notice'>{two}</p></article>", f"{one} Side effects {two}"),
        (f"<article><h1 id='social-media-rules'>Rules</h1><p>{one}</p></article>", f"Rules {one}"),
        (f"<article class='social-policy'><p>{one}</p><p>{two}</p></article>", f"{one} {two}"),
        (f"<article><p>{one}</p><div id='related-work' class='level2'><p>{two}</p></div><div class='section' id='search'><p>{three}</p></div></article>", f"{one} {two} {three}"),
        (f"<form id='aspnetForm' method='post'><input type='hidden' value='x'><div><p>{one}</p><p>{two}</p></div><button>Go</button></form>", f"{one} {two}"),
        (f"<div>{'<a href=x>a link to elsewhere</a> ' * 40}</div><form><article><p>{one}</p><p>{two}</p></article></form>", f"{one} {two}"),
    ]
    for body, text in pages:
        assert html_text.main_text(f"<html><body>{menu}{body}</body></html>") == text


def test_small_forms_and_notices_stay_out():
    one = "A paragraph of the text, with enough words in it to be dense, as paragraphs of articles are."
    odd = "".join(f"<div class='{x}'><p>Words that are not the article's.</p></div>" for x in ("notice", "socialShare", "search_form", "alert", "cookie-notice", "comment-list"))
    assert html_text.main_text(f"<body><div><p>{one}</p>{odd}<form><p>Your name</p></form><p>{one}</p></div></body>") == f"{one} {one}"


def test_pages_frame(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 4), (None, "u", "<p>x", 5)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract_main_text(rows).toPandas()
    assert len(got) == 3 and (got.n_chars == got.text.str.len()).all()
    assert html_text.extract_main_text(rows.filter("false")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.filter("piece = 0").count() == kept.count() > 0
    again = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, again.select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
