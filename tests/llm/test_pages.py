"""Densities against a plain recursive version, pages without article or main, hostile and long pages."""

from __future__ import annotations

import html.parser
import math
import random
import time

import pytest

from papyrine.llm import html_text
from papyrine.llm.html_text import main_text

DENSE = "Paragraph {} of the text, with enough words in it to be dense, as paragraphs of articles are."


class Tree(html.parser.HTMLParser):
    """Nodes of well-formed pages as [tag, children, own texts], in the order of their start tags."""

    def __init__(self):
        super().__init__()
        self.nodes, self.open = [], []

    def handle_starttag(self, tag, attrs):
        node = [tag, [], []]
        if self.open:
            self.open[-1][1].append(node)
        self.nodes.append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if self.open:
            self.open[-1][2].append(data)


def below(node):
    return [node, *(x for child in node[1] for x in below(child))]


def chars(node):
    return sum(len("".join("".join(x[2]).split())) for x in below(node))


def links(node):
    return sum(chars(x) if x[0] == "a" else links(x) for x in node[1])


def density(node, body):
    c, t = chars(node), len(below(node))
    linked = c if node[0] == "a" else links(node)
    tags = sum(x[0] == "a" for x in below(node)) - (node[0] == "a")
    if not c:
        return 0.0
    base = math.log(c / max(1, c - linked) * linked + links(body) / chars(body) * c + math.e)
    value = max(1.0, c / max(1, linked) * t / max(1, tags))
    return c / t * math.log(value) / (math.log(max(base, 1.0001)) if base > 1.0001 else 1e-4)


def random_page(rng):
    def words(n):
        return " ".join(rng.choice(["plain", "stone", "river", "light", "of", "and"]) for _ in range(n))

    def part(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return f"<p>{words(rng.randrange(1, 40))}{rng.choice(['', '<b>bold text</b>', '<a>a link here</a>'])}</p>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a>{words(2)}</a></li>" for _ in range(rng.randrange(1, 9))) + "</ul>"
        return "<div>" + "".join(part(depth - 1) for _ in range(rng.randrange(1, 6))) + "</div>"

    return f"<html><body>{''.join(part(3) for _ in range(rng.randrange(1, 5)))}</body></html>"


def test_core_and_threshold_match_a_plain_version():
    rng = random.Random(11)
    for _ in range(150):
        source = random_page(rng)
        tree = Tree()
        tree.feed(source)
        body = tree.nodes[1]
        inside = [x for x in tree.nodes[1:] if x[0] not in ("a", "b")]
        core = max(inside, key=lambda x: sum(density(y, body) for y in x[1]))
        least = min(density(x, body) for x in inside if any(y is core for y in below(x)))
        page = html_text.Page(source)
        path, threshold = html_text.core_and_threshold(page, html_text.Densities(page))
        assert tree.nodes[path[0] - 1] is core and threshold == pytest.approx(least)


def test_density_chooses_without_article_or_main():
    text = "".join(f"<p>{DENSE.format(i)}</p>" for i in range(6))
    whole = " ".join(DENSE.format(i) for i in range(6))
    comments = "".join(f"<div class='c'><p>Comment {i} says that nothing of this is right at all, at some length.</p></div>" for i in range(12))
    foot = "<div>Copyright 2024 by the people who write here. All rights are reserved by them.</div>"
    menu = "".join("<li><a href=x>Menu item</a></li>" for _ in range(9))
    for body, expected in (
        (f"<div class='content with-sidebar'>{text}</div>", whole),
        (f"<div class='widget'>{text}<div class='ad'>Buy this</div></div>", whole),
        (f"<div id='post'><h1>Title</h1>{text}</div><section class='comments'>{comments}</section>{foot}", f"Title {whole}"),
        (f"<div id='post'><h1>Title</h1>{text}<section class='comments'>{comments}</section></div>{foot}", f"Title {whole}"),
        (f"<div class='wrap'><h1>Title</h1><div class='body'>{text}</div></div>{foot}", f"Title {whole}"),
        (f"<div><ul>{menu}</ul>{text}</div>", whole),
        (f"<table><tr><td>{menu}</td><td><h1>T</h1>{text}</td></tr></table>", f"T {whole}"),
        ("".join(f"<div><section>{text}</section></div>" for _ in range(3)), f"{whole} {whole} {whole}"),
    ):
        assert main_text(f"<html><body>{body}</body></html>") == expected


def test_density_chooses_among_articles():
    text = "".join(f"<p>{DENSE.format(i)}</p>" for i in range(5))
    cards = "".join(f"<article class='card'><h2>Card {i}</h2><p>Teaser text of some words.</p></article>" for i in range(8))
    whole = "Real " + " ".join(DENSE.format(i) for i in range(5))
    assert main_text(f"<body><main>{cards}<article><h1>Real</h1>{text}</article></main></body>") == whole
    assert main_text(f"<body><article class='post tags-science'><h1>Real</h1>{text}</article>{cards}</body>") == whole


def test_inline_elements_do_not_part_words_and_the_rest_of_a_page_counts():
    assert main_text("<body><p>wo<img src=x>rd<script>1</script>s <i>he</i>re<!-- no -->in</p></body></html><p>after</p>") == "words herein after"
    assert main_text("<head><title>T</title><p>body without a tag</p>") == "body without a tag"
    assert main_text("<p>one<br>two<div>three</div>&amp;lt; &nbsp; &#x41;") == "one two three &lt; A"


@pytest.mark.parametrize("piece", ['<a "', "<a x='", "<div>", "<p>", "<p><b>", "<b></i>", "<li>", "<ul><li>", "<td>", "<table>", "<a href=x>", "<", "</", "<!--", "<!-- >", "<script>", "&", "<a x=y ", "</div>", "<p></div>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    main_text(piece * 100_000)
    assert time.perf_counter() - start < 6


def test_deep_open_elements_and_unmatched_ends():
    start = time.perf_counter()
    assert main_text("<div>" * 20_000 + "deep" + "</span></p></td>" * 20_000) == "deep"
    assert main_text("<p>word</p>\n" * 60_000) == " ".join(["word"] * 60_000)
    assert time.perf_counter() - start < 12


def test_pages_repeat_and_clash(spark):
    rows = spark.createDataFrame([(1, "u", f"<p>{DENSE.format(1)}", "x", 1)] * 3, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract_main_text(rows).collect()
    assert [tuple(r) for r in got] == [(1, "u", DENSE.format(1), len(DENSE.format(1)))] * 3


def test_formulas_drawings_and_fallbacks_are_text():
    page = "<html><body><nav>menu</nav><article><p>We have <math><mi>E</mi><mo>=</mo><mi>mc</mi></math> here.</p><p>See <svg><path d='x'/><text>axis</text></svg>, <object data='x'>a film</object> and <canvas>a plot</canvas>.</p></article></body></html>"
    assert main_text(page) == "We have E=mc here. See axis, a film and a plot."


def test_articles_of_like_length_stay_together():
    said = ["word " * 60, "term " * 50, "rare " * 5]
    page = f"<body><nav>menu</nav><main><article><h1>A</h1><p>{said[0]}</p></article><article><h2>B</h2><p>{said[1]}</p></article><article><p>{said[2]}</p></article><article class='comment'><p>{said[0]}</p></article></main><footer>end</footer></body>"
    words = main_text(page).split()
    assert words.count("word") == 60 and words.count("term") == 50 and "menu" not in words and "end" not in words
    alone = f"<body><main><article><p>{said[0]}</p></article><aside><article><p>{said[1]}</p></article></aside></main></body>"
    assert main_text(alone).split() == ["word"] * 60
