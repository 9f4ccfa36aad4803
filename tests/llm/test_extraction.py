"""Extraction: trees, exact marginals against all labellings, held-out pages, the given pages, edges."""

import html as entities
import itertools
import re
from collections import Counter

import numpy as np
import pytest

from merchloom.llm import extraction, layouts, queries
from merchloom.llm.dom import parse
from merchloom.llm.extraction import KINDS, Trees, sum_product


def texts(html):
    return [t for t in parse(html).texts if t]


@pytest.mark.parametrize("html, want", [
    ("<p>One<p>two <b>bold\n <i>x</i></b> y<div>three</div>four", ["One", "two bold x y", "three", "four"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>4", ["1", "2", "3", "4"]),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &amp; &lt;b&gt; &#233;&nbsp;&eacute;</p><textarea><p>no</textarea>", ["yes & <b> é é"]),
    ("a < b and c > d <3", ["a < b and c > d <3"]),
    ("<p title=\"x > y\">in</p><p class=it's>it's <a href='a\"b>'>so</a></p>", ["in", "it's so"]),
    ("<div><button>no<div>no</div></button>yes<label>no</div><p>after", ["yes", "after"]),
    ("<select><option>no<option>no</select>yes<noscript><p>no</p></noscript>", ["yes"]),
    ("one<br>two<hr>three</p>four", ["one two", "three", "four"]),
    ("<!-- open <p>no", []), ("<script>no", []), ("", []), ("plain", ["plain"]), ("<P>A</P><DIV>B</DIV>", ["A", "B"]),
    ("</div></p><p>x</table></li>y", ["xy"]),
])
def test_blocks_of_text(html, want):
    assert texts(html) == want


def test_parents_come_first_and_links_count():
    page = parse('<body class="a"><nav id=Top><a href=x>Home</a> or</nav><div><p>x</div><p>y')
    assert all(p < i for i, p in enumerate(page.parents))
    at = page.texts.index("Home or")
    assert page.linked[at] == 4 and page.names[page.parents[at]] == "Top"
    assert page.tags[page.parents[page.texts.index("y")]] == "p" and page.tags[page.parents[page.parents[page.texts.index("y")]]] == "body"


def test_deep_and_hostile_pages():
    deep = parse("<div>" * 30_000 + "x" + "</div>" * 30_000)
    assert len(deep.tags) == 30_002
    assert texts("<a \"" * 20_000 + ">x") == ["x"]
    assert texts("<p " + "a='" * 20_001 + ">x") == ["x"]
    model = extraction.Model({}, np.zeros(0), np.zeros((KINDS, 2, 2)))
    assert np.allclose(model.marginals([deep]), 0.5)


def test_marginals_against_all_labellings():
    draw = np.random.default_rng(5)
    for _ in range(20):
        pages = []
        for _ in range(2):
            page = parse("")
            for _ in range(draw.integers(0, 6)):
                page.add(int(draw.integers(0, len(page.tags))), str(draw.choice(["p", "div", "#text", "li", "b"])), text="")
            pages.append(page)
        nodes = sum(len(p.tags) for p in pages)
        trees = Trees.of(pages, [[[] for _ in p.tags] for p in pages], {})
        scores, edges = draw.normal(size=nodes) * 3, draw.normal(size=(KINDS, 2, 2)) * 2
        got, *messages = sum_product(trees, scores, edges)
        joint = extraction.joint_marginals(trees, *messages, edges)
        chance, both, total = np.zeros(nodes), np.zeros((nodes, 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=nodes):
            weight = np.exp(sum(scores[i] * y[i] for i in range(nodes)) + sum(
                edges[trees.kinds[i], y[trees.parents[i]], y[i]] for i in range(nodes) if trees.parents[i] >= 0))
            total += weight
            chance += weight * np.array(y)
            for i in range(nodes):
                if trees.parents[i] >= 0:
                    both[i, y[trees.parents[i]], y[i]] += weight
        assert np.allclose(got, chance / total) and np.allclose(joint, both / total)


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(layouts.labelled_pages(spark, queries.LABELLED_PAGES))


def quality(pairs):
    """(precision, recall) in characters of whole blocks."""
    good = extra = lost = 0
    for got, want in pairs:
        a, b = (Counter(t.split("\n\n")) if t else Counter() for t in (got, want))
        size = lambda c: sum(len(k) * n for k, n in c.items())
        good, extra, lost = good + size(a & b), extra + size(a - b), lost + size(b - a)
    return good / (good + extra), good / (good + lost)


def test_held_out_layouts(spark, model):
    drawn = [layouts.draw_page(seed) for seed in range(500_000, 500_400)]
    got = ["\n\n".join(b) for b in model.blocks([parse(html) for html, _ in drawn])]
    precision, recall = quality(list(zip(got, [text for _, text in drawn], strict=True)))
    assert precision > 0.97 and recall > 0.97


def article(html):
    inside = re.sub(r"</?b>|<br>", "", re.search("<article>(.*?)</article>", html, re.DOTALL).group(1))
    return "\n\n".join(t for part in re.split("</?(?:p|h1)>", inside) if (t := " ".join(entities.unescape(part).split())))


def test_query_on_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.queries()["op13_extraction"](spark, sf).collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text == article(pages[r.page_id]) for r in rows) >= 0.99 * len(rows)


HAND = """<html><body><div id="cookie-bar"><p>We use cookies to make the site better. Please accept them all, thank you.</p></div>
<header class="site"><a href="/">Daily</a><nav><ul><li><a href=a>World</a><li><a href=b>Sport</a></ul></nav></header>
<div class="layout"><main><h1>A title</h1><p>First paragraph of the story, with some <a href=x>linked words</a> in it.</p><div class="advertisement">Buy our fine new
shoes today. They are cheap.</div><p>Second paragraph. It has two sentences.</p><ul><li>A point made.</li><li>Another point made.</li></ul></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=1>A long headline about something</a></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>I do not agree with this at all. It is wrong.</p></div><div class="comment"><p>Well said, I liked it.</p></div></section>
<form class="newsletter"><p>Sign up for our letter, it is free.</p><input name=mail><button>Go</button></form></div>
<footer><p>&copy; 2024 Daily. All rights reserved. No part may be copied.</p></footer></body></html>"""


def test_a_page_of_another_hand(model):
    assert model.blocks([parse(HAND)])[0] == [
        "A title", "First paragraph of the story, with some linked words in it.", "Second paragraph. It has two sentences.", "A point made.", "Another point made."]


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "<p></p>"), (None, HAND), (4, HAND), (4, HAND), (5, "<article><p>" + "word and word. " * 40_000 + "</p></article>")]
    frame = spark.createDataFrame([(*r, "clash", 7, "kept") for r in rows], "page_id long, html string, text string, n_chars long, url string")
    got = extraction.extract(frame, model).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows] and all(r.url == "kept" for r in got)
    assert [r.text for r in got[:3]] == ["", "", ""] and got[0].n_chars == 0
    assert got[3].text == got[4].text == got[5].text and got[3].n_chars > 100
    assert got[6].n_chars == 15 * 40_000 - 1
    assert extraction.extract(frame.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        extraction.fit(spark.createDataFrame([], "html string, text string"))
