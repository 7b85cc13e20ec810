"""The page reader, the graphical model against enumeration, and extraction of varied pages."""

import itertools

import numpy as np
import pytest

from ebbtide.llm import html_extract, html_tree
from tests.llm.helpers import saved

LONG = "It was a fine day when the ship came in with all its sails set, and the whole town stood at the quay to see it. "


def leaves(source):
    return [t for t in html_tree.read(source).text if t is not None]


@pytest.mark.parametrize("source, want", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p>a <b>b</b>c<br>d</p>e", ["a bc d", "e"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]), ("<b>x<p>y</b>z", ["x", "yz"]),
    ("a &lt;p&gt; &amp;amp; &copy; &#65;&#x42; &nbsp; &unknown; &am", ["a <p> &amp; © AB &unknown; &am"]),
    ("<!-- <p>x</p> -->a<!-- open", ["a"]), ("<script>if (a</b) '<p>'</script>b<STYLE>x</Style >c", ["b", "c"]),
    ("<script>never closed <p>x", []), ("<div title='a > b' data-x=\">\">in</div>out", ["in", "out"]), ("1 < 2 <3", ["1 < 2 <3"]),
    ("</p></div>a</b>", ["a"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
    ("a<hr>b<img src=x>c", ["a", "bc"]), ("<a href=x>one</a> <a href=y>two", ["one two"]), ("<p>a</p\n>b", ["a", "b"]),
    ("<article>a<div>b</article>c", ["a", "b", "c"]), ("<p \n\t class=x>\n a \r\n b\t</p>", ["a b"]), ("<a \"<p>b", ["b"]),
    ("<!DOCTYPE html><?xml version='1'?>a</ >b", ["ab"]), ("<x-box>a</x-box>b", ["a", "b"])])
def test_reader(source, want):
    assert [t for t, silent in zip(html_tree.read(source).text, html_tree.read(source).silent) if t is not None and not silent] == want


def test_reader_is_linear_on_odd_pages():
    for source in ("<" * 200_000, "<a \"" * 50_000, "<div>" * 50_000 + "x", "<p>" * 50_000 + "x", "<!--" * 50_000, "&" * 200_000, "</div>" * 50_000):
        page = html_tree.read(source)
        forest = html_tree.Forest()
        forest.grow(page)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for source in ("<div>a<p>b</p><p>c</p></div>d", "<ul><li>a<li>b</ul><div><div>c</div></div>", "x"):
        forest = html_tree.Forest()
        forest.grow(html_tree.read(source))
        n = len(forest.parent)
        unary, edges = rng.normal(size=n), rng.normal(size=(2, 2, 2))
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(unary[i] * y[i] for i in range(n))
            s += sum(edges[int(forest.leaf[i])][y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
            weight[y] = np.exp(s)
        total = sum(weight.values())
        want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        got, joint = html_extract.Trees(forest).marginals(unary, edges)
        assert np.allclose(got, want)
        for i in range(1, n):
            both = [[sum(w for y, w in weight.items() if (y[forest.parent[i]], y[i]) == (a, b)) / total for b in (0, 1)] for a in (0, 1)]
            assert np.allclose(joint[i], both)


@pytest.fixture(scope="module")
def model():
    return html_extract.train(html_extract.examples())


#: Pages unlike the layouts, with the text that is to be found.
PAGES = [
    (f"<html><head><title>T</title></head><body class='single'><div class='site-header'><a href='/'>Home</a><div class='menu'><a href=1>News</a> <a href=2>Sport</a></div></div>"
     f"<div class='entry'><h1>Ship comes in</h1><p>{LONG}</p><div class='advertisement'>Buy now and save.</div><p>{LONG * 2}</p></div>"
     f"<div class='comments-area'><h3>2 replies</h3><ol><li><p>{LONG * 2}</p></li><li><p>I saw it too.</p></li></ol></div><div class='site-info'>© 2020</div></body></html>",
     "Ship comes in " + " ".join((LONG * 3).split())),
    (f"<main><h1>A day</h1><p>{LONG}<p>Short.</main><aside><p>{LONG}</p></aside><footer><p>{LONG}</p></footer>",
     "A day " + LONG + "Short."),
    (f"<nav><a href=1>a</a></nav><article><h2>Part</h2><p>{LONG}</p><form><p>Your mail please, so that we can write to you.</p><input></form>"
     f"<p>End &amp; out.</p><section id=comments><article class=comment><p>{LONG * 3}</p></article></section></article>",
     "Part " + LONG + "End & out."),
    ("<div class='cookie-banner'><p>We use cookies to make this page better for all of you.</p></div><article><h1>T</h1></article>", "T"),
    ("<nav><ul><li><a href=1>a</a></ul></nav><footer>© x</footer>", ""), ("<script>x</script>", ""),
]


@pytest.mark.parametrize("source, want", PAGES)
def test_main_text_of_varied_pages(model, source, want):
    assert html_extract.main_texts([source], model) == [want.strip()]


def test_held_out_layouts(model):
    rng = np.random.default_rng(99)
    wrong = total = 0
    for _ in range(60):
        source, labels = html_extract._filled(html_extract.composed(rng), rng)
        forest = html_tree.Forest()
        forest.grow(html_tree.read(source))
        want = [labels[int(t[t.index("\ue000") + 1:t.index("\ue001")])] for t in forest.text if t is not None]
        got = html_extract.marginals(forest, model)[np.array(forest.leaf)] > 0.5
        wrong, total = wrong + int((got != np.array(want)).sum()), total + len(want)
    assert total > 500 and wrong / total < 0.04


def test_extract_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long = "<p>" + LONG * 20_000 + "</p>"
    rows = [(1, "u", None, "x", 3), (2, None, "", "x", 3), (None, "u", "<article><p>a b</p></article>", "x", 3),
            (3, "u", "<article><p>a b</p></article>", "x", 3), (3, "u", "<article><p>a b</p></article>", "x", 3),
            (4, "u", f"<article><h1>t</h1>{long}</article>", "x", 3)]
    got = html_extract.extract(saved(spark.createDataFrame(rows, schema)))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=str)
    assert [t[:2] + t[3:] for t in texts] == [(1, "u", 0), (2, None, 0), (3, "u", 3), (3, "u", 3), (4, "u", 1 + len(LONG) * 20_000), (None, "u", 3)]
    assert html_extract.extract(saved(spark.createDataFrame([], schema))).collect() == []


def test_training_pages_label_themselves(spark):
    rows = [(i, "u", f"<nav>n</nav><article><h1>t{i}</h1><aside>x</aside></article>{'<b>y</b>' if i % 2 else ''}") for i in range(9)]
    rows += [(20, "u", "<div>no article</div>"), (21, "u", None)]
    found = html_extract.training_pages(saved(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert len(found) == 2
    page = html_tree.read(found[0])
    labels = html_extract.own_labels(page)
    assert {page.text[i]: labels[i] for i in range(len(labels)) if labels[i] is not None}["x"] is False
    assert html_extract.own_labels(html_tree.read("<article>a</article><article>b</article>")) is None
