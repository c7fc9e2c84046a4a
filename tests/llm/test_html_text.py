"""Page extraction: parsing, exact inference, and pages whose main text is known."""

import html
import itertools
import math
import random
import re

import pytest

from lectern.llm.html_text import Model, extract, fit, hides, marginals, parse, train

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header class="site"><h1>Site</h1></header>
<div class="cookie-notice"><p>We use cookies, and more cookies. Please accept our long cookie text here.</p></div>
<div class="post-content"><h1>Title &amp; more</h1><p>First   paragraph,<br>with <b>bold</b> words &#233;, that is long enough.<p>Second one <a href=y>with a link</a>, unclosed.
<div class="ad"><p>Buy this now, it is cheap, and good for you, really.</p></div><ul><li>Item one, of the article.<li>Item two</ul></div>
<section class="comments"><p>I liked this article very much, thanks, it was quite long.</p></section>
<aside><p>Related: other things, and many words in here to be read.</p></aside><form><p>Fill in this form, please, now.</p></form>
<footer>&copy; 2020</footer></body></html>"""


def reference_text(page):
    """The generator's pages: headings and paragraphs of the article."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


def test_messages_equal_enumeration():
    rng = random.Random(2)
    for n in range(1, 8):
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        evidence = [rng.uniform(-3, 3) for _ in range(n)]
        bond = [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
        total, good = 0.0, [0.0] * n
        for s in itertools.product((0, 1), repeat=n):
            w = math.exp(sum(e * x for e, x in zip(evidence, s)) + sum(bond[s[parent[i]]][s[i]] for i in range(1, n)))
            total += w
            good = [g + w * x for g, x in zip(good, s)]
        got, _ = marginals(parent, evidence, bond)
        assert all(abs(a - b / total) < 1e-9 for a, b in zip(got, good))


def test_unseen_layout_and_held_out_pages(spark, table):
    model = train(table, number=60)
    assert model.text(PAGE) == "Title & more\n\nFirst paragraph, with bold words é, that is long enough.\n\nSecond one with a link, unclosed.\n\nItem one, of the article.\n\nItem two"
    got = {r.page_id: r.text for r in extract(table, model).collect()}
    want = {r.page_id: reference_text(r.html) for r in table.collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_odd_input(spark):
    model = fit([])
    assert isinstance(model, Model) and model.text("") == ""
    for source in ("<", "<p", "a < b > c", "<a href='", "<!--", "<script>x", "</p></p></div>", "<div>" * 3000 + "deep", "<b>" * 3000, "&amp;&#0;&bogus;"):
        model.text(source)
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (1, "u", "<article><p>Some text, of a page.</p></article>", "x"), (1, "u", None, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df, train(df)).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [0, 0, 0, 21]
    assert extract(df.limit(0), model).count() == 0


def test_runs_of_text():
    page = parse("<p>one<br>two <i>three</i><div>four<!-- no --></div>five")
    assert [t for t in page.text if t] == ["one two three", "four", "five"]


def test_head_without_end_tag():
    texts = lambda source: [t for t in parse(source).text if t]
    top = "<html><head><meta charset=utf-8><title>x</title><style>p {}</style><noscript><p>no</p></noscript>\n"
    assert texts(top + "<body><article><p>Hi <b>you</b></p></article></body></html>") == ["Hi you"]
    assert texts(top + "<p>Hi</p><p>there") == texts(top + "</head><body><p>Hi</p><p>there") == texts(top + "<head><body><p>Hi</p><p>there") == ["Hi", "there"]
    assert texts(top + "Hi <!-- no --><p>there") == ["Hi", "there"]
    assert fit([]).text(PAGE.replace("</head>", "")) == fit([]).text(PAGE)


def test_only_hiding_attributes_hide():
    for shown in (
        ' title="the hidden truth" href=x', ' data-title="A hidden cost"', ' class="post hidden lg:block"', " class=hidden", " data-hidden=1", ' aria-hidden="false"', ' title="aria-hidden=true"',
        ' data-style="display:none"', ' title="use display:none here"', ' style="display:none;display:block"', ' style="--x-display:none"', " title='a \"hidden\" b'", " title=hidden", ' alt = "x hidden',
    ):
        assert not hides(shown), shown
    for hidden in (" hidden", ' class="a"hidden', " HIDDEN=''", " hidden/", ' hidden="until-found"', " aria-hidden=true", ' ARIA-Hidden = "True"', ' style="color:red; Display : NONE !important;display:block"', " style=display:none", " style='/* a */display:none'"):
        assert hides(hidden), hidden
    page = parse('<article class="post hidden lg:block"><p>one <a title="the hidden truth" href=x>two</a><section data-title="A hidden cost"><p>three</section><p hidden>four</article>')
    assert [t for t in page.text if t] == ["one two", "three"]


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>Read the <a>guide <svg><title>x</title><path d='M1'/></svg></a> before you start.</p>", ["Read the guide before you start."]),
    ("<p>one <custom-icon></custom-icon>two <button>Buy</button>three</p>", ["one two three"]),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> hold.</p>", ["Let x=2 hold."]),
    ("<p>a <select><option>1<option>2</select>b <video src=v>no video</video>c <canvas>no</canvas>d</p>", ["a b c d"]),
    ("<p>at <output>3</output> of <meter>4</meter> <picture><source><img></picture>done</p>", ["at 3 of 4 done"]),
    ("<div>one <div hidden>x</div>two<noscript>y</noscript> three<template><p>z</p></template></div>", ["one two three"]),
    ("<div>one <object><p>x</p></object>two</div><div>three</div>", ["one two", "three"]),
    ("<ul><li>a<li>b <x-y>c</x-y></ul><table><caption>d<tr><td>e<td>f</table>", ["a", "b c", "d", "e", "f"]),
    ("<my-card><p>one</p></my-card><p>two</p></my-card>three", ["one", "two", "three"]),
])
def test_what_ends_a_block(page, blocks):
    assert [t for t in parse(page).text if t] == blocks
