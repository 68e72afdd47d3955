import html
import itertools
import math
import re

import pytest

from housemark.llm import html_extraction as extraction
from housemark.llm.dom import Page


@pytest.fixture(scope="module")
def model():
    return extraction.Model(extraction.example_counts())


def blocks(source):
    return [text for _, text, _ in Page(source).pieces]


@pytest.mark.parametrize(
    "source, wanted",
    [
        ("", []),
        ("<p>a<p>b", ["a", "b"]),
        ("<p>a <b>b<br>c\n d", ["a b c d"]),
        ("<p>&eacute;&amp;amp; &lt;b&gt; &#x41;&nbsp;x &unknown;</p>", ["é&amp; <b> A x &unknown;"]),
        ("<p>a<!-- <p>no --> b<!-->c<!DOCTYPE x>", ["a bc"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>x</p>", ["x"]),
        ("<SCRIPT>x</scripts></ScRiPt >y", ["y"]),
        ("<script>never ends <p>x", []),
        ("<p>a</p><p title='>'>b</p><p title=\"it's\">c</p>", ["a", "b", "c"]),
        ("<p title='open>b</p><p>c", ["b", "c"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>a<div>b</div>c</div>d</div></p>e", ["a", "b", "c", "de"]),
        ("text <em>in</em>line</p", ["text inline"]),
        ("a < b and 1<2 <", ["a < b and 1<2 <"]),
        ("<p>cut off &am", ["cut off &am"]),
        ("<p>a<svg><text>no</text></svg>b<button>no</button>c", ["abc"]),
        ("<p>AT&<b>amp;</b>T &lt<!-- -->; &eacute<i>;</i>", ["AT&amp;T <; é;"]),
        ("<p>see <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object>fallback <b>text</b></object></p>",
         ["see x=1 and fallback text"]),
        ("<math><mi>y</mi><annotation>\\y</annotation></math>", ["y"]),
        ("<noscript><p>one</p></noscript><p>a<noscript>b</noscript>c", ["one", "abc"]),
        ("<p>a<map>b</map><dialog><p>c</dialog>d", ["ab", "c", "d"]),
    ],
)
def test_blocks_of_markup(source, wanted):
    assert blocks(source) == wanted


def test_deep_nesting_needs_no_recursion(model):
    source = "<div>" * 5000 + "<p>" + "some words of text " * 20 + "</p>" + "</div>" * 5000
    assert isinstance(model.text(source), str)


def exact_marginals(model, page):
    edges = [model.potentials(x) for x in extraction.seen(page)]
    n = len(page.tags)
    total, content = 0.0, [0.0] * n
    for states in itertools.product((0, 1), repeat=n - 1):
        states = (0, *states)
        weight = math.exp(
            sum(edges[i][2 * states[page.parents[i]] + states[i]] for i in range(1, n))
        )
        total += weight
        for i, s in enumerate(states):
            content[i] += weight * s
    return [c / total for c in content]


@pytest.mark.parametrize(
    "source",
    [
        "<div><p>some words</p><ul><li><a>x</a><li>y</ul></div>",
        "<article><h1>t</h1><p>words words</p><aside><p>x</p></aside></article><footer>f</footer>",
        "<div class=menu>a</div><section><div><p>text of it</p></div></section>",
    ],
)
def test_messages_give_the_marginals_of_all_states(model, source):
    page = Page(source)
    assert model.marginals(page) == pytest.approx(exact_marginals(model, page), abs=1e-9)


OTHER = """<html><head><title>t</title></head><body><header><a href=/>Site</a><h2>Site name</h2></header>
<div id=menu><a href=a>Home</a> <a href=b>News</a></div><div class="wrapper"><div class="cookie-banner">We use
cookies. <button>OK</button></div><main><h1>Title here</h1><p>First paragraph with <a href=x>link</a> and
&eacute;t&eacute; &amp; more text to make it longer.</p><ul><li>item one of the list</li><li>item two</li></ul>
<div class="ad">Buy now</div><p>Second paragraph text is here, also rather long I would say.</p></main>
<aside class=sidebar><h3>Related</h3><p>You may like this and that.</p></aside><form><p>Subscribe to us</p></form>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Great article, I liked it a lot.</p></div></section>
</div><footer>Copyright 2024</footer></body></html>"""
PLAIN = """<body><div id="nav"><ul><li><a>x</a></li><li><a>y</a></li></ul></div><div class="post-body"><h1>A story</h1>
<p>Once upon a time there was a text, and it was long enough.</p>Loose text in a div<p>It went on.</p></div>
<div class="reader-comments"><p>I disagree with the story, it is far too short.</p></div><div class="site-footer">bye</div>"""


@pytest.fixture(scope="module")
def trained(spark):
    return extraction.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "url", "html")


@pytest.mark.parametrize("which", ["model", "trained"])
def test_pages_of_other_makes(which, request):
    """Neither page has an article element; the trained model has seen no other."""
    model = request.getfixturevalue(which)
    assert model.text(OTHER).split("\n") == [
        "Title here",
        "First paragraph with link and été & more text to make it longer.",
        "item one of the list",
        "item two",
        "Second paragraph text is here, also rather long I would say.",
    ]
    assert model.text(PLAIN).split("\n") == [
        "A story",
        "Once upon a time there was a text, and it was long enough.",
        "Loose text in a div",
        "It went on.",
    ]


def article(source):
    """The article element's blocks by plain patterns."""
    inside = source[source.index("<article>") + 9 :].split("</article>")[0]
    inside = re.sub(r"<[^>]*$", "", inside)
    parts = [re.sub("<[^>]*>", " ", x) for x in re.split("</?(?:p|h1)>", inside)]
    texts = [" ".join(html.unescape(x).split()) for x in parts]
    return "\n".join(x for x in texts if x)


def test_held_out_pages(spark):
    """Trained on 50 pages, the model finds the article of all others."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = extraction.with_text(pages, sample=50).collect()
    assert len(rows) == pages.count()
    assert [r.text for r in rows] == [article(r.html) for r in rows]


@pytest.mark.parametrize("start, end", [("<div>", "</div>"), ("<main>", "</main>"), ("<section class=story>", "</section>")])
def test_pages_without_an_article_element(spark, trained, start, end):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for row in pages:
        other = row.html.replace("<article>", start).replace("</article>", end)
        assert trained.text(other) == article(row.html)


def test_labels_leave_out_what_an_article_sets_apart():
    source = "<article><h1>t</h1><p>a</p><div class=comments><p>b</p></div><div id=Share-Box>c</div><form>d</form></article>"
    page = Page(source)
    states = extraction.article_labels(page)
    assert [page.tags[i] for i, s in enumerate(states) if s] == ["article", "h1", "p"]
    assert extraction.article_labels(Page("<article>a</article><article>b</article>")) is None


def test_the_sample_is_of_labelled_pages_and_copies_count_once(spark, monkeypatch):
    """Pages without an article element use up no place in the sample, nor do copies."""
    taken = []
    monkeypatch.setattr(extraction, "mixed", lambda examples, sampled: taken.append(sampled) or examples)
    page = "<nav>n</nav><article><h1>{0}</h1><p>{0}</p></article>"
    rows = [("u", f"<p>no article {i}</p>") for i in range(300)] + [("u", "<!--<article>-->x")]
    rows += [("u", page.format(i)) for i in range(40)] + [("u", page.format(0))] * 200
    pages = spark.createDataFrame(rows, "url string, html string").repartition(4)
    extraction.train(pages, "url", "html", sample=100)
    extraction.train(pages, "url", "html", sample=10)
    # One article element for each page of the sample.
    assert [x[0, 1, 0, "article"] for x in taken] == [40, 10]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "   "), (3, "u", OTHER),
            (4, "u", "<article><p>" + "long text " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr(
        "*", "'own' AS text", "'own' AS `order`", "'own' AS source"
    )
    found = extraction.with_text(pages).collect()
    assert [len(r.text) for r in found][:4] == [0, 0, 0, 0]
    assert found[4].text.startswith("Title here") and len(found[5].text) == 499_999
    assert found[0].source == "own"
    assert extraction.with_text(pages.limit(0)).collect() == []
