import time
from itertools import product

import pytest

from parley.llm.html_extract import TreeModel, features, main_texts, marked_labels, parse, trained_model, kind
from parley.llm.html_pages import training_pages

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>My Site</h1><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav></header>
<div class="cookie-banner"><p>We use cookies, please accept them all.</p><button>OK</button></div>
<div class="wrapper"><article><h1>Big  &amp; bold</h1><p>First <b>para</b>graph&nbsp;with <a href="/x">a link</a>.<p>Second
 one<br>continued &lt;here&gt;.</p><ul><li>one item.</li><li>two items.</li></ul><div class="ad">Buy this thing now.</div>
<!-- <p>hidden</p> --><blockquote>Quoted words.</blockquote></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside></div>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this very much, thank you.</p></div></section>
<form class="newsletter"><label>Mail</label><input><button>Go</button></form>
<footer>&copy; 2020 My Site</footer></body></html>"""
MAIN = ("Big & bold\nFirst paragraph with a link.\nSecond one continued <here>.\none item.\ntwo items.\nQuoted words.")


@pytest.fixture(scope="module")
def model():
    return trained_model()


def test_article_only(model):
    assert model.main_text(ARTICLE) == MAIN


def test_marginals_are_exact(model):
    page = parse("<body><nav class=menu><a>x y</a></nav><div id=content><p>Some words here.</p>tail</div><footer>© z</footer></body>")
    n = len(page.parent)
    import math
    shown = [math.exp(sum(model.evidence(seen))) for seen in features(page)]
    weight = {}
    for y in product((0, 1), repeat=n):
        w = model.root if y[0] else 1 - model.root
        for i in range(n):
            w *= shown[i] if y[i] else 1.0
            if i:
                w *= model.edge[kind(page.tag[i])][y[page.parent[i]]][y[i]]
        weight[y] = w
    total = sum(weight.values())
    for i, p in enumerate(model.marginals(page)):
        assert abs(p - sum(w for y, w in weight.items() if y[i]) / total) < 1e-9


def test_held_out_pages(model):
    right = every = 0
    for source in training_pages(150, 77):
        page = parse(source)
        for y, p, tag in zip(marked_labels(page), model.marginals(page), page.tag):
            if not tag:
                every += 1
                right += (p > 0.5) == y
    assert right >= 0.96 * every


def test_training_learns_from_marks():
    pages = ['<body><div class="good" data-y="1">Words here.</div><div class="evil" data-y="0">Words here.</div></body>'] * 20
    assert TreeModel.trained(pages).main_text('<div class="evil">No way.</div><div class="good">Yes, so.</div>') == "Yes, so."


@pytest.mark.parametrize("source", ["", "plain text", "<", "<p", "<p>a<", "a < b", "<a href='x>y", '<p title="a>b">c', "</p></div>", "<b><i></b></i>",
                                    "<!-- open", "<script>x", "<div>" * 3000 + "x", "<ul><li>a<li>b</ul>", "<table><tr><td>a<td>b<tr><td>c</table>",
                                    "&notanentity; &#x41; &#0;", "<p>\x00</p>", "<![CDATA[x]]>", "<textarea><p>x</p></textarea>y"])
def test_odd_pages_do_not_crash(model, source):
    page = parse(source)
    assert len(model.marginals(page)) == len(page.parent)
    model.main_text(source)


def test_blocks_in_page_order():
    page = parse("<div>a <b>b</b>c<p>d<br>e<p>f</div>g<ul><li>h<li>i</ul><textarea>no</textarea><a>&lt;p&gt;</a>")
    assert [t for t in page.text if t] == ["a bc", "d e", "f", "g", "h", "i", "<p>"]


@pytest.mark.parametrize("old, new", [
    ("</head>", ""), ("</head><body>", ""), ("</head><body>", "Skip <body>"), ("<article>", '<svg class="i" viewBox="0 0 1 1"/><article>'),
    ("<article>", "<math/><article>"), ("<article>", '<svg><title/><style/><path d="M0"/></svg><article>')])
def test_open_head_and_self_closed_elements(model, old, new):
    page = ARTICLE.replace("\n", " ").replace("</head> <body>", "</head><body>")
    assert old in page
    assert MAIN in model.main_text(page.replace(old, new, 1))


def test_head_without_end_tag():
    page = parse("<html><head><title>x</title><meta a><style>y{}</style><p>one</p><svg/>two<math />three<svg><p>no</p></svg><p>four")
    assert [t for t in page.text if t] == ["one", "twothree", "four"]


def test_query_rows(spark, model):
    rows = [(1, "u", ARTICLE), (2, None, None), (3, "v", ""), (3, "v", ""), (None, "w", "<article><p>" + "Long words. " * 20000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "7 as n_chars")
    got = sorted(map(tuple, main_texts(df).collect()), key=repr)
    want = [(1, "u", MAIN, len(MAIN)), (2, None, "", 0), (3, "v", "", 0), (3, "v", ""  , 0)]
    want.append((None, "w", ("Long words. " * 20000).strip(), 12 * 20000 - 1))
    assert got == sorted(want, key=repr)
    assert main_texts(df.where("false")).count() == 0


HOSTILE = {"stray end tags": "<b>" * 120_000 + "</i>" * 160_000, "unclosed quotes": '<a href="x>' * 90_001, "cut-off tags": "<a " * 340_000,
           "open brackets": "<" * 1_000_000, "deep nesting": "<div>" * 200_000, "open paragraphs": "<b>" * 100_000 + "<p>" * 200_000,
           "list items": "<b>" * 100_000 + "<li>" * 100_000, "rows": "<table>" + "<b>" * 100_000 + "<tr>" * 100_000,
           "quotes in quotes": "<x '\">\"' " * 90_000, "headings": "<b>" * 100_000 + "</h1>" * 100_000, "odd quotes": "<a \"'>" * 150_001,
           "foreign": "<svg>" + "<title/>" * 100_000, "comments": "<!-" * 300_000}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_time_in_proportion(kind):
    began = time.process_time()
    parse(HOSTILE[kind])
    assert time.process_time() - began < 6  # of about a megabyte; each takes under 2 s on an idle machine


def test_tags_with_stray_quotes():
    def leaves(source):
        page = parse(source)
        return [t for t in page.text if t]
    assert leaves('<p>one <a href="x>two</a> three</p><p>four') == ["one two three", "four"]
    assert leaves('<p>one</p><p title="a>b">two</p>') == ["one", "two"]
    assert leaves("<p>one <i x='>two <b>three") == ["one two three"]
    assert leaves("a < b <<p>c") == ["a < b <", "c"]
    assert leaves("<p>x</p class=\"><p>y</p>") == ["x", "y"]
