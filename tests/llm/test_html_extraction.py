import html
import itertools
import re
import time

import pytest

from tessera.llm import html_extraction as hx


@pytest.fixture(scope="module")
def model():
    return hx.train(hx.labelled_pages())


def test_marginals_match_enumeration(model):
    for page in ("<body><div><p>some text here.</p></div><nav><li><a>x</a></li></nav></body>", "<p>a<p>b", "x"):
        nodes = hx.parse(page)
        local = [model.local(n, nodes[n.parent]) if k else model.root for k, n in enumerate(nodes)]
        total, content = 0.0, [0.0] * len(nodes)
        for states in itertools.product(range(3), repeat=len(nodes)):
            p = 1.0
            for k, s in enumerate(states):
                p *= local[k][s] * (model.between(nodes[k])[states[nodes[k].parent]][s] if k else 1)
            total += p
            for k, s in enumerate(states):
                content[k] += p * (s == hx.CONTENT)
        assert model.marginals(nodes) == pytest.approx([c / total for c in content])


def test_held_out_labelled_pages(model):
    wrong = n = 0
    for page in hx.labelled_pages(150, seed=99):
        nodes = hx.parse(page)
        for node, p in zip(nodes, model.marginals(nodes), strict=True):
            if node.tag == "#text":
                n += 1
                wrong += (p > 0.5) != bool(node.label)
    assert n > 1500 and wrong / n < 0.02


def expected(page):
    """The one layout of the test tables: the article's heading and paragraphs."""
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", body)
    texts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " " if "<br>" in p else "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    pages = {r.page_id: r for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    out = hx.op1_html(spark, path).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


LONG = "This is a sentence of the article that says something of interest to all who read it."


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<html><body><header class='site-header'><h1>Brand</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav><div id='cookie-notice'>We use cookies. <button>OK</button></div><main><article><h1>Title</h1><p>{LONG}</p><p>A &amp; B&nbsp;\n\n c &lt;d&gt; {LONG}</p></article><section id='comments'><h3>Comments</h3><p>{LONG}</p></section></main><aside><p>{LONG}</p></aside><form><label>Name</label><p>Join us</p></form><footer>&copy; x</footer></body></html>", f"Title\n{LONG}\nA & B c <d> {LONG}"),
        (f"<div class='entry-content'><p>{LONG}<p>{LONG} <a href='/a'>more</a> and so on.<script>if (a < b) document.write('<p>no</p>')</script></div><div class=sidebar><p>{LONG}</p></div>", f"{LONG}\n{LONG} more and so on."),
        ("", ""), (None, ""), ("<", None), ("<p", None), ("</p></div>", ""), ("<!-- x", ""), ("<script>x", ""), ("   \n", ""),
    ],
)
def test_layouts(model, page, text):
    got = model.text(page)
    assert text is None or got == text


def test_odd_rows(spark, model):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"), (2, "u", "<div>" * 3000 + LONG)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = hx.extract(df, model).collect()
    assert sorted(r.n_chars for r in out)[:2] == [0, 0] and max(r.n_chars for r in out) == 3000 * len(LONG) + 2999
    assert hx.extract(df.limit(0), model).count() == 0


def runs(page):
    return [n.text for n in hx.parse(page) if n.tag == "#text"]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a</p><svg-icon></svg-icon><p>rest of article</p>", ["a", "rest of article"]),
        ("<p>a</p><video-player src=x>b</video-player><object-card/><title-bar>c</title-bar><p>rest</p>", ["a", "bc", "rest"]),
        ("<p>a<svg/></p><p>rest</p>", ["a", "rest"]),
        ("<p>a<svg class='x' /></p><p>rest</p><svg><path/></svg><p>end</p>", ["a", "rest", "end"]),
        ("<p>a<svg><title/><svg>x</svg>y</svg></p><p>rest</p>", ["a", "rest"]),
        ("<p>a<math/> b</p><p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then</p>", ["a b", "if x=1 then"]),
        ("<p>a</p><video src=x><p>rest</p><video>no</video><p>end</p>", ["a", "rest", "end"]),
        ("<p>a</p><template>x<template>y</template>z</template><select><option>o</select><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><canvas><p>rest</p>", ["a", "rest"]),
        ("<p>a</p><textarea>x<p>y</p>", ["a"]),
        ("<script>'<svg>'</script><p>a</p><script src=x>if (a<b) '</svg>'</script><p>rest</p><style>p{}", ["a", "rest"]),
    ],
)
def test_markup_that_ends_no_page(page, want):
    assert runs(page) == want


def test_many_unclosed_elements_take_linear_time():
    assert len("".join(runs("<video>a" * 50_000))) == 50_000


def test_article_beside_icons(model):
    page = f"<article><h1>Title</h1><p>{LONG}</p><svg-icon name=x></svg-icon><p>{LONG}<svg/></p><video-player></video-player><p>{LONG}</p></article>"
    assert model.text(page) == f"Title\n{LONG}\n{LONG}\n{LONG}"


NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/n>News</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Company. All rights reserved.</p></footer>"
ONE = "The council agreed on Tuesday to repair the old bridge before the winter."
TWO = "Work will start in May and should take about four months, the mayor said."
ARTICLE = f"The bridge\n{ONE}\n{TWO}"
PARTS = ("<h1>The bridge</h1>", f"<p>{ONE}</p>", f"<p>{TWO}</p>")


@pytest.mark.parametrize(
    "main",
    [
        f"<article>{''.join(PARTS)}</article>",
        f"<article>{''.join(PARTS)}<div class='share'>Share this: <a href=x>Mail</a> <a href=y>Post</a></div></article>",
        f"<article>{''.join(PARTS)}<div class='tags'><a href=x>bridge</a> <a href=y>council</a></div></article>",
        f"<article>{PARTS[0]}{PARTS[1]}<div class='newsletter-form'><form><label>Mail</label><button>Join</button></form></div>{PARTS[2]}</article>",
        f"<article>{PARTS[0]}<div><div>{PARTS[1]}</div><div>{PARTS[2]}</div></div></article>",
        f"<div class='content'><div>{PARTS[0]}</div><div><div>{PARTS[1]}</div><div>{PARTS[2]}</div></div></div>",
        f"<div id=main class='with-sidebar'>{''.join(PARTS)}</div>",
        f"<div class='page hidden-xs'>{''.join(PARTS)}</div>",
        f"<main><section>{PARTS[0]}</section><section>{PARTS[1]}</section><section>{PARTS[2]}</section></main>",
        f"<main><div class='wrap a1'><div class='b2'><div class='c3'>{''.join(PARTS)}</div></div></div></main>",
        f"<article class='post no-comments'>{''.join(PARTS)}</article><section id='comments'><h3>2 comments</h3><div><b>Ann</b><p>I think that this bridge should have been closed.</p></div></section>",
        f"<div class='layout'><div class='entry-content'>{''.join(PARTS)}</div><aside><h3>Most read</h3><ul><li><a href=1>A new school opens its doors</a></li><li><a href=2>Rain expected</a></li></ul></aside></div>",
        f"<article>{''.join(PARTS)}<aside class='ad'><p>Buy the best shoes now, only today and only here.</p></aside></article>",
    ],
)
def test_short_articles_stay_whole(model, main):
    for page in (f"<html><body>{NAV}{main}{FOOT}</body></html>", f"<body><div id='page'><header class='site-header'><a href=/>The Gazette</a></header>{NAV}<div class='container'>{main}</div>{FOOT}</div></body>"):
        assert model.text(page) == ARTICLE


def test_all_names_are_evidence():
    assert hx._hint("id=main class='with-sidebar'")[0] == ("main",) and hx._hint("class='page hidden-xs'")[0] == ("main",)
    assert hx._hint("class='content sidebar'")[0] == ("main", "side") and hx._hint("class=x")[0] == ("none",) and hx._hint("class=main hidden")[0] == ("unseen",)


S = "The river rose for three days before anyone wrote it down. "


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div class=content>{S}<br><br>{S * 2}<br><br>{S}</div>", (S * 4).strip()),
        (f"<body><div class=content>{S}<br><br>{S * 2}</div>", (S * 3).strip()),
        (S * 3, (S * 3).strip()),
        ("Just a few words", "Just a few words"),
        (
            f"<html><body><nav><a href=/>Home</a></nav><article><header><h1>A Big Title</h1><p class=byline>By Ann Other</p></header><figure><img src=x>"
            f"<figcaption>The river at dawn</figcaption></figure><p>{S * 3}</p><p>{S}</p></article><footer>&copy; 2024 Us</footer></body></html>",
            f"A Big Title\nBy Ann Other\nThe river at dawn\n{(S * 3).strip()}\n{S.strip()}",
        ),
        (f"<body><div class=login-story>Log in to read more.</div><article><h1>Title here</h1><p>{S * 2}</p></article>", f"Title here\n{(S * 2).strip()}"),
        (f"<body><table><tr><td class=menu><a href=/a>Home</a><br><a href=/b>News</a></td><td class=content><h1>T it</h1><p>{S * 3}</p></td></tr></table>", f"T it\n{(S * 3).strip()}"),
    ],
)
def test_layouts_with_little_markup(model, page, want):
    assert model.text(page) == want


@pytest.mark.parametrize("piece", ["<script x", '<a b="c" ', '<p title="', "<p \"'>'", "<!--x", "</p ", "<svg ", "<svg><title/>"])
def test_unfinished_tags_take_linear_time(piece):
    for end in ("", "'>"):
        began = time.perf_counter()
        hx.parse(piece * 30_000 + end)
        assert time.perf_counter() - began < 10


def test_mismatched_quotes_end_at_the_tag(model):
    assert [n.text for n in hx.parse(f'<p title="x>{S}</p><p>more') if n.text] == [S.strip(), "more"]
