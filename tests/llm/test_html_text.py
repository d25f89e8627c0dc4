"""Minimum cuts against all labellings, and pages of other shapes than the given ones."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tillframe.llm import html_text as h

FLAT = np.zeros(h.FEATURES)


def cost(keep, source, sink, edges):
    own = sum(sink[i] if k else source[i] for i, k in enumerate(keep))
    return own + sum(c for i, j, c in edges if keep[i] != keep[j])


@pytest.mark.parametrize("seed", range(60))
def test_cut_is_the_cheapest_labelling(seed):
    rng = random.Random(seed)
    n = rng.randrange(0, 9)
    source = [rng.randrange(0, 12) for _ in range(n)]
    sink = [rng.randrange(0, 12) for _ in range(n)]
    edges = [(i, j, rng.randrange(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]
    got = h.minimum_cut(source, sink, edges)
    best = min(cost(k, source, sink, edges) for k in itertools.product((True, False), repeat=n))
    assert cost(got, source, sink, edges) == best


def test_long_chain():
    n = 3000
    source = [10 if k % 7 else 0 for k in range(n)]
    sink = [0 if k % 7 else 4 for k in range(n)]
    assert all(h.minimum_cut(source, sink, [(k, k + 1, 3) for k in range(n - 1)])[1:-1])


PAGES = {
    "<article><h1>T &amp; U</h1><p>a  b<br>c\n d</p><div class='ad'>buy</div><p>e&nbsp;f &lt;g&gt;</p></article><footer>x</footer>": "T & U\na b c d\ne f <g>",
    "<nav><a>m</a></nav><main><p>one<p>two<ul><li>three<li>four</ul></main><aside>side</aside>": "one\ntwo\nthree\nfour",
    "<div id=content><p>Text <b>bold</b> <a href=x>link</a>.</p></div><div class='cookie-notice'>We use cookies.</div>": "Text bold link.",
    "<article><p>body</p><section class=comments><p>first!</p></section><form><label>mail</label><input></form></article>": "body",
    "<article><p>keep<script>if (a < b) { x('</p>') }</script></p><style>p{}</style><!-- <p>no</p> --><p>more</p></article>": "keep\nmore",
    "<ARTICLE><P CLASS=\"x>y\">upper</P><p hidden>h</p><p style='display: none'>n</p></ARTICLE>": "upper",
    "<article><p>cut off &am": "cut off &am",
    "<article><p>a</p><!-- never closed <p>b</p>": "a",
    "<article><p>1 < 2 and 3 > 2</p></article>": "1 < 2 and 3 > 2",
    "<header><h1>Site</h1></header><article><p>x</p></article>": "x",
    "": "",
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert h.page_text(page, FLAT) == PAGES[page]


ARTICLE = "<article><h1>Title</h1><p>first</p><p>second</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body class='has-sidebar'>{ARTICLE}<nav>menu</nav></body></html>",
        f"<div class='with-sidebar'>{ARTICLE}<div class='sidebar'>menu</div></div>",
        f"<div id='share-page'>{ARTICLE}</div><footer>x</footer>",
        f"<form id=page><div><main>{ARTICLE}</main></div><nav>menu</nav></form>",
        f"<div class='sidebar'>{ARTICLE}</div>",
    ],
)
def test_article_inside_a_boilerplate_name_stays(page):
    assert h.page_text(page, FLAT) == "Title\nfirst\nsecond"


@pytest.mark.parametrize(
    "inner",
    [
        "<section class='comments'><article class='comment'><p>Reader says hi.</p></article></section>",
        "<section class='comments'><article><p>Reader says hi.</p><article><p>And another.</p></article></article></section>",
        "<article class='comment'><p>Reader says hi.</p></article>",
        "<div id='disqus'><div role='article'><div class='content'><p>Reader says hi.</p></div></div></div>",
        "<aside><article><p>A related story.</p></article></aside>",
        "<aside><div class='widget'><article><p>A related story.</p></article></div></aside>",
        "<nav><main>menu</main></nav>",
    ],
)
def test_article_inside_an_article_does_not_save_comments(inner):
    body = "<h1>Title</h1><p>first</p><p>second</p>"
    for page in (f"<article>{body}{inner}</article>", f"<main><article>{body}</article>{inner}</main>", f"<article>{body}</article>{inner}"):
        assert h.page_text(page, FLAT) == "Title\nfirst\nsecond", page


def test_articles_inside_main_stay():
    page = "<main><article><p>one</p></article><section class='story'><article><p>two</p></article></section></main>"
    assert h.page_text(page, FLAT) == "one\ntwo"


@pytest.mark.parametrize("inner", ["<script>x('</p>')</script>", "<style>p{}</style>", "<noscript><p>n</p></noscript>", "<template><div>t</div></template>", "<svg><text>s</text></svg>"])
def test_scripts_inside_a_paragraph_do_not_cut_it(inner):
    assert h.page_text(f"<article><p>Hello {inner}world</p><p>more</p></article>", FLAT) == "Hello world\nmore"


def test_hidden_and_nested_boilerplate_still_go():
    page = "<div hidden><article><p>h</p></article></div><article><p>a</p><nav><ul><li>m</li></ul></nav><div class='cookie-notice'>c</div></article><footer><div class='content'>f</div></footer>"
    assert h.page_text(page, FLAT) == "a"


def test_pages_without_telling_tags_are_judged_by_their_text(spark):
    prose = "It was a long way from the river to the hill, and nobody spoke of it. "
    made = []
    for k in range(40):
        menu = "".join(f"<li><a href=/{j}>Item {j}</a></li>" for j in range(6))
        body = "".join(f"<p>{prose * (1 + (k + j) % 4)}</p>" for j in range(4))
        made.append((k, f"http://x/{k}", f"<nav><ul>{menu}</ul></nav><article>{body}</article><footer>Imprint | Contact</footer>"))
    plain = made[0][2].replace("nav", "div").replace("article", "div").replace("footer", "div")
    df = spark.createDataFrame(made + [(99, "u", plain), (100, None, None), (None, "u", ""), (0, made[0][1], made[0][2])], "page_id long, url string, html string")
    df = df.withColumn("text", df.page_id * 0).withColumn("features", df.page_id)
    got = {r.page_id: r for r in h.extract_pages(df).collect()}
    assert got[99].text == got[0].text == "\n".join([(prose * (1 + j % 4)).strip() for j in range(4)])
    assert got[100].text == got[None].text == "" and got[100].n_chars == 0
    assert h.extract_pages(df).count() == 44 and h.extract_pages(df.where("page_id < 0")).count() == 0


def test_very_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {k}, with words.</p>" for k in range(5000)) + "</article>" + "<b" * 2000
    assert h.page_text(page, FLAT).count("\n") == 4999


def test_deep_nesting():
    page = "<div>" * 5000 + "<article><p>x</p></article>" + "</div>" * 5000 + "<nav>m</nav>"
    assert h.page_text(page, FLAT) == "x"
