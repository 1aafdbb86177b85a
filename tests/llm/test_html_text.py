import itertools
import random
import time

import numpy as np
import pytest

from heathgrid.llm import html_text as H
from heathgrid.llm import registry

PAGES = "page_id long, url string, html string"
PROSE = ["The river rose in spring, and the boats were drawn up on the shore.", "Nobody had seen such a flood, said the keeper; the mill stood in it to the sills.", "Yes.", "When the water fell, the meadows were grey, but the orchard bloomed all the same."]


def text(page, weights=H.PRIOR):
    return H.main_text(page, list(weights))


@pytest.mark.parametrize("seed", range(60))
def test_the_cut_is_of_least_cost(seed):
    r = random.Random(seed)
    n = r.randint(1, 9)
    own = [r.randint(-6, 6) for _ in range(n)]
    edges = {(a, b): r.randint(0, 5) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5}

    def cost(side):
        return sum(max(0, own[k]) if not side[k] else max(0, -own[k]) for k in range(n)) + sum(c for (a, b), c in edges.items() if side[a] != side[b])

    least = min(cost(s) for s in itertools.product((False, True), repeat=n))
    got = H.minimum_cut(own, edges)
    assert cost(got) == least
    fewest = min(sum(s) for s in itertools.product((False, True), repeat=n) if cost(s) == least)
    assert sum(got) == fewest


def test_a_long_undecided_chain():
    r = random.Random(1)
    n = 4000
    own = [r.choice((-2, 2)) for _ in range(n)]
    edges = {(k, k + 1): 3 for k in range(n - 1)}
    got = H.minimum_cut(own, edges)
    # by dynamic programming along the chain
    cost = [0, 0]
    for k in range(n):
        cost = [min(cost[s], cost[1 - s] + (3 if k else 0)) + (max(0, own[k]) if not s else max(0, -own[k])) for s in (0, 1)]
    mine = sum(max(0, own[k]) if not got[k] else max(0, -own[k]) for k in range(n)) + 3 * sum(got[k] != got[k + 1] for k in range(n - 1))
    assert mine == min(cost)


SIDES = [
    "<nav><ul><li><a href=/a>Home</a><li><a href=/b>News and reports of the week, at length.</a></ul></nav>",
    '<div class="main-menu"><a href=/>Start</a> <a href=/x>Shop</a></div>',
    '<header><a href=/>The Daily Heath</a><p>All the news that there is, every day, for you.</p></header>',
    '<div id="sidebar"><h3>Popular</h3><p>Ten things that you never knew about geese, told by geese.</p></div>',
    '<aside>Did you know? Geese can fly, and they do so often.</aside>',
    '<div class="cookie-notice">We use cookies, as everyone does. <button>Accept</button></div>',
    '<div class="ad">Buy the new boat, it floats. It is cheap.</div>',
    '<form action=/s><label>Your name</label><input name=q><textarea>write here</textarea><select><option>One<option>Two</select><button>Send</button></form>',
    "<script>var a = '<p>no</p>';</script><style>p { margin: 0 }</style><noscript>Please enable scripts.</noscript>",
    '<section id="comments"><h2>Comments</h2><article class="comment"><p>I was there, and it was not like that at all. The mill stood dry.</p></article></section>',
    '<ol class="commentlist"><li><p>What a flood it was, my friends, and what a spring came after it.</p></ol>',
    "<footer>&copy; 2024 The Daily Heath. All rights reserved.</footer>",
    '<div hidden>Not to be seen by anyone.</div><p style="display: none">Nor this one.</p>',
    '<div role="complementary"><p>More of the same, every day, from the same house.</p></div>',
]


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ("<div>", "</div>")])
@pytest.mark.parametrize("shuffle", range(5))
def test_side_parts_go_and_the_article_stays(wrap, shuffle):
    r = random.Random(shuffle)
    sides = r.sample(SIDES, len(SIDES))
    k = r.randint(2, len(sides))
    page = "<!doctype html><html><head><title>Flood</title></head><body>" + "".join(sides[:k]) + wrap[0] + "<h1>The flood &amp; the mill</h1>" + "".join(f"<p>{x}</p>" for x in PROSE) + wrap[1] + "".join(sides[k:]) + "</body></html>"
    assert text(page).split("\n") == ["The flood & the mill", *PROSE]


def test_side_parts_inside_the_article():
    r = random.Random(3)
    body = [f"<p>{x}" for x in PROSE] + r.sample(SIDES, len(SIDES))
    body = ["<header><h1>The flood</h1></header>", *body[:2], SIDES[6], *body[2:]]
    assert text("<body><article>" + "".join(body) + "</article>").split("\n")[:3] == ["The flood", *PROSE[:2]]
    got = set(text("<body><article>" + "".join(body) + "</article>").split("\n"))
    assert got == {"The flood", *PROSE} | ({"The Daily Heath", "All the news that there is, every day, for you."} & got)


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>a  b\n\tc<br>d&nbsp;e</p></article>", "a b c d e"),
    ("<article>x<b>y</b>z<p>1 &lt;b&gt; 2 &amp &am &#228;&#x41;</article>", "xyz\n1 <b> 2 & &am äA"),
    ("<article><p>one<p>two<div>three</div>four<hr>five</p></article>", "one\ntwo\nthree\nfour\nfive"),
    ("<article><p><b>x<br><p>y</p><p>z</b></article>", "x\ny\nz"),
    ("<ARTICLE><P CLASS='a>b' data-x=\"<p>q</p>\">1 < 2 and 3 > 2</P></ARTICLE>", "1 < 2 and 3 > 2"),
    ("<article><!-- <p>no</p> --><!--> kept<p>a<!doctype x>b<?php c ?>d</article>", "kept\nabd"),
    ("<article><p>a<span class=ad>buy <span>now</span> or never</span>b</article>", "a\nb"),
    ("<article><p>ends in a tag <a href=\"x", "ends in a tag"),
    ("<article><p>a<script>never closed <p>b", "a"),
    ("<article><p>a<!-- never closed <p>b", "a"),
    ("<article><ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d</div><td>e</table></article>", "a\nb\nc\nd\ne"),
    ("<article class=commentary><p>A talk.</article>", "A talk."),
    ("<div class=has-sidebar><article><p>A talk.</article></div>", "A talk."),
    ("", ""), ("<p></p>", ""), ("<nav>a</nav>", ""), ("<", ""), ("</", ""), ("<a", ""),
])
def test_markup(page, want):
    assert text(page) == want


def test_pages_without_names():
    """Nothing but texts, links and order tells these blocks apart."""
    page = "<body><div><a href=a>Home</a> <a href=b>News</a></div><div><h2>The flood of the year</h2>" + "".join(f"<p>{x}" for x in PROSE) + "</div><div>Copyright © 2024 Heath | <a href=c>Imprint</a></div>"
    assert text(page).split("\n") == ["The flood of the year", *PROSE]


def test_beside_what_is_named_like_an_article():
    page = "<body><div>Get the weekly letter from us</div><h1>The flood of the year</h1><div id=post-body>" + "".join(f"<p>{x}" for x in PROSE) + "</div><div>More on floods</div>"
    assert text(page).split("\n") == ["The flood of the year", *PROSE]


def test_hostile_pages_take_time_in_proportion():
    for piece in ("<div>", "<a \"", "<!--", "<p", "<li><b>", "</div>", "&am", "<span class=ad>", "<table><tr><td>", "<script>", "<p>x</p>"):
        page = piece * (400_000 // len(piece))
        began = time.time()
        text(page)
        assert time.time() - began < 20, piece


def test_learning_is_drawn_to_the_prior():
    assert (H.train(np.zeros((0, 9)), np.zeros(0)) == np.array(H.PRIOR)).all()
    r = np.random.default_rng(0)
    x = np.hstack([np.ones((4000, 1)), r.normal(size=(4000, 8))])
    y = (x[:, 2] < 0).astype(float)
    w = H.train(x, y)
    assert ((x @ w > 0) == y).mean() > 0.95 and w[2] < -1
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)
    gradient = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - y)) + H.DRAWN * (w - np.array(H.PRIOR))
    assert np.abs(gradient).max() < 1e-3  # nothing is cheaper: the loss is convex


def test_table(spark):
    long = "<article>" + "".join(f"<p>{PROSE[k % 4]} {k}</p>" for k in range(50_000)) + "</article>"
    rows = [(1, "u", "<article><p>One.</article>", 5, "t"), (1, "u", "<article><p>One.</article>", 5, "t"), (2, None, None, 5, "t"), (None, "v", "", 5, "t"), (3, "w", long, 5, "t")]
    pages = spark.createDataFrame(rows, PAGES + ", n_chars int, text string")
    got = H.extract(pages, H.fit(pages))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = {3: "\n".join(f"{PROSE[k % 4]} {k}" for k in range(50_000))}
    assert sorted(map(str, got.where("page_id is null or page_id < 3").collect())) == sorted(["Row(page_id=1, url='u', text='One.', n_chars=4)"] * 2 + ["Row(page_id=2, url=None, text='', n_chars=0)", "Row(page_id=None, url='v', text='', n_chars=0)"])
    row = got.where("page_id = 3").collect()[0]
    assert row.text == want[3] and row.n_chars == len(want[3])
    empty = pages.where("false")
    assert H.extract(empty, H.fit(empty)).count() == 0


def test_query(spark):
    """All pages of a table against what stands in their articles' paragraphs."""
    import html
    import re

    got = {r.page_id: r.text for r in registry.op12_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    assert len(got) == len(pages) > 200
    for p in pages:
        inside = re.search("<article>(.*)</article>", p.html, re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?p>|</?h1>", inside))
        assert got[p.page_id] == "\n".join(x for x in blocks if x)
