"""Main text: held-out pages of the tables, hand-written pages of other layouts, odd markup."""

import html
import itertools
import re

import numpy as np
import pytest

pytest.importorskip("heronlake.llm")
from heronlake.llm import htmlcrf  # noqa: E402

LONG = "The committee met on Tuesday to discuss the new water plan, which had been delayed for several months. Members raised questions about cost, and the chair promised a written answer before the next session."
MORE = "Construction is expected to begin in the spring. Residents along the northern canal will see traffic diverted for roughly six weeks, according to the city engineer."
HAND = {
    "semantic": (f"<html><body class='has-sidebar'><header><h1>Daily News</h1><p>Your trusted source</p></header><nav><a href=/>Home</a> <a href=/w>World</a></nav><main><article><h1>Water plan</h1><p>{LONG}</p><p>Short.</p><ul><li>one point</li><li>two points</li></ul></article><section class='comments'><h2>Comments</h2><p>I think this is a very good plan and the city should do more of it, really.</p></section></main><aside><h3>Related</h3><ul><li><a href=x>Older story</a></li></ul></aside><footer><p>&copy; 2024 Daily News. All rights reserved.</p></footer></body></html>", ["Water plan", LONG, "Short.", "one point", "two points"]),
    "named": (f"<div id='cookie-banner'>We use cookies to improve your experience. <button>Accept</button></div><div class='header'><div>My blog</div></div><div class=menu><ul><li><a href=a>About</a><li><a href=b>Contact</a></ul></div><div class='post-content'><h2>Water &amp; plan</h2><p>{LONG}<p>{MORE}<blockquote>A quote from the chair.</blockquote></div><div id=comments><div class=comment><p>Great post, thanks for sharing it with all of us!</p></div></div><div class=footer>Copyright 2023 My blog</div>", ["Water & plan", LONG, MORE, "A quote from the chair."]),
    "unmarked": (f"<body><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Sport</a></li></ul><div><h1>Water plan</h1><p>{LONG}</p><p>{MORE}</p></div><div><p>© 2022 Example Inc.</p></div></body>", ["Water plan", LONG, MORE]),
    "nested": (f"<body><div class='container'><div class='sidebar'><form action=s><label>Search</label><input name=q></form><p>Subscribe to our newsletter for weekly updates.</p></div><div id='content'><h1>Water plan</h1><p>{LONG}</p><div class='ad'>Buy one, get one free! Limited offer.</div><p>{MORE}<br>Second line.</p><div class='share'>Share this on <a href=f>social</a></div></div></div></body>", ["Water plan", LONG, MORE + " Second line."]),
    "comments inside": (f"<body><nav>Menu</nav><article><header><h1>Water plan</h1></header><p>{LONG}</p><p>{MORE}</p><section class=comments><p>First commenter: I do not agree with this at all, it is a waste of money and time.</p><p>Second one: me too</p></section></article><div class='newsletter'><p>Sign up for our newsletter</p></div></body>", ["Water plan", LONG, MORE]),
    "roles": (f"<body><div role=navigation><a href=/>index</a></div><div role=main><p>{LONG}</p><table><tr><td>cell one</td><td>cell two</td></tr></table><p>{MORE}</p></div><div class='related-posts'><p>You may also like our long story about the harbour and its many boats.</p></div></body>", [LONG, "cell one", "cell two", MORE]),
}
ODD = [None, "", "   ", "just words", "<p>a", "</p></div>", "<script>var t='<p>x</p>'", "<!-- never ends <p>x</p>", "<article><p>" + "very long " * 200_000 + "</p></article>", "<p>1 < 2 &amp;&lt; 3 &bogus; &#x41;</p>", "<div>" * 3000 + "deep", "<head><title>t</title><p>late</p>"]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def field(pages):
    return htmlcrf.fitted(pages.where("page_id % 2 = 0"))


def article(page):
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
    parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(p for p in parts if p)


def test_held_out_pages(pages, field):
    got = htmlcrf.extracted(pages, field).collect()
    source = {r.page_id: r for r in pages.collect()}
    assert len(got) == len(source)
    for r in got:
        assert r.text == article(source[r.page_id].html) and r.url == source[r.page_id].url and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", HAND)
def test_other_layouts(field, name):
    page, want = HAND[name]
    found = htmlcrf.blocks(page)
    assert [b.text for b, y in zip(found, field.decode(htmlcrf.features(found))) if y] == want


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        field = htmlcrf.Field(rng.normal(size=(htmlcrf.SPACE, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        feats = [rng.integers(0, htmlcrf.SPACE, 5) for _ in range(n)]
        s = field.scores(feats)

        def total(y):
            return field.begin[y[0]] + sum(s[i][c] for i, c in enumerate(y)) + sum(field.moves[a][b] for a, b in zip(y, y[1:]))

        assert tuple(field.decode(feats)) == max(itertools.product((0, 1), repeat=n), key=total)


def test_training_follows_the_chain():
    """Labels that only neighbours tell apart are learnt."""
    a, b, c = (np.array([i]) for i in (1, 2, 3))
    pages = [([a, c, c], [1, 1, 1]), ([b, c, c], [0, 0, 0])] * 5
    field = htmlcrf.train(pages)
    assert field.decode([a, c, c]).tolist() == [1, 1, 1] and field.decode([b, c, c]).tolist() == [0, 0, 0]
    assert htmlcrf.train([]).decode([a]).tolist() == [1]


def test_odd_pages(spark, field):
    """Null, empty, broken, deep and very long pages, repeated rows, null ids, clashing columns, empty tables."""
    rows = [(i, "u", t, "x", 1) for i, t in enumerate(ODD)] + [(1, "u", ODD[1], "x", 1), (None, None, HAND["named"][0], None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = htmlcrf.extracted(frame, field).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (0, 1, 2)] == [""] * 4
    assert next(r.text for r in got if r.page_id == 8) == ("very long " * 200_000).strip()
    assert next(r.text for r in got if r.page_id is None) == "\n\n".join(HAND["named"][1])
    assert [b.text for b in htmlcrf.blocks(ODD[9])] == ["1 < 2 &< 3 &bogus; A"]
    assert htmlcrf.main_text(frame.limit(0)).count() == 0


def test_names_that_blocks_are_split_at():
    page = "<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><p>x<b>y</b> z<p>w<div>d<p>e</div>f"
    assert [b.text for b in htmlcrf.blocks(page)] == ["one", "two", "a", "b", "c", "xy z", "w", "d", "e", "f"]
