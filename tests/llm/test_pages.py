"""Pages that no generator made, and the parser's cost and rules."""

import time
from pathlib import Path

import pytest

from tapeline.llm import pages as P

NEWS = """<!doctype html><html lang=en><head><meta charset=utf-8><title>River reopens</title><script>if (a < b) { x("</div>") }</script></head>
<body class="page"><div id="cookie-banner" class="consent"><p>We use cookies to improve our service.</p><button>Accept all</button></div>
<header class="site-header"><a href="/"><img src=logo.png alt=Logo></a><nav><ul><li><a href=/news>News<li><a href=/sport>Sport<li><a href=/tv>TV</ul></nav></header>
<main><article class="story"><h1>River reopens after the flood</h1><p class="byline">By A. Writer</p>
<p>The river was opened to boats on Monday, three weeks after the flood that closed its locks &amp; quays.</p>
<p>Officials said that <b>all twelve</b> gates had been tested, and that the water was clean again.
<p>Boats may pass from six in the morning.
<div class="ad advert"><a href=//ads.example/1>Buy a boat today</a></div>
<h2>What comes next</h2><p>Repairs of the banks go on until autumn, the office wrote in its report.</p>
<figure><img src=a.jpg><figcaption>The lock on Monday morning.</figcaption></figure></article>
<section id="comments" class="comments"><h3>Comments</h3><div class="comment"><b>joe</b><p>Finally, I have waited for so long to go out again.</p></div></section></main>
<aside class="sidebar"><h3>Most read</h3><ul><li><a href=/1>Bridge closed</a></li><li><a href=/2>Fair opens</a></li></ul></aside>
<footer><p>&copy; 2024 The Paper. All rights reserved.</p></footer></body></html>"""

BLOG = """<html><body><div id=top class=nav><a href=/>home</a> | <a href=/about>about</a> | <a href=/archive>archive</a></div>
<div id=content class="post entry"><h1>Why I bake bread</h1>
<p>Every Sunday I take flour, water and salt, and I wait. The dough rises slowly, and so do I.</p>
<ul><li>Use warm water, but not hot water.</li><li>Wait until the dough has doubled.</li></ul>
<blockquote>Bread is a slow art, my grandmother used to say.</blockquote>
<p>Then it goes into the oven for forty minutes, and the house smells of it until the evening.</p></div>
<form action=/s><label>Search this site</label><input name=q><button>Go</button></form>
<div class=footer>Powered by a very small engine. <a href=/rss>RSS</a></div></body></html>"""


@pytest.mark.parametrize(
    ("page", "wanted", "unwanted"),
    [
        (NEWS, ["River reopens after the flood", "The river was opened to boats on Monday, three weeks after the flood that closed its locks & quays.", "Officials said that all twelve gates had been tested, and that the water was clean again.", "Boats may pass from six in the morning.", "What comes next", "Repairs of the banks go on until autumn, the office wrote in its report."],
         ["cookies", "Accept", "Sport", "Buy a boat", "Finally", "Most read", "Fair opens", "rights reserved", "x("]),
        (BLOG, ["Why I bake bread", "Every Sunday I take flour, water and salt, and I wait. The dough rises slowly, and so do I.", "Use warm water, but not hot water.", "Bread is a slow art, my grandmother used to say.", "Then it goes into the oven for forty minutes, and the house smells of it until the evening."],
         ["archive", "Search this site", "Powered", "RSS"]),
    ],
)
def test_hand_written_pages(page, wanted, unwanted):
    lines = P.extract(P.trained(), [page])[0].split("\n")
    assert [w for w in wanted if w not in lines] == []
    assert [u for u in unwanted if any(u in x for x in lines)] == []


PARA = "<p>A paragraph of some length, with a comma, stands here so that there is main text.</p>"


@pytest.mark.parametrize(
    ("inside", "seen"),
    [
        ('<p hidden>secret words of nobody</p>', None), ('<div style="color:red; DISPLAY : none">secret words</div>', None), ("<dialog>secret words of a box</dialog>", None), ("<dialog open>words of an open box</dialog>", "words of an open box"),
        ("<details><summary>More about it</summary><p>The body of the details, which readers open.</p></details>", "The body of the details, which readers open."),
        ("<p>It holds that <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in all these cases.</p>", "It holds that x=2 in all these cases."), ('<p title="is hidden">Shown text of a paragraph.</p>', "Shown text of a paragraph."),
        ("<p>1 < 2 and a <- b, so it goes.</p>", "1 < 2 and a <- b, so it goes."), ("<p>kept<!-- gone --> too, and <![CDATA[ gone ]]>so on.</p>", "kept too, and so on."), ('<p data-x="a > b">Quoted signs end no tag.</p>', "Quoted signs end no tag."),
    ],
)
def test_what_is_shown(inside, seen):
    nodes = P.parse(f"<html><body><article>{PARA}{inside}{PARA}</article></body></html>")
    lines = P.text_of(nodes, P.np.array([not n.hidden for n in nodes])).split("\n")
    assert lines[1:-1] == ([seen] if seen and "summary" not in inside else ["More about it", seen] if seen else [])
    assert "secret" not in P.extract(P.trained(), [f"<article>{PARA}{inside}{PARA}</article>"])[0]


@pytest.mark.parametrize("page", ["<b " * 350_000, "<div>" * 90_000 + "</p>" * 90_000, "<a b='" * 170_000, "<b><div>" + "<i>" * 120_000 + "</b>" * 120_000, "<!" * 500_000, "<p>" * 300_000, "<li>" * 250_000, "</" * 500_000], ids=range(8))
def test_parsing_takes_linear_time(page):
    began = time.process_time()
    P.parse(page)
    assert time.process_time() - began < 6  # some tenths of a second where it is linear, hours where it is not


@pytest.mark.parametrize("page", ["", None, "   ", "plain words only", "<", "<p", "<p>", "</p>", "<script>", "<textarea>x", "&amp;", "<html></html>", "\x00<a>\x00"])
def test_odd_pages_have_a_text(page):
    assert isinstance(P.extract(P.trained(), [page])[0], str)


def test_no_line_of_an_article_is_lost():
    """The driver's pages mark their article, so its lines are known."""
    import html
    import re

    duckdb = pytest.importorskip("duckdb")
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    found = duckdb.execute(f"select html from '{path}'").fetchall()
    for (page,), got in zip(found, P.extract(P.trained(), [h for (h,) in found]), strict=True):
        inside = page[page.index("<article") : page.rindex("</article>")]
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", inside)]
        assert got.split("\n") == [x for x in plain if x]
