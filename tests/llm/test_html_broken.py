"""Broken, deep and long pages, and pages of other makes than those the labeller was trained on."""

from __future__ import annotations

import time

import pytest

from vialect.llm import html_extract


@pytest.mark.parametrize(
    ("page", "n"),
    [
        ('<a "', 500_000), ("<svg>", 400_000), ('<a ">" ', 300_000), ("<a '\">", 300_000), ("<![CDATA[", 200_000), ("<!--", 300_000), ("<select>", 200_000), ("<a ", 500_000), ("<div>", 200_000), ("</p><b>", 200_000),
        ("<b><b><b><b><div></div>", 60_000), ("<i><div><b></i>", 100_000),
    ],
)
def test_long_broken_pages_take_seconds(page, n):
    began = time.process_time()
    html_extract.blocks(page * n + "<p>end</p>")
    html_extract.blocks("<div>" * 1000 + page * (n // 10) + "</p>" * (n // 10))
    assert time.process_time() - began < 15


@pytest.mark.parametrize("depth", [3997, 10_000, 200_000])
def test_depth(depth):
    found = html_extract.blocks("<div class=content>" * depth + "<h1>Title</h1><p>text</p>")
    assert [(b.text, b.own) for b in found] == [("Title", "h1"), ("text", "p")]
    assert found[1].path == html_extract.blocks("<div class=content><p>text</p>")[0].path


def test_text_of_broken_tags():
    assert [b.text for b in html_extract.blocks('<p>a<b class="x>b</b> c</p><p>1 < 2 <3</p>')] == ["ab c", "1 < 2 <3"]
    assert [b.text for b in html_extract.blocks('<p>a</p><p title=">">d</p>')] == ["a", "d"]
    assert [b.text for b in html_extract.blocks("<p>a<![CDATA[b & c]]>d</p><![CDATA[<p>e</p>")] == ["ab & cd", "e"]


MARKED = {
    "a weblog with classes only": """<html><body class="home"><div id="masthead"><div class="logo"><a href="/">Field notes</a></div><div id="nav"><a href="/a">Archive</a> <a href="/b">About me</a> <a href="/c">Contact</a></div></div>
<div id="wrapper"><div class="post"><h2>+Walking the old canal</h2><p>+We set out at dawn, when the mist was still lying on the water, and met nobody for two hours.</p>
<p>+The lock at the third mile is <em>broken</em>, but the keeper let us through.</p><blockquote><p>+Nothing here has moved since the war, he said.</p></blockquote><p>+We shall go back in spring.</p></div>
<div class="comments"><h3>2 comments</h3><div class="comment"><p>What a lovely walk, thank you!</p></div><div class="comment"><p>I was there last year and it rained.</p></div></div></div>
<div class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">The mill</a></li><li><a href="/2">The bridge</a></li></ul></div><div id="footer"><p>&copy; 2014 Field notes. All rights reserved.</p></div></body></html>""",
    "a news page with landmarks": """<!doctype html><html><body><header role="banner"><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header><div class="cookie-banner"><p>We value your privacy.</p><button>Accept</button></div>
<main><article><h1>+Council votes to keep the ferry</h1><p>+The council decided on Tuesday by nine votes to six that the ferry stays.</p><aside class="related"><h4>Related</h4><a href="/r">Ferry strike</a></aside>
<p>+Fares will rise by a tenth, and the last crossing will be at ten.</p><h2>+What comes next</h2><ul><li>+A new timetable in May</li><li>+A second boat in autumn</li></ul><p>+The vote is final.</p></article></main>
<aside><h3>Most read</h3><ol><li><a href="/m">Storm closes road</a></li></ol></aside><form class="newsletter"><label>Your e-mail</label><input><button>Subscribe</button></form><footer><ul><li><a href="/i">Imprint</a></li></ul><p>Copyright Daily Ferry</p></footer></body></html>""",
    "a manual page in German": """<html><body><nav class="breadcrumb"><a href="/">Start</a> <a href="/h">Handbuch</a></nav><section class="content"><h1>+Die Pumpe entlüften</h1><p>+Schalten Sie die Anlage aus und warten Sie fünf Minuten.</p>
<ol><li>+Ventil öffnen, bis Wasser austritt.</li><li>+Ventil schließen und Druck prüfen.</li></ol><pre>+Druck: 1,5 bar</pre><p>+Bei Bedarf wiederholen Sie den Vorgang.</p></section><div class="ad-box"><p>Jetzt Ersatzteile kaufen!</p></div><footer><p>Impressum und Datenschutz</p></footer></body></html>""",
}


@pytest.mark.parametrize("name", MARKED)
def test_hand_marked_pages(name):
    """Blocks that a reader marked as main text begin with a plus sign."""
    page = MARKED[name]
    marked = [b.text.startswith("+") for b in html_extract.blocks(page)]
    clean = page.replace(">+", ">")
    texts = [b.text for b in html_extract.blocks(clean)]
    got = html_extract.main_text([clean], html_extract.trained())[0].split("\n\n")
    assert got == [t for t, m in zip(texts, marked, strict=True) if m]
