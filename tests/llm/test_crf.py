import random
import re
from collections import Counter
from html import unescape
from itertools import product

import numpy as np
import pytest

from postmill.llm import crf
from postmill.llm.crf import Field, block_features, blocks, extract, fit, labelled_page, main_text, train

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href="/">Site</a></header><nav><ul><li>Home<li>About</ul></nav><!-- ad -->
<div class="cookie-notice">We use cookies.</div><article><h1>Title &amp;amp; more</h1><p><b>First &eacute;&#8211;<br><p>Second   para
 with <i>mark</i>up.<ul><li>Item one<li>Item two</ul><div class="ad">Buy this.</div><p>Last one.</p><section class="comments"><p>I like it.</p></section></article><aside><p>Side text here.</p></aside>
<form><label>Name</label><textarea>typed</textarea></form><footer>&copy; me</footer>"""


def test_blocks():
    found = [b.text for b in blocks(PAGE)]
    assert found == [
        "Site", "Home", "About", "We use cookies.", "Title &amp; more", "First é–", "Second para with markup.", "Item one", "Item two", "Buy this.", "Last one.", "I like it.", "Side text here.", "Name", "© me",
    ]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == [] and [b.text for b in blocks("just text")] == ["just text"]
    assert [b.text for b in blocks("<p>a" * 3000)] == ["a"] * 3000
    assert len(blocks("<div>" * 2000 + "deep")) == 1


@pytest.mark.parametrize("n", [3, 11, 64, 5000])
def test_any_open_element_can_be_closed(n):
    inline = "<i>" * n
    found = blocks(f"<body><nav>{inline}menu</nav><article><p>{inline}one<p>two<ul><li>{inline}three<li>four</ul></article><footer>five")
    assert [b.text for b in found] == ["menu", "one", "two", "three", "four", "five"]
    tags = [[tag for tag, _ in b.ancestors if tag != "i"] for b in found]
    assert tags == [["nav"], ["article", "p"], ["article", "p"], ["article", "ul", "li"], ["article", "ul", "li"], ["footer"]]
    assert [b.text for b in blocks(f"<div><button>{inline}no</button>yes</div>")] == ["yes"]


def test_head_ends_without_its_end_tag():
    head = "<html><head><meta charset=utf-8><title>T</title><noscript><img src=x>no</noscript><style>p{}</style><link href=x>"
    for rest in ("<article>Text</article>", "<p>Text", "\n<b>Text</b>", "Text", "</head>Text", "</head><body>Text", "<body>Text", "<div>Text</div></head>"):
        assert [b.text for b in blocks(head + rest)] == ["Text"], rest
    assert [tuple(tag for tag, _ in b.ancestors) for b in blocks(head + "<article><p>Text")] == [("article", "p")]
    assert blocks(head) == blocks("<head><title>T</title> \n </head>") == []


def test_a_slash_ends_no_element():
    assert [b.text for b in blocks("<article><script/>var x=1;</script><p>hello")] == ["hello"]
    assert [b.text for b in blocks("<div/>one<p/>two<br/>three<style/>p{}</style>four")] == ["one", "two", "threefour"]
    assert [tuple(t for t, _ in b.ancestors) for b in blocks("<nav/><p>menu</p></nav><p>text")] == [("nav", "p"), ("p",)]
    assert [b.text for b in blocks("<p>a <svg><title/><path d=x /><g/>no</svg> b<svg/> c <math><mi/>x</math> d")] == ["a b c d"]


# Pages of other hands than the made ones: the main text of each stands between double brackets, which are no part of it.
OTHER_PAGES = [
    """<!doctype html><html><head><title>Recipe</title></head><body class="home"><div id="top"><a href="/">Kitchen</a> <a href="/login">Sign in</a></div>
<div class="sidebar-left"><ul><li><a href="/soups">Soups</a></li><li><a href="/bread">Bread</a></li></ul></div>
<div id="content"><div class="post"><h1>[[Rye bread at home]]</h1><p>[[Rye flour takes up more water than wheat, so the dough stays soft and sticky until it is baked.]]</p>
<h2>[[What you need]]</h2><ul><li>[[500 g of rye flour]]</li><li>[[400 g of water]]</li><li>[[a spoon of salt]]</li></ul><p>[[Mix all of it in the evening and let it rest in a warm place over night.]]</p></div></div>
<div class="comments-area"><h3>3 replies</h3><p>Mine fell apart, what did I do wrong?</p><p>Use less water.</p></div><div class="footer-widgets"><p>All rights reserved 2024</p></div></body></html>""",
    """<html><body><header class="site-header"><nav class="main-menu"><a href="/news">News</a><a href="/sport">Sport</a><a href="/weather">Weather</a></nav></header>
<div class="cookie-banner"><p>This site stores cookies to remember you.</p><button>Accept</button></div><main><article class="story"><header><h1>[[Bridge closed until spring]]</h1></header>
<p>[[The old bridge over the river will stay closed until spring, the town said on Monday.]]</p><aside class="related"><h4>Read also</h4><a href="/1">Ferry times</a><a href="/2">Road works</a></aside>
<p>[[Engineers found cracks in two of its five arches last week.]]</p><blockquote>[[We can not take that risk,]]</blockquote><p>[[said the mayor. Buses go by the northern road until then.]]</p></article></main>
<footer><p>Contact us</p><p>Imprint</p></footer></body></html>""",
    """<body><table><tr><td><div class="menu"><a href=a>Start</a><br><a href=b>Manual</a><br><a href=c>Download</a></div></td></tr></table><div class="entry-content"><h1>[[Installing the tool]]</h1>
<p>[[Download the archive and unpack it.]]<p>[[Then run the installer as shown here:]]<pre>[[./install --prefix=/opt/tool]]</pre><p>[[The installer asks for a folder and copies its files there.]]</div>
<div class="pagination"><a href=p>Previous</a><a href=n>Next</a></div><div class="newsletter"><form><label>Your mail address</label><input></form></div><footer>Made with care</footer>""",
    """<html><body><ul class="breadcrumbs"><li><a href=/>Home</a><li><a href=/d>Docs</a></ul><section class="content"><article><h2>[[How sorting works]]</h2><p>[[Rows are read in runs, each run is sorted, and runs are merged.]]</p>
<div class="ad">Buy two lamps, get one free today.</div><p>[[A merge reads each run from its start to its end, so it needs little memory.]]</p><table><tr><td>[[run size]]<td>[[64 MB]]<tr><td>[[runs merged]]<td>[[at most 16]]</table></article></section>
<section id="comments"><div class="comment"><p>Very clear, thank you for writing this up.</p></div><div class="comment"><p>What about ties?</p></div></section><div class="share"><a href=x>Share</a></div></body></html>""",
    """<body><nav><ul><li><a href="/a">Alpha</a><li><a href="/b">Beta</a></ul></nav><div class="notice">Our office is closed on Friday.</div><main id="main"><h1>[[The lighthouse]]</h1><p>[[The lighthouse stands on a rock two miles off the coast.]]</p>
<p>[[It was built in 1862 and has been without a keeper since 1981.]]</p><p>[[Boats go out twice a day in summer.]]</p></main><aside class="sidebar"><h3>Tours</h3><p>Book a tour for two.</p></aside><footer>Harbour museum, 12 Quay Street</footer></body>""",
]


def test_pages_of_other_hands(field):
    """Recall and precision of words on pages that the generator of labelled pages did not make."""
    found = right = wanted = 0
    for page in OTHER_PAGES:
        want = " ".join(part.split("]]")[0] for part in page.split("[[")[1:]).split()
        got = main_text(page.replace("[[", "").replace("]]", ""), field).split()
        same = sum((Counter(want) & Counter(got)).values())
        found, right, wanted = found + len(got), right + same, wanted + len(want)
    assert right / wanted >= 0.9 and right / found >= 0.9, (right, found, wanted)


def test_given_pages_against_their_own_markup(spark):
    """On the given pages: the words of each article, as plain patterns cut it out of the source."""
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    own = train(given, rows=20, layouts=3)
    found = {r.page_id: r.text for r in extract(given, own).collect()}
    same = wanted = got = 0
    for r in given.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html)
        if not inner:
            continue
        inner = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|aside|form|header|footer)\b.*?</\1>|<(section|div) class=\"?(?:comments|ad|notice)\b.*?</\2>", " ", inner[1])
        want = unescape(re.sub(r"</?(?:b|i|em|strong|a|span|mark)\b[^>]*>", "", inner).replace("<", " <"))
        want = re.sub(r"<[^>]*>", " ", want).split()
        same += sum((Counter(want) & Counter(found[r.page_id].split())).values())
        wanted, got = wanted + len(want), got + len(found[r.page_id].split())
    assert wanted > 1000 and same / wanted >= 0.97 and same / got >= 0.97, (same, wanted, got)


def test_long_pages_are_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "fit", lambda pages, *_: seen.append(pages))
    rows = [(1, "<article>" + "<p>one line of it" * 300 + "</article><footer>at the end"), (2, "<p>too many" * 600)]
    train(spark.createDataFrame(rows, "page_id long, html string"), rows=5, layouts=1, most_blocks=400)
    sizes = sorted(len(labels) for _, labels in seen[0])
    assert sizes[-1] == 301 and len(seen[0]) == 40 + 2
    assert max((labels for _, labels in seen[0]), key=len)[-1] == 0


@pytest.fixture(scope="module")
def pages(request):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["over", "under", "tree", "stone", "river", "walks", "slowly"]) for _ in range(rng.randint(3, 25))) + "."
    html = lambda: f"<body><nav><ul><li>{text()}</ul></nav><div class=ad>{text()}</div><article><h1>{text()}</h1><p>{text()}<p>{text()}</article><footer>{text()}</footer>"
    return [(i, f"http://x/{i}", html()) for i in range(60)]


@pytest.fixture(scope="module")
def field(spark, pages):
    return train(spark.createDataFrame(pages, "page_id long, url string, html string"), rows=50, layouts=12)


def test_held_out_pages(field, pages):
    wrong = total = 0
    for i in range(300):
        made, labels = labelled_page([b.text for b in blocks(pages[i % 60][2])], f"held out {i}")
        wrong += sum(bool(y) != bool(x) for x, y in zip(field.decode(block_features(made)), labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_query_on_pages(spark, field, pages):
    rows = [*pages[50:], (None, None, None), (7, "u", ""), (7, "u", ""), (8, "u", PAGE), (9, "u", "<article>" + "<p>many words &lt;here&gt;</p>" * 20_000)]
    found = extract(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"), field).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    for i, _, html in pages[50:]:
        inner = html.split("<article>")[1].split("</article>")[0]
        assert texts[i] == " ".join(inner.replace("<h1>", "").replace("</h1>", "").replace("<p>", " ").split())
    assert texts[8] == "Title &amp; more First é– Second para with markup. Item one Item two Last one."
    assert texts[7] == texts[None] == "" and texts[9] == " ".join(["many words <here>"] * 20_000)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), field).count() == 0


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(1)
    field = Field(rng.normal(size=(1 << 14, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7):
        features = [rng.integers(0, 1 << 14, 4).tolist() for _ in range(n)]
        value = lambda path: field.start[path[0]] + sum(field.emit[f, s].sum() for f, s in zip(features, path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))
        assert tuple(field.decode(features).astype(int)) == max(product((0, 1), repeat=n), key=value)


def test_fit_learns_transitions():
    pages = [([[1], [2], [2]], [0, 1, 0]), ([[1], [2]], [0, 1])] * 20
    assert fit(pages, steps=200).decode([[1], [2], [2]]).astype(int).tolist() == [0, 1, 0]


def test_training_without_pages(spark):
    field = train(spark.createDataFrame([], "page_id long, html string"))
    assert main_text("<body><nav>Menu</nav><article><p>Some text is here.</p></article>", field) == "Some text is here."


def test_sample_has_one_page_an_id(spark, pages, monkeypatch):
    seen = []
    monkeypatch.setattr(crf, "fit", lambda pages, *_: seen.append(pages))
    repeated = [(k, None, html) for k in (3, None) for _, _, html in pages] * 5
    for parts in (2, 7):
        train(spark.createDataFrame([*pages[:20], *repeated], "page_id long, url string, html string").repartition(parts), rows=12, layouts=2)
        train(spark.createDataFrame([*pages[:20], *repeated], "page_id long, url string, html string").repartition(parts), rows=100, layouts=2)
    fixed = 40 * 2
    assert [len(x) - fixed for x in seen] == [12 * 3, 21 * 3] * 2 and seen[:2] == seen[2:]
