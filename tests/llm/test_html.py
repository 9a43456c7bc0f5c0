"""Main text of pages against an independent parser, and the cases of its rules."""

import time
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkwell.llm import html_text, queries

LONG = "It had rained all night and the road was deep in mud when they set out for home again, and nobody spoke for a long while."


class Article(HTMLParser):
    """The blocks of <article> in the given pages, which hold p, h1 and br only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = False, [], []

    def end(self):
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("p", "h1"):
            self.end()
        elif tag == "br":
            self.now.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def plain_article(page):
    parser = Article()
    parser.feed(page or "")
    parser.close()
    parser.end()
    return "\n\n".join(parser.blocks)


def test_every_page_equals_an_independent_parser(spark):
    for sf in ("sf0.001", "sf0.01"):
        pages = {i: h for i, h in zip(*pq.read_table(f"/root/testdata/{sf}/pages.parquet", columns=["page_id", "html"]).to_pydict().values(), strict=True)}
        rows = queries.op6_html_text(spark, f"/root/testdata/{sf}").collect()
        assert len(rows) == len(pages)
        for r in rows:
            assert r.text == plain_article(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def tree():
    return html_text.labelled_tree()


CASES = {
    "a short article alone": ("<article><h1>H</h1><p>A</p><p>B</p><p>C</p></article>", "H|A|B|C"),
    "a title and no footer": ("<title>T</title><article><h1>H</h1><p>A</p><p>B</p><p>C</p></article>", "H|A|B|C"),
    "a footer and no title": ("<article><h1>H</h1><p>A</p><p>B</p></article><footer>F</footer>", "H|A|B"),
    "a paragraph with a banner's name": (f"<article><h1>H</h1><p class='lead-banner'>Lead.</p><p>{LONG}</p></article>", f"H|Lead.|{LONG}"),
    "a story with a promotion's name": (f"<div class='story promo'><h1>H</h1><p>{LONG}</p><p>{LONG}</p></div><div class=promo>Buy.</div>", f"H|{LONG}|{LONG}"),
    "a list in a plain div": (f"<div><p>{LONG}</p><ul><li>Bread and cheese</li><li>Milk</li></ul><p>{LONG}</p></div>", f"{LONG}|Bread and cheese|Milk|{LONG}"),
    "boilerplate without names": (f"<div>Home News Sport</div><div>We use cookies.</div><div><h1>H</h1><p>{LONG}</p><p>So.</p></div><div>All rights reserved</div>", f"H|{LONG}|So."),
    "comments longer than the story": (f"<div class=story><p>{LONG}</p><p>Yes.</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p><p>I agree.</p></div>", f"{LONG}|Yes."),
    "comments as articles": (f"<article><p>{LONG}</p></article><section id=replies><article class=comment><p>{LONG}</p></article></section>", LONG),
    "forms, buttons and advertisements inside": (f"<article><p>{LONG}</p><form><p>Write to us</p><button>Send</button></form><div class=ad>Buy now.</div><p>End.</p></article>", f"{LONG}|End."),
    "sections": (f"<article><section><h2>One</h2><p>{LONG}</p></section><section><h2>Two</h2><p>No.</p></section></article><div>Off</div>", f"One|{LONG}|Two|No."),
    "quotes in tags": (f"<article><p don't>{LONG}</p><p title='x>y' id = \"a>b\">End</p></article>", f"{LONG}|End"),
    "empty and unclosed elements": (f"<article><p>{LONG}</p><svg/><p>One</p><select><option>no</select><p>Two</p><object><p>Three</p></article>", f"{LONG}|One|Two|Three"),
    "a page in one form": (f"<body><form id=aspnetForm><div id=hdr>Site</div><div class=menu><a>Home</a></div><h1>H</h1><p>{LONG}</p><p>{LONG}</p><div>End</div></form>", f"H|{LONG}|{LONG}"),
    "an article in a form": (f"<form><nav><a>Home</a></nav><article><h1>H</h1><p>{LONG}</p><p>So.</p></article></form>", f"H|{LONG}|So."),
    "a long form beside an article": (f"<article><p>Short.</p><p>{LONG}</p></article><form><p>{LONG}</p><p>{LONG}</p></form>", f"Short.|{LONG}"),
    "a section about sponsors": (f"<article><h1>H</h1><p>{LONG}</p><section class='sponsored-research'><p>{LONG}</p></section></article>", f"H|{LONG}|{LONG}"),
    "prices of shares": (f"<article><p>{LONG}</p><div class='share-price'><p>{LONG}</p></div><div class=share-buttons>Send this</div></article>", f"{LONG}|{LONG}"),
    "a section named social": (f"<main><h1>H</h1><section id='social'><h2>S</h2><p>{LONG}</p></section><p>{LONG}</p></main>", f"H|S|{LONG}|{LONG}"),
    "a newsletter inside": (f"<article><p>{LONG}</p><div class=newsletter><p>Get our letters by mail every week.</p></div><p>{LONG}</p></article>", f"{LONG}|{LONG}"),
    "long comments in main": (f"<main><h1>H</h1><p>{LONG}</p><div class='comment-list'><p>{LONG}</p><p>Yes.</p></div></main>", f"H|{LONG}"),
    "references": ("<article><p>&lt;A&gt; &amp; B&am &#65; &#000000000000065; &#x1F600; c&nbsp;&#160; d</p></article>", "<A> & B&am A A 😀 c d"),
    "no tag": ("<article><p>a < b <3 >> c</p></article>", "a < b <3 >> c"),
    "a tag never closed": ("<article><p>A</p><p>B <a href=", "A|B"),
    "scripts with markup": ("<article><p>A</p><script>var t = '</p>';</script><style>p{}</style><p>B</p></article>", "A|B"),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(tree, name):
    page, want = CASES[name]
    assert html_text.main_text(page, tree) == want.replace("|", "\n\n")


def test_references_beyond_unicode(tree):
    for digits in ("9" * 20, "9" * 6000):
        assert html_text.main_text(f"<article><p>a &#{digits}; b</p></article>", tree) == "a � b"
    assert html_text.main_text(f"<article><p>&#{'0' * 6000}65;</p></article>", tree) == "A"


HEAVY = ["<a ", '<a href="', "<div>x", "< ", "<!-- ", "<svg>", "<object>", "<script>", "<", "<a = ", "<ul><li>x", "&#", "<article>x", "</p>", "<p class='", "<div></p>", "<a><p>", "<! ", "</"]


@pytest.mark.parametrize("piece", HEAVY)
def test_time_is_in_proportion(tree, piece):
    began = time.perf_counter()
    html_text.main_text(piece * ((1 << 20) // len(piece)), tree)
    assert time.perf_counter() - began < 8  # about one second on an idle core


def test_unmatched_ends_take_no_time(tree):
    began = time.perf_counter()
    html_text.main_text("<div>" * 100_000 + "</p>" * 100_000, tree)
    assert time.perf_counter() - began < 5


def test_tree_uses_the_dealt_features_and_fits_its_table(tree):
    used = {html_text.NAMES[c] for c in tree.column if c >= 0}
    assert {"words", "links", "words_before", "words_after", "links_before", "links_after"} <= used
    inner = np.flatnonzero(tree.column >= 0)
    leaf = tree.column < 0
    assert not any(leaf[a] and leaf[b] and tree.label[a] == tree.label[b] for a, b in zip(tree.left[inner], tree.right[inner], strict=True))
    wrong = rows = 0
    for page in html_text.LABELLED:
        filled = html_text.FILL.sub(lambda m: m[1].strip("=") + " ".join(["words"] * int(m[2])) + m[3], page)
        blocks, elements = html_text.blocks_of(filled)
        y = tree.predict(html_text.features(blocks, elements))
        wrong += sum(bool(p) != b.text.startswith("+") for p, b in zip(y, blocks, strict=True))
        rows += len(blocks)
    assert rows > 400 and wrong <= 5


def test_growing_finds_the_best_cut():
    x = np.array([[1, 5], [2, 5], [3, 5], [4, 9], [5, 9], [6, 9]], float)
    tree = html_text.grow(x, np.array([0, 0, 0, 1, 1, 1], float))
    assert (tree.column[0], tree.cut[0]) == (0, 3.5) and tree.predict(x).tolist() == [0, 0, 0, 1, 1, 1]
    assert len(html_text.grow(x, np.ones(6)).column) == 1


def test_page_hard_cases(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (3, "u", "<p>" * 3000, "x"), (4, "u", "<!-- open", "x"), (None, "u", CASES["sections"][0], "x"), (5, "u", CASES["sections"][0], "x"), (5, "u", CASES["sections"][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id or 0, r.text != "") for r in got) == [(0, True), (1, False), (2, False), (3, False), (4, False), (5, True), (5, True)]
    assert len({r.text for r in got if r.text}) == 1
    assert html_text.extract(df.limit(0)).count() == 0
