"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks of text at its block-level tags. Each block has
its word count, link density and text density, those of both neighbours, its
kind of tag, and what its containers hold. A decision tree (Gini splits),
trained on the small labelled table below, says which blocks belong to the
article. A class name alone doesn't decide: it counts with the share of the page
that the element of this name holds, and with the words and links of its longest
block, so a section of prose stays whatever it is called. Only names of reader
comments, which are prose too, count as they stand. A form that holds more than half of
the page, with any article in it, is a container like others.

Defined cases: a null or empty page, and one without an article block, gives an
empty text; a page may have any size and is read whole, in time in proportion;
a block without a neighbour has its own values in the neighbour's place;
comments, scripts and tags that are never closed run to the end of the page, as
in HTML; a "<" that opens no tag is text; character references beyond Unicode
become U+FFFD; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import small_batches

#: What may end a tag or open a quoted value in it, and the name of a tag.
STOP, NAME = re.compile(r">|=\s*[\"']"), re.compile(r"/?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")

#: Elements whose content is no text of the page; the first ones hold no markup either.
RAW = frozenset("script style textarea iframe xmp noembed noframes".split())
SKIPPED = RAW | frozenset("noscript template svg math object canvas select audio video".split())
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in SKIPPED}

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("li dt dd tr caption figcaption".split())
PROSE = HEADINGS | LISTS | frozenset("p blockquote pre".split())
BLOCKS = PROSE | frozenset("address article aside body button center details dialog div dl fieldset figure footer form head header hgroup hr html label legend main menu nav ol option search section summary table tbody tfoot thead title ul".split())
#: Tags whose content belongs to the container around them.
CARRIERS = frozenset("ul ol dl table tbody thead tfoot hgroup".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Tags that by their meaning hold no article text.
BESIDE = frozenset("nav footer aside form menu dialog head title button fieldset label search".split())
#: Words of class names, ids and roles; those in SOFT don't count beside one of OWN.
HARD = frozenset("ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments consent cookie cookies disqus login menu modal nav navbar navigation newsletter popup promo related replies share sharing sidebar signup social sponsor sponsored subscribe".split())
SOFT = frozenset("banner copyright footer header masthead notice overlay toolbar widget".split())
#: Names of reader comments.
REPLIES = frozenset("comment comments disqus replies".split())
OWN = frozenset("article body content entry main post story text title".split())

NAMES = (
    "words", "links", "density", "words_before", "words_after", "links_before", "links_after", "density_before", "density_after",
    "sentence", "heading", "list", "prose", "in_core", "has_core", "beside", "page_header", "container_share", "marked_share", "replies", "marked_longest",
)
COLUMNS = 80


@dataclass
class Element:
    tag: str
    parent: int
    marked: bool = False
    replies: bool = False
    words: int = 0
    longest: int = 0  # words outside links of its longest block
    plain: int = 0  # words outside links, not those of elements inside that are containers


@dataclass
class Block:
    element: int = 0
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    words: int = 0
    text: str = ""


def name_words(attributes: str) -> list[str]:
    """The words of an element's class names, id and role."""
    return [p.lower() for m in MARKS.findall(attributes) for p in PARTS.findall("".join(m))]


def is_marked(tag: str, words: list[str]) -> bool:
    """Whether a class name, id or role speaks against the element; one of a paragraph or the like must do so with every word."""
    if not words or tag in ("html", "body", "main"):
        return False
    if tag in PROSE:
        return all(w in HARD or w in SOFT for w in words)
    if tag == "article":
        return any(w in HARD for w in words) and not any(w in OWN for w in words)
    return any(w in HARD for w in words) or any(w in SOFT for w in words) and not any(w in OWN for w in words)


def tag_end(html: str, at: int) -> int:
    """The position behind the tag that begins before ``at``, -1 if it is never closed."""
    while m := STOP.search(html, at):
        if m[0] == ">":
            return m.end()
        at = html.find(m[0][-1], m.end()) + 1
        if not at:
            break
    return -1


def clean(text: str) -> str:
    """Character references decoded, white space as single spaces."""
    if "&#" in text:
        text = HUGE.sub("�", ZEROS.sub("&#", text))
    return " ".join(unescape(text).split())


def blocks_of(html: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page, in order, and its block-level elements; an element comes after its parent."""
    blocks: list[Block] = []
    elements, stack, opened = [Element("", -1)], [0], Counter()
    now, link, at, unclosed = Block(), 0, 0, set()  # link: how deep the stack was where a link began, 0 outside of links

    def put(text: str) -> None:
        if text:
            now.pieces.append(text)
            n = len(text.split())
            now.words += n
            now.linked += n * bool(link)

    def end() -> None:
        nonlocal now
        if now.words:
            now.text, now.element = clean("".join(now.pieces)), stack[-1]
            if now.text:
                blocks.append(now)
            now = Block()
        else:
            now.pieces.clear()

    def pop() -> None:
        nonlocal link
        opened[elements[stack.pop()].tag] -= 1
        if len(stack) < link:
            link = 0

    while (i := html.find("<", at)) >= 0:
        m = NAME.match(html, i + 1)
        if not m and html[i + 1 : i + 2] not in ("!", "?"):
            put(html[at : i + 1])
            at = i + 1
            continue
        put(html[at:i])
        if html.startswith("<!--", i):
            at = html.find("-->", i + 4) + 3
            if at == 2:
                at = len(html)
            continue
        if not m:
            at = html.find(">", i) + 1 or len(html)
            continue
        at = tag_end(html, m.end())
        if at < 0:
            at = len(html)
            break
        name, closes = m[1].lower(), html[i + 1] == "/"
        if name in SKIPPED:
            if closes or name in unclosed or name in ("svg", "math") and html[at - 2] == "/":
                continue
            if (over := CLOSING[name].search(html, at)) is not None:
                at = tag_end(html, over.end())
            elif name in RAW:
                at = -1
            else:
                unclosed.add(name)
            if at < 0:
                at = len(html)
        elif name == "a":
            link = 0 if closes else len(stack)
        elif name in ("br", "td", "th", "img", "input"):
            put(" ")
        elif name in BLOCKS and closes:
            end()
            if opened[name]:
                while elements[stack[-1]].tag != name:
                    pop()
                pop()
        elif name in BLOCKS:
            end()
            top = elements[stack[-1]].tag
            if top == "p" or name == top and name in ("li", "dt", "dd", "tr", "option"):
                pop()
            if name not in VOID:
                named = name_words(html[m.end() : at])
                marked = is_marked(name, named)
                elements.append(Element(name, stack[-1], marked, marked and not REPLIES.isdisjoint(named)))
                stack.append(len(elements) - 1)
                opened[name] += 1
    put(html[at:])
    end()
    return blocks, elements


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """A row of NAMES for each block, in time in proportion to blocks and elements."""
    for b in blocks:
        e = elements[b.element]
        e.words += b.words
        e.longest = max(e.longest, b.words - b.linked)
    within = [int(e.tag in ("article", "main")) for e in elements]
    for i in range(len(elements) - 1, 0, -1):
        e, up = elements[i], elements[elements[i].parent]
        up.words += e.words
        up.longest = max(up.longest, e.longest)
        within[e.parent] += within[i]
    # from parents to children: containers, and what the tags and names around say
    beside, header, marked, container = [False], [False], [False], [0]
    for i, e in enumerate(elements[1:], 1):
        p = e.parent
        page = e.tag == "form" and 2 * e.words > elements[0].words and within[i] == within[0]
        beside.append(beside[p] or e.tag in BESIDE and not page)
        marked.append(marked[p] or e.marked)
        container.append(container[p] if e.tag in PROSE or e.tag in CARRIERS else i)
    for b in blocks:
        elements[container[b.element]].plain += b.words - b.linked
    most = max([e.plain for e in elements] + [1])
    clear = max((e.plain for e, x, y in zip(elements, beside, marked, strict=True) if not (x or y)), default=0)
    share, articles, replies, named = [1.0], {"article": [], "main": []}, [False], [0]
    for i, e in enumerate(elements[1:], 1):
        replies.append(replies[e.parent] or e.replies)
        named.append(i if e.marked else named[e.parent])
        share.append(min(share[e.parent], e.words / max(e.words + clear, 1)) if e.marked else share[e.parent])
        if e.tag in articles and e.words and not beside[i]:
            articles[e.tag].append(i)
    # the articles without a mark are the core, else main, else the articles that hold most of the page
    for found in ([i for i in articles["article"] if not marked[i]], articles["main"], [i for i in articles["article"] if share[i] > 0.8]):
        if found:
            break
    core, found = [False], set(found)
    for i, e in enumerate(elements[1:], 1):
        core.append(core[e.parent] or i in found)
        header.append(header[e.parent] or e.tag == "header" and not core[i])

    out = np.zeros((len(blocks), len(NAMES)))
    for x, b in zip(out, blocks, strict=True):
        e = elements[b.element]
        x[:3] = b.words, b.linked / b.words, b.words / max(1.0, len(b.text) / COLUMNS)
        x[9:13] = b.text[-1] in ".!?…:;\"”»)。！？", e.tag in HEADINGS, e.tag in LISTS, e.tag in PROSE
        x[13:17] = core[b.element], bool(found), beside[b.element], header[b.element]
        near = named[b.element]
        x[17:] = elements[container[b.element]].plain / most, share[b.element], replies[b.element], elements[near].longest if near else 0
    before, after = np.r_[0, : len(out) - 1], np.r_[1 : len(out), len(out) - 1]
    if len(out):
        x = out[:, :3].copy()
        out[:, [3, 5, 7]], out[:, [4, 6, 8]] = x[before], x[after]
    return out


@dataclass
class Tree:
    """Inner nodes test x[column] <= cut and go on left or right; leaves carry a label."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.column[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(self.column[at], 0)] <= self.cut[at]
            at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
        return self.label[at]

    def rules(self, node: int = 0, depth: int = 0) -> str:
        """The tree as text."""
        if self.column[node] < 0:
            return "  " * depth + ("article" if self.label[node] else "other") + "\n"
        head = f"{'  ' * depth}{NAMES[self.column[node]]} <= {self.cut[node]:.3g}\n"
        return head + self.rules(self.left[node], depth + 1) + self.rules(self.right[node], depth + 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 3) -> Tree:
    """Best Gini split at each node until it is pure, ``depth`` is reached, or a side would hold under ``least`` rows; of equal splits the earlier column."""
    nodes: list[list] = []

    def best_split(x: np.ndarray, y: np.ndarray) -> tuple[float, int, float] | None:
        best = None
        for c in range(x.shape[1]):
            order = np.argsort(x[:, c], kind="stable")
            v, ones, n = x[order, c], np.cumsum(y[order]), np.arange(1, len(y) + 1)
            cuts = np.flatnonzero(v[1:] > v[:-1])
            cuts = cuts[(cuts + 1 >= least) & (cuts + 1 <= len(y) - least)]
            if not len(cuts):
                continue
            a, k = ones[cuts], n[cuts]
            b, m = ones[-1] - a, len(y) - k
            impurity = a * (k - a) / k + b * (m - b) / m
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-9:
                best = float(impurity[i]), c, float(v[cuts[i]] + v[cuts[i] + 1]) / 2
        return best

    def build(rows: np.ndarray, left_over: int) -> int:
        i = len(nodes)
        nodes.append([-1, 0.0, 0, 0, int(y[rows].mean() >= 0.5)])
        if left_over and 0 < y[rows].mean() < 1 and (best := best_split(x[rows], y[rows])):
            go = x[rows, best[1]] <= best[2]
            nodes[i][:2] = best[1], best[2]
            nodes[i][2] = build(rows[go], left_over - 1)
            nodes[i][3] = build(rows[~go], left_over - 1)
            below = [nodes[k] for k in nodes[i][2:4]]
            if all(b[0] < 0 for b in below) and below[0][4] == below[1][4]:  # a cut between equal leaves says nothing
                nodes[i:] = [[-1, 0.0, 0, 0, below[0][4]]]
        return i

    build(np.arange(len(y)), depth)
    return Tree(*(np.array(c) for c in zip(*nodes, strict=True)))


#: The labelled table: pages in which a sign and a number stand for a block of so many words: + is of the article, - is not,
#: = goes on with the block; a full stop ends a sentence.
LABELLED = (
    # tags tell: articles with short and long blocks, advertisements and forms beside and inside
    "<head><title>-5</title></head><body><header><h1>-2</h1><p>-8.</header><nav><ul><li><a>-1</a><li><a>-1</a><li><a>-4</a></ul></nav><div class=ad>-11.</div><article><h1>+4</h1><p>+17.<p>+2.<p>+9 <a>=2</a> =9.<h2>+1</h2><p>+1.<ul><li>+5<li>+2</ul></article><aside><h3>-2</h3><p>-14.</aside><footer>-12.</footer>",
    "<body><nav>-3</nav><div>-7.</div><article><h1>+9</h1><p>+61.<p>+1.<p>+120.<blockquote>+14.</blockquote><p>+1</article><footer>-9</footer>",
    "<title>-6</title><nav><a>-1</a> <a>=2</a></nav><div class=ad>-30.</div><article><h1>+12</h1><p>+1.<p>+3.</article><footer>-15.</footer>",
    "<article><h1>+2</h1><p>+1<p>+1<p>+1</article>",
    "<div><a>-2</a><a>-3</a></div><article><h1>+3</h1><p>+2.<p>+6.</article><div><p>-34.<p>-47.</div><div>-9.</div>",
    "<section><p>-25.<p>-6.</section><article><p>+14.<p>+1.<p>+3.</article><section><p>-61.<p>-19.<p>-3.</section>",
    "<div>-16.</div><article><h1>+5</h1><p>+4.</article><div>-22.</div><p>-38.<p>-2.",
    "<p>-11.<main><h1>+2</h1><p>+8.<p>+2.</main><p>-29.<p>-31.<ul><li>-4<li>-2</ul>",
    "<article><h1>+6</h1><p>+20 <a>=3</a>.<p><a>+5</a><p><a>+14.</a><ul><li><a>+2</a><li><a>+7</a></ul><p>+26.</article>",
    "<article><p><a>+3</a><p>+4.<p><a>+8</a><p><a>+1</a></article><footer><p><a>-3</a></footer>",
    "<nav>-2</nav><article><h1>+4</h1><section><h2>+2</h2><p>+60.<p>+18.</section><section><h2>+3</h2><p>+2.<p>+9.</section><div><p>+1.<p>+25.</div><div>+12.</div><div>+2</div><section><p><a>+3</a><p><a>+11</a></section></article><div>-3</div><div><p>-40.<p>-2.</div>",
    "<div>-5</div><article><div><h1>+7</h1><p>+3</div><div><p>+140.<p>+2.<p>+95.<p>+64.</div><div><p>+1.<ul><li><a>+2</a><li><a>+6</a><li>+3</ul></div><div><h3>+2</h3><p>+15.</div></article><div><p>-52.<p>-33.<p>-1.</div><div><a>-2</a></div>",
    "<article><div><p>+2.</div><div><p>+88.</div><div><p>+1</div><figure><figcaption>+8.</figcaption></figure><div><p>+70.<p>+5.</div></article><section><h2>-2</h2><p>-30.<p>-48.<p>-2.</section>",
    "<main><section><h1>+3</h1><p>+4.</section><section><p>+75.<p>+1.<p>+66.</section><section><h2>+1</h2><p>+3.<p><a>+4</a></section><div>+2.</div></main><div><p>-28.<p>-36.</div>",
    "<title>-3</title><article><h2>+3</h2><p>+2.<p>+6<p>+4.</article>",
    "<body><article><header><h1>+3</h1><p>+4</header><section><p>+3.<p>+13.<pre>+5</pre></section><div class=ad>-9.</div><form><p>-13.</form><p>+3.<footer>-5</footer></article><div class=notice>-10.</div>",
    "<body><p>-2<ul><li>-1</ul><article><p>+1.<p><a>+12.</a><p>+1.<p class=lead-banner>+18.<p><a>+1</a></article><div><p>-1</div>",
    "<article><h1>+5</h1><p>+33.<div class=related><h3>-2</h3><ul><li><a>-5</a><li><a>-4</a></ul></div><p>+41.<div class='ad box'>-4</div><p>+2.</article><section class=comments><h3>-1</h3><article class=comment><p>-26.</article><article class=comment><p>-44.</article></section>",
    "<article><h1>+4</h1><div>+35.</div><div>+28.</div><div>+3.</div></article><div>-20.</div>",
    "<article><p class=cookie-notice>-9.<h1>+6</h1><p>+22.<table><tr><td>+2<td>=3<tr><td>+1<td>=2</table><p>+8.</article>",
    "<main><nav><a>-2</a></nav><h1>+5</h1><p>+19.<table><tr><td>+1<td>=2<tr><td>+2<td>=1</table><div class=share><p>-13.</div><p>+2.<div class=related><h3>-2</h3><ul><li><a>-4</a></ul></div></main><footer><p>-9.<ul><li><a>-1</a></ul></footer>",
    "<main><div class='post-content'><h1>+7</h1><p>+25.<p>+3.<ul><li>+12.<li>+3</ul></div><aside><article><p>-21.</article></aside><div class=sidebar><p>-18.<p>-2</div></main><div>-6</div>",
    "<body><header class=site-header><p>-7.</header><main><header><h1>+6</h1></header><p>+48.<p>+31.<button>-1</button><p>+1.</main><p>-16.",
    # names tell, with the share of the page that the named element holds
    "<body><div id=cookie-notice><p>-15.</div><div class=menu><a>-1</a><a>=1</a></div><div class=content><h2>+4</h2><p>+16.<p>+20.<blockquote>+13.</blockquote><p>+3.</div><div class=sidebar><p>-16.</div><section id=comments><h3>-1</h3><div class=comment><p>-16.</div><form><label>-2</label><p>-11.<button>-1</button></form></section><div class=footer><p>-13.</div>",
    "<body><div class=navbar>-4</div><div class='story promo'><h1>+6</h1><p>+37.<p>+52.<p>+2.<p>+29.</div><div class=promo>-6.</div>",
    "<body><div class=story><h1>+5</h1><p>+24.<p>+30.</div><div class=comments><p>-35.<p>-41.<p>-18.<p>-2.</div>",
    "<div class=header><a>-2</a> =5</div><div id=text><h1>+8</h1><p>+90.<ul><li>+7<li>+9.<li>+1</ul><p>+1.<p>+70.</div><div class=newsletter><p>-12.</div><div class=copyright>-6.</div>",
    "<div class=masthead>-3</div><div><p>+40.<p>+36.<div class=advert><p>-17.</div><p>+28.<p>+4.</div><div class=subscribe>-21.</div><div class=footer><ul><li>-2<li>-3</ul></div>",
    "<div class=page><div class=modal><p>-31.</div><div class=entry><h1>+3</h1><p>+55.<p class=comment-note>+19.<p class=note>+6.<h3>+2</h3><p>+44.</div></div>",
    "<div class='banner story'><h1>+4</h1><p>+60.<p>+45.</div><div class=banner>-5</div>",
    # a story shorter than what lies about it
    "<article><p>+15.<p>+2.<p>+8.</article><p>-38.<p>-22.",
    "<div class=top>-4</div><article><h1>+3</h1><p>+5.<p>+11.<p>+2.</article><div class=ad>-40.</div><div>-25.</div>",
    "<article><p><a>+4</a><p><a>+9</a><p>+3.</article><footer><p><a>-4</a><p>-6.</footer>",
    # names mislead: prose in sections with such names, and what deserves them
    "<article><h1>+4</h1><p>+30.<section class='sponsored-research'><h2>+3</h2><p>+26.<p>+31.<p>+2.</section><p>+22.</article><footer>-9.</footer>",
    "<article><h1>+5</h1><p>+28.<div class='share-price'><p>+24.</div><p>+35.<div class='share-buttons'>-3</div><p>+1.</article>",
    "<main><h1>+3</h1><section id=social><h2>+2</h2><p>+27.<p>+33.</section><section><p>+25.</section><section class=social><ul><li><a>-1</a><li><a>-2</a></ul></section></main>",
    "<main><section class='related-work'><h2>+2</h2><p>+41.<p>+3.<p>+38.</section><section><h2>+1</h2><p>+50.</section><section class=related><h2>-2</h2><p><a>-6</a><p><a>-8</a></section></main>",
    "<article><h1>+6</h1><p>+44.<div class='subscribe popup'><h3>-3</h3><p>-14.<p>-9.</div><p>+39.<div class=promo><h3>-2</h3><p>-12. <a>=3</a></div><p>+3.</article>",
    "<article><h1>+4</h1><div class='sponsored section'><p>+29.<p>+48.</div><div class=sponsored><p>-11 <a>=4</a></div><div class='ad slot'>-16.</div><p>+21.</article>",
    "<article><p>+32.<div class='newsletter-history'><h2>+3</h2><p>+37.<p>+1.<p>+45.</div><div class=newsletter><p>-15.<p>-4</div></article>",
    "<main><h1>+5</h1><p>+36.<div class='popup-book'><p>+42.<p>+23.</div><div class='replies'><p>-38.<p>-27.<p>-3.</div><div class='comment-list'><p>-44.<p>-2.</div></main>",
    "<article><p>+26.<div class=related><h3>-3</h3><p>-5 <a>=7</a><p>-4 <a>=9</a></div><p>+47.<div class=sidebar><p>-13.<p>-7.</div></article>",
    # forms that hold the page, and forms on it
    "<form id=main-form><div>-3</div><div class=menu><a>-2</a></div><div><h1>+5</h1><p>+40.<p>+3.<p>+36.</div><div>-4</div></form>",
    "<form><nav><a>-2</a><a>-1</a></nav><article><h1>+4</h1><p>+31.<p>+2.</article><footer>-8.</footer></form>",
    "<form><h1>+4</h1><p>+28.<p>+33.<p>+1.<p>+24.</form><footer>-6.</footer>",
    "<h1>+4</h1><p>+30.<p>+28.<form><p>-12.<label>-2</label><p>-3</form>",
    "<article><h1>+2</h1><p>+9.</article><form><h2>-2</h2><p>-30.<p>-22.</form>",
    # flat pages: a block's own words, and the links of the blocks beside it
    "<p><a>-3</a><p>-4.<p><a>-2</a><p>+40.<p><a>-5</a><p>-6.<p><a>-3</a><p>+38.<p><a>-4</a><p>-5.<p><a>-2</a>",
    "<p><a>-6</a><p>+33.<p><a>-4</a><p>-3.<p><a>-7</a><p>+27.<p><a>-3</a><p>-5.<p><a>-4</a>",
    "<p><a>-3</a><p>-9<p><a>-4</a><p>+36.<p>+3.<p>+52.<p>+29.<p><a>-6</a><p>-8<p><a>-5</a>",
    "<p><a>-2</a><p>-6.<p><a>-1</a><p>-7.<p><a>-2</a><h1>+5</h1><p>+33.<p>+27.<p>+44.<p>+2.<p>+31.",
    "<h1>+6</h1><p>+34.<p>+9.<p>+28.<p><a>-4</a><p>-9.<p><a>-3</a><p>-8.<p><a>-7</a>",
    "<div>-4</div><div>-11.</div><div><a>-3</a></div><div>-10.</div><div><a>-2</a></div><div>+58.</div><div>+11.</div><div>+63.</div><div><a>-4</a></div><div>-12.</div><div><a>-4</a></div>",
    "<ul><li><a>-2</a><li>-4<li><a>-3</a></ul><p>+30.<ul><li>+4<li>+6.<li>+2</ul><p>+26.<ul><li><a>-4</a><li>-3<li><a>-2</a></ul>",
    # neither tags nor names: words and links of a block, its neighbours and its container
    "<body><ul><li><a>-1</a><li><a>-5</a></ul><h1>+4</h1><p>+17.<p>+18.<p><a>-2</a> <a>=2</a><p><a>-9</a>",
    "<body><p>-2<div><p>+17.<p>+19.</div><p><a>-1</a>",
    "<body><div>-3</div><div>-3.</div><div><h1>+5</h1><p>+44.<p>+2.<ul><li>+4<li>+2<li>+9</ul><p>+27.<p>+1.</div><div>-3</div><div>-5.</div>",
    "<div>-4</div><div><a>-1</a> <a>=1</a> <a>=2</a></div><div><h1>+6</h1></div><div><p>+38.</div><div><p>+41.</div><div><p>+29.</div><div>-4</div><div>-6.</div>",
    "<div>-2</div><div>-9.</div><div>+52.</div><div>+61.</div><div>+45.</div><div>-3</div>",
    "<div><div>-2</div><div><p>+23.<h2>+3</h2><p>+34.<p>+4.<p>+21 <a>=6</a> =9.</div><div><p><a>-7</a><p><a>-6</a><p><a>-8</a></div></div><div>-7.</div>",
    "<div><h1>+4</h1><p>+50.<p>+33.</div><div><h2>+2</h2><p>+41.<p>+2.<p>+27.</div><div><h2>+3</h2><p>+38.</div><div><p>-4</div><div>-3.</div>",
    "<section><h2>+5</h2><p>+22.<p>+70.</section><section><h2>+1</h2><p>+31.<p>+1.<ul><li>+3<li>+12.</ul><p>+19.</section><section><ul><li><a>-3</a><li><a>-4</a></ul></section>",
    "<div><p>-4</div><div><p>+18.<p>+24.<p>+11.<p>+2.<p>+30.</div><div><p>-5.</div><div>-2</div>",
    "<div>-6</div><div>-2</div><div><p>+100.</div><div><p>+72.</div><div>-5.</div><div>-3</div>",
    "<div>-8.</div><div>+66.</div><div>+20.</div><div>+31.</div><div>-7</div><div><a>-4</a></div>",
    "<p><a>-1</a><p><a>-3</a><h2>+4</h2><p>+12.<p>+9 <a>=1</a>.<p>+1.<p>+24.<p><a>-5</a>",
    "<div><h2>+6</h2><p>+36.<p><a>-4</a><p>+27.<p>+3.<p><a>-7</a></div>",
    "<ul><li><a>-2</a><li><a>-2</a><li><a>-1</a></ul><p>+55.<p>+2.<ul><li>+6<li>+11.</ul><p>+48.<ul><li><a>-5</a><li><a>-3</a></ul>",
    "<div><p>-3.</div><div><h1>+7</h1><p>+80.<p>+1.<p>+3.<p>+95.</div><div><h3>-2</h3><ul><li><a>-6</a><li><a>-4</a><li><a>-5</a></ul></div>",
    "<table><tr><td><p><a>-1</a><p><a>-2</a></td><td><h1>+5</h1><p>+31.<p>+26.<p>+2.</td></tr></table><div>-4</div>",
    "<p>+46.<p>+3.<p>+52.<h2>+2</h2><p>+1.<ol><li>+4.<li>+2.</ol><p>+38.",
    "<h1>+3</h1><p>+20.<p>+2.<ul><li><a>-2</a><li><a>-3</a></ul><p>+35.<ul><li>+3<li>+8</ul>",
    "<h1>+6</h1>+25.<h2>+2</h2>+30.<div><a>-2</a> <a>=1</a></div>",
    "<div>-4</div><div><h1>+5</h1><div>+33.</div><div>+27.</div><ul><li>+3<li>+4</ul></div><div><p>-4<p>-6</div><div>-8.</div>",
    "<div>-1</div><div>-2</div><div>-3</div><div><p>+64.<p>+5.<dl><dt>+2<dd>+11.</dl></div><div>-5.</div><div>-2</div>",
    "<div><ul><li>-1<li>-2<li>-1</ul></div><div><h1>+4</h1><p>+58.<p>+49.</div><div><h3>-2</h3><p>-5</div>",
    "<nav><a>-2</a></nav><h1>+4</h1><p>+2.<p>+33.<p>+1.<form><p>-9.</form><aside>-22.</aside><footer>-19.</footer>",
    "<header>-6.</header><div><h2>+5</h2><p>+30.<p>+3.</div><footer><p>-4<p>-25.</footer>",
    "<header><h1>-2</h1></header><section><h1>+4</h1><p>+29.<p>+1.<p>+32.</section><section><h2>+3</h2><p>+40.<p>+26.</section><footer>-8</footer>",
    "<div><a>-3</a></div><div><a>-2</a></div><nav>-8.</nav><div class=sidebar>-40.</div><p>+15.<p>+22.",
)
FILL = re.compile(r"([-+=])(\d+)(\.?)")


def labelled_tree() -> Tree:
    """The tree trained on the labelled table."""
    fill = lambda m: m[1].strip("=") + " ".join(["words"] * int(m[2])) + m[3]
    x, y = [], []
    for page in LABELLED:
        blocks, elements = blocks_of(FILL.sub(fill, page))
        x.append(features(blocks, elements))
        y += [b.text.startswith("+") for b in blocks]
    return grow(np.concatenate(x), np.array(y, float))


def main_text(html: str, tree: Tree) -> str:
    blocks, elements = blocks_of(html)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, y in zip(blocks, tree.predict(features(blocks, elements)), strict=True) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    tree = labelled_tree()
    rows = small_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                texts = [main_text(x or "", tree) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
