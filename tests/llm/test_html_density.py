"""Density decides what is content: against brute force, on pages without semantic tags and with misleading names."""

import random
from html.parser import HTMLParser
from math import e, log

import pytest

from trajmill.llm import htmltext

LONG = "A paragraph with quite a few words in it, so that it is dense enough for an article, and then some more of them."
MENU = "<div>" + "".join(f"<span><a href='{i}'>Entry {i}</a></span>" for i in range(12)) + "</div>"


class Tree(HTMLParser):
    """Nested lists: [tag, child, ...]; a child is such a list or a text."""

    def __init__(self, html):
        super().__init__()
        self.stack = [["html"]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.stack[-1].append([tag])
        self.stack.append(self.stack[-1][-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1].append(data)


def counts(node, linked=False):
    """characters, tags, characters in links, links below a node."""
    linked = linked or node[0] == "a"
    c = t = lc = lt = 0
    for x in node[1:]:
        if isinstance(x, str):
            c, lc = c + len(" ".join(x.split())), lc + linked * len(" ".join(x.split()))
        else:
            a, b, d, f = counts(x, linked)
            c, t, lc, lt = c + a, t + b + 1, lc + d, lt + f + (x[0] == "a")
    return c, t, lc, lt


def brute(node, share, linked=False):
    """(density, density sum) of every node, in document order."""
    def density(c, t, lc, lt):
        if not c:
            return 0.0
        return c / max(t, 1) * log(max(1.0, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / log(1 + log(c / max(c - lc, 1) * lc + share * c + e))

    c, t, lc, lt = counts(node, linked)
    linked = linked or node[0] == "a"
    own = sum(len(" ".join(x.split())) for x in node[1:] if isinstance(x, str))
    below = [brute(x, share, linked) for x in node[1:] if not isinstance(x, str)]
    total = sum(b[0][0] for b in below) + (0.0 if linked else density(own, 1, 0, 0))
    return [(density(c, t, lc, lt), total)] + [x for b in below for x in b]


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        words = " ".join("word" for _ in range(rng.randint(1, 40)))
        if kind < 0.25 and depth < 5:
            out += f"<div>{page(rng, depth + 1)}</div>"
        elif kind < 0.5:
            out += f"<span><a>{words}</a></span>"
        else:
            out += f"<div>{words} <b>{words}</b></div>"
    return out


@pytest.mark.parametrize("seed", range(30))
def test_densities_by_brute_force(seed):
    html = page(random.Random(seed))
    own = htmltext.Page(html)
    dense, sums, _ = own.densities(own.out)
    tree = Tree(html).stack[0]
    c, _, lc, _ = counts(tree)
    want = brute(tree, lc / max(c, 1))
    assert [pytest.approx(x) for x in zip(dense, sums)] == want


def plain(text):
    return f"<body><div>{MENU}<div><h2>Title</h2><p>{text} One.</p><p>Short.</p><p>{text} Two.</p></div>{MENU}<div><span>Follow</span><span>us</span></div></div></body>"


def test_without_semantic_tags():
    assert htmltext.main_text(plain(LONG)) == f"Title\n{LONG} One.\nShort.\n{LONG} Two."


def test_density_decides(monkeypatch):
    monkeypatch.setattr(htmltext, "density", lambda *_: 1.0)
    assert htmltext.main_text(plain(LONG)) != f"Title\n{LONG} One.\nShort.\n{LONG} Two."


@pytest.mark.parametrize("name", ["sidebar", "comment", "promo banner", "ad", "footer"])
def test_misleading_names(name):
    assert htmltext.main_text(plain(LONG).replace("<div><h2>", f"<div class='{name}'><h2>")) == f"Title\n{LONG} One.\nShort.\n{LONG} Two."


def test_article_tag_alone_makes_no_content():
    """An <article> of links is no content, the plain text beside it is."""
    assert htmltext.main_text(f"<body><article>{MENU}</article><div><p>{LONG} One.</p><p>{LONG} Two.</p></div></body>") == f"{LONG} One.\n{LONG} Two."


def test_sections():
    sections = f"<section><h2>First</h2><p>{LONG} 1.</p><p>{LONG} 2.</p><p>{LONG} 3.</p></section><section><h2>Second</h2><p>{LONG} 4.</p><p>Ends.</p></section>"
    want = "\n".join(["Head", "First", f"{LONG} 1.", f"{LONG} 2.", f"{LONG} 3.", "Second", f"{LONG} 4.", "Ends."])
    for wrapper in ("article", "div", "main"):
        assert htmltext.main_text(f"<body><nav><a href=1>Home</a><a href=2>About</a></nav><{wrapper}><h1>Head</h1>{sections}</{wrapper}><footer>nobody</footer></body>") == want


def test_unnamed_advert_beside_the_article():
    assert htmltext.main_text(f"<body><div>Buy this now, it is cheap and good, really.</div><div><p>{LONG} 1.</p><p>{LONG} 2.</p><p>{LONG} 3.</p></div></body>") == f"{LONG} 1.\n{LONG} 2.\n{LONG} 3."


def test_no_rows(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, text string")
    assert htmltext.extract_pages(df).count() == 0


def test_advert_longer_than_the_article():
    assert htmltext.main_text("<body><div class='ad'>An advert with far more text than the article has, by a good deal.</div><article><h1>Small.</h1><p>Small.</p></article></body>") == "Small.\nSmall."
