"""Main text of web pages by composite text density.

A node's density is its characters per tag, raised where few of them are in links and lowered where many are. A node's
density sum adds up its children's densities (and that of text directly in it). The node with the largest sum is the heart
of the article and content as a whole. The threshold is the least density on the path from the heart up to the body, menus
and all, between those of a few plain words and of a plain sentence. Subtrees beside that path, inside the heart's wrappers, are content if they
reach the threshold, and so are the short paragraphs and headings without links next to them; subtrees beside the wrapper,
directly in the body, also need a density sum of RIVAL times the heart's.

No tag makes a node content: <article> and <main> are wrappers like any other. Elements that say that they are not
(navigation, forms, adverts, notices, comments and so on, by tag, role, class or id) are taken out before the heart is
sought, but for names that would take out most of the page's plain text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from trajmill.llm.common import slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What a start tag ends, if it is open above the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_OUT_TAGS = {"nav", "aside", "footer", "menu", "dialog", "button", "select", "svg", "canvas", "object", "head", "search", "audio", "video", "map"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|sidebar|side-?bar|rail|ad|ads|adv|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|notification|"
    r"popup|modal|overlay|newsletter|subscri\w+|signup|sign-up|login|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|comments?|commentlist|comment-\w+|respond|replies|"
    r"disqus\w*|widget\w*|toolbar|masthead|site-header|page-header|site-footer|page-footer|footer|copyright|skip-link|search-?\w*|outbrain|taboola)(?:$|[\s_\d-])", re.I)  # fmt: skip
_THREADS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|comment-\w+|respond|replies|disqus\w*)(?:$|[\s_\d-])", re.I)
#: Blocks that may be short, and stay with content beside them if they have no link.
_TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "hr", "br"}
#: The threshold is held between the densities of so many plain characters; the share of the heart's density sum that makes a block beside its wrapper another article.
PLAIN, RIVAL = (15, 40), 0.25
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """The composite density of an element; share: of the page's characters that are in links."""
    if not chars:
        return 0.0
    base = log(chars / max(chars - link_chars, 1) * link_chars + share * chars + e)
    return chars / max(tags, 1) * log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1.0)) / log(base + 1)


class Page:
    """A page's elements in document order, and its text in order with the breaks between blocks."""

    def __init__(self, html: str):
        self.tag, self.parent, self.out, self.raw = ["html"], [-1], [False], [False]
        self.named: list[int] = []  # elements that class or id would take out
        self.threads: set[int] = set()  # of these, those that are named for readers' comments
        self.events: list[tuple[int, str | None]] = []  # (element, text), or None for a break
        stack, at = [0], 0
        open_: dict[str, int] = {"html": 1}
        while at < len(html):
            m = _TOKEN.search(html, at)
            self._text(stack[-1], html[at : m.start() if m else len(html)])
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(stack, open_, name)
                continue
            if name in ("html", "body") and open_.get(name):
                continue
            self._make_room(stack, open_, name)
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.raw.append(self.raw[stack[-1]] or name in _RAW or name == "head")
            self.out.append(self.out[stack[-1]] or self._is_out(name, m[3] or "", open_))
            if not self.out[node] and self._is_named(name, m[3] or ""):
                self.named.append(node)
                if self._is_named(name, m[3] or "", _THREADS):
                    self.threads.add(node)
            if name in _BLOCK or name == "br":
                self.events.append((node, None))
            if name in _RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
                self.out[node] = True
            elif name not in _VOID:
                stack.append(node)
                open_[name] = open_.get(name, 0) + 1

    def _text(self, node: int, raw: str) -> None:
        if raw:
            self.events.append((node, unescape(raw) if "&" in raw else raw))

    def _pop(self, stack: list[int], open_: dict[str, int]) -> str:
        name = self.tag[stack.pop()]
        open_[name] -= 1
        if name in _BLOCK:
            self.events.append((stack[-1], None))
        return name

    def _close(self, stack: list[int], open_: dict[str, int], name: str) -> None:
        if name in ("html", "body") or not open_.get(name):
            return  # what follows the body's end still belongs to it
        while self._pop(stack, open_) != name:
            pass

    def _make_room(self, stack: list[int], open_: dict[str, int], name: str) -> None:
        if name in _BLOCK and open_.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] == "p":
                    while self._pop(stack, open_) != "p":
                        pass
                    break
                if self.tag[stack[i]] in _BLOCK:
                    break
        ended, within = _ENDS.get(name, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in ended:
                while len(stack) > i:
                    self._pop(stack, open_)
                break
            if self.tag[stack[i]] in within or not ended:
                break

    def _is_out(self, name: str, attributes: str, open_: dict[str, int]) -> bool:
        inside = bool(open_.get("article") or open_.get("main"))
        if name in _OUT_TAGS or (name == "header" and not inside):
            return True
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _OUT_ROLES or _HIDDEN.search(found.get("style", "")):
            return True
        return False

    def _is_named(self, name: str, attributes: str, names: re.Pattern = _OUT_NAMES) -> bool:
        if name in ("html", "body", "article", "main") or not attributes.strip():
            return False
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        return any(names.search(unescape(found[k])) for k in ("class", "id") if k in found)

    def _marked(self) -> list[int]:
        """Elements that say where the article is. Each comment of a thread may be an article of its own: such elements count only where
        none lies outside of threads, and then those around or in the element of the largest density sum."""
        marked = [i for i, name in enumerate(self.tag) if name in ("article", "main", "h1") and not self.out[i]]
        if not self.threads:
            return marked
        thread = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            thread[i] = thread[self.parent[i]] or (i if i in self.threads else 0)
        if outside := [i for i in marked if not thread[i]]:
            return outside
        sums = self.densities(self.out)[1]
        heart = max(range(len(self.tag)), key=lambda i: (sums[i], -i))
        return [i for i in marked if thread[i] == thread[heart]]

    def forms_out(self) -> None:
        """A form, and what class or id name so, is out, unless the article is in it. Where no tag says where the article is,
        a name takes out no element with most of the page's text outside links either."""
        holds = set()
        for i in self._marked():
            while i >= 0 and i not in holds:
                holds.add(i)
                i = self.parent[i]
        if self.named:
            linked, chars = [False] * len(self.tag), [0] * len(self.tag)
            for i in range(1, len(self.tag)):
                linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
            for i, text in self.events:
                if text is not None and not self.out[i] and not linked[i]:
                    chars[i] += len(" ".join(text.split()))
            for i in range(len(self.tag) - 1, 0, -1):
                chars[self.parent[i]] += chars[i]
            for i in self.named:
                self.out[i] |= i not in holds and (bool(holds) or 2 * chars[i] <= chars[0])
        for i, name in enumerate(self.tag):
            self.out[i] |= (name == "form" and i not in holds) or (i > 0 and self.out[self.parent[i]])

    def densities(self, out: list[bool]) -> tuple[list[float], list[float], list[int]]:
        """The density, the density sum and the characters in links of every element; those that are out count for nothing."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags, own, linked = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            linked[i] = linked[self.parent[i]] or self.tag[i] == "a"
        for i, text in self.events:
            if text is not None and not out[i]:
                own[i] += len(" ".join(text.split()))
        for i in range(n - 1, -1, -1):
            chars[i] += own[i]
            link_chars[i] += own[i] if linked[i] else 0
            if i and not out[i]:
                up = self.parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i] + (self.tag[i] == "a")
        share = link_chars[0] / max(chars[0], 1)
        dense = [0.0 if out[i] else density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
        sums = [0.0 if linked[i] or out[i] else density(own[i], 1, 0, 0, share) for i in range(n)]
        for i in range(1, n):
            sums[self.parent[i]] += dense[i]
        return dense, sums, link_chars

    def content(self) -> tuple[list[bool], set[int]]:
        """Which elements belong to the article, and others of which only the text directly in them does."""
        n = len(self.tag)
        whole = self.densities(self.raw)[0]
        self.forms_out()
        dense, sums, link_chars = self.densities(self.out)
        heart = max(range(n), key=lambda i: (sums[i], -i))
        path = [heart]
        while self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        few, many = (density(n, 1, 0, 0, 0.0) for n in PLAIN)
        threshold = max(few, min(many, *(whole[i] for i in path)))
        page = [i for i in path if self.tag[i] in ("html", "body")]
        children: dict[int, list[int]] = {i: [] for i in path}
        for i in range(1, n):
            if self.parent[i] in children and not self.out[i]:
                children[self.parent[i]].append(i)
        chosen, own, on_path = set() if heart in page else {heart}, {i for i in path if i not in page or i == heart}, set(path)
        best = list(range(n))  # the element of the largest sum in each subtree
        for i in range(n - 1, 0, -1):
            if (sums[best[i]], -best[i]) > (sums[best[self.parent[i]]], -best[self.parent[i]]):
                best[self.parent[i]] = best[i]
        open_ = {}  # subtrees below the threshold, with the element on the path that they are beside
        for up in path if heart in page else path[1:]:
            beside = [i for i in children[up] if i not in on_path]
            rival = RIVAL * sums[heart] if up in page and up != heart else 0.0
            near = {i for i in beside if dense[i] >= threshold and sums[best[i]] >= rival}
            chosen |= near
            if not rival:
                if near or up != heart or heart in page:
                    chosen.update(i for i in beside if self.tag[i] in _TEXTUAL and not link_chars[i])
                open_.update((i, up) for i in beside if i not in chosen)
        for i in range(1, n):  # parts of them may reach it
            if (up := open_.get(self.parent[i])) is not None and not self.out[i]:
                if dense[i] >= threshold and self.tag[i] != "a":
                    chosen.add(i)
                else:
                    open_[i] = up
        kept = [False] * n
        for i in range(n):
            kept[i] = not self.out[i] and (i in chosen or (i > 0 and kept[self.parent[i]]))
        return kept, own

    def text(self) -> str:
        kept, own = self.content()
        blocks, run = [], []
        for i, text in [*self.events, (0, None)]:
            if text is None:
                if block := " ".join("".join(run).split()):
                    blocks.append(block)
                run = []
            elif kept[i] or i in own:
                run.append(text)
        return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return Page(html).text() if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row's main text.

    Blocks are joined by one line feed, white space inside a block is one space, character references are decoded. A null
    or empty page has an empty text; so has one without text. Pages cut short end where they end. Of elements of one density
    sum the first is the heart. Rows that share a page_id have a result each. Other columns are ignored. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint")
