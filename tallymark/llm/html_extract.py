"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = 128

# Elements of HTML by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "textarea", "title", "object", "canvas", "audio", "video", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ASIDE = {"nav", "footer", "aside", "button", "select", "option", "datalist", "dialog", "menu", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PARAGRAPHS = HEADINGS | {"p", "pre", "blockquote", "li", "dt", "dd", "td", "th", "figcaption", "caption", "summary"}
BLOCKS = PARAGRAPHS | {
    "html", "body", "main", "article", "section", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "header",
    "footer", "nav", "aside", "form", "figure", "fieldset", "address", "details", "hr", "center", "hgroup", "search", "head", "menu", "dialog"}
# What a start tag closes, and up to which elements it looks for it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "div", "main", "td", "th", "blockquote"}
# Names in class and id, and roles, of what is mostly no article; a name may add where or what kind of box it is.
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar rail menu menubar nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist discussion disqus respond "
    "replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending widget toolbar pagination pager "
    "skip copyright disclaimer form search hidden".split())
BOX_NAMES = set(
    "area bar block bottom box button buttons container icons inner item items left links list only posts right section site slot sr "
    "top unit visually wrap wrapper".split())
# What readers say: such an element may hold more text than the article.
VOICES = set("comment comments commentlist discussion disqus respond replies reply".split())
# A name with one of these tells something of the layout: has-sidebar, overflow-hidden.
LAYOUT = {"has", "with", "no", "without", "overflow"}
NONE, WEAK, STRONG, VOICE = range(4)
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}

# One step through a page: a comment or declaration, a tag with its attributes, or text up to the next of them.
# A quote opens a value only after "="; one that is never closed opens nothing.
STEP = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|(?P<text>[^<]+|<)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME = re.compile(r"[a-z0-9]+")
# Letters with an accent, digits and so on count as one code point each, commas of other scripts as commas.
COMMA = re.compile("[,،、，]")


def is_aside(tag: str, found: dict[str, str], in_article: bool) -> bool:
    """Whether an element is no part of an article, by its kind or role, or because it is hidden."""
    if tag in ASIDE or tag == "header" and not in_article:
        return True
    if not found or tag in ("html", "body", "main"):
        return False
    style = found.get("style", "").replace(" ", "")
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return found.get("role") in ASIDE_ROLES


def suspicion(tag: str, found: dict[str, str], in_article: bool) -> int:
    """How surely the names of an element tell that it is no part of an article.

    A whole class or id of nothing but names of asides is strong, one that only contains such a name is weak.
    """
    worst = STRONG if tag == "form" or found.get("role") == "form" else NONE
    if tag in ("html", "body", "main"):
        return NONE
    for name in (found.get("class", "") + " " + found.get("id", "")).split():
        parts = {x for x in NAME.findall(name) if not x.isdigit()}
        hits = parts & (ASIDE_NAMES - {"header"} if in_article else ASIDE_NAMES)
        if hits and not parts & LAYOUT:
            worst = max(worst, WEAK if parts - ASIDE_NAMES - BOX_NAMES else VOICE if hits & VOICES else STRONG)
    return worst


class Page:
    """Elements of a page in document order, and its text blocks outside of asides.

    What only a name or a form makes suspect is read too; :meth:`show` leaves out what it is given.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.skip, self.article = ["html"], [-1], [False], [False]
        self.suspect = [NONE]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, code points in links
        self._read_blocks: list[tuple[int, list[tuple[int, str, int]]]] = []  # element, its texts by the element they stand in
        self.headers: list[int] = []  # of a main, outside of any article
        self._stack, self._parts, self._links = [0], [], 0
        # Places in the stack of the open blocks, the inline elements open in each by tag, and all open blocks by tag.
        self._open_blocks, self._inline, self._count = [0], [Counter()], Counter(["html"])
        self._read(source)
        self.show(set())

    def show(self, dropped: set[int]) -> None:
        """Sets ``blocks`` to the text outside of the elements ``dropped``."""
        gone = [False] * len(self.tag)
        for i in range(len(self.tag)) if dropped else ():
            gone[i] = i in dropped or self.parent[i] >= 0 and gone[self.parent[i]]
        self.blocks = []
        for owner, parts in self._read_blocks:
            shown = [x for x in parts if not gone[x[0]]]
            text = " ".join("".join([x[1] for x in shown]).split())
            if text:
                self.blocks.append((owner, text, min(sum(x[2] for x in shown), len(text))))

    def named_asides(self) -> tuple[set[int], list[int]]:
        """The suspect elements that are menus or boxes, and the unlinked code points of every element.

        One that holds every article, main or first heading of the page and half of its text holds the article; so does one
        with nine tenths of a page that has none of them. A weak name counts only where half of the text is links.
        """
        headers = set(self.headers) if "article" in self.tag else set()
        if not any(self.suspect) and not headers:
            return set(), []
        count = len(self.tag)
        size, linked, marks = [0] * count, [0] * count, [0] * count
        for _, parts in self._read_blocks:
            for node, text, links in parts:
                size[node] += len("".join(text.split()))
                linked[node] += links
        for node in range(count - 1, -1, -1):
            marks[node] += size[node] > 0 and self.tag[node] in ("article", "main", "h1")
            if node:
                for x in (size, linked, marks):
                    x[self.parent[node]] += x[node]
        plain = [n - k for n, k in zip(size, linked)]
        named = headers
        for node, kind in enumerate(self.suspect):
            share = plain[node] / max(plain[0], 1)
            if kind == NONE or kind == WEAK and 2 * linked[node] < max(size[node], 1):
                continue
            if marks[0] and marks[node] == marks[0] and share >= 0.5 or not marks[0] and kind != VOICE and share >= 0.9:
                continue
            named.add(node)
        return named, plain

    def _flush(self) -> None:
        if self._parts:
            self._read_blocks.append((self._stack[self._open_blocks[-1]], self._parts))
        self._parts = []

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._parts.append((self._stack[-1], " ", 0))
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in BLOCKS:
            self._flush()
            self._close_within({"p"}, SCOPE)
            self._close_within(CLOSES.get(tag, set()), SCOPE - ({"td", "th"} if tag in ("tr", "td", "th") else set()))
        top = self._stack[-1]
        self.tag.append(tag)
        self.parent.append(top)
        self.article.append(self.article[top] or tag in ("article", "main"))
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTR.finditer(attrs)} if attrs else {}
        self.skip.append(self.skip[top] or is_aside(tag, found, self.article[top]))
        self.suspect.append(suspicion(tag, found, self.article[top]))
        if tag == "header" and self.article[top] and not self.inside_article(top):
            self.headers.append(len(self.tag) - 1)
        self._stack.append(len(self.tag) - 1)
        self._links += tag == "a"
        if tag in BLOCKS:
            self._open_blocks.append(len(self._stack) - 1)
            self._inline.append(Counter())
            self._count[tag] += 1
        else:
            self._inline[-1][tag] += 1

    def inside_article(self, node: int) -> bool:
        while node >= 0 and self.tag[node] not in ("article", "main"):
            node = self.parent[node]
        return node >= 0 and self.tag[node] == "article"

    def _pop_to(self, depth: int) -> None:
        """Closes all elements from a place of the stack on: each is looked at once in its life."""
        while len(self._stack) > depth:
            tag = self.tag[self._stack.pop()]
            self._links -= tag == "a"
            if tag in BLOCKS:
                self._open_blocks.pop()
                self._inline.pop()
                self._count[tag] -= 1
            else:
                self._inline[-1][tag] -= 1

    def _close_within(self, tags: set[str], scope: set[str]) -> None:
        """Closes the innermost of ``tags`` up to the first of ``scope``, looking at blocks only, and only if one is open."""
        if any(self._count[t] for t in tags):
            for i in range(len(self._open_blocks) - 1, 0, -1):
                depth = self._open_blocks[i]
                tag = self.tag[self._stack[depth]]
                if tag in tags:
                    return self._pop_to(depth)
                if tag in scope or tag not in PARAGRAPHS and tag != "tr":
                    return None

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._parts.append((self._stack[-1], " ", 0))
        # An inline end tag does not close the block it stands in, and an end tag of what is not open closes nothing.
        if not (self._count[tag] if tag in BLOCKS else self._inline[-1][tag]):
            return
        depth = len(self._stack) - 1
        while depth > 0 and self.tag[self._stack[depth]] != tag:
            depth -= 1
        if depth:
            if tag in BLOCKS:
                self._flush()
            self._pop_to(depth)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            step = STEP.match(source, at)
            at = step.end()
            if step["tag"]:
                tag = step["tag"].lower()
                if step["end"]:
                    self._close(tag)
                elif tag in RAW:
                    if not step["attrs"].endswith("/") or tag in ("script", "style"):
                        close = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
                        at = close.end() if close else end
                else:
                    self._open(tag, step["attrs"])
            elif step["text"] and not self.skip[self._stack[-1]]:
                text = html.unescape(step["text"])
                self._parts.append((self._stack[-1], text, len("".join(text.split())) if self._links else 0))
        self._flush()


def best_nodes(page: Page) -> set[int]:
    """The container with the highest score, and those siblings that belong to it."""
    count = len(page.tag)
    points, size, linked = [0.0] * count, [0] * count, [0] * count
    for owner, text, links in page.blocks:
        size[owner] += len(text)
        linked[owner] += links
        if page.tag[owner] in HEADINGS:
            continue
        worth = (1 + len(COMMA.findall(text)) + min(len(text) / 100, 3)) * (1 - links / len(text))
        node = page.parent[owner] if page.tag[owner] in PARAGRAPHS and page.parent[owner] >= 0 else owner
        for level in range(5):  # in full to the container, half to the next, then less and less
            points[node] += worth / (1 if level == 0 else 2 * level)
            node = page.parent[node]
            if node < 0:
                break
    for node in range(count - 1, 0, -1):
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    score = [p * (1 - k / s) if s else 0.0 for p, k, s in zip(points, linked, size)]
    best = max(range(count), key=lambda i: (score[i], -i))
    if score[best] <= 0:
        # Headings alone, or links alone: whatever stands in the first article, else in the page.
        best = next((i for i in range(count) if page.tag[i] in ("article", "main") and size[i]), 0)
    node = best
    while node > 0:  # an article around the best container is the container
        if page.tag[node] in ("article", "main"):
            best = node
            break
        node = page.parent[node]
    kept = {best}
    if page.parent[best] >= 0:
        # Where the best container holds one paragraph alone, its neighbours that hold plain paragraphs are more of the same.
        held = [0] * count
        for owner, _, _ in page.blocks:
            held[owner] += page.tag[owner] in PARAGRAPHS
        for node in range(count - 1, 0, -1):
            held[page.parent[node]] += held[node]
        single = page.tag[best] not in ("article", "main") and held[best] == 1
        for node in range(1, count):
            if page.parent[node] == page.parent[best] and size[node]:
                plain = linked[node] < 0.25 * size[node] and (page.tag[node] in PARAGRAPHS or single and held[node])
                if score[node] >= 0.2 * score[best] > 0 or plain:
                    kept.add(node)
    return kept


def article_text(page: Page, dropped: set[int]) -> str:
    """The article of a page without the elements ``dropped``, blocks joined by an empty line."""
    page.show(dropped)
    if not page.blocks:
        return ""
    kept, inside = best_nodes(page), [False] * len(page.tag)
    for node in range(len(page.tag)):
        inside[node] = node in kept or page.parent[node] >= 0 and inside[page.parent[node]]
    return "\n\n".join(text for owner, text, _ in page.blocks if inside[owner])


def main_text(source: str | None) -> str:
    """The article of a page; empty for null, empty or textless pages.

    Where a page without article and first heading has lost most of its text to a name or a form, or all of its text, what
    holds the most of that is read; what readers say only if nothing else is there.
    """
    page = Page(source or "")
    named, plain = page.named_asides()
    text = article_text(page, named)
    back = [i for i in named if not text or page.suspect[i] != VOICE]
    most = max((plain[i] for i in back), default=0)
    if most > 5 * len(text) and (not text or not any(page.article[owner] or page.tag[owner] == "h1" for owner, _, _ in page.blocks)):
        text = article_text(page, named - {i for i in back if 2 * plain[i] >= most})
    return text


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in ``text_col`` instead of the html; one row per row, no shuffle.

    Paragraphs pass points for length and commas to their ancestors, less the share of their text that is links; the best
    container is kept with siblings of a fifth of its score and plain paragraphs beside it, which may stand in containers
    of their own if the best one holds a single paragraph. Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left out by element, role and name; a form or a
    name alone does not if the element holds the article (see :meth:`Page.named_asides`, :func:`main_text`). A null or
    empty page, or one without text, gives an empty string. Other columns are kept; an input column ``text_col`` is
    replaced. Every element is opened and closed once, whatever is left open, so time and memory grow with the page.
    """
    kept = [c for c in pages.columns if c not in (html_col, text_col)]
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = pa.array([main_text(x.as_py()) for x in part[html_col]], pa.string())
                yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], texts], [*kept, text_col])

    return pages.select(*kept, html_col).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], f"`{text_col}` string"]))
