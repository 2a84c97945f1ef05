"""Main text of web pages by tree scoring.

The page becomes a tree of elements (end tags that HTML implies are supplied).
Each block of text earns points for its length and commas; its container gets
them in full, the next ancestor half, those above a third, a quarter ... down
to a ``REACH``-th.  A container's points are discounted by the share of its text that is in links.
The best container wins, widened to the article or main element around it,
and siblings of like score are kept with it.  Menus, headers, footers, asides,
forms, notices, adverts, scripts and reader comments are cut by element, role
and class words before scoring and so earn nothing.  An element whose class
names content (post, article-body) is not cut for a compound that only has a
furniture word in it (long-form); should class words leave a page no text at
all, only classes that consist of such words count.  Nameless lists of links
are left out beside an article, never inside one.

Cases: null or empty html and pages without text give an empty string; broken
markup is read as far as it goes; long and deep pages cost linear time, and
batches are cut by bytes; rows are independent, so repeated rows need no care;
columns other than ``html`` and ``keep`` are not read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm.words import giving_back, slices

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form fieldset button select option input dialog menu svg math canvas object audio video map head datalist template".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion promoted promos banner nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot colophon sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert popup popups modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations recirculation pagination pager comment comments commentlist disqus respond reply replies discussion form search skip copyright legal disclaimer toolbar paywall".split()
)
KEPT_WORDS = frozenset("article entry post story content body main text".split())
#: Words that make a compound a state or a kind of content, not furniture: has-sidebar, long-form, share-enabled.
FIRST_WORDS, LAST_WORDS = frozenset("has with without no is long short free".split()), frozenset("enabled disabled".split())
#: Ancestors that a block's points reach.
REACH = 32
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: Open elements that a start tag closes.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
WORDS = re.compile(r"[A-Za-z][a-z]*+")


def _words(token: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(token)]


def _named_unwanted(token: str) -> bool:
    """Whether one class or id names furniture: main-menu and sidebar-left do, has-sidebar, long-form and entry-header don't."""
    words = _words(token)
    bad = DROPPED_WORDS.intersection(words)
    if not bad or words[0] in FIRST_WORDS and len(words) > 1 or words[-1] in LAST_WORDS:
        return False
    return not (bad == {"header"} and KEPT_WORDS.intersection(words))


def _named_only(token: str) -> bool:
    """Whether a class or id consists of furniture words."""
    return DROPPED_WORDS.issuperset(_words(token) or [""])


def _unwanted(tag: str, attributes: str, in_article: bool, lenient: bool = False) -> bool:
    """Whether an element is cut with all that it holds; ``lenient``: of class words only the plainest count."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    names: list[str] = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in DROPPED_ROLES:
            return True
        if name in ("class", "id"):
            names += value.split()
    if tag in ("article", "main"):  # only comments come as articles of their own
        names = [t for t in names if COMMENT_WORDS.intersection(_words(t))]
    bad = [t for t in names if _named_unwanted(t)]
    content = any(KEPT_WORDS.intersection(_words(t)) and not _named_unwanted(t) for t in names)
    return any(_named_only(t) for t in bad) if lenient or content else bool(bad)


class _Tree:
    """Elements as parallel lists, blocks of text as (element, text, characters in links)."""

    def __init__(self, lenient: bool = False):
        self.lenient = lenient
        self.tag, self.parent, self.cut, self.block = ["#root"], [-1], [False], [0]
        self.links = [0]
        self.open: Counter = Counter()  # open elements by tag
        self.blocks: list[tuple[int, str, int]] = []
        self.stack = [0]
        self.parts: list[str] = []
        self.linked = 0
        self.in_link = self.in_article = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append((self.block[self.stack[-1]], text, min(self.linked, len(text))))
            self.parts, self.linked = [], 0

    def text(self, s: str) -> None:
        if s and not self.cut[self.stack[-1]]:
            if "&" in s:
                s = references.unescape(s)
            self.parts.append(s)
            if self.in_link:
                self.linked += len(s.strip())

    def pop(self) -> None:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        self.in_link -= tag == "a"
        self.in_article -= tag in ("article", "main")

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
            if tag not in ("html", "body"):
                self.close_open(("p",), ("td", "th", "button", "table", "caption", "object"))
        elif tag == "br":
            self.parts.append(" ")
        if tag in CLOSES:
            self.close_open(CLOSES[tag], FENCES.get(tag, ("table",)))
        if tag == "a" and self.in_link:
            self.close_open(("a",), ("td", "th", "table"))
        if tag in VOID:
            return
        i, up = len(self.tag), self.stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.links.append(0)
        self.cut.append(self.cut[up] or _unwanted(tag, attributes, self.in_article > 0, self.lenient))
        self.block.append(i if block else self.block[up])
        if attributes.endswith("/") and tag in ("svg", "path", "g", "use"):
            return
        self.stack.append(i)
        self.open[tag] += 1
        self.in_link += tag == "a"
        self.in_article += tag in ("article", "main")
        if tag == "a":
            self.links[up] += 1

    def close_open(self, tags: tuple[str, ...], fences: tuple[str, ...]) -> None:
        """Close the innermost open element of ``tags``, if no fence stands before it; repeat for nested ones."""
        again = True
        while again and any(self.open[t] for t in tags):
            again = False
            for depth in range(len(self.stack) - 1, 0, -1):
                tag = self.tag[self.stack[depth]]
                if tag in tags:
                    self.flush()
                    while len(self.stack) > depth:
                        self.pop()
                    again = len(tags) > 1
                    break
                if tag in fences:
                    break

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for depth in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
            open_tag = self.tag[self.stack[depth]]
            if open_tag == tag:
                while len(self.stack) > depth:
                    self.pop()
                return
            if tag not in BLOCK and open_tag in BLOCK:
                return  # an inline end tag doesn't close blocks


def parse(page: str, lenient: bool = False) -> _Tree:
    tree, at, n = _Tree(lenient), 0, len(page)
    closed = page.rfind(">") + 1  # no tag ends beyond
    while at < n:
        m = TAG.search(page, at, closed)
        if not m:
            break
        tree.text(page[at : m.start()])
        at = m.end() if not m[0].startswith("<!--") or m[0].endswith("-->") else n
        if m[1]:
            tree.end(m[1].lower())
        elif name := m[2] or m[4]:
            name, attributes = name.lower(), m[3] if m[2] else m[5]
            if name in RAW and not attributes.endswith("/"):
                close = re.compile(rf"</{name}[^>]*+>", re.I).search(page, at)
                at = close.end() if close else n
                if name in ("iframe", "textarea", "noscript"):
                    tree.parts.append(" ")
            else:
                tree.start(name, attributes)
    rest = page[at:]
    tree.text(rest.partition("<")[0] if re.match(r"[^<]*<[a-zA-Z/!]", rest) else rest)
    tree.flush()
    return tree


def extract(page: str | None) -> str:
    """Main text: one line a block."""
    if not page:
        return ""
    tree = parse(page)
    blocks = [b for b in tree.blocks if not tree.cut[b[0]]]
    if not blocks:  # a class word too many: only the plainest count, and menus are told by their links
        tree = parse(page, lenient=True)
        blocks = [b for b in tree.blocks if not tree.cut[b[0]] and b[2] <= 0.5 * len(b[1])]
    if not blocks:
        return ""
    n = len(tree.tag)
    points, length, linked, anchors = [0.0] * n, [0] * n, [0] * n, list(tree.links)
    for at, text, in_links in blocks:
        length[at] += len(text)
        linked[at] += in_links
        earned = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - in_links / len(text))
        up, share = at if tree.tag[at] in ("div", "section", "article", "main", "body", "#root", "td") else tree.parent[at], 1
        while up > 0 and share <= REACH:
            points[up] += earned / share
            up, share = tree.parent[up], share + 1
    for i in range(n - 1, 0, -1):
        length[tree.parent[i]] += length[i]
        linked[tree.parent[i]] += linked[i]
        anchors[tree.parent[i]] += anchors[i]
    score = [points[i] * (1 - linked[i] / length[i]) if length[i] else 0.0 for i in range(n)]
    best = max(range(n), key=lambda i: (score[i], i))
    if score[best] <= 0:
        best = 0
    around, up = best, tree.parent[best]
    while up > 0:
        if tree.tag[up] == "article" or tree.tag[up] == "main" and tree.tag[around] != "article":
            around = up
        up = tree.parent[up]
    best = around if linked[around] <= 0.5 * length[around] else best
    chosen = {best}
    if best and tree.tag[best] not in ("article", "main", "body", "html"):
        bar = max(10.0, 0.2 * score[best])
        titled = [tag in ("h1", "h2") for tag in tree.tag]
        for i in range(n - 1, 0, -1):
            titled[tree.parent[i]] |= titled[i]
        for i in range(1, n):
            if tree.parent[i] == tree.parent[best] and i != best and not tree.cut[i] and length[i]:
                density = linked[i] / length[i]
                if score[i] >= bar or tree.tag[i] in ("h1", "h2", "h3") or i < best and titled[i] and density < 0.25 or tree.tag[i] == "p" and (density < 0.25 and length[i] > 80 or density == 0):
                    chosen.add(i)
    kept, dense, prose = [False] * n, [False] * n, [False] * n
    for i in range(n):
        up = tree.parent[i]
        kept[i] = i in chosen or up >= 0 and kept[up]
        prose[i] = tree.tag[i] in ("article", "main") or up >= 0 and prose[up]
        dense[i] = not prose[i] and (up >= 0 and dense[up] or i not in chosen and tree.tag[i] in ("ul", "ol", "div", "section", "table", "p") and anchors[i] >= 3 and linked[i] > 0.6 * length[i])
    return "\n".join(text for at, text, _ in blocks if kept[at] and not dense[at])


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns and ``text``; one row a page."""
    fields = [pages.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", text string"

    def run(batches):
        for batch in giving_back(batches):
            for a, b in slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                texts = [extract(h) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return pages.select(*keep, html_col).mapInArrow(run, schema)
