"""Main text of web pages by tree scoring.

Parts that can't be the article (menus, headers, footers, asides, adverts, notices, forms, reader
comments, scripts, styles) go first. Then every paragraph passes points for its length and its commas to
the elements around it, less with each level; an element's points are discounted by the share of its text
that lies in links. The best element, widened to the article or main element around it if there is one,
or else joined by its siblings that aren't mostly links, gives the text.

All steps take time in proportion to the page: lengths of texts and links are summed up once, from the
leaves to the root.

Defined cases: a null or empty page gives an empty text; broken or cut markup is read as browsers do for
unclosed paragraphs, items and cells, and a reference that is cut stays as it is; a page without any
paragraph gives all its text that isn't dropped; a null page_id or url stays null; repeated rows are read
each; of equally good containers the first one counts; a very long page is read whole, in time that grows
with its length; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.llm.common import table

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a paragraph and stand as blocks of their own.
_BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag closes, and what bounds the search for it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_DROPPED = set(
    "head script style noscript template iframe nav footer aside form button select textarea input dialog svg "
    "canvas object embed audio video menu title search".split()
)
_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
    "tablist status".split()
)
#: Words of class names and ids. A name drops its element if all of its words are of these lists, one of them
#: of the first three; a paragraph, heading or cell is dropped by the first list only.
_STRONG = set("ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored cookie cookies "
              "consent gdpr comment comments disqus reply replies respond".split())  # fmt: skip
_WEAK = set(
    "promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar toolbar newsletter subscribe "
    "subscription signup login popup overlay modal share sharing social related recommended widget widgets pagination "
    "pager skip".split()
)
_OUTER = set("header footer masthead banner notice alert".split())
#: Words that say where or how, and words for the article itself, whose own header and footer stay.
_NEUTRAL = set(
    "area bar block box bottom button buttons col column container content form global google icon icons inner item items "
    "left link links list main media message page panel posts primary right row secondary section site slot thread top "
    "unit wrap wrapper".split()
)
_OWN = {"article", "entry", "post", "story"}
_TEXTS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption span a em strong b i".split())
_COMMENT = {"comment", "comments", "reply", "replies"}
_KEPT = {"html", "body", "main", "article"}
_TAG_POINTS = {"article": 10.0, "main": 8.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0,
               "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "address": -3.0}
_PARAGRAPHS = {"p", "pre", "td", "blockquote", "dd", "li"}


class Node:
    """An element; after measured() with the sizes of its whole text: characters, those in links, commas."""

    __slots__ = ("article", "attrs", "chars", "children", "commas", "linked", "parent", "points", "tag")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = self.commas = 0
        self.article = False

    @property
    def link_density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    def attributes(self) -> dict[str, str]:
        if not self.attrs.strip():
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)}

    def nodes(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [x for x in reversed(node.children) if isinstance(x, Node)]


def measured(root: Node) -> None:
    """Sums up the sizes, from the leaves to the root."""
    for node in reversed(list(root.nodes())):
        node.chars = node.linked = node.commas = 0
        node.article = node.tag in ("article", "main")
        for x in node.children:
            if isinstance(x, str):
                node.chars += sum(map(len, x.split()))
                node.commas += x.count(",")
            else:
                node.chars, node.commas, node.linked = node.chars + x.chars, node.commas + x.commas, node.linked + x.linked
                node.article |= x.article
        if node.tag == "a":
            node.linked = node.chars


def parse(page: str) -> Node:
    root = Node("root")
    now, at = root, 0
    open_ = Open()
    while at < len(page):
        m = _TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            now.children.append(html.unescape(page[at:end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            now = _close(now, tag, open_)
            continue
        now = _left(now, _open_place(now, tag, open_), open_)
        node = Node(tag, m[3] or m[6] or "", now)
        now.children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else len(page)
        elif tag not in _VOID and not (m[3] or m[6] or "").endswith("/"):
            now = node
            open_.enter(tag)
    return root


class Open:
    """How many elements of each name are open, in all and since the innermost open block began."""

    def __init__(self):
        self.counts: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]

    def enter(self, tag: str) -> None:
        self.counts[tag] += 1
        if tag in _BLOCK:
            self.inline.append(Counter())
        else:
            self.inline[-1][tag] += 1

    def leave(self, tag: str) -> None:
        self.counts[tag] -= 1
        if tag in _BLOCK:
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1

    def __getitem__(self, tag: str) -> int:
        return self.counts[tag]

    def closes(self, tag: str) -> bool:
        """Whether an end tag closes something: a block's wherever one is open, another's within the innermost block."""
        return (self.counts if tag in _BLOCK else self.inline[-1])[tag] > 0


def _left(now: Node, place: Node, open_: Open) -> Node:
    """Goes up to the place; what lies below it is no longer open."""
    while now is not place:
        open_.leave(now.tag)
        now = now.parent
    return place


def _close(now: Node, tag: str, open_: Open) -> Node:
    """The place after an end tag; one that closes nothing changes nothing."""
    if not open_.closes(tag):
        return now
    node = now
    while node.tag != tag:  # all that is passed is left
        node = node.parent
    return _left(now, node.parent, open_)


def _open_place(now: Node, tag: str, open_: Open) -> Node:
    """Where a new element goes, after what it closes."""
    closed, bound = _CLOSES.get(tag, (set(), set()))
    if tag in _BLOCK:
        closed, bound = closed | {"p"}, bound | {"td", "th", "button", "table"}
    node: Node | None = now if any(open_[x] for x in closed) else None
    place = now
    while node and node.parent:
        if node.tag in closed:
            place = node.parent
            if node.tag != "p" or tag not in _CLOSES:
                break
        elif node.tag in bound or tag not in _CLOSES and node.tag in _BLOCK:
            break
        node = node.parent
    return place


def _kinds(attrs: dict[str, str]) -> Iterator[str]:
    """What the element's class names and id say it is: strong, weak, outer, or comment for strong ones that are one."""
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)}
        if parts & _STRONG and parts <= _STRONG | _WEAK | _OUTER | _NEUTRAL | _OWN:
            yield "comment" if parts & _COMMENT else "strong"
        elif parts & _WEAK and parts <= _WEAK | _OUTER | _NEUTRAL | _OWN:
            yield "weak"
        elif parts & _OUTER and parts <= _OUTER | _NEUTRAL:
            yield "outer"


def _is_dropped(node: Node, in_article: bool) -> bool:
    if node.tag in _DROPPED:
        return True
    if node.tag == "header" and not in_article:
        return True
    attrs = node.attributes()
    if not attrs:
        return False
    kinds = set(_kinds(attrs))
    if node.tag in _KEPT:
        return node.tag == "article" and "comment" in kinds
    style = attrs.get("style", "").replace(" ", "").lower()
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
        return True
    if in_article and (node.tag in _TEXTS or node.tag not in _BLOCK):
        # a word or paragraph of the article, whatever it is called; readers' posts stand in containers
        kinds -= {"comment"}
    if "comment" in kinds:
        return True
    named = kinds if node.tag not in _TEXTS else kinds & {"strong"}
    return (bool(named) or attrs.get("role", "").lower() in _ROLES) and not node.article


def prune(node: Node) -> None:
    """Takes out what can't be the article."""
    todo = [(node, False)]
    while todo:
        now, in_article = todo.pop()
        inside = in_article or now.tag == "article"
        now.children = [x for x in now.children if isinstance(x, str) or not _is_dropped(x, inside)]
        todo += [(x, inside) for x in now.children if isinstance(x, Node)]


def blocks(node: Node) -> Iterator[str]:
    """The text of each block in page order, white space as one space, empty ones left out."""
    run: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        now = todo.pop()
        if now is None or isinstance(now, Node) and now.tag in _BLOCK:
            if text := " ".join("".join(run).split()):
                yield text
            run = []
        if isinstance(now, str):
            run.append(now)
        elif now is not None:
            if now.tag == "br":
                run.append(" ")
            if now.tag in _BLOCK:
                todo.append(None)
            todo += reversed(now.children)
    if text := " ".join("".join(run).split()):
        yield text


def _is_paragraph(node: Node) -> bool:
    if node.tag in _PARAGRAPHS:
        return True
    own = any(isinstance(x, str) and x.strip() for x in node.children)
    return node.tag in ("div", "section", "article", "main") and own


def best_nodes(root: Node) -> list[Node]:
    """The container of the article, or it and its good siblings."""
    scored: dict[int, Node] = {}
    for node in root.nodes():
        if not _is_paragraph(node):
            continue
        if node.tag in _PARAGRAPHS:
            size, commas = node.chars, node.commas
        else:
            own = [x for x in node.children if isinstance(x, str)]
            size, commas = sum(len(x.strip()) for x in own), sum(x.count(",") for x in own)
        if size < 2:
            continue
        points = 1.0 + commas + min(size / 100.0, 3.0)
        above, level = (node.parent if node.tag in _PARAGRAPHS else node), 1
        while above and above.tag not in ("root", "html") and level <= 4:
            if id(above) not in scored:
                scored[id(above)] = above
                above.points = _TAG_POINTS.get(above.tag, 0.0)
            above.points += points / level
            above, level = above.parent, level + 1
    final = {k: x.points * (1.0 - x.link_density) for k, x in scored.items()}
    if not final:
        return [next((x for t in ("article", "main", "body") for x in root.nodes() if x.tag == t), root)]
    best = scored[max(final, key=lambda k: final[k])]
    around, node = None, best
    while node:
        if node.tag == "article" or node.tag == "main" and around is None:
            around = node
        node = node.parent
    if around is not None:
        return [around]
    inside = [x for t in ("article", "main") for x in best.nodes() if x.tag == t]
    if len(inside) == 1:
        return inside
    _without_menus(best)
    siblings = [x for x in best.parent.children if isinstance(x, Node)] if best.parent else [best]
    return [x for x in siblings if x is best or x.link_density < 0.5]


def _without_menus(node: Node) -> None:
    """Lists that consist of links, where no article or main element says what is the text."""
    menus = {id(x): x for x in node.nodes() if x.tag in ("ul", "ol") and x.parent and x is not node and x.link_density >= 0.9}
    for above in {id(x.parent): x.parent for x in menus.values()}.values():
        above.children = [y for y in above.children if id(y) not in menus]


def main_text(page: str) -> str:
    if not page:
        return ""
    root = parse(page)
    measured(root)
    prune(root)
    measured(root)
    out: list[str] = []
    for node in best_nodes(root):
        out += blocks(node)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    @F.pandas_udf("string")
    def article(pages_: pd.Series) -> pd.Series:
        return pages_.map(main_text)

    out = pages.select("page_id", "url", article(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
