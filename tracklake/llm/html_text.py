"""Operator 3: HTML extraction by tree scoring.

A tolerant parser builds the element tree. Paragraphs pass points for their length and commas to their ancestors;
a container's points are discounted by its link density. The article is what holds the best container, less its parts
that are mostly links.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracklake.llm.common import field, map_texts, table

# The elements of HTML by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS_END_AT = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "head"))
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol", "dl", "table"))
#: Elements that are a paragraph of what holds them.
PARAGRAPHS = frozenset("p pre li h1 h2 h3 h4 h5 h6 dd dt".split())
#: Elements that are no part of an article.
DROPPED = RAW | frozenset("head nav header footer aside form button select input label fieldset dialog menu svg canvas object audio video math".split())
#: Words in a class, id or role that mark such parts.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo complementary consent cookie cookies disqus footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pagination paywall popup promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: Marks of readers' own texts, which can be longer than the article.
READERS = frozenset("comment comments disqus respond".split())
#: Words that make a compound such as with-sidebar say how a page is laid out, not what an element is.
STATES = frozenset("has have hide is no not show with without".split())
#: A part that only its marks speak against, and that holds nearly all text, is kept if it has so many characters.
WRAPPER_SHARE, WRAPPER_CHARS = 0.8, 250
#: Elements whose marks don't drop them: their parts are judged alone.
WHOLE = frozenset(("html", "body", "main", "article"))

#: In these, a mark that is only part of a name, as in share-price, says nothing.
SMALL = frozenset("p pre li dd dt td th blockquote figure h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
COMMENT_END = re.compile(r"--!?>")
TAG_STOP = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
WORD = re.compile(r"[a-z]+")

FULL, LONG_CHARS, MOST_LENGTH_POINTS = 1.0, 100, 3.0
#: A container's own points by its element.
OWN = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 2.0, "td": 1.0, "blockquote": 1.0}
#: Around the best container, text in which more than this share is links is no article.
MOST_LINKS = 0.5
#: Beside the article, a container stays with this share of the best one's points; a lone paragraph, if so long and with few links.
SIBLING_SHARE, SIBLING_CHARS, SIBLING_LINKS = 0.2, 80, 0.25


class Node:
    __slots__ = ("chars", "children", "link_chars", "marks", "passed", "points", "sure", "tag", "up")

    def __init__(self, tag: str, up: Node | None, marks: frozenset[str] = frozenset(), sure: bool = False) -> None:
        self.tag, self.up, self.marks, self.sure = tag, up, marks, sure
        self.children: list[Node | tuple[str, int]] = []  # nodes, and blocks of text with the characters in links
        self.points = self.passed = 0.0
        self.chars = self.link_chars = 0


class Tags:
    """The tags of a page, read forward only: each character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.resume = 0
        self.loose = False  # a quote swallowed the rest of the page: from there on a tag ends at the next >

    def end_of(self, at: int) -> int:
        """Where the > of a tag is, -1 if there is none; one inside quotes is none, unless a quote is never closed."""
        page = self.page
        first = page.find(">", at)
        if self.loose or first < 0:
            return first
        while m := TAG_STOP.search(page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], at) + 1
            if not at:
                break
        self.loose = True
        return first

    def __iter__(self) -> Iterator[tuple[int, int, bool, str, str]]:
        """(start, end, whether it closes, name, attributes) of each tag; comments and the like have no name."""
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            closes = page.startswith("/", start + 1)
            name = NAME.match(page, start + 1 + closes)
            if name:
                stop = self.end_of(name.end())
                at = len(page) if stop < 0 else stop + 1
                # A tag that is cut off by the end of the page is no tag.
                yield start, at, closes, name[0].lower() if stop >= 0 else "", page[name.end() : stop] if stop >= 0 else ""
            elif page.startswith("<!--", start):
                # <!--> and <!---> are whole comments
                stop = COMMENT_END.search(page, start + 2) if page.startswith(("<!-->", "<!--->"), start) else COMMENT_END.search(page, start + 4)
                at = stop.end() if stop else len(page)
                yield start, at, False, "", ""
            elif page.startswith(("!", "?", "/"), start + 1):
                at = page.find(">", start) + 1 or len(page)
                yield start, at, False, "", ""
            else:
                at = start + 1
                continue
            at = max(at, self.resume)

    def past_raw(self, name: str, at: int) -> int:
        """Where the raw text of an element ends; the tags go on from there."""
        closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        self.resume = (self.page.find(">", closing.end()) + 1 or len(self.page)) if closing else len(self.page)
        return self.resume


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), next((v for v in m.groups()[1:] if v is not None), ""))
    return out


def hidden(attributes: dict[str, str]) -> bool:
    return attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(INVISIBLE.search(attributes.get("style", "")))


def marks_of(attributes: dict[str, str], small: bool = False) -> tuple[frozenset[str], bool]:
    """The marks in class, id and role, and whether one is a whole name there, not a part of a compound such as nav-fixed."""
    found, sure = set(), False
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            words = WORD.findall(name)
            if not STATES.intersection(words) and not (small and len(words) > 1):
                own = MARKS.intersection(words)
                found |= own
                sure |= bool(own) and len(words) == 1
    return frozenset(found), sure


def parse(page: str, marks: bool = True) -> Node:
    """The tree of what can be part of an article; text is gathered into blocks under the element that holds it.

    Marked elements stay in it, with their marks; without ``marks`` they are like others, and so are forms.
    """
    root = Node("#", None)
    stack = [root]  # elements that hold blocks: the block-level ones
    open_: Counter[str] = Counter()  # how many of each name are in it
    links = 0  # open links; what else is open within the line doesn't count
    text: list[str] = []
    linked = 0
    skip, depth = "", 0  # inside a dropped element: its name and how deep in elements of that name
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join("".join(text).split())
            if block:
                stack[-1].children.append((block, min(linked, len(block))))
            text.clear()
        linked = 0

    def take(part: str) -> None:
        nonlocal linked
        if part:
            part = unescape(part) if "&" in part else part
            text.append(part)
            if links:
                linked += len(" ".join(part.split()))

    def close(tag: str) -> None:
        nonlocal links
        if not open_[tag]:
            return
        flush()
        links = 0
        while (node := stack.pop()).tag != tag:
            open_[node.tag] -= 1
        open_[tag] -= 1

    tags = Tags(page)
    for start, end, closes, tag, inside in tags:
        if not skip:
            take(page[at:start])
        at = end
        if not tag:
            continue
        if skip:
            if tag == skip:
                depth += -1 if closes else (not inside.endswith("/"))
                if depth == 0:
                    skip = ""
            continue
        if tag in RAW and not closes:
            at = tags.past_raw(tag, end)
            continue
        if closes:
            if tag in BLOCK:
                close(tag)
            elif tag == "a":
                links = max(0, links - 1)
            elif tag == "br":
                text.append(" ")
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in PARAGRAPHS_END_AT:
            close("p")
        for other in ENDS_ITSELF.get(tag, ()):
            if open_[other]:
                inner = next((n.tag for n in reversed(stack) if n.tag in LISTS or n.tag == other), "")
                if inner == other:
                    close(other)
        framed = tag in DROPPED and (marks or tag != "form") and (tag != "header" or not (open_["article"] or open_["main"]))
        attributes = attributes_of(inside) if inside and tag not in WHOLE else {}
        gone = framed or hidden(attributes)
        own, sure = marks_of(attributes, tag in SMALL) if marks and attributes and not gone else (frozenset(), False)
        if gone or (sure and tag not in BLOCK):
            if tag in BLOCK:
                flush()
            if tag not in VOID and not inside.endswith("/"):
                skip, depth = tag, 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            links = 0
            if len(stack) < 2000:
                node = Node(tag, stack[-1], own, sure)
                stack[-1].children.append(node)
                stack.append(node)
                open_[tag] += 1
        elif tag == "a":
            links += 1
    if not skip:
        take(page[at:])
    flush()
    return root


def prune(root: Node) -> None:
    """Takes the marked elements from the tree, but for those that hold the article or its title.

    A frame stands beside the article and a wrapper holds it: most of the text that is not in links, and the title.
    """
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += reversed([c for c in node.children if isinstance(c, Node)])
    if not any(n.marks for n in nodes):
        return
    title = next((n for tag in ("h1", "h2") for n in nodes if n.tag == tag), None)
    prose: dict[Node, int] = {}
    holds: dict[Node, set[str]] = {}
    for n in reversed(nodes):  # children before their parents
        prose[n] = sum(prose[c] if isinstance(c, Node) else len(c[0]) - c[1] for c in n.children)
        holds[n] = {n.tag} & WHOLE | ({"title"} if n is title else set())
        for c in n.children:
            if isinstance(c, Node):
                holds[n] |= holds[c]

    def stays(n: Node) -> bool:
        most, readers = 2 * prose[n] > prose[root], not n.marks.isdisjoint(READERS)
        if holds[n] & {"title", "main"} and (most or not n.sure):
            return True
        if not n.sure or "article" in holds[n]:
            return most and not readers
        return not readers and prose[n] >= WRAPPER_CHARS and prose[n] > WRAPPER_SHARE * prose[root]

    for n in nodes:
        n.children = [c for c in n.children if not isinstance(c, Node) or not c.marks or stays(c)]


def score(root: Node) -> list[Node]:
    """All elements with text, with their points; a paragraph is any block of text. What holds it gets its points, and of
    what an element got its parent gets half."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(nodes):  # children before their parents
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.passed += c.passed if c.tag in PARAGRAPHS else c.passed / 2
                continue
            block, links = c
            node.chars += len(block)
            node.link_chars += links
            node.passed += FULL + block.count(",") + block.count("，") + min(len(block) / LONG_CHARS, MOST_LENGTH_POINTS)
        node.points = OWN.get(node.tag, 0.0) + (0.0 if node.tag in PARAGRAPHS else node.passed)
    return [n for n in nodes if n.chars]


def judged(node: Node) -> float:
    return node.points * (1 - node.link_chars / max(node.chars, 1))


def blocks_of(node: Node) -> list[str]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, Node):
            todo += reversed(n.children)
        else:
            out.append(n[0])
    return out


def main_text(page: str) -> str:
    """The article's blocks in page order, joined by a space; empty if the page has no text outside its frame."""
    return article_text(parse(page)) or article_text(parse(page, marks=False))


def article_text(root: Node) -> str:
    prune(root)
    nodes = score(root)
    holders = [n for n in nodes if n.tag not in HEADINGS and n.tag != "p"]
    if not holders:
        return ""
    best = max(holders, key=judged)
    top = outermost(best)
    kept = article_blocks(top, best)
    if top.up:
        near = top.up.children
        at = near.index(top)
        kept = [x for c in near[:at] for x in beside(c, best)] + kept + [x for c in near[at + 1 :] for x in beside(c, best)]
    return " ".join(kept)


def outermost(best: Node) -> Node:
    """The article or main element around the best container; without one, the farthest container around it in which
    most text is not links."""
    line = [best]
    while line[-1].up:
        line.append(line[-1].up)
    named = [n for n in line if n.tag in ("article", "main")]
    if named:
        return named[-1]
    top = best
    while top.up and top.up.link_chars <= MOST_LINKS * top.up.chars:
        top = top.up
    return top


def article_blocks(top: Node, best: Node) -> list[str]:
    """The blocks of the best container, and those of all else in ``top`` that is not mostly links."""
    line = set()
    n: Node | None = best
    while n is not top:
        line.add(n)
        n = n.up
    line.add(top)
    out: list[str] = []
    todo: list[tuple[Node | tuple[str, int], bool]] = [(top, top.tag in ("article", "main"))]
    while todo:
        c, short = todo.pop()  # and whether short parts stay there
        if not isinstance(c, Node):
            if c[1] <= SIBLING_LINKS * len(c[0]) and (short or len(c[0]) >= SIBLING_CHARS):
                out.append(c[0])
        elif c is best or c.tag == "h1" or (c.tag in HEADINGS and (short or c.up in line)):
            out += blocks_of(c)
        elif c in line:
            todo += [(x, short) for x in reversed(c.children)]
        elif c.link_chars > SIBLING_LINKS * c.chars:
            todo += [(x, False) for x in reversed(c.children)]
        elif short or c.chars >= SIBLING_CHARS or (c.tag == "p" and c.up in line):
            out += blocks_of(c)
    return out


def beside(c: Node | tuple[str, int], best: Node) -> list[str]:
    """The blocks of a neighbour of the article if it is part of it: alike in points, a long paragraph, or the title."""
    if not isinstance(c, Node):
        return [c[0]] if len(c[0]) >= SIBLING_CHARS and c[1] <= SIBLING_LINKS * len(c[0]) else []
    alike = judged(c) >= SIBLING_SHARE * judged(best) and c.tag not in ("ul", "ol", "table")
    good = c.chars and (alike or c.tag == "p") and c.chars >= SIBLING_CHARS and c.link_chars <= SIBLING_LINKS * c.chars
    return blocks_of(c) if good or c.tag == "h1" else []


def extract_text(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Every row with the page's main text and its length in code points.

    A null or empty page has an empty text. Equal pages have equal texts, repeated rows stay, an empty table gives an
    empty result. Unclosed and cut-off markup is read as far as it goes. A kept column named text or n_chars gives way.
    """

    def run(pages: list[bytes]) -> list:
        texts = [main_text(p.decode("utf-8", "replace")) for p in pages]
        return [texts, [len(t) for t in texts]]

    return map_texts(df, html, df.columns if keep is None else keep, [field("text", T.StringType()), field("n_chars", T.LongType())], run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
