"""Main text of web pages by tree scoring (operator 10).

Per page: the markup is read into a tree, boilerplate subtrees (menus,
headers, footers, side columns, notices, adverts, forms, scripts, styles,
reader comments) are left out unless they hold the page's article or most of
its paragraph text, and every paragraph passes points for its
length and commas to its next ``REACH`` ancestors, less the further away.  An ancestor's sum
is discounted by its share of link text.  The best container is kept; where it
lies in an ``article`` or ``main`` element that element is the container, else
the articles beside it are kept with it, other containers that are not mostly
links are kept at the highest level that adds no link text.  A page that is left
without text is read again without the rules on forms and class names.  Every
step is linear in the page's size, however deep its elements lie.

Pages are independent, so the job has no shuffle, and a page's tree lives only
while its row is handled.

Defined cases: a null or empty page, or one without text, gives an empty text;
a null ``page_id`` or ``url`` is passed through; repeated rows are handled
each; equal scores go to the container that starts first; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HARD = frozenset("script style noscript template head title button select option textarea input iframe object embed canvas "
                 "svg audio video map".split())           # what lies in them is no text of the page
DROPPED = frozenset("nav header footer aside form dialog menu".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr img br".split())
#: an element that starts here ends an open paragraph
ENDS_P = frozenset("address article aside blockquote body center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main menu nav ol p pre section table ul li dd dt".split())
#: start tag -> open elements that it ends, up to the given borders
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments "
                        "consent cookie cookies disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice "
                        "notices notification alert pager pagination popup promo promotion recommended related replies respond "
                        "share sharing shoutbox sidebar sidebars signup skyscraper social sponsor sponsored subscribe toolbar "
                        "widget widgets".split())
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adbox cookie cookies consent gdpr".split())
COMMENTS = frozenset("comment comments disqus replies respond".split())
#: words that may also name a section of an article
TOPICS = BOILERPLATE - COMMENTS - frozenset("ad ads adv advert adverts adbox shoutbox skyscraper newsletter signup subscribe".split())
HAVING = frozenset("no not has have with without one two both hide hides".split())
HEADERS = frozenset({"header", "masthead"})
CONTENT = frozenset("article content main story entry post".split())
LAYOUT = frozenset("sidebar sidebars notice banner widget widgets alert comment comments".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
KEPT_TAGS = frozenset({"html", "body", "article", "main"})
START = {"article": 25, "main": 25, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3,
         "dl": -3, "li": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
SIBLING_SHARE = 0.2
REACH = 6                      # elements that a block passes points to
PARAGRAPHS = frozenset("p pre blockquote".split())


def name_parts(*values: str | None) -> set[str]:
    """Lower-case words of class names and ids, cut at signs and at capitals;
    a name's words from "no-", "has-" and the like before a layout word on say
    what is beside the element, not what it is."""
    parts: set[str] = set()
    for name in " ".join(v for v in values if v).split():
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        cut = next((k for k, w in enumerate(words) if w in HAVING and (BOILERPLATE | HEADERS) & set(words[k + 1:])
                    and not (k and words[k - 1] in BOILERPLATE | HEADERS)), len(words))
        parts.update(words[:cut])
    return parts


def boilerplate_rule(tag: str, attrs: dict[str, str | None]) -> str | None:
    """Why an element counts as boilerplate: "hard" (never text), "tag",
    "form", "topic" or "class" (names), "advert", "comment", "hidden"."""
    if tag in HARD:
        return "hard"
    if tag in DROPPED:
        return "form" if tag == "form" else "tag"
    if not attrs or tag in KEPT_TAGS:
        return None
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
        return "hidden"
    role = (attrs.get("role") or "").lower()
    if role in ROLES:
        return "form" if role == "form" else "tag"
    parts = name_parts(attrs.get("class"), attrs.get("id"))
    bad = parts & (BOILERPLATE | HEADERS)
    # "content with-sidebar" names a layout around the content, "comment-content" is a comment's
    if not bad:
        return None
    if bad & ADVERTS:
        return "topic" if tag == "section" and bad <= TOPICS else "advert"
    if bad & COMMENTS:
        return "comment"
    return "topic" if tag == "section" and bad <= TOPICS else "class"


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "rule", "score", "text", "links", "paragraphs", "articles", "open")

    def __init__(self, tag: str, parent: "Node | None", rule: str | None):
        self.tag, self.parent, self.rule = tag, parent, rule
        self.dropped = rule == "hard" or (parent is not None and parent.dropped)
        self.children: list = []
        self.score, self.text, self.links = 0.0, 0, 0


class TreeBuilder(HTMLParser):
    """Tree of a page, tolerant of missing and stray end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, None)
        self.open: dict[str, int] = {}                 # open elements by tag

    def _leave(self, node: Node) -> None:
        """Close all open elements up to ``node``, itself included."""
        while True:
            at = self.at
            self.open[at.tag] -= 1
            self.at = at.parent
            if at is node:
                return

    def _close(self, tags: set[str], borders: set[str] | frozenset[str]) -> None:
        if not any(self.open.get(t) for t in tags):
            return
        node = self.at
        while node.parent is not None and node.tag not in borders:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in ENDS_P:
            self._close({"p"}, frozenset({"div", "article", "section", "td", "blockquote", "li", "aside", "main"}))
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, self.at, boilerplate_rule(tag, dict(attrs)))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("html", "body") and self.at.tag == tag and tag in ("svg", "path"):
            self._leave(self.at)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag):                     # a stray end tag
            return
        node = self.at
        while node.parent is not None and node.tag != tag:
            if tag in INLINE and node.tag not in INLINE:       # a stray inline end tag ends no block
                return
            node = node.parent
        if node.parent is not None:
            self._leave(node)

    def handle_data(self, data: str) -> None:
        if not self.at.dropped:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def settle(root: Node, lenient: bool = False) -> None:
    """Mark what is dropped.  Boilerplate that holds an article or main with
    text, when none lies in the open, or most of the page's paragraph text
    stays; reader comments, adverts and hidden parts only if no paragraph lies
    elsewhere; ``lenient`` has no rules on forms and class names."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and c.rule != "hard")
    for node in reversed(order):                               # articles: text in them; open: that outside boilerplate
        below = [c for c in node.children if not isinstance(c, str) and c.rule != "hard"]
        node.text = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.text for c in below)
        node.links = node.text if node.tag == "a" else sum(c.links for c in below)
        node.paragraphs = node.text if node.tag in PARAGRAPHS else sum(c.paragraphs for c in below)
        node.articles = node.text if node.tag in ("article", "main") else sum(c.articles for c in below)
        node.open = node.text if node.tag in ("article", "main") else sum(c.open for c in below if not c.rule)
    stack = [(root, root, False)]
    while stack:
        node, scope, inside = stack.pop()
        node.dropped = False
        if node.rule and not (lenient and node.rule in ("form", "class", "topic", "comment")):
            most = node.paragraphs * 2 > root.paragraphs
            if node.rule in ("comment", "advert", "hidden"):
                keep = 0 < node.paragraphs == root.paragraphs
            elif node.articles and not scope.open:
                keep = True
            elif node.rule == "topic" and inside:
                keep = node.paragraphs > 0 and node.links * 2 <= node.text
            else:
                keep = most and (inside or node.rule != "tag" or not scope.open)
            if not keep:
                node.dropped = True
                continue
            scope = node
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, scope, inside) for c in node.children if not isinstance(c, str) and c.rule != "hard")


def blocks(top: list, owner: Node | None = None) -> Iterator[tuple[Node, str]]:
    """Text blocks below the given nodes in page order, each with the element
    it lies in (``owner`` for text among the given nodes)."""
    words: list[str] = []
    stack: list = list(reversed(top))
    while stack:
        item = stack.pop()
        if isinstance(item, tuple):                            # the end of a block element
            text = " ".join("".join(words).split())
            if text and owner is not None:
                yield owner, text
            words, owner = [], item[0]
        elif isinstance(item, str):
            words.append(item)
        elif item.dropped:
            continue
        elif item.tag == "br":
            words.append(" ")
        elif item.tag in INLINE:
            stack.extend(reversed(item.children))
        else:
            text = " ".join("".join(words).split())
            if text and owner is not None:
                yield owner, text
            words, owner = [], item
            stack.append((item.parent,))
            stack.extend(reversed(item.children))
    text = " ".join("".join(words).split())
    if text and owner is not None:
        yield owner, text


def measure(root: Node) -> list[Node]:
    """Elements in page order with the length of their text and link text."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        below = [c for c in node.children if not isinstance(c, str) and not c.dropped]
        node.text = own + sum(c.text for c in below)
        node.links = node.text if node.tag == "a" else sum(c.links for c in below)
    return order


def fair_siblings(best: Node) -> list:
    """The best container and what lies beside it and is not mostly links;
    text and inline elements between two blocks count together."""
    limit = max(10.0, best.score * SIBLING_SHARE)
    kept, run = [], []

    def close() -> None:
        text = sum(len(c.strip()) if isinstance(c, str) else c.text for c in run)
        if sum(c.links for c in run if not isinstance(c, str)) * 2 <= text or best in run:
            kept.extend(run)
        run.clear()
    for c in best.parent.children:
        if isinstance(c, str) or (c.tag in INLINE and not c.dropped):
            run.append(c)
            continue
        close()
        if not c.dropped and (c is best or c.score >= limit or c.links * 2 <= c.text):
            kept.append(c)
    close()
    return kept


def fair_articles(best: Node) -> list:
    """An article or main, and the articles beside it that hold paragraph text
    and are not mostly links."""
    if best.tag != "article" or best.parent is None:
        return [best]
    return [c for c in best.parent.children if c is best or (not isinstance(c, str) and c.tag == "article" and not c.dropped
                                                            and c.paragraphs > 0 and c.links * 2 <= c.text)]


def main_text(html: str | None) -> str:
    """The page's main text, one line per block."""
    if not html:
        return ""
    root = parse(html)
    settle(root)
    text = text_of(root)
    if not text:
        settle(root, lenient=True)
        text = text_of(root)
    return text


def text_of(root: Node) -> str:
    """Main text of a tree with its dropped elements marked."""
    order = measure(root)
    scored: dict[int, Node] = {}
    for owner, text in blocks([root]):
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        # the block's own element passes them to its ancestors
        node, level = (owner.parent or owner), 0
        while node is not None and level < REACH:
            if id(node) not in scored:
                node.score = START.get(node.tag, 0)
                scored[id(node)] = node
            node.score += points / (1, 2)[level] if level < 2 else points / (level * 3)
            node, level = node.parent, level + 1
    if not scored:
        return ""
    for node in scored.values():
        node.score *= 1 - (node.links / node.text if node.text else 0)
    best = max((n for n in order if id(n) in scored), key=lambda n: n.score)
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:
        return "\n".join(text for _, text in blocks(fair_articles(node), node.parent))
    # up to the highest container that adds no link text
    while best.parent is not None and best.parent.parent is not None and best.parent.links <= best.links:
        best = best.parent
    if best.parent is not None:
        return "\n".join(text for _, text in blocks(fair_siblings(best), best.parent))
    return "\n".join(text for _, text in blocks([best]))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], schema=arrow)
    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "html").mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint")
