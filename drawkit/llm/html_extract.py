"""Main text of web pages by tree scoring.

Every block that holds text of its own is a paragraph: it gives points for its length and commas, discounted by the
share of its text that stands in links, to the elements above it, less with each level. What is marked up as an article
gets the points of all its paragraphs. An element's sum is discounted by its own link density; the best element is the
container, and siblings that score well or read like prose are kept with it.

Before that, what isn't main text is cut out of the tree: by tag, by role, and by a class or id whose whole name says
so ("site-footer", "cookie-notice"). A longer name that begins or ends with such a word ("user-comments", "google-ad")
only hints at it, and what the part holds decides: reader comments go unless the page's article or heading is in them;
adverts, sign-ups and the like go if they are short or mostly links; menus and bars go if they are mostly links. Names
that tell a state or are a phrase ("has-sidebar", "page-with-menu", "reply-to-critics") hint at nothing, and so does an
id made of the part's own heading. If names leave next to nothing, hints are dropped first, and then names don't count
for what holds most of the page's text.

Time and memory grow in proportion to the page: the tokenizer looks at each character a fixed number of times, an end
tag without an open element costs one look-up, and all walks are loops over the page's items, at any depth.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rebatch, text_or_empty

NAME = re.compile(r"[A-Za-z][^\s/>]*+")
ATTR = re.compile(r"""[\s/=]*+([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+)|))?""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: More digits than Python turns into a number: no character has such a reference.
HUGE_REFERENCE = re.compile(r"&#[0-9]{4000,};?")

#: Elements by what they are in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset("#root address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Not shown as text, or not main text wherever it stands: scripts, controls, fallbacks of media, menus, footers, sidebars.
CUT_TAGS = frozenset("script style noscript template nav footer aside button select option input textarea iframe svg object embed canvas dialog menu head title audio video map applet noembed noframes xmp datalist annotation annotation-xml".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that name a part of a page which isn't main text.
PARTS = COMMENTS | frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social related recommended recommendations pagination pager login".split())
#: Words that may stand beside them in such a name without changing what it says.
BESIDE = frozenset("site page main global primary secondary left right top bottom header box bar wrap wrapper container block section area list item items inner outer group panel module region zone unit slot links link posts post entry article story form buttons button icons icon title heading mobile desktop sticky fixed js wp the my".split())
#: Words of PARTS that mean an advert, an offer or a call to share or sign up also in a longer name.
OFFERS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promoted promotion cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social related recommended recommendations popup modal".split())
#: Words of names that tell a state or belong to a phrase.
TELLS_NOTHING = frozenset("has with without no not non is are to of and or on for in by from vs free enabled disabled open closed layout template type category tag hoc".split())
HINTED_TAGS = frozenset("article section div ul ol dl table form details fieldset".split())
CLOSES_P = BLOCK - frozenset("#root body html caption dd dt li tbody td tfoot th thead tr legend".split())
#: A start tag ends these open elements, up to the nearest of the second set.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
P_SCOPE = ("td", "th", "table", "caption", "button")
#: An end tag of anything but these doesn't reach out of a table cell.
TABLE_TAGS = frozenset("table tbody thead tfoot tr td th caption".split())
CELL_SCOPE = ("td", "th", "table", "caption")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in RAW}


class Node:
    """An element. items[start] and items[end] are the element itself; its texts and elements stand between them.

    block: the nearest block at or above it. article: the nearest element at or above it that is marked up as one.
    """

    __slots__ = ("article", "attrs", "block", "commas", "cut", "depth", "end", "head_len", "in_link", "link_len", "links", "own_len", "own_link", "parent", "score", "start", "tag", "text_len")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str], start: int) -> None:
        self.tag, self.parent, self.attrs, self.start, self.end = tag, parent, attrs, start, -1
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.depth = 0 if parent is None else parent.depth + 1
        self.in_link = tag == "a" or parent is not None and parent.in_link
        self.article = self if is_article(self) else parent.article if parent is not None else None
        self.cut = False
        self.clear()

    def clear(self) -> None:
        self.text_len = self.link_len = self.links = self.head_len = self.own_len = self.own_link = self.commas = 0
        self.score = 0.0

    @property
    def density(self) -> float:
        return self.link_len / self.text_len if self.text_len else 0.0

    @property
    def worth(self) -> float:
        return self.score * (1 - self.density)


def is_article(node: Node) -> bool:
    a = node.attrs
    return node.tag in ("article", "main") or bool(a) and (a.get("role", "").lower() in ("main", "article") or "articleBody" in a.get("itemprop", ""))


def unescape(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return html.unescape(text)
    except ValueError:
        return html.unescape(HUGE_REFERENCE.sub("�", text))


class _Builder:
    """Open elements, with the places of each tag among them, so that no look for one walks over the others."""

    def __init__(self) -> None:
        self.items: list[str | Node] = []
        self.nodes: list[Node] = []
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.push("#root", {})

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, self.open[-1] if self.open else None, attrs, len(self.items))
        self.items.append(node)
        self.nodes.append(node)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def pop_to(self, at: int) -> None:
        """Ends the open elements from place `at` on."""
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node.tag].pop()
            node.end = len(self.items)
            self.items.append(node)

    def bound(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of one of the tags."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def end_implied(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the outermost open element of one of the tags, this side of any element of within."""
        if not any(self.places.get(t) for t in tags):
            return
        bound = self.bound(within)
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, bound)) < len(p)]
        if found:
            self.pop_to(min(found))

    def end_tag(self, tag: str) -> None:
        place = self.places.get(tag)
        if not place or tag in ("#root", "body", "html"):
            return
        at = place[-1]
        if tag not in TABLE_TAGS and at < self.bound(CELL_SCOPE):
            return
        if tag not in BLOCK and self.open[-1].block.depth > self.open[at].depth:
            # An inline element that ends inside a block which began in it: the block goes on. A link ends with its blocks.
            if tag == "a":
                self.pop_to(at)
            return
        self.pop_to(at)

    def start_tag(self, tag: str, attrs: dict[str, str], alone: bool) -> None:
        if tag in CLOSES_P:
            self.end_implied(("p",), P_SCOPE)
        if tag in ENDS:
            self.end_implied(*ENDS[tag])
        elif tag == "a" and self.places.get("a"):
            self.end_tag("a")
        self.push(tag, attrs)
        if alone:
            self.pop_to(len(self.open) - 1)


def parse(page: str) -> tuple[list[str | Node], list[Node]]:
    """The page's items in order (see Node) and its elements, the root first.

    Character references are decoded. End tags may be missing or out of place. A tag, comment or script that isn't ended
    takes the rest of the page; an attribute's quotation that isn't ended counts as none.
    """
    made = _Builder()
    pos, size = 0, len(page)
    while True:
        at = page.find("<", pos)
        if at < 0:
            at = size
        if at > pos:
            made.items.append(unescape(page[pos:at]))
        if at >= size:
            break
        nxt = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            pos = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            made.items.append(page[at + 9 : size if end < 0 else end])
            pos = size if end < 0 else end + 3
        elif nxt in ("!", "?") and nxt:
            end = page.find(">", at)
            pos = size if end < 0 else end + 1
        elif nxt == "/" and (m := NAME.match(page, at + 2)):
            end = page.find(">", m.end())
            pos = size if end < 0 else end + 1
            made.end_tag(m[0].lower())
        elif nxt != "/" and (m := NAME.match(page, at + 1)):
            tag, pos, attrs, alone = m[0].lower(), m.end(), {}, False
            if page[pos : pos + 1] == ">":
                pos += 1
            else:
                while a := ATTR.match(page, pos):
                    attrs.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
                    pos = a.end()
                end = page.find(">", pos)
                if end < 0:
                    break
                alone = page[end - 1] == "/" and tag not in BLOCK
                pos = end + 1
            raw = tag in RAW
            made.start_tag(tag, attrs, alone or raw or tag in VOID)
            if raw and not alone:
                ended = _RAW_END[tag].search(page, pos)
                pos = ended.end() if ended else size
        else:  # no tag begins here
            made.items.append("<")
            pos = at + 1
    made.pop_to(0)
    return made.items, made.nodes


def named_part(node: Node) -> str | None:
    """What a class or id of the element says it is by its whole name: "comments", "part", or null."""
    found = None
    for name in (*node.attrs.get("class", "").split(), node.attrs.get("id", "")):
        words = [w.lower() for w in WORDS.findall(name)]
        if words and all(w in PARTS or w in BESIDE or w.isdigit() for w in words) and any(w in PARTS for w in words):
            if any(w in COMMENTS for w in words):
                return "comments"
            found = "part"
    return found


def hinted_part(node: Node, heading: list[str] | None) -> str | None:
    """What a class or id hints at by its first or last word: "comments", "offer", "bar", or null.

    heading: the words of the element's first heading. An id of these words is made from it.
    """
    if node.tag not in HINTED_TAGS:
        return None
    found = None
    for kind in ("class", "id"):
        for name in node.attrs.get(kind, "").split():
            words = [w.lower() for w in WORDS.findall(name)]
            if not words or any(w in TELLS_NOTHING for w in words) or kind == "id" and words == heading:
                continue
            ends = (words[0], words[-1])
            if any(w in COMMENTS for w in ends):
                return "comments"
            if any(w in OFFERS for w in ends):
                found = "offer"
            elif any(w in PARTS for w in ends):
                found = found or "bar"
    return found


def marks_within(items: list[str | Node], nodes: list[Node]) -> tuple[dict[int, int], dict[int, int], dict[int, list[str]]]:
    """By an element's id(): articles and first-level headings in it, itself included, and the words of its first heading.

    Of a heading its first 63 items (texts and elements' ends) are read, so that headings in headings cost no more.
    """
    articles: dict[int, int] = {}
    titles: dict[int, int] = {}
    headings: dict[int, list[str]] = {}
    for node in reversed(nodes):
        key = id(node)
        n_articles = articles.get(key, 0) + (node.article is node)
        n_titles = titles.get(key, 0) + (node.tag == "h1")
        if node.tag in HEADINGS:
            texts = (x for x in items[node.start + 1 : min(node.end, node.start + 64)] if isinstance(x, str))
            headings[key] = [w.lower() for w in WORDS.findall(" ".join(texts))]
        articles[key], titles[key] = n_articles, n_titles
        if node.parent is not None:
            above = id(node.parent)
            if n_articles:
                articles[above] = articles.get(above, 0) + n_articles
            if n_titles:
                titles[above] = titles.get(above, 0) + n_titles
            if key in headings:
                headings[above] = headings[key]
    return articles, titles, headings


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()


def lengths(items: list[str | Node], nodes: list[Node]) -> None:
    """Texts' lengths, those in links and in headings, links and commas of each element, without what is cut."""
    for node in nodes:
        node.clear()
    at: Node = nodes[0]
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, str):
            n = len(x.strip())
            at.text_len += n
            at.block.own_len += n
            if at.in_link:
                at.link_len += n
                at.block.own_link += n
            if n:
                at.block.commas += x.count(",") + x.count("、") + x.count("，") + x.count("،")
        elif i == x.end:
            if x.parent is not None:
                at = x.parent
        elif x.cut:
            i = x.end
        else:
            at = x
        i += 1
    for node in reversed(nodes):
        if not node.cut and node.parent is not None:
            if node.tag in ("h1", "h2"):
                node.head_len = node.text_len
            node.parent.links += node.links + (node.tag == "a")
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
            node.parent.head_len += node.head_len


#: How names are taken: hints too; whole names only; not for what holds most of the text; not at all.
HINTS, ALL_NAMES, SMALL_PARTS, NO_NAMES = range(4)


def prune(items: list[str | Node], nodes: list[Node], names: int = HINTS) -> bool:
    """Marks what isn't main text: by tag, role and name. Sets the lengths of what is left; whether that is enough.

    What holds the page's main element stays, and so does a form that holds more than half of the page's text and less
    than half of that in links. With SMALL_PARTS the same goes for named parts, but reader comments go however long they
    are. Enough is any text in an article, or a fifth of the text before names were looked at.
    """
    for node in nodes:
        node.cut = node.tag in CUT_TAGS or node.tag not in ("html", "body") and _hidden(node.attrs)
    lengths(items, nodes)
    whole = nodes[0].text_len
    holds: set[int] = set()
    for node in nodes:
        if node.tag == "main" or node.attrs and node.attrs.get("role") == "main":
            while node is not None and id(node) not in holds:
                holds.add(id(node))
                node = node.parent
    for node in nodes:
        if node.cut or node.tag in ("#root", "html", "body") or id(node) in holds:
            continue
        large = node.text_len > whole / 2 and node.density < 0.5
        if node.tag == "form":
            node.cut = not large
        elif node.tag == "header":
            node.cut = (node.article is None or node.article is node) and not large
        if not node.cut and node.attrs and names != NO_NAMES:
            roles = node.attrs.get("role", "").lower().split()
            part = "part" if roles and roles[0] in CUT_ROLES else named_part(node)
            node.cut = part is not None and (names <= ALL_NAMES or part == "comments" or not large)
    if names == HINTS:
        cut_hinted(items, nodes, holds, whole)
    lengths(items, nodes)
    return any(x.article is x and x.text_len for x in nodes) or 5 * nodes[0].text_len >= whole


def cut_hinted(items: list[str | Node], nodes: list[Node], holds: set[int], whole: int) -> None:
    """Marks what a longer name hints at and what it holds bears out, see the module. Lengths must be set."""
    named = [x for x in nodes if x.attrs and not x.cut and ("class" in x.attrs or "id" in x.attrs) and id(x) not in holds]
    if not named:
        return
    articles, titles, headings = marks_within(items, nodes)
    every = articles[id(nodes[0])]
    for node in named:
        key = id(node)
        if titles[key] or every and articles[key] == every:
            continue
        hint = hinted_part(node, headings.get(key))
        if hint == "comments":
            node.cut = True
        elif hint == "offer":
            node.cut = node.text_len < max(200, whole / 20) or node.density >= 1 / 3
        elif hint == "bar":
            node.cut = node.links >= 2 and node.density >= 0.5


def points(node: Node) -> float:
    """What a paragraph is worth: 1, 1 for each comma, up to 3 for its length; less the share of its text in links."""
    if not node.own_len or node.tag in HEADINGS:
        return 0.0
    return (1 + node.commas + min(3.0, node.own_len / 100)) * (1 - node.own_link / node.own_len)


def score(nodes: list[Node]) -> None:
    """Passes each paragraph's points to the blocks above it: whole, half, a quarter, an eighth; whole to its article.

    A block of mixed content, such as a div or a table cell, is its own first container.
    """
    for node in nodes:
        worth = points(node) if node.block is node else 0.0
        if not worth:
            continue
        up = node.parent.block if node.tag in ("p", "li", "dd", "dt", "pre", "blockquote", "caption", "figcaption", "summary") and node.parent else node
        share, article = 1.0, node.article
        while up is not None and share > 0.1:
            up.score += worth * share
            if up is article:
                article.score += worth * (1 - share)
                article = None
            up, share = (up.parent.block if up.parent else None), share / 2
        if article is not None:
            article.score += worth


def children(items: list[str | Node], node: Node):
    i = node.start + 1
    while i < node.end:
        x = items[i]
        if not isinstance(x, str):
            yield x
            i = x.end
        i += 1


def choose(items: list[str | Node], nodes: list[Node]) -> list[Node]:
    """The best container, and those of its siblings that belong to the article, in page order. Of equals the outermost."""
    usable = (x for x in nodes if x.block is x and not x.cut and x.tag not in HEADINGS and x.tag not in ("p", "li", "#root"))
    best = max(usable, key=lambda x: x.worth, default=nodes[0])
    if best.worth <= 0:
        best = nodes[0]
    # References and the like lower an article's worth, but belong to it.
    if best.article is not None and best.article.worth >= 0.25 * best.worth:
        best = best.article
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    least = max(10.0, 0.2 * best.worth)
    own = best.article is best

    def keep(x: Node) -> bool:
        if x is best:
            return True
        if x.cut or not x.text_len:
            return False
        if x.start < best.start and x.head_len > 0.8 * x.text_len:
            return x.density < 0.5
        if own:
            return x.tag == best.tag and x.worth >= least
        if x.tag in ("h1", "h2", "h3"):
            return x.density < 0.5
        return x.worth >= least or x.tag == "p" and x.density < 0.25

    return [x for x in children(items, best.parent) if keep(x)]


def is_menu(node: Node, before: Node | None) -> bool:
    """A list of three links or more and hardly anything else, without a heading of its own, outside any article."""
    return node.tag in ("ul", "ol", "div", "dl", "table") and node.article is None and node.density > 0.8 and node.links >= 3 and (before is None or before.tag not in HEADINGS)


def blocks(items: list[str | Node], chosen: list[Node]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for top in chosen:
        flush()
        i, before = top.start, None
        while i <= top.end:
            x = items[i]
            if isinstance(x, str):
                held.append(x)
            elif x.cut or i < x.end and x is not top and is_menu(x, before):
                i = x.end
            else:
                if x.tag in BLOCK:
                    flush()
                    if i == x.end:
                        before = x
                elif x.tag == "br":
                    held.append(" ")
            i += 1
    flush()
    return out


def extract(page: str) -> str:
    """The main text, one line per block; empty if there is none.

    A page of which too little is left that way is read again with less regard to names.
    """
    items, nodes = parse(page)
    if not any(isinstance(x, str) and not x.isspace() for x in items):
        return ""
    for names in (HINTS, ALL_NAMES, SMALL_PARTS, NO_NAMES):
        if prune(items, nodes, names) or names == NO_NAMES:
            score(nodes)
            if found := blocks(items, choose(items, nodes)):
                return "\n".join(found)
    return ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row. A null page counts as empty: an empty text.

    Ids and addresses pass through as they are, null or repeated; an empty table gives an empty one; columns besides
    the three are not read. White space is what Unicode calls so, non-breaking spaces included. Pages of any length and
    depth are read whole, in time in proportion to their length. What isn't shown (hidden elements, fallbacks of media)
    is no text.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    text = extract(page)
                    yield page_id, url, text, len(text)

        return rebatch(rows(), schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
