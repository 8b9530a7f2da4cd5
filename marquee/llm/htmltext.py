"""Main text of HTML pages by tree scoring; pages stay where they are, no shuffle.

A page is read once into its elements (open and close as browsers do: implied ends of p, li, cells and headings, void and raw-text elements,
comments, missing end tags) and its blocks, the runs of text between block-level borders. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are known by their element, role, class or id and left out with all they hold. Every block of
running text then gives points for its length and commas, less its share of linked text, to the element around it and in smaller parts to those above;
the element with most points, less its own share of linked text, is the container. An `article` around it takes its place.
Of its siblings those stay that score in proportion, are paragraphs, or are headings before one that stays.
Inside, lists and boxes that are nearly all links go. All other blocks are kept, whole and in page order.

Defined results: a null page counts as empty; no container gives an empty text; character references are decoded once, as HTML5 reads them (also
some without a semicolon); white space is Unicode's, so a no-break space becomes a space; br counts as white space; repeated rows give repeated rows;
an empty table gives an empty result; other columns are dropped, so they may have any name.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names, roles and words of class names and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("aside audio button canvas dialog footer form head header iframe map menu nav noembed noframes noscript object script select style svg math template textarea title video xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | LEFT_OUT - {"button", "canvas", "audio", "video", "svg", "math", "map", "object", "select", "textarea"} | frozenset("address article blockquote body caption center dd details dir div dl dt fieldset figcaption figure hgroup hr legend li listing main ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("caption dd dt legend li script style head title tbody td template tfoot th thead tr noscript".split()) | {"dd", "dt", "li"}
PARAGRAPHS = HEADINGS | frozenset("blockquote dd dt figcaption li p pre summary td th".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset(
    "ad adbanner adbox ads adslot adunit advert advertisement advertisements advertising adverts alert alerts anzeige anzeigen aside banner breadcrumb breadcrumbs colophon comment commentaires commentarea commentbox commentform commentlist comments comentario comentarios consent cookie cookiebanner cookiebar cookies copyright disclaimer disqus footer gdpr header kommentar kommentare leftbar login mainmenu mainnav masthead menu menus modal nav navbar navigation navmenu newsletter notice notices notification notifications overlay pagefooter pageheader pager pagination popup promo promotion publicite publicidad recommendations recommended related replies reply respond rightbar search share sharing sidebar sidenav signup sitefooter siteheader sitenav skip social sponsor sponsored submenu subnav subscribe subscription toolbar topbar topnav werbung widget widgets".split()
)
TYPES = frozenset("comment usercomments wpadblock wpfooter wpheader wpsidebar sitenavigationelement".split())
#: Headings under which readers write.
COMMENTS_BELOW = frozenset(("comments", "reader comments", "readers comments", "user comments", "leave a comment", "leave a reply", "kommentare", "leserkommentare", "kommentar schreiben", "commentaires", "laisser un commentaire", "comentarios", "deja un comentario"))
#: Beside these a word only says how the page is laid out around the element.
LAYOUT = frozenset("with has have no not without is".split())
GOOD = frozenset("article blog body content entry main page post story text".split())
SCOPE = frozenset("table td th caption template".split())

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
COMMAS = re.compile("[,،、，]")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element: what it is, and sums over its text."""

    __slots__ = ("chars", "good", "keeps", "linked", "links", "out", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, good: bool = False):
        self.tag, self.parent, self.out, self.good = tag, parent, out or (parent is not None and parent.out), good
        self.chars = self.linked = self.links = 0
        self.points, self.keeps = 0.0, False

    def link_density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


def marked(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether its names promise content."""
    out, good = tag in LEFT_OUT, tag in ("article", "main")
    if out or not attributes.strip():
        return out, good
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or UNSEEN.search(found.get("style", "")):
        return True, good
    if found.get("role", "").lower() in ROLES and tag not in ("body", "main", "article"):
        return True, good
    if found.get("itemtype", "").rpartition("/")[2].lower() in TYPES:
        return True, good
    if found.get("itemprop") == "articleBody" or found.get("role", "").lower() in ("main", "article"):
        good = True
    label = found.get("aria-label", "")
    for name in [*found.get("class", "").split(), found.get("id", ""), label if label.count(" ") < 3 and tag != "article" else ""]:
        parts = {p.lower() for p in NAME_PART.findall(name)}
        bad = parts & (WORDS - {"header"} if tag in HEADINGS else WORDS)
        if bad and not parts & LAYOUT and tag not in ("html", "body", "main"):
            return True, good
        good = good or bool(parts & GOOD and not bad)
    return False, good


class Page:
    """Elements and blocks of one page."""

    def __init__(self, html: str):
        self.nodes = [Node("body", None)]
        self.stack, self.open = [self.nodes[0]], {}
        self.blocks: list[tuple[Node, str, int]] = []
        self.run: list[str] = []
        self.linked = 0
        self.read(html)

    def read(self, html: str) -> None:
        at = 0
        while m := TOKEN.search(html, at):
            self.text(html[at : m.start()])
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self.end(name)
            else:
                self.start(name, m[3])
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                    at = close.start() if close else len(html)
        self.text(html[at:])
        self.border()

    def text(self, text: str) -> None:
        if not text or (self.stack[-1].out and not (self.open.get("head") and text.strip() and self.leave_head())):
            return
        text = unescape(text) if "&" in text else text
        self.run.append(text)
        if self.open.get("a"):
            self.linked += len("".join(text.split()))

    def border(self) -> None:
        """Ends the block that is being read."""
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self.blocks.append((next(n for n in reversed(self.stack) if n.tag in BLOCK), text, self.linked))
            self.run, self.linked = [], 0

    def leave_head(self) -> bool:
        """Content after an open head closes it, unless it stands inside an element of the head."""
        if self.stack[-1].tag == "head":
            self.pop_to("head")
            return not self.stack[-1].out
        return False

    def pop_to(self, *tags: str) -> None:
        if any(n.tag in BLOCK for n in self.stack[self.depth(tags) :]):
            self.border()
        while True:
            tag = self.stack.pop().tag
            self.open[tag] -= 1
            if tag in tags:
                return

    def depth(self, tags: tuple[str, ...]) -> int:
        return next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag in tags)

    def close(self, tags: tuple[str, ...], within: frozenset[str] | set[str]) -> None:
        """Closes the innermost of `tags` if it is open and no element of `within` stands between."""
        if not any(self.open.get(t) for t in tags):
            return
        for n in reversed(self.stack):
            if n.tag in tags:
                return self.pop_to(*tags)
            if n.tag in within:
                return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            if self.open.get("head"):
                self.pop_to("head")
            return
        if self.open.get("head") and tag not in IN_HEAD and self.stack[-1].tag == "head":
            self.pop_to("head")
        if tag in ENDS_P:
            self.close(("p",), SCOPE | {"button", "object"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(*HEADINGS)
        elif tag == "li":
            self.close(("li",), {"ul", "ol", "menu", "table"})
        elif tag in ("dd", "dt"):
            self.close(("dd", "dt"), {"dl", "table"})
        elif tag in ("td", "th"):
            self.close(("td", "th"), {"tr", "table"})
        elif tag in ("tr", "tbody", "thead", "tfoot"):
            self.close(("tr",) if tag == "tr" else ("tbody", "thead", "tfoot"), {"table"})
        elif tag == "a":
            self.close(("a",), BLOCK)
        if tag in BLOCK:
            self.border()
        if tag in VOID:
            if tag == "br":
                self.text(" ")
            return
        out, good = marked(tag, attributes)
        node = Node(tag, self.stack[-1], out, good)
        if not node.out:
            self.nodes.append(node)
        elif tag in BLOCK or out:
            self.text(" ")
        if tag == "a":
            node.links = 1
        self.stack.append(node)
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if tag in HEADINGS:
            self.close(tuple(HEADINGS), SCOPE)
        elif tag in BLOCK or tag in LEFT_OUT:
            self.close((tag,), set() if tag in ("table", "td", "th", "caption", "tr", "tbody", "thead", "tfoot", "template") else SCOPE)
        elif tag == "br":
            self.text(" ")
        else:
            self.close((tag,), BLOCK - {tag})

    def without_comments(self) -> None:
        """Drops what follows a heading of readers' comments in the element that holds it, and the heading."""
        ended: set[Node] = set()
        kept = []
        for block in self.blocks:
            node = block[0]
            if node.tag in HEADINGS and "".join(c for c in block[1].lower() if c.isalpha() or c == " ").strip() in COMMENTS_BELOW:
                ended.add(node.parent)
            while ended and node is not None and node not in ended:
                node = node.parent
            if not ended or node is None:
                kept.append(block)
        self.blocks = kept

    def main_blocks(self) -> list[str]:
        self.without_comments()
        own: dict[Node, list[tuple[str, int]]] = {}
        for node, text, linked in self.blocks:
            own.setdefault(node, []).append((text, linked))
            node.chars += len(text.replace(" ", ""))
            node.linked += linked
        for node, texts in own.items():
            self.give(node, texts)
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.linked += node.linked
                node.parent.links += node.links
        best, most = None, 0.0
        for node in self.nodes:
            if node.tag not in PARAGRAPHS and node.tag in BLOCK and node.chars:
                node.points = (node.points + (25 if node.tag == "article" else 10 if node.good else 0)) * (1 - node.link_density())
                if node.points > most:
                    best, most = node, node.points
        if best is None:
            return []
        above = best
        while above is not None and above.tag != "article":
            above = above.parent
        best = above or best
        best.keeps = True
        if best.parent is not None and best.tag != "article":
            self.keep_siblings(best, most)
        for node in self.nodes:
            if node.parent is not None and node.parent.keeps:
                node.keeps = not (node.tag in ("div", "ul", "ol", "dl", "section", "table", "td") and node.links > 1 and node.link_density() >= 0.8)
        return [text for node, text, _ in self.blocks if node.keeps]

    @staticmethod
    def give(node: Node, texts: list[tuple[str, int]]) -> None:
        """Points of an element's own blocks to the element that holds them and, in smaller parts, to those above."""
        if node.tag in HEADINGS:
            return
        points = 0.0
        for text, linked in texts:
            points += (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * max(0.0, 1 - linked / max(1, len(text)))
        holder, part = (node.parent if node.tag in PARAGRAPHS else node), 1.0
        for nth in range(5):
            if holder is None:
                return
            holder.points += points * part
            holder, part = holder.parent, 0.5 if nth == 0 else 1 / (3 * (nth + 1))

    def keep_siblings(self, best: Node, most: float) -> None:
        beside = [n for n in self.nodes if n.parent is best.parent]
        following = False
        for n in reversed(beside):
            if n.tag not in HEADINGS:
                running = n.tag in PARAGRAPHS and n.chars and n.link_density() < 0.25
                following = n is best or running or n.points >= max(10.0, 0.2 * most)
            n.keeps = following


def main_text(html: str) -> str:
    return " ".join(Page(html).main_blocks())


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url and text, the main text of every page."""

    def extract(batches):
        import pyarrow as pa

        for batch in batches:
            texts = pa.array((main_text(h.as_py() or "") for h in batch.column("html")), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), texts], names=["id", "url", "text"])

    kinds = f"id {pages.schema[id_col].dataType.simpleString()}, url {pages.schema[url_col].dataType.simpleString()}, text string"
    return pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(extract, kinds)
