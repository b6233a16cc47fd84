"""A forgiving HTML reader: a tree of block elements with their text, menus and other furniture marked."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img picture source".split()
)
#: A start tag closes an open element of these names, up to the nearest fence.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
FENCE = frozenset("html body div section article main aside nav header footer table ul ol dl form fieldset".split())
TABLE_FENCE = frozenset("html body table".split())
LIST_FENCE = frozenset("html body ul ol dl table".split())
#: Elements that never hold main text; a form does if it is wrapped around the page.
FURNITURE = frozenset(
    "head script style noscript template iframe object embed svg canvas button input select textarea title nav "
    "footer aside dialog menu audio video".split()
)
#: Words of class, id or role names that mark what readers or advertisers add: never main text.
FOREIGN = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr comment "
    "comments disqus reply replies respond responses feedback discussion talkback newsletter subscribe subscription signup "
    "login".split()
)
#: Words that mark furniture, and words that clear a name of the suspicion.
CUES = FOREIGN | frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar sidenav footer header masthead notice alert popup modal "
    "overlay related recommended share sharing social search widget toolbar pagination pager skip complementary contentinfo "
    "hidden".split()
)
CLEARS = frozenset("with without has no".split())
#: Words that say nothing about what an element holds; inside main text a name marks furniture if it has no others.
NEUTRAL = frozenset(
    "area bar block blocks body bottom box button buttons center col column container content count desktop div entry "
    "field form frame global group heading holder icon icons inner item items js jp left line link links list lists local "
    "main message messages middle mobile module node outer page panel policy post posts primary region right root row second "
    "secondary section site slot slots space stories story sub tag text thread title top unit user view wide wp wrap wrapper "
    "article articles blog fb twitter us".split()
)
#: Owners of a header that belongs to the text.
OWNERS = frozenset("article post entry story".split())
MAIN = frozenset("article main content post entry story".split())

_TAG = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """A block element; `items` holds text pieces (str), (str,) for link text, None for a line break, and Nodes."""

    __slots__ = ("tag", "label", "parent", "items", "furniture", "main")

    def __init__(self, tag: str, label: str, parent: Node | None, furniture: int, main: bool):
        self.tag, self.label, self.parent, self.furniture, self.main = tag, label, parent, furniture, main
        self.items: list = []

    def blocks(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape((value or "").strip("\"'")) for name, value in _ATTRIBUTE.findall(raw)}


#: Grades of furniture: none, suspected (kept if the page's text is in it), foreign (kept only if nothing else is left), certain.
PLAIN, SUSPECTED, STRANGE, CERTAIN = range(4)


def _kind(tag: str, attributes: dict[str, str], inside_main: bool) -> tuple[str, int, bool]:
    """Label, grade of furniture, whether a main-content element."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()
    label = f"{tag}.{attributes['class'].split()[0]}" if attributes.get("class", "").split() else tag
    grade = max((suspicion(n, inside_main) for n in names), default=PLAIN)
    if tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article"):
        return label, grade if tag == "article" else PLAIN, grade == PLAIN or tag != "article"
    if tag in ("html", "body"):
        return label, PLAIN, False
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", ""))
    if tag in FURNITURE or hidden or (tag == "header" and not inside_main):
        return label, CERTAIN, False
    return label, max(grade, SUSPECTED) if tag == "form" else grade, False


@lru_cache(1 << 16)
def suspicion(name: str, inside_main: bool = False) -> int:
    """Grade of furniture that a class, id or role name speaks for.

    Glued words (`commentlist`, `adslot`, `topnav`) are split if both halves are known. Inside main text a name with a
    word of its own (`search-engines`) marks nothing.
    """
    parts: set[str] = set()
    for p in _PARTS.findall(name):
        word = p.lower()
        cut = next((k for k in range(2, len(word) - 1) if word not in CUES and _known(word[:k], word[k:])), 0)
        parts |= {word[:cut], word[cut:]} if cut else {word}
    found = parts & CUES
    if not found or parts & CLEARS or (found == {"header"} and parts & OWNERS):
        return PLAIN
    if inside_main and parts - CUES - NEUTRAL:
        return PLAIN
    return STRANGE if found & FOREIGN else SUSPECTED


def _known(a: str, b: str) -> bool:
    return (a in CUES and (b in NEUTRAL or b in CUES)) or (b in CUES and a in NEUTRAL)


class Reader:
    """Builds the block tree of one page. Furniture stays in it, with its grade, but for what never holds text."""

    def __init__(self, html: str):
        self.root = Node("#root", "#root", None, PLAIN, False)
        self.node = self.root
        #: Open elements: (tag, the block node current before it, link depth, furniture depth, main depth), and their number by tag.
        self.open: list[tuple[str, Node, int, int, int]] = []
        self.known: Counter[str] = Counter()
        self.links = self.gone = self.mains = 0
        self._read(html)

    def _text(self, text: str) -> None:
        if text and not self.gone:
            clean = unescape(text)
            self.node.items.append((clean,) if self.links else clean)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._text(html[at:])
                return
            self._text(html[at:lt])
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 4)
                if end < 0:
                    return
                at = end + 3
            elif html.startswith(("<!", "<?"), lt):
                end = html.find(">", lt)
                if end < 0:
                    return
                at = end + 1
            else:
                closing = html.startswith("</", lt)
                name = _NAME.match(html, lt + 1 + closing)
                if not name:  # a bare sign
                    self._text("<")
                    at = lt + 1
                    continue
                tag = name.group().lower()
                m = _TAG.match(html, name.end())
                end = m.end() if m else html.find(">", name.end()) + 1
                if end <= 0:
                    return
                if closing:
                    self._close(tag)
                else:
                    self._start(tag, html[name.end() : end - 1])
                    if tag in RAW and html[end - 2 : end - 1] != "/":
                        end = self._raw(tag, html, end)
                at = end

    def _raw(self, tag: str, html: str, at: int) -> int:
        m = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
        self._close(tag)
        return m.end() if m else len(html)

    def _implied(self, tag: str) -> None:
        if tag in CLOSES:
            fence = TABLE_FENCE if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else LIST_FENCE
            self._pop_to(CLOSES[tag], fence)
        if tag not in INLINE and tag not in VOID | {"script", "style", "template"} or tag == "hr":
            self._pop_to(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag[0] == "h" and tag[1:].isdigit() else ("p",), FENCE)

    def _pop_to(self, names: tuple[str, ...], fence: frozenset[str]) -> None:
        if not any(self.known[n] for n in names):
            return
        for i in range(len(self.open) - 1, -1, -1):
            tag = self.open[i][0]
            if tag in names:
                self._cut(i)
                if len(names) == 1:
                    return
            elif tag in fence:
                return

    def _cut(self, i: int) -> None:
        _, self.node, self.links, self.gone, self.mains = self.open[i]
        for x in self.open[i:]:
            self.known[x[0]] -= 1
        del self.open[i:]

    def _start(self, tag: str, raw: str) -> None:
        self._implied(tag)
        if tag in VOID:
            if tag in ("br", "hr") and not self.gone:
                self.node.items.append(None)
            return
        attributes = _attributes(raw) if raw.strip(" /") else {}
        label, grade, main = _kind(tag, attributes, self.mains > 0)
        self.open.append((tag, self.node, self.links, self.gone, self.mains))
        self.known[tag] += 1
        self.links += tag == "a"
        self.mains += main
        if grade == CERTAIN:
            self.gone += 1
        elif not self.gone and (tag not in INLINE or grade):
            child = Node(tag, label, self.node, grade, main)
            self.node.items.append(child)
            self.node = child
        if raw.endswith("/") and tag not in RAW and tag not in INLINE and tag not in FENCE and tag != "p":
            self._close(tag)

    def _close(self, tag: str) -> None:
        if not self.known[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return
            if self.open[i][0] in FENCE and tag in INLINE | {"p", "li"}:
                return


def _order(root: Node) -> list[Node]:
    """Nodes below and with root, owners first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(node.blocks())
    return out


def prune(root: Node, strict: bool = True) -> Node:
    """Takes furniture out of the tree, unless the page's text is in it.

    A suspected element (a name such as `sidebar` on a layout, a form around the page) stays if it holds all main
    elements of the page and more text than lies outside of all furniture, or, on a page without main elements, more
    than half of all text outside links. Strange ones (comments, adverts) go unless not strict.
    """
    nodes = _order(root)
    at = {id(n): k for k, n in enumerate(nodes)}
    size, mains, inside = [0] * len(nodes), [0] * len(nodes), [False] * len(nodes)
    plain = 0
    for k, n in enumerate(nodes):
        inside[k] = n.furniture > PLAIN or (n.parent is not None and inside[at[id(n.parent)]])
    for k in range(len(nodes) - 1, -1, -1):
        n = nodes[k]
        if strict and n.furniture == STRANGE:
            continue
        own = sum(len(x.strip()) for x in n.items if isinstance(x, str))
        size[k] += own
        plain += 0 if inside[k] else own
        mains[k] += n.main and size[k] > 0
        if n.parent is not None:
            size[at[id(n.parent)]] += size[k]
            mains[at[id(n.parent)]] += mains[k]
    gone: set[int] = set()
    for k, n in enumerate(nodes[1:], 1):
        if n.furniture:
            holds = mains[k] == mains[0] and size[k] >= plain if mains[0] else 2 * size[k] > size[0]
            if not holds or not size[k] or (n.furniture == STRANGE and strict):
                gone.add(id(n))
    for n in nodes if gone else ():
        if any(id(x) in gone for x in n.blocks()):
            n.items = [x for x in n.items if id(x) not in gone]
    return root


def lines(node: Node) -> list[str]:
    """Blocks of text below a node in page order, white space inside each turned into one space."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACES.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack = [(iter(node.items), node.tag)]
    while stack:
        for item in stack[-1][0]:
            if item is None:
                flush()
            elif isinstance(item, Node):
                if item.tag not in INLINE:
                    flush()
                stack.append((iter(item.items), item.tag))
                break
            else:
                run.append(item if isinstance(item, str) else item[0])
        else:
            if stack.pop()[1] not in INLINE:
                flush()
    flush()
    return out


def parse(html: str | None, strict: bool = True, whole: bool = False) -> Node:
    """The block tree of a page without its furniture (with it if `whole`)."""
    root = Reader(html or "").root
    return root if whole else prune(root, strict)
