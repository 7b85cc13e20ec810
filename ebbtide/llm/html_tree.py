"""Pages as trees of blocks: a tolerant reader of HTML and the features of its nodes.

Only elements that part blocks are nodes; inline elements are transparent, and their text runs
together.  A node is an element with text under it, or a leaf: the text between two block borders.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements of the language by their role.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea".split())
#: Text in these is never shown as text of the page.
SILENT = frozenset("script style head title noscript template textarea select option optgroup datalist button iframe object "
                   "svg canvas audio video map xmp noembed noframes".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Start tag to the open elements that it ends, and where the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
        "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
#: Words of class, id and role by what they tell; the weights are learned.
FRAME_WORDS = frozenset("""ad ads advert advertisement banner bar billboard bottom breadcrumb breadcrumbs comment comments consent
cookie cookies copyright discussion disclaimer disqus feedback foot footer form gdpr head header hidden legal links login masthead menu meta modal
more nav navbar navigation newsletter note notice notices overlay pager pagination paywall popular popup privacy promo promoted promotion rail
recommend recommended related replies reply respond search share sharing side sidebar signup skip skyscraper social sponsor
sponsored sticky subscribe tags teaser thread toolbar top topbar tracking trending warning widget widgets complementary contentinfo
alert alertdialog dialog aside reader reactions""".split())
BODY_WORDS = frozenset("""article articlebody body blog content copy entry main maincontent news page paragraph post prose read
story text""".split())

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)|[^>]*+)>"
                    r"|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}


@dataclass
class Page:
    """Nodes in page order, parents before children; node 0 is the root."""
    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    attributes: list[str] = field(default_factory=lambda: [""])
    silent: list[bool] = field(default_factory=lambda: [False])
    #: Leaves only: decoded text with single spaces, and the characters of it in links.
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, tag: str, attributes: str, silent: bool, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.silent.append(silent)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


def read(source: str) -> Page:
    """The tree of a page.  Unclosed, unopened and crossed tags end up as browsers would have the blocks."""
    page, stack = Page(), [0]
    run: list[str] = []  # pieces of the open leaf
    linked: list[str] = []
    link_depth = 0  # depth at which the open link began; 0: none

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                inside = len(" ".join(html.unescape("".join(linked)).split())) if linked else 0
                page.add(stack[-1], "#text", "", page.silent[stack[-1]], text, inside)
            run.clear()
            linked.clear()

    def close(to: int) -> None:
        nonlocal link_depth
        flush()
        del stack[to:]
        if link_depth > to:
            link_depth = 0

    def put(piece: str) -> None:
        run.append(piece)
        if link_depth:
            linked.append(piece)

    at = 0
    while True:
        found = _TOKEN.search(source, at)
        if found is None:
            put(source[at:])
            break
        if found.start() > at:
            put(source[at:found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in INLINE:
                if tag == "a":
                    link_depth = 0
            elif tag not in VOID:
                for depth in range(len(stack) - 1, 0, -1):
                    name = page.tag[stack[depth]]
                    if name == tag:
                        close(depth)
                        break
                    if name in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                        break
            elif tag == "br":
                put(" ")
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                put(" ")
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                link_depth = len(stack)
            continue
        if tag in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                name = page.tag[stack[depth]]
                if name == "p":
                    close(depth)
                    break
                if name not in ("#text",) and name != "p":
                    break
        ends = ENDS.get(tag)
        if ends:
            lowest = 0
            for depth in range(len(stack) - 1, 0, -1):
                name = page.tag[stack[depth]]
                if name in ends[1]:
                    break
                if name in ends[0]:
                    lowest = depth
            if lowest:
                close(lowest)
        flush()
        attributes = found[3] or ""
        stack.append(page.add(stack[-1], tag, attributes, page.silent[stack[-1]] or tag in SILENT))
        if tag in RAW:
            end = _END_OF[tag].search(source, at)
            at = len(source) if end is None else end.end()
            close(len(stack) - 1)
        elif attributes.rstrip().endswith("/") and "-" in tag:
            close(len(stack) - 1)
    close(1)
    return page


def _words_of(attributes: str) -> tuple[list[str], bool]:
    """Lower-case words of the naming attributes, and whether the element is hidden."""
    words, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role", "itemprop"):
            words += [w.lower() for w in _PART.findall(value)]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return words, hidden


_ELEMENTS: dict[tuple[str, str, str], tuple[str, ...]] = {}


def element_features(tag: str, attributes: str, above: str) -> tuple[str, ...]:
    """Names of the features of an element below an element ``above``."""
    key = (tag, attributes, above)
    have = _ELEMENTS.get(key)
    if have is None:
        words, hidden = _words_of(attributes) if attributes else ([], False)
        seen = dict.fromkeys(words)
        frame, body = any(w in FRAME_WORDS for w in seen), any(w in BODY_WORDS for w in seen)
        have = (f"tag:{tag}", f"tag:{tag}<{above}", *(f"word:{w}" for w in seen),
                *(["frame"] if frame else []), *(["body"] if body and not frame else []),
                *(["frame body"] if body and frame else []), *(["bare"] if not words else []), *(["hidden"] if hidden else []))
        if len(_ELEMENTS) > 50_000:
            _ELEMENTS.clear()
        _ELEMENTS[key] = have
    return have


def amount(n: int) -> int:
    return min(n.bit_length(), 8)


def share(part: int, total: int) -> int:
    return 0 if not part else 1 if 3 * part < total else 2 if 3 * part < 2 * total else 3


@dataclass
class Forest:
    """Nodes with text of one or more pages: parent place (-1: root), depth, leaf flags, feature
    names, page number, and the text of leaves."""
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    leaf: list[bool] = field(default_factory=list)
    silent: list[bool] = field(default_factory=list)
    features: list[tuple[str, ...]] = field(default_factory=list)
    page: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    pages: int = 0

    def grow(self, page: Page) -> None:
        """Append the nodes of a page that have text under them."""
        n = len(page.parent)
        words, chars, links = [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            text = page.text[i]
            if text is not None:
                words[i], chars[i], links[i] = text.count(" ") + 1, len(text), page.linked[i]
            up = page.parent[i]
            if up >= 0:
                words[up] += words[i]
                chars[up] += chars[i]
                links[up] += links[i]
        place = [-1] * n
        for i in range(n):
            if not words[i]:
                continue
            up = page.parent[i]
            above = page.tag[up] if up >= 0 else ""
            text = page.text[i]
            linked = share(links[i], chars[i])
            if text is None:
                own = (*element_features(page.tag[i], page.attributes[i], above), f"under:{amount(words[i])}", f"links:{linked}")
            else:
                end = "end" if text[-1] in ".!?…。！？:;\"”»" else "open"
                mark = ("sign",) if "©" in text or "opyright" in text else ()
                own = (f"leaf:{amount(words[i])}:{linked}", f"in:{above}", f"{end}:{min(amount(words[i]), 4)}", *mark)
            place[i] = len(self.parent)
            self.parent.append(place[up] if up >= 0 else -1)
            self.depth.append(self.depth[place[up]] + 1 if up >= 0 else 0)
            self.leaf.append(text is not None)
            self.silent.append(page.silent[i])
            self.features.append(own)
            self.page.append(self.pages)
            self.text.append(text)
        self.pages += 1
