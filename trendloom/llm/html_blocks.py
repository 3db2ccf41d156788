"""Text blocks of a web page: a forgiving reading of its markup, and what the markup says about each block."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from math import log1p

# Fixed values of the HTML standard: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Elements whose whole content is never text of the page.
UNSEEN = frozenset("head template noscript svg math object canvas audio video select datalist map".split())
BLOCK = frozenset(
    """html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6
    header hgroup li main menu nav ol p pre search section summary table caption colgroup thead tbody tfoot tr td th ul legend listing optgroup option""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption".split())
ITEMS = frozenset("li td th dd dt caption summary legend option".split())
#: Blocks of these stand beside each other in the element that holds them.
LEAVES = HEADINGS | PARAGRAPHS | ITEMS
#: A start tag ends an open element of these, up to the nearest of the scope.
ENDS = {
    **{t: ("p",) for t in BLOCK - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot", "colgroup", "option", "optgroup", "legend"}},
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"),
    "tr": ("tr",), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"), "hr": ("p",),
}
SCOPES = {
    "li": frozenset("ul ol menu table html".split()), "dd": frozenset("dl table html".split()), "dt": frozenset("dl table html".split()), "td": frozenset(("tr", "table", "html")),
    "th": frozenset(("tr", "table", "html")), "tr": frozenset(("table", "html")), "tbody": frozenset(("table", "html")), "tfoot": frozenset(("table", "html")),
}
#: No paragraph is ended from inside one of these.
P_SCOPE = frozenset("button table td th caption object template html".split())

# What names of classes, ids and roles say.  A name that follows "no", "has", "with" or "without" says nothing.
AGAINST = frozenset(
    """ad ads adbox adsense adslot advert adverts advertisement advertising advertorial affiliate alert alerts announcement author-box badge banner banners bio breadcrumb
    breadcrumbs byline-box callout captcha colophon consent cookie cookies copyright cta dialog disclaimer disclosure discussion dropdown footer footnav form forms gdpr header
    hidden infobar jumplinks legal links login masthead menu menus message meta modal nav navbar navbox navigation navigator newsletter notice notices notification
    notifications offcanvas overlay pager paginate pagination paywall popover popular popup privacy promo promoted promotion promotions rail ratings recirc recommend
    recommendation recommendations recommended register related search share shares sharing shop sidebar sidebars sidenav signin signup sitemap skip social sponsor sponsored
    sponsors subnav subscribe subscription tabs tagcloud tags teaser teasers toast toolbar tooltip topbar trending warning widget widgets""".split()
)
#: These hold for everything inside, whatever other names stand there.
FIRMLY_AGAINST = frozenset("ad ads adbox adsense adslot advert adverts advertisement advertising comment comments commentlist disqus replies reply respond sponsored cookie consent gdpr reactions".split())
FOR = frozenset("article articlebody body content entry essay main maincontent post prose story text copy longform".split())
NEUTRALISERS = frozenset("no has with without not hide is".split())
ROLES_AGAINST = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog status tablist tooltip".split())
ROLES_FOR = frozenset(("main", "article"))

NEUTRAL, WEAK, FIRM = 0, 1, 2

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|\"|')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME_BREAK = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_STOPS = re.compile(r"[.!?…。！？]")


@dataclass(slots=True)
class Element:
    """An open or closed element: its kind, the one it lies in, and what the markup says about text in it."""

    tag: str
    parent: int
    depth: int
    evidence: int  # -1 against, 0 nothing, 1 for
    firmness: int
    inside_main: bool
    unseen: bool


@dataclass(slots=True)
class Block:
    """One stretch of text between block boundaries, white space collapsed."""

    text: str
    link_chars: int
    element: int
    tag: str
    evidence: int


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)


def _names(value: str) -> list[str]:
    return [n for n in _NAME_BREAK.split(_CAMEL.sub("-", value).lower()) if n]


def _spoken(tag: str, attributes: dict[str, str]) -> tuple[int, int]:
    """(evidence, firmness) of an element by its own tag, role and names."""
    names = _names(attributes.get("class", "")) + _names(attributes.get("id", ""))
    told = [n for i, n in enumerate(names) if not (i and names[i - 1] in NEUTRALISERS)] if names else names
    role = attributes.get("role", "").lower().strip()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or ("style" in attributes and _HIDDEN.search(attributes["style"])):
        return -1, FIRM
    if any(n in FIRMLY_AGAINST for n in told):
        return -1, FIRM
    if tag in ("nav", "aside", "dialog", "menu", "button", "fieldset", "search"):
        return -1, FIRM
    if role in ROLES_FOR or tag == "main" or attributes.get("itemprop", "").lower() == "articlebody":
        return 1, FIRM
    if tag == "article":
        return 1, WEAK
    if role in ROLES_AGAINST:
        return -1, WEAK
    if tag in ("footer", "form"):
        return -1, WEAK
    if any(n in AGAINST for n in told):
        return -1, WEAK
    if any(n in FOR for n in told):
        return 1, NEUTRAL
    if tag == "header":
        return -1, NEUTRAL
    return 0, NEUTRAL


def _evidence(tag: str, raw: str, parent: Element) -> tuple[int, int, bool]:
    """(evidence, firmness, inside a main part) of an element within its parent.

    The nearest element that says something decides, with these exceptions:
    what lies in a firm place against stays there (comments, navigation,
    advertising), unless a main part begins; a name for content inside a
    weak place against changes nothing, an article does; the header of an
    article is part of it.
    """
    if tag not in BLOCK and not raw:
        return parent.evidence, parent.firmness, parent.inside_main
    attributes = {m[1].lower(): html.unescape(next((v for v in m.group(2, 3, 4) if v is not None), "")) for m in reversed(list(_ATTRIBUTE.finditer(raw)))} if raw and not raw.isspace() else {}
    said, firmness = _spoken(tag, attributes)
    if said == 0 or tag in ("html", "body"):
        return parent.evidence, parent.firmness, parent.inside_main
    if said > 0:
        opens = firmness == FIRM or (firmness == WEAK and parent.firmness < FIRM)
        if parent.evidence >= 0 or (opens and not (parent.firmness == FIRM and parent.inside_main)):
            return 1, NEUTRAL, parent.inside_main or firmness >= WEAK
        return parent.evidence, parent.firmness, parent.inside_main
    if tag == "header" and firmness == NEUTRAL and parent.evidence > 0:
        return parent.evidence, parent.firmness, parent.inside_main
    return -1, max(firmness, parent.firmness if parent.evidence < 0 else NEUTRAL), parent.inside_main


def read_page(source: str) -> Page:
    """The text blocks of a page in order, with the elements they lie in.

    Reads markup as browsers do where it matters for text: raw content of
    scripts and styles, comments, omitted end tags, stray end tags, quoted
    attributes with angle brackets, cut-off pages.  Character references are
    decoded; ``<br>`` and other white space become one space.
    """
    page = Page()
    elements, blocks = page.elements, page.blocks
    elements.append(Element("#page", -1, 0, 0, NEUTRAL, False, False))
    stack = [0]
    pieces: list[str] = []
    linked: list[str] = []
    owner = 0
    links = 0
    lowered = None
    still_open: Counter[str] = Counter()

    def flush() -> None:
        nonlocal owner
        text = " ".join("".join(pieces).split())
        if text:
            element = elements[owner]
            blocks.append(Block(text, min(len(text), sum(map(len, linked))), owner, element.tag, element.evidence))
        pieces.clear()
        linked.clear()

    def add(text: str) -> None:
        nonlocal owner
        top = elements[stack[-1]]
        if top.unseen:
            return
        if "&" in text:
            text = html.unescape(text)
        if not pieces or text and not text.isspace() and all(p.isspace() for p in pieces):
            at = stack[-1]
            while at and elements[at].tag not in BLOCK and elements[at].evidence == elements[elements[at].parent].evidence:
                at = elements[at].parent
            owner = at
        pieces.append(text)
        if links:
            linked.append("".join(text.split()))

    def close(count: int) -> None:
        nonlocal links
        for at in reversed(stack[len(stack) - count :]):
            tag = elements[at].tag
            if tag in BLOCK or elements[at].evidence != elements[elements[at].parent].evidence:
                flush()
            still_open[tag] -= 1
            if tag == "a":
                links -= 1
        del stack[len(stack) - count :]

    position = 0
    while True:
        found = _TOKEN.search(source, position)
        if found is None:
            if position < len(source):
                add(source[position:])
            break
        if found.start() > position:
            add(source[position : found.start()])
        position = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # an end tag
            if tag == "br":
                add(" ")
            elif not still_open[tag] and tag not in HEADINGS:
                continue
            elif tag in BLOCK or tag in UNSEEN:
                for back in range(1, len(stack)):
                    other = elements[stack[-back]].tag
                    if other == tag or (tag in HEADINGS and other in HEADINGS):
                        close(back)
                        break
                    if other in ("table", "td", "th", "caption", "template") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body", "html"):
                        break
            else:
                for back in range(1, len(stack)):
                    other = elements[stack[-back]].tag
                    if other == tag:
                        close(back)
                        break
                    if other in BLOCK:
                        break
            continue
        if tag in RAW:
            if lowered is None:
                lowered = source.lower() if len(source.lower()) == len(source) else re.sub("[A-Z]", lambda m: m[0].lower(), source)
            end = position
            while True:
                end = lowered.find("</" + tag, end)
                if end < 0:
                    position = len(source)
                    break
                after = end + 2 + len(tag)
                if after >= len(source) or source[after] in " \t\n\r\f/>":
                    position = source.find(">", after) + 1 or len(source)
                    break
                end = after
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            if tag != "hr":
                continue
        for ended in ENDS.get(tag, ()):
            if not still_open[ended]:
                continue
            scope = P_SCOPE if ended == "p" else SCOPES.get(tag, P_SCOPE)
            for back in range(1, len(stack)):
                other = elements[stack[-back]].tag
                if other == ended:
                    close(back)
                    break
                if other in scope:
                    break
        if tag == "hr":
            continue
        if tag == "body" and elements[stack[-1]].unseen:  # a head that never ended
            close(len(stack) - 1)
        if tag == "a" and links:  # links do not nest
            for back in range(1, len(stack)):
                if elements[stack[-back]].tag == "a":
                    close(back)
                    break
        top = elements[stack[-1]]
        if tag in BLOCK:
            flush()
        evidence, firmness, inside_main = _evidence(tag, found[3], top)
        if tag not in BLOCK and evidence != top.evidence:
            flush()
        elements.append(Element(tag, stack[-1], top.depth + 1, evidence, firmness, inside_main, top.unseen or tag in UNSEEN))
        if found[3].endswith("/") and tag not in BLOCK and tag in UNSEEN:
            continue
        stack.append(len(elements) - 1)
        still_open[tag] += 1
        if tag == "a":
            links += 1
    flush()
    return page


def home(page: Page, block: Block) -> int:
    """The element whose children the block stands among."""
    at = block.element
    while at and page.elements[at].tag not in BLOCK:
        at = page.elements[at].parent
    return page.elements[at].parent if at and page.elements[at].tag in LEAVES else at


FEATURES = ("chars", "link_share", "stops", "ends_sentence", "heading", "paragraph", "item", "bare", "chars_before", "chars_after", "links_before", "links_after", "edge", "one")


def block_features(blocks: list[Block]) -> list[list[float]]:
    """One row of ``FEATURES`` per block, from its text, its tag and its neighbours; names and places in the markup are not among them."""
    size = [log1p(len(b.text)) / 5 for b in blocks]
    link = [b.link_chars / len(b.text) for b in blocks]
    last = len(blocks) - 1
    rows = []
    for i, b in enumerate(blocks):
        tail = b.text[-1]
        rows.append([
            size[i], link[i], log1p(len(_STOPS.findall(b.text))), float(tail in ".!?…\"”»。！？"),
            float(b.tag in HEADINGS), float(b.tag in PARAGRAPHS), float(b.tag in ITEMS), float(b.tag not in LEAVES),
            size[i - 1] if i else 0.0, size[i + 1] if i < last else 0.0, link[i - 1] if i else 1.0, link[i + 1] if i < last else 1.0,
            (2 * i / last - 1) ** 2 if last else 0.0, 1.0,
        ])
    return rows
