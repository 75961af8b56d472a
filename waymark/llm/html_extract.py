"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks.  A classifier gives each block a cost of calling it content and a cost of calling it
boilerplate: capacities of its arcs to the two terminals.  Neighbouring blocks, and blocks of one
parent, are joined by smoothness arcs.  The minimum cut (by maximum flow) is the cheapest labelling of the
whole page; blocks on the content side are the text.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free_name

# Fixed values of HTML: kinds of elements by what they mean for blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea".split())
#: Their text, if any, is not the page's.  Without an end tag they count as empty: what follows is no part of them.
EMBEDDED = frozenset("noscript template iframe object svg canvas select datalist button audio video noframes annotation annotation-xml".split())
#: End tags may be left out; the next option, any block and the end of the list end them.
OPTIONS = frozenset("option optgroup".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr img input"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Open elements that the start of one ends, its end tags being left out.
CLOSES = {
    "li": frozenset(("p", "li")),
    "dt": frozenset(("p", "dt", "dd")),
    "dd": frozenset(("p", "dt", "dd")),
    "td": frozenset(("p", "td", "th")),
    "th": frozenset(("p", "td", "th")),
    "tr": frozenset(("p", "td", "th", "tr")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), frozenset(("p", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"))),
    **dict.fromkeys(CLOSES_PARAGRAPH, frozenset(("p",))),
}

#: Words in an element's name, class, id or role that speak against its text (or, below, for it).
AGAINST = frozenset(
    "nav navbar navigation menu menubar menus breadcrumb breadcrumbs header masthead topbar footer foot colophon copyright sidebar side aside rail"
    " complementary ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search social share"
    " sharing follow related recommended recommendations more widget widgets tag tags pagination pager toolbar skip comment comments commentlist"
    " reply replies respond responses disqus discussion disclaimer legal sitemap byline hidden contentinfo dialog toc teaser".split()
)
FOR = frozenset("article main content story post entry body text maincontent articlebody prose page".split())
#: Words that leave the sense of a class name as it is, and those that only say of what something is the menu, tags or comments.
PLAIN = frozenset(
    "site global primary secondary left right top bottom upper lower inner outer wrap wrapper container box block bar area section list links"
    " link item items group row col column panel unit slot posts articles stories news button buttons icons cloud the and".split()
)
OF = frozenset("main page post entry article".split())
#: Marks that an article inside does not lift: there it is a reader's comment.
COMMENTS = frozenset("comment comments commentlist reply replies respond responses disqus discussion".split())

#: Costs in thousandths: what each sign adds to the cost of a label.
AGAINST_COST, FOR_COST, LINK_COST, HIDDEN_COST = 6000, 1500, 3500, 12000
LENGTH_COST, HEADING_COST, LIST_COST, BASE_COST = 1200, 500, 700, 800
#: Capacity of smoothness arcs: neighbours of one parent, neighbours otherwise, next of the same parent.
SIBLING_ARC, NEIGHBOUR_ARC, FAMILY_ARC = 900, 150, 500

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_NAME = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
#: Class names that show on wider screens what "hidden" hides on small ones.
_SHOWN = re.compile(r"(?i)(?:^|\s)\w+:(?:block|flex|grid|inline|inline-block|table|contents)(?:\s|$)")
#: A form is a wrapper of the page where it holds this share of its text, and a paragraph of so many characters.
WRAPPER_SHARE, WRAPPER_PARAGRAPH = 0.5, 80
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Block:
    text: str
    tag: str
    parent: int
    linked: int
    against: bool
    speaks_for: bool
    hidden: bool
    #: Number of the outermost form around it, 0 if none.
    form: int = 0


@dataclass
class Element:
    tag: str
    number: int
    against: bool
    speaks_for: bool
    hidden: bool
    comments: bool = False
    #: Inside an embedded element: text is left out.
    dropped: bool = False
    form: int = 0


def _against(words: list[str]) -> bool:
    """Whether a whole class name, given by its words, is that of something beside the text.

    "cookie-notice" and "site-footer" are; "no-sidebar", "has-comments" and "tag-city" say something about the text.
    """
    if words == ["more"]:  # a wrapper as often as a link
        return False
    if words[0] == "tag" and len(words) > 1:
        return words[1:] in (["cloud"], ["list"], ["links"])
    if len(words) == 2 and words[0] in OF and words[1] in AGAINST:
        return words[1] != "header"  # of an entry or article: its title
    return not AGAINST.isdisjoint(words) and all(w in AGAINST or w in PLAIN or w.isdigit() for w in words)


def _element(tag: str, attributes: str, number: int, parent: Element) -> Element:
    names, hidden = [] if tag == "form" else [[tag]], parent.hidden
    central = tag in ("article", "main")
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id", "role"):
                # camelCase and joined names: a name counts as a whole, made of its words.
                shown = _SHOWN.search(value)
                names += [
                    _NAME.findall(_CAMEL.sub(r"\1 \2", n).lower()) for n in value.split() if not (shown and n.lower() == "hidden")
                ]
                central |= name == "role" and value.strip().lower() in ("article", "main")
            elif name == "style":
                hidden |= bool(_HIDDEN.search(value))
            elif name in ("hidden", "aria-hidden"):
                hidden |= name == "hidden" or value.lower() == "true"
    names = [words for words in names if words]
    speaks_for = parent.speaks_for or tag not in ("body", "html") and any(
        not FOR.isdisjoint(words) and AGAINST.isdisjoint(words) for words in names
    )
    against, comments, dropped = parent.against, parent.comments, parent.dropped or tag in EMBEDDED or tag in OPTIONS
    if central:
        # The page's text or an article of it: inherited marks end here, except among comments.
        against = comments = comments and tag != "main"
        dropped = False
    elif tag not in ("body", "html") and not (parent.speaks_for and tag == "header"):  # the header of an article holds its title
        found = [words for words in names if _against(words)]
        against |= bool(found)
        comments |= any(not COMMENTS.isdisjoint(words) for words in found)
    form = 0 if central else parent.form or (number if tag == "form" else 0)
    return Element(tag, number, against, speaks_for and not against, hidden, comments, dropped, form)


def _ended(html: str, name: str) -> set[int]:
    """Places of the start tags of an element that have an end tag."""
    found, starts = set(), []
    for tag in re.finditer(f"(?i)<(/?){re.escape(name)}(?=[\\s/>])", html):
        if not tag[1]:
            starts.append(tag.start())
        elif starts:
            found.add(starts.pop())
    return found


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, forms' parts, comments and markup give none."""
    out: list[Block] = []
    stack = [Element("", 0, False, False, False)]
    opened: Counter[str] = Counter()
    ended: dict[str, set[int]] = {}
    parts: list[str] = []
    linked, links, numbers, at, end = 0, 0, 0, 0, len(html)
    outside = [stack[0]]  # the open elements whose text counts

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = outside[-1]
                out.append(Block(text, top.tag, top.number, min(linked, len(text)), top.against, top.speaks_for, top.hidden, top.form))
            parts.clear()
        linked = 0

    def push(text: str) -> None:
        nonlocal linked
        if stack[-1].dropped:
            return
        parts.append(text)
        if links:
            linked += len(text.strip())

    def enter(element: Element) -> None:
        stack.append(element)
        opened[element.tag] += 1
        if not element.dropped:
            outside.append(element)

    def leave() -> None:
        element = stack.pop()
        opened[element.tag] -= 1
        if not element.dropped:
            outside.pop()

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            push(html[at:])
            break
        if lt > at:
            push(html[at:lt])
        if html.startswith("<!--", lt):
            # "<!-->" and "<!--->" are whole comments.
            close = html.find("-->", lt + 2)
            at = end if close < 0 else close + 3
            continue
        tag = _TAG.match(html, lt)
        if tag is None:
            nxt = html[lt + 1 : lt + 2]
            if nxt in ("!", "?") or nxt == "/" or nxt.isalpha():
                close = html.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                push("<")
                at = lt + 1
            continue
        at, closing, name = tag.end(), bool(tag[1]), tag[2].lower()
        if name in RAW:
            if not closing and not tag[3].endswith("/"):
                close = re.compile(f"(?i)</{re.escape(name)}(?=[\\s/>])[^>]*>").search(html, at)
                at = close.end() if close else end
            push(" ")
            continue
        if closing and name in OPTIONS and not opened[name]:
            continue
        if not closing and name in OPTIONS:
            while stack[-1].tag == "option" or name == "optgroup" and stack[-1].tag == "optgroup":
                leave()
            push(" ")
            enter(_element(name, tag[3], 0, stack[-1]))
            continue
        if name in EMBEDDED and not closing:
            push(" ")
            if name not in ended:
                ended[name] = _ended(html, name)
            if lt in ended[name] and not tag[3].endswith("/"):
                enter(_element(name, tag[3], 0, stack[-1]))
            continue
        if name in EMBEDDED and not opened[name]:
            push(" ")
            continue
        if not closing and name in CLOSES_PARAGRAPH:
            while stack[-1].tag in OPTIONS:
                leave()
        if stack[-1].dropped and not closing and name not in INLINE and name not in VOID:
            # Only an article or the main element in here has text again.
            inner = _element(name, tag[3], numbers + 1, stack[-1])
            if inner.dropped:
                enter(inner)
                continue
        elif name == "a" and not stack[-1].dropped:
            links = 0 if closing else 1
        if name in INLINE:
            continue
        if name == "br":
            push("\n")
            continue
        if closing and opened[name]:
            depth = len(stack) - 1
            while stack[depth].tag != name:
                depth -= 1
            if not all(e.dropped for e in stack[depth:]):
                flush()
                links = 0
            while len(stack) > depth:
                leave()
            continue
        if stack[-1].dropped and (closing or name in VOID):
            continue
        flush()
        links = 0
        if closing or name in VOID:
            continue
        while stack[-1].tag in CLOSES.get(name, ()):
            leave()
        numbers += 1
        enter(_element(name, tag[3], numbers, stack[-1]))
    flush()
    # A block's parent is the element around it; of paragraphs and the like, the one around that.
    return _forms_marked(out)


def _forms_marked(blocks: list[Block]) -> list[Block]:
    """Blocks of a form count against being content, unless the form is wrapped around the page itself."""
    forms = {b.form for b in blocks if b.form}
    if not forms:
        return blocks
    whole = sum(len(b.text) for b in blocks if not b.hidden)
    for form in forms:
        inside = [b for b in blocks if b.form == form and not b.hidden]
        plain = [b for b in inside if not b.against]
        wraps = sum(len(b.text) for b in inside) >= WRAPPER_SHARE * whole and any(
            len(b.text) - b.linked >= WRAPPER_PARAGRAPH and b.tag != "form" for b in plain
        )
        if not wraps:
            for b in blocks:
                if b.form == form:
                    b.against, b.speaks_for = True, False
    return blocks


def costs(block: Block) -> tuple[int, int]:
    """Cost of calling a block content, and of calling it boilerplate."""
    content, boilerplate = BASE_COST, BASE_COST
    if block.hidden:
        content += HIDDEN_COST
    if block.against:
        content += AGAINST_COST
    if block.speaks_for:
        boilerplate += FOR_COST + AGAINST_COST
    share = block.linked / len(block.text)
    content += int(LINK_COST * share) if share > 0.4 else 0
    words = block.text.count(" ") + 1
    if share <= 0.4:
        boilerplate += LENGTH_COST * min(words, 30) // 15
    if block.tag in HEADINGS:
        boilerplate += HEADING_COST
    if block.tag in ("li", "td", "th", "dt", "dd") and words < 8 and not block.speaks_for:
        content += LIST_COST
    return content, boilerplate


def minimum_cut(content: list[int], boilerplate: list[int], arcs: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side of the cheapest cut.

    A node labelled content pays ``content``, else ``boilerplate``; an arc (i, j, capacity) is paid when its ends
    differ.  Of equally cheap cuts the one with the fewest content nodes.
    """
    n = len(content)
    # What both terminals would pay cancels: a node keeps an arc to one terminal.
    supply = [b - c for c, b in zip(content, boilerplate, strict=True)]
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for i, j, capacity in arcs:
        for a, b in ((i, j), (j, i)):
            out[a].append(len(to))
            to.append(b)
            room.append(capacity)
    have = [max(0, s) for s in supply]
    want = [max(0, -s) for s in supply]
    while True:
        # Layers from all nodes that still have supply; then flow along shortest paths only.
        level = [-1] * n
        queue = deque(i for i in range(n) if have[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= bool(want[i])
            for e in out[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for source in range(n):
            while have[source]:
                path, i = [], source
                while not want[i]:
                    edges = out[i]
                    while tried[i] < len(edges):
                        e = edges[tried[i]]
                        if room[e] and level[to[e]] == level[i] + 1:
                            break
                        tried[i] += 1
                    if tried[i] < len(edges):
                        path.append(edges[tried[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                    else:
                        break
                if not want[i]:
                    break
                flow = min(have[source], want[i], *(room[e] for e in path)) if path else min(have[source], want[i])
                have[source] -= flow
                want[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def main_text(html: str | None) -> str:
    """The content blocks in page order, one line each; null and pages without content give ''."""
    blocks = blocks_of(html or "")
    if not blocks:
        return ""
    content, boilerplate = zip(*(costs(b) for b in blocks), strict=True)
    arcs, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            near = blocks[i - 1]
            alike = near.against == b.against and near.speaks_for == b.speaks_for
            arcs.append((i - 1, i, SIBLING_ARC if alike else NEIGHBOUR_ARC))
        if b.parent in last and last[b.parent] != i - 1:
            arcs.append((last[b.parent], i, FAMILY_ARC))
        last[b.parent] = i
    kept = minimum_cut(list(content), list(boilerplate), arcs)
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


def with_main_text(pages: DataFrame, name: str = "text", html: str = "html") -> DataFrame:
    """The pages with a column of their main text.

    Whole pages are read; white space inside a block is one space, blocks are joined by line feeds.  Null and empty html
    give an empty text.  Other columns pass through, every row stays.  Where the table already has a column of the
    new name, the new one gets a number behind its name.
    """

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in column], pa.string())

    return pages.withColumn(free_name(pages.columns, name), extract(html))
