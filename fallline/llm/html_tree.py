"""A small HTML parser: structural elements as a tree, with the text blocks that they hold.

Inline elements (and unknown ones) do not part text; structural elements do.  Comments, scripts, styles
and form controls hold no text.  End tags close up to the element that they name, unmatched ones are
ignored, and elements whose end tag may be omitted are closed by what follows them, so broken pages parse
as a browser would mostly see them.
"""

from __future__ import annotations

import re
from html import unescape

# A tag's quoted values are looked at up to a number, so that a hostile page is not read again from every tag on.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,400}+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noframes", "noscript", "template")}
STRUCTURE = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table tbody thead tfoot "
    "tr caption ul button object video audio svg canvas".split())
#: Elements that a new element of these kinds closes.
_CLOSES = {t: ("p",) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()}
_CLOSES |= {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "p"), "tbody": ("tr", "tbody", "thead", "p"), "tfoot": ("tr", "tbody", "thead", "p"), "option": ("option",), "body": ("head",)}
#: An omitted end tag is not looked for beyond these.
_FENCE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
_BARRIER = ("html", "body", "table", "article", "section", "div", "button", "object")


class Node:
    """A structural element; ``items`` are child nodes and text pieces (text, inside a link) in order."""

    __slots__ = ("tag", "marks", "role", "hidden", "items", "label")

    def __init__(self, tag: str, marks: frozenset = frozenset(), role: str = "", hidden: bool = False):
        self.tag, self.marks, self.role, self.hidden = tag, marks, role, hidden
        self.items: list = []
        self.label = tag + "".join(f".{m}" for m in sorted(marks)) if marks else tag


_NO_ATTRIBUTES = (frozenset(), "", False)


def _attributes(source: str) -> tuple[frozenset, str, bool]:
    if not source or source == "/":
        return _NO_ATTRIBUTES
    marks, role, hidden = [], "", False
    for name, a, b, c in _ATTRIBUTE.findall(source):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            marks += _WORD.findall(_CAMEL.sub(" ", unescape(value)).lower())
        elif name == "role":
            role = value.lower()
        elif name == "itemprop" and value.lower() == "articlebody":
            marks.append("articlebody")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return frozenset(m for m in marks if not m.isdigit()), role, hidden


_NOWHERE: list[int] = []


def parse(html: str) -> Node:
    root = Node("html")
    stack = [root]  # open structural elements
    places: dict[str, list[int]] = {}  # where in the stack the elements of each tag are
    endless: set[str] = set()  # raw elements that no end tag follows any more
    links = 0
    at, size = 0, len(html)
    last_end = html.rfind(">")

    def close(tag: str, fence: tuple = ()) -> None:
        mine = places.get(tag)
        if mine and not any(places.get(f, _NOWHERE)[-1:] > mine[-1:] for f in fence):
            while len(stack) > mine[-1] + 1:
                places[stack.pop().tag].pop()
            stack.pop()
            mine.pop()

    while at < size:
        m = _TOKEN.search(html, at) if at <= last_end or html.find("<!", at) >= 0 or html.find("<?", at) >= 0 else None
        end = m.start() if m else size
        if end > at:
            text = html[at:end]
            stack[-1].items.append((unescape(text) if "&" in text else text, links > 0))
        if not m:
            break
        at = m.end()
        slash, tag, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not tag:
            if html.startswith("<![CDATA[", m.start()):
                stack[-1].items.append((html[m.start() + 9 : at].removesuffix("]]>"), links > 0))
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                links = 0
            elif tag in STRUCTURE and tag != "html":
                close(tag)
            continue
        if tag in RAW:
            found = None if tag in endless else RAW[tag].search(html, at)
            if found:
                stop = html.find(">", found.end())
                at = size if stop < 0 else stop + 1
            else:
                endless.add(tag)
                at = size if tag != "title" else at
            continue
        if tag == "a":
            links = 1
        elif tag in ("br", "td", "th"):
            stack[-1].items.append((" ", links > 0))
        if tag == "html" or tag not in STRUCTURE:
            continue
        for other in _CLOSES.get(tag, ()):
            close(other, _FENCE.get(tag, _BARRIER) if other != "p" else _BARRIER)
        node = Node(tag, *_attributes(attributes))
        stack[-1].items.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
            links = 0
    return root


def blocks(node: Node, skip=lambda node: False):
    """(node, text, share of the text inside links) of each text block below ``node``, in page order.

    White space inside a block is one space; blocks without text are left out.
    """
    pieces: list[tuple[str, bool]] = []
    stack = [(node, iter(node.items))]
    while stack:
        here, items = stack[-1]
        for item in items:
            if isinstance(item, Node):
                if pieces:
                    yield from _flush(here, pieces)
                    pieces = []
                if not skip(item):
                    stack.append((item, iter(item.items)))
                    break
            else:
                pieces.append(item)
        else:
            if pieces:
                yield from _flush(here, pieces)
                pieces = []
            stack.pop()


def _flush(node: Node, pieces: list[tuple[str, bool]]):
    text = " ".join("".join(p for p, _ in pieces).split())
    if text:
        linked = sum(len(p.strip()) for p, inside in pieces if inside)
        yield node, text, linked / max(sum(len(p.strip()) for p, _ in pieces), 1)
