"""Web pages as trees: block elements and the blocks of text between their borders.

Inline elements make no nodes; white space inside a block is one space and character references are decoded. Left-open
elements end as browsers end them: a paragraph at the next block, a list item or cell at the next one of its
kind, everything inside an element with its end tag. Scripts, styles, controls of forms and embedded media hold no text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Names of HTML elements.
BLOCKS = frozenset(
    "html head body article aside nav section header footer main div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd menu table caption "
    "colgroup thead tbody tfoot tr td th blockquote pre address figure figcaption form fieldset legend details summary dialog hr "
    "search center dir".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("select button template svg object canvas audio video datalist label output progress meter noscript".split())
_ENDS_PARAGRAPH = BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
_SCOPES = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}

_MARKUP = re.compile(
    r"<!--(?:(?!-->)[\s\S])*+(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?(?=[\s/\"'>]|$)", re.IGNORECASE)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


@dataclass
class Page:
    """Nodes in the order of the page: a parent comes before its children. Texts are empty for elements."""

    parents: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, names: str = "", text: str = "", linked: int = 0) -> int:
        self.parents.append(parent)
        self.tags.append(tag)
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.parents) - 1


def _names(attributes: str) -> str:
    """Class, id, role and label of an element, and ``hidden`` if it is not shown."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = values[0] or values[1] or values[2]
        name = name.lower()
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN_STYLE.search(value):
                found.append("hidden")
        else:
            found.append(value)
    return " ".join(found)


def parse(html: str) -> Page:
    """The tree of a page; tag ``#text`` marks its blocks of text. The first node is the page itself."""
    page = Page()
    stack: list[tuple[str, int]] = [("", page.add(-1, "#page"))]
    open_tags: dict[str, int] = {}
    pieces: list[str] = []
    linked = 0
    link_depth = 0  # depth of the element that holds the open link, 0 without one
    silent, inside = "", 0  # the open element without text, and the blocks open in it
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.add(stack[-1][1], "#text", "", text, min(linked, len(text)))
            pieces.clear()
        linked = 0

    def pop(depth: int) -> None:
        nonlocal link_depth
        while len(stack) > depth:
            name, _ = stack.pop()
            open_tags[name] -= 1
        if link_depth > len(stack):
            link_depth = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not silent:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if link_depth:
                linked += len(text.strip())

    def close(name: str, scope: frozenset[str] = frozenset()) -> bool:
        """End the innermost open element of that name, unless one of the scope is met first."""
        if not open_tags.get(name):
            return False
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == name:
                flush()
                pop(depth)
                return True
            if stack[depth][0] in scope:
                return False
        return False

    while at < size:
        found = _MARKUP.search(html, at)
        if not found:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at:found.start()])
        at = found.end()
        slash, name, attributes = found.groups()
        if not name:
            continue
        name = name.lower()
        if silent:  # ends with its end tag, or with the block around it
            if slash and name == silent:
                silent = ""
                continue
            if not (slash and name in BLOCKS and not inside):
                inside += (name in BLOCKS and name not in VOID) * (-1 if slash else 1)
                if name not in RAW or slash:
                    continue
            else:
                silent = ""
        if slash:
            if name == "a":
                link_depth = 0
            elif name == "br":
                pieces.append(" ")
            elif name in BLOCKS and name not in ("body", "html"):
                if not close(name, frozenset(("table",)) if name not in ("table", "form") else frozenset()) and name == "p":
                    flush()
            continue
        if name in RAW:
            end = _RAW_ENDS[name].search(html, at)
            at = end.end() if end else size
        elif name in SILENT:
            if not attributes.endswith("/"):
                silent, inside = name, 0
        elif name == "a":
            link_depth = len(stack)
        elif name == "br":
            pieces.append(" ")
        elif name == "hr":
            flush()
        if name not in BLOCKS or name in SILENT or name in VOID or name in ("html", "body") and open_tags.get(name):
            continue
        names = _names(attributes) if attributes.strip() else ""
        if stack[-1][0] == "head":
            pop(len(stack) - 1)
        flush()
        if name in _ENDS_PARAGRAPH:
            close("p", frozenset(("table", "td", "th", "button")))
        for sibling in _SIBLINGS.get(name, ()):
            close(sibling, _SCOPES.get(name, frozenset(("table",))))
        if name[0] == "h" and name[1:].isdigit() and stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit():
            pop(len(stack) - 1)
        stack.append((name, page.add(stack[-1][1], name, names)))
        open_tags[name] = open_tags.get(name, 0) + 1
    flush()
    return page
