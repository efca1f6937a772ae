"""HTML to a tree of block elements and the text blocks below them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.S)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I) for name in
       ("script", "style", "noscript", "template", "iframe", "textarea", "svg", "xmp", "noembed", "noframes")}
# What a start tag closes, if it is open, and the elements that this cannot reach through.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"),
          "tbody": ("tr td th thead tbody", "table"), "body": ("head", "")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
# Blocks that do not end a paragraph.
IN_PARAGRAPH = frozenset("button input select object video audio canvas map".split())


@dataclass
class Page:
    """Nodes in page order: parent, element and attributes; texts are nodes named ``#text``."""

    parent: list[int] = field(default_factory=lambda: [-1])
    name: list[str] = field(default_factory=lambda: ["#page"])
    attributes: list[str] = field(default_factory=lambda: [""])
    text: dict[int, str] = field(default_factory=dict)
    linked: dict[int, int] = field(default_factory=dict)

    def add(self, parent: int, name: str, attributes: str = "") -> int:
        self.parent.append(parent)
        self.name.append(name)
        self.attributes.append(attributes)
        return len(self.parent) - 1


def parse(html: str) -> Page:
    """The page's tree. Never fails: open elements end with the page, stray end tags are skipped."""
    page, stack = Page(), [0]
    buffer: list[str] = []
    linked, in_link, at, size = 0, False, 0, len(html)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                node = page.add(stack[-1], "#text")
                page.text[node] = text
                page.linked[node] = linked
            buffer.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if in_link:
                linked += len(raw)

    def close(names, stops) -> bool:
        for depth in range(len(stack) - 1, 0, -1):
            name = page.name[stack[depth]]
            if name in names:
                flush()
                del stack[depth:]
                return True
            if name in stops:
                break
        return False

    while at < size:
        match = TAG.search(html, at)
        if match is None:
            say(html[at:])
            break
        say(html[at:match.start()])
        at = match.end()
        ends, name, attributes = match.group(1), match.group(2), match.group(3)
        if name is None:
            ends, name, attributes = match.group(4), match.group(5), match.group(6)
            if name is None:
                continue
        name = name.lower()
        if name in RAW and not ends:
            if not attributes.endswith("/") or name != "svg":
                at = RAW[name].search(html, at).end()
            continue
        if name in INLINE:
            if name == "a":
                in_link = not ends
            elif name == "br" or name == "img" or name == "wbr":
                buffer.append(" " if name == "br" else "")
            continue
        if ends:
            if not close((name,), ()) and name == "p":
                flush()  # a stray end of a paragraph is an empty one
            in_link = False
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        flush()
        in_link = False
        if name in CLOSES:
            close(*CLOSES[name])
        if name not in IN_PARAGRAPH:
            # A block ends an open paragraph, but not one that stands outside of a button or cell.
            close(("p",), ("button", "td", "th", "table", "div", "article", "section", "li", "blockquote"))
        stack.append(page.add(stack[-1], name, attributes))
    flush()
    return page
