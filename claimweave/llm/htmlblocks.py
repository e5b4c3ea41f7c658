"""HTML to leaf blocks: runs of inline text with the tags above them, in page order.

A tolerant single-pass reader (linear in the page): comments, declarations, scripts, styles and other raw
text never become blocks; character references are decoded; white space, ``<br>`` included, becomes one
space.  Unclosed paragraphs, items and cells end where HTML says they do; stray end tags are ignored.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr wbr br img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe textarea title svg math object xmp noembed noframes".split())
_RAW_END = {tag: re.compile("</" + tag, re.IGNORECASE | re.ASCII) for tag in _RAW}
#: Elements that an opening tag of the same group ends.
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "optgroup": ("option", "optgroup"),
}
#: An implied end never reaches out of these.
_SCOPE = frozenset("table ul ol dl body div section article aside nav main header footer form td th select".split())
_MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
#: Attributes and the end of a tag.  A quote opens a value only right after "="; elsewhere, or without a partner, it is a character.
_TAG_END = re.compile(r"""(?:[ \t\n\r\f/]|[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:"[^"]*+"|'[^']*+'|[^ \t\n\r\f>]*+))?+)*+>""")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


class Node:
    """An element: the one above it and its tokens, which are its tag name and class, id and role words."""

    __slots__ = ("above", "names")

    def __init__(self, above: Node | None, names: tuple[str, ...]):
        self.above, self.names = above, names


class Block(NamedTuple):
    text: str
    node: Node | None  # the element around it; shared, so that deep pages take linear space
    linked: float  # share of the characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Tokens of all ancestors, outermost first."""
        names, node = [], self.node
        while node is not None:
            names.append(node.names)
            node = node.above
        return tuple(t for ns in reversed(names) for t in ns)


def _tokens(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attributes:
        for m in _NAMES.finditer(attributes):
            out += ["." + w for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())]
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of one page; null or empty: none."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, Node]] = []
    pieces: list[str] = []
    links = linked = 0
    at, end = 0, len(page)
    plain = False  # after a tag without an end, every tag of the page ends at its first ">"

    def tag_end(start: int) -> int:
        """Place after the tag; 0: nothing ends it."""
        nonlocal plain
        if not plain and (m := _TAG_END.match(page, start)):
            return m.end()
        plain = True
        return page.find(">", start) + 1

    def text(part: str) -> None:
        nonlocal linked
        part = html.unescape(part) if "&" in part else part
        pieces.append(part)
        if links:
            linked += len(part)

    def flush() -> None:
        nonlocal linked
        if pieces:
            whole = "".join(pieces)
            joined = " ".join(whole.split())
            if joined:
                out.append(Block(joined, stack[-1][1] if stack else None, min(1.0, linked / len(whole))))
            pieces.clear()
        linked = 0

    def pop_to(names: tuple[str, ...]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in _SCOPE:
                return

    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        name = m[2]
        if name is None:
            close = page.find("-->" if m[0] == "<!--" else ">", m.end())
            at = end if close < 0 else close + (3 if m[0] == "<!--" else 1)
            continue
        tag = name.lower()
        at = tag_end(m.end())
        if not at:  # no end of this tag: what is left is no text
            break
        attributes = page[m.end() : at - 1]
        if m[1]:
            if tag == "br":
                pieces.append(" ")
            elif tag in _INLINE:
                links -= tag == "a" and links > 0
            else:
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        links = 0 if tag not in _INLINE else links
                        break
            continue
        if tag in _RAW and not attributes.endswith("/"):
            close = _RAW_END[tag].search(page, at)
            if close is None:
                break
            at = tag_end(close.end()) or end
            continue
        if tag in _INLINE:
            if tag in ("br", "img", "wbr"):
                pieces.append(" " if tag != "wbr" else "")
            else:
                links += tag == "a"
            continue
        flush()
        links = 0
        if tag in _VOID:
            continue
        pop_to(("p",))
        if tag in _ENDS:
            pop_to(_ENDS[tag])
        stack.append((tag, Node(stack[-1][1] if stack else None, _tokens(tag, attributes))))
    flush()
    return out
