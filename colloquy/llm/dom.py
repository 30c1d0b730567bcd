"""Leaf blocks of HTML pages, with the elements around them."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

#: A comment, a declaration, or a tag (slash, name, attributes); quotes only count after an equals sign, and what the page's end cuts off goes.
TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
#: Elements that begin and end a block.
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary
    table tbody td tfoot th thead tr ul""".split()
)
#: Elements that part a page.
PARTS = frozenset("article main section nav aside header footer form".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset("script style noscript template iframe noembed noframes textarea svg math object head title".split())
#: Open elements that a start tag ends, up to the first of the elements after the slash.
ENDS = {
    **dict.fromkeys(("dd", "dt"), ({"dd", "dt"}, {"dl"})),
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"table"})),
    "tr": ({"tr", "td", "th"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})),
}
#: Elements of which nothing can be open inside of a paragraph.
INSIDE_P = frozenset(("button", "label", "option", "optgroup", "select"))
CLOSE = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.IGNORECASE) for name in DROPPED}


class Frame:
    """An open block element: its name, the one around it, and what can be said of it and all around it."""

    __slots__ = ("name", "around", "within", "said", "score")

    def __init__(self, name: str, around: Frame | None, said: frozenset[str]):
        self.name, self.around, self.said, self.score = name, around, said, None
        #: The closest element that parts a page.
        self.within = name if name in PARTS else around.within if around else ""


class Block(NamedTuple):
    text: str
    linked: int
    frame: Frame


class Frames:
    """Frames that are the same for the same elements around them; `known` limits what is said, and so what a frame holds."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known, self.made = known, {}
        self.root = Frame("", None, frozenset())

    def inside(self, around: Frame, name: str, attributes: str) -> Frame:
        key = id(around), name, attributes
        found = self.made.get(key)
        if found is None:
            said = {f"in {name}"} | {f for w in marks(attributes) for f in (f"mark {w}", f"starts {w[:4]}", f"ends {w[-4:]}")}
            said = around.said | (said & self.known if self.known is not None else said)
            found = self.made[key] = Frame(name, around, said)
        return found


def marks(attributes: str) -> set[str]:
    """Lower-case words of the attributes class, id and role."""
    if not attributes:
        return set()
    values = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes))
    return {w.lower() for w in WORD.findall(values)}


def blocks_of(html: str, frames: Frames) -> tuple[str, list[Block]]:
    """The page's title, and its blocks in order: runs of text that no block element's tag parts.

    Character references are decoded and white space becomes one space; blocks without text are
    left out. Elements that may be left open end where HTML says; end tags of nothing open are
    passed over, and one pass reads the page whatever its tags.
    """
    found: list[Block] = []
    pieces: list[str] = []
    stack, opened = [frames.root], {}
    title, at, linked, anchors = "", 0, 0, 0

    def pop() -> str:
        name = stack.pop().name
        opened[name] -= 1
        return name

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, linked, stack[-1]))
            pieces.clear()
        linked = 0

    while at < len(html):
        m = TOKEN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            linked += len(piece) if anchors else 0
        if m is None:
            break
        at, slash, name = m.end(), m[1], m[2]
        if not name:
            continue
        name = name.lower()
        if name in DROPPED:
            if not slash and name != "head" and not (m[3].endswith("/") and name in ("svg", "math")):
                end = CLOSE[name].search(html, at)
                if name == "title" and not title:
                    title = " ".join(unescape(html[at : end.start() if end else len(html)]).split())
                at = end.start() if end else len(html)
        elif name in BLOCKS:
            flush()
            if slash:
                if opened.get(name):
                    while pop() != name:
                        pass
                continue
            if opened.get("p") and name not in INSIDE_P and stack[-1].name == "p":
                pop()
            over, until = ENDS.get(name, ((), ()))
            while over and stack[-1].name in over and stack[-1].name not in until:
                pop()
            if name != "hr":
                stack.append(frames.inside(stack[-1], name, m[3].strip()))
                opened[name] = opened.get(name, 0) + 1
        elif name == "a":
            anchors = 0 if slash else 1
        elif name == "br":
            pieces.append(" ")
    flush()
    return title, found
