"""Leaf blocks of an HTML page: the text runs between block-level tags, each with its tag path and plain figures."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from zlib import crc32

PATH_BUCKETS = 16384

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title".split())
HIDDEN = frozenset("svg template".split())
#: An opening tag ends these open elements, looked for up to the first element that is neither one of them nor a div or p.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody"]), "tfoot": frozenset(["tr", "td", "th", "thead", "tbody"]),
}
THROUGH = frozenset(["div", "p"])

TAG = re.compile(r"""</?([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
PLAIN_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)([^>]*+)>")
NAMED = re.compile(r"""(?:^|[\s"'])(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(slots=True)
class Block:
    text: str
    path: frozenset[int]
    depth: int
    linked: int


@dataclass(slots=True)
class _Open:
    name: str
    path: frozenset[int]
    hidden: bool = False


@dataclass(slots=True)
class _State:
    stack: list[_Open]
    opened: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    inline: set[int] = field(default_factory=set)
    in_link: bool = False
    linked: int = 0
    out: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        if self.pieces:
            top = self.stack[-1]
            text = "" if top.hidden else " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                self.out.append(Block(text, top.path | self.inline if self.inline else top.path, len(self.stack), min(self.linked, len(text))))
            self.pieces = []
        self.inline, self.linked = set(), 0

    def pop(self) -> None:
        self.opened[self.stack.pop().name] -= 1

    def push(self, name: str, buckets: list[int]) -> None:
        top = self.stack[-1]
        path = top.path if top.path.issuperset(buckets) else top.path.union(buckets)
        self.stack.append(_Open(name, path, top.hidden or name in HIDDEN))
        self.opened[name] = self.opened.get(name, 0) + 1


def bucket(token: str, known: dict[str, int] = {}) -> int:  # noqa: B006 - a cache
    got = known.get(token)
    if got is None:
        if len(known) > 100_000:
            known.clear()
        got = known[token] = crc32(token.encode("utf-8", "surrogatepass")) % PATH_BUCKETS
    return got


def tokens(name: str, attributes: str, kind: str = "") -> list[int]:
    """Buckets of a tag: its name, the words of its class, id, role and itemprop, and the four-letter parts of longer ones."""
    found = [bucket(f"{kind}<{name}")]
    if "=" in attributes:
        for _, value in NAMED.findall(attributes):
            for part in PART.findall(value):
                part = part.lower()
                found.append(bucket(f"{kind}{part}"))
                if len(part) > 4:
                    found.extend(bucket(f"{kind}{part[k : k + 4]}~") for k in range(len(part) - 3))
    return found


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a whole page in order.

    Scripts, styles, titles, comments and hidden vector or template content give no text; references are decoded and
    white space inside a block becomes one space. Unclosed paragraphs, items and cells end where the next one begins; a
    stray closing tag only ends a block; an unclosed comment or attribute ends at the next ``>``, an unclosed script at
    the page's end.
    """
    state = _State([_Open("", frozenset())], {"": 1})
    place, size, last = 0, len(page), page.rfind(">")
    careful = True  # until a quoted value is found to run to the page's end
    lower = None
    while place < size:
        mark = page.find("<", place)
        if mark < 0 or mark > last:
            tail = page[place:] if mark < 0 else page[place:mark]
            if mark >= 0:  # what follows the last ">" is text up to an unfinished tag
                cut = re.search(r"<[A-Za-z/!?]", page[mark:])
                tail = page[place : mark + cut.start()] if cut else page[place:]
            state.pieces.append(tail)
            break
        if mark > place:
            piece = page[place:mark]
            state.pieces.append(piece)
            if state.in_link:
                state.linked += len(piece.strip())
        following = page[mark + 1]
        if following == "!" or following == "?":
            if page.startswith("<!--", mark):
                stop = page.find("-->", mark + 2)
                place = stop + 3 if stop >= 0 else page.find(">", mark) + 1
            else:
                place = page.find(">", mark) + 1
            continue
        found = TAG.match(page, mark) if careful else None
        if found is None:
            found = PLAIN_TAG.match(page, mark)
            if found is None:  # "<" before something else is text
                if following == "/":
                    place = page.find(">", mark) + 1
                else:
                    state.pieces.append("<")
                    place = mark + 1
                continue
            careful = False
        name, attributes, place = found[1].lower(), found[2], found.end()
        if following == "/":
            if name in INLINE:
                if name == "a":
                    state.in_link = False
                elif name == "br":
                    state.pieces.append(" ")
                continue
            state.flush()
            if name not in ("html", "body") and state.opened.get(name, 0):
                while state.stack[-1].name != name:
                    state.pop()
                state.pop()
            continue
        if name in INLINE:
            if name == "br":
                state.pieces.append(" ")
            elif name != "img" and name != "wbr":
                if name == "a":
                    state.in_link = True
                state.inline.update(tokens(name, attributes, "i:"))
            continue
        if name in RAW:
            if lower is None:
                lower = page.lower() if len(page.lower()) == size else page.translate(ASCII_LOWER)
            stop = lower.find(f"</{name}", place)
            place = size if stop < 0 else page.find(">", stop) + 1 or size
            continue
        state.flush()
        state.in_link = False
        if state.stack[-1].name == "p":
            state.pop()
        ending = ENDS.get(name)
        if ending:
            depth = len(state.stack) - 1
            while depth and (state.stack[depth].name in THROUGH):
                depth -= 1
            if state.stack[depth].name in ending:
                while len(state.stack) > depth:
                    state.pop()
                while state.stack[-1].name in ending:
                    state.pop()
        if name not in VOID and not attributes.endswith("/") or name in ("p", "div", "li"):
            state.push(name, tokens(name, attributes))
    state.flush()
    return state.out


ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
