"""HTML pages as sequences of text blocks with the tags that lead to them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Elements inside a block; every other tag ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
HIDDEN = frozenset("script style title template textarea iframe noembed noframes svg select".split())
# Elements that a tag of the name ends, and elements around the tag beyond which it doesn't reach.
_P = (frozenset(("p",)), frozenset("table td th caption button object".split()))
SIBLINGS = {
    "p": _P, **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))), "option": (frozenset(("option",)), frozenset(("datalist",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))), **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("table", "tr")))),
}
# An end tag doesn't reach beyond these, but for those of tables.
_CELLS = frozenset(("table", "td", "th", "caption"))
_TABLE = {"table": frozenset(), **dict.fromkeys("tr td th caption tbody thead tfoot".split(), frozenset(("table",)))}
_VALUE = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_OPEN = re.compile(r"""=\s*(["'])""")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:_-]*)")
_LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Block:
    """A text, the different tokens of all elements around it, outermost first, and its characters inside links."""

    text: str
    path: tuple[str, ...]
    link_chars: int


def _tag(inner: str) -> tuple[bool, str, tuple[str, ...]] | None:
    """Closing or not, name, and the tokens that tell the element's part; None for what is no tag."""
    found = _NAME.match(inner)
    if not found:
        return None
    name = found[2].lower()
    labels = [part for value in _LABELS.findall(inner) for part in _PARTS.findall(value.lower())]
    return bool(found[1]), name, (name, *dict.fromkeys("." + x for x in labels))


def _open_quote(inner: str) -> str:
    """The quote of an attribute's value that is not closed yet, or nothing."""
    if ('"' not in inner and "'" not in inner) or not (inner[:1].isalpha() or inner[:1] == "/"):
        return ""
    found = _OPEN.search(_VALUE.sub("", inner))
    return found[1] if found else ""


def blocks(page: str, tags: dict | None = None) -> list[Block]:
    """The blocks with text in page order; character references decoded, white space made single spaces.

    One pass over what follows each ``<``; an unclosed comment or hidden element hides the rest,
    an unclosed tag is text. ``tags`` keeps what tags mean between pages.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: dict[str, int] = {}
    # How often each token stands on the stack, and the tokens as a path until they change.
    around: dict[str, int] = {}
    path: tuple[str, ...] | None = ()
    tags = {} if tags is None else tags
    if len(tags) > 50_000:
        tags.clear()
    before, *rest = page.split("<")
    buffer = [before] if before else []
    links, comment, hidden = 0, False, ""
    # Quotes that don't occur any more.
    missing: set[str] = set()

    def flush() -> None:
        nonlocal path
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            if path is None:
                path = tuple(around)
            out.append(Block(text, path, links))

    def push(name: str, tokens: tuple[str, ...]) -> None:
        nonlocal path
        stack.append((name, tokens))
        opened[name] = opened.get(name, 0) + 1
        for t in tokens:
            if t not in around:
                path = None
            around[t] = around.get(t, 0) + 1

    def pop() -> None:
        nonlocal path
        name, tokens = stack.pop()
        opened[name] -= 1
        for t in tokens:
            around[t] -= 1
            if not around[t]:
                del around[t]
                path = None

    def close(names: frozenset[str], beyond: frozenset[str]) -> None:
        """End the innermost open element of these names, if none of ``beyond`` is inside it."""
        if any(opened.get(name, 0) > 0 for name in names):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in names:
                    while len(stack) > at:
                        pop()
                    return
                if stack[at][0] in beyond:
                    return

    def whole_tag(inner: str, closed: str, text: str, at: int) -> tuple[str, str, int] | None:
        """A tag whose quoted value goes on beyond a ``>`` or ``<``: its inside, what follows, and the next piece; None if no quote ends it."""
        while quote := _open_quote(inner):
            if quote not in text:
                upto = at
                while quote not in missing and upto < len(rest) and quote not in rest[upto]:
                    upto += 1
                if quote in missing or upto == len(rest):
                    missing.add(quote)
                    return None
                text, at = "<".join([text, *rest[at:upto + 1]]), upto + 1
            value, _, text = text.partition(quote)
            more, ended, text = text.partition(">")
            inner = inner + closed + value + quote + more
            if not ended:
                return None
            closed = ended
        return inner, text, at

    i = 0
    while i < len(rest):
        piece = rest[i]
        i += 1
        if comment or (not hidden and piece.startswith("!--")):
            end = piece.find("-->", 0 if comment else 3)
            comment = end < 0
            if not comment and end + 3 < len(piece):
                buffer.append(piece[end + 3:])
            continue
        inner, closed, text = piece.partition(">")
        if hidden:
            if not (inner[:1] == "/" and inner[1:].strip().lower() == hidden):
                continue
            hidden = ""
        elif _open_quote(inner) and (found := whole_tag(inner, closed, text, i)):
            inner, text, i = found
            closed = ">"
        if not closed:
            buffer.append("<" + piece)
            continue
        tag = tags.get(inner, False)
        if tag is False:
            tag = tags[inner] = None if inner[:1] in ("!", "?") else _tag(inner)
        if tag is None:
            buffer.append(text if inner[:1] in ("!", "?") else "<" + piece)
            continue
        closing, name, tokens = tag
        if name not in INLINE:
            if buffer:
                flush()
            links = 0
        elif name == "br":
            buffer.append(" ")
        if closing:
            if name in SIBLINGS and name not in _TABLE:
                close(frozenset((name,)), SIBLINGS[name][1])
            else:
                close(frozenset((name,)), _TABLE.get(name, _CELLS))
        elif name in HIDDEN:
            hidden = name
            continue
        elif name not in VOID and not inner.endswith("/"):
            if name in SIBLINGS:
                close(*SIBLINGS[name])
            elif name not in INLINE:
                close(*_P)
            push(name, tokens)
        if text:
            buffer.append(text)
            if opened.get("a", 0) > 0:
                links += len(text)
    if buffer:
        flush()
    return out
