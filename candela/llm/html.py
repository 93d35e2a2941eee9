"""A small tolerant HTML reader: text blocks with where they stand, and media references."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

#: Comments, sections, declarations and tags; a quote in a tag counts after an equals sign, and one that is never closed does not.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*(?:>|\Z)""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
MATH = "math semantics annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none"
INLINE = frozenset(MATH.split()) | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
#: Elements whose start ends an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul li dd dt".split())
#: Elements that may stand before the body.
HEAD = RAW | frozenset("html head base link meta".split()) - frozenset("textarea iframe svg".split())
#: Elements whose start ends an open svg.
BREAKS_SVG = CLOSES_P | frozenset("b big body br code em embed head i img meta ruby s small span strong strike sub sup tt u var".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
MEDIA = frozenset("img video audio source object embed".split())


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    serial: int
    #: This element's tag and attributes and those of all around it, outermost first.
    line: tuple[tuple[str, str], ...]


@dataclass(slots=True)
class Block:
    """Text between two block boundaries, or a media reference (``src`` set)."""

    path: tuple[Element, ...]
    text: str
    linked: int = 0
    src: str | None = None
    alt: str = ""
    caption: str = ""
    figure: int | None = None


@lru_cache(4096)
def attributes(tag: str) -> dict[str, str]:
    """Attributes of a start tag as written."""
    body = tag[_NAME.match(tag).end() :]
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(body)}


def _unclosed(page: str, at: int, name: str, stack: list[Element]) -> int:
    """Where an svg or template without end tag ends: with its parent, an svg also where page content starts."""
    around, inner = {e.tag for e in stack}, Counter()
    for m in _TAG.finditer(page, at):
        tag = m[2].lower()
        if not m[1]:
            if name == "svg" and tag in BREAKS_SVG:
                return m.start()
            inner[tag] += tag not in VOID
        elif inner[tag]:
            inner[tag] -= 1
        elif tag in around:
            return m.start()
    return len(page)


def blocks(page: str | None) -> list[Block]:
    """Blocks of a page in order; head, scripts, styles and comments give none."""
    stack: list[Element] = []
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    at, serial, links, page = 0, 0, 0, page or ""
    begun = False  # the body, by its tag or by an element that stands in it
    unclosed: set[str] = set()

    def flush():
        if not parts:
            return
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = len(" ".join("".join(p for p, in_link in parts if in_link).split())) if links or any(x for _, x in parts) else 0
            out.append(Block(tuple(stack), text, linked, figure=next((e.serial for e in reversed(stack) if e.tag == "figure"), None)))
        parts.clear()

    while True:
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else len(page)]
            parts.append((html.unescape(text) if "&" in text else text, links > 0))
        if m is None:
            break
        at, token = m.end(), m[0]
        if token[1] in "!?" or (not token.endswith(">") and at == len(page)):
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if name not in INLINE:
                flush()
            if any(e.tag == name for e in stack):
                while stack.pop().tag != name:
                    pass
                if links:
                    links = sum(e.tag == "a" for e in stack)
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P and any(e.tag == "p" for e in stack):
            i = max(i for i, e in enumerate(stack) if e.tag == "p")
            if not any(e.tag in ("button", "table", "td", "th", "object") for e in stack[i:]):
                del stack[i:]
        if name == "li":
            i = max((i for i, e in enumerate(stack) if e.tag in ("li", "ul", "ol", "menu")), default=-1)
            if i >= 0 and stack[i].tag == "li":
                del stack[i:]
        serial += 1
        if links:
            links = sum(e.tag == "a" for e in stack)
        element = Element(name, attributes(token), serial, (*(stack[-1].line if stack else ()), (name, token)))
        if name in MEDIA and (src := element.attrs.get("src") or element.attrs.get("data")):
            flush()
            out.append(Block(tuple(stack), "", src=src, alt=element.attrs.get("alt", ""), figure=next((e.serial for e in reversed(stack) if e.tag == "figure"), None)))
        if name in VOID or token.endswith("/>"):
            begun |= name not in HEAD
            continue
        if name in RAW:
            begun |= name not in HEAD
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None and name in ("svg", "template"):
                unclosed.add(name)
                at = _unclosed(page, at, name, stack)
            else:
                at = end.end() if end else len(page)
            continue
        stack.append(element)
        links += name == "a"
        if name == "body" and not begun:
            parts.clear()
            out.clear()
        begun |= name not in HEAD
    flush()
    captions = {b.figure: b.text for b in out if b.figure is not None and b.src is None and any(e.tag == "figcaption" for e in b.path)}
    for b in out:
        if b.src is not None:
            b.caption = captions.get(b.figure, "") or b.alt
    return out
