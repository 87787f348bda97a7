"""HTML to leaf blocks: what text stands where, without judging it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>)")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Fixed values of HTML: elements whose content isn't text of the page, elements without content, and elements inside lines.
HIDDEN = frozenset("script style noscript template textarea title iframe svg select option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big br canvas cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msqrt msub msup mtext object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
#: A start tag of one of these ends an open paragraph; one of the second kind ends an open one of its own kind.
_SELF_ENDING = frozenset("li dt dd tr td th p option".split())
_ENDS_AT = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}


@dataclass
class Block:
    """Text between two block boundaries."""

    path: tuple[str, ...]
    text: str
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tag, and the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return (tag,)
    pieces = [p.lower() for _, v in _ATTRIBUTE.findall(attributes) for p in _PIECE.findall(v)]
    return (tag, *(f".{p}" for p in dict.fromkeys(pieces)))


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks in page order. White space inside a block is one space; character references are decoded.

    Null and empty pages have none. Unclosed and stray tags do no harm: an end tag closes the nearest open
    element of its name, a block element ends an open paragraph, and what stays open ends with the page.
    """
    source = page or ""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    link_depth, linked = 0, 0

    def flush():
        nonlocal linked, link_depth
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(n for _, names in stack for n in names), text, min(linked, len(text))))
            parts.clear()
        linked = link_depth = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                linked += len(text.strip())

    at = 0
    while True:
        start = source.find("<", at)
        if start < 0:
            add(source[at:])
            break
        m = _TAG.match(source, start)
        if not m:
            add(source[at : start + 1])
            at = start + 1
            continue
        add(source[at:start])
        at = m.end()
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                link_depth = 0 if m[1] else 1
            elif tag in ("br", "img"):
                parts.append(" ")
            continue
        if tag in HIDDEN:
            if not m[1] and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            parts.append(" ")
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in _SELF_ENDING:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")) or (tag in ("td", "th") and stack[k][0] in ("td", "th")):
                        del stack[k:]
                        break
                    if stack[k][0] in _ENDS_AT.get(tag, (stack[k][0],)):
                        break
            stack.append((tag, _names(tag, m[3])))
    flush()
    return out
