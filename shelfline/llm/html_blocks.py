"""Blocks of text of an HTML page, with the zone of the page that each lies in."""
from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element names, and words of class, id and role attributes that mark page furniture.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
GAP = frozenset("br td th img wbr option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
FURNITURE = frozenset("nav footer aside form menu dialog head script style title textarea noscript template iframe select button svg math object "
                      "canvas audio video".split())
CONTENT = frozenset(("article", "main"))
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer "
                  "footer menu modal nav navbar navigation newsletter notice notices notification popup promo promoted related share sharing "
                  "sidebar social sponsor sponsored subscribe widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

_PIECE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^>]*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


class Block(NamedTuple):
    zone: str        # content: inside an article or main; furniture: menus, adverts and so on; open: elsewhere
    text: str


def _is_furniture(name: str, attributes: str, inside_content: bool) -> bool:
    if name in FURNITURE or name == "header" and not inside_content:
        return True
    for key, value in _ATTRIBUTE.findall(attributes) if attributes.strip(" /") and name not in ("body", "html", "main") else ():
        words = re.split(r"[^a-z]+", value.lower())
        if key.lower() == "hidden" or (ROLES if key.lower() == "role" else MARKS).intersection(words):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; white space inside a block is one blank, empty blocks are left out.

    Tolerant: unclosed elements end with their parent, a paragraph or list item ends with the next one, and
    anything that is not well-formed markup is text. Scripts, styles and the head hold no blocks.
    """
    page = page or ""
    out: list[Block] = []
    held: list[str] = []
    stack: list[list] = []          # [name, zone, open elements of that name inside] of elements that set a zone
    at = 0

    def zone() -> str:
        return stack[-1][1] if stack else "open"

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(Block(zone(), text))
    while at < len(page):
        m = _PIECE.search(page, at)
        if not m:
            held.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(html.unescape(page[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3] if m[3] is not None else m[4]
        if name in BLOCK or name in RAW or name == "head":
            flush()
        elif name in GAP:
            held.append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][2]:
                        stack[i][2] -= 1
                    else:
                        flush()
                        del stack[i:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        if stack and stack[-1][0] in ("p", "li", "dd", "dt") and (name == stack[-1][0] or stack[-1][0] == "p" and name in BLOCK):
            stack.pop()
        if name == "body" and stack and stack[-1][0] == "head":
            stack.pop()
        here = zone()
        if here == "furniture" or _is_furniture(name, attributes, here == "content"):
            new = "furniture"
        else:
            new = "content" if name in CONTENT else here
        if new != here:
            flush()
            stack.append([name, new, 0])
        elif stack and stack[-1][0] == name and name not in ("p", "li", "dd", "dt"):
            stack[-1][2] += 1
    flush()
    return out
