"""Blocks of a web page with the path of elements that each stands in.

A small helper of the style tree: it reads tags in one pass, closes what
HTML closes by itself and splits the text where a block element begins or
ends.  It never fails, whatever the markup.
"""

from __future__ import annotations

import re
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)",
    re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object select button xmp noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav aside footer form head menu dialog fieldset".split()) | RAW
NOT_OUTSIDE = frozenset(["header"])
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
         "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"])}
LISTS = frozenset("ul ol dl table menu".split())
#: Words in class, id or role that mark what isn't the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget widgets "
    "footer masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended recommendations search searchform complementary contentinfo".split())
_PART = re.compile(r"[a-zA-Z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("text", "path", "inside", "out")

    def __init__(self, text: str, path: tuple, inside: bool, out: bool):
        self.text, self.path, self.inside, self.out = text, path, inside, out


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def _marked(a: dict[str, str]) -> bool:
    if "hidden" in a or a.get("aria-hidden") == "true":
        return True
    names = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}"
    return any(p.lower() in MARKS for p in _PART.findall(_CAMEL.sub(" ", names)))


def blocks(html: str) -> tuple[list[Block], list[tuple[tuple, tuple]]]:
    """Text blocks in page order, and (path, tags of the children) of each closed element.

    ``inside``: in an article or main element; ``out``: in something that by
    its element or names can't be the article's text.
    """
    found: list[Block] = []
    shapes: list[tuple[tuple, tuple]] = []
    # name, label, inside, out, tags of children
    stack: list[tuple] = [("", "", False, False, [])]
    piece: list[str] = []
    at = 0

    def flush() -> None:
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                found.append(Block(text, tuple(s[1] for s in stack[1:]), stack[-1][2], stack[-1][3]))

    def close(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][4]:
                shapes.append((tuple(s[1] for s in stack[1:]), tuple(stack[-1][4])))
            stack.pop()

    end = len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if m is None:
            piece.append(html[at:])
            break
        if m.start() > at:
            piece.append(html[at:m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            if name == "p" or name in BLOCK or name in RAW:
                flush()
            elif name == "br":
                piece.append(" ")
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if name in BLOCK or not any(s[0] in BLOCK for s in stack[depth + 1:]):
                        if name in BLOCK:
                            flush()
                        close(depth)
                    break
            continue
        if name == "br":
            piece.append(" ")
            continue
        if name in RAW:
            flush()
            stack[-1][4].append(name)
            if not m[3].endswith("/"):
                over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(html, at)
                at = over.end() if over else end
            continue
        block = name in BLOCK
        if block:
            flush()
            # an open paragraph ends here, as does the item before an item
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close(depth)
                    break
                if stack[depth][0] in BLOCK:
                    break
            if name in ITEMS:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in ITEMS[name]:
                        close(depth)
                        break
                    if stack[depth][0] in LISTS:
                        break
        if name in VOID:
            continue
        a = _attributes(m[3])
        label = name + "".join(sorted("." + c for c in a.get("class", "").split()))
        _, _, inside, out, children = stack[-1]
        children.append(name)
        if name in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody":
            inside = True
        out = out or name in NEVER or (name in NOT_OUTSIDE and not inside) or (
            name not in ("html", "body") and _marked(a))
        if m[3].endswith("/") and block is False:
            continue
        stack.append((name, label, inside, out, []))
    flush()
    close(1)
    return found, shapes
