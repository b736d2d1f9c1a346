"""The one step Spark has no expression for: finding the anchors of a tolerant-HTML page.

Runs inside Python workers on Arrow batches (see ``parse.py``). It only tokenises, keeps the stack of open
elements, and reports each wanted anchor's href and text; everything that follows is Column work.
"""

from __future__ import annotations

import codecs
import html as entities
import re

# HTML rules.
NAVIGATION = {"nav", "header", "footer"}
VOID = {
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input",
    "isindex", "link", "meta", "param", "source", "track", "wbr",
}
HIDDEN_TEXT = {"script", "style", "template", "rt", "rp"}
IMPLIED = {"html", "head", "body"}
IN_HEAD = {"base", "link", "meta", "title"}
# A misplaced end tag closes only elements that rank no higher than itself.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}
DEFAULT_RANK = 100
# A start tag that ends the innermost open element.
_BLOCKS = {
    "address", "blockquote", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "hr", "li", "menu", "ol", "p", "pre", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSED_BY = {
    "a": {"a", "fieldset", "table", "td", "th"},
    "p": _BLOCKS,
    "li": {"li"},
    "dt": {"dd", "dt"},
    "dd": {"dd", "dt"},
    "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "tr": {"tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
}

# Possessive throughout, so that broken markup costs no backtracking.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?)?+"""
_TOKEN = re.compile(
    rf"""<(?:
        !--(?:[^-]++|-(?!->))*+(?:-->|\Z)
      | (?P<raw>(?i:script|style))(?=[\s>])[^>]*+(?<!/)>(?:[^<]++|<(?!/(?i:(?P=raw))))*+
      | (?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:\s++|/(?!>)|{_ATTRIBUTE})*+)(?P<empty>/?)(?:>|\Z)
      | [!?/][^>]*+(?:>|\Z)
    )""",
    re.X | re.A,
)
_PAIR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+|'[^']*+|[^\s>"'][^\s>]*+)?)?+["']?""", re.A)
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)")
_DECLARED = re.compile(
    rb"""<(?:meta[^>]+?charset\s*=\s*["']?|\?xml[^>]+?encoding\s*=\s*["'])([A-Za-z0-9_:.\-]+)""", re.I
)
_MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
# Labels whose web meaning differs from the codec of that name.
_CODEC_ALIASES = {"x-sjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "macintosh": "mac-roman"}


def _codec(label: str | None) -> str | None:
    """The text codec a label names; other codecs (hex, base64, ...) and unusable ones don't count."""
    if not label:
        return None
    try:
        codec = codecs.lookup(_CODEC_ALIASES.get(label.lower(), label)).name
        b"<p>".decode(codec, "replace")
    except (LookupError, ValueError):
        return None
    return codec


def decode_page(content: bytes, hint: str | None) -> str:
    """Text of a page by the first label that fits all its bytes: header hint, byte-order mark, declared charset, UTF-8.

    If none fits, the first label decodes what it can; without a label, Windows-1252 does.
    """
    declared = _DECLARED.search(content)
    marked = next((codec for mark, codec in _MARKS if content.startswith(mark)), None)
    labels = [_codec(hint), marked, _codec(declared.group(1).decode("ascii")) if declared else None]
    codecs_named = [codec for codec in labels if codec is not None]
    for codec in [*codecs_named, "utf-8"]:
        try:
            return content.decode(codec).removeprefix("\ufeff")
        except ValueError:
            continue
    return content.decode(codecs_named[0] if codecs_named else "cp1252", "replace").removeprefix("\ufeff")


def _plain(text: str) -> str:
    return _REFERENCE.sub(lambda m: entities.unescape(m.group()), text) if "&" in text else text


def _squeeze(pieces: list[str]) -> str:
    return " ".join(" ".join(pieces).split())


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _PAIR.findall(source):
        found.setdefault(name.lower(), _plain(value[1:] if value[:1] in "\"'" else value))
    return found


#: An open element as selectors see it: its name and attributes.
Element = tuple[str, dict[str, str]]
#: An anchor: order in the document, href, title, and, if asked for, its open elements from the root to itself.
Anchor = tuple[int, str, str, list[Element]]


def find_anchors(page: str, skip_navigation: bool, with_paths: bool = False) -> tuple[str | None, list[Anchor]]:
    """The document's base href and its anchors: all, or with ``skip_navigation`` those outside navigation.

    With paths, for a selector to choose from, every anchor counts: navigation then plays no part.
    """
    base: str | None = None
    anchors: list[list] = []  # order, href, text pieces, first image text, title attribute, path
    stack = ["html", "body"]
    path: list[Element] = [("html", {}), ("body", {})]  # beside the stack, if asked for
    open_anchors: list[tuple[int, list]] = []  # (stack depth, anchor)
    navigation = hidden = order = last = 0

    def leave() -> None:
        nonlocal navigation, hidden
        name = stack.pop()
        if with_paths:
            path.pop()
        navigation -= name in NAVIGATION
        hidden -= name in HIDDEN_TEXT
        while open_anchors and open_anchors[-1][0] > len(stack):
            open_anchors.pop()

    for token in _TOKEN.finditer(page):
        if open_anchors:
            start = token.start()
            if start > last and not hidden:
                piece = _plain(page[last:start])
                for _, anchor in open_anchors:
                    anchor[2].append(piece)
            last = token.end()
        raw, end, name, source, empty = token.groups()
        if name is None:
            continue
        if not name.islower():
            name = name.lower()
        if end:
            if stack[-1] == name and len(stack) > 2:
                leave()
            elif name not in VOID and name not in IMPLIED:
                rank = END_RANK.get(name, DEFAULT_RANK)
                depth = len(stack) - 1
                while depth > 1 and stack[depth] != name:
                    depth = 0 if END_RANK.get(stack[depth], DEFAULT_RANK) > rank else depth - 1
                if depth > 1:
                    while len(stack) > depth:
                        leave()
            continue
        if name in IMPLIED:
            # These always exist: a tag only adds attributes to <html> or <body>.
            if with_paths and name != "head":
                path[name == "body"] = (name, _attributes(source))
            continue
        while len(stack) > 2 and name in CLOSED_BY.get(stack[-1], ()):
            leave()
        attrs: dict[str, str] = {}
        if with_paths or name in ("a", "img", "base"):
            attrs = _attributes(source)
        if name == "base" and base is None:
            base = attrs.get("href")
        if name == "img":
            for _, anchor in open_anchors:
                anchor[3] = anchor[3] or _squeeze([attrs.get("alt", "")])
        if name in VOID:
            continue
        if not empty:
            stack.append(name)
            if with_paths:
                path.append((name, attrs))
            navigation += name in NAVIGATION
            hidden += name in HIDDEN_TEXT
        if name == "a" and "href" in attrs:
            if with_paths or not (skip_navigation and navigation):
                own = ([*path, (name, attrs)] if empty else path[:]) if with_paths else []
                anchor = [order, attrs["href"].strip(), [], "", _squeeze([attrs.get("title", "")]), own]
                anchors.append(anchor)
                if not empty:
                    open_anchors.append((len(stack), anchor))
                    last = token.end()
            order += 1
    if open_anchors and not hidden and last < len(page):
        piece = _plain(page[last:])
        for _, anchor in open_anchors:
            anchor[2].append(piece)
    return base, [(at, href, _squeeze(text) or image or label, own) for at, href, text, image, label, own in anchors]
