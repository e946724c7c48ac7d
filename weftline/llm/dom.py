"""Pages as sequences of leaf blocks: decoding, a forgiving tag scanner, and the text between block tags."""

from __future__ import annotations

import re
from html import unescape

import xxhash

#: Inline tags, which vanish without a blank, and tags that never have content.
INLINE = frozenset("a b i em strong span code".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose end tag may be missing: what closes them when it starts.
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_OPTIONAL_END = frozenset("p li td th tr dt dd option".split())
_BLOCK_IN_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I)
_CODE = re.compile("\ue000[^\ue001]*\ue001")
_CUT = re.compile(r"<[/a-zA-Z][^<>]*\Z")  # a tag that the page's end cuts off
# Text, then a tag: end mark, name, attributes. A "<" that begins no tag is text.
_TOKEN = re.compile(r"([^<]*(?:<(?![/a-zA-Z])[^<]*)*)(?:<(/?)([a-zA-Z][\w:.-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|(<)|\Z)")
_DOCUMENT = re.compile(r"<(?:!doctype\s+html|html|body|head)\b", re.I)
_PART = re.compile(r"<(?:div|p|table|h1)\b", re.I)
# Code in plain text: what stands there is shown and no markup of the page.
_SHOWN = re.compile(r"^(```|~~~).*?^\1[^\n]*$|`[^`\n]+`|<(?:source|syntaxhighlight)\b[^>]*>.*?</(?:source|syntaxhighlight)>|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}|^(?: {4}|\t)[^\n]*$", re.S | re.M)
# What may stand before the first tag of a page and shows nothing.
_LEAD = re.compile(r"(?:\s+|\ufeff|<!--.*?-->|<\?[^>]*>|<(script|style|title)\b[^>]*>.*?</\1\s*>|<(?:meta|link|base)\b[^>]*>)*+", re.S | re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
_ALIASES = {"latin1": "cp1252", "latin-1": "cp1252", "iso-8859-1": "cp1252", "iso8859-1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}


def decode(page: bytes | None, content_type: str | None) -> str:
    """The text of a page: by the charset its content type names, else as UTF-8; undecodable bytes become U+FFFD, an
    unknown charset counts as none, a byte order mark is dropped. Null gives an empty text."""
    if not page:
        return ""
    m = _CHARSET.search(content_type) if content_type else None
    name = m.group(1).lower() if m else "utf-8"
    if page[:3] == b"\xef\xbb\xbf":
        page, name = page[3:], "utf-8" if name in ("utf8", "utf-8") else name
    try:
        text = page.decode(_ALIASES.get(name, name), "replace")
    except (LookupError, UnicodeError):
        text = page.decode("utf-8", "replace")
    return text[1:] if text[:1] == "﻿" else text


def has_html(text: str) -> bool:
    """Whether a page is HTML at all, and not plain text that may hold a tag or two as content: it begins, but for what
    shows nothing, with a tag of a document or a block that is closed somewhere; or a tag of a document stands anywhere
    in it, outside what plain text would show as code. White space, comments, styles and what else shows nothing may be
    of any length, and the whole page is looked at."""
    at = _LEAD.match(text).end()
    if _DOCUMENT.match(text, at):
        return True
    if _DOCUMENT.search(text, at):
        return _DOCUMENT.search(_SHOWN.sub(" ", text[at:])) is not None
    return _PART.match(text, at) is not None and "</" in text


def sentence_ends(text: str) -> int:
    """How many sentences end inside a text: marks with a blank after them, or marks of scripts without blanks that are
    not at the end."""
    n = text.count(". ") + text.count("? ") + text.count("! ")
    if '"' in text or ")" in text or "»" in text or "”" in text:
        n += text.count('." ') + text.count('?" ') + text.count(".) ") + text.count(".» ") + text.count(".” ")
    if not text.isascii():
        n += text.count("。", 0, -1) + text.count("！", 0, -1) + text.count("？", 0, -1)
    return n


class Block:
    """A leaf block: text between two block tags, the elements around it (outermost first), how many characters are
    inside links and inside code, whether a form control stands in the same element; ``plain`` is the text without its
    code elements, null if it has none; ``lines`` is the text as written, with its lines, inside pre."""

    __slots__ = ("text", "path", "links", "code", "control", "plain", "lines")

    def __init__(self, text: str, path: tuple, links: int, code: int, control: bool, plain: str | None, lines: str | None = None):
        self.text, self.path, self.links, self.code, self.control, self.plain, self.lines = text, path, links, code, control, plain, lines

    @property
    def tag(self) -> str:
        return self.path[-1].tag if self.path else ""

    @property
    def in_code(self) -> bool:
        """Inside pre, or nearly all in code elements."""
        return self.code * 10 >= len(self.text) * 9 or any(n.tag == "pre" for n in self.path)


class Node:
    """An element: tag, attributes as written, its first leaf block and the one after its last, and if wanted the
    hash of its subtree: tags and texts, without attributes."""

    __slots__ = ("tag", "attrs", "first", "end", "parts", "hash")

    def __init__(self, tag: str, attrs: str, first: int):
        self.tag, self.attrs, self.first = tag, attrs, first


def blocks(html: str, nodes: list[Node] | None = None) -> list[Block]:
    """The leaf blocks of a page in order, entities decoded once and white space collapsed; blank ones are left out.
    Head, scripts, styles and comments are no text. ``nodes`` collects the closed elements with subtree hashes."""
    html = _CUT.sub("", _DROP.sub("", _HEAD.sub("", html, 1)))
    out: list[Block] = []
    stack: list[Node] = []
    parts: list[str] = []
    links = code = 0
    in_link = in_code = control = False
    hashing = nodes is not None

    def close(depth: int) -> None:
        for n in reversed(stack[depth:]):
            n.end = len(out)
            if hashing:
                n.hash = xxhash.xxh3_64_intdigest(n.tag + "\x00" + "\x01".join(n.parts))
                stack.pop()
                if stack:
                    stack[-1].parts.append(f"{n.hash:x}")
                nodes.append(n)
        if not hashing:
            del stack[depth:]

    for text, closing, name, attrs, stray in _TOKEN.findall(html):
        if text:
            if in_link:
                links += len(text)
            if in_code:
                code += len(text)
                text = f"\ue000{text}\ue001"
            parts.append(text)
        if stray:
            parts.append(stray)
            continue
        tag = name.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "code":
                in_code = not closing
            continue
        if tag == "input" or tag == "button":
            control = True
        if parts:
            text, plain = "".join(parts), None
            if code:
                plain = _CODE.sub(" ", text)
                plain = " ".join(unescape(plain).split())
                text = text.replace("\ue000", "").replace("\ue001", "")
            if "&" in text:
                text = unescape(text)
            lines = text.strip("\r\n") if "\n" in text and any(n.tag == "pre" for n in stack) else None
            text = " ".join(text.split())
            if text:
                out.append(Block(text, tuple(stack), links, code, control, plain, lines))
                if hashing and stack:
                    stack[-1].parts.append(text)
                control = False
            parts = []
            links = code = 0
        if tag in VOID or not tag:
            continue
        if closing:
            control = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag in _CLOSES or tag in _BLOCK_IN_P:
            closes = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                t = stack[i].tag
                if t in closes or (t == "p" and tag in _BLOCK_IN_P):
                    close(i)
                    break
                if t not in _OPTIONAL_END or t in _STOPS.get(tag, ()):
                    break
        n = Node(tag, attrs, len(out))
        if hashing:
            n.parts = []
        stack.append(n)
    close(0)
    return out


_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def attributes(raw: str) -> dict[str, str]:
    """Attributes of a tag, names in lower case, entities decoded; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(raw):
        out.setdefault(k.lower(), unescape(a or b or c))
    return out
