"""Main content of pages (problem 4): a linear-chain conditional random field over leaf blocks, decoded by Viterbi."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.dom import Block, blocks, decode, has_html, sentence_ends
from weftline.session import spread

WEIGHTS = os.path.join(os.path.dirname(__file__), "crf_weights.json")
_CJK = re.compile(r"[぀-ヿ一-鿿가-힯]")
_END = re.compile(r"[.!?。！？…:;][\"'”’»)\]]*$")
# Words in class and id attributes that sites use for their parts; others carry no weight.
_PART_WORDS = frozenset(
    "nav menu footer foot header head top sidebar side aside content main post body entry article text txt share social related more cookie banner consent notice comment comments widget promo ad list links info data crumbs breadcrumb wrap page site story section box".split()
)
_WORD = re.compile(r"[a-z]+")
_STRUCTURE = frozenset("main article section aside nav header footer ul ol table tr form noscript blockquote pre figure dl".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_part_cache: dict[str, tuple[str, ...]] = {}


def _parts(attrs: str) -> tuple[str, ...]:
    """The known words of an element's attributes, as features."""
    found = _part_cache.get(attrs)
    if found is None:
        if len(_part_cache) > 50_000:
            _part_cache.clear()
        found = _part_cache[attrs] = tuple("k=" + w for w in set(_WORD.findall(attrs.lower())) & _PART_WORDS)
    return found


def _link_share(b: Block) -> int:
    """No link, some, much, nearly all."""
    if not b.links:
        return 0
    r = b.links / max(1, len(b.text))
    return 1 if r < 0.3 else 2 if r < 0.8 else 3


def _words(text: str) -> int:
    n = text.count(" ") + 1
    return n if text.isascii() else n + len(_CJK.findall(text)) // 2


def _around(path: tuple, known: dict[int, tuple]) -> tuple:
    """The features of the elements around a block, shared by the blocks of one element."""
    x = path[-1]
    found = known.get(id(x))
    if found is None:
        up = _around(path[:-1], known) if len(path) > 1 else ()
        if x.tag in _STRUCTURE:
            up = (*up, "a=" + x.tag)
        found = known[id(x)] = (*up, *_parts(x.attrs)) if x.attrs else up
    return found


_own_cache: dict[tuple, tuple[str, ...]] = {}


def _own(tag: str, share: int, size: str, end: str) -> tuple[str, ...]:
    key = (tag, share, size, end)
    found = _own_cache.get(key)
    if found is None:
        if len(_own_cache) > 50_000:
            _own_cache.clear()
        found = _own_cache[key] = ("1", f"t={tag}", f"l={share}", f"w={size}{end}", f"tw={tag}{size}{end}{share}")
    return found


def features(page: list[Block]) -> list[list[tuple[str, ...]]]:
    """The features of each block, in groups that many blocks share: its element and text, the elements around it, its
    place to the headline, its signs, its neighbours."""
    out: list[list[tuple[str, ...]]] = []
    head = next((b for b in page if b.path and b.path[-1].tag == "h1"), None)
    home = head.path[-2] if head and len(head.path) > 1 else None
    bare = home is None or home.tag in ("body", "html")
    n = len(page)
    links = [_link_share(b) for b in page]
    tags = [b.path[-1].tag if b.path else "-" for b in page]
    after = rights = teasers = False
    around: dict[int, tuple] = {}
    places: dict[tuple, tuple] = {}
    for i, b in enumerate(page):
        path, text, tag, share = b.path, b.text, tags[i], links[i]
        w = _words(text)
        f = [_own(tag, share, "1" if w < 4 else "2" if w < 8 else "3" if w < 15 else "4" if w < 40 else "5", "e" if _END.search(text[-6:]) else "n")]
        if path:
            f.append(_around(path, around))
        if b is head:
            after = True
        key = (id(path[-1]) if path else 0, after)
        place = places.get(key)
        if place is None:
            if head is not None:
                inside = not bare and home in path
                place = ("after" if after else "before", ("in" if inside else "out") if not bare else "bare1" if after else "bare0")
                if inside or bare:
                    at = path.index(home) + 1 if home in path else 0
                    place += ("deep=" + "/".join([x.tag for x in path[at:][:4]]) + ("+" if after else "-"),)
            else:
                place = ("nohead",)
            places[key] = place
        f.append(place)
        signs = []
        if b is head:
            signs.append("headline")
        if "©" in text[:40]:
            rights = True
            signs.append("copyright")
        if rights:
            signs.append("rights")
        if " | " in text or " > " in text[:60]:
            signs.append("bars")
        if b.control:
            signs.append("control")
        if tag in _HEADINGS and i + 1 < n and links[i + 1] == 3:
            teasers = True
            signs.append("teasehead")
        if teasers:
            signs.append("teasers")
            if bare:
                signs.append("bareteasers")
        if len(path) > 1 and i and links[i - 1] == 3 and page[i - 1].path and page[i - 1].path[-1] is path[-2]:
            signs.append("underlink")
        if sentence_ends(text) > 0:
            signs.append("sentences")
        f.append(tuple(signs))
        f.append(("pt=^",) if not i else _beside("pt=", tags[i - 1], links[i - 1]))
        f.append(("nt=$",) if i + 1 == n else _beside("nt=", tags[i + 1], links[i + 1]))
        out.append(f)
    return out


_beside_cache: dict[tuple, tuple[str]] = {}


def _beside(side: str, tag: str, share: int) -> tuple[str]:
    key = (side, tag, share)
    found = _beside_cache.get(key)
    if found is None:
        if len(_beside_cache) > 50_000:
            _beside_cache.clear()
        found = _beside_cache[key] = (f"{side}{tag}{share}",)
    return found


class Crf:
    """Two states, site and main: a weight of each feature for main against site, and weights of state changes."""

    def __init__(self, weights: dict[str, float], change: list[list[float]]):
        self.weights, self.change = weights, change
        self.sums: dict[tuple[str, ...], float] = {}  # of groups of features

    def _sum(self, group: tuple[str, ...]) -> float:
        if len(self.sums) > 200_000:
            self.sums.clear()
        got = self.sums[group] = sum(self.weights.get(x, 0.0) for x in group)
        return got

    @classmethod
    def load(cls, path: str = WEIGHTS) -> Crf:
        with open(path) as f:
            d = json.load(f)
        return cls(d["weights"], d["change"])

    def decode(self, feats: list[list[tuple[str, ...]]]) -> list[bool]:
        """The best sequence of states."""
        if not feats:
            return []
        sums = self.sums
        (a00, a01), (a10, a11) = self.change
        s0 = s1 = 0.0
        back: list[tuple[bool, bool]] = []
        first = True
        for f in feats:
            u = 0.0
            for g in f:
                u += sums[g] if g in sums else self._sum(g)
            if first:
                s0, s1, first = 0.0, u, False
                continue
            k0, k1 = s1 + a10 > s0 + a00, s1 + a11 > s0 + a01
            back.append((k0, k1))
            s0, s1 = (s1 + a10 if k0 else s0 + a00), (s1 + a11 if k1 else s0 + a01) + u
        state = s1 > s0
        out = [state]
        for k0, k1 in reversed(back):
            state = k1 if state else k0
            out.append(state)
        out.reverse()
        return out


_model: Crf | None = None


def model() -> Crf:
    """The trained model, once per Python process."""
    global _model
    if _model is None:
        _model = Crf.load()
    return _model


def main_blocks(text: str) -> list[Block]:
    """The blocks of a page's main content, in order."""
    page = blocks(text)
    return [b for b, keep in zip(page, model().decode(features(page))) if keep]


def block_hashes(text: str) -> list[str]:
    """Hex MD5 of each distinct main block in lower case."""
    return list(dict.fromkeys(hashlib.md5(" ".join(b.text.lower().split()).encode("utf-8", "surrogatepass")).hexdigest() for b in main_blocks(text)))


def find_main(df: DataFrame, id_col: str = "crawl_id") -> DataFrame:
    """(id, block_md5): one row for each distinct block of main content of each page that has HTML.

    Null, empty and blank pages and pages without HTML give no rows; broken pages are read as far as they go; a page
    several times gives its rows each time; other columns are ignored. A map over Arrow batches: no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, md5s = [], []
            for i, page, ct in zip(*(c.to_pylist() for c in b.columns)):
                text = decode(page, ct)
                if text and has_html(text):
                    h = block_hashes(text)
                    ids += [i] * len(h)
                    md5s += h
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(md5s, pa.string())], [id_col, "block_md5"])

    return spread(df.where(F.col("page").isNotNull()).select(id_col, "page", "content_type"), id_col).mapInArrow(run, f"{id_col} {kind}, block_md5 string")


def extract_main(df: DataFrame, id_col: str = "crawl_id") -> DataFrame:
    """(id, main): the text of each page's main content, a line for each block; null for null pages, the whole text for
    pages without HTML, empty where a page has no main content."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for page, ct in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = decode(page, ct)
                texts.append(None if page is None else "\n".join(x.text for x in main_blocks(text)) if has_html(text) else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "main"])

    return spread(df.select(id_col, "page", "content_type"), id_col).mapInArrow(run, f"{id_col} {kind}, main string")
