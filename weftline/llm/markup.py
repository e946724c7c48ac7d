"""Markup residue in page texts (problem 5): site templates removed by subtree hashes, then visible markup found and
turned into clean text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.url import url_host
from weftline.llm.dom import Block, Node, blocks, decode, has_html
from weftline.session import cut, spread

#: A subtree is template if it occurs on this many different pages of a host and on this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.1

KINDS = ("html", "markdown", "wiki", "latex")
_TAGS = "a abbr address article aside b blockquote body br button caption center cite code dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s script section select small span strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul video".replace(" ", "|")
_ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_GREEK = "alpha|beta|gamma|delta|epsilon|theta|lambda|mu|pi|sigma|phi|omega|sum|int|frac|sqrt|leq|geq|neq|cdot|times|infty|partial|item|maketitle|noindent|newpage|par|ldots|quad"
_BULLET = r"(?:^|(?<=[.!?。！？\"”»)] ))- (?=[\"“«]?[^\W\d_])"
PATTERNS = {
    "html": [
        rf"</?(?:{_TAGS})(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*\s*/?>",
        r"<!--.*?-->",
    ],
    "markdown": [
        r"(?<![\w*])\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*(?![\w*])",
        r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![\w*])",
        r"(?<![\w_])__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?![\w_])",
        r"(?<![\w_])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])",
        r"(?<![\w~])~~(?=[^\s~])[^~\n]+(?<=[^\s~])~~(?![\w~])",
        r"(?:^|(?<=\s))#{1,6}\s+(?=[^\W\d_])",
        r"```|(?<![`\w])`[^`\n]+`(?![`\w])",
        r"!?\[[^\[\]\n]+\]\((?:[^()\s]+|<[^>\n]+>)(?:\s+\"[^\"\n]*\")?\)",
        r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|(?:^|(?<=\s))\[[^\[\]\n]+\]:\s+(?:/|https?:)\S+",
        r"\|\s*:?-{3,}:?\s*\|",
        r"(?<=\S )={4,}(?=\s|$)|^={4,}$|^-{4,}$",
        r"(?:^|(?<=\s))- \[[ xX]\] ",
        r"^> (?=\S)",
        _BULLET + r"[^\n]*?" + _BULLET,  # two list items at least, run together
    ],
    "wiki": [
        r"\[\[(?=[^\W\d]|:)[^\[\]\n]+(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]",
        r"\{\{(?=[^\W\d])[^{}]+\}\}",
        r"\{\|\s|(?<=\s)\|-(?=\s)|(?<=\s)\|\}",
        r"(?:^|(?<=\s))(={2,6}) (?=[^=\s])[^=\n]+ \1(?=\s|$)|^(={2,6})(?=[^=\s])[^=\n]+\2$",
        r"(?<!')'{2,3}(?=[^'\s])[^'\n]+(?:'[^'\n]+)*?'{2,3}(?!')",
        r"\[https?://\S+ [^\]\n]+\]",
        r"</?(?:ref|nowiki|gallery|references)\b[^>]*>",
    ],
    "latex": [
        r"(?<![\w:\\])\\[a-zA-Z]{2,30}\*?(?:\[[^\]\n]*\])?\{|(?<=[\s.,;:()~])\\[a-zA-Z]{2,30}\{|(?<=[\w.~])~?\\(?:ref|cite|footnote|label|emph|textbf|textit|eqref)\{",
        r"\\\[(?=.*\\\])|\\\((?=.*\\\))",
        r"(?<![\w$\\])\$\$?(?=[^$\s])(?=[^$]*(?:\\[a-zA-Z]|[_^]\{?\w|[=<>+]))[^$\n]+(?<=[^$\s])\$\$?(?![\w$])",
        rf"(?<![\w:\\])\\(?:{_GREEK})\b",
    ],
}
_COMPILED = {k: re.compile("|".join(f"(?:{p})" for p in ps if "\\1" not in p), re.S | re.I if k == "html" else re.S | re.M) for k, ps in PATTERNS.items()}
_WIKI_HEADING = re.compile(PATTERNS["wiki"][3], re.M)
# One character run that every pattern of a kind needs; a text without it is not searched.
_NEEDS = {"html": ("<", "&"), "markdown": ("**", "__", "~~", "#", "`", "](", "][", "]:", "--", "===", "*", "_", "[", ">", "- "), "wiki": ("[[", "{{", "{|", "|-", "|}", "==", "''", "[http", "<"), "latex": ("\\", "$")}


def hits(text: str, kind: str) -> int:
    """How often markup of a kind shows in a text."""
    if not any(n in text for n in _NEEDS[kind]):
        return 0
    n = sum(1 for _ in _COMPILED[kind].finditer(text))
    if kind == "html" and "&" in text:
        n += sum(m.group(1)[0] == "#" or m.group(1) + ";" in html5 for m in _ENTITY.finditer(text))
    if kind == "wiki" and "==" in text:
        n += sum(1 for _ in _WIKI_HEADING.finditer(text))
    return n


def kinds_of(texts: list[str]) -> list[str]:
    """The kinds of which markup shows in any of the texts."""
    return [k for k in KINDS if any(hits(t, k) for t in texts)]


_PLAIN_CODE = re.compile(r"^(```|~~~).*?^\1[^\n]*$|<pre>.*?</pre>|<(?:code|source|syntaxhighlight)[^>]*>.*?</(?:code|source|syntaxhighlight)>|\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\}", re.S | re.M)
_LINE_MARKS = {
    "markdown": re.compile(r"^#{1,6} \S|^\s*[-*+] \S|^> |^(```|~~~)|^\|?[\s:|-]*-{3,}|^={3,}$|^-{3,}$", re.M),
    "wiki": re.compile(r"^={2,6}.*={2,6}\s*$|^[*#:;]+ ?\S|^\{\||^\|[-}+]|^\[\[(?:File|Category|Image):", re.M),
    "latex": re.compile(r"^\\(?:begin|end|section|subsection|item|label|chapter|documentclass|usepackage)\b", re.M),
    "html": re.compile(r"^</?(?:p|div|ul|li|h\d|table|tr|td|br)\b", re.M | re.I),
}


def kind_of_plain(text: str) -> str | None:
    """The kind a page without HTML is written in: the one with the most signs; null if it has none."""
    fences = text.count("```") // 2
    rest = _PLAIN_CODE.sub("\n", text)
    score = {k: hits(rest, k) + len(_LINE_MARKS[k].findall(rest)) for k in KINDS}
    score["markdown"] += 2 * fences
    best = max(KINDS, key=lambda k: score[k])
    return best if score[best] else None


def site_key(host: int, subtree: int) -> int:
    """One number for a subtree on a host."""
    return (host * 0x9E3779B97F4A7C15 + subtree) % (1 << 64) - (1 << 63)


def shown_text(b: Block) -> str:
    """The text of a block in which markup is visible: without its code elements."""
    return b.text if b.plain is None else b.plain


def _holders(page: list[Block], nodes: list[Node], keys: list[int]) -> list[list[int]]:
    """For each block the keys of the subtrees it lies in."""
    out: list[list[int]] = [[] for _ in page]
    for n, k in zip(nodes, keys):
        for i in range(n.first, n.end):
            out[i].append(k)
    return out


def parse_pages(pages: DataFrame, id_col: str = "crawl_id", clean: bool = False) -> DataFrame:
    """What each page holds, read and parsed once: (id, host, pid, keys, items), where ``host`` and ``pid`` are the hashes of
    host and page, ``keys`` those of all its subtrees on that host, and each item has the ``keys`` of the subtrees it
    lies in. Items are (markup) of blocks in which markup shows, or with ``clean`` (text, row) of all blocks, in order;
    cells of a table row have the same ``row``. A page without HTML has no subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_keys, all_items = [], []
            for host, page, ct in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                text = decode(page, ct)
                keys: list[int] = []
                items: list[dict] | None = []
                if not text.strip():
                    items = None if clean else []
                elif not has_html(text):
                    if clean:
                        items = [{"text": clean_plain(text), "row": -1, "keys": []}]
                    elif k := kind_of_plain(text):
                        items = [{"markup": k, "keys": []}]
                else:
                    nodes: list[Node] = []
                    parsed = blocks(text, nodes)
                    nodes = [n for n in nodes if n.end > n.first]
                    keys = [site_key(host, n.hash) for n in nodes]
                    if clean:
                        items = [{"text": t, "row": r, "keys": h} for t, r, h in zip(*clean_blocks(parsed), _holders(parsed, nodes, keys)) if t.strip()]
                    else:
                        found = [(i, k) for i, x in enumerate(parsed) if not x.in_code for k in KINDS if hits(shown_text(x), k)]
                        if found:
                            held = _holders(parsed, nodes, keys)
                            items = [{"markup": k, "keys": held[i]} for i, k in found]
                all_keys.append(sorted(set(keys)))
                all_items.append(items)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(all_keys, pa.list_(pa.int64())), pa.array(all_items, kind)], [id_col, "host", "pid", "keys", "items"])

    within = [("text", pa.string()), ("row", pa.int32())] if clean else [("markup", pa.string())]
    kind = pa.list_(pa.struct([*within, ("keys", pa.list_(pa.int64()))]))
    item = "struct<text:string,row:int,keys:array<bigint>>" if clean else "struct<markup:string,keys:array<bigint>>"
    spec = f"{id_col} {pages.schema[id_col].dataType.simpleString()}"
    source = pages if clean else pages.where(F.col("page").isNotNull())
    each = source.select(id_col, F.xxhash64(F.coalesce(url_host(F.col("url")), F.lit(""))).alias("host"), F.xxhash64("page").alias("pid"), "page", "content_type")
    return spread(each, id_col).mapInArrow(run, f"{spec}, host bigint, pid bigint, keys array<bigint>, items array<{item}>")


def host_templates(parsed: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, gone): the keys of the template subtrees of each host: those on many of its different pages.

    Each different page of a host counts once, however often it was fetched. Counts per subtree have map-side partial
    sums, which a host with a third of all pages needs most. A page has at most a few hundred subtrees and a template
    is on a share of all pages, so the templates of a host are bounded, whatever its number of pages."""
    distinct = parsed.where(F.size("keys") > 0).groupBy("host", "pid").agg(F.any_value("keys").alias("keys"))
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    counts = distinct.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return counts.join(pages, "host").where(F.col("n") >= least_share * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("gone"))


def find_markup(pages: DataFrame, id_col: str = "crawl_id", clean: bool = False, templates: bool = True) -> DataFrame:
    """(id, markup) for each page and each kind of which markup shows; with ``clean``, (id, text) of every page instead.

    Main content is what no template subtree of the page's host holds: nothing else decides it. Hosts of fewer than
    ``LEAST_PAGES`` different pages have no templates and keep everything. A page without HTML counts with the kind it
    is written in. Null, empty and blank pages give no rows (a null text with ``clean``); pages with a null url count as
    one host; a page several times gives its rows each time; other columns are ignored. Without ``templates`` nothing
    is removed.

    Pages are read and parsed once; what was found, with the subtrees it lies in, is written. Templates are counted from
    that table and joined with it by host, which is the only join: Spark sends the hosts' templates to all tasks where
    they are few and shuffles, splitting busy hosts, where they are not."""
    parsed = cut(parse_pages(pages, id_col, clean), "parsed")
    if templates:
        gone = cut(host_templates(parsed), "templates")
        parsed = parsed.select(id_col, "host", "items").join(gone, "host", "left")
    else:
        parsed = parsed.withColumn("gone", F.lit(None).cast("array<bigint>"))
    left = F.filter("items", lambda x: F.col("gone").isNull() | ~F.arrays_overlap(x["keys"], F.col("gone")))
    if not clean:
        return parsed.where(F.size("items") > 0).select(id_col, F.explode(F.array_distinct(F.transform(left, lambda x: x["markup"]))).alias("markup"))
    before = lambda i: F.element_at(F.col("_left"), i)["row"]
    joint = lambda x, i: F.when(i == 0, F.lit("")).when((x["row"] >= 0) & (before(F.greatest(i, F.lit(1))) == x["row"]), F.lit(" | ")).otherwise(F.lit("\n\n"))
    return parsed.select(id_col, left.alias("_left")).select(id_col, F.when(F.col("_left").isNotNull(), F.array_join(F.transform("_left", lambda x, i: F.concat(joint(x, i), x["text"])), "")).alias("text"))


_FORMULA = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<![\w$\\])\$\$?(?=[^$\s])([^$\n]+)(?<=[^$\s])\$\$?(?![\w$])", re.S)


_COMMAND = re.compile(r"(?<![:\w])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}|(?<=[\w.])\\(?:footnote|emph|textbf|textit)\{([^{}]*)\}")


# One of these is in every form of markup.
_SIGNS = re.compile(r"[*_~#`\[|={<&\\$\ue010]|''|- ")


def clean_text(text: str) -> str:
    """A text without visible markup: tags, emphasis, links and commands become what they show, formulas stay between
    dollars; headings and lists keep their line and mark."""
    if not _SIGNS.search(text):  # no rule below can change it
        return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        body = next(g for g in m.groups() if g is not None).strip()
        if not re.search(r"\\[a-zA-Z]|[_^=<>+]", body):
            return m.group(0)
        kept.append(body)
        return f"\ue010{len(kept) - 1}\ue011"

    t = _FORMULA.sub(keep, text)
    t = re.sub(r"<!--.*?-->", " ", t, flags=re.S)
    t = re.sub(r"<br\s*/?>|</p>|</div>|</tr>", "\n", t, flags=re.I)
    t = re.sub(r"<li\b[^>]*>", "\n- ", t, flags=re.I)
    t = re.sub(r"<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", t, flags=re.I)
    t = re.compile(PATTERNS["html"][0], re.I).sub("", t)
    t = _ENTITY.sub(lambda m: unescape(m.group(0)), t)
    if re.search(_BULLET + r"[^\n]*?" + _BULLET, t):
        t = re.sub(_BULLET, "\n- ", t)
    t = re.sub(r"\{\|[^\n]*?(?=\n|\s!|\s\|)|\|\}|^\|-.*$|(?<=\s)\|-(?=\s)", " ", t, flags=re.M)
    t = re.sub(r"\[\[(?:File|Image|Category|Datei|Fichier):[^\[\]|]*(?:\|(?:thumb|left|right|\d+px))*\|?([^\[\]]*)\]\]", r"\1", t)
    t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\W\d][^\[\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"\{\{(?=[^\W\d])[^{}]*\}\}", "", t)
    t = re.sub(r"</?(?:ref|nowiki)\b[^>]*>", "", t)
    t = re.sub(r"(?m)(?:^|(?<=\s))(={2,6}) ?([^=\n]+?) ?\1(?=\s|$)", lambda m: f"\n{'#' * len(m.group(1))} {m.group(2)}\n", t)
    t = re.sub(r"(?<!')'{2,3}([^'\n]+(?:'[^'\n]+)*?)'{2,3}(?!')", r"\1", t)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]", r"\1", t)
    t = re.sub(r"(?:^|(?<=\s))\[[^\[\]\n]+\]:\s+(?:/|https?:)\S+", "", t)
    for mark in (r"\*\*", "__", "~~", r"\*", "_"):
        t = re.sub(rf"(?<![\w*_~\\]){mark}(?=[^\s*_~])([^\n*~]+?)(?<=[^\s*~]){mark}(?![\w*~])", r"\1", t)
    t = re.sub(r"\\(?:section|chapter)\*?\{([^{}]*)\}", r"\n## \1\n", t)
    t = re.sub(r"\\subsection\*?\{([^{}]*)\}", r"\n### \1\n", t)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"\\item\b\s*", "\n- ", t)
    t = re.sub(r"~?\\(?:label|cite|ref|eqref|index)\{[^{}]*\}", "", t)
    while (inner := _COMMAND.sub(lambda m: f" ({m.group(2)})" if m.group(0).startswith("\\footnote") and m.group(2) else m.group(1) or m.group(2) or "", t)) != t:
        t = inner  # from the innermost command outwards, however deep
    t = re.sub("\ue010(\\d+)\ue011", lambda m: f"${kept[int(m.group(1))]}$", t)
    return "\n".join(x for x in (" ".join(line.split()) for line in t.split("\n")) if x)


_clean = clean_text


def clean_blocks(page: list[Block]) -> tuple[list[str], list[int]]:
    """The clean text of each block and the table row it is a cell of, -1 if none: headings with hash marks, list items
    with dashes, code fenced with its lines, quotes marked."""
    out: list[str] = []
    rows: list[int] = []
    known: dict[int, int] = {}
    for b in page:
        tag, row = b.tag, -1
        clean = _clean if b.plain is None or any(hits(b.plain, k) for k in KINDS) else str  # shown code stays
        if any(n.tag == "pre" for n in b.path):
            out.append(f"```\n{b.lines or b.text}\n```")
        elif tag in ("td", "th"):
            tr = next((n for n in reversed(b.path) if n.tag == "tr"), None)
            row = known.setdefault(id(tr), len(known)) if tr is not None else -1
            out.append(clean(b.text))
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            out.append(f"{'#' * int(tag[1])} {clean(b.text)}")
        elif tag in ("li", "dt", "dd"):
            out.append(f"- {clean(b.text)}")
        elif any(n.tag == "blockquote" for n in b.path):
            out.append(f"> {clean(b.text)}")
        else:
            out.append(clean(b.text))
        rows.append(row)
    return out, rows


def clean_plain(text: str) -> str:
    """A page without HTML: code blocks stay, the rest is cleaned paragraph by paragraph."""
    out, at = [], 0
    for m in _PLAIN_CODE.finditer(text):
        out += [clean_text(p) for p in re.split(r"\n\s*\n", text[at : m.start()])] + [m.group(0)]
        at = m.end()
    out += [clean_text(p) for p in re.split(r"\n\s*\n", text[at:])]
    return "\n\n".join(x for x in out if x.strip())
