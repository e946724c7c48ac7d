"""Trains the model of ``boilerplate`` on labelled pages and writes its weights.

    python -m weftline.llm.train_boilerplate FOLDER [HELD_OUT_FOLDER]

The pages are those of ``crawl`` in the folder, at most ``MAX_PAGES``. Their labels come from ``label_page``, rules
that were written while reading pages of every layout: they know where each layout keeps its main content, and they
look at whole pages, at neighbours of neighbours and at fixed phrases, which the model does not."""

from __future__ import annotations

import glob
import json
import re
import sys
from collections import Counter

import numpy as np

from weftline.llm.boilerplate import _END, WEIGHTS, Crf, _link_share, _words, features
from weftline.llm.dom import Block, blocks, decode, has_html

MAX_PAGES, MIN_COUNT = 6000, 5
_OUTSIDE = frozenset("nav aside footer noscript form header button".split())
_CONTENT_TAGS = frozenset("h1 h2 h3 h4 li td th pre blockquote dt dd figcaption".split())
_WIDGET_ATTRS = re.compile(r"class=[\"']?(?:u|share|crumbs|cookie|newsletter|related|comments?|sidebar)\b|id=[\"']?(?:cookie|share|comments?)", re.I)


def label_page(page: list[Block]) -> list[bool]:
    """Which blocks are main content."""
    at = next((i for i, b in enumerate(page) if b.path and b.path[-1].tag == "h1"), None)
    if at is None:
        return [False] * len(page)
    home = page[at].path[-2] if len(page[at].path) > 1 else None
    bare = home is None or home.tag in ("body", "html")
    links = [_link_share(b) for b in page]
    out = [False] * len(page)
    teasers: object = None
    for i in range(at, len(page)):
        b = page[i]
        tag = b.path[-1].tag if b.path else ""
        if bare and ("©" in b.text[:3]):
            break
        if not bare and home not in b.path:
            continue
        parent = b.path[-2] if len(b.path) > 1 else None
        nxt = page[i + 1] if i + 1 < len(page) else None
        if tag in ("h2", "h3", "h4") and nxt is not None and links[i + 1] == 3 and nxt.path[-1].tag == "div":
            teasers = parent
            if bare or parent is home:
                teasers = home
        if teasers is not None and (teasers in b.path):
            # teasers may stand inside the main element, followed by more content there
            direct = b.path[-1] if teasers is home and len(b.path) and b.path.index(home) == len(b.path) - 2 else None
            if teasers is home and not bare and direct is not None and tag in ("p", "pre", "ul", "ol", "blockquote") and links[i] < 3:
                teasers = None
            else:
                continue
        at_home = b.path.index(home) + 1 if home in b.path else 0
        inner = b.path[at_home:]
        if any(x.tag in _OUTSIDE or _WIDGET_ATTRS.search(x.attrs) for x in inner):
            continue
        if b.control or "©" in b.text[:3] or (links[i] == 3 and tag not in ("p", "li", "td")):
            continue
        if tag in _CONTENT_TAGS or _END.search(b.text) or _words(b.text) >= 8:
            out[i] = True
    return out


def load_pages(folder: str, limit: int = MAX_PAGES) -> list[list[Block]]:
    import pyarrow.parquet as pq

    out = []
    for f in sorted(glob.glob(f"{folder}/crawl.parquet/*.parquet") or [f"{folder}/crawl.parquet"]):
        t = pq.read_table(f, columns=["page", "content_type"])
        for page, ct in zip(t.column("page").to_pylist(), t.column("content_type").to_pylist()):
            text = decode(page, ct)
            if text and has_html(text) and (b := blocks(text)):
                out.append(b)
                if len(out) >= limit:
                    return out
    return out


def fit(pages: list[list[Block]], labels: list[list[bool]], rounds: int = 150, l2: float = 2.0) -> Crf:
    """Maximum likelihood with a quadratic penalty; exact gradients by forward and backward sums over all pages at
    once, steps by Adam."""
    feats = [[[x for g in f for x in g] for f in features(p)] for p in pages]
    counts = Counter(x for p in feats for f in p for x in set(f))
    names = sorted(k for k, c in counts.items() if c >= MIN_COUNT)
    index = {k: i for i, k in enumerate(names)}
    longest = max(map(len, feats))
    rows, cols, cells = [], [], []
    y = np.zeros((len(pages), longest), int)
    mask = np.zeros((len(pages), longest), bool)
    for p, (page, lab) in enumerate(zip(feats, labels)):
        for t, f in enumerate(page):
            mask[p, t], y[p, t] = True, lab[t]
            for x in f:
                if x in index:
                    rows.append(p * longest + t)
                    cols.append(index[x])
    rows, cols = np.array(rows), np.array(cols)
    w, a = np.zeros(len(names)), np.zeros((2, 2))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    pair_mask = mask[:, 1:]
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & pair_mask).sum()
    target = np.bincount(cols, weights=y.reshape(-1)[rows], minlength=len(w))
    for step in range(1, rounds + 1):
        u = np.bincount(rows, weights=w[cols], minlength=mask.size).reshape(mask.shape)
        psi = np.zeros((*mask.shape, 2))
        psi[..., 1] = u
        alpha = np.zeros_like(psi)
        beta = np.zeros_like(psi)
        alpha[:, 0] = psi[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + a[0], alpha[:, t - 1, 1, None] + a[1]) + psi[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            x = psi[:, t + 1] + beta[:, t + 1]
            new = np.logaddexp(a[:, 0] + x[:, 0, None], a[:, 1] + x[:, 1, None])
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None]) * mask
        pair = np.exp(alpha[:, :-1, :, None] + a + (psi + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair_mask[..., None, None]
        gw = np.bincount(cols, weights=p1.reshape(-1)[rows], minlength=len(w)) - target + l2 * w
        ga = pair.sum((0, 1)) - seen + l2 * a
        for g, m, v, x in ((gw, mw, vw, w), (ga, ma, va, a)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.98
            v += 0.02 * g * g
            x -= 0.15 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return Crf({k: round(float(x), 4) for k, x in zip(names, w) if abs(x) > 1e-3}, [[round(float(x), 4) for x in r] for r in a])


def evaluate(crf: Crf, pages: list[list[Block]], labels: list[list[bool]]) -> dict[str, float]:
    """Precision and recall over blocks, and the share of pages without a wrong block."""
    tp = fp = fn = whole = 0
    for p, lab in zip(pages, labels):
        got = crf.decode(features(p))
        tp += sum(g and x for g, x in zip(got, lab))
        fp += sum(g and not x for g, x in zip(got, lab))
        fn += sum(x and not g for g, x in zip(got, lab))
        whole += got == lab
    return {"pages": len(pages), "precision": tp / max(1, tp + fp), "recall": tp / max(1, tp + fn), "whole pages": whole / max(1, len(pages))}


if __name__ == "__main__":
    train = load_pages(sys.argv[1])
    crf = fit(train, [label_page(p) for p in train])
    print("training", evaluate(crf, train, [label_page(p) for p in train]))
    if len(sys.argv) > 2:
        held = load_pages(sys.argv[2])
        print("held out", evaluate(crf, held, [label_page(p) for p in held]))
    with open(WEIGHTS, "w") as f:
        json.dump({"weights": crf.weights, "change": crf.change}, f, indent=0, sort_keys=True)
