"""Encoding a corpus with a public byte-level BPE tokenizer (problem 8): tree concatenation of long texts."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

#: Where the public vocabulary files lie; the folder must exist on every executor.
TOKENIZER_DIR = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the public pattern that splits text into pieces before merges are applied.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are encoded in leaves of at most this many.
LEAF_CHARS = 16_384
_KEEP = 8  # characters of one kind that a cut inside a run leaves on both sides

_loaded: dict = {}


def encoding(folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k"):
    """The tokenizer, once per Python process."""
    if (folder, name) not in _loaded:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[folder, name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, name]


def _kind(c: str) -> str:
    """Letter, number, space or other, as the pattern tells them apart."""
    import unicodedata

    if c.isspace() and c not in "\x1c\x1d\x1e\x1f":
        return "S"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "P"


def _safe(text: str, i: int) -> bool:
    """Whether pieces always part between i - 1 and i: no alternative of the pattern goes from a character that isn't
    a space to one of another kind, but for the contractions, which go from a quote to a letter."""
    a, b = _kind(text[i - 1]), _kind(text[i])
    return a != "S" and a != b and not (a == "P" and b == "L")


def _inside(text: str, i: int) -> bool:
    """Whether i is inside a run of one kind, with some of it on both sides."""
    return i >= _KEEP and all(_kind(c) == _kind(text[i]) for c in text[i - _KEEP : i + _KEEP]) and i + _KEEP <= len(text)


def leaves(text: str, limit: int) -> list[tuple[str, bool]]:
    """The text in parts of at most ``limit`` characters, halved again and again, each with whether it must be merged
    with the next one: only where no place near the middle parts the pieces, inside one very long piece.

    Pieces don't part for sure only inside a run of one kind, after a space, and from a sign to a letter. So what has no
    place to part is spaces, signs and letters in this order, and one of the three runs is long enough to be cut inside:
    no text of more than a hundred characters or so is ever left whole."""
    if len(text) <= limit:
        return [(text, False)]
    mid, reach, cut, merge = len(text) // 2, min(len(text) // 4, limit // 4), 0, False
    for d in range(reach):
        if _safe(text, mid - d):
            cut = mid - d
            break
        if _safe(text, mid + d):
            cut = mid + d
            break
    if not cut:
        for d in range(len(text) // 2 - _KEEP):
            cut = next((i for i in (mid - d, mid + d) if _inside(text, i)), 0)
            if cut:
                merge = True
                break
        else:  # shorter than a hundred characters
            return [(text, False)]
    left, right = leaves(text[:cut], limit), leaves(text[cut:], limit)
    return left[:-1] + [(left[-1][0], merge)] + right


def encode_leaf(enc, text: str) -> tuple[list[int], int, int, int]:
    """(ids, number of ids of the first piece, of the last piece, number of pieces up to 2)."""
    import regex

    ids = enc.encode_ordinary(text)
    first = regex.match(PATTERN, text)
    if first is None:
        return ids, 0, 0, 0
    if first.end() == len(text):
        return ids, len(ids), len(ids), 1
    start = len(text) - 1  # back to a place where pieces part, then forward to the last piece
    while start > 0 and not _safe(text, start):
        start -= 1
    last = None
    for last in regex.finditer(PATTERN, text[start:]):
        pass
    return ids, len(enc._encode_single_piece(first.group())), len(enc._encode_single_piece(last.group())), 2


def join_ids(enc, a: list[int], b: list[int]) -> list[int]:
    """The encoding of one piece from the encodings of its two halves: the ids around the join are encoded again in a
    window that grows until it fits exactly on both sides. Merges only look at neighbours, so a sequence in which
    every two neighbours are the encoding of their own bytes is the encoding of the whole."""
    data = enc.decode_single_token_bytes

    def fits(x: int, y: int) -> bool:
        return enc._encode_single_piece(data(x) + data(y)) == [x, y]

    k = 4
    while True:
        i, j = max(0, len(a) - k), min(len(b), k)
        middle = enc._encode_single_piece(b"".join(map(data, [*a[i:], *b[:j]])))
        if (i == 0 or fits(a[i - 1], middle[0])) and (j == len(b) or fits(middle[-1], b[j])):
            return a[:i] + middle + b[j:]
        k *= 2


def merge_leaves(enc, parts: list[tuple[list[int], int, int, int, bool]]) -> list[int]:
    """The encoding of a text from those of its leaves, neighbours merged pairwise as in a tree."""
    while len(parts) > 1:
        up = []
        for i in range(0, len(parts) - 1, 2):
            (x, xf, xl, xn, join), (y, yf, yl, yn, then) = parts[i], parts[i + 1]
            if not join:
                up.append((x + y, xf, yl, 2, then))
                continue
            whole = join_ids(enc, x[len(x) - xl :], y[:yf])
            n = 1 if xn == 1 and yn == 1 else 2
            up.append((x[: len(x) - xl] + whole + y[yf:], len(whole) if xn == 1 else xf, len(whole) if yn == 1 else yl, n, then))
        parts = up + parts[len(parts) - len(parts) % 2 :]
    return parts[0][0] if parts else []


def encode_text(enc, text: str | None, limit: int = LEAF_CHARS) -> list[int]:
    """One text, in this process, by the same leaves and merges as in the distributed form."""
    if not text:
        return []
    return merge_leaves(enc, [(*encode_leaf(enc, t), m) for t, m in leaves(text, limit)])


def _result(out: str, values: list) -> pa.Array:
    return pa.array([len(v) for v in values], pa.int32()) if out == "tokens" else pa.array(values, pa.list_(pa.int32()))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k", limit: int = LEAF_CHARS, out: str = "ids") -> DataFrame:
    """(id, ids) of every row of ``df``, or (id, tokens), their number, if ``out`` is "tokens".

    Null and empty texts give an empty list (0 tokens). Strings that look like special tokens are ordinary text.
    Repeated rows come out as often as they come in; null ids are kept; other columns are ignored.

    Texts up to ``limit`` characters are encoded where they are read, in Arrow batches. Longer ones are cut into a
    tree of leaves, the leaves of all long texts are spread over the cluster, and each text's leaves are merged where
    its result is written: the only shuffle, and only for long texts."""
    spec = f"{id_col} {df.schema[id_col].dataType.simpleString()}"
    kind = f"{out} {'int' if out == 'tokens' else 'array<int>'}"
    slim = df.select(id_col, F.col(text_col).alias("_text"))
    long = F.coalesce(F.length("_text") > limit, F.lit(False))

    def short_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            ids = [enc.encode_ordinary(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _result(out, ids)], [id_col, out])

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = leaves(t, limit)
                h = hash_text(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(p), b.column(0).type), pa.array([h] * len(p)), pa.array(range(len(p)), pa.int32()), pa.array([x for x, _ in p]), pa.array([m for _, m in p])],
                    [id_col, "_hash", "_seq", "_leaf", "_merge"],
                )

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            got = [encode_leaf(enc, t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([g[0] for g in got], pa.list_(pa.int32())), *(pa.array([g[k] for g in got], pa.int32()) for k in (1, 2, 3)), b.column(4)],
                [id_col, "_hash", "_seq", "_ids", "_first", "_last", "_pieces", "_merge"],
            )

    def merge(group: pa.Table) -> pa.Table:
        enc = encoding(folder, name)
        rows = sorted(group.to_pylist(), key=lambda r: r["_seq"])
        copies = sum(r["_seq"] == 0 for r in rows)  # the same row several times
        parts = [(r["_ids"], r["_first"], r["_last"], r["_pieces"], r["_merge"]) for r in rows[::copies]]
        ids = merge_leaves(enc, parts)
        return pa.table([pa.array([rows[0][id_col]] * copies, group.schema.field(id_col).type), _result(out, [ids] * copies)], [id_col, out])

    done = spread(slim.where(~long), id_col).mapInArrow(short_texts, f"{spec}, {kind}")
    cut = slim.where(long).mapInArrow(cut_texts, f"{spec}, _hash string, _seq int, _leaf string, _merge boolean")
    coded = cut.repartition("_hash", "_seq").mapInArrow(encode_leaves, f"{spec}, _hash string, _seq int, _ids array<int>, _first int, _last int, _pieces int, _merge boolean")
    return done.unionByName(coded.groupBy(id_col, "_hash").applyInArrow(merge, f"{spec}, {kind}"))


def hash_text(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()
