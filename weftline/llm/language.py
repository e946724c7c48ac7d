"""Languages of pages and of their stretches (problem 3): segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary. A word's probability under a language is the
sum over all its segmentations into pieces, by a forward pass. The probabilities are fitted to sentences of known
language by expectation-maximisation, whose expected counts come from the same sums."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.boilerplate import main_blocks
from weftline.llm.dom import attributes, decode, has_html
from weftline.llm.encode import TOKENIZER_DIR
from weftline.session import spread

#: The class of text in none of the languages of the samples.
OTHER = "und"
#: Sentences of each language that the model is fitted to at most; ``lang_samples`` has 40 of each and does not grow.
MAX_SAMPLES = 2000
# Runs of letters with inner apostrophes; scripts without blanks go on until their script changes.
_WORD = re.compile(r"[぀-ゟ]+|[゠-ヿ]+|[㐀-鿿々]+|(?:(?![぀-ヿ㐀-鿿々])[^\W\d_])+")
_SPACED_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile(r"[぀-ヿ㐀-鿿々]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|(?<=[。！？])|\n+")

# ISO 639 codes and English names of the nine languages.
NAMES = {
    "en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "it": "it ita italian",
    "pt": "pt por portuguese", "nl": "nl nld dut dutch", "ru": "ru rus russian", "ja": "ja jpn japanese",
}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}


def declared(label: str | None) -> str | None:
    """The language that a label names, in any spelling: region, case, longer code or English name; else null."""
    first = re.split(r"[-_,; ]", (label or "").strip().lower(), maxsplit=1)[0]
    return _BY_NAME.get(first)


def pieces_of(folder: str = TOKENIZER_DIR, name: str = "piece_bpe_32k") -> set[str]:
    """The vocabulary in lower case: all its pieces of letters, with the mark of a word's beginning as a blank. The others
    (signs, digits, byte pieces) cannot occur, because words are runs of letters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
    out = set()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).replace("▁", " ").lower()
        if not p.startswith("<") and p and (p.strip().isalpha() or p == " "):
            out.add(p)
    return out


class Model:
    """Languages, and for each piece the logarithm of its probability under each language; ``floor`` is that of a
    single character outside the vocabulary."""

    def __init__(self, langs: list[str], prob: dict[str, np.ndarray], floor: np.ndarray):
        self.langs, self.prob, self.floor = langs, prob, floor
        self.longest = max(map(len, prob), default=1)
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)))

    def word(self, word: str) -> int:
        """The row of ``table`` with the word's log probability under each language: the sum over segmentations.
        Words are kept while they fit; the table is a cache and may begin anew."""
        k = len(self.rows)
        if k + 2 >= len(self.table):  # the last rows stay free: -1 and -2 stand for no row
            if k >= 1 << 18:
                return -1
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[k] = self.log_prob(word)
        self.rows[word] = k
        return k

    def log_prob(self, word: str) -> np.ndarray:
        return _forward(word if _unspaced(word) else " " + word, self.prob, self.floor, self.longest)

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log probability of the words of each text under each language: a row for each text, of zeros for one without
        words."""
        rows, at, starts = self.rows, [], []
        for t in texts:
            starts.append(len(at))
            at += [rows[w] if w in rows else self.word(w) for w in words_of(t)]
            at.append(-2)  # a row of zeros ends each text
        if not texts:
            return np.zeros((0, len(self.langs)))
        picked = self.table.take(at, axis=0, mode="wrap")
        picked[[s - 1 for s in starts[1:]] + [len(at) - 1]] = 0.0
        if -1 in at:  # beyond the cache
            words = [w for t in texts for w in [*words_of(t), ""]]
            for k in [k for k, a in enumerate(at) if a == -1]:
                picked[k] = self.log_prob(words[k])
        return np.add.reduceat(picked, starts, axis=0)

    def text(self, text: str) -> np.ndarray:
        return self.texts([text])[0]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; scripts without blanks also part where the script changes."""
    low = text.lower()
    return (_SPACED_WORD if low.isascii() or not _UNSPACED.search(low) else _WORD).findall(low)


def _unspaced(word: str) -> bool:
    return "぀" <= word[0] <= "鿿"


def _forward(s: str, prob: dict[str, np.ndarray], floor: np.ndarray, longest: int | None = None) -> np.ndarray:
    """log sum over segmentations, for all languages at once; long words are rescaled on the way and do not underflow."""
    n, get = len(s), prob.get
    longest = longest or max(map(len, prob), default=1)
    alpha = [np.ones_like(floor)]
    scale = 0.0
    for j in range(1, n + 1):
        p = get(s[j - 1])
        total = alpha[j - 1] * (floor if p is None else p)
        for i in range(max(0, j - longest), j - 1):
            p = get(s[i:j])
            if p is not None:
                total += alpha[i] * p
        alpha.append(total)
        if n > 20 and total.max() < 1e-200:  # rescale the window that later steps can still see
            for i in range(max(0, j - longest), j + 1):
                alpha[i] = alpha[i] * 1e200
            scale -= 200 * math.log(10)
    return np.log(np.maximum(alpha[n], 1e-320)) + scale


#: How likely a character that no sample has is under the class of other languages, in shares of an even vocabulary; under
#: the languages themselves it is a thousandth.
UNKNOWN = 0.05
#: And how much less likely the pieces of the samples are there than in all samples together: text that is made of them is
#: put in the nearest language, however little it resembles its samples, which are few.
DISCOUNT = 0.3


def fit(samples: Iterable[tuple[str, str]], vocabulary: set[str], rounds: int = 4, mass: float = 0.12) -> Model:
    """Piece probabilities for each language of (lang, text) rows.

    Expected piece counts are the forward-backward sums over segmentations. They are smoothed in two steps: towards
    the counts of all languages together, with the weight of ``mass``, and to an even share over the vocabulary, so
    that no piece is impossible anywhere. Text of a language without samples is like all of them and none: its class,
    ``OTHER``, has the counts of all languages together at a discount, and expects characters that no sample has."""
    words: dict[str, Counter] = defaultdict(Counter)
    used: Counter = Counter()
    for lang, text in samples:
        if lang and text and used[lang] < MAX_SAMPLES:
            used[lang] += 1
            for w in words_of(text):
                words[lang][" " + w if not _unspaced(w) else w] += 1
    langs = sorted(words)
    chars = {c for ws in words.values() for w in ws for c in w}
    vocab = {p for p in vocabulary if set(p) <= chars} | chars
    # Whole words of the samples are no pieces of their own: pieces come from the public vocabulary only.
    even, longest = 1.0 / max(1, len(vocab)), max(map(len, vocab), default=1)
    prob = {lang: dict.fromkeys(vocab, even) for lang in langs}
    counts: dict[str, Counter] = {}
    for _ in range(rounds):
        for lang in langs:
            counts[lang] = _expected(words[lang], prob[lang], longest)
        for lang in langs:
            total = sum(counts[lang].values()) or 1.0
            prob[lang] = {p: 0.999 * counts[lang][p] / total + 0.001 * even for p in vocab}
    everything: Counter = Counter()
    for lang in langs:
        total = sum(counts[lang].values()) or 1.0
        for p, c in counts[lang].items():
            everything[p] += c / total / len(langs)
    shared = {p: 0.9 * everything[p] + 0.1 * even for p in vocab}
    own = lambda g, p: (1 - mass) * (0.98 * counts[g][p] / (sum(counts[g].values()) or 1.0) + 0.02 * even * _short(p)) + mass * shared[p]
    out = {p: np.array([own(g, p) for g in langs] + [DISCOUNT * shared[p]]) for p in vocab}
    return Model([*langs, OTHER], out, even * np.array([1e-3] * len(langs) + [UNKNOWN]))


def _short(p: str) -> float:
    """Unseen long pieces are less likely than unseen short ones."""
    return 0.5 ** (len(p) - 1)


def _expected(words: Counter, prob: dict[str, float], longest: int) -> Counter:
    out: Counter = Counter()
    for w, c in words.items():
        n = len(w)
        a = [1.0] + [0.0] * n
        b = [0.0] * n + [1.0]
        spans = [(i, j, prob[w[i:j]]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if w[i:j] in prob]
        for i, j, p in spans:  # sorted by start: every a[i] is complete when it is used
            a[j] += a[i] * p
        for i, j, p in reversed(spans):
            b[i] += p * b[j]
        if a[n] > 0:
            for i, j, p in spans:
                out[w[i:j]] += c * a[i] * p * b[j] / a[n]
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and s.strip()]


#: Nats that a change of language costs, between paragraphs and inside one.
BETWEEN, WITHIN = 10.0, 14.0
#: What log probabilities are divided by for a confidence: sums over the words of a sentence are far too sure, because words
#: are not independent. Chosen on held-out samples (see the tests), where sentences of a confidence are right as often.
TEMPERATURE = 3.0


def label_text(model: Model, paragraphs: list[str]) -> list[tuple[int, int, int, str, float]]:
    """(paragraph, sentences, characters, language, confidence) of each sentence with words.

    The languages are the best path through all sentences of the text, where each change has its cost. The confidence
    of a sentence is the probability of its language among all, with the neighbours' language as it is on the path:
    a sentence that another language would explain better than the one it was put in has a low one."""
    parts = [(k, 1, x) for k, p in enumerate(paragraphs) for x in sentences(p)]
    table = model.texts([x for _, _, x in parts])
    keep = table[:, 0] < 0 if len(table) else np.zeros(0, bool)
    if not keep.all():
        parts, table = [p for p, k in zip(parts, keep) if k], table[keep]
    items = [(k, n, len(p)) for k, n, p in parts]
    scores = table
    if not items:
        return []
    firsts = table.argmax(axis=1)
    if (firsts == firsts[0]).all():  # the best path never changes
        path = firsts.tolist()
    else:
        best, back = scores[0], []
        for t in range(1, len(items)):
            cost = WITHIN if items[t][0] == items[t - 1][0] else BETWEEN
            top = int(best.argmax())
            floor = best[top] - cost
            back.append((best < floor, top))
            best = np.maximum(best, floor) + scores[t]
        state = int(best.argmax())
        path = [state]
        for move, top in reversed(back):
            state = top if move[state] else state
            path.append(state)
        path.reverse()
    chosen = np.array(path)
    rows = np.arange(len(items))
    alone = scores - WITHIN * (np.arange(scores.shape[1])[None, :] != chosen[:, None]) if len(items) > 1 else scores
    conf = 1.0 / np.exp(np.clip((alone - alone[rows, chosen][:, None]) / TEMPERATURE, -700, 700)).sum(axis=1)
    return [(*x, model.langs[g], float(c)) for x, g, c in zip(items, path, conf)]


def stretches(labels: list[tuple[int, int, int, str, float]]) -> list[tuple[str, float, int, int, int]]:
    """(language, confidence, first paragraph, last paragraph, characters) of each stretch in one language; its confidence
    is the mean of its sentences', by their length."""
    out: list[list] = []
    for k, _, chars, lang, conf in labels:
        if out and out[-1][0] == lang:
            out[-1][1], out[-1][3], out[-1][4] = out[-1][1] + conf * chars, k, out[-1][4] + chars
        else:
            out.append([lang, conf * chars, k, k, chars])
    return [(lang, total / chars, first, last, chars) for lang, total, first, last, chars in out]


def paragraph_languages(labels: list[tuple[int, int, int, str, float]], least: int = 2) -> set[str]:
    """The languages of the samples in which some paragraph has ``least`` sentences or more."""
    n: Counter = Counter()
    for k, count, _, lang, _ in labels:
        if lang != OTHER:
            n[k, lang] += count
    return {lang for (_, lang), c in n.items() if c >= least}


_META = re.compile(r"<meta\b[^>]*>", re.I)
_HTML_TAG = re.compile(r"<html\b([^>]*)>", re.I)


def declaration(text: str) -> str | None:
    """The lang of the html element; where that attribute is absent, the content-language meta element."""
    m = _HTML_TAG.search(text)
    if m:
        a = attributes(m.group(1))
        if "lang" in a:
            return a["lang"]
        if re.search(r"(?<![\w:-])lang(?:\s|$|=)", m.group(1)):
            return ""
    head = text[: m.end()] if (m := re.search(r"</head\s*>|<body\b", text, re.I)) else text
    for tag in _META.findall(head):
        a = attributes(tag)
        if a.get("http-equiv", "").lower() == "content-language" or a.get("name", "").lower() == "content-language":
            return a.get("content", "")
    return None


_PLAIN_CODE = re.compile(r"^(```|~~~).*?^\1|<pre>.*?</pre>|<(?:code|source)[^>]*>.*?</(?:code|source)>|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", re.S | re.M)


def page_paragraphs(text: str) -> list[str]:
    """The main content's blocks outside code; of a page without HTML its paragraphs."""
    if has_html(text):
        return [b.text for b in main_blocks(text) if not b.in_code]
    prose = _PLAIN_CODE.sub("\n\n", text)
    return [" ".join(p.split()) for p in re.split(r"\n\s*\n", prose) if p.strip() and not p.lstrip().startswith(("{|", "{{", "|", "!"))]


def judge(model: Model, text: str) -> tuple[str | None, list[tuple[int, int, int, str, float]], set[str], bool]:
    """(declared language, labels, paragraph languages, whether the declaration is a case)."""
    labels = label_text(model, page_paragraphs(text))
    langs = paragraph_languages(labels)
    said = declared(declaration(text)) if has_html(text) else None
    return said, labels, langs, len(langs) > 1 or bool(langs) and said not in langs


def fit_from(samples: DataFrame, folder: str = TOKENIZER_DIR) -> Model:
    """The model of a table of labelled sentences. At most ``MAX_SAMPLES`` rows of each language reach the driver."""
    per = samples.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.row_number().over(_window()).alias("_n"))
    return fit([(r["lang"], r["text"]) for r in per.where(F.col("_n") <= MAX_SAMPLES).collect()], pieces_of(folder))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")


def page_languages(df: DataFrame, model: Model, found_only: bool, id_col: str = "crawl_id") -> DataFrame:
    """(id, lang) of the paragraphs of each page whose declaration is absent, empty, unknown or wrong, or which mixes
    languages, if ``found_only``; else (id, segment, lang, confidence, declared, first, last, chars) of each stretch.

    Null pages and pages without words give no rows; pages without HTML declare nothing; a page several times gives
    its rows each time; other columns are ignored. The model (some 100 kB, the size of the vocabulary) is sent with
    the tasks; a map over Arrow batches, no shuffle."""
    spec = f"{id_col} {df.schema[id_col].dataType.simpleString()}"
    packed = (model.langs, list(model.prob), np.stack(list(model.prob.values())).astype(np.float32), model.floor)

    def unpack() -> Model:
        langs, names, values, floor = packed
        return Model(langs, dict(zip(names, values.astype(np.float64))), floor)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack()
        for b in batches:
            ids, langs = [], []
            for i, page, ct in zip(*(c.to_pylist() for c in b.columns)):
                text = decode(page, ct)
                _, _, got, case = judge(m, text) if text.strip() else (None, [], set(), False)
                if case:
                    ids += [i] * len(got)
                    langs += sorted(got)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(langs, pa.string())], [id_col, "lang"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack()
        for b in batches:
            rows = []
            for i, page, ct in zip(*(c.to_pylist() for c in b.columns)):
                text = decode(page, ct)
                if text.strip():
                    said, labels, _, _ = judge(m, text)
                    rows += [(i, k, lang, conf, said, first, last, chars) for k, (lang, conf, first, last, chars) in enumerate(stretches(labels))]
            cols = list(zip(*rows)) if rows else [[] for _ in range(8)]
            types = [b.column(0).type, pa.int32(), pa.string(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [id_col, "segment", "lang", "confidence", "declared", "first", "last", "chars"])

    slim = spread(df.where(F.col("page").isNotNull()).select(id_col, "page", "content_type"), id_col)
    if found_only:
        return slim.mapInArrow(found, f"{spec}, lang string")
    return slim.mapInArrow(segments, f"{spec}, segment int, lang string, confidence double, declared string, first int, last int, chars int")
