"""Per-document text quality statistics and a verdict whether a text is natural prose.

A huge document is cut into chunks, each with a margin of context on both sides. Every count belongs to one place of the
text and depends on no more than that margin, so counts of chunks add up to those of the whole text; a line that an edge
cuts leaves its piece as boundary state, which is completed by the next chunk's. States merge associatively in a tree.
Ratios, the class of each line and the verdict come from completed lines only. Lines are told apart by a small model that is
fitted on labelled documents; without labels the public rule of web corpora holds (a line of at least five words that ends
with a terminal mark is prose).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import free_name

#: Characters of a chunk, of context on each side, and chunk states that one merge of the tree takes.
CHUNK, MARGIN, FAN_IN = 65_536, 256, 64
#: Bound of the fitted sample: labelled documents of at most one chunk, in the order of a hash of their id.
SAMPLE_DOCS = 1000
#: Characters that NumPy works at a time.
_SLICE = 400_000

# Very common words of the languages with spaces.
COMMON_WORDS = (
    "the of and to in a is that it for was on are as with be at by this have from or not but what all were when we there an which their if will about how they you i who"
    " der die das und ist den von zu mit sich des auf für nicht ein eine auch es werden hat dass sie nach wird bei noch wie war wir über oder aber durch man dann im dem ich"
    " le la les de et du un une que qui dans pour pas sur au avec ce il elle nous vous se sa son ses plus par ne ou mais sont été être tout si leur"
    " el los las del y en por con su al lo como más pero sus ha sin sobre este entre cuando todo esta ser también fue hasta desde está porque"
).split()
#: Characters of a word that tell whether it is common; longer words are not.
_WORD = 24

# Classes of characters.
NEWLINE, SPACE, TAB, LOWER, UPPER, LETTER, IDEOGRAPH, HIRAGANA, KATAKANA, DIGIT, MARK, STOP, WIDE_STOP, COMMA, WIDE_COMMA, COLON, PIPE, CLOSE, OPEN, ANGLE, HASH, DASH, SIGN, BROKEN, OTHER, TAG = range(26)
CLASSES = 26
_BY_CHARACTER = {
    NEWLINE: "\n", TAB: "\t", STOP: ".!?…", WIDE_STOP: "。！？｡", COMMA: ",;", WIDE_COMMA: "，、；", COLON: ":：", PIPE: "|｜", CLOSE: "\"'”’»」』)]}）】》", OPEN: "“‘«「『([{（【《„",
    ANGLE: "<>", HASH: "#＃", DASH: "-–—*•·●▪◦‣→⁃+", SIGN: "/\\=_@%&~^$`", BROKEN: "�",
}
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,250}>")
_CELL, _ITEM = re.compile(r"</?(?:td|th|tr|table|thead|tbody)\b", re.I), re.compile(r"</?(?:li|ul|ol|dt|dd)\b", re.I)

# What a piece of a line holds: sums, bit maps that are joined by or, codes of its first and of its last visible characters.
_EXTRA = ("tokens", "words", "common", "word_chars", "long", "gaps", "tight", "breaks", "misread", "cells", "items", "numbers")
SUMS = CLASSES + len(_EXTRA)
_AT = {k: CLASSES + i for i, k in enumerate(_EXTRA)}
_TOP = 0x30000


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower-case form of each code point below _TOP (those above count as the last), and the hashes of common words."""
    kind = np.full(_TOP, OTHER, "u1")
    lower = np.arange(_TOP, dtype="u8")
    for c in range(_TOP):
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat == "Ll":
            kind[c] = LOWER
        elif cat in ("Lu", "Lt"):
            kind[c] = UPPER
            low = ch.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or c >= 0x20000:
            kind[c] = IDEOGRAPH
        elif 0x3040 <= c <= 0x309F:
            kind[c] = HIRAGANA
        elif 0x30A0 <= c <= 0x30FF:
            kind[c] = KATAKANA
        elif cat[0] == "L":
            kind[c] = LETTER
        elif cat == "Nd":
            kind[c] = DIGIT
        elif cat[0] == "M":
            kind[c] = MARK
        elif ch.isspace():
            kind[c] = SPACE
        elif 0x80 <= c < 0xA0:
            kind[c] = BROKEN
    for k, chars in _BY_CHARACTER.items():
        kind[[ord(x) for x in chars]] = k
    words = sorted(set(COMMON_WORDS))
    codes = _codes("\n".join(words))
    low = lower[np.minimum(codes, _TOP - 1)]
    ends = np.flatnonzero(np.append(codes, 10) == 10)
    starts = np.append(0, ends[:-1] + 1)
    return kind, lower, np.sort(_hashes(low, starts, ends))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of an odd number and of its inverse modulo 2^64."""
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)])), np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of codes[start:end] for each pair, from prefix sums."""
    up, down = _powers(max(1 << 20, 1 << len(codes).bit_length()))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * up[: len(codes)])])
    h = (sums[ends] - sums[starts]) * down[starts]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Pieces:
    """Rows for the lines, or pieces of lines, of a text between two places."""

    __slots__ = ("sums", "bits", "head", "tail")

    def __init__(self, sums: np.ndarray, bits: np.ndarray, head: np.ndarray, tail: np.ndarray):
        self.sums, self.bits, self.head, self.tail = sums, bits, head, tail

    @staticmethod
    def of(text: str, a: int = 0, b: int | None = None) -> Pieces:
        """The lines of text[a:b]; what stands around it is context and not counted."""
        b = len(text) if b is None else b
        kinds, lowers, common = _tables()
        codes = _codes(text)
        at = np.minimum(codes, _TOP - 1)
        kind = kinds[at]
        extra: dict[str, np.ndarray] = {}
        if "<" in text:
            kind = kind.copy()
            tags = {"cells": [], "items": []}
            for m in _TAG.finditer(text):
                kind[m.start() : m.end()] = TAG
                for name, pattern in (("cells", _CELL), ("items", _ITEM)):
                    if pattern.match(m[0]):
                        tags[name].append(m.start())
            extra = {k: np.array(v, "i8") for k, v in tags.items()}
        broken = kind == NEWLINE
        solid = ~(broken | (kind == SPACE) | (kind == TAB) | (kind == TAG))
        letter = (kind == LOWER) | (kind == UPPER) | (kind == LETTER) | (kind == MARK)
        before = lambda x, n=1: np.concatenate([np.zeros(min(n, len(x)), bool), x[:-n]])
        after = lambda x: np.append(x[1:], False)
        starts, ends = np.flatnonzero(solid & ~before(solid)), np.flatnonzero(solid & ~after(solid)) + 1
        extra["tokens"] = starts
        long = np.zeros(len(codes) + 1, "i4")
        wide = ends - starts >= 40
        long[starts[wide]] += 1
        long[ends[wide]] -= 1
        east = (kind == IDEOGRAPH) | (kind == HIRAGANA) | (kind == KATAKANA)
        extra["long"] = np.flatnonzero((np.cumsum(long[:-1]) > 0) & ~east)
        ws, we = np.flatnonzero(letter & ~before(letter)), np.flatnonzero(letter & ~after(letter)) + 1
        low = lowers[at]
        hashes = _hashes(low, ws, np.minimum(we, ws + _WORD + 1))
        extra["words"], extra["word_chars"] = ws, np.flatnonzero(letter)
        known = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        extra["common"] = ws[known & (we - ws <= _WORD)]
        space = ~solid & ~broken
        extra["gaps"] = np.flatnonzero(solid & before(space) & before(space, 2) & before(space, 3))
        sep = (kind == COMMA) | (kind == WIDE_COMMA)
        extra["tight"] = np.flatnonzero(sep & after(solid))
        stop = kind == STOP
        last = ~after(solid)
        closed = after((kind == CLOSE) & last)
        extra["breaks"] = np.flatnonzero(stop & ~before(kind == DIGIT) & (last | closed) | (kind == WIDE_STOP))
        lead = (codes >= 0xC2) & (codes <= 0xF4)
        extra["misread"] = np.flatnonzero(lead & after(((codes >= 0x80) & (codes <= 0xBF)) | (kind == BROKEN)))
        digit = kind == DIGIT
        extra["numbers"] = np.flatnonzero(digit & ~before(digit))

        line = np.cumsum(broken[a:b], dtype="i8") - broken[a:b]
        n = int(line[-1] + broken[b - 1]) + 1 if b > a else 1
        sums = np.zeros((n, SUMS), "i8")
        sums[:, :CLASSES] = np.bincount(line * CLASSES + kind[a:b], minlength=n * CLASSES).reshape(n, CLASSES)
        for k, places in extra.items():
            own = places[(places >= a) & (places < b)]
            sums[:, _AT[k]] = np.bincount(line[own - a], minlength=n)
        bits = np.zeros((n, 3), "u8")
        here = np.flatnonzero(solid[a:b])
        one = np.uint64(1)
        head, tail = np.zeros((n, 4), "u1"), np.zeros((n, 2), "u1")
        if len(here):
            of = line[here]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            rows = of[first]
            bits[rows, 0] = np.bitwise_or.reduceat(one << (codes[a:b][here] % 64).astype("u8"), first)
            p, q = here[first] + a, here[np.append(first[1:], len(here)) - 1] + a
            padded = np.append(kind, [NEWLINE] * 2)
            step = p + np.isin(kind[p], (OPEN,))
            for _ in range(8):
                step = step + (padded[np.minimum(step, len(kind))] == DIGIT)
            get = lambda x: padded[np.minimum(x, len(kind))]
            head[rows] = np.stack([kind[p], get(p + 1), get(step), get(step + 1)], axis=1)
            back = q.copy()
            for _ in range(8):
                back = np.where((kind[back] == CLOSE) & (back > 0), back - 1, back)
            tail[rows] = np.stack([kind[q], kind[back]], axis=1)
        own = (ws >= a) & (ws < b)
        if own.any():
            of, h = line[ws[own] - a], hashes[own]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            place = h >> np.uint64(57)
            for k in (0, 1):
                mark = np.where(place // 64 == k, one << (place % np.uint64(64)), np.uint64(0))
                bits[of[first], 1 + k] = np.bitwise_or.reduceat(mark, first)
        return Pieces(sums, bits, head, tail)

    def __len__(self) -> int:
        return len(self.sums)

    def __getitem__(self, rows) -> Pieces:
        return Pieces(self.sums[rows], self.bits[rows], self.head[rows], self.tail[rows])

    def __add__(self, other: Pieces) -> Pieces:
        """Pieces of the same lines, `other` behind."""
        mine, theirs = self.solid > 0, other.solid > 0
        return Pieces(self.sums + other.sums, self.bits | other.bits, np.where(mine[:, None], self.head, other.head), np.where(theirs[:, None], other.tail, self.tail))

    @property
    def solid(self) -> np.ndarray:
        return self.sums[:, :CLASSES].sum(axis=1) - self.sums[:, [NEWLINE, SPACE, TAB, TAG]].sum(axis=1)

    def ends_stopped(self) -> np.ndarray:
        return np.isin(self.tail[:, 1], (STOP, WIDE_STOP)) & (self.solid > 0)

    def features(self) -> np.ndarray:
        n = np.maximum(self.solid, 1).astype("f4")[:, None]
        x = self.sums.astype("f4")
        e = {k: x[:, i : i + 1] for k, i in _AT.items()}
        tokens, words = np.maximum(e["tokens"], 1), np.maximum(e["words"], 1)
        chars = np.bitwise_count(self.bits[:, :1]).astype("f4")
        terms = np.bitwise_count(self.bits[:, 1:]).sum(axis=1, keepdims=True).astype("f4")
        east = x[:, [IDEOGRAPH, HIRAGANA, KATAKANA]].sum(axis=1, keepdims=True)
        onehot = lambda c: np.eye(CLASSES, dtype="f4")[c].reshape(len(c), -1)
        return np.concatenate(
            [
                x[:, SPACE : CLASSES - 1] / n, np.log1p(n) / 4, np.log1p(tokens) / 3, np.log1p(n / tokens) / 3, e["words"] / tokens, e["common"] / words, np.minimum(e["common"], 3) / 3, e["long"] / n, np.log1p(e["gaps"]),
                e["tight"] / tokens, np.log1p(e["tight"]), np.log1p(e["breaks"]), 20 * e["breaks"] / (n + 20), e["misread"] / n, np.minimum(e["cells"], 2), np.minimum(e["items"], 2), e["numbers"] / tokens, np.log1p(x[:, [TAB, PIPE, HASH]]),
                chars / np.minimum(n, 64), terms / np.minimum(words, 128), east / n, (x[:, [COMMA]] + x[:, [WIDE_COMMA]]) / tokens, x[:, [COMMA]] * 10 / n, x[:, [WIDE_COMMA]] * 10 / n, onehot(self.head), onehot(self.tail),
            ],
            axis=1,
        )

    def rule(self) -> np.ndarray:
        """1 for a line of at least five words, or twelve characters of a script without spaces, that ends with a terminal mark; else -1."""
        east = self.sums[:, [IDEOGRAPH, HIRAGANA, KATAKANA]].sum(axis=1)
        enough = (self.sums[:, _AT["tokens"]] >= 5) | (east >= 12)
        return np.where(self.ends_stopped() & enough, 1.0, -1.0).astype("f4")


class LineModel:
    """Probability that a line is prose: one hidden layer over the features of a line, added to the rule."""

    def __init__(self, features: int, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, 1 / np.sqrt(features / 6), (features, hidden)).astype("f4"), np.zeros(hidden, "f4"), np.zeros((hidden, 1), "f4"), np.zeros(1, "f4"), np.array([1.5], "f4")]

    def logit(self, x: np.ndarray, rule: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2, r = self.w
        return (np.tanh(x @ w1 + b1) @ w2)[:, 0] + b2 + r * rule

    def prose(self, lines: Pieces) -> np.ndarray:
        return self.logit(lines.features(), lines.rule()) > 0

    def fit(self, lines: Pieces, doc: np.ndarray, label: np.ndarray, epochs: int = 300, rate: float = 0.02, decay: float = 3e-4) -> LineModel:
        """Fit on labels of documents only: a document's share of prose is that of its lines, weighted by their characters."""
        x, rule, n, docs = lines.features(), lines.rule(), lines.solid.astype("f4"), len(label)
        # Lines that look alike in all respects (standing lines) are worked once; their weight lies in their documents.
        total = np.maximum(np.bincount(doc, n, docs), 1)
        part = (n / total[doc]).astype("f4")
        y = label.astype("f4")
        balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)).astype("f4")
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        for t in range(1, epochs + 1):
            w1, b1, w2, b2, r = self.w
            h = np.tanh(x @ w1 + b1)
            z = (h @ w2)[:, 0] + b2 + r * rule
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            share = np.bincount(doc, part * p, docs)
            k = 10.0
            q = 1 / (1 + np.exp(-k * (share - 0.5)))
            g_doc = (balance * (q - y) * k / docs).astype("f4")
            g = g_doc[doc] * part * p * (1 - p) + 2e-2 * part * (p * (1 - p)) * (1 - 2 * p) / docs  # lines are of one kind
            gh = np.outer(g, w2[:, 0]) * (1 - h * h)
            grads = [x.T @ gh + decay * w1, gh.sum(axis=0), (h.T @ g)[:, None] + decay * w2, np.array([g.sum()], "f4"), np.array([(g * rule).sum()], "f4")]
            step = rate * min(1.0, 2 * (1 - t / (epochs + 1)))
            for i, d in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.99 * v[i] + 0.01 * d * d
                self.w[i] = (self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)).astype("f4")
        return self


def features_of(text: str = "") -> int:
    return Pieces.of(text).features().shape[1]


def fit_line_model(labelled: DataFrame, doc: str, text: str, label: str, sample_docs: int = SAMPLE_DOCS) -> LineModel:
    """A model fitted on at most `sample_docs` labelled documents of at most one chunk; nulls in any column are left out.

    Without documents of both labels the model is the rule alone.
    """
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0) & (F.length(text) <= CHUNK)).select(F.col(text).alias("t"), F.col(label).alias("y"), F.xxhash64(doc).alias("h"))
    picked = rows.orderBy("h", "t").limit(sample_docs).select("t", "y").toPandas()
    model = LineModel(features_of())
    if picked.y.nunique() < 2:
        return model
    texts, y = picked.t.tolist(), picked.y.to_numpy(bool)
    lines, doc_of = lines_of_texts(texts)
    seen = lines.solid > 0
    return model.fit(lines[seen], doc_of[seen], y)


def lines_of_texts(texts: list[str]) -> tuple[Pieces, np.ndarray]:
    """The lines of all texts and the text of each."""
    doc = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
    parts, a, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > _SLICE or i == len(texts) - 1:
            parts.append(Pieces.of("\n".join(texts[a : i + 1])))
            a, size = i + 1, 0
    if not parts:
        return Pieces.of("")[:0], doc
    return Pieces(*(np.concatenate([getattr(p, k) for p in parts]) for k in Pieces.__slots__)), doc


COUNTS = ("lines", "stopped_lines", "words", "word_chars", "common_words", "letters", "digits", "solid_chars", "prose_chars", "other_chars")


def _counts(lines: Pieces, model: LineModel) -> np.ndarray:
    """(lines x COUNTS) of completed lines; zeros for lines without a visible character."""
    n, prose = lines.solid, model.prose(lines)
    s = lines.sums
    letters = s[:, [LOWER, UPPER, LETTER, IDEOGRAPH, HIRAGANA, KATAKANA]].sum(axis=1)
    out = np.stack([n > 0, lines.ends_stopped(), s[:, _AT["tokens"]], n, s[:, _AT["common"]], letters, s[:, DIGIT], n, n * prose, n * ~prose], axis=1).astype("i8")
    return out * (n > 0)[:, None]


class State:
    """What a stretch of text adds to its document: counts of its whole lines and the pieces of lines at its edges.

    Without a line break the stretch is one piece (`first`), with one it has two (`first`, `last`).
    """

    __slots__ = ("counts", "first", "last")

    def __init__(self, counts: np.ndarray, first: Pieces, last: Pieces | None):
        self.counts, self.first, self.last = counts, first, last

    @staticmethod
    def of(text: str, model: LineModel, a: int = 0, b: int | None = None) -> State:
        lines = Pieces.of(text, a, b)
        if len(lines) == 1:
            return State(np.zeros(len(COUNTS), "i8"), lines, None)
        return State(_counts(lines[1:-1], model).sum(axis=0) if len(lines) > 2 else np.zeros(len(COUNTS), "i8"), lines[:1], lines[-1:])

    def merge(self, other: State, model: LineModel) -> State:
        counts = self.counts + other.counts
        if self.last is None:
            return State(counts, self.first + other.first, other.last)
        middle = self.last + other.first
        if other.last is None:
            return State(counts, self.first, middle)
        return State(counts + _counts(middle, model)[0], self.first, other.last)

    def finish(self, model: LineModel) -> np.ndarray:
        """Counts with the lines at the edges; the state itself stays as it is."""
        return self.counts + _counts(self.first, model)[0] + (_counts(self.last, model)[0] if self.last is not None else 0)

    def __getstate__(self):
        pack = lambda p: p and (p.sums, p.bits, p.head, p.tail)
        return self.counts, pack(self.first), None if self.last is None else pack(self.last)

    def __setstate__(self, s):
        self.counts, self.first, self.last = s[0], Pieces(*s[1]), None if s[2] is None else Pieces(*s[2])


def merged(states: list[State], model: LineModel) -> State:
    while len(states) > 1:
        states = [a.merge(b, model) for a, b in zip(states[::2], states[1::2])] + states[len(states) // 2 * 2 :]
    return states[0]


def cut(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, str, int, int]]:
    """(number, text with its context, where the chunk begins in it, where it ends) of each chunk; linear in the text."""
    for k, a in enumerate(range(0, len(text), chunk)):
        low, high = max(0, a - MARGIN), min(len(text), a + chunk)
        yield k, text[low : high + MARGIN], a - low, high - low


def _counts_of_texts(model: LineModel):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = np.zeros((len(texts), len(COUNTS)), "i8")
            there = texts.notna().to_numpy()
            where, values = np.flatnonzero(there), texts[there].tolist()
            size, a = 0, 0
            for i, t in enumerate(values):
                size += len(t) + 1
                if size > _SLICE or i == len(values) - 1:  # so many texts at a time
                    lines, doc = lines_of_texts(values[a : i + 1])
                    begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    out[where[a : i + 1]] = np.add.reduceat(_counts(lines, model), begins, axis=0)
                    size, a = 0, i + 1
            yield pd.DataFrame({k: pd.Series(np.where(there, out[:, j], 0), dtype="Int64").where(there) for j, k in enumerate(COUNTS)})

    return run


def _cut_batches(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b.doc, b.text):
                for k, piece, a, z in cut(text, chunk):
                    yield pd.DataFrame({"doc": [doc], "chunk": [k], "piece": [piece], "a": [a], "z": [z]})

    return run


def _states_of_chunks(model: LineModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for b in batches:
            yield pd.DataFrame({"doc": b.doc, "chunk": b.chunk, "state": [pickle.dumps(State.of(t, model, a, z)) for t, a, z in zip(b.piece, b.a, b.z)]})

    return run


def _merge_states(model: LineModel):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        import pickle

        part = part.sort_values("chunk")
        return pd.DataFrame({"doc": part.doc.iloc[:1], "chunk": part["group"].iloc[:1], "state": [pickle.dumps(merged([pickle.loads(s) for s in part.state], model))]})

    return run


def _finish_states(model: LineModel):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for b in batches:
            yield pd.concat([b[["doc"]].reset_index(drop=True), pd.DataFrame([pickle.loads(s).finish(model) for s in b.state], columns=COUNTS)], axis=1)

    return run


_SCHEMA = ", ".join(f"{x} bigint" for x in COUNTS)


def _of_chunks(docs: DataFrame, model: LineModel, chunk: int, fan_in: int, longest: int) -> DataFrame:
    """Counts of the documents (doc, text) longer than a chunk. `longest` bounds the levels of the tree, not what a document may hold."""
    pieces = docs.mapInPandas(_cut_batches(chunk), "doc string, chunk int, piece string, a int, z int")
    states = pieces.repartition("doc", "chunk").mapInPandas(_states_of_chunks(model), "doc string, chunk int, state binary")
    width = longest // chunk + 1
    while width > 1:
        states = states.withColumn("group", F.floor(F.col("chunk") / fan_in).cast("int")).groupBy("doc", "group").applyInPandas(_merge_states(model), "doc string, chunk int, state binary")
        width = -(-width // fan_in)
    return states.mapInPandas(_finish_states(model), "doc string, " + _SCHEMA)


def text_statistics(docs: DataFrame, doc: str, text: str, model: LineModel | None = None, chunk: int = CHUNK, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each row of `docs` (columns: its id, the counts, the ratios and `is_prose`).

    Null and empty texts have null statistics and a null verdict, texts of white space only a null verdict. A text is prose
    unless more than half of its characters that are not white space or tags stand in lines that the model does not take for
    prose. Repeated ids keep their own rows; texts above `chunk` characters are told apart by id and text. A word is a run of
    visible characters, a tag has at most 250 characters, only words of at most 24 letters can be common.
    """
    model = model or LineModel(features_of())
    tag = free_name(docs.columns, "_doc")
    rows = docs.select(F.col(f"`{doc}`").alias("id"), F.nullif(F.col(f"`{text}`"), F.lit("")).alias("t"))
    short = rows.where(F.col("t").isNull() | (F.length("t") <= chunk))
    long = rows.where(F.length("t") > chunk).withColumn(tag, F.concat_ws(":", F.col("id").cast("string"), F.md5("t")))
    a = short.select("id", F.pandas_udf(_counts_of_texts(model), _SCHEMA)(F.col("t")).alias("c")).select("id", "c.*")
    longest = long.agg(F.max(F.length("t"))).first()[0]
    if longest:
        b = _of_chunks(long.dropDuplicates([tag]).select(F.col(tag).alias("doc"), F.col("t").alias("text")), model, chunk, fan_in, longest)
        a = a.unionByName(long.select("id", tag).join(b.withColumnRenamed("doc", tag), tag).drop(tag))
    return _ratios(a).withColumnRenamed("id", doc)


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.nullif(F.col(b), F.lit(0))


def _ratios(c: DataFrame) -> DataFrame:
    return c.select(
        "*", _share("word_chars", "words").alias("mean_word_length"), ((F.col("solid_chars") - F.col("letters") - F.col("digits")) / F.nullif(F.col("solid_chars"), F.lit(0))).alias("symbol_ratio"),
        _share("stopped_lines", "lines").alias("stopped_line_share"), _share("common_words", "words").alias("common_word_share"), _share("prose_chars", "solid_chars").alias("prose_share"),
        F.when(F.col("solid_chars") > 0, F.col("other_chars") * 2 <= F.col("solid_chars")).alias("is_prose"),
    )


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, is_prose) of the labelled documents."""
    return documents.select("doc_id", "text").join(labels.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).select("doc_id", "is_prose"), "doc_id")


def found_not_prose(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """p8_found. The model of lines is fitted on labelled documents."""
    model = fit_line_model(labelled_documents(documents, labels), "doc_id", "text", "is_prose")
    return text_statistics(documents, "doc_id", "text", model).where(~F.col("is_prose")).select("doc_id").distinct()
