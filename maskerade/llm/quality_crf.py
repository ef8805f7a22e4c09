"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a document as content or boilerplate from what can be
seen of it (symbols, capitals, repetition, punctuation, length, place) and from the marks around it; Viterbi
decoding finds the best marks of all lines together. A document is kept if content lines hold at least
``MIN_CONTENT`` of its words, unless it fails the plain rules: fewer than ``MIN_WORDS`` words, or more than
``MAX_REPEAT`` per cent of its words in three-word windows that the text has twice or more.

The field is fitted by gradient ascent on its likelihood, over at most ``TRAIN_DOCS`` labelled documents (those whose
doc_id has the least hashes) and a stretch of at most ``TRAIN_LINES`` lines of each, from a place drawn by hash. Labels
are of documents, so lines get weak ones of their own: a field without steps is fitted to the documents' labels, and
says of each line whether it looks like lines of good documents (``weak_labels``). Clean lines of bad documents and
junk in good ones then teach the steps between marks. Without labelled documents of both kinds the field has the fixed
weights of ``PRIOR``. Marking reads whole texts of all documents, a batch at a time, without a shuffle.

Defined results: null and empty text has no words and fails the plain rules; lines without a word are not marked and
count for nothing; repeated rows are marked each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes

MIN_WORDS, MAX_REPEAT, MIN_CONTENT = 50, 50, 0.5
TRAIN_DOCS, TRAIN_LINES = 2000, 200

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True

#: Each feature with the bounds of its bins: bin i holds values from bound i - 1 to below bound i.
BINS = {
    "symbols a word": (0.01, 0.2, 0.6),
    "bars a word": (0.01, 0.3),
    "capitals of letters": (0.15, 0.5),
    "repeated words": (0.01, 0.3, 0.6),
    "times in the text": (1.5, 2.5),
    "words": (2, 4, 8, 21),
    "characters a word": (3, 9, 15),
    "digits of characters": (0.01, 0.3),
    "exclamations a word": (0.01, 0.5),
    "ends a sentence": (0.5,),
    "first": (0.5,),
    "last": (0.5,),
}
WIDTH = sum(len(b) + 1 for b in BINS.values())


def _prior() -> dict:
    w = np.zeros(WIDTH)
    at = 0
    for name, bounds in BINS.items():
        sign = -1.5 if name in ("symbols a word", "bars a word", "capitals of letters", "repeated words", "exclamations a word") else 0.0
        w[at : at + len(bounds) + 1] = [sign * (i if i < len(bounds) else len(bounds) + 1) + 0.5 for i in range(len(bounds) + 1)]
        at += len(bounds) + 1
    return {"emit": w, "step": np.array([[0.5, -0.5], [-0.5, 0.5]])}


#: Weights without labelled documents.
PRIOR = _prior()


def _sums(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[b] - c[a]


class Seen:
    """What a slab of texts shows: per text the plain counts, per line (with a word) its features."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        raw, at = buf[offsets[0] : offsets[-1]], offsets - offsets[0]
        texts = len(at) - 1
        a, b = textbytes.words(raw, at[:-1])
        h = textbytes.Hasher(raw)
        lead = (raw & 0xC0) != 0x80
        inside = ~textbytes.SEPARATOR[raw]
        first = np.searchsorted(a, at)  # of each text's words
        self.n_words = np.diff(first)
        self.word_chars = _sums(lead & inside, at[:-1], at[1:])
        symbol = _SYMBOL[raw]
        self.n_symbols = _sums(symbol, at[:-1], at[1:])
        text = np.repeat(np.arange(texts), self.n_words)
        # words in windows of three that the text has again
        wh = h(a, b)
        covered = np.zeros(len(a), bool)
        if len(a) > 2:
            whole = np.flatnonzero(text[2:] == text[:-2])
            key = textbytes.combined([wh[whole], wh[whole + 1], wh[whole + 2], text[whole].astype(np.uint64)])
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            again = whole[times[back] > 1]
            for k in range(3):
                covered[again + k] = True
        self.n_repeat_words = np.add.reduceat(np.append(covered, False), np.minimum(first[:-1], len(a)), dtype=np.int64) * (self.n_words > 0) if texts else np.zeros(0, np.int64)
        # lines
        starts = np.union1d(at[:-1][np.diff(at) > 0], np.flatnonzero(raw[:-1] == 10) + 1) if len(raw) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        ends = ends - ((ends > 0) & (raw[ends - 1] == 10)) if len(starts) else ends
        ends = np.maximum(ends, starts)
        w0, w1 = np.searchsorted(a, starts), np.searchsorted(a, ends)
        some = w1 > w0
        starts, ends, w0, w1 = starts[some], ends[some], w0[some], w1[some]
        self.line_text = np.searchsorted(at, starts, "right") - 1
        self.line_start, self.line_end, self.line_words = starts - at[self.line_text], ends - at[self.line_text], w1 - w0
        key = textbytes.combined([h(starts, ends), self.line_text.astype(np.uint64)])
        _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        later = np.ones(len(starts), bool)
        later[one] = False
        self.n_dup_lines = np.bincount(self.line_text[later], minlength=texts)
        count = lambda flags: _sums(flags, starts, ends)
        words = np.maximum(self.line_words, 1)
        upper, lower = count(_UPPER[raw]), count(_LOWER[raw])
        chars = count(lead & inside)
        new = np.ones(len(starts), bool)
        new[1:] = self.line_text[1:] != self.line_text[:-1]
        values = {
            "symbols a word": count(symbol) / words,
            "bars a word": count(raw == 124) / words,
            "capitals of letters": upper / np.maximum(upper + lower, 1),
            "repeated words": _sums(covered, w0, w1) / words,
            "times in the text": times[back],
            "words": self.line_words,
            "characters a word": chars / words,
            "digits of characters": count(_DIGIT[raw]) / np.maximum(chars, 1),
            "exclamations a word": count(raw == 33) / words,
            "ends a sentence": _END[raw[b[w1 - 1] - 1]] if len(starts) else np.zeros(0),
            "first": new,
            "last": np.append(new[1:], True) if len(new) else new,
        }
        bins, base = [], 0
        for name, bounds in BINS.items():
            bins.append(np.searchsorted(bounds, values[name], "right") + base)
            base += len(bounds) + 1
        self.features = np.stack(bins, axis=1).astype(np.uint8) if len(starts) else np.zeros((0, len(BINS)), np.uint8)
        self.failed = (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT * self.n_words)


def _chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each text that has lines, longest first."""
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if len(text) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(text)))
    order = np.argsort(-n, kind="stable")
    return first[order], n[order]


def viterbi(emit: np.ndarray, step: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The best marks (1 content) of all lines; ``emit`` is each line's score for content over boilerplate."""
    first, n = _chains(text)
    mark = np.zeros(len(emit), np.int8)
    if not len(first):
        return mark
    came = np.zeros((len(emit), 2), np.int8)
    best = np.zeros((len(first), 2))
    best[:, 1] = emit[first]
    active = np.searchsorted(-n, -np.arange(n[0]), "left")  # texts with more than t lines
    for t in range(1, n[0]):
        k = active[t]
        ways = best[:k, :, None] + step
        row = first[:k] + t
        came[row] = ways.argmax(axis=1)
        best[:k] = ways.max(axis=1)
        best[:k, 1] += emit[row]
    last = best.argmax(axis=1).astype(np.int8)
    for t in range(n[0] - 1, -1, -1):
        k = active[t]
        row = first[:k] + t
        mark[row] = last[:k]
        last[:k] = came[row, last[:k]]
    return mark


def fit(features: np.ndarray, text: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> dict:
    """Weights of the field from lines in order, their texts and their labels: the greatest mean log likelihood of a line, less decay / 2 of their squares.

    ``weight``, one for all lines of a text, is how much these count.
    """
    weight = np.ones(len(text)) if weight is None else weight
    first, n = _chains(text)
    emit_w, step_w = np.zeros(WIDTH), np.zeros((2, 2))
    one = np.zeros((len(features), WIDTH))
    np.put_along_axis(one, features.astype(np.int64), 1.0, axis=1)
    pairs = text[1:] == text[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][pairs], label[1:][pairs]), weight[1:][pairs])
    goal = one.T @ (label * weight)
    active = np.searchsorted(-n, -np.arange(n[0]), "left")
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for i in range(1, rounds + 1):
        emit = np.stack((np.zeros(len(features)), one @ emit_w), axis=1)
        fore, back = emit.copy(), np.zeros_like(emit)
        for t in range(1, n[0]):
            row = first[: active[t]] + t
            fore[row] += np.logaddexp.reduce(fore[row - 1][:, :, None] + step_w, axis=1)
        for t in range(n[0] - 1, 0, -1):
            row = first[: active[t]] + t
            back[row - 1] = np.logaddexp.reduce(step_w + (emit[row] + back[row])[:, None, :], axis=2)
        total = np.logaddexp.reduce(fore + back, axis=1)
        p = np.exp(fore[:, 1] + back[:, 1] - total)
        q = np.flatnonzero(pairs)
        both = np.exp(fore[q][:, :, None] + step_w + (emit[q + 1] + back[q + 1])[:, None, :] - total[q][:, None, None])
        both = (both * weight[q][:, None, None]).sum(axis=0)
        g = np.concatenate((goal - one.T @ (p * weight), (seen - both).ravel())) / len(features) - decay * np.concatenate((emit_w, step_w.ravel()))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
        emit_w, step_w = emit_w + move[:WIDTH], step_w + move[WIDTH:].reshape(2, 2)
    return {"emit": emit_w, "step": step_w}


def weak_labels(features: np.ndarray, label: np.ndarray) -> np.ndarray:
    """A label for each line from labels that hold for whole documents: what lines like it mostly have, each kind of document counting half."""
    even = 0.5 / np.bincount(label, minlength=2).clip(1) * len(label)
    return (fit(features, np.arange(len(features)), label, even[label])["emit"][features].sum(axis=1) > 0).astype(np.int64)


@textbytes.lean
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        quality = batch.column("quality").to_pylist()
        for i, j in textbytes.slabs(offsets):
            seen = Seen(buf, offsets[i : j + 1])
            rows = []
            for k in range(j - i):
                lines = seen.features[seen.line_text == k]
                lo = zlib.crc32(lines.tobytes()) % max(1, len(lines) - TRAIN_LINES + 1)
                rows.append((int(quality[i + k]), lines[lo : lo + TRAIN_LINES].tobytes()))
            yield pa.RecordBatch.from_pydict({"quality": pa.array([r[0] for r in rows], pa.int32()), "lines": pa.array([r[1] for r in rows], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> dict:
    """The field fitted to at most ``limit`` labelled documents."""
    chosen = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    rows = texts.mapInArrow(_sample, "quality int, lines binary").toPandas()
    lines = [np.frombuffer(x, np.uint8).reshape(-1, len(BINS)) for x in rows["lines"]]
    n = np.array([len(x) for x in lines], np.int64)
    if not n.sum() or len({q for q, k in zip(rows["quality"], n, strict=True) if k}) < 2:
        return PRIOR
    # rows come in any order: sort them, so that sums of floats and so weights agree between runs
    order = sorted(range(len(lines)), key=lambda i: (rows["quality"][i], lines[i].tobytes()))
    text = np.repeat(np.arange(len(lines)), n[order])
    features, label = np.concatenate([lines[i] for i in order]), np.repeat(rows["quality"].to_numpy(np.int64)[order], n[order])
    return fit(features, text, weak_labels(features, label))


def _judged(seen: Seen, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of lines; words in content lines and the verdict of texts."""
    mark = viterbi(model["emit"][seen.features].sum(axis=1), model["step"], seen.line_text)
    content = np.bincount(seen.line_text, weights=mark * seen.line_words, minlength=len(seen.n_words)).astype(np.int64)
    return mark, content, ~seen.failed & (content >= MIN_CONTENT * seen.n_words)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Counts and verdict of every document."""

    @textbytes.lean
    def run(batches):
        for batch in batches:
            buf, offsets, _ = textbytes.raw_text(batch.column("text"))
            for i, j in textbytes.slabs(offsets):
                seen = Seen(buf, offsets[i : j + 1])
                _, content, kept = _judged(seen, model)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(i, j - i)}
                    | {k: pa.array(getattr(seen, k).astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                    | {"base_failed": pa.array(seen.failed), "kept": pa.array(kept), "n_content_words": pa.array(content)}
                )

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_content_words long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def label_lines(docs: DataFrame, model: dict) -> DataFrame:
    """Every line with a word: its document, bytes [start, end) and mark."""

    @textbytes.lean
    def run(batches):
        for batch in batches:
            buf, offsets, _ = textbytes.raw_text(batch.column("text"))
            for i, j in textbytes.slabs(offsets):
                seen = Seen(buf, offsets[i : j + 1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(seen.line_text)),
                        "start": pa.array(seen.line_start),
                        "end": pa.array(seen.line_end),
                        "content": pa.array(_judged(seen, model)[0].astype(bool)),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, end long, content boolean")


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The documents that are kept, with all their columns."""

    @textbytes.lean
    def run(batches):
        for batch in batches:
            buf, offsets, _ = textbytes.raw_text(batch.column("text"))
            kept = [_judged(Seen(buf, offsets[i : j + 1]), model)[2] for i, j in textbytes.slabs(offsets)]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)
