"""Vector best-fit packing of tokenised documents into sequences.

A document becomes token ids and an end id; only one longer than a sequence is cut, its first piece taking what
doesn't fill a whole one. A piece is a vector (tokens, 1 document, tokens^2 of attention cost) and a sequence has a
capacity for each. Pieces, longest first, go to the open sequence that they fit best under every constraint: by the
least weighted norm of what would be left (``norm``), or by the greatest weighted dot product of piece and residual
(``dot``).

The contract's sequences are as few as can be of ``tokens``, so that the other two capacities are by default the
loosest that a full sequence can need; give ``capacity`` smaller ones and they bind (pieces are then cut to fit alone).

A piece's vector depends on its length alone, so best fit is run on the histogram of lengths: at most ``tokens``
classes however many documents there are, with sequences of equal content kept as one entry and a count. The plan
says for each class which of its ranks go where, and documents meet it by rank. Nothing that grows with the
documents reaches the driver, and no packing is lost at the borders of partitions.

Tokenising splits whole batches in numpy by the tokenizer's own pattern and looks words up in a table, so that byte
pair merging runs once for each new word of a task. Special tokens of the tokenizer's file that a text spells out are
their own ids, as the tokenizer has it when it isn't told to add any; ``special=False`` reads them as plain text.

Ranks within a length are counted by partition of the pinned pieces, so neither a frequent length nor a repeated or
null doc_id gathers in a task. Defined results: null and empty text is the end id alone; repeated rows and rows with a
null doc_id are packed each; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common, textbytes

TOKENIZER = "byte_bpe_50k.json"
END = 0
#: Of a sequence: tokens, documents, sum of squared lengths.
CAPACITY = (2048, 2048, 2048 * 2048)
WEIGHTS = (1.0, 0.05, 0.05)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, of each code point."""
    kinds = np.full(sys.maxunicode + 1, 3, np.uint8)
    first = {"L": 1, "N": 2}
    for i in range(sys.maxunicode + 1):
        kinds[i] = first.get(unicodedata.category(chr(i))[0], 3)
    kinds[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return kinds


def split(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pattern of byte-level BPE begins a word, over texts that begin at ``starts`` (code points).

    The pattern: 's 't 're 've 'm 'll 'd; an optional space and letters, numbers or others; white space, which
    leaves its last character to what follows.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    space, blank = kind == 0, points == 0x20
    edge = np.zeros(n + 1, bool)
    edge[starts[starts < n]] = True
    edge[n] = True
    begins = np.empty(n, bool)
    begins[0] = True
    begins[1:] = kind[1:] != kind[:-1]
    after = np.zeros(n, bool)  # what follows a blank in its text belongs to the blank
    after[1:] = blank[:-1] & ~space[1:]
    begins &= ~after
    last = np.zeros(n, bool)  # white space before another character of its text
    last[:-1] = space[:-1] & ~space[1:]
    begins |= last & ~edge[1:]
    begins |= edge[:-1]
    for i in np.flatnonzero((points == 0x27) & begins):
        tail = points[i + 1 : i + 3].tolist()
        stop = next((k for k in (1, 2) if edge[i + k]), 3) if i + 2 <= n else 1
        if stop > 1 and chr(tail[0]) in "stmd":
            k = 2
        elif stop > 2 and len(tail) == 2 and chr(tail[0]) + chr(tail[1]) in ("re", "ve", "ll"):
            k = 3
        else:
            continue
        begins[i + 1 : i + k] = False
        if i + k < n:
            begins[i + k] = True
    return np.flatnonzero(begins)


@lru_cache(2)
def _merger(path: str):
    """Ids of one word's bytes, and of the special tokens, for a byte-level BPE file of the tokenizers library."""
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    model = file["model"]
    letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
    ranks = {bytes(of[c] for c in word): i for word, i in model["vocab"].items() if all(c in of for c in word)}
    order = {w: len(of) + i for i, w in enumerate("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])}
    plain = all(ranks[bytes(of[c] for c in w)] == i for w, i in order.items())
    if not plain or len(order) + len(of) < len(ranks) - 1:
        raise ValueError("not a vocabulary whose ids follow its merges")
    ranks = {w: i for w, i in ranks.items() if i < len(of) + len(order)}
    if any(t[k] for t in file.get("added_tokens", ()) for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("special tokens that take blanks along aren't known here")
    special = {t["content"].encode(): t["id"] for t in file.get("added_tokens", ())}
    encode = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda word: encode(word.decode("utf-8", "surrogatepass")), special


class Tokens:
    """Token ids of whole batches. Words met lately are in a table of ``2 ** bits`` places."""

    def __init__(self, path: str, special: bool = True, bits: int = 19, most: int = 300_000):
        self._merge, named = _merger(path)
        self._special = named if special else {}
        self._named = re.compile(b"|".join(re.escape(x) for x in sorted(self._special, key=len, reverse=True))) if self._special else None
        self._shift, self._most = np.uint64(64 - bits), most
        self._hash, self._word = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self._clear()

    def _clear(self) -> None:
        self._hash[:] = 0
        self._known: dict[int, int] = {}
        self._at, self._n, self._ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self._ids[0], self._n[0], self._words, self._used = END, 1, 1, 1  # word 0 is the end id

    def _add(self, word: bytes) -> int:
        ids = [self._special[word]] if word in self._special else self._merge(word)
        if self._words == len(self._at):
            self._at, self._n = np.resize(self._at, 2 * self._words), np.resize(self._n, 2 * self._words)
        if self._used + len(ids) > len(self._ids):
            self._ids = np.resize(self._ids, 2 * (self._used + len(ids)))
        self._at[self._words], self._n[self._words] = self._used, len(ids)
        self._ids[self._used : self._used + len(ids)] = ids
        self._words, self._used = self._words + 1, self._used + len(ids)
        return self._words - 1

    def _spelt(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Begin and end of the special tokens that texts spell out."""
        whole = raw.tobytes()
        if self._named is None or not self._named.search(whole):
            return np.zeros((0, 2), np.int64)
        at = at.tolist()
        found = [m.span() for i, j in zip(at, at[1:], strict=False) for m in self._named.finditer(whole, i, j)]
        return np.array(found, np.int64).reshape(-1, 2)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and where each text's begin."""
        if self._words > self._most:
            self._clear()
        base, texts = offsets[0], len(offsets) - 1
        raw = buf[base : offsets[-1]]
        points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        starts = np.searchsorted(lead, offsets[:-1] - base)
        inner = self._spelt(raw, offsets - base)
        if len(inner):  # what is before and after a special token is split on its own
            starts = np.union1d(starts, np.searchsorted(lead, inner.ravel()))
        a = lead[split(points, starts)] if len(points) else np.zeros(0, np.int64)
        if len(inner):
            k = np.searchsorted(inner[:, 0], a, "right") - 1
            a = a[(k < 0) | (a == inner[k, 0]) | (a >= inner[k, 1])]
        b = np.append(a[1:], len(raw)) if len(a) else a
        h = textbytes.Hasher(raw)(a, b) | np.uint64(1)
        slot = (h >> self._shift).astype(np.int64)
        word = np.where(self._hash[slot] == h, self._word[slot], -1)
        missing = np.flatnonzero(word < 0)
        if len(missing):
            new, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            found = np.empty(len(new), np.int32)
            for i, (key, k) in enumerate(zip(new.tolist(), missing[at].tolist(), strict=True)):
                w = self._known.get(key)
                if w is None:
                    w = self._known[key] = self._add(raw[a[k] : b[k]].tobytes())
                found[i] = w
            word[missing] = found[back]
            s = (new >> self._shift).astype(np.int64)
            self._hash[s], self._word[s] = new, found
        ends = np.searchsorted(a, offsets[1:] - base)  # the end id comes after a text's words
        word = np.insert(word, ends, 0)
        n = self._n[word].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self._ids[np.repeat(self._at[word] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[np.concatenate(([0], ends + np.arange(1, texts + 1)))]


@textbytes.lean
def _cut(batches: Iterator[pa.RecordBatch], path: str, tokens: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = Tokens(path)
    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        for i, j in textbytes.slabs(offsets):
            ids, at = encode(buf, offsets[i : j + 1])
            ids = ids.astype("<u4")
            n = np.diff(at)
            pieces = -(-n // tokens)
            row = np.repeat(np.arange(j - i), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = n - (pieces - 1) * tokens
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * tokens)
            length = np.where(piece == 0, first[row], tokens)
            lo = (at[row] + start).tolist()
            parts = [ids[x:y] for x, y in zip(lo, (at[row] + start + length).tolist(), strict=True)]
            columns = {
                "doc_id": batch.column("doc_id").slice(i, j - i).take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p.data) for p in parts], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)


def tokenised(docs: DataFrame, path: str | None = None, tokens: int = CAPACITY[0], with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, and ids if asked for."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _cut(it, path, tokens, with_ids), schema)


def best_fit(histogram: dict[int, int], capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """The plan: rows (length, lo, hi, sequence, each, offset).

    Of the pieces of a length, those of rank lo to hi - 1 go to sequences from ``sequence`` on, ``each`` to one, side
    by side from ``offset`` on.
    """
    cap, w = np.array(capacity, np.float64), np.array(weights)
    left = np.zeros((1024, 3))  # of each kind of sequence
    count: list[int] = []
    made: list[tuple[int, int, int]] = []  # what it came from, length and how many of it were added
    many = np.zeros(1024, np.int64)

    def new(origin: int, length: int, each: int, residual: np.ndarray, n: int) -> None:
        nonlocal left, many
        k = len(made)
        if k == len(many):
            left, many = np.concatenate((left, np.zeros_like(left))), np.concatenate((many, np.zeros_like(many)))
        made.append((origin, length, each))
        left[k], many[k] = residual - each * np.array([length, 1, length * length], np.float64), n

    for length in sorted(histogram, reverse=True):
        todo, item = histogram[length], np.array([length, 1, length * length], np.float64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity {capacity}")
        while todo:
            k = len(made)
            fits = np.flatnonzero((many[:k] > 0) & (left[:k] >= item).all(axis=1))
            if len(fits):
                if rule == "dot":
                    best = fits[np.argmax((w * left[fits] / cap * item / cap).sum(axis=1))]
                else:
                    best = fits[np.argmin((w * ((left[fits] - item) / cap) ** 2).sum(axis=1))]
                room, there = left[best].copy(), int(many[best])
            else:
                best, room, there = -1, cap, todo
            each = int((room // item).min())
            use = min(there, todo // each)
            if not use:
                each, use = todo, 1
            if best >= 0:
                many[best] -= use
            new(int(best), length, each, room, use)
            todo -= use * each
    plan, sequence, rank = [], 0, dict.fromkeys(histogram, 0)
    for k in range(len(made)):
        if not many[k]:
            continue
        n, at, chain = int(many[k]), k, []
        while at >= 0:
            chain.append(made[at])
            at = made[at][0]
        offset = 0
        for _, length, each in reversed(chain):
            plan.append((length, rank[length], rank[length] + n * each, sequence, each, offset))
            rank[length] += n * each
            offset += length * each
        sequence += n
    return plan


@textbytes.lean
def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Adds sequence and place to pieces, by their length and rank in it."""
    key = plan[:, 0] << 44 | plan[:, 1]
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        row = plan[np.searchsorted(key, length << 44 | rank, "right") - 1]
        nth = rank - row[:, 1]
        names = [n for n in batch.schema.names if n != "_rank"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)],
            names=[*names, "sequence_id", "offset"],
        )


def pack(pieces: DataFrame, capacity: tuple[int, int, int] = CAPACITY, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pinned pieces."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # a row for each possible length at most
    plan = np.array(sorted(best_fit(histogram, capacity, weights, rule)), np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(plan)  # grows with the kinds of sequences, not with the pieces
    keyed = pieces.select("*", F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().alias("_h"))
    rows = common.ranked(keyed, ["length"], "_b", [F.col("_h")], "_rank").drop("_b", "_h")
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return rows.mapInArrow(lambda it: _place(it, shared.value), schema)


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, capacity: tuple[int, int, int] = CAPACITY, **options) -> DataFrame:
    """Pieces of all documents in sequences. Pieces are cut so that each fits alone."""
    most = min(capacity[0], math.isqrt(capacity[2]))
    return pack(common.pin(tokenised(docs, path, most, with_ids)), capacity, **options)
