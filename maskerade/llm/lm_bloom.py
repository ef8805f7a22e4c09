"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to levels, level j standing for counts from ``BASE ** (j - 1)``. The
filter holds (n-gram, 1), ..., (n-gram, its level); a count is read back by asking for level 1, 2, ... until one is
missing, and stands for the mean of its level. It holds every word and word pair that occurs, however large the corpus,
in parts by n-gram hash. Pairs of at least the share ``HELD`` of all tokens and words of at least ``FREQUENT`` are a
filter of their own that is broadcast (at most 2 / share of them, as shares are rounded to levels); all others are asked of their part by shuffle. These
shares say what travels how, not what is known. Behind each filter stand short hashes of what it holds, so that an
n-gram that it lacks isn't taken for one that it has.

The score is the log10 probability of the text under a model whose masses are 1:

    P(w) = (q(w) + 1) / (sum of q + V + 1), and 1 / (sum of q + V + 1) for the class of all words never met
    P(w | u) = (q(u w) + PRIOR P(w)) / (S(u) + PRIOR), S(u) the sum of q(u w) over the words after u

with q as the filters read it, also in the sums. An unknown pair or context backs off to P(w) by its whole mass.

Beside it stands the exact unigram base, from the broadcast words and from the exact counts that the rarer words meet
in their parts.

Counts are over the whole texts of all documents learnt from: tasks count what they hold, parts sum up. Parts are by
the hash of a pair's first word, so that a context's sum is at hand, but pairs of words that would make a part hot are
spread by their own hash and their sums added up. There is a part for each ``PART`` bytes of text. Words are told apart
by 64-bit hashes, pairs by their part and 40 bits.

Defined results: null and empty text is its end token alone; a null doc_id counts as an empty one; repeated rows
count and are scored each; with nothing to learn from, N and V are 0, every count is 0 and a token's probability 1;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

HELD, FREQUENT, BASE, PRIOR = 1e-7, 2.5e-7, 2, 4.0
#: N-grams of fewer than BASE ** LEAST occurrences are never broadcast.
LEAST = 3
#: Filter bits for each (n-gram, level), and bits set for one.
BITS, PROBES = 16, 4
#: Tokens that a task counts before it emits, and that it asks for at once.
STRETCH, ASKS = 2_000_000, 500_000
#: Bytes of text for each part, and the share of a part's tokens from which a word's pairs are spread.
PART, HOT = 64_000_000, 0.125

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def train_part() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of texts, an end token after each text, and n + 1 offsets."""
    raw, at = _LOWER[buf[offsets[0] : offsets[-1]]], offsets - offsets[0]
    a, b = textbytes.words(raw, at[:-1])
    ends = np.searchsorted(a, at[1:])
    h = np.insert(textbytes.Hasher(raw)(a, b), ends, END)
    return h, np.concatenate(([0], ends + np.arange(1, len(at))))


def contexts(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each token in its text."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[at[:-1]] = BEGIN
    return before


def pairs(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it."""
    return textbytes.combined([before, h])


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Monotone in the hash."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _route(before: np.ndarray, two: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """The part of each pair."""
    return _bucket(np.where(_among(hot, before)[1], two, before), buckets)


def _among(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted array, and whether it is there."""
    if not len(known):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def low(two: np.ndarray) -> np.ndarray:
    """The 40 bits that tell pairs apart in a part."""
    return two & np.uint64((1 << 40) - 1)


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(raw: pa.Buffer | bytes) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(flat), 8), np.uint8)
    out[:, :5] = flat
    return out.reshape(-1).view("<u8")


#: The mean of the counts of each level, 0 of level 0.
_MEANS = np.append(0.0, (float(BASE) ** np.arange(64) * (1 + BASE) - 1) / 2)


def quantised(level: np.ndarray) -> np.ndarray:
    """The mean of the counts of each level, 0 of level 0."""
    return _MEANS[level]


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value of a sorted array begins, and how often it is there."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(sorted_))


def _small(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in as few bytes as they need; to 65536 of them numpy sorts by digits."""
    return bucket.astype("u1" if buckets <= 1 << 8 else "<u2" if buckets <= 1 << 16 else "<u4")


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket that keeps the order in each, and buckets + 1 edges in it."""
    edges = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
    return np.argsort(_small(bucket, buckets), kind="stable"), edges


def _batch(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        for i, j in textbytes.slabs(offsets):
            yield tokens(buf, offsets[i : j + 1])


COUNTED = "bucket int, h binary, n binary"
WORDS_OF = "bucket int, types long, total long, h binary, n binary, filter binary"
PAIRS_COUNTED = "bucket int, u binary, runs binary, h binary, n binary"
PAIRS_OF = "bucket int, u binary, runs binary, h binary, filter binary"


@textbytes.lean
def _count_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def rows():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        edges = np.searchsorted(_bucket(h, buckets), np.arange(buckets + 1))
        made = [(k, h[edges[k] : edges[k + 1]].tobytes(), n[edges[k] : edges[k + 1]].astype("<u4").tobytes()) for k in np.flatnonzero(np.diff(edges)).tolist()]
        yield _batch(["bucket", "h", "n"], [pa.int32(), pa.binary(), pa.binary()], made)

    for h, _ in _texts(batches):
        held.append(h)
        if sum(map(len, held)) >= STRETCH:
            yield from rows()
    if held:
        yield from rows()


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


@textbytes.lean
def _merge_words(table: pa.Table, bits: int) -> pa.Table:
    """A part's words with their counts and its filter."""
    h, back = np.unique(_joined(table.column("h"), "<u8"), return_inverse=True)
    n = np.bincount(back, weights=_joined(table.column("n"), "<u4"), minlength=len(h)).astype("<i8")
    row = (table.column("bucket")[0].as_py(), len(h), int(n.sum()), h.tobytes(), n.tobytes(), Filter(h, n, 1, bits).dump())
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    return pa.Table.from_batches([_batch(["bucket", "types", "total", "h", "n", "filter"], types, [row])])


@textbytes.lean
def _count_pairs(batches: Iterator[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """By part: contexts, how many pairs each has, the pairs and their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows():
        u, two = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(two)
        first, n = _runs(two[order])
        one = order[first]
        order = np.argsort(u[one])
        one, n = one[order], n[order]
        order, edges = _dealt(_route(u[one], two[one], hot, buckets), buckets)
        u, two, n = u[one[order]], two[one[order]], n[order].astype("<u4")
        made = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[k], edges[k + 1]
            own, runs = _runs(u[lo:hi])
            made.append((k, u[lo:hi][own].tobytes(), runs.astype("<u4").tobytes(), _packed(two[lo:hi]), n[lo:hi].tobytes()))
        yield _batch(["bucket", "u", "runs", "h", "n"], [pa.int32(), *[pa.binary()] * 4], made)

    for h, at in _texts(batches):
        before = contexts(h, at)
        held.append((before, pairs(before, h)))
        if sum(len(u) for u, _ in held) >= STRETCH:
            yield from rows()
    if held:
        yield from rows()


@textbytes.lean
def _merge_pairs(table: pa.Table, bits: int) -> pa.Table:
    """A part's pairs by context and its filter."""
    u = np.repeat(_joined(table.column("u"), "<u8"), _joined(table.column("runs"), "<u4"))
    raw = np.concatenate([_unpacked(x.as_buffer()) for x in table.column("h")])
    order = np.argsort(raw)
    first, _ = _runs(raw[order])
    n = np.add.reduceat(_joined(table.column("n"), "<u4")[order], first, dtype=np.int64)
    one = order[first]
    h, u = raw[one], u[one]
    order = np.argsort(u)
    own, runs = _runs(u[order])
    row = (table.column("bucket")[0].as_py(), u[order[own]].tobytes(), runs.astype("<u4").tobytes(), _packed(h[order]), Filter(h, n, 1, bits).dump())
    return pa.Table.from_batches([_batch(["bucket", "u", "runs", "h", "filter"], [pa.int32(), *[pa.binary()] * 4], [row])])


class Filter:
    """The log-frequency Bloom filter."""

    def __init__(self, h: np.ndarray, n: np.ndarray, least: int = 1, bits: int = BITS):
        """``least``: no count is below it, so that its level is the first."""
        self.least = least
        level = np.floor(np.log(np.maximum(n / least, 1.0)) / math.log(BASE) + 1e-9).astype(np.int64) + 1
        self.bits = max(10, math.ceil(math.log2(max(1, int(level.sum())) * bits)))
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        self.most = int(level.max(initial=0))
        for j in range(1, self.most + 1):
            x = self._mixed(h[level >= j], j)
            for i in range(PROBES):
                byte, bit = self._place(x, i)
                np.bitwise_or.at(self.table, byte, np.left_shift(np.uint8(1), bit))

    def dump(self) -> bytes:
        return np.array([self.least, self.bits, self.most], "<i8").tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, raw: pa.Buffer | bytes) -> Filter:
        out = cls.__new__(cls)
        out.least, out.bits, out.most = np.frombuffer(raw, "<i8", 3).tolist()
        out.table = np.frombuffer(raw, np.uint8, offset=24)
        return out

    def _mixed(self, h: np.ndarray, level: int) -> np.ndarray:
        return textbytes.mixed(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))

    def _place(self, x: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte and bit of a probe."""
        step = (x >> np.uint64(17)) | np.uint64(1)
        place = (x + step * np.uint64(probe * 0xD1B54A32D192ED03 % (1 << 64))) >> np.uint64(64 - self.bits)
        return (place >> np.uint64(3)).view(np.int64), place.astype(np.uint8) & np.uint8(7)

    def _there(self, x: np.ndarray, probe: int) -> np.ndarray:
        byte, bit = self._place(x, probe)
        return (self.table[byte] >> bit) & np.uint8(1) > 0

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The levels of n-grams, 0 for those that it lacks."""
        level = np.zeros(len(h), np.int64)
        live = np.arange(len(h))
        for j in range(1, self.most + 1):
            x = self._mixed(h, j)
            some = np.flatnonzero(self._there(x, 0))
            x = x[some]
            there = self._there(x, 1)
            for i in range(2, PROBES):
                there &= self._there(x, i)
            some = some[there]
            if not len(some):
                break
            live, h = live[some], h[some]
            level[live] = j
        return np.where(level > 0, level + round(math.log(self.least, BASE)), 0)


class Held:
    """A filter, and behind it the short hashes of what it holds."""

    def __init__(self, filter_: Filter, known: np.ndarray):
        self.filter, self.known = filter_, np.sort(known)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels as the filter reads them, 0 for n-grams that aren't held."""
        one, back = np.unique(h, return_inverse=True)
        return self.read(one)[back]

    def read(self, one: np.ndarray) -> np.ndarray:
        """The same where few n-grams are asked for twice."""
        level = self.filter.levels(one)
        some = np.flatnonzero(level)
        level[some] = np.where(_among(self.known, one[some])[1], level[some], 0)
        return level

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Whether levels aren't 0: the filter finds all that it holds, so what is known tells."""
        one, back = np.unique(h, return_inverse=True)
        return _among(self.known, one)[1][back]


class Model:
    """Totals, the filters that are broadcast, the sums of the contexts among their words."""

    def __init__(self, total: int, types: int, words: tuple[np.ndarray, np.ndarray], least: int, rest: float, hot: np.ndarray, buckets: int, bits: int):
        self.total, self.types, self.hot, self.buckets = total, types, hot, buckets
        order = np.argsort(words[0])
        self.words, self.counts = words[0][order], words[1][order]
        self.alone = Held(Filter(self.words, self.counts, least, bits), self.words)
        #: Sum of quantised counts and of one for each word and for the class of unknown ones.
        self.mass = float(quantised(self.alone.read(self.words)).sum()) + rest + types + 1
        self.pairs = Held(Filter(np.zeros(0, np.uint64), np.zeros(0)), np.zeros(0, np.uint64))
        self.after(np.zeros(len(self.words)), 0.0)

    def after(self, sums: np.ndarray, begin: float) -> None:
        """Takes the sums of the pairs after each word and at the beginning, as places among their few values."""
        self.sums, self.begin = sums, begin
        self.values, place = np.unique(np.append(sums, begin), return_inverse=True)
        self.place = place.astype("<u2" if len(self.values) < 1 << 16 else "<u4")

    def placed_sums(self, place: np.ndarray) -> np.ndarray:
        """The sums at places; not a number for the place after the last."""
        return np.append(self.values, np.nan)[place]

    def log(self, both: np.ndarray, alone: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """log10 P of tokens from the levels of pair and word and the sum of the context."""
        return np.log10((quantised(both) + PRIOR * (quantised(alone) + 1) / self.mass) / (sums + PRIOR))

    def log_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.total + self.types + 1.0))


def _part_sums(model: Model, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Contexts of a part and the sums of their pairs there, as pairs are read."""
    h, u = _unpacked(row["h"]), np.frombuffer(row["u"], "<u8")
    level = model.pairs.read(h)
    rare = level == 0
    level[rare] = Filter.load(row["filter"]).levels(h[rare])
    runs = np.frombuffer(row["runs"], "<u4").astype(np.int64)
    return u, np.add.reduceat(quantised(level), np.cumsum(runs) - runs) if len(runs) else np.zeros(0)


def _buffers(batch, i: int, *names: str) -> dict:
    return {n: batch.column(n)[i].as_buffer() for n in names}


def train(docs: DataFrame, bits: int = BITS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, and the pinned parts of all words and of all pairs."""
    spark = docs.sparkSession
    learnt = docs.filter(train_part()).select("text")
    size = learnt.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, common.shuffle_partitions(spark), -(-size // PART))
    words = common.pin(learnt.mapInArrow(lambda it: _count_words(it, buckets), COUNTED).groupBy("bucket").applyInArrow(lambda t: _merge_words(t, bits), WORDS_OF))
    common.release(spark)
    total, types = (int(x or 0) for x in words.agg(F.sum("total"), F.sum("types")).first())
    # powers of the base, so that levels are the same wherever they are read
    power = {k: max(LEAST, math.floor(math.log(max(1.0, share * total), BASE) + 1e-9)) for k, share in (("words", FREQUENT), ("pairs", HELD))}
    least = BASE ** power["words"]

    @textbytes.lean
    def frequent(batches):
        """Frequent words, and the quantised sum of the others."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = _buffers(batch, i, "h", "n", "filter")
                h, n = np.frombuffer(row["h"], "<u8"), np.frombuffer(row["n"], "<i8")
                some = n >= least
                rest = float(quantised(Filter.load(row["filter"]).levels(h[~some])).sum())
                yield _batch(["h", "n", "rest"], [pa.binary(), pa.binary(), pa.float64()], [(h[some].tobytes(), n[some].tobytes(), rest)])

    rows = words.select("h", "n", "filter").mapInArrow(frequent, "h binary, n binary, rest double").collect()  # at most 2 / share words
    found = [np.concatenate([np.frombuffer(r[k], kind) for r in rows] or [np.zeros(0, kind)]) for k, kind in (("h", "<u8"), ("n", "<i8"))]
    hot = np.sort(np.append(found[0][found[1] >= HOT * total / buckets], BEGIN))
    model = Model(total, types, tuple(found), least, math.fsum(r["rest"] for r in rows), hot, buckets, bits)
    two = common.pin(learnt.mapInArrow(lambda it: _count_pairs(it, hot, buckets), PAIRS_COUNTED).groupBy("bucket").applyInArrow(lambda t: _merge_pairs(t, bits), PAIRS_OF))
    common.release(spark)
    floor = power["pairs"] + 1

    @textbytes.lean
    def often(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _buffers(batch, i, "h", "filter")
                h = _unpacked(row["h"])
                level = Filter.load(row["filter"]).levels(h)
                some = level >= floor
                yield _batch(["h", "level"], [pa.binary(), pa.binary()], [(h[some].tobytes(), level[some].astype(np.uint8).tobytes())])

    rows = two.select("h", "filter").mapInArrow(often, "h binary, level binary").collect()  # at most 2 / share pairs
    h, level = (np.concatenate([np.frombuffer(r[k], kind) for r in rows] or [np.zeros(0, kind)]) for k, kind in (("h", "<u8"), ("level", np.uint8)))
    model.pairs = Held(Filter(h, BASE ** (level - 1.0), BASE ** power["pairs"], bits), h)
    shared = spark.sparkContext.broadcast(model)

    @textbytes.lean
    def sums(batches):
        m = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                u, s = _part_sums(m, _buffers(batch, i, "u", "runs", "h", "filter"))
                some = _among(m.words, u)[1] | (u == BEGIN)
                yield pa.RecordBatch.from_pydict({"u": pa.array(u[some].view(np.int64)), "s": pa.array(s[some])})

    known = two.mapInArrow(sums, "u long, s double").groupBy("u").agg(F.sum("s").alias("s")).toPandas()  # a row for each frequent word
    shared.destroy()
    at, there = _among(model.words, known["u"].to_numpy(np.int64).view(np.uint64))
    sums, s = np.zeros(len(model.words)), known["s"].to_numpy(float)
    sums[at[there]] = s[there]
    model.after(sums, float(s[~there].sum()))
    return model, words, two


#: WORDS and TWO are what a stretch of text asks a part for, DOCUMENT is the stretch itself, the others the part.
WORDS, TWO, DOCUMENT, VOCABULARY, PAIRS = range(5)
#: Stands for a level that is asked for.
ASKED = 255
ROUTED = "kind int, bucket int, stretch long, h binary, n binary, u binary, runs binary, filter binary"
ANSWERED = "kind int, bucket int, stretch long, h binary, n binary, s binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
FACTS = np.dtype([("doc", "<i8"), ("tokens", "<i8"), ("known", "<i8"), ("open", "<i8"), ("base", "<f8"), ("score", "<f8"), ("out", "u1"), ("null", "u1")])
_KEYS = [pa.int32(), pa.int32(), pa.int64()]


@textbytes.lean
def _ask(batches: Iterator[pa.RecordBatch], model: Model, documents: bool) -> Iterator[pa.RecordBatch]:
    """Sums what is known here: per stretch its documents with what is open (``documents``), or by part what is asked for it.

    Both are told by the partition's number and what has been read of it: their tables begin with the same scan.
    """
    part, buckets = TaskContext.get().partitionId(), model.buckets
    stretch, size = part << 40, 0
    held: dict[str, list[np.ndarray]] = {}
    names, types = ["kind", "bucket", "stretch", "h", "n", "u", "runs", "filter"], [*_KEYS, *[pa.binary()] * 5]

    def flush():
        got = {k: np.concatenate(v) for k, v in held.items()}
        held.clear()
        where, rows = [], []
        for kind, h, bucket in ((WORDS, got["words"], _bucket(got["words"], buckets)), (TWO, got["two"], _route(got["before"], got["two"], model.hot, buckets))):
            if documents:
                where.append(_small(bucket, buckets).tobytes())
                continue
            order, edges = _dealt(bucket, buckets)
            for k in np.flatnonzero(np.diff(edges)).tolist():
                some = h[order[edges[k] : edges[k + 1]]]
                rows.append((kind, k, stretch, some.tobytes() if kind == WORDS else _packed(some), *[None] * 4))
        if documents:
            streams = [got["alone"].tobytes(), got["both"].tobytes(), got["sums"].tobytes(), *where]
            rows.append((DOCUMENT, part % buckets, stretch, zlib.compress(b"".join(streams), 1), got["facts"].tobytes(), *[None] * 3))
        yield _batch(names, types, rows)

    def facts(at, ids, out, one, back, place, frequent, known, both):
        """What is known of each text, and what is known of the tokens that are open."""
        level = np.full(len(one), ASKED, np.uint8)
        level[frequent] = model.alone.read(one[frequent])
        alone = level[back]
        n = model.counts[place] if len(model.words) else np.zeros(len(one), np.int64)
        own = np.where(frequent, model.place[place], len(model.values)).astype(model.place.dtype)[back]
        sums = np.empty_like(own)
        sums[1:] = own[:-1]
        sums[at[:-1]] = model.place[-1]
        text = np.repeat(np.arange(len(ids)), np.diff(at))
        open_ = ~known | (both == 0) | (sums == len(model.values))
        done = ~open_
        count = lambda w, x: np.bincount(w, weights=x, minlength=len(ids))
        made = np.zeros(len(ids), FACTS)
        made["doc"] = [x if x is not None else 0 for x in ids]
        made["null"] = [x is None for x in ids]
        made["out"] = out
        made["tokens"] = np.diff(at)
        made["known"] = count(text, known)
        made["open"] = count(text, open_)
        made["base"] = count(text, np.where(frequent, model.log_base(n), 0.0)[back])
        made["score"] = count(text[done], model.log(both[done], alone[done], model.values[sums[done]]))
        both = np.where(both > 0, both, ASKED).astype(np.uint8)
        return {"alone": alone[open_], "both": both[open_], "sums": sums[open_], "facts": made}

    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        out = batch.column("held_out").to_numpy(zero_copy_only=False)
        for i, j in textbytes.slabs(offsets):
            h, at = tokens(buf, offsets[i : j + 1])
            one, back = np.unique(h, return_inverse=True)
            place, frequent = _among(model.words, one)
            known = frequent[back]
            before = contexts(h, at)
            two = pairs(before, h)
            if documents:
                both = model.pairs.levels(low(two))
                asked = both == 0
                more = facts(at, ids[i:j], out[i:j], one, back, place, frequent, known, both)
            else:
                asked, more = ~model.pairs.holds(low(two)), {}
            for k, v in {"words": h[~known], "two": two[asked], "before": before[asked], **more}.items():
                held.setdefault(k, []).append(v)
            size += len(h)
            if size >= ASKS:
                yield from flush()
                stretch, size = stretch + 1, 0
    if held:
        yield from flush()


@textbytes.lean
def _answer(table: pa.Table, model: Model) -> pa.Table:
    """What a part knows of the words (levels, counts, sums after them) and pairs (levels) that each stretch asks for."""
    kinds, bucket = table.column("kind").to_numpy(), table.column("bucket")[0].as_py()
    words, counts, sums, levels = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, "<f4"), np.zeros(0, np.int64)
    two = None
    for i in np.flatnonzero(kinds == VOCABULARY).tolist():
        row = _buffers(table, i, "h", "n", "filter")
        words, counts = np.frombuffer(row["h"], "<u8"), np.frombuffer(row["n"], "<i8")
        levels, sums = Filter.load(row["filter"]).levels(words).astype(np.uint8), np.zeros(len(words), "<f4")
    for i in np.flatnonzero(kinds == PAIRS).tolist():
        row = _buffers(table, i, "u", "runs", "h", "filter")
        two = Held(Filter.load(row["filter"]), _unpacked(row["h"]))
        u, s = _part_sums(model, row)
        at, there = _among(words, u)
        sums[at[there]] = s[there]
    rows = []
    stretches = table.column("stretch").fill_null(0).to_numpy()
    for kind, width in ((WORDS, 8), (TWO, 5)):
        mine = np.flatnonzero(kinds == kind).tolist()
        raw = [table.column("h")[i].as_buffer() for i in mine]
        ends = np.cumsum([0, *(x.size // width for x in raw)])
        for i, j in textbytes.slabs(ends, ASKS):  # stretches together, as with many parts each asks for little
            asked = b"".join(raw[i:j])
            if kind == WORDS:
                at, there = _among(words, np.frombuffer(asked, "<u8"))
                pick = lambda x, t: (np.where(there, x[at], 0) if len(words) else np.zeros(len(at))).astype(t)  # noqa: B023, E731
                found = [pick(levels, np.uint8), pick(counts, "<u4"), pick(sums, "<f4")]
            else:
                h = _unpacked(asked)
                found = [(two.levels(h) if two is not None else np.zeros(len(h), np.int64)).astype(np.uint8)]
            for k in range(i, j):
                cells = [x[ends[k] - ends[i] : ends[k + 1] - ends[i]].tobytes() for x in found]
                rows.append((kind, bucket, int(stretches[mine[k]]), *cells, *[None] * (3 - len(cells))))
    return pa.Table.from_batches([_batch(["kind", "bucket", "stretch", "h", "n", "s"], [*_KEYS, *[pa.binary()] * 3], rows)])


@textbytes.lean
def _finish(table: pa.Table, model: Model) -> pa.Table:
    """The rows of a stretch's documents."""
    kinds, buckets = table.column("kind").to_numpy(), table.column("bucket").to_numpy()
    cell = lambda name, i: table.column(name)[i].as_buffer()
    own = int(np.flatnonzero(kinds == DOCUMENT)[0])
    facts = np.frombuffer(cell("n", own), FACTS)
    raw, size = zlib.decompress(cell("h", own)), int(facts["open"].sum())
    alone, both = (np.frombuffer(raw, np.uint8, size, k * size).copy() for k in (0, 1))
    sums = model.placed_sums(np.frombuffer(raw, model.place.dtype, size, 2 * size))
    start = 2 * size + size * model.place.itemsize
    asked = {WORDS: np.flatnonzero(alone == ASKED), TWO: np.flatnonzero(both == ASKED)}
    n, after = np.zeros(len(asked[WORDS]), np.int64), np.zeros(len(asked[WORDS]), "<f4")
    for kind, level in ((WORDS, alone), (TWO, both)):
        where = np.frombuffer(raw, _small(np.zeros(0, np.int64), model.buckets).dtype, len(asked[kind]), start)
        start += where.nbytes
        order = np.argsort(where, kind="stable")
        mine = np.flatnonzero(kinds == kind)
        mine = mine[np.argsort(buckets[mine])].tolist()
        if mine:
            got = lambda name, t: np.concatenate([np.frombuffer(cell(name, i), t) for i in mine])  # noqa: B023, E731
            level[asked[kind][order]] = got("h", np.uint8)
            if kind == WORDS:
                n[order], after[order] = got("n", "<u4"), got("s", "<f4")
    # the word before an open context was asked for, so it is open and just before
    follows = np.zeros(size + 1, "<f4")
    follows[asked[WORDS] + 1] = after
    sums = np.where(np.isnan(sums), follows[:-1], sums)
    text = np.repeat(np.arange(len(facts)), facts["open"])
    rare = text[asked[WORDS]]
    count = lambda w, x: np.bincount(w, weights=x, minlength=len(facts))
    return pa.table(
        {
            "doc_id": pa.array(facts["doc"].copy(), mask=facts["null"] > 0),
            "held_out": pa.array(facts["out"] > 0),
            "n_tokens": pa.array(facts["tokens"].copy()),
            "n_known": pa.array(facts["known"] + count(rare, n > 0).astype(np.int64)),
            "base_score": pa.array(facts["base"] + count(rare, model.log_base(n))),
            "score": pa.array(facts["score"] + count(text, model.log(both, alone, sums))),
        }
    )


def score(docs: DataFrame, model: Model, words: DataFrame, two: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long"), (~train_part()).alias("held_out"), "text")
    asked = texts.mapInArrow(lambda it: _ask(it, shared.value, False), ROUTED)
    # made again rather than sent with what is asked: it would be shuffled twice
    stretches = texts.mapInArrow(lambda it: _ask(it, shared.value, True), ROUTED).select("kind", "bucket", "stretch", "h", "n", F.lit(None).cast("binary").alias("s"))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    known = words.select(F.lit(VOCABULARY).alias("kind"), "bucket", *none("long", "stretch"), "h", "n", *none("binary", "u", "runs"), "filter")
    known = known.unionByName(two.select(F.lit(PAIRS).alias("kind"), "bucket", *none("long", "stretch"), "h", *none("binary", "n"), "u", "runs", "filter"))
    answers = asked.unionByName(known).groupBy("bucket").applyInArrow(lambda t: _answer(t, shared.value), ANSWERED)
    rows = stretches.unionByName(answers).groupBy("stretch").applyInArrow(lambda t: _finish(t, shared.value), SCORED)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    return score(docs, *train(docs, bits))
