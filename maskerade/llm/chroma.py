"""Chroma audio fingerprints, and a search for recordings that hold the same sound.

Samples become frames, frames spectra, spectra the energy of the twelve pitch classes, smoothed over time and scaled
to unit length. Over that image of 12 rows, ``FILTERS`` compare two areas each, summed from its integral image; the
comparison is quantised to two bits, and a frame's sixteen pairs of bits are one 32-bit integer.

Recordings of the same sound share integers at one offset. The first ``BITS`` bits of an integer are its key. Blocks of
queries meet blocks of recordings, and in a pair of blocks all hits of keys, with each single bit flipped, vote for
offsets: where at least ``VOTES`` meet, the bits of the two fingerprints at that offset are compared; an overlap of at
least ``OVERLAP`` frames with a share of wrong bits of at most ``ERRORS`` is a match. One vote is enough, as matches may
be short and noisy: of those of the driver's vectors, three votes of 24 bits had a third or less. No key is too common: hits of silence, or
of a sound that many recordings hold, all count, in portions of ``HOT``. Hits never leave the task that makes them, so
nothing gathers by key; how many there are grows with queries times recordings.

Recordings with the same samples are one, with as many copies, so that copies are never compared with each other.

The driver's tables have no audio; ``melody`` renders a vector as one, a note for each of its numbers.

Defined results: null and empty samples, and ones too short for a frame, have no integers and match nothing; silence
is an even spectrum; null samples inside a recording are 0; repeated rows are copies; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, FRAME, HOP = 8000, 1024, 512
SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
LOWEST, HIGHEST = 100.0, 2000.0
#: Kind of comparison, first pitch class, pitch classes, frames. See ``_areas``.
FILTERS = (
    ("level", 0, 3, 12), ("level", 3, 3, 12), ("level", 6, 3, 12), ("level", 9, 3, 12),
    ("pitch", 0, 4, 8), ("pitch", 4, 4, 8), ("pitch", 8, 4, 8), ("pitch", 2, 8, 4),
    ("time", 0, 4, 8), ("time", 4, 4, 8), ("time", 8, 4, 8), ("time", 0, 12, 12),
    ("cross", 0, 6, 8), ("cross", 6, 6, 8), ("cross", 3, 6, 12), ("middle", 0, 12, 12),
)
WIDTH = 12
#: Bounds of the four values of a comparison, a logarithm of a ratio.
BOUNDS = (-0.12, 0.0, 0.12)
BITS, VOTES, OVERLAP, ERRORS = 20, 1, 16, 0.2
_NEW = np.where(np.arange(OVERLAP) >= np.arange(OVERLAP + 1)[:, None], np.uint32(0xFFFFFFFF), np.uint32(0))
_LANES = np.uint64(0x00FF00FF00FF00FF)
_CHANGES = np.array([0, *(1 << k for k in range(BITS))], np.uint32)
#: Integers in a block, hits that are counted at once, and blocks of queries that are broadcast.
FRAMES, HOT, BROADCAST = 1 << 17, 1 << 20, 64
_GRAY = np.array([0, 1, 3, 2], np.uint32)


@cache
def _pitch_classes() -> np.ndarray:
    """Which spectrum lines count for which pitch class."""
    lines = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(lines), 12))
    for i, f in enumerate(lines):
        if LOWEST <= f <= HIGHEST:
            out[i, int(round(12 * np.log2(f / 440.0))) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    """Pitch-class frames (n, 12), each of length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < len(SMOOTH):
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    energy = (np.abs(np.fft.rfft(frames)) ** 2) @ _pitch_classes()
    k = len(SMOOTH)
    smooth = sum(w * energy[i : len(energy) - k + 1 + i] for i, w in enumerate(SMOOTH))
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-9, smooth / np.maximum(norm, 1e-9), 1 / np.sqrt(12))


def _areas(kind: str, y: int, h: int, w: int) -> list[tuple[int, int, int, int, int]]:
    """Areas (sign, y0, y1, x0, x1) of a filter."""
    if kind == "level":  # an area against the rest of its frames
        return [(1, y, y + h, 0, w), (-1, 0, y, 0, w), (-1, y + h, 12, 0, w)]
    if kind == "pitch":  # lower against upper half
        return [(1, y, y + h // 2, 0, w), (-1, y + h // 2, y + h, 0, w)]
    if kind == "time":  # earlier against later half
        return [(1, y, y + h, 0, w // 2), (-1, y, y + h, w // 2, w)]
    if kind == "cross":  # one diagonal of quarters against the other
        return [(1, y, y + h // 2, 0, w // 2), (1, y + h // 2, y + h, w // 2, w), (-1, y + h // 2, y + h, 0, w // 2), (-1, y, y + h // 2, w // 2, w)]
    third = w // 3  # middle against both sides
    return [(1, y, y + h, third, w - third), (-1, y, y + h, 0, third), (-1, y, y + h, w - third, w)]


def packed(image: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place of the filters on the image."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)
    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        sums = {1: np.zeros(n), -1: np.zeros(n)}
        size = {1: 0, -1: 0}
        for sign, y0, y1, x0, x1 in _areas(kind, y, h, w):
            sums[sign] += integral[at + x1, y1] - integral[at + x0, y1] - integral[at + x1, y0] + integral[at + x0, y0]
            size[sign] += (y1 - y0) * (x1 - x0)
        value = np.log((1e-3 + np.maximum(sums[1], 0) / size[1]) / (1e-3 + np.maximum(sums[-1], 0) / size[-1]))
        out = (out << np.uint32(2)) | _GRAY[np.searchsorted(BOUNDS, value)]
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    return packed(chroma(samples))


def melody(vector: np.ndarray) -> np.ndarray:
    """A note of ``HOP`` samples for each number: 48 semitones around 440 Hz for values from -0.5 to 0.5."""
    v = np.nan_to_num(np.asarray(vector, np.float64))
    if not len(v):
        return np.zeros(0)
    tone = 440.0 * 2.0 ** (np.clip(np.rint(v * 48), -18, 18) / 12)
    phase = np.cumsum(np.repeat(tone, HOP)) * (2 * np.pi / RATE)
    return np.sin(phase)


def _prints(batches: Iterator[pa.RecordBatch], render: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            made = [fingerprint(render(np.array([x if x is not None else 0.0 for x in v.as_py()] if v.is_valid else [], np.float64))) for v in part.column("samples")]
            yield pa.RecordBatch.from_pydict({"sound": part.column("sound"), "print": pa.array([m.astype("<u4").tobytes() for m in made], pa.binary())})


def fingerprints(recordings: DataFrame, render: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> tuple[DataFrame, DataFrame]:
    """From (id, samples): (id, sound), and for each distinct sound (sound, first, copies, print). Both pinned.

    ``render`` turns a row's samples into those that are heard. Samples are the same if they are number by number.
    """
    numbers = F.transform("samples", lambda x: F.coalesce(x, F.lit(0)).cast("string"))
    keyed = recordings.select(F.col("id").cast("long").alias("id"), "samples", F.sha2(F.coalesce(F.concat_ws(",", numbers), F.lit("")), 256).alias("same"))
    groups = keyed.groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.any_value("samples").alias("samples"))
    sounds = common.pin(groups.withColumn("sound", F.monotonically_increasing_id()))
    members = common.pin(keyed.select("id", "same").join(common.small(sounds.select("same", "sound")), "same").select("id", "sound"))
    # a row is much work and few bytes: its partitions aren't to be coalesced by size
    prints = sounds.select("sound", "samples").repartition(4 * common.shuffle_partitions(recordings.sparkSession), "sound").mapInArrow(lambda it: _prints(it, render), "sound long, print binary")
    return members, common.pin(sounds.drop("samples", "same").join(prints, "sound"))


PACKED = "sounds array<long>, sizes array<int>, prints binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints side by side, a row for about ``FRAMES`` integers; those too short for an overlap match nothing."""

    def row(sounds: list[int], prints: list[bytes]) -> pa.RecordBatch:
        sizes = [len(p) // 4 for p in prints]
        return pa.RecordBatch.from_pydict({"sounds": pa.array([sounds], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "prints": pa.array([b"".join(prints)], pa.binary())})

    sounds, prints, held = [], [], 0
    for batch in batches:
        for sound, raw in zip(batch.column("sound").to_pylist(), batch.column("print").to_pylist(), strict=True):
            if len(raw or b"") < 4 * OVERLAP:
                continue
            if held and held + len(raw) // 4 > FRAMES:
                yield row(sounds, prints)
                sounds, prints, held = [], [], 0
            sounds.append(sound)
            prints.append(raw)
            held += len(raw) // 4
    if sounds:
        yield row(sounds, prints)


class _Prints:
    """Fingerprints side by side: the integers, where each begins and ends, and of each integer whose it is."""

    def __init__(self, sounds: pa.ListScalar, sizes: pa.ListScalar, prints: pa.BinaryScalar):
        self.sounds, self.sizes = sounds.values.to_numpy(), sizes.values.to_numpy().astype(np.int64)
        self.bits = np.frombuffer(prints.as_buffer(), "<u4")
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.keys = self.bits >> np.uint32(32 - BITS)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one behind the other."""
    out = np.arange(int(count.sum()), dtype=np.int64)
    return out + np.repeat(first - (np.cumsum(count) - count), count)


def _slices(weights: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts what has these weights into runs of at most ``most``, or of one."""
    upto, a = np.cumsum(weights), 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells with at least ``VOTES`` votes, and their votes."""
    cells = np.sort(cells)
    begins = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1]))) if len(cells) else np.zeros(0, np.int64)
    votes = np.diff(np.append(begins, len(cells)))
    enough = votes >= VOTES
    return cells[begins[enough]], votes[enough]


def _histograms(asked: _Prints, prints: _Prints, q0: int, q1: int, s0: int, s1: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Query, sound, offset and votes of the offsets at which these queries and these sounds share ``VOTES`` keys.

    Every hit of every key counts. Where there are more than ``most`` at once, queries or sounds are halved; the
    histogram of one query and one sound is an array that hits are added to.
    """
    f0, p0 = int(asked.starts[q0]), int(prints.starts[s0])
    mine, theirs = asked.keys[f0 : asked.ends[q1 - 1]], prints.keys[p0 : prints.ends[s1 - 1]]
    at, place = np.argsort(mine, kind="stable"), np.argsort(theirs, kind="stable")
    a, a_first, a_count = np.unique(mine[at], return_index=True, return_counts=True)
    b, b_first, b_count = np.unique(theirs[place], return_index=True, return_counts=True)
    # the side with fewer keys is looked up in the other, each key with and without each single bit flipped
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    probes = few[:, None] ^ _CHANGES
    found = np.minimum(np.searchsorted(many, probes), len(many) - 1)
    i, j = np.nonzero(many[found] == probes)
    i, j = (i, found[i, j]) if few is a else (found[i, j], i)
    count = a_count[i] * b_count[j]
    hits = int(count.sum())
    if hits > most and (q1 - q0 > 1 or s1 - s0 > 1):
        if q1 - q0 > 1:
            middle = (q0 + q1) // 2
            halves = ((q0, middle, s0, s1), (middle, q1, s0, s1))
        else:
            middle = (s0 + s1) // 2
            halves = ((q0, q1, s0, middle), (q0, q1, middle, s1))
        for half in halves:
            yield from _histograms(asked, prints, *half, most)
        return
    # an offset's cell: a row for each query, in it a stretch for each sound, long enough for all offsets
    longest = int(asked.sizes[q0:q1].max())
    width = len(theirs) + (s1 - s0) * longest

    def cells(pair: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Of the ``k``-th hits of these pairs of keys."""
        frame, where = at[a_first[i[pair]] + k // b_count[j[pair]]], place[b_first[j[pair]] + k % b_count[j[pair]]]
        q, s = asked.of[f0 + frame], prints.of[p0 + where]
        return (q - q0) * width + where + (s - s0) * longest + (longest - 1) - (frame + f0 - asked.starts[q])

    if hits > most:
        votes, upto = np.zeros(width, np.int64), np.cumsum(count)
        for low in range(0, hits, most):
            hit = np.arange(low, min(hits, low + most))
            pair = np.searchsorted(upto, hit, "right")
            np.add.at(votes, cells(pair, hit - (upto[pair] - count[pair])), 1)
        cell = np.flatnonzero(votes >= VOTES)
        votes = votes[cell]
    else:
        cell, votes = _counted(cells(np.repeat(np.arange(len(count)), count), _ranges(np.zeros(len(count), np.int64), count)))
    begins = prints.starts[s0:s1] - p0 + np.arange(s1 - s0) * longest
    q, rest = cell // width, cell % width
    s = np.searchsorted(begins, rest, "right") - 1
    yield q + q0, s + s0, rest - begins[s] - (longest - 1), votes


def _ones(windows: np.ndarray) -> np.ndarray:
    """Bits that are set in each row of integers: counts of bytes, summed as 16-bit lanes of one number."""
    counts = np.bitwise_count(windows).view(np.uint64)
    lanes = ((counts & _LANES) + ((counts >> np.uint64(8)) & _LANES)).sum(axis=1, dtype=np.uint64)
    return ((lanes * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


def _wrong(x: np.ndarray, y: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Wrong bits of stretches of at least ``OVERLAP`` integers, by windows of that many; what has too many for a match already isn't read on."""
    x, y = (np.lib.stride_tricks.sliding_window_view(b, OVERLAP) for b in (x, y))
    wrong, most, done = np.zeros(len(frames), np.int64), ERRORS * 32 * frames, 0
    left = np.arange(len(frames))
    while len(left):
        begin = np.minimum(done, frames[left] - OVERLAP)
        different = x[at_x[left] + begin] ^ y[at_y[left] + begin]
        if done:  # the last window begins with integers that the one before it had
            different &= _NEW[done - begin]
        wrong[left] += _ones(different)
        done += OVERLAP
        left = left[(wrong[left] <= most[left]) & (frames[left] > done)]
    return wrong


def _compared(asked: _Prints, prints: _Prints, q: np.ndarray, s: np.ndarray, offset: np.ndarray, votes: np.ndarray, most: int) -> list[np.ndarray]:
    """Of the matches among these offsets query, sound, offset, votes, frames and errors, the best of each pair."""
    a, b = np.maximum(0, -offset), np.minimum(asked.sizes[q], prints.sizes[s] - offset)
    long = b - a >= OVERLAP
    q, s, offset, votes, a, frames = q[long], s[long], offset[long], votes[long], a[long], (b - a)[long]
    wrong = np.zeros(len(q), np.int64)
    for i, j in _slices(np.full(len(q), OVERLAP), 4 * most):
        wrong[i:j] = _wrong(asked.bits, prints.bits, (asked.starts[q] + a)[i:j], (prints.starts[s] + a + offset)[i:j], frames[i:j])
    errors = wrong / (32 * frames)
    good = np.flatnonzero((errors <= ERRORS) & (asked.sounds[q] != prints.sounds[s]))
    good = good[np.lexsort((offset[good], -votes[good], errors[good], s[good], q[good]))]
    new = np.ones(len(good), bool)
    new[1:] = (q[good[1:]] != q[good[:-1]]) | (s[good[1:]] != s[good[:-1]])
    good = good[new]
    return [asked.sounds[q[good]], prints.sounds[s[good]], offset[good], votes[good], frames[good], errors[good]]


MATCHES = "query long, sound long, offset int, votes long, frames int, errors double"


def _matched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Matches of blocks of queries in blocks of sounds."""
    names, types = zip(*(f.split() for f in MATCHES.split(", ")), strict=True)
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[t] for t in types]
    for batch in batches:
        for k in range(batch.num_rows):
            asked, prints = (_Prints(*(batch.column(mark + c)[k] for c in ("sounds", "sizes", "prints"))) for mark in ("_", ""))
            for some in _histograms(asked, prints, 0, len(asked.sizes), 0, len(prints.sizes), most):
                best = _compared(asked, prints, *some, most)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(best, types, strict=True)], names=list(names))


def search(queries: DataFrame, sounds: DataFrame) -> DataFrame:
    """Matches (query, sound, offset, votes, frames, errors) of the queries (sound, print) among all sounds, the best offset of each. Pinned.

    An offset is the recording's place at the query's 0. Blocks of queries meet all blocks of sounds.
    """
    most = HOT
    frames = queries.agg(F.sum(F.octet_length("print"))).first()[0] or 0
    blocks = lambda df, parts: df.select("sound", "print").repartition(parts).mapInArrow(_packed, PACKED)
    asked = common.pin(blocks(queries, 4 + frames // (4 * FRAMES)).withColumnsRenamed({c: f"_{c}" for c in ("sounds", "sizes", "prints")}))
    met = blocks(sounds, 2 * common.shuffle_partitions(sounds.sparkSession)).crossJoin(common.small(asked, rows=BROADCAST))
    return common.pin(met.mapInArrow(lambda it: _matched(it, most), MATCHES))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [p.as_py() or b"" for p in batch.column("print")]
        yield pa.RecordBatch.from_pydict({"sound": batch.column("sound"), "n_frames": pa.array([len(p) // 4 for p in prints], pa.int64()), "print_crc32": pa.array([zlib.crc32(p) for p in prints], pa.int64())})


def search_digest(recordings: DataFrame, every: int = 50, render: Callable[[np.ndarray], np.ndarray] = melody) -> DataFrame:
    """A row for each recording: its sound's first id, frames, and for ids divisible by ``every`` what was found.

    ``n_matches`` counts all other recordings with the same sound or a matching one; ``best_match`` is the first id of
    the best other sound, with its offset and share of wrong bits.
    """
    members, sounds = fingerprints(recordings, render)
    asked = members.filter(F.pmod("id", F.lit(every)) == 0).select("sound").distinct()
    found = search(sounds.join(asked, "sound", "left_semi"), sounds).join(sounds.select("sound", "first", "copies"), "sound")
    best = F.struct("errors", (-F.col("votes")).alias("votes"), "first", "offset")
    each = common.pin(found.groupBy("query").agg(F.sum("copies").alias("others"), F.min(best).alias("best")))
    facts = sounds.select("sound", "first", "copies").join(sounds.select("sound", "print").mapInArrow(_crc, "sound long, n_frames long, print_crc32 long"), "sound")
    facts = facts.join(each.withColumnRenamed("query", "sound"), "sound", "left")
    query = F.coalesce(F.pmod("id", F.lit(every)) == 0, F.lit(False))
    return members.join(facts, "sound").select(
        "id",
        F.col("first").alias("sound_id"),
        "n_frames",
        "print_crc32",
        query.alias("is_query"),
        F.when(query, F.when(F.col("n_frames") > 0, F.col("copies") - 1).otherwise(0) + F.coalesce("others", F.lit(0))).cast("long").alias("n_matches"),
        F.when(query, F.col("best.first")).alias("best_match"),
        F.when(query, F.col("best.offset")).alias("best_offset"),
        F.when(query, F.col("best.errors")).alias("best_errors"),
    )
