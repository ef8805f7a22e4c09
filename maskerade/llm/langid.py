"""Language identification by language-bitmask n-gram filters.

One Bloom filter holds the n-grams of all languages: it is bit-sliced, so that a place of the table is a mask with a
bit for each language, and the masks at an n-gram's ``PROBES`` places, joined by AND, name every language that has
it. A text's n-grams are looked up; each language's hits are counted over the masks and corrected for the share of
hits that the filling of its own bit plane would give by chance. The language with the greatest corrected share wins.

An n-gram is three or four letters in a row, word borders being a blank; letters are lower-cased. A language has an
n-gram if it is there at least ``FLOOR`` of all its n-grams and ``SHARE`` as often as in the language that has it
most. Counts are over whole texts of all learnt documents: tasks count over distinct words and emit distinct n-grams.
The table is sized so that the language with the most n-grams fills at most ``FILL`` of its bit plane; as a language
has at most 1 / ``FLOOR`` n-grams, what is broadcast is bounded however large the input, and grows by a word of 8 bytes
a place for each ``PLANES`` languages.

Defined results: null text and text without a letter is ``und`` with score 0; a text without a known n-gram is the
most common language with score 0; with nothing to learn from all is ``und``; documents without lang are not learnt
from, any other value of it is a language; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

PROBES, FILL = 3, 0.1
FLOOR, SHARE = 1e-7, 0.2
#: Languages of a mask.
PLANES = 63


@cache
def _letters() -> np.ndarray:
    """The lower-case letter of each code point; a blank for what is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and blanks of texts, each text between two blanks, and where each begins (n + 1)."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[at]
    n = len(at) - 1
    out = np.full(len(points) + n + 1, 32, np.uint64)
    where = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(starts))
    out[where] = _letters()[points]
    return out, starts + np.arange(n + 1)


def _grams(p: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For three and four letters: where n-grams begin, and their hashes."""
    out, letter = [], p != 32
    for n in (3, 4):
        k = len(p) - n + 1
        if k <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.uint64)))
            continue
        inner = letter[1 : k + 1].copy()
        for j in range(2, n - 1):
            inner &= letter[j : k + j]
        a = np.flatnonzero(inner)
        h = p[a]
        for j in range(1, n):
            h = (h << np.uint64(16)) + h * np.uint64(5) + p[a + j]
        out.append((a, textbytes.mixed(h + np.uint64(n))))
    return out


def table_bits(most: int) -> int:
    """The binary logarithm of the places that ``most`` n-grams fill to ``FILL`` at most."""
    return max(10, math.ceil(math.log2(max(1, most) * PROBES / -math.log1p(-FILL))))


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of n-grams in a table of 2 ** bits."""
    step = textbytes.mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return [((h + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(PROBES)]


@textbytes.lean
def _count(batches, languages: list[str]):
    """Distinct n-grams of each language in a partition, with their counts."""
    number = {name: i for i, name in enumerate(languages)}
    words: list[dict[bytes, int]] = [{} for _ in languages]

    def rows():
        for lang, found in enumerate(words):
            keys = list(found)
            for lo in range(0, len(keys), 200_000):
                part = keys[lo : lo + 200_000]
                raw = np.frombuffer(b"".join(part), np.uint8)
                at = np.concatenate(([0], np.cumsum([len(w) for w in part])))
                p, starts = _points(raw, at)
                times = np.array([found[w] for w in part], np.int64)
                grams = _grams(p)
                h = np.concatenate([g[1] for g in grams])
                t = np.concatenate([times[np.clip(np.searchsorted(starts, g[0] + 1, "right") - 1, 0, len(part) - 1)] for g in grams])
                new, back = np.unique(h, return_inverse=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": pa.array(new.view(np.int64)),
                        "lang": pa.array(np.full(len(new), lang, np.int32)),
                        "n": pa.array(np.bincount(back, weights=t, minlength=len(new)).astype(np.int64)),
                    }
                )
            found.clear()

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        for i, j in textbytes.slabs(offsets):
            raw, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            a, b = textbytes.words(raw, at[:-1])
            if not len(a):
                continue
            which = np.array([number[x] for x in langs[i:j]], np.uint64)
            text = np.searchsorted(at, a, "right") - 1
            key = textbytes.combined([textbytes.Hasher(raw)(a, b), which[text]])
            _, one, times = np.unique(key, return_index=True, return_counts=True)
            for s, e, t, n in zip(a[one].tolist(), b[one].tolist(), which[text[one]].tolist(), times.tolist(), strict=True):
                w = raw[s:e].tobytes()
                words[t][w] = words[t].get(w, 0) + n
        if sum(map(len, words)) > 400_000:
            yield from rows()
    yield from rows()


@textbytes.lean
def _slots(batches, bits: int):
    for batch in batches:
        h = batch.column("h").to_numpy().view(np.uint64)
        for place in _places(h, bits):
            yield pa.RecordBatch.from_pydict({"place": pa.array(place), "word": batch.column("word"), "mask": batch.column("mask")})


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, common_language: int):
        self.languages, self.table, self.common = languages, table, common_language
        self.bits = table.shape[1].bit_length() - 1
        self.planes = np.array([((table[i // PLANES] >> np.uint64(i % PLANES)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.chance = self.planes**PROBES

    def shares(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts: whether they have a letter; of each, by language, the corrected share of n-grams in it."""
        p, starts = _points(raw, at)
        letters = np.concatenate(([0], np.cumsum(p != 32)))
        some = letters[starts[1:]] > letters[starts[:-1]]
        hits, total = np.zeros((len(at) - 1, len(self.languages))), np.zeros(len(at) - 1)
        for a, h in _grams(p):
            if not len(a):
                continue
            edges = np.searchsorted(a, starts - 0)
            total += np.diff(edges)
            places = _places(h, self.bits)
            for word in range(len(self.table)):
                mask = self.table[word][places[0]]
                for place in places[1:]:
                    mask &= self.table[word][place]
                for i in range(word * PLANES, min((word + 1) * PLANES, len(self.languages))):
                    seen = np.concatenate(([0], np.cumsum((mask >> np.uint64(i % PLANES)) & np.uint64(1))))
                    hits[:, i] += seen[edges[1:]] - seen[edges[:-1]]
        share = hits / np.maximum(total, 1)[:, None]
        return some, np.maximum(0.0, (share - self.chance) / (1 - self.chance))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame) -> Model | None:
    """Learns from the text and lang of all documents that aren't held out."""
    learnt = docs.filter(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull()).select("lang", "text")
    rows = learnt.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row a language
    if not rows:
        return None
    languages = sorted(r["lang"] for r in rows)
    counts = learnt.mapInArrow(lambda it: _count(it, languages), "h long, lang int, n long").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    counts = common.pin(counts)
    totals = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    rates = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    most = rates.groupBy("h").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate")).alias("all"))
    held = most.select("h", "most", F.explode("all").alias("x")).filter((F.col("x.rate") >= FLOOR) & (F.col("x.rate") >= SHARE * F.col("most")))
    held = common.pin(held.select("h", "x"))
    bits = table_bits(held.groupBy("x.lang").count().agg(F.max("count")).first()[0] or 0)
    bit = F.expr(f"shiftleft(1L, x.lang % {PLANES})")
    masks = held.groupBy("h", F.expr(f"cast(x.lang div {PLANES} as int)").alias("word")).agg(F.bit_or(bit).alias("mask"))
    slots = masks.mapInArrow(lambda it: _slots(it, bits), "place long, word int, mask long").groupBy("place", "word").agg(F.bit_or("mask").alias("mask"))
    slots = slots.toPandas()  # at most 2 ** bits places a word of languages
    table = np.zeros((-(-len(languages) // PLANES), 1 << bits), np.uint64)
    table[slots["word"].to_numpy(), slots["place"].to_numpy()] = slots["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return Model(languages, table, languages.index(rows[0]["lang"]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @textbytes.lean
    def run(batches):
        m = shared.value
        for batch in batches:
            buf, offsets, null = textbytes.raw_text(batch.column("text"))
            for i, j in textbytes.slabs(offsets):
                names, scores = ["und"] * (j - i), np.zeros(j - i)
                if m is not None:
                    some, share = m.shares(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best, total = share.argmax(axis=1), share.sum(axis=1)
                    best = np.where(total > 0, best, m.common)
                    scores = np.where(some & (total > 0), share.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                    names = [m.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(i, j - i),
                        "held_out": batch.column("held_out").slice(i, j - i),
                        "lang_pred": pa.array(names, pa.string()),
                        "score": pa.array(scores),
                    }
                )

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
