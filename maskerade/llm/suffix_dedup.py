"""Removal of repeated passages by a distributed, sparse suffix array.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller
doc_id, or earlier in the same one. Strings don't cross documents and are judged on the input.

Every string has a token: the stretch of ``GRAM`` bytes in it whose hash is least (the leftmost of equals). Equal
strings have equal tokens at equal places, so only suffixes that start at tokens need sorting, one in about 35. A
suffix stands for a run of strings with that token, and carries the hash of the bytes that they cover.

1. Splitters, sampled from a bounded number of documents, range-partition suffixes by leading bytes, token hash,
   hash of what is covered, and document: equal suffixes are neighbours, and ever so many of them can be cut into
   several buckets. A bucket sorts its suffixes by multikey quicksort. All but the first of equal ones are repeats,
   and so are all strings they stand for.
2. A token that has suffixes covering different bytes, or that meets a bucket's edge, may still have equal strings
   in part of them. A string has ``SIDE`` bytes left or right of its token, so a suffix carries a hash of the token
   with either side, and one that shares neither with another class of its token needs no look. The first suffix of each class is compared across classes and bucket boundaries: by token, and
   string by string, on the bytes themselves. Tokens with more than ``HOT`` classes, and those at an edge, which may
   have classes in several buckets, are dealt by string instead.
3. Documents gather their repeated stretches; those without any never move.

Defined results: null and empty text has no bytes and is kept as it is; a text shorter than ``LENGTH`` has no string;
rows that share a doc_id or lack one are ordered by their texts; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textbytes

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
#: Documents from which splitters are taken; suffixes of a bucket; classes of a token that are compared in one task.
SAMPLE, BUCKET, HOT = 1000, 1_000_000, 1024
#: Longer documents are worked on in parts of this many bytes.
PART = 1 << 20
_PLACE = 24

_SECOND = textbytes.byte_values(2)


def multikey_quicksort(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by several keys: sorts by the first, then only runs of equals by the next, and so on.

    Also says of each place in that order whether all keys are as in the place before.
    """
    order = np.argsort(columns[0], kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = columns[0][order][1:] == columns[0][order][:-1]
    for c in columns[1:]:
        if not same.any():
            break
        tied = same.copy()
        tied[:-1] |= same[1:]
        at = np.flatnonzero(tied)
        run = np.cumsum(~same)[at]
        order[at] = order[at][np.lexsort((c[order[at]], run))]
        same[1:] &= c[order][1:] == c[order][:-1]
    return order, same


def suffixes(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Suffixes at tokens: text, token's place, first string's and last string's place (in ``raw``), and keys."""
    n = len(raw)
    valid = np.zeros(n, bool)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        valid[lo : max(lo, hi - LENGTH + 1)] = True
    none = np.zeros(0, np.int64)
    if not valid.any():
        return {"text": none, "token": none, "first": none, "last": none, "lead": none.astype(np.uint64), "cover": none.astype(np.uint64), "sides": none}
    hashes = textbytes.Hasher(raw).raw_windows(GRAM)
    least = (hashes & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    where = np.flatnonzero(valid)
    token = (least[where] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.ones(len(where), bool)
    new[1:] = (token[1:] != token[:-1]) | (where[1:] != where[:-1] + 1)
    first = where[new]
    last = where[np.append(np.flatnonzero(new)[1:] - 1, len(where) - 1)]
    token = token[new]
    lead = np.zeros(len(token), np.uint64)
    for k in range(5):
        lead = (lead << np.uint64(8)) | raw[token + k]
    second = textbytes.Hasher(raw, _SECOND)
    cover = second(first, last + LENGTH)
    sides = np.zeros(len(token), np.uint64)
    left, right = np.flatnonzero(token - first >= SIDE), np.flatnonzero(last + LENGTH - token - GRAM >= SIDE)  # 0: no string reaches so far
    sides[left] |= (second(token[left] - SIDE, token[left] + GRAM) >> np.uint64(32)) | np.uint64(1)
    sides[right] |= ((second(token[right], token[right] + GRAM + SIDE) >> np.uint64(32)) | np.uint64(1)) << np.uint64(32)
    return {
        "text": np.searchsorted(at, first, "right") - 1,
        "token": token,
        "first": first,
        "last": last,
        "lead": (lead << np.uint64(24)) | (hashes[token] >> np.uint64(40)),
        "cover": textbytes.mixed(cover + (token - first).astype(np.uint64)),
        "sides": sides.view(np.int64),
    }


def _parts(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Bytes, offsets, first row and the first byte's place in that row's text."""
    for i, j in textbytes.slabs(offsets):
        for lo in range(int(offsets[i]), max(int(offsets[j]), int(offsets[i]) + 1), PART if j == i + 1 else 1 << 62):
            hi = min(int(offsets[j]), lo + PART + LENGTH - 1) if j == i + 1 else int(offsets[j])
            at = offsets[i : j + 1] - lo if j > i + 1 else np.array([0, hi - lo])
            yield buf[lo:hi], at, i, lo - int(offsets[i])


def _packed(token: np.ndarray, before: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (token << 14) | (before << 7) | more


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and last string."""
    first = (x >> 14) - ((x >> 7) & 127)
    return first, first + (x & 127)


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    buf, offsets, _ = textbytes.raw_text(batch.column("text"))
    dids = batch.column("did").to_numpy()
    for raw, at, row, base in _parts(buf, offsets):
        s = suffixes(raw, at)
        place = s["token"] - at[s["text"]] + base
        yield {"lead": s["lead"], "cover": s["cover"], "did": dids[row + s["text"]], "packed": _packed(place, s["token"] - s["first"], s["last"] - s["first"]), "sides": s["sides"]}


_KEYS = ("lead", "cover", "did", "packed", "sides")


@textbytes.lean
def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in _rows(batch):
            yield pa.RecordBatch.from_pydict({k: pa.array(r[k].view(np.int64)) for k in _KEYS[:3]})


def _bucket_of(r: dict[str, np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters (lead, cover, did) aren't above a row."""
    lead, cover, did = (splitters[:, k] for k in range(3))
    lead, cover = lead.view(np.uint64), cover.view(np.uint64)
    lo, hi = np.searchsorted(lead, r["lead"], "left"), np.searchsorted(lead, r["lead"], "right")
    bucket = lo.copy()
    for k in np.flatnonzero(hi > lo).tolist():  # rows that share their lead with a splitter
        key = (int(r["cover"][k]), int(r["did"][k]))
        a, b = int(lo[k]), int(hi[k])
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if (int(cover[m]), int(did[m])) <= key else (a, m)
        bucket[k] = a
    return bucket


@textbytes.lean
def _deal(batches: Iterator[pa.RecordBatch], splitters: np.ndarray, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Suffixes in packed columns, a row for each stretch of text and bucket."""
    held: list[dict[str, np.ndarray]] = []

    def flush():
        r = {k: np.concatenate([x[k] for x in held]) for k in _KEYS}
        held.clear()
        bucket = _bucket_of(r, splitters)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(len(splitters) + 2))
        some = np.flatnonzero(np.diff(edges)).tolist()
        columns = {k: [r[k][order[edges[b] : edges[b + 1]]].tobytes() for b in some] for k in _KEYS}
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    for batch in batches:
        for r in _rows(batch):
            held.append(r)
            if sum(len(x["did"]) for x in held) >= most:
                yield from flush()
    if held:
        yield from flush()


#: Kinds of what a bucket finds: a repeated stretch, a class to compare by token or by string.
REPEAT, CLASS, STRING = 0, 1, 2
FOUND = "kind int, did long, a long, b long"


@textbytes.lean
def _sort_bucket(table: pa.Table) -> pa.Table:
    """Repeated stretches (a to b of did), and the first suffix of classes (a: token, b: packed) to compare further."""
    r = {k: np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(k)]) for k in _KEYS}
    lead, cover = r["lead"].view(np.uint64), r["cover"].view(np.uint64)
    order, _ = multikey_quicksort([lead, cover, r["did"], r["packed"] >> 14])
    lead, cover = lead[order], cover[order]
    new_lead, new = np.ones(len(order), bool), np.ones(len(order), bool)
    new_lead[1:] = lead[1:] != lead[:-1]
    new[1:] = new_lead[1:] | (cover[1:] != cover[:-1])
    token = np.cumsum(new_lead) - 1
    alike = np.zeros(len(order), bool)
    sides = r["sides"].view(np.uint64)[order]
    first_of = np.flatnonzero(new)
    for side in (sides[first_of] >> np.uint64(32), sides[first_of] & np.uint64(0xFFFFFFFF)):
        some = first_of[side > 0]
        _, back, times = np.unique(textbytes.mixed((token[some].astype(np.uint64) << np.uint64(32)) | side[side > 0]), return_inverse=True, return_counts=True)
        alike[some] |= times[back] > 1
    alike |= new & ((token == 0) | (token == token[-1]))  # an edge's token may have classes elsewhere
    classes = np.bincount(token, weights=alike)
    kind = np.where(classes > HOT, STRING, CLASS)
    kind[[0, -1]] = STRING
    kind = kind[token]
    more = alike
    did, packed = r["did"][order], r["packed"][order]
    first, last = _unpacked(packed[~new])
    columns = [
        np.concatenate((np.full(len(first), REPEAT), kind[more])).astype(np.int32),
        np.concatenate((did[~new], did[more])),
        np.concatenate((first, lead[more].view(np.int64))),
        np.concatenate((last + LENGTH, packed[more])),
    ]
    return pa.table([pa.array(c) for c in columns], names=["kind", "did", "a", "b"])


STRINGS = "kind int, key long, did long, place long, bytes binary"


@textbytes.lean
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that suffixes cover; a hot token's strings each, repeats within the batch decided at once."""
    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        lists = batch.column("suffixes")
        flat = lists.flatten()
        text = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        key, packed, hot = (np.asarray(flat.field(k)) for k in ("key", "packed", "hot"))
        did = batch.column("did").to_numpy()[text]
        first, last = _unpacked(packed)
        lo = offsets[text] + first
        hi = offsets[text] + last + LENGTH
        whole = np.flatnonzero(~hot)
        for s in range(0, len(whole), 20_000):
            k = whole[s : s + 20_000]
            parts = [buf[a:b].tobytes() for a, b in zip(lo[k].tolist(), hi[k].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(k), CLASS, np.int32)), "key": pa.array(key[k]), "did": pa.array(did[k]), "place": pa.array(first[k]), "bytes": pa.array(parts, pa.binary())})
        single = np.flatnonzero(hot)
        for s in range(0, len(single), 5_000):
            k = single[s : s + 5_000]
            n = last[k] - first[k] + 1
            row = np.repeat(k, n)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = lo[row] + shift
            _, order, repeat = _strings(buf, start, did[row], first[row] + shift)
            kind = np.empty(len(row), np.int32)
            kind[order] = np.where(repeat, REPEAT, CLASS)
            h = _hash_strings(buf, start)
            parts = [buf[a : a + LENGTH].tobytes() if c == CLASS else b"" for a, c in zip(start.tolist(), kind.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kind), "key": pa.array(h.view(np.int64)), "did": pa.array(did[row]), "place": pa.array(first[row] + shift), "bytes": pa.array(parts, pa.binary())})


def _hash_strings(buf: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of the string at each start."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lo, stop = int(start.min()), int(start.max()) + LENGTH
    if stop - lo > 2 * LENGTH * len(start):  # far apart: hash copies of them
        buf, lo, stop, start = buf[start[:, None] + np.arange(LENGTH)].ravel(), 0, LENGTH * len(start), np.arange(len(start)) * LENGTH
    return textbytes.Hasher(buf[lo:stop], _SECOND)(start - lo, start - lo + LENGTH)


def _strings(buf: np.ndarray, start: np.ndarray, did: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts strings (by hash, then document and place); says which equal an earlier one, byte by byte."""
    h = _hash_strings(buf, start)
    order, _ = multikey_quicksort([h, did, place])
    s, h = start[order], h[order]
    repeat = np.zeros(len(s), bool)
    repeat[1:] = h[1:] == h[:-1]
    at = np.flatnonzero(repeat)
    span = np.arange(LENGTH)
    for k in range(0, len(at), 20_000):
        i = at[k : k + 20_000]
        if (buf[s[i][:, None] + span] != buf[s[i - 1][:, None] + span]).any():
            raise ArithmeticError("two different strings share a 64-bit hash")
    return h, order, repeat


@textbytes.lean
def _compare(table: pa.Table) -> pa.Table:
    """Repeated stretches among the strings of a bucket's suffixes."""
    kind, key = table.column("kind").to_numpy(), table.column("key").to_numpy()
    did, place = table.column("did").to_numpy(), table.column("place").to_numpy()
    dids, places = [did[kind == REPEAT]], [place[kind == REPEAT]]
    rows = np.flatnonzero(kind == CLASS)
    rows = rows[np.argsort(key[rows], kind="stable")]
    buf, offsets, _ = textbytes.raw_text(table.column("bytes").take(pa.array(rows)))  # bytes of a token lie together
    key, did, place = key[rows], did[rows], place[rows]
    n = np.diff(offsets) - LENGTH + 1
    # tokens are worked on a stretch of whole ones at a time
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(rows) else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(n)))
    cuts, k = [0], 0
    while len(edge) and k < len(rows):
        later = edge[(edge > k) & (total[edge] >= total[k] + 200_000)]
        k = int(later[0]) if len(later) else len(rows)
        cuts.append(k)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        size = n[a:b]
        row = np.repeat(np.arange(a, b), size)
        shift = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        _, order, repeat = _strings(buf, offsets[row] + shift, did[row], place[row] + shift)
        found = order[repeat]
        dids.append(did[row][found])
        places.append(place[row][found] + shift[found])
    d, p = np.concatenate(dids), np.concatenate(places)
    order = np.lexsort((p, d))
    d, p = d[order], p[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1 if len(first) else first
    return pa.table({"did": pa.array(d[first]), "a": pa.array(p[first]), "b": pa.array(p[last] + LENGTH)})


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of stretches [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.append(first[1:], len(a)) - 1] if len(a) else b


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``did``, by which they are ordered: doc_id, or a rank where doc_id isn't a key."""
    ids = docs.groupBy("doc_id").count()
    if ids.filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("did", F.col("doc_id").cast("long"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    n = common.ranges(docs.sparkSession, docs.count())
    scaled = (F.col("doc_id").cast("double") - F.lit(float(low or 0))) / F.lit(max(float((high or 0) - (low or 0)), 1.0)) * n
    bucket = F.coalesce(F.least(F.lit(n - 1), F.floor(scaled)), F.lit(n)).cast("long")
    return common.ranked(common.pin(docs.withColumn("_b", bucket)), [], "_b", [F.col("doc_id"), F.col("text").asc_nulls_first()], "did").drop("_b")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated stretches (did, a, b) of documents (did, text); they may overlap. To be read once."""
    spark = docs.sparkSession
    parts = common.shuffle_partitions(spark)
    texts = docs.select("did", "text").filter(F.octet_length("text") >= LENGTH)
    n = docs.count()
    chosen = texts.filter(F.pmod(F.xxhash64(F.lit(13), "did"), F.lit(max(1, n // SAMPLE))) == 0)
    sample = chosen.mapInArrow(_sample, "lead long, cover long, did long").toPandas()  # of about SAMPLE documents
    keys = [sample["lead"].to_numpy().view(np.uint64), sample["cover"].to_numpy().view(np.uint64), sample["did"].to_numpy()]
    order, _ = multikey_quicksort(keys)
    buckets = max(parts, len(order) * max(1, n // SAMPLE) // BUCKET)
    picks = order[(np.arange(1, buckets) * len(order)) // buckets] if len(order) else np.zeros(0, np.int64)
    splitters = np.stack([sample[k].to_numpy()[picks] for k in ("lead", "cover", "did")], axis=1) if len(picks) else np.zeros((0, 3), np.int64)
    dealt = texts.mapInArrow(lambda it: _deal(it, splitters), "bucket int, lead binary, cover binary, did binary, packed binary, sides binary")
    found = common.pin(dealt.groupBy("bucket").applyInArrow(_sort_bucket, FOUND))
    classes = found.filter(F.col("kind") != REPEAT).select("did", F.struct(F.col("a").alias("key"), F.col("b").alias("packed"), (F.col("kind") == STRING).alias("hot")).alias("s"))
    wanted = common.pin(classes.groupBy("did").agg(F.collect_list("s").alias("suffixes")))  # at most a document's suffixes
    amount = wanted.agg(F.sum(F.size("suffixes"))).first()[0] or 0
    texts = texts.join(common.small(wanted.select("did"), 200_000), "did", "left_semi").join(wanted, "did")
    strings = texts.select("did", "text", "suffixes").mapInArrow(_cut, STRINGS)
    deal = max(parts, amount * WINDOW // 2 // 1_000_000)
    compared = strings.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(deal))).groupBy("deal").applyInArrow(_compare, "did long, a long, b long")
    return found.filter(F.col("kind") == REPEAT).select("did", "a", "b").unionByName(compared)


def _with_spans(docs: DataFrame, work: Callable[[bytes, np.ndarray, np.ndarray], dict], types: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Applies ``work`` to each text and its repeated runs. Documents without any don't move."""

    @textbytes.lean
    def run(batches):
        for batch in batches:
            spans = batch.column("spans") if "spans" in batch.schema.names else None
            rest = [c for c in batch.schema.names if c not in ("did", "text", "spans")]
            buf, offsets, null = textbytes.raw_text(batch.column("text"))
            none = np.zeros(0, np.int64)
            for lo, hi in textbytes.slabs(offsets, 1 << 21):
                rows = []
                for i in range(lo, hi):
                    a, b = none, none
                    if spans is not None and spans[i].is_valid:
                        v = spans[i].values
                        a, b = _union(np.asarray(v.field("a")), np.asarray(v.field("b")))
                    rows.append(work(None if null[i] else buf[offsets[i] : offsets[i + 1]], a, b))
                columns = {c: batch.column(c).slice(lo, hi - lo) for c in rest}
                columns |= {c: pa.array([r[c] for r in rows], types[c]) for c in types}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    numbered = _numbered(docs)
    spans = common.pin(repeats(numbered).groupBy("did").agg(F.collect_list(F.struct("a", "b")).alias("spans")))  # at most a document's suffixes
    ids = common.small(spans.select("did"), 200_000)
    clean = numbered.join(ids, "did", "left_anti").mapInArrow(run, schema)
    return clean.unionByName(numbered.join(ids, "did", "left_semi").join(spans, "did").mapInArrow(run, schema))


def _without(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return raw.tobytes()
    keep = np.ones(len(raw), bool)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        keep[x:y] = False
    return raw[keep].tobytes()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    empty = np.zeros(0, np.uint8)

    def work(raw, a, b):
        raw = empty if raw is None else raw
        return {"n_bytes": len(raw), "n_removed": int((b - a).sum()), "n_spans": len(a), "kept_sha256": hashlib.sha256(_without(raw, a, b)).hexdigest()}

    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    return _with_spans(docs.select("doc_id", "text"), work, types, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages, with all their columns; a character cut in two goes whole."""

    def work(raw, a, b):
        return {"text": None if raw is None else _without(raw, a, b).decode("utf-8", "ignore") if len(a) else raw.tobytes().decode()}

    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*(f"`{c}`" for c in rest)).alias("row"), "doc_id", "text")  # names of theirs can't clash with ours
    done = _with_spans(row, work, {"text": pa.string()}, f"row {row.schema['row'].dataType.simpleString()}, doc_id {row.schema['doc_id'].dataType.simpleString()}, text string")
    return done.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
