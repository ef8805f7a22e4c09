"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its windows of ``SHINGLE`` words (a shorter text is one window). Texts of equal sets are one
node, with the number of its copies. Each of ``TREES`` trees labels a node with ``LONGEST`` min-hashes of 16 bits; the
labels in order are a prefix tree, in which nodes that share a prefix lie side by side.

Matched prefixes start at the whole label and shorten. At each depth the pairs that share a prefix of it in some tree,
and none of a depth before in any, are verified exactly, on their sets of 64-bit window hashes, each pair once (in the
first such tree). A pair of similarity s is found down to depth d with probability 1 - (1 - s^d)^TREES, so the pairs
found so far say how many there are in all (each stands for one over its probability), and how many a shorter prefix
would find. Prefixes shorten, by as much as that asks for, until the found share, less two standard errors, reaches
the target recall, or until the depth at which even pairs at the threshold reach it: where near copies are close the
whole labels do, a few pairs at the threshold make them shorten as far as needed.

Members of a prefix are dealt in blocks of at most about ``BLOCK``, and a task compares two blocks, so that no task
holds a large group. A task returns for each node its links and one edge to the least node it is connected with
there: pairs aren't emitted. Components come from these edges by contraction. As every link is counted, work on a
group of m near copies grows with m^2; exact copies are one node and cost nothing more.

Defined results: null text and text without a word has no windows, no links and a class of its own; equal texts are
linked, and each copy counts as one link; rows are told apart as rows, so repeated rows are copies, and rows with one
doc_id and different texts are different; the class is named by its least doc_id, null where all of its ids are;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, textbytes

SHINGLE, THRESHOLD, TREES, LONGEST, RECALL = 5, 0.8, 20, 8, 0.999
BLOCK = 256
#: Bins of similarities from the threshold to 1, by which found pairs are counted.
BINS = 40


def recall_at(depth: int, similarity: float | np.ndarray, trees: int) -> float | np.ndarray:
    """Share of pairs of a similarity that have a common prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_prefix(threshold: float = THRESHOLD, trees: int = TREES, longest: int = LONGEST, target: float = RECALL) -> int:
    """The depth at which even pairs at the threshold reach the target: prefixes never need to be shorter."""
    depth = longest
    while depth > 1 and recall_at(depth, threshold, trees) < target:
        depth -= 1
    return depth


def recall_found(bins: np.ndarray, depth: int, threshold: float, trees: int, then: int | None = None) -> float:
    """A cautious estimate of the share of all pairs among those found down to ``depth``, counted by similarity.

    With ``then``, of the share that a search down to that depth would find. The estimated number of all pairs is
    raised by two standard errors, and by those of one pair at the threshold, so that few pairs, or none, aren't
    taken for proof.
    """
    similarity = np.minimum(threshold + (1 - threshold) * (np.arange(len(bins)) + 0.5) / (len(bins) - 1), 1.0)
    pairs = bins / recall_at(depth, similarity, trees).clip(1e-9, 1.0)
    p, at = (recall_at(then or depth, x, trees) for x in (similarity, threshold))
    p = p.clip(1e-9, 1.0)
    error = np.sqrt((pairs * (1 - p) / p).sum() + (1 - at) / at**2)
    return float((pairs * p).sum() / (pairs.sum() + 2 * error)) if bins.sum() else 0.0


def shingle_sets(raw: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct window hashes of each text."""
    a, b = textbytes.words(raw, at[:-1])
    h = textbytes.Hasher(raw)(a, b)
    first = np.searchsorted(a, at)
    n = np.diff(first)
    windows = textbytes.combined([h[k : len(h) - width + 1 + k] for k in range(width)]) if len(h) >= width else np.zeros(0, np.uint64)
    out = []
    for lo, k in zip(first[:-1].tolist(), n.tolist(), strict=True):
        if k >= width:
            w = np.sort(windows[lo : lo + k - width + 1])
            out.append(w[np.concatenate(([True], w[1:] != w[:-1]))])
        elif k:
            out.append(textbytes.mixed(textbytes.combined([h[i : i + 1] for i in range(lo, lo + k)]) + np.uint64(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _set_key(s: np.ndarray) -> np.ndarray:
    """A 64-bit name of a set."""
    return textbytes.mixed(s).sum(dtype=np.uint64)


@textbytes.lean
def _sign(batches: Iterator[pa.RecordBatch], width: int, trees: int) -> Iterator[pa.RecordBatch]:
    seeds = textbytes.mixed(np.arange(1, 2 * trees * LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    flips, factors = seeds[::2].astype(np.uint32), seeds[1::2].astype(np.uint32) | np.uint32(1)
    for batch in batches:
        buf, offsets, _ = textbytes.raw_text(batch.column("text"))
        for i, j in textbytes.slabs(offsets):
            sets = shingle_sets(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            size = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(size)
            labels = np.zeros((j - i, trees * LONGEST), ">u2")
            if len(full):
                flat = (np.concatenate([sets[k] for k in full]) >> np.uint64(32)).astype(np.uint32)
                starts = np.cumsum(size[full]) - size[full]
                for k in range(trees * LONGEST):
                    labels[full, k] = textbytes.mixed(np.minimum.reduceat((flat ^ flips[k]) * factors[k], starts).astype(np.uint64)) & np.uint64(0xFFFF)
            keys = np.array([_set_key(s) for s in sets], np.uint64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id").slice(i, j - i),
                    "same": batch.column("same").slice(i, j - i),
                    "node": pa.array(keys.view(np.int64), mask=size == 0),
                    "labels": pa.array([x.tobytes() for x in labels], pa.binary()),
                }
            )


@textbytes.lean
def _whole_units(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 2000) -> Iterator[pa.Table]:
    """Stretches of a sorted stream that end where a unit ends."""
    held: list[pa.RecordBatch] = []
    schema = None

    def cut(table: pa.Table) -> int:
        k = np.stack([table.column(c).to_numpy() for c in keys])
        change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
        return int(change[-1]) + 1 if len(change) else 0

    for batch in batches:
        schema = batch.schema
        for lo in range(0, batch.num_rows, rows):
            held.append(batch.slice(lo, rows))
            if sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held)
                if at := cut(table):
                    yield table.slice(0, at).combine_chunks()
                    held = table.slice(at).to_batches()
    if held and schema is not None:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table.combine_chunks()


class _Units:
    """Units (prefix of a tree, two blocks) of a table in order, and the pairs that belong to each."""

    KEYS = ["prefix", "lo", "hi"]

    def __init__(self, table: pa.Table, depth: int, done: int | None):
        self.node = table.column("node").to_numpy()
        self.block, self.cross = table.column("block").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()
        self.tree = table.column("tree").to_numpy()
        raw, offsets, _ = textbytes.raw_text(table.column("labels"))
        labels = raw[offsets[0] : offsets[-1]].view(">u2").reshape(len(self.node), -1, LONGEST)
        #: Of each row and tree: its prefix of this depth, and of the one before.
        self.here, self.done = (textbytes.combined([labels[:, :, k].astype(np.uint64) for k in range(d)]) if d else None for d in (depth, done))
        k = np.stack([table.column(c).to_numpy() for c in self.KEYS])
        self.starts = np.flatnonzero(np.concatenate(([True], (k[:, 1:] != k[:, :-1]).any(axis=0))))
        self.stops = np.append(self.starts[1:], len(self.node))

    def pairs(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows lo to hi, which are whole units, that share this unit's prefix, none in an earlier tree, and none of the depth before."""
        size = (self.stops - self.starts)[(self.starts >= lo) & (self.starts < hi)]
        after = np.repeat(np.cumsum(size), size) - np.arange(1, hi - lo + 1)
        i = np.repeat(np.arange(lo, hi), after)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
        mine = ~self.cross[i] | (self.block[i] != self.block[j])
        mine &= self.node[i] != self.node[j]
        mine &= (self.tree[i] == self.tree[j]) & (self.here[i, self.tree[i]] == self.here[j, self.tree[j]])  # prefixes travel as hashes
        i, j = i[mine], j[mine]
        for t in range(self.here.shape[1]):
            same = (self.here[i, t] == self.here[j, t]) & (t < self.tree[i])
            if self.done is not None:
                same |= self.done[i, t] == self.done[j, t]
            i, j = i[~same], j[~same]
        return i, j

    def stretches(self, most: int = 100_000) -> Iterator[tuple[int, int]]:
        """Whole units of up to about ``most`` pairs."""
        lo, pairs = 0, 0
        for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True):
            if pairs and pairs + (b - a) ** 2 // 2 > most:
                yield lo, a
                lo, pairs = a, 0
            pairs += (b - a) ** 2 // 2
        if lo < len(self.node):
            yield lo, len(self.node)


@textbytes.lean
def _with_pairs(batches: Iterator[pa.RecordBatch], depth: int, done: int | None) -> Iterator[pa.RecordBatch]:
    """Rows that have a pair to verify."""
    for table in _whole_units(batches, _Units.KEYS):
        units = _Units(table, depth, done)
        wanted = np.zeros(table.num_rows, bool)
        for lo, hi in units.stretches():
            i, j = units.pairs(lo, hi)
            wanted[i] = wanted[j] = True
        yield from table.filter(pa.array(wanted)).to_batches()


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    renumbered = np.cumsum(times > 1) - 1
    row, column = row[shared], renumbered[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    total = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(column, np.arange(0, int((times > 1).sum()) + width, width))
    for k in range(len(edges) - 1):
        part = np.zeros((len(sets), width), np.float32)
        part[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width] = 1
        total += part @ part.T
    return np.rint(total[i, j]).astype(np.int64)


@textbytes.lean
def _verify(batches: Iterator[pa.RecordBatch], depth: int, done: int | None, width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each unit's node with links there: the least node it is connected with, linked texts and documents.

    The last row has no node and counts the task's pairs by similarity.
    """
    bins = np.zeros(BINS + 1, np.int64)
    for table in _whole_units(batches, _Units.KEYS, rows=500):
        units = _Units(table, depth, done)
        copies = table.column("copies").to_numpy()
        buf, offsets, _ = textbytes.raw_text(table.column("text"))
        sets: list[np.ndarray] = []
        for a, b in textbytes.slabs(offsets):
            sets += shingle_sets(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
        n = np.array([len(s) for s in sets], np.int64)
        nodes, roots, texts, docs = [], [], [], []
        for a, b in zip(units.starts.tolist(), units.stops.tolist(), strict=True):
            i, j = units.pairs(a, b)
            near = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
            i, j = i[near], j[near]
            if not len(i):
                continue
            both = common_counts(sets[a:b], i - a, j - a)
            similar = both / (n[i] + n[j] - both)
            linked = similar >= threshold
            bins += np.bincount(((similar[linked] - threshold) * (BINS / max(1 - threshold, 1e-9))).astype(np.int64).clip(0, BINS), minlength=BINS + 1)
            i, j = i[linked] - a, j[linked] - a
            if not len(i):
                continue
            w = copies[a:b]
            t = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
            d = np.bincount(i, weights=w[j], minlength=b - a) + np.bincount(j, weights=w[i], minlength=b - a)
            root = units.node[a:b].copy()
            while True:
                least = np.minimum(root[i], root[j])
                if (root[i] == least).all() and (root[j] == least).all():
                    break
                np.minimum.at(root, i, least)
                np.minimum.at(root, j, least)
            some = np.flatnonzero(t)
            nodes.append(units.node[a:b][some])
            roots.append(root[some])
            texts.append(t[some])
            docs.append(d[some].astype(np.int64))
        if nodes:
            cols = {k: pa.array(np.concatenate(v)) for k, v in (("node", nodes), ("root", roots), ("n_texts", texts), ("n_docs", docs))}
            yield pa.RecordBatch.from_pydict(cols | {"bins": pa.nulls(len(cols["node"]), pa.list_(pa.int64()))})
    if bins.any():
        none = {k: pa.nulls(1, pa.int64()) for k in ("node", "root", "n_texts", "n_docs")}
        yield pa.RecordBatch.from_pydict(none | {"bins": pa.array([bins.tolist()], pa.list_(pa.int64()))})


FOUND = "node long, root long, n_texts long, n_docs long, bins array<long>"


class Forest:
    """The labelled nodes of documents, those that share a prefix at the shortest depth with another, and their texts."""

    def __init__(self, docs: DataFrame, width: int, trees: int, shortest: int):
        self.parts, self.trees, self.width = common.shuffle_partitions(docs.sparkSession), trees, width
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("same"), "text")
        signed = texts.mapInArrow(lambda it: _sign(it, width, trees), "doc_id long, same long, node long, labels binary")
        #: Of each row: doc_id and ``same``, which tell it from others, and its node (null without a word).
        self.rows = common.pin(signed)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
        nodes = self.rows.filter("node is not null").groupBy("node").agg(first.alias("first"), F.count("*").alias("copies"), F.any_value("labels").alias("labels"))
        self.nodes = common.pin(nodes.select("node", "first.doc_id", "first.same", "copies", "labels"))
        label = F.expr(f"substring(labels, tree * {2 * LONGEST} + 1, {2 * LONGEST})")
        members = self.nodes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select("node", "tree", label.alias("label"))
        together = members.groupBy("tree", F.substring("label", 1, 2 * shortest).alias("prefix")).count().filter("count > 1").select(F.xxhash64("tree", "prefix").alias("at"))
        members = members.withColumn("at", F.xxhash64("tree", F.substring("label", 1, 2 * shortest)))
        self.members = common.pin(members.join(together, "at", "left_semi").drop("at"))
        wanted = self.nodes.join(self.members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("_doc"), F.col("same").alias("_same"))
        # a row that is repeated would bring its text as often
        held = texts.join(common.small(wanted, 200_000), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same")))
        self.bodies = common.pin(held.groupBy("node").agg(F.any_value("text").alias("text")))

    def at(self, depth: int, done: int | None, threshold: float) -> DataFrame:
        """What the pairs show that share a prefix of ``depth`` and none of the depth ``done``. Pinned."""
        members = self.members.withColumn("prefix", F.xxhash64("tree", F.substring("label", 1, 2 * depth)))
        longer = F.substring("label", 1, 2 * done) if done else F.lit(None)
        sizes = members.groupBy("prefix").agg(F.count("*").alias("n"), F.min(longer).alias("least"), F.max(longer).alias("most"))
        sizes = sizes.filter("n > 1 and least <> most" if done else "n > 1").select("prefix", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        members = members.join(sizes, "prefix").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        members = members.join(self.nodes.select("node", "copies", "labels"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = members.select("prefix", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "tree", "block", "node", "copies", "labels")
        deal = lambda df: df.repartition(self.parts, *_Units.KEYS).sortWithinPartitions(*_Units.KEYS, "labels", "node")
        wanted = deal(units).mapInArrow(lambda it: _with_pairs(it, depth, done), units.schema)
        width = self.width
        return common.pin(deal(wanted.join(self.bodies, "node")).mapInArrow(lambda it: _verify(it, depth, done, width, threshold), FOUND))


def _linked(docs: DataFrame, threshold: float, width: int, trees: int, recall: float) -> tuple[DataFrame, DataFrame, dict[int, float]]:
    """Rows; facts of nodes (with the row that comes first in the class); estimated recall by depth."""
    shortest = shortest_prefix(threshold, trees, LONGEST, recall)
    forest = Forest(docs, width, trees, shortest)
    found, bins, reached, depth, done = None, np.zeros(BINS + 1), {}, LONGEST, None
    while True:
        new = forest.at(depth, done, threshold)
        found = new if found is None else found.unionByName(new)
        bins += np.array([n or 0 for n in new.agg(*(F.sum(F.col("bins")[k]) for k in range(BINS + 1))).first()])
        reached[depth] = recall_found(bins, depth, threshold, trees)
        if reached[depth] >= recall or depth == shortest:
            break
        enough = [d for d in range(depth - 1, shortest, -1) if recall_found(bins, depth, threshold, trees, d) >= recall]
        depth, done = max(enough, default=shortest), depth
    found = found.filter("node is not null")
    linked = found.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    groups = graph.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same"))
    named = groups.join(forest.nodes.select("node", "doc_id", "same"), "node").groupBy("component").agg(first.alias("head"))
    facts = forest.nodes.select("node", "copies", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "same").alias("own")).join(linked, "node", "left")
    facts = facts.join(groups.join(named, "component").select("node", "head"), "node", "left").withColumn("head", F.coalesce("head", "own")).drop("own")
    return forest.rows, common.pin(facts), reached  # pinned, so that both sides of joins are plain exchanges and a hot node's rows can be split


def join(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """Of every document: doc_id, class_id, n_copies, n_links (linked documents), n_linked_texts (other texts)."""
    rows, facts, _ = _linked(docs, threshold, width, trees, recall)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("doc_id", "node").join(facts, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        (F.greatest(zero("copies") - 1, F.lit(0)) + zero("n_docs")).cast("long").alias("n_links"),
        zero("n_texts").alias("n_linked_texts"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row of each class stays, with all its columns: the one of the least doc_id (null last), and one of rows that repeat it."""
    rows, facts, _ = _linked(docs, threshold, width, trees, recall)
    keyed = rows.filter("node is not null").select("doc_id", "same", "node").join(facts.select("node", "head"), "node")
    # told by key, not by row: what is repeated is one entry, and so are its rows
    keyed = keyed.groupBy("doc_id", "same").agg(F.count("*").alias("n"), F.any_value("head").alias("head"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("same") == F.col("head.same"))
    marked = common.pin(keyed.filter(~is_head | (F.col("n") > 1)).select(F.col("doc_id").alias("_doc"), F.col("same").alias("_same"), is_head.alias("_head")))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("same", F.xxhash64("row.text"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("same") == F.col("_same"))
    stay = held.join(common.small(marked, 200_000), same, "left_anti").select("row")
    once = held.join(common.small(marked.filter("_head"), 200_000), same).groupBy("_doc", "same").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return stay.unionByName(once).select("row.*")
