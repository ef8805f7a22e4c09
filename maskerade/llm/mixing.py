"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's documents are each wanted r = target / source size times. r has a whole part, which every document
gets, and a fraction p, which rounding turns into 0 or 1. Two documents at a time meet: probability mass, weighted
by their sizes, moves at random from one to the other until one of them is 0 or 1. The move keeps the expectation
of both and the sum of size x p exactly, so a source ends within one document's size of its target, whereas
independent draws would err by the root of the sum of squares.

Meetings run in a reduction tree: documents of a source hash into chunks of about ``CHUNK``, a fold over a chunk's
array settles all but one, and what is left of the chunks meets in chunks of the next level. A hot source is many
chunks, and a level is 1 / CHUNK of the one before. Documents longer than their source's mean are settled first;
what the last of them is off by is spread over the others' fractions before these are settled, so that one very
long document doesn't decide how near a source comes to its target. Draws are hashes of seed, level and both documents, and a
chunk's order is by hash and key, so reruns agree.

Rows of one doc_id, source and size are alike to the decisions: they are counted and numbered, in blocks of at most
``REPEATS``, so that one document that is repeated without end, or many without a doc_id, neither gather in a task nor
share a draw. The tables with a row for each source are small and ordered in one task.

Defined results: null or empty text has size 0 and is taken as 0 words; a null source is a source of its own, last;
repeated documents and those with a null doc_id are documents of their own; with no words at all, targets are 0; other columns are ignored by
the decisions and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents that meet in one fold.
CHUNK = 128
#: Rows alike that are numbered in one go.
REPEATS = 4096


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Source, its rows, size and target from (source, size); one row a source.

    Sources sorted by code point, null last, have the weights in turn. A target is min(cap x size, level x weight),
    with the level at which targets sum to all sizes: what resharing the excess again and again leads to. Sources
    sorted by cap x size / weight, those below the level are a prefix, found from running sums.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    by = by.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    line = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    total, whole = F.sum("source_size").over(Window.partitionBy()), F.sum("_w").over(Window.partitionBy())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (whole - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    by = by.withColumn("_level", level)
    # the level is that of the first source whose cap isn't below the level of all from it on
    fits = F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))
    final = F.first(fits, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    final = F.coalesce(final, F.lit(float("inf")))
    return by.withColumn("target", F.least(F.col("_cap"), final * F.col("_w"))).select("source", "n", "source_size", "target")


def _meet(level: int, seed: int):
    """The fold: settles one of the carried document and the next, carries the other."""

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def settled(x: Column, take: Column | int) -> Column:
        return F.array(F.struct(x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), x["size"].alias("size"), (F.lit(take) if isinstance(take, int) else take).cast("int").alias("take")))

    def left(x: Column, p: Column) -> Column:
        return F.struct(x["k"].alias("k"), x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), x["size"].alias("size"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["rest"]
        draw = (F.xxhash64(F.lit(seed), F.lit(level), a["k"], b["k"]).cast("double") / F.lit(2.0**64)) + 0.5
        ratio = b["size"] / a["size"]
        moves = F.struct(F.least(1 - a["p"], b["p"] * ratio).alias("up"), F.least(a["p"], (1 - b["p"]) * ratio).alias("down"), ratio.alias("ratio"), draw.alias("u"))

        def move(m: Column) -> Column:
            rises = m["u"] * (m["up"] + m["down"]) < m["down"]
            a_ends = F.when(rises, 1 - a["p"] <= b["p"] * m["ratio"]).otherwise(a["p"] <= (1 - b["p"]) * m["ratio"])
            a_p = F.when(rises, a["p"] + m["up"]).otherwise(a["p"] - m["down"])
            b_p = F.when(rises, b["p"] - m["up"] / m["ratio"]).otherwise(b["p"] + m["down"] / m["ratio"])
            one = F.when(rises, 1).otherwise(0)
            return F.struct(
                F.when(a_ends, left(b, b_p)).otherwise(left(a, a_p)).alias("rest"),
                F.concat(acc["done"], F.when(a_ends, settled(a, one)).otherwise(settled(b, 1 - one))).alias("done"),
            )

        return F.when(a.isNull(), F.struct(left(b, b["p"]).alias("rest"), acc["done"].alias("done"))).otherwise(let(moves, move))

    return step


REST = "struct<k:bigint,doc_id:bigint,nth:bigint,size:bigint,p:double>"
DONE = "array<struct<doc_id:bigint,nth:bigint,size:bigint,take:int>>"


def _tree(live: DataFrame, most: int, sources: int, seed: int) -> tuple[list[DataFrame], DataFrame]:
    """Settles all rows: the settled ones of each level, and by source the words the last one is off by."""
    key = F.xxhash64(F.lit(seed), "doc_id", "nth")
    chunk = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size", "nth"), F.ceil(F.col("n") / CHUNK))
    live = live.select("_s", chunk.alias("_c"), F.struct(key.alias("k"), "doc_id", "nth", F.col("size"), F.col("_p").alias("p")).alias("x"))
    settled, level, width = [], 0, -(-most // CHUNK)
    while True:
        met = live.groupBy("_s", "_c").agg(F.array_sort(F.collect_list("x")).alias("xs")).select(
            "_s", "_c", F.aggregate("xs", F.struct(F.lit(None).cast(REST).alias("rest"), F.array().cast(DONE).alias("done")), _meet(level, seed)).alias("m")
        )
        met = met.select("_s", "_c", F.col("m.rest").alias("x"), F.col("m.done").alias("done"))
        met = common.pin(met.coalesce(1 + width * sources // 100) if level else met)  # upper levels are few rows
        settled.append(met.select("_s", F.explode("done").alias("d")).select("_s", "d.doc_id", "d.nth", "d.size", "d.take"))
        live = met.select("_s", F.floor(F.col("_c") / CHUNK).alias("_c"), "x")
        if width <= 1:
            break
        level, width = level + 1, -(-width // CHUNK)
    draw = (F.xxhash64(F.lit(seed), F.lit(-1), F.col("x.k")).cast("double") / F.lit(2.0**64)) + 0.5
    last = live.select("_s", "x.doc_id", "x.nth", "x.size", "x.p", (draw < F.col("x.p")).cast("int").alias("take"))
    return [*settled, last.drop("p")], last.select("_s", ((F.col("p") - F.col("take")) * F.col("size")).alias("_off"))


def numbered(sizes: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size) with a number ``nth`` from 0 among those that are alike. From a pinned table of their counts."""
    alike = common.pin(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_m")))
    rows = alike.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / REPEATS))))
    if (alike.agg(F.max("_m")).first()[0] or 0) > REPEATS:
        rows = rows.repartition(common.shuffle_partitions(sizes.sparkSession), "doc_id", "source", "size", "_block")
    first = F.col("_block") * REPEATS
    return rows.withColumn("nth", F.explode(F.sequence(first, F.least(first + REPEATS, F.col("_m")) - 1))).select("doc_id", "source", "size", "nth")


def decide(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 29) -> DataFrame:
    """doc_id, source, size, nth (among rows alike), source_size, target and ``copies`` for each row of (doc_id, source, size)."""
    sizes = numbered(sizes)
    stats = common.pin(targets(sizes, weights, cap).withColumn("_s", F.monotonically_increasing_id()))
    sources, most = stats.agg(F.count("*"), F.max("n")).first()
    most = most or 0
    near = F.broadcast if sources <= 20_000 else lambda df: df  # tables with a row a source; more of them join by shuffle
    facts = stats.select(F.col("source").alias("_source"), "_s", "n", "source_size", "target")
    want = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = sizes.join(near(facts), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_want", want)
    rows = rows.withColumn("_whole", F.floor(F.col("_want") + 1e-12)).withColumn("_p", F.greatest(F.lit(0.0), F.col("_want") - F.col("_whole")))
    open_ = (F.col("size") > 0) & (F.col("_p") > 1e-12)
    settled = [rows.filter(~open_).select("_s", "doc_id", "nth", "size", F.lit(0).alias("take"))]
    live = rows.filter(open_).withColumn("_long", F.col("size") > F.col("source_size") / F.col("n"))
    parts, last = _tree(live.filter("_long"), most, sources, seed)
    settled += parts
    shift = live.filter("not _long").groupBy("_s").agg(F.sum("size").alias("_mass")).join(last, "_s")
    shift = shift.select(F.col("_s").alias("_t"), (F.col("_off") / F.col("_mass")).alias("_shift"))
    short = live.filter("not _long").join(near(shift), F.col("_s") == F.col("_t"), "left")
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_p") + F.coalesce(F.col("_shift"), F.lit(0.0))))
    settled += _tree(short.withColumn("_p", moved), most, sources, seed)[0]
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    wholes = facts.select("_s", F.col("_source").alias("source"), "source_size", "target", F.floor(want + 1e-12).alias("_whole"))
    copies = F.least((F.col("_whole") + F.col("take")).cast("long"), F.lit(int(cap)).cast("long"))
    return done.join(near(wholes), "_s").select("doc_id", "source", "size", "nth", F.col("source_size").cast("long"), "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as decided, with the columns of ``docs``.

    Decisions meet their documents by doc_id, source and size; rows alike in these are numbered by where they are.
    """
    sized = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # names of theirs can't clash with ours
    sized = sized.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").alias("source"), common.word_count(F.col("row.text")).alias("size"))
    keys = ["doc_id", "source", "size"]
    decided = common.pin(decide(sized.select(*keys), **options).select(*keys, "nth", "copies"))
    same = lambda names: common._all([F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in names])
    repeated = common.small(decided.filter("nth = 1").select(*keys)).alias("r")
    rows = sized.alias("l").join(repeated, same(keys), "left_anti").withColumn("nth", F.lit(0).cast("long"))
    if not repeated.isEmpty():
        again = common.pin(sized.alias("l").join(repeated, same(keys), "left_semi"))
        again = again.select("*", F.spark_partition_id().alias("_b"), F.monotonically_increasing_id().alias("_h"))
        rows = rows.unionByName(common.ranked(again, keys, "_b", [F.col("_h")], "nth").drop("_b", "_h"))
    met = rows.alias("l").join(decided.filter("copies > 0").alias("r"), same([*keys, "nth"]))
    return met.select("l.row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.copies")))).select("row.*")


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", common.word_count(F.col("text")).alias("size"))
    return decide(sized, **options).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
