"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; a row's fractional rank is (2 rank + 1) / (2 n)
for the n rows of its source. Sorted by fractional rank, every stretch of the result holds the sources in the
proportions of the whole, so equal cuts give shards that each match the mixture to within one row a source.

The law is ``rows``: shard sizes differ by at most one row. Equal texts are rows like any others: keeping them
together can't be had at the same time as this law.

Ranks, of a source as of the whole, come from ``common.ranked``: no task holds a source or all rows.

Defined results: null text has no bytes (size 8, CRC 0); a null source is a source of its own, after the others;
null and repeated doc_id are rows like any others, and rows equal in every respect are interchangeable; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def interleave(rows: DataFrame, shards: int, source: str = "source", keys: tuple[str, ...] = ("doc_id",), seed: int = 17) -> DataFrame:
    """Adds ``shard`` and ``slot``, its place there from 0. ``keys`` order the rows of a source, once hashed."""
    rows = common.pin(rows.withColumn("_h", F.xxhash64(F.lit(seed), *(F.col(k) for k in keys))))
    n = rows.count()
    buckets = common.ranges(rows.sparkSession, n)
    keyed = [F.col("_h"), *(F.col(k).asc_nulls_last() for k in keys)]
    ranks = common.ranked(rows.withColumn("_b", common.spread(F.col("_h"), buckets)), [source], "_b", keyed, "_rank", "_of")
    ranks = ranks.withColumn("_f", (2 * F.col("_rank") + 1) / (2.0 * F.col("_of")))
    ranks = common.pin(ranks.withColumn("_b", F.least(F.lit(buckets - 1), F.floor(F.col("_f") * buckets)).cast("long")))
    ordered = common.ranked(ranks, [], "_b", [F.col("_f"), F.col(source).asc_nulls_last(), *keyed], "_at")
    shard = F.expr(f"cast((_at * {shards}L) div {max(n, 1)}L as int)")
    first = F.expr(f"(cast(shard as bigint) * {n}L + {shards - 1}L) div {shards}L")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("_at") - first).drop("_h", "_b", "_rank", "_of", "_f", "_at")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The digest of every document's place: size, text_crc32, law, shard, slot."""
    slim = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = interleave(slim, shards, keys=("doc_id", "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
