"""What several training-data operators share: saved cut points, distributed ranks, checked broadcasts."""

from __future__ import annotations

import gc
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import pin

#: A word is a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = 20_000, cells: Column | None = None) -> DataFrame:
    """Marks a table that is cheap to make again for broadcast if it has at most ``rows`` rows; a larger one joins by shuffle.

    ``cells`` counts the numbers in a row with arrays; ten for each row that is allowed may be in all.
    """
    n, m = df.agg(F.count("*"), F.sum(cells if cells is not None else F.lit(0))).first()
    return F.broadcast(df) if n <= rows and (m or 0) <= 10 * rows else df


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is pinned: it does when the driver has collected its garbage, however long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranges(spark: SparkSession, rows: int) -> int:
    """Into how many ranges an order is cut: several for each task, and none of much over 100,000 rows."""
    return max(4 * shuffle_partitions(spark), rows // 100_000)


def spread(hashed: Column, buckets: Column | int) -> Column:
    """A bucket from 0 to buckets - 1, monotone in a signed 64-bit hash."""
    buckets = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.least(buckets - 1, F.floor((hashed.cast("double") / F.lit(2.0**64) + 0.5) * buckets)).cast("long")


def ranked(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], name: str, total: str | None = None) -> DataFrame:
    """Adds each row's rank from 0 within its group, in the given order, without a task that holds a group.

    ``bucket`` is a column that is monotone in the order, so that a group splits into ranges of bounded size: ranks
    are counted inside a range, and ranges get offsets from their counts, of which there are few. ``total`` names a
    column for the size of the group. Nulls form a group of their own. ``df`` is read twice: pin it first.
    """
    ranges = df.groupBy(*groups, bucket).agg(F.count("*").alias("_n"))
    over = Window.partitionBy(*groups)
    ranges = ranges.select(
        *(F.col(c).alias(f"_g{i}") for i, c in enumerate([*groups, bucket])),
        (F.sum("_n").over(over.orderBy(bucket)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(over).alias("_all"),
    )
    within = Window.partitionBy(*groups, bucket).orderBy(*order)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate([*groups, bucket])]
    joined = df.withColumn("_in", F.row_number().over(within) - 1).join(small(ranges), on=_all(same), how="inner")
    joined = joined.withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
    joined = joined.withColumn(total, F.col("_all").cast("long")) if total else joined
    return joined.drop("_in", "_before", "_all", *(f"_g{i}" for i in range(len(groups) + 1)))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
