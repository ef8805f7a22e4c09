"""Sources and sinks: text and JSONL corpora, dictionaries, redacted output under neutral names, sealed maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import pin

GOLD = "input string, output struct<spans:array<array<string>>, entities:map<string,array<string>>>, meta map<string,string>"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus, a JSON object a line: row, text, spans, meta."""
    rows = spark.read.schema(GOLD).json(path)
    span = lambda s: F.struct(s[0].cast("int").alias("start"), s[1].cast("int").alias("end"), s[2].alias("label"))
    return rows.select(F.col("input").alias("text"), F.transform("output.spans", span).alias("spans"), "output.entities", "meta")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """One value a line; # begins a comment."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value")).filter("value <> ''").distinct()


def neutral_names(docs: DataFrame, order: str, suffix: str = ".txt") -> DataFrame:
    """Names that tell nothing: document-0001.txt and so on, in order. Ranges of the order are counted, and ranked each on its own."""
    keep = docs.columns
    cut = pin(docs.repartitionByRange(order)).withColumn("_range", F.spark_partition_id())
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rows = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(order))).join(F.broadcast(before), "_range")
    n = F.col("_before") + F.col("_in")
    return rows.select(*keep, F.concat(F.lit("document-"), F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string")), F.lit(suffix)).alias("name"))


def sealed(value: Column, key: Column) -> Column:
    """A map under AES-GCM, base64; the key comes from a column so that plans don't show it."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def opened(value: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def live(maps: DataFrame, now: float, idle_hours: float = 24, hard_hours: float = 168) -> DataFrame:
    """Session maps that are neither idle for too long nor too old."""
    return maps.filter((F.lit(now) - F.col("last_used") <= idle_hours * 3600) & (F.lit(now) - F.col("created") <= hard_hours * 3600))
