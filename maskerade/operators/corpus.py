"""Corpus preparation: exact copies, mixtures, label schemes, overlaps, ambiguous values, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def deduplicated(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The document of the least key for each distinct text; the text itself isn't shuffled, its hash is."""
    first = docs.groupBy(F.md5(F.col(text)).alias("_hash")).agg(F.min(key).alias(key))
    return docs.join(first.select(key), key, "left_semi")


def weighted_sample(rows: DataFrame, key: Column, weight: Column, budget: int, seed: int = 7) -> DataFrame:
    """``budget`` rows without replacement, the likelier the weightier: the least -ln(u) / weight, u a hash of the key."""
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48) + 1)
    return rows.withColumn("_score", -F.log(u) / weight).orderBy("_score", key).limit(budget).drop("_score")


def remapped(entities: DataFrame) -> DataFrame:
    """(…, label, value) in the present scheme: bank and routing numbers are account numbers, keys and tokens secrets, an
    account id is one only as a UUID, dates and unknown labels go."""
    kept = (
        "person", "email", "phone_number", "address", "postal_code", "date_of_birth", "government_id", "payment_card", "card_cvv", "card_expiry", "iban", "tax_id", "ip_address", "file_path", "username",
        "organization", "password",
    )
    label = F.col("label")
    new = (
        F.when(label.isin("bank_account", "routing_number"), "account_number")
        .when(label == "sensitive_account_id", F.when(F.trim("value").rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "sensitive_account_id").otherwise("account_number"))
        .when(label.isin("api_key", "access_token"), "secret")
        .when(label.isin(*kept), label)
    )
    return entities.withColumn("label", new).filter("label is not null and value <> ''").distinct()


def strict_labels(spans: DataFrame, known: DataFrame) -> DataFrame:
    """Labels by the table (source_label, label); a label that it lacks fails the job."""
    joined = spans.join(known, spans["label"] == known["source_label"], "left")
    checked = F.when(known["label"].isNull(), F.raise_error(F.concat(F.lit("unknown label: "), spans["label"]))).otherwise(known["label"])
    return joined.select(*(checked.alias("label") if c == "label" else spans[c] for c in spans.columns))


def first_of_overlaps(spans: DataFrame, *keys: str) -> DataFrame:
    """Drops spans that overlap an earlier kept one; by start, longer first.

    Whether one is kept depends on those kept before: a fold over a document's own array.
    """
    rows = F.array_sort(F.collect_list(F.struct("start", (F.col("start") - F.col("end")).alias("shorter"), "end", "label")))

    def step(acc: Column, s: Column) -> Column:
        keep = s["start"] >= acc["last"]
        return F.when(keep, F.struct(F.concat(acc["out"], F.array(s)).alias("out"), s["end"].alias("last"))).otherwise(acc)

    grouped = spans.select(*keys, F.col("start").cast("int"), F.col("end").cast("int"), "label").groupBy(*keys).agg(rows.alias("xs"))
    begin = F.struct(F.array().cast("array<struct<start:int,shorter:int,end:int,label:string>>").alias("out"), F.lit(-1).alias("last"))
    return grouped.select(*keys, F.inline(F.aggregate("xs", begin, step, lambda acc: acc["out"]))).drop("shorter")


def ambiguous(entities: DataFrame, key: str) -> DataFrame:
    """Rows that have a value under more than one label in the same document."""
    bad = entities.groupBy(key, "value").agg(F.countDistinct("label").alias("n")).filter("n > 1").select(key).distinct()
    return entities.join(bad, key, "left_semi")


def unambiguous(entities: DataFrame, key: str) -> DataFrame:
    """The rows of documents in which every value has one label."""
    bad = entities.groupBy(key, "value").agg(F.countDistinct("label").alias("n")).filter("n > 1").select(key).distinct()
    return entities.join(bad, key, "left_anti")


def invalid(docs: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Constraint violations of gold spans: out of range, blank, unknown label; counts by label and fault."""
    known = [*{x for v in fixed.CATEGORIES.values() for x in v}, *fixed.FLOOR_LABELS]
    rows = spans.join(docs.select(key, "text"), key)
    value = F.expr("substring(text, start + 1, end - start)")
    fault = (
        F.when((F.col("start") < 0) | (F.col("end") > F.length("text")) | (F.col("start") >= F.col("end")), "range").when(F.trim(value) == "", "blank").when(~F.col("label").isin(*known), "label")
    )
    return rows.withColumn("fault", fault).filter("fault is not null").groupBy("label", "fault").agg(F.count("*").alias("n"))


def fingerprint(rows: DataFrame, column: str) -> DataFrame:
    """One hash of a set of values, whatever their order: the hash of their sorted hashes' sums by first byte."""
    hashed = rows.select(F.sha2(F.col(column).cast("string"), 256).alias("h")).groupBy(F.substring("h", 1, 2).alias("slot"))
    slots = hashed.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 3, 10), 16, 10).cast("decimal(38,0)")).alias("s"))
    return slots.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "slot", F.col("n").cast("string"), F.col("s").cast("string")))), ","), 256).alias("fingerprint"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """Conversations with their turns numbered from 0 in order."""
    return conversations.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
