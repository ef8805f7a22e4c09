"""Labelled evaluation: leaks, recall, precision, confusion, ship bars, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Pairs of gold and predicted spans that overlap: an equi-join on the document with the interval as residual."""
    g = gold.select(key, F.col("seq").alias("g_seq"), F.col("label").alias("g_label"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    p = pred.select(key, F.col("seq").alias("p_seq"), F.col("label").alias("p_label"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    both = g.join(p, key).filter("g_start < p_end and p_start < g_end")
    return both.withColumn("shared", F.least("g_end", "p_end") - F.greatest("g_start", "p_start"))


def by_label(gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Of each label: gold, detected and rightly labelled gold spans, predictions and right ones, recall, precision, F1.

    Ratios are rounded to six places once, from counts.
    """
    pairs = overlaps(gold, pred, key)
    g = pairs.groupBy(key, "g_seq", F.col("g_label").alias("label")).agg(F.bool_or(F.col("g_label") == F.col("p_label")).alias("same"))
    found = g.groupBy("label").agg(F.count("*").alias("detected"), F.count_if("same").alias("labelled"))
    p = pairs.groupBy(key, "p_seq", F.col("p_label").alias("label")).agg(F.bool_or(F.col("g_label") == F.col("p_label")).alias("same"))
    right = p.groupBy("label").agg(F.count_if("same").alias("right"))
    out = gold.groupBy("label").agg(F.count("*").alias("gold")).join(found, "label", "full").join(pred.groupBy("label").agg(F.count("*").alias("pred")), "label", "full").join(right, "label", "full").na.fill(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    out = out.withColumn("recall", F.round(ratio("labelled", "gold"), 6)).withColumn("detect_recall", F.round(ratio("detected", "gold"), 6)).withColumn("precision", F.round(ratio("right", "pred"), 6))
    return out.withColumn("f1", F.round(f1(ratio("right", "pred"), ratio("labelled", "gold")), 6))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def confusion(gold: DataFrame, pred: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Gold label against the label of the prediction that shares most with it, or MISS; ``top`` cells off the diagonal."""
    order = Window.partitionBy(key, "g_seq").orderBy(F.desc("shared"), "p_seq")
    best = overlaps(gold, pred, key).withColumn("n", F.row_number().over(order)).filter("n = 1").select(key, F.col("g_seq").alias("seq"), "p_label")
    cells = gold.join(best, [key, "seq"], "left").groupBy(F.col("label").alias("gold"), F.coalesce("p_label", F.lit("MISS")).alias("pred")).agg(F.count("*").alias("n"))
    return cells if top is None else cells.filter("gold <> pred").orderBy(F.desc("n"), "gold", "pred").limit(top)


def leaks(truth: DataFrame, redacted: DataFrame, key: str) -> DataFrame:
    """Of each category: true values checked, and those that the redacted text still shows."""
    rows = truth.join(redacted, key)
    return rows.groupBy("category").agg(F.count("*").alias("checked"), F.count_if(F.contains("redacted", F.col("value"))).alias("leaks"))


def ship_bar(scores: DataFrame, floor_labels: Sequence[str], recall: float = 0.99, precision: float = 0.97, f1: float = 0.93) -> DataFrame:
    """Scores of ``by_label`` with the bars that a label misses; floor labels have bars of their own."""
    hard = F.col("label").isin(*floor_labels)
    missed = F.array_compact(F.array(F.when(hard & (F.col("recall") < recall), "recall"), F.when(hard & (F.col("precision") < precision), "precision"), F.when(F.col("f1") < f1, "f1")))
    return scores.withColumn("is_floor", hard).withColumn("fails", F.array_join(missed, ",")).withColumn("passes", F.size(missed) == 0)


def parity(pairs: DataFrame) -> DataFrame:
    """Of (id, a, b) vectors: cosine and whether their greatest entries agree."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    top = lambda x: F.array_position(x, F.array_max(x))
    cosine = dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    return pairs.select("id", cosine.alias("cosine"), (top(F.col("a")) == top(F.col("b"))).alias("agrees"))


def macro_micro(scores: DataFrame) -> DataFrame:
    """F1 over labels and over spans, from the counts of ``by_label``.

    The mean over labels is of millionths as whole numbers, so that no order of summation decides a digit.
    """
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    whole = F.round(f1(share("right", "pred"), share("labelled", "gold")) * 1_000_000).cast("long")
    made = scores.agg(F.sum(whole).alias("sum"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("right", "pred", "labelled", "gold")))
    macro = F.expr("cast((2 * sum + n) div (2 * n) as double) / 1000000")  # rounded half up
    return made.select(macro.alias("macro_f1"), F.round(f1(share("right", "pred"), share("labelled", "gold")), 6).alias("micro_f1"))


def category_f1(scores: DataFrame, category: Column) -> DataFrame:
    """F1 of the labels of each category together."""
    made = scores.groupBy(category.alias("category")).agg(*(F.sum(c).alias(c) for c in ("right", "pred", "labelled", "gold")))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return made.select("category", "gold", "pred", F.round(f1(share("right", "pred"), share("labelled", "gold")), 6).alias("f1"))


def clean_false_positives(docs: DataFrame, gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Documents without a gold span (``neg_rows``), those of them with a prediction, and such predictions."""
    clean = docs.select(key).join(gold.select(key).distinct(), key, "left_anti")
    hits = clean.join(pred.groupBy(key).agg(F.count("*").alias("n")), key, "left")
    return hits.agg(F.count("*").alias("neg_rows"), F.count("n").alias("clean_fp"), F.coalesce(F.sum("n"), F.lit(0)).alias("clean_spans"))


def scorecard(replayed: DataFrame) -> DataFrame:
    """Of replayed fixtures (name, text, redacted, restored, must, benign): leaks, benign words redacted, round trips."""
    shown = lambda words: F.filter(words, lambda w: F.contains("redacted", w))
    return replayed.select(
        "name",
        F.size(shown(F.col("must"))).alias("leaks"),
        (F.size("benign") - F.size(shown(F.col("benign")))).alias("over_redacted"),
        (F.col("restored") == F.col("text")).alias("round_trip"),
    )
