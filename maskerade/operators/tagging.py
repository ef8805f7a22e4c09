"""The model tier: any tagger as an Arrow UDF, and decoding of its BIO output. The engine has no weights of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import SPAN
from . import chunks


def decode(tokens: Column, least: float = 0.5) -> Column:
    """Spans from tokens (start, end, tag, p) in order: B- or another label begins one, its confidence is the least p."""

    def step(acc: Column, t: Column) -> Column:
        label = F.regexp_replace(t["tag"], "^[BI]-", "")
        cur = acc["cur"]
        goes_on = cur.isNotNull() & t["tag"].startswith("I-") & (cur["label"] == label)
        new = F.struct(t["start"].alias("start"), t["end"].alias("end"), label.alias("label"), t["p"].cast("double").alias("conf"))
        grown = F.struct(cur["start"].alias("start"), t["end"].alias("end"), cur["label"].alias("label"), F.least(cur["conf"], t["p"].cast("double")).alias("conf"))
        out = F.when(cur.isNotNull() & ~goes_on, F.concat(acc["out"], F.array(cur))).otherwise(acc["out"])
        nxt = F.when(t["tag"] == "O", F.lit(None)).when(goes_on, grown).otherwise(new)
        return F.struct(out.alias("out"), nxt.alias("cur"))

    one = "struct<start:int,end:int,label:string,conf:double>"
    begin = F.struct(F.array().cast(f"array<{one}>").alias("out"), F.lit(None).cast(one).alias("cur"))
    done = F.aggregate(tokens, begin, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    return F.filter(done, lambda s: s["conf"] >= least)


def tag(docs: DataFrame, key: str, load: Callable[[], Callable[[list[str]], list[list[dict]]]], text: str = "text") -> DataFrame:
    """Spans (key, start, end, label, tier, conf, rule, validator, value) that a tagger finds in windows of all texts.

    ``load`` runs once a worker and returns the tagger: texts -> lists of {start, end, label, conf}. Equal windows are
    tagged once and joined back.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            found = model(part.tolist())
            yield pd.Series([[{"tier": 2, "rule": "model", "validator": None, "value": t[s["start"] : s["end"]]} | s for s in spans] for t, spans in zip(part, found, strict=True)])

    cut = chunks.chunked(docs, key, text)
    tagged = cut.select("chunk").distinct().withColumn("spans", F.pandas_udf(run, f"array<{SPAN}>")("chunk"))
    rows = cut.join(tagged, "chunk").select(key, F.col("start").alias("_at"), F.inline("spans"))
    return rows.withColumn("start", F.col("start") + F.col("_at")).withColumn("end", F.col("end") + F.col("_at")).drop("_at").distinct()


def carried(names: Column, carrier: str = "The customer is {}.") -> Column:
    """A bare name inside a sentence, for a second look."""
    head, tail = carrier.split("{}")
    return F.when(names.rlike(r"^\p{L}[\p{L}'’.-]*(?: \p{L}[\p{L}'’.-]*){0,3}$") & F.length(names).between(2, 60), F.concat(F.lit(head), names, F.lit(tail)))


def words_whole(text: Column, start: Column, end: Column, label: Column) -> Column:
    """A model's span grown to the edges of the words that it cuts; hyphens and apostrophes join words of names."""
    inner = F.when(label.isin("person", "organization"), F.lit(r"[\p{L}\p{N}_'’-]")).otherwise(F.lit(r"[\p{L}\p{N}_]"))
    left = F.length(F.regexp_substr(F.concat(F.lit(" "), F.substring(text, F.lit(1), start)), F.concat(F.lit("(?:"), inner, F.lit(r")*\z"))))
    right = F.length(F.regexp_substr(text.substr(end + 1, F.length(text)), F.concat(F.lit("^(?:"), inner, F.lit(")*"))))
    return F.struct((start - F.coalesce(left, F.lit(0))).alias("start"), (end + F.coalesce(right, F.lit(0))).alias("end"))
