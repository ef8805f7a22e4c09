"""The whole way of a table of texts: detect, demote, narrow, grow, merge, stitch, apply policy and dictionaries, mint, substitute, sweep.

Everything up to the sweep is one projection over each document; only dictionaries join, as small tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, normalize, validators
from ..functions.spans import SPAN, let
from ..operators import detect, growth, merge, policy, pseudonyms, secrets, tagging


def _moved(s: Column, start: Column | None = None, end: Column | None = None, label: Column | None = None) -> Column:
    """A span with another place or label."""
    new = {"start": start, "end": end, "label": label}
    return F.struct(*((s[f] if new.get(f) is None else new[f]).alias(f) for f in ("start", "end", "label", "tier", "conf", "rule", "validator", "value"))).cast(SPAN)


def redact(
    docs: DataFrame, text: str = "text", mode: str = "privacy", profile: str = "wide", denied: Sequence[str] = (), allowed: Sequence[str] = (), spans: str | None = None, invisible: bool = True, paths: str = "username"
) -> DataFrame:
    """Adds ``redacted``, ``restore`` (placeholder -> value) and ``found`` (label -> spans) to documents.

    ``spans`` names a column with spans of a model, if there are any: their floor labels are earned or lost, paths
    narrowed as ``paths`` says, cut words made whole, persons grown. ``denied`` and ``allowed`` are a user's own
    dictionaries, small by nature; denied terms are redacted whatever else is.
    """
    keep = docs.columns
    body = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.substring(body, s["start"] + 1, s["end"] - s["start"])
    out = detect.detect(docs, text, profile, named=profile != "thin", invisible=invisible).withColumnRenamed("spans", "_found") if "spans" not in keep else None
    if out is None:  # the caller's own column keeps its name
        out = detect.detect(docs.withColumnRenamed("spans", "_own"), text, profile, named=profile != "thin", invisible=invisible).withColumnRenamed("spans", "_found").withColumnRenamed("_own", "spans")
    model = growth.grow_persons(body, F.coalesce(F.col(spans), F.array()).cast(f"array<{SPAN}>")) if spans else F.array().cast(f"array<{SPAN}>")
    out = out.withColumn("_found", F.concat(F.col("_found"), secrets.spans(normalize.separators(body)), model))
    if spans:
        earned = lambda s: F.when(s["tier"] == 0, s["label"]).otherwise(let(value(s), lambda v: policy.earned_label(s["label"], s["tier"], v)))
        out = out.withColumn("_found", F.filter(F.transform("_found", lambda s: _moved(s, label=earned(s))), lambda s: s["label"].isNotNull()))
    paths_like = lambda s: normalize.label_key(s["label"]).isin("filepath", "path", "sensitiveref", "uuid")
    part = lambda s: F.when(paths_like(s), let(value(s), lambda v: policy.path_part(s["label"], v, paths))).otherwise(F.struct(s["label"].alias("label"), F.lit(0).alias("skip"), (s["end"] - s["start"]).alias("length")))
    parts = F.filter(F.transform("_found", lambda s: F.struct(s.alias("s"), part(s).alias("p"))), lambda x: x["p"].isNotNull())
    narrow = lambda x: _moved(x["s"], x["s"]["start"] + x["p"]["skip"], x["s"]["start"] + x["p"]["skip"] + x["p"]["length"], x["p"]["label"])
    out = out.withColumn("_found", F.transform(parts, narrow))
    if spans:
        whole = lambda s: tagging.words_whole(body, s["start"], s["end"], s["label"])
        grown = lambda s: let(whole(s), lambda w: _moved(s, w["start"], w["end"]))
        out = out.withColumn("_found", F.transform("_found", lambda s: F.when(s["tier"] != 0, grown(s)).otherwise(s)))
    if denied:
        fields = ("start", "end", F.lit(fixed.CUSTOM_LABEL), F.lit(0), F.lit(1.0), F.lit("denylist"), F.lit(None).cast("string"), "value")
        custom = F.transform(policy.term_spans(body, denied), lambda s: F.struct(*(s[f] if isinstance(f, str) else f for f in fields)).cast(SPAN))
        out = out.withColumn("_found", F.concat("_found", custom))
    out = out.withColumn("_merged", merge.stitched(body, merge.merge(growth.propagate(body, F.col("_found")))))
    p = policy.MODES[mode]
    kept = lambda s: policy.allows(s["label"], p["enabled"], p["exclude"]) & ~validators.benign_hash(value(s)) & ~value(s).rlike(fixed.PLACEHOLDER)
    out = out.withColumn("_merged", F.filter("_merged", kept))
    if allowed:
        free = policy.forms([a.strip().lower() for a in allowed])
        hard = lambda s: s["label"].isin(*fixed.FLOOR_LABELS, fixed.CUSTOM_LABEL)
        exempt = lambda s: let(F.lower(F.trim(value(s))), lambda w: w.isin(*free) | policy.word_stem(w).isin(*free))
        out = out.withColumn("_merged", F.filter("_merged", lambda s: hard(s) | ~exempt(s)))
    out = pseudonyms.redact(out, "_merged", text)
    known = F.map_from_arrays(F.map_values("restore"), F.map_keys("restore"))
    labels = F.transform("_merged", lambda s: s["label"])
    counts = F.transform(F.array_sort(F.array_distinct(labels)), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x))))
    swept = F.when(F.size("restore") > 0, pseudonyms.swept(F.col("redacted"), known)).otherwise(F.col("redacted"))
    return out.select(*keep, swept.alias("redacted"), "restore", F.map_from_entries(counts).alias("found"))
