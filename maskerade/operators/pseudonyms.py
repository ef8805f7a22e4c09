"""Placeholders for values: minting, substitution, sweeping known values, restoring.

A document's own map needs no shuffle. A session's map is a table: numbers follow the first appearance of a value in
(turn, place), which a window over the session's values gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, normalize, validators
from ..functions.spans import let


def number(n: Column) -> Column:
    """Three digits, or as many as it takes."""
    return F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))


def placeholder(label: Column, n: Column, underscores: bool = True) -> Column:
    """<PAYMENT_CARD_001> in documents, <PAYMENTCARD_001> in sessions."""
    name = F.upper(label) if underscores else F.upper(F.regexp_replace(label, "[^A-Za-z0-9]", ""))
    return F.concat(F.lit("<"), name, F.lit("_"), number(n), F.lit(">"))


def minted(text: Column, spans: Column) -> Column:
    """Spans of one document with ``key`` and ``placeholder``: numbered by label in order of first appearance."""
    value = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), value(s).alias("value"), normalize.value_key(value(s), s["label"]).alias("key")))

    def numbered(all_: Column) -> Column:
        same = lambda a, b: (a["label"] == b["label"]) & (a["key"] == b["key"])
        first = F.filter(all_, lambda s, i: ~F.exists(F.slice(all_, 1, i), lambda x: same(x, s)))

        def each(firsts: Column) -> Column:
            def one(s: Column) -> Column:
                mine = F.get(F.filter(firsts, lambda f: same(f, s)), F.lit(0))["start"]
                n = F.size(F.filter(firsts, lambda f: (f["label"] == s["label"]) & (f["start"] <= mine)))
                return s.withField("placeholder", placeholder(s["label"], n))

            return F.transform(all_, one)

        return let(first, each)

    return F.when(F.size(spans) > 0, let(keyed, numbered)).otherwise(F.array().cast("array<struct<start:int,end:int,label:string,value:string,key:string,placeholder:string>>"))


def substituted(text: Column, spans: Column) -> Column:
    """The text with placeholders instead of spans, in one pass from the left."""

    def step(acc: Column, s: Column) -> Column:
        moved = F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["placeholder"]).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(moved)

    end = lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text)))
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, end)


def mapping(spans: Column) -> Column:
    """Placeholder -> first value."""
    pairs = F.transform(spans, lambda s: F.struct(s["placeholder"], s["value"]))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda x: x["placeholder"] == p["placeholder"]))
    return F.map_from_entries(first)


def restored(text: Column, values: Column) -> Column:
    """The text with values instead of placeholders that the map has; one pass, exact names."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(fixed.PLACEHOLDER), F.lit(0)).alias("m"), F.split(text, fixed.PLACEHOLDER, -1).alias("g"))

    def joined(x: Column) -> Column:
        put = F.transform(x["m"], lambda m: F.coalesce(F.try_element_at(values, m), m))
        return F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(F.get(put, i), F.lit("")))), "")

    return F.when(text.rlike(fixed.PLACEHOLDER), let(parts, joined)).otherwise(text)


def pattern_of(values: Column) -> Column:
    """A pattern for known values of at least four characters: whole words, longest first."""
    long = F.filter(F.array_distinct(values), lambda v: F.length(v) >= fixed.LEAST_SWEPT)
    ordered = F.array_sort(F.transform(long, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    quoted = F.transform(ordered, lambda s: F.regexp_replace(s["v"], r"([^\p{L}\p{N}_ ])", r"\\$1"))
    return F.when(F.size(long) > 0, F.concat(F.lit(f"{fixed.NOT_AFTER_WORD}(?:"), F.array_join(quoted, "|"), F.lit(f"){fixed.NOT_BEFORE_WORD}")))


def swept(text: Column, known: Column) -> Column:
    """Text between placeholders with every known value replaced. ``known`` maps values to placeholders."""
    pattern = pattern_of(F.map_keys(known))
    both = F.concat(F.lit(fixed.PLACEHOLDER + "|"), pattern)  # placeholders match first and stay
    parts = F.struct(F.regexp_extract_all(text, both, F.lit(0)).alias("m"), F.split(text, both, -1).alias("g"))

    def joined(x: Column) -> Column:
        put = F.transform(x["m"], lambda m: F.coalesce(F.try_element_at(known, m), m))
        return F.array_join(F.transform(x["g"], lambda g, i: F.concat(g, F.coalesce(F.get(put, i), F.lit("")))), "")

    return F.when(pattern.isNull(), text).otherwise(let(parts, joined))


def redact(docs: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Adds redacted text and the map that restores it, from merged spans."""
    out = docs.withColumn("_minted", minted(F.col(text), F.col(spans)))
    return out.select(*docs.columns, substituted(F.col(text), F.col("_minted")).alias("redacted"), mapping(F.col("_minted")).alias("restore"))


def session_map(values: DataFrame) -> DataFrame:
    """The map of each session from (session, turn, start, label, value): number, placeholder, first turn, value.

    Values of one key are one entry, the first spelling standing for all.
    """
    keyed = values.withColumn("key", normalize.value_key(F.col("value"), F.col("label")))
    first = keyed.groupBy("session", "label", "key").agg(F.min(F.struct("turn", "start")).alias("at"), F.min_by("value", F.struct("turn", "start")).alias("value"), F.count("*").alias("uses"))
    # a value keeps the label that it was first given
    owner = Window.partitionBy("session", "key").orderBy("at", "label")
    first = first.withColumn("_owner", F.row_number().over(owner)).filter("_owner = 1")
    n = F.row_number().over(Window.partitionBy("session", "label").orderBy("at", "key"))
    return first.withColumn("n", n).select("session", "label", "value", "key", F.col("at.turn").alias("first_turn"), "n", placeholder(F.col("label"), F.col("n"), underscores=False).alias("placeholder"), "uses")


def kept(entries: DataFrame, cap: int) -> DataFrame:
    """Entries that survive first-in first-out eviction; numbers are never given again."""
    return entries.withColumn("_late", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("first_turn"), F.desc("n"), F.desc("label")))).filter(F.col("_late") <= cap).drop("_late")


def tool_map(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Entries that may be restored inside the arguments of executed tools.

    Floor classes and sensitive_ref stay literal, but for identities whose value is a UUID or a path. Strict: none.
    """
    if strict:
        return entries.limit(0)
    key = normalize.label_key(F.regexp_extract("placeholder", r"^<([A-Z][A-Z0-9_]*)_\d{3,}>$", 1))
    canon = [x.replace("_", "") for x in (*fixed.FLOOR_LABELS, "sensitive_ref")]
    identity = key.isin("sensitiveaccountid", "accountnumber", "sensitiveref") & (F.col("value").rlike(f"^{fixed.UUID}$") | validators.path_shaped(F.col("value")))
    return entries.filter((key != "") & (~key.isin(*canon) | identity))


def placeholders(text: Column) -> Column:
    """Distinct placeholders of a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.PLACEHOLDER), F.lit(0))))


def session_id(header: Column, system: Column, tenant: Column | None = None) -> Column:
    """The header, or a hash of the system prompt, or null for a session of its own."""
    hashed = F.concat(F.lit("sys-"), F.coalesce(F.concat(tenant, F.lit("-")), F.lit("")) if tenant is not None else F.lit(""), F.substring(F.sha2(system, 256), 1, 32))
    return F.coalesce(F.nullif(F.trim(header), F.lit("")), F.when(F.length(F.trim(system)) > 0, hashed))



def restored_whole(text: Column, values: Column) -> Column:
    """Restored text; fails if a placeholder is left that the map lacks."""
    lacking = F.filter(placeholders(text), lambda p: ~F.array_contains(F.map_keys(values), p))
    return F.when(F.size(lacking) > 0, F.raise_error(F.concat(F.lit("no value for "), F.array_join(lacking, ", ")))).otherwise(restored(text, values))


def frozen(texts: DataFrame, memo: DataFrame, compute) -> DataFrame:
    """Redacted texts (session, text, redacted): from the memo (session, hash, redacted) if it has the text's hash, computed
    by ``compute`` otherwise, so that what a turn was first sent as is what it is always sent as."""
    keyed = texts.withColumn("hash", F.sha2("text", 256))
    known = keyed.join(memo.select("session", "hash", "redacted"), ["session", "hash"])
    new = compute(keyed.join(memo, ["session", "hash"], "left_anti"))
    return known.select("session", "text", "redacted").unionByName(new.select("session", "text", "redacted"))
