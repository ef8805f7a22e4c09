"""Span sets: union of overlapping spans, stitching, clipping, activity.

``merge`` works on an array of spans inside a row, without a shuffle; ``merge_rows`` on a table of spans, with one
shuffle on its keys. Both sort by start, longer first, order of emission last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import let

_FACE = "struct<label:string,tier:int,rule:string,validator:string>"
MERGED = "array<struct<start:int,end:int,label:string,tier:int,conf:double,rule:string,validator:string,members:int,labels:array<string>>>"


def floor(label: Column) -> Column:
    return label.isin(*fixed.FLOOR_LABELS)


def merge(spans: Column) -> Column:
    """Clusters of overlapping spans; spans that only touch stay apart.

    The face of a cluster is that of its surest (then longest, then first) member, but a floor label isn't lost to a
    softer one: then the face is that of the surest floor member.
    """

    def face(s: Column) -> Column:
        return F.struct(s["label"].alias("label"), s["tier"].alias("tier"), s["rule"].alias("rule"), s["validator"].alias("validator"))

    def lone(s: Column) -> Column:
        hard = floor(s["label"])
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["conf"].alias("conf"),
            F.lit(1).alias("members"),
            F.array(s["label"]).alias("labels"),
            s["conf"].alias("best"),
            (s["end"] - s["start"]).alias("length"),
            face(s).alias("face"),
            F.when(hard, s["conf"]).otherwise(-1.0).alias("hard_best"),
            F.when(hard, face(s)).otherwise(F.lit(None).cast(_FACE)).alias("hard"),
        )

    def joined(c: Column, s: Column) -> Column:
        n = s["end"] - s["start"]
        better = (s["conf"] > c["best"]) | ((s["conf"] == c["best"]) & (n > c["length"]))
        harder = floor(s["label"]) & (s["conf"] > c["hard_best"])
        return F.struct(
            c["start"].alias("start"),
            F.greatest(c["end"], s["end"]).alias("end"),
            F.greatest(c["conf"], s["conf"]).alias("conf"),
            (c["members"] + 1).alias("members"),
            F.array_union(c["labels"], F.array(s["label"])).alias("labels"),
            F.when(better, s["conf"]).otherwise(c["best"]).alias("best"),
            F.when(better, n).otherwise(c["length"]).alias("length"),
            F.when(better, face(s)).otherwise(c["face"]).alias("face"),
            F.when(harder, s["conf"]).otherwise(c["hard_best"]).alias("hard_best"),
            F.when(harder, face(s)).otherwise(c["hard"]).alias("hard"),
        )

    def step(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        return (
            F.when(cur.isNull(), F.struct(acc["out"].alias("out"), lone(s).alias("cur")))
            .when(s["start"] < cur["end"], F.struct(acc["out"].alias("out"), joined(cur, s).alias("cur")))
            .otherwise(F.struct(F.concat(acc["out"], F.array(cur)).alias("out"), lone(s).alias("cur")))
        )

    def elected(c: Column) -> Column:
        f = F.when(~floor(c["face"]["label"]) & c["hard"].isNotNull(), c["hard"]).otherwise(c["face"])
        return let(
            f,
            lambda f: F.struct(
                c["start"].alias("start"), c["end"].alias("end"), f["label"].alias("label"), f["tier"].alias("tier"), c["conf"].alias("conf"), f["rule"].alias("rule"), f["validator"].alias("validator"),
                c["members"].alias("members"), F.when(F.size(c["labels"]) > 1, F.array_sort(c["labels"])).alias("labels"),
            ),
        )

    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("shorter"), i.alias("seq"), s["end"].alias("end"), s["label"].alias("label"), s["tier"].alias("tier"), s["conf"].alias("conf"), s["rule"].alias("rule"), s["validator"].alias("validator"))))
    cluster = f"struct<start:int,end:int,conf:double,members:int,labels:array<string>,best:double,length:int,face:{_FACE},hard_best:double,hard:{_FACE}>"
    start = F.struct(F.array().cast(f"array<{cluster}>").alias("out"), F.lit(None).cast(cluster).alias("cur"))
    done = F.aggregate(ordered, start, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    return F.transform(done, elected).cast(MERGED)


def merge_rows(spans: DataFrame, *keys: str) -> DataFrame:
    """The same for a table (keys, seq, start, end, label, tier, conf, rule, validator): running greatest end, islands, elections."""
    order = Window.partitionBy(*keys).orderBy("start", F.col("start") - F.col("end"), "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", (before.isNull() | (F.col("start") >= before)).cast("int")).withColumn("_at", F.row_number().over(order))
    rows = rows.withColumn("_cluster", F.sum("_new").over(order))
    face, length = F.struct("label", "tier", "rule", "validator"), F.col("end") - F.col("start")
    hard = F.when(floor(F.col("label")), F.struct("conf", -F.col("_at")))
    made = rows.groupBy(*keys, "_cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("conf").alias("conf"), F.count("*").cast("int").alias("members"), F.sort_array(F.collect_set("label")).alias("labels"),
        F.max_by(face, F.struct("conf", length, -F.col("_at"))).alias("_face"), F.max_by(face, hard).alias("_hard"),
    )
    f = F.when(~floor(F.col("_face.label")) & F.col("_hard").isNotNull(), F.col("_hard")).otherwise(F.col("_face"))
    made = made.withColumn("_f", f)
    return made.select(*keys, "start", "end", "_f.label", "_f.tier", "conf", "_f.rule", "_f.validator", "members", F.when(F.size("labels") > 1, F.col("labels")).alias("labels"))


def stitch_addresses(spans: DataFrame, text: str, *keys: str, gap: int = 12) -> DataFrame:
    """Joins an address with the addresses and postal codes that follow it behind at most ``gap`` letters and separators.

    ``spans`` has the text of each span's document in ``text``; in order of start, a run grows from an address.
    """
    order = Window.partitionBy(*keys).orderBy("start", "seq")
    last = F.lag("end").over(order)
    between = F.expr(f"substring({text}, _last + 1, greatest(start - _last, 0))")
    rows = spans.withColumn("_last", last).withColumn("_before", F.lag("label").over(order))
    near = F.col("_before").isin("address", "postal_code") & F.col("label").isin("address", "postal_code") & (F.length(between) <= gap) & between.rlike(r"^[\s,\-()A-Za-z]*\z")
    rows = rows.withColumn("_joins", F.coalesce(near, F.lit(False)))
    # a postal code joins, but a run can only begin at an address
    rows = rows.withColumn("_run", F.sum((~F.col("_joins")).cast("int")).over(order))
    rows = rows.withColumn("_first", F.first("label").over(Window.partitionBy(*keys, "_run").orderBy("start", "seq")))
    group = F.when(F.col("_first") == "address", F.lit(-1)).otherwise(F.col("seq"))
    made = rows.groupBy(*keys, "_run", group.alias("_each")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", "start").alias("label"), F.min("conf").alias("conf"))
    return made.select(*keys, "start", "end", "label", "conf")


def stitched(text: Column, spans: Column, gap: int = 12) -> Column:
    """``stitch_addresses`` for the array of merged spans in order; a run keeps the other fields of the address it begins with."""
    both = ("address", "postal_code")

    def step(acc: Column, s: Column) -> Column:
        def with_last(last: Column) -> Column:
            between = F.substring(text, last["end"] + 1, F.greatest(s["start"] - last["end"], F.lit(0)))
            joins = (last["label"] == "address") & s["label"].isin(*both) & (F.length(between) <= gap) & between.rlike(r"^[\s,\-()A-Za-z]*\z")
            grown = last.withField("end", F.greatest(last["end"], s["end"])).withField("conf", F.least(last["conf"], s["conf"])).withField("members", last["members"] + s["members"])
            return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

        return F.when(F.size(acc) == 0, F.array(s)).otherwise(let(F.element_at(acc, -1), with_last))

    # most documents have no address, and none is looked at twice
    return F.when(F.exists(spans, lambda s: s["label"] == "address"), F.aggregate(spans, F.array().cast(MERGED), step)).otherwise(spans)


def clip_inactive(spans: DataFrame, *keys: str) -> DataFrame:
    """What is left of inactive spans between the active ones: interval difference, as gaps of a sweep over edges."""
    active = spans.filter("active")
    edges = active.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"))
    order = Window.partitionBy(*keys).orderBy("s", "e")
    edges = edges.withColumn("_high", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    free = edges.filter("_high is not null and s > _high").select(*keys, F.col("_high").alias("a"), F.col("s").alias("b"))
    ends = edges.groupBy(*keys).agg(F.min("s").alias("_low"), F.max("e").alias("_top"))
    outer = ends.select(*keys, F.lit(-1).alias("a"), F.col("_low").alias("b")).unionByName(ends.select(*keys, F.col("_top").alias("a"), F.lit(2147483647).alias("b")))
    gaps = free.unionByName(outer)
    idle = spans.filter("not active")
    whole = idle.join(ends, list(keys), "left_anti").select(*keys, "seq", "label", "start", "end", F.lit(False).alias("active"))
    cut = idle.join(gaps, list(keys)).select(*keys, "seq", "label", F.greatest("start", "a").alias("start"), F.least("end", "b").alias("end"), F.lit(False).alias("active")).filter("start < end")
    return active.select(*keys, "seq", "label", "start", "end", "active").unionByName(whole).unionByName(cut)


def activity(spans: DataFrame) -> DataFrame:
    """Spans and active spans of each label, most first."""
    return spans.groupBy("label").agg(F.count("*").alias("total"), F.count_if("active").alias("active")).orderBy(F.desc("total"), "label")


def with_manual(auto: DataFrame, manual: DataFrame, *keys: str) -> DataFrame:
    """Spans of both tables (keys, seq, start, end, label, active): a manual span that is active blocks the automatic ones it overlaps."""
    m = manual.filter("active").select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    same = [F.col(f"a.{k}") == F.col(f"m.{k}") for k in keys]
    hit = (F.col("a.start") < F.col("m._e")) & (F.col("m._s") < F.col("a.end"))
    for c in same:
        hit = hit & c
    free = auto.alias("a").join(m.alias("m"), hit, "left_anti")
    return free.withColumn("source", F.lit("auto")).unionByName(manual.withColumn("source", F.lit("manual")))


def explained(spans: DataFrame) -> DataFrame:
    """Where spans come from, without their values: what may be logged."""
    keep = [c for c in spans.columns if c not in ("value", "text")]
    return spans.select(*(F.round("conf", 3).alias("conf") if c == "conf" else F.col(c) for c in keep))
