"""The span primitive: where a pattern matches, in code points, from built-in expressions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,tier:int,conf:double,rule:string,validator:string,value:string>"



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass
class Match:
    """A match inside a text: columns for its value and place."""

    text: Column
    value: Column
    start: Column
    end: Column

    def before(self, n: int) -> Column:
        k = F.least(self.start, F.lit(n))
        return F.substring(self.text, self.start - k + 1, k)

    def after(self, n: int) -> Column:
        return F.substring(self.text, self.end + 1, F.lit(n))

    def glued(self) -> Column:
        """A letter directly before or behind."""
        return self.before(1).rlike(r"^\p{L}") | self.after(1).rlike(r"^\p{L}")


@dataclass(frozen=True, eq=False)
class Rule:
    """A detection rule. ``label``, ``conf`` and ``validator`` may depend on the match; ``keep`` filters matches.

    With ``group`` 1 the pattern ends in that group (and lookaheads), and only the group is the span.
    """

    name: str
    pattern: str
    label: str | Callable[[Match], Column]
    conf: float | Callable[[Match], Column]
    keep: Callable[[Match], Column] | None = None
    validator: Callable[[Match], Column] | None = None
    group: int = 0
    rename: Callable[[Match], Column] | None = None


#: Numbers that one fold sums up: an array is copied for each.
_FOLD = 128


def running(numbers: Column) -> Column:
    """The sum of the numbers before each, in blocks, so that a long array isn't copied once for each of its entries."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / _FOLD).cast("int"))
    block = lambda b: F.slice(numbers, b * _FOLD + 1, F.lit(_FOLD))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, n: acc + n)

    def within(totals: Column) -> Column:
        def one(b: Column) -> Column:
            start = F.struct(total(F.slice(totals, F.lit(1), b)).alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
            return F.aggregate(block(b), start, step, lambda acc: acc["out"])

        return F.flatten(F.transform(blocks, one))

    return F.when(F.size(numbers) > 0, let(F.transform(blocks, lambda b: total(block(b))), within)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches; the pattern may differ by row, null matching nothing."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("g"),
    )

    def placed(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            end = acc["at"] + F.length(x["g"][i]) + F.length(x["m"][i])
            span = F.struct((end - F.length(x["v"][i])).cast("int").alias("start"), end.cast("int").alias("end"), x["v"][i].alias("value"))
            return F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, step, lambda acc: acc["out"])

    return F.when(F.rlike(text, pattern), let(found, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def scan(text: Column, rule: Rule) -> Column:
    """Array of spans of a rule."""
    value = lambda x, m: x(m) if callable(x) else F.lit(x)

    def build(s: Column) -> Column:
        m = Match(text, s["value"], s["start"], s["end"])
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            value(rule.label, m).alias("label"),
            F.lit(0).alias("tier"),
            value(rule.conf, m).cast("double").alias("conf"),
            (rule.rename(m) if rule.rename else F.lit(rule.name)).alias("rule"),
            (rule.validator(m) if rule.validator else F.lit(None).cast("string")).alias("validator"),
            s["value"].alias("value"),
        )

    found = matches(text, rule.pattern, rule.group)
    if rule.keep:
        found = F.filter(found, lambda s: rule.keep(Match(text, s["value"], s["start"], s["end"])))
    return F.transform(found, build).cast(f"array<{SPAN}>")
