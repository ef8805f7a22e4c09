"""Making spans of names complete, and finding the same values elsewhere in a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import SPAN, let, matches
from . import names, pseudonyms

_INITIALS = re.compile(r"[A-Z](?:\.?[A-Z])*\.?")
_DOTTED = re.compile(r"[A-Z](?:\.[A-Z])*\.?")
_LEFT = re.compile(r"(?:[^\W\d_]['’.\-]?)*\Z")
_RIGHT = re.compile(r"(?:['’.\-]?[^\W\d_])*")


def _absorbs(token: str) -> bool:
    """A capitalised word, an initial or a particle, and no word of ledgers, roles or logs."""
    if not token or any(c.isdigit() or c == "/" for c in token):
        return False
    bare = token.strip(".,;:()'\"’-").casefold()
    if _DOTTED.fullmatch(token):
        return True
    if not bare or bare in fixed.LEDGER_STOP_WORDS | fixed.ROLE_WORDS | fixed.STATUS_WORDS:
        return False
    return bare in fixed.NAME_PARTICLES or bool(_INITIALS.fullmatch(token)) or (token[0].isupper() and "." not in token and re.sub("['’-]", "", token).isalpha())


def grown(text: str, start: int, end: int) -> tuple[int, int]:
    """The name around a span: cut words completed, then up to five words and 60 characters over single blanks."""
    a = start - len(_LEFT.search(text, 0, start)[0]) if text[start : start + 1].isalpha() else start
    b = end + len(_RIGHT.match(text, end)[0]) if text[end - 1 : end].isalpha() else end
    n = len(text[a:b].split())
    while n < names.MOST_WORDS and (m := re.compile(r" (\S+)").match(text, b)) and _absorbs(m[1]) and m.end() - a <= names.MOST_CHARS:
        b, n = m.end(), n + 1
    while n < names.MOST_WORDS and (m := re.compile(r"(?<!\s)(\S+) \Z").search(text, 0, a)) and _absorbs(m[1]) and b - m.start() <= names.MOST_CHARS:
        a, n = m.start(), n + 1
    ok = (a, b) != (start, end) and (names.proper if any(c.isupper() for c in text[start:end]) else names.loose)(text[a:b])
    return (a, b) if ok else (start, end)


def _grow(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t, s):
        if s["label"] != "person" or s["conf"] < fixed.PROPAGATED_CONF:
            return s
        a, b = grown(t, s["start"], s["end"])
        return s if (a, b) == (s["start"], s["end"]) else {**s, "start": a, "end": b, "rule": s["rule"] + "+grow", "value": t[a:b]}

    return pd.Series([[one(t, dict(s)) for s in xs] if xs is not None else None for t, xs in zip(text, spans, strict=True)])


def grow_persons(text: Column, spans: Column) -> Column:
    """Spans with persons grown. The UDF takes and returns the whole array: were it used around the UDF as well, the
    optimizer would repeat what makes it at each use."""
    return F.pandas_udf(_grow, f"array<{SPAN}>")(text, spans)


def propagate(text: Column, spans: Column) -> Column:
    """Every other occurrence of sure names, organisations, users and addresses, and of the words of a person's name: whole
    words, any case, at least four characters."""
    value = lambda s: F.trim(F.substring(text, s["start"] + 1, s["end"] - s["start"]))
    sure = F.filter(spans, lambda s: s["label"].isin(*fixed.PROPAGATED_LABELS) & (s["conf"] >= fixed.PROPAGATED_CONF) & (F.length(value(s)) >= fixed.LEAST_SWEPT))
    entry = lambda v, s: F.struct(F.lower(v).alias("key"), v.alias("value"), s["label"].alias("label"), s["conf"].alias("conf"), s["tier"].alias("tier"))
    words = lambda s: F.filter(F.split(value(s), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= fixed.LEAST_SWEPT) & ~F.lower(w).isin(*fixed.STATUS_WORDS))
    whole = F.transform(sure, lambda s: entry(value(s), s))
    parts = F.flatten(F.transform(F.filter(sure, lambda s: s["label"] == "person"), lambda s: F.transform(words(s), lambda w: entry(w, s))))

    def found(sources: Column) -> Column:
        pattern = F.concat(F.lit("(?iu)"), pseudonyms.pattern_of(F.transform(sources, lambda e: e["value"])))
        first = lambda m: F.get(F.filter(sources, lambda e: e["key"] == F.lower(m["value"])), F.lit(0))
        inside = lambda m: F.exists(sure, lambda s: (s["start"] <= m["start"]) & (m["start"] < s["end"]))
        hits = F.filter(matches(text, pattern), lambda m: ~inside(m) & first(m).isNotNull())
        return F.transform(hits, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), first(m)["label"].alias("label"), first(m)["tier"].alias("tier"), first(m)["conf"].alias("conf"), F.lit("repeat").alias("rule"), F.lit(None).cast("string").alias("validator"), m["value"].alias("value")))

    return F.when(F.size(sure) > 0, F.concat(spans, let(F.concat(whole, parts), found))).otherwise(spans)
