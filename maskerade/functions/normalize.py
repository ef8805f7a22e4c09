"""Length-preserving normalisation, so that places in the normalised text are places in the original."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


@cache
def _digits() -> tuple[str, str]:
    """Every other character that stands for one digit, and the ASCII digits that they stand for."""
    found = [(chr(i), str(unicodedata.digit(chr(i)))) for i in range(128, sys.maxunicode + 1) if unicodedata.digit(chr(i), None) is not None]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def dashes(text: Column) -> Column:
    return F.translate(text, fixed.DASHES, "-" * len(fixed.DASHES))


def spaces(text: Column) -> Column:
    return F.translate(text, fixed.SPACES, " " * len(fixed.SPACES))


def digits(text: Column) -> Column:
    return F.translate(text, *_digits())


def separators(text: Column) -> Column:
    """Dashes, spaces and digits in one pass; text that is ASCII already is left alone."""
    a, b = _digits()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, fixed.DASHES + fixed.SPACES + a, "-" * len(fixed.DASHES) + " " * len(fixed.SPACES) + b)).otherwise(text)


def capitals(text: Column) -> Column:
    """Runs of two and more capitals in title case, of the same length."""
    pieces = F.split(text, r"(?<=[A-ZÀ-ÖØ-Þ])(?![A-ZÀ-ÖØ-Þ])|(?<![A-ZÀ-ÖØ-Þ])(?=[A-ZÀ-ÖØ-Þ])")
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^[A-ZÀ-ÖØ-Þ]{2,}$"), F.concat(F.substring(p, 1, 1), F.lower(p.substr(F.lit(2), F.length(p))))).otherwise(p)), "")


def without_invisible(text: Column) -> Column:
    """Format and control characters removed."""
    return F.regexp_replace(text, r"[\p{Cf}\p{Cc}]", "")


def label_key(label: Column) -> Column:
    """A label or placeholder name in its one spelling for comparison."""
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def value_key(value: Column, label: Column) -> Column:
    """What makes two values one in a map: trimmed, inner white space collapsed, lower case unless the label is case-sensitive."""
    plain = F.regexp_replace(F.trim(value), r"\s+", " ")
    return F.when(label.isin(*fixed.CASE_SENSITIVE_LABELS), plain).otherwise(F.lower(plain))


def _composed(text: pd.Series) -> pd.DataFrame:
    """NFC of each text, and where in the text each of its characters begins (and the last one ends)."""
    rows = []
    for t in text:
        t = t or ""
        # a character and the combining ones after it (Hangul vowels and finals too) normalise on their own
        cut = [i for i, c in enumerate(t) if not i or not (unicodedata.combining(c) or 0x1160 <= ord(c) <= 0x11FF)]
        parts = [unicodedata.normalize("NFC", t[i:j]) for i, j in zip(cut, [*cut[1:], len(t)], strict=False)]
        rows.append(("".join(parts), [i for i, p in zip(cut, parts, strict=True) for _ in p] + [len(t)]))
    return pd.DataFrame(rows, columns=["text", "places"])


def composed(text: Column) -> Column:
    """Canonical composition with the way back: struct (text, places), of an empty text where nothing is left to compose."""
    return F.pandas_udf(_composed, "text string, places array<int>")(F.when(text.rlike(r"[\p{M}\u1160-\u11FF]"), text).otherwise(""))


def nfc(text: Column) -> Column:
    """Canonical composition; Python sees only texts that have something to compose."""
    return F.when(text.rlike(r"[\p{M}\u1160-\u11FF]"), composed(text)["text"]).otherwise(text)
