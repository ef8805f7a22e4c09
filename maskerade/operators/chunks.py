"""Cutting long texts into windows that a model takes whole."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 600, 80
_CUTS = "array<struct<start:int,end:int>>"


def window_cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of ``size`` characters that overlap, each ending at the last blank of its overlap if there is one."""
    out, at = [], 0
    while True:
        end = min(at + size, len(text))
        if end < len(text):
            blank = text.rfind(" ", max(at + size - overlap, at + 1), end)
            end = blank if blank >= 0 else end
        out.append((at, end))
        if end >= len(text):
            return out
        at = max(end - overlap, at + 1)


def line_cuts(text: str, size: int = SIZE) -> list[tuple[int, int]]:
    """Whole lines packed up to ``size``; a longer one stands alone."""
    out, start, end, alone = [], 0, 0, False
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        n = len(line)
        if end > start and (alone or n > size or end - start + n > size):
            out.append((start, end))
            start = end
        end, alone = end + n, n > size
    return [*out, (start, end)] if end > start else out


def _cutting(cut: Callable[[str], list[tuple[int, int]]]) -> Callable[[Column], Column]:
    """Where one cut goes depends on the one before: texts are walked once, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"start": a, "end": b} for a, b in cut(t)])

    return F.pandas_udf(run, _CUTS)


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of (start, end) of ``window_cuts``."""
    return _cutting(lambda t: window_cuts(t, size, overlap))(text)


def packed_lines(text: Column, size: int = SIZE) -> Column:
    """Array of (start, end) of ``line_cuts``; a line that stands alone is to be cut by ``windows``."""
    return _cutting(lambda t: line_cuts(t, size))(text)


def chunked(docs: DataFrame, key: str, text: str = "text", cuts: Column | None = None) -> DataFrame:
    """A row for each chunk: key, chunk_no, start, chunk."""
    cut = docs.select(key, F.col(text).alias("_t"), (windows(F.col(text)) if cuts is None else cuts).alias("_cuts"))
    rows = cut.select(key, "_t", F.posexplode_outer("_cuts").alias("chunk_no", "_c")).filter("_c is not null")
    return rows.select(key, F.col("chunk_no").cast("int"), F.col("_c.start").alias("start"), F.expr("substring(_t, _c.start + 1, _c.end - _c.start)").alias("chunk"))


def prose(text: Column) -> Column:
    """Natural language: eight words or more, three in five with a letter, few signs of code."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    lettered = F.size(F.filter(words, lambda w: w.rlike(r"\p{L}")))
    signs = F.length(text) - F.length(F.translate(text, "{}[]()<>=;+*/\\|&%$#@~`", ""))
    return (F.size(words) >= 8) & (lettered >= F.size(words) * 0.6) & (signs <= F.length(text) * 0.03)
