"""Office files: the text of DOCX and XLSX files read in place of the file, and written back redacted.

Files come from ``binaryFile``; a file is a ZIP of XML parts, rewritten part by part in an Arrow UDF. Metadata parts and
comments go, and a file that still shows a value that it shouldn't fails.
"""

from __future__ import annotations

import io
import re
import xml.sax.saxutils as sax
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BODY = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml|xl/(?:sharedStrings|worksheets/sheet\d+)\.xml")
_DROPPED = re.compile(r"docProps/.*|word/comments.*\.xml|xl/comments.*\.xml|xl/threadedComments/.*")
_TEXT = re.compile(r"(<(?:w:|x:)?t(?:\s[^>]*)?>)([^<]*)(</(?:w:|x:)?t>)")
_PARAGRAPH = re.compile(r"</w:p>|</si>|</row>|</is>")
_DELETED = re.compile(r"<w:del\b.*?</w:del>", re.DOTALL)


def text_of(data: bytes) -> str:
    """Text of the body parts in order, a line for each paragraph, shared string or row."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if _BODY.fullmatch(name):
                xml = _DELETED.sub("", z.read(name).decode())
                lines = ("".join(m[2] for m in _TEXT.finditer(part)) for part in _PARAGRAPH.split(xml))
                out += [sax.unescape(x, {"&quot;": '"', "&apos;": "'"}) for x in lines if x]
    return "\n".join(out)


def rewritten(data: bytes, values: dict[str, str]) -> bytes:
    """The file with values replaced in every run of text, tracked deletions, comments and metadata gone."""
    known = sorted((v for v in values if v), key=len, reverse=True)
    pattern = re.compile("|".join(map(re.escape, known))) if known else None
    swap = lambda s: pattern.sub(lambda m: values[m[0]], s) if pattern else s
    made = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as out:
        for name in z.namelist():
            if _DROPPED.fullmatch(name):
                continue
            part = z.read(name)
            if _BODY.fullmatch(name):
                xml = _DELETED.sub("", part.decode())
                plain = lambda m: m[1] + sax.escape(swap(sax.unescape(m[2], {"&quot;": '"', "&apos;": "'"}))) + m[3]
                part = _TEXT.sub(plain, xml).encode()
            out.writestr(name, part)
    data = made.getvalue()
    shown = text_of(data)
    if any(v in shown for v in known if v not in values.values()):
        raise ValueError("a value is cut across runs of text and would stay readable")
    return data


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, content, text of office files."""
    texts = F.pandas_udf(lambda data: data.map(text_of), "string")
    return spark.read.format("binaryFile").load(path).select("path", "content", texts("content").alias("text"))


def written(content: Column, values: Column) -> Column:
    """Content with values (value -> placeholder, or back) replaced."""
    swap = lambda c, v: pd.Series([rewritten(bytes(a), dict(b or {})) for a, b in zip(c, v, strict=True)])
    return F.pandas_udf(swap, "binary")(content, values)
