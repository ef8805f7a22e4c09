"""JSON bodies as rows: every leaf with its path, its key and the kind of value that it is.

One pass over a body's text in Arrow batches: VARIANT would refuse duplicate keys, and read the body again for each
level. Any depth is walked, duplicate keys are leaves each, and strings that hold JSON themselves are opened. Nothing
is passed over: a body that can't be parsed is one leaf, its whole text.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import fixed
from . import secrets

#: Keys that route or structure a request and never hold text of a user.
STRUCTURAL = ("type", "role", "model", "id", "object", "index", "status", "finish_reason", "stop_reason", "encrypted_content", "signature", "media_type")


class Pairs(list):
    """An object as its pairs, in order and with duplicates."""


class Number(str):
    """A number as it is written."""


def parsed(text: str):
    """The node, or None where the text is no JSON, or nested too deep to tell."""
    try:
        return json.loads(text, object_pairs_hook=Pairs, parse_int=Number, parse_float=Number, parse_constant=Number)
    except (ValueError, RecursionError):
        return None


def opened(value) -> Pairs | list | None:
    """The container that a string holds, if it does."""
    if isinstance(value, str) and not isinstance(value, Number) and value.lstrip()[:1] in ("{", "["):
        inner = parsed(value)
        return inner if isinstance(inner, list) else None
    return None


def _leaves(body: str, open_strings: bool) -> Iterator[tuple[str, str | None, str | None, str]]:
    root = parsed(body)
    if root is None and body.strip() != "null":
        yield "$", None, body, "string"
        return
    todo: list[tuple[str, str | None, object]] = [("$", None, root)]
    while todo:
        path, name, node = todo.pop()
        inner = opened(node) if open_strings else None
        node = node if inner is None else inner
        if isinstance(node, Pairs):
            todo += [(f"{path}.{k}", k, v) for k, v in reversed(node)]
        elif isinstance(node, list):
            todo += [(f"{path}[{i}]", name, v) for i, v in reversed(list(enumerate(node)))]
        elif node is None:
            yield path, name, None, "null"
        elif isinstance(node, bool):
            yield path, name, str(node).lower(), "boolean"
        else:
            yield path, name, str(node), "number" if isinstance(node, Number) else "string"


def by_body(bodies: DataFrame, key: str, body: str, columns: list[str], rows: Callable[[str], Iterator[tuple]], most: int = 20_000) -> DataFrame:
    """``rows`` of text columns for each body that isn't null, beside its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            whose: list[int] = []

            def table():
                parts = [batch.column(0).take(pa.array(whose, pa.int64()))]  # noqa: B023
                parts += [pa.array(c, pa.string()) for c in (zip(*held, strict=True) if held else [()] * len(columns))]  # noqa: B023
                return pa.RecordBatch.from_arrays(parts, names=[key, *columns])

            for i, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    for row in rows(text):
                        held.append(row)
                        whose.append(i)
                        if len(held) >= most:
                            yield table()
                            held.clear()
                            whose.clear()
            yield table()

    schema = StructType([bodies.schema[key], *(StructField(c, StringType()) for c in columns)])
    return bodies.select(key, body).mapInArrow(run, schema)


def leaves(bodies: DataFrame, key: str, body: str = "body", open_strings: bool = True) -> DataFrame:
    """(key, path, name, value, kind) of scalars; value as text; kind is string, number, boolean or null."""
    return by_body(bodies, key, body, ["path", "name", "value", "kind"], lambda text: _leaves(text, open_strings))


def fields(walked: DataFrame) -> DataFrame:
    """Leaves that may hold text of a user: strings and numbers, but for structural keys and ids."""
    structural = F.col("name").isin(*STRUCTURAL) | F.col("name").rlike("_id$")
    return walked.filter(F.col("kind").isin("string", "number") & ~F.coalesce(structural, F.lit(False)))


def keyed(walked: DataFrame) -> DataFrame:
    """Leaves under sensitive keys, with their labels: redacted whatever they look like, but for ones that are already."""
    label = secrets.key_label(F.col("name"))
    return walked.filter(F.col("kind").isin("string", "number") & (F.trim("value") != "") & ~F.col("value").rlike(fixed.PLACEHOLDER)).withColumn("label", label).filter("label is not null")
