"""Writing values back into JSON bodies: redaction and restoring of strings, numbers under sensitive keys, JSON in strings,
files in base64. Renaming keys and keeping key order and duplicates needs the text of the body itself: an Arrow UDF."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed
from .secrets import label_of
from .walk import STRUCTURAL, Pairs

_PLACEHOLDER = re.compile(fixed.PLACEHOLDER)
_TEXT_FILE = re.compile(r"data:(?:text/[\w.+-]+|application/(?:json|xml|csv|x-yaml))(?:;[\w=.-]+)*;base64,")
#: Blocks that are signed or opaque and pass as they are.
OPAQUE = ("thinking", "redacted_thinking")


def parse(body: str):
    return json.loads(body, object_pairs_hook=Pairs)


def dump(node) -> str:
    if isinstance(node, Pairs):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {dump(v)}" for k, v in node) + "}"
    if isinstance(node, list):
        return "[" + ", ".join(map(dump, node)) + "]"
    return json.dumps(node, ensure_ascii=False)


def rewritten(node, text: Callable[[str], str], forced: Callable[[str, str], str] | None = None, keys: bool = False):
    """The node with every text of a user rewritten. ``forced`` gives what stands for a value under a sensitive key;
    ``keys`` rewrites keys too, a second key of the same name becoming name.dup1."""
    if isinstance(node, Pairs):
        if dict(node).get("type") in OPAQUE:
            return node
        out, used = Pairs(), {}
        for k, v in node:
            name = text(k) if keys else k
            if keys and name != k and name in used:
                used[name] += 1
                name = f"{name}.dup{used[name]}"
            used.setdefault(name, 0)
            label = label_of(k) if forced else None
            if label and isinstance(v, (str, int, float)) and not isinstance(v, bool) and str(v).strip() and not _PLACEHOLDER.search(str(v)):
                out.append((name, forced(str(v), label)))
            elif k in STRUCTURAL or k.endswith("_id"):
                out.append((name, v))
            else:
                out.append((name, rewritten(v, text, forced, keys)))
        return out
    if isinstance(node, list):
        return [rewritten(v, text, forced, keys) for v in node]
    if not isinstance(node, str):
        return node
    if node.lstrip()[:1] in ("{", "["):
        try:
            inner = parse(node)
        except ValueError:
            inner = None
        if inner is not None:
            new = rewritten(inner, text, forced, keys)
            return dump(new) if new != inner else node
    if m := _TEXT_FILE.match(node):
        try:
            plain = base64.b64decode(node[m.end() :], validate=True).decode()
        except ValueError:
            return node
        new = text(plain)
        return m[0] + base64.b64encode(new.encode()).decode() if new != plain else node
    return text(node)


def _replaced(values: dict[str, str]) -> Callable[[str], str]:
    known = sorted((v for v in values if v), key=len, reverse=True)
    if not known:
        return lambda s: s
    pattern = re.compile("|".join(map(re.escape, known)))
    return lambda s: pattern.sub(lambda m: values[m[0]], s)


def _redacted(body: pd.Series, known: pd.Series) -> pd.Series:
    def one(text, pairs):
        if text is None:
            return None
        values = dict(pairs or {})
        count: dict[str, int] = {}
        for p in values.values():
            name, _, n = p[1:-1].rpartition("_")
            count[name] = max(count.get(name, 0), int(n))

        def forced(value: str, label: str) -> str:
            name = label.replace("_", "").upper()
            if value not in values:
                count[name] = count.get(name, 0) + 1
                values[value] = f"<{name}_{count[name]:03d}>"
            return values[value]

        try:
            return dump(rewritten(parse(text), _replaced(values), forced))
        except (ValueError, RecursionError):
            return text

    return pd.Series([one(t, p) for t, p in zip(body, known, strict=True)])


def _restored(body: pd.Series, values: pd.Series) -> pd.Series:
    def one(text, pairs):
        try:
            return None if text is None else dump(rewritten(parse(text), _replaced(dict(pairs or {})), keys=True))
        except (ValueError, RecursionError):
            return text

    return pd.Series([one(t, p) for t, p in zip(body, values, strict=True)])


def redacted(body: Column, known: Column) -> Column:
    """The body with known values (value -> placeholder) replaced and values under sensitive keys given new ones."""
    return F.pandas_udf(_redacted, "string")(body, known)


def restored(body: Column, values: Column) -> Column:
    """The body with placeholders (placeholder -> value) restored in values and keys."""
    return F.pandas_udf(_restored, "string")(body, values)
