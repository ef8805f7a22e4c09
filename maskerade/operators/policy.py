"""What is redacted under which policy, and the dictionaries of values that never or always are."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, normalize, validators
from ..functions.spans import let, matches


def category(label: Column) -> Column:
    """The category of a label, or the label itself."""
    pairs = [F.lit(x) for c, labels in fixed.CATEGORIES.items() for label_ in labels for x in (label_, c)]
    return F.coalesce(F.element_at(F.create_map(*pairs), label), label)


#: Modes and their policies. ``coding`` lets operational shapes pass; ``off`` keeps the floor alone.
MODES = {
    "privacy": {"enabled": True, "exclude": ("username", "date")},
    "coding": {"enabled": True, "exclude": ("username", "date", "uuid", "ip", "org", "filepath", "postal")},
    "off": {"enabled": False, "exclude": ()},
}


def allows(label: Column, enabled: Column | bool = True, exclude: Column | Sequence[str] = (), only: Column | Sequence[str] | None = None) -> Column:
    """Whether a label is redacted: floor and custom labels always; others if enabled, not excluded by label or
    category, and within ``only`` if that is given."""
    listed = lambda x: x if isinstance(x, Column) else F.array(*(F.lit(v) for v in x)).cast("array<string>")
    has = lambda xs: F.array_contains(xs, label) | F.array_contains(xs, category(label))
    soft = (enabled if isinstance(enabled, Column) else F.lit(enabled)) & ~F.coalesce(has(listed(exclude)), F.lit(False))
    if only is not None:
        soft = soft & F.coalesce(has(listed(only)), F.lit(True) if isinstance(only, Column) else F.lit(False))
    return label.isin(*fixed.FLOOR_LABELS, fixed.CUSTOM_LABEL) | soft


def word_key(value: Column) -> Column:
    """What makes a value that of a dictionary: composed, trimmed, lower case."""
    return F.lower(F.trim(normalize.nfc(value)))


def word_stem(key: Column) -> Column:
    """A key without its possessive."""
    return F.regexp_replace(key, "['’]s\\z", "")


def exempt(spans: DataFrame, allowed: DataFrame, value: str = "value") -> DataFrame:
    """Drops soft spans whose whole value is in the dictionary ``allowed`` (value), case and a possessive aside."""
    words = allowed.select(word_key(F.col("value")).alias("_word")).distinct()
    rows = spans.withColumn("_key", word_key(F.col(value))).withColumn("_stem", word_stem(F.col("_key")))
    hard = F.col("label").isin(*fixed.FLOOR_LABELS, fixed.CUSTOM_LABEL)
    soft = rows.filter(~hard).join(words, F.col("_key") == F.col("_word"), "left_anti").join(words, F.col("_stem") == F.col("_word"), "left_anti")
    return rows.filter(hard).unionByName(soft).drop("_key", "_stem")


def forms(words: Sequence[str]) -> list[str]:
    """Words composed and decomposed, longest first."""
    return sorted({unicodedata.normalize(f, w) for w in words for f in ("NFC", "NFD")}, key=lambda w: (-len(w), w))


def term_spans(text: Column, terms: Sequence[str]) -> Column:
    """Array of (start, end, value) of terms: whole words, any case, composed or not, longest first, at least two characters."""
    quoted = "|".join("".join(c if c.isalnum() or c in "_ " else "\\" + c for c in t) for t in forms([t for t in terms if len(t) >= 2]))
    return matches(text, f"(?iu){fixed.NOT_AFTER_WORD}(?:{quoted}){fixed.NOT_BEFORE_WORD}(?!\\p{{M}})" if quoted else "(?!)")


def denied(docs: DataFrame, terms: Sequence[str], key: str, text: str = "text") -> DataFrame:
    """Spans of terms that are always redacted."""
    found = F.transform(term_spans(F.col(text), terms), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    return docs.select(key, F.inline_outer(found)).filter("start is not null").select(key, "start", "end", F.lit(fixed.CUSTOM_LABEL).alias("label"), F.lit(1.0).alias("conf"), "value")


def credential_verdict(v: Column) -> Column:
    """Whether a model's claim of a credential stays a floor label (floor), becomes a soft one (ref) or goes (drop), by its shape."""

    def by_facts(f: Column) -> Column:
        token, n, kinds, random = (f[k] for k in ("token", "n", "kinds", "random"))
        prefixed = F.lower(token).rlike("^(?:" + "|".join("".join(c if c.isalnum() else "\\" + c for c in p) for p in fixed.CREDENTIAL_PREFIXES) + ")")
        benign = token.rlike(f"^{fixed.UUID}$") | validators.benign_hash(token) | token.rlike(r"^\d+$")
        call = token.rlike(r"^[A-Za-z_][\w.]*[(\[]")
        code = token.rlike(r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")
        return F.when(n < 8, "drop").when(prefixed, "floor").when(benign | call, "drop").when(random & (kinds >= 2), "floor").when(code, "drop").when((kinds >= 2) | random, "floor").otherwise("ref")

    def facts(token: Column) -> Column:
        n = F.length(token)
        kinds = token.rlike("[a-z]").cast("int") + token.rlike("[A-Z]").cast("int") + token.rlike("[0-9]").cast("int")
        distinct = F.size(F.array_distinct(F.split(token, "(?!^)")))
        random = (validators.entropy(token) >= 0.75 * F.log2(F.greatest(n, F.lit(2)))) | ((n >= 12) & (distinct / n >= 0.7))
        return F.struct(token.alias("token"), n.alias("n"), kinds.alias("kinds"), random.alias("random"))

    return let(let(F.regexp_replace(F.trim(v), "^['\"`]+|['\"`]+$", ""), facts), by_facts)


def earned_label(label: Column, tier: Column, value: Column) -> Column:
    """The label that a span keeps, null if it goes. Claims of a model (tier over 0) lose floor labels that no checksum
    backs: an identity becomes sensitive_ref, a credential by its shape; a mail address with a numeric tail is a version.
    An id that is a UUID is uuid on any tier."""
    claimed, verdict = tier != 0, credential_verdict(value)
    credential = claimed & label.isin(*fixed.MODEL_CREDENTIAL)
    return (
        F.when(label.isin("sensitive_account_id", "account_number") & value.rlike(f"^{fixed.UUID}$"), F.lit("uuid"))
        .when(claimed & label.isin(*fixed.MODEL_IDENTITY) | credential & (verdict == "ref"), F.lit("sensitive_ref"))
        .when(credential & (verdict == "drop") | claimed & (label == "email") & value.rlike(r"\.\d+$"), F.lit(None))
        .otherwise(label)
    )


def demoted(spans: DataFrame) -> DataFrame:
    """Spans with the labels that they keep."""
    return spans.withColumn("label", earned_label(F.col("label"), F.col("tier"), F.col("value"))).filter("label is not null")


def path_part(label: Column, value: Column, mode: str = "username") -> Column:
    """What is left of a span that is a path: struct (label, skip, length), null if it goes.

    ``username`` leaves the home folder's user alone, ``passthrough`` nothing, ``full`` all. Soft claims that are
    shaped like a path count as one; other spans are left whole.
    """
    named = normalize.label_key(label).isin("filepath", "path")
    path = named | label.isin("sensitive_ref", "uuid") & validators.path_shaped(value)
    whole = F.struct(label.alias("label"), F.lit(0).alias("skip"), F.length(value).alias("length"))
    if mode == "full":
        return whole
    user = validators.home_user(value)
    skip = F.regexp_instr(value, F.lit(fixed.HOME_USER)) - 1 + F.length(F.regexp_extract(value, fixed.HOME_USER, 0)) - F.length(user)
    part = F.struct(F.when(named, label).otherwise("file_path").alias("label"), skip.cast("int").alias("skip"), F.length(user).alias("length"))
    left = F.when((user != "") & ~user.rlike(f"^{fixed.PLACEHOLDER}$"), part) if mode == "username" else F.lit(None).cast("struct<label:string,skip:int,length:int>")
    return F.when(path, left).otherwise(whole)


def narrowed_paths(spans: DataFrame, mode: str = "username") -> DataFrame:
    """Path spans keep the home folder's user alone (``username``), go (``passthrough``) or stay whole (``full``)."""
    rows = spans.withColumn("_p", path_part(F.col("label"), F.col("value"), mode)).filter("_p is not null")
    rows = rows.withColumn("label", F.col("_p.label")).withColumn("start", (F.col("start") + F.col("_p.skip")).cast("int"))
    value = F.expr("substring(value, _p.skip + 1, _p.length)")
    return rows.withColumn("end", (F.col("start") + F.col("_p.length")).cast("int")).withColumn("value", value).drop("_p")
