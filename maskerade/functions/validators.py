"""Predicates over candidate values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(digits: Column) -> Column:
    """The check digit of digits alone."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def mod97(value: Column) -> Column:
    """Remainder of the rearranged account number, letters as 10 to 35, folded character by character."""
    v = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    turned = F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.when(v.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+\z"), F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))))


def iban(value: Column) -> Column:
    return F.coalesce(mod97(value) == 1, F.lit(False))


def longest_iban(value: Column) -> Column:
    """The value, or its longest part before a space or hyphen, that is valid; else null."""
    n = F.length(value)
    cuts = F.filter(F.sequence(F.lit(5), F.greatest(n, F.lit(5))), lambda k: (k == n) | F.substring(value, k + 1, F.lit(1)).isin(" ", "-"))
    parts = F.transform(F.reverse(cuts), lambda k: F.substring(value, F.lit(1), k))
    return F.get(F.filter(parts, iban), F.lit(0))


def date_shaped(value: Column) -> Column:
    """Y-M-D (with an hour behind or not), D-M-Y or M-D-Y, or YYYYMMDD, with a possible month and day."""

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(value, pattern, k).try_cast("int")

    ymd, dmy, run = r"^((?:19|20)\d{2})-(\d{1,2})-(\d{1,2})( \d{1,2})?\n?\z", r"^(\d{1,2})-(\d{1,2})-((?:19|20)\d{2})\n?\z", r"^(?:19|20)(\d{2})(\d{2})(\d{2})\n?\z"
    within = lambda c, high: c.between(1, high)
    a, b = part(dmy, 1), part(dmy, 2)
    found = (
        F.when(value.rlike(ymd), within(part(ymd, 2), 12) & within(part(ymd, 3), 31))
        .when(value.rlike(dmy), (within(a, 31) & within(b, 12)) | (within(a, 12) & within(b, 31)))
        .when(value.rlike(run), within(part(run, 2), 12) & within(part(run, 3), 31))
    )
    return F.coalesce(found, F.lit(False))


def octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda o: o.cast("int") <= 255)


def benign_hash(value: Column) -> Column:
    """A commit or content hash, which is nobody's secret."""
    return value.rlike(fixed.BENIGN_HASH)


def entropy(value: Column) -> Column:
    """Bits a character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.size(F.filter(chars, lambda x: x == c)) / n * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))


def home_user(path: Column) -> Column:
    """The user's name in a path below a home folder; empty if there is none."""
    return F.regexp_extract(path, fixed.HOME_USER, 1)


def path_shaped(value: Column) -> Column:
    return ~value.rlike(r"\s") & value.rlike(r"^(?:/|~|[A-Za-z]:[\\/])") & (F.length(F.regexp_replace(value, r"[^\\/]", "")) >= 2)
