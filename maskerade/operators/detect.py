"""Deterministic detection: a table of rules over normalised text, as one projection without a shuffle.

``wide`` is the high-recall profile, ``thin`` holds checksum- and format-exact shapes only, ``client`` adds the
shapes that only the client profile has. Names next to cues need a sequential scan of tokens and run in an Arrow UDF;
all else stays in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, normalize, validators
from ..functions.spans import SPAN, Match, Rule, let, running, scan
from . import names


def _card(m: Match) -> Column:
    digits = validators.only_digits(F.regexp_replace(m.value, "%20", " "))
    return F.length(digits).isin(15, 16) & validators.luhn(digits)


def _born(m: Match) -> Column:
    return m.before(fixed.BIRTH_WINDOW).rlike(fixed.BIRTH_CUE)


def _business(m: Match) -> Column:
    """A business number's program account behind the digits, and no cue before them that they are a person's."""
    return m.after(12).rlike(fixed.BUSINESS_SUFFIX) & ~m.before(fixed.SIN_WINDOW).rlike(fixed.SIN_CUE)


def _cued(cue: str):
    return lambda m: m.before(fixed.CUE_BEFORE).rlike(cue) | m.after(fixed.CUE_AFTER).rlike(cue)


def _luhn_word(m: Match) -> Column:
    return F.when(validators.luhn(validators.only_digits(m.value)), "luhn_ok").otherwise("luhn_fail")


def _run_digits(m: Match) -> Column:
    return F.length(validators.only_digits(m.value))


def _run_label(m: Match) -> Column:
    n = _run_digits(m)
    dated = F.when(_born(m), "date_of_birth").otherwise("sensitive_date")
    return F.when(validators.date_shaped(m.value), dated).when(n.isin(15, 16), "payment_card").when(n == 9, "government_id").otherwise("sensitive_account_id")


def _run_conf(m: Match) -> Column:
    n, ok = _run_digits(m), validators.luhn(validators.only_digits(m.value))
    dated = F.when(_born(m), 0.9).otherwise(0.8)
    return F.when(validators.date_shaped(m.value), dated).when(n.isin(15, 16), F.when(ok, 0.97).otherwise(0.7)).when(n == 9, F.when(ok, 0.9).otherwise(0.75)).otherwise(0.6)


def _run_rule(m: Match) -> Column:
    return F.when(validators.date_shaped(m.value), F.when(_born(m), "tier0:dob_cue").otherwise("tier0:date_shaped")).otherwise("tier0:digit_run")


def _run_validator(m: Match) -> Column:
    return F.when(~validators.date_shaped(m.value) & _run_digits(m).isin(9, 15, 16), _luhn_word(m))


def digit_run(phones: Column) -> Rule:
    """Digit runs by length and checksum; one inside a phone number, separators and all, is the phone's."""

    def keep(m: Match) -> Column:
        inside = m.value.rlike(r"\D") & F.exists(phones, lambda p: (p["start"] <= m.start) & (m.end <= p["end"]))
        counted = _run_digits(m).between(7, 19) & ~inside & ~((_run_digits(m) == 9) & _business(m))
        return validators.date_shaped(m.value) | counted

    return Rule("tier0:digit_run", fixed.DIGIT_RUN, _run_label, _run_conf, keep, _run_validator, rename=_run_rule)


MOD97 = lambda m: F.lit("mod97_ok")
LUHN = lambda m: F.lit("luhn_ok")

EMAIL = Rule("tier0:email", fixed.EMAIL, "email", 0.99)
IPV4 = Rule("tier0:ip", fixed.IPV4, "ip_address", 0.95, lambda m: validators.octets(m.value))
PHONE = Rule("tier0:phone", fixed.PHONE, "phone_number", 0.85)
UUID = Rule("tier0:uuid", fixed.UUID, "uuid", 0.99)
IBAN = Rule("tier0:iban", fixed.IBAN, "iban", 0.99, lambda m: validators.longest_iban(m.value).isNotNull(), MOD97)
DATE = Rule("tier0:date", fixed.DATE, lambda m: F.when(_born(m), "date_of_birth").otherwise("sensitive_date"), lambda m: F.when(_born(m), 0.9).otherwise(0.8), rename=lambda m: F.when(_born(m), "tier0:dob_cue").otherwise("tier0:date"))
GLUED_SIN = Rule("tier0:digit_glued", fixed.GLUED_DIGITS, "government_id", 0.8, lambda m: m.glued() & validators.luhn(m.value) & ~_business(m), LUHN)
CARD_SEPARATED = Rule("tier0:card_sep", fixed.SEPARATED_CARD, "payment_card", 0.95, _card, LUHN)
SSN_DOTTED = Rule("tier0:ssn_dotted", fixed.DOTTED_SSN, "government_id", 0.8)
CARD_PARTS = (
    Rule("tier0:cvv", fixed.CVV, "card_cvv", 0.9, group=1),
    Rule("tier0:expiry", fixed.EXPIRY, "card_expiry", 0.9, group=1),
    Rule("tier0:num_secret", fixed.NUMERIC_SECRET, "password", 0.9, group=1),
)


def _cue_rules() -> list[Rule]:
    out = []
    for label, cue, shape, least in fixed.CUE_RULES:

        def keep(m: Match, label=label, least=least) -> Column:
            ok = F.length(F.regexp_replace(m.value, r"\D", "")) >= least
            return ok & ~((_run_digits(m) == 9) & m.after(9).rlike(fixed.BUSINESS_SUFFIX)) if label == "account_number" else ok

        # white space inside a cue may be a line end, but not between cue and value
        out.append(Rule("floor:cue_digit", rf"(?iu)(?<!{fixed.W})(?:{cue.replace(chr(92) + 's', '[ \\t\\x0B\\f\\r]')}){fixed.CUE_SEPARATOR}({shape})", label, 0.92, keep, group=1))
    return out


WIDE = (
    EMAIL,
    IPV4,
    Rule("tier0:ipv6", fixed.IPV6, "ip_address", 0.9, lambda m: F.length(F.regexp_replace(m.value, "[^:]", "")) >= 2),
    Rule("tier0:postal", fixed.POSTAL, "postal_code", 0.9),
    UUID,
    IBAN,
    PHONE,
    DATE,
    Rule("tier0:context_cue", fixed.LONG_ID, "sensitive_account_id", 0.55, lambda m: m.glued() & _cued(fixed.ID_CUE)(m)),
    Rule("tier0:card_glued", fixed.GLUED_CARD, "payment_card", 0.95, _card, LUHN),
    Rule("tier0:iban_glued", fixed.GLUED_IBAN, "iban", 0.99, lambda m: m.before(1).rlike(r"[\p{L}\p{N}]") & validators.iban(m.value), MOD97),
    GLUED_SIN,
    CARD_SEPARATED,
    SSN_DOTTED,
    *CARD_PARTS,
    Rule("tier0:us_zip", fixed.US_ZIP_STATE, "postal_code", 0.85, group=1),
    Rule("tier0:us_zip", fixed.US_ZIP_WORD, "postal_code", 0.9, group=1),
    *_cue_rules(),
)
THIN = (
    Rule("floor:email", fixed.EMAIL, "email", 0.99),
    UUID,
    Rule("floor:iban", fixed.IBAN, "iban", 0.99, lambda m: validators.longest_iban(m.value).isNotNull(), MOD97),
    Rule("floor:card", fixed.GLUED_CARD, "payment_card", 0.97, _card, LUHN),
    Rule("floor:sin", rf"{fixed.NOT_AFTER_WORD}\d{{3}}[ -]?\d{{3}}[ -]?\d{{3}}{fixed.NOT_BEFORE_WORD}", "government_id", 0.9, lambda m: validators.luhn(validators.only_digits(m.value)) & ~_business(m), LUHN),
    GLUED_SIN,
    CARD_SEPARATED,
    SSN_DOTTED,
    *CARD_PARTS,
)
_CLIENT = (
    Rule("tier0:nam", fixed.HEALTH_CARD, "government_id", 0.85),
    Rule("tier0:saaq_licence", fixed.DRIVER_LICENCE, "sensitive_account_id", 0.65, _cued(fixed.DRIVER_CUE)),
    Rule("tier0:neq", fixed.ENTERPRISE, "sensitive_account_id", 0.9, _cued(fixed.ENTERPRISE_CUE)),
)
#: The client's rules: those of the wide profile but for IPv6, ZIP codes and numbers glued to letters, and its own.
CLIENT = tuple(r for r in WIDE if r.name not in ("tier0:ipv6", "tier0:us_zip", "tier0:card_glued", "tier0:iban_glued", "tier0:digit_glued")) + _CLIENT


def _iban_ends(spans: Column) -> Column:
    """Account numbers end where they are valid, which may be before the match does."""
    valid = lambda s: validators.longest_iban(s["value"])
    cut = lambda s: s.withField("value", valid(s)).withField("end", (s["start"] + F.length(valid(s))).cast("int"))
    return F.transform(spans, lambda s: F.when(s["rule"].isin("tier0:iban", "floor:iban"), cut(s)).otherwise(s))


def spans(text: Column, profile: str = "wide", phones: Column | None = None) -> Column:
    """Array of spans of normalised text, in order of rules."""
    rules = {"wide": WIDE, "thin": THIN, "client": CLIENT}[profile]
    found = {r: scan(text, r) if "iban" not in r.name else _iban_ends(scan(text, r)) for r in rules}
    none = F.array().cast(f"array<{SPAN}>")
    mail = [x for r, x in found.items() if r.pattern == fixed.EMAIL]
    others = [x for r, x in found.items() if r.pattern != fixed.EMAIL]
    if profile != "thin":
        others.append(scan(text, digit_run(scan(text, PHONE) if phones is None else phones)))
    # a look for the character that a rule can't do without is cheaper than the rule
    mailed = F.when(F.contains(text, F.lit("@")), F.concat(*mail).cast(f"array<{SPAN}>")).otherwise(none)
    numbered = F.when(text.rlike("[0-9:]"), F.concat(*others).cast(f"array<{SPAN}>")).otherwise(none)
    return F.concat(mailed, numbered)


def detect(docs: DataFrame, text: str = "text", profile: str = "wide", named: bool = False, invisible: bool = False) -> DataFrame:
    """Adds ``spans``. ``named`` adds names next to cues; ``invisible`` scans again without format and control
    characters, for texts that have any, with places mapped back and ``+cf`` behind the rules' names."""
    keep = docs.columns
    out = docs.withColumn("_t", normalize.separators(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumn("_phones", F.when(F.col("_t").rlike("[0-9]"), scan(F.col("_t"), PHONE)).otherwise(F.array().cast(f"array<{SPAN}>")))
    out = out.withColumn("spans", spans(F.col("_t"), profile, F.col("_phones")))
    if named:
        out = out.withColumn("spans", F.concat("spans", names.cue_names(F.col("_t"))))
    if invisible:
        out = out.withColumn("_clean", F.when(F.col("_t").rlike(r"[\p{Cf}\p{Cc}]"), normalize.without_invisible(F.col("_t"))))
        out = out.withColumn("_again", F.when(F.col("_clean").isNotNull(), spans(F.col("_clean"), profile)))
        # how many visible characters come before each removed one: a place moves by as many as lie at or before it
        gaps = F.transform(F.split(F.col("_t"), r"[\p{Cf}\p{Cc}]", -1), F.length)
        before = let(gaps, running)
        out = out.withColumn("_gaps", F.when(F.col("_again").isNotNull() & (F.size("_again") > 0), F.slice(before, F.lit(2), F.size(gaps))).otherwise(F.array().cast("array<int>")))
        place = lambda p: (p + F.size(F.filter("_gaps", lambda g: g <= p))).cast("int")
        back = lambda s: s.withField("start", place(s["start"])).withField("end", (place(s["end"] - 1) + 1).cast("int")).withField("rule", F.concat(s["rule"], F.lit("+cf")))
        out = out.withColumn("spans", F.when(F.col("_again").isNotNull(), F.concat("spans", F.transform("_again", back))).otherwise(F.col("spans")))
    return out.select(*keep, "spans")


def rows(detected: DataFrame, *keys: str, column: str = "spans") -> DataFrame:
    """A row for each span, with its ordinal ``seq`` in order of emission.

    ``inline_outer`` keeps the array one expression: field by field, or behind an inferred filter on its size, the
    optimizer would evaluate all rules again for each use.
    """
    fields = [f.name for f in detected.schema[column].dataType.elementType.fields]
    numbered = F.transform(column, lambda s, i: F.struct(i.cast("int").alias("seq"), *(s[f].alias(f) for f in fields)))
    return detected.select(*keys, F.inline_outer(numbered)).filter(F.col("seq").isNotNull())
