"""A query for each detection rule, over texts built around a value at a place that is known without detecting it.

Prefix, value and suffix are SQL over ``customer`` that Spark and DuckDB read alike; Spark builds the text and detects,
the oracle only measures lengths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..operators import detect
from ..session import ship


def luhn_sql(digits: str, n: int) -> str:
    """The check digit behind ``n`` digits, as SQL."""
    terms = []
    for i in range(1, n + 1):
        d = f"cast(substr({digits}, {i}, 1) as int)"
        terms.append(f"(2 * {d} - case when {d} > 4 then 9 else 0 end)" if (n - i) % 2 == 0 else d)
    return f"cast((10 - ({' + '.join(terms)}) % 10) % 10 as string)"


K = "c_custkey"
P8 = f"lpad(cast(({K} * 7919) % 100000000 as string), 8, '0')"
P15 = f"('4' || lpad(cast(({K} * 104729) % 100000000000000 as string), 14, '0'))"
SIN = f"({P8} || {luhn_sql('p8', 8)})"
SIN_SPACED = "(substr(sin, 1, 3) || ' ' || substr(sin, 4, 3) || ' ' || substr(sin, 7, 3))"
CARD = f"({P15} || {luhn_sql('p15', 15)})"
CARD_DOTTED = "(substr(card, 1, 4) || '.' || substr(card, 5, 4) || '.' || substr(card, 9, 4) || '.' || substr(card, 13, 4))"
# 18 digits of a bank account, behind them DE00 as 131400: check = 98 - remainder
IBAN_CHECK = f"lpad(cast(98 - (((370400440000000000 + {K}) % 97) * (1000000 % 97) + 131400) % 97 as string), 2, '0')"
IBAN = f"('DE' || {IBAN_CHECK} || '37040044' || lpad(cast({K} as string), 10, '0'))"
NAME = f"('J' || translate(lpad(cast({K} as string), 6, '0'), '0123456789', 'abcdefghij') || ' Tremblay')"
BASE = f"(SELECT *, {SIN.replace(P8, 'p8')} AS sin, {CARD.replace(P15, 'p15')} AS card, {IBAN} AS iban, {NAME} AS name FROM (SELECT {K}, {P8} AS p8, {P15} AS p15 FROM customer) t0) t1"


@dataclass(frozen=True)
class Template:
    rule: str
    label: str
    prefix: str
    value: str
    suffix: str
    expected: str = "true"
    profile: str = "wide"


N4, N2 = f"lpad(cast({K} % 10000 as string), 4, '0')", f"lpad(cast({K} % 28 + 1 as string), 2, '0')"
TEMPLATES = {
    "email": Template("tier0:email", "email", "'to '", f"('u.' || cast({K} as string) || '+x@mail.example.com')", "' now'"),
    "ip": Template("tier0:ip", "ip_address", "'at '", f"('10.20.' || cast({K} % 300 as string) || '.7')", "' up'", f"{K} % 300 <= 255"),
    "ipv6": Template("tier0:ipv6", "ip_address", "'host '", f"('2001:db8::' || cast({K} % 9999 as string))", "' up'"),
    "postal": Template("tier0:postal", "postal_code", "'in '", f"('H' || cast({K} % 10 as string) || 'X 1Y' || cast({K} % 7 as string))", "' now'"),
    "uuid": Template("tier0:uuid", "uuid", "'id '", f"('123e4567-e89b-12d3-a456-' || lpad(cast({K} as string), 12, '0'))", "' ok'"),
    "phone": Template("tier0:phone", "phone_number", "'dial '", f"('(514) 555-' || {N4})", "' now'"),
    "iban": Template("tier0:iban", "iban", "'pay '", "iban", "', thanks'"),
    "date": Template("tier0:date", "sensitive_date", "'due '", f"({N2} || ' mai 2026')", "' please'"),
    "dob_cue": Template("tier0:dob_cue", "date_of_birth", "'née à Québec le '", f"({N2} || ' mai 1980')", "' ici'"),
    "date_shaped": Template("tier0:date_shaped", "sensitive_date", "'build '", f"('2026-07-' || {N2})", "' done'"),
    "digit_run_sin": Template("tier0:digit_run", "government_id", "'value '", SIN_SPACED, "' there'"),
    "digit_run_card": Template("tier0:digit_run", "payment_card", "'paid '", "card", "' once'"),
    "digit_run_account": Template("tier0:digit_run", "sensitive_account_id", "'ref '", f"('90' || lpad(cast({K} as string), 10, '0'))", "' end'"),
    "business_number": Template("tier0:digit_run", "government_id", f"(case when {K} % 2 = 0 then 'NAS ' else 'TPS ' end)", "sin", "' RT0001'", f"{K} % 2 = 0"),
    "context_cue": Template("tier0:context_cue", "sensitive_account_id", "'confirmation no A'", f"('5' || lpad(cast({K} as string), 11, '0'))", "' ok'"),
    "card_glued": Template("tier0:card_glued", "payment_card", "'card'", "card", "'expires'"),
    "iban_glued": Template("tier0:iban_glued", "iban", "'iban'", "iban", "' x'"),
    "digit_glued": Template("tier0:digit_glued", "government_id", "'JaneDoe'", "sin", "' x'"),
    "card_sep": Template("tier0:card_sep", "payment_card", "'card '", CARD_DOTTED, "' ok'"),
    "ssn_dotted": Template("tier0:ssn_dotted", "government_id", "'ssn '", f"('123.45.' || {N4})", "' ok'"),
    "cvv": Template("tier0:cvv", "card_cvv", "'\"cvv\": '", f"lpad(cast({K} % 1000 as string), 3, '0')", "', next'"),
    "expiry": Template("tier0:expiry", "card_expiry", "'expiry \"'", "'08/27'", "'\" ok'"),
    "num_secret": Template("tier0:num_secret", "password", "'NIP: '", N4, "' merci'"),
    "us_zip": Template("tier0:us_zip", "postal_code", f"(case when {K} % 3 = 0 then 'Austin, TX ' when {K} % 3 = 1 then 'zip code: ' else 'Laval, QC ' end)", f"('7' || {N4})", "' ok'", f"{K} % 3 < 2"),
    "cue_policy": Template("floor:cue_digit", "sensitive_account_id", "'policy number: '", f"('AB' || {N4} || 'X')", "'. ok'"),
    "cue_account": Template("floor:cue_digit", "account_number", "'numéro de compte : '", f"('7' || lpad(cast({K} as string), 7, '0'))", "', ok'"),
    "cue_phone": Template("floor:cue_digit", "phone_number", "'Tél. '", f"('450.555.' || {N4})", "' ok'"),
    "cue_birth": Template("floor:cue_digit", "date_of_birth", "'né(e) le '", f"({N2} || ' janvier 1979')", "' ok'"),
    "cue_name_header": Template("tier0:cue_name", "person", "'From: '", "name", "' <'||name||'>'"),
    "cue_name_ledger": Template("tier0:cue_name", "person", "'VIR INTERAC RECU MME '", "lower(name)", "' CA7Q12'"),
    "cue_name_slash": Template("tier0:cue_name", "person", "'Interac e-Transfer from /'", "name", "' / 12'"),
    "thin_card": Template("floor:card", "payment_card", "'paid '", "card", "' once'", profile="thin"),
    "thin_sin": Template("floor:sin", "government_id", "'value '", SIN_SPACED, "' there'", profile="thin"),
    "thin_iban": Template("floor:iban", "iban", "'pay '", "iban", "', thanks'", profile="thin"),
    "client_health_card": Template("tier0:nam", "government_id", "'carte '", f"('TREM ' || {N4} || ' ' || {N4})", "' ok'", profile="client"),
    "client_licence": Template("tier0:saaq_licence", "sensitive_account_id", "'permis '", f"('T' || lpad(cast({K} as string), 12, '0'))", "' ok'", profile="client"),
    "client_enterprise": Template("tier0:neq", "sensitive_account_id", "'NEQ '", f"('1' || lpad(cast({K} as string), 9, '0'))", "' ok'", profile="client"),
    "invisible": Template("tier0:digit_run+cf", "payment_card", "'card '", "(substr(card, 1, 4) || '​' || substr(card, 5, 6) || '​' || substr(card, 11, 6))", "' ok'"),
    "superscript": Template("tier0:digit_run", "payment_card", "'card '", "translate(card, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')", "' ok'"),
    "dashed": Template("tier0:phone", "phone_number", "'dial '", f"('514–555—' || {N4})", "' now'"),
}


def _query(name: str):
    t = TEMPLATES[name]

    def run(spark, sf_dir):
        ship(spark)
        spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
        texts = spark.sql(f"SELECT {K}, {t.prefix} || {t.value} || {t.suffix} AS text FROM {BASE}")
        found = detect.rows(detect.detect(texts, profile=t.profile, named=t.rule == "tier0:cue_name", invisible=t.rule.endswith("+cf")).select(K, "text", "spans"), K, "text")
        value = F.expr("substring(text, start + 1, end - start)")
        return found.filter(F.col("rule") == t.rule).select(K, "start", "end", "label", value.alias("value")).distinct()

    run.__name__ = f"rule_{name}"
    return run


def _oracle(name: str) -> str:
    t = TEMPLATES[name]
    return (
        f"SELECT {K}, cast(length({t.prefix}) as int) AS start, cast(length({t.prefix}) + length({t.value}) as int) AS \"end\", '{t.label}' AS label, {t.value} AS value"
        f" FROM {BASE} WHERE {t.expected}"
    )


QUERIES = {f"rule_{n}": _query(n) for n in TEMPLATES}
ORACLE_SQL = {f"rule_{n}": _oracle(n) for n in TEMPLATES}
