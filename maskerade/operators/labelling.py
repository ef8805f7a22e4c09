"""Training data for taggers: windows of labelled texts, tags of tokens, perturbed copies, generated documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks


def windowed(gold: DataFrame, key: str) -> DataFrame:
    """Windows of labelled texts (key, text, spans) with the spans that lie in them whole, and the count of those cut."""
    cut = chunks.chunked(gold.select(key, "text"), key)
    rows = cut.join(gold.select(key, "spans"), key)
    end = F.col("start") + F.length("chunk")
    inside = F.filter("spans", lambda s: (s["start"] >= F.col("start")) & (s["end"] <= end))
    cross = F.filter("spans", lambda s: (s["start"] < end) & (s["end"] > F.col("start")) & ~((s["start"] >= F.col("start")) & (s["end"] <= end)))
    moved = F.transform(inside, lambda s: s.withField("end", (s["end"] - F.col("start")).cast("int")).withField("start", (s["start"] - F.col("start")).cast("int")))
    return rows.select(key, "chunk_no", F.col("chunk").alias("text"), moved.alias("spans"), F.size(cross).alias("n_cut"))


def token_tags(text: Column, spans: Column) -> Column:
    """Array of (start, end, tag): words with BIO tags; a word takes the label of the span that its first character is in."""
    from ..functions.spans import matches

    def tag(w: Column) -> Column:
        s = F.get(F.filter(spans, lambda s: (s["start"] <= w["start"]) & (w["start"] < s["end"])), F.lit(0))
        first = s.isNotNull() & ~F.exists(words, lambda v: (v["start"] >= s["start"]) & (v["start"] < w["start"]))
        return F.struct(w["start"].alias("start"), w["end"].alias("end"), F.when(s.isNull(), "O").when(first, F.concat(F.lit("B-"), s["label"])).otherwise(F.concat(F.lit("I-"), s["label"])).alias("tag"))

    words = matches(text, r"\S+")
    return F.transform(words, tag)


def perturbed(text: Column, kind: str) -> Column:
    """A copy of the same length: capitals, unbreakable blanks, long dashes or no accents."""
    if kind == "capitals":
        return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(text)
    table = {"blanks": (" ", " "), "dashes": ("-", "–"), "accents": ("àâäçéèêëîïôöùûüÿÀÂÄÇÉÈÊËÎÏÔÖÙÛÜ", "aaaceeeeiioouuuyAAACEEEEIIOOUUU")}[kind]
    return F.translate(text, *table)


def augmented(docs: DataFrame, share: float, kind: str, seed: int = 3) -> DataFrame:
    """The documents and perturbed copies of a share of them, chosen by a hash of the text."""
    u = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(10_000)) / 10_000
    return docs.unionByName(docs.filter(u < share).withColumn("text", perturbed(F.col("text"), kind)))


#: Generated documents: kind, and its pieces, {label} being a value of that label.
KINDS = {
    "statement": ("Account holder: {person}\nAccount number: {account_number}\nIBAN {iban}\nCard {payment_card}\n", 3),
    "receipt": ("Thanks {person}! We sent the receipt to {email}. Paid with {payment_card}.", 3),
    "letter": ("Dear {person}, your number {government_id} was issued. Call {phone_number}.", 2),
    "log": ("INFO login ok id={uuid} from {ip_address}", 2),
    "negative": ("The build 1.2.3 of unpkg@1.1.0 passed in 12:34:56 without errors.", 1),
}


def generated(spark: SparkSession, rows: int, seed: int = 20260614) -> DataFrame:
    """(id, kind, text, spans, entities) made from a seed alone: values have right check digits, spans right places."""
    weight = sum(w for _, w in KINDS.values())
    draw = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), F.col("id"))
    digits = lambda salt, n: F.lpad(F.pmod(draw(salt), F.lit(10**n)).cast("string"), n, "0")

    def checked(body: Column) -> Column:
        """Digits with a Luhn digit behind."""
        tries = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string")))
        return F.get(F.filter(tries, lambda t: F.call_function("luhn_check", t)), F.lit(0))

    bank = F.pmod(draw("iban"), F.lit(10**9))
    check = F.lit(98) - ((F.lit(370400440000000000) + bank) % 97 * (1_000_000 % 97) + 131400) % 97
    values = {
        "person": F.concat(F.element_at(F.array(*map(F.lit, ("Ann", "Luc", "Eva", "Tom"))), (F.pmod(draw("first"), F.lit(4)) + 1).cast("int")), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Roy", "Lee", "Gagné", "Smith"))), (F.pmod(draw("last"), F.lit(4)) + 1).cast("int"))),
        "account_number": digits("account", 9),
        "iban": F.concat(F.lit("DE"), F.lpad(check.cast("string"), 2, "0"), F.lit("37040044"), F.lpad(bank.cast("string"), 10, "0")),
        "payment_card": checked(F.concat(F.lit("4"), digits("card", 14))),
        "email": F.concat(F.lit("u"), digits("mail", 6), F.lit("@example.org")),
        "government_id": checked(digits("sin", 8)),
        "phone_number": F.concat(F.lit("514-555-"), digits("phone", 4)),
        "uuid": F.concat(F.lit("123e4567-e89b-12d3-a456-"), digits("uuid", 12)),
        "ip_address": F.concat(F.lit("10.1.2."), F.pmod(draw("ip"), F.lit(250)).cast("string")),
    }
    base = spark.range(rows).withColumn("_pick", F.pmod(draw("kind"), F.lit(weight)))
    out, low = None, 0
    for kind, (pattern, w) in KINDS.items():
        parts, labels = [], []
        for piece in pattern.split("{"):
            label, brace, rest = piece.partition("}")
            if brace:
                labels.append((len(parts), label))
                parts.append(values[label])
                piece = rest
            parts.append(F.lit(piece))
        places = [F.struct(sum((F.length(p) for p in parts[:k]), F.lit(0)).cast("int").alias("start"), sum((F.length(p) for p in parts[: k + 1]), F.lit(0)).cast("int").alias("end"), F.lit(label).alias("label")) for k, label in labels]
        spans = F.array(*places) if places else F.array().cast("array<struct<start:int,end:int,label:string>>")
        made = base.filter((F.col("_pick") >= low) & (F.col("_pick") < low + w)).select("id", F.lit(kind).alias("kind"), F.concat(*parts).alias("text"), spans.alias("spans"))
        out, low = made if out is None else out.unionByName(made), low + w
    return out
