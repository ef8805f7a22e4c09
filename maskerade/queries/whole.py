"""Queries of growth and propagation, bodies rewritten, generated corpora, and the whole way of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import SPAN
from ..operators import bodies, detect, evaluate, growth, labelling, merge
from ..plans import redaction
from ..session import pin, ship
from .documents import ADDRESS, EMAILS
from .templates import BASE, K

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


_NAMED = f"(SELECT {K}, 'Client ' || name || ' called. ' || upper(name) || ' paid, Tremblays did not; TREMBLAY left.' AS text, length(name) AS n FROM {BASE}) t"


def _people(spark, sf_dir):
    ship(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    rows = spark.sql(f"SELECT {K}, text, n FROM {_NAMED}")
    one = F.struct(F.lit(7).alias("start"), (F.col("n") + 7).cast("int").alias("end"), F.lit("person").alias("label"), F.lit(2).alias("tier"), F.lit(0.9).alias("conf"), F.lit("model").alias("rule"), F.lit(None).cast("string").alias("validator"), F.substring("text", F.lit(8), F.col("n")).alias("value"))
    return rows.withColumn("spans", F.array(one).cast(f"array<{SPAN}>"))


@query(
    f"SELECT {K}, cast(7 as int) AS \"start\", cast(7 + n as int) AS \"end\", 'model' AS rule FROM {_NAMED} UNION ALL SELECT {K}, cast(16 + n as int), cast(16 + 2 * n as int), 'repeat' FROM {_NAMED}"
    f" UNION ALL SELECT {K}, cast(16 + 2 * n + 26 as int), cast(16 + 2 * n + 34 as int), 'repeat' FROM {_NAMED}"
)
def propagated_repeats(spark, sf_dir):
    """A name found once, found again in capitals and by its last word; a longer word with it inside isn't."""
    docs = _people(spark, sf_dir)
    return detect.rows(docs.withColumn("spans", growth.propagate(F.col("text"), F.col("spans"))), K).select(K, "start", "end", "rule")


@query(f"SELECT {K}, cast(7 as int) AS \"start\", cast(7 + n as int) AS \"end\", 'model+grow' AS rule FROM {_NAMED}")
def grown_persons(spark, sf_dir):
    """A span that a model cut short, grown to the whole name and no further."""
    docs = _people(spark, sf_dir).withColumn("spans", F.transform("spans", lambda s: s.withField("end", (s["end"] - 12).cast("int"))))
    return detect.rows(docs.withColumn("spans", growth.grow_persons(F.col("text"), F.col("spans"))), K).select(K, "start", "end", "rule")


_BODY = """'{"model": "m1", "messages": [{"role": "user", "content": "I am ' || c_name || '"}, {"tool": {"password": "' || {pw} || '", "cvv": ' || {cvv} || ', "user_id": "' || c_name || '"}}]}'"""


def _json(pw: str, cvv: str, name: str) -> str:
    return _BODY.replace("{pw}", pw).replace("{cvv}", cvv).replace("I am ' || c_name || '", f"I am ' || {name} || '")


_PLAIN = _json("'pw' || cast(c_custkey as string)", "cast(c_custkey % 900 + 100 as string)", "c_name")


def _bodies(spark, sf_dir):
    ship(spark)
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(f"SELECT c_custkey, c_name, {_PLAIN} AS body FROM customer")


@query(f"SELECT c_custkey, {_json(repr('<SECRET_001>'), repr(chr(34) + '<CARDCVV_001>' + chr(34)), repr('<PERSON_001>'))} AS body FROM customer")
def json_body_redaction(spark, sf_dir):
    """Known values and those under sensitive keys replaced, ids and the model left."""
    rows = _bodies(spark, sf_dir)
    return rows.select("c_custkey", bodies.redacted(F.col("body"), F.create_map(F.col("c_name"), F.lit("<PERSON_001>"))).alias("body"))


@query(f"SELECT c_custkey, {_PLAIN.replace(chr(39) + ', ' + chr(34) + 'user_id', chr(39) + ', ' + chr(34) + 'user_id')} AS body FROM customer".replace("\"cvv\": ' || cast(c_custkey % 900 + 100 as string) || ',", "\"cvv\": \"' || cast(c_custkey % 900 + 100 as string) || '\","))
def json_body_restored(spark, sf_dir):
    """Redacted bodies restored; a number under a sensitive key comes back as a string."""
    rows = _bodies(spark, sf_dir)
    red = rows.withColumn("body", bodies.redacted(F.col("body"), F.create_map(F.col("c_name"), F.lit("<PERSON_001>"))))
    values = F.create_map(F.lit("<PERSON_001>"), F.col("c_name"), F.lit("<SECRET_001>"), F.concat(F.lit("pw"), F.col("c_custkey").cast("string")), F.lit("<CARDCVV_001>"), (F.col("c_custkey") % 900 + 100).cast("string"))
    return red.select("c_custkey", bodies.restored(F.col("body"), values).alias("body"))


@query(f"SELECT doc_id, value, false AS shown FROM (SELECT DISTINCT doc_id, value FROM ({EMAILS}) e) q")
def wire_redaction(spark, sf_dir):
    """The whole way of all documents; each address that the oracle finds by itself must not be shown any more.

    Addresses are read from the text, not from the map that restores it: that has one spelling of a value, with the
    line ends and invisible characters that were redacted with it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ship(spark)
    red = redaction.redact(docs.select("doc_id", "text"))
    found = F.when(F.contains("text", F.lit("@")), F.array_distinct(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0))))
    rows = red.select("doc_id", "redacted", F.explode_outer(found).alias("value")).filter(F.col("value").isNotNull())
    return rows.select("doc_id", "value", F.contains("redacted", F.col("value")).alias("shown")).distinct()


@query()
def generated_corpus_recall(spark, sf_dir):
    """Recall of the wide profile on generated documents, as many as there are customers."""
    ship(spark)
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    gold = labelling.generated(spark, n)
    found = detect.detect(gold.drop("spans"), named=True).withColumn("spans", merge.merge(F.col("spans")))
    rows = lambda d: d.select("id", F.posexplode("spans").alias("seq", "s")).select("id", "seq", "s.start", "s.end", "s.label")
    return evaluate.by_label(pin(rows(gold)), pin(rows(found.select("id", "spans"))), "id")


@query()
def generated_windows(spark, sf_dir):
    """Windows of generated documents with their spans, and words with tags."""
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    cut = labelling.windowed(labelling.generated(spark, n), "id")
    return cut.select("id", "chunk_no", "n_cut", F.size("spans").alias("n_spans"), F.size(F.filter(labelling.token_tags(F.col("text"), F.col("spans")), lambda t: t["tag"] != "O")).alias("n_tagged"))


@query("SELECT c_custkey, 0 AS leaks, 0 AS over_redacted, true AS round_trip FROM customer")
def replay_scorecard(spark, sf_dir):
    """Fixtures replayed through the whole way: what must go is gone, what is benign stays, restoring gives the text back."""
    from ..operators import pseudonyms

    ship(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    mail, card = F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org")), F.lit("4111 1111 1111 1111")
    docs = c.select("c_custkey", F.concat(F.lit("build 1.2.3 of core@0.2.0 by "), mail, F.lit(", card "), card, F.lit(" ok")).alias("text"), F.array(mail, card).alias("must"), F.array(F.lit("core@0.2.0"), F.lit("1.2.3")).alias("benign"))
    red = redaction.redact(docs).withColumn("restored", pseudonyms.restored_whole(F.col("redacted"), F.col("restore"))).withColumnRenamed("c_custkey", "name")
    return evaluate.scorecard(red).withColumnRenamed("name", "c_custkey")
