"""Queries of corpus preparation and of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize, validators
from ..operators import corpus, tagging
from ..session import ship
from .documents import CHUNKS
from .templates import BASE, K

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT min(doc_id) AS doc_id, any_value(n_chars) AS n_chars FROM documents GROUP BY text")
def dedup_md5(spark, sf_dir):
    return corpus.deduplicated(_table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "n_chars")


@query("SELECT lang, source, count(*) AS n, cast(sum(n_chars) as bigint) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def lang_split(spark, sf_dir):
    _table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")


@query(
    "SELECT doc_id, lang FROM (SELECT doc_id, lang, -ln((cast('0x' || substr(md5('7:' || cast(doc_id as string)), 1, 12) as bigint) + 1.0) / 281474976710657.0) / CASE WHEN lang IN ('fr', 'en') THEN 2.0 ELSE 1.0 END AS s"
    " FROM documents) q ORDER BY s, doc_id LIMIT 300"
)
def weighted_mix(spark, sf_dir):
    """A sample of 300 documents, French and English twice as likely; a sampling operator, so the limit is its meaning."""
    docs = _table(spark, sf_dir, "documents")
    weight = F.when(F.col("lang").isin("fr", "en"), 2.0).otherwise(1.0)
    return corpus.weighted_sample(docs, F.col("doc_id"), weight, 300).select("doc_id", "lang")


_ENTITIES = """SELECT o_orderkey AS doc, CASE o_orderkey % 8 WHEN 0 THEN 'bank_account' WHEN 1 THEN 'routing_number' WHEN 2 THEN 'sensitive_account_id' WHEN 3 THEN 'api_key' WHEN 4 THEN 'sensitive_date'
  WHEN 5 THEN 'person' WHEN 6 THEN 'strange' ELSE 'sensitive_account_id' END AS label, CASE WHEN o_orderkey % 8 = 7 THEN '123e4567-e89b-12d3-a456-' || lpad(cast(o_orderkey as string), 12, '0')
  ELSE 'v' || cast(o_custkey as string) END AS value FROM orders"""


@query(
    "SELECT doc, CASE doc % 8 WHEN 3 THEN 'secret' WHEN 5 THEN 'person' WHEN 7 THEN 'sensitive_account_id' ELSE 'account_number' END AS label, value FROM (" + _ENTITIES + ") e WHERE doc % 8 NOT IN (4, 6)"
)
def label_remap(spark, sf_dir):
    _table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return corpus.remapped(spark.sql(_ENTITIES))


@query("SELECT o_orderkey AS doc, CASE WHEN o_orderpriority LIKE '1%' THEN 'person' ELSE 'email' END AS label FROM orders")
def label_mapping_strict(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("label"))
    known = orders.select(F.col("label").alias("source_label")).distinct().withColumn("label", F.when(F.col("source_label").like("1%"), "person").otherwise("email"))
    return corpus.strict_labels(orders, known)


_SPANS = 'SELECT l_orderkey AS doc, cast(l_suppkey % 40 as int) AS "start", cast(l_suppkey % 40 + 1 + l_partkey % 12 as int) AS "end", max(l_returnflag) AS label FROM lineitem GROUP BY 1, 2, 3'


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY "start", "start" - "end", label) AS i FROM ({_SPANS}) s),
w AS (SELECT doc, i, "start", "end", label, true AS kept, "end" AS last FROM o WHERE i = 1 UNION ALL
  SELECT o.doc, o.i, o."start", o."end", o.label, o."start" >= w.last, CASE WHEN o."start" >= w.last THEN o."end" ELSE w.last END FROM w JOIN o ON o.doc = w.doc AND o.i = w.i + 1)
SELECT doc, "start", "end", label FROM w WHERE kept"""
)
def first_of_overlaps(spark, sf_dir):
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return corpus.first_of_overlaps(spark.sql(_SPANS.replace('"start"', "`start`").replace('"end"', "`end`")), "doc")


@query(
    "SELECT c_nationkey AS doc, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM (SELECT c_nationkey, cast(c_custkey % 200 as string) AS value, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1, 2) q WHERE k > 1) GROUP BY 1"
)
def ambiguous_values(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), (F.col("c_custkey") % 200).cast("string").alias("value"), F.col("c_mktsegment").alias("label"))
    return corpus.ambiguous(rows, "doc").groupBy("doc").agg(F.count("*").alias("n"))


@query(
    "SELECT c_nationkey * 200 + c_custkey % 200 AS doc, count(*) AS n FROM customer WHERE c_nationkey * 200 + c_custkey % 200 NOT IN"
    " (SELECT doc FROM (SELECT c_nationkey * 200 + c_custkey % 200 AS doc, cast(c_custkey % 7 as string) AS value, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1, 2) q WHERE k > 1) GROUP BY 1"
)
def unambiguous_rows(spark, sf_dir):
    """What is left when documents go in which a value has two labels."""
    rows = _table(spark, sf_dir, "customer").select((F.col("c_nationkey") * 200 + F.col("c_custkey") % 200).alias("doc"), (F.col("c_custkey") % 7).cast("string").alias("value"), F.col("c_mktsegment").alias("label"))
    return corpus.unambiguous(rows, "doc").groupBy("doc").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT doc_id, cast(doc_id % 50 as int) AS "start", cast(CASE doc_id % 4 WHEN 0 THEN n_chars + 5 WHEN 1 THEN doc_id % 50 + 3 WHEN 2 THEN doc_id % 50 ELSE doc_id % 50 + 1 END as int) AS "end",
  CASE WHEN doc_id % 5 = 0 THEN 'odd' ELSE 'person' END AS label, text FROM documents),
f AS (SELECT label, CASE WHEN "end" > length(text) OR "start" >= "end" THEN 'range' WHEN trim(substr(text, "start" + 1, "end" - "start")) = '' THEN 'blank' WHEN label = 'odd' THEN 'label' END AS fault FROM s)
SELECT label, fault, count(*) AS n FROM f WHERE fault IS NOT NULL GROUP BY 1, 2"""
)
def corpus_validation(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 4
    end = F.when(k == 0, F.col("n_chars") + 5).when(k == 1, F.col("doc_id") % 50 + 3).when(k == 2, F.col("doc_id") % 50).otherwise(F.col("doc_id") % 50 + 1)
    spans = docs.select("doc_id", (F.col("doc_id") % 50).cast("int").alias("start"), end.cast("int").alias("end"), F.when(F.col("doc_id") % 5 == 0, "odd").otherwise("person").alias("label"))
    return corpus.invalid(docs, spans, "doc_id")


@query(
    "SELECT sha256(string_agg(slot || ':' || cast(n as string) || ':' || cast(s as string), ',' ORDER BY slot || ':' || cast(n as string) || ':' || cast(s as string))) AS fingerprint FROM (SELECT substr(h, 1, 2) AS slot, count(*) AS n,"
    " cast(sum(cast('0x' || substr(h, 3, 10) as bigint)) as hugeint) AS s FROM (SELECT sha256(text) AS h FROM documents) q GROUP BY 1) q"
)
def corpus_fingerprint(spark, sf_dir):
    return corpus.fingerprint(_table(spark, sf_dir, "documents"), "text")


@query(
    f"SELECT {K}, true AS luhn, true AS sin, {K} % 2 = 0 AS iban, {K} % 3 < 2 AS dated FROM customer"
)
def validators_agree(spark, sf_dir):
    """Check digits that are right by construction, and account numbers that are off by one for odd keys."""
    _table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    rows = spark.sql(f"SELECT {K}, card, sin, iban FROM {BASE}")
    off = F.concat(F.substring("iban", 1, 21), ((F.substring("iban", 22, 1).cast("int") + 1) % 10).cast("string"))
    iban = F.when(F.col(K) % 2 == 0, F.col("iban")).otherwise(off)
    date = F.when(F.col(K) % 3 == 0, "2026-02-28").when(F.col(K) % 3 == 1, "28-02-1999").otherwise("2026-13-01")
    return rows.select(K, validators.luhn(F.col("card")).alias("luhn"), validators.luhn(F.col("sin")).alias("sin"), validators.iban(iban).alias("iban"), validators.date_shaped(date).alias("dated"))


@query(f"SELECT {K}, '5-1 4' || cast({K} as string) AS plain, 'JEAN-LUC Tremblay 12' AS cased, 'Jean-Luc Tremblay 12' AS capitals, 'paymentcard' AS label FROM customer")
def normalised_text(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    plain = F.concat(F.lit("⁵–１ 4"), F.col(K).cast("string"))
    cased = F.lit("JEAN-LUC Tremblay 12")
    return c.select(K, normalize.separators(plain).alias("plain"), cased.alias("cased"), normalize.capitals(cased).alias("capitals"), normalize.label_key(F.lit("Payment_Card")).alias("label"))


@query(f"SELECT {K}, 5 AS \"start\", 12 AS \"end\", 'person' AS label, cast(0.7 as double) AS conf FROM customer UNION ALL SELECT {K}, 13, 16, 'email', 0.9 FROM customer")
def bio_decode(spark, sf_dir):
    """Tags of a model decoded: a span of two tokens takes the lower probability, one under the bar goes."""
    token = lambda a, b, t, p: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("tag"), F.lit(p).alias("p"))
    tags = F.array(token(0, 4, "O", 0.9), token(5, 9, "B-person", 0.8), token(9, 12, "I-person", 0.7), token(13, 16, "I-email", 0.9), token(17, 20, "B-person", 0.4))
    return _table(spark, sf_dir, "customer").select(K, F.inline(tagging.decode(tags)))


@query(f"SELECT DISTINCT doc_id, cast(start + strpos(chunk, ' the ') as int) AS \"start\", 'organization' AS label FROM ({CHUNKS}) c WHERE contains(chunk, ' the ')")
def tagged_windows(spark, sf_dir):
    """A stub tagger over windows of whole texts: the first 'the' of each as an organisation, tagged once a distinct window."""
    ship(spark)

    def load():
        return lambda texts: [[{"start": t.index(" the ") + 1, "end": t.index(" the ") + 4, "label": "organization", "conf": 0.9}] if " the " in t else [] for t in texts]

    return tagging.tag(_table(spark, sf_dir, "documents"), "doc_id", load).select("doc_id", "start", "label")
