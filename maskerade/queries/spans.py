"""Queries over span tables built from relational keys: merging, stitching, clipping, policy, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluate, merge, policy

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Spans of a document (an order): touching, nested and equal ones, with ties of confidence. Read alike by both engines.
LABELS = "CASE l_partkey % 6 WHEN 0 THEN 'payment_card' WHEN 1 THEN 'person' WHEN 2 THEN 'email' WHEN 3 THEN 'government_id' WHEN 4 THEN 'address' ELSE 'postal_code' END"
SPANS = f"""SELECT l_orderkey AS doc, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as int) AS seq, cast(l_suppkey % 40 as int) AS "start", cast(l_suppkey % 40 + 1 + l_partkey % 12 as int) AS "end",
  {LABELS} AS label, cast(0 as int) AS tier, cast((l_partkey % 5) as double) / 10 + 0.5 AS conf, 'r' || cast(l_linenumber as string) AS rule, cast(NULL as string) AS validator FROM lineitem"""
FLOOR = ", ".join(f"'{x}'" for x in fixed.FLOOR_LABELS)


def _lineitem(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    return spark.sql(SPANS.replace('"start"', "`start`").replace('"end"', "`end`"))


# Islands begin where no earlier span reaches beyond the start: a correlated NOT EXISTS, no running maximum.
_MERGED = f"""
WITH s AS ({SPANS}), o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY "start", "start" - "end", seq) AS pos FROM s),
heads AS (SELECT doc, pos FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc = a.doc AND b.pos < a.pos AND b."end" > a."start")),
m AS (SELECT o.*, (SELECT max(h.pos) FROM heads h WHERE h.doc = o.doc AND h.pos <= o.pos) AS cluster FROM o),
best AS (SELECT *, row_number() OVER (PARTITION BY doc, cluster ORDER BY conf DESC, "end" - "start" DESC, pos) AS r,
  CASE WHEN label IN ({FLOOR}) THEN row_number() OVER (PARTITION BY doc, cluster, label IN ({FLOOR}) ORDER BY conf DESC, pos) END AS fr FROM m)
SELECT doc, min("start") AS "start", max("end") AS "end", CASE WHEN max(CASE WHEN r = 1 THEN label END) IN ({FLOOR}) THEN max(CASE WHEN r = 1 THEN label END)
  ELSE coalesce(max(CASE WHEN fr = 1 THEN label END), max(CASE WHEN r = 1 THEN label END)) END AS label, max(conf) AS conf, cast(count(*) as int) AS members,
  CASE WHEN max(CASE WHEN r = 1 THEN label END) IN ({FLOOR}) THEN max(CASE WHEN r = 1 THEN rule END) ELSE coalesce(max(CASE WHEN fr = 1 THEN rule END), max(CASE WHEN r = 1 THEN rule END)) END AS rule,
  CASE WHEN count(DISTINCT label) > 1 THEN array_to_string(list_sort(list(DISTINCT label)), ',') END AS labels
FROM best GROUP BY doc, cluster
"""
_OUT = ("doc", "start", "end", "label", "conf", "members", "rule")


@query(_MERGED)
def merge_clusters(spark, sf_dir):
    return merge.merge_rows(_lineitem(spark, sf_dir), "doc").select(*_OUT, F.array_join("labels", ",").alias("labels"))


@query(_MERGED)
def merge_clusters_in_rows(spark, sf_dir):
    """The same clusters from arrays inside rows, as documents have them."""
    rows = _lineitem(spark, sf_dir)
    spans = F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "label", "tier", "conf", "rule", "validator"))), lambda s: s.dropFields("seq"))
    docs = rows.groupBy("doc").agg(spans.alias("spans"))
    return docs.select("doc", F.inline(merge.merge(F.col("spans")))).select(*_OUT, F.array_join("labels", ",").alias("labels"))


@query(f"""SELECT label AS label, count(*) AS n, count(*) FILTER (WHERE members > 1) AS n_merged FROM ({_MERGED}) q WHERE label IN ({FLOOR}) GROUP BY label""")
def floor_sticky_primary(spark, sf_dir):
    rows = merge_clusters(spark, sf_dir).filter(merge.floor(F.col("label")))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("members") > 1).alias("n_merged"))


# Three parts at known places; a gap of letters and separators joins them unless it is too long or holds a digit.
_ADDRESS = """SELECT c_custkey AS doc, '12 rue X' || sep || 'Laval' || ', ' || 'H2X 1Y4' AS text, sep FROM
  (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ', ' WHEN 1 THEN ' - App ' WHEN 2 THEN ' far too many words ' ELSE ', 7, ' END AS sep FROM customer) t"""


@query(f"""SELECT doc, 0 AS "start", CASE WHEN doc % 4 < 2 THEN cast(length(text) as int) ELSE 8 END AS "end", 'address' AS label FROM ({_ADDRESS}) a
UNION ALL SELECT doc, cast(8 + length(sep) as int), cast(length(text) as int), 'address' FROM ({_ADDRESS}) a WHERE doc % 4 >= 2""")
def address_stitch(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    docs = spark.sql(_ADDRESS)
    n = F.length("sep")
    part = lambda seq, a, b, label: F.struct(F.lit(seq).alias("seq"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"), F.lit(0.9 - seq / 10).alias("conf"))
    parts = F.array(part(0, F.lit(0), F.lit(8), "address"), part(1, n + 8, n + 13, "address"), part(2, n + 15, n + 22, "postal_code"))
    return merge.stitch_addresses(docs.select("doc", "text", F.inline(parts)), "text", "doc").select("doc", "start", "end", "label")


# Inactive spans by character: what no active span covers, as runs.
_CLIP = f"""
WITH s AS (SELECT *, seq % 2 = 0 AS active FROM ({SPANS}) q), act AS (SELECT * FROM s WHERE active),
chars AS (SELECT doc, seq, label, unnest(generate_series("start", "end" - 1)) AS c FROM s WHERE NOT active),
free AS (SELECT * FROM chars x WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.doc = x.doc AND a."start" <= x.c AND x.c < a."end")),
runs AS (SELECT *, c - row_number() OVER (PARTITION BY doc, seq ORDER BY c) AS run FROM free)
SELECT doc, seq, label, cast(min(c) as int) AS "start", cast(max(c) + 1 as int) AS "end", false AS active FROM runs GROUP BY doc, seq, label, run
UNION ALL SELECT doc, seq, label, "start", "end", active FROM act
"""


@query(_CLIP)
def inactive_clip(spark, sf_dir):
    rows = _lineitem(spark, sf_dir).withColumn("active", F.col("seq") % 2 == 0)
    return merge.clip_inactive(rows, "doc").select("doc", "seq", "label", "start", "end", "active")


@query(f"SELECT label, count(*) AS total, count(*) FILTER (WHERE seq % 2 = 0) AS active FROM ({SPANS}) s GROUP BY label")
def label_activity(spark, sf_dir):
    return merge.activity(_lineitem(spark, sf_dir).withColumn("active", F.col("seq") % 2 == 0))


_ALL_LABELS = [*dict.fromkeys([*(x for v in fixed.CATEGORIES.values() for x in v), *fixed.FLOOR_LABELS, "custom", "manual"])]
_OFF = [x for x in _ALL_LABELS if x in fixed.FLOOR_LABELS or x == "custom"]
_PRIVACY_NO, _CODING_NO = ("username", "sensitive_date"), ("username", "sensitive_date", "uuid", "ip_address", "organization", "file_path", "postal_code")


def _matrix() -> str:
    rows = []
    for x in _ALL_LABELS:
        floor = x in _OFF
        for mode, no in (("privacy", _PRIVACY_NO), ("coding", _CODING_NO), ("off", _ALL_LABELS)):
            rows.append(f"('{x}', '{mode}', {'true' if floor or x not in no else 'false'})")
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(label, mode, redacts)"


@query(_matrix())
def policy_matrix(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in _ALL_LABELS], "label string")
    out = None
    for mode, p in policy.MODES.items():
        part = labels.select("label", F.lit(mode).alias("mode"), policy.allows(F.col("label"), p["enabled"], p["exclude"]).alias("redacts"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"SELECT label, count(*) AS n FROM ({SPANS}) s WHERE label IN ({FLOOR}) OR NOT (label = 'email' OR (label = 'postal_code')) GROUP BY label"
)
def policy_filter_counts(spark, sf_dir):
    """Spans left by an exclude list of a label and a category; floor labels stay even if they are listed."""
    rows = _lineitem(spark, sf_dir).filter(policy.allows(F.col("label"), exclude=("email", "postal", "card")))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


_VALUES = """SELECT c_custkey AS doc, CASE c_custkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'payment_card' ELSE 'organization' END AS label,
  CASE c_custkey % 5 WHEN 0 THEN 'Jean Tremblay' WHEN 1 THEN ' JEAN tremblay ' WHEN 2 THEN 'Jean Tremblay''s' WHEN 3 THEN 'Jean' ELSE c_name END AS value FROM customer"""


@query(f"SELECT doc, label, value FROM ({_VALUES}) v WHERE label = 'payment_card' OR doc % 5 > 2")
def allowlist_anti(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    allowed = spark.createDataFrame([("jean tremblay",), ("nobody",)], "value string")
    return policy.exempt(spark.sql(_VALUES), allowed).select("doc", "label", "value")


@query(
    "SELECT p_partkey, cast(strpos(text, word) - 1 as int) AS \"start\", cast(strpos(text, word) - 1 + length(word) as int) AS \"end\", 'custom' AS label FROM"
    " (SELECT p_partkey, 'Our ' || upper(p_name) || ' (' || p_brand || ') is' AS text, unnest(['WIDGET', 'RING']) AS word FROM part) t WHERE regexp_matches(text, '[^A-Z]' || word || '[^A-Z]')"
)
def denylist_terms(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("Our "), F.upper("p_name"), F.lit(" ("), "p_brand", F.lit(") is")).alias("text"))
    return policy.denied(texts, ["widget", "ring", "w", "rin"], "p_partkey").select("p_partkey", "start", "end", "label")


_PATHS = """SELECT c_custkey AS doc, 5 AS pos, CASE c_custkey % 4 WHEN 0 THEN '/home/user' || cast(c_custkey as string) || '/notes.txt' WHEN 1 THEN 'C:' || chr(92) || 'Users' || chr(92) || 'u' || cast(c_custkey as string) || chr(92) || 'x'
  WHEN 2 THEN '/etc/hosts' ELSE '~alex/x' END AS value FROM customer"""


@query(f"""SELECT doc, CASE doc % 4 WHEN 0 THEN 'user' || cast(doc as string) WHEN 1 THEN 'u' || cast(doc as string) ELSE 'alex' END AS value,
  cast(pos + CASE doc % 4 WHEN 0 THEN 6 WHEN 1 THEN 9 ELSE 1 END as int) AS "start" FROM ({_PATHS}) p WHERE doc % 4 <> 2""")
def path_narrowing(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    rows = spark.sql(_PATHS.replace("chr(92)", "char(92)")).select("doc", F.col("pos").alias("start"), (F.col("pos") + F.length("value")).alias("end"), F.lit("file_path").alias("label"), "value")
    return policy.narrowed_paths(rows).select("doc", "value", "start")


_CLAIMS = (
    ("account_number", 2, "778812", "sensitive_ref"), ("government_id", 0, "046454286", "government_id"), ("account_number", 0, "123e4567-e89b-12d3-a456-426614174000", "uuid"),
    ("password", 2, "re.compile(r", None), ("secret", 2, "DIGIT_RUN_RE", None), ("password", 2, "short", None), ("secret", 2, "ghp_short123", "secret"), ("password", 2, "Hunter2Pass", "password"),
    ("password", 2, "correcthorse", "sensitive_ref"), ("email", 2, "core@0.2.0", None), ("email", 0, "core@0.2.0", "email"), ("person", 2, "Jean", "person"),
    ("api_key", 2, "os.environ.get", None), ("secret", 2, "356a192b7913b04c54574d18c28d46e6395428ab", None), ("payment_card", 2, "4111", "payment_card"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', {t}, '{x}', '{w}')" for x, t, v, w in _CLAIMS if w) + ") t(value, tier, claimed, label)")
def model_claims(spark, sf_dir):
    rows = spark.createDataFrame([(v, t, x, x) for x, t, v, _ in _CLAIMS], "value string, tier int, claimed string, label string")
    return policy.demoted(rows).select("value", "tier", "claimed", "label")


# Gold spans and predictions of a document: predictions miss some, shift some, mislabel some.
GOLD = f"SELECT doc, seq, \"start\", \"end\", label FROM ({SPANS}) s"
PRED = f"""SELECT doc, seq, cast("start" + doc % 3 as int) AS "start", cast("end" + doc % 3 as int) AS "end", CASE WHEN (doc + seq) % 7 = 0 THEN 'person' ELSE label END AS label FROM ({SPANS}) s
  WHERE (doc + seq) % 4 <> 0"""


def _gold_pred(spark, sf_dir):
    _lineitem(spark, sf_dir)
    ticks = lambda q: q.replace('"start"', "`start`").replace('"end"', "`end`")
    return spark.sql(ticks(GOLD)), spark.sql(ticks(PRED))


_PRF = f"""
WITH g AS ({GOLD}), p AS ({PRED}), labels AS (SELECT label FROM g UNION SELECT label FROM p),
gs AS (SELECT *, EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND p."start" < g."end" AND g."start" < p."end") AS hit,
  EXISTS (SELECT 1 FROM p WHERE p.doc = g.doc AND p."start" < g."end" AND g."start" < p."end" AND p.label = g.label) AS same FROM g),
ps AS (SELECT *, EXISTS (SELECT 1 FROM g WHERE p.doc = g.doc AND p."start" < g."end" AND g."start" < p."end" AND p.label = g.label) AS same FROM p),
c AS (SELECT label, (SELECT count(*) FROM gs WHERE gs.label = l.label) AS gold, (SELECT count(*) FROM gs WHERE gs.label = l.label AND hit) AS detected,
  (SELECT count(*) FROM gs WHERE gs.label = l.label AND same) AS labelled, (SELECT count(*) FROM ps WHERE ps.label = l.label) AS pred, (SELECT count(*) FROM ps WHERE ps.label = l.label AND same) AS "right" FROM labels l),
r AS (SELECT *, round(labelled / gold, 6) AS recall, round(detected / gold, 6) AS detect_recall, round("right" / pred, 6) AS "precision" FROM c)
SELECT *, round(2 * ("right" / pred) * (labelled / gold) / ("right" / pred + labelled / gold), 6) AS f1 FROM r
"""


@query(_PRF)
def eval_label_prf(spark, sf_dir):
    return evaluate.by_label(*_gold_pred(spark, sf_dir), "doc")


@query(f"""SELECT label, f1, label IN ({FLOOR}) AS is_floor, concat_ws(',', CASE WHEN label IN ({FLOOR}) AND recall < 0.99 THEN 'recall' END, CASE WHEN label IN ({FLOOR}) AND "precision" < 0.97 THEN 'precision' END,
  CASE WHEN f1 < 0.93 THEN 'f1' END) AS fails FROM ({_PRF}) q""")
def ship_bar_verdict(spark, sf_dir):
    return evaluate.ship_bar(eval_label_prf(spark, sf_dir), fixed.FLOOR_LABELS).select("label", "f1", "is_floor", "fails")


_CONFUSION = f"""
WITH g AS ({GOLD}), p AS ({PRED}), pairs AS (SELECT g.doc, g.seq, g.label AS gold, p.label AS pred, row_number() OVER (PARTITION BY g.doc, g.seq ORDER BY least(g."end", p."end") - greatest(g."start", p."start") DESC, p.seq) AS r
  FROM g JOIN p ON p.doc = g.doc AND p."start" < g."end" AND g."start" < p."end"),
cells AS (SELECT g.label AS gold, coalesce(b.pred, 'MISS') AS pred, count(*) AS n FROM g LEFT JOIN (SELECT * FROM pairs WHERE r = 1) b ON b.doc = g.doc AND b.seq = g.seq GROUP BY 1, 2)
SELECT gold, pred, n FROM cells WHERE gold <> pred ORDER BY n DESC, gold, pred LIMIT 10
"""


@query(_CONFUSION)
def confusion_topk(spark, sf_dir):
    return evaluate.confusion(*_gold_pred(spark, sf_dir), "doc", top=10)


@query(
    "SELECT a.vec_id AS id, round(list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) / sqrt(list_dot_product(cast(a.embedding as double[]), cast(a.embedding as double[]))"
    " * list_dot_product(cast(b.embedding as double[]), cast(b.embedding as double[]))), 6) AS cosine, list_position(a.embedding, list_max(a.embedding)) = list_position(b.embedding, list_max(b.embedding)) AS agrees"
    " FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
)
def logit_parity(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b")), "id")
    return evaluate.parity(pairs).withColumn("cosine", F.round("cosine", 6))


@query(f"SELECT * FROM (SELECT cast((2 * sum(cast(round(2 * (\"right\" / pred) * (labelled / gold) / (\"right\" / pred + labelled / gold) * 1000000) as bigint)) + count(*)) // (2 * count(*)) as double) / 1000000 AS macro_f1, round(2 * (sum(\"right\") / sum(pred)) * (sum(labelled) / sum(gold)) / (sum(\"right\") / sum(pred) + sum(labelled) / sum(gold)), 6) AS micro_f1 FROM ({_PRF}) q) q")
def macro_micro_f1(spark, sf_dir):
    return evaluate.macro_micro(eval_label_prf(spark, sf_dir))


_AUTO = f"SELECT doc, seq, \"start\", \"end\", label, true AS active FROM ({SPANS}) s WHERE seq % 3 <> 0"
_MANUAL = f"SELECT doc, seq, \"start\", \"end\", 'manual' AS label, seq % 2 = 0 AS active FROM ({SPANS}) s WHERE seq % 3 = 0"


@query(f"""WITH a AS ({_AUTO}), m AS ({_MANUAL}) SELECT doc, seq, "start", "end", label, 'auto' AS source FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc = a.doc AND m.active AND m."start" < a."end" AND a."start" < m."end")
UNION ALL SELECT doc, seq, "start", "end", label, 'manual' FROM m""")
def combine_manual(spark, sf_dir):
    """Two disjoint sets of spans of all documents, automatic and manual."""
    rows = _lineitem(spark, sf_dir).select("doc", "seq", "start", "end", "label")
    auto = rows.filter("seq % 3 <> 0").withColumn("active", F.lit(True))
    manual = rows.filter("seq % 3 = 0").withColumn("label", F.lit("manual")).withColumn("active", F.col("seq") % 2 == 0)
    return merge.with_manual(auto, manual, "doc").select("doc", "seq", "start", "end", "label", "source")


@query(f"SELECT doc, seq, \"start\", \"end\", label, tier, round(conf, 3) AS conf, rule FROM ({SPANS}) s")
def explain_spans(spark, sf_dir):
    rows = merge.explained(_lineitem(spark, sf_dir).withColumn("value", F.lit("secret")))
    return rows.select(*(c for c in rows.columns if c != "validator"))
