"""Queries over sessions: entity maps of conversations, maps as of a turn, tools, JSON bodies, streams, sealed maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pseudonyms, secrets, walk
from ..session import ship
from ..sources import files

QUERIES, ORACLE_SQL = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# Values that turns of a conversation mention: one repeated in other cases, one of a case-sensitive label, one new each turn.
MENTIONS = """SELECT session, turn, start, label, value FROM (
  SELECT conv_id AS session, turn, cast(10 as int) AS start, 'email' AS label, CASE WHEN turn % 2 = 0 THEN 'Ann' ELSE 'ANN' END || cast(conv_id as string) || '@x.org' AS value FROM conversations
  UNION ALL SELECT conv_id, turn, cast(40 as int), 'person', CASE WHEN turn % 3 = 0 THEN 'Ann Lee' ELSE 'ann lee' END FROM conversations
  UNION ALL SELECT conv_id, turn, cast(70 as int), 'account_number', '77' || cast(conv_id * 1000 + turn as string) FROM conversations
  UNION ALL SELECT conv_id, turn, cast(90 as int), 'payment_card', '4111 1111' FROM conversations WHERE turn > 1) m"""


def _mentions(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/conversations.parquet").createOrReplaceTempView("conversations")
    return spark.sql(MENTIONS)


_MAP = f"""
WITH m AS (SELECT *, CASE WHEN label = 'person' THEN value ELSE lower(value) END AS key FROM ({MENTIONS}) q),
f AS (SELECT session, label, key, min(turn * 1000 + start) AS pos, arg_min(value, turn * 1000 + start) AS value, count(*) AS uses FROM m GROUP BY 1, 2, 3),
n AS (SELECT *, (SELECT count(*) FROM f g WHERE g.session = f.session AND g.label = f.label AND (g.pos < f.pos OR g.pos = f.pos AND g.key <= f.key)) AS n FROM f)
SELECT session, label, value, cast(pos // 1000 as bigint) AS first_turn, cast(n as int) AS n, '<' || upper(replace(label, '_', '')) || '_' || lpad(cast(n as string), 3, '0') || '>' AS placeholder, uses FROM n
"""


@query(_MAP)
def session_entity_map(spark, sf_dir):
    return pseudonyms.session_map(_mentions(spark, sf_dir)).select("session", "label", "value", "first_turn", "n", "placeholder", "uses")


@query(f"SELECT c.conv_id AS session, c.turn, count(*) AS n_known, max(e.n) FILTER (WHERE e.label = 'account_number') AS last_account FROM conversations c JOIN ({_MAP}) e ON e.session = c.conv_id AND e.first_turn <= c.turn GROUP BY 1, 2")
def session_map_asof_turn(spark, sf_dir):
    """The map that each turn knows: entries first seen at or before it."""
    entries = pseudonyms.session_map(_mentions(spark, sf_dir))
    turns = spark.table("conversations").select(F.col("conv_id").alias("session"), "turn")
    known = turns.join(entries, "session").filter("first_turn <= turn")
    return known.groupBy("session", "turn").agg(F.count("*").alias("n_known"), F.max(F.when(F.col("label") == "account_number", F.col("n"))).alias("last_account"))


@query(f"SELECT session, label, placeholder FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY first_turn DESC, n DESC, label DESC) AS r FROM ({_MAP}) q) q WHERE r <= 3")
def session_map_eviction(spark, sf_dir):
    return pseudonyms.kept(pseudonyms.session_map(_mentions(spark, sf_dir)), 3).select("session", "label", "placeholder")


@query(f"SELECT session, placeholder, value FROM ({_MAP}) q WHERE label IN ('email', 'person')")
def tool_arg_replay(spark, sf_dir):
    return pseudonyms.tool_map(pseudonyms.session_map(_mentions(spark, sf_dir))).select("session", "placeholder", "value")


@query(
    "SELECT c.conv_id AS session, c.turn, 'Hi Ann' || cast(c.conv_id as string) || '@x.org, and <EMAIL_999> stays' AS restored FROM conversations c"
)
def session_restore(spark, sf_dir):
    entries = pseudonyms.session_map(_mentions(spark, sf_dir).filter("label = 'email' and turn % 2 = 0"))
    maps = entries.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("restore"))
    turns = spark.table("conversations").select(F.col("conv_id").alias("session"), "turn", F.lit("Hi <EMAIL_001>, and <EMAIL_999> stays").alias("text"))
    return turns.join(maps, "session").select("session", "turn", pseudonyms.restored(F.col("text"), F.col("restore")).alias("restored"))


@query("SELECT conv_id AS session, turn, 'Mail <EMAIL_001> or <EMAIL_001>; ' || CASE WHEN turn > 0 THEN '<ACCOUNTNUMBER_001>' ELSE '7' END AS swept FROM conversations")
def session_sweep(spark, sf_dir):
    """Known values swept from later text, by a pattern of each session's own."""
    m = _mentions(spark, sf_dir)
    mail = F.concat(F.lit("ann"), F.col("session").cast("string"), F.lit("@x.org"))
    text = F.concat(F.lit("Mail "), mail, F.lit(" or <EMAIL_001>; "), F.when(F.col("turn") > 0, "acct-1").otherwise("7"))
    known = F.create_map(mail, F.lit("<EMAIL_001>"), F.lit("acct-1"), F.lit("<ACCOUNTNUMBER_001>"), F.lit("7"), F.lit("<X_001>"))
    turns = m.select("session", "turn").distinct()
    return turns.select("session", "turn", pseudonyms.swept(text, known).alias("swept"))


@query("SELECT conv_id AS session, 'sys-' || substr(sha256(min(text)), 1, 32) AS derived, substr(sha256('proj' || chr(31) || cast(conv_id as string)), 1, 32) AS map_name FROM conversations WHERE role = 'user' GROUP BY conv_id")
def session_names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("role = 'user'").groupBy(F.col("conv_id").alias("session")).agg(F.min("text").alias("text"))
    name = F.substring(F.sha2(F.concat(F.lit("proj"), F.lit(chr(31)), F.col("session").cast("string")), 256), 1, 32)
    return c.select("session", pseudonyms.session_id(F.lit(""), F.col("text")).alias("derived"), name.alias("map_name"))


@query("SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value, 'number' AS kind FROM events")
def json_walk_props(spark, sf_dir):
    ship(spark)
    walked = walk.leaves(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")
    return walked.select("event_id", "path", "value", "kind")


# A request body: messages, a tool call whose arguments are JSON in a string, routing ids.
def _bodies(spark, sf_dir):
    ship(spark)
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    args = F.to_json(F.struct(F.concat(F.lit("pw"), F.col("c_custkey").cast("string")).alias("password"), (F.col("c_custkey") % 900 + 100).alias("cvv"), F.lit("ok").alias("note")))
    call = F.struct(F.lit("call_1").alias("id"), args.alias("arguments"))
    first = F.struct(F.lit("user").alias("role"), F.concat(F.lit("I am "), "c_name").alias("content"), F.lit(None).cast(f"array<struct<id:string,arguments:string>>").alias("tool_calls"))
    second = F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.array(call).alias("tool_calls"))
    body = F.struct(F.lit("m1").alias("model"), F.array(first, second).alias("messages"), F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"), F.lit(5).alias("n"))
    return c.select("c_custkey", F.to_json(body).alias("body"))


@query(
    "SELECT c_custkey, '$.messages[0].content' AS path, 'I am ' || c_name AS value FROM customer UNION ALL SELECT c_custkey, '$.messages[1].tool_calls[0].arguments.password', 'pw' || cast(c_custkey as string) FROM customer"
    " UNION ALL SELECT c_custkey, '$.messages[1].tool_calls[0].arguments.cvv', cast(c_custkey % 900 + 100 as string) FROM customer UNION ALL SELECT c_custkey, '$.messages[1].tool_calls[0].arguments.note', 'ok' FROM customer"
    " UNION ALL SELECT c_custkey, '$.n', '5' FROM customer"
)
def json_body_fields(spark, sf_dir):
    """Text of a request, by path: content, arguments inside strings, numbers; roles, ids and the model are structure."""
    return walk.fields(walk.leaves(_bodies(spark, sf_dir), "c_custkey")).select("c_custkey", "path", "value")


@query(
    "SELECT c_custkey, 'secret' AS label, 'pw' || cast(c_custkey as string) AS value FROM customer UNION ALL SELECT c_custkey, 'card_cvv', cast(c_custkey % 900 + 100 as string) FROM customer"
)
def keyed_redaction(spark, sf_dir):
    """Values under sensitive keys, whatever they look like."""
    return walk.keyed(walk.leaves(_bodies(spark, sf_dir), "c_custkey")).select("c_custkey", "label", "value")


_KEYS = (
    ("password", "secret"), ("user_pwd", "secret"), ("apiKey", "secret"), ("api-key", "secret"), ("card_number", "payment_card"), ("cvv2", "card_cvv"), ("card_expiry", "card_expiry"), ("exp_date", "card_expiry"),
    ("ssn", "government_id"), ("nas", "government_id"), ("dob", "date_of_birth"), ("date_of_birth", "date_of_birth"), ("using", None), ("canvas", None), ("spinning", None), ("name", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {repr(v) if v else 'NULL'})" for k, v in _KEYS) + ") t(name, label)")
def sensitive_keys(spark, sf_dir):
    return spark.createDataFrame([(k,) for k, _ in _KEYS], "name string").select("name", secrets.key_label(F.col("name")).alias("label"))


@query("SELECT c_custkey, c_name AS opened, true AS differs FROM customer")
def sealed_maps(spark, sf_dir):
    """Maps under AES-GCM and opened again."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("key", F.expr("unhex(substring(sha2('k', 256), 1, 32))"))
    sealed = c.withColumn("sealed", files.sealed(F.col("c_name"), F.col("key")))
    return sealed.select("c_custkey", files.opened(F.col("sealed"), F.col("key")).alias("opened"), (F.col("sealed") != F.col("c_name")).alias("differs"))


@query("SELECT c_custkey AS session FROM customer WHERE c_custkey % 40 <= 24 AND c_custkey % 300 <= 168")
def map_expiry(spark, sf_dir):
    hours = lambda n: (1e6 - (F.col("c_custkey") % n) * 3600).cast("double")
    maps = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("session"), hours(40).alias("last_used"), hours(300).alias("created"))
    return files.live(maps, 1e6).select("session")


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE cast(o_custkey as bigint) END AS map_id FROM orders"
)
def fingerprint_match(spark, sf_dir):
    """Saved maps found again by the hash of a redacted body; two maps for one hash are ambiguous and give none."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    body = F.sha2(F.concat(F.lit("body "), F.col("o_orderkey").cast("string")), 256)
    saved = orders.select(body.alias("hash"), F.col("o_custkey").alias("map_id")).unionByName(orders.filter("o_orderkey % 3 = 2").select(body.alias("hash"), (F.col("o_custkey") + 1).alias("map_id")))
    one = saved.groupBy("hash").agg(F.countDistinct("map_id").alias("n"), F.min("map_id").alias("map_id")).withColumn("map_id", F.when(F.col("n") == 1, F.col("map_id")))
    return orders.select("o_orderkey", body.alias("hash")).join(one, "hash", "left").select("o_orderkey", "map_id")


_FOUND = "list_distinct(regexp_extract_all(text || ' <A_001> <B_002> <A_001> <a_003> <C_12>', '<[A-Z][A-Z0-9_]*_[0-9]{3,}>'))"


@query(f"SELECT doc_id, list_sort({_FOUND})[1] AS first_found, cast(len({_FOUND}) as int) AS n FROM documents")
def placeholders_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = pseudonyms.placeholders(F.concat("text", F.lit(" <A_001> <B_002> <A_001> <a_003> <C_12>")))
    return docs.select("doc_id", F.get(found, F.lit(0)).alias("first_found"), F.size(found).alias("n"))


@query()
def streamed_restore(spark, sf_dir):
    """Pieces of text that cut placeholders in two, restored by a stateful stream and put together again."""
    import tempfile

    from ..streaming import restore

    ship(spark)
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = "Dear <PERSON_001>, a < b and <EMAIL_001>! <PERSON_002>"
    streams = conversations.select("conv_id").distinct()
    pieces = streams.select("conv_id", F.explode(F.sequence(F.lit(0), F.lit((len(text) - 1) // 7))).alias("seq"))
    who = F.concat(F.lit("n"), F.col("conv_id").cast("string"))
    pieces = pieces.select(F.col("conv_id").cast("string").alias("stream_id"), F.lit(0).alias("block"), F.col("seq").cast("long").alias("seq"), F.lit(text).alias("whole"), who.alias("who"))
    pieces = pieces.select(
        "stream_id", "block", "seq", F.substring("whole", (F.col("seq") * 7 + 1).cast("int"), F.lit(7)).alias("text"),
        F.create_map(F.lit("<PERSON_001>"), F.col("who"), F.lit("<EMAIL_001>"), F.lit("a@b.c")).alias("restore"), (F.col("seq") == (len(text) - 1) // 7).alias("final"),
    )
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream")
    name = f"{base}/stream-{abs(hash((sf_dir, id(pieces))))}"
    pieces.write.mode("overwrite").parquet(f"{name}/in")
    stream = restore.restored(spark.readStream.schema(pieces.schema).parquet(f"{name}/in"))
    stream.writeStream.format("parquet").option("path", f"{name}/out").option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start().awaitTermination()
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return spark.read.parquet(f"{name}/out").groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


ORACLE_SQL["streamed_restore"] = "SELECT DISTINCT cast(conv_id as string) AS stream_id, 'Dear n' || cast(conv_id as string) || ', a < b and a@b.c! <PERSON_002>' AS text FROM conversations"


@query("SELECT conv_id AS session, turn, CASE WHEN turn = 0 THEN 'frozen ' || cast(conv_id as string) ELSE 'now <X_001>' END AS redacted FROM conversations")
def frozen_turns(spark, sf_dir):
    """Turns sent before keep the redacted text that they had; others are redacted by today's map."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    texts = c.select(F.col("conv_id").alias("session"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("text"))
    memo = c.select(F.col("conv_id").alias("session")).distinct().select("session", F.sha2(F.lit("turn 0"), 256).alias("hash"), F.concat(F.lit("frozen "), F.col("session").cast("string")).alias("redacted"))
    out = pseudonyms.frozen(texts, memo, lambda new: new.withColumn("redacted", F.lit("now <X_001>")))
    return out.select("session", F.regexp_extract("text", r"\d+", 0).cast("long").alias("turn"), "redacted")
