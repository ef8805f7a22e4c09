"""The whole way of a text, bodies, office files, growth, labelled corpora."""

import base64
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from maskerade.functions.spans import SPAN
from maskerade.operators import bodies, corpus, growth, labelling, merge, policy, pseudonyms, tagging, walk
from maskerade.plans import redaction
from maskerade.session import ship
from maskerade.sources import files, office
from maskerade.streaming import restore


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_redaction_modes_and_dictionaries(spark):
    text = "Ann Lee <ann@x.org> paid 4111111111111111 on project Falcon from 10.0.0.1, id 123e4567-e89b-12d3-a456-4266141740ab. ANN LEE again."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    out = {m: {r["doc_id"]: r for r in redaction.redact(docs, mode=m, denied=["falcon"], allowed=["ann@x.org"]).collect()} for m in ("privacy", "off")}
    private, off = out["privacy"][1]["redacted"], out["off"][1]["redacted"]
    assert private == "<PERSON_001> <ann@x.org> paid <PAYMENT_CARD_001> on project <CUSTOM_001> from <IP_ADDRESS_001>, id <UUID_001>. <PERSON_002> again."
    assert off == "Ann Lee <ann@x.org> paid <PAYMENT_CARD_001> on project <CUSTOM_001> from 10.0.0.1, id 123e4567-e89b-12d3-a456-4266141740ab. ANN LEE again."
    assert out["privacy"][1]["found"]["payment_card"] == 1
    assert out["privacy"][2]["restore"] == {} and out["privacy"][3]["redacted"] == ""


def test_redaction_with_a_models_spans(spark):
    text = "we met Jean-Luc Tremblay tomorrow; TREMBLAY agreed."
    span = [(7, 11, "person", 2, 0.9, "model", None, "Jean")]
    docs = spark.createDataFrame([(1, text, span)], f"doc_id long, text string, found_spans array<{SPAN}>")
    assert redaction.redact(docs, spans="found_spans").first()["redacted"] == "we met <PERSON_001> tomorrow; <PERSON_002> agreed."


def test_growth():
    text = "INFO user=John Error; Dr Ann de la Roche S paid"
    assert growth.grown(text, 10, 14) == (10, 14)
    a = text.index("Ann")
    assert text[slice(*growth.grown(text, a, a + 2))] in ("Ann de la Roche S", "Dr Ann de la Roche S")
    assert growth.grown("x  Ann  y", 3, 6) == (3, 6)


def test_bodies_keep_order_and_duplicates(spark):
    inner = json.dumps({"q": "Ann", "pin": 5571})
    body = '{"b": 1, "a": "Ann", "a": "Ann", "args": ' + json.dumps(inner) + ', "file": "data:text/plain;base64,' + base64.b64encode(b"Ann is here").decode() + '", "content": {"type": "thinking", "text": "Ann"}, "id": "Ann"}'
    df = spark.createDataFrame([(body,), ("not json",), (None,)], "body string")
    red = [r[0] for r in df.select(bodies.redacted(F.col("body"), F.create_map(F.lit("Ann"), F.lit("<PERSON_001>")))).collect()]
    pairs = json.loads(red[0], object_pairs_hook=list)
    assert [k for k, _ in pairs] == ["b", "a", "a", "args", "file", "content", "id"]
    got = dict(pairs)
    assert got["a"] == "<PERSON_001>" and got["id"] == "Ann" and dict(got["content"])["text"] == "Ann"
    assert json.loads(got["args"]) == {"q": "<PERSON_001>", "pin": "<SECRET_001>"}
    assert base64.b64decode(got["file"].partition(",")[2]) == b"<PERSON_001> is here"
    assert red[1:] == ["not json", None]


def test_restored_keys_collide(spark):
    df = spark.createDataFrame([('{"<A_001>": 1, "x": {"<A_001>": "<A_001>", "<B_001>": 2}}',)], "body string")
    values = F.create_map(F.lit("<A_001>"), F.lit("v"), F.lit("<B_001>"), F.lit("v"))
    out = df.select(bodies.restored(F.col("body"), values)).first()[0]
    assert out == '{"v": 1, "x": {"v": "v", "v.dup1": 2}}'


def test_walk_opens_strings(spark):
    df = spark.createDataFrame([(1, '{"a": [1, "x", {"b": "{\\"c\\": true}"}], "user_id": "u"}'), (2, "broken {"), (3, None)], "i long, body string")
    got = {(r["i"], r["path"], r["value"], r["kind"]) for r in walk.leaves(df, "i").collect()}
    assert got == {(1, "$.a[0]", "1", "number"), (1, "$.a[1]", "x", "string"), (1, "$.a[2].b.c", "true", "boolean"), (1, "$.user_id", "u", "string"), (2, "$", "broken {", "string")}  # what can't be parsed is a leaf
    assert {r["path"] for r in walk.fields(walk.leaves(df, "i")).collect()} == {"$", "$.a[0]", "$.a[1]"}


def docx(*paragraphs):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
        z.writestr("word/document.xml", f"<w:document><w:body>{body}<w:del><w:t>gone</w:t></w:del></w:body></w:document>")
        z.writestr("docProps/core.xml", "<a>Ann</a>")
    return made.getvalue()


def test_office(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("Dear Ann &amp; co", "bye"))
    df = office.read(spark, str(tmp_path))
    assert df.first()["text"] == "Dear Ann & co\nbye"
    data = df.select(office.written(F.col("content"), F.create_map(F.lit("Ann"), F.lit("<PERSON_001>"))).alias("c")).first()["c"]
    assert office.text_of(bytes(data)) == "Dear <PERSON_001> & co\nbye"
    assert "docProps/core.xml" not in zipfile.ZipFile(io.BytesIO(bytes(data))).namelist()


def test_files(spark, tmp_path):
    (tmp_path / "allow.txt").write_text("# names\nAnn  # mine\n\nBob\nBob\n")
    assert {r[0] for r in files.dictionary(spark, str(tmp_path / "allow.txt")).collect()} == {"Ann", "Bob"}
    (tmp_path / "gold.jsonl").write_text(json.dumps({"input": "hi Ann", "output": {"spans": [[3, 6, "person"]], "entities": {"person": ["Ann"]}}, "meta": {"lang": "en"}}) + "\n")
    row = files.gold(spark, str(tmp_path / "gold.jsonl")).first()
    assert row["text"][row["spans"][0]["start"] : row["spans"][0]["end"]] == "Ann"
    names = files.neutral_names(spark.createDataFrame([("b",), ("a",)], "path string"), "path").orderBy("path").collect()
    assert [r["name"] for r in names] == ["document-0001.txt", "document-0002.txt"]


def test_generated_documents_are_true(spark):
    rows = labelling.generated(spark, 300).collect()
    assert len(rows) == 300 and {r["kind"] for r in rows} == set(labelling.KINDS)
    again = {r["id"]: r["text"] for r in labelling.generated(spark, 300).collect()}
    for r in rows:
        assert again[r["id"]] == r["text"]
        for s in r["spans"]:
            v = r["text"][s["start"] : s["end"]]
            assert v and v == v.strip() and "{" not in v
            if s["label"] == "payment_card":
                d = [int(c) for c in v]
                assert sum(d[-1::-2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[-2::-2]) % 10


def test_windows_of_gold_and_tags(spark):
    text = "word " * 115 + "Ann Marie Lee " + "word " * 40
    a = text.index("Ann")
    df = spark.createDataFrame([(1, text, [(a, a + 13, "person")])], "id long, text string, spans array<struct<start:int,end:int,label:string>>")
    rows = labelling.windowed(df, "id").orderBy("chunk_no").collect()
    for r in rows:
        for s in r["spans"]:
            assert r["text"][s["start"] : s["end"]] == "Ann Marie Lee"
    assert sum(len(r["spans"]) for r in rows) + sum(r["n_cut"] for r in rows) >= 1
    tags = [t["tag"] for t in df.select(labelling.token_tags(F.col("text"), F.col("spans")).alias("t")).first()["t"]]
    assert tags[115:118] == ["B-person", "I-person", "I-person"] and set(tags[:115]) == {"O"}


def test_augmenters_keep_length(spark):
    df = spark.createDataFrame([("Élan déjà-vu ß x",)], "text string")
    for kind in ("capitals", "blanks", "dashes", "accents"):
        assert len(df.select(labelling.perturbed(F.col("text"), kind)).first()[0]) == 16
    assert labelling.augmented(df, 1.0, "dashes").count() == 2 and labelling.augmented(df, 0.0, "dashes").count() == 1


def test_unknown_labels_fail(spark):
    spans = spark.createDataFrame([("odd",)], "label string")
    known = spark.createDataFrame([("a", "b")], "source_label string, label string")
    with pytest.raises(Exception, match="unknown label"):
        corpus.strict_labels(spans, known).collect()


def test_bio_decoding_against_a_plain_program(spark):
    rng = random.Random(3)
    rows = [(i, [(2 * k, 2 * k + 1, rng.choice(("O", "B-a", "I-a", "B-b", "I-b")), rng.choice((0.4, 0.6, 0.9))) for k in range(rng.randint(0, 9))]) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, tokens array<struct<start:int,end:int,tag:string,p:double>>")
    got = {r["i"]: [(s["start"], s["end"], s["label"], s["conf"]) for s in r["d"]] for r in df.select("i", tagging.decode(F.col("tokens")).alias("d")).collect()}
    for i, tokens in rows:
        out, cur = [], None
        for a, b, tag, p in tokens:
            if tag == "O":
                cur = None
            elif cur and tag[0] == "I" and cur[2] == tag[2:]:
                cur[1], cur[3] = b, min(cur[3], p)
            else:
                cur = [a, b, tag[2:], p]
                out.append(cur)
        assert got[i] == [tuple(s) for s in out if s[3] >= 0.5]


def test_path_policy(spark):
    rows = spark.createDataFrame([(0, 12, "file_path", "/home/al/x/y")], "start int, end int, label string, value string")
    assert [(r["start"], r["end"], r["value"]) for r in policy.narrowed_paths(rows).collect()] == [(6, 8, "al")]
    assert policy.narrowed_paths(rows, "passthrough").count() == 0 and policy.narrowed_paths(rows, "full").first()["end"] == 12


def test_merge_of_nothing(spark):
    df = spark.createDataFrame([(1, [])], f"i long, spans array<{SPAN}>")
    assert df.select(merge.merge(F.col("spans")).alias("m")).first()["m"] == []


def test_unresolved_placeholders_fail(spark):
    df = spark.createDataFrame([("a <X_001> <Y_001>",)], "text string")
    good = F.create_map(F.lit("<X_001>"), F.lit("1"), F.lit("<Y_001>"), F.lit("2"))
    assert df.select(pseudonyms.restored_whole(F.col("text"), good)).first()[0] == "a 1 2"
    with pytest.raises(Exception, match="no value for <Y_001>"):
        df.select(pseudonyms.restored_whole(F.col("text"), F.create_map(F.lit("<X_001>"), F.lit("1")))).collect()


def test_tool_arguments_come_whole(spark, tmp_path):
    schema = "stream_id string, block int, seq long, text string, restore map<string,string>, final boolean"
    text = '{"path": "<PATH_001>", "n": 1}'
    rows = [(s, 0, k, text[k * 9 : k * 9 + 9], {"<PATH_001>": s}, k == 3) for s in ("x", "y") for k in (2, 0, 3, 1)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = restore.gathered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("gathered").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {(r["stream_id"], r["text"]) for r in spark.table("gathered").collect()} == {(s, text.replace("<PATH_001>", s)) for s in ("x", "y")}
