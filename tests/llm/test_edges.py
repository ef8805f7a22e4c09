"""Every operator on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import zlib

import pytest

from maskerade.llm import chroma, jaccard_forest, langid, lm_bloom, mixing, packing, quality_crf, sharding, suffix_dedup, template_html

OPERATORS = {
    "join": jaccard_forest.join,
    "quality": lambda d: quality_crf.score(d, quality_crf.PRIOR),
    "passages": suffix_dedup.digest,
    "mix": mixing.mix_digest,
    "shards": sharding.shard_documents,
    "languages": lambda d: langid.predict(d, langid.train(d)),
    "scores": lm_bloom.score_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_give_a_row_each(odd, odd_rows, name):
    rows = OPERATORS[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in odd_rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, name):
    assert OPERATORS[name](nothing).collect() == []


KEEP = {
    "join": jaccard_forest.keep_one,
    "passages": suffix_dedup.remove,
    "mix": mixing.mix,
    "quality": lambda d: quality_crf.keep(d, quality_crf.PRIOR),
}


def left(name, odd, odd_rows):
    """How many of the odd rows a stage gives."""
    if name == "join":  # those without a word, and one of each text
        texts = [r[1] for r in odd_rows if r[1] and r[1].split()]
        return len(odd_rows) - len(texts) + len(set(texts))
    if name == "mix":
        sizes = odd.select("doc_id", "source", mixing.common.word_count(odd["text"]).alias("size"))
        return sum(r["copies"] for r in mixing.decide(sizes).collect())
    return sum(r["kept"] for r in quality_crf.score(odd, quality_crf.PRIOR).collect()) if name == "quality" else len(odd_rows)


@pytest.mark.parametrize("name", KEEP)
def test_stages_return_the_rows_and_columns(odd, odd_rows, nothing, name):
    kept = KEEP[name](odd)
    assert kept.columns == odd.columns
    assert kept.count() == left(name, odd, odd_rows)
    assert KEEP[name](nothing).collect() == []


def test_join_on_odd_rows(odd):
    rows = {(r["doc_id"], r["n_copies"], r["n_links"], r["class_id"]) for r in jaccard_forest.join(odd).collect()}
    assert {(4, 2, 1, 4), (5, 2, 1, 4), (7, 2, 1, 7), (1, 1, 0, 1), (2, 1, 0, 2)} <= rows


def test_passages_of_rows_without_a_key(odd):
    rows = suffix_dedup.digest(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["kept_sha256"]))
    assert by[1] == [(0, 0, hashlib.sha256(b"").hexdigest())]
    long = next(n for n, _, _ in by[4])
    assert by[5] == [(long, long, hashlib.sha256(b"").hexdigest())]
    assert by[6][0][:2] == (200_000, 199_900 + 100 - 100 + 99) or by[6][0][1] >= 199_900
    assert sorted(x[1] for x in by[7])[-1] == 810  # the second of the repeated rows goes whole


def test_packing_of_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    assert sum(r["start"] == 0 for r in rows) == 12
    assert [r for r in rows if r["doc_id"] == 2][0]["ids_crc32"] == zlib.crc32(b"\0\0\0\0")
    assert packing.pack_documents(nothing).collect() == []


def test_quality_without_labels(spark, documents, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_crf.train(documents, labels) is quality_crf.PRIOR
    assert quality_crf.train(nothing, labels) is quality_crf.PRIOR


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, token string, container string"
    broken = "<p>a<p>b<div class='ad'>no</div><script>x</p></script><b>c&nbsp;&amp; <i>d</i>\n e<!-- open"
    rows = [(None, None, None), (1, "http://h/x", ""), (2, "http://h/y", broken), (2, "http://h/y", broken), (3, "nonsense", "plain text"), (4, "http://h/z", "<article>" + "<p>long</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], schema)
    got = {(r["page_id"], r["text"]) for r in template_html.extract(pages).collect()}
    assert {(None, ""), (1, ""), (2, "a\n\nb\n\nc & d e"), (3, "plain text"), (4, "\n\n".join(["long"] * 20_000))} == got
    assert template_html.extract(spark.createDataFrame([], schema)).collect() == []


def test_recordings(spark):
    schema = "id long, samples array<float>, sound string, print string"
    rows = [(None, None), (50, None), (100, []), (150, [0.1]), (200, [0.1, None] * 40), (200, [0.1, None] * 40), (201, [0.1, 0.0] * 40)]
    got = {(r["id"], r["n_frames"], r["n_matches"]) for r in chroma.search_digest(spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)).collect()}
    assert {(None, 0, None), (50, 0, 0), (100, 0, 0), (150, 0, 0), (200, 64, 2)} <= got
    assert chroma.search_digest(spark.createDataFrame([], schema)).collect() == []
