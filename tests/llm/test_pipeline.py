"""The pipeline, stage by stage, against plain programs over the stage's own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from maskerade.llm import mixing, quality_crf

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, documents, tmp_path_factory):
    """What each stage got and gave, written and read again."""
    folder = str(tmp_path_factory.mktemp("sf"))
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{k}")
        made = spark.read.parquet(f"{folder}/{k}")
        out[name] = (docs, made)
        docs = made
    out["folder"] = folder
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages, documents):
    for name, (docs, made) in list((k, v) for k, v in stages.items() if k != "folder")[:-1]:
        assert made.columns == documents.columns, name
        assert docs.columns == documents.columns


def test_quality(stages):
    docs, made = stages["quality rules"]
    verdict = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality_crf.score(docs, quality_crf.PRIOR).collect()}
    kept = texts(made)
    assert set(kept) == {i for i, (k, _) in verdict.items() if k} and kept
    assert all(len(WORD.findall(t)) >= 50 for t in kept.values())
    assert all(texts(docs)[i] == t for i, t in kept.items())


def test_one_of_each_group_stays(stages):
    docs, made = stages["n-gram Jaccard join"]
    sets = {}
    for i, t in texts(docs).items():
        w = WORD.findall(t)
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False))
    left, gone = set(sets), set()
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            group.add(i)
            new = {j for j in left - group if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
            group |= new
            todo += new
        gone |= group - {min(group)}
        left -= group
    assert gone and set(texts(made)) == set(sets) - gone


def test_passages_go(stages):
    docs, made = stages["suffix-array dedup"]
    seen, want = set(), {}
    for i, t in sorted(texts(docs).items()):
        b = t.encode()
        cut = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                cut[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = bytes(x for x, c in zip(b, cut, strict=True) if not c).decode("utf-8", "ignore")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in made.collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert any(want[i] != t for i, t in texts(docs).items())


def test_mixture_takes_what_was_decided(stages):
    docs, made = stages["mixing sources to target weights"]
    decided = {r["doc_id"]: (r["size"], r["taken"], r["target"]) for r in mixing.mix_digest(docs).collect()}
    copies = Counter(r["doc_id"] for r in made.collect())
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target = defaultdict(int), {}
    for i, (size, words, goal) in decided.items():
        assert copies[i] * size == words <= 3 * size
        taken[source[i]] += words
        target[source[i]] = goal
    assert all(abs(taken[s] - target[s]) <= 300 for s in target)


def test_sequences_hold_every_token(stages):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    reference = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs, made = stages["best-fit packing"]
    want = Counter()
    for r in docs.collect():
        want[r["doc_id"]] += len(reference.encode(r["text"], add_special_tokens=False).ids) + 1
    got, used = Counter(), Counter()
    for r in made.collect():
        got[r["doc_id"]] += r["length"]
        used[r["sequence_id"]] += r["length"]
    assert got == want and max(used.values()) <= 2048
    assert len(used) <= -(-sum(want.values()) // 2048) + 1


def test_run_gives_the_last_stages_rows(spark, stages):
    _, made = stages["best-fit packing"]
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, stages["folder"])) == key(made)
