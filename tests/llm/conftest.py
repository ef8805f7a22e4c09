import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, syllables=("the", "tion", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ti", "es", "or", "st")):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small invented documents with exact copies, near copies and shared passages."""
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7]]
    for k in (10, 11, 12, 13):
        words = (texts[k] + " " + prose(rng, 80)).split()
        texts[k] = " ".join(words)
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    passage = prose(rng, 40)
    texts += [f"{prose(rng, 20)}\n{passage}\n{prose(rng, 30)}" for _ in range(5)]
    texts += ["élan " * 70 + "日本語 テスト", passage + passage, "a", "b c", "x" * 350, "\n\n", "  "]
    return [(i, t, ("en", "fr")[i % 2], f"s{i % 5}", len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    rng = random.Random(9)
    long = prose(rng, 30_000)
    return [
        (None, None, None, None, None),
        (None, "text without an id " * 20, "en", None, 380),
        (1, None, "en", "a", 0),
        (2, "", None, "a", 0),
        (3, "   \n\t ", "fr", None, 6),
        (4, long, "en", "b", len(long)),
        (5, long, "en", "b", len(long)),
        (6, "y" * 200_000, "en", "b", 200_000),
        (7, "same words again and again " * 30, "en", "a", 810),
        (7, "same words again and again " * 30, "en", "a", 810),
        (7, "another text under the same id", "fr", "c", 30),
        (8, "\x00\x1c odd​ \U0001f600 ␀ ' 's 'll don't", "fr", "c", 10),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    names = ("_h", "_b", "did", "node", "prefix", "size", "length", "count", "key", "kept", "bucket", "_nth", "copies", "x", "text_crc32")
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from maskerade.session import ship

    ship(spark)
