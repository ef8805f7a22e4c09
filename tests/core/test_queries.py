"""Every registered query that SQL can express, against DuckDB on the same tables."""

import decimal
import glob

import duckdb
import pytest

from maskerade import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rpartition('/')[2].removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return str(list(v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert sorted(names) == columns
    assert got == want


def test_queries_without_sql(spark):
    assert queries.QUERIES["line_chunks"](spark, SF).count() > 200
    assert queries.QUERIES["wide_profile_counts"](spark, SF).count() > 2


def test_flagship(spark):
    assert queries.flagship(spark, SF).count() > 0


def against_sql(spark, folder, name, texts):
    """Rows of a query of documents with these texts, and those of its SQL."""
    path = str(folder / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    df = queries.QUERIES[name](spark, str(folder))
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    return sorted(map(tuple, df.select(*names).collect()), key=str), sorted(result.fetchall(), key=str)


def test_secret_assignments_are_those_of_the_sql(spark, tmp_path):
    """Other spellings of the key, values with blanks and line ends, quotes left open, hashes in capitals."""
    hash_ = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
    texts = [f'a token = "{hash_}", b', f'TOKEN = "{hash_.upper()}"!!', f'token = "{hash_.upper()}"', 'token = "two words, here; now"token = "abc\ndefg"', f'token = "{hash_}\n"', 'Token: abcdefgh, token="abcdefgh"', 'token = "short" token = "left open', 'token = "tokén 😀 = "', None, ""]
    got, want = against_sql(spark, tmp_path, "secret_assignments", texts)
    assert got == want and len(got) == 6


def test_wire_redaction_reads_addresses_from_the_text(spark, tmp_path):
    """Addresses behind a line end, in two spellings, with invisible characters next to them, and twice in a text."""
    texts = ["Eriner thanea.\nthe.65@mail7.example.com The", "Ann@X.org, ann@x.org and ann@x.org", "a\u200bb.c@x.org or d@x.org\u200b.net", "ask x@y.co.uk\te@f.fr", "none @ all", None, ""]
    got, want = against_sql(spark, tmp_path, "wire_redaction", texts)
    assert got == want and len(got) == 7
