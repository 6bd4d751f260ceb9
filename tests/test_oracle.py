"""Every query with SQL against DuckDB on the smallest driver tables; the others must give rows."""

import os

import duckdb
import pytest

from lexmill.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    names = sorted(rel.columns)
    assert sorted(df.columns) == names
    want = [tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()]
    assert sorted((tuple(r[c] for c in names) for r in got), key=str) == sorted(want, key=str)


def test_answers_of_other_scripts(spark, duck, tmp_path):
    """DuckDB ends a word before a letter beyond ASCII, and its trim takes off all of Unicode's blanks."""
    after = ["", "é", "щ", "中", "²", "_", "1", "١", "a", ".", "\u200d", "\u0301", "\u00a0", "\u212a", "\n", "\x00"]
    blank = ["", " ", "\t", "\n", " \n", "\u00a0", "\u1680", "\u180e", "\u2009", "\u200b", "\u2028", "\u202f", "\u205f", "\u3000", "\x85", "\u3000 \u00a0"]
    texts = [b + w + a for b in blank for w in ("yes", "NO", "") for a in after] + [None]
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "role string, text string").write.parquet(at)
    want = duck.sql(registry.ORACLE_SQL["yes_no_labels"].replace("FROM conversations", f"FROM '{at}/*.parquet'")).fetchall()
    assert {r.role: r.label for r in registry.QUERIES["yes_no_labels"](spark, str(tmp_path)).collect()} == {role: label for label, role, _ in want}


def test_places_of_words(spark, duck, tmp_path):
    """Odd blanks and texts without words as in DuckDB."""
    texts = [None, "", " ", "a b", "a\x0bb", "a\x85b", "a\x1cb", "a\u00a0b\u3000", "\fa\rb", " \U0001f600\u00e9 \u00e9x", "\t\n a b"]
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(at)
    want = duck.sql(registry.ORACLE_SQL["word_spans"].replace("FROM documents", f"FROM '{at}/*.parquet'")).fetchall()
    assert sorted(map(tuple, registry.QUERIES["word_spans"](spark, str(tmp_path)).collect())) == sorted(want)


def test_places_of_words_are_not_held_as_objects(monkeypatch):
    """A million words in a batch: as objects their places would take some 300 MB."""
    import tracemalloc

    import pyarrow as pa

    from lexmill.functions import headings

    monkeypatch.setattr(headings.F, "arrow_udf", lambda kind: lambda f: lambda text: f(text))
    texts = pa.array(["ab " * 10_000] * 100 + [None])
    tracemalloc.start()
    got = headings.word_spans(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.null_count == 1 and got[99][-1].as_py() == {"start": 29_997, "end": 29_999} and most < 40e6
