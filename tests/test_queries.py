"""Every registered query of the library against its SQL."""

import duckdb
import pytest

from tests.oracle import agree, rows_of
from vellum import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    agree(spark, sf_dir, registry.QUERIES[name], registry.ORACLE[name])


def test_decoded_texts_of_odd_documents(spark, tmp_path):
    """Null, empty and short texts, characters that a charset hasn't, and a few words again and again, whose bytes could be those of other charsets; each with all remainders of doc_id."""
    odd = [None, "", "a", "Été 章 😀 &#65; &amp; &#x41; œuvre €5 ﬁn " * 8, "été İstanbul ΟΔΟΣ " * 12, "\ufffd été " * 40, "su " * 80, "um us " * 40, "ññas " * 50, "éèen " * 50, "Èêre üöer " * 30, "Öäie éé, " * 30]
    odd += ["enréoi ÊÇ!! " * 20, "chälich ßß " * 20, "TZ!! " * 50, "in ing is and " * 20, "enlichzuer " * 20 + "zuö", "Ñí, ñí de la " * 20, "“or” to – “in” " * 20]
    rows = [(105 * k + r, t) for k, t in enumerate(odd) for r in range(105)]
    rows += [(105 * k + r, t) for k, t in enumerate(("è " * 110, "ó, " * 80), len(odd)) for r in range(0, 105, 5)]  # what windows-1252 could as well be Cyrillic, in UTF-8
    rows += [(105 * k + r, t) for k, t in enumerate(("éé " * 70, "üö. " * 70), len(odd) + 2) for r in range(4, 105, 5)]  # no Cyrillic word is without a vowel
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["decoded_texts"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = c.execute(registry.ORACLE["decoded_texts"])
    names, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert (names, [x for x in rows_of(found.columns, [tuple(r) for r in found.collect()])[1] if x not in set(want)]) == (names, [])
    assert found.count() == len(rows)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
