"""Every query with SQL gives the rows of its SQL."""

import duckdb
import pytest
from conftest import DATA, normal

from lexivec.plans import registry, structures


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(structures.QUERIES) == set(structures.SQL) and not set(structures.QUERIES) & set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(structures.QUERIES))
def test_structure_equals_sql(spark, duck, name):
    got, want = structures.QUERIES[name](spark, DATA).toPandas(), duck.sql(structures.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


#: Texts without tokens or none at all, rows without a language or an id, ids of several rows, letters that fold by what stands beside them.
ODD = [(1, "A cat, a Café", "en"), (2, "", "en"), (3, None, "en"), (4, "?! --", "en"), (5, "Der Hund", "de"), (6, "...", "fr"), (7, "who am i", None), (8, None, None), (None, "lost words", "en"), (None, "lost", None)]
ODD += [(10, "same id", "en"), (10, "same id again", "en"), (11, "two tongues", "en"), (11, "zwei Zungen", "de"), (12, "", "it"), (12, "parole", "en"), (13, "x", "en"), (13, "", None), (14, "İSTANBUL ΟΔΟΣ οδοσ ΣΑΣ", "tr"), (15, "a\u0870b \U00031350", "ar")]


@pytest.mark.parametrize("broadcast", [registry.BROADCAST_KEYS, 1])
@pytest.mark.parametrize("rows", [ODD, [r for r in ODD if r[0] is None or r[0] < 10]], ids=["repeated", "once"])
def test_token_counts_of_odd_rows_equal_sql(spark, tmp_path, monkeypatch, broadcast, rows):
    monkeypatch.setattr(registry, "BROADCAST_KEYS", broadcast)
    table = [(*r, "src0", len(r[1] or "")) for r in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, registry.tokenize_stats(spark, str(tmp_path)).select("language", "n_docs", "n_tokens", "n_terms").collect()), key=repr)
    assert got == sorted(con.sql(registry.SQL["tokenize_stats"]).fetchall(), key=repr)
