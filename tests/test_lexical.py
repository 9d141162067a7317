import math

import pytest
from pyspark.sql import functions as F

from lexivec.functions import text as T
from lexivec.operators import lexical

ROWS = [("a", "src/a.rs", "rust", "the quick brown fox"), ("b", "src/b.go", "go", "the lazy Café dog, the end"), ("c", "Src/c.py", "python", "store_driver stores quick things"), ("d", "tests/d.rs", "rust", "quick fox"), ("e", "x/e.md", "markdown", None), ("f", "x/f.md", "markdown", "")]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(ROWS, "chunk_id string, path string, language string, content string")


def ids(df):
    return [r.chunk_id for r in df.collect()]


def test_literal_query_quotes_words():
    assert lexical.literal_query('a "b') == '"a" AND """b"'


def test_blank_query_is_empty(chunks):
    assert ids(lexical.search(chunks, "  ")) == []


def test_score_is_bm25(chunks):
    row = lexical.search(chunks, "lazy").first()
    lengths = [4, 6, 5, 2, 0, 0]
    idf = math.log((6 - 1 + 0.5) / (1 + 0.5))
    assert row.score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / (sum(lengths) / 6))))


def test_accents_and_case_fold(chunks):
    assert ids(lexical.search(chunks, "CAFE")) == ["b"]


def test_letters_fold_one_by_one(spark):
    rows = spark.createDataFrame([("a", "İSTANBUL ΟΔΟΣ"), ("b", "istanbul"), ("c", "a\u0870b")], "chunk_id string, content string").withColumn("path", F.lit("p"))
    assert sorted(ids(lexical.search(rows, "istanbul"))) == sorted(ids(lexical.search(rows, "İstanbul"))) == ["a", "b"]
    assert ids(lexical.search(rows, "ΟΔΟΣ")) == ids(lexical.search(rows, "οδοσ")) == ["a"]
    assert ids(lexical.search(rows, "a\u0870b")) == ["c"] and ids(lexical.search(rows, "a")) == []
    assert [r.s for r in rows.select(T.match_snippet(F.col("content"), ["istanbul"]).alias("s")).collect()] == ["[İSTANBUL] ΟΔΟΣ", "[istanbul]", None]


def test_underscored_word_is_a_phrase(chunks):
    assert ids(lexical.search(chunks, "store_driver")) == ["c"]


def test_sign_only_word_matches_nothing(chunks):
    assert ids(lexical.search(chunks, "quick ()")) == []


def test_test_paths_are_hidden_but_counted(chunks):
    assert ids(lexical.search(chunks, "fox")) == ["a"]


def test_boolean_language(chunks):
    find = lambda q: sorted(ids(lexical.search(chunks, q, literal=False)))
    assert find("quick OR lazy") == ["a", "b", "c"]
    assert find("quick NOT brown") == ["c"]
    assert find('"brown fox"') == ["a"]
    assert find("brown + fox") == ["a"]
    assert find("sto*") == ["c"]
    assert find("^the") == ["a", "b"]
    assert find("(quick OR lazy) AND the") == ["a", "b"]
    assert find("quick brown") == ["a"]
    assert find("NEAR(the fox, 2)") == ["a"]
    assert find("NEAR(the fox, 1)") == []
    assert find("content : lazy") == ["b"]


def test_bad_queries(chunks):
    for q in ("(quick", "path : x", "AND", "quick OR"):
        with pytest.raises(lexical.QueryError):
            lexical.parse(q)


def test_filters_keep_statistics(chunks):
    whole = {r.chunk_id: r.score for r in lexical.search(chunks, "quick").collect()}
    some = {r.chunk_id: r.score for r in lexical.search(chunks, "quick", languages=["python"]).collect()}
    assert some == {"c": whole["c"]}
    assert sorted(ids(lexical.search(chunks, "quick", prefixes=["src/"]))) == ["a", "c"]


def test_snippet_brackets_hits(chunks):
    assert lexical.search(chunks, "lazy dog", snippets=True).first().snippet == "…[lazy] Café [dog] the end"


def test_postings(chunks):
    got = {(r.term, r.chunk_id): (r.tf, r.length) for r in lexical.postings(chunks).collect()}
    assert got["the", "b"] == (2, 6) and ("", "f") not in got


@pytest.mark.parametrize("query", ["quick OR lazy", "quick NOT brown", '"brown fox"', "brown + fox", "sto*", "^the", "(quick OR lazy) AND the", "quick brown", "NEAR(the fox, 2)", "NEAR(the dog end, 3)", "th* AND ^the", '"the end"', '"()"', "missing", "cafe OR qu*"])
def test_index_gives_the_same_rows(spark, chunks, tmp_path, query):
    index = lexical.Index.build(chunks, str(tmp_path / "index"))
    for options in ({}, {"languages": ["rust", "go"]}, {"prefixes": ["src/"]}, {"snippets": True}):
        plain, held = (sorted(map(tuple, lexical.search(chunks, query, literal=False, digits=9, index=i, **options).collect())) for i in (None, index))
        assert plain == held


def test_index_of_an_empty_table(spark, chunks, tmp_path):
    index = lexical.Index.build(chunks.limit(0), str(tmp_path / "index"))
    assert lexical.search(chunks.limit(0), "quick", index=index).count() == 0
