"""What queries do with larger tables: what they build, move and hold, told by their plans and by what they leave."""

import pandas as pd
import pytest

from lexivec.operators import fusion, graph, lexical, trace
from lexivec.plans import registry as R
from lexivec.plans import structures as S

from conftest import DATA


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.parametrize("name", ["hybrid_query", "symbol_roots", "result_lines", "query_hits", "rrf_fusion"])
def test_a_few_searches_build_no_index(spark, monkeypatch, name):
    query = (R.QUERIES | S.QUERIES)[name]
    monkeypatch.setattr(R, "_HELD", {})
    scanned = sorted(map(tuple, query(spark, DATA).collect()))
    assert not any(key[1] == "index" for key in R._HELD)
    R.held_index(spark, DATA)
    assert scanned and sorted(map(tuple, query(spark, DATA).collect())) == scanned


@pytest.mark.parametrize("text", ["a NOT b", "(a OR b) AND c", "NEAR(a b, 2)", 'clow* OR "é x"', "a NOT (b NOT c)", "^a OR c"])
def test_rows_left_out_before_tokens_are_made_match_nothing(spark, text):
    words = ["a", "b", "c", "clown", "É x", "x", "ab", "Ca"]
    rows = [(i, "p/" + str(i), " ".join(words[j] for j in range(8) if i >> j & 1)) for i in range(256)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, content string")
    node = lexical.parse(text)
    from pyspark.sql import functions as F
    from lexivec.functions.text import folded

    hits = {r.chunk_id for r in lexical.scored(chunks, node).collect()}
    index = lexical.search(chunks, text, 256, literal=False, index=R.lexical.Index.build(chunks, S._folder(spark, "growth")))
    may = {r.chunk_id for r in chunks.filter(lexical._may_match(node, folded(F.col("content")))).collect()}
    assert hits and hits == {r.chunk_id for r in index.collect()} and hits <= may < set(range(256))


def test_reranking_searches_once(spark):
    assert "embedding" not in plan(R.external_rerank(spark, DATA))


def test_a_batch_cuts_lists_before_they_move(spark):
    told = planned(R.bm25_batch_benchmark(spark, DATA))
    assert "WindowGroupLimit" in told


def test_postings_meet_tiers_without_a_shuffle(spark, monkeypatch, tmp_path):
    told, was = [], lexical.ordered
    monkeypatch.setattr(lexical, "TIER", 4)
    monkeypatch.setattr(lexical, "ordered", lambda rows, by, n: (told.append(plan(rows)), was(rows, by, n))[1])
    rows = [(i, f"p/{i}", "the " * (1 + i % 5) + f"w{i % 7}") for i in range(60)]
    index = lexical.Index.build(spark.createDataFrame(rows, "chunk_id long, path string, content string"), str(tmp_path / "index"))
    placed = next(x for x in told if "_tiers" in x)
    assert "strategy=broadcast" in placed and "_step" not in placed
    assert {r.tier for r in index.terms.filter("term = 'the'").collect()} > {0}


def test_edges_leave_in_pieces(spark, monkeypatch):
    held = []
    frames = type(spark.range(0))
    was = frames.mapInPandas
    monkeypatch.setattr(frames, "mapInPandas", lambda self, f, *a: (held.append(f), was(self, f, *a))[1])
    S.code_edges(spark, DATA)
    frame = pd.DataFrame([("s", "p", "python", "f", 1, "g(1)\n" * 20_000)], columns=["symbol_id", "path", "language", "short_name", "start_line", "content"])
    pieces = [len(x) for x in held[0](iter([frame]))]
    assert sum(pieces) == 20_000 and max(pieces) <= graph.PIECE_EDGES


def test_a_stored_level_ranks_its_own_edges(spark, tmp_path):
    roots, symbols, edges = R._graph(spark, DATA)
    search = trace.BeamSearch(roots, symbols, edges, R.BEAM_TERMS, R.BEAM, digits=12, folder=str(tmp_path / "trace"))
    told = plan(search._extended()[0])
    assert "LeftSemi" in told
    assert search.to(2).count() == trace.BeamSearch(roots, symbols, edges, R.BEAM_TERMS, R.BEAM, digits=12).to(2).count()
