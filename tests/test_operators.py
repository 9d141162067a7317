import collections

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lexivec.config import load
from lexivec.functions import paths
from lexivec.operators import analytics, chunking, fusion, graph, index, trace, vector
from lexivec.plans import registry


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_test_paths(spark):
    names = {"service_test.go": True, "service.test.ts": True, "service.spec.ts": True, "tests/x.rs": True, "integration_test/x.rs": True, "contest.go": False, "specification.go": False, "service.go": False}
    df = spark.createDataFrame(list(names.items()), "path string, want boolean")
    assert df.filter(paths.is_test_path(F.col("path")) != F.col("want")).count() == 0


def test_excluded_prefixes_hold_at_the_root(spark):
    df = spark.createDataFrame([("node_modules/a",), ("pkg/node_modules/a",), ("own/a",)], "path string")
    assert [r[0] for r in df.select(paths.is_excluded(F.col("path"), ["own"])).collect()] == [True, False, True]


def test_windows(spark):
    files = spark.createDataFrame([("a", "1\n2\n3\n4\n5\n6\n"), ("b", ""), ("c", None), ("d", "x\r\n")], "path string, content string")
    got = rows(chunking.windows(files, 3, 1).select("path", "start_line", "end_line", "content"), "path", "start_line")
    assert got == [("a", 1, 3, "1\n2\n3"), ("a", 3, 5, "3\n4\n5"), ("a", 5, 6, "5\n6"), ("d", 1, 1, "x")]


def test_sections(spark):
    files = spark.createDataFrame([("a", "intro\n# A\nx\n####### no\n## B \ny"), ("b", "#Hello")], "path string, content string")
    got = rows(chunking.sections(files).select("symbol", "start_line", "end_line"), "start_line")
    assert got == [("Preamble", 1, 1), ("A", 2, 4), ("B", 5, 6)]


@pytest.mark.parametrize(
    "language, text, want",
    [
        ("rust", "pub fn a() {\n  let s = \"}\";\n}\nstruct B;\nimpl B {\n  fn c(&self) {}\n}\nconst D: u8 = 1;\nmod e {}\n", {("function", "a", 1, 3), ("type", "B", 4, 4), ("type", None, 5, 7), ("function", "c", 6, 6), ("const", "D", 8, 8), ("module", "e", 9, 9)}),
        ("go", "package x\nfunc A() {\n}\nfunc (r *R) B() int {\n return 1\n}\ntype C struct {\n}\n", {("function", "A", 2, 3), ("method", "B", 4, 6), ("type", "C", 7, 8)}),
        ("js", "function a() {\n  function inner() {}\n}\nclass B {\n  c() {\n  }\n}\nconst d = () => {\n};\n", {("function", "a", 1, 3), ("type", "B", 4, 7), ("method", "c", 5, 6), ("function", "d", 8, 9)}),
        ("ts", "interface A {\n x: number\n}\ntype B = string;\nenum C { X }\n", {("type", "A", 1, 3), ("type", "B", 4, 4), ("type", "C", 5, 5)}),
        ("python", "class A:\n    def b(self):\n        def inner(): pass\n\ndef c():\n    pass\n", {("type", "A", 1, 3), ("method", "b", 2, 3), ("function", "c", 5, 6)}),
    ],
)
def test_definitions(language, text, want):
    assert {(k, s, a, b) for a, b, k, s in chunking.definitions(text, language)} == want


def test_chunk_files_falls_back_to_windows(spark):
    files = spark.createDataFrame([("a.rs", "rust", "fn foo() -> u8 { 42 }\n"), ("b.md", "markdown", "no heading"), ("c.txt", "unknown", "x\ny")], "path string, language string, content string")
    got = rows(chunking.chunk_files(files).select("path", "kind", "symbol"), "path")
    assert got == [("a.rs", "function", "foo"), ("b.md", "block", None), ("c.txt", "block", None)]


def test_edges(spark):
    chunk = [("k", "src/h.rs", "rust", 10, 14, "function", "h", 'router.get("/m", list_m);\nlet q = "select x from missions";\nstore(q);\nh(1);')]
    df = spark.createDataFrame(chunk, "chunk_id string, path string, language string, start_line long, end_line long, kind string, symbol string, content string")
    got = {(r.edge_kind, r.dst_name, r.line, r.confidence) for r in graph.edges(df).collect()}
    assert {("route", "list_m", 10, 0.86), ("sql_read", "missions", 11, 0.77), ("call", "store", 12, 0.62), ("call", "h", 13, 0.45)} <= got
    assert graph.symbols(df).first().fq_name == "src/h.rs::h"


def test_resolve_prefers_full_name_then_path(spark):
    symbols = spark.createDataFrame([("1", "a.rs", 1, "a.rs::f", "f"), ("2", "b.rs", 5, "b.rs::f", "f"), ("3", "tests/c.rs", 1, "tests/c.rs::g", "g")], "symbol_id string, path string, start_line long, fq_name string, short_name string")
    edges = spark.createDataFrame([("e1", "b.rs::f", "z.rs"), ("e2", "x::f", "b.rs"), ("e3", "f", "z.rs"), ("e4", "g", "z.rs")], "edge_id string, dst_name string, path string")
    assert rows(graph.resolve(edges, symbols).select("edge_id", "dst_symbol_id"), "edge_id") == [("e1", "2"), ("e2", "2"), ("e3", "1"), ("e4", None)]


def _graph(spark):
    symbols = spark.createDataFrame([("a", "alpha", "p.rs", 1), ("b", "beta", "p.rs", 5), ("c", "gamma", "q.rs", 1)], "symbol_id string, short_name string, path string, start_line long")
    edges = spark.createDataFrame(
        [("a", "b", "beta", "call", "p.rs", 2, 0.62, "beta()", "1"), ("b", "c", "gamma", "route", "p.rs", 6, 0.9, "", "2"), ("c", "a", "alpha", "call", "q.rs", 2, 0.5, "", "3"), ("b", None, "table", "sql_read", "p.rs", 7, 0.77, "", "4")],
        "src_symbol_id string, dst_symbol_id string, dst_name string, edge_kind string, path string, line long, confidence double, evidence string, edge_id string",
    )
    roots = spark.createDataFrame([("a", 1.0)], "symbol_id string, score double")
    return roots, symbols, edges


def test_beam_emits_cycle_but_does_not_follow_it(spark):
    paths_ = trace.beam_trace(*_graph(spark), ["beta"], hops=5, beam=4)
    got = rows(paths_.select("depth", "last", F.round("score", 6)), "depth", "last")
    one = 1.0 + 0.62 + 0.12 - 0.06
    assert got == [(1, "b", round(one, 6)), (2, None, round(one + 0.8 * 0.77 - 0.12, 6)), (2, "c", round(one + 0.81 - 0.12, 6)), (3, "a", round(one + 0.81 - 0.12 + 0.5 - 0.18, 6))]
    chosen = trace.diverse(paths_, 2)
    assert [r.depth for r in chosen.collect()] == [3, 2]
    tree = {(r.depth, r["count"]) for r in trace.flow_tree(paths_).collect()}
    assert (1, 4) in tree
    cited = [(r.path, r.line) for r in trace.citations(chosen, _graph(spark)[1]).orderBy("place").collect()]
    assert cited[0] == ("p.rs", 1)


def test_server_calls_replace_own(spark):
    _, symbols, edges = _graph(spark)
    covered = spark.createDataFrame([("a",)], "symbol_id string")
    calls = edges.filter("src_symbol_id = 'a'").drop("confidence")
    got = {(r.src_symbol_id, r.confidence) for r in graph.with_server_calls(edges, calls, covered).filter("edge_kind = 'call'").collect()}
    assert got == {("a", 0.96), ("c", 0.5)}
    assert {r[0] for r in graph.server_worthy(edges, symbols).collect()} == {"a", "c"}


def test_incremental_plan_and_stats(spark):
    cols = "path string, size long, mtime long, content_hash string"
    files = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 1, "h"), ("changed", 1, 1, "h"), ("gone", 1, 1, "h")], cols)
    scan = spark.createDataFrame([("same", 1, 1, "h"), ("touched", 1, 2, "h"), ("changed", 2, 2, "i"), ("new", 1, 1, "h")], cols)
    actions = index.plan(scan, files)
    assert dict(rows(actions, "path")) == {"same": "unchanged", "touched": "touched", "changed": "changed", "gone": "removed", "new": "new"}
    table = spark.createDataFrame([("same", "old"), ("changed", "old"), ("gone", "old")], "path string, v string")
    fresh = spark.createDataFrame([("changed", "new"), ("new", "new")], "path string, v string")
    assert rows(index.replace_paths(table, fresh, actions), "path") == [("changed", "new"), ("new", "new"), ("same", "old")]
    assert tuple(index.stats(actions, fresh).first()) == (4, 2, 2, 1, 2)


def test_embed_missing_prunes_and_embeds_once(spark):
    chunks = spark.createDataFrame([("1", "a", 1, "h1", "x"), ("2", "b", 1, "h1", "x"), ("3", "c", 1, "h2", "yy")], "chunk_id string, path string, start_line long, content_hash string, content string")
    held = spark.createDataFrame([("h1", [1.0, 0.0]), ("h9", [0.0, 1.0])], "content_hash string, vector array<double>")
    got = rows(vector.embed_missing(chunks, held, lambda texts: [[3.0 * len(t), 4.0 * len(t)] for t in texts]), "content_hash")
    assert got == [("h1", [1.0, 0.0]), ("h2", [0.6, 0.8])]


def test_vector_checks():
    with pytest.raises(ValueError):
        vector.check_collection("l2", "f32")
    with pytest.raises(ValueError):
        vector.check_collection("cos", "i8")


def test_rrf(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank long")
    assert dict(rows(fusion.rrf([(1.0, a), (0.5, a), (0.0, a)], digits=9), "chunk_id")) == {"x": round(1.5 / 61, 9), "y": round(1.5 / 62, 9)}


def test_frecency(spark):
    old = spark.createDataFrame([("a", 1.0, 10)], "path string, rank double, last_accessed long")
    new = spark.createDataFrame([("a", 20), ("b", 5)], "path string, at long")
    assert rows(analytics.record_accesses(old, new), "path") == [("a", 2.0, 20), ("b", 1.0, 5)]
    results = spark.createDataFrame([("1", "auth/x", 2.0), ("2", "auth/y", 1.0), ("3", "z", 3.0)], "chunk_id string, path string, score double")
    assert analytics.directory_vote(results, old, F.lit(10)).first().directory == "."
    assert rows(analytics.guide(results), "path") == [("auth/x", "1", 2.0), ("auth/y", "2", 1.0), ("z", "3", 3.0)]


def test_config_defaults_and_file(tmp_path):
    assert load(tmp_path / "none").query.rrf_k == 60
    (tmp_path / "c.toml").write_text("[query]\nrrf_k = 10.0\n[index]\nmax_file_bytes = 8\n")
    assert load(tmp_path / "c.toml").query.rrf_k == 10 and load(tmp_path / "c.toml").index.max_file_bytes == 8


def brute_edges(docs):
    import re

    name = r"([A-Za-z_][A-Za-z0-9_]*)"
    patterns = [("call", rf"\b{name}\s*\(", 0.62)]
    patterns += [("sql_read", rf"(?i)\b{head}\s+{name}", 0.77) for head in ("from", "join", r"select\s+.+?\bfrom")]
    patterns += [("sql_write", rf"(?i)\b{head}\s+{name}", 0.82) for head in (r"insert\s+into", "update", r"delete\s+from")]
    out = collections.Counter()
    for path, text in docs:
        symbol = re.search("[A-Za-z_][A-Za-z0-9_]*", text or "")
        for kind, pattern, confidence in patterns:
            for m in re.finditer(pattern, text or ""):
                if kind == "call" and m[1] in graph.NOT_CALLS:
                    continue
                key = (path, kind, text.count("\n", 0, m.start(1)) + 1, m[1])
                out[key] = max(out[key], 0.45 if kind == "call" and m[1] == symbol[0] else confidence)
    return dict(out)


def test_extract_edges_equals_brute_force(spark, tmp_path):
    planted = ["x insert into alpha values", "x delete\nfrom beta where", "x update gamma set y", "x select a,\nb from delta join\neps", "x insert\n  into\nzeta", "x select a from eta", "run call(1) and run(2) if (3)", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(planted)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for sf in (str(tmp_path), DATA):
        docs = [(f"{r.source}/{r.doc_id}", r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        got = {(r.path, r.edge_kind, r.line, r.dst_name): r.confidence for r in registry.BRUTE_FORCE["extract_edges"](spark, sf).collect()}
        assert got == brute_edges(docs)
        assert sf == DATA or {n for _, k, _, n in got if k == "sql_write"} == {"alpha", "beta", "gamma", "zeta"}
