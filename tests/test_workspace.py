"""The small trees that the engine has to handle, end to end."""

import json

import pytest

from lexivec.operators import output
from lexivec.sources import providers, server_logs, tree
from lexivec.streaming import upserts
from lexivec.workspace import Workspace


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_index_search_get_and_trace(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {"src/driver.rs": 'pub fn show_missions() {\n    store_missions();\n}\n\nfn store_missions() {\n    let q = "select id from missions";\n}\n', "ignored.rs": "fn secret_marker() {}\n", "docs/readme.md": "# Guide\nmissions guide\n", "tests/x.rs": "fn x() {}\n", "blob.txt": b"\0\1\2"})
    w = Workspace(spark, str(tmp_path / "ws"))
    first = w.index(str(root), ignore_text="ignored.rs\n")
    assert (first["scanned"], first["indexed"], first["skipped"], first["removed"]) == (2, 2, 0, 0)
    again = w.index(str(root), ignore_text="ignored.rs\n")
    assert (again["indexed"], again["skipped"]) == (0, 2)
    assert w.search("secret_marker").count() == 0
    hits = {r.path for r in w.search("missions").collect()}
    assert hits == {"src/driver.rs", "docs/readme.md"}
    assert w.get("src/driver.rs:6").first().symbol == "store_missions"
    assert w.get("src/driver.rs").first().symbol == "show_missions"
    assert w.embed().count() == 3
    assert "src/driver.rs" in {r.path for r in w.table("chunks").join(w.query("show missions", deep=True), "chunk_id").collect()}
    paths, cited = w.trace("show missions driver")
    kinds = {s.edge_kind for r in paths.collect() for s in r.steps}
    assert {"call", "sql_read"} <= kinds and ("src/driver.rs", 1) in {(r.path, r.line) for r in cited.collect()}
    (root / "docs/readme.md").unlink()
    assert w.index(str(root), ignore_text="ignored.rs\n")["removed"] == 1
    assert w.embed().count() == 2 and w.check()["generation"] == 3
    assert {r.path for r in w.search("missions").collect()} == {"src/driver.rs"}


def test_unchanged_files_are_not_read(spark, tmp_path):
    import os

    root = tmp_path / "repo"
    write(root, {"src/a.rs": "fn alpha() {\n    beta();\n}\n", "src/b.rs": "fn beta() {}\n"})
    w = Workspace(spark, str(tmp_path / "ws"))
    w.index(str(root))
    a, stat = root / "src/a.rs", (root / "src/a.rs").stat()
    a.write_text("fn gamma() {\n    beta();\n}\n")  # the same size, and below the same time
    os.utime(a, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    write(root, {"src/c.rs": "fn delta() {\n    alpha();\n}\n"})
    counts = w.index(str(root))
    assert (counts["indexed"], counts["skipped"]) == (1, 2)
    assert {r.short_name for r in w.table("symbols").collect()} == {"alpha", "beta", "delta"}
    assert {r.dst_name for r in w.table("edges").filter("dst_symbol_id is not null").collect()} >= {"beta", "alpha"}
    assert not [p for p in (tmp_path / "ws").iterdir() if p.name.startswith(".CURRENT-")]


def test_a_broken_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    write(root, {"src/a.rs": "fn alpha() {}\n"})
    w = Workspace(spark, str(tmp_path / "ws"))
    w.index(str(root))
    before = w.state()
    write(root, {"src/b.rs": "fn beta() {}\n"})
    monkeypatch.setattr(Workspace, "_save", lambda self, state: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        w.index(str(root))
    assert w.state() == before and w.search("alpha").count() == 1 and w.search("beta").count() == 0


def test_ignore_rules():
    rules = tree.Ignore("*.log\n!keep.log\n/build\nout/\ndocs/**/x.md\n")
    assert [rules.ignores(p) for p in ("a.log", "d/a.log", "keep.log", "build/a", "d/build", "out/a", "d/out/b", "docs/a/b/x.md", "src/a")] == [True, True, False, True, False, True, True, True, False]


def test_repo_paths(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a").mkdir()
    assert tree.repo_root(tmp_path / "a") == tmp_path.resolve()
    assert tree.repo_path(tmp_path, "a/../b") == "b"
    with pytest.raises(ValueError):
        tree.repo_path(tmp_path, "../x")


def test_server_logs(spark):
    lines = spark.createDataFrame([("src/a.go:3:6-9",), ("Foo Function 10:6-12:2",), ("callee[0]: ranges 4:2-5 in a.go from/to function Bar in b.go:7:6-9",), ("callee[1]: ranges 4:2-5 in a.go from/to function Out in /usr/x.go:7:6-9",), ("a.go:1:2-3: broken thing",)], "value string")
    assert tuple(server_logs.locations(lines.filter("value like 'src%'")).first()) == ("src/a.go", 3, 6, 3, 9)
    assert tuple(server_logs.document_symbols(lines).first()) == ("Foo", "Function", 10, 6, 12, 2)
    assert [(r.name, r.path, r.line) for r in server_logs.calls(lines).collect()] == [("Bar", "b.go", 7)]
    assert "broken thing" in {r.message for r in server_logs.diagnostics(lines).collect()}
    assert server_logs.parse_position("a/b.go:3:4") == ("a/b.go", 3, 4)
    with pytest.raises(ValueError):
        server_logs.parse_position("a:0:1")


def test_providers():
    waits = []

    def flaky():
        if len(waits) < 2:
            raise providers.Passing
        return "done"

    assert providers.retried(flaky, wait=waits.append) == "done" and waits == [0.2, 0.4]

    def short(texts):
        if sum(map(len, texts)) > 300:
            raise providers.TooLong
        return [[float(len(t))] for t in texts]

    assert providers.splitting(short)(["a" * 200, "b" * 200, "c" * 500])[:2] == [[200.0], [200.0]]
    assert providers.vectors_in(json.dumps({"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}), 2) == [[1.0], [2.0]]
    assert providers.scores_in(json.dumps({"results": [{"document_index": 1, "score": 0.5}]}), 2) == [0.0, 0.5]
    assert providers.expansions_in('1. "foo bar"\n- query\n* baz\nmore', "Query") == ["foo bar", "baz"]
    with pytest.raises(ValueError):
        providers.vectors_in('{"error": {"message": "no"}}', 1)


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")], "path string, mtime long, v string").write.parquet(str(tmp_path / "in/1"))
    state = {"t": spark.createDataFrame([("a", 0, "x"), ("c", 0, "c")], "path string, mtime long, v string")}
    stream = spark.readStream.schema("path string, mtime long, v string").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def keep(df, number):
        state["t"] = spark.createDataFrame(df.collect(), df.schema)

    upserts.upsert_stream(stream, str(tmp_path / "cp"), lambda: state["t"], keep).awaitTermination()
    assert sorted((r.path, r.v) for r in state["t"].collect()) == [("a", "new"), ("b", "b"), ("c", "c")]


def test_output(spark):
    df = spark.createDataFrame([("a", 1, 2, "f", 0.5, "s"), ("a", 3, 4, None, 0.25, None)], "path string, start_line int, end_line int, symbol string, score double, snippet string")
    assert [r.value for r in output.as_tsv(df).collect()] == ["0.5000\ta:1-2\tf\ts", "0.2500\ta:3-4\t\t"]
    assert [r.value for r in output.as_files(df).collect()] == ["a"] and output.as_json(df).count() == 2
