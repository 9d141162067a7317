"""Intervals, nesting, ignore files of a tree, modules, snippets, resumable traces and caches, each against its definition."""

import random
import time

import pytest
from pyspark.sql import functions as F
from test_workspace import write

from lexivec.operators import cache, chunking, graph, intervals, lexical, trace
from lexivec.operators.segments import SegmentedTable
from lexivec.sources import server_logs, tree
from lexivec.workspace import Workspace


def test_narrowest_equals_brute_force(spark):
    random.seed(1)
    rows = []
    for i in range(600):
        a = random.randint(0, 400)
        rows.append((random.choice("ab"), a, a + random.choice([0, 1, 3, 40, 41, 300]), f"s{i:04}"))
    rows += [("a", 5, 2, "none"), (None, 1, 9, "null"), ("a", None, 3, "null")]
    table = spark.createDataFrame(rows, "path string, start_line int, end_line int, chunk_id string")
    places = [(p, n) for p in "abc" for n in range(0, 720, 3)] + [("a", 7), ("a", 7), (None, 3)]
    got = lexical.covering_line(table, spark.createDataFrame(places, "path string, line int")).collect()
    want = []
    for p, n in places:
        around = [(r[2] - r[1], r[1], r[3]) for r in rows if r[0] == p and p and r[1] is not None and r[1] <= n <= r[2]]
        if around:
            want.append((p, n, min(around)[2]))
    assert sorted((r.path, r.line, r.chunk_id) for r in got) == sorted(want)


def test_one_path_with_very_many_symbols(spark):
    """100,000 nested symbols of one path: each keeps a few blocks, each place reads 32."""
    n = 100_000
    rows = spark.range(n).select(F.lit("x.rs").alias("path"), F.col("id").alias("start_line"), (2 * n - F.col("id")).alias("end_line"), F.col("id").cast("string").alias("symbol_id"))
    places = spark.createDataFrame([("x.rs", 70_000), ("x.rs", 2 * n - 5)], "path string, line long")
    began = time.time()
    got = {r.line: r.symbol_id for r in intervals.narrowest(rows, places, ["path"], "start_line", "end_line", "line", ["symbol_id"]).collect()}
    assert got == {70_000: "70000", 2 * n - 5: "5"} and time.time() - began < 60


def test_covering_symbols_and_roots(spark):
    symbols = spark.createDataFrame([("s1", "c1", "a.rs", 1, 90), ("s2", "c2", "a.rs", 10, 20), ("s3", "c3", "b.rs", 1, 5)], "symbol_id string, chunk_id string, path string, start_line long, end_line long")
    around = graph.covering_symbols(symbols, spark.createDataFrame([("a.rs", 15), ("a.rs", 50)], "path string, line long"))
    assert sorted((r.line, r.symbol_id, r.width_rank) for r in around.collect()) == [(15, "s1", 2), (15, "s2", 1), (50, "s1", 1)]
    hits = spark.createDataFrame([("c3", "b.rs", 1, 0.5), ("bare", "a.rs", 12, 0.9), ("none", "z.rs", 1, 2.0)], "chunk_id string, path string, start_line long, score double")
    assert [(r.symbol_id, r.score) for r in graph.roots(hits, symbols).collect()] == [("s2", 0.9), ("s3", 0.5)]
    assert [r.symbol_id for r in graph.roots(hits.select("chunk_id", "score"), symbols).collect()] == ["s3"]


def test_large_files_are_cut_in_linear_time():
    method = "  pub fn method_name(a: u8) -> u8 {\n    let x = a + 1;\n    x\n  }\n"
    for text, n in (("impl X {\n" + method * 16_000 + "}\n", 16_001), ("const A: u8 = 1 +\n" + "  2 +\n" * 150_000, 1), ("fn a() {" * 100_000, 1)):
        began = time.time()
        assert len(chunking.braced_definitions(text, "rust")) == n
        assert time.time() - began < 5


def test_ignore_files_of_every_folder(spark, tmp_path):
    write(tmp_path, {".git/info/exclude": "local.txt\nback.rs\n", ".gitignore": "*.log\n/only_root\n!back.rs\ngen/\n", "a/.gitignore": "!keep.log\n*.rs\n!b/\n", "a/b/.gitignore": "!x.rs\n", "gen/.gitignore": "!in.rs\n"})
    write(tmp_path, {p: "text" for p in ("local.txt", "back.rs", "m.log", "only_root", "d/only_root", "a/keep.log", "a/y.rs", "a/b/x.rs", "a/b/z.rs", "gen/in.rs", "d/gen/q.rs", ".hidden/h.rs", "pkg/__init__.py", "c/[x].rs")})
    (tmp_path / "link.rs").symlink_to(tmp_path / "back.rs")
    got = {r.path for r in tree.listing(spark, str(tmp_path)).collect()}
    names = {p for p in got if not p.endswith(".gitignore")}
    assert names == {"back.rs", "d/only_root", "a/keep.log", "a/b/x.rs", ".hidden/h.rs", "pkg/__init__.py", "c/[x].rs"}
    assert "back.rs" not in {r.path for r in tree.listing(spark, str(tmp_path), ignore_text="back.rs\n").collect()}
    read = {r.path: (r.content, r.language) for r in tree.scan(spark, str(tmp_path)).collect()}
    assert set(read) == got and read["c/[x].rs"] == ("text", "rust")


def test_folders_are_handed_on(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tree, "FOLDERS", 2)
    names = {f"d{i}/e{j}/f{k}.rs" for i in range(3) for j in range(2) for k in range(2)} | {"top.rs"}
    write(tmp_path, {n: "x" for n in names} | {"node_modules/a/b.rs": "x", "d0/node_modules/c.rs": "x"})
    assert {r.path for r in tree.walk(spark, str(tmp_path), ["d2"]).collect()} == {n for n in names if not n.startswith("d2/")} | {"d0/node_modules/c.rs"}


def test_rules_like_the_plain_matcher(spark):
    random.seed(4)
    lines = ["*.log", "!keep.log", "/build", "out/", "docs/**/x.md", "a/**", "**/foo", "[!a]b", "a?c", "!a/b", "b/", "# note", "", "!*.log"]
    for _ in range(5):
        text = "\n".join(random.choices(lines, k=5))
        paths = ["/".join(random.choices(["a", "b", "foo", "out", "build", "x.md", "docs", "m.log", "keep.log", "abc"], k=random.randint(1, 4))) for _ in range(40)]
        rules = tree.rules_of(spark.createDataFrame([(".gitignore", text)], "path string, content string"))
        got = {r.path for r in tree.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), rules).collect()}
        assert got == {p for p in paths if tree.Ignore(text).ignores(p)}, text


def test_modules_by_the_folders_above(spark):
    random.seed(5)
    folders = ["", *{"/".join(random.choices("abcd", k=random.randint(1, 4))) for _ in range(120)}]
    files = ["/".join([*random.choices("abcd", k=random.randint(0, 5)), "f.go"]) for _ in range(300)] + ["abx/f.go"]
    for modules in (folders, folders[1:]):
        got = {r.path: r.module for r in server_logs.module_of(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([(m,) for m in modules], "module string")).collect()}
        want = {f: max((m for m in modules if m == "" or f.startswith(m + "/")), key=len, default=None) for f in files}
        assert got == want


@pytest.mark.parametrize(
    ("text", "query", "shown"),
    [
        ("the lazy Café dog, the end", "lazy dog", "the [lazy] Café [dog], the end"),
        ("call store_driver now", "store_driver", "call [store_driver] now"),
        ("a b c d e f g h i j k l Store-Driver m n o p q", '"store driver"', "…i j k l [Store-Driver] m n o p…"),
        ("one two. three four hit five six seven eight nine ten eleven twelve", "hit", "…three four [hit] five six seven eight nine ten eleven…"),
        ("x a b c d e f g h i hit", "x OR hit", "[x] a b c d e f g h i…"),
        ("a a a", '"a a"', "[a a a]"),
        ("nothing here", "hit", None),
        ("hits are many", "hi*", "[hits] are many"),
    ],
)
def test_snippets(text, query, shown):
    node = lexical.parse(query if any(s in query for s in '"*') or " OR " in query else lexical.literal_query(query))
    assert lexical.snippet_of(text, lexical.phrases_of(node)) == shown


@pytest.fixture(scope="module")
def net(spark):
    random.seed(6)
    symbols = [(f"s{i}", f"name{i}", "src/a.rs", i) for i in range(40)]
    edges = [(f"s{random.randint(0, 39)}", f"s{random.randint(0, 39)}", "n", random.choice(["call", "import"]), "src/a.rs", random.randint(1, 99), random.random(), "e", f"e{k}") for k in range(160)]
    return (
        spark.createDataFrame([("s0", 0.5), ("s1", 0.4)], "symbol_id string, score double"),
        spark.createDataFrame(symbols, "symbol_id string, short_name string, path string, start_line long"),
        spark.createDataFrame(edges, "src_symbol_id string, dst_symbol_id string, dst_name string, edge_kind string, path string, line long, confidence double, evidence string, edge_id string"),
    )


def test_a_search_goes_on_from_where_it_stopped(spark, net, tmp_path):
    whole = sorted(map(str, trace.beam_trace(*net, ["name3"], 5, 4).collect()))
    folder = str(tmp_path / "run")
    fast = trace.BeamSearch(*net, ["name3"], 4, folder=folder)
    assert sorted(map(str, fast.to(2).collect())) == sorted(map(str, trace.beam_trace(*net, ["name3"], 2, 4).collect()))
    later = trace.BeamSearch(*net, ["name3"], 4, folder=folder)
    assert later.depth == 2
    assert sorted(map(str, later.to(5).collect())) == whole
    empty = spark.createDataFrame([], net[2].schema)  # levels that are kept don't look at the edges again
    assert sorted(map(str, trace.BeamSearch(net[0], net[1], empty, [], 4, folder=folder).to(5).collect())) == whole


def test_stages_merge_by_endpoint(spark, net):
    fast, deep = (trace.diverse(trace.beam_trace(*net, [], hops, 4), 6) for hops in (1, 3))
    both = trace.merged(fast, deep)
    ends = both.select(trace.endpoint(F.col("root"), F.col("steps")).alias("e"))
    assert ends.distinct().count() == both.count() == fast.union(deep).select(trace.endpoint(F.col("root"), F.col("steps")).alias("e")).distinct().count()
    hidden = deep.withColumn("steps", F.transform("steps", lambda s: s.withField("path", F.lit("tests/x.rs"))))
    assert trace.merged(fast, hidden).count() == trace.merged(fast, fast).count()


def test_cache_generations(spark, tmp_path):
    held, asked = cache.Cache(SegmentedTable(spark, str(tmp_path / "c"), cache.SCHEMA, "key"), 1), []

    def work_out(rows):
        asked.append(rows.count())
        return rows.select("key", F.concat(F.lit("v"), "key").alias("value"))

    wanted = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    held, rows = held.filled(wanted, work_out)
    held, again = held.filled(wanted.union(spark.createDataFrame([("c",)], "key string")), work_out)
    assert asked == [2, 1] and {r.key: r.value for r in again.collect()} == {"a": "va", "b": "vb", "c": "vc"} and rows.count() == 2
    held = held.put_one("t", "trace", lasting=False)
    later = cache.Cache(held.table, 2)
    assert held.get("t") == "trace" and later.get("t") is None and later.get("a") == "va"
    later = later.put_one("t", "new", lasting=False)
    assert later.get("t") == "new" and later.table.read().count() == 4
    assert cache.key_of("x", a=1, b=2) == cache.key_of("x", b=2, a=1) != cache.key_of("x", a=1, b=3)


def test_one_file_writes_its_own_rows(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, {f"src/f{i}.rs": f"fn fun{i}() {{\n    fun{(i + 1) % 8}();\n}}\n" for i in range(8)})
    w = Workspace(spark, str(tmp_path / "ws"))
    w.index(str(root))
    before = w.state()["tables"]
    write(root, {"src/f3.rs": "fn fun3() {\n    fun4();\n    other();\n}\n", "src/new.rs": "fn other() {}\n"})
    w.index(str(root))
    after = w.state()["tables"]
    written = {n: sum(s["rows"] for s in after[n] if s not in before[n]) for n in ("files", "chunks", "references", "edges")}
    assert written["files"] == 2 and written["chunks"] == 2 and written["references"] <= 5 and written["edges"] <= 7
    (root / "src/f5.rs").unlink()
    w.index(str(root))
    fresh = Workspace(spark, str(tmp_path / "ws2"))
    fresh.index(str(root))
    for name in ("files", "chunks", "symbols", "references", "edges"):
        assert sorted(map(str, w.table(name).collect())) == sorted(map(str, fresh.table(name).collect())), name
    assert sorted(map(tuple, w.search("fun4").collect())) == sorted(map(tuple, fresh.search("fun4").collect()))


def test_second_query_embeds_and_scores_nothing(spark, tmp_path):
    root, embedded, scored = tmp_path / "repo", [], []
    write(root, {"src/a.rs": "fn alpha() {\n    beta();\n}\n", "src/b.rs": "fn beta() {}\n", "notes.md": "plain alpha text\n"})

    def embedder(texts):
        embedded.extend(texts)
        return [[float(len(t)), 1.0] + [0.0] * 510 for t in texts]

    def scorer(query, texts):
        scored.extend(texts)
        return [float("beta();" in t) for t in texts]

    w = Workspace(spark, str(tmp_path / "ws"), embedder=embedder, scorer=scorer)
    w.index(str(root))
    w.embed()
    first = w.query("alpha", deep=True).collect()
    n = len(embedded), len(scored)
    assert [r.asDict() for r in w.query("alpha", deep=True).collect()] == [r.asDict() for r in first]
    assert (len(embedded), len(scored)) == n and n[1] > 0
    top = first[0]
    assert (top.path, top.start_line, top.symbol) == ("src/a.rs", 1, "alpha") and "[alpha]" in top.snippet and top.score == 1.0
    paths, cited = w.trace("alpha", deep=True)
    assert paths.count() and cited.count()
    failing = Workspace(spark, str(tmp_path / "ws"), embedder=embedder, scorer=lambda q, t: [])
    assert failing.query("beta", deep=True).first().score != 1.0


def test_numbers_of_contents_that_meet(spark):
    from lexivec.operators import vector

    hashes = spark.createDataFrame([(f"h{i:02}",) for i in range(20)] + [("h01",)], "content_hash string")
    few = lambda content, salt: F.pmod(vector.hash_key(content, salt), F.lit(24))
    rows = vector.surrogate_keys(hashes, few).collect()
    assert len(rows) == len({r.key for r in rows}) == len({r.content_hash for r in rows}) == 20
    assert sorted(map(tuple, vector.surrogate_keys(hashes, few).collect())) == sorted(map(tuple, rows))


def test_columns_of_names(spark):
    rows = [("foo food foo", "foo", 1), ("food _foo foo", "foo", 11), ("é foo(1)", "foo", 4), ("afoo", "foo", None), ("a.b", "a.b", 1), ("axb a.b", "a.b", 5), ("x", " ", None), ("", "x", None), (None, "x", None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, line string, name string, want int").select("i", server_logs.identifier_column(F.col("line"), F.col("name")).alias("c"))
    assert [r.c for r in got.orderBy("i").collect()] == [r[2] for r in rows]


def test_told_by_a_writer_or_the_rule():
    step = {"edge_kind": "call", "from_symbol": "a", "target_name": "b", "path": "src/a.rs", "line": 3}
    paths = [{"root": "a", "score": 1.0, "steps": [step]}]
    plain = trace.told("q", paths, [("src/a.rs", 3)])
    assert plain.source == "rule" and "a -> b" in plain.text and plain.error is None
    assert trace.told("q", paths, [], lambda *a: " well ") == trace.Told("well", "written")
    assert trace.told("q", paths, [], lambda *a: " ").error == "the writer said nothing"

    def broken(*a):
        raise OSError("no\nway")

    assert trace.told("q", paths, [("src/a.rs", 3)], broken) == trace.Told(plain.text, "rule", "no way")
    assert trace.told("q", [], [], lambda *a: "never asked").source == "rule"


def test_settings_are_made_and_read_back(tmp_path):
    from lexivec import config

    path = tmp_path / "deep" / "settings.toml"
    assert config.ensure(path) == config.Config() and path.exists()
    changed = config.Config(embed=config.EmbedConfig(model='q"uote', dimensions=7), weights=config.EdgeWeights(import_=0.25))
    config.save(path, changed)
    assert config.ensure(path) == changed


def test_collections(spark):
    from lexivec.operators import vector

    held = spark.createDataFrame([("p", "m", 8, 1, "c1"), ("p", "m", 16, 2, "c2")], "provider string, model string, dim int, updated_at int, collection string")
    chunks = spark.createDataFrame([("a.rs", 1, "text")], "path string, start_line int, content string")
    embed = lambda texts: [[1.0] * 5 for _ in texts]
    assert vector.wanted_dimension(9, held, "p", "m", chunks, embed) == 9
    assert vector.wanted_dimension(None, held, "p", "m", chunks, embed) == 16
    assert vector.wanted_dimension(None, held, "p", "other", chunks, embed) == 5
    with pytest.raises(ValueError):
        vector.wanted_dimension(None, held, "p", "other", chunks.limit(0), embed)
    vectors = spark.createDataFrame([("c1", 1), ("c2", 2), ("c2", 3)], "collection string, v int")
    left = vector.dropped(held, vectors, "c2")
    assert [t.count() for t in left] == [1, 1] and {r.collection: r.vectors for r in vector.counted(vectors).collect()} == {"c1": 1, "c2": 2}


def test_folders_and_summaries_of_a_workspace(spark, tmp_path):
    root, asked = tmp_path / "repo", []
    write(root, {"a/x.rs": "fn alpha() {\n    beta();\n}\n", "b/y.rs": "fn beta() {}\n// alpha\n"})
    w = Workspace(spark, str(tmp_path / "ws"))
    w.index(str(root))
    assert {r.path for r in w.guide("alpha").collect()} <= {"a/x.rs", "b/y.rs"}
    first = w.directory("alpha", now=1000)
    assert first in ("a", "b") and w.directory("alpha", now=2000) == first
    assert [tuple(r) for r in w.table("frecency").collect()] == [(first, 2.0, 2000)]
    rule = w.told("alpha")
    assert rule.source == "rule" and w.told("alpha", write=lambda *a: asked.append(1) or "said").text == "said"
    assert w.told("alpha", write=lambda *a: asked.append(1) or "again").text == "said" and w.told("alpha").text == "said" and asked == [1]
