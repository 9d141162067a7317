"""Queries over the structures of the engine (segments, tiers, intervals, ignore files, stages, caches), and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import content_snippet
from ..operators import analytics, cache, chunking, fusion, graph, intervals, lexical, output, trace, vector
from ..operators.segments import SegmentedTable
from ..session import work_folder
from ..sources import server_logs, tree
from . import oracles as O
from . import registry as R

SHOWN = '"of the" OR idiot'
#: Ignore files: of the root, and of every folder whose name begins with `blog.`.
ROOT_RULES, BLOG_RULES = "m.*\n!m.*.com\n*.html\nspam-farm.*/\n", "/en/\n!*.html\n"


def _folder(spark, name: str) -> str:
    return f"{work_folder(spark)}/lexivec/{name}-{uuid.uuid4().hex}"


def bm25_snippets(spark, sf):
    """Hits with the best window of their text, phrases in one pair of brackets."""
    return lexical.search(R.corpus(spark, sf), SHOWN, 50, literal=False, digits=6, index=R.ready_index(spark, sf), snippets="phrases").select("chunk_id", "score", "snippet")


def query_hits(spark, sf):
    """The rows of `hybrid_query` as they are shown."""
    fused = fusion.held(R.hybrid_query(spark, sf))
    rows = R.corpus(spark, sf).join(F.broadcast(fused), "chunk_id")
    marked = lexical.snippet(F.col("content"), lexical.parse(lexical.literal_query(R.SEED_QUERY)))
    return rows.select("chunk_id", "path", "start_line", "language", "score", F.coalesce(marked, content_snippet(F.col("content"))).alias("snippet"))


def bm25_after_edits(spark, sf):
    """A search of an index that was built of other rows and then brought up to date: some texts changed, some rows came, some went."""
    docs = R.corpus(spark, sf)
    changed = F.col("language") == "de"
    before = docs.filter("source <> 'src1'").withColumn("content", F.when(changed, F.concat(F.lit("idiot clown "), "content")).otherwise(F.col("content")))
    more = docs.filter("source = 'src2'").withColumn("chunk_id", -F.col("chunk_id") - 1)
    index = lexical.Index.build(before.unionByName(more), _folder(spark, "edited"))
    index = index.updated(docs.filter("source = 'src1'")).updated(docs.filter("source <> 'src1'").filter(changed), before.filter(changed).unionByName(more))
    return lexical.search(docs, R.OR, 50, literal=False, digits=6, index=index)


def _url_paths(spark, sf):
    return R._t(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*[^?#/])", 1).alias("path"))


def ignored_urls(spark, sf):
    """Paths that ignore files leave out, those of the root and of folders below."""
    rows = _url_paths(spark, sf)
    own = rows.select(F.regexp_extract("path", "^(blog[.][^/]*)/", 1).alias("folder")).filter("folder <> ''").distinct()
    files = own.select(F.concat("folder", F.lit("/.gitignore")).alias("path"), F.lit(BLOG_RULES).alias("content"))
    files = files.unionByName(spark.createDataFrame([(".gitignore", ROOT_RULES)], "path string, content string"))
    return rows.join(tree.ignored(rows.select("path").distinct(), tree.rules_of(files)), "path")


def module_of_url(spark, sf):
    """The deepest module above each path: hosts are modules, and so are their folders en and fr."""
    rows = _url_paths(spark, sf)
    host, second = F.regexp_extract("path", "^([^/]*)/", 1), F.regexp_extract("path", "^([^/]*/(?:en|fr))/", 1)
    modules = rows.select(F.explode(F.array(host, second)).alias("module")).filter("module <> ''").distinct()
    return rows.join(server_logs.module_of(rows.select("path"), modules), "path")


def url_folders(spark, sf):
    """Paths by folder, with their extension and language."""
    path = F.col("path")
    return _url_paths(spark, sf).filter(~P.is_excluded(path) & ~P.is_binary_name(path)).groupBy(P.directory(path).alias("folder"), P.extension(path).alias("extension"), P.language(path).alias("language")).agg(F.count("*").alias("n"), F.sum(P.is_test_path(path).cast("int")).alias("n_tests"))


def _window_symbols(spark, sf):
    return R._windows(spark, sf).select(F.concat_ws(":", "path", "start_line").alias("symbol_id"), F.concat_ws(":", "path", "start_line").alias("chunk_id"), "path", "start_line", "end_line")


def covering_symbols(spark, sf):
    """Every window around the fourth line of each document, the narrowest first."""
    places = R.corpus(spark, sf).select("path", F.lit(4).cast("long").alias("line"))
    return graph.covering_symbols(_window_symbols(spark, sf), places).select("path", "line", "symbol_id", "width_rank")


def hit_roots(spark, sf):
    """Roots of hits that have no symbol of their own: the narrowest window around line 4."""
    hits = lexical.search(R.corpus(spark, sf), "the", 200, digits=6, index=R.ready_index(spark, sf))
    return graph.roots(hits.select(F.col("chunk_id").cast("string").alias("chunk_id"), "path", F.lit(4).cast("long").alias("start_line"), "score"), _window_symbols(spark, sf)).select("symbol_id", "score")


def narrowest_order(spark, sf):
    """For every day the shortest time from order to shipping around it, by market segment: overlapping intervals of any kind."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    orders = R._t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", day("o_orderdate").alias("first_day"))
    spans = R._t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("last_day")).join(orders, "l_orderkey")
    points = orders.select("o_orderpriority", F.col("first_day").alias("day")).distinct()
    return intervals.narrowest(spans, points, ["o_orderpriority"], "first_day", "last_day", "day", ["l_orderkey"]).select("o_orderpriority", "day", "l_orderkey", "first_day", "last_day")


def first_chunks(spark, sf):
    return lexical.first_chunk(_window_symbols(spark, sf))


def frecency_upsert(spark, sf):
    """Access counts of users up to a moment, and more accesses on top."""
    events = R._t(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.unix_timestamp("ts").alias("at"))
    early = events.filter(F.col("at") < R.NOW).groupBy("path").agg(F.count("*").cast("double").alias("rank"), F.max("at").alias("last_accessed"))
    return analytics.record_accesses(early, events.filter(F.col("at") >= R.NOW))


def server_edges(spark, sf):
    """Calls of some sources replaced by a server's; the rest stays."""
    _, _, edges = R._graph(spark, sf)
    covered = edges.filter("edge_kind = 'call' and line % 2 = 0").select(F.col("src_symbol_id").alias("symbol_id")).distinct()
    calls = edges.filter("edge_kind = 'call'").join(covered.withColumnRenamed("symbol_id", "src_symbol_id"), "src_symbol_id").filter("line % 2 = 0")
    return graph.with_server_calls(edges, calls.select(*[c for c in edges.columns if c != "confidence"]), covered).groupBy("src_symbol_id", "edge_kind").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def beam_trace_resumed(spark, sf):
    """The rows of `beam_trace`, from a search that stopped after one step and went on later."""
    roots, symbols, edges = R._graph(spark, sf)
    folder = _folder(spark, "trace")
    trace.BeamSearch(roots, symbols, edges, R.BEAM_TERMS, R.BEAM, digits=12, folder=folder).to(1)
    paths = trace.BeamSearch(roots, symbols, edges, R.BEAM_TERMS, R.BEAM, digits=12, folder=folder).to(R.BEAM_HOPS)
    last = F.element_at("steps", -1)
    return paths.select("root", "depth", F.col("last"), "score", last["from_symbol"].alias("from_symbol"), last["target_name"].alias("target"))


def kept_scores(spark, sf):
    """Lengths of contents, some of them kept from before: only the others are worked out."""
    held = cache.Cache(SegmentedTable(spark, _folder(spark, "cache"), cache.SCHEMA, "key"), 1)
    wanted = R.corpus(spark, sf).select("chunk_id", "language", "content", cache.keys_of("length", "content_hash").alias("key"))
    held, _ = held.filled(wanted.filter("language = 'fr'"), lambda rows: rows.select("key", F.concat(F.lit("kept:"), F.length("content").cast("string")).alias("value")))
    held, values = held.filled(wanted, lambda rows: rows.select("key", F.length("content").cast("string").alias("value")))
    return wanted.join(values, "key").select("chunk_id", "value")


def chunk_by_id(spark, sf):
    return lexical.get_chunk(R.corpus(spark, sf), 7).select("chunk_id", "path", "content_hash")


def chunk_keys(spark, sf):
    """Numbers of contents, for the chunks of one language."""
    docs = R.corpus(spark, sf)
    return vector.keys_of_chunks(docs, docs.filter("language = 'en'"), vector.surrogate_keys(docs))


def chosen_collection(spark, sf):
    """The collection of a model with the wanted dimension, else its latest one."""
    held = R._t(spark, sf, "clients").filter("updated_at is not null and segment is not null")
    held = held.select(F.col("source").alias("provider"), F.col("segment").alias("model"), F.col("nation_id").alias("dim"), "updated_at", F.col("client_id").alias("collection"))
    known = held.filter("provider is not null").groupBy("provider", "model").agg(F.min("dim").alias("dim")).orderBy("provider", "model").first()
    return vector.resolve_collection(held, known.provider, known.model, known.dim).select("collection", "dim")


def embed_texts(spark, sf):
    docs = R.corpus(spark, sf)
    return vector.embed_texts(docs.join(vector.missing(docs, R.collection(spark, sf)), "content_hash"), 300)


def paths_by_root(spark, sf):
    return trace.grouped(R._beam(spark, sf))


def server_worthy(spark, sf):
    _, symbols, edges = R._graph(spark, sf)
    calls = edges.withColumn("dst_symbol_id", F.when(F.col("line") % 3 == 0, F.col("dst_symbol_id"))).withColumn("dst_name", F.when(F.col("line") % 2 == 0, F.concat(F.lit("pkg."), "dst_name")).otherwise(F.concat("dst_name", F.lit("?"))))
    return graph.server_worthy(calls, symbols)


def result_lines(spark, sf):
    hits = R.hybrid_query(spark, sf).join(R.corpus(spark, sf), "chunk_id")
    return output.as_tsv(hits.select("path", "start_line", F.col("start_line").alias("end_line"), "symbol", "score", F.lit(None).cast("string").alias("snippet")))


def server_output(spark, sf):
    """Lines of a language server, made of documents, in both forms of a place."""
    docs = R.corpus(spark, sf)
    number = F.length("content")
    text = F.concat("path", F.lit(".go:"), number.cast("string"), F.lit(":"), (number % 80 + 1).cast("string"), F.lit("-"), F.when(number % 2 == 0, F.concat((number + 3).cast("string"), F.lit(":7"))).otherwise(F.lit("99")))
    return server_logs.locations(docs.select(text.alias("value")))


def identifier_columns(spark, sf):
    """Where a document's second identifier first stands alone in its first line."""
    docs = R.corpus(spark, sf).select("chunk_id", F.get(F.split("content", "\n"), F.lit(0)).alias("line"))
    name = F.coalesce(F.get(F.regexp_extract_all("line", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lit(1)), F.lit(""))
    return docs.select("chunk_id", server_logs.identifier_column(F.col("line"), name).cast("long").alias("column"))


def code_edges(spark, sf):
    """Edges of source files that are made of documents' words: imports, routes, calls and queries."""
    words = F.regexp_extract_all("content", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    w = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit("x"))
    text = F.concat(F.lit("from "), w(0), F.lit("."), w(1), F.lit(" import y\nimport "), w(2), F.lit("\n@app.get('/"), w(3), F.lit("')\ndef run():\n  "), w(1), F.lit("(1); router.post('/"), w(2), F.lit("', "), w(4), F.lit(")\n  q = 'select a from "), w(0), F.lit(" join "), w(3), F.lit("'\n"))
    chunks = R.corpus(spark, sf).select("chunk_id", "path", F.lit("python").alias("language"), text.alias("content"), w(1).alias("symbol"), F.lit(10).cast("long").alias("start_line"), F.lit(16).cast("long").alias("end_line"), F.lit("block").alias("kind"))
    return graph.edges(chunks).select("path", "edge_kind", "line", "dst_name", "confidence", "evidence")


def binary_contents(spark, sf):
    """Which contents count as binary: some have a NUL byte behind their text, within the first 8 KiB or beyond."""
    docs = R._t(spark, sf, "documents")
    raw = F.when(F.col("n_chars") % 7 == 0, F.concat(F.col("text").cast("binary"), F.lit(b"\0"))).otherwise(F.col("text").cast("binary"))
    return docs.select("doc_id", tree.is_binary(raw).alias("is_binary"))


def chunk_ids(spark, sf):
    """Identity of chunks: place, kind and symbol, without the content."""
    rows = R._windows(spark, sf)
    return rows.select("path", "start_line", chunking.chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("kind"), F.col("symbol")).alias("chunk_id"))


def vector_upsert(spark, sf):
    """A collection after an upsert: the newest row of each key, and old rows of keys that got none."""
    held = R._t(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("label").alias("updated_at"), F.get("embedding", 0).cast("double").alias("first"))
    fresh = held.filter("key % 3 = 0").withColumn("first", -F.col("first")).withColumn("updated_at", F.col("updated_at") + 5)
    return vector.upsert(held, vector.latest(held.filter("key % 3 = 0").unionByName(fresh), ["key"]), ["key"])


def result_files(spark, sf):
    return output.as_files(R._by_source(spark, sf))


QUERIES = {f.__name__: f for f in (bm25_snippets, query_hits, bm25_after_edits, ignored_urls, module_of_url, url_folders, covering_symbols, hit_roots, narrowest_order, first_chunks, frecency_upsert, server_edges, beam_trace_resumed, kept_scores, chunk_by_id, chunk_keys, chosen_collection, embed_texts, paths_by_root, server_worthy, result_lines, server_output, identifier_columns, code_edges, binary_contents, chunk_ids, vector_upsert, result_files)}


def _instances(phrases: list[list[str]]) -> str:
    parts = []
    for k, words in enumerate(phrases):
        joins = "".join(f" JOIN tok t{i} ON t{i}.chunk_id = t0.chunk_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
        parts.append(f"SELECT t0.chunk_id, t0.pos - 1 AS p, {k} AS k, t0.pos - 1 + {len(words)} AS e FROM tok t0{joins} WHERE t0.term = '{words[0]}' AND t0.chunk_id IN (SELECT chunk_id FROM {{rows}})")
    return " UNION ALL ".join(parts)


def snippets(rows: str, phrases: list[list[str]]) -> str:
    """CTEs that end in `cut` (chunk_id, snippet), by the rule of the snippet function of SQLite's full-text engine: every hit
    offers a window of 10 tokens around it and one from its sentence's start (after . or : and white space), a phrase's first
    hit in it counts 1000, further ones 1, the start of the text 120, of a sentence 100; the first best one is shown."""
    return f"""inst AS ({_instances(phrases).format(rows=rows)}),
parts AS (SELECT chunk_id, string_split_regex(content, '[\\p{{L}}\\p{{N}}]+') AS sep, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}]+') AS raw FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM inst)),
begun AS (SELECT chunk_id, len(raw) AS n, list_filter(range(0, len(raw)), lambda i: i = 0 OR regexp_matches(sep[i + 1], '[.:][ \\t\\n\\r]+$')) AS starts FROM parts),
offered AS (SELECT DISTINCT chunk_id, n, p, p AS s, 0 AS sentence FROM inst JOIN begun USING (chunk_id)
  UNION SELECT chunk_id, n, p, list_max(list_filter(starts, lambda i: i <= p)) AS s, 1 FROM inst JOIN begun USING (chunk_id) WHERE n > 10 AND list_max(list_filter(starts, lambda i: i <= p)) < p),
valued AS (SELECT o.chunk_id, n, o.p, s, sentence, 999 * count(DISTINCT i.k) + count(*) + sentence * (CASE WHEN s = 0 THEN 120 ELSE 100 END) AS score, min(i.p) AS a, arg_max(i.e, i.p * 10 + i.k) AS z
  FROM offered o JOIN inst i ON i.chunk_id = o.chunk_id AND i.p >= s AND i.p < s + 10 GROUP BY 1, 2, 3, 4, 5),
chosen AS (SELECT chunk_id, n, CASE WHEN sentence = 1 THEN s ELSE greatest(0, least(a - trunc((10 - (z - a)) / 2.0)::BIGINT, n - 10)) END AS b FROM valued QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, p, sentence) = 1),
spans AS (SELECT chunk_id, list({{'p': p, 'e': e}}) AS l FROM inst GROUP BY 1),
cut AS (SELECT chunk_id, (CASE WHEN b > 0 THEN '…' ELSE sep[1] END) || array_to_string(list_transform(range(b, least(b + 10, n)), lambda i:
    (CASE WHEN len(list_filter(l, lambda h: h.p <= i AND i < h.e)) > 0 AND (i = b OR len(list_filter(l, lambda h: h.p < i AND i < h.e)) = 0) THEN '[' ELSE '' END) || raw[i + 1]
    || (CASE WHEN len(list_filter(l, lambda h: h.p <= i AND i < h.e)) > 0 AND (i + 1 = least(b + 10, n) OR len(list_filter(l, lambda h: h.p < i + 1 AND i + 1 < h.e)) = 0) THEN ']' ELSE '' END)
    || (CASE WHEN i + 1 < least(b + 10, n) THEN sep[i + 2] ELSE '' END)), '') || (CASE WHEN b + 10 < n THEN '…' ELSE sep[n + 1] END) AS snippet
  FROM chosen JOIN parts USING (chunk_id) JOIN spans USING (chunk_id))"""


URLS = "urls AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^?#]*[^?#/])', 1) AS path FROM pages)"
SYMBOLS = "symbols AS (SELECT path || ':' || start_line AS symbol_id, * FROM windows)"
CONTENT = O.SQL["content_snippet"]
SQL = {
    "bm25_snippets": f"WITH {O.TOK},\n{O.hits('h', [O.phrase(['of', 'the']), O.phrase(['idiot'])], 'f0 OR f1', 50)},\n{snippets('h', [['of', 'the'], ['idiot']])}\nSELECT chunk_id, score, snippet FROM h JOIN cut USING (chunk_id)",
    "query_hits": f"WITH {O.FUSED},\n{snippets('hybrid', [['idiot'], ['clown']])},\nplain AS ({CONTENT})\nSELECT chunk_id, path, start_line, language, score, coalesce(cut.snippet, plain.snippet) AS snippet FROM hybrid JOIN chunks USING (chunk_id) LEFT JOIN cut USING (chunk_id) JOIN plain USING (chunk_id)",
    "bm25_after_edits": O.SQL["bm25_or"],
    "ignored_urls": f"""WITH {URLS} SELECT page_id, path FROM urls WHERE (starts_with(path, 'm.') AND NOT regexp_matches(path, '^m\\.[^/]*\\.com(/|$)')) OR (starts_with(path, 'spam-farm.') AND contains(path, '/'))
  OR (starts_with(path, 'blog.') AND regexp_matches(path, '^[^/]*/en/')) OR (regexp_matches(path, '\\.html(/|$)') AND NOT regexp_matches(path, '^blog\\.[^/]*/'))""",
    "module_of_url": f"""WITH {URLS} SELECT page_id, path, CASE WHEN regexp_matches(path, '^[^/]*/(en|fr)/') THEN regexp_extract(path, '^[^/]*/(?:en|fr)') WHEN contains(path, '/') THEN regexp_extract(path, '^[^/]*') END AS module FROM urls""",
    "url_folders": f"""WITH {URLS} SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS extension,
  CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language, count(*) AS n, 0::BIGINT AS n_tests FROM urls GROUP BY 1, 2, 3""",
    "covering_symbols": f"WITH {O.WINDOWS}, {SYMBOLS} SELECT path, 4::BIGINT AS line, symbol_id, row_number() OVER (PARTITION BY path ORDER BY end_line - start_line, start_line, symbol_id) AS width_rank FROM symbols WHERE start_line <= 4 AND 4 <= end_line",
    "hit_roots": f"""WITH {O.TOK}, {O.WINDOWS.removeprefix(O.CHUNKS + ',')}, {SYMBOLS},\n{O.hits('a', [O.phrase(['the'])], 'f0', 200)},
near AS (SELECT path, symbol_id FROM symbols WHERE start_line <= 4 AND 4 <= end_line QUALIFY row_number() OVER (PARTITION BY path ORDER BY end_line - start_line, start_line, symbol_id) = 1)
SELECT symbol_id, max(score) AS score FROM a JOIN near USING (path) GROUP BY symbol_id, path ORDER BY score DESC, path, symbol_id LIMIT 20""",
    "narrowest_order": """WITH spans AS (SELECT o_orderkey AS l_orderkey, o_orderpriority, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS first_day, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS last_day FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
points AS (SELECT DISTINCT o_orderpriority, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders)
SELECT o_orderpriority, day, l_orderkey, first_day, last_day FROM points JOIN spans USING (o_orderpriority) WHERE first_day <= day AND day <= last_day QUALIFY row_number() OVER (PARTITION BY o_orderpriority, day ORDER BY last_day - first_day, l_orderkey) = 1""",
    "first_chunks": f"WITH {O.WINDOWS} SELECT path, path || ':' || min(start_line) AS chunk_id FROM windows GROUP BY path",
    "frecency_upsert": "SELECT user_id::VARCHAR AS path, count(*)::DOUBLE AS rank, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_accessed FROM events GROUP BY 1",
    "server_edges": f"""WITH {O.GRAPH}, covered AS (SELECT DISTINCT src FROM edges WHERE kind = 'call' AND line % 2 = 0)
SELECT src AS src_symbol_id, kind AS edge_kind, count(*) AS n, max(c) AS best FROM (SELECT src, kind, confidence AS c FROM edges WHERE NOT (kind = 'call' AND src IN (SELECT src FROM covered))
  UNION ALL SELECT src, kind, 0.96::DOUBLE FROM edges WHERE kind = 'call' AND line % 2 = 0) GROUP BY 1, 2""",
    "beam_trace_resumed": O.SQL["beam_trace"],
    "kept_scores": "SELECT doc_id AS chunk_id, CASE WHEN text IN (SELECT text FROM documents WHERE lang = 'fr') THEN 'kept:' ELSE '' END || length(text) AS value FROM documents",
    "chunk_by_id": f"WITH {O.CHUNKS} SELECT chunk_id, path, content_hash FROM chunks WHERE chunk_id = 7",
    "chunk_keys": f"WITH {O.CHUNKS} SELECT chunk_id, ('0x' || substr(sha256(content_hash), 1, 15))::BIGINT AS key FROM chunks WHERE language = 'en'",
    "chosen_collection": """WITH held AS (SELECT * FROM clients WHERE updated_at IS NOT NULL AND segment IS NOT NULL), known AS (SELECT source, segment, min(nation_id) AS dim FROM held WHERE source IS NOT NULL GROUP BY ALL ORDER BY source, segment LIMIT 1)
SELECT client_id AS collection, nation_id AS dim FROM held JOIN known USING (source, segment) ORDER BY (nation_id = dim) IS TRUE DESC, updated_at DESC, client_id LIMIT 1""",
    "embed_texts": f"WITH {O.CHUNKS} SELECT content_hash, substring(arg_min(content, path), 1, 300) AS content FROM chunks WHERE content_hash NOT IN (SELECT content_hash FROM chunks JOIN embeddings ON vec_id = chunk_id) GROUP BY 1",
    "paths_by_root": f"WITH {O.BEAM} SELECT root, max(score) AS best_score, count(*) AS paths FROM beam GROUP BY root",
    "server_worthy": f"WITH {O.GRAPH} SELECT DISTINCT src AS symbol_id FROM edges JOIN symbols ON symbols.id = dst WHERE kind = 'call' AND (line % 3 = 0 OR line % 2 = 0)",
    "result_lines": f"WITH {O.FUSED} SELECT printf('%.4f', score) || chr(9) || path || ':1-1' || chr(9) || symbol || chr(9) AS value FROM hybrid JOIN chunks USING (chunk_id)",
    "server_output": f"WITH {O.CHUNKS} SELECT path || '.go' AS path, length(content) AS line, length(content) % 80 + 1 AS \"column\", length(content) + CASE WHEN length(content) % 2 = 0 THEN 3 ELSE 0 END AS end_line, CASE WHEN length(content) % 2 = 0 THEN 7 ELSE 99 END::BIGINT AS end_column FROM chunks",
    "identifier_columns": f"""WITH {O.CHUNKS}, l AS (SELECT chunk_id, string_split(content, chr(10))[1] AS line FROM chunks), w AS (SELECT *, coalesce(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')[2], '') AS name FROM l)
SELECT chunk_id, CASE WHEN name <> '' AND regexp_matches(line, '(^|[^A-Za-z0-9_])' || name || '([^A-Za-z0-9_]|$)') THEN strlen(regexp_extract(line, '^(.*?(?:^|[^A-Za-z0-9_]))' || name || '(?:[^A-Za-z0-9_]|$)', 1)) + 1 END AS "column" FROM w""",
    "code_edges": f"""WITH {O.CHUNKS}, w AS (SELECT path, regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*') AS ws FROM chunks),
n AS (SELECT path, coalesce(ws[1], 'x') AS a, coalesce(ws[2], 'x') AS b, coalesce(ws[3], 'x') AS c, coalesce(ws[4], 'x') AS d, coalesce(ws[5], 'x') AS e FROM w),
code AS (SELECT path, b, unnest(['from ' || a || '.' || b || ' import y', 'import ' || c, '@app.get(''/' || d || ''')', 'def run():', '  ' || b || '(1); router.post(''/' || c || ''', ' || e || ')', '  q = ''select a from ' || a || ' join ' || d || '''']) AS l, unnest(range(10, 16)) AS line FROM n),
found AS (
  SELECT path, 'call' AS edge_kind, line, unnest(regexp_extract_all(l, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS dst_name, NULL::DOUBLE AS confidence, trim(l) AS evidence, b FROM code
  UNION ALL SELECT path, 'import', line, unnest(regexp_extract_all(l, '^from ([A-Za-z0-9_.]+) import ', 1)), 0.75, trim(l), b FROM code
  UNION ALL SELECT path, 'import', line, unnest(regexp_extract_all(l, '^import ([A-Za-z0-9_.]+)', 1)), 0.75, trim(l), b FROM code
  UNION ALL SELECT path, 'route', line, b, 0.82, 'route ' || regexp_extract(l, '''([^'']+)''', 1) || ' -> ' || b, b FROM code WHERE starts_with(l, '@app.get')
  UNION ALL SELECT path, 'route', line, regexp_extract(l, ''', ([A-Za-z0-9_]+)', 1), 0.86, 'route ' || regexp_extract(l, '''([^'']+)''', 1) || ' -> ' || regexp_extract(l, ''', ([A-Za-z0-9_]+)', 1), b FROM code WHERE contains(l, 'router.post')
  UNION ALL SELECT path, 'sql_read', line, unnest(regexp_extract_all(l, '(?i)\\b(?:from|join)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)), 0.77, trim(l), b FROM code)
SELECT path, edge_kind, line, dst_name, max(coalesce(confidence, CASE WHEN dst_name = b THEN 0.45 ELSE 0.62 END))::DOUBLE AS confidence, evidence FROM found
WHERE edge_kind <> 'call' OR dst_name NOT IN ({", ".join(f"'{x}'" for x in graph.NOT_CALLS)}) GROUP BY path, edge_kind, line, dst_name, evidence""",
    "binary_contents": "SELECT doc_id, n_chars % 7 = 0 AND strlen(text) < 8192 AS is_binary FROM documents",
    "chunk_ids": f"WITH {O.WINDOWS} SELECT path, start_line, sha256(path || chr(1) || start_line || chr(1) || end_line || chr(1) || 'block' || chr(1)) AS chunk_id FROM windows",
    "vector_upsert": "SELECT vec_id AS key, label + CASE WHEN vec_id % 3 = 0 THEN 5 ELSE 0 END AS updated_at, embedding[1]::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN -1 ELSE 1 END AS first FROM embeddings",
    "result_files": f"WITH {O.TOK},\n{O.hits('a', [O.phrase(['the'])], 'f0', 200)} SELECT DISTINCT regexp_extract(path, '^([^/]*)/', 1) AS value FROM a",
}
