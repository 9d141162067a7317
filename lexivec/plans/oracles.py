"""DuckDB SQL that gives the rows of each query, written from the definitions of the operators."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN, STOP_WORDS

NOW = 1_706_745_600


def tokens(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, source || '/' || doc_id AS path, lang AS language, 1::BIGINT AS start_line, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS symbol, sha256(text) AS content_hash, text AS content, source FROM documents)"
TOK = f"""{CHUNKS},
toks AS (SELECT chunk_id, {tokens('content')} AS t FROM chunks),
tok AS (SELECT chunk_id, unnest(t) AS term, unnest(range(1, len(t) + 1)) AS pos FROM toks),
stat AS (SELECT count(*) AS total, avg(len(t)) AS average FROM toks)"""


def score(f: str, n: str, length: str = "len(toks.t)") -> str:
    idf = f"ln(((SELECT total FROM stat) - {n} + 0.5) / ({n} + 0.5))"
    return f"(CASE WHEN {idf} <= 0 THEN 1e-6 ELSE {idf} END) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * {length} / (SELECT average FROM stat)))"


def phrase(words: list[str], prefix: bool = False) -> str:
    """(chunk_id, f)."""
    joins = "".join(f" JOIN tok t{i} ON t{i}.chunk_id = t0.chunk_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    first = f"starts_with(t0.term, '{words[0]}')" if prefix else f"t0.term = '{words[0]}'"
    return f"SELECT t0.chunk_id, count(*) AS f FROM tok t0{joins} WHERE {first} GROUP BY 1"


def hits(name: str, phrases: list[str], match: str, limit: int = 50, where: str = "") -> str:
    """CTEs that end in `name`: (chunk_id, path, score), the best rows."""
    ctes = ",\n".join(f"{name}_p{i} AS ({p})" for i, p in enumerate(phrases))
    total = " + ".join(f"coalesce({score(f'{name}_p{i}.f', f'(SELECT count(*) FROM {name}_p{i})')}, 0)" for i in range(len(phrases)))
    joins = "\n".join(f"LEFT JOIN {name}_p{i} USING (chunk_id)" for i in range(len(phrases)))
    named = match
    for i in range(len(phrases)):
        named = named.replace(f"f{i}", f"(coalesce({name}_p{i}.f, 0) > 0)")
    return f"""{ctes},
{name} AS (SELECT chunk_id, path, round({total}, 6) AS score FROM chunks JOIN toks USING (chunk_id)
{joins}
WHERE ({named}) {where} ORDER BY score DESC, chunk_id LIMIT {limit})"""


def search(phrases: list[str], match: str, where: str = "") -> str:
    return f"WITH {TOK},\n{hits('h', phrases, match, 50, where)}\nSELECT chunk_id, path, score FROM h"


def rank(name: str, rows: str, limit: int | None = None) -> str:
    cut = f" ORDER BY score DESC, chunk_id LIMIT {limit}" if limit else ""
    return f"{name} AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM {rows}{cut}))"


NEAR = """SELECT chunk_id, count(*) AS f FROM (
  SELECT DISTINCT a.chunk_id, a.pos FROM tok a JOIN tok b ON a.chunk_id = b.chunk_id AND b.term = '{other}' AND greatest(a.pos, b.pos) - least(a.pos, b.pos) <= 6
  WHERE a.term = '{word}') GROUP BY 1"""

WINDOWS = f"""{CHUNKS},
lined AS (SELECT path, string_split(regexp_replace(content, '\\n$', ''), chr(10)) AS ls FROM chunks WHERE content <> ''),
win AS (SELECT path, unnest(range(0, greatest(0, ceil((len(ls) - 4) / 3.0))::BIGINT * 3 + 1, 3)) AS s, ls FROM lined),
windows AS (SELECT path, s + 1 AS start_line, least(s + 4, len(ls)) AS end_line, array_to_string(ls[s + 1 : s + 4], chr(10)) AS content FROM win)"""

NAMES = "['src/main.rs','pkg/service_test.go','web/app.test.ts','tests/a.py','contest.go','docs/readme.md','node_modules/x.js','pkg/node_modules/y.jsx','lib/specification.go','img/logo.png','integration_test/b.TSX','a.spec.js','vendor/z.go','Makefile']"
DEALT = f"dealt AS (SELECT doc_id, {NAMES}[n_chars % 14 + 1] AS path FROM documents)"
PLAN = """base AS (SELECT source || '/' || doc_id AS path, n_chars AS size, doc_id AS mtime, sha256(text) AS h, lang, source FROM documents),
files AS (SELECT path, size + (lang = 'de')::INT AS size, mtime - (source = 'src0')::INT AS mtime, CASE WHEN lang = 'de' THEN 'old' ELSE h END AS h FROM base WHERE lang <> 'es'),
scan AS (SELECT * FROM base WHERE lang <> 'fr'),
plan AS (SELECT coalesce(s.path, f.path) AS path, CASE WHEN s.path IS NULL THEN 'removed' WHEN f.path IS NULL THEN 'new'
  WHEN s.size = f.size AND s.mtime = f.mtime THEN 'unchanged' WHEN s.h = f.h THEN 'touched' ELSE 'changed' END AS action
  FROM scan s FULL JOIN files f ON s.path = f.path)"""
SIMILAR = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT vec_id AS chunk_id, label, round(greatest(-1, least(1, list_inner_product(embedding::DOUBLE[], q.v)
  / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q.v, q.v)))), 6) AS score FROM embeddings, q)"""
SEEDS = [phrase(["idiot"]), phrase(["clown"])]
BEST = f"{TOK},\n{SIMILAR},\n{hits('b', SEEDS, 'f0 AND f1', 200)},\n{rank('rb', 'b')},\n{rank('rv', 'near', 200)}"
FUSED = f"""{BEST},
fused AS (SELECT chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM rb UNION ALL SELECT * FROM rv) GROUP BY 1),
hybrid AS (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 50)"""
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
PRF = f"""seeds AS (SELECT chunks.* FROM (SELECT * FROM b ORDER BY score DESC, chunk_id LIMIT 10) JOIN chunks USING (chunk_id)),
words AS (
  SELECT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS term, 1 AS w FROM seeds
  UNION ALL SELECT unnest(regexp_split_to_array(symbol, '[^A-Za-z0-9_]+')), 3 FROM seeds
  UNION ALL SELECT unnest(['idiot', 'clown']), 2),
prf AS (SELECT term, sum(w)::BIGINT AS weight FROM words WHERE length(term) >= 3 AND lower(term) NOT IN ({STOP}) AND NOT regexp_full_match(term, '[0-9]+')
  GROUP BY 1 ORDER BY weight DESC, term LIMIT 24)"""
LINES = "lines AS (SELECT {key}, unnest(string_split({text}, chr(10))) AS l, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS line FROM {table})"
SYMBOLS = "symbols AS (SELECT chunk_id::VARCHAR AS symbol_id, chunk_id, path, start_line, path || '::' || symbol AS fq_name, lower(symbol) AS short_name FROM chunks WHERE symbol <> '')"

GRAPH = """symbols AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, c_name FROM customer UNION ALL SELECT 'O' || o_orderkey, o_orderpriority FROM orders),
edges AS (
  SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'call' AS kind, n_nationkey::BIGINT AS line, 0.62::DOUBLE AS confidence, n_name AS evidence, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'route', c_custkey, round(abs(c_acctbal) / 20000, 9), c_mktsegment, 0.9 FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'sql_read', o_orderkey, round(o_totalprice / 1000000, 9), o_orderstatus, 0.8 FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, line, dst) AS ord FROM edges),
ahead AS (SELECT ranked.*, name, weight * confidence + least(0.25, (contains(lower(name), 'building'))::INT * 0.08 + (contains(lower(evidence), 'building'))::INT * 0.04
  + (contains(lower(name), 'urgent'))::INT * 0.08 + (contains(lower(evidence), 'urgent'))::INT * 0.04) AS gain FROM ranked JOIN symbols ON symbols.id = dst WHERE ord <= 4),
s0 AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS current, r_name AS from_symbol, round(r_regionkey * 0.01 + 0.5, 6) AS score, 0::BIGINT AS state_ord, ''::VARCHAR AS node FROM region)"""
for _d in (1, 2, 3):
    GRAPH += f""",
e{_d} AS (SELECT root, {_d}::BIGINT AS depth, dst AS last, round(score + gain - 0.06 * {_d}, 12) AS score, from_symbol, name AS target, state_ord, ord, line, kind, confidence,
  node || (CASE WHEN node = '' THEN '' ELSE ' > ' END) || concat_ws(':', kind, from_symbol, name, 'graph/tpch.rs', line) AS node FROM s{_d - 1} JOIN ahead ON src = current),
s{_d} AS (SELECT root, last AS current, target AS from_symbol, score, n AS state_ord, node FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, state_ord, ord) AS n FROM e{_d}) WHERE n <= 4)"""
BEAM = GRAPH + ",\nbeam AS (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3)"
CHOSEN = f"""{BEAM},
keyed AS (SELECT *, concat_ws('|', root, kind, 'graph/tpch.rs', line, target) AS key FROM beam),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, depth, state_ord, ord) AS n FROM keyed) WHERE n = 1),
rooted AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, depth, state_ord, ord, key) AS root_rank FROM single),
chosen AS (SELECT * FROM rooted ORDER BY root_rank > 1, score DESC, root, depth, state_ord, ord, key LIMIT 12)"""

SQL: dict[str, str] = {
    "tokenize_stats": f"""WITH {TOK} SELECT language, count(DISTINCT chunk_id) AS n_docs, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok JOIN chunks USING (chunk_id) GROUP BY 1""",
    "bm25_and": search([phrase(["that"]), phrase(["with"])], "f0 AND f1"),
    "bm25_or": search([phrase(["idiot"]), phrase(["clown"]), phrase(["trash"])], "f0 OR f1 OR f2"),
    "bm25_phrase": search([phrase(["of", "the"])], "f0"),
    "bm25_prefix": search([phrase(["clow"], True), phrase(["disg"], True)], "f0 OR f1"),
    "bm25_not": search([phrase(["the"]), phrase(["of"])], "f0 AND NOT f1"),
    # Statistics count every phrase that occurs; rows need both within five tokens of each other.
    "bm25_near": search([phrase(["the"]), phrase(["idiot"])], f"chunk_id IN (SELECT chunk_id FROM ({NEAR.format(word='the', other='idiot')}))"),
    "bm25_lang_path_filter": search([phrase(["of"])], "f0", "AND language IN ('en', 'de') AND (path ILIKE 'SRC1%' OR path ILIKE 'src_%')"),
    "bm25_batch_benchmark": f"""WITH {TOK},
words AS (SELECT DISTINCT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM words) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY 1),
scored AS (SELECT query_id, chunk_id, round(sum({score('tf', 'n')}), 6) AS score FROM tf JOIN df USING (term) JOIN words USING (term) JOIN toks USING (chunk_id) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 5""",
    "snippet_window": f"""WITH {TOK},
hit AS (SELECT chunk_id, pos FROM tok WHERE term IN ('idiot', 'clown')),
counted AS (SELECT a.chunk_id, a.pos, count(*) AS n FROM hit a JOIN hit b ON a.chunk_id = b.chunk_id AND b.pos BETWEEN a.pos AND a.pos + 9 GROUP BY 1, 2),
best AS (SELECT chunk_id, arg_max(pos, n * 1000000 - pos) AS s FROM counted GROUP BY 1),
shown AS (SELECT chunk_id, regexp_extract_all(content, '[\\p{{L}}\\p{{N}}]+') AS raw, t, s FROM best JOIN chunks USING (chunk_id) JOIN toks USING (chunk_id))
SELECT chunk_id, (CASE WHEN s > 1 THEN '…' ELSE '' END) || array_to_string(list_transform(range(s, least(s + 10, len(t) + 1)), lambda i: CASE WHEN t[i] IN ('idiot', 'clown') THEN '[' || raw[i] || ']' ELSE raw[i] END), ' ')
  || (CASE WHEN s + 9 < len(t) THEN '…' ELSE '' END) AS snippet FROM shown""",
    "content_snippet": """SELECT doc_id AS chunk_id, CASE WHEN strlen(j) > 200 THEN substring(j, 1, list_max(list_filter(range(50, 201), lambda k: strlen(substring(j, 1, k)) <= 200))) || '…' ELSE j END AS snippet
FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10))[1:3], lambda s: trim(s)), lambda s: s <> ''), ' ') AS j FROM documents)""",
    "chunk_windows": f"WITH {WINDOWS} SELECT path, start_line, end_line, sha256(content) AS content_hash FROM windows",
    "chunk_sections": f"""WITH {CHUNKS},
l AS (SELECT path, unnest(string_split(content, chr(10))) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM chunks WHERE content <> ''),
m AS (SELECT path, i, CASE WHEN i % 3 = 0 THEN '## ' || s ELSE s END AS s FROM l),
kept AS (SELECT * FROM m QUALIFY NOT (s = '' AND i > 1 AND i = max(i) OVER (PARTITION BY path))),
h AS (SELECT *, regexp_matches(s, '^\\s*#{{1,6}} \\s*\\S') AS head FROM kept),
n AS (SELECT *, sum(head::INT) OVER (PARTITION BY path ORDER BY i) AS sec, bool_or(head) OVER (PARTITION BY path) AS any_head FROM h)
SELECT path, min(i) AS start_line, max(i) AS end_line, coalesce(max(CASE WHEN head THEN trim(regexp_replace(s, '^\\s*#{{1,6}} ', '')) END), 'Preamble') AS symbol, sha256(string_agg(s, chr(10) ORDER BY i)) AS content_hash
FROM n WHERE any_head GROUP BY path, sec""",
    "chunk_covering_line": f"""WITH {WINDOWS}, asked AS (SELECT path, unnest([2, 4, 9])::BIGINT AS line FROM chunks),
around AS (SELECT asked.path, line, start_line, end_line, row_number() OVER (PARTITION BY asked.path, line ORDER BY end_line - start_line, start_line) AS n FROM asked JOIN windows ON windows.path = asked.path AND line BETWEEN start_line AND end_line)
SELECT path, line, start_line, end_line FROM around WHERE n = 1""",
    "test_path_filter": f"""WITH {DEALT} SELECT doc_id, path, path IN ('pkg/service_test.go', 'web/app.test.ts', 'tests/a.py', 'integration_test/b.TSX', 'a.spec.js') AS is_test FROM dealt""",
    "language_classify": f"""WITH {DEALT} SELECT path, count(*) AS n, CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'ts' WHEN 'tsx' THEN 'tsx' WHEN 'js' THEN 'js' WHEN 'jsx' THEN 'jsx' WHEN 'py' THEN 'python'
  WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' ELSE 'unknown' END AS language, path LIKE '%.png' AS is_binary FROM dealt GROUP BY 1""",
    "exclude_prefix": f"""WITH {DEALT} SELECT * FROM dealt WHERE NOT (starts_with(path, 'tests/') OR starts_with(path, 'node_modules/') OR starts_with(path, 'vendor/'))""",
    "index_incremental_plan": f"WITH {PLAN} SELECT path, action FROM plan",
    "index_stats": f"""WITH {WINDOWS}, {PLAN}
SELECT count(*) FILTER (WHERE action <> 'removed') AS scanned, count(*) FILTER (WHERE action IN ('new', 'changed')) AS indexed, count(*) FILTER (WHERE action IN ('unchanged', 'touched')) AS skipped, count(*) FILTER (WHERE action = 'removed') AS removed,
  (SELECT count(*) FROM windows JOIN plan USING (path) WHERE action IN ('new', 'changed')) AS chunks_written FROM plan""",
    "content_dedup_representative": f"WITH {CHUNKS} SELECT content_hash, arg_min(chunk_id, path) AS chunk_id, min(path) AS path FROM chunks GROUP BY 1",
    "missing_hashes": f"WITH {CHUNKS} SELECT DISTINCT content_hash FROM chunks WHERE content_hash NOT IN (SELECT content_hash FROM chunks JOIN embeddings ON vec_id = chunk_id)",
    "orphan_hashes": f"WITH {CHUNKS} SELECT DISTINCT content_hash FROM chunks JOIN embeddings ON vec_id = chunk_id WHERE content_hash NOT IN (SELECT content_hash FROM chunks WHERE language = 'en')",
    "vector_topk": f"WITH {SIMILAR} SELECT chunk_id AS vec_id, score FROM near ORDER BY score DESC, chunk_id LIMIT 20",
    "vector_topk_filtered": f"WITH {SIMILAR} SELECT chunk_id AS vec_id, score FROM near WHERE label IN (1, 2) ORDER BY score DESC, chunk_id LIMIT 20",
    "vector_search": f"""WITH {CHUNKS}, {SIMILAR}, held AS (SELECT content_hash, arg_min(score, chunk_id) AS score FROM near JOIN chunks USING (chunk_id) GROUP BY 1),
shown AS (SELECT content_hash, arg_min(chunk_id, path) AS chunk_id, min(path) AS path FROM chunks WHERE language IN ('en', 'fr') GROUP BY 1)
SELECT chunk_id, path, score FROM (SELECT * FROM held JOIN shown USING (content_hash) ORDER BY score DESC, content_hash LIMIT 20)""",
    "vector_normalize": """SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first, 1.0::DOUBLE AS length FROM embeddings""",
    "rrf_fusion": f"""WITH {TOK},\n{hits('a', [phrase(['the'])], 'f0', 200)},\n{hits('c', [phrase(['of'])], 'f0', 200)},\n{rank('ra', 'a')},\n{rank('rc', 'c')}
SELECT chunk_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM ra UNION ALL SELECT *, 0.6::DOUBLE FROM rc) GROUP BY 1""",
    "hybrid_query": f"WITH {FUSED} SELECT chunk_id, score FROM hybrid",
    "prf_terms": f"WITH {TOK},\n{hits('b', SEEDS, 'f0 AND f1', 200)},\n{PRF} SELECT * FROM prf",
    "deep_query": f"""WITH {BEST},\n{PRF},
xf AS (SELECT chunk_id, prf.term, count(*) AS f FROM tok JOIN prf ON tok.term = lower(prf.term) GROUP BY 1, 2),
xn AS (SELECT term, count(*) AS n FROM xf GROUP BY 1),
x AS (SELECT chunk_id, round(sum({score('f', 'n')}), 6) AS score FROM xf JOIN xn USING (term) JOIN toks USING (chunk_id) GROUP BY 1),
{rank('rx', 'x', 200)}
SELECT chunk_id, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM rb UNION ALL SELECT *, 1.0::DOUBLE FROM rv UNION ALL SELECT *, 0.6::DOUBLE FROM rx) GROUP BY 1 ORDER BY score DESC, chunk_id LIMIT 50""",
    "deterministic_rerank": f"""WITH {FUSED},
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM hybrid),
scored AS (SELECT chunk_id, place, place > 30 AS tail, round(CASE WHEN place > 30 THEN p.score ELSE p.score + 0.2 * coalesce(b.score, 0) / (SELECT max(score) FROM b) + 0.2 * greatest(0, least(1, coalesce(near.score, 0)))
  + CASE WHEN lower(symbol) IN ('idiot', 'clown') THEN 0.05 ELSE 0 END END, 6) AS score FROM placed p LEFT JOIN b USING (chunk_id) LEFT JOIN near USING (chunk_id) LEFT JOIN chunks USING (chunk_id))
SELECT chunk_id, score, row_number() OVER (ORDER BY tail, CASE WHEN tail THEN place ELSE -score END, chunk_id) AS position FROM scored""",
    "external_rerank": f"""WITH {FUSED},
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM hybrid),
wanted AS (SELECT content_hash, any_value(content) AS content, bool_or(language = 'fr') AS cached FROM chunks JOIN hybrid USING (chunk_id) GROUP BY 1),
given AS (SELECT content_hash, CASE WHEN cached THEN 0.5 ELSE round((length(content) - length(translate(content, 'aeiou', ''))) / greatest(length(content), 1), 6) END AS given FROM wanted),
scored AS (SELECT chunk_id, place > 30 AS tail, placed.score, CASE WHEN place <= 30 THEN given END AS given FROM placed LEFT JOIN chunks USING (chunk_id) LEFT JOIN given USING (content_hash))
SELECT chunk_id, coalesce(given, score) AS score, row_number() OVER (ORDER BY tail, given DESC NULLS LAST, score DESC, chunk_id) AS position FROM scored""",
    "guide_best_per_file": f"""WITH {TOK},\n{hits('a', [phrase(['the'])], 'f0', 200)},
s AS (SELECT split_part(path, '/', 1) AS path, chunk_id, score, row_number() OVER (PARTITION BY split_part(path, '/', 1) ORDER BY score DESC, chunk_id) AS n FROM a)
SELECT path, chunk_id, score FROM s WHERE n = 1 ORDER BY score DESC, path LIMIT 8""",
    "cd_directory_vote": f"""WITH {TOK},\n{hits('a', [phrase(['the'])], 'f0', 200)},\n{rank('r', 'a')},
vote AS (SELECT source AS directory, sum(1.0::DOUBLE / rank) AS vote FROM r JOIN chunks USING (chunk_id) GROUP BY 1),
seen AS (SELECT 'src' || (user_id % 40) AS directory, count(*)::DOUBLE AS rank, max(floor(epoch(ts)))::BIGINT AS last FROM events GROUP BY 1)
SELECT directory, round(vote + 0.5 * coalesce(rank * exp(-greatest(0, {NOW} - last) / 86400.0::DOUBLE / 14.0::DOUBLE), 0), 6) AS score FROM vote LEFT JOIN seen USING (directory)""",
    "frecency_decay": """WITH seen AS (SELECT event_type AS path, count(*)::DOUBLE / 100 AS rank, max(floor(epoch(ts)))::BIGINT AS last FROM events GROUP BY 1)
SELECT path, round(rank * exp(-greatest(0, (SELECT max(floor(epoch(ts)))::BIGINT FROM events) + 604800 - last) / 86400.0::DOUBLE / 14.0::DOUBLE), 6) AS frecency FROM seen""",
    "extract_call_edges": f"""WITH {LINES.format(key='page_id', text='html', table='pages')},
m AS (SELECT page_id, line, unnest(regexp_extract_all(l, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS name FROM lines)
SELECT page_id, line, name, count(*) AS n FROM m WHERE name NOT IN ('if','for','while','switch','match','return','fn','func','def','class','struct','enum','trait','impl','let','new','use','import','from','catch','throw') GROUP BY 1, 2, 3""",
    "extract_sql_edges": f"""WITH {LINES.format(key='doc_id AS chunk_id', text='text', table='documents')},
m AS (SELECT chunk_id, line, 'sql_read' AS edge_kind, 0.77::DOUBLE AS confidence, unnest(regexp_extract_all(l, '(?i)\\bfrom\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM lines
  UNION ALL SELECT chunk_id, line, 'sql_read', 0.77, unnest(regexp_extract_all(l, '(?i)\\bjoin\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM lines
  UNION ALL SELECT chunk_id, line, 'sql_read', 0.77, unnest(regexp_extract_all(l, '(?i)\\bselect\\s+.+?\\bfrom\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM lines
  UNION ALL SELECT chunk_id, line, 'sql_write', 0.82, unnest(regexp_extract_all(l, '(?i)\\binsert\\s+into\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM lines
  UNION ALL SELECT chunk_id, line, 'sql_write', 0.82, unnest(regexp_extract_all(l, '(?i)\\bupdate\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM lines
  UNION ALL SELECT chunk_id, line, 'sql_write', 0.82, unnest(regexp_extract_all(l, '(?i)\\bdelete\\s+from\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) FROM lines)
SELECT chunk_id, edge_kind, line, name, max(confidence) AS confidence FROM m GROUP BY 1, 2, 3, 4""",
    "extract_links": f"""WITH {LINES.format(key='page_id', text='html', table='pages')}, m AS (SELECT page_id, unnest(regexp_extract_all(l, 'href="([^"]*)"', 1)) AS name FROM lines) SELECT page_id, name, count(*) AS n FROM m GROUP BY 1, 2""",
    "resolve_names": f"""WITH {CHUNKS}, {SYMBOLS}, {LINES.format(key='chunk_id, path', text='content', table='chunks')},
e AS (SELECT DISTINCT chunk_id, path, line, unnest(regexp_extract_all(l, '(?i)\\bfrom\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)) AS dst_name FROM lines),
tried AS (SELECT e.*, s.symbol_id, row_number() OVER (PARTITION BY e.chunk_id, e.line, e.dst_name ORDER BY (s.path = e.path) DESC, s.path, s.start_line, s.symbol_id) AS n FROM e LEFT JOIN symbols s ON s.short_name = e.dst_name)
SELECT chunk_id, line, dst_name, symbol_id AS dst_symbol_id FROM tried WHERE n = 1""",
    "symbol_roots": f"WITH {TOK}, {SYMBOLS},\n{hits('a', [phrase(['the'])], 'f0', 200)} SELECT symbol_id, max(score) AS score FROM a JOIN symbols USING (chunk_id) GROUP BY symbol_id, symbols.path ORDER BY score DESC, symbols.path, symbol_id LIMIT 20",
    "fallback_roots": f"""WITH {CHUNKS}, {SYMBOLS}, s AS (SELECT symbol_id, path, 0.5::DOUBLE * contains(short_name, 'the')::INT + 0.5::DOUBLE * contains(short_name, 'on')::INT + 0.5::DOUBLE * contains(short_name, 'er')::INT AS score FROM symbols)
SELECT symbol_id, score FROM s WHERE score > 0 ORDER BY score DESC, path, symbol_id LIMIT 20""",
    "outgoing_ranked": f"WITH {GRAPH} SELECT src AS src_symbol_id, dst AS dst_symbol_id, ord AS edge_rank FROM ranked WHERE ord <= 3",
    "beam_trace": f"WITH {BEAM} SELECT root, depth, last, score, from_symbol, target FROM beam",
    "diverse_paths": f"WITH {CHOSEN} SELECT root, depth, score, root_rank, line FROM chosen",
    "flow_tree": f"""WITH {BEAM},
prefix AS (SELECT a.root, b.node, b.depth, b.confidence, a.score FROM beam a JOIN beam b ON a.root = b.root AND (a.node = b.node OR starts_with(a.node, b.node || ' > ')))
SELECT root, depth, node, count(*) AS count, max(score) AS best_score, max(confidence) AS best_confidence FROM prefix GROUP BY 1, 2, 3""",
    "trace_citations": f"""WITH {CHOSEN}, p AS (SELECT *, row_number() OVER (ORDER BY score DESC, root, depth) AS p FROM chosen),
told AS (SELECT 1::BIGINT AS line, p, 0 AS i FROM p UNION ALL
  SELECT split_part(unnest(string_split(node, ' > ')), ':', -1)::BIGINT, p, unnest(range(1, depth + 1)) FROM p),
first AS (SELECT line, min(p * 100 + i) AS o FROM told GROUP BY 1)
SELECT 'graph/tpch.rs' AS path, line, row_number() OVER (ORDER BY o, line) AS place FROM first""",
}

SQL["vector_topk_ivf"] = SQL["vector_topk"]
