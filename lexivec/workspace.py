"""A workspace: tables in one folder, brought up to date from a tree, and the commands that read them.

Tables are segmented: a run writes the rows of files that changed, and keys of what they had before; merges follow a schedule
by size. `CURRENT` names the segments in use. It is replaced last, by a rename that takes effect whole or not at all, so a run
that breaks off leaves the old state. Segments that a run has replaced are deleted by the next one, when no reader of the
state before can be left. Only files whose size or time changed are read, and only their edges are extracted; other edges
are resolved again if a name of theirs came or went. The driver holds names of segments and counts only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.text import content_snippet
from .operators import analytics, cache, chunking, fusion, graph, index, lexical, trace, vector
from .operators.segments import SegmentedTable
from .session import remove
from .sources import tree
from .sources.providers import Embedder, hashed_bag

FILES = "path string, size long, mtime long, language string, content_hash string"
CHUNKS = "chunk_id string, path string, language string, start_line long, end_line long, kind string, symbol string, content_hash string, content string"
VECTORS = "content_hash string, vector array<double>"
SYMBOLS = "symbol_id string, chunk_id string, path string, start_line long, end_line long, language string, kind string, fq_name string, short_name string"
REFERENCES = f"ref_id string, {graph.EDGE}"
EDGES = "ref_id string, src_symbol_id string, dst_symbol_id string, dst_name string, edge_kind string, path string, line long, confidence double, evidence string, edge_id string"
FRECENCY = "path string, rank double, last_accessed long"
SCHEMAS = {"files": FILES, "references": REFERENCES, "chunks": CHUNKS, "vectors": VECTORS, "symbols": SYMBOLS, "edges": EDGES, "frecency": FRECENCY, "cache": cache.SCHEMA}
#: What rows of a table come and go by.
KEYS = {"files": "path", "references": "path", "chunks": "path", "vectors": "content_hash", "edges": "ref_id", "frecency": "path", "cache": "key"}


class Workspace:
    def __init__(self, spark: SparkSession, folder: str, config: Config = Config(), embedder: Embedder | None = None, scorer: Callable[[str, list[str]], list[float]] | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config
        self.embedder, self.scorer = embedder or hashed_bag(config.embed.dimensions), scorer

    # State: one small text file, read and written by Spark so that any file system will do.

    def state(self) -> dict:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {"generation": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT").first().value)

    def _save(self, state: dict) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        current, fresh = hadoop.Path(f"{self.folder}/CURRENT"), hadoop.Path(f"{self.folder}/.CURRENT-{uuid.uuid4().hex}")
        out = fresh.getFileSystem(conf).create(fresh, True)
        out.write(bytearray((json.dumps(state) + "\n").encode()))
        out.close()
        rename = getattr(hadoop, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        qualified = current.getFileSystem(conf).makeQualified
        hadoop.FileContext.getFileContext(qualified(current).toUri(), conf).rename(qualified(fresh), qualified(current), how)

    def segmented(self, name: str, state: dict | None = None) -> SegmentedTable:
        """A table by its segments; empty where the state names none."""
        held = (self.state() if state is None else state)["tables"].get(name, [])
        sort = {"chunks": ["path"], "files": ["path"]}.get(name)
        return SegmentedTable(self.spark, f"{self.folder}/{name}", SCHEMAS[name], KEYS[name], held, sort)

    def table(self, name: str, state: dict | None = None) -> DataFrame:
        if name == "symbols":  # a view of the chunks
            return graph.symbols(self.table("chunks", state))
        return self.segmented(name, state).read()

    def _keep(self, state: dict, name: str, table: SegmentedTable) -> SegmentedTable:
        """Note a table's segments in the state, merged if that is due; what they replace becomes garbage."""
        table = table.compacted()
        names = {s["name"] for s in table.listed()}
        state["garbage"] += [f"{self.folder}/{name}/{s['name']}" for s in state["tables"].get(name, []) if s["name"] not in names]
        state["tables"][name] = table.listed()
        return table

    def _begun(self) -> tuple[dict, list[str]]:
        """The state to change, and folders that the state before it had replaced."""
        state = self.state()
        old = state.get("garbage", [])
        return state | {"garbage": [], "tables": dict(state["tables"])}, old

    def _scratch(self, df: DataFrame, name: str, made: list[str]) -> DataFrame:
        made.append(f"{self.folder}/.scratch/{name}-{uuid.uuid4().hex}")
        df.write.parquet(made[-1])
        return self.spark.read.schema(df.schema).parquet(made[-1])

    def index(self, root: str, ignore_text: str = "", exclude: list[str] | None = None, full: bool = False) -> dict:
        """Bring files, chunks, references and edges up to date; returns the counts of the run."""
        began, made = time.time(), []
        remove(self.spark, f"{self.folder}/.scratch")  # of a run that broke off
        state, garbage = self._begun()
        state["garbage"].append(f"{self.folder}/trace/{state['generation']}")
        if full:
            for name in ("files", "chunks", "references", "edges", "lexical"):
                state["garbage"] += [f"{self.folder}/{name}/{s['name']}" for s in state["tables"].pop(name, [])]
        columns = [c.split()[0] for c in FILES.split(", ")]
        files = self.segmented("files", state)
        held = files.read()
        # The tree is listed once; a file that changes while the run goes on is seen as it was then.
        listed = self._scratch(tree.listing(self.spark, root, self.config.index, ignore_text, exclude), "listed", made)
        known = held.join(listed, ["path", "size", "mtime"], "left_semi")
        read = self._scratch(tree.scan(self.spark, root, self.config.index, only=listed.join(known, "path", "left_anti")), "read", made)
        actions = self._scratch(index.plan(known.select(*columns).unionByName(read.select(*columns)), held), "actions", made)
        did = lambda *kinds: actions.filter(F.col("action").isin(*kinds)).select("path")
        gone, came = did(index.CHANGED, index.REMOVED), did(index.CHANGED, index.NEW)
        self._keep(state, "files", files.appended(read.join(did(index.CHANGED, index.NEW, index.TOUCHED), "path", "left_semi"), did(index.CHANGED, index.TOUCHED, index.REMOVED)))
        fresh = self._scratch(chunking.chunk_files(read.join(came, "path", "left_semi"), self.config.index), "chunks", made)
        chunks = self.segmented("chunks", state)
        old = self._scratch(chunks.read().join(gone, "path", "left_semi"), "old", made)
        chunks = self._keep(state, "chunks", chunks.appended(fresh, gone))
        found = self._scratch(graph.edges(fresh).withColumn("ref_id", graph.reference_id()), "references", made)
        references = self.segmented("references", state)
        lost = self._scratch(references.read().join(gone, "path", "left_semi").select("ref_id"), "lost", made)
        references = self._keep(state, "references", references.appended(found, gone))
        # A reference's target depends on the symbols of its name alone, so only names that came or went are resolved again.
        symbols = graph.symbols(chunks.read())
        names = graph.symbols(fresh).unionByName(graph.symbols(old)).select(graph.last_name(F.col("short_name")).alias("name"))
        touched = self._scratch(graph.touched_references(references.read(), names, came), "touched", made)
        wanted = touched.select(graph.last_name(F.col("dst_name")).alias("_name")).distinct()
        likely = symbols.join(wanted, graph.last_name(F.col("short_name")) == F.col("_name"), "left_semi")
        edges = self.segmented("edges", state)
        was = edges.read().select("ref_id", F.col("dst_symbol_id").alias("_dst"), F.lit(True).alias("_was"))
        resolved = graph.resolve(touched, likely).join(was, "ref_id", "left").filter(F.col("_was").isNull() | ~F.col("dst_symbol_id").eqNullSafe(F.col("_dst"))).drop("_dst", "_was")
        resolved = self._scratch(resolved.withColumn("edge_id", graph.edge_id()), "edges", made)
        self._keep(state, "edges", edges.appended(resolved, lost.unionByName(resolved.select("ref_id"))))
        words = lexical.Index(self.spark, f"{self.folder}/lexical", "string", state["tables"].get("lexical"))
        if words.segments and fresh.isEmpty() and old.isEmpty():
            state["tables"]["lexical"] = words.listed()
        else:
            self._keep(state, "lexical", words.updated(fresh, old))
        counts = index.stats(actions, fresh).first().asDict()
        state |= {"generation": state["generation"] + 1, "last_indexed_at": int(began)}
        self._save(state)
        remove(self.spark, *garbage, *made)
        return counts | {"duration_ms": int(1000 * (time.time() - began))}

    def embed(self, full: bool = False) -> DataFrame:
        """Vectors of new contents are added, those of contents that are gone are taken away."""
        state, garbage = self._begun()
        vectors, chunks, settings = self.segmented("vectors", state), self.table("chunks", state), self.config.embed
        held = self.spark.createDataFrame([], VECTORS) if full else vectors.read()
        gone = vectors.read().select("content_hash") if full else vector.orphans(chunks, held).select("content_hash")
        fresh = vector.embedded(vector.missing(chunks, held).join(chunks, "content_hash"), self.embedder, settings.max_chars, settings.batch_size)
        out = self._keep(state, "vectors", vectors.appended(fresh, gone))
        self._save(state)
        remove(self.spark, *garbage)
        return out.read()

    def lexical(self) -> lexical.Index | None:
        """The inverted index of the chunks, once there is one."""
        held = self.state()["tables"].get("lexical")
        return lexical.Index(self.spark, f"{self.folder}/lexical", "string", held) if held else None

    def cached(self) -> cache.Cache:
        state = self.state()
        return cache.Cache(self.segmented("cache", state), state["generation"])

    def _cache(self, held: cache.Cache) -> None:
        """Take over what a cache holds by now; the generation stays."""
        state, garbage = self._begun()
        self._keep(state, "cache", held.table)
        self._save(state)
        remove(self.spark, *garbage)

    def query_vector(self, text: str) -> list[float]:
        """The query's vector, embedded once; one of another dimension than asked for counts as missing."""
        settings = self.config.embed
        key, held = cache.key_of("query vector", provider=settings.provider, model=settings.model, dimensions=settings.dimensions, text=text), self.cached()
        value = json.loads(held.get(key) or "[]")
        if len(value) != settings.dimensions:
            value = [float(x) for x in self.embedder([text])[0]]
            self._cache(held.put_one(key, json.dumps(value)))
        return value

    def search(self, query: str, **options) -> DataFrame:
        return lexical.search(self.table("chunks"), query, index=self.lexical(), **options)

    def similarities(self, query: str) -> DataFrame | None:
        vectors = self.table("vectors")
        if vectors.isEmpty():
            return None
        return vector.vector_search(self.table("chunks"), vectors, self.query_vector(query), self.config.query.vec_limit).select("chunk_id", "score")

    def query(self, text: str, deep: bool = False, expand=None) -> DataFrame:
        """The best chunks, as `shown`. Deep queries are reranked: by the scorer if the workspace has one, its scores kept by
        content, else by shares of both lists."""
        chunks, near, words = self.table("chunks"), self.similarities(text), self.lexical()
        if not deep:
            return self.shown(fusion.hybrid(chunks, near, text, self.config.query, index=words), text)
        fused = fusion.held(fusion.deep(chunks, near, text, self.config.query, self.config.deep, self._expansions(expand), index=words))
        ranked = self._scored(fused, text) if self.scorer is not None and not fused.isEmpty() else None
        if ranked is None:
            hits = lexical.search(chunks, text, self.config.query.bm25_limit, index=words)
            ranked = fusion.deterministic_rerank(fused, hits, self._cosines(fused, text), chunks, text, self.config.deep.rerank_top)
        return self.shown(ranked, text)

    def _expansions(self, expand):
        """`expand`, asked once for each query."""
        if expand is None:
            return None

        def asked(query: str, terms: list[str]) -> list[str]:
            key, held = cache.key_of("expansions", provider=self.config.embed.provider, model=self.config.embed.model, query=query), self.cached()
            value = held.get(key)
            if value is None:
                value = json.dumps(list(expand(query, terms)))
                self._cache(held.put_one(key, value))
            return json.loads(value)

        return asked

    def _cosines(self, fused: DataFrame, text: str) -> DataFrame:
        """(chunk_id, score): cosines of the fused rows, worked out for these alone."""
        vectors = self.table("vectors")
        if vectors.isEmpty():
            return self.spark.createDataFrame([], "chunk_id string, score double")
        return vector.cosines(self.table("chunks").join(F.broadcast(fused.select("chunk_id")), "chunk_id").select("chunk_id", "content_hash"), vectors, self.query_vector(text))

    def _scored(self, fused: DataFrame, text: str) -> DataFrame | None:
        """The head reordered by the scorer; None where it fails. `rerank_top` contents at most go to it, those whose scores
        are kept don't."""
        head = fused.orderBy(F.desc("score"), "chunk_id").limit(self.config.deep.rerank_top)
        contents = self.table("chunks").join(F.broadcast(head.select("chunk_id")), "chunk_id").select("chunk_id", "content_hash", "content")
        wanted = contents.withColumn("key", cache.keys_of("rerank", "content_hash", provider=self.config.embed.provider, model=self.config.embed.model, query=text))

        def work_out(rows: DataFrame) -> DataFrame:
            todo = rows.select("key", "content").orderBy("key").collect()  # rerank_top rows
            given = self.scorer(text, [r.content or "" for r in todo])
            return self.spark.createDataFrame([(r.key, str(float(s))) for r, s in zip(todo, given, strict=True)], "key string, value string")

        before = self.cached()
        try:
            held, scores = before.filled(wanted, work_out)
        except (ValueError, OSError):
            return None
        if held is not before:
            self._cache(held)
        given = wanted.join(scores, "key").select("content_hash", F.col("value").cast("double").alias("score")).distinct()
        return fusion.scored_rerank(fused, contents, given, self.config.deep.rerank_top)

    def shown(self, hits: DataFrame, text: str) -> DataFrame:
        """(chunk_id, path, start_line, end_line, language, symbol, score, snippet) of a query's rows, a few hundred at most.
        The snippet shows the query's words, else the first lines."""
        chunks = self.table("chunks").join(F.broadcast(fusion.held(hits.select("chunk_id", "score"))), "chunk_id")
        marked = lexical.snippet(F.col("content"), lexical.parse(lexical.literal_query(text))) if text.strip() else F.lit(None).cast("string")
        return chunks.select("chunk_id", "path", "start_line", "end_line", "language", "symbol", "score", F.coalesce(marked, content_snippet(F.col("content"))).alias("snippet")).orderBy(F.desc("score"), "chunk_id")

    def _roots(self, text: str, symbols: DataFrame) -> DataFrame:
        settings, config = self.config.trace, self.config.query
        wide = max(20, 5 * settings.candidate_roots)
        config = replace(config, limit=max(1, settings.candidate_roots), bm25_limit=wide, vec_limit=wide)
        hits = fusion.held(fusion.hybrid(self.table("chunks"), self.similarities(text), text, config, index=self.lexical()))
        hits = hits.join(self.table("chunks").join(F.broadcast(hits.select("chunk_id")), "chunk_id", "left_semi").select("chunk_id", "path", "start_line"), "chunk_id")
        roots = graph.roots(hits, symbols, settings.candidate_roots)
        return graph.fallback_roots(symbols, text, settings.candidate_roots) if roots.isEmpty() else roots

    def stage(self, text: str, deep: bool = False) -> DataFrame:
        """(root, score, depth, root_rank, steps) of one stage: the paths it shows.

        Levels of the search are kept for the index's generation, by query, beam and weights: a stage goes on from what an
        earlier one of the same beam has reached. What is kept through test files is not used.
        """
        settings, symbols = self.config.trace, self.table("symbols")
        hops, beam = (settings.hops_deep, settings.beam_deep) if deep else (settings.hops_fast, settings.beam_fast)
        generation = self.state()["generation"]
        key = cache.key_of("trace", generation=generation, query=text, beam=beam, roots=settings.candidate_roots, weights=self.config.weights)
        search = trace.BeamSearch(self._roots(text, symbols), symbols, self.table("edges"), graph.query_terms(text), beam, self.config.weights, folder=f"{self.folder}/trace/{generation}/{key}")
        return trace.diverse(search.to(hops).filter(~trace.has_test_paths(F.col("steps"))), settings.limit)

    def trace(self, text: str, deep: bool = False) -> tuple[DataFrame, DataFrame]:
        """(paths, citations): the fast stage, and with `deep` both merged by their endpoints."""
        chosen = self.stage(text)
        if deep:
            chosen = trace.best(trace.merged(chosen, self.stage(text, deep=True)), self.config.trace.limit)
        return chosen, trace.citations(chosen, self.table("symbols"))

    def told(self, text: str, deep: bool = False, write=None) -> trace.Told:
        """A summary of a trace, kept for the index's generation. One that a writer made is used again by all; one of the rule
        only where no writer is asked for."""
        key, held = cache.key_of("told", query=text, deep=deep, limits=self.config.trace), self.cached()
        kept = held.get(key)
        kept = trace.Told(*json.loads(kept)) if kept else None
        if kept is not None and (write is None or kept.source == "written"):
            return kept
        paths, cited = self.trace(text, deep)
        rows = [r.asDict(recursive=True) for r in paths.orderBy(F.desc("score"), "root").collect()]  # the few that are shown
        told = trace.told(text, rows, [(r.path, r.line) for r in cited.orderBy("place").collect()], write)
        self._cache(held.put_one(key, json.dumps([told.text, told.source, told.error]), lasting=False))
        return told

    def guide(self, text: str, files: int = 8) -> DataFrame:
        """The files to read first: the best hit of each."""
        return analytics.guide(self.query(text).select("chunk_id", "path", "score"), files)

    def directory(self, text: str, now: int | None = None) -> str | None:
        """The folder that a query points to, by its hits and by how often and how lately it was chosen. The choice counts."""
        now = int(time.time()) if now is None else now
        best = analytics.directory_vote(self.query(text).select("chunk_id", "path", "score"), self.table("frecency"), F.lit(now)).first()
        if best is None:
            return None
        state, garbage = self._begun()
        seen = self.segmented("frecency", state)
        mine = F.col("path") == best.directory
        row = analytics.record_accesses(seen.read().filter(mine), self.spark.createDataFrame([(best.directory, now)], "path string, at long"))
        self._keep(state, "frecency", seen.appended(row, row.select("path")))
        self._save(state)
        remove(self.spark, *garbage)
        return best.directory

    def get(self, target: str) -> DataFrame:
        """A chunk by `path:line`, by path (its first chunk) or by its id."""
        chunks = self.table("chunks")
        path, _, line = target.rpartition(":")
        if path and line.isdigit():
            return lexical.covering_line(chunks, self.spark.createDataFrame([(path, int(line))], "path string, line long"))
        if "/" in target or "." in target:
            first = lexical.first_chunk(chunks.filter(F.col("path") == target))
            return chunks.join(first.select("chunk_id"), "chunk_id", "left_semi")
        return lexical.get_chunk(chunks, target)

    def check(self) -> dict:
        """Row counts of all tables and the state of the index."""
        state = self.state()
        return {"generation": state["generation"], **{name: self.table(name).count() for name in SCHEMAS}}
