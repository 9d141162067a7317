"""BM25 search with phrases, prefixes, boolean algebra and NEAR.

A chunk table has the columns chunk_id, path, language, content (and symbol, start_line, end_line, kind where it is an
index). `Index` keeps its postings with positions, sorted by term, and a row of statistics: a search reads the row groups of
its own terms only, gathers the terms of a chunk, and takes phrases, prefixes and NEAR from positions. Without an index each
phrase's count in a row is an expression over the row's tokens, and corpus statistics are one aggregate of one row. Both
give the same rows; the best come from a top-k.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, path_prefix
from ..functions.text import fold_words, folded, let, match_snippet, phrase_starts, tokens
from ..session import remove
from .intervals import narrowest
from .segments import BROADCAST_KEYS, Segment, SegmentedTable, joined, ordered, written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
NEAR_DEFAULT = 10
#: Postings of a term in tier 0, about, and steps of impact by which they are dealt.
TIER, IMPACT_STEPS = 1024, 64
PAGE_ROWS = 1024
#: Postings of a search's words from which it goes by tiers.
WORTH = 1 << 18
#: Ids that are looked up by literals.
LOOKED_UP = 4096
TERMS = "term string, tier int, n long, most int, thinnest double"


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False


@dataclass
class Node:
    """`op`: phrase, and, or, not, near."""

    op: str
    parts: list = field(default_factory=list)
    phrase: Phrase | None = None
    distance: int = NEAR_DEFAULT


def literal_query(text: str) -> str:
    """Every word quoted, all of them required."""
    return " AND ".join('"' + w.replace('"', '""') + '"' for w in text.split())


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<sign>[(),*^+:])|(?P<word>[^\s"(),*^+:]+))')


class QueryError(ValueError):
    """The text is no query of the language."""


class _Parser:
    """or := and (OR and)*; and := not ([AND] not)*; not := unit (NOT unit)*; unit := ( or ) | NEAR( ... ) | phrase."""

    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise QueryError(f"unreadable at {at}: {text[at : at + 20]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self, value: str | None = None) -> str:
        kind, got = self.peek()
        if kind == "end" or (value is not None and got != value):
            raise QueryError(f"expected {value or 'a term'}, found {got or 'the end'}")
        self.at += 1
        return got

    def whole(self) -> Node:
        node = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return node

    def _chain(self, below, op: str, words: tuple[str, ...], implicit: bool = False) -> Node:
        parts = [below()]
        while True:
            kind, value = self.peek()
            if kind == "word" and value in words:
                self.take()
            elif not (implicit and (kind in ("string", "word") and value not in ("OR", "AND", "NOT") or value in ("(", "^"))):
                break
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(op, parts)

    def either(self) -> Node:
        return self._chain(self.every, "or", ("OR",))

    def every(self) -> Node:
        return self._chain(self.without, "and", ("AND",), implicit=True)

    def without(self) -> Node:
        return self._chain(self.unit, "not", ("NOT",))

    def unit(self) -> Node:
        kind, value = self.peek()
        if value == "(" and kind == "sign":
            self.take("(")
            node = self.either()
            self.take(")")
            return node
        if kind == "word" and self.peek(1)[1] == ":":
            if value != "content":
                raise QueryError(f"no such column: {value}")
            self.take()
            self.take(":")
            return self.unit()
        if value == "NEAR" and self.peek(1)[1] == "(":
            self.take()
            self.take("(")
            phrases, distance = [], NEAR_DEFAULT
            while self.peek()[1] not in (")", ","):
                phrases.append(self.phrase())
            if self.peek()[1] == ",":
                self.take()
                distance = int(self.take())
            self.take(")")
            return Node("near", [Node("phrase", phrase=p) for p in phrases], distance=distance)
        return Node("phrase", phrase=self.phrase())

    def phrase(self) -> Phrase:
        first = self.peek()[1] == "^" and bool(self.take())
        words: list[str] = []
        while True:
            kind, value = self.peek()
            if kind not in ("string", "word") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"expected a term, found {value or 'the end'}")
            self.take()
            words += fold_words(value[1:-1].replace('""', '"') if kind == "string" else value)
            if self.peek()[1] != "+":
                break
            self.take()
        prefix = self.peek() == ("sign", "*") and bool(self.take())
        return Phrase(words, prefix, first)


def parse(text: str) -> Node:
    return _Parser(text).whole()


def phrases_of(node: Node) -> list[Phrase]:
    return [node.phrase] if node.op == "phrase" else [p for part in node.parts for p in phrases_of(part)]


def _matches(node: Node, starts: dict[int, Column]) -> Column:
    if node.op == "phrase":
        return F.size(starts[id(node.phrase)]) > 0
    if node.op == "near":
        return F.size(_clumps(node, starts)) > 0
    parts = [_matches(p, starts) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if node.op == "and" else out | p if node.op == "or" else out & ~p
    return out


def _may_match(node: Node, text: Column) -> Column:
    """Whether the folded text holds, at any place, the words that the query needs. It is wider than the query, never narrower."""
    if node.op == "phrase":
        return reduce(lambda x, y: x & y, [text.contains(w) for w in node.phrase.words])
    parts = [_may_match(p, text) for p in (node.parts[:1] if node.op == "not" else node.parts)]
    return reduce((lambda x, y: x | y) if node.op == "or" else (lambda x, y: x & y), parts)


def _within(last: Column, reach: int, p: Column) -> Column:
    return (p <= last) & (p >= last - reach)


def _clumps(node: Node, starts: dict[int, Column]) -> Column:
    """Places of the last phrase of each clump: every phrase starts at most its length plus the distance before it."""
    own = [p.phrase for p in node.parts]
    held = F.struct(*[starts[id(p)].alias(f"p{i}") for i, p in enumerate(own)])

    def clumps(s: Column) -> Column:
        def holds(last: Column) -> Column:
            out = F.lit(True)
            for i, phrase in enumerate(own):
                reach = len(phrase.words) + node.distance
                out = out & F.exists(s[f"p{i}"], partial(_within, last, reach))
            return out

        return F.filter(F.array_distinct(F.concat(*[s[f"p{i}"] for i in range(len(own))])), holds)

    return let(held, clumps)


def bm25(count: Column, length: Column, n: Column, total: Column, average: Column) -> Column:
    idf = F.log((total - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    return idf * count * (K1 + 1) / (count + K1 * (1 - B + B * length / average))


def scored(chunks: DataFrame, node: Node, keep: list[str] | None = None) -> DataFrame:
    """Rows that match, with a `score` from statistics of the whole table."""
    keep = keep or chunks.columns
    found = phrases_of(node)
    if not found or not all(p.words for p in found):
        return chunks.select(*keep).withColumn("score", F.lit(0.0)).filter(F.lit(False))

    def placed(toks: Column) -> Column:
        cells = []
        for i, p in enumerate(found):
            at = phrase_starts(toks, p.words, p.prefix)
            cells.append((F.filter(at, lambda x: x == 0) if p.first else at).alias(f"s{i}"))
        return F.struct(F.size(toks).alias("length"), *cells)

    def counted(c: Column) -> Column:
        own = {id(p): c[f"s{i}"] for i, p in enumerate(found)}
        return F.struct(c["length"].alias("length"), _matches(node, own).alias("hit"), *[F.size(c[f"s{i}"]).alias(f"f{i}") for i in range(len(found))])

    # The tokens of a row are made once, its phrases are searched once, and only counts leave the expression.
    wide_of = lambda rows: rows.select(*keep, let(let(tokens(F.col("content")), placed), counted).alias("_c"))
    wide = wide_of(chunks)
    sums = [F.sum(F.when(F.col(f"_c.f{i}") > 0, 1).otherwise(0)).alias(f"_n{i}") for i in range(len(found))]
    stats = wide.agg(F.count("*").alias("_total"), F.avg("_c.length").alias("_average"), *sums)  # one row
    score = F.lit(0.0)
    for i in range(len(found)):
        score = score + bm25(F.col(f"_c.f{i}"), F.col("_c.length"), F.col(f"_n{i}"), F.col("_total"), F.col("_average"))
    # Statistics take the tokens of every row; of the others only rows that hold the words are cut into tokens again.
    hits = wide_of(chunks.filter(_may_match(node, folded(F.col("content"))))).filter("_c.hit")
    return hits.crossJoin(F.broadcast(stats)).select(*keep, score.alias("score"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Few large input splits are dealt out before costly work on each row; many are left where they are."""
    most = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(most, key) if rows.rdd.getNumPartitions() < most else rows


@dataclass(frozen=True)
class IndexSegment(Segment):
    """`chunks` and `tokens`: what the segment added to their numbers, less what it took away."""

    chunks: int = 0
    tokens: int = 0


@dataclass
class Reading:
    """What a search by tiers has read: postings, all postings of its words, passes."""

    rows: int = 0
    of: int = 0
    passes: int = 0


class Index(SegmentedTable):
    """The inverted index of a chunk table, in segments.

    A segment's postings (term, tier, chunk_id, length, language, hidden, positions) are written in that order, so readers skip
    what is not asked for and a frequent term lies in many files; `hidden` marks test paths. Tiers order a term's postings
    by impact (what the count in a chunk of that length adds to a score): tier 0 has about TIER of the best, each next one
    twice as many. `terms` has a row for each term and tier with its number and bounds, `paths` one for each chunk. Chunks
    that a run takes away are in `gone`; their terms are counted back in `terms` as tier -1.
    """

    kind = IndexSegment

    def __init__(self, spark, folder: str, id_type: str, segments: list[dict] | None = None):
        postings = f"term string, tier int, chunk_id {id_type}, length int, language string, hidden boolean, positions array<int>"
        super().__init__(spark, folder, postings, "chunk_id", segments, ["term", "tier", "chunk_id"])
        self.id_type = id_type
        self.total, self.tokens = (sum(getattr(s, n) for s in self.segments) for n in ("chunks", "tokens"))
        self.average = self.tokens / self.total if self.total else None

    def _with(self, segments: list[IndexSegment]) -> Index:
        return Index(self.spark, self.folder, self.id_type, [asdict(s) for s in segments])

    @classmethod
    def build(cls, chunks: DataFrame, folder: str) -> Index:
        return cls(chunks.sparkSession, folder, dict(chunks.dtypes)["chunk_id"]).updated(chunks)

    @property
    def postings(self) -> DataFrame:
        return joined(self.segments, self.folder, "rows", self.spark, self.schema)

    @property
    def paths(self) -> DataFrame:
        return self.alive(joined(self.segments, self.folder, "paths", self.spark, f"chunk_id {self.id_type}, path string, length int")).select("chunk_id", "path")

    @property
    def terms(self) -> DataFrame:
        return joined(self.segments, self.folder, "terms", self.spark, TERMS)

    def updated(self, fresh: DataFrame, gone: DataFrame | None = None) -> Index:
        """The index after chunks came and went; `gone` holds the rows that go, as they were."""
        name, spark = uuid.uuid4().hex, self.spark
        raw = f"{self.folder}/{name}/raw"
        language = F.col("language") if "language" in fresh.columns else F.lit(None).cast("string")
        dealt = spread(fresh.select("chunk_id", "path", language.alias("language"), "content"), "chunk_id")
        toks = dealt.select("chunk_id", "path", "language", tokens(F.col("content")).alias("t"))
        toks = toks.select("chunk_id", "path", "language", F.size("t").alias("length"), is_test_path(F.col("path")).alias("hidden"), "t")
        each = toks.select("chunk_id", "length", "language", "hidden", "path", "t")
        each = each.mapInArrow(_by_term, f"chunk_id {self.id_type}, length int, language string, hidden boolean, term string, positions array<int>, path string, tf int")
        sums, none = Observation(), F.col("term").isNull()
        each.observe(sums, F.count(F.when(none, 1)).alias("chunks"), F.coalesce(F.sum(F.when(none, F.col("length"))), F.lit(0)).alias("tokens"), F.count("term").alias("postings")).write.parquet(raw)
        came, raw_rows = sums.get, spark.read.parquet(raw)
        ordered(raw_rows.filter("term is null").select("chunk_id", "path", "length"), ["chunk_id"], came["chunks"]).write.parquet(f"{self.folder}/{name}/paths")
        keys, minus, lost = None, None, (0, 0)
        if gone is not None and self.segments:
            old = gone.select("chunk_id", tokens(F.col("content")).alias("t"))
            lost = old.agg(F.count("*"), F.coalesce(F.sum(F.size("t")), F.lit(0))).first()
            minus = old.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg((-F.count("*")).alias("n"))
            keys = old.select("chunk_id")
        segment = self._segment(name, raw_rows.filter("term is not null").drop("path"), keys, minus, 1 + max((s.seq for s in self.segments), default=0), came["chunks"] - lost[0], came["tokens"] - lost[1], came["postings"])
        remove(spark, raw)
        return self._with([*self.segments, segment])

    def _segment(self, name: str, rows: DataFrame, gone: DataFrame | None, minus: DataFrame | None, seq: int, chunks: int, tokens_: int, n: int) -> IndexSegment:
        """Write postings by impact, the bounds of their tiers, and the keys that go."""
        spark, folder = self.spark, f"{self.folder}/{name}"
        mean = (self.tokens + tokens_) / max(1, self.total + chunks) or 1.0
        tf = F.col("tf") if "tf" in rows.columns else F.size("positions")  # a number is read without the places
        step = F.floor(IMPACT_STEPS * tf / (tf + K1 * (1 - B + B * F.col("length") / mean))).cast("int")
        # At most IMPACT_STEPS rows for each term of more than TIER postings; all others stay in tier 0.
        counted = rows.groupBy("term", step.alias("_step")).agg(F.count("*").alias("n"))
        by_term = Window.partitionBy("term")
        above = F.sum("n").over(by_term.orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1))
        tiers = counted.select("term", "_step", F.coalesce(above, F.lit(0)).alias("above"), F.sum("n").over(by_term).alias("all")).filter(F.col("all") > TIER)
        tiers = tiers.select("term", "_step", F.floor(F.log2(1 + F.col("above") / TIER)).cast("int").alias("tier")).filter("tier > 0")
        # No term has over TIER postings if all together don't.
        placed = rows.withColumn("tier", F.lit(0))
        if n > TIER:
            # One row for each frequent term; postings are not dealt by term for them unless these are many.
            frequent = tiers.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("_step", "tier"))).alias("_tiers"))
            few = written(frequent, f"{folder}/tiers") <= BROADCAST_KEYS
            frequent = spark.read.schema("term string, _tiers map<int, int>").parquet(f"{folder}/tiers")
            placed = rows.join(F.broadcast(frequent) if few else frequent, "term", "left").withColumn("tier", F.coalesce(F.try_element_at("_tiers", step), F.lit(0)))
        kept = written(ordered(placed.select(*self.columns), self.sort, n), f"{folder}/rows", **{"parquet.page.row.count.limit": PAGE_ROWS})
        remove(spark, f"{folder}/tiers")
        held = spark.read.schema(self.schema).parquet(f"{folder}/rows")
        bounds = held.groupBy("term", "tier").agg(F.count("*").alias("n"), F.max(F.size("positions")).alias("most"), F.min(F.col("length") / F.size("positions")).alias("thinnest"))
        if minus is not None:
            bounds = bounds.unionByName(minus.filter("n <> 0").select("term", F.lit(-1).alias("tier"), "n", F.lit(0).alias("most"), F.lit(0.0).alias("thinnest")))
        ordered(bounds, ["term", "tier"], n).write.parquet(f"{folder}/terms")
        return IndexSegment(name, seq, kept, self._write_gone(name, gone), chunks, tokens_)

    def compacted(self, full: bool = False) -> Index:
        """The same index after merges that are due. What a run's segments counted for a term stays the same in sum."""
        table = self
        while run := (table.segments if full and len(table.segments) > 1 else [] if full else table._due()):
            older = [s for s in table.segments if s not in run]
            name, n = uuid.uuid4().hex, sum(s.rows for s in run)
            part = lambda what, schema: joined(run, table.folder, what, table.spark, schema)  # noqa: E731, B023
            table.alive(part("paths", f"chunk_id {table.id_type}, path string, length int"), run).drop("_seq").transform(lambda df: ordered(df, ["chunk_id"], n)).write.parquet(f"{table.folder}/{name}/paths")  # noqa: B023
            rows = table.alive(part("rows", table.schema), run).drop("_seq", "tier")
            minus = None
            if older:
                was = part("terms", TERMS).select("term", (-F.col("n")).alias("n"))
                now = rows.groupBy("term").agg(F.count("*").alias("n"))
                # terms: alive rows + minus = what the run's segments said.
                minus = was.unionByName(now).groupBy("term").agg((-F.sum("n")).alias("n"))
            merged = table._segment(name, rows, table.gone(run) if older else None, minus, run[-1].seq, sum(s.chunks for s in run), sum(s.tokens for s in run), n)
            table = table._with([*older, merged])
        return table

    def scored(self, node: Node) -> DataFrame:
        """(chunk_id, language, hidden, score) of the chunks that match."""
        found = phrases_of(node)
        exact = sorted({w for p in found for i, w in enumerate(p.words) if not (p.prefix and i == len(p.words) - 1)})
        begun = sorted({p.words[-1] for p in found if p.prefix})
        wanted = reduce(lambda x, y: x | y, [F.col("term").startswith(w) for w in begun], F.col("term").isin(exact))
        terms = F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("terms")
        held = self.alive(self.postings.filter(wanted)).groupBy("chunk_id").agg(F.first("length").alias("length"), F.first("language").alias("language"), F.first("hidden").alias("hidden"), terms)
        none = F.array().cast("array<int>")

        def starts(phrase: Phrase) -> Column:
            at = []
            for k, word in enumerate(phrase.words):
                if phrase.prefix and k == len(phrase.words) - 1:
                    places = F.flatten(F.map_values(F.map_filter("terms", partial(_begins, word))))
                else:
                    places = F.coalesce(F.try_element_at("terms", F.lit(word)), none)
                at.append(F.transform(places, partial(_earlier, k)) if k else places)
            both = reduce(F.array_intersect, at)
            return F.filter(both, lambda x: x == 0) if phrase.first else both

        cells = F.struct(*[starts(p).alias(f"s{i}") for i, p in enumerate(found)])

        def counted(c: Column) -> Column:
            own = {id(p): c[f"s{i}"] for i, p in enumerate(found)}
            return F.struct(_matches(node, own).alias("hit"), *[F.size(c[f"s{i}"]).alias(f"f{i}") for i in range(len(found))])

        wide = held.select("chunk_id", "length", "language", "hidden", let(cells, counted).alias("_c"))
        sums = [F.sum(F.when(F.col(f"_c.f{i}") > 0, 1).otherwise(0)).alias(f"_n{i}") for i in range(len(found))]
        stats = wide.agg(*sums)  # one row
        score = F.lit(0.0)
        for i in range(len(found)):
            score = score + bm25(F.col(f"_c.f{i}"), F.col("length"), F.col(f"_n{i}"), F.lit(self.total), F.lit(self.average))
        return wide.filter("_c.hit").crossJoin(F.broadcast(stats)).select("chunk_id", "language", "hidden", score.alias("score"))

    def best_of_any(self, words: list[str], limit: int, digits: int | None = None, languages: list[str] | None = None, worth: int | None = None, reading: Reading | None = None) -> DataFrame | None:
        """(chunk_id, score): the best chunks for words of which any may occur, read by tiers of impact; None where a plain
        read is as good.

        A pass reads the open tiers of each word. What it has seen of a chunk is at most its score, so the k-th best of these
        is a bound that every row of the answer reaches. It ends when all that unread tiers could add to an unseen chunk stays
        below it. Chunks that might still reach it with words from unread tiers are then looked up by their ids alone.
        """
        kinds = sorted(set(words))
        rows = self.terms.filter(F.col("term").isin(kinds)).groupBy("term", "_seq", "tier").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("thinnest").alias("thinnest")).collect()  # segments x words x tiers
        count = {w: sum(r.n for r in rows if r.term == w) for w in kinds}
        size = {(w, t): sum(r.n for r in rows if r.term == w and r.tier == t) for w in kinds for t in {r.tier for r in rows if r.term == w and r.tier >= 0}}
        if limit <= 0 or sum(size.values()) < (WORTH if worth is None else worth):
            return None
        margin = 10.0**-digits if digits is not None else 1e-9
        weight = {}
        for w in kinds:
            idf = math.log((self.total - count[w] + 0.5) / (count[w] + 0.5))
            weight[w] = words.count(w) * (idf if idf > 0 else LEAST_IDF)
        # A score falls with 1 / count and with length / count, so the best of both bound a tier, whatever the mean length is.
        ahead = lambda w, t: max((weight[w] * (K1 + 1) / (1 + K1 * (1 - B) / r.most + K1 * B * r.thinnest / self.average) for r in rows if r.term == w and r.tier > t), default=0.0) * (1 + 1e-9)
        level, passes = dict.fromkeys(kinds, 0), 0
        while True:
            passes += 1
            seen = self._seen(words, reduce(lambda x, y: x | y, [(F.col("term") == w) & (F.col("tier") <= level[w]) for w in kinds]), count, languages)
            least = seen.orderBy(F.desc("score")).limit(limit).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
            open_ = {w: bound for w in kinds if (bound := ahead(w, level[w])) > 0}
            least = least.least if least.n >= limit else None
            if not open_ or least is not None and sum(open_.values()) < least - margin:
                break
            for w, bound in open_.items():
                if bound >= sum(open_.values()) / len(open_):
                    level[w] += 1
        rest = {w: sum(n for (x, t), n in size.items() if x == w and t > level[w]) for w in kinds}
        if reading is not None:
            reading.passes, reading.of, reading.rows = passes, sum(size.values()), sum(size.values()) - sum(rest.values())
        if open_:
            hoped = F.col("score")
            for w, bound in open_.items():
                hoped = hoped + F.when(F.col(f"f{kinds.index(w)}") == 0, F.lit(bound)).otherwise(0.0)
            likely = seen.filter(hoped >= least - margin)
            unsure = likely.filter(reduce(lambda x, y: x | y, [F.col(f"f{kinds.index(w)}") == 0 for w in open_]))
            if len(open_) == 1 and len(kinds) == 1 or unsure.isEmpty():
                seen = likely
            else:
                unread = reduce(lambda x, y: x | y, [(F.col("term") == w) & (F.col("tier") > level[w]) for w in open_])
                read = reduce(lambda x, y: x | y, [(F.col("term") == w) & (F.col("tier") <= level[w]) for w in kinds])
                ids = likely.select("chunk_id")
                some = [r.chunk_id for r in ids.orderBy("chunk_id").limit(LOOKED_UP + 1).collect()]
                if len(some) <= LOOKED_UP:
                    unread = unread & among("chunk_id", some)
                if reading is not None:
                    reading.rows += self.postings.filter(unread).count()
                seen = self._seen(words, read | unread, count, languages, ids)
        return seen.select("chunk_id", "score")

    def _seen(self, words: list[str], which: Column, count: dict[str, int], languages: list[str] | None, ids: DataFrame | None = None) -> DataFrame:
        """(chunk_id, score, f0 ..) from some postings: counts by distinct word, and the score of what they show."""
        kinds = sorted(set(words))
        rows = self.alive(self.postings.filter(which)).filter(~F.col("hidden"))
        rows = rows.filter(F.col("language").isin(languages)) if languages else rows
        rows = rows.join(ids, "chunk_id", "left_semi") if ids is not None else rows
        tf = [F.max(F.when(F.col("term") == w, F.size("positions")).otherwise(0)).alias(f"f{i}") for i, w in enumerate(kinds)]
        held = rows.groupBy("chunk_id").agg(F.first("length").alias("length"), *tf)
        score = F.lit(0.0)
        for w in words:
            score = score + bm25(F.col(f"f{kinds.index(w)}"), F.col("length"), F.lit(count[w]), F.lit(self.total), F.lit(self.average))
        return held.select("chunk_id", score.alias("score"), *[f"f{i}" for i in range(len(kinds))])


_WORD = re.compile(r"[^\W_]+")
FIRST_SEEN, SEEN_AGAIN, AT_START, AT_SENTENCE = 1000, 1, 120, 100


def snippet_of(text: str, phrases: list[Phrase], size: int = 10, marks: tuple[str, str, str] = ("[", "]", "…")) -> str | None:
    """The best window of `size` tokens, its text as it stands, phrase hits in brackets (overlapping ones in one pair), cut
    ends marked; None without a hit.

    Every hit offers a window around the hits that follow within `size` tokens, and one from the start of its sentence. Of a
    phrase the first hit in a window counts most. The best score wins, of equals the first offered.
    """
    open_, close, more = marks
    found = [*_WORD.finditer(text)]
    words = [(fold_words(m[0]) or [""])[0] for m in found]
    n, hits = len(words), []
    for at in range(n):
        for i, p in enumerate(phrases):
            k = len(p.words)
            if k and at + k <= n and words[at : at + k - 1] == p.words[:-1] and (words[at + k - 1].startswith(p.words[-1]) if p.prefix else words[at + k - 1] == p.words[-1]) and not (p.first and at):
                hits.append((at, i, at + k))
    if not hits:
        return None
    starts = [0]
    for at in range(1, n):
        gap = text[found[at - 1].end() : found[at].start()]
        rest = gap.rstrip(" \t\n\r")
        if rest != gap and rest[-1:] in (".", ":"):
            starts.append(at)
    begins = [h[0] for h in hits]

    def scored(at: int) -> tuple[int, int]:
        inside = hits[bisect_left(begins, at) : bisect_left(begins, at + size)]
        seen = {h[1] for h in inside}
        first, last = inside[0][0], inside[-1][2]
        place = first - int((size - (last - first)) / 2)  # towards zero
        return len(seen) * FIRST_SEEN + (len(inside) - len(seen)) * SEEN_AGAIN, max(0, min(place, n - size))

    best, start = 0, 0
    for at in dict.fromkeys(begins):
        score, place = scored(at)
        if score > best:
            best, start = score, place
        sentence = starts[bisect_right(starts, at) - 1]
        if n > size and sentence < at:
            inside = hits[bisect_left(begins, sentence) : bisect_left(begins, sentence + size)]
            seen = {h[1] for h in inside}
            score = len(seen) * FIRST_SEEN + (len(inside) - len(seen)) * SEEN_AGAIN + (AT_SENTENCE if sentence else AT_START)
            if score > best:
                best, start = score, sentence
    end = min(start + size, n)
    joined_hits: list[list[int]] = []
    for a, _, b in hits:
        if joined_hits and a < joined_hits[-1][1]:
            joined_hits[-1][1] = max(joined_hits[-1][1], b)
        else:
            joined_hits.append([a, b])
    out = [more if start else text[: found[0].start()]]
    for at in range(start, end):
        mine = next((h for h in joined_hits if h[0] <= at < h[1]), None)
        out.append(open_ if mine and at == max(mine[0], start) else "")
        out.append(found[at][0])
        out.append(close if mine and at == min(mine[1], end) - 1 else "")
        if at + 1 < end:
            out.append(text[found[at].end() : found[at + 1].start()])
    out.append(more if end < n else text[found[n - 1].end() :])
    return "".join(out)


def snippet(content: Column, node: Node) -> Column:
    """`snippet_of` each text, for the few rows of a result."""
    wanted = phrases_of(node)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet_of(t, wanted) if t else None)

    return cut(content)


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each chunk and term, with its places, and one without a term for each chunk, with its path. Tokens are
    grouped before anything is shuffled."""
    names = ["chunk_id", "length", "language", "hidden", "term", "positions", "path", "tf"]
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.int32())), batch.column(4), pa.nulls(n, pa.int32())], names=names)
        lists = batch.column(5)
        count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        total = int(count.sum())
        if not total:
            continue
        coded = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(lists)), count)
        key = row * len(coded.dictionary) + np.asarray(coded.indices)
        order = np.argsort(key, kind="stable")
        at = (np.arange(total) - np.repeat(np.cumsum(count) - count, count))[order].astype(np.int32)
        first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        term = coded.dictionary.take(pa.array(np.asarray(coded.indices)[order[first]]))
        places = pa.ListArray.from_arrays(pa.array(np.r_[first, total].astype(np.int32)), pa.array(at))
        held = [batch.column(i).take(pa.array(row[order[first]])) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*held, term, places, pa.nulls(len(first), pa.string()), pa.array(np.diff(np.r_[first, total]).astype(np.int32))], names=names)


def among(column: str, values: list, most: int = 16) -> Column:
    """`column` is one of the sorted `values`, said so that readers can skip pages: at most `most` ranges around them."""
    if not values:
        return F.lit(False)
    step = -(-len(values) // most)
    parts = [values[i : i + step] for i in range(0, len(values), step)]
    return reduce(lambda x, y: x | y, [F.col(column).between(p[0], p[-1]) for p in parts]) & F.col(column).isin(values)


def _any_words(node: Node) -> list[str] | None:
    """The words of a query that asks for any of some plain words."""
    parts = node.parts if node.op == "or" else [node]
    if all(p.op == "phrase" and len(p.phrase.words) == 1 and not p.phrase.prefix and not p.phrase.first for p in parts):
        return [p.phrase.words[0] for p in parts]
    return None


def _earlier(k: int, place: Column) -> Column:
    return place - k


def _begins(word: str, term: Column, places: Column) -> Column:
    return term.startswith(word)


def search(chunks: DataFrame, query: str, limit: int = 50, literal: bool = True, languages: list[str] | None = None, prefixes: list[str] | None = None, snippets: bool | str = False, digits: int | None = None, index: Index | None = None) -> DataFrame:
    """The best chunks: (chunk_id, path, score), with a snippet if wanted (`phrases`: that of `snippet_of`). Filters don't touch the statistics; test paths are
    hidden. `digits` rounds scores before ranking, for results that must be the same on any engine. `index` is that of
    `chunks`."""
    text = literal_query(query) if literal else query
    none = chunks.select("chunk_id", "path", F.lit(0.0).alias("score")).filter(F.lit(False))
    if not text.strip():
        return none.withColumn("snippet", F.lit("")) if snippets else none
    node = parse(text)
    phrases = phrases_of(node)
    whole = ["content"] if snippets else []
    if index is not None:
        if not phrases or not all(p.words for p in phrases):
            return none.withColumn("snippet", F.lit("")) if snippets else none
        any_of = None if prefixes else _any_words(node)
        hits = index.best_of_any(any_of, limit, digits, languages) if any_of else None
        if hits is None:
            hits = index.scored(node).filter(~F.col("hidden"))
            hits = hits.filter(F.col("language").isin(languages)) if languages else hits
    else:
        hits = scored(chunks, node, ["chunk_id", "path"] + (["language"] if languages else []) + whole).filter(~is_test_path(F.col("path")))
    if languages and index is None:
        hits = hits.filter(F.col("language").isin(languages))
    if prefixes:
        hits = hits.join(index.paths, "chunk_id") if index is not None else hits
        hits = hits.filter(path_prefix(F.col("path"), prefixes))
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    best = hits.orderBy(F.desc("score"), "chunk_id").limit(max(limit, 0))
    if index is not None:
        # At most `limit` rows; what the index doesn't hold of them is looked up by their ids.
        kept = best.select("chunk_id", "score")
        kept = kept.sparkSession.createDataFrame(kept.collect(), kept.schema)
        ids = sorted(r.chunk_id for r in kept.collect())
        best = (chunks.select("chunk_id", "path", "content") if snippets else index.paths).filter(among("chunk_id", ids)).join(F.broadcast(kept), "chunk_id")
    words = [w for p in phrases for w in p.words]
    return best.select("chunk_id", "path", "score", *([(snippet(F.col("content"), node) if snippets == "phrases" else match_snippet(F.col("content"), words)).alias("snippet")] if snippets else []))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, length): the inverted index without positions."""
    toks = spread(chunks.select("chunk_id", "content"), "chunk_id").select("chunk_id", tokens(F.col("content")).alias("t"))
    return toks.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def search_batch(chunks: DataFrame, queries: DataFrame, limit: int, digits: int = 6, index: Index | None = None) -> DataFrame:
    """The best chunks for each of many queries (query_id, text), whose distinct words are alternatives: one join by term."""
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    if index is not None:
        total = chunks.sparkSession.createDataFrame([(index.total, index.average)], "total long, average double")
        held = index.alive(index.postings).select("term", "chunk_id", F.size("positions").alias("tf"), "length")
    else:
        held, total = postings(chunks), chunks.agg(F.count("*").alias("total"), F.avg(F.size(tokens(F.col("content")))).alias("average"))
    # A chunk's postings go to one task: sums by query and chunk are made and cut to the best there, and only these move on.
    wanted = held.join(words.select("term").distinct(), "term", "left_semi").repartition("chunk_id")
    n = wanted.groupBy("term").agg(F.count("*").alias("n"))
    small = F.broadcast if words.count() <= BROADCAST_KEYS else lambda rows: rows
    each = wanted.join(small(n), "term").join(small(words), "term").crossJoin(F.broadcast(total))
    summed = each.groupBy("query_id", "chunk_id").agg(F.round(F.sum(bm25(F.col("tf"), F.col("length"), F.col("n"), F.col("total"), F.col("average"))), digits).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return summed.withColumn("rank", rank).filter(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("long"))


def get_chunk(chunks: DataFrame, chunk_id) -> DataFrame:
    return chunks.filter((F.col("chunk_id") == F.lit(chunk_id)) & ~is_test_path(F.col("path"))).limit(1)


def covering_line(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """For each (path, line) the narrowest chunk around it."""
    return narrowest(chunks, places, ["path"], "start_line", "end_line", "line", ["start_line", "chunk_id"])


def first_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.min_by("chunk_id", F.struct("start_line", "chunk_id")).alias("chunk_id"))
