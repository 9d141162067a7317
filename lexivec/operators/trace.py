"""Beam search over the edge graph, selection of diverse paths, and what is shown of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EdgeWeights
from ..functions.paths import is_test_path
from ..session import exists

# Shares of a query word in a target's name and in the evidence, their limit, and the cost of a step.
TARGET_BONUS, EVIDENCE_BONUS, MOST_BONUS, STEP_COST = 0.08, 0.04, 0.25, 0.06
STEP = "struct<edge_kind:string,from_symbol:string,to_symbol:string,target_name:string,path:string,line:bigint,confidence:double,evidence:string>"


def edge_weight(kind: Column, weights: EdgeWeights = EdgeWeights()) -> Column:
    out = F.lit(weights.other)
    for name, w in weights.by_kind().items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out


def bonus(target: Column, evidence: Column, terms: list[str]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + F.when(F.lower(target).contains(t), TARGET_BONUS).otherwise(0.0) + F.when(F.lower(evidence).contains(t), EVIDENCE_BONUS).otherwise(0.0)
    return F.least(F.lit(MOST_BONUS), out)


#: States of a stored level up to which its edges are picked by a broadcast of them.
FEW_STATES = 10_000
EMITTED = f"root string, score double, depth long, last string, state_ord int, edge_ord int, steps array<{STEP}>"
STATE = f"root string, current string, from_symbol string, score double, state_ord int, visited array<string>, steps array<{STEP}>"


class BeamSearch:
    """A beam search that can go on: (root, score, depth, last, steps) of every extension of every state.

    All roots go on in lockstep. A state follows its first `beam` edges, and a root keeps its best `beam` new states at each
    depth, so a level holds at most roots * beam states. With a `folder` each depth's extensions and states are written
    there; a later search in that folder goes on after the last depth instead of starting anew, and a lost executor costs
    one depth. Without one the levels stay one plan, cut by checkpoints where the session has a folder for them.
    """

    def __init__(self, roots: DataFrame, symbols: DataFrame, edges: DataFrame, terms: list[str], beam: int, weights: EdgeWeights = EdgeWeights(), digits: int | None = None, folder: str | None = None, checkpoint_every: int = 4):
        self.names = symbols.select(F.col("symbol_id").alias("dst_symbol_id"), F.col("short_name").alias("to_symbol"))
        self.edges, self.terms, self.weights = edges, terms, weights
        self.beam, self.digits, self.folder, self.checkpoint_every = beam, digits, folder, checkpoint_every
        self.spark, self.depth, self.emitted = roots.sparkSession, 0, []
        state = roots.select(F.col("symbol_id").alias("root"), F.col("symbol_id").alias("current"), "score").join(symbols.select(F.col("symbol_id").alias("current"), F.col("short_name").alias("from_symbol")), "current", "left")
        self.state = state.select("root", "current", "from_symbol", "score", F.lit(0).alias("state_ord"), F.array("root").alias("visited"), F.array().cast(f"array<{STEP}>").alias("steps"))
        while folder and exists(self.spark, f"{folder}/{self.depth + 1}/state/_SUCCESS"):
            self.depth += 1
            self._take(self.depth)
        if folder and not self.depth:
            self.state.write.mode("overwrite").parquet(f"{folder}/0/state")
            self.state = self.spark.read.schema(STATE).parquet(f"{folder}/0/state")

    def _ahead(self) -> DataFrame:
        """The first edges of symbols with the gain of each. A stored level of few states ranks and names its own edges alone."""
        few = lambda rows: F.broadcast(rows.distinct())
        edges, names = self.edges, self.names
        narrow = bool(self.folder) and self.state.count() <= FEW_STATES
        if narrow:
            edges = edges.join(few(self.state.select(F.col("current").alias("src_symbol_id"))), "src_symbol_id", "left_semi")
        place = F.row_number().over(Window.partitionBy("src_symbol_id").orderBy(F.desc("confidence"), "line", "edge_id"))
        first = edges.withColumn("edge_ord", place).filter(F.col("edge_ord") <= self.beam)
        if narrow:
            names = names.join(few(first.select("dst_symbol_id")), "dst_symbol_id", "left_semi")
        ahead = first.join(names, "dst_symbol_id", "left")
        ahead = ahead.select(F.col("src_symbol_id").alias("current"), "edge_ord", "edge_id", "dst_symbol_id", "to_symbol", F.coalesce("to_symbol", "dst_name").alias("target_name"), "edge_kind", "path", "line", "confidence", "evidence")
        gain = edge_weight(F.col("edge_kind"), self.weights) * F.col("confidence") + bonus(F.coalesce("target_name", F.lit("")), F.coalesce("evidence", F.lit("")), self.terms)
        return ahead.withColumn("gain", gain)

    def _take(self, depth: int) -> None:
        read = lambda part, schema: self.spark.read.schema(schema).parquet(f"{self.folder}/{depth}/{part}")
        self.emitted.append(read("emitted", EMITTED))
        self.state = read("state", STATE)

    def _extended(self) -> tuple[DataFrame, DataFrame]:
        depth = self.depth
        step = F.struct("edge_kind", "from_symbol", "to_symbol", "target_name", "path", F.col("line").cast("long").alias("line"), "confidence", "evidence")
        score = F.col("score") + F.col("gain") - STEP_COST * depth
        new = self.state.join(self._ahead(), "current").select("root", "dst_symbol_id", "to_symbol", "state_ord", "edge_ord", "visited", (F.round(score, self.digits) if self.digits is not None else score).alias("score"), F.concat("steps", F.array(step)).cast(f"array<{STEP}>").alias("steps"))
        emitted = new.select("root", "score", F.lit(depth).cast("long").alias("depth"), F.col("dst_symbol_id").alias("last"), "state_ord", "edge_ord", "steps")
        order = Window.partitionBy("root").orderBy(F.desc("score"), "state_ord", "edge_ord")
        going = new.filter(F.col("dst_symbol_id").isNotNull() & ~F.array_contains("visited", F.col("dst_symbol_id")))
        state = going.withColumn("next_ord", F.row_number().over(order)).filter(F.col("next_ord") <= self.beam)
        return emitted, state.select("root", F.col("dst_symbol_id").alias("current"), F.col("to_symbol").alias("from_symbol"), "score", F.col("next_ord").alias("state_ord"), F.concat("visited", F.array("dst_symbol_id")).alias("visited"), "steps")

    def to(self, hops: int) -> DataFrame:
        """All extensions up to `hops` steps, one at least."""
        hops = max(1, hops)
        while self.depth < hops:
            self.depth += 1
            emitted, state = self._extended()
            if self.folder:
                emitted.write.mode("overwrite").parquet(f"{self.folder}/{self.depth}/emitted")
                state.write.mode("overwrite").parquet(f"{self.folder}/{self.depth}/state")  # last: it tells that the depth is whole
                self._take(self.depth)
            else:
                self.emitted.append(emitted)
                cut = self.depth % self.checkpoint_every == 0 and self.depth < hops and self.spark.conf.get("spark.checkpoint.dir", None)
                self.state = state.checkpoint() if cut else state
        return reduce(DataFrame.unionByName, self.emitted[:hops])


def beam_trace(roots: DataFrame, symbols: DataFrame, edges: DataFrame, terms: list[str], hops: int, beam: int, weights: EdgeWeights = EdgeWeights(), digits: int | None = None) -> DataFrame:
    """A beam search of `hops` steps from its start."""
    return BeamSearch(roots, symbols, edges, terms, beam, weights, digits).to(hops)


def merged(fast: DataFrame, deep: DataFrame) -> DataFrame:
    """Paths of two stages, one for each endpoint: the better, of equals the shorter. Paths through test files are left out."""
    order = Window.partitionBy("_key").orderBy(F.desc("score"), "depth", "steps")
    both = fast.unionByName(deep.select(*fast.columns)).withColumn("_key", endpoint(F.col("root"), F.col("steps")))
    return both.filter(~has_test_paths(F.col("steps"))).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_key", "_n")


def best(paths: DataFrame, limit: int) -> DataFrame:
    """At most `limit` of some shown paths, the best of each root first."""
    rooted = paths.withColumn("root_rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), "depth", "steps")).cast("long"))
    return rooted.orderBy(F.col("root_rank") > 1, F.desc("score"), "root", "depth", "steps").limit(max(1, limit))


def has_test_paths(steps: Column) -> Column:
    return F.exists(steps, lambda s: F.coalesce(is_test_path(s["path"]), F.lit(False)))


def endpoint(root: Column, steps: Column) -> Column:
    """The root and the last edge: paths that share it tell the same."""
    last = F.element_at(steps, -1)
    return F.concat_ws("|", root, last["edge_kind"], last["path"], last["line"].cast("string"), F.coalesce(last["target_name"], F.lit("")))


def diverse(paths: DataFrame, limit: int) -> DataFrame:
    """At most `limit` paths: the best of each root by score, then the best of what is left, one for each endpoint."""
    tie = ["depth", "state_ord", "edge_ord"]
    keyed = paths.withColumn("_key", endpoint(F.col("root"), F.col("steps")))
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("score"), *tie))).filter("_n = 1")
    rooted = one.withColumn("root_rank", F.row_number().over(Window.partitionBy("root").orderBy(F.desc("score"), *tie, "_key")).cast("long"))
    return rooted.orderBy(F.col("root_rank") > 1, F.desc("score"), "root", *tie, "_key").limit(max(1, limit)).select("root", "score", "depth", "root_rank", "steps")


def grouped(paths: DataFrame) -> DataFrame:
    """(root, best_score, paths) for a list of roots."""
    return paths.groupBy("root").agg(F.max("score").alias("best_score"), F.count("*").alias("paths")).orderBy(F.desc("best_score"), "root")


def flow_tree(paths: DataFrame) -> DataFrame:
    """Paths merged into a prefix tree: (root, node, depth, count, best_score, best_confidence, evidence) for each prefix."""
    key = lambda s: F.concat_ws(":", s["edge_kind"], s["from_symbol"], s["target_name"], s["path"], s["line"].cast("string"))
    each = paths.select("root", "score", "steps", F.explode(F.sequence(F.lit(1), F.size("steps"))).alias("depth"))
    node = F.array_join(F.transform(F.slice("steps", F.lit(1), F.col("depth")), key), " > ")
    last = F.element_at("steps", F.col("depth"))
    rows = each.select("root", F.col("depth").cast("long").alias("depth"), node.alias("node"), "score", last["confidence"].alias("confidence"), last["evidence"].alias("evidence"))
    evidence = F.min_by(F.when(F.col("evidence") != "", F.col("evidence")), F.when(F.col("evidence") != "", F.struct(-F.col("score"), F.col("evidence"))))
    return rows.groupBy("root", "node", "depth").agg(F.count("*").alias("count"), F.max("score").alias("best_score"), F.max("confidence").alias("best_confidence"), evidence.alias("evidence"))


def citations(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, line, place) in the order in which they are first told: roots of the paths first, then steps."""
    order = Window.orderBy(F.desc("score"), "root", "depth")
    numbered = paths.withColumn("_p", F.row_number().over(order))  # a handful of chosen paths
    at_root = numbered.join(roots.select(F.col("symbol_id").alias("root"), F.col("path").alias("rpath"), F.col("start_line").alias("rline")), "root").select(F.col("rpath").alias("path"), F.col("rline").cast("long").alias("line"), F.struct("_p", F.lit(0).alias("i")).alias("o"))
    in_step = numbered.select("_p", F.posexplode("steps").alias("i", "s")).select("s.path", "s.line", F.struct("_p", (F.col("i") + 1).alias("i")).alias("o"))
    first = at_root.unionByName(in_step).filter(~is_test_path(F.col("path"))).groupBy("path", "line").agg(F.min("o").alias("o"))
    return first.select("path", "line", F.row_number().over(Window.orderBy("o", "path", "line")).cast("long").alias("place"))


def summary(paths: list[dict], cited: list[tuple[str, int]]) -> str:
    """A sentence about the best path, from rows collected for showing."""
    if not paths:
        return "No trace paths found."
    best = paths[0]
    hops = " -> ".join([best["root"], *(s["target_name"] or s["edge_kind"] for s in best["steps"][:5])])
    text = f"Best path: {hops}."
    if len(paths) > 1:
        text += f" {len(paths) - 1} alternative paths."
    if cited:
        text += " Sources: " + ", ".join(f"{p}:{line}" for p, line in cited[:6]) + "."
    return text


@dataclass(frozen=True)
class Told:
    """A summary, whether an outside writer made it (`written`) or the rule (`rule`), and what went wrong with the writer."""

    text: str
    source: str
    error: str | None = None


def told(query: str, paths: list[dict], cited: list[tuple[str, int]], write: Callable[[str, list[dict], list[tuple[str, int]]], str] | None = None) -> Told:
    """What a writer says of the chosen paths; the rule's sentence where there is none, or it fails or says nothing."""
    plain = summary(paths, cited)
    if write is None or not paths:
        return Told(plain, "rule")
    try:
        text = (write(query, paths, cited) or "").strip()
    except (ValueError, OSError) as error:
        return Told(plain, "rule", " ".join(str(error).split()) or type(error).__name__)
    return Told(text, "written") if text else Told(plain, "rule", "the writer said nothing")
