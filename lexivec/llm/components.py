"""Connected components of an edge table, by hooking each node to its least neighbour and contracting.

No neighbourhood is ever gathered: each round takes a minimum per node (combined before the shuffle), follows it one step
further, and renames the ends of all edges. Edges inside a component vanish; the rounds grow with the logarithm of the
longest chain. Each round's table goes to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


HUB = 1000
#: Rows of a file, at least: small tables of a round are written as few files, by few tasks.
FILE_ROWS = 50_000
BROADCAST_ROWS = 400_000


def _looked_up(rows: DataFrame, hook: DataFrame, end: str, to: str, spread: str, how: str = "inner") -> DataFrame:
    """`rows` with what `hook` says of the column `end` as `to`. Nodes with over HUB edges are broadcast where they are few,
    so that no task gets all rows of one; in the join of the others their rows go by the column `spread`."""
    plain = hook.select(F.col("node").alias("key"), F.col("to").alias("plain"))
    hubs = hook.filter(F.col("degree") > HUB).select(F.col("node").alias(end), F.col("to").alias("hub"))
    if not 0 < hubs.count() <= BROADCAST_ROWS:
        return rows.join(plain.withColumnsRenamed({"key": end, "plain": to}), end, how)
    marked = rows.join(F.broadcast(hubs), end, "left").withColumn("key", F.when(F.col("hub").isNull(), F.col(end)).otherwise(F.col(spread)))
    return marked.join(plain, "key", how).withColumn(to, F.coalesce("hub", "plain")).drop("key", "hub", "plain")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of `edges` (a long, b long); the component is its least node.

    Loops and repeated edges don't matter; rows with a null end are left out; no edges give no rows.
    The table is written in the shared folder, where the caller may discard it.
    """
    edge = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges", "lz4")
    hooks, nodes = [], 0
    while left := edge.count():
        files = 1 + 2 * left // FILE_ROWS
        near = edge.select("a", "b").union(edge.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("degree"))
        near = materialize(near.select(F.col("a").alias("node"), F.least("a", "b").alias("to"), "degree").coalesce(files), "hooks", "lz4")
        further = _looked_up(near.drop("degree"), near, "to", "next", "node").select("node", F.col("next").alias("to"))
        hook = materialize(further.join(near.select("node", "degree"), "node").coalesce(files), "hooks", "lz4")
        hooks.append(hook)
        nodes = max(nodes, 2 * left)
        ends = _looked_up(_looked_up(edge, hook, "a", "p", "b"), hook, "b", "q", "a")
        contracted = materialize(ends.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct().coalesce(files), "edges", "lz4")
        discard(edge, near)
        edge = contracted
    if not hooks:
        return materialize(edge.select(F.col("a").alias("node"), F.col("b").alias("component")), "components", "lz4")
    out = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        out = _looked_up(out, hook, "component", "next", "node", "left").select("node", F.coalesce("next", "component").alias("component"))
    out = materialize(out.coalesce(1 + nodes // FILE_ROWS), "components", "lz4")
    discard(edge, *hooks)
    return out
