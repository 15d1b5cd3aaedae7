"""Connected components of a table of links, by contracting it round after round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesolite.llm._spark import counted, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``links``; a component's name is its smallest node.

    Each round orders the nodes, the first one by name (which contracts stars
    around small names at once), later ones by a hash, afresh, hooks every node to the least
    of itself and its neighbours and replaces the nodes of all links by what
    they are hooked to.  Links inside a node drop out, so a round's table is a
    fraction of the last one's, whatever the shape of the graph.  The hooks of
    all rounds are then followed from the last to the first, and each root's
    group is named by its smallest node.

    A node with very many links is one key of a join and of partial minima, so
    Spark splits it; no round collects its neighbours.
    """
    return contracted(*counted(links_of(links, a, b), "links"))


def links_of(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct()


def contracted(edges: DataFrame, n: int) -> DataFrame:
    """``components`` of a written table of ``n`` distinct links (a, b), a < b."""
    hooks = []
    while n:
        order = lambda c: F.struct((F.xxhash64(F.col(c), F.lit(len(hooks))) if hooks else F.lit(0)).alias("h"), F.col(c).alias("id"))
        both = edges.select(F.col("a").alias("node"), order("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), order("a").alias("to")))
        hook = both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("to", order("node"))["id"].alias("parent"))
        hook = written(hook, "hooks")
        hooks.append(hook)
        moved = hook.filter("node != parent")
        at = lambda c: moved.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
        edges = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        edges, n = counted(links_of(edges, "x", "y"), "links")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = hooks[-1].select("node", F.col("parent").alias("root"))
    for k, hook in enumerate(reversed(hooks[:-1])):
        up = roots.withColumnRenamed("node", "parent")
        roots = hook.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        if k % 4 == 3:
            roots = written(roots, "roots")
    names = roots.groupBy("root").agg(F.min("node").alias("component"))
    return written(roots.join(names, "root").select("node", "component"), "components")
