"""Connected components of an edge table by repeated contraction.

Each round hooks every vertex to its smallest neighbour, follows one more hop, and replaces the edges
by those between hooks. At least half of the vertices of every unfinished component vanish per round,
so the rounds are few; each is written to the shared folder, which cuts the lineage. No vertex's
neighbours are ever gathered: rounds are joins and minimums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: comparable ids) -> (vertex, root): the smallest id reachable from each vertex that
    has an edge to another. Self-links, repeats and directions do not matter; null ends are dropped."""
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("o")).union(edges.select(F.col("b"), F.col("a")))
        hook = materialise(both.groupBy("v").agg(F.least(F.min("o"), F.col("v")).alias("h")), "hooks")
        jump = hook.select(F.col("v").alias("h"), F.col("h").alias("hh"))
        hook = materialise(hook.join(jump, "h").select("v", F.col("hh").alias("h")), "hooks")
        hooks.append(hook)
        to_a, to_b = (hook.select(F.col("v").alias(c), F.col("h").alias(f"h{c}")) for c in "ab")
        edges = edges.join(to_a, "a").join(to_b, "b").where("ha <> hb")
        edges = materialise(edges.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    out = hooks[-1].select(F.col("v").alias("vertex"), F.col("h").alias("root"))
    for hook in reversed(hooks[:-1]):  # a hook that has no edge left is final
        later = out.select(F.col("vertex").alias("h"), "root")
        out = hook.join(later, "h", "left").select(F.col("v").alias("vertex"), F.coalesce("root", "h").alias("root"))
    return out
