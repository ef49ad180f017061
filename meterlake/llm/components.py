"""Connected components by contraction: every round hooks each node to its least neighbour, follows
the hooks to their roots, and contracts the edges, so rounds grow with the logarithm of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.staging import staged


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` to the root by doubling; parents are smaller, so there is no cycle."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        parents = staged(parents.join(up, "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"), F.col("up").isNotNull().alias("moved")), "roots")
        if parents.filter("moved").limit(1).count() == 0:
            return parents.drop("moved")
        parents = parents.drop("moved")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge; the root is the least node of its component. Nulls
    and loops are ignored; repeated edges do no harm; no edges give no rows."""
    live = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    live = staged(live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    whole = None
    while live.limit(1).count():
        # Each node hooks to its least neighbour if that is smaller; the others are roots for now.
        hooks = live.groupBy("u").agg(F.min("v").alias("v")).filter("v < u").select(F.col("u").alias("node"), F.col("v").alias("parent"))
        roots = _roots(hooks)
        to = lambda side: roots.select(F.col("node").alias(side), F.col("parent").alias(f"{side}_root"))
        moved = live.join(to("u"), "u", "left").join(to("v"), "v", "left")
        moved = moved.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).filter("u <> v").distinct()
        if whole is None:
            whole = roots.withColumnRenamed("parent", "root")
        else:
            up = roots.select(F.col("node").alias("root"), F.col("parent").alias("up"))
            whole = whole.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")).unionByName(roots.withColumnRenamed("parent", "root")).groupBy("node").agg(F.min("root").alias("root"))
        whole, live = staged(whole, "components"), staged(moved, "edges")
    if whole is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = whole.select("root").distinct().select(F.col("root").alias("node"), "root")
    return whole.unionByName(tops)
