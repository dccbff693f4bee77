"""Connected components by contraction, on edge tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links, in any direction and repeated or not -> (node, root).

    Every node of ``edges`` comes back once; ``root`` is the smallest node that is
    reachable.  Each round hooks every node to its smallest neighbour, follows the
    hooks twice, and keeps only the links between different roots, so rounds grow with
    the logarithm of the longest chain.  Only grouped minima and joins on the node are
    used: a node with very many links is pre-aggregated, and its join is split by AQE.
    """
    links = materialize(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-e"
    )
    labels = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        hook = materialize(hook, "cc-h")
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hook = hook.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        hook = materialize(hook, "cc-p")
        if labels is None:
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            up = hook.select(F.col("u").alias("root"), "p")
            labels = materialize(
                labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-l"
            )
        left = hook.select("u", F.col("p").alias("a"))
        right = hook.select(F.col("u").alias("v"), F.col("p").alias("b"))
        links = materialize(
            links.join(left, "u").join(right, "v").where("a <> b")
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "cc-e",
        )
        if links.isEmpty():
            return labels
