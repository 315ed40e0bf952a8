"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is its smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their
    roots by doubling, and contracts the links; roots at least halve, so rounds are
    logarithmic.  Each step is written to the shared folder.  Minima combine before the
    shuffle, and joins are of two written tables, so that a hub is split by AQE.
    """
    edge = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    edges = scratch.write(links.select(*edge("a", "b")).where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        to = scratch.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "to")
        while True:
            nxt = to.select(F.col("node").alias("mid"), F.col("to").alias("far"))
            jumped = scratch.write(to.join(nxt, to["to"] == nxt["mid"]).select("node", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(to)
            to = jumped
            if not moved:
                break
        far = to.select(F.col("node").alias("mid"), F.col("to").alias("far"))
        if labels is None:
            labels = to.select("node", F.col("to").alias("component"))
        else:
            labels = labels.join(far, labels["component"] == far["mid"], "left").select("node", F.coalesce("far", "component").alias("component"))
        labels = scratch.write(labels, "labels")
        fa, fb = far.withColumnsRenamed({"mid": "ma", "far": "fa"}), far.withColumnsRenamed({"mid": "mb", "far": "fb"})
        half = scratch.write(edges.join(fa, edges["a"] == fa["ma"]).select("fa", "b"), "half")
        rest = half.join(fb, half["b"] == fb["mb"]).where("fa <> fb").select(*edge("fa", "fb")).distinct()
        rest = scratch.write(rest, "links")
        scratch.drop(edges, half, to)
        edges = rest
        if edges.isEmpty():
            return labels
