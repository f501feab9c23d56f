"""Connected components of links held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c) for each vertex with a link: c is the smallest vertex it can reach.

    Minimum labels with grandparent hooking: in each round a vertex and its
    parent take the least grandparent of the neighbours, so the number of
    rounds follows the logarithm of the longest path.  Labels are staged in the
    shared folder each round; all work is inner joins and aggregates of small rows,
    whose hot keys (the root of a large component, a hub) Spark splits when it joins
    and combines before it shuffles.
    Null vertices are ignored; no links give no rows."""
    both = links.select(F.col(a).alias("v"), F.col(b).alias("w")).where("v is not null and w is not null and v <> w")
    edges = C.stage(both.union(both.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct(), "edges")
    labels = C.stage(edges.groupBy("v").agg(F.least("v", F.min("w")).alias("c")), "labels")
    while True:
        parent = labels.select(F.col("v").alias("c"), F.col("c").alias("g"))
        grand = labels.join(parent, "c").select("v", "c", "g")
        offer = edges.join(grand.select(F.col("v").alias("w"), F.col("g").alias("offer")), "w").join(labels, "v")
        best = offer.select(F.explode(F.array(F.struct(F.col("v").alias("t"), "offer"), F.struct(F.col("c").alias("t"), "offer"))).alias("x")).groupBy(F.col("x.t").alias("v")).agg(F.min("x.offer").alias("offer"))
        new = C.stage(grand.join(best, "v", "left").select("v", F.least("g", F.coalesce("offer", "g")).alias("c"), F.col("c").alias("was")), "labels")
        moved = new.where("c <> was").limit(1).count()
        C.unstage(labels)
        labels = new.select("v", "c")
        labels._staged_at = new._staged_at
        if not moved:
            C.unstage(edges)
            return labels
