"""Connected components by alternating large-star and small-star steps, all as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.stage import drop, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, root)`` for every id on an edge, root the smallest id reachable.

    Loops and repeated edges are allowed; an empty table gives an empty one.  Each round costs two grouped
    minima and two joins, and ends when no edge can move; the number of rounds is logarithmic in practice and does not depend on degree.
    """
    cur = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not _stars(cur):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v"))))
                .otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
            ).alias("e")
        ).select("e.u", "e.v").distinct()
        before, cur = cur, stage(small, "edges")
        drop(before)
    roots = cur.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    """Whether every id on the larger end of an edge is on one edge only: then each component hangs on its smallest id."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("low"))
    ends = ends.unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    found = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not found.where("up > 1 or (up = 1 and low = 1)").head(1)
