"""Connected components by alternating large-star and small-star.

Large-star ties every larger neighbour of a node to the smallest node in its
neighbourhood; small-star ties the smaller ones.  Both keep the components, and
alternating them ends with every node tied to the smallest of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsweep.llm.common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges go from the larger node u to the smaller node v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _stored(edges.groupBy("u").agg(F.min("v").alias("m")))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.withColumnRenamed("m", "v")).distinct()


def _stored(least: DataFrame) -> DataFrame:
    """The smallest neighbours, stored: a join with a table that is read lets Spark split the edges
    of a hub over many tasks, one with an aggregate in place does not."""
    return staged(least, "least")


def _settled(edges: DataFrame) -> bool:
    """Whether every component is a star already: no node is tied twice, or tied and tied to."""
    tied = edges.select(F.col("u").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("held"))
    held = edges.select(F.col("v").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("held"))
    nodes = tied.unionByName(held).groupBy("node").agg(F.sum("tied").alias("tied"), F.max("held").alias("held"))
    return not nodes.agg(F.max((F.col("tied") > 1) | ((F.col("tied") > 0) & (F.col("held") > 0)))).first()[0]


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of the ``(u, v)`` edges; the component is its smallest node.

    Every round is stored in the shared folder; stars need none.  Loops, repeated
    and reversed edges and those with a null end do no harm; no edges give no rows.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ordered = staged(edges_only(ordered).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(ordered):
            tied = ordered.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return tied.unionByName(ordered.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        ordered = staged(_small_star(_large_star(ordered)), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def edges_only(edges: DataFrame) -> DataFrame:
    return edges.filter("u is not null and v is not null and u <> v")
