"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regimen.llm.common import write_shared


def connect(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v: long) reaches.

    Alternating large-star and small-star rounds: every round is a few
    shuffles of at most the rows of the edge table, stars shrink towards their
    smallest node, and the number of rounds grows with the logarithm of the
    number of nodes.  Each round's edges are a table in the shared folder, so
    a lost executor repeats one round.  Self-loops and repeated edges are fine."""
    e = write_shared(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                     .where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v")))
                 .where("u > v").distinct())
        e = write_shared(small)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
