"""Connected components of an edge table by alternating large-star and small-star steps.

Each step replaces every node's links by links to the smallest node it sees, with one
minimum per node and one join; no neighbour list is gathered, and the links of a node
with very many are dealt over several tasks. Steps are written to the shared folder, so
lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import drop, join_counted, materialize


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """edges(a, b) of any ordered type: (node, component) for every node that has an edge, component being its smallest node.

    Loops and rows with a null are ignored; repeated and reversed edges count once.
    """
    spark = edges.sparkSession
    made: list[str] = []
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges", made)
    before = _state(e)
    for _ in range(max_steps):
        old = list(made)
        made.clear()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), "lowest", old)
        large = join_counted(both.where("v > u"), low, "u", "n", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large, "large", old)
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lowest", old)
        rest = join_counted(large, low2.where("n > 1"), "u", "n", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(rest.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), "edges", made)
        after = _state(e)
        drop(spark, old)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
