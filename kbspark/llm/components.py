"""Connected components by alternating large-star and small-star rounds, on DataFrames only.

A round is two partial aggregates and two joins; a node that a third of all edges share is summed before
its shuffle, and its join is one that Spark splits. Each round is written to the shared folder. Rounds
grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, shuffled


def _stars(around: DataFrame, emit) -> DataFrame:
    """Joins each (u, v) with the smallest node of u's star and emits new edges (a > b)."""
    least = around.groupBy("u").agg(F.min("v").alias("least")).withColumn("m", F.least("u", "least")).drop("least")
    return emit(around.join(shuffled(least), "u")).filter("u > v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge names; the component is its smallest node.

    Self-loops give a node of its own; edges with a null end are ignored; repeated edges count once; no
    edges give an empty result.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    given = materialise(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now, mark, was = given.filter("u > v"), None, None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = _stars(both, lambda d: d.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        now = _stars(now, lambda d: d.select("u", F.col("m").alias("v")).unionByName(d.select(F.col("v").alias("u"), F.col("m").alias("v"))))
        now = materialise(now, "stars")
        discard(was)
        was = now
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if mark == (row.n, row.h) or not row.n:
            break
        mark = (row.n, row.h)
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(shuffled(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
