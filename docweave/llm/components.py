"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import staged


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """Each node of ``edges`` (columns ``a`` and ``b``) with ``component``, its smallest reachable node.

    Every round ties each node's neighbours to the smallest of them, first the larger ones, then the
    smaller ones, until nothing changes: about log2 of the longest chain rounds. Rounds are staged in the
    shared folder; a node with very many neighbours is only ever joined, never gathered. Empty edges give
    an empty table; loops and repeated edges don't matter.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = staged(now)
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("e"))
        now = staged(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct())
        new = _mark(now)
        if new == mark:
            break
        mark = new
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return roots.union(tops)
