"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import save


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = save(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    ``edges``: columns ``u, v`` of one orderable type; order, repeats and self-loops don't matter.
    Returns ``node, root`` (root: the smallest node of the component, its own row included).
    Each round and the minima in it are written to the shared folder: so a hub's rows are only
    ever pre-aggregated, or joined with a table on the hub, which adaptive execution can split.
    """
    now = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        now = save(_small_star(_large_star(now).filter("u <> v").distinct()).filter("u <> v").distinct())
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components didn't settle")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
