"""The site graph: trust and hops from seeds, derived seeds, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.trust import LEAST, edge_strength, passed_on, promotes
from quillstream.operators.cuts import cut
from quillstream.operators.store import mark_roots

MOST_HOPS = 10


def with_strength(edges: DataFrame) -> DataFrame:
    """``src, dst, strength`` of edges that lead to a known site; parallel edges count by the strongest."""
    strength = edge_strength(F.col("confidence"), F.col("discovery_method"))
    known = edges.filter("target_site_id is not null").select(F.col("source_site_id").alias("src"), F.col("target_site_id").alias("dst"), strength.alias("strength"))
    return known.groupBy("src", "dst").agg(F.max("strength").alias("strength"))


def incoming(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """``dst, trust, hop``: the most trust that any source passes on, and one hop more than the nearest source."""
    sources = sites.filter("trust_score is not null").select(F.col("id").alias("src"), "trust_score", "hop_count")
    met = edges.join(sources, "src")
    return met.groupBy("dst").agg(F.max(passed_on(F.col("trust_score"), F.col("strength"))).alias("trust"), (F.min("hop_count") + 1).alias("hop"))


def site_trust(sites: DataFrame, edges: DataFrame, is_root: Column) -> DataFrame:
    """One step for every site: ``id, trust, hop``; roots (1, 0), sites without trusted sources (0.1, null)."""
    found = incoming(with_strength(edges), sites)
    met = sites.select("id", is_root.alias("root")).join(found, F.col("id") == F.col("dst"), "left")
    return met.select(
        "id", F.when(F.col("root"), 1.0).otherwise(F.coalesce("trust", F.lit(LEAST))).alias("trust"), F.when(F.col("root"), 0).otherwise(F.col("hop")).alias("hop")
    )


def build_trust(sites: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = MOST_HOPS, reset: bool = False) -> DataFrame:
    """Sites with trust and hops after breadth-first rounds from the seeds.

    Each round gives a hop to the sites that some site of the round before links to, and the trust
    that all their sources pass on, as they stood at its start. Sites with a hop are left alone
    unless ``reset``. A round reads the frontier's links and writes the sites that it reaches; the sites
    themselves are met once, at the end.
    """
    strong = cut(with_strength(edges))
    start = mark_roots(sites.withColumn("hop_count", F.lit(None).cast("int")) if reset else sites, seeds)
    state = cut(start.select("id", F.col("trust_score").cast("double").alias("trust_score"), "hop_count"))
    reached = state.limit(0)
    for hop in range(1, rounds + 1):
        frontier = state.unionAll(reached).filter(F.col("hop_count") == hop - 1).select(F.col("id").alias("src"))
        ahead = strong.join(frontier, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = ahead.join(state.filter("hop_count is null").select("id"), "id", "left_semi").join(reached.select("id"), "id", "left_anti")
        links = strong.join(fresh.select(F.col("id").alias("dst")), "dst", "left_semi")
        # of a source that a round has reached that round's trust counts
        before = state.join(reached.select("id"), "id", "left_anti").unionAll(reached)
        now = cut(incoming(links, before).select(F.col("dst").alias("id"), F.col("trust").alias("trust_score"), F.lit(hop).alias("hop_count")))
        if now.isEmpty() and state.filter(F.col("hop_count") == hop).isEmpty():
            break
        reached = reached.unionAll(now)
    met = start.join(reached.select("id", F.col("trust_score").alias("__trust"), F.col("hop_count").alias("__hop")), "id", "left")
    new = {"trust_score": F.coalesce("__trust", "trust_score"), "hop_count": F.coalesce("__hop", "hop_count")}
    return met.select(*(new[c].alias(c) if c in new else F.col(c) for c in sites.columns))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("source_site_id").alias("id")).agg(F.count("*").alias("links"))


def derived_seeds(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """Trusted sites with an OPML list and enough links, most trusted first."""
    met = sites.join(out_degree(edges), "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return met.filter(promotes(F.col("trust_score"), F.col("has_opml"), F.col("links"))).select("id", "url", "trust_score", "links").orderBy(F.desc("trust_score"), "id")


def graph_stats(sites: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: sites, edges, fingerprinted sites, mean trust (0 without sites)."""
    s = sites.agg(F.count("*").alias("sites"), F.count("ssg").alias("fingerprinted"), F.coalesce(F.avg("trust_score"), F.lit(0.0)).alias("avg_trust"))
    return s.join(edges.agg(F.count("*").alias("edges")))
