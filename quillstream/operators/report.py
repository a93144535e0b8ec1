"""Metrics of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.cuts import running_sums

# fixed values: targets of the report
SITES_PER_MINUTE, SSG_PERCENT, LINKS_PERCENT = 10, 90, 70


def crawl_metrics(results: DataFrame) -> DataFrame:
    """One row over crawl results (``ok, ssg, theme, comment_system, has_rss, friend_links, response_ms``)."""
    ok = F.col("ok")
    return results.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("ssg").isNotNull()).alias("with_ssg"),
        F.count_if(ok & F.col("theme").isNotNull()).alias("with_theme"), F.count_if(ok & F.col("comment_system").isNotNull()).alias("with_comments"),
        F.count_if(ok & F.col("has_rss")).alias("with_rss"), F.count_if(ok & (F.col("friend_links") > 0)).alias("with_links"),
        F.coalesce(F.sum(F.when(ok, F.coalesce("friend_links", F.lit(0)))), F.lit(0)).cast("long").alias("links"),
        F.avg(F.when(ok & (F.col("response_ms") != 0), F.col("response_ms"))).alias("mean_ms"),
    )


def percent(part: Column, whole: Column) -> Column:
    """To one decimal; null without a whole."""
    return F.round(F.try_divide(part * 100, whole).cast("decimal(20,6)"), 1)


def verdicts(metrics: DataFrame, seconds: float) -> DataFrame:
    """Rates, throughput and whether each target is met."""
    rated = metrics.withColumn("ssg_percent", percent(F.col("with_ssg"), F.col("succeeded"))).withColumn("links_percent", percent(F.col("with_links"), F.col("succeeded")))
    rated = rated.withColumn("per_minute", F.round(F.try_divide(F.col("total") * 60, F.lit(seconds)).cast("decimal(20,6)"), 1))
    mark = lambda c, least: F.when(F.col(c) >= least, "PASS").otherwise("FAIL")
    return rated.select("*", mark("per_minute", SITES_PER_MINUTE).alias("throughput"), mark("ssg_percent", SSG_PERCENT).alias("detection"), mark("links_percent", LINKS_PERCENT).alias("coverage"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def progress(done: DataFrame, total: int, order: str = "seq") -> DataFrame:
    """Running counts over finished blogs (``seq, ok, new_articles, elapsed_ms``) and the seconds that remain."""
    counted = running_sums(done, order, {"processed": F.lit(1), "succeeded": F.col("ok"), "new_total": F.col("new_articles")})
    rows = counted.withColumn("failed", F.col("processed") - F.col("succeeded"))
    left = (F.lit(total) - F.col("processed")) * F.col("elapsed_ms") / F.col("processed") / 1000
    return rows.withColumn("eta_s", F.floor(left + 0.5).cast("long"))


def discovery_totals(per_source: DataFrame) -> DataFrame:
    return per_source.agg(F.count("*").alias("sources"), F.sum("discovered").alias("discovered"), F.sum("added").alias("added"), F.sum("errors").alias("errors"))


def unique_urls(*sources: DataFrame) -> DataFrame:
    """How many distinct urls several sources have together."""
    rows = sources[0].select("url")
    for s in sources[1:]:
        rows = rows.unionAll(s.select("url"))
    return rows.agg(F.countDistinct("url").alias("urls"))
