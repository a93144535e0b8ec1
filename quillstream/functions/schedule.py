"""Crawl tiers and due times; clocks are arguments, in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000, 86_400_000
# fixed values: polling interval of each tier, and the ages that end the first two
INTERVALS = {"active": HOUR, "normal": 6 * HOUR, "dormant": 7 * DAY}
ACTIVE_DAYS, NORMAL_DAYS = 7, 90


def tier(as_of: Column, latest_post: Column) -> Column:
    age = as_of - latest_post
    return F.when(age <= ACTIVE_DAYS * DAY, "active").when(age <= NORMAL_DAYS * DAY, "normal").otherwise("dormant")


def polling_interval(tier_name: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, ms in INTERVALS.items():
        out = F.when(tier_name == name, F.lit(ms).cast("long")).otherwise(out)
    return out


def next_crawl_at(as_of: Column, last_crawl: Column, tier_name: Column) -> Column:
    return F.when(last_crawl.isNull(), as_of).otherwise(last_crawl + polling_interval(tier_name))


def should_crawl(as_of: Column, next_at: Column) -> Column:
    return F.coalesce(as_of >= next_at, F.lit(True))


def due(last_scraped: Column, cutoff: Column) -> Column:
    return last_scraped.isNull() | (last_scraped < cutoff)
