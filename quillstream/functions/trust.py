"""Trust arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
DECAY, LEAST, PROMOTE_AT, PROMOTE_LINKS = 0.8, 0.1, 0.8, 10
LEAST_QUALITY, MOST_QUALITY = 0.3, 1.2
METHOD_BONUS = {"opml": 0.1, "xfn": 0.05, "microformat": 0.05}


def method_bonus(method: Column) -> Column:
    out = F.lit(0.0)
    for name, bonus in METHOD_BONUS.items():
        out = F.when(method == name, bonus).otherwise(out)
    return out


def edge_strength(confidence: Column, method: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)) + method_bonus(method))


def passed_on(source_trust: Column, strength: Column) -> Column:
    return source_trust * DECAY * strength


def content_quality(posts_per_day: Column, has_author: Column, has_dates: Column) -> Column:
    flood = F.when(posts_per_day > 10, F.lit(1.0) / F.least(posts_per_day / 10, F.lit(10.0))).otherwise(1.0)
    value = flood * F.when(has_author, 1.0).otherwise(0.95) * F.when(has_dates, 1.02).otherwise(1.0)
    return F.least(F.lit(MOST_QUALITY), F.greatest(F.lit(LEAST_QUALITY), value))


def final_trust(trust: Column, quality: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), trust * quality))


def promotes(trust: Column, has_opml: Column, links: Column) -> Column:
    return (trust >= PROMOTE_AT) & has_opml & (links >= PROMOTE_LINKS)
