"""The static catalogue of seed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: url, name, type, languages
SEEDS = [
    ("https://www.travellings.cn", "开往 Travellings", "circle", ["zh"]),
    ("https://foreverblog.cn", "十年之约", "circle", ["zh"]),
    ("https://blogwe.com", "博客志", "directory", ["zh"]),
    ("https://storeweb.cn", "个站商店", "directory", ["zh"]),
    ("https://xn--sr8hvo.ws/directory", "IndieWeb Webring", "webring", ["en"]),
    ("https://indieseek.xyz/links/", "Indieseek Links", "directory", ["en"]),
    ("https://webring.xxiivv.com/", "XXIIVV Webring", "webring", ["en"]),
    ("https://personalsit.es", "personalsit.es", "directory", ["en"]),
    ("https://ooh.directory/", "ooh.directory", "directory", ["en"]),
    ("https://blogroll.org", "Ye Olde Blogroll", "directory", ["en"]),
    ("https://github.com/timqian/chinese-independent-blogs", "Chinese Independent Blogs List", "directory", ["zh"]),
]


def seed_sources(spark: SparkSession, lang: str | None = None) -> DataFrame:
    seeds = spark.createDataFrame(SEEDS, "url string, name string, type string, languages array<string>")
    return seeds.filter(F.array_contains("languages", F.lit(lang))) if lang else seeds


def seed_languages(spark: SparkSession) -> DataFrame:
    return seed_sources(spark).select(F.explode("languages").alias("language")).distinct().orderBy("language")


def by_name(seeds: DataFrame, part: str) -> DataFrame:
    """Seeds whose name holds ``part``, case aside."""
    return seeds.filter(F.lower("name").contains(part.lower()))
