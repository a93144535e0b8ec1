"""Feed and queue queries over blogs, articles and comment snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.schedule import due

PAGE = 100


def in_language(rows: DataFrame, lang: str | None) -> DataFrame:
    """Rows whose languages hold ``lang``; all rows without one."""
    return rows.filter(F.array_contains("languages", F.lit(lang))) if lang else rows


def _blogs(blogs: DataFrame, lang: str | None) -> DataFrame:
    return in_language(blogs, lang).select(F.col("id").alias("blog_id"), F.col("name").alias("blog_name"), F.col("url").alias("blog_url"))


def latest_feed(articles: DataFrame, blogs: DataFrame, lang: str | None = None, limit: int = PAGE) -> DataFrame:
    """Newest articles with their blog; undated ones last, the larger id first among equals."""
    return articles.join(_blogs(blogs, lang), "blog_id").orderBy(F.desc_nulls_last("published_at"), F.desc("id")).limit(limit)


def comments_feed(articles: DataFrame, blogs: DataFrame, snapshots: DataFrame, lang: str | None = None, limit: int = PAGE) -> DataFrame:
    """Articles with a snapshot by the time of their latest one, with its count."""
    latest = snapshots.groupBy("article_id").agg(F.max(F.struct("snapshot_at", "id", "comment_count")).alias("s"))
    latest = latest.select("article_id", F.col("s.snapshot_at").alias("latest_comment_at"), F.col("s.comment_count").alias("comment_count"))
    met = articles.join(latest, articles.id == latest.article_id).drop("article_id").join(_blogs(blogs, lang), "blog_id")
    return met.orderBy(F.desc_nulls_last("latest_comment_at"), F.desc("id")).limit(limit)


def feed(filter_name: str, articles: DataFrame, blogs: DataFrame, snapshots: DataFrame, lang: str | None = None) -> DataFrame:
    """The feed of a filter name; unknown names give the latest feed."""
    return comments_feed(articles, blogs, snapshots, lang) if filter_name == "comments" else latest_feed(articles, blogs, lang)


def blog_list(blogs: DataFrame) -> DataFrame:
    return blogs.orderBy(F.asc_nulls_first("name"), "id")


def crawl_order(blogs: DataFrame) -> DataFrame:
    """Never scraped first, then the longest ago."""
    return blogs.orderBy(F.asc_nulls_first("last_scraped_at"), "id")


def due_queue(blogs: DataFrame, cutoff: Column) -> DataFrame:
    return crawl_order(blogs.filter(due(F.col("last_scraped_at"), cutoff)))


def next_due(blogs: DataFrame, cutoff: Column) -> DataFrame:
    return due_queue(blogs, cutoff).limit(1)


def page_of(rows: DataFrame, order: str, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def random_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded hash of their contents, so that the draw doesn't depend on how rows are dealt."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns).limit(n)


def top_counts(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most frequent values that aren't null."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def queue_order(queue: DataFrame) -> DataFrame:
    return queue.orderBy(F.desc("priority"), "id")


def language_text(rows: DataFrame, part: str) -> DataFrame:
    """Rows whose languages hold ``part`` when written out as JSON, so a part of a name counts."""
    return rows.filter(F.to_json("languages").contains(part))


def first_rows_of(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` of a list (0 and less: none)."""
    return rows.orderBy(order).limit(max(0, n))


def merge_feed(shown: DataFrame, arrived: DataFrame, when: str = "published_at") -> DataFrame:
    """A shown feed with the rows that arrived: each url once (the row shown before any other, the newest id first), newest first."""
    both = shown.withColumn("__new", F.lit(1)).unionByName(arrived.withColumn("__new", F.lit(2)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("url").orderBy("__new", F.desc("id")))
    return both.withColumn("__n", rank).filter("__n = 1").drop("__n", "__new").orderBy(F.desc_nulls_last(when), F.desc("id"))
