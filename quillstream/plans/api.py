"""What the service's routes answer, as one-row or row-wise JSON over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import display_date, escape_html, truncate
from quillstream.operators import feedq, store


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON object a row, in the rows' order."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def articles(filter_name: str, articles_: DataFrame, blogs: DataFrame, snapshots: DataFrame, lang: str | None = None) -> DataFrame:
    return as_json(feedq.feed(filter_name, articles_, blogs, snapshots, lang))


def blog_list(blogs: DataFrame) -> DataFrame:
    return as_json(feedq.blog_list(blogs))


def add_blogs(blogs: DataFrame, given: DataFrame) -> DataFrame:
    """``seq, url, status``: 400 without a url, 409 where it is known, else 201."""
    return store.strict_insert_status(blogs, given).select("seq", "url", "status")


def indexer_status(state: DataFrame) -> DataFrame:
    return as_json(state.select(F.coalesce("is_running", F.lit(False)).alias("isRunning"), F.col("current_blog_id").alias("currentBlogId"), F.col("last_crawl_at").alias("lastCrawlAt")))


def batch_status(cancelled: Column, processed: Column, total: Column, started_ms: Column, ended_ms: Column) -> Column:
    """Whether a batch still runs, and its whole seconds."""
    return F.struct((~cancelled & (processed < total)).alias("is_running"), F.floor((ended_ms - started_ms) / 1000 + 0.5).cast("long").alias("seconds"))


def cards(feed: DataFrame, lang: str = "zh") -> DataFrame:
    """``id, html``: a feed row as an escaped card (title, link, blog, short description, date)."""
    text = lambda c: escape_html(F.coalesce(F.col(c), F.lit("")))
    when = F.coalesce(display_date(F.col("published_at"), lang), F.lit(""))
    html = F.concat(
        F.lit('<article><h2><a href="'), text("url"), F.lit('">'), text("title"), F.lit("</a></h2><p>"), escape_html(truncate(F.coalesce("description", F.lit("")))),
        F.lit("</p><footer>"), text("blog_name"), F.lit(" · "), when, F.lit("</footer></article>"),
    )
    return feed.select("id", html.alias("html"))
