"""Composite pipelines: site processing, batch indexing, discovery, language jobs, the crawl report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.lang import article_language, densities, page_languages, strip_tags
from quillstream.operators import feedq, links, report, store
from quillstream.operators.comments import scrape_articles
from quillstream.operators.cuts import cut
from quillstream.operators.feeds import first_feed, parse_feeds, probes
from quillstream.operators.pages import fingerprint, protocols
from quillstream.sources.http import classify


def site_facts(pages: DataFrame) -> DataFrame:
    """Fingerprint and protocols of pages (``site_id, url, html``) in one projection; the html stays in the scan."""
    return pages.select("site_id", fingerprint(F.col("html")).alias("fingerprint"), protocols(F.col("html"), F.col("url")).alias("protocols"))


def process_sites(sites: DataFrame, relationships: DataFrame, pages: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Sites with the facts of their pages, and relationships with the friend links found there.

    Each page is searched once: its facts and its links are written to the shared folder before they are used.
    """
    facts = site_facts(pages).select(
        F.col("site_id").alias("id"), "fingerprint.ssg", "fingerprint.theme", "fingerprint.comment_system", F.col("protocols.rss.url").alias("rss_url"),
        F.col("protocols.opml.supported").alias("has_opml"), F.col("protocols.opml.url").alias("opml_url"), F.col("protocols.webmention.supported").alias("has_webmention"),
        F.col("protocols.webmention.url").alias("webmention_endpoint"), (F.col("protocols.microformats.h_card") | F.col("protocols.microformats.h_feed")).alias("has_microformats"),
    )
    known = [c for c in facts.columns if c != "id" and c in sites.columns]
    updated = cut(store.replace_columns(sites, cut(facts), "id", known))
    found = cut(links.friend_links(pages))
    grown = cut(store.insert_if_new(updated, found.select("url"), ["url"], "url"))
    targets = grown.select(F.col("url").alias("target_url"), F.col("id").alias("target_site_id"))
    given = found.withColumnRenamed("url", "target_url").join(targets, "target_url").select(
        F.col("site_id").alias("source_site_id"), "target_site_id", "target_url", F.lit("friend").alias("relationship_type"), F.col("method").alias("discovery_method"), "confidence", F.lit(0).alias("seq")
    )
    return grown, store.upsert_relationships(relationships, given, as_of)


def parsed_articles(blogs: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``blog_id, feed_url, ...`` of each blog's feed among the fetched ones (``feed_url, status, body``); and the articles in them, in the feed's order ``seq``."""
    feeds = first_feed(probes(blogs), classify(responses.select("feed_url", "status", "body")))
    rows = parse_feeds(feeds.select(F.col("blog_id").alias("feed_id"), F.col("url").alias("base_url"), F.col("body").alias("xml")))
    text = densities(strip_tags(F.concat_ws(" ", "title", "description")))
    given = rows.withColumn("language", article_language(text)).withColumnRenamed("feed_id", "blog_id").withColumn("published_at", F.col("published_at").cast("date"))
    return feeds, given.withColumn("seq", F.struct("blog_id", "pos"))


def article_events(rows: DataFrame, articles: list[str], kind: str = "new_article", *more: str) -> DataFrame:
    """``type, data, languages, key`` of articles with their blog (``blog_id, blog_name, blog_url, languages``): all their fields, and the blog's id, name and url."""
    article = F.struct(*(F.col(c) for c in articles), *(F.col(c) for c in more))
    blog = F.struct(F.col("blog_id").alias("id"), F.col("blog_name").alias("name"), F.col("blog_url").alias("url"))
    return rows.select(F.lit(kind).alias("type"), F.to_json(F.struct(article.alias("article"), blog.alias("blog")), {"ignoreNullFields": "false"}).alias("data"), "languages", F.concat_ws("-", F.lit(kind), "id").alias("key"))


def batch_index(blogs: DataFrame, articles: DataFrame, snapshots: DataFrame, responses: DataFrame, pages: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """One run over all blogs: new articles, comment snapshots, blog outcomes and events.

    ``responses``: feed fetches (``feed_url, status, body``); ``pages``: article pages (``url, html``). Feeds are parsed and pages searched once: the articles and
    the counts are written to the shared folder before they are used. A blog without a comment system gets that of its first new article with comments.
    """
    feeds, given = parsed_articles(blogs, responses)
    given, feeds = cut(given), cut(feeds.select("blog_id"))
    fresh = cut(store.new_rows(articles, given, ["url"], "seq"))
    stored = cut(store.insert_if_new(articles, fresh.drop("pos"), ["url"], "seq"))
    known = blogs.select(F.col("id").alias("blog_id"), "comment_system", F.col("name").alias("blog_name"), F.col("url").alias("blog_url"), "languages")
    new_ids = stored.join(fresh.select("url"), "url", "left_semi").join(known, "blog_id")
    counts = cut(scrape_articles(new_ids.select("id", "url", "comment_system"), pages).filter("count > 0"))
    systems = counts.join(new_ids.select(F.col("id").alias("article_id"), "blog_id"), "article_id").groupBy(F.col("blog_id").alias("id")).agg(F.min_by("system", "article_id").alias("comment_system"))
    changed = store.append_changed(snapshots, counts.select("article_id", F.col("count").alias("comment_count")), as_of)
    tried_blogs = blogs.select(F.col("id").alias("blog_id")).distinct().join(feeds.select("blog_id", F.lit(True).alias("found")), "blog_id", "left")
    outcomes = tried_blogs.select(F.col("blog_id").alias("id"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"), F.coalesce("found", F.lit(False)).alias("feed_found"))
    with_counts = new_ids.join(changed.select(F.col("article_id").alias("id"), "comment_count"), "id")
    done = store.crawl_outcomes(store.fill_empty(blogs, systems, "id", ["comment_system"]), outcomes.select("id", "ok", "message"), as_of)
    events = article_events(new_ids, articles.columns).unionByName(article_events(with_counts, articles.columns, "new_comment", "comment_count"))
    return {"articles": stored, "snapshots": changed, "blogs": done, "outcomes": outcomes, "events": events}


def poll_next(blogs: DataFrame, cutoff: Column) -> DataFrame:
    """The blog that a polling tick crawls."""
    return feedq.next_due(blogs, cutoff)


def discover(blogs: DataFrame, seeds: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blogs with those that the seed pages link to, and ``source, discovered, added, errors`` of each source."""
    found = links.scrape_seeds(seeds, pages)
    flagged = store.with_is_new(blogs, found.withColumn("seq", F.struct("source", "pos")), ["url"], "seq")
    per = flagged.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if("is_new").alias("added"))
    fetched = seeds.join(pages.filter("html is not null").select("url", F.lit(True).alias("got")).distinct(), "url", "left")
    totals = fetched.join(per, fetched.name == per.source, "left").select(
        "name", F.coalesce("discovered", F.lit(0)).alias("discovered"), F.coalesce("added", F.lit(0)).alias("added"), F.when(F.col("got"), 0).otherwise(1).alias("errors")
    )
    return store.insert_if_new(blogs, found.select("url", "name", F.struct("source", "pos").alias("seq")), ["url"], "seq"), totals


def detect_blog_languages(blogs: DataFrame, pages: DataFrame, lang: str = "zh", limit: int = 100) -> DataFrame:
    """``id, old, languages, changed`` of the first ``limit`` blogs that have ``lang`` and a page."""
    some = feedq.in_language(blogs, lang).orderBy("id").limit(limit).select("id", "url", F.col("languages").alias("old"))
    met = some.join(pages.filter("html is not null").select("url", "html"), "url")
    now = met.select("id", "old", page_languages(F.col("html"), F.col("url"), densities(strip_tags(F.col("html")))).alias("languages"))
    return now.withColumn("changed", ~F.col("old").eqNullSafe(F.col("languages")))


def slice_report(pages: DataFrame, seconds: float) -> DataFrame:
    """Verdicts over crawled pages (``site_id, url, html, response_ms``; a null html is a failure)."""
    facts = site_facts(pages.filter("html is not null"))
    friends = links.friend_links(pages.filter("html is not null")).groupBy("site_id").agg(F.count("*").alias("friend_links"))
    met = pages.select("site_id", F.col("html").isNotNull().alias("ok"), "response_ms").join(facts, "site_id", "left").join(friends, "site_id", "left")
    results = met.select("ok", "fingerprint.ssg", "fingerprint.theme", "fingerprint.comment_system", F.col("protocols.rss.supported").alias("has_rss"), "friend_links", "response_ms")
    return report.verdicts(report.crawl_metrics(results), seconds)
