"""Schemas of the domain tables, their keys and their defaults."""

from __future__ import annotations

from pyspark.sql import types as T

BLOGS = (
    "id bigint, url string, name string, ssg string, comment_system string, rss_url string, languages array<string>, last_scraped_at timestamp, "
    "error_count int, last_error string, created_at timestamp, etag string, last_modified string, crawl_tier string, next_crawl_at bigint, theme string, "
    "trust_score double, hop_count int, has_opml boolean, opml_url string, has_webmention boolean, webmention_endpoint string, has_microformats boolean"
)
ARTICLES = "id bigint, blog_id bigint, url string, title string, description string, cover_image string, language string, published_at date, discovered_at timestamp"
COMMENT_SNAPSHOTS = "id bigint, article_id bigint, comment_count int, snapshot_at timestamp"
SITE_RELATIONSHIPS = (
    "id bigint, source_site_id bigint, target_site_id bigint, target_url string, relationship_type string, discovery_method string, confidence double, "
    "discovered_at bigint, last_seen_at bigint"
)
SEED_SOURCES = "id bigint, url string, name string, type string, languages array<string>, last_scraped_at timestamp, member_count int, created_at timestamp"
DISCOVERY_QUEUE = "id bigint, url string, discovered_from_blog_id bigint, discovery_type string, priority int, created_at timestamp"
CIRCLES = "id bigint, name string, url string, languages array<string>"
BLOG_CIRCLES = "blog_id bigint, circle_id bigint"
FRIEND_LINKS = "source_blog_id bigint, target_url string, discovered_at timestamp"
CRAWL_STATE = "id int, current_blog_id bigint, last_crawl_at timestamp, is_running boolean"
TABLES = {
    "blogs": BLOGS, "articles": ARTICLES, "comment_snapshots": COMMENT_SNAPSHOTS, "site_relationships": SITE_RELATIONSHIPS, "seed_sources": SEED_SOURCES,
    "discovery_queue": DISCOVERY_QUEUE, "circles": CIRCLES, "blog_circles": BLOG_CIRCLES, "friend_links": FRIEND_LINKS, "crawl_state": CRAWL_STATE,
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


UNIQUE = {
    "blogs": ["url"], "articles": ["url"], "site_relationships": ["source_site_id", "target_url", "relationship_type"], "seed_sources": ["url"],
    "discovery_queue": ["url"], "blog_circles": ["blog_id", "circle_id"], "friend_links": ["source_blog_id", "target_url"], "crawl_state": ["id"],
}
NOT_NULL = {"blogs": ["url"], "articles": ["url"], "circles": ["name"], "seed_sources": ["url", "type"], "site_relationships": ["source_site_id", "target_url", "relationship_type"], "discovery_queue": ["url"]}
#: Column -> SQL of its default, by table.
DEFAULTS = {
    "blogs": {"languages": "array('zh')", "error_count": "0", "crawl_tier": "'normal'", "trust_score": "0.5D", "has_opml": "false", "has_webmention": "false", "has_microformats": "false"},
    "circles": {"languages": "array('zh')"},
    "seed_sources": {"languages": "array('zh')", "member_count": "0"},
    "discovery_queue": {"priority": "0"},
    "site_relationships": {"confidence": "0.5D"},
    "crawl_state": {"is_running": "false"},
}
