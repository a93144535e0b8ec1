"""The crawl loop: at each tick of a clock the blogs that are due are fetched, and what came of it is stored.

A tick is a micro-batch of a stream, so Spark numbers it and does it again, under the same number, if it fails. What a tick decides (which blogs, as they
were then; what their feeds answered; the new articles and their ids) is written under ``ticks/<number>`` before any table is touched,
and each table is updated by keys from there. So a tick that broke off at any point can be done again and leaves the same tables.

Tables under the base folder: ``blogs`` in buckets of ``id``, ``articles`` in buckets of ``url``, ``crawl_state`` (one row a tick; the last one is the cursor), and ``outbox``.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.operators import feedq, feeds, store
from quillstream.plans.batch import article_events, parsed_articles
from quillstream.sources import buckets
from quillstream.sources.http import PageSource, fetch_table
from quillstream.streaming import events as streams
from quillstream.streaming import sink

#: Seconds after which a blog is due again, blogs that a tick crawls, and URLs that a task fetches.
POLL_SECONDS, AT_ONCE, PER_TASK = 24 * 3600, 1, 50
Fetch = Callable[[SparkSession, str], DataFrame]


def create(blogs: DataFrame, base: str, n: int = buckets.BUCKETS) -> None:
    """Crawl tables with the given blogs and no articles."""
    buckets.create(store.with_missing_columns(blogs, "blogs"), f"{base}/blogs", ["id"], n)
    buckets.create(blogs.sparkSession.createDataFrame([], schemas.schema("articles")), f"{base}/articles", ["url"], n)


def fetch_pages(spark: SparkSession, asked: str) -> DataFrame:
    """The default fetch: ``url, status, body`` of a stored table of URLs."""
    return fetch_table(spark, asked, pertask=str(PER_TASK))


def _written_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made only if no earlier attempt finished it."""
    name = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not name.getFileSystem(spark._jsc.hadoopConfiguration()).exists(name):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cursor(spark: SparkSession, base: str) -> DataFrame:
    """The crawl state: one row ``id, current_blog_id, last_crawl_at, is_running``, of the last tick that crawled."""
    rows = spark.read.schema(f"{schemas.CRAWL_STATE}, tick long").parquet(f"{base}/crawl_state")
    return rows.orderBy(F.desc("tick")).limit(1).drop("tick")


def _move_cursor(crawled: DataFrame, base: str, tick: int, running: bool) -> None:
    last = crawled.agg(F.max_by("id", "seq").alias("current_blog_id"), F.max("as_of").alias("last_crawl_at")).filter("current_blog_id is not null")
    row = last.select(F.lit(1).alias("id"), "current_blog_id", "last_crawl_at", F.lit(running).alias("is_running"), F.lit(tick).cast("long").alias("tick"))
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tick").parquet(f"{base}/crawl_state")


def tick(
    spark: SparkSession, base: str, number: int, as_of: datetime, fetch: Fetch = fetch_pages, at_once: int = AT_ONCE, poll_seconds: int = POLL_SECONDS, n: int = buckets.BUCKETS,
    clients: DataFrame | None = None, reached: Callable[[int, str], None] = lambda number, step: None,
) -> int:
    """Crawl the ``at_once`` blogs that are due longest; returns how many there were. ``reached`` is called with the number and the name of each step before it (tests make it fail).

    A blog without a feed, or with one that answers nothing, counts as crawled, as no path failing is an error. Events of new articles go to the outbox, for ``clients`` where given.
    """
    at, now = f"{base}/ticks/{number}", F.lit(as_of).cast("timestamp")
    cutoff = now - F.expr(f"interval {poll_seconds} seconds")

    reached(number, "choose")
    due = lambda: feedq.due_queue(buckets.read(spark, f"{base}/blogs"), cutoff).limit(at_once)
    order = F.struct(F.col("last_scraped_at").isNotNull(), F.coalesce("last_scraped_at", F.lit(0).cast("timestamp")), "id")
    chosen = _written_once(spark, f"{at}/chosen", lambda: due().withColumn("seq", order).withColumn("as_of", now))
    crawled = chosen.count()
    if not crawled:
        return 0
    _move_cursor(chosen, base, number, True)

    reached(number, "fetch")
    _written_once(spark, f"{at}/asked", lambda: feeds.probes(chosen.select("id", "url", "ssg")).select(F.col("feed_url").alias("url")).distinct())
    answers = _written_once(spark, f"{at}/answers", lambda: fetch(spark, f"{at}/asked").select(F.col("url").alias("feed_url"), "status", "body"))

    reached(number, "articles")
    wanted = schemas.schema("articles").fieldNames()
    fresh = _written_once(spark, f"{at}/articles", lambda: _fresh(spark, base, chosen, answers, now, n).select(*wanted))
    buckets.update(spark, f"{base}/articles", fresh, ["url"], buckets.replace_rows(["url"]), n)

    reached(number, "blogs")
    old = chosen.drop("seq", "as_of")
    outcomes = chosen.select("id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"))
    buckets.update(spark, f"{base}/blogs", store.crawl_outcomes(old, outcomes, now), ["id"], buckets.replace_rows(["id"]), n)

    reached(number, "events")
    named = chosen.select(F.col("id").alias("blog_id"), F.col("name").alias("blog_name"), F.col("url").alias("blog_url"), "languages")
    events = article_events(fresh.join(named, "blog_id"), wanted)
    if clients is not None:
        found = streams.fan_out(events, clients, ("type", "data", "key"))
        sink.write_frames(found.select("client_id", "key", streams.frame(F.col("type"), F.col("data")).alias("frame")), f"{base}/outbox", number)

    reached(number, "cursor")
    _move_cursor(chosen, base, number, False)
    return crawled


def _fresh(spark: SparkSession, base: str, chosen: DataFrame, answers: DataFrame, now, n: int) -> DataFrame:
    _, given = parsed_articles(chosen.select("id", "url", "ssg"), answers)
    return buckets.new_rows_with_ids(spark, f"{base}/articles", given.withColumn("discovered_at", now), ["url"], "seq", n)


def crawl_loop(spark: SparkSession, base: str, checkpoint: str, clock: DataFrame | None = None, interval: str | None = "5 seconds", **options):
    """Crawl at each micro-batch of ``clock`` (a stream with ``timestamp``; by default Spark's own, one row a second). Returns the query; stop() ends the loop.

    The tick's number is the batch's and its time the batch's latest timestamp, both kept in ``checkpoint``: a loop that is started again does a broken tick first.
    Without ``interval`` it ends with what the clock has.
    """
    ticks = clock if clock is not None else spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def each(batch: DataFrame, number: int) -> None:
        as_of = batch.agg(F.max("timestamp")).first()[0]
        if as_of is not None:
            tick(spark, base, number, as_of, **options)

    for source in (PageSource, sink.FrameSink):
        spark.dataSource.register(source)
    writer = ticks.select("timestamp").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
