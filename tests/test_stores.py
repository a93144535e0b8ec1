"""Fetching from stored tables, tables in buckets, the crawl loop, the outbox, and state of streams."""

import datetime as dt
import http.server
import json
import os
import threading
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstream import schemas
from quillstream.operators import store
from quillstream.plans import crawl
from quillstream.sources import buckets, http as pages
from quillstream.streaming import events, sink

FEED = '<?xml version="1.0"?><rss><channel><item><title>T</title><link>{}</link><description>a long description of the post</description></item></channel></rss>'


@pytest.fixture
def server():
    """Answers every path with its own text, and 304 to those who know its ETag; ``asked`` has what came."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            known = self.headers.get("If-None-Match")
            asked.append((self.path, known))
            if self.path == "/missing":
                return self.send_error(404)
            body = ("x" * 5000 + "é") if self.path == "/long" else FEED.format("/post" + self.path) if self.path.endswith(".xml") else "page " + self.path
            if known == f'"{self.path}"':
                self.send_response(304)
                self.end_headers()
                return None
            self.send_response(200)
            self.send_header("ETag", f'"{self.path}"')
            self.end_headers()
            self.wfile.write(body.encode())
            return None

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.asked, s.url = asked, f"http://127.0.0.1:{s.server_port}"
    yield s
    s.shutdown()


URLS = "url string, etag string, last_modified string"


def test_a_table_of_urls_is_fetched_twice(spark, tmp_path, server):
    table = str(tmp_path / "urls")
    known = spark.createDataFrame([(f"{server.url}/{i}", None, None) for i in range(20)] + [(f"{server.url}/missing", '"m"', "old")], URLS)
    buckets.create(known, table, ["url"], 4)
    first = pages.fetch_table(spark, table, pertask="3").cache()
    assert {r.url: (r.status, r.body) for r in first.collect()} == {f"{server.url}/{i}": (200, f"page /{i}") for i in range(20)} | {f"{server.url}/missing": (404, None)}
    buckets.update(spark, table, pages.next_validators(buckets.read(spark, table), first), ["url"], buckets.replace_rows(["url"]), 4)
    first.unpersist()
    assert {r.etag for r in buckets.read(spark, table).collect()} == {f'"/{i}"' for i in range(20)} | {'"m"'}
    again = pages.classify(pages.fetch_table(spark, table, pertask="3"))
    assert {(r.status, r.unchanged) for r in again.filter("not url like '%missing'").collect()} == {(304, True)}
    assert buckets.read(spark, table).filter("last_modified = 'old'").count() == 1


def test_a_million_urls_are_planned_by_ranges(tmp_path):
    urls = pa.array([f"http://h{i % 1000}.example.org/{i}" for i in range(250_000)])
    for k in range(4):
        pq.write_table(pa.table({"url": urls}), tmp_path / f"part-{k}.parquet", row_group_size=60_000)
    reader = pages.PageReader({"path": str(tmp_path), "pertask": "1000"})
    planned = [p.value for p in reader.partitions()]
    assert sum(n for *_, n in planned) == 1_000_000 and len(planned) == 1000 and max(len(json.dumps(p)) for p in planned) < 300
    assert [u for u, _, _ in reader.fetcher.asked(planned[61])] == urls[61_000:62_000].to_pylist()


def test_a_stream_of_urls_goes_on_where_it_stopped(spark, tmp_path, server):
    spark.dataSource.register(pages.PageSource)
    folder, out = tmp_path / "urls", str(tmp_path / "out")
    folder.mkdir()

    def add(name, *paths):
        pq.write_table(pa.table({"url": [server.url + p for p in paths]}), tmp_path / name)
        os.rename(tmp_path / name, folder / f"{name}.parquet")
        time.sleep(0.02)

    def run():
        stream = spark.readStream.format("pages").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        q.stop()

    add("a", "/1", "/2")
    run()
    add("b", "/3")
    run()
    assert sorted(p for p, _ in server.asked) == ["/1", "/2", "/3"]
    assert sorted(r.body for r in spark.read.parquet(out).collect()) == ["page /1", "page /2", "page /3"]


def test_long_bodies_tell_their_length_or_come_in_pieces(spark, tmp_path, server):
    pq.write_table(pa.table({"url": [f"{server.url}/long"]}), tmp_path / "u.parquet")
    r = pages.fetch_table(spark, str(tmp_path), mostbytes="1000").first()
    assert (r.status, r.body, r.body_bytes) == (413, None, 5002)
    rows = pages.fetch_table(spark, str(tmp_path), mostbytes="1667", pieces="true").orderBy("piece").collect()
    assert "".join(r.body for r in rows) == "x" * 5000 + "é" and [r.piece for r in rows] == [0, 1, 2, 3]


def files(path):
    return {str(p.relative_to(path)): p.stat().st_ino for p in Path(path).rglob("*.parquet")}


def test_an_update_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "articles")
    wanted = schemas.schema("articles")
    old = spark.range(200).select("id", F.lit(1).alias("blog_id"), F.concat(F.lit("https://x/"), "id").alias("url"))
    buckets.create(store.with_missing_columns(old, "articles").select(*wanted.fieldNames()), path, ["url"], 16)
    before = files(path)
    given = spark.createDataFrame([(1, "https://x/5"), (2, "https://new/1"), (3, "https://new/1"), (4, ""), (5, None)], "seq long, url string")
    fresh = buckets.insert_if_new(spark, path, given, ["url"], "seq", 16)
    assert [(r.url, r.id) for r in fresh.collect()] == [("https://new/1", 200)]
    touched = {f"bucket={r[0]}" for r in fresh.select(buckets.bucket_of(["url"], 16)).collect()}
    after = files(path)
    assert {n.split("/")[0] for n in before.keys() ^ after.keys()} == touched and len(touched) == 1
    assert buckets.read(spark, path).count() == 201
    assert buckets.insert_if_new(spark, path, given, ["url"], "seq", 16).count() == 0 and files(path) == after


def test_latest_snapshots_are_kept_up_to_date(spark, tmp_path):
    path, rows = str(tmp_path / "latest"), []
    schema = "article_id long, id long, comment_count int, snapshot_at timestamp"
    buckets.create(spark.createDataFrame([], schema), path, ["article_id"], 8)
    for k in range(3):
        batch = [(i % 13, 100 * k + i, (i * 7 + k) % 5, dt.datetime(2025, 1, 1 + (i + k) % 3)) for i in range(40)]
        rows += batch
        for _ in range(2):  # a batch done again changes nothing
            buckets.merge_latest(spark, path, spark.createDataFrame(batch, schema), 8)
    whole = store.latest_snapshots(spark.createDataFrame(rows, schema)).select("article_id", "id", "comment_count")
    assert sorted(map(tuple, buckets.read(spark, path).select("article_id", "id", "comment_count").collect())) == sorted(map(tuple, whole.collect()))


def clock(spark, folder, hours):
    Path(folder).mkdir(exist_ok=True)
    for h in hours:
        name = Path(folder) / f"{h:03d}.json"
        if not name.exists():
            name.write_text(json.dumps({"timestamp": f"2025-01-01T{h:02d}:00:00Z"}))
            time.sleep(0.02)
    return spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).json(str(folder))


def tables(spark, base):
    shown = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return (
        shown(buckets.read(spark, f"{base}/articles"), "id", "blog_id", "url", "discovered_at"), shown(buckets.read(spark, f"{base}/blogs"), "id", "last_scraped_at", "error_count"),
        shown(crawl.cursor(spark, base), "*"), shown(sink.outbox(spark, f"{base}/outbox"), "client_id", "frame"),
    )


def test_a_broken_tick_is_done_again(spark, tmp_path):
    blogs = spark.createDataFrame([(i, f"https://b{i}.org", f"B{i}", "hexo", 2) for i in range(1, 6)], "id long, url string, name string, ssg string, error_count int")
    blogs = blogs.withColumn("languages", F.array(F.lit("zh")))
    clients = spark.createDataFrame([("c1", "zh"), ("c2", "en")], "client_id string, lang string")

    def fetch(spark, asked):
        return spark.read.parquet(asked).select("url", F.when(F.col("url").endswith("atom.xml"), 200).otherwise(404).alias("status"), F.lit(FEED.format("/p")).alias("body"))

    def run(name, fail_at=None):
        base, failed = str(tmp_path / name), []
        crawl.create(blogs, base, 4)

        def reached(number, step):
            if number == 1 and step == fail_at and len(failed) < 2:  # the second tick dies, and dies again when it is done again
                failed.append(step)
                raise RuntimeError("killed")

        for _ in range(4):
            q = crawl.crawl_loop(spark, base, f"{base}/state", clock(spark, f"{base}-clock", [1, 2, 3]), None, fetch=fetch, at_once=2, n=4, clients=clients, reached=reached)
            try:
                q.awaitTermination()
                break
            except Exception as e:  # noqa: BLE001
                assert "killed" in str(e)
        return tables(spark, base), len(failed)

    whole, _ = run("whole")
    assert len(whole[0]) == 5 and len(whole[3]) == 5 and "current_blog_id=5" in whole[2][0] and "is_running=False" in whole[2][0] and all("error_count=0" in r for r in whole[1])
    for step in ("blogs", "cursor"):
        got, failed = run(step, step)
        assert got == whole and failed == 2, step


def test_failed_frames_are_rows_and_none_is_sent_twice(spark, tmp_path):
    frames = spark.createDataFrame([(f"c{i % 5}", f"{i:03d}", f"data: {i}\n\n") for i in range(40)] + [(None, "x", "lost"), ("c1", "y", None)], "client_id string, key string, frame string")
    path, log = str(tmp_path / "out"), str(tmp_path / "sent")
    Path(log).mkdir()

    def send(client, key, frame, log=log):
        if client == "c3":
            raise OSError("gone")
        died = os.path.join(log, "died")
        if key == "021" and not os.path.exists(died):
            open(died, "w").close()
            raise SystemExit("the task dies")
        with open(os.path.join(log, client), "a") as f:
            f.write(key + "\n")

    with pytest.raises(Exception, match="the task dies|exited|failed"):
        sink.write_frames(frames, path, 7, send)
    assert not (tmp_path / "out" / "batch=7" / "_SUCCESS").exists()
    for _ in range(2):  # done again after the failure, and once more
        sink.write_frames(frames, path, 7, send)
    sent = sorted(k for p in Path(log).glob("c*") for k in p.read_text().split())
    assert sent == sorted(f"{i:03d}" for i in range(40) if i % 5 != 3)
    assert {(r.client_id, r.key, r.error.split(":")[0]) for r in sink.failures(spark, path).collect()} == {("c3", f"{i:03d}", "OSError") for i in range(3, 40, 5)} | {(None, "x", "no client"), ("c1", "y", "no frame")}
    assert sink.outbox(spark, path).count() == 42


def test_a_stream_of_frames(spark, tmp_path):
    spark.dataSource.register(sink.FrameSink)
    for k in range(2):
        spark.createDataFrame([(f"c{k}", str(k), "f")], "client_id string, key string, frame string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client_id string, key string, frame string").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("frames").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.batch, r.client_id) for r in sink.outbox(spark, str(tmp_path / "out")).collect()) == [(0, "c0"), (1, "c1")]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_counts_are_forgotten_after_their_time(spark, tmp_path, rocks):
    schema = "id long, article_id long, comment_count int, snapshot_at timestamp"
    at = dt.datetime(2025, 1, 1)

    def run(ttl, name, batches, wait):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            found = events.new_comments(spark.readStream.schema(schema).parquet(str(tmp_path / name / "in")), ttl)
            # as time passes state ends without new rows, so a query by a processing-time clock has always another batch; this runs one
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "state")).trigger(once=True).start(str(tmp_path / name / "out")).awaitTermination(60)
            if k == 0:
                time.sleep(wait)
        return sorted((r.id, r.article_id, r.comment_count, r.before) for r in spark.read.parquet(str(tmp_path / name / "out")).collect())

    batches = [[(1, 7, 3, at), (2, 7, 3, at + dt.timedelta(1)), (3, 7, 4, at + dt.timedelta(2)), (9, 8, None, at)], [(4, 7, 4, at + dt.timedelta(3)), (5, 8, 1, at)]]
    kept = [(1, 7, 3, None), (3, 7, 4, 3), (5, 8, 1, None)]
    assert run(3_600_000, "long", batches, 0) == kept
    assert run(1, "short", batches, 1) == sorted([*kept, (4, 7, 4, None)])  # forgotten: the same count is its first again


def test_clients_come_and_go(spark, tmp_path, rocks):
    schema = "client_id string, action string, lang string, type string, data string, languages array<string>, at long, key string"
    batches = [
        [("1", "add", "zh", None, None, None, 1, "a"), ("2", "add", None, None, None, None, 2, "b"), (None, None, None, "new_article", "A", ["en"], 3, "e1")],
        [("1", "remove", None, None, None, None, 4, "c"), ("3", "add", "en", None, None, None, 5, "d"), (None, None, None, "new_article", "B", ["en"], 6, "e2"), (None, None, None, "new_comment", "C", [], 7, "e3"), ("4", "add", None, None, None, None, 8, "f"), ("4", "remove", None, None, None, None, 9, "g")],
        [("3", "add", "zh", None, None, None, 10, "h"), ("9", "remove", None, None, None, None, 11, "i"), (None, None, None, "new_article", "D", ["en"], 12, "e4"), (None, None, None, "error", "E", ["xx"], 13, "e5"), (None, None, None, "new_comment", "F", None, 14, "e6")],
    ]
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        given = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = events.subscribed(given.filter("action is not null"), given.filter("type is not null"), 3)
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        every = spark.read.parquet(str(tmp_path / "out")).collect()
        got.append((sorted((r.client_id, r.key) for r in every if r.client_id), sum({r.shard: r.clients for r in every if r.type == "count"}.values())))
    assert got[0][0] == [("1", "a"), ("2", "b"), ("2", "e1")]
    assert sorted(set(got[1][0]) - set(got[0][0])) == [("2", "e2"), ("2", "e3"), ("3", "d"), ("3", "e2")]
    assert sorted(set(got[2][0]) - set(got[1][0])) == [("2", "e4"), ("2", "e5"), ("2", "e6"), ("3", "e5"), ("3", "e6")]
    last = spark.read.parquet(str(tmp_path / "out"))
    assert {r.frame for r in last.filter("type = 'connected'").collect()} == {": connected\n\n"} and last.filter("key = 'e2' and client_id = '3'").first().frame == "event: new_article\ndata: B\n\n"


def test_progress_from_metrics(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, i % 2 == 0, k) for i in range(4)], "id long, ok boolean, new_articles long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    told = []
    listener = events.progress_listener(12, told.append, "crawl")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long, ok boolean, new_articles long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        events.observed(stream).writeStream.queryName("crawl").format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if len(told) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [(r.processed, r.succeeded, r.failed) for r in told] == [(4, 2, 2), (8, 4, 4), (12, 6, 6)] and told[-1].new_total == 12 and told[-1].eta_s == 0
