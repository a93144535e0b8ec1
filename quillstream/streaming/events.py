"""Change streams: typed events, language fan-out, frames, deduplicated articles and changed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.streaming import sink

# fixed values: events that no language filter holds back
UNFILTERED = ["indexer_progress", "error"]
CONNECTED = ": connected\n\n"


def frame(kind: Column, data: Column) -> Column:
    """A server-sent event."""
    return F.concat(F.lit("event: "), kind, F.lit("\ndata: "), data, F.lit("\n\n"))


def batch_frame(fields: list[Column]) -> Column:
    """A frame without event name whose JSON holds its type."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*fields)), F.lit("\n\n"))


#: Clients that are broadcast at most.
BROADCAST_CLIENTS = 100_000


def _by_key(events: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Every event under each key that it is delivered by: one of its own where no filter holds it back, else its languages' keys and that of the clients without one."""
    langs = F.coalesce("languages", F.array().cast("array<string>"))
    filtered = ~F.col("type").isin(UNFILTERED) & F.col("languages").isNotNull()
    keys = F.when(filtered, F.concat(F.transform(F.array_distinct(langs), lambda x: F.concat(F.lit("lang:"), x)), F.array(F.lit("any")))).otherwise(F.array(F.lit("all")))
    return events.select(*columns, F.explode(keys).alias("__key"))


def _wanted(clients: DataFrame) -> DataFrame:
    """``client_id`` and the keys that a client asks for; no event has two of them."""
    own = F.when(F.col("lang").isNull(), "any").otherwise(F.concat(F.lit("lang:"), "lang"))
    return clients.select("client_id", F.explode(F.array(own, F.lit("all"))).alias("__key"))


def fan_out(events: DataFrame, clients: DataFrame, columns: tuple[str, ...] = ("type", "data")) -> DataFrame:
    """One row per client and event it gets: ``client_id`` and the event's ``columns``. ``events``: ``type, data, languages``; ``clients``: ``client_id, lang`` (null: all).

    Events without a filter (no list of languages, or a kind that none holds back) have a key of their own that every client asks for;
    filtered ones have their languages' keys and one for the clients without a language, who alone get an event whose
    list is empty. No pair is made that isn't delivered.
    """
    wants = _wanted(clients)
    if clients.count() <= BROADCAST_CLIENTS:
        wants = F.broadcast(wants)
    return _by_key(events, columns).join(wants, "__key").select("client_id", *columns)


def fan_out_totals(events: DataFrame, clients: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """``client_id, type, n`` and the ``sums`` of the events' columns, over all events of a type that a client gets: what grouping ``fan_out`` gives.

    Each event goes out under its keys, and is totalled there; a client's totals are those of its two keys. So work
    grows with the events and with the clients, and not with the pairs of both.
    """
    per = _by_key(events, ("type", *sums)).groupBy("__key", "type").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sums))
    added = [F.sum(c).alias(c) for c in ("n", *sums)]
    return per.join(_wanted(clients), "__key").groupBy("client_id", "type").agg(*added)


def fan_out_counts(events: DataFrame, clients: DataFrame) -> DataFrame:
    """``client_id, type, n``: how many events of each type a client gets."""
    return fan_out_totals(events, clients)


def progress_updates(done: DataFrame) -> DataFrame:
    """A stream of finished blogs (``ok, new_articles``) as running totals: one row a micro-batch in complete mode."""
    return done.groupBy().agg(F.count("*").alias("processed"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("new_articles"), F.lit(0)).alias("new_total"))


def with_hooks(stream: DataFrame, hooks: dict[str, Callable[[DataFrame, int], None]], interval: str | None = None):
    """Run user functions on each micro-batch's rows of their type (``*``: all rows); one that fails doesn't stop the others. Returns the query."""

    def each(batch: DataFrame, number: int) -> None:
        for kind, hook in hooks.items():
            try:
                hook(batch if kind == "*" else batch.filter(F.col("type") == kind), number)
            except Exception as e:  # noqa: BLE001
                print(f"hook {kind} failed on batch {number}: {e}")

    writer = stream.writeStream.foreachBatch(each)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def new_articles(articles: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Each url once. With ``(column, delay)`` its state is dropped after the delay; without, state grows with the urls."""
    if watermark:
        return articles.withWatermark(*watermark).dropDuplicatesWithinWatermark(["url"])
    return articles.dropDuplicates(["url"])


CHANGES = "article_id long, id long, comment_count int, before int, snapshot_at timestamp"


def _changes(article, rows: Iterator[pd.DataFrame], last: int | None) -> tuple[pd.DataFrame, int | None]:
    """An article's rows that change its count, by time and id, with the count before; and the last count."""
    found = pd.concat(list(rows)).sort_values(["snapshot_at", "id"]).astype({"comment_count": "Int32"})
    found = found[found["comment_count"].notna()]
    before = found["comment_count"].shift(1)
    if len(found):
        before.iloc[0] = pd.NA if last is None else last
        last = int(found["comment_count"].iloc[-1])
    found = found.assign(article_id=article, before=before)[before.isna() | (before != found["comment_count"]).fillna(True)]
    return found[["article_id", "id", "comment_count", "before", "snapshot_at"]], last


def _with_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    found, last = _changes(key[0], batches, state.get[0] if state.exists else None)
    if last is not None:
        state.update((last,))
    yield found


class LastCount(StatefulProcessor):
    """The last count of an article, for ``ttl`` after it was last seen."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last int", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        found, last = _changes(key[0], rows, held[0] if held else None)
        if last is not None:
            self.last.update((last,))
        yield found

    def close(self) -> None:
        pass


def new_comments(snapshots: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Snapshots that change an article's count, as its rows arrive; state is one number an article. Rows without a count are left out.

    Without ``ttl_ms`` it is kept for ever. With it, an article of which nothing came for so long is forgotten, so that its next snapshot counts as its first;
    the session then needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = snapshots.select("id", "article_id", F.col("comment_count").cast("int"), F.col("snapshot_at").cast("timestamp"))
    grouped = rows.groupBy("article_id")
    if ttl_ms is None:
        return grouped.applyInPandasWithState(_with_state, CHANGES, "last int", "append", GroupStateTimeout.NoTimeout)
    return grouped.transformWithStateInPandas(LastCount(ttl_ms), CHANGES, "Append", "ProcessingTime")


#: Groups that the clients' registry is kept in; each batch of events goes to all of them.
SHARDS = 16
SUBSCRIBED = "shard int, client_id string, key string, type string, frame string, clients long"


class Registry(StatefulProcessor):
    """The clients of a shard, with their languages."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.langs = handle.getMapState("clients", "client_id string", "lang string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["at", "key"], kind="stable")
        events, came = given[given["kind"] == "event"], []
        for r in given[given["kind"] != "event"].itertuples():
            here = self.langs.containsKey((r.client_id,))
            if r.kind == "add":
                self.langs.updateValue((r.client_id,), (None if pd.isna(r.lang) else r.lang,))
                came += [] if here else [(r.client_id, r.key)]
            elif here:
                self.langs.removeKey((r.client_id,))
        held = [(k[0], v[0]) for k, v in self.langs.iterator()]
        clients = pd.DataFrame({"client_id": [c for c, _ in held], "lang": [x for _, x in held]}, dtype=object)
        there = set(clients["client_id"])
        parts = [pd.DataFrame({"client_id": [c for c, _ in came if c in there], "key": [k for c, k in came if c in there], "type": "connected", "frame": CONNECTED}, dtype=object)]
        for e in events.itertuples():
            wanted = clients if e.type in UNFILTERED or e.languages is None else clients[clients["lang"].isna() | clients["lang"].isin(list(e.languages))]
            parts.append(pd.DataFrame({"client_id": wanted["client_id"], "key": e.key, "type": e.type, "frame": f"event: {e.type}\ndata: {e.data}\n\n"}, dtype=object))
        parts.append(pd.DataFrame({"client_id": [None], "key": [None], "type": ["count"], "frame": [None], "clients": [len(clients)]}, dtype=object))
        out = pd.concat(parts, ignore_index=True).assign(shard=int(key[0]))
        yield out[["shard", "client_id", "key", "type", "frame", "clients"]].astype({"clients": "Int64"})

    def close(self) -> None:
        pass


def subscribed(changes: DataFrame, events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Streams of clients that come and go, and of events, as the frames of those who are there: ``shard, client_id, key, type, frame, clients``.

    ``changes``: ``client_id, action`` (add or remove), ``lang`` (null: all), ``at`` (their order), ``key``. ``events``: ``key, type, data, languages, at``. The registry is
    state: a client's shard follows from its id, and each event goes to all shards. In a micro-batch the changes come first. A client who came and is still there at its end gets the initial frame
    (``type`` is connected); adding one who is there changes the language only, removing one who isn't does nothing. Each shard with rows tells how many clients it has (``type`` is count). Needs the RocksDB state store.
    """
    client = F.col("client_id").cast("string")
    own = changes.filter("client_id is not null").select(
        F.pmod(F.xxhash64(client), F.lit(shards)).cast("int").alias("shard"), F.col("action").alias("kind"), client.alias("client_id"), "lang", F.col("key").cast("string").alias("key"),
        F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("data"), F.lit(None).cast("array<string>").alias("languages"), F.col("at").cast("long").alias("at"),
    )
    each = events.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit("event").alias("kind"), F.lit(None).cast("string").alias("client_id"), F.lit(None).cast("string").alias("lang"),
        F.col("key").cast("string").alias("key"), "type", "data", "languages", F.col("at").cast("long").alias("at"),
    )
    return own.union(each).groupBy("shard").transformWithStateInPandas(Registry(), SUBSCRIBED, "Append", "None")


def deliver(stream: DataFrame, clients: DataFrame, path: str, send: Callable[[str, str, str], None] | None = None, interval: str | None = None, checkpoint: str | None = None):
    """Fan each batch's events (``type, data, languages, key``) out to the clients, into the outbox ``path`` and, where given, to ``send(client, key, frame)`` on the executors.

    A client that fails doesn't stop the others: its frames are rows with their error (``sink.failures``). A batch done again after a failure sends nothing twice.
    Returns the query (stop() cancels).
    """

    def each(batch: DataFrame, number: int) -> None:
        found = fan_out(batch, clients, ("type", "data", "key")).select("client_id", "key", frame(F.col("type"), F.col("data")).alias("frame"))
        sink.write_frames(found, path, number, send)

    stream.sparkSession.dataSource.register(sink.FrameSink)
    writer = stream.writeStream.foreachBatch(each)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def progress_listener(total: int, tell: Callable[[Row], None], name: str | None = None):
    """A listener that gives running totals of a stream of finished blogs after each batch, from its metrics alone; no batch is read again.

    The stream has to observe ``finished`` (see ``observed``). ``tell`` gets a row ``processed, succeeded, failed, new_total, elapsed_s, eta_s``. With ``name`` other queries of the session are left out.
    """
    from time import monotonic

    from pyspark.sql.streaming import StreamingQueryListener

    class Totals(StreamingQueryListener):
        def __init__(self):
            self.began, self.sums = monotonic(), {"processed": 0, "succeeded": 0, "new_total": 0}

        def onQueryStarted(self, event) -> None:
            if name is None or event.name == name:
                self.began = monotonic()

        def onQueryProgress(self, event) -> None:
            seen = event.progress.observedMetrics.get("finished")
            if seen is None or (name is not None and event.progress.name != name):
                return
            for k in self.sums:
                self.sums[k] += seen[k] or 0
            done, elapsed = self.sums["processed"], monotonic() - self.began
            left = round((total - done) * elapsed / done) if done else None
            tell(Row(**self.sums, failed=done - self.sums["succeeded"], elapsed_s=elapsed, eta_s=left))

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    return Totals()


def observed(done: DataFrame) -> DataFrame:
    """A stream of finished blogs (``ok, new_articles``) whose batches tell their totals to a ``progress_listener``."""
    return done.observe("finished", F.count(F.lit(1)).alias("processed"), F.count_if("ok").alias("succeeded"), F.coalesce(F.sum("new_articles"), F.lit(0)).alias("new_total"))
