"""Language-model scoring: prediction by partial matching over byte contexts, and a word unigram base.

The trie of byte contexts is counted over all training texts: every byte with its ORDER bytes of
history is one event, equal events are summed in each task and then by key. All shorter contexts
follow from the longest. Escapes use method C (a context that has seen q different bytes in n
events escapes with q / (n + q)), and a byte already refused in a longer context is excluded from
the shorter. Up to TRIE_NODES events the trie is broadcast whole, and each text's bytes are looked up
at once. Beyond that nothing is left out: events and contexts stay written tables, a head of the most
frequent events is broadcast with its chances from the full counts, and the other distinct events of
the texts are joined to the tables.

Base scores need every word's count: the HEAD most frequent words are broadcast, which takes
the hot keys away; the rest go through a join by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import row_of, save

ORDER = 3
#: Most events of ORDER + 1 bytes that are broadcast (some 20 bytes each where they are used).
TRIE_NODES = 1 << 21
#: Most frequent words that are broadcast.
HEAD = 1 << 16
#: The end of a text, counted as a token; no word is empty.
END = b""


def to_tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def events(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Event codes of the texts' lower-cased bytes (history in the high bytes) and each text's byte count."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]
    b = np.frombuffer(b"".join(bytes(ORDER) + r for r in raw), np.uint8).astype(np.uint32)
    code = np.zeros(len(b), np.uint32)
    for k in range(ORDER + 1):
        code[k:] |= b[: len(b) - k] << np.uint32(8 * k)
    own = np.ones(len(b), bool)
    starts = np.cumsum([0, *(len(r) + ORDER for r in raw)])[:-1]
    for k in range(ORDER):
        own[starts + k] = False
    return code[own], np.array([len(r) for r in raw], np.int64)


def count_events(train: DataFrame) -> DataFrame:
    """``code, n`` over all rows of ``train`` (column ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c, n = np.unique(events(b.column(0).slice(at, 1000).to_pylist())[0], return_counts=True)
                both, place = np.unique(np.concatenate([codes, c]), return_inverse=True)
                codes, counts = both, np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
                if len(codes) > TRIE_NODES:
                    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "n"])
                    codes, counts = codes[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["code", "n"])

    return train.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Chances:
    """A hash table of events' log10 probabilities."""

    def __init__(self, codes: np.ndarray, value: np.ndarray):
        bits = max(4, int(len(codes) * 3).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint32), np.full(1 << bits, np.nan, np.float64)
        slot, rest = self._slot(codes), np.arange(len(codes))
        while len(rest):
            free = np.isnan(self.values[slot[rest]])
            self.keys[slot[rest[free]]] = codes[rest[free]]
            self.values[slot[rest[free]]] = value[rest[free]]
            lost = self.keys[slot[rest]] != codes[rest]
            rest = rest[lost | np.isnan(self.values[slot[rest]])]
            slot[rest] = slot[rest] + 1 & self.mask

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435769) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """NaN for events that it doesn't hold."""
        slot = self._slot(codes)
        out = self.values[slot]
        rest = np.flatnonzero((self.keys[slot] != codes) & ~np.isnan(out))
        slot = slot[rest]
        while len(rest):
            slot = slot + 1 & self.mask
            out[rest] = self.values[slot]
            more = (self.keys[slot] != codes[rest]) & ~np.isnan(self.values[slot])
            rest, slot = rest[more], slot[more]
        return out


def look_up(keys: np.ndarray, wanted: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Each column's values at the sorted keys, 0 where a wanted one is missing."""
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in columns]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return [np.where(keys[at] == wanted, c[at], 0.0) for c in columns]


def escape_down(steps: Iterator[tuple], size: int) -> np.ndarray:
    """log10 P of events: escapes from the longest known context down to one that has seen the byte.

    A step, from ORDER bytes of context to none, holds of each event: its count there and the
    context's n, q and what its bytes hold in the next shorter context (all 0 where it is unknown).
    """
    total, open_, used = np.zeros(size), np.ones(size, bool), np.zeros(size)
    gone_n, gone_q = np.zeros(size), np.zeros(size)
    for count, n, q, left in steps:
        i = np.flatnonzero(open_ & (q > 0))
        left_n, left_q, hit = n[i] - gone_n[i], q[i] - gone_q[i], count[i] > 0
        room = np.maximum(left_n + left_q, 1e-12)
        total[i[hit]] += np.log10(count[i[hit]] / room[hit])
        open_[i[hit]] = False
        miss = ~hit & (left_q > 0)
        total[i[miss]] += np.log10(left_q[miss] / room[miss])
        gone_n[i], gone_q[i], used[i] = left[i], q[i], q[i]
    # a byte that no training text holds: all such bytes alike
    total[open_] += -np.log10(np.maximum(1, 256 - used[open_]))
    return total


class Trie:
    """Static PPM model of events of ``order`` bytes of history and one: a hash table of the seen, and the parts to work out the others."""

    rest: dict[str, DataFrame] | None = None

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.seen, self.context, self.left, self.order = [], [], [], order
        counts = counts.astype(np.float64)
        for size in range(order, -1, -1):  # from the longest context to none
            self.seen.append((codes, counts))
            above, place, q = np.unique(codes >> np.uint32(8), return_inverse=True, return_counts=True)
            self.context.append((above, np.bincount(place, counts, len(above)), q.astype(np.float64)))
            codes, place = np.unique(codes & np.uint32((1 << 8 * size) - 1), return_inverse=True)
            counts = np.bincount(place, counts, len(codes))
        for k in range(order):  # of each context: what its bytes hold in the next shorter one
            c, shorter = self.seen[k][0], self.seen[k + 1]
            n = shorter[1][np.searchsorted(shorter[0], c & np.uint32((1 << 8 * (order - k)) - 1))]
            self.left.append(np.bincount(np.searchsorted(self.context[k][0], c >> np.uint32(8)), n, len(self.context[k][0])))
        self.left.append(np.zeros(len(self.context[order][0])))
        self.chances = Chances(self.seen[0][0], self.work_out(self.seen[0][0])) if order == ORDER else None

    def steps(self, codes: np.ndarray) -> Iterator[tuple]:
        for k, (seen, (above, n, q), left) in enumerate(zip(self.seen, self.context, self.left)):
            size = 8 * (self.order - k)
            count = look_up(seen[0], codes & np.uint32((1 << size + 8) - 1), seen[1])
            yield (*count, *look_up(above, codes >> np.uint32(8) & np.uint32((1 << size) - 1), n, q, left))

    def work_out(self, codes: np.ndarray) -> np.ndarray:
        return escape_down(self.steps(codes), len(codes))

    def score(self, codes: np.ndarray) -> np.ndarray:
        out = self.chances.find(codes)
        rest = np.flatnonzero(np.isnan(out))
        c, place = np.unique(codes[rest], return_inverse=True)
        out[rest] = self.work_out(c)[place]
        return out


class Head:
    """The most frequent events of a model that is too large to broadcast: ``score`` is NaN for the others.

    Their chances are worked out from ``rest``, tables that stay where they are: ``events`` (code, n), ``contexts``
    (context, n, q, left) and ``shorter`` (short, m: events of two bytes of history). ``steps`` adds the contexts of
    two bytes and fewer, at most 65,536 of each.
    """

    def __init__(self, counted: DataFrame, nodes: int):
        byte = lambda c, n: F.col(c).bitwiseAND((1 << 8 * n) - 1)
        shorter = save(counted.groupBy(byte("code", ORDER).alias("short")).agg(F.sum("n").alias("m")))
        met = counted.select("code", "n", byte("code", ORDER).alias("short")).join(shorter, "short")
        contexts = save(met.groupBy(F.shiftright("code", 8).alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("q"), F.sum("m").alias("left")))
        self.rest = {"events": counted, "contexts": contexts, "shorter": shorter}
        pairs = save(shorter.groupBy(byte("short", ORDER - 1).alias("pair")).agg(F.sum("m").alias("l")))
        self.lower = Trie(*_sorted(pairs, "pair", "l"), order=ORDER - 2)
        two = shorter.select("short", "m", byte("short", ORDER - 1).alias("pair")).join(pairs, "pair")
        self.two = _sorted(two.groupBy(F.shiftright("short", 8).alias("context")).agg(F.sum("m").alias("n"), F.count("*").alias("q"), F.sum("l").alias("left")), "context", "n", "q", "left")
        head = most_frequent(counted, "n", nodes).withColumn("context", F.shiftright("code", 8))
        room = head.join(contexts.select("context", (F.col("n") + F.col("q")).alias("room")), "context")
        codes, n, room = _sorted(room, "code", "n", "room")
        self.seen, self.chances = [(codes, n)], Chances(codes, np.log10(n / room))

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "rest"}  # what the broadcast carries

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.chances.find(codes)

    def steps(self, codes: np.ndarray, given: list[np.ndarray]) -> Iterator[tuple]:
        """``given``: count, n, q, left of the longest context and the count in the next."""
        yield tuple(given[:4])
        yield (given[4], *look_up(self.two[0], codes >> np.uint32(8) & np.uint32((1 << 8 * (ORDER - 1)) - 1), *self.two[1:]))
        yield from self.lower.steps(codes)


def _sorted(found: DataFrame, *columns: str) -> list[np.ndarray]:
    """The columns of a table that is known to be small, by the first."""
    rows = found.select(*columns).toArrow()
    codes = rows[0].to_numpy().astype(np.uint32)
    order = np.argsort(codes)
    return [codes[order], *(c.to_numpy()[order].astype(np.float64) for c in rows.columns[1:])]


def work_out_rest(asked: DataFrame, head: Head, held) -> DataFrame:
    """``code, chance`` of distinct events (``code``); ``held`` is the broadcast whose second part is ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value[1]
        for b in batches:
            codes = b.column(0).to_numpy().astype(np.uint32)
            given = [b.column(i).to_numpy().astype(np.float64) for i in range(1, 6)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(escape_down(trie.steps(codes, given), len(codes)))], ["code", "chance"])

    asked = asked.select("code", F.shiftright("code", 8).alias("context"), F.col("code").bitwiseAND((1 << 8 * ORDER) - 1).alias("short"))
    events = head.rest["events"].withColumnRenamed("n", "count")
    met = asked.join(events, "code", "left").join(head.rest["contexts"], "context", "left").join(head.rest["shorter"], "short", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("count", "n", "q", "left", "m")]
    return save(met.select("code", *zero).mapInArrow(run, "code long, chance double"))


def most_frequent(counted: DataFrame, column: str, bound: int) -> DataFrame:
    """The rows of the largest counts, at most ``bound``: those above a step of an eighth of a power of 2."""
    step = F.floor(F.log2(column) * 8).cast("int")
    kept, least = 0, None
    for at, n in counted.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a few hundred steps
        kept += n
        if kept > bound:
            break
        least = at
    return counted.limit(0) if least is None else counted.filter(step >= least)


def train_trie(train: DataFrame, nodes: int = TRIE_NODES) -> Trie | Head:
    """Counts over all of ``train``: whole, or where more than ``nodes`` events are seen, the most frequent and the tables of the rest."""
    counted = save(count_events(train))
    return Head(counted, nodes) if counted.count() > nodes else Trie(*_sorted(counted, "code", "n"))


def count_tokens(train: DataFrame) -> DataFrame:
    """``token, c`` over all rows of ``train``; the end of a text is the empty token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                counts.update(to_tokens(text.as_py()))
                if len(counts) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "c"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "c"])

    return train.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def score_documents(docs: DataFrame, train: DataFrame, text_col: str = "text", head: int = HEAD, nodes: int = TRIE_NODES) -> DataFrame:
    """Per row of ``docs``: ``doc`` (the row as a struct), ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``train`` has the same text column. base_score sums log10((c+0.5)/(N+0.5*(V+1))) over the
    tokens; score is the trie's log10 probability of the text's lower-cased bytes (0 for an empty or null text).
    Without training rows every token is unknown and every byte has chance 1/256.
    """
    train = train.select(F.col(text_col).alias("text"))
    counts = save(count_tokens(train))
    n_all, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = {bytes(r["token"]): r["c"] for r in most_frequent(counts, "c", head).collect()}
    spark = docs.sparkSession
    trie = train_trie(train, nodes)
    held = spark.sparkContext.broadcast((known, trie))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, trie = held.value
        logs = {t: math.log10(c + 0.5) for t, c in known.items()}
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = part.column(1).to_pylist()
                out: list[list] = [[], [], [], [], []]
                for text in texts:
                    tokens = Counter(to_tokens(text))
                    common = [(logs[t], n) for t, n in tokens.items() if t in logs]
                    tail = {t: n for t, n in tokens.items() if t not in logs}
                    row = (sum(tokens.values()), sum(n for _, n in common), math.fsum(x * n for x, n in common), list(tail), list(tail.values()))
                    for column, x in zip(out, row):
                        column.append(x)
                codes, sizes = events(texts)
                chances = trie.score(codes)
                gone = np.flatnonzero(np.isnan(chances))
                chances[gone] = 0
                sums = np.concatenate([[0.0], np.cumsum(chances)])
                ends = np.cumsum(sizes)
                score = sums[ends] - sums[ends - sizes]
                place = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)[gone]
                asked, times = np.unique(place << 32 | codes[gone], return_counts=True)
                bounds = pa.array(np.searchsorted(asked >> 32, np.arange(len(texts) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (asked & 0xFFFFFFFF, times.astype(np.int64))]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, t) for x, t in zip(out, kinds)), pa.array(score), *lists],
                    ["doc", "n_tokens", "n_known", "logs", "tail", "times", "score", "codes", "code_times"],
                )

    whole = docs.select(row_of(docs).alias("doc")).withColumn("text", F.col(f"doc.`{text_col}`"))
    schema = T.StructType(
        [whole.schema["doc"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("logs", T.DoubleType()),
         T.StructField("tail", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType())), T.StructField("score", T.DoubleType()),
         T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("code_times", T.ArrayType(T.LongType()))]
    )
    scored = save(whole.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("tail").alias("token"), F.col("times").alias("times"))).alias("x")).select("row", "x.token", "x.times")
    met = rare.join(counts.select("token", "c"), "token", "left")
    by_row = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times")).alias("rare_logs")
    )
    base = math.log10(n_all + 0.5 * (vocabulary + 1))
    joined = scored.drop("tail", "times", "codes", "code_times").join(by_row, "row", "left").withColumn("rest", F.lit(0.0))
    if trie.rest:
        events_of = scored.select("row", F.explode(F.arrays_zip(F.col("codes").alias("code"), F.col("code_times").alias("times"))).alias("x")).select("row", "x.code", "x.times")
        chances = work_out_rest(events_of.select("code").distinct(), trie, held)
        rest = events_of.join(chances, "code").groupBy("row").agg(F.sum(F.col("chance") * F.col("times")).alias("rest"))
        joined = joined.drop("rest").join(rest, "row", "left")
    return joined.select(
        "doc", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
