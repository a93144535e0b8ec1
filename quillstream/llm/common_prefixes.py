"""Suffix-array dedup with an interval tree of common prefixes, over bytes.

What decides is the longest byte string that a suffix shares with an earlier one: the depth of the deepest interval
above it, in the tree of common-prefix intervals of the suffix array, that holds an earlier place. Intervals whose places differ in the byte before
them can't be prolonged to the left: these are the maximal repeats.

Not every suffix is needed. A maximal repeat begins at a *start*: a window of ``run`` bytes whose places have different bytes
before them. All its places are starts. Three screens, each over all documents, find them:

1. A window's anchor is its ``k``-gram of least hash. Windows whose anchor occurs once are dropped; those that stay form stretches.
2. A window's near anchor is the least gram of GRAM bytes among its first ones. Windows stay if the bytes from the near anchor on, which all its
   windows have, occur with different bytes before the near anchor.
3. The windows themselves are counted, with the byte before them.

All this depends on the bytes of a window alone, so equal windows fare alike. One window in CUT is a start in any case, which
bounds what lies between two. A suffix reaches from a start to the next one, or to the end of its stretch: no repeat goes
beyond a stretch, and one that goes beyond a start goes on from there. Equal suffixes are one, with the earliest place.

Suffixes are dealt by their first window and sorted by their bytes, which is the order of the suffix array; one scan with a stack, which holds
one place for each open interval, closes the intervals of ``run`` bytes or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import row_key, save
from quillstream.llm.substrings import CHUNK, NULL_ID, bloom, fits, maybe_in, mixed, powers

#: Bytes of a near anchor.
GRAM = 16
#: One window in so many is a start whatever stands before it.
CUT = 4096
#: Windows that are worked on at once, and bytes before the first that are looked at.
SPAN, LEFT = 1 << 19, 64
#: Rows that a task holds to add them up before it hands them on.
HELD = 1 << 20
#: Suffixes with one first window that a scan takes; the windows of others are counted one by one.
GROUP = 1_000_000
#: Stands for what is before a text's first byte.
NONE = -(1 << 63)
PLACE = np.uint64((1 << 20) - 1)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done, size = values, 1
    while size * 2 <= width:
        done, size = np.minimum(done[:-size], done[size:]), size * 2
    return np.minimum(done[: len(done) - (width - size)], done[width - size :]) if width > size else done


class Chunk:
    """Windows of some texts: ``at`` in ``data``, the ``text`` they are of, and ``place`` there."""

    def __init__(self, parts: list[tuple[int, int, bytes, int, int]]):
        self.data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        up, self.down = powers()
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)])])
        base = np.cumsum([0, *(len(p[2]) for p in parts)])[:-1]
        many = np.array([p[4] for p in parts])
        own = np.repeat(np.arange(len(parts)), many)
        self.at = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + (base + [p[3] for p in parts])[own]
        self.text, self.shift = np.array([p[0] for p in parts])[own], np.array([p[1] for p in parts] - base)[own]
        self.place = self.at + self.shift

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        return mixed((self.sums[at + k] - self.sums[at]) * self.down[at])

    def anchors(self, at: np.ndarray, k: int, width: int) -> np.ndarray:
        """Where the least of the ``width`` k-grams from ``at`` on lies; the first of several."""
        every = np.arange(len(self.data) - k + 1)
        packed = (self.grams(every, k) & ~PLACE) | every.astype(np.uint64)
        return (least(packed, width)[at] & PLACE).astype(np.int64)


def chunks(items: list[tuple[int, int, bytes]], run: int) -> Iterator[Chunk]:
    """Windows of some items: where an item's bytes lie in its text, its first window in these bytes, and the bytes."""
    parts, size = [], 0
    for i, (low, first, data) in enumerate(items):
        for a in range(first, len(data) - run + 1, SPAN):
            b, lo = min(a + SPAN, len(data) - run + 1), max(0, a - LEFT)
            part = i, low + lo, data[lo : b + run - 1], a - lo, b - a
            if size + len(part[2]) > CHUNK:
                yield Chunk(parts)
                parts, size = [], 0
            parts.append(part)
            size += len(part[2])
    if parts:
        yield Chunk(parts)


class Screens:
    """The windows that pass the screens so far. A screen is a broadcast filter of keys, or None where places are given (``marks``, by item).

    The first screen is for windows of whole texts, the others are for those of stretches.
    """

    def __init__(self, run: int, k: int, filters: list):
        self.run, self.k, self.filters = run, k, filters

    def on(self, level: int, key: np.ndarray, text: np.ndarray, place: np.ndarray, marks: list) -> np.ndarray:
        if self.filters[level] is not None:
            return maybe_in(self.filters[level].value, key)
        code = lambda t, p: np.asarray(t, np.int64) << 40 | np.asarray(p, np.int64)
        known = [code(i, own) for i, own in enumerate(marks[level]) if len(own)]
        return np.isin(code(text, place), np.concatenate(known)) if known else np.zeros(len(key), bool)

    def anchors(self, c: Chunk):
        """``key, low, high, text, place`` of the anchors; and which anchor each window has."""
        found = c.anchors(c.at, self.k, self.run - self.k + 1)
        new = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
        key = c.grams(found[new], self.k)
        zero = np.zeros(len(key), np.int64)
        return (key, zero, zero, c.text[new], found[new] + c.shift[new]), np.cumsum(new) - 1

    def near_anchors(self, c: Chunk):
        """The same of the near anchors; low and high tell the bytes before them."""
        found = c.anchors(c.at, GRAM, GRAM + 1)
        new = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
        at, place = found[new], found[new] + c.shift[new]
        before, inside = np.full(len(at), NONE, np.int64), place > GRAM
        before[inside] = c.grams(at[inside] - GRAM - 1, GRAM + 1).view(np.int64) | 1
        return (c.grams(at, self.run - GRAM), before, before, c.text[new], place), np.cumsum(new) - 1

    def windows(self, c: Chunk, on: np.ndarray):
        """The same of windows; low and high are the byte before."""
        at, place = c.at[on], c.place[on]
        before = np.where(place > 0, c.data[at - 1].astype(np.int64), NONE)
        return c.grams(at, self.run), before, before, c.text[on], place

    def keys(self, c: Chunk, marks: list):
        """``key, low, high, text, place`` of what the next screen looks up."""
        if not self.filters:
            return self.anchors(c)[0]
        near, of = self.near_anchors(c)
        return near if len(self.filters) == 1 else self.windows(c, self.on(1, near[0], *near[3:], marks)[of])


def items_of(batches: Iterator[pa.RecordBatch], n_marks: int) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Slices of about SPAN bytes (longer items alone), their items and marks. Columns: id, row, text, low, first, marks."""
    for b in batches:
        at, low, first = 0, b.column(3).to_pylist(), b.column(4).to_pylist()
        while at < b.num_rows:
            items, size, end = [], 0, at
            while end < b.num_rows and (not items or size < SPAN):
                data = b.column(2)[end].as_py() or b""
                items.append((low[end], first[end], data))
                size += len(data)
                end += 1
            part = b.slice(at, end - at)
            yield part, items, [[x if x is not None else [] for x in part.column(5 + i).to_pylist()] for i in range(n_marks)]
            at = end


def _summed(parts: list[tuple]) -> pa.RecordBatch:
    """``key, low, high, n``: one row for each key."""
    key, low, high, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, low, high, n = key[order], low[order], high[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    if len(new):
        low, high, n = np.minimum.reduceat(low, new), np.maximum.reduceat(high, new), np.add.reduceat(n, new)
    return pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(low), pa.array(high), pa.array(n)], ["key", "low", "high", "n"])


def _keys(screens: Screens, n_marks: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, items, marks in items_of(batches, n_marks):
            for c in chunks(items, screens.run):
                key, low, high, *_ = screens.keys(c, marks)
                held.append((key, low, high, np.ones(len(key), np.int64)))
                size += len(key)
                if size > HELD:
                    yield _summed(held)
                    held, size = [], 0
        if held:
            yield _summed(held)

    return go


def _places(screens: Screens, n_marks: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, items, marks in items_of(batches, n_marks):
            for c in chunks(items, screens.run):
                key, _, _, text, place = screens.keys(c, marks)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(1).take(pa.array(text)), pa.array(place)], ["key", "row", "place"])

    return go


def _stretches(screens: Screens, n_marks: int):
    """Stretches of texts: ``id, row, text, low, first`` with some bytes before the first window."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = screens.run
        for part, items, marks in items_of(batches, n_marks):
            found = []
            for c in chunks(items, run):
                keys, of = screens.anchors(c)
                on = screens.on(0, keys[0], *keys[3:], marks)[of]
                found.append((c.text[on], c.place[on]))
            text, place = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            if not len(text):
                continue
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (text[1:] != text[:-1])]))
            a, b, own = place[new], place[np.append(new[1:], len(place)) - 1] + run, text[new]
            low = np.maximum(0, a - LEFT)
            cut = [items[t][2][x:y] for t, x, y in zip(own.tolist(), low.tolist(), b.tolist())]
            t = pa.array(own)
            yield pa.RecordBatch.from_arrays([part.column(0).take(t), part.column(1).take(t), pa.array(cut, pa.binary()), pa.array(low), pa.array(a - low)], ["id", "row", "text", "low", "first"])

    return go


def _suffixes(screens: Screens, n_marks: int):
    """Suffixes of stretches: ``row, id, start, n, before, piece`` (a 128-bit hash), and once for each task and piece its first ``window`` and ``text``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for part, items, marks in items_of(batches, n_marks):
            found = []
            for c in chunks(items, screens.run):
                near, of = screens.near_anchors(c)
                rows = screens.windows(c, slice(None))
                starts = screens.on(1, near[0], *near[3:], marks)[of]
                starts[starts] = screens.on(2, rows[0][starts], rows[3][starts], rows[4][starts], marks)
                found.append((*rows, starts | (rows[0] % np.uint64(CUT) == 0)))
            if not found:
                continue
            key, before, _, text, place, starts = (np.concatenate(x) for x in zip(*found))
            starts = np.flatnonzero(starts)
            last = np.searchsorted(text, text[starts], "right") - 1
            after = np.append(starts[1:], len(key))
            ends = np.where(after <= last, place[np.minimum(after, len(key) - 1)] - 1, place[last]) + screens.run
            if len(told) > HELD:
                told.clear()
            for a in range(0, len(starts), 5000):
                own, end = starts[a : a + 5000], ends[a : a + 5000]
                cut = [items[t][2][x - items[t][0] : y - items[t][0]] for t, x, y in zip(text[own].tolist(), place[own].tolist(), end.tolist())]
                names = [xxhash.xxh3_128_digest(x) for x in cut]
                shown = []
                for name, x in zip(names, cut):
                    shown.append(None if name in told else x)
                    told.add(name)
                t = pa.array(text[own])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(t), part.column(0).take(t), pa.array(place[own]), pa.array(end - place[own]), pa.array(before[own]), pa.array(names, pa.binary()),
                        pa.array(key[own].view(np.int64)), pa.array(shown, pa.binary()),
                    ],
                    ["row", "id", "start", "n", "before", "piece", "window", "text"],
                )

    return go


def shared(a: bytes, b: bytes) -> int:
    """Bytes that two suffixes share from their start."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class Scan:
    """The stack of open intervals over sorted suffixes, one after the other. An open interval holds its earliest suffix alone, as all others have met an earlier one.

    ``reach`` gets ``(name, depth)`` of a suffix once it meets an earlier place: the depth of the deepest interval that holds one.
    ``intervals`` gets ``(depth, first, last, diverse)`` of each closed interval, by the suffixes' ranks; diverse: different bytes stand before its places.
    """

    def __init__(self, run: int):
        self.run, self.open, self.rank, self.text, self.alone = run, [], -1, b"", None
        self.reach: list[tuple[bytes, int]] = []
        self.intervals: list[tuple[int, int, int, bool]] = []

    def _merge(self, node: list, child: list) -> None:
        (depth, _, best, low, high), (_, _, other, lo, hi) = node, child
        kept, gone = (best, other) if best[0] < other[0] else (other, best)
        self.reach.append((gone[1], depth))
        node[2:] = kept, min(low, lo), max(high, hi)

    def _until(self, depth: int) -> None:
        """The suffix added last shares ``depth`` bytes with the next one."""
        child = self.alone
        while child and self.open and self.open[-1][0] > depth:
            node = self.open.pop()
            self._merge(node, child)
            self.intervals.append((node[0], node[1], self.rank, node[3] != node[4] or node[3] == NONE))
            child = node
        if child and depth >= self.run:
            if self.open and self.open[-1][0] == depth:
                self._merge(self.open[-1], child)
            else:
                self.open.append([depth, *child[1:]])

    def add(self, text: bytes, place: tuple, name: bytes, low: int, high: int) -> None:
        self._until(shared(self.text, text))
        self.rank += 1
        self.text, self.alone = text, [len(text), self.rank, (place, name), low, high]

    def end(self) -> None:
        self._until(0)
        self.text, self.alone = b"", None


def _scan(run: int):
    """Of rows ``window, text, first, piece, low, high`` sorted by window and text: ``piece, depth`` of what meets an earlier place; each suffix's
    ``piece, part, rank``; and each interval's ``depth, part, first, last, diverse``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, scan, window = TaskContext.get().partitionId(), Scan(run), None

        def told(ranks: list[tuple[bytes, int]]) -> pa.RecordBatch:
            reach, spans = scan.reach, scan.intervals
            scan.reach, scan.intervals = [], []
            a, b, c = len(reach), len(ranks), len(spans)
            columns = [
                ([x for x, _ in reach] + [x for x, _ in ranks] + [None] * c, pa.binary()), ([d for _, d in reach] + [None] * b + [x[0] for x in spans], pa.int64()), ([None] * a + [part] * (b + c), pa.int64()),
                ([None] * a + [r for _, r in ranks] + [None] * c, pa.int64()), ([None] * (a + b) + [x[1] for x in spans], pa.int64()), ([None] * (a + b) + [x[2] for x in spans], pa.int64()), ([None] * (a + b) + [x[3] for x in spans], pa.bool_()),
            ]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in columns], ["piece", "depth", "part", "rank", "first", "last", "diverse"])

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                rows, ranks = b.slice(at, 2000).to_pylist(), []
                for r in rows:
                    if r["window"] != window:
                        scan.end()
                        window = r["window"]
                    scan.add(r["text"], tuple(r["first"].values()), r["piece"], r["low"], r["high"])
                    ranks.append((r["piece"], scan.rank))
                yield told(ranks)
        scan.end()
        yield told([])

    return go


def _windows(run: int):
    """All windows of suffixes ``piece, first, text``: ``piece, j, place, window`` (128 bits); ``place`` as ``first``, for the window."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for at in range(0, len(r["text"]) - run + 1, 20_000):
                    js = range(at, min(at + 20_000, len(r["text"]) - run + 1))
                    places = [r["first"] | {"start": r["first"]["start"] + j} for j in js]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["piece"]] * len(js), pa.binary()), pa.array(js, pa.int64()), pa.array(places, b.schema.field("first").type), pa.array([xxhash.xxh3_128_digest(r["text"][j : j + run]) for j in js], pa.binary())],
                        ["piece", "j", "place", "window"],
                    )

    return go


def _screen(items: DataFrame, screens: Screens) -> DataFrame:
    """Adds a screen over ``items``. Where its keys are too many to broadcast, the items get a column of the places that pass."""
    level, spark = len(screens.filters), items.sparkSession
    found = items.mapInArrow(_keys(screens, len(items.columns) - 5), "key long, low long, high long, n long")
    keys = found.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).filter("n > 1")
    keys = save((keys.filter(f"low <> high or low = {NONE}") if level else keys).select("key"))
    n = keys.count()
    if fits(n):
        screens.filters.append(spark.sparkContext.broadcast(bloom(keys, n)))
        return items.withColumn(f"m{level}", F.lit(None).cast("array<long>"))
    placed = items.mapInArrow(_places(screens, len(items.columns) - 5), f"key long, row {items.schema['row'].dataType.simpleString()}, place long").join(keys, "key", "left_semi")
    marked = items.join(placed.groupBy("row").agg(F.collect_set("place").alias(f"m{level}")), "row", "left")
    screens.filters.append(None)
    return save(marked.select(*items.columns, f"m{level}"))


def suffixes(texts: DataFrame, run: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Members (each suffix at its place: ``row, id, start, n, piece``) and distinct pieces (``piece, window, n, text, first, low, high``); both written. ``texts``: ``id, row, text``."""
    screens, kind = Screens(run, k, []), {c: texts.schema[c].dataType.simpleString() for c in ("id", "row")}
    whole = _screen(texts.select("id", "row", "text", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("first")), screens)
    stretches = save(whole.mapInArrow(_stretches(screens, 1), f"id {kind['id']}, row {kind['row']}, text binary, low long, first long")).withColumn("m0", F.lit(None).cast("array<long>"))
    for _ in range(2):
        stretches = _screen(stretches, screens)
    found = save(stretches.mapInArrow(_suffixes(screens, 3), f"row {kind['row']}, id {kind['id']}, start long, n long, before long, piece binary, window long, text binary"))
    place = F.struct("id", "row", "start")
    pieces = found.groupBy("piece").agg(F.max("window").alias("window"), F.max("n").alias("n"), F.max("text").alias("text"), F.min(place).alias("first"), F.min("before").alias("low"), F.max("before").alias("high"))
    return found.select("row", "id", "start", "n", "piece"), save(pieces)


def tree(pieces: DataFrame, run: int) -> DataFrame:
    """What ``_scan`` gives for the pieces, sorted by their bytes within their first window; written."""
    dealt = pieces.select("window", "text", "first", "piece", "low", "high").repartition("window").sortWithinPartitions("window", "text")
    return save(dealt.mapInArrow(_scan(run), "piece binary, depth long, part long, rank long, first long, last long, diverse boolean"))


def repeat_groups(docs: DataFrame, run: int = 100, k: int = 48, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats with all their places: ``repeat`` (a number), ``n_bytes``, ``diverse``, ``id``, ``start``.

    Each interval of the suffix array of ``run`` bytes or more is a group. ``diverse``: its places have different bytes before them (or stand where a text begins), so that it
    can't be prolonged to the left; other groups go on from a group that begins earlier. A repeat that holds a start is told up to ``run`` - 1
    bytes after it and goes on in that start's group.
    """
    members, pieces = suffixes(_keyed(docs, id_col, text_col, [])[0], run, k)
    found = tree(pieces, run)
    spans = found.filter("first is not null").select("part", "first", "last", "depth", "diverse", F.monotonically_increasing_id().alias("repeat"))
    ranks = found.filter("rank is not null").select("part", "rank", "piece")
    met = spans.withColumn("rank", F.explode(F.sequence("first", "last"))).join(ranks, ["part", "rank"]).join(members, "piece")
    return met.select("repeat", F.col("depth").alias("n_bytes"), "diverse", "id", "start")


def repeated_spans(texts: DataFrame, run: int, k: int) -> DataFrame:
    """``row, spans``: for each row key the stretches of bytes (``start``, ``n``) that an earlier place has too."""
    members, pieces = suffixes(texts, run, k)
    many = save(pieces.groupBy("window").count().filter(F.col("count") > GROUP).select("window"))
    reach = tree(pieces.join(many, "window", "left_anti"), run).filter("depth is not null and part is null").select("piece", F.lit(0).cast("long").alias("j"), "depth")
    if many.count():
        kind = pieces.schema["first"].dataType.simpleString()
        wide = save(pieces.join(many, "window", "left_semi").select("piece", "first", "text").mapInArrow(_windows(run), f"piece binary, j long, place {kind}, window binary"))
        low = save(wide.groupBy("window").agg(F.min("place").alias("least")))
        reach = reach.unionAll(wide.join(low, "window").filter("least < place").select("piece", "j", F.lit(run).cast("long").alias("depth")))
    nodes = reach.groupBy("piece").agg(F.collect_list(F.struct("j", "depth")).alias("found"))
    # written, so that the join below has plain shuffles on both sides, which can be split where a suffix is frequent
    known = save(pieces.select("piece", "first").join(nodes, "piece", "left"))
    earliest = F.struct("id", "row", "start") == F.col("first")
    whole = F.array(F.struct(F.col("start"), F.col("n")))
    part = F.transform("found", lambda x: F.struct((F.col("start") + x["j"]).alias("start"), x["depth"].alias("n")))
    placed = members.join(known, "piece").withColumn("spans", F.when(earliest, part).otherwise(whole)).filter("spans is not null")
    return placed.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut(data: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what is left."""
    gone, runs, kept, at = 0, 0, [], -1
    for a, b in sorted((s["start"], s["start"] + s["n"]) for s in spans):
        if a > at:
            kept.append(data[max(at, 0) : a])
            gone, runs, at = gone + b - a, runs + 1, b
        elif b > at:
            gone, at = gone + b - at, b
    return gone, runs, b"".join([*kept, data[max(at, 0) :]])


def _keyed(docs: DataFrame, id_col: str, text_col: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    if isinstance(docs.schema[id_col].dataType, T.StringType):
        id_ = F.coalesce(F.concat(F.lit("0"), own), F.lit("1"))
    else:
        id_ = F.coalesce(own.cast("long"), F.lit(NULL_ID))
    keyed = docs.select(id_.alias("id"), row_key(id_, text).alias("row"), text.cast("binary").alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    return keyed.select("id", "row", "text"), keyed.select("row", "text", "doc")


def remove_repeats(docs: DataFrame, run: int = 100, k: int = 48, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Cut every byte inside a string of ``run`` bytes that also starts earlier: in a text of a smaller id, or before in the same text.

    Returns ``doc`` (a struct of the row's columns, or of ``carry`` alone, so that no name clashes), ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs
    of removed bytes) and ``kept`` (the bytes that stay, in one piece; a character may lose some of its bytes). Strings are judged on the input. A null text
    has no bytes, and ``kept`` is null; shorter texts lose nothing. Ids are whole numbers or strings; a null id sorts after all others. Texts that share an id go by a hash
    of the text; rows that repeat id and text count as one and return alike. No rows give none.
    """
    if not 2 * GRAM < run or not GRAM <= k <= run - GRAM:
        raise ValueError("run is more than twice GRAM, and k between GRAM and run - GRAM")
    texts, whole = _keyed(docs, id_col, text_col, docs.columns if carry is None else carry)
    spans = repeated_spans(texts, run, k)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts, found = part.column(1).to_pylist(), part.column(2).to_pylist()
                done = [cut(t or b"", s or []) for t, s in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                        pa.array([None if t is None else d[2] for t, d in zip(texts, done)], pa.binary()),
                    ],
                    ["doc", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    joined = whole.join(spans, "row", "left").select("doc", "text", "spans")
    schema = T.StructType([joined.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(go, schema)


def remove_sql(run: int = 100) -> str:
    """DuckDB SQL of the figures of ``remove_repeats`` over ``documents``; bytes are pairs of hexadecimal digits."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), s AS (SELECT doc_id, h, unnest(range(len(h) // 2 - {run} + 1)) AS p FROM d WHERE len(h) >= {2 * run}),
        w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, {2 * run})) AS g FROM s), gone AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
        i AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p), {run + 1}) > {run} AS new FROM gone), j AS (SELECT doc_id, p, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
        r AS (SELECT doc_id, min(p) AS a, max(p) + {run} AS b FROM j GROUP BY doc_id, k), q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
        f AS (SELECT doc_id, sum(b - a) AS n, count(*) AS m, max(b) AS z, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS t FROM q JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t || substr(h, 2 * z + 1), h))) AS kept_sha256 FROM d LEFT JOIN f USING (doc_id)"""
