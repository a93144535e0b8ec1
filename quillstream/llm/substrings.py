"""Substring dedup with prefix-partitioned suffix trees.

A *window* is ``run`` consecutive words. What decides is the longest word sequence that a suffix of
a document shares with a document of a smaller id: the depth of the deepest node above the suffix's
leaf that holds a smaller id. All words of that sequence go.

Not every suffix is needed. A repeat that can't be prolonged to its left starts at a window whose
occurrences have different words before them; suffixes that start elsewhere lie inside such a
repeat. So two screens over all documents look at the windows first:

1. The anchor of a window is its k-gram of least hash. Windows whose anchor occurs in one document
   only are dropped.
2. The anchor widened to the left or right inside the window is its key. Windows whose key occurs in
   one document only are dropped. A key whose occurrences have different words on their left (or are
   near a text's start) is a *start*; so is one in CUT, whatever its words, which bounds the distance
   between starts. All this depends on the words of a window alone, so equal windows fare alike.

Windows that stay form stretches. The suffixes that go to the trees begin at start windows and reach
to the next start, or to the end of their stretch: no repeat goes beyond a stretch, and one that
goes beyond a start goes on from there. Starts in a row are shipped with one text. Equal texts of
several documents are shipped once, with the least id.

The leaves are dealt by their first words: by the shortest of the PREFIXES that at most GROUP leaves
share. Each group is sorted, which is its subtree's order, and the subtree's internal nodes of ``run``
words or more, however deep, give the longest repeat of every leaf. Leaves beyond the last prefix
(more than GROUP that share a whole window) are a part of the tree too large for a task; there each
window counts as one node at depth ``run``, aggregated and joined over all tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import row_key, save

#: Leaves that one subtree may hold in memory.
GROUP = 20_000
#: Prefix lengths tried, in words, before a whole window's.
PREFIXES = (2, 4, 8)
#: One key in so many is a start whatever stands before it; and one in so many ends a row of starts that share a suffix.
CUT, SHARE = 1024, 4
#: Starts that share a suffix at most.
MOST = 32
#: Bloom filters of shared keys: bits for each key, bytes of a shard and of all shards at most. Beyond that keys are joined.
KEY_BITS, SHARD_BYTES, BLOOM_BYTES = 16, 1 << 16, 1 << 26
#: Hot prefixes that are broadcast at most.
BROADCAST_ROWS = 100_000
NULL_ID = (1 << 63) - 1
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
#: Text bytes, and words, that are worked on at once.
CHUNK, SPAN = 1 << 20, 1 << 18
IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers 0..CHUNK of an odd number modulo 2 ** 64, and those of its inverse."""
    if not _powers or len(_powers[0]) <= CHUNK:
        _powers.clear()
        for base in (int(ODD), pow(int(ODD), -1, 1 << 64)):
            x = np.full(CHUNK + 1, base, np.uint64)
            x[0] = 1
            _powers.append(np.multiply.accumulate(x))
    return _powers


def mixed(g: np.ndarray) -> np.ndarray:
    g = g ^ g >> np.uint64(31)
    g *= ODD2
    return g ^ g >> np.uint64(29)


def tokens(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``data`` starts, and its hash; CHUNK bytes at a time. A word of CHUNK bytes or more is hashed alone."""
    whole, starts, hashes, at = np.frombuffer(data, np.uint8), [], [], 0
    up, down = powers()
    while at < len(whole):
        block = whole[at : at + CHUNK]
        space = IS_SPACE[block]
        gaps = np.flatnonzero(space)
        if len(block) == CHUNK and not len(gaps):
            end = at + CHUNK
            while end < len(whole) and not len(gaps := np.flatnonzero(IS_SPACE[whole[end : end + CHUNK]])):
                end += CHUNK
            end = end + int(gaps[0]) if len(gaps) else len(whole)
            starts.append(np.array([at]))
            hashes.append(np.array([xxhash.xxh64_intdigest(data[at:end], 3)], np.uint64))
            at = end
            continue
        if at + len(block) < len(whole):
            block, space = block[: gaps[-1] + 1], space[: gaps[-1] + 1]
        before, after = np.ones(len(block), bool), np.ones(len(block), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((block.astype(np.uint64) + np.uint64(1)) * up[: len(block)])])
        h = (sums[end] - sums[start]) * down[start]
        h ^= h >> np.uint64(29)
        h *= ODD2
        starts.append(start + at)
        hashes.append(h ^ h >> np.uint64(32))
        at += len(block)
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Words:
    """Words of some texts: ``start`` in ``data``, ``hash``, the ``text`` they are of, and each text's ``first`` and last + 1."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        self.start, self.hash = tokens(self.data)
        self.text = np.searchsorted(bounds, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.start = np.append(self.start, len(self.data))

    def grams(self, at: np.ndarray, k: int) -> np.ndarray:
        g = np.zeros(len(at), np.uint64)
        for j in range(k):
            g = g * ODD + self.hash[at + j]
        return mixed(g)

    def between(self, a: list[int], b: list[int]) -> list[bytes]:
        """Words a to b - 1 of each pair, joined by one space."""
        return [b" ".join(self.data[x:y].split()) for x, y in zip(self.start[a].tolist(), self.start[b].tolist())]


def batches_of_texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of about CHUNK bytes of text (a longer text alone) and their words."""
    for b in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + CHUNK, "right")))
            part = b.slice(at, end - at)
            yield part, Words([x or b"" for x in part.column(column).cast(pa.large_binary()).to_pylist()])
            at = end


def least_grams(words: Words, a: int, b: int, run: int, k: int) -> tuple[np.ndarray, ...]:
    """Of the windows that start at words a..b-1 inside one text, by equal anchors: the anchors' places, first windows, how many, and keys."""
    n, reach = b - a, run - k
    h = words.hash[a : b + run - 1]
    g = np.zeros(n + reach, np.uint64)
    for j in range(k):
        g = g * ODD + h[j : j + n + reach]
    g = mixed(g)
    least = g[:n].copy()
    for j in range(1, reach + 1):
        np.minimum(least, g[j : j + n], out=least)
    at = np.zeros(n, np.int64)
    for j in range(reach, -1, -1):
        at[g[j : j + n] == least] = j
    whole = np.flatnonzero(words.text[a:b] == words.text[a + run - 1 : b + run - 1])
    place = whole + at[whole]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    return place[new] + a, whole[new] + a, np.diff(np.append(new, len(place))), mixed(g[place[new]] * ODD)


class Units:
    """Consecutive windows with one key: ``first`` window (word), how ``many``, ``key``, and a hash of the words ``before`` (0: near the text's start)."""

    def __init__(self, words: Words, run: int, k: int, held: np.ndarray | None):
        wide, parts = (run - k) // 2, []
        for a in range(0, max(0, len(words.hash) - run + 1), SPAN):
            place, first, many, key = least_grams(words, a, min(a + SPAN, len(words.hash) - run + 1), run, k)
            if held is not None:
                on = maybe_in(held, key)
                place, first, many = place[on], first[on], many[on]
            left = np.clip(place - wide - first + 1, 0, many)  # windows that hold the anchor and `wide` words on its left
            both = lambda x, y: np.stack([x, y], 1).ravel()
            at, first, many, tag = both(place - wide, place), both(first, first + left), both(left, many - left), both(np.ones(len(place), np.uint64), np.full(len(place), 2, np.uint64))
            on = many > 0
            parts.append((at[on], first[on], many[on], tag[on]))
        at, self.first, self.many, tag = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
        self.words, self.key = words, words.grams(at, k + wide) * ODD + tag.astype(np.uint64)
        reach = run - k - wide + 1
        inside = at - reach >= words.first[words.text[self.first]]
        self.before = np.zeros(len(at), np.uint64)
        self.before[inside] = words.grams(at[inside] - reach, reach) | np.uint64(1)


def _anchor_keys(run: int, k: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in batches_of_texts(batches, 2):
            ids = part.column(0)
            for a in range(0, max(0, len(words.hash) - run + 1), SPAN):
                _, first, _, key = least_grams(words, a, min(a + SPAN, len(words.hash) - run + 1), run, k)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), ids.take(pa.array(words.text[first]))], ["key", "id"])

    return go


def _unit_keys(run: int, k: int, held, placed: bool = False):
    """Keys of the windows that pass the first screen; ``placed``: with their row and first window in the text."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in batches_of_texts(batches, 2):
            u = Units(words, run, k, held and held.value)
            text = words.text[u.first]
            rest = [part.column(1).take(pa.array(text)), pa.array(u.first - words.first[text])] if placed else [part.column(0).take(pa.array(text)), pa.array(u.before.view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(u.key.view(np.int64)), *rest], ["key", "row", "first"] if placed else ["key", "id", "before"])

    return go


def _bits(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard of each key and its two bits there."""
    keys = keys.view(np.uint64)
    size = np.uint64(SHARD_BYTES * 8 - 1)
    return (keys >> np.uint64(40)) % np.uint64(shards), keys & size, keys >> np.uint64(19) & size


def bloom(keys: DataFrame, n: int) -> np.ndarray:
    """Sharded Bloom filter of the ``n`` longs ``key``, built on the executors."""
    shards = max(1, -(-n * KEY_BITS // (SHARD_BYTES * 8)))

    def build(pdf):
        _, a, b = _bits(pdf["key"].to_numpy(), shards)
        on = np.zeros(SHARD_BYTES * 8, np.uint8)
        on[a.astype(np.int64)] = on[b.astype(np.int64)] = 1
        return pdf.head(1)[["shard"]].assign(bits=[np.packbits(on, bitorder="little").tobytes()])

    shard = F.pmod(F.shiftrightunsigned("key", 40), F.lit(shards)).alias("shard")
    built = keys.select(shard, "key").groupBy("shard").applyInPandas(build, "shard long, bits binary").collect()
    whole = np.zeros((shards, SHARD_BYTES), np.uint8)
    for shard, bits in built:
        whole[shard] = np.frombuffer(bits, np.uint8)
    return whole


def maybe_in(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    shard, a, b = _bits(keys, len(whole))
    on = lambda bit: whole[shard.astype(np.int64), (bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
    return (on(a) & on(b)).astype(bool)


def fits(n: int) -> bool:
    return n * KEY_BITS // 8 <= BLOOM_BYTES


def suffixes_of(u: Units, starts: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes at the start windows: the first word, how many start windows follow on it, and the word after the last.

    Start windows in a row share a suffix, MOST of them at most, and fewer where one in SHARE keys begins another.
    """
    own = np.flatnonzero(starts)
    if not len(own):
        return own, own, own
    after = np.concatenate([[False], u.first[1:] == (u.first + u.many)[:-1]])
    stretch = np.cumsum(~after)
    first, many = u.first[own], u.many[own]
    chained = np.concatenate([[False], (np.diff(own) == 1) & after[own[1:]]]) & (u.key[own] % np.uint64(SHARE) != 0)
    chain = np.cumsum(~chained) - 1
    place = (first - first[~chained][chain]) // MOST
    chained[1:] &= place[1:] == place[:-1]
    new = np.flatnonzero(~chained)
    last = np.append(new[1:], len(own)) - 1
    a, windows = first[new], first[last] + many[last] - first[new]
    end = np.searchsorted(stretch, stretch[own[new]], "right") - 1
    end = u.first[end] + u.many[end] - 1 + run
    on = np.flatnonzero(stretch[own[new[1:]]] == stretch[own[new[:-1]]])
    end[on] = a[on + 1] + run - 1
    return a, windows, end


def _suffixes(run: int, k: int, held, wide, diverse):
    """Suffixes at starts: ``row, id, start`` (word), ``many`` (start windows from there on), ``n`` (words), ``text``.

    ``wide`` and ``diverse`` are filters of shared keys and of starts; without them the columns
    ``firsts`` and ``diverse`` name the text's windows that stay.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in batches_of_texts(batches, 2):
            u = Units(words, run, k, held and held.value)
            if wide is not None:
                on = maybe_in(wide.value, u.key)
                starts = maybe_in(diverse.value, u.key)
            else:
                given, flags = part.column(3), part.column(4)
                base = np.repeat(words.first[:-1], given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                found = given.flatten().to_numpy(zero_copy_only=False) + base
                order = np.argsort(found, kind="stable")
                at = np.minimum(np.searchsorted(found[order], u.first), max(0, len(found) - 1))
                on = found[order][at] == u.first if len(found) else np.zeros(len(u.first), bool)
                starts = flags.flatten().to_numpy(zero_copy_only=False)[order][at] & on if len(found) else on
            starts |= u.key % np.uint64(CUT) == 0
            u.first, u.many, u.key, starts = u.first[on], u.many[on], u.key[on], starts[on]
            a, many, b = suffixes_of(u, starts, run)
            text = words.text[a]
            for i in range(0, len(a), 5000):
                part_of = slice(i, i + 5000)
                t = pa.array(text[part_of])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1).take(t), part.column(0).take(t), pa.array((a - words.first[text])[part_of].astype(np.int32)), pa.array(many[part_of].astype(np.int32)),
                        pa.array((b - a)[part_of].astype(np.int32)), pa.array(words.between(a[part_of], b[part_of]), pa.binary()),
                    ],
                    ["row", "id", "start", "many", "n", "text"],
                )

    return go


def _prefixes(run: int, with_text: bool):
    """Leaves of distinct suffixes (``rec, least, many, text``): ``rec, j``, hashes of their first words and, if wanted, ``least`` and the leaf's own text."""
    lengths = [*PREFIXES, run]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in batches_of_texts(batches, 3):
            many = part.column(2).to_numpy()
            text = np.repeat(np.arange(part.num_rows), many)
            j = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            at = words.first[text] + j
            for i in range(0, len(at), 20_000):
                own, t = at[i : i + 20_000], pa.array(text[i : i + 20_000])
                columns = [part.column(0).take(t), pa.array(j[i : i + 20_000].astype(np.int32)), *(pa.array(words.grams(own, m).view(np.int64)) for m in lengths)]
                names = ["rec", "j", *(f"p{m}" for m in lengths)]
                if with_text:
                    ends = words.start[words.first[text[i : i + 20_000] + 1]]
                    # texts are joined by a byte that is white space, so each leaf ends with one, too
                    leaves = [words.data[x:y].rstrip(b"\n") + b" " for x, y in zip(words.start[own].tolist(), ends.tolist())]
                    columns += [part.column(1).take(t), pa.array(j[i : i + 20_000] == many[text[i : i + 20_000]] - 1), pa.array(leaves, pa.binary())]
                    names += ["least", "last", "leaf"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return go


def shared_words(a: bytes, b: bytes) -> int:
    """Words that two leaves share from their start: the depth at which their paths part. Each word ends with a space."""
    n = min(len(a), len(b))
    parted = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return a.count(b" ", 0, n - (parted.bit_length() + 7) // 8)


def longest_repeats(leaves: list[bytes], ids: list, run: int) -> Iterator[tuple[int, int]]:
    """``(leaf, depth)`` for sorted leaves: the deepest internal node of ``run`` words or more that holds a smaller id than the leaf's.

    Nodes close from the deepest up. A closed node keeps its least id and the leaves that have it: all its other
    leaves met a smaller id in it or below it.
    """
    open_nodes: list[list] = []
    for i, leaf in enumerate(leaves):
        depth = shared_words(leaf, leaves[i + 1]) if i + 1 < len(leaves) else 0
        low, waiting = ids[i], [i]
        while open_nodes and open_nodes[-1][0] >= max(depth, run):
            level, other, others = open_nodes[-1]
            if other < low:
                low, waiting, gone = other, others, waiting
            elif low < other:
                gone = others
            else:
                gone = []
                if len(others) > len(waiting):
                    waiting, others = others, waiting
                waiting.extend(others)
            yield from ((x, level) for x in gone)
            if level == depth:
                open_nodes[-1][1:] = low, waiting
                break
            open_nodes.pop()
        else:
            if depth >= run:
                open_nodes.append([depth, low, waiting])


def _trees(run: int):
    """``rec, j, depth`` of the leaves with a repeat, from rows ``group, window, rec, j, least, leaf`` sorted by group and leaf.

    Of a group's subtree only what lies under nodes of ``run`` words is worked on: leaves with the same first ``run`` words.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(rows: pa.Table) -> pa.RecordBatch:
            group, window = rows[0].to_numpy(), rows[1].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (window[1:] != window[:-1]), [True]]))
            found: list[tuple[int, int]] = []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if z - a > 1:
                    leaves, ids = rows["leaf"].slice(a, z - a).to_pylist(), rows["least"].slice(a, z - a).to_pylist()
                    found += ((a + i, depth) for i, depth in longest_repeats(leaves, ids, run))
            at = pa.array([i for i, _ in found], pa.int64())
            picked = rows.select(["rec", "j"]).take(at).combine_chunks()
            depth = pa.array([d for _, d in found], pa.int32())
            return pa.RecordBatch.from_arrays([*(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in picked.columns), depth], ["rec", "j", "depth"])

        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            group, window = rows[0].to_numpy(), rows[1].to_numpy()
            same = (group == group[-1]) & (window == window[-1])
            last = len(same) if not same.all() else 0
            last = int(np.flatnonzero(~same)[-1]) + 1 if last else 0
            if last:
                yield nodes(rows.slice(0, last))
            held = rows.slice(last).combine_chunks()
        if held is not None:
            yield nodes(held)

    return go


def _windows(run: int):
    """The window at a leaf's start, and of the last start in a text all that follow: ``rec, j, least, window``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in batches_of_texts(batches, 3):
            many = np.where(part.column(4).to_numpy(zero_copy_only=False), np.maximum(1, np.diff(words.first) - run + 1), 1)
            text = np.repeat(np.arange(part.num_rows), many)
            at = words.first[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
            j = at - words.first[text] + part.column(1).to_numpy()[text]
            for i in range(0, len(at), 20_000):
                own, t = at[i : i + 20_000], pa.array(text[i : i + 20_000])
                yield pa.RecordBatch.from_arrays([part.column(0).take(t), pa.array(j[i : i + 20_000].astype(np.int32)), part.column(2).take(t), pa.array(words.between(own, own + run), pa.binary())], ["rec", "j", "least", "window"])

    return go


def small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def repeats_of(records: DataFrame, run: int) -> DataFrame:
    """``rec, j, depth`` of distinct suffixes (``rec, least, many, text``): the longest repeat from word j on that a smaller id has too."""
    lengths, kind = [*PREFIXES, run], records.schema["least"].dataType.simpleString()
    columns = ", ".join(["rec binary", "j int", *(f"p{m} long" for m in lengths)])
    sizes = save(records.select("rec", "least", "many", "text").mapInArrow(_prefixes(run, False), columns).groupBy(*(f"p{m}" for m in lengths)).count())
    leaves = records.select("rec", "least", "many", "text").mapInArrow(_prefixes(run, True), f"{columns}, least {kind}, last boolean, leaf binary")
    group, fit = F.lit(None).cast("long"), []
    for m in lengths:
        hot = save(sizes.groupBy(f"p{m}").agg(F.sum("count").alias("n")).filter(F.col("n") > GROUP).select(f"p{m}", F.lit(True).alias(f"hot{m}")))
        n = hot.count()
        fit.append((m, hot, n))
        if not n:  # nothing is left for longer prefixes
            break
        sizes = sizes.join(small(hot, n), f"p{m}", "left_semi")
    for m, hot, n in fit:
        leaves = leaves.join(small(hot, n), f"p{m}", "left") if n else leaves.withColumn(f"hot{m}", F.lit(None).cast("boolean"))
    group = F.coalesce(*(F.when(F.col(f"hot{m}").isNull(), F.xxhash64(F.lit(m), f"p{m}")) for m, _, _ in fit))
    leaves = leaves.select(group.alias("group"), F.col(f"p{run}").alias("window"), "rec", "j", "least", "last", "leaf")
    dealt = leaves.filter("group is not null").drop("last").repartition("group").sortWithinPartitions("group", "leaf")
    found = dealt.mapInArrow(_trees(run), "rec binary, j int, depth int")
    if fit[-1][0] == run and fit[-1][2]:
        wide = save(leaves.filter("group is null").select("rec", "j", "least", "leaf", "last").mapInArrow(_windows(run), f"rec binary, j int, least {kind}, window binary"))
        low = save(wide.groupBy("window").agg(F.min("least").alias("low")))
        found = found.unionAll(wide.join(low, "window").filter("low < least").select("rec", "j", F.lit(run).alias("depth")))
    return found


def repeated_spans(docs: DataFrame, run: int = 13, k: int = 5) -> DataFrame:
    """``row, spans``: for each row key, the stretches of words (``start``, ``n``) that a smaller id has too.

    ``docs``: columns ``id`` (no nulls), ``row`` (its key) and ``text``.
    """
    spark, texts = docs.sparkSession, docs.select("id", "row", "text")
    kind, row = docs.schema["id"].dataType.simpleString(), docs.schema["row"].dataType.simpleString()
    seen = texts.mapInArrow(_anchor_keys(run, k), f"key long, id {kind}")
    anchors = save(seen.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key"))
    n = anchors.count()
    held = spark.sparkContext.broadcast(bloom(anchors, n)) if fits(n) else None
    met = texts.mapInArrow(_unit_keys(run, k, held), f"key long, id {kind}, before long").groupBy("key")
    met = met.agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("before").alias("low"), F.max("before").alias("high")).filter("a < b")
    keys = save(met.select("key", F.expr("low <> high or low = 0").alias("diverse")))
    n = keys.count()
    made = f"row {row}, id {kind}, start int, many int, n int, text binary"
    if fits(n):
        starts = keys.filter("diverse")
        filters = [spark.sparkContext.broadcast(bloom(x, c)) for x, c in ((keys, n), (starts, starts.count()))]
        found = texts.mapInArrow(_suffixes(run, k, held, *filters), made)
    else:
        placed = texts.mapInArrow(_unit_keys(run, k, held, True), f"key long, row {row}, first long").join(keys, "key")
        by_row = placed.groupBy("row").agg(F.collect_list(F.struct("first", "diverse")).alias("w")).select("row", F.col("w.first").alias("firsts"), F.col("w.diverse").alias("diverse"))
        found = texts.join(by_row, "row").select("id", "row", "text", "firsts", "diverse").mapInArrow(_suffixes(run, k, held, None, None), made)
    members = save(found.withColumn("rec", F.unhex(F.md5("text"))))
    records = save(members.groupBy("text").agg(F.min("id").alias("least"), F.max("many").alias("many"), F.max("n").alias("n")).withColumn("rec", F.unhex(F.md5("text"))))
    nodes = repeats_of(records, run).groupBy("rec").agg(F.collect_list(F.struct("j", "depth")).alias("found"))
    # written, so that the join below has plain shuffles on both sides, which can be split where a suffix is frequent
    known = save(records.select("rec", "least", "n").join(nodes, "rec", "left"))
    placed = members.select("rec", "row", "id", "start").distinct().join(known, "rec").filter("found is not null or least < id")
    whole = F.array(F.struct(F.col("start"), F.col("n")))
    spans = F.when(F.col("least") < F.col("id"), whole).otherwise(F.transform("found", lambda x: F.struct((F.col("start") + x["j"]).alias("start"), x["depth"].alias("n"))))
    return placed.select("row", spans.alias("spans")).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about CHUNK bytes, cut where white space begins."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            gap = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]").search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def cut(text: str | None, spans: list[dict] | None, layout: bool = False) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by one space, or (layout) by the white space before each."""
    raw = (text or "").encode("utf-8", "replace")
    if not spans:
        return sum(len(p.split()) for p in pieces(raw)), 0, raw if layout else b" ".join(b" ".join(p.split()) for p in pieces(raw) if p.split())
    end = max(s["start"] + s["n"] for s in spans)
    gone = np.zeros(end, bool)
    for s in spans:
        gone[s["start"] : s["start"] + s["n"]] = True
    n, kept = 0, []
    for p in pieces(raw):
        words = re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", p) if layout else p.split()
        own = gone[n : n + len(words)].tolist()
        kept += [w for w, g in zip(words, own) if not g] + words[len(own) :]
        n += len(words)
    return n, int(gone.sum()), (b"" if layout else b" ").join(kept)


def remove_repeats(docs: DataFrame, run: int = 13, k: int = 5, id_col: str = "doc_id", text_col: str = "text", layout: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Cut every run of ``run`` words that also starts in a document with a smaller id.

    Returns ``doc`` (a struct of the row's columns, or of ``carry`` alone, so that no name clashes), ``n_words``,
    ``n_removed`` and ``kept`` (the words that stay, joined by one space; with ``layout`` the text
    with the other words cut out and its white space otherwise as it was). Runs are judged on the
    input. Ids are whole numbers or strings (by their characters). Null and short texts lose
    nothing (a null one stays null); a null id sorts after all others; rows that repeat an id count as one document and
    each return; a text may lose all its words.
    """
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    if isinstance(docs.schema[id_col].dataType, T.StringType):
        id_ = F.coalesce(F.concat(F.lit("0"), own), F.lit("1"))
    else:
        id_ = F.coalesce(own.cast("long"), F.lit(NULL_ID))
    columns = docs.columns if carry is None else carry
    keyed = docs.select(id_.alias("id"), row_key(id_, text).alias("row"), text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("doc"))
    spans = repeated_spans(keyed.select("id", "row", "text"), run, k)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                done = [cut(t.as_py(), s.as_py(), layout) for t, s in zip(part.column(1), part.column(2))]
                n, gone, kept = zip(*done)
                kept = [k if t.is_valid else None for k, t in zip(kept, part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])

    joined = keyed.join(spans, "row", "left").select("doc", "text", "spans")
    schema = T.StructType([joined.schema["doc"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(go, schema)


def remove_sql(run: int = 13) -> str:
    """DuckDB SQL of the figures of ``remove_repeats`` over ``documents``."""
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, w, unnest(range(len(w) - {run} + 1)) AS p FROM d WHERE len(w) >= {run}), g AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {run}], ' ') AS g FROM s),
        low AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS first FROM g), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {run})) AS i FROM low WHERE first < doc_id),
        spread AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM spread ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""
