"""SimHash near-duplicates, found by anchor points of a covering code.

A 64-bit fingerprint is cut into ``blocks`` equal blocks. Two fingerprints that differ in at most
``threshold`` bits differ in at most ``threshold // blocks`` bits of some block. Each block is a
point of {0,1}^w; the anchors are the words of a perfect Hamming code on its first w-1 bits, with
the last bit free, whose covering radius is 1. A fingerprint is replicated to every anchor within
the radius plus the block's share of the threshold, so a close pair always meets at the anchor
nearest to one of the two, where it is compared.

A document may have several fingerprints. Some are searched: two documents meet if one of these is
within the threshold. Others prove: documents that meet link if these, all together, are within a
second threshold, which is a sharper measure of similarity than one fingerprint's bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import save
from quillstream.llm.components import components

RADIUS = 1
#: Rows of one anchor that are compared in one piece; more are dealt into blocks of this size.
PIECE = 2048
#: So many large anchors or fewer are sent to all tasks.
BROADCAST_ANCHORS = 100_000


SEED = 42


def sums(text: str | None, shapes: tuple[tuple[int, int], ...]) -> list[int]:
    """For each shape (k, n): n SimHashes of the k-word shingles (repeats included), as unsigned 64-bit numbers.

    The first is of the shingles' XXH64 under SEED, the others of numbers mixed from it.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return [0] * sum(n for _, n in shapes)
    joined, out = b" ".join(words), []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    for k, n in shapes:
        size = max(1, len(words) - k + 1)
        stops = ends[min(k, len(words)) - 1 :]
        ones = np.zeros((n, 64), np.int64)
        for at in range(0, size, 65536):
            shingles = [joined[a:b] for a, b in zip(starts[at : min(size, at + 65536)].tolist(), stops[at : at + 65536].tolist())]
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(shingles))
            for row in ones:
                row += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                hashes = mixed(hashes)
        out += [int(np.packbits(row * 2 > size, bitorder="little").view("<u8")[0]) for row in ones]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Other numbers, one for each, with bits that tell nothing of theirs."""
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def fingerprint(text: str | None, k: int) -> int:
    return sums(text, ((k, 1),))[0]


def fingerprints(docs: DataFrame, shapes: tuple[tuple[int, int], ...] = ((3, 1),), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, f0, f1, ...`` (signed longs, those of each shape in turn) of every row; a null or wordless text has zeros."""
    total = sum(n for _, n in shapes)
    names = [f"f{i}" for i in range(total)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([sums(t.as_py(), shapes) for t in b.column(1)], np.uint64).reshape(-1, total).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in fps.T)], ["id", *names])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in names)])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def anchor_masks(width: int) -> list[np.ndarray]:
    """By syndrome: what to flip in a block to reach each anchor within RADIUS + 1, the nearest first."""
    free, out = 1 << (width - 1), [[0, 1 << (width - 1)]]
    for s in range(1, width):
        near = 1 << (s - 1)
        pairs = [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, width) if i < i ^ s]
        out.append([near, near | free, *pairs])
    return [np.array(x, np.uint64) for x in out]


def syndrome(block: np.ndarray, width: int) -> np.ndarray:
    """Xor of the positions 1..w-1 of the bits that are set."""
    s = np.zeros(len(block), np.uint64)
    for bit in range(width.bit_length() - 1):
        mask = np.uint64(sum(1 << (i - 1) for i in range(1, width) if i >> bit & 1))
        s |= (np.bitwise_count(block & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(bit)
    return s


def _replicas(n: int, searched: int, blocks: int):
    width = 64 // blocks
    masks = anchor_masks(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                node, *fps = (c.to_numpy(zero_copy_only=False) for c in b.slice(at, 20_000).columns)
                for i, fp in enumerate(fps[:searched]):
                    for k in range(blocks):
                        part = fp.view(np.uint64) >> np.uint64(k * width) & np.uint64((1 << width) - 1)
                        s = syndrome(part, width)
                        for value in np.unique(s):
                            own, flips = s == value, masks[int(value)]
                            anchors = (part[own][:, None] ^ flips[None, :]) + np.uint64(i * blocks + k << width)
                            home = np.zeros(anchors.shape, bool)
                            home[:, 0] = True
                            rows = [np.repeat(c[own], len(flips)) for c in (node, *fps)]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchors.ravel().view(np.int64), home.ravel(), *rows)], ["anchor", "home", "node", *(f"f{j}" for j in range(n))])

    return run


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each component of the graph on 0..n-1 with the links a-b."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (before == root).all():
            break
    return root


def close(a: list[np.ndarray], b: list[np.ndarray], searched: int, threshold: int, most: int) -> np.ndarray:
    """Where some of the first ``searched`` fingerprints is within ``threshold`` bits and the others all together within ``most``."""
    apart = [np.bitwise_count(x ^ y) for x, y in zip(a, b)]
    least, total = apart[0], np.zeros(apart[0].shape, np.int16)
    for x in apart[1:searched]:
        least = np.minimum(least, x)
    for x in apart[searched:]:
        total += x
    return (least <= threshold) & (total <= most)


def _forest(node: np.ndarray, fps: list[np.ndarray], home: np.ndarray, side: np.ndarray, limits: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one anchor's piece: pairs of nodes.

    side: 0 and 1 for the two blocks of a pair of different blocks, else 2.
    """
    homes = np.flatnonzero(home)
    a, b = [], []
    for part in np.array_split(homes, max(1, len(homes) * len(node) // 2_000_000 + 1)):
        near = close([f[part][:, None] for f in fps], [f[None, :] for f in fps], *limits)
        near &= (side[part][:, None] != side[None, :]) | (side[None, :] == 2)
        x, y = np.nonzero(near)
        a.append(part[x])
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    root = local_roots(len(node), a, b)
    moved = np.flatnonzero(root != np.arange(len(node)))
    return node[moved], node[root[moved]]


def _compare(*limits: int):
    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, home, side, node, *fps = rows
        fps = [f.view(np.uint64) for f in fps]
        u, v = [], []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([edge, [len(key)]]))
        for at, n in zip(edge[size > 32].tolist(), size[size > 32].tolist()):
            own = slice(at, at + n)
            x, y = _forest(node[own], [f[own] for f in fps], home[own], side[own], limits)
            u.append(x)
            v.append(y)
        small = np.repeat(size <= 32, size)
        for k in range(1, int(size[size <= 32].max(initial=1))):
            i = np.flatnonzero(small[:-k] & (key[:-k] == key[k:]))
            i = i[home[i] | home[i + k]]
            i = i[close([f[i] for f in fps], [f[i + k] for f in fps], *limits)]
            u.append(node[i])
            v.append(node[i + k])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            last = int(np.searchsorted(rows[0] == rows[0][-1], True)) if len(rows[0]) else 0
            if last:
                yield links([x[:last] for x in rows])
            held = [x[last:] for x in rows]
        if held is not None and len(held[0]):
            yield links(held)

    return run


def near_links(distinct: DataFrame, threshold: int = 3, blocks: int = 2, searched: int = 1, most: int = 0) -> DataFrame:
    """Links ``u, v`` that connect every two distinct ``node`` with one of the first ``searched`` fingerprints (``f0, f1, ...``) within ``threshold`` bits and the others, in sum, within ``most``.

    Per anchor only a spanning forest is returned, which connects the same nodes. An anchor with
    more than PIECE rows is dealt into blocks, and block is compared with block.
    """
    if blocks not in (2, 4) or not 0 <= threshold < 2 * blocks:
        raise ValueError("blocks is 2 or 4, and threshold below twice that")
    names = [c for c in distinct.columns if c != "node"]

    def replicas(kept: list[str]) -> DataFrame:
        return distinct.select("node", *kept).mapInArrow(_replicas(len(kept), searched, blocks), "anchor long, home boolean, node long, " + ", ".join(f"{c} long" for c in kept))

    # few anchors are large: they are written first, so that the join sends them to the replicas instead of moving these once more
    counts = replicas(names[:searched]).groupBy("anchor").count()
    many = save(counts.filter(F.col("count") > PIECE).select("anchor", F.ceil(F.col("count") / PIECE).cast("int").alias("n")))
    dealt = replicas(names).join(F.broadcast(many) if many.count() <= BROADCAST_ANCHORS else many, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("n")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    keyed = dealt.select(F.xxhash64("anchor", low, high).alias("key"), "home", side.cast("byte").alias("side"), "node", *names)
    # a block meets itself in its own piece only: rows of one block and of two differ in key
    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_compare(searched, threshold, most), "u long, v long")


def near_duplicates(
    docs: DataFrame, k: int = 3, threshold: int = 3, blocks: int = 2, id_col: str = "doc_id", text_col: str = "text", searched: int = 1, proof: tuple[int, int] | None = None, most: int = 0
) -> DataFrame:
    """Component of every row: ``id, f0, ..., component`` (the smallest id linked to it, at any number of steps).

    Texts lower-cased in A-Z give k-word shingles, repeats included (fewer words: the whole
    sequence; none: fingerprint 0, linked like any other). Texts link where one of ``searched``
    fingerprints differs in ``threshold`` or fewer bits and those of ``proof`` (words of a shingle,
    how many fingerprints), if there are any, in ``most`` or fewer together. Null texts count as empty; a null id gets a component but never names one (null only where all ids
    of the component are null). Repeated rows each return.
    """
    shapes = ((k, searched), proof) if proof else ((k, searched),)
    names = [f"f{i}" for i in range(sum(n for _, n in shapes))]
    node = F.col("f0") if len(names) == 1 else F.xxhash64(*names)
    fps = save(fingerprints(docs, shapes, id_col, text_col).withColumn("node", node))
    classes = save(fps.groupBy("node", *names).agg(F.min("id").alias("least")))
    found = components(near_links(classes.select("node", *names), threshold, blocks, searched, most)).withColumnRenamed("node", "known")
    # only linked classes are grouped, and the groups' names written, so that a large one can be split
    linked = save(classes.join(found, classes.node == F.col("known")).select("known", "least", "root"))
    names_of = save(linked.groupBy("root").agg(F.min("least").alias("component")))
    named = linked.join(names_of, "root").select("known", "component")
    by_node = classes.join(named, classes.node == F.col("known"), "left").select("node", F.coalesce("component", "least").alias("component"))
    # written, so that a frequent fingerprint's rows can be split in the join
    return fps.join(save(by_node), "node").select("id", *names, "component")


def hex64(c):
    return F.lpad(F.lower(F.hex(c)), 16, "0")
