"""Hard-negative mining with a multiway tree of split points and distance ranges (GNAT).

Vectors are scaled to whole numbers and scores are exact inner products. So that a score is a distance, each
vector x gets one more component, sqrt(M - |x|^2) with M the largest squared norm, and a query a zero there: then
|a - x|^2 = |a|^2 + M - 2<a, x>, and a range of scores is an annulus around the query.

A node of the tree has some split points; a row goes to the child of its nearest one, so children are divided by
hyperplanes. The split points come from a bounded sample; all rows are indexed, and each split point keeps the least and the largest
distance to the rows below each of its siblings, over all rows. A search drops each child whose range, seen from any
split point, misses the annulus, and compares with every row of the leaves that are left. So results are exact.

A first look into the query's own leaf bounds the annulus from outside. Leaves are dealt in blocks, through which
the queries stream; equal vectors with one label are one point with its few smallest ids, as no other can be returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import save

#: Rows that the tree's split points are chosen from at most, split points of a node, and sampled rows that a node needs to be split.
SAMPLE, ARITY, LEAST = 20_000, 16, 64
#: Rows wanted in a leaf, and rows of a block (a leaf of more is several).
LEAF, BLOCK = 1_000, 2_000
#: Scores of an open range.
NO_LOW, NO_HIGH = -(1 << 63), (1 << 63) - 1
#: Sums of products below this are exact in float64.
EXACT = float(1 << 53)
#: Queries that are looked up in the tree at once, and products of a block with its queries.
AT_ONCE, PRODUCTS = 512, 1 << 22


@dataclass
class Node:
    """Split points (rows of ``points``), their ``children`` (a Node, or a leaf's number), and ``low`` and ``high``: distances of split point i to the rows below child j."""

    number: int
    points: np.ndarray
    children: list = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Tree:
    """Fitted on a sample of rows (already with their last component); ``share``: which part of all rows it is."""

    def __init__(self, x: np.ndarray, square: float, share: float, leaf: int):
        self.square, self.nodes, self.n_leaves = square, [], 0
        self.root = self._grow(x, max(1.0, leaf * share))
        self.blocks = np.ones(self.n_leaves, np.int64)

    def _grow(self, x: np.ndarray, most: float):
        if len(x) > max(most, LEAST):
            chosen = self._choose(x)
            if len(chosen) > 1:
                node = Node(len(self.nodes), x[chosen])
                self.nodes.append(node)
                near = nearest(x, node.points)
                node.children = [self._grow(x[near == j], most) for j in range(len(chosen))]
                node.low, node.high = np.full((2, len(chosen), len(chosen)), np.inf) * np.array([1, -1])[:, None, None]
                return node
        self.n_leaves += 1
        return self.n_leaves - 1

    @staticmethod
    def _choose(x: np.ndarray) -> list[int]:
        """Split points: of some rows, one after the other the farthest from those chosen."""
        some = np.linspace(0, len(x) - 1, min(len(x), 4 * ARITY)).astype(int)
        chosen, near = [int(some[0])], None
        while len(chosen) < ARITY:
            d = distances(x[some], x[chosen[-1:]])[:, 0]
            near = d if near is None else np.minimum(near, d)
            if near.max() <= 1e-6 * (1 + np.abs(x).max()):
                break
            chosen.append(int(some[near.argmax()]))
        return chosen

    def paths(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[Node, np.ndarray, np.ndarray]]]:
        """Leaf of each row, and for each node the rows that pass it with the child they go to."""
        leaf, passed, todo = np.zeros(len(x), np.int64), [], [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if not isinstance(at, Node):
                leaf[rows] = at
            elif len(rows):
                near = nearest(x[rows], at.points)
                passed.append((at, rows, near))
                todo += [(child, rows[near == j]) for j, child in enumerate(at.children)]
        return leaf, passed

    def alive(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves with the queries that may have rows there, at a distance in one of their annuli ``near``..``far`` (columns; NaN: none)."""
        slack = 1e-6 * np.sqrt(self.square) + 1e-6
        norms, todo = (queries**2).sum(1), [(self.root, np.arange(len(queries)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            if not isinstance(at, Node):
                yield at, rows
                continue
            d = np.sqrt(np.maximum(0, norms[rows, None] + self.square - 2 * queries[rows] @ at.points[:, :-1].T))[:, None, :, None]
            inner, outer = near[rows][:, :, None, None], far[rows][:, :, None, None]
            meets = (at.high >= np.maximum(d - outer, inner - d) - slack) & (at.low <= d + outer + slack)
            on = meets.all(2).any(1)
            todo += [(child, rows[on[:, j]]) for j, child in enumerate(at.children)]


def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest split point; all have the same norm."""
    return (x @ points.T).argmax(1)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (points**2).sum(1) - 2 * x @ points.T))


def vectors(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def lifted(x: np.ndarray, square: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(0, square - (x**2).sum(1)))[:, None]], 1)


def scores(x: np.ndarray, y: np.ndarray, square: float) -> np.ndarray:
    """Inner products as longs, exactly (beyond a long the nearest one)."""
    if square < EXACT:
        return (x @ y.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    found = whole(x).dot(whole(y).T)
    return np.minimum(np.maximum(found, NO_LOW), NO_HIGH).astype(np.int64)


def _scaled(scale: int, dims: int):
    """``id, label, vec, anchor, norm`` with ``vec`` the floors of ``scale`` times each component, as bytes of doubles, zeros after the last."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            x, n = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), lists.value_lengths().to_numpy(zero_copy_only=False)
            whole = np.zeros((b.num_rows, dims))
            whole[np.repeat(np.arange(b.num_rows), n), np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)] = x + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in whole], pa.binary()), b.column(3), pa.array((whole**2).sum(1))], ["id", "label", "vec", "anchor", "norm"])

    return go


def points_of(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors of a label: ``pid, key, label, vec, norm, ids`` with the ``most`` smallest ids; written. ``rows``: ``id, label, vec, norm, key``."""
    least = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    some = rows.select("id", "key").distinct().withColumn("n", least).filter(F.col("n") <= most)
    ids = some.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = rows.groupBy("key").agg(*(F.any_value(c).alias(c) for c in ("label", "vec", "norm")))
    return save(distinct.join(ids, "key").withColumn("pid", F.monotonically_increasing_id()))


def fit(points: DataFrame, dims: int, leaf: int, sample: int) -> Tree:
    """The tree over ``points``, with ranges over all of them and the number of blocks of each leaf still to come."""
    n, square = points.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    part = points.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n))) < sample).select("key", "vec").collect()
    x = np.frombuffer(b"".join(r["vec"] for r in sorted(part)), np.float64).reshape(-1, dims)
    return Tree(lifted(x, square), square, len(x) / max(1, n), leaf)


def index(points: DataFrame, tree: Tree, dims: int, block: int) -> DataFrame:
    """``points`` with their ``leaf`` and ``block``, written; the tree gets its ranges and blocks (both as many as it has nodes and leaves)."""
    spark = points.sparkSession
    held = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, _ = held.value.paths(lifted(vectors(b.column("vec"), dims), held.value.square))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*b.schema.names, "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            x = lifted(vectors(b.column("vec"), dims), held.value.square)
            for node, rows, near in held.value.paths(x)[1]:
                d = distances(x[rows], node.points)
                for j in np.unique(near).tolist():
                    own = d[near == j]
                    k = node.number, j
                    low[k], high[k] = np.minimum(low.get(k, np.inf), own.min(0)), np.maximum(high.get(k, -np.inf), own.max(0))
        keys = list(low)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([low[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([high[k].tolist() for k in keys], pa.list_(pa.float64()))], ["node", "child", "low", "high"])

    placed = save(points.mapInArrow(leaves, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in points.schema)}, leaf long"))
    seen = placed.select("vec").mapInArrow(ranges, "node long, child long, low array<double>, high array<double>").select("node", "child", F.posexplode(F.arrays_zip("low", "high")).alias("i", "r"))
    for r in seen.groupBy("node", "child", "i").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high")).collect():
        tree.nodes[r["node"]].low[r["i"], r["child"]], tree.nodes[r["node"]].high[r["i"], r["child"]] = r["low"], r["high"]
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / block).alias("n")).collect()
    for r in sizes:
        tree.blocks[r["leaf"]] = r["n"]
    held.unpersist()
    blocks = spark.createDataFrame([(int(i), int(n)) for i, n in enumerate(tree.blocks)], "leaf long, n_blocks long")
    return save(placed.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("n_blocks"))).drop("n_blocks"))


def route(queries: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """``leaf, block, qid, label, vec, spans``: each query (``qid, label, vec, spans``) at all blocks where it can have rows."""
    held = queries.sparkSession.sparkContext.broadcast(tree)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                x, spans = vectors(part.column("vec"), dims), part.column("spans").to_pylist()
                norms = (x**2).sum(1) + held.value.square
                near, far = np.full((2, len(spans), max(1, max(map(len, spans)))), np.nan)
                for i, own in enumerate(spans):
                    for k, s in enumerate(own):
                        near[i, k] = np.sqrt(max(0.0, norms[i] - 2.0 * s["high"]))
                        far[i, k] = np.sqrt(max(0.0, norms[i] - 2.0 * s["low"])) if s["low"] > NO_LOW else np.inf
                for leaf, rows in held.value.alive(x, near, far):
                    n = int(held.value.blocks[leaf])
                    chosen = part.take(pa.array(np.repeat(rows, n)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n * len(rows), leaf)), pa.array(np.tile(np.arange(n), len(rows))), *chosen.columns], ["leaf", "block", *part.schema.names])

    return queries.select("qid", "label", "vec", "spans").mapInArrow(go, "leaf long, block long, qid long, label string, vec binary, spans array<struct<w:bigint,low:bigint,high:bigint>>")


def _scan(dims: int, square: float, same: bool, most: int):
    """Streams each block's queries past its rows: ``qid, w, pid, first, score``, the first ``most`` of the block for each query and span.

    Rows come sorted by leaf and block, the points (without ``spans``) first.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x, labels, pids, firsts = None, [], None, None, None, None
        for b in batches:
            leaf, block, is_query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "block", "is_query"))
            edges = np.flatnonzero((leaf[1:] != leaf[:-1]) | (block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for at, end in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows]):
                part, now = b.slice(at, end - at), (leaf[at], block[at])
                if now != key:
                    key, held, x = now, [], None
                if not is_query[at]:
                    held.append(part)
                    continue
                if x is None:
                    if not held:
                        continue
                    x = np.concatenate([vectors(p.column("vec"), dims) for p in held])
                    labels, pids, firsts = (np.array([v for p in held for v in p.column(c).to_pylist()]) for c in ("label", "pid", "first"))
                step = max(1, PRODUCTS // len(x))
                for i in range(0, part.num_rows, step):
                    yield found(part.slice(i, step), x, labels, pids, firsts)

    def found(part: pa.RecordBatch, x, labels, pids, firsts) -> pa.RecordBatch:
        got = scores(vectors(part.column("vec"), dims), x, square)
        out: list[list] = [[], [], [], [], []]
        for own, qid, label, spans in zip(got, part.column("pid").to_pylist(), part.column("label").to_pylist(), part.column("spans").to_pylist()):
            fits = labels == label if same else labels != label
            for s in spans:
                rows = np.flatnonzero(fits & (own >= s["low"]) & (own <= s["high"]))
                if len(rows) > 4 * most:  # only rows that score as high as the last one taken
                    rows = rows[own[rows] >= np.partition(own[rows], len(rows) - most)[len(rows) - most]]
                rows = rows[np.lexsort((firsts[rows], -own[rows].astype(object) if own[rows].min(initial=0) == NO_LOW else -own[rows]))[:most]]
                for column, values in zip(out, ([qid] * len(rows), [s["w"]] * len(rows), pids[rows].tolist(), firsts[rows].tolist(), own[rows].tolist())):
                    column += values
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["qid", "w", "pid", "first", "score"])

    return go


def search(points: DataFrame, routed: DataFrame, tree: Tree, dims: int, same: bool, most: int) -> DataFrame:
    """``qid, w, pid, id, score, rank``: for each query and span the first ``most`` ids of all blocks, by score and id; written."""
    spans = "array<struct<w:bigint,low:bigint,high:bigint>>"
    rows = points.select("leaf", "block", F.lit(False).alias("is_query"), "pid", "label", "vec", F.col("ids")[0].alias("first"), F.lit(None).cast(spans).alias("spans"))
    asked = routed.select("leaf", "block", F.lit(True), F.col("qid"), "label", "vec", F.lit(None).cast("long"), "spans")
    dealt = rows.unionAll(asked).repartition("leaf", "block").sortWithinPartitions("leaf", "block", "is_query")
    best = dealt.mapInArrow(_scan(dims, tree.square, same, most), "qid long, w long, pid long, first long, score long")
    # each point has its first id, so of more points than ids are wanted the last can't have one; ties of score and id are points of one id
    ahead = F.row_number().over(Window.partitionBy("qid", "w").orderBy(F.desc("score"), "first", "pid"))
    best = best.withColumn("n", ahead).filter(F.col("n") <= most)
    met = best.join(points.select("pid", F.slice("ids", 1, most).alias("ids")), "pid").select("qid", "w", "pid", F.explode("ids").alias("id"), "score")
    first = Window.partitionBy("qid", "w").orderBy(F.desc("score"), "id", "pid")
    return save(met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most))


def narrowed(queries: DataFrame, seen: DataFrame, most: int) -> DataFrame:
    """``queries`` whose spans begin at the score of the ``most``-th found in ``seen``, where there are as many."""
    low = seen.filter(F.col("rank") == most).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("lows"))
    spans = F.transform("spans", lambda s: F.struct(s["w"].alias("w"), F.greatest(s["low"], F.element_at("lows", s["w"])).alias("low"), s["high"].alias("high")))
    return save(queries.join(low, "qid", "left").withColumn("spans", F.when(F.col("lows").isNull(), F.col("spans")).otherwise(spans)).drop("lows"))


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    scale: int = 256, leaf: int = LEAF, block: int = BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """Hard negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A row's score is its inner product with the anchor, both scaled by ``scale`` and rounded down. An anchor's positives are the ``positives`` other
    rows of its label with the largest scores; negatives of a positive the first ``negatives`` of the rows of other labels with ``low`` to ``high``
    hundredths of the positive's score. Ties go to the smaller id. ``anchor`` is a condition on the rows.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that repeat id, label and vector are one; an id with several vectors or
    labels is several rows. A shorter vector counts as filled up with zeros. Scores beyond a long count as the nearest long. A positive without negatives has no row; no rows give none.
    """
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    given = given.filter("id is not null and label is not null and vec is not null").filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    dims = max(1, given.agg(F.max(F.size("vec"))).first()[0] or 1)
    scaled = given.mapInArrow(_scaled(scale, dims), "id long, label string, vec binary, anchor boolean, norm double")
    scaled = save(scaled.withColumn("key", F.unhex(F.md5(F.concat("vec", F.col("label").cast("binary"))))))

    points = points_of(scaled, positives + 1)
    tree = fit(points, dims, leaf, sample)
    points = index(points, tree, dims, block)
    anchors = save(scaled.filter("anchor").select("id", "key").distinct().join(points.select("key", "pid"), "key").select(F.col("id").alias("anchor_id"), F.col("pid").alias("qid")))
    asked = points.withColumnRenamed("pid", "qid").join(anchors.select("qid").distinct(), "qid", "left_semi").select("qid", "label", "vec", "leaf", "block")

    span = lambda w, a, b: F.struct(w.alias("w"), a.alias("low"), b.alias("high"))
    queries = save(asked.withColumn("spans", F.array(span(F.lit(0).cast("long"), F.lit(NO_LOW), F.lit(NO_HIGH)))))
    queries = narrowed(queries, search(points, queries, tree, dims, True, positives + 1), positives + 1)
    with_label = points.select("leaf", "block", "label").distinct()
    found = search(points, route(queries, tree, dims).join(with_label, ["leaf", "block", "label"], "left_semi"), tree, dims, True, positives + 1)
    paired = anchors.join(found.drop("w", "rank"), "qid").filter("not (id = anchor_id and pid = qid)")
    first = Window.partitionBy("anchor_id", "qid").orderBy(F.desc("score"), "id", "pid")
    paired = save(paired.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= positives).select("anchor_id", "qid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    exact = lambda c: F.expr(f"cast({c} as decimal(20, 0))")
    at_least, at_most = F.ceil(exact("positive_score") * low / 100).cast("long"), F.floor(exact("positive_score") * high / 100).cast("long")
    wanted = paired.select("qid", F.col("positive_score").alias("w"), at_least.alias("low"), at_most.alias("high")).filter("low <= high").distinct()
    wanted = wanted.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("spans"))
    queries = save(asked.join(wanted, "qid"))
    queries = narrowed(queries, search(points, queries, tree, dims, False, negatives), negatives)
    hard = search(points, route(queries, tree, dims), tree, dims, False, negatives)
    hard = hard.select("qid", F.col("w").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return paired.join(hard, ["qid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine_sql() -> str:
    """DuckDB SQL of the registered query over ``embeddings``."""
    return """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
