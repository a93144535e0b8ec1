"""Quality classifier by co-training.

Two views of a document are learned apart: its text (hashed byte trigrams and the
form of the whole text) and
its metadata (source, language, length). Over rounds each classifier labels the pool rows that it
is surest of and hands them to the other (if its calibrated chance makes it confident). Each is then calibrated on labelled rows that neither
was fitted on, and the calibrated views are added as evidence to score all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import row_of

GRAM_DIMS, SHAPE_DIMS, META_DIMS = 2048, 8, 128
TEXT_DIMS = GRAM_DIMS + SHAPE_DIMS
#: Labelled and unlabelled rows of the fit, about (its bounds), rounds, and rows handed over a round.
LABELLED, POOL, ROUNDS, HANDED = 3000, 3000, 5, 100
#: Calibrated chance from which a view counts as confident of a row.
CONFIDENT = 0.9


def shape(text: str) -> list[float]:
    """Shares, from 0 to 1, of what junk has too much of."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, own = max(1, len(words)), len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    symbols = sum(map(text.count, "#*$%&|<>{}[]=\\~^_")) / max(1, len(text))
    capitals = sum(map(str.isupper, words)) / n
    return [again, 1 - own / n if n > 20 else 0, 1 - len(set(lines)) / max(1, len(lines)), min(1, 10 * symbols), capitals, min(1, text.count("!") / n), 1 / n, float(n < 50)]


def text_features(texts: list[str | None]) -> np.ndarray:
    x = np.zeros((len(texts), TEXT_DIMS), np.float32)
    for row, text in zip(x, texts):
        row[GRAM_DIMS:] = shape(text or "")
        b = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
        if len(b) >= 3:
            code = (b[:-2] | b[1:-1] << 8 | b[2:] << 16) * np.uint32(2654435761)
            row[:GRAM_DIMS] = np.sqrt(np.bincount(code >> np.uint32(21), minlength=GRAM_DIMS) / (len(b) - 2))
    return x


def meta_features(rows: list[tuple]) -> np.ndarray:
    """One hot source (hashed), language (hashed) and length (by powers of 2); a null is a value of its own."""
    x = np.zeros((len(rows), META_DIMS), np.float32)
    for row, (source, lang, size) in zip(x, rows):
        row[zlib.crc32(f"s{source}".encode()) % 80] = row[80 + zlib.crc32(f"l{lang}".encode()) % 24] = 0.5
        row[104 + (23 if size is None else min(22, max(0, int(size)).bit_length()))] = 0.5
    return x


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a logistic regression whose classes weigh alike; y is 0 or 1."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    ahead, rate = w.copy(), 1 / (0.25 * 8 + l2)  # rows have squared length 8 at most
    for i in range(rounds):
        step = ahead - rate * (x.T @ (share * (sigmoid(x @ ahead) - y)) + l2 * ahead)
        ahead, w = step + i / (i + 3) * (step - w), step
    return w


def apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift so that sigmoid(slope * z + shift) is the chance of y; counts are smoothed, the slope isn't negative."""
    good = (y == 1).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * z + b)
        g, h = p - target, p * (1 - p)
        m = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [(g * z).sum(), g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return max(0.0, float(a)), float(b)


class CoTrained:
    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS, handed: int = HANDED):
        self.ready = len(set(y.tolist())) == 2
        if not self.ready:
            return
        spare = np.arange(len(y)) % 4 == 3  # a quarter is kept for the calibration
        if len(set(y[spare].tolist())) < 2:
            spare = np.ones(len(y), bool)
            fit = spare
        else:
            fit = ~spare
        views, pools = [text, meta], [pool_text, pool_meta]
        xs, ys = [v[fit] for v in views], [y[fit].astype(float)] * 2
        free = np.ones(len(pool_text), bool)
        share = y.mean()
        for _ in range(rounds):
            w = [fit_logistic(x, t) for x, t in zip(xs, ys)]
            for me, other in ((0, 1), (1, 0)):
                left = np.flatnonzero(free)
                if not len(left):
                    break
                a, b = calibrate(apply(w[me], views[me][spare]), y[spare])
                chance = sigmoid(a * apply(w[me], pools[me][left]) + b)
                order, chance = left[np.argsort(chance, kind="stable")], np.sort(chance, kind="stable")
                n_good = min(int((chance >= CONFIDENT).sum()), max(1, round(handed * share)))
                n_bad = min(int((chance <= 1 - CONFIDENT).sum()), max(1, handed - round(handed * share)))
                chosen = np.concatenate([order[:n_bad], order[len(order) - n_good :]])
                free[chosen] = False
                xs[other] = np.vstack([xs[other], pools[other][chosen]])
                ys[other] = np.concatenate([ys[other], np.zeros(n_bad), np.ones(n_good)])
        self.w = [fit_logistic(x, t) for x, t in zip(xs, ys)]
        self.scale = [calibrate(apply(w, v[spare]), y[spare]) for w, v in zip(self.w, views)]
        self.prior = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chances of good quality: both views, text alone, metadata alone. Without a fit all are 0.5."""
        if not self.ready:
            return (np.full(len(text), 0.5),) * 3
        z = [a * apply(w, x) + b for w, x, (a, b) in zip(self.w, (text, meta), self.scale)]
        return sigmoid(z[0] + z[1] - self.prior), sigmoid(z[0]), sigmoid(z[1])


COLUMNS = ["text", "source", "lang", "n_chars"]


def _views(part: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    text, *meta = (part.column(at + k).to_pylist() for k in range(4))
    return text_features(text), meta_features(list(zip(*meta)))


def _inputs(docs: DataFrame) -> list:
    return [F.col("text"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained:
    """Fit on about ``labelled`` labelled and ``pool`` other rows, drawn by a hash of their ids; features are made on the executors.

    A document's labels are averaged; labels without a document and null labels count for nothing. Of rows that repeat
    an id the one whose text has the least hash is learned from.
    """
    docs = docs.select("doc_id", *COLUMNS)
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n_marks, n_docs = marks.count(), docs.count()
    place = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(n)), F.lit(1 << 30)) / float(1 << 30)
    few = marks.filter(place(1) < labelled / max(1, n_marks))
    known = docs.join(F.broadcast(few), "doc_id")
    others = docs.filter(place(2) < pool / max(1, n_docs)).join(few, "doc_id", "left_anti").withColumn("y", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, meta = _views(b, 2)
            xs = [[v.astype(np.float16).tobytes() for v in x] for x in (text, meta)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in xs)], ["doc_id", "y", "t", "m"])

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("y", T.IntegerType()), T.StructField("t", T.BinaryType()), T.StructField("m", T.BinaryType())])
    drawn = known.select("doc_id", "y", *_inputs(docs)).unionAll(others.select("doc_id", "y", *_inputs(docs)))
    one = drawn.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), *drawn.columns[1:])).alias("r")).select("doc_id", *(f"r.{c}" for c in drawn.columns[1:]))
    drawn = one.mapInArrow(run, schema).collect()
    drawn = sorted(drawn, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["t"]))
    text, meta = (np.frombuffer(b"".join(r[c] for r in drawn), np.float16).reshape(-1, n).astype(np.float32) for c, n in (("t", TEXT_DIMS), ("m", META_DIMS)))
    y = np.array([r["y"] for r in drawn], int)
    return CoTrained(text[y >= 0], meta[y >= 0], y[y >= 0], text[y < 0], meta[y < 0])


def score_documents(docs: DataFrame, model: CoTrained) -> DataFrame:
    """Every row: ``doc`` (the row as a struct), ``score``, ``text_score`` and ``meta_score`` (0 to 1).

    Whole texts are used; a null text counts as empty and null metadata as a value of its own;
    rows that repeat score alike.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.asarray(s, np.float64)) for s in held.value.score(*_views(part, 1)))], ["doc", "score", "text_score", "meta_score"])

    whole = docs.select(row_of(docs).alias("doc"), *_inputs(docs))
    return whole.mapInArrow(run, T.StructType([whole.schema["doc"], *(T.StructField(c, T.DoubleType()) for c in ("score", "text_score", "meta_score"))]))
