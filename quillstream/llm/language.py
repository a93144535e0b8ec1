"""Hierarchical language identification: the family first, then one-versus-one within it.

Features are hashed byte trigrams of the whole lower-cased text (square roots of their shares).
Linear support vector machines are fitted on a bounded sample of labelled rows: one for each two
families, then one for each two languages of a family.

Whether a text is in a learned language at all is asked apart: its mean log chance per trigram under
the profile of the language found, against what labelled rows show that the profile was not made of.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.common import row_of, save

DIMS = 4096
#: Sampled rows of each language at most, and of all together (but LEAST_ROWS of each): the bound of the fit.
ROWS_PER_LANGUAGE, ROWS = 500, 20_000
#: Text bytes that are worked on at once.
CHUNK = 1 << 20
UNKNOWN = "und"
#: Parts that labelled rows are dealt to (each is held against a profile of the others), and fewest rows of a language for that.
FOLDS, LEAST_ROWS = 4, 8
#: Share of a profile that is spread evenly over all trigrams.
EVEN = 0.05
#: A text is strange that lies this many times farther out than the QUANTILE of the labelled rows, and at least LEAST_FAR spreads.
QUANTILE, FARTHER, LEAST_FAR = 0.01, 1.5, 4.0
#: Trigrams overlap by two bytes: how many count as one draw.
OVERLAP = 3
#: Words of a piece, where a text that is strange as a whole is looked at by pieces in learned languages.
PIECE = 12
# fixed values: families of common ISO 639-1 codes; a code that isn't listed is a family of its own
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr gu pa ne",
    "semitic": "ar he mt am",
    "sinitic": "zh",
    "malayic": "id ms",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: ASCII bytes that are no letters become spaces.
PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(x, texts):
        b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(PLAIN) + b" ", np.uint8)
        counts = np.zeros(DIMS)
        for at in range(0, len(b) - 2, CHUNK):
            part = b[at : at + CHUNK + 2].astype(np.uint32)
            code = (part[:-2] | part[1:-1] << 8 | part[2:] << 16) * np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(20), minlength=DIMS)
        row[:] = np.sqrt(counts / max(1, len(b) - 2))
    return x


def n_own(text: str) -> int:
    """Bytes of the text's distinct words: repeated words say nothing new of its language."""
    words = set(text.lower().encode("utf-8", "replace").translate(PLAIN).split())
    return sum(map(len, words)) + len(words)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


#: The dimensions of trigrams with two spaces on end, which tell of layout and not of language.
WIDE_GAPS = features([f" {x} " for x in ("", *"abcdefghijklmnopqrstuvwxyz")]).any(0) & ~features(list("abcdefghijklmnopqrstuvwxyz")).any(0)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and bias (last) of a linear SVM with squared hinge loss; y is -1 or 1; classes weigh alike."""
    x = np.hstack([x, np.full((len(x), 1), 1, np.float32)])
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = np.zeros(x.shape[1])
    ahead, rate = w.copy(), 1 / (2 * 2.0 + l2)  # rows have squared length 2
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - rate * (l2 * ahead - 2 * x.T @ (share * y * slack))
        ahead, w = step + i / (i + 3) * (step - w), step
    return w


def fit_rows(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """One machine: ``rows`` are its negative examples, and inverted (~) its positive ones."""
    return fit_svm(x[np.where(rows < 0, ~rows, rows)], np.where(rows < 0, 1, -1))


class Profile:
    """How far a text lies below the usual text of one language, in spreads; short texts spread wider."""

    def __init__(self, x: np.ndarray, sizes: np.ndarray):
        x = self._shares(x)
        self.log, self.limit = self._log(x), np.inf
        p = np.exp(self.log)
        self.own = float(p @ self.log**2 - (p @ self.log) ** 2)  # of one trigram
        if len(x) < LEAST_ROWS:
            self.mean = self.between = 0.0
            return
        fold, fits = np.arange(len(x)) % FOLDS, np.zeros(len(x))
        for k in range(FOLDS):
            fits[fold == k] = x[fold == k] @ self._log(x[fold != k])
        long = fits[sizes >= np.median(sizes)]  # short texts say little of the mean
        self.mean = float(np.median(long))
        self.between = 1.4826 * float(np.median(np.abs(long - self.mean)))
        self.limit = max(LEAST_FAR, FARTHER * float(np.quantile(self._far(fits, sizes), 1 - QUANTILE)))

    @staticmethod
    def _shares(x: np.ndarray) -> np.ndarray:
        share = np.where(WIDE_GAPS, 0, x.astype(np.float64) ** 2)
        return share / np.maximum(share.sum(1, keepdims=True), 1e-12)

    @staticmethod
    def _log(x: np.ndarray) -> np.ndarray:
        share = x.sum(0)
        return np.log((1 - EVEN) * share / max(share.sum(), 1e-12) + EVEN / DIMS)

    def _far(self, fits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (self.mean - fits) / self.spread(sizes)

    def spread(self, sizes: np.ndarray) -> np.ndarray:
        return np.sqrt(self.between**2 + OVERLAP * self.own / np.maximum(1, sizes) + 1e-12)

    def strangeness(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Above 1: farther out than labelled rows of the language lie. 0 where too few were there to tell."""
        return self._far(self._shares(x) @ self.log, sizes) / self.limit


class Model:
    """``families``: names in order; ``family_pairs`` and ``pairs``: (name, name) -> weights."""

    def __init__(self, x: np.ndarray, langs: list[str], sizes: list[int], fit_all=None):
        """``fit_all``: fits the machines of some ``(x, y)`` given by row numbers; here, one after the other, where there is none."""
        self.langs = sorted(set(langs))
        family = {code: FAMILY_OF.get(code, code) for code in self.langs}
        self.members = {f: [c for c in self.langs if family[c] == f] for f in sorted(set(family.values()))}
        own, kin = np.array(langs), np.array([family[c] for c in langs])
        pick = lambda names, a, b: np.concatenate([np.flatnonzero(names == b), ~np.flatnonzero(names == a)])
        families, pairs = list(combinations(self.members, 2)), [p for codes in self.members.values() for p in combinations(codes, 2)]
        rows = [pick(kin, *p) for p in families] + [pick(own, *p) for p in pairs]
        fitted = fit_all(rows) if fit_all and rows else [fit_rows(x, r) for r in rows]
        self.family_pairs, self.pairs = dict(zip(families, fitted)), dict(zip(pairs, fitted[len(families) :]))
        sizes = np.array(sizes, np.int64)
        self.profiles = {code: Profile(x[own == code], sizes[own == code]) for code in self.langs}

    @staticmethod
    def _choose(x: np.ndarray, names: list[str], weights: dict) -> tuple[np.ndarray, np.ndarray]:
        """One-versus-one: most wins, then the larger sum of margins; and the chance of the least sure of its wins."""
        wins, sums, least = (np.zeros((len(x), len(names))) for _ in range(3))
        least += 1
        for a, b in combinations(range(len(names)), 2):
            w = weights[names[a], names[b]]
            margin = x @ w[:-1] + w[-1]
            chance = 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10)))
            for i, m, c in ((a, margin, chance), (b, -margin, 1 - chance)):
                wins[:, i] += m > 0
                sums[:, i] += m
                least[:, i] = np.minimum(least[:, i], c)
        best = np.lexsort((sums, wins))[:, -1] if len(x) else np.zeros(0, int)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        pred, score, strange = [UNKNOWN] * len(texts), [0.0] * len(texts), [np.inf] * len(texts)
        x = features([texts[i] for i in known])
        names = list(self.members)
        if not known:
            return pred, score, strange
        sizes = np.array([n_own(texts[i]) for i in known])
        family, sure = self._choose(x, names, self.family_pairs)
        for f, codes in enumerate(self.members.values()):
            rows = np.flatnonzero(family == f)
            lang, sure_too = self._choose(x[rows], codes, self.pairs)
            for r, code, s in zip(rows.tolist(), lang.tolist(), (sure[rows] * sure_too).tolist()):
                pred[known[r]], score[known[r]] = codes[code], min(1.0, max(0.0, s))
            for k, code in enumerate(codes):
                for r, s in zip(rows[lang == k].tolist(), self.profiles[code].strangeness(x[rows[lang == k]], sizes[rows[lang == k]]).tolist()):
                    strange[known[r]] = s if s <= 1 else min(s, self.by_pieces(texts[known[r]], sizes[r]))
        return pred, score, strange

    def by_pieces(self, text: str, size: int) -> float:
        """The strangeness of a text whose pieces may be in different learned languages, each held against the nearest."""
        words, total, spreads = text.split(), 0.0, 0.0
        spread = np.array([p.spread(np.array([size]))[0] * p.limit for p in self.profiles.values()])
        for at in range(0, len(words), 500 * PIECE):
            pieces = [" ".join(words[i : i + PIECE]) for i in range(at, min(len(words), at + 500 * PIECE), PIECE)]
            far, n = np.zeros((len(self.langs), len(pieces))), np.array([len(p) for p in pieces])
            shares = Profile._shares(features(pieces))
            for row, p in zip(far, self.profiles.values()):
                row[:] = np.inf if np.isinf(p.limit) else p.mean - shares @ p.log
            total, spreads = total + float(far.min(0) @ n), spreads + float(spread[far.argmin(0)] @ n)
        return total / spreads


def _fit_on_executors(spark: SparkSession, x: np.ndarray):
    """Fits each machine in a task of its own; the sampled features (bounded by ROWS) are broadcast."""

    def fit_all(rows: list[np.ndarray]) -> list[np.ndarray]:
        held = spark.sparkContext.broadcast((x.astype(np.float16), rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x, rows = held.value
                for i in b.column(0).to_pylist():
                    used = np.where(rows[i] < 0, ~rows[i], rows[i])
                    w = fit_svm(x[used].astype(np.float32), np.where(rows[i] < 0, 1, -1))
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w.tobytes()], pa.binary())], ["i", "w"])

        found = spark.range(0, len(rows), 1, len(rows)).mapInArrow(run, "i long, w binary").collect()
        held.unpersist()
        return [np.frombuffer(r["w"], np.float64) for r in sorted(found)]

    return fit_all


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE, total: int = ROWS) -> Model:
    """Fit on a sample of every language's distinct texts, drawn by their hash; features of whole texts are made on the executors.

    All values of ``lang`` are learned. A language gets ``rows`` rows at most, and all together ``total``, but LEAST_ROWS
    of each however many there are. Null texts and languages and texts without a letter aren't learned from; a text that
    repeats counts once.
    """
    usable = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    hashed = usable.withColumn("h", F.xxhash64("text"))
    sizes = save(hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    n_langs = sizes.count()
    each = max(LEAST_ROWS, min(rows, total // max(1, n_langs)))
    # of the texts' hashes, the smallest: a third more than wanted are looked at, as the number of texts is an estimate and some have no letter
    least = F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), F.lit(4 / 3 * each) / F.col("n"))
    drawn = hashed.join(F.broadcast(sizes) if n_langs <= 100_000 else sizes, "lang").filter(F.col("h") < least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # a frequent text leaves a task once
        for b in batches:
            found: list[list] = [[], [], [], []]
            for t, code, h in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (code, h) not in seen and has_letter(t):
                    seen.add((code, h))
                    for column, value in zip(found, (h, features([t])[0].astype(np.float16).tobytes(), code, n_own(t))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.binary(), pa.string(), pa.int64()))], ["h", "x", "lang", "size"])

    one = drawn.select("text", "lang", "h").mapInArrow(run, "h long, x binary, lang string, size long").dropDuplicates(["lang", "h"])
    some = one.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= each)
    found = sorted(some.select("h", "x", "lang", "size").collect())
    x = np.frombuffer(b"".join(r["x"] for r in found), np.float16).reshape(-1, DIMS).astype(np.float32)
    return Model(x, [r["lang"] for r in found], [r["size"] for r in found], _fit_on_executors(labelled.sparkSession, x))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Per row: ``doc`` (the row as a struct), ``lang_pred``, ``score`` (0 to 1, how sure of it among the learned) and ``strangeness``.

    Strangeness above 1 means that the text is unlike labelled rows of ``lang_pred``, as texts in
    languages that were not learned are (a text may change between learned ones); it is infinite for ``und`` and 0 where the language has
    fewer than LEAST_ROWS sampled rows. The whole text is used. Null texts and texts without a letter are ``und`` with score 0; so is
    every text where the model has learned no language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                pred, score, strange = held.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(strange, pa.float64())], ["doc", "lang_pred", "score", "strangeness"])

    whole = docs.select(row_of(docs).alias("doc")).withColumn("text", F.col(f"doc.`{text_col}`"))
    return whole.mapInArrow(run, T.StructType([whole.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("strangeness", T.DoubleType())]))
