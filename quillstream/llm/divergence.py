"""Source divergence audit by three-dimensional cube partitioning.

For each language the sources are held against each other, and against the whole language, by the
terms they use. Work is dealt along three axes: a block of groups (a group is a language's source), a second block of
groups, and a block of terms. The slice (group block, term block) of the counts is replicated to each cell
that pairs its block with another one; a cell turns its two slices into dense matrices of a bounded size and
sums the divergence of each pair of groups over its terms, those included that neither slice holds. The
sums of the cells are reduced along the term axis.

All numbers are whole: shares are billionths, rounded down, of counts to which 2 are added.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.common import LOWER, UPPER, save

#: Terms are runs of a-z and everything beyond ASCII, after A-Z is lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Groups and terms of a block: a cell holds two matrices of so many numbers.
GROUPS, TERMS = 128, 1024
#: Shares are parts of this, and what is added to each count.
ONE, ADDED = 1_000_000_000, 2
#: Different terms that one task counts before it hands them on, text bytes counted at once, and rows of a batch.
HELD, CHUNK, ROWS = 300_000, 1 << 20, 50_000
#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 16_000_000
#: Bytes of UTF-8 to the terms' bytes; what is no part of a term becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
DF = 1 << 48


def pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about CHUNK bytes, cut at spaces."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end


def _rows_of(held: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), own in held.items():
        terms, packed = list(own), list(own.values())
        for i in range(0, len(terms), ROWS):
            part = packed[i : i + ROWS]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(terms[i : i + ROWS], pa.binary()), pa.array([x % DF for x in part]), pa.array([x // DF for x in part])],
                ["lang", "source", "term", "n", "df"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, df``: occurrences and documents of some of the rows, added up as far as memory allows."""
    held, size = defaultdict(dict), 0
    for b in batches:
        langs, sources, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
        for i, key in enumerate(zip(langs, sources)):
            own, doc = held[key], Counter()
            for piece in pieces(texts[i].as_py().translate(LETTERS)):
                doc.update(piece.split())
            before = len(own)
            for term, n in doc.items():
                own[term] = own.get(term, 0) + n + DF
            size += len(own) - before
            if size > HELD:
                yield from _rows_of(held)
                held, size = defaultdict(dict), 0
    yield from _rows_of(held)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, df`` of documents ``lang, source, text``: how often a group has a term, and in how many documents; written."""
    parts = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_count, "lang string, source string, term binary, n long, df long")
    return save(parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the (written) table's strings and numbers are within BROADCAST_BYTES."""
    size = sum((F.octet_length(c) if t == "string" else F.lit(8) for c, t in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(ONE * (n + ADDED) / (total + ADDED * terms)), exactly; 1 where there are no terms."""
    return F.expr(f"if({terms} = 0, 1L, 1L + (cast({ONE} as decimal(10, 0)) * cast({n} + {ADDED} as decimal(20, 0))) div cast({total} + {ADDED} * {terms} as decimal(20, 0)))")


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one cell: ``lang, a, b, value``, each pair of groups once.

    ``rows``: for each group of the two blocks (``side``, ``g``) one with its name, the share of a term that it lacks and how many terms
    the block has (``t`` is -1), and one for each term it has.
    """
    groups = rows[rows["t"] < 0].sort_values(["side", "g"])
    entries = rows[rows["t"] >= 0]
    terms, column = np.unique(entries["t"].to_numpy(), return_inverse=True)
    columns = {"lang": [], "a": [], "b": [], "value": []}
    if not len(groups):
        return pd.DataFrame(columns)
    n_terms, lang = int(groups["n_terms"].iloc[0]), groups["lang"].iloc[0]
    low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])

    def matrix(side: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        own = groups[groups["side"] == side]
        none, on = own["p"].to_numpy(), (entries["side"] == side).to_numpy()
        m = np.repeat(none[:, None], len(terms), 1)
        m[entries["g"].to_numpy()[on] - 1, column[on]] = entries["p"].to_numpy()[on]
        return own["source"].tolist(), m, none

    (names, m, none), (others, k, lacks) = matrix(low), matrix(high)
    for i, name in enumerate(names):
        first = i + 1 if low == high else 0
        d, s = m[i] - k[first:], m[i] + k[first:]
        unseen, both = none[i] - lacks[first:], none[i] + lacks[first:]
        value = (d * d // s).sum(1) + (n_terms - len(terms)) * (unseen * unseen // both)
        n = len(value)
        for column, values in zip(columns.values(), ([lang] * n, [name] * n, others[first:], value.tolist())):
            column += values
    return pd.DataFrame({c: np.array(v, np.int64 if c == "value" else object) for c, v in columns.items()})


def pair_divergences(entries: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """``lang, a, b, value`` for each two groups of a language, once.

    ``groups``: ``lang, source, none`` (the share of a term that it lacks), ``block``, ``g`` (from 1 in its block), ``n_blocks``.
    ``entries``: ``lang, source, block, g, n_blocks, tb, t, p``. ``blocks``: ``lang, tb, n_terms`` of each block of terms.
    """
    whole = groups.join(blocks, "lang").select("lang", "block", "g", "n_blocks", "tb", F.lit(-1).alias("t"), F.col("none").alias("p"), "source", "n_terms")
    slices = whole.unionAll(entries.select("lang", "block", "g", "n_blocks", "tb", "t", "p", F.lit(None).cast("string"), F.lit(None).cast("long")))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    cells = slices.withColumn("other", other).select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "tb", F.col("block").alias("side"), "g", "t", "p", "source", "n_terms"
    )
    partial = cells.groupBy("lang", "low", "high", "tb").applyInPandas(_cell, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", groups_of: int = GROUPS, terms_of: int = TERMS) -> DataFrame:
    """How the sources of each language differ: ``lang, source, part, item, value, rank``.

    A language keeps the terms that ``least_docs`` of its documents have. With p and q the shares of a term, its divergence is floor((p - q)**2 / (p + q)).
    Part ``pair``: ``item`` is another source, ``value`` the divergence from it, summed over all kept terms (0 where there are none). Part
    ``term``: ``item`` is one of the ``top`` kept terms that the source has relatively more of than its language, ``value`` its divergence.
    Ranks go from the largest value down, ties by the item. Null texts, languages and sources count as empty ones; each row is a document,
    rows that repeat included; a source without terms has its pairs; no rows give none. Other columns play no part.
    """
    given = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = term_counts(given)
    kept = save(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n_lang")).filter(F.col("df") >= least_docs).drop("df"))
    seen = save(given.select("lang", "source").distinct())
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    langs = seen.groupBy("lang").agg(F.count("*").alias("n_groups")).join(terms, "lang", "left").select("lang", "n_groups", zero("v"), zero("total"))
    sized = lambda n, each: F.greatest(F.lit(1), F.ceil(F.col(n) / each)).cast("int")
    langs = save(langs.withColumn("n_blocks", sized("n_groups", groups_of)).withColumn("n_tb", sized("v", terms_of)))

    placed = kept.join(small(langs.select("lang", "v", "total", "n_tb")), "lang")
    placed = placed.select("lang", "term", F.pmod(F.xxhash64("term"), F.col("n_tb")).cast("int").alias("tb"), share("n_lang", "total", "v").alias("q"))
    in_block = lambda block, name: F.row_number().over(Window.partitionBy("lang", block).orderBy(name))
    placed = save(placed.withColumn("t", in_block("tb", "term")))
    had = save(counts.drop("df").join(placed, ["lang", "term"]))

    groups = seen.join(had.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").select("lang", "source", zero("total"))
    groups = groups.join(small(langs.select("lang", "v", "n_blocks")), "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int"))
    groups = save(groups.withColumn("g", in_block("block", "source")).withColumn("none", share("0L", "total", "v")))
    entries = had.join(small(groups.drop("none")), ["lang", "source"]).withColumn("p", share("n", "total", "v"))

    blocks = langs.select("lang", F.explode(F.sequence(F.lit(0), F.col("n_tb") - 1)).alias("tb"))
    blocks = blocks.join(placed.groupBy("lang", "tb").agg(F.count("*").alias("n_terms")), ["lang", "tb"], "left").select("lang", "tb", zero("n_terms"))
    once = save(pair_divergences(entries, groups, blocks))
    pairs = once.unionAll(once.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    most = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(most))
    more = entries.filter("n > 0 and p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))
    return pairs.unionAll(more.withColumn("rank", F.row_number().over(most)).filter(F.col("rank") <= top))


def audit_sql(least_docs: int = 10, top: int = 10) -> str:
    """DuckDB SQL of ``audit`` over ``documents``."""
    p = f"1 + ({ONE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * v)"
    return f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w FROM documents),
        t AS (SELECT doc, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {least_docs}),
        l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        q AS (SELECT lang, term, {p} AS q FROM k JOIN l USING (lang)),
        g AS (SELECT lang, source, term, n, {p} AS p FROM (SELECT s.lang, s.source, s.total, l.v, k.term, coalesce(c.n, 0) AS n FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM g JOIN q USING (lang, term) WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= {top}"""
