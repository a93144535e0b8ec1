"""Benchmark decontamination with a distributed positional inverted index.

The index is a written table of postings (term, document row, position) of every word of the corpus,
in shards of whole texts that are small enough to be sorted in memory; building it moves the texts once, but no postings, and a frequent
term is spread over all shards. Shards are sorted by the hash of the term, and a search reads the ranges of hashes
those alone that its terms fall in. Any number of benchmarks can be held against one index. A phrase search starts from the rarest term of every window of an item, shifts its postings by the
term's offset, intersects them with those of the second rarest, and confirms the survivors
against the postings of all of the item's terms. A proximity search asks for the rarest terms of an
item near its rarest one, in any order, from the two rarest up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm.common import LOWER, UPPER, lower_ascii, row_key, row_of, save, scratch

#: Words are runs of digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between a proximity match's rarest term and its others at most, and how many of an item's rarest terms are asked for.
SLOP, NEAR_TERMS = 20, 5
#: A side is broadcast at this many rows (of some 30 bytes) or fewer; beyond that Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: Ranges of hashes that a search can leave out (a power of 2).
PARTS = 32
#: Bytes of text in a shard on average; a task sorts its postings, which take some 25 times as much memory.
SHARD_BYTES = 4_000_000


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where the (written) table is within BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item, off, term, n`` of every item with a word; ids are kept as strings, rows that repeat are one."""
    one = items.select(F.col(id_col).cast("string").alias("item"), tokens(F.col(text_col)).alias("words")).distinct()
    return one.select("item", F.size("words").alias("n"), F.xxhash64("words").alias("version"), F.posexplode("words").alias("off", "term"))


def part_of(hash_: Column) -> Column:
    """The part of the hashes' range, of PARTS equal ones, that a hash lies in (from -PARTS / 2)."""
    return F.shiftright(hash_, 64 - PARTS.bit_length() + 1)


def in_parts(hash_: Column, parts: list[int]) -> Column:
    """Whether a hash lies in one of the parts: as few ranges of hashes, which the scan of the sorted shards can skip by."""
    width, held = 2**64 // PARTS, set(parts)
    firsts = sorted(p for p in held if p - 1 not in held)
    lasts = sorted(p for p in held if p + 1 not in held)
    found = F.lit(False)
    for first, last in zip(firsts, lasts):
        found = found | hash_.between(first * width, last * width + width - 1)
    return found


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The postings of all tokens of the texts: ``hash, term, row, pos, key``, written to ``path`` (or a new folder) and read back.

    ``docs``: ``key`` and ``text``. ``row`` numbers the input rows. Each text has the empty term after its last word, where
    alone ``key`` is given; a null or wordless text has it at 0.
    """
    spark, path = docs.sparkSession, path or scratch(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.repartition(1 + size // SHARD_BYTES, "key")  # however large the input's own partitions are
    words = F.array_append(tokens(F.col("text")), F.lit(""))
    spread = docs.select("key", F.monotonically_increasing_id().alias("row"), words.alias("words")).select("key", "row", F.posexplode("words").alias("pos", "term"))
    postings = spread.select(F.xxhash64("term").alias("hash"), "term", "row", "pos", F.when(F.col("term") == "", F.col("key")).alias("key"))
    postings.sortWithinPartitions("hash").write.option("compression", "zstd").parquet(path)
    return spark.read.schema(postings.schema).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that ``build_index`` wrote to ``path``."""
    return spark.read.schema("hash long, term string, row long, pos int, key binary").parquet(path)


def postings_of(index: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term_id, row, pos`` of the terms in ``vocabulary`` (``term, term_id``), written; only the parts that these fall in are read."""
    parts = [r[0] for r in vocabulary.select(part_of(F.xxhash64("term"))).distinct().collect()]
    return save(index.filter(in_parts(F.col("hash"), parts)).join(small(vocabulary), "term").select("term_id", "row", "pos"))


def rows_of(index: DataFrame) -> DataFrame:
    """``key, row, n_words`` of each distinct key; of texts that repeat under one the first row stands for all."""
    ends = index.filter((F.col("hash") == F.xxhash64(F.lit(""))) & (F.col("term") == ""))
    return ends.groupBy("key").agg(F.min("row").alias("row"), F.max("pos").alias("n_words"))


def search(index: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """Exact phrase matches: ``item, row, pos`` for each token inside a window of ``window`` item words.

    ``index``: ``term_id, row, pos`` (see ``postings_of``). ``terms``: ``item, version, n, off, term_id``. An item of fewer words is one window.
    """
    df = index.groupBy("term_id").agg(F.count("*").alias("df"))
    terms = terms.withColumn("w", F.least("n", F.lit(window)))
    ranked = terms.join(df, "term_id", "left").withColumn("cost", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term_id"))
    ahead = Window.partitionBy("item", "version").orderBy("off")
    windows = ranked.withColumn("costs", F.collect_list("cost").over(ahead.rowsBetween(0, window - 1))).filter(F.col("off") <= F.col("n") - F.col("w"))
    windows = windows.select("item", "version", F.array_sort("costs").alias("costs"))
    windows = save(windows.filter("costs[0].df > 0").select("item", "version", F.col("costs")[0].alias("first"), F.coalesce(F.get("costs", F.lit(1)), F.col("costs")[0]).alias("second")).distinct())

    def placed(which: str) -> DataFrame:
        rare = windows.select("item", "version", F.col("first.off").alias("f"), F.col("second.off").alias("s"), f"{which}.term_id", f"{which}.off")
        return index.join(small(rare), "term_id").select("item", "version", "f", "s", "row", (F.col("pos") - F.col("off")).alias("base"))

    keys = ["item", "version", "row", "base"]
    likely = save(placed("first").join(placed("second"), [*keys, "f", "s"], "left_semi").select(*keys).distinct())
    rows = save(likely.select("row").distinct())
    near = index.join(small(rows), "row", "left_semi")
    wanted = likely.join(small(save(terms.select("item", "version", "n", "w", "off", "term_id"))), ["item", "version"]).withColumn("pos", F.col("base") + F.col("off"))
    hit = wanted.join(near, ["row", "pos", "term_id"]).select(*keys, "w", "off", "pos").distinct()
    line = Window.partitionBy(*keys).orderBy("off")
    runs = hit.withColumn("run", F.col("off") - F.row_number().over(line))
    long = runs.withColumn("length", F.count("*").over(Window.partitionBy(*keys, "run"))).filter("length >= w")
    return long.select("item", "row", "pos").distinct()


def proximity(index: DataFrame, terms: DataFrame, slop: int = SLOP, most: int = NEAR_TERMS) -> DataFrame:
    """Proximity matches: ``item, row, pos`` where the ``most`` rarest distinct terms of an item (all of fewer) lie within ``slop`` words of the rarest at ``pos``.

    Rare is what has few postings, and of two alike what comes first in the item.
    """
    df = index.groupBy("term_id").agg(F.count("*").alias("df"))
    distinct = terms.groupBy("item", "version", "term_id").agg(F.min("off").alias("off"))
    own = Window.partitionBy("item", "version")
    ranked = distinct.join(df, "term_id", "left").withColumn("rank", F.row_number().over(own.orderBy(F.coalesce("df", F.lit(0)), "off"))).filter(F.col("rank") <= most)
    wanted = ranked.groupBy("item", "version").agg(F.count("*").alias("n_terms"))
    ranked = save(ranked.join(wanted, ["item", "version"]))
    place = lambda c: F.floor(F.col(c) / slop)

    def placed(rank: int) -> DataFrame:
        return index.join(small(save(ranked.filter(F.col("rank") == rank).select("item", "version", "n_terms", "term_id"))), "term_id").select("item", "version", "n_terms", "row", "pos")

    around = F.explode(F.array(*(place("at") + d for d in (-1, 0, 1)))).alias("cell")
    at = placed(1).withColumnRenamed("pos", "at")
    second = placed(2).select("item", "version", "row", "pos", place("pos").alias("cell"))
    keys = ["item", "version", "row"]
    pairs = at.filter("n_terms > 1").select("*", around).join(second, [*keys, "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    # the other terms are asked for around the places alone where the two rarest meet
    likely = save(at.filter("n_terms = 1").unionByName(pairs.select(at.columns)).distinct())
    cells = save(likely.select("row", around).distinct())
    close = index.withColumn("cell", place("pos")).join(small(cells), ["row", "cell"], "left_semi")
    others = close.join(small(save(ranked.select("item", "version", "term_id"))), "term_id")
    met = likely.select("*", around).join(others, [*keys, "cell"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    full = met.groupBy("item", "row", "at", "n_terms").agg(F.countDistinct("term_id").alias("seen")).filter("seen = n_terms")
    return full.select("item", "row", F.col("at").alias("pos")).distinct()


def spelt_in_ids(items: DataFrame, item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The items' ``terms`` (``item, version, n, off, term_id``) and ``vocabulary`` (``term, term_id``), written."""
    spelt = save(item_terms(items, item_id, item_text))
    vocabulary = save(spelt.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    return save(spelt.join(vocabulary, "term").select("item", "version", "n", "off", "term_id")), vocabulary


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The index of a table of documents, which any number of searches may share."""
    return build_index(docs.select(row_key(F.col(id_col), F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text")), path)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    carry: list[str] | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Per row of ``docs``: ``doc`` (a struct of its columns, or of ``carry`` alone), ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted ids), ``n_near``.

    A word is hit inside any occurrence of ``window`` consecutive words of an item (an item of
    fewer words is one window; one without words none). ``n_near`` counts the items with a proximity
    match. Null texts have no words, null item ids no place in ``items``; rows that repeat id and
    text return alike; either table may be empty. ``index`` is what ``index_documents`` made of ``docs``, where it is at hand.
    """
    index = index or index_documents(docs, id_col, text_col)
    terms, vocabulary = spelt_in_ids(items, item_id, item_text)
    lists = postings_of(index, vocabulary)
    hits = search(lists, terms, window)
    by_row = hits.groupBy("row").agg(F.countDistinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    near = proximity(lists, terms).groupBy("row").agg(F.countDistinct("item").alias("n_near"))
    found = save(rows_of(index).join(by_row, "row", "left").join(near, "row", "left").drop("row"))
    keyed = docs.select(row_key(F.col(id_col), F.col(f"`{text_col}`")).alias("key"), row_of(docs, carry).alias("doc"))
    counted = keyed.join(found, "key", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.select("doc", zero("n_words"), zero("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), zero("n_near"))


def without_leaks(
    docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    index: DataFrame | None = None,
) -> DataFrame:
    """The rows of ``docs`` whose text holds no window of an item, unchanged."""
    index = index or index_documents(docs, id_col, text_col)
    terms, vocabulary = spelt_in_ids(items, item_id, item_text)
    rows = save(search(postings_of(index, vocabulary), terms, window).select("row").distinct())
    leaks = save(rows_of(index).join(small(rows), "row", "left_semi").select("key"))
    keyed = docs.select(row_key(F.col(id_col), F.col(f"`{text_col}`")).alias("key"), row_of(docs).alias("doc"))
    return keyed.join(small(leaks), "key", "left_anti").select("doc.*")


def contamination_sql(window: int = 10) -> str:
    """DuckDB SQL of the figures of ``contamination`` over ``documents`` and ``benchmark``."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""WITH i AS (SELECT item_id, {words} AS w FROM benchmark), d AS (SELECT doc_id, {words} AS w FROM documents),
        s AS (SELECT item_id, w, least({window}, len(w)) AS k, unnest(range(len(w) - least({window}, len(w)) + 1)) AS p FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS g FROM s),
        t AS (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
        hit AS (SELECT doc_id, item_id, t.k, p FROM (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS g FROM t) t JOIN iw ON t.k = iw.k AND t.g = iw.g),
        spots AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM hit) GROUP BY doc_id),
        found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
        it AS (SELECT item_id, t, min(off) AS off FROM (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS off FROM i) GROUP BY item_id, t),
        po AS MATERIALIZED (SELECT doc_id, t, p FROM (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS p FROM d) WHERE t IN (SELECT t FROM it)), df AS (SELECT t, count(*) AS df FROM po GROUP BY t),
        rk AS (SELECT * FROM (SELECT item_id, t, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), off) AS r FROM it LEFT JOIN df USING (t)) WHERE r <= {NEAR_TERMS}),
        at_ AS (SELECT item_id, doc_id, p AS x FROM rk JOIN po USING (t) WHERE r = 1), full_ AS (SELECT a.item_id, a.doc_id, x FROM at_ a JOIN rk k ON a.item_id = k.item_id JOIN po o ON o.doc_id = a.doc_id AND o.t = k.t AND abs(o.p - x) <= {SLOP}
            GROUP BY a.item_id, a.doc_id, x HAVING count(DISTINCT k.t) = (SELECT count(*) FROM rk q WHERE q.item_id = a.item_id)), near AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM full_ GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(near.n, 0)::BIGINT AS n_near, coalesce(spots.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(spots.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)"""
