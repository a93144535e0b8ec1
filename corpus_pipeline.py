"""From raw documents to a training mix: language, near copies, repeated passages, benchmark leaks, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import decontaminate, language, mixing, simhash, substrings
from quillstream.llm.common import remainder, row_key, save, table

#: A document is rejected whose language is unknown, or that is farther from every learned one than this allows (1: the calibrated limit).
MOST_STRANGE = 1.0
#: Near copies. Two fingerprints of word pairs, which edits change least, are searched within 7 bits of 64 (over 4 blocks
#: of 16 bits); four of five-word shingles prove a pair within 46 bits of 256, what 0.8 of the shingles in common come to, and a margin.
PAIRS, SEARCHED, BITS, BLOCKS, SHINGLE, PROOFS, ALL_BITS = 2, 2, 7, 4, 5, 4, 46
#: Passages of so many words or more that an earlier document has too are cut.
PASSAGE = 20
#: Benchmark windows, in words.
WINDOW = 10


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in learned languages, unchanged."""
    model = language.train(docs.filter(remainder("doc_id", 4) != 2))
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("strangeness") <= MOST_STRANGE)).select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id, and of rows that repeat id and text one."""
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    name = F.struct(F.col("doc.doc_id").isNull().alias("missing"), F.col("doc.doc_id").alias("doc_id"), "row")
    found = simhash.near_duplicates(keyed.select(name.alias("name"), "doc.text"), PAIRS, BITS, BLOCKS, "name", searched=SEARCHED, proof=(SHINGLE, PROOFS), most=ALL_BITS)
    kept = save(found.filter("id = component").select(F.col("id.row").alias("row")).distinct())
    return keyed.join(kept, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too; texts that lose every word go."""
    rest = [c for c in docs.columns if c != "text"]
    found = substrings.remove_repeats(docs, run=PASSAGE, layout=True, carry=rest).filter("n_removed = 0 or n_removed < n_words")
    now = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(F.length("kept"))}
    return found.select(*(now.get(c, F.col(f"doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"), window=WINDOW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target weights, with their tokens, learned topic and probability (under names of their own where ``docs`` has these)."""
    taken, added = {c.lower() for c in docs.columns}, []
    for c in ("tokens", "topic", "probability"):
        name = c
        while name in taken:
            name = f"mix_{name}"
        added.append(F.col(c).alias(name))
    return mixing.mix(docs, learn_topics=True).filter("drawn").select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns), *added)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir))
    return docs
