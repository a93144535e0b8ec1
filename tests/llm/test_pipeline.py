"""The stages on a small corpus, each held against a plain recomputation on its own input."""

import re

import corpus_pipeline as p
import pytest

from quillstream.llm.common import save
from quillstream.llm.simhash import sums
from test_simhash import groups
from test_substrings import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    extra = spark.createDataFrame([(9001, "12 34 !!", "en", "s", 8), (9002, None, None, None, None), (9003, "", "en", "s", 0)], docs.schema)
    docs = docs.unionAll(extra).unionAll(docs.limit(3))
    for name, stage in p.STAGES:
        after = save(stage(spark, docs, sf))
        out.append((name, docs.collect(), after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_language_rejects_only_the_unknown(stages):
    before, after = stages["language_id"]
    left = {r.doc_id for r in after.collect()}
    assert after.columns == COLUMNS
    assert {r.doc_id for r in before} - left <= {r.doc_id for r in before if not any(map(str.isalpha, r.text or ""))} and not left & {9001, 9002, 9003}


def test_unlearned_languages_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = docs.filter("lang = 'fr'").collect()
    known = docs.filter("lang <> 'fr'").count()
    unlabelled = docs.withColumn("lang", p.F.when(p.F.col("lang") != "fr", p.F.col("lang")))
    short = spark.createDataFrame([(9001, "The", None, None, 3), (9002, "der und in den", None, None, 14), (9003, "Привет, как дела? Сегодня хорошая погода", None, None, 40)], docs.schema)
    left = {r.doc_id for r in p.identify_language(spark, unlabelled.unionAll(short), None).collect()}
    ids = {r.doc_id for r in foreign if len(r.text) >= 500}
    assert len(ids & left) <= 0.05 * len(ids) and len(left - {r.doc_id for r in foreign}) >= 0.99 * known and left & {9001, 9002, 9003} == {9001, 9002}


def test_one_of_each_group_stays(stages):
    before, after = stages["simhash_near_dedup"]
    fps = {r.doc_id: sums(r.text, ((p.PAIRS, p.SEARCHED), (p.SHINGLE, p.PROOFS))) for r in before}
    ids = sorted(fps)
    apart = lambda a, b: [(x ^ y).bit_count() for x, y in zip(fps[a], fps[b])]
    root = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if min((d := apart(a, b))[: p.SEARCHED]) <= p.BITS and sum(d[p.SEARCHED :]) <= p.ALL_BITS])
    assert after.columns == COLUMNS
    assert sorted(r.doc_id for r in after.collect()) == [i for i in ids if root.get(i, i) == i]


def test_passages_are_cut(stages):
    before, after = stages["substring_dedup"]
    wanted = {i: kept for i, n, gone, kept in brute([(r.doc_id, " ".join(re.findall(r"[^\x20\x09-\x0d]+", r.text))) for r in before], p.PASSAGE) if gone < n}
    assert after.columns == COLUMNS
    old = {r.doc_id: r.text for r in before}
    found = {r.doc_id: r for r in after.collect()}
    assert {i: " ".join(re.findall(r"[^\x20\x09-\x0d]+", r.text)) for i, r in found.items()} == wanted
    assert all(r.n_chars == len(r.text) for i, r in found.items() if r.text != old[i])


def test_leaks_go(stages, spark):
    before, after = stages["decontamination"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t))
    runs = set()
    for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect():
        w = words(r.text)
        runs |= {tuple(w[i : i + p.WINDOW]) for i in range(max(1, len(w) - p.WINDOW + 1))}
    assert min(map(len, runs)) == p.WINDOW
    clean = {r.doc_id for r in before if not any(tuple(w[i : i + p.WINDOW]) in runs for w in [words(r.text)] for i in range(len(w) - p.WINDOW + 1))}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < len(before)


def test_mix_draws_from_its_input(stages):
    before, after = stages["source_mixing"]
    got = after.collect()
    assert 0 < len(got) < len(before) and {r.doc_id for r in got} <= {r.doc_id for r in before} and all(0 < r.probability <= 1 for r in got)


def test_mix_learns_topics(stages):
    before, after = stages["decontamination"][1], stages["source_mixing"][1]
    words = p.mixing.topic_words(before.select("text", p.F.coalesce("lang", p.F.lit(p.mixing.MISSING)).alias("lang")))
    got = {r.topic for r in after.select("topic").distinct().collect()}
    assert got <= {*words, p.mixing.MISSING} and len(got) > 5


def stage_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = " ".join(f"the word{i % 5000} and of" for i in range(60_000))
    extra = [(9001, long, "en", "s", len(long)), (9002, None, None, None, None), (9003, "", None, "s", 0), (None, "the house and the garden of it", "en", None, 30), (9005, "the the the the", "en", "s", 15), (9005, "the the the the", "en", "s", 15)]
    return docs.filter("doc_id < 60").unionAll(spark.createDataFrame(extra, docs.schema))


@pytest.mark.parametrize("name", [n for n, _ in p.STAGES])
def test_odd_inputs(spark, name):
    """Nulls, empty and very long texts, repeated rows, clashing column names, and an empty table, stage by stage."""
    stage, docs = dict(p.STAGES)[name], stage_inputs(spark)
    for c in ("row", "id", "doc", "topic", "tokens", "probability", "spans", "f0", "component", "a.b"):
        docs = docs.withColumn(c, p.F.lit("kept"))
    after = save(stage(spark, docs, "/root/testdata/sf0.001"))
    assert after.columns[: len(docs.columns)] == docs.columns
    rows = after.collect()
    assert all(r.row == r.doc == r.topic == "kept" for r in rows) and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    if name == "simhash_near_dedup":
        assert sum(r.doc_id == 9005 for r in rows) == 1 and 9001 in {r.doc_id for r in rows}
    if name == "decontamination":
        assert {9001, 9002, 9003, None} <= {r.doc_id for r in rows} and sum(r.doc_id == 9005 for r in rows) == 2
    if name == "language_id":
        assert 9001 in {r.doc_id for r in rows} and not {9002, 9003} & {r.doc_id for r in rows}
    none = stage(spark, docs.limit(0), "/root/testdata/sf0.001")
    assert none.count() == 0 and none.columns == after.columns
