import math

import numpy as np

import quillstream.llm.cotraining as m
from quillstream.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert len(found) == 1000 and all(0 <= s <= 1 for r in found for s in (r.score, r.text_score, r.meta_score))
    tested = [(r.kept, labels[r.doc_id]) for r in found if r.held_out and r.doc_id in labels]
    good, bad = ([k for k, q in tested if q == v] for v in (1, 0))
    assert len(tested) > 40 and sum(good) > 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    text = np.zeros((n, m.TEXT_DIMS), np.float32)
    meta = np.zeros((n, m.META_DIMS), np.float32)
    text[np.arange(n), y * 20 + rng.integers(0, 20, n)] = 1
    meta[np.arange(n), y * 20 + rng.integers(0, 20, n)] = 1
    model = m.CoTrained(text[:24], meta[:24], y[:24], text[24:400], meta[24:400], rounds=6, handed=30)
    alone = m.fit_logistic(text[:18], y[:18])
    right = lambda s: ((s > 0.5) == y[400:]).mean()
    assert right(model.score(text[400:], meta[400:])[0]) > right(m.sigmoid(m.apply(alone, text[400:]))) + 0.05


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1.0), (2, "", "s", "en", 0, 1.0), (2, "", "s", "en", 0, 1.0), (None, "w " * 60_000, "s", "en", 1, 1.0)], "doc_id long, text string, source string, lang string, n_chars long, y double")
    labels = spark.createDataFrame([(1, None), (1, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0), labels.unionAll(spark.createDataFrame([(2, 0)], labels.schema))):
        found = m.score_documents(docs, m.train(docs, given)).collect()
        assert len(found) == 4 and all(0 <= r.score <= 1 for r in found)
    assert m.score_documents(docs.limit(0), m.train(docs.limit(0), labels)).count() == 0


def slow_score(model, row):
    """Both views' chances and their sum as evidence, with loops over features made one text at a time."""
    t, meta = m.text_features([row.text])[0], m.meta_features([(row.source, row.lang, row.n_chars)])[0]
    z = []
    for w, x, (a, b) in zip(model.w, (t, meta), model.scale):
        z.append(a * (sum(float(v) * float(u) for v, u in zip(x, w) if v) + float(w[-1])) + b)
    chance = lambda v: 1 / (1 + math.exp(-max(-30, min(30, v))))
    return chance(z[0] + z[1] - model.prior), chance(z[0]), chance(z[1])


def test_query_matches_brute_force(spark):
    from quillstream.llm.common import remainder, table
    from quillstream.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = m.train(docs.filter(remainder("doc_id", 5) != 1), table(spark, sf, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    got = QUERIES["op3_quality_classifier"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = slow_score(model, rows[r.doc_id])
        assert all(abs(x - y) < 1e-4 for x, y in zip((r.score, r.text_score, r.meta_score), wanted)) and r.kept == (r.score >= 0.5)


def test_repeated_ids_count_once(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} of some words", "s", "en", 20) for i in range(500)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen = {}
    real, m.CoTrained = m.CoTrained, lambda text, meta, y, pool_text, pool_meta: seen.update(labelled=len(y), pool=len(pool_text))
    try:
        m.train(docs, labels)
    finally:
        m.CoTrained = real
    assert seen == {"labelled": 40, "pool": 10}
