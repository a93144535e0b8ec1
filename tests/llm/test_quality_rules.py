import random
from collections import Counter

import pytest
from llm_compare import assert_same

import quillstream.llm.quality_rules as m
from quillstream.llm.queries import ORACLES, QUERIES


def brute(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("lookup", [2_000_000, 0])
def test_measures_match_brute_force(spark, monkeypatch, lookup):
    monkeypatch.setattr(m, "LOOKUP", lookup)
    rng = random.Random(1)
    texts = [None, "", "a", "a b", "a b c", "a a a a", "x\n\nx\n \nx y", "éé #$ 　 <b>\n" * 3, "p q r s " * 4000]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(3, 60))) + "\n" * rng.randint(0, 2) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "a b c", 9), (3, "a b", 9)], "doc_id long, text string, n_words int")
    for r in m.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.doc.text)
        assert 0 <= r.quality <= 1 and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert m.judge(docs.limit(0)).count() == 0


def test_matches_sql(spark):
    assert assert_same(spark, QUERIES["op7_quality_rules"], ORACLES["op7_quality_rules"], "/root/testdata/sf0.01") == 1000


def test_em_finds_accuracies(spark):
    rng, right = random.Random(0), [0.9, 0.8, 0.65, 0.7]
    rows = []
    for _ in range(6000):
        y = 1 if rng.random() < 0.6 else -1
        rows.append(tuple(0 if rng.random() < 0.2 else y if rng.random() < p else -y for p in right))
    patterns = spark.createDataFrame([(*k, n) for k, n in Counter(rows).items()], "a int, b int, c int, d int, n long")
    prior, accuracy = m.fit(patterns, ["a", "b", "c", "d"], rounds=60)
    assert abs(prior - 0.6) < 0.06 and all(abs(x - y) < 0.06 for x, y in zip(accuracy, right))


def test_clean_documents_stay(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.01").collect()}
    good = [found[i].kept for i, q in labels.items() if q == 1 and not found[i].base_failed]
    assert sum(good) > 0.97 * len(good)
