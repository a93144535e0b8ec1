"""The registered queries on the small tables, against SQL or a plain recomputation."""

import math
import zlib
from collections import Counter

import pytest
from llm_compare import assert_same

from quillstream.llm.queries import ORACLES, QUERIES
from test_language_model import m as lm
from test_language_model import slow_ppm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_decontamination", "op6_substrings", "op9_warc", "op11_source_divergence", "op12_hard_negatives", "op13_suffix_array"])
def test_matches_sql(spark, name):
    assert assert_same(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.01") >= 150


def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op8(spark):
    docs = documents(spark)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [d.text for i, d in docs.items() if not held(i)]
    counts = Counter(w for t in train for w in lm.to_tokens(t))
    n, v = sum(counts.values()), len(counts)
    found = QUERIES["op8_language_model"](spark, SF).collect()
    assert len(found) == len(docs)
    better = 0
    for r in found:
        tokens = lm.to_tokens(docs[r.doc_id].text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel_tol=1e-9)
        better += r.score > len((docs[r.doc_id].text or "").encode()) * math.log10(1 / 64)
    assert better > 0.9 * len(found)
    some = min(found, key=lambda r: (not r.held_out, r.n_tokens))
    assert math.isclose(some.score, slow_ppm(train, docs[some.doc_id].text), rel_tol=1e-6)


def test_op10_held_out_accuracy(spark):
    docs = documents(spark)
    found = [r for r in QUERIES["op10_language_id"](spark, SF).collect() if r.held_out]
    assert found and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in found) >= 0.97 * len(found)
