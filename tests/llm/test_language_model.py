import math
import random
from collections import Counter, defaultdict

import numpy as np

import quillstream.llm.language_model as m


def slow_ppm(train, text):
    """PPM, method C, with exclusion, byte by byte."""
    seen = defaultdict(Counter)
    for t in train:
        b = bytes(m.ORDER) + (t or "").encode().lower()
        for i in range(m.ORDER, len(b)):
            for k in range(m.ORDER + 1):
                seen[b[i - k : i]][b[i]] += 1
    b, total = bytes(m.ORDER) + (text or "").encode().lower(), 0.0
    for i in range(m.ORDER, len(b)):
        refused, q = set(), 0
        for k in range(m.ORDER, -1, -1):
            ctx = {s: n for s, n in seen[b[i - k : i]].items() if s not in refused} if b[i - k : i] in seen else None
            if ctx is None:
                continue
            if b[i] in ctx:
                total += math.log10(ctx[b[i]] / (sum(ctx.values()) + len(ctx)))
                break
            if ctx:
                total += math.log10(len(ctx) / (sum(ctx.values()) + len(ctx)))
            refused |= set(ctx)
            q = len(refused)
        else:
            total -= math.log10(max(1, 256 - q))
    return total


def corpus():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "Cat", "sat", "été", "on", "mat", "é", "x" * rng.randint(1, 4)]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    return docs + [(70, None), (71, ""), (72, "zzz unseen #~"), (3, docs[3][1]), (3, docs[3][1])]


def test_matches_brute_force(spark):
    docs = corpus()
    train = [t for i, t in docs if i % 5]
    counts = Counter(w for t in train for w in m.to_tokens(t))
    n, v = sum(counts.values()), len(counts)
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    for head in (3, 1000):
        found = m.score_documents(df, df.filter("doc_id % 5 <> 0"), head=head).collect()
        assert sorted(r.doc.doc_id for r in found) == sorted(i for i, _ in docs)
        for r in found:
            tokens = m.to_tokens(r.doc.text)
            assert (r.n_tokens, r.train_tokens, r.n_known) == (len(tokens), n, sum(counts[t] > 0 for t in tokens))
            assert abs(r.base_score - sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)) < 1e-9
            assert abs(r.score - slow_ppm(train, r.doc.text)) < 1e-6


def test_bounded_trie_and_no_training(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    trie = m.train_trie(docs.select("text"), nodes=50)
    assert 0 < len(trie.seen[0][0]) <= 50
    for r in m.score_documents(docs, docs.limit(0)).collect():
        assert r.n_known == 0 and abs(r.score + len((r.doc.text or "").encode()) * math.log10(256)) < 1e-9
    assert m.score_documents(docs.limit(0), docs).count() == 0


def test_events_beyond_the_broadcast_count(spark):
    docs = corpus() + [(80 + i, "".join(map(chr, random.Random(i).sample(range(0x4E00, 0x9FA5), 40)))) for i in range(6)]
    train = [t for i, t in docs if i % 5]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for nodes in (0, 50, 400):
        found = m.score_documents(df, df.filter("doc_id % 5 <> 0"), nodes=nodes).collect()
        assert sorted(r.doc.doc_id for r in found) == sorted(i for i, _ in docs)
        for r in found:
            assert abs(r.score - slow_ppm(train, r.doc.text)) < 1e-6


def test_chances_of_a_context_add_up():
    codes, _ = m.events([t for _, t in corpus()])
    trie = m.Trie(*np.unique(codes, return_counts=True))
    for context in (0x746865, 0x20_6d_61, 0x7A7A7A):
        p = 10 ** trie.work_out(np.array([context << 8 | b for b in range(256)], np.uint32))
        assert 0.9 < p.sum() < 1.0001
