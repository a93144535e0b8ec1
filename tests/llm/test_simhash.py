import random

import numpy as np
import pytest
import xxhash

from quillstream.llm.components import components
from quillstream.llm.queries import QUERIES
from quillstream.llm.simhash import anchor_masks, fingerprint, near_duplicates, near_links, sums, syndrome


def slow_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_fingerprint_matches_definition():
    for text in (None, "", "  \t", "one", "One TWO", "a b c", "a b c a b c d e É é", "x y " * 3000):
        for k in (3, 5):
            assert fingerprint(text, k) == slow_fingerprint(text, k) == sums(text, ((2, 3), (k, 2)))[3]
    assert len(set(sums("a b c d e", ((2, 3), (5, 3))))) == 6


@pytest.mark.parametrize("width", [16, 32])
def test_anchors_cover_and_meet(width):
    rng, masks = random.Random(width), anchor_masks(width)
    reach = lambda y: {y ^ int(m) for m in masks[int(syndrome(np.array([y], np.uint64), width)[0])]}
    for _ in range(300):
        x = rng.getrandbits(width)
        s = int(syndrome(np.array([x], np.uint64), width)[0])
        home = x ^ int(masks[s][0])
        assert bin(home ^ x).count("1") <= 1
        for a in reach(x):
            assert int(syndrome(np.array([a], np.uint64), width)[0]) == 0 and bin(a ^ x).count("1") <= 2
        for bit in range(width):
            assert home in reach(x ^ 1 << bit)


@pytest.mark.parametrize(("threshold", "blocks"), [(3, 2), (7, 4)])
def test_links_match_brute_force(spark, monkeypatch, threshold, blocks):
    import quillstream.llm.simhash as m

    monkeypatch.setattr(m, "PIECE", 40)  # forces hot anchors into blocks
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = rng.choice(fps[:20])
        for _ in range(rng.randint(1, threshold + 2)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= threshold]
    links = near_links(spark.createDataFrame([(x, x) for x in fps], "node long, f0 long"), threshold, blocks)
    assert {r.node: r.root for r in components(links).collect()} == groups(near)


def test_several_fingerprints_match_brute_force(spark, monkeypatch):
    import quillstream.llm.simhash as m

    monkeypatch.setattr(m, "PIECE", 60)
    rng = random.Random(6)
    rows = [[rng.getrandbits(64) for _ in range(2)] for _ in range(30)]
    for _ in range(400):
        x = list(rng.choice(rows[:30]))
        for _ in range(rng.randint(1, 20)):
            x[rng.randrange(2)] ^= 1 << rng.randrange(64)
        rows.append(x)
    apart = lambda a, b: [(x ^ y).bit_count() for x, y in zip(a, b)]
    for r in rows:
        r.append(rng.choice([0, 1, 3]) << 5)
    near = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[i + 1 :], i + 1) if min((d := apart(a, b))[:2]) <= 7 and d[2] <= 1]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = near_links(spark.createDataFrame([(i, *map(signed, r)) for i, r in enumerate(rows)], "node long, f0 long, f1 long, f2 long"), 7, 4, 2, 1)
    assert {r.node: r.root for r in components(links).collect()} == groups(near)


def test_replicas_move_once(spark):
    links = near_links(spark.createDataFrame([(i, i << 20, i) for i in range(50)], "node long, f0 long, f1 long"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan


def test_components_of_path_and_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == groups(edges[:-1])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_edge_cases(spark):
    rows = [(3, "a b c d", 1), (1, "A b  c d", 1), (None, "a b c d", 1), (9, None, 1), (8, "", 1), (5, "other words in here", 1), (5, "other words in here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    found = sorted((r.id is None, r.id or 0, r.component) for r in near_duplicates(docs).collect())
    assert found == [(False, 1, 1), (False, 3, 1), (False, 5, 5), (False, 5, 5), (False, 8, 8), (False, 9, 8), (True, 0, 1)]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    fps = {r.doc_id: slow_fingerprint(r.text, 3) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(fps)
    root = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3])
    found = QUERIES["op4_simhash"](spark, sf).collect()
    assert sorted(tuple(r) for r in found) == [(i, f"{fps[i]:016x}", root.get(i, i)) for i in ids]
