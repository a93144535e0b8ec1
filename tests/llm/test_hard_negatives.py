import math
import random

import pytest

import quillstream.llm.hard_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=3):
    usable = {(i, label, tuple(math.floor(256 * x) for x in vec)) for i, vec, label in rows if None not in (i, vec, label) and all(x is not None and math.isfinite(x) for x in vec)}
    out = []
    for me in usable:
        if me[0] % 50:
            continue
        score = lambda o: sum(x * y for x, y in zip(me[2], o[2]))
        mine = sorted((-score(o), o[0]) for o in usable if o[1] == me[1] and o != me)[:positives]
        other = sorted((-score(o), o[0]) for o in usable if o[1] != me[1])
        for p, i in mine:
            found = [(-s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(me[0], i, k, j, -p, s) for k, (s, j) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clusters(rng, n, dims, labels=4):
    middle = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    vec = lambda: [float(x + rng.gauss(0, 0.4)) for x in rng.choice(middle)]
    return [(i, [float(m.np.float32(x)) for x in vec()], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dims", [2, 8])
def test_matches_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(m, "LEAST", 8)
    monkeypatch.setattr(m, "ARITY", 4)
    monkeypatch.setattr(m, "PRODUCTS", 200)
    rng = random.Random(dims)
    rows = clusters(rng, 900, dims)
    copy = rows[7][1]
    rows += [(1000 + i, copy, i % 2) for i in range(400)]  # a third are copies; ids 1000, 1050, ... are anchors
    rows += [(2000, None, 1), (2050, rows[0][1], None), (2100, [float("nan")] * dims, 1), (2150, [None] * dims, 1), (2200, [0.0] * dims, 2), (None, copy, 1), (2250, [1.0], 0), (2300, [], 1), (2350, [float("inf")] * dims, 1)]
    rows += [rows[50], rows[50], (50, rows[3][1], 1), (2400, [-x for x in copy], 7), (2450, rows[100][1], 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", m.F.lit(1)).withColumn("a.b", m.F.lit(2)).withColumn("leaf", m.F.lit(3)).repartition(3)
    assert rows_of(m.mine(df, m.F.expr("vec_id % 50 = 0"), leaf=40, block=50, sample=300)) == brute(rows)


def test_search_prunes(spark):
    """With clusters far apart most leaves are left out, and nothing is lost."""
    rng = random.Random(3)
    rows = clusters(rng, 3000, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    given = df.selectExpr("vec_id id", "cast(label as string) label", "cast(embedding as array<double>) vec", "false anchor").mapInArrow(m._scaled(256, 3), "id long, label string, vec binary, anchor boolean, norm double")
    points = m.points_of(given.withColumn("key", m.F.unhex(m.F.md5(m.F.concat("vec", m.F.col("label").cast("binary"))))), 6)
    tree = m.fit(points, 3, 50, 3000)
    points = m.index(points, tree, 3, 1000)
    assert tree.n_leaves > 20 and points.count() == 3000
    asked = points.filter("pid % 10 = 0").selectExpr("pid qid", "label", "vec", "array(struct(0L w, cast(0.9 * norm as long) low, cast(1.1 * norm as long) high)) spans")
    routed = m.route(asked, tree, 3)
    assert routed.count() < 0.5 * asked.count() * tree.n_leaves
    assert rows_of(m.mine(df, m.F.expr("vec_id % 50 = 0"), leaf=50)) == brute(rows)


def test_large_components(spark):
    rows = [(i, [1e18 * (i + 1), -3e25, 2.0], i % 2) for i in range(60)]
    found = m.mine(spark.createDataFrame(rows, SCHEMA), m.F.expr("vec_id = 0"), low=0, high=100).collect()
    assert found and all(r.positive_score == m.NO_HIGH for r in found)


def test_empty(spark):
    assert m.mine(spark.createDataFrame([], SCHEMA), m.F.expr("vec_id % 50 = 0")).count() == 0
    assert m.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA), m.F.expr("vec_id % 50 = 0")).count() == 0
