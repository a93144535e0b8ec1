import random
import re

import quillstream.llm.decontaminate as m
from quillstream.llm.common import save

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            x = words(text)
            size = min(window, len(x))
            for s in range(len(x) - size + 1) if x else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit |= set(range(p, p + size))
                        if item is not None:
                            found.add(str(item))
        out.append((-1 if i is None else i, len(w), len(hit), len(found), tuple(sorted(found))))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "Ab", "É", "x1", "qq", "rr", "ss", "tt"])
    items = [(i, " ".join(word() for _ in range(rng.randint(3, 25)))) for i in range(12)] + [(20, None), (21, "..."), (22, "the"), (3, "the of ab ab ab of the of the of the")]
    docs = []
    for i in range(60):
        parts = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            x = rng.choice(items[:12])[1].upper().split(" ")
            parts += x[: rng.randint(1, len(x))] + [word()] + x
        docs.append((i, "; ".join(parts)))
    docs += [(7, docs[7][1]), (7, "other"), (None, docs[3][1]), (90, None), (91, "")]
    found = m.contamination(
        spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, items string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = sorted((-1 if r.doc.doc_id is None else r.doc.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in found.collect())
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in m.contamination(docs, items.limit(0)).collect()] == [(2, 0)]
    assert m.contamination(docs.limit(0), items).count() == 0


def near_rows(docs, items, slop):
    """The definition: the rarest five distinct terms of an item all within slop words of the rarest."""
    texts = [words(t) for _, t in docs]
    df, out = {}, set()
    for w in texts:
        for x in w:
            df[x] = df.get(x, 0) + 1
    for item, text in items:
        first = {}
        for off, x in enumerate(words(text)):
            first.setdefault(x, off)
        rare = sorted(first, key=lambda x: (df.get(x, 0), first[x]))[:5]
        for (i, _), w in zip(docs, texts):
            if rare and any(x == rare[0] and all(r in w[max(0, p - slop) : p + slop + 1] for r in rare) for p, x in enumerate(w)):
                out.add((str(item), i))
    return out


def test_proximity_matches_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150)))) for i in range(60)] + [(60, None), (61, ""), (62, "red x x blue x green"), (63, "green blue red"), (64, "red " + "x " * 30 + "blue green")]
    items = [(i, " ".join(rng.choice(vocabulary[: rng.choice([4, 30])]) for _ in range(rng.randint(1, 8)))) for i in range(15)] + [(50, "red green blue"), (51, "red"), (52, None), (53, "absent red"), (50, "red green blue")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index = m.index_documents(table)
    terms, held = m.spelt_in_ids(spark.createDataFrame(items, "item_id long, text string"))
    lists = m.postings_of(index, held)
    id_of = {r.row: r.doc_id for r in m.rows_of(index).join(table.select(m.row_key(m.F.col("doc_id"), m.F.col("text")).alias("key"), "doc_id"), "key").collect()}
    for slop in (6, 20):
        assert {(r["item"], id_of[r.row]) for r in m.proximity(lists, terms, slop=slop).collect()} == near_rows(docs, items, slop)


def test_benchmarks_share_an_index(spark, tmp_path):
    """All terms are stored, so a later benchmark is searched without the texts; only the parts of its terms are read."""
    docs = [(i, f"alpha beta{i % 3} gamma delta epsilon{i % 5}") for i in range(30)] + [(40, "zeta " * 5_000 + "rare eta theta")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    assert m.index_documents(table, path=path).count() == sum(len(words(t)) + 1 for _, t in docs)
    for items in ([(1, "beta1 gamma delta"), (2, "delta epsilon4")], [(3, "rare eta theta"), (4, "zeta zeta zeta")]):
        given = spark.createDataFrame(items, "item_id long, text string")
        found = m.contamination(table, given, index=m.open_index(spark, path))
        assert sorted((r.doc.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in found.collect()) == brute(docs, items)
    parts = [-16, -15, 3, 15]
    one = m.open_index(spark, path).withColumn("part", m.part_of(m.F.xxhash64("term")))
    assert {r.part for r in one.filter(m.in_parts(m.F.col("hash"), parts)).collect()} == set(parts) & {r.part for r in one.collect()}
    plan = m.open_index(spark, path).filter(m.in_parts(m.F.col("hash"), parts))._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(Or(And(GreaterThanOrEqual(hash," in plan


def test_shards_of_the_index_are_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "SHARD_BYTES", 1_000)
    docs = spark.createDataFrame([(i, f"word{i} of the text " * 10) for i in range(60)] + [(60, None)], "doc_id long, text string").coalesce(1)
    index = m.index_documents(docs, path=f"{tmp_path}/index")
    assert len(list((tmp_path / "index").glob("part-*.parquet"))) > 8 and index.count() == 60 * 41 + 1
    assert m.index_documents(docs.limit(0)).count() == 0
