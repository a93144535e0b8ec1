import random

import pytest
import quillstream.llm.substrings as m


def brute(rows, run=13):
    least = {}
    for i, t in rows:
        w = [x for x in (t or "").split(" ") if x]
        for p in range(len(w) - run + 1):
            s = tuple(w[p : p + run])
            key = m.NULL_ID if i is None else i
            least[s] = min(least.get(s, m.NULL_ID), key)
    out = []
    for i, t in rows:
        w = [x for x in (t or "").split(" ") if x]
        gone = set()
        for p in range(len(w) - run + 1):
            if least[tuple(w[p : p + run])] < (m.NULL_ID if i is None else i):
                gone |= set(range(p, p + run))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    passages = [[word() for _ in range(rng.choice([10, 20, 40, 200]))] for _ in range(10)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(rng.randint(0, 4)):
            passage = list(rng.choice(passages))
            if rng.random() < 0.5:  # a near copy, or a part
                passage[rng.randrange(len(passage))] = word()
            if rng.random() < 0.3:
                passage = passage[rng.randrange(len(passage)) :]
            w += [word() for _ in range(rng.randint(0, 30))] + (passage if rng.random() < 0.7 else [])
        rows.append((i, " ".join(w)))
    rows += [(500, rows[7][1]), (500, rows[7][1]), (501, None), (502, ""), (None, rows[9][1]), (503, "the " * 100), (504, "the " * 60), (500, rows[11][1])]
    rows += [(505, "on and on we go " * 40), (506, "go on and on we " * 50)]
    rng.shuffle(rows)
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return [(r.doc.doc_id, r.n_words, r.n_removed, r.kept or "") for r in m.remove_repeats(docs, **options).collect()]


@pytest.mark.parametrize("seed", [3, 4])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert order(found(spark, rows)) == order(brute(rows))


@pytest.mark.parametrize(("group", "bloom_bytes", "cut", "span", "most"), [(5, 1 << 26, 1024, 1 << 18, 32), (40, 0, 1024, 1 << 18, 1), (20_000, 0, 4, 1 << 18, 32), (20_000, 1 << 26, 2, 50, 7)])
def test_bounds_do_not_change_the_result(spark, monkeypatch, group, bloom_bytes, cut, span, most):
    """Small groups (longer prefixes, whole windows as nodes), joins instead of filters, more starts, short spans, short rows of starts."""
    for name, value in (("GROUP", group), ("BLOOM_BYTES", bloom_bytes), ("CUT", cut), ("SPAN", span), ("MOST", most), ("SHARE", 4 if most > 1 else 1 << 40)):
        monkeypatch.setattr(m, name, value)
    # the bounds reach the workers by value
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(m)
    try:
        rows = corpus(5, 60)
        assert order(found(spark, rows)) == order(brute(rows))
    finally:
        cloudpickle.unregister_pickle_by_value(m)


def test_nodes_deeper_than_a_window_decide(spark):
    """Only suffixes at starts become leaves, so the words after the first window go by the depth of the node."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(400)]
    own = lambda: [word() for _ in range(30)]
    rows = [(i, " ".join([*own(), *passage[: 400 - 40 * i], *own()])) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = {}
    real = m.repeats_of
    m.repeats_of = lambda records, run: seen.setdefault("nodes", real(records, run))
    try:
        got = {r.doc.doc_id: r.n_removed for r in m.remove_repeats(docs).collect()}
    finally:
        m.repeats_of = real
    assert got == {0: 0, 1: 360, 2: 320, 3: 280}
    nodes = seen["nodes"].collect()
    assert max(r.depth for r in nodes) >= 280 and len(nodes) < 100


def slow_repeats(leaves, ids, run):
    out = {}
    for i, a in enumerate(leaves):
        for j, b in enumerate(leaves):
            if ids[j] < ids[i] and (n := m.shared_words(a, b)) >= run:
                out[i] = max(out.get(i, 0), n)
    return out


def test_longest_repeats():
    rng = random.Random(2)
    for _ in range(300):
        rows = sorted((b"".join(rng.choice([b"a ", b"b ", b"ab "]) for _ in range(rng.randint(1, 9))), rng.randint(0, 5)) for _ in range(rng.randint(1, 25)))
        leaves, ids = [list(x) for x in zip(*rows)]
        for run in (1, 2, 3):
            got = list(m.longest_repeats(leaves, ids, run))
            assert dict(got) == slow_repeats(leaves, ids, run) and len(got) == len(dict(got))


def test_tokens_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = b"".join(rng.choice([b"a", b"bc", b"def" * 5, b"x" * 70]) + rng.choice([b" ", b"\n\t "]) for _ in range(500))
    monkeypatch.setattr(m, "CHUNK", 1 << 16)
    m._powers.clear()
    start, whole = m.tokens(text)
    words = [text[a:].split(None, 1)[0] for a in start.tolist()]
    assert words == text.split()
    monkeypatch.setattr(m, "CHUNK", 64)
    m._powers.clear()
    again, parts = m.tokens(text)
    m._powers.clear()
    short = [len(w) < 64 for w in words]
    assert again.tolist() == start.tolist() and (parts == whole)[short].all() and len(set(parts.tolist())) == len(set(words))
    assert [b"".join(m.pieces(text)), *(p for p in m.pieces(text) if p[:1].strip() and p != text[: len(p)])] == [text]


def test_very_long_text(spark):
    rng = random.Random(4)
    w = [f"w{rng.randrange(50_000)}" for _ in range(600_000)]
    long, part, giant = " ".join(w), " ".join(w[400_000:450_000]), "z" * (m.CHUNK + 5)
    rows = [(1, part), (2, long), (3, f"{giant} {' '.join(w[:20])}"), (4, f"{giant} " * 14), (5, f"{giant} " * 13 + "a")]
    got = {r[0]: r[1:3] for r in found(spark, rows)}
    assert got == {1: (50_000, 0), 2: (600_000, 50_000), 3: (21, 20), 4: (14, 0), 5: (14, 13)}


def test_string_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([("b", text, 1, "x", 2), ("a", text, 1, "x", 2), (None, text, 1, "x", 2), ("10", "short", 1, "x", 2)], "doc_id string, text string, id int, row string, spans int")
    assert {r.doc.doc_id: (r.n_removed, r.doc.spans) for r in m.remove_repeats(docs).collect()} == {"a": (0, 2), "b": (20, 2), None: (20, 2), "10": (0, 2)}


def test_empty(spark):
    assert m.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_layout_stays(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, passage), (2, f" A b\n\n{passage}\nc  d \n"), (3, "x\ty\n")], "doc_id long, text string")
    kept = {r.doc.doc_id: (r.n_removed, r.kept) for r in m.remove_repeats(docs, layout=True).collect()}
    assert kept == {1: (0, passage), 2: (15, " A b\nc  d"), 3: (0, "x\ty\n")}
