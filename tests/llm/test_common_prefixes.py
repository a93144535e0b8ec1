import random

import numpy as np
import pyarrow as pa
import pytest

import quillstream.llm.common_prefixes as m

RUN, K = 40, 20


def brute(docs, run=RUN):
    """``docs``: (id, text) in order; what rows repeat is one."""
    seen, out = set(), {}
    order = sorted({(m.NULL_ID if i is None else i, (t or "").encode()) for i, t in docs}, key=lambda x: x[0])
    for i, data in order:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - run + 1):
            w = data[p : p + run]
            if w in seen:
                gone[p : p + run] = True
            seen.add(w)
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[i] = (len(data), int(gone.sum()), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(8, 40)) for _ in range(6)]
    docs = []
    for i in range(120):
        parts = [text(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(passages), rng.choice(["", "x", text(3)])]
        docs.append((i, rng.choice([" ", "\n", "é"]).join(parts)))
    near = docs[5][1] + text(60)
    for i in range(200, 260):  # near copies, a third of the rows
        at = rng.randrange(len(near))
        docs.append((i, near[:at] + rng.choice(["", "Z", "QQ"]) + near[at + rng.randint(0, 2) :]))
    docs += [(300, "a" * 500), (301, "b" + "a" * 300), (302, "ab" * 200), (303, "\n".join([passages[0]] * 5)), (304, passages[0]), (305, passages[0][1:]), (306, "x" * (RUN - 1)), (307, "x" * RUN), (308, "x" * RUN)]
    return docs + [(309, None), (310, ""), (311, docs[3][1]), (311, docs[3][1]), (None, docs[4][1])]


@pytest.mark.parametrize("path", ["filters", "joins", "hot"])
def test_matches_brute_force(spark, monkeypatch, path):
    if path == "joins":
        monkeypatch.setattr(m, "fits", lambda n: False)
    if path == "hot":
        monkeypatch.setattr(m, "GROUP", 1)
    docs = corpus(random.Random(4))
    df = spark.createDataFrame([(*d, "kept", 1) for d in docs], "doc_id long, text string, row string, n int").withColumn("a.b", m.F.lit(1)).repartition(3)
    found = m.remove_repeats(df, RUN, K).collect()
    wanted = brute(docs)
    assert len(found) == len(docs)
    for r in found:
        assert r.doc["row"] == "kept" and r.doc["a.b"] == 1
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept or b"")) == wanted[m.NULL_ID if r.doc.doc_id is None else r.doc.doc_id]
    assert [r.kept for r in found if r.doc.doc_id == 309] == [None] and sum(r.n_removed > 0 for r in found) > 60


def test_groups_hold_all_places(spark):
    passage = "the long passage that three documents share, and one of them twice over; "
    docs = [(1, "One. " + passage), (2, "Two! " + passage + "And " + passage), (3, passage + "end")]
    groups = {}
    for r in m.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string"), RUN, K).collect():
        groups.setdefault((r.repeat, r.n_bytes, r.diverse), set()).add((r.id, r.start))
    whole = [places for (_, n, diverse), places in groups.items() if diverse and n >= len(passage)]
    assert {(1, 5), (2, 5), (2, 9 + len(passage)), (3, 0)} in whole
    text = {i: t.encode() for i, t in docs}
    for (_, n, diverse), places in groups.items():
        assert len(places) > 1 and len({text[i][p : p + n] for i, p in places}) == 1
        assert not diverse or len({text[i][p - 1 : p] for i, p in places}) > 1 or (3, 0) in places


def test_scan_finds_every_interval():
    rng = random.Random(1)
    for _ in range(200):
        texts = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 12))})
        places, befores = rng.sample(range(100), len(texts)), [rng.randrange(2) for _ in texts]
        scan = m.Scan(2)
        for t, p, b in zip(texts, places, befores):
            scan.add(t, (p,), t, b, b)
        scan.end()
        prefixes = {t[:n] for t in texts for n in range(2, len(t) + 1)}
        wanted = set()
        for x in prefixes:
            at = [i for i, t in enumerate(texts) if t.startswith(x)]
            depth = min(m.shared(texts[i], texts[j]) for i in at for j in at) if len(at) > 1 else 0
            if len(at) > 1 and depth == len(x):
                wanted.add((depth, at[0], at[-1], len({befores[i] for i in at}) > 1))
        assert set(scan.intervals) == wanted
        deepest = {t: max((m.shared(t, o) for o, q in zip(texts, places) if q < p), default=0) for t, p in zip(texts, places)}
        assert dict(scan.reach) == {t: d for t, d in deepest.items() if d >= 2}


def test_long_texts_in_pieces(monkeypatch):
    """Windows of a text that is worked on in pieces are those of the whole."""
    rng = random.Random(9)
    items = [(0, 0, bytes(rng.choice(b"abcdefgh ") for _ in range(n))) for n in (5000, 10, 300, 39, 40)] + [(700, 64, b"stretch " * 30)]

    def seen():
        s = m.Screens(RUN, K, [])
        out = [set(), set(), set()]
        for c in m.chunks(items, RUN):
            for level, keys in enumerate((s.anchors(c)[0], s.near_anchors(c)[0], s.windows(c, slice(None)))):
                key, low, _, text, place = keys
                out[level] |= set(zip(key.tolist(), low.tolist(), text.tolist(), place.tolist()))
        return out

    whole = seen()
    monkeypatch.setattr(m, "SPAN", 128)
    assert seen() == whole and len(whole[2]) == sum(max(0, len(t) - f - RUN + 1) for _, f, t in items)
    assert {p for _, _, t, p in whole[2] if t == 5} == set(range(764, 700 + 240 - RUN + 1))


def test_very_long_text(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_500_000))
    docs = [(1, long[700_000:700_300]), (2, long), (3, long[400_000:])]
    found = {r.doc.doc_id: r for r in m.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [(found[i].n_bytes, found[i].n_removed, found[i].n_spans) for i in (1, 2, 3)] == [(300, 0, 0), (1_500_000, 300, 1), (1_100_000, 1_100_000, 1)]


def test_string_ids_and_empty(spark):
    df = spark.createDataFrame([("b", "x" * 50), ("a", "x" * 50), (None, "x" * 50)], "doc_id string, text string")
    assert {r.doc.doc_id: r.n_removed for r in m.remove_repeats(df, RUN, K).collect()} == {"a": 49, "b": 50, None: 50}  # each window but the first
    assert m.remove_repeats(df.limit(0), RUN, K).count() == 0


def test_sums_of_a_task():
    parts = [(np.array([5, 3, 5], np.uint64), np.array([1, 2, 0]), np.array([1, 2, 0]), np.ones(3, np.int64))] * 2
    assert m._summed(parts).to_pydict() == {"key": [3, 5], "low": [2, 0], "high": [2, 1], "n": [2, 4]}
    assert isinstance(m._summed([tuple(np.zeros(0, np.int64) for _ in range(4))]), pa.RecordBatch)
