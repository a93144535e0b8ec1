import numpy as np

import quillstream.llm.language as m


def rows(n):
    words = {"en": "the of and to in that with was for not are", "de": "der die und in den von zu mit sich nicht ist", "fr": "le la et les des en un que pour dans pas", "es": "el la y los de en un que por para del con"}
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(words[code].split(), 30)), code) for i, code in enumerate(list(words) * n)]


def test_held_out_accuracy_and_edges(spark):
    docs = spark.createDataFrame(rows(60), "doc_id long, text string, lang string")
    model = m.train(docs.filter("doc_id < 160"))
    assert set(model.family_pairs) == {("germanic", "romance")} and set(model.pairs) == {("de", "en"), ("es", "fr")}
    found = m.identify(docs.filter("doc_id >= 160"), model).collect()
    assert sum(r.lang_pred == r.doc.lang for r in found) == len(found)
    assert all(0.5 < r.score <= 1 for r in found)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 -- 34", "x"), (4, "the " * 60_000, "x")], "doc_id long, text string, score string")
    assert sorted((r.doc.doc_id, r.lang_pred, r.score > 0.5) for r in m.identify(odd, model).collect()) == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True)]


def test_no_and_one_language(spark):
    docs = spark.createDataFrame(rows(3), "doc_id long, text string, lang string")
    assert {r.lang_pred for r in m.identify(docs, m.train(docs.limit(0))).collect()} == {"und"}
    assert {(r.lang_pred, r.score) for r in m.identify(docs, m.train(docs.filter("lang = 'de'"))).collect()} == {("de", 1.0)}
    assert m.identify(docs.limit(0), m.train(docs)).count() == 0


def test_every_language_is_learned_from_a_bounded_sample(spark):
    """A frequent text counts once, rows are bounded, and no language is left out however many there are."""
    docs = spark.createDataFrame(rows(60), "doc_id long, text string, lang string")
    many = docs.unionAll(docs.filter("doc_id = 1").crossJoin(spark.range(300)).select("doc_id", "text", "lang"))
    seen = {}
    real, m.Model = m.Model, lambda x, langs, sizes, fit: seen.setdefault("n", [langs.count(c) for c in sorted(set(langs))])
    try:
        m.train(many, rows=20)
        assert seen.pop("n") == [20] * 4
        m.train(many, total=40)
        assert seen.pop("n") == [10] * 4
        codes = spark.range(260).selectExpr("id AS doc_id", "concat('x', id, ' words of this one') AS text", "concat('l', id) AS lang")
        m.train(codes)
        assert seen.pop("n") == [1] * 260
    finally:
        m.Model = real


def slow_prediction(model, text):
    """The definition, with dictionaries and loops: family by votes of all pairs of families, then language by votes within it."""
    b = b" " + bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode()) + b" "
    counts = {}
    for i in range(len(b) - 2):
        d = ((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 2654435761 % (1 << 32)) >> 20
        counts[d] = counts.get(d, 0) + 1
    x = {d: (n / (len(b) - 2)) ** 0.5 for d, n in counts.items()}

    def choose(names, weights):
        votes, sums, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for i, p in enumerate(names):
            for q in names[i + 1 :]:
                w = weights[p, q]
                margin = sum(v * w[d] for d, v in x.items()) + w[-1]
                for name, t in ((p, margin), (q, -margin)):
                    votes[name] += t > 0
                    sums[name] += t
                    least[name] = min(least[name], 1 / (1 + np.exp(-3 * min(10, max(-10, t)))))
        best = max(names, key=lambda n: (votes[n], sums[n]))
        return best, least[best]

    family, sure = choose(list(model.members), model.family_pairs)
    code, sure_too = choose(model.members[family], model.pairs)
    return code, sure * sure_too


def test_query_matches_brute_force(spark):
    from quillstream.llm import queries
    from quillstream.llm.common import remainder, table

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    model = m.train(docs.filter(remainder("doc_id", 4) != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = queries.QUERIES["op10_language_id"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        code, sure = slow_prediction(model, texts[r.doc_id]) if m.has_letter(texts[r.doc_id]) else (m.UNKNOWN, 0.0)
        assert r.lang_pred == code and abs(r.score - sure) < 1e-3


def test_long_texts_do_not_differ(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 400
    whole = m.features([text])
    monkeypatch.setattr(m, "CHUNK", 100)
    assert np.allclose(m.features([text]), whole)
