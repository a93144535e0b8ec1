import random
import re
from collections import Counter, defaultdict

import quillstream.llm.divergence as m

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least_docs=10, top=10):
    docs = defaultdict(lambda: defaultdict(list))
    for lang, source, text in rows:
        docs[lang or ""][source or ""].append(Counter(TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))))
    out = []
    for lang, by in docs.items():
        df, whole = Counter(), Counter()
        for own in by.values():
            for c in own:
                df.update(c.keys())
                whole.update(c)
        kept = sorted(t for t in df if df[t] >= least_docs)
        counts = {s: sum(own, Counter()) for s, own in by.items()}

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in by:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in by if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice(["The", "of", "É", "x1y", "q-r", "ßs", "tt", "日本", "a" * 50, f"w{chr(97 + rng.randrange(26))}"])
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", None, "hot", "hot", "hot"]), " ".join(word() for _ in range(rng.randint(0, 40)))) for _ in range(300)]
    # no terms, no text, a language without kept terms, ties (two sources alike), repeated rows
    return [*rows, ("en", "none", "1 2 3"), ("en", "null", None), ("fr", "x", "le"), ("fr", "y", ""), *[("it", s, "uno due") for s in "ab" for _ in range(6)], rows[0], rows[0]]


SCHEMA = "lang string, source string, text string"


def test_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item", m.F.lit(1)).withColumn("a.b", m.F.lit(2)).withColumn("term", m.F.lit("x")).repartition(5)
    assert rows_of(m.audit(docs)) == brute(rows)
    # small blocks: several cells along each axis, some empty
    monkeypatch.setattr(m, "HELD", 20)
    assert rows_of(m.audit(docs, 3, 2, groups_of=2, terms_of=3)) == brute(rows, 3, 2)


def test_very_long_texts_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK", 1000)
    long = " ".join(["the", "of" * 2000, "garden"] * 3000)
    rows = [("en", "a", long), ("en", "b", "the garden"), ("en", "b", "Z" * 50_000)]
    assert rows_of(m.audit(spark.createDataFrame(rows, SCHEMA), 1)) == brute(rows, 1)
    counts = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_000, 3)], "n long, total long, v long")
    assert counts.select(m.share("n", "total", "v")).first()[0] == 1 + 10**9 * (9 * 10**12 + 2) // (10**13 + 6)


def test_empty(spark):
    assert m.audit(spark.createDataFrame([], SCHEMA)).count() == 0
