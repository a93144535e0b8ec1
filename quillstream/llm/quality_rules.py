"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies.

Votes are functions of per-document measures. Documents are summed per pattern of votes (at most
3 ** rules patterns, whatever the input), and each EM round is one aggregate over the patterns; the
driver holds only the prior and one accuracy for each rule. The posterior replaces all-must-pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import SPACE, row_of, save, split_words

ROUNDS = 12
#: Weight of the starting guess in each estimate, and the bounds of what EM may believe.
SMOOTH, LEAST, MOST = 10.0, 0.55, 0.99
START_PRIOR, START_ACCURACY = 0.7, 0.75
#: Windows times repeated windows up to which repeats are marked by lookup; beyond it by sorting. Both give the same.
LOOKUP = 2_000_000

#: Rule -> (bad when, good when), as SQL over the measures; neither: abstains.
RULES = {
    "length": ("n_words < 50", "n_words >= 100"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words < n_words"),
    "lines": ("5 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines > 2"),
    "symbols": ("10 * n_symbols > n_words", "100 * n_symbols <= n_words AND n_words > 0"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 12 * n_words OR n_words = 0", "word_chars >= 4 * n_words AND word_chars <= 9 * n_words AND n_words > 0"),
    "capitals": ("3 * n_capitals > word_chars", "10 * n_capitals <= word_chars AND n_words > 0"),
    "shouting": ("10 * n_marks > n_words", "50 * n_marks <= n_words AND n_words > 0"),
}
VOTES = [f"vote_{r}" for r in RULES]
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def repeated_places(hashes: str, dups: str) -> Column:
    """Ascending places of the windows whose hash is among the repeated ones."""
    n = F.size(hashes)
    looked_up = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(dups, F.get(hashes, i)))
    pairs = F.sort_array(F.arrays_zip(F.col(hashes).alias("h"), F.sequence(F.lit(0), n - 1).alias("i")))
    meet = F.zip_with(F.slice(pairs, F.lit(1), n - 1), F.slice(pairs, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    sorted_out = F.sort_array(F.array_distinct(F.flatten(meet)))
    return F.when(F.size(dups) == 0, F.array().cast("array<int>")).when(n.cast("long") * F.size(dups) <= LOOKUP, looked_up).otherwise(sorted_out)


def covered(places: str) -> Column:
    """Words in three-word windows that start at the ascending places."""
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc`` (the row as a struct) and the measures of its whole text; a null text measures as an empty one."""
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    rows = docs.select(row_of(docs).alias("doc")).select(
        "doc",
        split_words(text).alias("words"),
        lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
    )
    triple = lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(3)))
    rows = rows.withColumn("hashes", F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), triple)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.sort_array("hashes"))
    n = F.size("sorted")
    again = F.zip_with(F.slice("sorted", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("sorted", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when(a == b, a))
    rows = rows.withColumn("dups", F.array_distinct(F.array_compact(again))).withColumn("places", repeated_places("hashes", "dups"))
    return rows.select(
        "doc", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered("places").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), "n_capitals", "n_marks",
    )


def vote(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


def logit(p: float | Column) -> Column:
    p = F.lit(p)
    return F.log(p / (1 - p))


def posterior(prior: float, accuracy: list[float], votes: list[str]) -> Column:
    """P(good | votes), the rules being independent given the truth; an abstention says nothing."""
    odds = logit(prior)
    for v, a in zip(votes, accuracy):
        odds = odds + F.col(v) * logit(a)
    return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, votes: list[str], rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Prior and accuracies by EM over ``patterns`` (vote columns of -1, 0, 1 and their count ``n``)."""
    prior, accuracy = START_PRIOR, [START_ACCURACY] * len(votes)
    q = F.col("q")
    for _ in range(rounds):
        right = [F.sum(F.col("n") * F.when(F.col(v) == 1, q).when(F.col(v) == -1, 1 - q).otherwise(0.0)) for v in votes]
        voted = [F.sum(F.when(F.col(v) != 0, F.col("n")).otherwise(0)) for v in votes]
        row = patterns.withColumn("q", posterior(prior, accuracy, votes)).agg(F.sum(F.col("n") * q), F.sum("n"), *right, *voted).first()
        if not row[1]:
            break
        bound = lambda x: min(MOST, max(LEAST, x))
        prior = bound((row[0] + SMOOTH * START_PRIOR) / (row[1] + SMOOTH))
        k = len(votes)
        accuracy = [bound((r + SMOOTH * START_ACCURACY) / (n + SMOOTH)) for r, n in zip(row[2 : 2 + k], row[2 + k :])]
    return prior, accuracy


def judge(docs: DataFrame, text_col: str = "text", rules: dict[str, tuple[str, str]] = RULES, rounds: int = ROUNDS) -> DataFrame:
    """Every row with its measures, votes, ``quality`` (posterior that it is good), ``base_failed`` and ``kept``.

    ``doc`` is the row as a struct. Null and empty texts have no words and fail; rows that repeat
    return alike; an empty table gives an empty one. kept: base rules pass and quality is 0.5 or more.
    """
    votes = [f"vote_{r}" for r in rules]
    measured = save(measures(docs, text_col).select("*", *(vote(*when).alias(v) for v, when in zip(votes, rules.values()))))
    patterns = save(measured.groupBy(*votes).agg(F.count("*").alias("n")))
    quality = posterior(*fit(patterns, votes, rounds), votes)
    failed = F.expr(BASE_FAILED)
    return measured.select("*", quality.alias("quality"), failed.alias("base_failed"), (~failed & (quality >= 0.5)).alias("kept"))


def judge_sql(documents: str = "documents") -> str:
    """DuckDB SQL of the measures and verdicts of ``judge`` with the standard rules."""
    votes = [f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS {v}" for v, (bad, good) in zip(VOTES, RULES.values())]
    ws = "[^\\x20\\x09-\\x0D]"
    steps = [
        f"rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{ws}+') AS w FROM {documents})",
        "spots AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM rows_ WHERE len(w) >= 3))",
        "twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM spots) WHERE n > 1)",
        "reps AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY rid)",
        f"lined AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{ws}')) AS l FROM rows_)",
        """m AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
            len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals, len(regexp_extract_all(t, '!'))::BIGINT AS n_marks
            FROM rows_ JOIN lined USING (rid) LEFT JOIN reps USING (rid))""",
        f"voted AS (SELECT *, {', '.join(votes)} FROM m)",
        f"pat AS MATERIALIZED (SELECT {', '.join(VOTES)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL)",
        f"e0 AS (SELECT {START_PRIOR}::DOUBLE AS prior, {', '.join(f'{START_ACCURACY}::DOUBLE AS a{k}' for k in range(len(VOTES)))})",
    ]
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"{v} * ln(a{k} / (1 - a{k}))" for k, v in enumerate(VOTES))
    for i in range(ROUNDS):
        bound = lambda x: f"least({MOST}, greatest({LEAST}, {x}))"
        new = [
            bound(f"(sum(CASE {v} WHEN 1 THEN n * q WHEN -1 THEN n * (1 - q) ELSE 0 END) + {SMOOTH * START_ACCURACY}) / (sum(CASE WHEN {v} <> 0 THEN n ELSE 0 END) + {SMOOTH})") + f" AS a{k}"
            for k, v in enumerate(VOTES)
        ]
        steps.append(
            f"e{i + 1} AS MATERIALIZED (SELECT {bound(f'(sum(n * q) + {SMOOTH * START_PRIOR}) / (sum(n) + {SMOOTH})')} AS prior, {', '.join(new)} FROM (SELECT pat.*, 1 / (1 + exp(-({odds}))) AS q FROM pat, e{i}))"
        )
    return f"""WITH {', '.join(steps)} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
        NOT ({BASE_FAILED}) AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept FROM voted, e{ROUNDS}"""
