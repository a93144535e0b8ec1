"""Columns whose names hold dots or clash with the operators' own."""

from pyspark.sql import functions as F

from quillstream.llm import cotraining, decontaminate, language, language_model, mixing, quality_rules

SF = "/root/testdata/sf0.001"


def test_dotted_and_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    odd = docs.withColumn("a.b", F.lit("kept")).withColumn("doc", F.lit(1)).withColumn("score", F.lit(2))
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = [
        mixing.mix(odd), language.identify(odd, language.train(docs)), quality_rules.judge(odd), decontaminate.contamination(odd, items),
        cotraining.score_documents(odd, cotraining.train(docs, labels)), language_model.score_documents(odd, docs),
    ]
    n = odd.count()
    for df in found:
        rows = df.select("doc").collect()
        assert len(rows) == n and {(r.doc["a.b"], r.doc["doc"], r.doc["score"]) for r in rows} == {("kept", 1, 2)}


def test_a_repeated_id_is_learned_from_one_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.unionAll(docs.withColumn("text", F.concat("text", F.lit(" other words"))))
    x, y = (cotraining.score_documents(docs, cotraining.train(t, labels)).select("doc.doc_id", "score").orderBy("doc_id").collect() for t in (twice, twice.orderBy(F.desc("text")).repartition(7)))
    assert x == y
