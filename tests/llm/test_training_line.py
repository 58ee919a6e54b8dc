"""The mix of op7 as it lies on the training line."""

from pyspark.sql import functions as F

from lodeframe.llm import mixing, registry


def test_op7_places_every_pass_on_the_training_line(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 9)), "abc"[i % 3] if i % 10 else None) for i in range(300)] + [(7, "one two", "a"), (7, "one two", "a"), (None, "w w", "b"), (900, None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op7_mixing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    told = sorted((place, position) for r in out for place, position in zip(r["places"], r["positions"], strict=True))
    assert [place for place, _ in told] == list(range(len(told)))
    assert [position for _, position in told] == sorted(position for _, position in told)
    assert all((len(r["places"]) > 0) == (r["taken"] > 0) for r in out)


def test_places_follow_the_schedule(spark):
    """Equal weights and sizes: a source of tilt 0.5 has 5/8 of its words in the first half, one of -0.5 has 3/8."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    mixed = mixing.training_line(mixing.curriculum(docs, weights=(1.0,), tilts=(0.5, -0.5)))
    early = {r["source"]: r["n"] for r in mixed.select("source", F.explode("places").alias("place")).where("place < 1000").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(early["a"] - 625) <= 2 and abs(early["b"] - 375) <= 2
    assert mixing.training_line(mixing.curriculum(docs.limit(0))).count() == 0
