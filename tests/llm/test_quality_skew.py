"""The fit sample of op4_quality on skewed tables."""

from pyspark.sql import functions as F

from trackloom.llm import quality
from trackloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


def test_fit_sample_is_bounded_and_holds_no_empty_texts(spark, monkeypatch):
    docs = Q.table(spark, SF, "documents").select("doc_id", "text")
    n = docs.count()
    nulls = spark.range(n).select((F.col("id") + 10**9).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    hot = spark.range(n).select((F.col("id") + 2 * 10**9).alias("doc_id"), F.lit("one plain text that a third of all rows repeat word by word.").alias("text"))
    targets, fit = [], quality.fit_linear
    monkeypatch.setattr(quality, "fit_linear", lambda row, bucket, weight, target: (targets.append(target), fit(row, bucket, weight, target))[1])
    got = quality.quality_scores(docs.unionByName(nulls).unionByName(hot), fit_rows=600)
    labels = Q.table(spark, SF, "labels")
    seen = got.join(labels, "doc_id").toPandas()
    assert len(targets[0]) == 600
    assert (seen[seen.quality == 0].predicted == 0).mean() > 0.9 and (seen[seen.quality == 1].predicted == 1).mean() > 0.95
