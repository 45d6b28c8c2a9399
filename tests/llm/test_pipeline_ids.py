"""The pipeline's stages on rows that repeat an id or have none."""

from collections import Counter

import pytest

from trackloom.llm import mixing, quality
from trackloom.llm.queries import table

SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    schema = table(spark, SF, "documents").schema
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    bench = table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, "# $ % & * | ~ ^ " * 9), (5, bench), (7, text(4)), (7, text(4)), (7, text(4)), (8, text(4)), (None, text(4)), (9, ""), (9, ""), (None, None), (None, None)]
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], schema)


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_decide_row_by_row(spark, docs, monkeypatch):
    import corpus_pipeline as P

    from pyspark.sql import functions as F

    whole = bag(docs)
    def scores(d, id_col="doc_id"):  # noqa: E306
        return d.select(F.col(id_col).alias("doc_id"), F.when(F.col("text").startswith("#"), 0).otherwise(1).alias("predicted"))

    monkeypatch.setattr(quality, "quality_scores", scores)
    assert bag(P.quality_classifier(spark, docs, SF)) == Counter({k: n for k, n in whole.items() if not (k[1] or "").startswith("#")})
    kept = bag(P.near_dedup(spark, docs, SF))
    one = docs.where("doc_id = 7").first()["text"]
    assert kept == Counter({k: 1 if k == (7, one) else n for k, n in whole.items() if k[1] != one or k[0] == 7})
    clean = bag(P.decontamination(spark, docs, SF))
    assert clean == Counter({k: n for k, n in whole.items() if not (k[0] == 5 and k[1] == table(spark, SF, "benchmark").orderBy("item_id").first()["text"])})
    per_row = mixing.mix_sources(docs)
    got = bag(P.mixture(spark, docs, SF))
    assert sum(got.values()) == per_row.agg({"copies": "sum"}).first()[0] and all(got[k] <= 3 * whole[k] for k in got)
