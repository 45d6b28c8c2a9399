"""Corpus queries that SQL can express, against DuckDB; the pipeline on empty tables and clashing names."""

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF).select(want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_stages_on_clashing_names_and_empty_tables(spark):
    import corpus_pipeline as P

    names = ("copies", "copy", "rank", "row_key", "component_id", "size", "pattern", "predicted", "n_hit")
    docs = Q.table(spark, SF, "documents").where("doc_id < 40").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    docs = docs.unionByName(docs.where("doc_id < 3").withColumn("text", F.lit(None).cast("string"))).unionByName(docs.where("doc_id = 4"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        own = set(docs.toPandas().fillna("").itertuples(index=False, name=None))
        assert set(out.toPandas().fillna("").itertuples(index=False, name=None)) <= own, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert P.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
