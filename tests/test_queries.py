"""Every query that has an oracle must give the oracle's rows, as DuckDB computes them."""

import os

import duckdb
import pandas as pd
import pytest

from trackloom.queries import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels conversations pages benchmark documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.5f}".replace("-0.00000", "0.00000")
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_its_oracle(spark, duck, name):
    got = all_queries()[name](spark, SF).toPandas()
    want = duck.sql(all_oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_other_queries_run_and_agree_with_themselves(spark, name):
    q = all_queries()[name](spark, SF)
    first, again = q.count(), all_queries()[name](spark, SF).count()
    assert first == again and first > 0 and len(set(q.columns)) == len(q.columns)


def test_entry_points_work_without_the_corpus_folders(tmp_path):
    """The rest of the repository imports when the corpus subpackage and its pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/trackloom", tmp_path / "trackloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "fine" in out.stdout, out.stderr
