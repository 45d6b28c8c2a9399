"""Benchmarks of one and of several blocks give op2_decontam the same rows."""

import pytest

from trackloom.llm import decontam


@pytest.mark.parametrize("size", [10, 16 << 20])
def test_rows_that_repeat_an_id_or_have_none_are_judged_one_by_one(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma delta"), (3, "zeta")], "item_id long, text string")
    docs = [(1, "alpha beta gamma delta"), (1, "eta theta"), (1, "eta theta"), (None, "zeta"), (None, "iota"), (None, None), (2, "zeta x alpha beta gamma")]
    got = decontam.removal_spans(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    seen = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"], r["span_start"], r["span_end"]) for r in got)
    assert seen == sorted([(1, 4, 4, ["1", "2"], [0], [4]), (1, 2, 0, [], [], []), (1, 2, 0, [], [], []), (0, 1, 1, ["3"], [0], [1]), (0, 1, 0, [], [], []), (0, 0, 0, [], [], []), (2, 5, 4, ["1", "3"], [0, 2], [1, 5])])
