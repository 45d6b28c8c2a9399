"""Every operator on null and repeated ids, repeated rows, very long texts, ties, clashing names and empty tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackloom.llm import decontam, licenses, linededup, media, mixing, neardup, pii, quality, tokens, toxicity
from trackloom.llm import queries as Q

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, copies int, copy int, row_key long, node long, c int, words string, label int, keep string, pattern string, rank int"
LINE = "This very line of boilerplate is repeated in many documents."
MIT = "Released under the MIT License."
LONG = "alpha beta gamma delta " * 20000


def texts():
    return [(None, MIT), (None, None), (None, "call 415-555-2671 " + LINE), (3, MIT + " " + "x " * 20), (3, "other words here\n" + LINE), (3, "other words here\n" + LINE), (4, LINE + "\nown"), (5, LONG), (6, LONG), (7, ""), (8, LINE), (9, LINE + " "), (10, "\n" + LINE), (11, "born 1999-02-28, that is 28/02/1999")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", "en", 1, -1, 7, 8, 9, 10, 11, "w", 1, "k", "p", 5) for i, t in texts()], SCHEMA)


def apply(name, docs, spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (None, "born 1999")], "item_id long, text string")
    return {
        "op1": lambda: pii.pseudonymise(docs, "k"),
        "op2": lambda: decontam.removal_spans(docs, bench),
        "op3": lambda: mixing.mix_sources(docs),
        "op4": lambda: quality.quality_scores(docs),
        "op5": lambda: toxicity.toxicity_scores(docs, docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))),
        "op6": lambda: neardup.near_duplicates(docs),
        "op7": lambda: linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs)),
        "op8": lambda: licenses.license_scan(docs),
        "op9": lambda: media.media_columns(docs),
        "op10": lambda: tokens.token_output(docs, Q.tokenizer_file()),
    }[name]()


NAMES = [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_out_for_each_row_in(spark, docs, name):
    got = Counter(r["doc_id"] for r in apply(name, docs, spark).select("doc_id").collect())
    assert got == Counter(i for i, _ in texts())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, docs, name):
    assert apply(name, docs.where("false"), spark).count() == 0


def test_rows_of_one_id_or_none_are_decided_by_their_own_texts(spark, docs):
    found = sorted(((r["doc_id"] or 0, r["licenses"]) for r in apply("op8", docs, spark).collect()))
    assert [x for x in found if x[1]] == [(0, "MIT"), (3, "MIT")]
    hits = sorted((r["doc_id"] or 0, r["n_hit"], tuple(r["items"])) for r in apply("op2", docs, spark).collect() if r["n_hit"])
    assert hits == [(5, 80000, ("1",)), (6, 80000, ("1",)), (11, 2, ())]
    out = {(r["doc_id"], r["text"]): r for r in apply("op7", docs, spark).collect()}
    assert (3, "other words here") in out and (4, "own") in out and (10, "\n" + LINE) in out and (None, "call 415-555-2671 " + LINE) in out
    near = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in apply("op6", docs, spark).collect())
    assert (5, 5, True) in near and (6, 5, False) in near and near.count((3, 3, True)) == 3


def test_bitmaps_of_all_documents_give_back_the_kept_lines(spark, docs):
    maps = {r["row_key"]: r for r in linededup.line_bitmaps(docs).collect()}
    rows = linededup._keyed(docs, "doc_id", "text").collect()
    assert set(maps) == {r["row_key"] for r in rows}
    for r in rows:
        m, parts = maps[r["row_key"]], (r["text"] or "").split("\n")
        keep = linededup.kept_lines(m["keep"], m["n_lines"])
        assert len(keep) == len(parts) == m["n_lines"] and len(parts) - keep.sum() == m["n_dropped"]


def test_equal_values_in_other_notations_are_linked(spark):
    rows = spark.createDataFrame([(1, "1999-02-28"), (2, "28/02/1999"), (3, "02.28.1999"), (4, "415-555-2671"), (5, "+1 415-555-2671"), (6, "(415) 555-2671")], "doc_id long, text string")
    got = {r["doc_id"]: re.sub(r"\D", "", r["text"]) for r in pii.pseudonymise(rows, "k").collect()}
    day = (got[1][6:], got[1][4:6], got[1][:4])
    assert got[1] != "19990228" and got[2] == "".join(day) and got[3] == day[1] + day[0] + day[2]
    assert got[4] != "4155552671" and got[5] == "1" + got[4] and got[6] == got[4]


def test_shared_folder_is_a_must_on_a_cluster():
    from types import SimpleNamespace

    from trackloom.llm.common import shared_dir

    unset = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://head:7077")))


