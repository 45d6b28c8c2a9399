"""Operators on small rows: edges, ties and the cases that the definitions turn on."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import aggregates as A
from trackloom.operators import events_a as E
from trackloom.operators import joins as J
from trackloom.operators import temporal as T
from trackloom.operators import validate as C
from trackloom.sources import readers, writers
from trackloom.streaming import online


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_a_gap_of_the_limit_stays_inside(spark):
    df = spark.createDataFrame([(1, f) for f in (0, 12, 25, 26)], "m int, frame long")
    assert rows(T.segments(df, ["m"]), "start_frame", "end_frame") == [(0, 12), (25, 26)]
    assert T.segments(df.where("false"), ["m"]).count() == 0


def test_even_median_is_the_mean_of_the_middle(spark):
    df = spark.createDataFrame([([3.0, 1.0, None, 2.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(X.median_of(F.col("v"))).collect()] == [2.5, None]
    assert [r[0] for r in df.select(X.upper_median(F.col("v"))).collect()] == [3.0, None]


def test_mode_of_three_prefers_the_smallest(spark):
    df = spark.createDataFrame([(1, 2, 3), (None, 5, 4), (7, 2, 7), (None, 1, None)], "a int, o int, b int")
    assert [r[0] for r in df.select(X.mode_of_three(F.col("a"), F.col("o"), F.col("b"))).collect()] == [1, 4, 7, 1]


def test_text_sentinels_and_parsers(spark):
    df = spark.createDataFrame([(" 7 ",), ("NaN",), ("",), ("100",), (None,)], "t string")
    assert [r[0] for r in df.select(X.clean_text(F.col("t"))).collect()] == ["7", None, None, None, None]
    df = spark.createDataFrame([("number 23",), ("none 4",), ("no 4",), ("x",)], "t string")
    assert [r[0] for r in df.select(X.number_in(F.col("t"))).collect()] == [23, None, None, None]


def test_asof_prefers_the_later_of_two_neighbours(spark):
    left = spark.createDataFrame([(1, 10), (1, 50)], "m int, frame long")
    right = spark.createDataFrame([(1, 9, "before"), (1, 11, "after")], "m int, frame long, v string")
    assert rows(J.asof_nearest(left, right, ["m"]).withColumn("v", F.coalesce("v", F.lit("none"))), "frame", "v") == [(10, "after"), (50, "none")]


def test_nearest_is_strict_and_ties_go_to_the_order(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "m int, x double, y double")
    o = spark.createDataFrame([(1, 2, 1.0, 0.0), (1, 1, -1.0, 0.0), (1, 0, 2.5, 0.0)], "m int, k int, ox double, oy double")
    assert J.nearest_within(p, o, ["m"], 2.5, "k").first()["k"] == 1
    assert J.nearest_within(p, o.where("k = 0"), ["m"], 2.5, "k").count() == 0


def pair(spark, team_b, x, apart_y=0.0, gap=10):
    owned = [(1, f, 1, "left", 0.0, 0.0) for f in range(6)] + [(1, f + 5 + gap, 2, team_b, x, apart_y) for f in range(6)]
    df = spark.createDataFrame(owned, "m int, frame long, owner long, team string, x double, y double")
    s = E.spells(df, ["m"], gap=12, least=5)
    return E.classify_pairs(E.spell_pairs(s, df.select("m", "frame", "x", "y"), ["m"]), 25.0).collect()


def test_the_ladder_of_pairs(spark):
    a = pair(spark, "left", 26.0)[0]
    assert (a["kind"], a["progressive"], a["into_final_third"], a["frame"]) == ("pass", True, True, 5)
    assert pair(spark, "right", 26.0)[0]["kind"] == "interception"
    assert pair(spark, "right", 1.0)[0]["kind"] == "tackle"
    assert pair(spark, "left", 1.0)[0]["kind"] is None
    assert pair(spark, "left", 26.0, gap=200)[0]["kind"] is None  # too long a flight


def test_all_or_nothing(spark):
    assert spark.createDataFrame([(1, 2.0), (1, None), (2, 3.0)], "k int, v double").groupBy("k").agg(A.all_or_nothing("v").alias("s")).orderBy("k").collect() == [(1, None), (2, 3.0)]


def test_thirds_keep_the_published_sign(spark):
    df = spark.createDataFrame([("left", -40.0), ("right", -40.0)], "team string, x double")
    got = {r["team"]: (r["defensive"], r["attacking"]) for r in A.thirds(df, ["team"]).collect()}
    assert got == {"left": (0.0, 1.0), "right": (1.0, 0.0)}


def test_majorities(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, None, 3), (2, None, 4)], "t int, v string, pos int")
    assert {r["t"]: r["v"] for r in A.majority(df, ["t"], "v", "pos").collect()} == {1: "b", 2: None}


def test_a_mirrored_frame_is_found(spark):
    s = spark.createDataFrame([(1, f, 8, 0.0, 50.0, -0.95 if f == 9 else 0.95) for f in range(1, 10)], "m int, frame int, people int, outside double, extent double, rho double")
    assert rows(A.frame_validity(s, ["m"]).where("reason is not null"), "frame", "reason") == [(9, "mirrored")]


def test_possessions_are_clipped_to_periods(spark):
    e = spark.createDataFrame([(1, "p", 800, 1200), (1, "s", 1000, None)], "m int, id string, start_ms long, end_ms long")
    p = spark.createDataFrame([(1, 1, 0, 1000), (1, 2, 1000, 2000)], "m int, period int, p_start long, p_end long")
    assert rows(J.in_periods(e, p, ["m"]).fillna(-1), "id", "period", "in_start", "in_end") == [("p", 1, 800, 1000), ("p", 2, 1000, 1200), ("s", 2, 1000, -1)]


def test_rules_name_what_they_find(spark):
    df = spark.createDataFrame([(1, 5, 3, 0.5), (2, 1, None, 2.0), (3, 1, 2, None)], "id int, start_ms long, end_ms long, confidence double")
    assert rows(C.violations(df, ["id"], C.EVENT_RULES), "id", "rule") == [(1, "ends before it starts"), (2, "confidence out of range")]
    with pytest.raises(ValueError):
        C.require_empty(df, "rows")


def test_readers_and_writers_round_trip(spark, tmp_path):
    doc = {"predictions": [{"frame": 1, "track_id": 3, "bbox_image": {"x": 1, "y": 2, "w": 3, "h": 4}, "attributes": {"role": None, "jersey": "100", "team": "left", "name": "nan"}}, {"frame": 2, "attributes": {}}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    got = readers.predictions(spark, str(tmp_path / "p.json")).orderBy("frame").collect()
    assert (got[0]["role"], got[0]["jersey"], got[0]["name"], got[0]["team"]) == ("player", None, None, "left") and got[1]["track_id"] == -1 and got[1]["x"] is None
    (tmp_path / "t.csv").write_text("1,2,3,4,5,6,0.9\n0,1,1,1,1,1,1\n5,6\n")
    assert rows(readers.tracking_csv(spark, str(tmp_path / "t.csv")), "frame", "id", "score") == [(1, 2, 0.9)]
    new = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, m string, v int")
    writers.upsert_table(spark, str(tmp_path / "store"), new, ["id"], "m")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cp"))
    writers.upsert_table(spark, str(tmp_path / "store"), spark.createDataFrame([(1, "a", 9), (3, "a", 3)], "id int, m string, v int"), ["id"], "m")
    assert rows(spark.read.parquet(str(tmp_path / "store")), "id", "v") == [(1, 9), (2, 1), (3, 3)]
    line = writers.tracking_lines(spark.createDataFrame([(1, 2, 1.0, 2.0, 3.0, 4.0, 0.5), (1, -1, 1.0, 2.0, 3.0, 4.0, 0.5)], "frame long, track_id long, x double, y double, w double, h double, score double")).collect()
    assert [r[0] for r in line] == ["1,2,1.00,2.00,3.00,4.00,0.50,-1,-1,-1"]
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 3}')
    (tmp_path / "own.json").write_text('{"extends": "base.json", "a": {"y": 5}}')
    assert readers.config(str(tmp_path / "own.json")) == {"a": {"x": 1, "y": 5}, "b": 3}


def stream(spark, tmp_path, name, df, build, mode="append"):
    path = str(tmp_path / name)
    df.write.parquet(path)
    s = spark.readStream.schema(df.schema).parquet(path)
    q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    assert q.exception() is None
    return spark.table(name)


def test_streams_give_what_batches_give(spark, tmp_path):
    ev = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 40, 4)] + [(2, "2024-01-02 05:00:00", 1.0)], "k int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    build = lambda d: online.tumbling(online.timed(d), ["k"], "20 minutes")
    got = rows(stream(spark, tmp_path, "tumble", ev, build).select("k", F.col("w.start").cast("string").alias("w"), "n"), "k", "w", "n")
    assert got[0] == (1, "2024-01-01 00:00:00", 5)
    pts = spark.createDataFrame([(1, f, float(f), 0.0, 1.0) for f in range(1, 6)] + [(1, 3, 90.0, 0.0, 0.5)], "match_id int, frame long, x double, y double, score double")
    got = rows(stream(spark, tmp_path, "gate", pts, lambda d: online.gate(d, 30.0, 25.0, idle_ms=None)), "frame", "x")
    assert got == [(f, float(f)) for f in range(1, 6)]
    dets = spark.createDataFrame([(1, f, f * 10 + k, 10.0 * k * 20 + f, 0.0, 20.0, 40.0, 0.9) for f in range(1, 5) for k in range(2)], "match_id int, frame long, det long, bx double, by double, bw double, bh double, score double")
    got = rows(stream(spark, tmp_path, "tracks", dets, lambda d: online.track(d, idle_ms=None)), "frame", "det", "track_id")
    assert got == rows(online.track_batch(dets), "frame", "det", "track_id") and {t for _, _, t in got} == {1, 2}


def test_link_chains_against_brute_force():
    from itertools import permutations

    from trackloom.operators.identity import chain_roots

    rng = np.random.default_rng(3)
    for _ in range(30):
        pairs = [(a, b, float(rng.integers(1, 100))) for a in range(5) for b in range(a + 1, 6) if rng.random() < 0.5]
        if not pairs:
            continue
        cost = {(a, b): c for a, b, c in pairs}
        best = min((-sum((a, b) in cost for a, b in enumerate(p)), sum(cost.get((a, b), 0) for a, b in enumerate(p))) for p in permutations(range(1, 11), 5))
        roots = dict(chain_roots(pairs))
        assert len(roots) == -best[0] and all(roots[t] < t and roots[t] not in roots for t in roots)


def test_links_at_the_edges_of_a_bucket(spark):
    from trackloom.operators import identity

    rows = [(1, 1, 0, 399, 0.0, 0.0, 0.0, 0.0), (1, 2, 799, 900, 0.0, 3.0, 0.0, 0.0), (1, 3, 800, 900, 0.0, 0.0, 0.0, 0.0), (1, 4, 399, 500, 0.0, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "m int, track_id long, start long, end long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.a, r.b, r.cost) for r in identity.link_candidates(t, ["m"]).orderBy("a", "b").collect()] == [(1, 2, 3.0), (4, 2, 3.0), (4, 3, 0.0)]
    assert {r.track_id: r.root for r in identity.linked_tracks(t, ["m"]).collect()} == {1: 1, 2: 1, 3: 4, 4: 4}
    assert identity.linked_tracks(t.limit(0), ["m"]).count() == 0


def test_exclusive_quantiles_are_those_of_the_statistics_module(spark):
    import statistics

    from trackloom.operators.identity import exclusive_quantiles

    for v in ([3, 1, 2, 2, 9], [5, 7], list(range(40)), [4] * 7):
        df = spark.createDataFrame([(1, x) for x in v] + [(1, None), (2, 8)], "g int, v int")
        got = {r.g: r for r in exclusive_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).collect()}
        want = statistics.quantiles(v, n=10)
        assert np.allclose([got[1].a, got[1].b, got[1].c], [want[0], want[4], want[8]]) and got[1].n == len(v) and got[2].b == 8


@pytest.mark.parametrize("block_rows", [8192, 70])
def test_reciprocal_reranking_of_all_rows_equals_brute_force(spark, monkeypatch, block_rows):
    from trackloom.operators import retrieval as V
    from trackloom.queries import retrieval as Q

    r = np.random.default_rng(5)
    label = np.arange(220) % 11
    vec = r.normal(size=(11, 8))[label] + 0.6 * r.normal(size=(220, 8))
    g = spark.createDataFrame([(i, int(label[i]), vec[i].tolist()) for i in range(220)], "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(Q, "table", lambda *_: g)
    monkeypatch.setattr(V.neighbour_table, "__defaults__", (block_rows,))
    got = {(x["query"], x["id"]): (x["match"], x["final"]) for x in Q.reciprocal_rerank(spark, "").collect()}
    u = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    dist = np.round(1 - u @ u.T, 9)
    np.fill_diagonal(dist, 0)
    d = (dist / dist.max(1, keepdims=True)) ** 2
    rank = np.argsort(dist, axis=1, kind="stable")
    mutual = lambda i, k: {int(j) for j in rank[i, : k + 1] if i in rank[j, : k + 1]}
    v, grown = np.zeros_like(d), 0
    for i in range(220):
        own = mutual(i, 20)
        e = set(own).union(*(h for j in own if len((h := mutual(j, 10)) & own) > 2 / 3 * len(h)))
        grown += len(e) > len(own)
        v[i, list(e)] = np.exp(-d[i, list(e)])
        v[i] /= v[i].sum()
    v = np.stack([v[rank[i, :6]].mean(0) for i in range(220)])
    assert grown and set(got) == {(q, i) for q in range(0, 220, 50) for i in range(220) if i != q}
    for (q, i), (match, final) in got.items():
        s = np.minimum(v[q], v[i]).sum()
        assert match == (label[q] == label[i]) and abs(final - (0.7 * (1 - s / (2 - s)) + 0.3 * d[q, i])) < 1e-7
