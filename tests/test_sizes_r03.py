"""Findings of the third round."""

import time

import numpy as np
import pytest

from trackloom.operators import assignment as A
from trackloom.operators import kernels as N


@pytest.mark.parametrize("seed", range(12))
def test_far_pairs_are_blocked_in_the_assignment(seed):
    r = np.random.default_rng(seed)
    n, m = (int(v) for v in r.integers(1, 14, 2))
    p, q = r.integers(0, 12, (n, 2)).astype(float), r.integers(0, 12, (m, 2)).astype(float)
    d = np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1))
    want = [d[i, j] for i, j in N.hungarian(np.where(d < 3, d, 1e6)) if d[i, j] < 3]
    for cells in (1, 1 << 22):
        hit = A.assigned_points(p, q, cells, 3.0)
        assert all(d[i, j] == x < 3 for i, j, x in hit) and len({i for i, _, _ in hit}) == len({j for _, j, _ in hit}) == len(want)
        assert abs(sum(x for _, _, x in hit) - sum(want)) < 1e-9


def test_a_far_pair_takes_no_place_from_near_ones(spark):
    """Without the limit in the assignment, 2-7 and 1-8 cost least together, and 1-8 is dropped after that."""
    rows = lambda c, *p: spark.createDataFrame([(1, i, x, y) for i, x, y in p], f"match_id int, {c} long, x double, y double")
    a, b = rows("a", (1, 0.0, 0.0), (2, 3.0, 0.0)), rows("b", (7, 3.0, 0.0), (8, 3.0, 4.1))
    got = N.assign_points(a, b, ["match_id"], 5.0)
    assert sorted((x["a"], x["b"]) for x in got.collect()) == [(1, 7), (2, 8)]


def test_a_count_of_matches_from_one_frame_keeps_both_sides(spark):
    from trackloom.queries.audit import gaussian_matching
    from trackloom.queries.ledger import linear_assignment

    for q in (linear_assignment, gaussian_matching):
        df = q(spark, "/root/testdata/sf0.001")
        assert df.count() == len(df.collect()) > 0


def test_team_clusters_are_of_all_tracks(spark):
    from trackloom.plans.tracking import detections
    from trackloom.queries.fragments import team_clusters

    sf = "/root/testdata/sf0.001"
    whole = {(r[0], r[1]) for r in detections(spark, sf).select("match_id", "track_id").distinct().collect()}
    got = [(r["match_id"], r["track_id"]) for r in team_clusters(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == whole


@pytest.mark.parametrize("seed", range(6))
def test_silhouette_on_the_circle_is_that_of_all_pairs(seed):
    from trackloom.operators import linking as K

    r = np.random.default_rng(seed)
    x = r.normal(size=(int(r.integers(2, 300)), 2)).round(1) + [0.05, 0.0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = (np.arange(len(x)) % 3 == 0).astype(int)
    flat = K.silhouette(np.column_stack([x, np.zeros(len(x))]), label)
    assert abs(K.silhouette(x, label) - flat) < 1e-9
    began = time.process_time()
    K.silhouette(np.repeat(x, 60000 // len(x) + 1, axis=0), np.repeat(label, 60000 // len(x) + 1))
    assert time.process_time() - began < 1


def test_box_suppression_of_odd_rows_is_that_of_its_sql(spark, tmp_path):
    """Unknown times, values and counts, and boxes that share just three tenths."""
    import duckdb
    from test_queries import normal

    from trackloom.queries import all_oracles, all_queries

    con = duckdb.connect()
    con.sql("create table events as select event_id, case when event_id % 9 <> 4 then ts end as ts, user_id, event_type, case when event_id % 7 = 3 then null when event_id % 2 = 0 then event_id % 13 * 490 / 105.0 + event_id * 1e-7 else value end as value, case when event_id % 11 = 5 then null else props end as props from '/root/testdata/sf0.001/events.parquet'")
    con.sql("insert into events select event_id + 1000000, ts + interval 1 second, user_id, event_type, value + (event_id % 40 + 1) * 490 / 105.0 * 0.5, props from events where ts is not null and value is not null")
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    got, want = all_queries()["box_suppression"](spark, str(tmp_path)).toPandas(), con.sql(all_oracles()["box_suppression"]).df()
    assert normal(got) == normal(want)


def test_boxes_are_compared_as_in_sql():
    box = np.array([[0.0, 0.0, 1.3, 1.0], [0.7, 0.0, 1.3, 1.0], [np.nan, 0.0, 1.0, 1.0], [5.0, 0.0, np.nan, 1.0]])
    both = (1.3 - 0.7) * 1.0
    goes = both > both / (2.6 - both) * (2.6 - both)
    assert N.suppress(box[:2], np.array([2.0, 1.0]), both / (2.6 - both)).tolist() == ([0] if goes else [0, 1])
    assert N.suppress(box[[0, 2, 3]], np.array([3.0, 2.0, 1.0]), 0.3).tolist() == [0, 2]


def test_matches_of_a_block_come_to_the_driver_as_arrow(spark, monkeypatch):
    """As rows they are Python objects, some hundred bytes a number."""
    import tracemalloc

    from trackloom.operators import retrieval as V

    rows = [(i, i % 2, i % 3, [float(i % 7), float(i % 11), 1.0]) for i in range(1500)]
    g = spark.createDataFrame(rows, "id long, pid long, cam long, vector array<double>").coalesce(1).cache()
    q = g.where("id % 50 = 0")
    assert g.count() == 1500
    tracemalloc.start()
    n = V.match_ranks(q, g, "dartfish").count()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30 * 749 and most < 6_000_000


def test_hits_are_counted_before_they_become_a_row_a_threshold(spark):
    from trackloom.queries.audit import box_average_precision

    plan = box_average_precision(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(hits" not in plan and "Sort [id" not in plan


def test_of_equal_overlaps_the_first_truth_by_id_is_taken(spark):
    from trackloom.operators import evaluation as E

    found = spark.createDataFrame([(1, "a", 1, 0.9, 10.0, 0.0, 10.0, 10.0), (1, "a", 2, 0.8, 12.5, 0.0, 10.0, 10.0)], "image long, label string, id long, score double, bx double, by double, bw double, bh double")
    truth = spark.createDataFrame([(1, "a", 9, 12.0, 0.0, 10.0, 10.0), (1, "a", 3, 8.0, 0.0, 10.0, 10.0)], "image long, label string, id long, bx double, by double, bw double, bh double")
    got = {r["id"]: r["hits"][0] for r in E.box_hits(found, truth).collect()}
    assert got == {1: True, 2: True}


@pytest.mark.parametrize("seed", range(8))
def test_candidates_that_are_not_held_give_the_same_links(seed):
    from trackloom.operators.identity import near_pairs, near_roots, roots_of

    r = np.random.default_rng(seed)
    n = 60 + 100 * seed
    start = r.integers(0, 1440, n)
    end, first, last = start + r.integers(0, 200, n), r.integers(-20, 20, (n, 2)).astype(float), r.integers(-20, 20, (n, 2)) + r.integers(0, 2, (n, 1)) * 0.25
    a, b, cost = near_pairs(start, end, first, last, 400, 5.0)
    every = A.Near(start, end, first, last, 400, 5.0, 500)
    assert sorted((int(i), int(j)) for p, q, _ in every.pairs(np.arange(n)) for i, j in zip(p, q, strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
    cost_of, sums = dict(zip(zip(a.tolist(), b.tolist(), strict=True), cost.tolist(), strict=True)), []
    for to in (A.assigned_pairs(n, n, a, b, cost, 1e6), A.assigned_near(n, every)):
        on = np.flatnonzero(to >= 0)
        assert len(set(to[on].tolist())) == len(on)
        sums.append((len(on), round(sum(cost_of[i, int(to[i])] for i in on.tolist()), 6)))
    assert sums[0] == sums[1]
    one = roots_of(n, a, b, cost)
    for held in (0, 1 << 25):
        two = near_roots(start, end, first, last, 400, 5.0, few=0, held=held)
        assert (one == np.arange(n)).sum() == (two == np.arange(n)).sum()
    every.hold()
    assert sorted((int(i), int(j)) for p, q, _ in every.pairs(np.arange(n)[::-1]) for i, j in zip(n - 1 - p, q, strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
