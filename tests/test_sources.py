"""Every reader and writer on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from trackloom.sources import readers as R
from trackloom.sources import writers as W


def put(path, text):
    path.write_text(text)
    return str(path)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str) if cols else sorted(map(tuple, df.collect()), key=str)


def test_side_car_and_csv(spark, tmp_path):
    a, b = put(tmp_path / "a.json", '{"name": "x", "confidence": 0.2}\n{"confidence": 1}\n'), put(tmp_path / "b.json", '{"name": "x", "confidence": 0.9}\n')
    assert rows(R.attribute_sidecar(spark, [a, b])) == [("x", 0.9)]
    p = put(tmp_path / "t.txt", "1,7,1.5,2,3,4,0.9\n0,8,1,1,1,1,1\n2,9,1\n3,9,a,2,3,4,1\n")
    assert rows(R.tracking_csv(spark, p), "frame", "id", "x") == [(1, 7, 1.5), (3, 9, None)]
    p = put(tmp_path / "court.csv", "frame,x\n1,2.5\n2,oops\n")
    assert rows(R.court_csv(spark, p)) == [(1.0, 2.5), (2.0, None)]


def test_truth_and_ignored_rows(spark, tmp_path):
    p = put(tmp_path / "gt.txt", "1,1,0,0,5,5,1,1,1.0\n1,2,0,0,5,5,0,1,1.0\n1,3,0,0,5,5,1,8,0.5\n2,4,0,0,5,5,1,3,-1\n0,9,0,0,5,5,1,1,1\n")
    assert rows(R.truth_csv(spark, p), "id") == [(1,)] and rows(R.truth_csv(spark, p, ignored=True), "id") == [(3,), (4,)]


def test_track_text_and_vectors(spark, tmp_path):
    p = put(tmp_path / "w.txt", "1,2,0,0,5,5,0.5,player,100,red,nan\n")
    assert rows(R.track_text(spark, p), "track_id", "role", "jersey", "colour", "team") == [(2, "player", None, "red", None)]
    spark.createDataFrame([(1, 0.25, 1.0, [1.0]), (1, 0.35, 1.0, [2.0])], "frame long, x double, y double, vector array<double>").write.parquet(str(tmp_path / "v"))
    v = R.detection_vectors(spark, str(tmp_path / "v"))
    got = R.with_vectors(spark.createDataFrame([(1, 0.24, 1.0), (1, 9.0, 1.0)], "frame long, x double, y double"), v)
    assert rows(got, "x", "vector") == [(0.24, [1.0]), (9.0, None)]


def test_homographies_and_zips(spark, tmp_path):
    p = put(tmp_path / "h.json", '{"frame": 1, "homography": [[1,0,0],[0,1,0],[0,0,1]]}\n{"frame": 2, "homography": [[1]]}\n')
    assert rows(R.homographies(spark, p)) == [(1, [1.0, 0, 0, 0, 1, 0, 0, 0, 1])]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("a/x.json", '{"n": 1}')
        z.writestr("a/y.txt", "no")
    assert rows(R.zipped_documents(spark, str(tmp_path / "z.zip")), "name", "text") == [("a/x.json", '{"n": 1}')]


def test_lists_or_objects_and_stores(spark, tmp_path):
    one, two = put(tmp_path / "l.json", '[{"frame": 3, "left": 1}]'), put(tmp_path / "o.json", '{"timeline": [{"frame": 4, "left": 2}], "x": 1}')
    assert rows(R.timeline_or_cards(spark, one, "timeline", "frame: long, left: int")) == [(3, 1)] and rows(R.timeline_or_cards(spark, two, "timeline", "frame: long, left: int")) == [(4, 2)]
    spark.createDataFrame([("m", "pass", "e2", 5), ("m", "shot", "e1", 2), ("n", "pass", "e3", 1)], "match_id string, kind string, event_id string, start_ms long").write.partitionBy("match_id", "kind").parquet(str(tmp_path / "s"))
    assert [r["event_id"] for r in R.store_rows(spark, str(tmp_path / "s"), match="m").collect()] == ["e1", "e2"]
    assert [r["event_id"] for r in R.store_rows(spark, str(tmp_path / "s"), kind="pass", ident="e3").collect()] == ["e3"]


def test_json_readers(spark, tmp_path):
    p = put(tmp_path / "gt.json", json.dumps({"annotations": [{"image_id": "3021000123", "track_id": 5, "attributes": {"role": "player", "jersey": "7", "team": "left"}}]}))
    assert rows(R.truth_labels(spark, p)) == [(123, 5, "player", "7", "left")]
    p = put(tmp_path / "a.json", '{"event_id": "e", "kind": "pass", "timestamp_ms": 1}\n')
    assert R.annotations(spark, p).first()["kind"] == "pass"
    p = put(tmp_path / "bad.json", '{"event_id": "e", "timestamp_ms": "soon"}\n')
    with pytest.raises(Exception):
        R.annotations(spark, p).collect()
    p = put(tmp_path / "j.json", '{"identity": "i", "votes": {"7": 2}, "answers": ["7", "7", "8"]}\n')
    assert rows(R.jersey_reads(spark, p), "identity", "questions") == [("i", 3)]
    p = put(tmp_path / "e.json", '{"truth": "a", "prediction": "b", "confidence": 0.5}\n')
    assert R.evaluation_rows(spark, p).first()["prediction"] == "b"
    p = put(tmp_path / "r.json", json.dumps({"team": "T", "short": "t", "players": {"7": "Ann", "1": "Bo"}, "goalkeepers": ["1"], "starting_lineup": ["7"]}))
    assert rows(R.rosters(spark, p), "number", "name", "is_keeper", "is_starter") == [(1, "Bo", True, False), (7, "Ann", False, True)]
    p = put(tmp_path / "t.json", '{"stage": "s", "gpu": "10, x"}\n{"stage": "s", "gpu": "30, y"}\n')
    assert rows(R.telemetry(spark, p)) == [("s", 20.0, 30.0)]
    put(tmp_path / "good-1.json", "{}")
    put(tmp_path / "bad name.json", "{}")
    assert "good-1" in [r["report_id"] for r in R.report_files(spark, str(tmp_path)).collect()] and "bad name" not in [r["report_id"] for r in R.report_files(spark, str(tmp_path)).collect()]


def test_configurations(tmp_path):
    put(tmp_path / "base.yaml", "# base\na: 1\nb:\n  c: 'x'\n  d: [1, 2.5, yes]\n  e:\n    - p\n    - 2\nf: null\n")
    put(tmp_path / "own.yaml", "extends: base.yaml\nb:\n  c: y\ng: true\n")
    assert R.config(str(tmp_path / "own.yaml")) == {"a": 1, "b": {"c": "y", "d": [1, 2.5, "yes"], "e": ["p", 2]}, "f": None, "g": True}
    with pytest.raises(ValueError):
        R.parsed_yaml("a: 1\nno colon here\n")


def test_ledgers_and_stores_round_trip(spark, tmp_path):
    e = spark.createDataFrame([("e1", "pass", {"a": "1"}), ("e2", "shot", None)], "event_id string, type string, attributes map<string,string>")
    m = spark.createDataFrame([("r", {"k": "v"})], "run string, info map<string,string>")
    W.write_store(e, m.withColumnRenamed("run", "player"), m, str(tmp_path / "store"))
    assert rows(spark.read.parquet(str(tmp_path / "store/events")), "event_id", "attributes_json") == [("e1", '{"a":"1"}'), ("e2", None)]
    assert rows(spark.read.parquet(str(tmp_path / "store/meta"))) == [("r", '{"k":"v"}')]
    W.write_json(e.drop("attributes"), str(tmp_path / "l"))
    assert rows(R.ledger(spark, str(tmp_path / "l")), "event_id", "type") == [("e1", "pass"), ("e2", "shot")]
    d = spark.createDataFrame([(1, ("player", "red"))], "frame long, attributes struct<role string, color string>")
    W.write_predictions(d, str(tmp_path / "p"))
    assert rows(spark.read.text(str(tmp_path / "p"))) == [('{"frame":1,"attributes":{"role":"player"}}',)]


def test_text_forms(spark):
    t = spark.createDataFrame([(1, 5, 1.0, 2.0, 3.0, 4.0, 0.5), (2, -1, 1.0, 2.0, 3.0, 4.0, 0.5)], "frame long, track_id long, x double, y double, w double, h double, score double")
    assert rows(W.tracking_lines(t)) == [("1,5,1.00,2.00,3.00,4.00,0.50,-1,-1,-1",)]
    assert rows(W.tracking_lines(t, 1, False)) == [("1,5,1.0,2.0,3.0,4.0,-1,-1,-1,-1",)]
    assert rows(W.benchmark_lines(t)) == [("1,5,1.0,2.0,3.0,4.0,1,-1,-1,-1",)]
    assert rows(W.benchmark_lines(t, "kitti")) == [("0 5 pedestrian 0 0 -10 1.0 2.0 4.0 6.0 -10 -10 -10 -1000 -1000 -1000 -10",)]
    many = t.unionByName(t.withColumn("track_id", F.lit(9).cast("long")))
    assert rows(W.renumbered(many.where("track_id > 0").withColumn("m", F.lit(1)), ["m"]), "track_id") == [(1,), (2,), (2,)]
    assert W.timeline(t.withColumn("m", F.lit(1)), ["m"]).count() == 2
    text = W.summary_text(spark.createDataFrame([(1, "left", {"shots": 3.0, "passes": None}), (1, "right", {"shots": 1.0})], "match_id int, team string, figures map<string,double>"), "Match").first()["text"]
    assert text == "Match\nleft: passes unknown, shots 3.00\nright: shots 1.00"


def test_caches_manifests_and_runs(spark, tmp_path):
    requests = W.cache_key(spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int"))
    path = str(tmp_path / "cache")
    W.cache_put(requests.where("y = 1").select("key", F.lit(10).alias("result")), path)
    assert W.not_cached(requests, spark.read.parquet(path)).count() == 1
    W.cache_put(requests.select("key", F.lit(20).alias("result")), path)
    assert rows(W.cache_get(requests, path), "x", "result") == [("a", 10), ("b", 20)]
    again = W.cache_key(spark.createDataFrame([(1, "a")], "y int, x string"))
    assert again.first()["key"] == requests.where("y = 1").first()["key"]
    put(tmp_path / "f.bin", "abc")
    assert "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" in [r["sha256"] for r in W.manifest(spark, str(tmp_path / "f.bin")).collect()]
    one, two = W.run_row(spark, {"b": 1, "a": 2}, {"m": "1"}, "now"), W.run_row(spark, {"a": 2, "b": 1}, {}, "now")
    assert one.first()["config_sha256"] == two.first()["config_sha256"] and "spark" in one.first()["versions"]
    plan = spark.createDataFrame([(1,), (2,)], "chunk int")
    assert rows(W.unfinished(plan, plan.where("chunk = 1"), ["chunk"])) == [(2,)]
    flat = W.flattened(spark.createDataFrame([(1, (2, "s"))], "id int, passing struct<total int, source string>"))
    assert flat.columns == ["id", "passing_total"]


def test_report_csv_and_chunks_that_come_again(spark, tmp_path):
    from trackloom.streaming import online

    W.write_report_csv(spark.createDataFrame([(1, (2, "s"))], "id int, passing struct<total int, source string>"), str(tmp_path / "csv"))
    assert rows(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("1", "2")]
    write = online.upsert_chunks(str(tmp_path / "chunks"), ["id"], "chunk")
    chunk = lambda *r: spark.createDataFrame(r, "id int, chunk int, v int")
    write(chunk((1, 0, 5), (2, 0, 6)), 0)
    write(chunk((3, 1, 7)), 1)
    write(chunk((2, 0, 9), (2, 0, 9)), 2)  # a chunk that is sent again replaces itself
    assert rows(spark.read.parquet(str(tmp_path / "chunks")), "id", "v") == [(1, 5), (2, 9), (3, 7)]


def test_streams_retry_and_progress(spark):
    from trackloom.streaming import online

    calls, lost = [], []

    def work(batch, number):
        calls.append((number, batch.rdd.getNumPartitions()))
        if number == 1 and len(calls) == 1 or number == 2:
            raise RuntimeError("no")

    f = online.with_retry(work, lambda n, why: lost.append((n, why)))
    for n in (1, 2, 3):
        f(spark.range(8).repartition(4), n)
    assert [c[0] for c in calls] == [1, 1, 2, 2, 3] and [c[1] for c in calls] == [4, 1, 4, 1, 4] and lost == [(2, "no / no")]
    p = spark.createDataFrame([(1, 1, 0.2), (1, 2, 0.1), (1, 3, 1.7)], "job int, seq int, share double")
    assert rows(online.monotone_progress(p, ["job"]), "seq", "share") == [(1, 0.2), (2, 0.2), (3, 1.0)]
    look = online.needs_second_look(F.lit(0.9), F.lit(0.5), F.lit(False)), online.needs_second_look(F.lit(0.5), F.lit(0.5), F.lit(False))
    assert spark.range(1).select(*look).first()[:] == (False, True)
