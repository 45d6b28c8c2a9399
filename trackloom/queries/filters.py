"""Queries of row filters and small rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import filters as K
from trackloom.operators import validate as C
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query

M = ["match_id"]
_B = f"{ROWS}, b AS (SELECT event_id, frame, kind, x + 50 AS x, y + 30 AS y, k % 30 * 1.0 AS w, k % 20 * 1.0 AS h, (k % 100) / 100.0 AS score FROM d)"


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    return detections(spark, sf).select("event_id", "frame", "kind", (F.col("x") + 50).alias("x"), (F.col("y") + 30).alias("y"), (k % 30 * 1.0).alias("w"), (k % 20 * 1.0).alias("h"), (k % 100 / 100.0).alias("score"))


@query(f"WITH {_B} SELECT event_id, w, h FROM b WHERE x >= 1 AND y >= 1 AND w >= 2 AND h >= 2 AND w * h > 40")
def sane_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """boxes inside the picture, not too thin and not too small."""
    return K.sane_boxes(_boxes(spark, sf), least_area=40.0).select("event_id", "w", "h")


@query(f"WITH {_B} SELECT event_id FROM b WHERE w * h > 64 AND w * h < 400")
def scaled_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """F8: boxes within a range of scales."""
    return K.in_scale(_boxes(spark, sf), 8.0, 20.0).select("event_id")


@query(f"WITH {_B} SELECT event_id FROM b WHERE (kind = 'click' AND score >= 0.5) OR (kind = 'view' AND score >= 0.2)")
def confident_rows(spark: SparkSession, sf: str) -> DataFrame:
    """rows of the wanted classes above the floors of their classes."""
    return K.confident(_boxes(spark, sf), {"click": 0.5, "view": 0.2}, "kind").select("event_id")


@query(f"WITH {ROWS} SELECT event_id FROM d WHERE frame % 5 = 0")
def strided_rows(spark: SparkSession, sf: str) -> DataFrame:
    """every fifth frame."""
    return K.strided(detections(spark, sf), 5).select("event_id")


@query(f"""WITH {ROWS}, r AS (SELECT event_id, match_id, track_id, frame // 60 AS frame, CASE track_id % 3 WHEN 0 THEN 'Player' WHEN 1 THEN 'referee' ELSE 'ball' END AS role FROM d), l AS (SELECT match_id, max(frame) AS last FROM r GROUP BY match_id),
w AS (SELECT r.*, count(*) OVER t AS n, greatest(2, least(6, CAST(round_even((last - min(frame) OVER t + 1) * 0.5, 0) AS INTEGER))) AS need FROM r JOIN l USING (match_id) WINDOW t AS (PARTITION BY match_id, track_id)) SELECT event_id FROM w WHERE lower(role) NOT IN ('player', 'referee') OR n >= need""")
def long_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """short tracks go, but late ones are judged by the frames that were left."""
    t = F.col("track_id") % 3
    r = detections(spark, sf).select("event_id", "match_id", "track_id", F.floor(F.col("frame") / 60).alias("frame"), F.when(t == 0, "Player").when(t == 1, "referee").otherwise("ball").alias("role"))
    return K.long_tracks(r, M, least=6, floor=2).select("event_id")


@query(f"""WITH {ROWS}, c AS (SELECT CAST(floor((x + 53) / 10) AS INTEGER) AS gx, CAST(floor((y + 35) / 7) AS INTEGER) AS gy, kind, count(*) AS value FROM d GROUP BY ALL) SELECT kind, gx, gy, value FROM c a WHERE value >= (SELECT max(value) FROM c b WHERE b.kind = a.kind AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1)""")
def grid_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """cells of a grid that no neighbour exceeds."""
    d = detections(spark, sf)
    c = d.groupBy("kind", F.floor((F.col("x") + 53) / 10).cast("int").alias("gx"), F.floor((F.col("y") + 35) / 7).cast("int").alias("gy")).agg(F.count("*").alias("value"))
    return K.grid_peaks(c, ["kind"])


# ------------------------------------------------------------------ rosters
def _roster(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select((F.col("n_regionkey") % 2).alias("team"), n.alias("number"), F.col("n_name").alias("name"), (n % 7 == 0).alias("is_keeper"), ((F.col("n_regionkey") % 2 == 0) & (n % 3 == 0)).alias("is_starter"))


_RO = "ro AS (SELECT n_regionkey % 2 AS team, n_nationkey AS number, n_name AS name, n_nationkey % 7 = 0 AS is_keeper, n_regionkey % 2 = 0 AND n_nationkey % 3 = 0 AS is_starter FROM nation)"


@query(f"WITH {_RO}, a AS (SELECT *, max(CASE WHEN is_starter THEN 1 ELSE 0 END) OVER (PARTITION BY team) AS has FROM ro) SELECT CASE WHEN is_keeper THEN 'goalkeeper' ELSE 'player' END AS role, team, number FROM a WHERE has = 0 OR is_starter")
def allowed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """numbers that a role may have, within the line-up of teams that have one."""
    return K.allowed_numbers(_roster(spark, sf), starters_only=True)


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return detections(spark, sf).where("k % 3 <> 0").select(F.col("team").alias("side"), "track_id", (F.col("k") % 40).alias("number"))


_RE = f"{ROWS}, {_RO}, re AS (SELECT team AS side, track_id, k % 40 AS number FROM d WHERE k % 3 <> 0)"


@query(f"WITH {_RE} SELECT side, count(DISTINCT track_id) AS identities, count(*) AS reads, count(*) FILTER (number NOT IN (SELECT number FROM ro)) AS outside FROM re GROUP BY side")
def roster_check(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers that are in neither squad, by side."""
    return K.roster_check(_reads(spark, sf), _roster(spark, sf))


@query(f"WITH {_RE}, s AS (SELECT ro.*, number IN (SELECT number FROM re) AS seen FROM ro) SELECT team, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (seen), '') AS found, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (seen AND is_starter), '') AS starters_found, coalesce(string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (NOT seen AND is_starter), '') AS starters_missing FROM s GROUP BY team")
def squad_check(spark: SparkSession, sf: str) -> DataFrame:
    """Who of a squad was found or missed."""
    s = K.squad_check(_reads(spark, sf), _roster(spark, sf))
    return s.select("team", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("found", "starters_found", "starters_missing")])


@query(f"WITH {ROWS}, {_RO}, e AS (SELECT track_id % 2 AS cluster, k % 25 AS number, x + 53 AS weight FROM d), j AS (SELECT e.*, ro.team FROM e JOIN ro USING (number)), s AS (SELECT coalesce(sum(weight) FILTER (cluster = team), 0) AS direct, coalesce(sum(weight) FILTER (cluster <> team), 0) AS swapped FROM j) SELECT direct, swapped, CASE WHEN direct >= swapped THEN 'direct' ELSE 'swapped' END AS mapping FROM s")
def clusters_to_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Which cluster is which squad, by the evidence of numbers."""
    e = detections(spark, sf).select((F.col("track_id") % 2).alias("cluster"), (F.col("k") % 25).alias("number"), (F.col("x") + 53).alias("weight"))
    return K.clusters_to_teams(e, _roster(spark, sf))


@query(f"WITH {ROWS}, {_RO} SELECT event_id, ro.name FROM d LEFT JOIN ro ON ro.team = track_id % 2 AND ro.number = k % 30")
def names_of_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Names by side and number."""
    r = detections(spark, sf).select("event_id", (F.col("track_id") % 2).alias("team"), (F.col("k") % 30).alias("number"))
    return K.named(r, _roster(spark, sf)).select("event_id", "name")


@query(f"WITH {ROWS}, p AS (SELECT match_id, frame // 30 AS frame, track_id, team, x, row_number() OVER (PARTITION BY match_id, frame // 30 ORDER BY x DESC, track_id, event_id) AS rk, max(x) OVER (PARTITION BY match_id, frame // 30) AS top FROM d) SELECT match_id, team, count(*) AS votes FROM p WHERE top >= -20 AND rk <= 2 GROUP BY match_id, team")
def defending_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes of the deepest players in front of a goal, where play is near it."""
    d = detections(spark, sf).withColumn("frame", F.floor(F.col("frame") / 30))
    one = d.withColumn("track_id", F.col("track_id") * 10000000 + F.col("event_id"))  # rows of a track in one half hour are told apart
    return K.defending_votes(one, M, F.lit(1), least_depth=-20.0)  # the rows seldom reach the last quarter


@query(f"WITH {ROWS}, s AS (SELECT DISTINCT match_id, track_id FROM d WHERE k % 4 <> 0), l AS (SELECT event_id, match_id, track_id + 1 AS track_id FROM d) SELECT 'label' AS part, event_id AS id FROM l SEMI JOIN s USING (match_id, track_id) UNION ALL SELECT 'summary', track_id FROM s ANTI JOIN l USING (match_id, track_id)")
def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of known tracks, and tracks that no label names."""
    d = detections(spark, sf)
    labels = d.select("event_id", "match_id", (F.col("track_id") + 1).alias("track_id"))
    known, unnamed = K.coverage_joins(labels, d.where("k % 4 <> 0").select("match_id", "track_id").distinct(), ["match_id", "track_id"])
    return known.select(F.lit("label").alias("part"), F.col("event_id").alias("id")).unionByName(unnamed.select(F.lit("summary").alias("part"), F.col("track_id").alias("id")))


# ------------------------------------------------------------------ columns
@query(f"WITH {ROWS}, c AS (SELECT event_id, CAST(trunc((x + 52.5) * 10 + 50) AS INTEGER) AS px, CAST(trunc((y + 34.0) * 10 + 50) AS INTEGER) AS py FROM d) SELECT event_id, px, py, (px - 50) / 10.0 - 52.5 AS x, (py - 50) / 10.0 - 34 AS y FROM c")
def canvas(spark: SparkSession, sf: str) -> DataFrame:
    """Places as pixels of a drawn pitch, and back."""
    c = detections(spark, sf).select("event_id", K.to_canvas(F.col("x"), F.col("y")).alias("p")).select("event_id", "p.*")
    return c.withColumn("q", K.from_canvas(F.col("px"), F.col("py"))).select("event_id", "px", "py", "q.x", "q.y")


@query(f"WITH {ROWS}, s AS (SELECT *, min(frame) OVER (PARTITION BY match_id) AS s0 FROM d) SELECT event_id, frame / 25.0 AS video_s, (frame - s0) / 25.0 AS segment_s, printf('%02d:%06.3f', CAST(floor((frame - s0) / 25.0 / 60) AS INTEGER), ((frame - s0) / 25.0) % 60) AS text, CASE WHEN frame < 720 THEN 1 ELSE 2 END AS period FROM s")
def clocks(spark: SparkSession, sf: str) -> DataFrame:
    """Where rows stand on the clocks."""
    from pyspark.sql import Window

    d = detections(spark, sf).withColumn("s0", F.min("frame").over(Window.partitionBy("match_id")))
    return d.select("event_id", K.clock(F.col("frame"), 25.0, F.col("s0"), F.when(F.col("frame") < 720, 1).otherwise(2)).alias("c")).select("event_id", "c.*")


@query(f"WITH {ROWS} SELECT event_id, to_json({{'at': {{'frame': frame, 'track': track_id}}, 'kind': kind, 'none': CASE WHEN k % 2 = 0 THEN k END}}) AS payload, k % 2 = 0 AS known, CASE WHEN k % 2 = 0 THEN k END AS again FROM d")
def nested_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Nested rows to JSON text and back."""
    k = F.col("k")
    row = F.struct(F.struct("frame", F.col("track_id").alias("track")).alias("at"), "kind", F.when(k % 2 == 0, k).alias("none"))
    p = detections(spark, sf).select("event_id", K.payload(row).alias("payload"))
    back = F.from_json("payload", "struct<at struct<frame long, track long>, kind string, none int>")
    return p.withColumn("b", back).select("event_id", "payload", F.col("b.none").isNotNull().alias("known"), F.col("b.none").alias("again"))


@query(f"""WITH {ROWS}, e AS (SELECT event_id, CASE WHEN k % 17 = 0 THEN -1 ELSE frame END AS t, CASE WHEN k % 13 = 0 THEN frame - 2 ELSE frame + 5 END AS en, k % 11 = 0 AS noev, k % 19 = 0 AS blank, k % 23 = 0 AS inf, CASE WHEN k % 29 = 0 THEN -1.0 ELSE 3.0 END AS dist, (k % 12) / 10.0 AS xg, (k % 14 - 1) / 10.0 AS conf, k % 5 = 0 AS nokind FROM d)
SELECT event_id, 'negative time' AS rule FROM e WHERE t < 0 UNION ALL SELECT event_id, 'ends before it starts' FROM e WHERE en < t UNION ALL SELECT event_id, 'empty evidence' FROM e WHERE noev OR blank UNION ALL SELECT event_id, 'not finite' FROM e WHERE inf UNION ALL SELECT event_id, 'negative measure' FROM e WHERE dist < 0 UNION ALL SELECT event_id, 'expected value above 1' FROM e WHERE xg > 1 UNION ALL SELECT event_id, 'confidence out of range' FROM e WHERE conf < 0 OR conf > 1 UNION ALL SELECT event_id, 'confidence without its kind' FROM e WHERE nokind""")
def report_event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V3: what is wrong with a report event."""
    d, k = detections(spark, sf), F.col("k")
    evidence = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 19 == 0, F.array(F.lit("a"), F.lit(" "))).otherwise(F.array(F.lit("a")))
    numbers = F.create_map(F.lit("distance_m"), F.when(k % 29 == 0, -1.0).otherwise(3.0), F.lit("xg"), k % 12 / 10.0, F.lit("other"), F.when(k % 23 == 0, float("inf")).otherwise(1.0))
    e = d.select("event_id", F.when(k % 17 == 0, -1).otherwise(F.col("frame")).alias("timestamp_ms"), F.when(k % 13 == 0, F.col("frame") - 2).otherwise(F.col("frame") + 5).alias("end_ms"), evidence.alias("evidence_ids"), numbers.alias("numbers"), ((k % 14 - 1) / 10.0).alias("confidence"), F.when(k % 5 != 0, "heuristic").alias("confidence_kind"))
    return C.violations(e, ["event_id"], C.REPORT_RULES)


@query(f"""WITH {ROWS}, e AS (SELECT event_id, frame AS s, CASE WHEN k % 13 = 0 THEN frame - 1 ELSE frame + 4 END AS en, k % 4 = 0 AS ins, CASE WHEN k % 3 = 0 THEN 'unknown' ELSE 'pass' END AS ev, k % 6 = 0 AS back FROM d) SELECT event_id, 'ends before it starts' AS rule FROM e WHERE en < s UNION ALL SELECT event_id, 'insufficient evidence names an event' FROM e WHERE ins AND ev <> 'unknown' UNION ALL SELECT event_id, 'timestamps out of order' FROM e WHERE back""")
def semantic_event_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V1, V2: what is wrong with a semantic event."""
    d, k, f = detections(spark, sf), F.col("k"), F.col("frame")
    e = d.select("event_id", f.alias("start_ms"), F.when(k % 13 == 0, f - 1).otherwise(f + 4).alias("end_ms"), (k % 4 == 0).alias("insufficient_evidence"), F.when(k % 3 == 0, "unknown").otherwise("pass").alias("event"), F.when(k % 6 == 0, F.array(f, f - 1)).otherwise(F.array(f, f, f + 1)).alias("times"))
    return C.violations(e, ["event_id"], C.SEMANTIC_RULES)
