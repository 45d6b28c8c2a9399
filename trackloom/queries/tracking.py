"""Queries on the tracking view of `events`: segmentation, rolling statistics, joins and match aggregates, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import aggregates as A
from trackloom.operators import joins as J
from trackloom.operators import temporal as T
from trackloom.plans.tracking import BALL, POINTS, ROWS, ball, detections, track_points
from trackloom.queries.registry import query

MT = ["match_id", "track_id"]


@query(f"""WITH {POINTS},
s AS (SELECT *, sum(CASE WHEN gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, track_id ORDER BY frame) AS island
  FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY match_id, track_id ORDER BY frame) AS gap FROM p))
SELECT match_id, track_id, CAST(island AS BIGINT) AS island, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS samples FROM s GROUP BY match_id, track_id, island""")
def segments_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps and islands."""
    return T.segments(track_points(spark, sf), MT, gap=120)


@query(f"""WITH {BALL},
g AS (SELECT *, CASE WHEN lag(owner) OVER w IS DISTINCT FROM owner OR frame - lag(frame) OVER w > 12 THEN 1 ELSE 0 END AS n FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
r AS (SELECT match_id, owner, team, min(frame) AS start_frame, max(frame) AS end_frame FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM g) GROUP BY match_id, owner, team, i),
h AS (SELECT *, CASE WHEN lag(owner) OVER (PARTITION BY match_id ORDER BY start_frame) IS DISTINCT FROM owner THEN 1 ELSE 0 END AS n FROM r),
q AS (SELECT match_id, owner, team, min(start_frame) AS s, max(end_frame) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY start_frame) AS i FROM h) GROUP BY match_id, owner, team, i),
o AS (SELECT match_id, owner, team, count(*) AS spells, CAST(sum(e - s + 1) AS BIGINT) AS frames FROM q GROUP BY match_id, owner, team)
SELECT *, frames / sum(frames) OVER (PARTITION BY match_id) AS share FROM o""")
def possession_spells(spark: SparkSession, sf: str) -> DataFrame:
    """Who had the ball, for how long."""
    from trackloom.operators.events_a import spells

    s = spells(ball(spark, sf), ["match_id"], "owner", gap=12, least=1)
    out = s.groupBy("match_id", "owner", "team").agg(F.count("*").alias("spells"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("frames"))
    return out.withColumn("share", F.col("frames") / F.sum("frames").over(Window.partitionBy("match_id")))


@query(f"""WITH {ROWS}, ballp AS (SELECT match_id, frame, x, y, event_id FROM d WHERE kind = 'purchase'),
c AS (SELECT b.event_id, d.track_id AS other, sqrt((b.x - d.x) * (b.x - d.x) + (b.y - d.y) * (b.y - d.y)) AS dist, d.event_id AS oe FROM ballp b JOIN d ON b.match_id = d.match_id AND b.frame // 30 = d.frame // 30 AND d.kind <> 'purchase')
SELECT event_id, other, dist FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, oe) AS rn FROM c WHERE dist < 25) WHERE rn = 1""")
def nearest_in_radius(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest within a radius, per moment of half an hour."""
    d = detections(spark, sf).withColumn("slot", F.floor(F.col("frame") / 30))
    points = d.where("kind = 'purchase'").select("match_id", "slot", F.col("event_id").alias("id"), "x", "y")
    others = d.where("kind <> 'purchase'").select("match_id", "slot", F.col("track_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("event_id").alias("oe"))
    return J.nearest_of_group(points, others, ["match_id", "slot"], 25.0).select(F.col("id").alias("event_id"), "other", "dist")


@query(f"""WITH {POINTS}, q AS (SELECT match_id, frame, track_id FROM p WHERE kind = 'click'),
r AS (SELECT DISTINCT match_id, frame, max(x) OVER (PARTITION BY match_id, frame) AS rx FROM p WHERE kind <> 'click'),
j AS (SELECT q.match_id, q.track_id, q.frame, r.frame AS matched_frame, r.rx, row_number() OVER (PARTITION BY q.match_id, q.frame, q.track_id ORDER BY 2 * abs(r.frame - q.frame) - CASE WHEN r.frame > q.frame THEN 1 ELSE 0 END) AS rn
  FROM q LEFT JOIN r ON q.match_id = r.match_id AND abs(r.frame - q.frame) <= 3)
SELECT match_id, track_id, frame, matched_frame, rx FROM j WHERE rn = 1""")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest frame within +-3, forward first."""
    p = track_points(spark, sf)
    left = p.where("kind = 'click'").select("match_id", "frame", "track_id")
    right = p.where("kind <> 'click'").groupBy("match_id", "frame").agg(F.max("x").alias("rx"))
    return J.asof_nearest(left, right, ["match_id"], ident=["track_id"]).select("match_id", "track_id", "frame", "matched_frame", "rx")


@query(f"""WITH {BALL}, i AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS pos FROM b), l AS (SELECT match_id, max(pos) AS lastp FROM i GROUP BY match_id),
q AS (SELECT DISTINCT match_id, frame + 2 AS frame FROM d WHERE kind = 'error'),
f AS (SELECT q.match_id, q.frame, min(i.pos) AS pos FROM q LEFT JOIN i ON q.match_id = i.match_id AND i.frame >= q.frame GROUP BY q.match_id, q.frame)
SELECT f.match_id, f.frame, a.frame AS from_frame, a.x AS from_x, z.frame AS to_frame, z.x AS to_x FROM f JOIN l ON f.match_id = l.match_id LEFT JOIN i a ON a.match_id = f.match_id AND a.pos = f.pos LEFT JOIN i z ON z.match_id = f.match_id AND z.pos = least(f.pos + 10, CASE WHEN f.pos IS NULL THEN NULL ELSE lastp END) AND f.pos IS NOT NULL""")
def asof_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The first sample at or after a frame, and the one ten samples later."""
    q = detections(spark, sf).where("kind = 'error'").select("match_id", (F.col("frame") + 2).alias("frame")).distinct()
    out = J.asof_forward(q, ball(spark, sf).select("match_id", "frame", "x"), ["match_id"])
    return out.withColumn("ok", F.col("next_pos").isNotNull()).select("match_id", "frame", "from_frame", "from_x", F.when(F.col("ok"), F.col("to_frame")).alias("to_frame"), F.when(F.col("ok"), F.col("to_x")).alias("to_x"))


@query(f"""WITH {POINTS}, m AS (SELECT *, median(x) OVER (PARTITION BY match_id, track_id ORDER BY frame RANGE BETWEEN 120 PRECEDING AND 120 FOLLOWING) AS mx FROM p)
SELECT match_id, track_id, frame, mx AS median_x, avg(mx) OVER (PARTITION BY match_id, track_id ORDER BY frame RANGE BETWEEN 300 PRECEDING AND 300 FOLLOWING) AS smooth_x FROM m""")
def rolling_median_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Frame-aligned median, then mean of the medians."""
    m = T.rolling_median_time(track_points(spark, sf), MT, "frame", "x", 120, "median_x")
    return T.rolling_mean_time(m, MT, "frame", "median_x", 300, "smooth_x").select(*MT, "frame", "median_x", "smooth_x")


@query(f"""WITH {POINTS} SELECT match_id, track_id, frame, median(x) OVER w AS median_x, avg(y) OVER w AS mean_y FROM p WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def rolling_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Median and mean of three rows."""
    m = T.rolling_median_rows(track_points(spark, sf), MT, ["frame"], "x", 1, "median_x")
    return T.rolling_mean_rows(m, MT, ["frame"], "y", 1, "mean_y").select(*MT, "frame", "median_x", "mean_y")


@query(f"""WITH {BALL}, n AS (SELECT *, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame))
SELECT match_id, frame, x, y, false AS interpolated FROM b UNION ALL
SELECT match_id, frame + k, x + (nx - x) * k / (nf - frame), y + (ny - y) * k / (nf - frame), true FROM (SELECT *, unnest(range(1, nf - frame)) AS k FROM n WHERE nf - frame BETWEEN 2 AND 12)""")
def interpolate_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Linear rows in gaps of 2 to 12 frames."""
    return T.interpolate(ball(spark, sf), ["match_id"])


@query(f"""WITH {BALL}, s AS (SELECT *, first_value(frame) OVER w AS f0, last_value(frame) OVER w AS f1, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT match_id, frame, CASE WHEN f1 > f0 THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / ((f1 - f0) / 2.0) ELSE 0 END AS speed FROM s""")
def baseline_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Speed over a baseline of +-4 frames (at 2 frames a second)."""
    return T.speeds(ball(spark, sf), ["match_id"], 2.0).select("match_id", "frame", "speed")


_SPEED = f"""{BALL}, sp AS (SELECT match_id, frame, CASE WHEN f1 > f0 THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / ((f1 - f0) / 2.0) ELSE 0 END AS speed FROM (SELECT *, first_value(frame) OVER w AS f0, last_value(frame) OVER w AS f1, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)))"""


@query(f"""WITH {_SPEED}, f AS (SELECT *, speed >= 7 AS fast, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS nf FROM sp),
c AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM (SELECT *, CASE WHEN lag(fast) OVER (PARTITION BY match_id ORDER BY frame) IS DISTINCT FROM fast THEN 1 ELSE 0 END AS n FROM f)),
r AS (SELECT match_id, min(frame) AS start_frame, arg_max(coalesce(nf, frame), frame) AS end_frame, max(speed) AS peak FROM c WHERE fast GROUP BY match_id, i)
SELECT * FROM r WHERE (end_frame - start_frame) / 2.0 >= 0.6""")
def sprints(spark: SparkSession, sf: str) -> DataFrame:
    """Runs at 7 m/s or more that last 0.6 s."""
    return T.sprints(T.speeds(ball(spark, sf), ["match_id"], 2.0), ["match_id"], 2.0)


@query(f"""WITH {_SPEED}, f AS (SELECT *, speed >= 7 AS fast FROM sp),
c AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM (SELECT *, CASE WHEN lag(fast) OVER w IS DISTINCT FROM fast OR frame - lag(frame) OVER w > 3 THEN 1 ELSE 0 END AS n FROM f WINDOW w AS (PARTITION BY match_id ORDER BY frame))),
r AS (SELECT match_id, i, count(*) AS n FROM c WHERE fast GROUP BY match_id, i)
SELECT match_id, count(*) FILTER (n >= 2) AS sprints FROM r GROUP BY match_id""")
def sprint_count(spark: SparkSession, sf: str) -> DataFrame:
    """Streaks with gaps of up to three frames."""
    return T.sprint_count(T.speeds(ball(spark, sf), ["match_id"], 2.0), ["match_id"], 2.0)


@query(f"""WITH {BALL}, s AS (SELECT match_id, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame))
SELECT match_id, coalesce(sum(step) FILTER (gap <= 12), 0) AS distance_m FROM s GROUP BY match_id""")
def path_length(spark: SparkSession, sf: str) -> DataFrame:
    """Distance without steps over large gaps."""
    return T.path_length(ball(spark, sf), ["match_id"], 12)


@query(f"""WITH {BALL}, s AS (SELECT match_id, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
v AS (SELECT *, step / (gap / 5.0) AS speed FROM s WHERE gap BETWEEN 1 AND 12),
z AS (SELECT *, CASE WHEN speed < 2 THEN 'walk' WHEN speed < 4 THEN 'jog' WHEN speed < 5.5 THEN 'run' WHEN speed < 7 THEN 'high' WHEN speed < 99 THEN 'sprint' END AS zone FROM v)
SELECT match_id, zone, sum(gap) / 5.0 AS seconds, sum(step) AS metres FROM z WHERE zone IS NOT NULL GROUP BY match_id, zone""")
def speed_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Time and distance by band of speed."""
    return A.speed_zones(ball(spark, sf), ["match_id"], 5.0)


@query(f"""WITH {ROWS} SELECT team, greatest(least(CAST(trunc((x + 52.5) / 105.0 * 14) AS INTEGER), 13), 0) AS zx, greatest(least(CAST(trunc((y + 34.0) / 68.0 * 9) AS INTEGER), 8), 0) AS zy, count(*) AS n FROM d GROUP BY ALL""")
def heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """14 x 9 cells, clamped."""
    return A.heatmap(detections(spark, sf), ["team"])


@query(f"""WITH {ROWS}, s AS (SELECT track_id, x * CASE WHEN team = 'left' THEN -1 ELSE 1 END AS a FROM d)
SELECT track_id, avg(CASE WHEN a < -17.5 THEN 1.0 ELSE 0 END) AS defensive, avg(CASE WHEN a BETWEEN -17.5 AND 17.5 THEN 1.0 ELSE 0 END) AS middle, avg(CASE WHEN a > 17.5 THEN 1.0 ELSE 0 END) AS attacking FROM s GROUP BY track_id""")
def thirds(spark: SparkSession, sf: str) -> DataFrame:
    """Share of thirds, with the published sign."""
    return A.thirds(detections(spark, sf), ["track_id"])


@query(f"""WITH {ROWS}, s AS (SELECT match_id, frame // 60 AS frame, team, x, y FROM d),
c AS (SELECT *, avg(x) OVER w AS cx, avg(y) OVER w AS cy FROM s WINDOW w AS (PARTITION BY match_id, frame, team)),
f AS (SELECT match_id, frame, team, count(*) AS n, max(y) - min(y) AS width, max(x) - min(x) AS depth, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS compactness, avg(x * CASE WHEN team = 'left' THEN 1 ELSE -1 END) AS line FROM c GROUP BY match_id, frame, team)
SELECT match_id, team, count(*) AS frames, median(width) AS width, median(depth) AS depth, median(compactness) AS compactness, median(line) AS line FROM f WHERE n >= 4 GROUP BY match_id, team""")
def team_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Width, depth, compactness and line per moment and side, median over moments."""
    return A.team_shape(detections(spark, sf).withColumn("frame", F.floor(F.col("frame") / 60)), ["match_id"])


@query(f"""WITH {ROWS}, r AS (SELECT match_id, rank() OVER (PARTITION BY match_id ORDER BY x) + (count(*) OVER (PARTITION BY match_id, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY match_id ORDER BY y) + (count(*) OVER (PARTITION BY match_id, y) - 1) / 2.0 AS rb FROM d)
SELECT match_id, count(*) AS n, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) ELSE 0 END AS rho FROM r GROUP BY match_id""")
def rank_corr(spark: SparkSession, sf: str) -> DataFrame:
    """Spearman correlation with average ranks."""
    return A.rank_correlation(detections(spark, sf), ["match_id"], "x", "y")


_VALID = f"""{ROWS}, h AS (SELECT match_id, frame // 60 AS hour, x, y FROM d),
r AS (SELECT *, rank() OVER (PARTITION BY match_id, hour ORDER BY x) + (count(*) OVER (PARTITION BY match_id, hour, x) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY match_id, hour ORDER BY y) + (count(*) OVER (PARTITION BY match_id, hour, y) - 1) / 2.0 AS rb FROM h),
s AS (SELECT match_id, hour, count(*) AS people, avg(CASE WHEN abs(x) > 40 THEN 1.0 ELSE 0 END) AS outside, max(x) - min(x) AS extent, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) ELSE 0 END AS rho FROM r GROUP BY match_id, hour),
o AS (SELECT match_id, coalesce(sign(median(CASE WHEN abs(rho) >= 0.8 THEN rho END)), 0) AS orientation FROM s GROUP BY match_id)"""


@query(f"""WITH {_VALID} SELECT match_id, hour, people, CASE WHEN outside > 0.25 THEN 'outside the pitch' WHEN people >= 6 AND extent < 8 THEN 'collapsed' WHEN people >= 6 AND abs(rho) < 0.05 THEN 'not in order' WHEN people >= 6 AND orientation <> 0 AND sign(rho) <> orientation THEN 'mirrored' END AS reason FROM s JOIN o USING (match_id)""")
def frame_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration of moments and the first reason to reject one."""
    d = detections(spark, sf).withColumn("hour", F.floor(F.col("frame") / 60))
    rho = A.rank_correlation(d, ["match_id", "hour"], "x", "y")
    s = d.groupBy("match_id", "hour").agg(F.count("*").alias("people"), F.avg((F.abs("x") > 40).cast("double")).alias("outside"), (F.max("x") - F.min("x")).alias("extent")).join(rho.drop("n"), ["match_id", "hour"])
    return A.frame_validity(s, ["match_id"], least_corr=0.05).select("match_id", "hour", "people", "reason")


@query(f"""WITH {ROWS}, c AS (SELECT track_id, kind, count(*) AS n, min(event_id) AS f FROM d GROUP BY track_id, kind) SELECT track_id, arg_max(kind, n * 1000000000000 - f) AS kind FROM c GROUP BY track_id""")
def mode_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    """A1: majority; ties go to the value seen first."""
    return A.majority(detections(spark, sf), ["track_id"], "kind", "event_id")


@query(f"""WITH {ROWS}, e AS (SELECT track_id, CASE WHEN k % 3 = 0 THEN 100 ELSE k % 20 END AS jersey, event_id FROM d),
c AS (SELECT track_id, jersey, count(*) AS n, min(event_id) AS f FROM e GROUP BY track_id, jersey),
t AS (SELECT track_id, CAST(sum(n) AS BIGINT) AS votes, sum(CASE WHEN jersey = 100 THEN n ELSE 0 END) AS blank, arg_max(jersey, n * 1000000000000 - f) FILTER (jersey <> 100) AS best FROM c GROUP BY track_id)
SELECT track_id, CASE WHEN blank >= 0.35 * votes OR best IS NULL THEN 100 ELSE best END AS jersey, votes FROM t""")
def sentinel_majority(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4: a sentinel that wins only above a share."""
    d = detections(spark, sf).select("track_id", F.when(F.col("k") % 3 == 0, 100).otherwise(F.col("k") % 20).alias("jersey"), "event_id")
    return A.sentinel_majority(d, ["track_id"], "jersey", "event_id", share=0.35)


@query(f"""WITH {POINTS}, s AS (SELECT match_id, track_id, min(frame) AS f0, max(frame) AS f1 FROM p GROUP BY match_id, track_id)
SELECT a.match_id, a.track_id AS a, b.track_id AS b, least(a.f1, b.f1) - greatest(a.f0, b.f0) AS overlap FROM s a JOIN s b ON a.match_id = b.match_id AND a.track_id < b.track_id WHERE least(a.f1, b.f1) - greatest(a.f0, b.f0) > 200""")
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks that overlap in time by more than 200 frames."""
    s = detections(spark, sf).groupBy(*MT).agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    return J.overlap_pairs(s, ["match_id"], "track_id", "f0", "f1", 200)


@query(f"""WITH {ROWS}, e AS (SELECT event_id, match_id, frame * 60000 AS start_ms, CASE WHEN kind = 'view' THEN frame * 60000 + (k + 1) * 60000 * 5 END AS end_ms FROM d),
t AS (SELECT i AS period, i * 21600000 AS p_start, (i + 1) * 21600000 AS p_end FROM range(4) r(i))
SELECT event_id, CAST(period AS INTEGER) AS period, CASE WHEN end_ms IS NULL THEN start_ms ELSE greatest(start_ms, p_start) END AS in_start, CASE WHEN end_ms IS NOT NULL THEN least(end_ms, p_end) END AS in_end FROM e, t
WHERE CASE WHEN end_ms IS NOT NULL THEN greatest(start_ms, p_start) < least(end_ms, p_end) ELSE start_ms >= p_start AND start_ms < p_end END""")
def window_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events in half-open periods; spans are clipped, others belong by onset."""
    e = detections(spark, sf).select("event_id", "match_id", (F.col("frame") * 60000).alias("start_ms"), F.when(F.col("kind") == "view", F.col("frame") * 60000 + (F.col("k") + 1) * 300000).alias("end_ms"))
    periods = spark.range(4).select(F.col("id").cast("int").alias("period"), (F.col("id") * 21600000).alias("p_start"), ((F.col("id") + 1) * 21600000).alias("p_end"))
    periods = e.select("match_id").distinct().crossJoin(F.broadcast(periods))  # matches by four periods
    return J.in_periods(e, periods, ["match_id"]).select("event_id", "period", "in_start", "in_end")


@query(f"""WITH {ROWS}, g AS (SELECT event_id, match_id, team, frame FROM d WHERE kind = 'purchase'), s AS (SELECT match_id, team, frame AS f, track_id, event_id AS se FROM d WHERE kind = 'click'),
j AS (SELECT g.event_id, s.f, s.track_id, row_number() OVER (PARTITION BY g.event_id ORDER BY s.f DESC, s.se) AS rn FROM g LEFT JOIN s ON g.match_id = s.match_id AND g.team = s.team AND g.frame - s.f BETWEEN 0 AND 15)
SELECT event_id, f AS found_frame, track_id AS scorer FROM j WHERE rn = 1""")
def goal_scorer_lookback(spark: SparkSession, sf: str) -> DataFrame:
    """The last event of the same side within 15 frames before."""
    d = detections(spark, sf)
    goals = d.where("kind = 'purchase'").select("event_id", "match_id", "team", "frame")
    shots = d.where("kind = 'click'").select("match_id", "team", "frame", F.col("event_id").alias("se"), F.col("track_id").alias("scorer"))
    return J.last_before(goals, shots, ["match_id", "team"], "frame", 15, ["event_id"]).select("event_id", "found_frame", "scorer")


@query(f"""WITH {ROWS}, r AS (SELECT match_id, frame // 60 AS hour, track_id, row_number() OVER (PARTITION BY match_id, frame // 60 ORDER BY x DESC, event_id) AS rn FROM d) SELECT track_id, count(*) AS votes FROM r WHERE rn = 2 GROUP BY track_id""")
def offside_vote(spark: SparkSession, sf: str) -> DataFrame:
    """The second deepest of each moment gets a vote."""
    d = detections(spark, sf).withColumn("hour", F.floor(F.col("frame") / 60))
    r = A.top_k(d, ["match_id", "hour"], [F.col("x").desc(), F.col("event_id")], 2).where("rank = 2")
    return r.groupBy("track_id").agg(F.count("*").alias("votes"))


@query(f"""WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame // 60, team, k ORDER BY x DESC, event_id) AS rn FROM d) SELECT event_id, CASE WHEN rn = 1 THEN k END AS number FROM r""")
def dedupe_best(spark: SparkSession, sf: str) -> DataFrame:
    """Of equal numbers of a side in a moment the most confident keeps it."""
    d = detections(spark, sf)
    w = Window.partitionBy("match_id", F.floor(F.col("frame") / 60), "team", "k").orderBy(F.col("x").desc(), "event_id")
    return d.withColumn("rn", F.row_number().over(w)).select("event_id", F.when(F.col("rn") == 1, F.col("k")).alias("number"))


@query(f"""WITH {ROWS}, n AS (SELECT *, lag(k % 4) OVER w AS a, k % 4 AS o, lead(k % 4) OVER w AS b FROM d WINDOW w AS (PARTITION BY match_id ORDER BY event_id))
SELECT event_id, CASE WHEN o = a OR o = b THEN o WHEN a = b THEN a WHEN a IS NULL AND b IS NULL THEN o WHEN a IS NULL THEN least(o, b) WHEN b IS NULL THEN least(o, a) ELSE least(a, o, b) END AS smooth FROM n""")
def mode_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Mode of three rows; ties to the smallest."""
    d = detections(spark, sf).withColumn("o", F.col("k") % 4)
    return T.mode_filter(d, ["match_id"], ["event_id"], "o", "smooth").select("event_id", "smooth")


@query(f"""WITH {ROWS}, v AS (SELECT *, CASE WHEN k % 5 = 0 THEN x END AS s FROM d)
SELECT event_id, last_value(s IGNORE NULLS) OVER w AS forward, coalesce(last_value(s IGNORE NULLS) OVER w, first_value(s IGNORE NULLS) OVER (PARTITION BY match_id, track_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM v WINDOW w AS (PARTITION BY match_id, track_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ffill_bfill(spark: SparkSession, sf: str) -> DataFrame:
    """Forward and backward fill."""
    d = detections(spark, sf).withColumn("s", F.when(F.col("k") % 5 == 0, F.col("x")))
    d = T.fill_forward(d, MT, ["event_id"], "s", "forward")
    return T.fill_both(d, MT, ["event_id"], "s", "filled").select("event_id", "forward", "filled")


_HYST = f"""{ROWS}, s AS (SELECT match_id, frame / 10.0 AS t, avg((x + 52.5) / 105) AS share FROM d GROUP BY match_id, frame),
o AS (SELECT *, coalesce(last_value(CASE WHEN share >= 0.6 THEN 1 WHEN share < 0.3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM s),
c AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY t) AS i FROM (SELECT *, CASE WHEN lag(st) OVER (PARTITION BY match_id ORDER BY t) IS DISTINCT FROM st THEN 1 ELSE 0 END AS n FROM o)),
r AS (SELECT match_id, greatest(min(t) - 0.4, 0) AS a, max(t) + 0.4 AS z FROM c WHERE st = 1 GROUP BY match_id, i),
q AS (SELECT *, CASE WHEN a > max(z) OVER (PARTITION BY match_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 THEN 1 ELSE 0 END AS n FROM r),
seg AS (SELECT match_id, min(a) AS start_s, max(z) AS end_s FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY a, z) AS i FROM q) GROUP BY match_id, i)"""


def _playable(spark: SparkSession, sf: str) -> DataFrame:
    s = detections(spark, sf).groupBy("match_id", "frame").agg(F.avg((F.col("x") + 52.5) / 105).alias("share")).withColumn("t", F.col("frame") / 10.0)
    return T.playable_segments(s, ["match_id"], "t", "share", 0.6, 0.3)


@query(f"WITH {_HYST} SELECT * FROM seg WHERE end_s - start_s >= 1")
def hysteresis_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Playable stretches with hysteresis, padded and merged."""
    return _playable(spark, sf)


@query(f"""WITH {_HYST}, g AS (SELECT *, greatest(CAST(ceil((end_s - start_s) / 3.0) AS INTEGER), 1) AS n FROM seg WHERE end_s - start_s >= 1)
SELECT match_id, start_s, CAST(k AS INTEGER) AS piece, start_s + (end_s - start_s) / n * k AS piece_start, start_s + (end_s - start_s) / n * (k + 1) AS piece_end FROM (SELECT *, unnest(range(0, n)) AS k FROM g)""")
def plan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches in equal pieces of at most a length."""
    return T.split_intervals(_playable(spark, sf), "start_s", "end_s", 3.0).select("match_id", "start_s", "piece", "piece_start", "piece_end")


@query(f"""WITH {BALL}, h AS (SELECT *, CASE WHEN lag(team) OVER (PARTITION BY match_id ORDER BY frame) IS DISTINCT FROM team THEN 1 ELSE 0 END AS n FROM b),
r AS (SELECT match_id, team, i, max(frame) - min(frame) + 1 AS len FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM h) GROUP BY match_id, team, i)
SELECT match_id, team, count(*) AS spells, median(len) AS median_frames, max(len) AS longest FROM r GROUP BY match_id, team""")
def possession_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Spells of a side, their median and longest."""
    r = T.change_islands(ball(spark, sf), ["match_id"], ["frame"], "team").groupBy("match_id", "team", "island").agg((F.max("frame") - F.min("frame") + 1).alias("len"))
    return r.groupBy("match_id", "team").agg(F.count("*").alias("spells"), F.median("len").alias("median_frames"), F.max("len").alias("longest"))


@query(f"""WITH {ROWS}, l AS (SELECT match_id, event_id AS frame, side, CASE WHEN k % 7 = 0 THEN NULL WHEN side = 'left' THEN k % 5 ELSE k % 3 END AS score FROM d, (VALUES ('left'), ('right')) v(side)),
c AS (SELECT *, last_value(score IGNORE NULLS) OVER (PARTITION BY match_id, side ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT * FROM c WHERE score > before""")
def score_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A side's score above its last known one."""
    k = F.col("k")
    d = detections(spark, sf).select("match_id", F.col("event_id").alias("frame"), F.when(k % 7 != 0, k % 5).alias("left"), F.when(k % 7 != 0, k % 3).alias("right"))
    return T.score_changes(d, ["match_id"])


@query(f"""WITH {BALL}, o AS (SELECT DISTINCT match_id, frame FROM b), n AS (SELECT *, lead(frame) OVER (PARTITION BY match_id ORDER BY frame) AS nf FROM o) SELECT match_id, frame AS from_frame, nf AS to_frame, nf - frame - 1 AS missing FROM n WHERE nf - frame > 15""")
def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches without observations."""
    o = ball(spark, sf).select("match_id", "frame").distinct()
    n = o.withColumn("to_frame", F.lead("frame").over(Window.partitionBy("match_id").orderBy("frame")))
    return n.where("to_frame - frame > 15").select("match_id", F.col("frame").alias("from_frame"), "to_frame", (F.col("to_frame") - F.col("frame") - 1).alias("missing"))


@query(f"""WITH {ROWS} SELECT event_id, printf('%02d:%02d.%03d', frame // 60, frame % 60, (k * 7) % 1000) AS clock, CASE WHEN x * CASE WHEN team = 'left' THEN 1 ELSE -1 END >= 36 AND abs(y) <= 20.16 THEN true ELSE false END AS in_box, abs(x) <= 55.5 AND abs(y) <= 37 AS inside,
  sqrt((CASE WHEN team = 'left' THEN 52.5 ELSE -52.5 END - x) ** 2 + y ** 2) AS to_goal, CASE WHEN x / 10.0 + 5 <= 5 THEN 2.5 WHEN x / 10.0 + 5 >= 15 THEN 1.2 ELSE 2.5 - 1.3 * (x / 10.0 + 5 - 5) / 10 END AS radius FROM d""")
def geometry_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar geometry and clock columns."""
    d = detections(spark, sf)
    sign = X.direction(F.col("team"))
    seconds = F.col("frame") + ((F.col("k") * 7) % 1000) / 1000.0
    to_goal = X.distance(F.col("x"), F.col("y"), sign * 52.5, F.lit(0.0))
    return d.select("event_id", X.timecode(seconds).alias("clock"), X.in_box(F.col("x"), F.col("y"), sign).alias("in_box"), X.inside_pitch(F.col("x"), F.col("y")).alias("inside"), to_goal.alias("to_goal"), X.control_radius(F.col("x") / 10 + 5).alias("radius"))


_BOXES = f"""{ROWS}, bx AS (SELECT event_id AS id, match_id, frame // 10 AS frame, x + 60 AS bx, y + 40 AS b_y, 10.0 + k % 30 AS bw, 20.0 + k % 20 AS bh, team FROM d),
pr AS (SELECT a.match_id, a.frame, a.id AS a, b.id AS b, a.team AS ta, b.team AS tb, greatest(least(a.bx + a.bw, b.bx + b.bw) - greatest(a.bx, b.bx), 0) * greatest(least(a.b_y + a.bh, b.b_y + b.bh) - greatest(a.b_y, b.b_y), 0) AS i, a.bw * a.bh + b.bw * b.bh AS s, abs(a.b_y + a.bh / 2 - b.b_y - b.bh / 2) AS dy FROM bx a JOIN bx b ON a.match_id = b.match_id AND a.frame = b.frame AND a.id < b.id),
io AS (SELECT *, i / (s - i) AS iou FROM pr)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    d, k = detections(spark, sf), F.col("k")
    return d.select(F.col("event_id").alias("id"), "match_id", F.floor(F.col("frame") / 10).alias("frame"), (F.col("x") + 60).alias("bx"), (F.col("y") + 40).alias("by"), (k % 30 + 10.0).alias("bw"), (k % 20 + 20.0).alias("bh"), "team", k.cast("double").alias("score"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = J.frame_pairs(boxes(spark, sf), ["match_id", "frame"], "id", ["bx", "by", "bw", "bh", "team"])
    return p.withColumn("iou", X.iou(*[F.col(f"{s}_{c}") for s in "ab" for c in ("bx", "by", "bw", "bh")]))


@query(f"WITH {_BOXES} SELECT match_id, frame, a, b, iou FROM io WHERE iou > 0")
def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """IoU of all pairs of a frame."""
    return _pairs(spark, sf).where("iou > 0").select("match_id", "frame", "a", "b", "iou")


@query(f"WITH {_BOXES}, m AS (SELECT a AS id, iou FROM io UNION ALL SELECT b, iou FROM io) SELECT bx.id, least(coalesce(max(m.iou), 0), 1) AS occlusion FROM bx LEFT JOIN m ON bx.id = m.id GROUP BY bx.id")
def occlusion(spark: SparkSession, sf: str) -> DataFrame:
    """The largest IoU with any other box of the frame."""
    p = _pairs(spark, sf)
    m = p.select(F.col("a").alias("id"), "iou").unionByName(p.select(F.col("b").alias("id"), "iou")).groupBy("id").agg(F.max("iou").alias("m"))
    return boxes(spark, sf).select("id").join(m, "id", "left").select("id", F.least(F.coalesce("m", F.lit(0.0)), F.lit(1.0)).alias("occlusion"))


@query(f"WITH {_BOXES} SELECT id FROM bx WHERE id NOT IN (SELECT b FROM io WHERE iou > 0.15 AND dy < 3 AND ta = tb)")
def remove_double_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Of two like boxes of a frame the later goes."""
    p = _pairs(spark, sf)
    dy = F.abs(F.col("a_by") + F.col("a_bh") / 2 - F.col("b_by") - F.col("b_bh") / 2)
    gone = p.where((F.col("iou") > 0.15) & (dy < 3) & (F.col("a_team") == F.col("b_team"))).select(F.col("b").alias("id")).distinct()
    return boxes(spark, sf).join(gone, "id", "left_anti").select("id")


@query(f"""WITH {ROWS} SELECT track_id, count(*) AS samples, median(x) AS mx, median(y) AS my, min(match_id * 1440 + frame) AS first_frame, max(match_id * 1440 + frame) AS last_frame, arg_min(x, event_id) AS first_x, arg_max(x, event_id) AS last_x, quantile_cont(y, 0.9) - quantile_cont(y, 0.1) AS width_used, quantile_cont(x, 0.97) AS p97 FROM d GROUP BY track_id""")
def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A track's summary with interpolated percentiles."""
    at = F.col("match_id") * 1440 + F.col("frame")
    return detections(spark, sf).groupBy("track_id").agg(F.count("*").alias("samples"), F.median("x").alias("mx"), F.median("y").alias("my"), F.min(at).alias("first_frame"), F.max(at).alias("last_frame"), F.min_by("x", "event_id").alias("first_x"), F.max_by("x", "event_id").alias("last_x"), (F.percentile("y", 0.9) - F.percentile("y", 0.1)).alias("width_used"), F.percentile("x", 0.97).alias("p97"))


@query(f"""WITH {ROWS}, c AS (SELECT track_id, count(*) OVER (PARTITION BY track_id) AS n, event_id FROM d) SELECT event_id, track_id FROM c WHERE n >= 60""")
def short_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """tracks with too few rows go."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    return detections(spark, sf).withColumn("n", n).where("n >= 60").select("event_id", "track_id")


@query(f"""WITH {ROWS}, m AS (SELECT match_id, track_id, CASE WHEN avg(x) > 0 THEN 1 ELSE 0 END AS side, count(*) AS w FROM d GROUP BY match_id, track_id), t AS (SELECT match_id, side, sum(w) AS w FROM m GROUP BY match_id, side) SELECT match_id, arg_max(side, w * 2 + side) AS side FROM t GROUP BY match_id""")
def weighted_side_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Sides by votes weighted with detections."""
    m = detections(spark, sf).groupBy("match_id", "track_id").agg((F.avg("x") > 0).cast("int").alias("side"), F.count("*").alias("w"))
    t = m.groupBy("match_id", "side").agg(F.sum("w").alias("w"))
    return t.groupBy("match_id").agg(F.max_by("side", F.struct("w", "side")).alias("side"))


@query(f"""WITH {BALL}, s AS (SELECT match_id, frame, x, y, frame - lag(frame) OVER w AS gap, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) / nullif(frame - lag(frame) OVER w, 0) AS v FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
f AS (SELECT *, coalesce(v < 4, false) AS slow FROM s), c AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM (SELECT *, CASE WHEN lag(slow) OVER w IS DISTINCT FROM slow OR gap > 12 THEN 1 ELSE 0 END AS n FROM f WINDOW w AS (PARTITION BY match_id ORDER BY frame))),
r AS (SELECT match_id, min(frame) AS start_frame, max(frame) AS end_frame, arg_min(x, frame) AS x, arg_min(y, frame) AS y FROM c WHERE slow GROUP BY match_id, i)
SELECT r.match_id, start_frame, end_frame, min(sqrt((r.x - d.x) ** 2 + (r.y - d.y) ** 2)) AS nearest FROM r JOIN d ON r.match_id = d.match_id AND d.kind = 'signup' AND d.frame BETWEEN start_frame AND end_frame WHERE end_frame - start_frame >= 2 GROUP BY r.match_id, start_frame, end_frame HAVING min(sqrt((r.x - d.x) ** 2 + (r.y - d.y) ** 2)) <= 40""")
def stoppages(spark: SparkSession, sf: str) -> DataFrame:
    """Stretches of a slow ball with someone near."""
    w = Window.partitionBy("match_id").orderBy("frame")
    b = ball(spark, sf)
    gap = F.col("frame") - F.lag("frame").over(w)
    b = b.withColumn("gap", gap).withColumn("v", X.distance(F.lag("x").over(w), F.lag("y").over(w), F.col("x"), F.col("y")) / F.col("gap")).withColumn("slow", F.coalesce(F.col("v") < 4, F.lit(False)))
    runs = T.islands(b, ["match_id"], ["frame"], ~F.col("slow").eqNullSafe(F.lag("slow").over(w)) | (F.col("gap") > 12)).where("slow")
    runs = runs.groupBy("match_id", F.col("island").alias("stop")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by("x", "frame").alias("x"), F.min_by("y", "frame").alias("y")).where("end_frame - start_frame >= 2")
    refs = detections(spark, sf).where("kind = 'signup'").select("match_id", "frame", F.col("x").alias("ox"), F.col("y").alias("oy"))
    return J.near_stops(runs, refs, ["match_id"], 40).select("match_id", "start_frame", "end_frame", "nearest")
