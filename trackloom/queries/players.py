"""Queries of tracks and players: links, registries, votes of two readers, audits, lookups and clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import filters as K
from trackloom.operators import identity as I
from trackloom.operators import joins as J
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query

_ENDS = f"""{ROWS}, t AS (SELECT match_id, team, track_id, min(frame) AS s, max(frame) AS e, arg_min(x, o) AS x0, arg_min(y, o) AS y0, arg_max(x, o) AS x1, arg_max(y, o) AS y1 FROM (SELECT *, frame * 1000000000 + event_id AS o FROM d) GROUP BY ALL)"""


def _ends(spark: SparkSession, sf: str) -> DataFrame:
    return I.track_ends(detections(spark, sf), ["match_id", "team"])


@query(f"""WITH {_ENDS} SELECT a.match_id, a.team, a.track_id AS a, b.track_id AS b, round(sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2), 6) AS cost FROM t a JOIN t b ON a.match_id = b.match_id AND a.team = b.team WHERE b.s > a.e AND b.s - a.e <= 400 AND sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2) <= 15""")
def link_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of tracks that one player may have made."""
    return I.link_pairs(_ends(spark, sf), ["match_id", "team"], near=15.0)


@query(None)
def linked_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates assigned one to one, and each track's first in its chain."""
    return I.linked_tracks(_ends(spark, sf), ["match_id", "team"], near=15.0)


@query(f"""WITH {ROWS}, t AS (SELECT match_id, team, track_id, CASE WHEN track_id % 4 <> 0 THEN track_id % 12 END AS number, CASE WHEN track_id % 10 = 1 THEN 'goalkeeper' ELSE 'player' END AS role, CASE WHEN track_id % 3 = 0 THEN 'n' || track_id END AS name, max(k) / 100.0 AS confidence FROM d GROUP BY ALL),
r AS (SELECT *, team || '_' || coalesce(CAST(number AS VARCHAR), 'unknown_t' || track_id) AS player FROM t)
SELECT match_id, player, string_agg(CAST(track_id AS VARCHAR), ',' ORDER BY track_id) AS tracks, min(role) AS role, arg_min(name, track_id) FILTER (name IS NOT NULL) AS name, CAST(max(CASE WHEN number IS NULL THEN least(confidence, 0.2) ELSE confidence END) AS DOUBLE) AS confidence FROM r GROUP BY ALL""")
def player_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks collapsed into players."""
    t, ident = detections(spark, sf).groupBy("match_id", "team", "track_id").agg((F.max("k") / 100.0).alias("confidence")), F.col("track_id")
    t = t.withColumns({"number": F.when(ident % 4 != 0, ident % 12), "role": F.when(ident % 10 == 1, "goalkeeper").otherwise("player"), "name": F.when(ident % 3 == 0, F.concat(F.lit("n"), ident.cast("string")))})
    return I.player_registry(t, ["match_id"]).withColumn("tracks", F.array_join(F.col("tracks").cast("array<string>"), ","))


@query(f"""WITH {ROWS}, m AS (SELECT match_id, max(frame) + 1 AS frames FROM d GROUP BY match_id) SELECT match_id, track_id, count(DISTINCT frame) AS visible, round(count(DISTINCT frame) / frames, 9) AS share FROM d JOIN m USING (match_id) GROUP BY match_id, track_id, frames""")
def track_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Frames in which a track is seen, and their share."""
    g = detections(spark, sf).groupBy("match_id", "track_id").agg(F.countDistinct("frame").alias("visible"), F.max("frame").alias("last"))
    frames = F.max("last").over(Window.partitionBy("match_id")) + 1
    return g.select("match_id", "track_id", "visible", F.round(F.col("visible") / frames, 9).alias("share"))


@query(f"""WITH {ROWS}, v AS (SELECT track_id, k % 7 AS number, pow((20.0 + k % 80) / 100, 2) * ((k % 10) / 10.0) AS w, 1 AS raw FROM d WHERE kind <> 'purchase'), q AS (SELECT track_id, k % 5 AS number, count(*) AS votes FROM d WHERE kind = 'purchase' GROUP BY ALL), n AS (SELECT *, sum(votes) OVER (PARTITION BY track_id) AS questions FROM q),
u AS (SELECT * FROM v UNION ALL SELECT track_id, number, 5.0 * votes / questions, votes FROM n WHERE votes / questions >= 0.34), p AS (SELECT track_id, number, sum(w) AS w, sum(raw) AS raw FROM u GROUP BY ALL),
r AS (SELECT *, sum(w) OVER (PARTITION BY track_id) AS total, row_number() OVER (PARTITION BY track_id ORDER BY round(w, 9) DESC, number) AS rk FROM p) SELECT track_id, CAST(CASE WHEN raw >= 2 AND w >= 0.34 * total THEN number END AS INTEGER) AS number FROM r WHERE rk = 1""")
def pooled_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Two readers' votes for a track's number, pooled by weight."""
    d, k = detections(spark, sf), F.col("k")
    crops = d.where("kind <> 'purchase'").select("track_id", (k % 7).alias("number"), (k % 80 + 20.0).alias("height"), (k % 10 / 10.0).alias("share"))
    reads = d.where("kind = 'purchase'").groupBy("track_id", (k % 5).alias("number")).agg(F.count("*").alias("votes"))
    reads = reads.withColumn("questions", F.sum("votes").over(Window.partitionBy("track_id")))
    return I.pooled_votes(crops, reads, ["track_id"])


@query(f"""WITH {ROWS}, l AS (SELECT kind, count(*) AS n, list_sort(list(k)) AS v FROM d GROUP BY kind), q AS (SELECT *, unnest([0.1, 0.5, 0.9]) AS q FROM l), j AS (SELECT *, least(greatest(CAST(floor(q * (n + 1)) AS BIGINT), 1), greatest(n - 1, 1)) AS j FROM q),
r AS (SELECT kind, n, q, v[j] + (v[least(j + 1, n)] - v[j]) * CASE WHEN n > 1 THEN q * (n + 1) - j ELSE 0 END AS x FROM j) SELECT kind, n, round(max(x) FILTER (q = 0.1), 6) AS p10, round(max(x) FILTER (q = 0.5), 6) AS median, round(max(x) FILTER (q = 0.9), 6) AS p90 FROM r GROUP BY kind, n""")
def dataset_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and exclusive quantiles by class."""
    q = I.exclusive_quantiles(detections(spark, sf), ["kind"], "k", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return q.select("kind", "n", *[F.round(c, 6).alias(c) for c in ("p10", "median", "p90")])


@query(f"""WITH {ROWS}, a AS (SELECT track_id, k % 8 AS answer, row_number() OVER (PARTITION BY track_id ORDER BY event_id) - 1 AS pos FROM d), v AS (SELECT track_id, pos // 4 AS part, answer, count(*) AS votes, min(pos) AS f FROM a WHERE answer IN (SELECT r_regionkey FROM region) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY votes DESC, f) AS rk FROM v) SELECT track_id, part, CAST(answer AS INTEGER) AS answer, votes FROM r WHERE rk = 1 AND votes >= 2""")
def grouped_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in groups of four, filtered before voting."""
    a = detections(spark, sf).select("track_id", "event_id", (F.col("k") % 8).alias("answer"))
    return I.grouped_answers(a, table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("answer")), ["track_id"], "event_id")


@query(f"""WITH {ROWS}, w AS (SELECT track_id % 11 AS grp, team, sum(k + 1) AS w FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY w DESC, team) AS rk FROM w) SELECT DISTINCT d.track_id, grp, r.team FROM d JOIN r ON grp = d.track_id % 11 AND rk = 1""")
def group_teams(spark: SparkSession, sf: str) -> DataFrame:
    """One side per linked group by weight, joined back to its tracks."""
    d = detections(spark, sf).withColumn("grp", F.col("track_id") % 11)
    per = d.groupBy("grp", "track_id", "team").agg(F.sum(F.col("k") + 1).alias("w"))
    w = per.groupBy("grp", "team").agg(F.sum("w").alias("w"))
    rk = F.row_number().over(Window.partitionBy("grp").orderBy(F.col("w").desc(), "team"))
    best = w.withColumn("rk", rk).where("rk = 1").select("grp", "team")
    return per.select("grp", "track_id").distinct().join(best, "grp").select("track_id", "grp", "team")


@query(f"""WITH {ROWS}, s AS (SELECT n_nationkey AS number, CASE WHEN n_regionkey IN (0, 1) THEN 'left' END AS l, CASE WHEN n_regionkey IN (1, 2) THEN 'right' END AS r FROM nation), u AS (SELECT number, coalesce(l, r) AS side FROM s WHERE (l IS NULL) <> (r IS NULL)),
v AS (SELECT track_id, side, count(*) AS score FROM d JOIN u ON number = k % 25 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, side) AS rk FROM v), t AS (SELECT DISTINCT track_id, team FROM d)
SELECT track_id, CASE WHEN score >= 2 THEN side ELSE team END AS team FROM t LEFT JOIN (SELECT * FROM b WHERE rk = 1) USING (track_id)""")
def squad_correction(spark: SparkSession, sf: str) -> DataFrame:
    """A side corrected by numbers that only one squad has, if they score at least two."""
    d, region = detections(spark, sf), F.col("n_regionkey")
    sides = F.array_compact(F.array(F.when(region.isin(0, 1), "left"), F.when(region.isin(1, 2), "right")))
    squads = table(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), F.explode(sides).alias("team"))
    votes = d.groupBy("track_id", (F.col("k") % 25).alias("number")).agg(F.count("*").alias("n"))
    return I.sides_by_squads(d.select("track_id", "team").distinct(), votes, squads, ["track_id"])


@query(f"""WITH {ROWS}, b AS (SELECT track_id, event_id, kind, avg((10.0 + k % 30) * (20.0 + k % 20)) OVER (PARTITION BY track_id) AS area, k FROM d WHERE 10 + k % 30 >= 12 AND x >= -51.5) SELECT event_id, CASE WHEN area < 740 THEN 'ball' ELSE kind END AS role FROM b WHERE k % 2 = 0""")
def ball_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Sane boxes; tracks of small mean area become the ball; every second row."""
    d = detections(spark, sf).select("event_id", "track_id", "k", F.col("kind").alias("role"), (F.col("x") + 52.5).alias("x"), F.lit(1.0).alias("y"), (F.col("k") % 30 + 10.0).alias("w"), (F.col("k") % 20 + 20.0).alias("h"))
    return K.strided(K.small_tracks_as(K.sane_boxes(d, least_side=12.0), ["track_id"], 740.0), 2, "k").select("event_id", "role")


@query(f"""WITH {ROWS}, e AS (SELECT track_id, frame, arg_min(k, event_id) AS v FROM d WHERE kind = 'click' GROUP BY ALL), f AS (SELECT track_id, arg_min(k, event_id) AS v FROM d WHERE kind = 'click' GROUP BY ALL) SELECT d.event_id, coalesce(e.v, f.v) AS v FROM d LEFT JOIN e USING (track_id, frame) LEFT JOIN f ON f.track_id = d.track_id""")
def fallback_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The value at (track, frame), else the track's first."""
    d = detections(spark, sf)
    exact = d.where("kind = 'click'").select("track_id", "frame", "event_id", F.col("k").alias("v"))
    return J.lookup_with_fallback(d.select("track_id", "frame", F.col("event_id").alias("id")), exact, ["track_id", "frame"], ["track_id"], "event_id", "v").select(F.col("id").alias("event_id"), "v")


@query(f"""WITH {ROWS}, p AS (SELECT match_id, track_id, frame, arg_min(x, event_id) AS x, arg_min(y, event_id) AS y FROM d GROUP BY ALL), e AS (SELECT event_id, match_id, track_id, frame, track_id AS dest, frame + CAST(round(k % 7 * 0.9) AS BIGINT) AS arrive FROM d WHERE kind = 'click')
SELECT event_id, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y FROM e LEFT JOIN p a ON a.match_id = e.match_id AND a.track_id = e.track_id AND a.frame = e.frame LEFT JOIN p b ON b.match_id = e.match_id AND b.track_id = e.dest AND b.frame = e.arrive""")
def location_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Where the actor stood, and the recipient on arrival."""
    d = detections(spark, sf)
    p = d.groupBy("match_id", "track_id", "frame").agg(F.min_by(F.struct("x", "y"), "event_id").alias("p")).select("match_id", "track_id", "frame", "p.*")
    e = d.where("kind = 'click'").select("event_id", "match_id", F.col("track_id").alias("actor"), "frame", F.col("track_id").alias("target"), (F.col("frame") + F.round(F.col("k") % 7 * 0.9).cast("long")).alias("arrive"))
    return J.located(e, p, ["match_id"], "actor", "frame", "target", "arrive").select("event_id", "from_x", "from_y", "to_x", "to_y")


@query(f"""WITH {ROWS}, s AS (SELECT track_id, string_agg(frame || ':' || kind, ' ' ORDER BY match_id, frame, event_id) AS timeline, count(*) AS n FROM d WHERE kind NOT IN ('signup') GROUP BY track_id), a AS (SELECT DISTINCT track_id FROM d) SELECT track_id, coalesce(n, 0) AS n, coalesce(timeline, '') AS timeline FROM a LEFT JOIN s USING (track_id)""")
def player_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Each player's own events in order; players without any have an empty line."""
    d = detections(spark, sf)
    own = F.when(F.col("kind") != "signup", F.struct("match_id", "frame", "event_id", F.concat_ws(":", F.col("frame").cast("string"), "kind").alias("s")))
    g = d.groupBy("track_id").agg(F.array_sort(F.collect_list(own)).alias("e"))
    return g.select("track_id", F.size("e").cast("long").alias("n"), F.array_join(F.transform("e", lambda x: x["s"]), " ").alias("timeline"))


@query(f"""WITH {ROWS}, w AS (SELECT *, list(k) OVER r AS l, avg(k) OVER (PARTITION BY track_id ORDER BY event_id) AS so_far FROM d WINDOW r AS (PARTITION BY track_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT event_id, CAST(list_aggregate(l, 'median') AS DOUBLE) AS median, round(list_avg(l), 9) AS mean, round(so_far, 9) AS so_far FROM w""")
def smoothed_meters(spark: SparkSession, sf: str) -> DataFrame:
    """Median and mean of the last five readings, and the mean so far."""
    w = Window.partitionBy("track_id").orderBy("event_id")
    five = w.rowsBetween(-4, 0)
    return detections(spark, sf).select("event_id", X.median_of(F.collect_list("k").over(five)).cast("double").alias("median"), F.round(F.avg("k").over(five), 9).alias("mean"), F.round(F.avg("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("so_far"))


@query(f"""WITH {ROWS}, v AS (SELECT track_id, kind, count(*) AS n FROM d GROUP BY ALL) SELECT track_id, round(max(n) / sum(n), 9) AS consensus FROM v GROUP BY track_id""")
def consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the answers that the commonest has."""
    v = detections(spark, sf).groupBy("track_id", "kind").agg(F.count("*").alias("n"))
    return v.groupBy("track_id").agg(F.round(F.max("n") / F.sum("n"), 9).alias("consensus"))
