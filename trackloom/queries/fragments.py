"""Queries of track fragments, numbers and roles, and of column functions that no other query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import joins as J
from trackloom.operators import linking as K
from trackloom.operators.identity import track_ends
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query
from trackloom.queries.tracking import boxes

M = ["match_id"]


def looked(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with a vector and a box, and what their track says of role and side."""
    d = detections(spark, sf)
    role = F.when(F.col("track_id") % 10 == 1, "goalkeeper").otherwise("player")
    return d.select("match_id", "track_id", "frame", "team", role.alias("role"), F.array(F.col("x") + 60, F.col("y") + 40, (F.col("k") % 50).cast("double")).alias("vector"), (F.col("x") + 60).alias("bx"), (F.col("y") + 40).alias("by"), (F.col("k") % 30 + 10.0).alias("bw"), (F.col("k") % 20 + 20.0).alias("bh"))


def looks(spark: SparkSession, sf: str) -> DataFrame:
    rows = looked(spark, sf)
    return K.mean_looks(rows, M).join(rows.groupBy("match_id", "track_id").agg(F.first("team").alias("team"), F.first("role").alias("role"), F.min("frame").alias("start"), F.max("frame").alias("end")), ["match_id", "track_id"])


_LOOKS = f"""{ROWS}, lk AS (SELECT match_id, track_id, frame, team, CASE WHEN track_id % 10 = 1 THEN 'goalkeeper' ELSE 'player' END AS role, x + 60 AS a, y + 40 AS b, CAST(k % 50 AS DOUBLE) AS c, k, x, y FROM d), un AS (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM lk),
tr AS (SELECT match_id, track_id, min(team) AS team, min(role) AS role, avg(a / n) AS a, avg(b / n) AS b, avg(c / n) AS c FROM un GROUP BY match_id, track_id)"""


@query(f"""WITH {_LOOKS}, sh AS (SELECT DISTINCT p.match_id, p.track_id AS a, q.track_id AS b FROM lk p JOIN lk q ON p.match_id = q.match_id AND p.frame = q.frame AND p.track_id < q.track_id), pr AS (SELECT p.match_id, p.track_id AS a, q.track_id AS b, 1 - (p.a * q.a + p.b * q.b + p.c * q.c) AS distance FROM tr p JOIN tr q ON p.match_id = q.match_id AND p.role = q.role AND p.team = q.team AND p.track_id < q.track_id)
SELECT match_id, a, b, round(distance, 9) AS distance FROM pr ANTI JOIN sh USING (match_id, a, b) WHERE distance < 0.2""")
def close_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Mean cosine distances of fragments that may be one player."""
    out = K.close_looks(looks(spark, sf), looked(spark, sf), M, 0.2)
    return out.withColumn("distance", F.round("distance", 9))


@query(None)
def merged_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments merged by looks while they are close and do not jump."""
    rows = looked(spark, sf)
    first = rows.groupBy("match_id", "track_id", "frame").agg(F.min(F.struct("bx", "by", "bw", "bh")).alias("b")).select("match_id", "track_id", "frame", "b.*")
    return K.merged_tracks(looks(spark, sf), K.segments_of(first, M), K.shared_frames(rows, M), M, below=0.2)


@query(f"""WITH {ROWS}, bx AS (SELECT match_id, track_id, frame // 60 AS frame, min(x) + 60 AS bx, min(y) + 40 AS b_y, 10.0 + min(k) % 30 AS bw, 20.0 + min(k) % 20 AS bh FROM d GROUP BY match_id, track_id, frame // 60),
pr AS (SELECT p.match_id, p.track_id AS a, q.track_id AS b, greatest(least(p.bx + p.bw, q.bx + q.bw) - greatest(p.bx, q.bx), 0) * greatest(least(p.b_y + p.bh, q.b_y + q.bh) - greatest(p.b_y, q.b_y), 0) AS i, p.bw * p.bh + q.bw * q.bh AS s FROM bx p JOIN bx q ON p.match_id = q.match_id AND p.frame = q.frame AND p.track_id < q.track_id),
l AS (SELECT match_id, a, b, list(i / (s - i) ORDER BY i / (s - i)) AS u FROM pr GROUP BY match_id, a, b) SELECT match_id, a, b, u[len(u) // 2 + 1] AS overlap FROM l""")
def median_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """The upper median of the IoU of two tracks."""
    d = detections(spark, sf).withColumn("frame", F.floor(F.col("frame") / 60)).groupBy("match_id", "track_id", "frame").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.min("k").alias("k"))
    return K.median_overlap(d.select("match_id", "track_id", "frame", (F.col("x") + 60).alias("bx"), (F.col("y") + 40).alias("by"), (F.col("k") % 30 + 10.0).alias("bw"), (F.col("k") % 20 + 20.0).alias("bh")), M)


@query(None)
def linked_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments linked by looks, unless they are seen together in different places."""
    rows = looked(spark, sf)
    return K.linked_by_looks(looks(spark, sf), rows.groupBy("match_id", "track_id", "frame").agg(F.min(F.struct("bx", "by", "bw", "bh")).alias("b")).select("match_id", "track_id", "frame", "b.*"), M, 0.97)


@query(None)
def team_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Two clusters by the feature set that parts them best."""
    d = detections(spark, sf).groupBy("match_id", "track_id").agg(F.array(F.avg("x"), F.avg("y")).alias("reid"), F.array(F.avg("k"), F.count("*").cast("double")).alias("colour"))
    return K.cluster_teams(d, M, ["reid", "colour"])


# ------------------------------------------------------------------ roles and numbers
_TR = f"""{ROWS}, ks AS (SELECT match_id, track_id, median(x) AS median_x, CASE WHEN track_id % 10 = 1 THEN 'goalkeeper' WHEN track_id % 14 = 2 THEN 'referee' ELSE 'player' END AS role0, min(team) AS team FROM d GROUP BY match_id, track_id), kt AS (SELECT *, CASE WHEN role0 = 'goalkeeper' AND abs(median_x) < 25 THEN 'player' ELSE role0 END AS role FROM ks)"""


def keeper_tracks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("track_id")
    g = detections(spark, sf).groupBy("match_id", "track_id").agg(F.median("x").alias("median_x"), F.min("team").alias("team"))
    return K.demoted_keepers(g.withColumn("role", F.when(t % 10 == 1, "goalkeeper").when(t % 14 == 2, "referee").otherwise("player")))


@query(f"WITH {_TR} SELECT match_id, track_id, role FROM kt")
def demoted_keepers(spark: SparkSession, sf: str) -> DataFrame:
    """Goalkeepers that stand in midfield are players."""
    return keeper_tracks(spark, sf).select("match_id", "track_id", "role")


@query(f"""WITH {ROWS}, ks AS (SELECT match_id, track_id, median(x) AS mx, CASE WHEN track_id % 10 = 1 THEN 'goalkeeper' WHEN track_id % 14 = 2 THEN 'referee' ELSE 'player' END AS r0, CASE WHEN track_id % 11 <> 3 THEN track_id % 2 END AS cluster, count(*) AS n FROM d GROUP BY match_id, track_id), t AS (SELECT *, CASE WHEN r0 = 'goalkeeper' AND abs(mx) < 25 THEN 'player' ELSE r0 END AS role FROM ks),
v AS (SELECT match_id, count(*) FILTER (track_id % 2 = 0) AS v0, count(*) FILTER (track_id % 2 = 1) AS v1 FROM d WHERE match_id % 3 <> 0 AND k % 7 = 0 GROUP BY match_id), x AS (SELECT match_id, sum(mx * n) FILTER (cluster = 0) / sum(n) FILTER (cluster = 0) AS x0, sum(mx * n) FILTER (cluster = 1) / sum(n) FILTER (cluster = 1) AS x1 FROM t WHERE role = 'player' AND cluster IS NOT NULL GROUP BY match_id),
l AS (SELECT m.match_id, CASE WHEN coalesce(v0, 0) > coalesce(v1, 0) THEN 0 WHEN coalesce(v1, 0) > coalesce(v0, 0) THEN 1 WHEN x1 < x0 THEN 1 ELSE 0 END AS lft FROM (SELECT DISTINCT match_id FROM d) m LEFT JOIN v USING (match_id) LEFT JOIN x USING (match_id))
SELECT match_id, track_id, role, CASE WHEN role = 'goalkeeper' THEN CASE WHEN mx < 0 THEN 'left' ELSE 'right' END WHEN role <> 'player' THEN NULL WHEN cluster IS NOT NULL THEN CASE WHEN cluster = lft THEN 'left' ELSE 'right' END WHEN abs(mx) >= 25 THEN CASE WHEN mx < 0 THEN 'left' ELSE 'right' END END AS team FROM t JOIN l USING (match_id)""")
def sides_of_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Sides by the vote of the last defenders, else by where the kits stand; goalkeepers by their goal."""
    d, t = detections(spark, sf), F.col("track_id")
    tracks = d.groupBy("match_id", "track_id").agg(F.median("x").alias("median_x"), F.count("*").alias("n")).withColumn("role", F.when(t % 10 == 1, "goalkeeper").when(t % 14 == 2, "referee").otherwise("player")).withColumn("cluster", F.when(t % 11 != 3, t % 2))
    votes = d.where("match_id % 3 <> 0 and k % 7 = 0").groupBy("match_id", (t % 2).alias("cluster")).agg(F.count("*").alias("n"))
    return K.sides_of_tracks(tracks, votes, M)


@query(f"""WITH {_TR}, t AS (SELECT *, CASE WHEN track_id % 6 <> 0 THEN CAST(track_id % 40 AS VARCHAR) END AS number, track_id % 4 AS votes, CASE WHEN track_id % 9 = 0 THEN track_id - 9 END AS root FROM kt),
r AS (SELECT event_id, d.match_id, d.track_id, CASE WHEN k % 13 = 0 THEN 'ball' WHEN k % 5 = 0 THEN 'goalkeeper' ELSE 'player' END AS r0, CASE WHEN k % 6 <> 0 THEN d.team END AS t0, CASE WHEN k % 3 <> 0 THEN CAST(k % 40 AS VARCHAR) END AS n0, t.role, t.team, t.number, t.votes, t.root FROM d JOIN t USING (match_id, track_id)),
a AS (SELECT *, CASE WHEN r0 IN ('player', 'goalkeeper', 'referee') THEN role ELSE r0 END AS r1, role IN ('player', 'goalkeeper') AS ours FROM r), b AS (SELECT *, CASE WHEN ours THEN team ELSE t0 END AS t1, CASE WHEN ours AND r1 = 'player' AND number IS NOT NULL AND (n0 IS NOT NULL OR votes > 0) THEN number WHEN ours AND r1 = 'player' AND number IS NULL AND n0 IS NOT NULL THEN NULL ELSE n0 END AS n1 FROM a)
SELECT event_id, match_id, CASE WHEN ours THEN coalesce(root, track_id) ELSE track_id END AS track_id, r1 AS role, t1 AS team, n1 AS number, r0 IS DISTINCT FROM r1 AS changed_role, t0 IS DISTINCT FROM t1 AS changed_team, n0 IS DISTINCT FROM n1 AS changed_number FROM b""")
def numbers_written_back(spark: SparkSession, sf: str) -> DataFrame:
    """Rows under what their tracks say: fill, propagate or abstain."""
    d, k, t = detections(spark, sf), F.col("k"), F.col("track_id")
    tracks = keeper_tracks(spark, sf).withColumn("number", F.when(t % 6 != 0, (t % 40).cast("string"))).withColumn("votes", t % 4).withColumn("root", F.when(t % 9 == 0, t - 9))
    rows = d.select("event_id", "match_id", "track_id", F.when(k % 13 == 0, "ball").when(k % 5 == 0, "goalkeeper").otherwise("player").alias("role"), F.when(k % 6 != 0, F.col("team")).alias("team"), F.when(k % 3 != 0, (k % 40).cast("string")).alias("number"))
    return K.written_back(rows, tracks, M)


@query(f"""WITH {ROWS}, v AS (SELECT match_id, team, track_id, CASE WHEN k % 7 = 0 THEN 100 ELSE k % 12 END AS number, count(*) AS n FROM d GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, team, track_id ORDER BY n DESC, number) AS rk FROM v), t AS (SELECT *, row_number() OVER (PARTITION BY match_id, team, number ORDER BY n DESC, track_id DESC) AS h FROM r WHERE rk = 1)
SELECT t.match_id, t.team, t.track_id, CAST(CASE WHEN t.h = 1 OR t.number = 100 THEN t.number WHEN s.number <> 100 THEN s.number END AS INTEGER) AS number FROM t LEFT JOIN r s ON s.match_id = t.match_id AND s.team = t.team AND s.track_id = t.track_id AND s.rk = 2""")
def unique_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """One track of a team keeps a number, the others take their next one."""
    k = F.col("k")
    v = detections(spark, sf).groupBy("match_id", "team", "track_id", F.when(k % 7 == 0, 100).otherwise(k % 12).alias("number")).agg(F.count("*").alias("n"))
    return K.unique_numbers(v, M)


@query(f"""WITH {ROWS}, t AS (SELECT event_id, ['Player', 'coach', 'BALL', 'referee', 'goalkeeper'][event_id % 5 + 1] AS role, team, CASE WHEN k % 4 = 0 THEN '100' ELSE CAST(k % 50 AS VARCHAR) END AS number, kind AS colour FROM d), u AS (SELECT *, CASE WHEN lower(role) IN ('other', 'player', 'goalkeeper', 'referee', 'ball') THEN lower(role) ELSE 'other' END AS r FROM t)
SELECT event_id, r AS role, CASE WHEN r NOT IN ('ball', 'referee') THEN team END AS team, CASE WHEN r NOT IN ('ball', 'referee') AND number <> '100' THEN number END AS number, CASE WHEN r NOT IN ('ball', 'referee') THEN colour END AS colour FROM u""")
def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Track rows as they are reported."""
    names, k = F.array(*[F.lit(x) for x in ("Player", "coach", "BALL", "referee", "goalkeeper")]), F.col("k")
    t = detections(spark, sf).select("event_id", F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("role"), "team", F.when(k % 4 == 0, "100").otherwise((k % 50).cast("string")).alias("number"), F.col("kind").alias("colour"))
    return K.result_rows(t)


@query(f"""WITH {_LOOKS}, en AS (SELECT match_id, team, track_id, min(frame) AS s, max(frame) AS e, arg_min(x, o) AS x0, arg_min(y, o) AS y0, arg_max(x, o) AS x1, arg_max(y, o) AS y1 FROM (SELECT *, frame * 1000000000 + event_id AS o FROM d) GROUP BY ALL),
p AS (SELECT a.match_id, a.team, a.track_id AS a, b.track_id AS b, sqrt((b.x0 - a.x1) ** 2 + (b.y0 - a.y1) ** 2) AS dist FROM en a JOIN en b ON a.match_id = b.match_id AND a.team = b.team AND b.s > a.e AND b.s - a.e <= 400), c AS (SELECT p.*, (u.a * w.a + u.b * w.b + u.c * w.c) / sqrt((u.a ** 2 + u.b ** 2 + u.c ** 2) * (w.a ** 2 + w.b ** 2 + w.c ** 2)) AS co FROM p JOIN tr u ON u.match_id = p.match_id AND u.track_id = p.a JOIN tr w ON w.match_id = p.match_id AND w.track_id = p.b WHERE dist <= 15)
SELECT match_id, team, a, b, round(1 - co + 0.001 * dist, 9) AS cost FROM c WHERE co >= 0.85""")
def reid_links(spark: SparkSession, sf: str) -> DataFrame:
    """J15 with looks: 15 metres if the cosine is 0.85 or more."""
    ends = track_ends(detections(spark, sf), ["match_id", "team"])
    return K.reid_links(ends, looks(spark, sf).select("match_id", "track_id", "look"), ["match_id", "team"]).withColumn("cost", F.round("cost", 9))


# ------------------------------------------------------------------ columns
@query(f"""WITH {ROWS}, p AS (SELECT event_id, match_id, frame // 30 AS frame, x, y, k FROM d WHERE kind = 'click'), o AS (SELECT match_id, frame // 30 AS frame, x AS ox, y AS oy, event_id AS oid FROM d WHERE kind <> 'click'),
j AS (SELECT p.event_id, oid, sqrt((x - ox) ** 2 + (y - oy) ** 2) AS dist, CASE WHEN k % 20 <= 5 THEN 25.0 WHEN k % 20 >= 15 THEN 12.0 ELSE 25 - 13 * ((k % 20) - 5) / 10.0 END AS radius FROM p JOIN o USING (match_id, frame)), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dist, oid) AS rn FROM j WHERE dist <= radius) SELECT event_id, oid, round(dist, 9) AS dist FROM r WHERE rn = 1""")
def nearest_in_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest within a radius that depends on speed."""
    d, s = detections(spark, sf).withColumn("frame", F.floor(F.col("frame") / 30)), F.col("k") % 20
    radius = F.when(s <= 5, 25.0).when(s >= 15, 12.0).otherwise(25 - 13 * (s - 5) / 10.0)
    p = d.where("kind = 'click'").select("event_id", "match_id", "frame", "x", "y", radius.alias("radius"))
    o = d.where("kind <> 'click'").select("match_id", "frame", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("event_id").alias("oid"))
    return J.nearest_within(p, o, ["match_id", "frame"], F.col("radius"), "oid", inclusive=True, by=["event_id"]).select("event_id", "oid", F.round("dist", 9).alias("dist"))


@query(f"""WITH {_LOOKS}, p AS (SELECT a.match_id, a.track_id AS a, b.track_id AS b, sqrt((a.a - b.a) ** 2 + (a.b - b.b) ** 2) AS d1, abs(a.c - b.c) AS d2, (a.track_id % 3) / 2.0 AS s1, (a.track_id % 4) / 3.0 AS s2, (b.track_id % 3) / 2.0 AS t1, (b.track_id % 4) / 3.0 AS t2 FROM tr a JOIN tr b ON a.match_id = b.match_id AND b.track_id = a.track_id + 1), w AS (SELECT *, sqrt(s1 * t1) AS w1, sqrt(s2 * t2) AS w2 FROM p)
SELECT match_id, a, b, round(CASE WHEN w1 + w2 > 0 THEN (d1 * w1 + d2 * w2) / (w1 + w2) ELSE -1 END, 9) AS distance, round(exp(d1 * d1 * ln(0.05) / 0.25), 9) AS similarity FROM w""")
def part_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances over the parts that both sides show, and a Gaussian similarity."""
    t = looks(spark, sf)
    part = lambda c: F.array(F.slice(c, 1, 2), F.slice(c, 3, 1))
    seen = lambda i: F.array(F.col(i) % 3 / 2.0, F.col(i) % 4 / 3.0)
    a = t.select("match_id", F.col("track_id").alias("a"), F.col("look").alias("u"))
    b = t.select("match_id", (F.col("track_id") - 1).alias("a"), F.col("track_id").alias("b"), F.col("look").alias("v"))
    p = a.join(b, ["match_id", "a"])
    first = F.sqrt(X.squared_distance(F.slice("u", 1, 2), F.slice("v", 1, 2)))
    return p.select("match_id", "a", "b", F.round(X.part_distance(part("u"), part("v"), seen("a"), seen("b")), 9).alias("distance"), F.round(X.gaussian_similarity(first, 0.5), 9).alias("similarity"))


@query(f"""WITH {ROWS}, b AS (SELECT event_id, x + 60 AS bx, y + 40 AS b_y, k % 30 + 10.0 AS w, k % 20 + 20.0 AS h, k, x, y FROM d) SELECT event_id, bx + w / 2 AS cx, b_y + h / 2 AS cy, bx + w AS x1, b_y + h AS y1, w / h AS aspect, x BETWEEN -62.5 AND 62.5 AND y BETWEEN -39 AND 39 AS near_pitch,
0.25 * (1 - exp(-greatest(k * 3.0, 0) / 250)) + 0.20 * ((k % 10) / 10.0) + 0.20 * (1 - (k % 7) / 7.0) + 0.15 * ((k % 3) / 2.0) + 0.08 * ((k % 2) * 1.0) + 0.02 * 0.5 + 0.10 * ((k % 11) / 10.0) AS quality FROM b""")
def box_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Forms of a box, the wider margin of the pitch, and a view's quality."""
    b, k = boxes(spark, sf), F.col("score")
    b = b.withColumn("k", k.cast("int")).withColumn("c", X.centre_box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"))).withColumn("e", X.corner_box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh"))).withColumn("a", X.aspect_box(F.col("bx"), F.col("by"), F.col("bw"), F.col("bh")))
    n = F.col("k")
    q = X.view_quality(n * 3.0, n % 10 / 10.0, n % 7 / 7.0, n % 3 / 2.0, n % 2 * 1.0, F.lit(0.5), n % 11 / 10.0)
    return b.select(F.col("id").alias("event_id"), "c.cx", "c.cy", "e.x1", "e.y1", "a.aspect", X.inside_pitch(F.col("bx") - 60, F.col("by") - 40, 10.0, 5.0).alias("near_pitch"), q.alias("quality"))


@query(f"""WITH {ROWS}, c AS (SELECT track_id, kind, count(*) AS n FROM d GROUP BY track_id, kind), r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, kind) AS rk FROM c) SELECT track_id, kind AS top FROM r WHERE rk = 1""")
def top_of_map(spark: SparkSession, sf: str) -> DataFrame:
    """The key of a map's largest value."""
    c = detections(spark, sf).groupBy("track_id", "kind").agg(F.count("*").alias("n"))
    return c.groupBy("track_id").agg(X.argmax_key(F.map_from_entries(F.collect_list(F.struct("kind", "n")))).alias("top"))


@query("""WITH f AS (SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_orderkey % 3 <> 0), s AS (SELECT c_custkey AS b, c_nationkey AS c FROM customer WHERE c_custkey % 4 <> 0), m AS (SELECT a, c FROM f JOIN s USING (b)) SELECT 'matched' AS part, a, c FROM m UNION ALL SELECT 'left', a, NULL FROM f WHERE a NOT IN (SELECT a FROM m)""")
def composed_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Two matchings composed, with what is left over."""
    f = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    s = table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("c"))
    m = J.compose_matches(f, s)
    return m["matched"].select(F.lit("matched").alias("part"), "a", "c").unionByName(m["left"].select(F.lit("left").alias("part"), "a", F.lit(None).cast("int").alias("c")))


@query("SELECT l_orderkey, l_partkey % 3 AS part, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    """V4: keys that stand more than once."""
    return J.repeated_keys(table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 3).alias("part")), ["l_orderkey", "part"])


@query("""WITH s AS (SELECT o_custkey AS stop, o_orderkey % 500 AS start, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT DISTINCT start + u.g * 25 AS frame FROM s, unnest([0, 1, 2]) AS u(g) WHERE i = 1""")
def frames_to_ask(spark: SparkSession, sf: str) -> DataFrame:
    """frames spread over each stoppage, each once."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    s = table(spark, sf, "orders").withColumn("i", F.row_number().over(w)).where("i = 1").select((F.col("o_orderkey") % 500).alias("start"))
    return s.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda g: F.col("start") + g * 25)).alias("frame")).distinct()
