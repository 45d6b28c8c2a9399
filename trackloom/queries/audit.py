"""Queries of evaluation, manifests, projections and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators import evaluation as E
from trackloom.operators import validate as C
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query

M = ["match_id"]


# ------------------------------------------------------------------ attributes after matching
def _truth(spark: SparkSession, sf: str) -> DataFrame:
    d, k = detections(spark, sf), F.col("k")
    return d.where("event_id % 10 <> 3").select("match_id", F.col("event_id").alias("id"), F.when(k % 12 == 0, "goalkeeper").when(k % 15 == 1, "referee").otherwise("player").alias("role"), "team", F.when(k % 4 != 0, F.col("track_id") % 30).cast("string").alias("number"))


def _found(spark: SparkSession, sf: str) -> DataFrame:
    d, k = detections(spark, sf), F.col("k")
    return d.where("event_id % 10 <> 4").select("match_id", F.col("event_id").alias("id"), F.when(k % 11 == 0, "goalkeeper").otherwise("player").alias("role"), F.when(k % 9 != 0, F.col("team")).alias("team"), F.when(k % 5 != 0, (F.col("track_id") + F.when(k % 6 == 0, 1).otherwise(0)) % 30).cast("string").alias("number"))


_ATTR = f"""{ROWS}, t AS (SELECT match_id, event_id AS id, CASE WHEN k % 12 = 0 THEN 'goalkeeper' WHEN k % 15 = 1 THEN 'referee' ELSE 'player' END AS role, team, CASE WHEN k % 4 <> 0 THEN CAST(track_id % 30 AS VARCHAR) END AS number FROM d WHERE event_id % 10 <> 3),
f AS (SELECT match_id, event_id AS id, CASE WHEN k % 11 = 0 THEN 'goalkeeper' ELSE 'player' END AS role, CASE WHEN k % 9 <> 0 THEN team END AS team, CASE WHEN k % 5 <> 0 THEN CAST((track_id + CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END) % 30 AS VARCHAR) END AS number FROM d WHERE event_id % 10 <> 4)"""


@query(f"""WITH {_ATTR}, m AS (SELECT t.match_id, t.role AS tr, f.role AS fr, t.team AS tt, f.team AS ft, t.number AS tn, f.number AS fn FROM t JOIN f ON t.id = f.id AND t.match_id = f.match_id), a AS (SELECT match_id, count(*) AS n FROM t GROUP BY match_id), b AS (SELECT match_id, count(*) AS n FROM f GROUP BY match_id),
g AS (SELECT match_id, count(*) AS matched, count(*) FILTER (tr = fr) AS ro, count(*) FILTER (tr IN ('player', 'goalkeeper')) AS si, count(*) FILTER (tr IN ('player', 'goalkeeper') AND tt IS NOT DISTINCT FROM ft) AS te, count(*) FILTER (tr = 'player') AS pl, count(*) FILTER (tr = 'player' AND tn IS NOT DISTINCT FROM fn) AS ex, count(*) FILTER (tr = 'player' AND tn IS NOT NULL) AS la, count(*) FILTER (tr = 'player' AND tn IS NOT NULL AND fn IS NOT NULL) AS em, count(*) FILTER (tr = 'player' AND tn = fn) AS ri, count(*) FILTER (tr = 'player' AND tn IS NULL AND fn IS NOT NULL) AS fa FROM m GROUP BY match_id)
SELECT match_id, matched, a.n - matched AS missed, b.n - matched AS spurious, matched / a.n AS recall, matched / b.n AS "precision", ro / greatest(matched, 1) AS role_accuracy, te / greatest(si, 1) AS team_accuracy, ex / greatest(pl, 1) AS number_exact, ri / greatest(em, 1) AS number_when_emitted, em / greatest(la, 1) AS number_coverage, fa AS false_numbers, la AS labelled FROM g JOIN a USING (match_id) JOIN b USING (match_id)""")
def attribute_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Recall, precision and accuracies of role, side and number over matched rows."""
    t, f = _truth(spark, sf), _found(spark, sf)
    m = t.select("match_id", F.col("id").alias("truth")).join(f.select("match_id", F.col("id").alias("found")), (F.col("truth") == F.col("found")) & (t.match_id == f.match_id)).select(t.match_id, "truth", "found")
    return E.attribute_accuracy(t, f, m, M)


@query(None)
def gaussian_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions assigned to truths per frame by Gaussian similarity."""
    d = detections(spark, sf).withColumn("slot", F.floor(F.col("frame") / 30))
    t = d.where("event_id % 10 <> 3").select("match_id", "slot", F.col("event_id").alias("id"), "x", "y")
    f = d.where("event_id % 10 <> 4").select("match_id", "slot", F.col("event_id").alias("id"), (F.col("x") + F.col("k") % 3).alias("x"), "y")
    return E.gaussian_matches(t, f, ["match_id", "slot"])


@query(None)
def identity_scores(spark: SparkSession, sf: str) -> DataFrame:
    """MOTA, switches, IDP, IDR and IDF1 of matched tracks."""
    d, k = detections(spark, sf), F.col("k")
    m = d.where(k % 10 != 0).select("match_id", "frame", F.col("track_id").alias("truth"), F.when(k % 6 == 0, F.col("track_id") % 40).otherwise(F.col("track_id") + 1000).alias("pred"))
    m = m.groupBy("match_id", "frame", "truth").agg(F.min("pred").alias("pred"))
    n = d.groupBy("match_id").agg(F.count("*").alias("n"))
    return E.track_summary_scores(m, n, n.withColumn("n", F.col("n") + 3), M)


_COCO = f"""{ROWS}, bx AS (SELECT event_id AS id, match_id * 10000 + frame // 60 AS image, kind AS label, x + 60 AS bx, y + 40 AS b_y, 10.0 + k % 30 AS bw, 20.0 + k % 20 AS bh, k FROM d), t AS (SELECT image, label, row_number() OVER (PARTITION BY image, label ORDER BY id) AS j, bx, b_y, bw, bh FROM bx WHERE id % 3 <> 0),
f AS (SELECT image, label, id, (k % 100) / 100.0 AS score, bx + 1 + k % 4 AS bx, b_y + 2 AS b_y, bw, bh FROM bx WHERE id % 4 <> 0), fr AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY score DESC, id) AS rn FROM f),
ii AS (SELECT fr.image, fr.label, fr.id, t.j, greatest(least(fr.bx + fr.bw, t.bx + t.bw) - greatest(fr.bx, t.bx), 0) * greatest(least(fr.b_y + fr.bh, t.b_y + t.bh) - greatest(fr.b_y, t.b_y), 0) AS i, fr.bw * fr.bh + t.bw * t.bh AS s FROM fr JOIN t ON fr.image = t.image AND fr.label = t.label),
li AS (SELECT image, label, id, list({{'j': j, 'u': i / (s - i)}} ORDER BY i / (s - i) DESC, j) AS l FROM ii GROUP BY ALL), th AS (SELECT unnest(range(10)) AS k), e AS (SELECT fr.image, fr.label, fr.id, fr.score, fr.rn, th.k, coalesce(li.l, []) AS l FROM fr CROSS JOIN th LEFT JOIN li USING (image, label, id)),
r AS (SELECT image, label, id, score, rn, k, CASE WHEN len(l) > 0 AND l[1].u >= round(0.5 + 0.05 * k, 2) THEN [l[1].j] ELSE CAST([] AS BIGINT[]) END AS used, len(l) > 0 AND l[1].u >= round(0.5 + 0.05 * k, 2) AS hit FROM e WHERE rn = 1 UNION ALL
  SELECT image, label, id, score, rn, k, CASE WHEN n.u >= round(0.5 + 0.05 * k, 2) THEN list_append(used, n.j) ELSE used END, coalesce(n.u >= round(0.5 + 0.05 * k, 2), false) FROM (SELECT e.*, r.used, list_filter(e.l, lambda q: NOT list_contains(r.used, q.j))[1] AS n FROM r JOIN e ON e.image = r.image AND e.label = r.label AND e.k = r.k AND e.rn = r.rn + 1)),
tn AS (SELECT label, count(*) AS truths FROM t GROUP BY label), c AS (SELECT label, k, hit, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY label, k ORDER BY score DESC, image, id)),
h AS (SELECT label, k, tp / truths AS rec, max(tp / n) OVER (PARTITION BY label, k ORDER BY tp DESC) AS p FROM c JOIN tn USING (label) WHERE hit),
rt AS (SELECT label, k, q.j / 100.0 AS rr FROM tn CROSS JOIN th CROSS JOIN (SELECT unnest(range(101)) AS j) q), rd AS (SELECT rt.label, rt.k, rt.rr, max(h.p) AS p FROM rt LEFT JOIN h ON h.label = rt.label AND h.k = rt.k AND h.rec >= rt.rr - 1e-11 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_COCO} SELECT label, round(0.5 + 0.05 * k, 2) AS threshold, sum(coalesce(p, 0)) / 101 AS ap FROM rd GROUP BY label, k")
def box_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    """Average precision by class and IoU threshold, boxes matched greedily by score."""
    d, k, i = detections(spark, sf), F.col("k"), F.col("event_id")
    image = F.col("match_id").cast("long") * 10000 + F.floor(F.col("frame") / 60)
    box = d.select(i.alias("id"), image.alias("image"), F.col("kind").alias("label"), (F.col("x") + 60).alias("bx"), (F.col("y") + 40).alias("by"), (k % 30 + 10.0).alias("bw"), (k % 20 + 20.0).alias("bh"), "k")
    truth = box.where("id % 3 <> 0").select("image", "label", "id", "bx", "by", "bw", "bh")
    found = box.where("id % 4 <> 0").select("image", "label", "id", (k % 100 / 100.0).alias("score"), (F.col("bx") + 1 + k % 4).alias("bx"), (F.col("by") + 2).alias("by"), "bw", "bh")
    return E.average_precisions(E.box_hits(found, truth), truth)


# ------------------------------------------------------------------ recognisers and runs
_REC = "r AS (SELECT l_orderkey AS person, l_linenumber AS attribute, l_returnflag <> 'N' AS truth, (l_partkey % 100) / 100.0 AS p, (l_partkey % 100) / 100.0 >= 0.5 AS said FROM lineitem)"


def _recognised(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("person"), F.col("l_linenumber").alias("attribute"), (F.col("l_returnflag") != "N").alias("truth"), (F.col("l_partkey") % 100 / 100.0).alias("probability"))


@query(f"""WITH {_REC}, p AS (SELECT person, count(*) FILTER (said AND truth) AS b, count(*) FILTER (said OR truth) AS e, count(*) FILTER (said) AS s, count(*) FILTER (truth) AS t FROM r GROUP BY person), m AS (SELECT count(*) AS persons, avg(CASE WHEN e > 0 THEN b / e ELSE 0 END) AS accuracy, avg(CASE WHEN s > 0 THEN b / s ELSE 0 END) AS pr, avg(CASE WHEN t > 0 THEN b / t ELSE 0 END) AS recall FROM p),
a AS (SELECT attribute, count(*) FILTER (truth) AS p, count(*) FILTER (NOT truth) AS n, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND NOT said) AS tn FROM r GROUP BY attribute), q AS (SELECT avg((CASE WHEN p > 0 THEN tp / p ELSE 0 END + CASE WHEN n > 0 THEN tn / n ELSE 0 END) / 2) AS mean_accuracy FROM a) SELECT persons, accuracy, pr AS "precision", recall, 2 * pr * recall / (pr + recall) AS f1, mean_accuracy FROM m, q""")
def attribute_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of an attribute recogniser by person and by attribute."""
    return E.attribute_metrics(_recognised(spark, sf))


@query("""WITH r AS (SELECT o_custkey % 200 AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'before' ELSE 'after' END AS v, o_totalprice AS s, o_orderstatus AS i, o_custkey % 7 AS o FROM orders), g AS (SELECT name, median(s) FILTER (v = 'before') AS before_s, median(s) FILTER (v = 'after') AS after_s, count(DISTINCT i) = 1 AS same_inputs, count(DISTINCT o) = 1 AS exact_outputs FROM r GROUP BY name) SELECT *, before_s / after_s AS speedup FROM g WHERE before_s IS NOT NULL AND after_s IS NOT NULL""")
def paired_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Medians and speedups of paired runs, and whether their outputs are the same."""
    o = table(spark, sf, "orders")
    r = o.select((F.col("o_custkey") % 200).alias("name"), F.when(F.col("o_orderkey") % 2 == 0, "before").otherwise("after").alias("variant"), F.col("o_totalprice").alias("seconds"), F.col("o_orderstatus").alias("input_hash"), (F.col("o_custkey") % 7).alias("output_hash"))
    return E.paired_runs(r)


@query("""WITH l AS (SELECT o_custkey % 50 AS log, o_orderkey AS n, CASE o_orderkey % 3 WHEN 0 THEN 'mAP: ' || (o_orderkey % 100) || '.5% of all' WHEN 1 THEN 'Rank-1  : ' || (o_orderkey % 90) || '%' ELSE 'nothing' END AS value FROM orders), f AS (SELECT log, n, 'mAP' AS figure, regexp_extract(value, 'mAP: ([.\\dEe+-]+)%', 1) AS v FROM l UNION ALL SELECT log, n, 'r1', regexp_extract(value, 'Rank-1  : ([.\\dEe+-]+)%', 1) FROM l),
p AS (SELECT log, figure, CAST(arg_max(v, n) AS DOUBLE) AS v FROM f WHERE v <> '' GROUP BY log, figure) SELECT figure, count(*) AS runs, avg(v) AS mean, stddev_pop(v) AS spread FROM p GROUP BY figure""")
def log_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Mean figures over runs, read from their logs."""
    k, m = F.col("o_orderkey"), F.col("o_orderkey") % 3
    value = F.when(m == 0, F.concat(F.lit("mAP: "), (k % 100).cast("string"), F.lit(".5% of all"))).when(m == 1, F.concat(F.lit("Rank-1  : "), (k % 90).cast("string"), F.lit("%"))).otherwise("nothing")
    return E.log_figures(table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("log"), k.alias("n"), value.alias("value")))


# ------------------------------------------------------------------ looks, views, rosters
@query(f"""WITH {ROWS}, r AS (SELECT match_id, frame // 120 AS slot, event_id AS id, kind AS colour, x, y, k % 50 AS z FROM d), c AS (SELECT match_id, slot, colour, row_number() OVER (PARTITION BY match_id, slot ORDER BY count(*) DESC, min(id)) AS rk FROM r GROUP BY match_id, slot, colour), j AS (SELECT r.*, CASE WHEN rk <= 2 THEN rk - 1 ELSE -1 END AS team FROM r JOIN c USING (match_id, slot, colour)),
m AS (SELECT match_id, slot, avg(x) FILTER (team = 0) AS x0, avg(y) FILTER (team = 0) AS y0, avg(z) FILTER (team = 0) AS z0, avg(x) FILTER (team = 1) AS x1, avg(y) FILTER (team = 1) AS y1, avg(z) FILTER (team = 1) AS z1 FROM j GROUP BY match_id, slot)
SELECT j.match_id, j.slot, id, CAST(CASE WHEN team >= 0 THEN team WHEN x0 IS NULL OR x1 IS NULL THEN -1 WHEN (x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2 < (x - x1) ** 2 + (y - y1) ** 2 + (z - z1) ** 2 THEN 0 ELSE 1 END AS INTEGER) AS team FROM j JOIN m USING (match_id, slot)""")
def frame_colour_teams(spark: SparkSession, sf: str) -> DataFrame:
    """The two commonest colours of a moment are the teams, a third colour joins the nearer one."""
    d = detections(spark, sf).select("match_id", F.floor(F.col("frame") / 120).alias("slot"), F.col("event_id").alias("id"), F.col("kind").alias("colour"), F.array("x", "y", (F.col("k") % 50).cast("double")).alias("vector"))
    return E.colour_teams(d, ["match_id", "slot"])


@query(f"""WITH {ROWS}, v AS (SELECT track_id AS identity, event_id, match_id AS tracklet, frame, 20 + k AS height, round((k % 97) / 97.0, 4) AS occ, row_number() OVER (PARTITION BY track_id ORDER BY k DESC, event_id) AS rank FROM d QUALIFY rank <= 8)
SELECT identity, list_aggregate(list_transform(list_sort(list_distinct(list(tracklet))), lambda q: CAST(q AS VARCHAR)), 'string_agg', ',') AS tracklets, string_agg(event_id || ':' || frame || ':' || height, ',' ORDER BY rank) AS views FROM v GROUP BY identity""")
def views_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What to look at for each identity, in ranked order."""
    from pyspark.sql import Window

    d, k = detections(spark, sf), F.col("k")
    rank = F.row_number().over(Window.partitionBy("track_id").orderBy(k.desc(), "event_id"))
    v = d.withColumn("rank", rank).where("rank <= 8").select(F.col("track_id").alias("identity"), "rank", F.col("event_id").alias("observation"), F.col("match_id").alias("tracklet"), "frame", (k + 20).alias("height"), (k % 97 / 97.0).alias("occlusion"), F.lit(1.0).alias("sharpness"))
    m = E.views_manifest(v)
    text = F.transform("views", lambda x: F.concat_ws(":", x["observation"].cast("string"), x["frame"].cast("string"), x["height"].cast("string")))
    return m.select("identity", F.array_join(F.col("tracklets").cast("array<string>"), ",").alias("tracklets"), F.array_join(text, ",").alias("views"))


@query("""WITH r AS (SELECT o_orderkey AS roster_id, o_custkey AS name, o_custkey || '/' || o_orderstatus AS content, o_orderkey % 12 AS n FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY n DESC, roster_id) AS rn FROM r) SELECT roster_id, name, CAST(n AS INTEGER) AS starters FROM b WHERE rn = 1""")
def newest_rosters(spark: SparkSession, sf: str) -> DataFrame:
    """One roster of each content, with the larger line-up."""
    o = table(spark, sf, "orders")
    n = (F.col("o_orderkey") % 12).cast("int")
    r = o.select(F.col("o_orderkey").alias("roster_id"), F.col("o_custkey").alias("name"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderstatus").alias("content"), F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("lineup"))
    return E.newest_rosters(r).select("roster_id", "name", F.size("lineup").alias("starters"))


# ------------------------------------------------------------------ projections
@query(f"""WITH {ROWS}, l AS (SELECT event_id, ['Pass', 'shot', 'carry', 'touch', 'loss', 'Challenge'][event_id % 6 + 1] AS type, frame * 1.5 AS s, team, track_id FROM d) SELECT CAST(event_id AS VARCHAR) AS candidate_id, CAST(s * 1000 AS BIGINT) AS centre_ms, lower(type) AS hint, team, track_id AS actor, lower(type) = 'shot' AS important FROM l WHERE lower(type) IN ('pass', 'shot', 'challenge', 'interception', 'recovery', 'touch')""")
def event_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """ledger rows as candidates of semantic events."""
    names = F.array(*[F.lit(t) for t in ("Pass", "shot", "carry", "touch", "loss", "Challenge")])
    d = detections(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("type"), (F.col("frame") * 1.5).alias("video_s"), "team", "track_id")
    return E.event_candidates(d)


@query(f"""WITH {ROWS} SELECT to_json({{'frame': frame, 'kind': kind, 'team': team, 'track_id': track_id}}) AS row FROM d""")
def canonical_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows without what names the job, in one canonical text."""
    d = detections(spark, sf).select("frame", "kind", "team", "track_id", F.col("event_id").alias("id"), F.lit("i").alias("image_id"), F.lit("v").alias("video_id"))
    return E.canonical_rows(d)


@query(f"""WITH {ROWS}, s AS (SELECT match_id, track_id, min(frame) AS lo, max(frame) AS hi FROM d GROUP BY match_id, track_id) SELECT match_id, track_id, round(lo / 25.0, 3) AS start_s, round(hi / 25.0, 3) AS end_s, printf('%02d:%06.3f', CAST(floor(lo / 25.0 / 60) AS INTEGER), (lo / 25.0) % 60) AS start_timecode, printf('%02d:%06.3f', CAST(floor(hi / 25.0 / 60) AS INTEGER), (hi / 25.0) % 60) AS end_timecode, round((hi - lo + 1) / 25.0, 3) AS duration_s FROM s""")
def span_payload(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds, timecodes and inclusive durations of spans."""
    s = detections(spark, sf).groupBy("match_id", "track_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    return s.select("match_id", "track_id", E.span_payload(F.col("lo"), F.col("hi"), 25.0).alias("p")).select("match_id", "track_id", "p.*")


@query("""WITH s AS (SELECT o_custkey AS job, ['decode', 'detect', 'track', 'events', 'report'][o_orderkey % 5 + 1] AS stage, (o_orderkey % 13) / 10.0 AS share, o_totalprice / 1000 AS el FROM orders), g AS (SELECT job, least(sum(CASE stage WHEN 'decode' THEN 0.05 WHEN 'detect' THEN 0.6 WHEN 'track' THEN 0.15 WHEN 'events' THEN 0.15 ELSE 0.05 END * least(greatest(share, 0), 1)), 1) AS done, sum(el) AS spent_s FROM s GROUP BY job) SELECT job, done, spent_s, CASE WHEN done > 0 THEN spent_s * (1 - done) / done END AS eta_s FROM g""")
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted progress of jobs and the time left."""
    names = F.array(*[F.lit(t) for t in E.STAGE_WEIGHTS])
    o = table(spark, sf, "orders")
    s = o.select(F.col("o_custkey").alias("job"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("stage"), (F.col("o_orderkey") % 13 / 10.0).alias("share"), (F.col("o_totalprice") / 1000).alias("elapsed_s"))
    return E.progress(s, ["job"])


# ------------------------------------------------------------------ rules
@query("""WITH n AS (SELECT n_regionkey AS roster, n_name AS team, n_nationkey AS i FROM nation), r AS (SELECT *, i % 4 = 1 AS badnum, i % 5 = 2 AS noname, i % 3 = 0 AS keeper, i % 7 = 3 AS starter, i % 6 = 4 AS few FROM n), t AS (SELECT roster, count(DISTINCT lower(team)) AS teams FROM n GROUP BY roster)
SELECT roster, team, 'invalid number' AS problem FROM r WHERE badnum UNION ALL SELECT roster, team, 'empty name' FROM r WHERE noname UNION ALL SELECT roster, team, 'goalkeeper is no player' FROM r WHERE keeper UNION ALL SELECT roster, team, 'starter is no player' FROM r WHERE starter UNION ALL SELECT roster, team, 'not eleven starters' FROM r WHERE few OR starter UNION ALL SELECT roster, team, 'not two different teams' FROM r JOIN t USING (roster) WHERE teams <> 2""")
def roster_problems(spark: SparkSession, sf: str) -> DataFrame:
    """V6: what is wrong with a team sheet."""
    i = F.col("n_nationkey")
    eleven = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda x: x.cast("string"))
    numbers = F.concat(eleven, F.when(i % 4 == 1, F.array(F.lit("100"))).otherwise(F.array(F.lit("12"))))
    starters = F.when(i % 7 == 3, F.array(F.lit("55"))).when(i % 6 == 4, F.slice(eleven, 1, 5)).otherwise(eleven)
    r = table(spark, sf, "nation").select(F.col("n_regionkey").alias("roster"), F.col("n_name").alias("team"), F.col("n_name").alias("short"), numbers.alias("numbers"), F.when(i % 5 == 2, F.array(F.lit(" "))).otherwise(F.array(F.lit("a"))).alias("names"), F.when(i % 3 == 0, F.array(F.lit("77"))).otherwise(F.array(F.lit("01"))).alias("goalkeepers"), starters.alias("starters"))
    return C.roster_problems(r)


@query("""WITH i AS (SELECT o_orderkey AS id, (o_orderkey % 40) / 10.0 - 0.5 AS a, (o_orderkey % 40) / 10.0 - 0.5 + (o_orderkey % 9) / 20.0 AS b FROM orders) SELECT id, 'interval too short' AS rule FROM i WHERE b - a < 0.2 UNION ALL SELECT id, 'negative start' FROM i WHERE a < 0""")
def interval_rules(spark: SparkSession, sf: str) -> DataFrame:
    """V8: intervals of requests that are too short or start before zero."""
    k = F.col("o_orderkey")
    i = table(spark, sf, "orders").select(k.alias("id"), (k % 40 / 10.0 - 0.5).alias("start_s"), (k % 40 / 10.0 - 0.5 + k % 9 / 20.0).alias("end_s"))
    return C.violations(i, ["id"], C.INTERVAL_RULES)


@query("SELECT quality AS truth, toxic AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def known_label_counts(spark: SparkSession, sf: str) -> DataFrame:
    """V9: counts of label pairs; a label that is not known fails the query."""
    r = table(spark, sf, "labels").select(F.col("quality").cast("string").alias("truth"), F.col("toxic").cast("string").alias("prediction"))
    return C.known_labels_only(r, ["0", "1"], ["truth", "prediction"]).groupBy(F.col("truth").cast("int").alias("truth"), F.col("prediction").cast("int").alias("prediction")).agg(F.count("*").alias("n"))
