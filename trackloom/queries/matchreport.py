"""Queries of the match report: every metric of the catalogue, its evidence, and what is derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import report as R
from trackloom.plans.tracking import ROWS, detections
from trackloom.queries.registry import query

#: Kinds whose events are certified as complete.
COMPLETE = ["goal", "card", "tackle", "interception", "duel", "foul", "pass", "possession", "corner"]


def report_events(spark: SparkSession, sf: str) -> DataFrame:
    """The tracking rows as report events of every kind, with missing values of every sort."""
    d, k, i = detections(spark, sf), F.col("k"), F.col("event_id")
    kind = F.when(i % 5 < 2, "pass").otherwise(F.element_at(F.array(*[F.lit(x) for x in R.KINDS]), (i % len(R.KINDS) + 1).cast("int")))
    start, end = F.col("frame") * 1000, F.col("frame") * 1000 + (k % 60) * 1000
    some = lambda cond, v: F.when(cond, v)
    return d.select(
        "match_id", i.cast("string").alias("event_id"), kind.alias("kind"), some(i % 97 != 0, F.col("team")).alias("team"), some(i % 89 != 0, F.col("track_id").cast("string")).alias("player_id"),
        some(k % 3 != 0, (F.col("track_id") + 1).cast("string")).alias("target_id"), F.floor(F.col("frame") / 360).cast("int").alias("period"), some(k % 5 != 0, k % 2 == 0).alias("outcome"),
        some(k % 17 != 0, F.col("x")).alias("x"), some(k % 17 != 0, F.col("y")).alias("y"), some(k % 19 != 0, -F.col("x") * 0.5 + 10).alias("end_x"), some(k % 19 != 0, F.col("y") * 0.5).alias("end_y"),
        some(k % 23 != 0, X.direction(F.col("team"))).alias("sign"), start.alias("start_ms"), some(k % 7 != 0, end).alias("end_ms"), F.when(k % 3 == 0, "estimated").otherwise("verified").alias("status"),
        F.create_map(F.lit("header"), k % 4 == 0, F.lit("cross"), some(k % 7 != 0, k % 9 == 0), F.lit("on_target"), k % 3 == 0, F.lit("aerial"), k % 2 == 0, F.lit("high"), k % 2 == 1).alias("flags"),
        F.create_map(F.lit("distance_m"), some(k % 10 != 0, k * 0.5), F.lit("xg"), (k % 10) / 10.0, F.lit("xa"), (k % 8) / 10.0).alias("numbers"),
        F.create_map(F.lit("colour"), F.when(k % 6 == 0, None).when(k % 2 == 0, "yellow").otherwise("red"), F.lit("xg_model"), some(k % 4 != 1, F.lit("m")), F.lit("xa_model"), some(k % 3 == 0, F.lit("m"))).alias("labels"),
    )


_LIST = "[" + ", ".join(f"'{x}'" for x in R.KINDS) + "]"
_EVENTS = f"""{ROWS},
e0 AS (SELECT match_id, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 5 < 2 THEN 'pass' ELSE {_LIST}[event_id % {len(R.KINDS)} + 1] END AS kind, CASE WHEN event_id % 97 <> 0 THEN team END AS team, CASE WHEN event_id % 89 <> 0 THEN CAST(track_id AS VARCHAR) END AS player_id,
  CASE WHEN k % 3 <> 0 THEN CAST(track_id + 1 AS VARCHAR) END AS target_id, CAST(frame // 360 AS INTEGER) AS period, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS outcome, CASE WHEN k % 17 <> 0 THEN x END AS x, CASE WHEN k % 17 <> 0 THEN y END AS y,
  CASE WHEN k % 19 <> 0 THEN -x * 0.5 + 10 END AS end_x, CASE WHEN k % 19 <> 0 THEN y * 0.5 END AS end_y, CASE WHEN k % 23 <> 0 THEN CASE WHEN team = 'left' THEN 1 ELSE -1 END END AS sg, frame * 1000 AS start_ms, CASE WHEN k % 7 <> 0 THEN (k % 60) * 1.0 END AS dur,
  CASE WHEN k % 3 = 0 THEN 'estimated' ELSE 'verified' END AS status, CASE WHEN k % 10 <> 0 THEN k * 0.5 END AS dist, (k % 10) / 10.0 AS xg, (k % 8) / 10.0 AS xa, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 2 = 0 THEN 'yellow' ELSE 'red' END AS colour, k FROM d),
e1 AS (SELECT *, x * sg AS ax, end_x * sg AS aex, sqrt((end_x - x) * (end_x - x) + (end_y - y) * (end_y - y)) AS flown, (end_x - x) * sg AS gain FROM e0),
ev AS (SELECT *, coalesce(flown, dist) AS ln, gain / greatest(flown, 1e-12) AS co FROM e1)"""
_CATALOG = ", ".join(f"('{g}', '{m}', '{k}', '{q or ''}')" for g, m, k, q in R.METRICS)
_QUALIFIED = f"""{_EVENTS}, cat(grp, metric, kd, q) AS (VALUES {_CATALOG}),
qq AS (SELECT match_id, event_id, kind, team, player_id, period, outcome, status, grp, metric, CASE q WHEN '' THEN true WHEN 'header' THEN k % 4 = 0 WHEN 'cross' THEN CASE WHEN k % 7 <> 0 THEN k % 9 = 0 END WHEN 'on_target' THEN k % 3 = 0 WHEN 'aerial' THEN k % 2 = 0 WHEN 'high' THEN k % 2 = 1
  WHEN 'yellow' THEN colour = 'yellow' WHEN 'red' THEN colour = 'red' WHEN 'duration_0_10' THEN dur < 10 WHEN 'duration_10_20' THEN dur >= 10 AND dur < 20 WHEN 'duration_20_45' THEN dur >= 20 AND dur < 45 WHEN 'duration_over_45' THEN dur >= 45
  WHEN 'own_half' THEN ax < 0 WHEN 'opponent_half' THEN ax >= 0 WHEN 'inside_box' THEN CASE WHEN ax IS NOT NULL THEN ax BETWEEN 36 AND 52.5 AND abs(y) <= 20.16 END
  ELSE CASE WHEN kind <> 'pass' THEN NULL ELSE CASE q WHEN 'short' THEN ln < 10 WHEN 'medium' THEN ln BETWEEN 10 AND 40 WHEN 'long' THEN ln > 40 WHEN 'forward' THEN co >= 0.5 WHEN 'backward' THEN co <= -0.5 WHEN 'lateral' THEN co > -0.5 AND co < 0.5
    WHEN 'progressive' THEN co >= 0.5 AND gain >= CASE WHEN aex < 0 THEN 30 WHEN ax < 0 THEN 15 ELSE 10 END WHEN 'into_final_third' THEN CASE WHEN co IS NOT NULL THEN aex >= 17.5 END WHEN 'into_box' THEN CASE WHEN co IS NOT NULL THEN aex BETWEEN 36 AND 52.5 AND abs(end_y) <= 20.16 END END END END AS yes
  FROM ev JOIN cat ON kd = kind)"""
_SCOPED = lambda t: f"SELECT 'team' AS scope, team AS entity, CAST(NULL AS INTEGER) AS per, * FROM {t} WHERE team IS NOT NULL UNION ALL SELECT 'player', player_id, NULL, * FROM {t} WHERE player_id IS NOT NULL UNION ALL SELECT 'period', team, period, * FROM {t} WHERE team IS NOT NULL"
_KINDS_SQL = ", ".join(f"'{x}'" for x in COMPLETE)
_MEASURES = ", ".join(f"('{g}', '{m}', '{k}', '{w}', {str(mean).lower()}, '{u}', {d})" for g, m, k, w, mean, u, d in R.MEASURES)


@query(f"""WITH {_QUALIFIED}, who AS (SELECT DISTINCT match_id, scope, entity, per FROM ({_SCOPED('ev')})),
am AS (SELECT *, CASE WHEN kind = 'shot' AND k % 4 <> 1 THEN xg WHEN kind = 'pass' AND k % 3 = 0 THEN xa END AS model, CASE kind WHEN 'pass' THEN ln WHEN 'shot' THEN sqrt((sg * 52.5 - x) * (sg * 52.5 - x) + y * y) WHEN 'carry' THEN dist WHEN 'possession' THEN dur END AS amount FROM ev),
ca AS (SELECT match_id, scope, entity, per, kind, count(*) AS n, count(*) FILTER (status = 'estimated') AS est, sum(model) AS ms, count(model) AS mn, sum(amount) AS su, count(amount) AS an FROM ({_SCOPED('am')}) GROUP BY ALL),
co AS (SELECT match_id, scope, entity, per, grp, metric, count(*) FILTER (yes) AS sel, count(*) FILTER (yes IS NULL) AS unk, count(*) FILTER (yes AND outcome IS NULL) AS op, count(*) FILTER (yes AND outcome) AS won FROM ({_SCOPED('qq')}) GROUP BY ALL),
ok AS (SELECT match_id, kind, count(team) = count(*) AS tok, count(player_id) = count(*) AS pok FROM ev GROUP BY ALL),
rows_ AS (SELECT grp, metric, kd, '' AS what, false AS mean, 'count' AS unit, 0 AS dec FROM cat UNION ALL SELECT * FROM (VALUES {_MEASURES})),
j AS (SELECT w.match_id, w.scope, w.entity, w.per, r.*, coalesce(ca.n, 0) AS n, coalesce(ca.est, 0) AS est, coalesce(sel, 0) AS sel, coalesce(unk, 0) AS unk, coalesce(op, 0) AS op, coalesce(won, 0) AS won, CASE what WHEN 'model' THEN ms ELSE su END AS tot, coalesce(CASE what WHEN 'model' THEN mn ELSE an END, 0) AS known,
  kd IN ({_KINDS_SQL}) AND coalesce(CASE WHEN w.scope = 'player' THEN pok ELSE tok END, true) AS complete
  FROM who w CROSS JOIN rows_ r LEFT JOIN ca ON ca.match_id = w.match_id AND ca.scope = w.scope AND ca.entity = w.entity AND ca.per IS NOT DISTINCT FROM w.per AND ca.kind = r.kd LEFT JOIN co ON co.match_id = w.match_id AND co.scope = w.scope AND co.entity = w.entity AND co.per IS NOT DISTINCT FROM w.per AND co.grp = r.grp AND co.metric = r.metric AND r.what = '' LEFT JOIN ok ON ok.match_id = w.match_id AND ok.kind = r.kd),
v AS (SELECT *, CASE WHEN (n > 0 OR complete) AND unk = 0 THEN sel END AS cnt, CASE WHEN (n > 0 OR complete) AND known = n THEN coalesce(tot, 0) END AS total FROM j),
x AS (SELECT *, CASE WHEN what = '' THEN CAST(cnt AS DOUBLE) WHEN mean THEN CASE WHEN n > 0 THEN floor(floor(total * 10000.0 + 0.5) / 10000.0 / n * 1000.0 + 0.5) / 1000.0 END ELSE floor(total * 10000.0 + 0.5) / 10000.0 END AS value, CASE WHEN what = '' AND sel > 0 AND op = 0 THEN won END AS successful FROM v)
SELECT match_id, scope, entity, per AS period, grp AS "group", metric, value, CASE WHEN what = '' THEN sel END AS observed, CASE WHEN what = '' THEN unk END AS unknown, successful, CASE WHEN cnt > 0 THEN floor(successful * 100 / cnt * 100.0 + 0.5) / 100.0 END AS success_pct,
  CASE WHEN value IS NULL THEN 'unavailable' WHEN complete AND est = 0 THEN 'verified' WHEN est > 0 THEN 'estimated' ELSE 'partial' END AS state, unit FROM x""")
def match_report(spark: SparkSession, sf: str) -> DataFrame:
    """All metrics and measures of the catalogue at team, player and period x team."""
    return R.rolled_up(report_events(spark, sf), COMPLETE)


@query(f"""WITH {_QUALIFIED} SELECT match_id, team AS entity, period, grp AS "group", metric, string_agg(event_id, ',' ORDER BY event_id) AS evidence_ids FROM qq WHERE yes AND team IS NOT NULL GROUP BY ALL""")
def report_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The events behind every metric of a period."""
    return R.evidence(report_events(spark, sf), "period").withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(f"""WITH {_EVENTS}, s AS (SELECT match_id, team, count(*) FILTER (kind <> 'pass' AND ax >= 12.5) AS actions, count(*) FILTER (kind = 'pass' AND outcome AND ax <= -12.5) AS passes, count(*) FILTER (kind <> 'pass' AND ax IS NULL) AS lost, count(*) FILTER (kind = 'pass' AND (ax IS NULL OR outcome IS NULL)) AS blind FROM ev WHERE kind IN ('pass', 'tackle', 'interception', 'duel', 'foul') AND k % 17 <> 0 AND k % 23 <> 0 AND k % 5 <> 0 AND k % 19 <> 0 GROUP BY ALL),
t AS (SELECT match_id, count(DISTINCT team) AS teams FROM ev WHERE k % 17 <> 0 AND k % 23 <> 0 AND k % 5 <> 0 AND k % 19 <> 0 GROUP BY match_id)
SELECT a.match_id, a.team, b.passes, a.actions, CASE WHEN u.match_id IS NULL AND a.lost = 0 AND b.blind = 0 AND a.actions > 0 THEN floor(b.passes / a.actions * 1000.0 + 0.5) / 1000.0 END AS ppda FROM s a JOIN s b ON a.match_id = b.match_id AND a.team <> b.team JOIN t ON t.match_id = a.match_id AND teams = 2 LEFT JOIN s u ON u.match_id = a.match_id AND u.team IS NULL WHERE a.team IS NOT NULL AND b.team IS NOT NULL""")
def pressing(spark: SparkSession, sf: str) -> DataFrame:
    """Passes per defensive action of rows whose places and outcomes are known."""
    e = report_events(spark, sf).where("x is not null and sign is not null and outcome is not null and end_x is not null")
    return R.pressing(e, COMPLETE)


@query(f"""WITH {_EVENTS}, g AS (SELECT match_id, target_id AS player_id, count(*) AS received, count(*) FILTER (status = 'estimated') AS est FROM ev WHERE kind = 'pass' AND outcome AND target_id IS NOT NULL GROUP BY ALL),
p AS (SELECT match_id, count(*) FILTER (player_id IS NULL OR (outcome AND target_id IS NULL)) AS gaps FROM ev WHERE kind = 'pass' GROUP BY ALL)
SELECT match_id, player_id, received, CASE WHEN gaps = 0 AND est = 0 THEN 'verified' WHEN est > 0 THEN 'estimated' ELSE 'partial' END AS state FROM g JOIN p USING (match_id)""")
def passes_received(spark: SparkSession, sf: str) -> DataFrame:
    """Passes by the player who got them."""
    return R.passes_received(report_events(spark, sf), complete=True)


@query(f"""WITH {_EVENTS} SELECT match_id, team, player_id, target_id, count(*) AS passes, CASE WHEN count(*) FILTER (outcome) = count(*) THEN count(*) FILTER (outcome) END AS completed, string_agg(event_id, ',' ORDER BY event_id) AS evidence_ids FROM ev WHERE kind = 'pass' AND outcome AND player_id IS NOT NULL AND target_id IS NOT NULL GROUP BY match_id, team, player_id, target_id""")
def report_network(spark: SparkSession, sf: str) -> DataFrame:
    """Who passed to whom, with evidence."""
    return R.pass_network(report_events(spark, sf)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(f"""WITH {_EVENTS}, t AS (SELECT match_id, team, CASE WHEN count(dur) = count(*) THEN sum(dur) END AS s, count(*) FILTER (status = 'estimated') AS est FROM ev WHERE kind = 'possession' AND team IS NOT NULL GROUP BY ALL), u AS (SELECT *, CASE WHEN count(s) OVER w = count(*) OVER w THEN sum(s) OVER w END AS tot, sum(est) OVER w AS e FROM t WINDOW w AS (PARTITION BY match_id))
SELECT match_id, team, floor(s * 10000.0 + 0.5) / 10000.0 AS time_s, CASE WHEN tot > 0 THEN floor(100 * s / tot * 100.0 + 0.5) / 100.0 END AS share_pct, CASE WHEN coalesce(tot, 0) <= 0 THEN 'unavailable' WHEN e > 0 THEN 'estimated' ELSE 'partial' END AS state FROM u""")
def possession_time_share(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of possession time, with the worst state of both sides."""
    return R.possession_shares(report_events(spark, sf))


@query(f"""WITH {_EVENTS} SELECT match_id, kind, count(*) AS n, string_agg(event_id, ',' ORDER BY start_ms, event_id) AS ids, count(*) FILTER (x IS NOT NULL) AS placed FROM ev GROUP BY ALL""")
def event_maps(spark: SparkSession, sf: str) -> DataFrame:
    """What happened where, by kind."""
    m = R.event_maps(report_events(spark, sf))
    return m.select("match_id", "kind", F.size("events").cast("long").alias("n"), F.array_join(F.transform("events", lambda e: e["event_id"]), ",").alias("ids"), F.size(F.filter("events", lambda e: e["spatial"] == "available")).cast("long").alias("placed"))


@query(f"""WITH {ROWS}, r AS (SELECT match_id, max(frame) AS last_frame, count(DISTINCT frame) AS frames_seen, CASE match_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000 ELSE 1440000 END AS ms FROM d GROUP BY match_id), f AS (SELECT *, CAST(ceil(ms / 1000 * 1.0 - 1e-9) AS BIGINT) AS fr FROM r),
p AS (SELECT *, CASE WHEN ms IS NULL THEN NULL WHEN ms <= 0 OR fr <= 0 THEN 'source duration must be positive' WHEN last_frame > fr THEN 'source duration excludes observed frames' WHEN frames_seen > fr THEN 'observed frame count exceeds the source interval' END AS problem FROM f)
SELECT match_id, problem, CASE WHEN problem IS NULL AND ms IS NOT NULL THEN fr END AS clip_frames, CASE WHEN problem IS NULL AND ms IS NOT NULL THEN floor(frames_seen / fr * 10000.0 + 0.5) / 10000.0 END AS coverage FROM p""")
def source_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage by the source's duration, or why it cannot be."""
    r = detections(spark, sf).groupBy("match_id").agg(F.max("frame").alias("last_frame"), F.countDistinct("frame").alias("frames_seen"))
    m = F.col("match_id") % 5
    ms = F.when(m == 0, None).when(m == 1, 0).when(m == 2, 1000).otherwise(1440000)
    return R.with_duration(r, ms, F.lit(1.0)).select("match_id", "problem", "clip_frames", "coverage")
