"""Queries of the event ledgers and of the sequential kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.operators import cleaning as P
from trackloom.operators import events_a as E
from trackloom.operators import joins as J
from trackloom.operators import kernels as N
from trackloom.operators import temporal as T
from trackloom.plans.tracking import BALL, ROWS, ball, detections, held, table, track_points
from trackloom.queries.registry import query
from trackloom.queries.tracking import boxes

M = ["match_id"]

_SPELLS = f"""{BALL},
g AS (SELECT *, CASE WHEN lag(owner) OVER w IS DISTINCT FROM owner OR frame - lag(frame) OVER w > 12 THEN 1 ELSE 0 END AS n FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
r AS (SELECT match_id, owner, team, min(frame) AS s0, max(frame) AS e0, arg_min(x, frame) AS sx, arg_min(y, frame) AS sy, arg_max(x, frame) AS ex, arg_max(y, frame) AS ey FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS i FROM g) GROUP BY match_id, owner, team, i),
h AS (SELECT *, CASE WHEN lag(owner) OVER (PARTITION BY match_id ORDER BY s0) IS DISTINCT FROM owner THEN 1 ELSE 0 END AS n FROM r),
sp AS (SELECT match_id, owner, team, min(s0) AS start_frame, max(e0) AS end_frame, arg_min(sx, s0) AS sx, arg_min(sy, s0) AS sy, arg_max(ex, e0) AS ex, arg_max(ey, e0) AS ey FROM (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY s0) AS i FROM h) GROUP BY match_id, owner, team, i)"""

_PAIRS = f"""{_SPELLS},
nx AS (SELECT *, lead(owner) OVER w AS b, lead(team) OVER w AS tb, lead(start_frame) OVER w AS nf, lead(sx) OVER w AS nsx, lead(sy) OVER w AS nsy FROM sp WINDOW w AS (PARTITION BY match_id ORDER BY start_frame)),
q AS (SELECT *, (nf - end_frame) / 2.0 AS flight_s, sqrt((nsx - ex) ** 2 + (nsy - ey) ** 2) AS travelled FROM nx WHERE b IS NOT NULL),
kinds AS (SELECT match_id, owner AS a, b, end_frame, nf, travelled, CASE WHEN flight_s > 4 THEN NULL WHEN team = tb AND travelled < 3 THEN NULL WHEN team = tb THEN 'pass' WHEN travelled <= 3 AND travelled < 3 THEN 'tackle' ELSE 'interception' END AS kind,
  CASE WHEN team = tb AND travelled >= 3 AND flight_s <= 4 THEN (nsx - ex) * CASE WHEN team = 'left' THEN 1 ELSE -1 END >= 10 ELSE false END AS progressive,
  CASE WHEN team = tb AND travelled >= 3 AND flight_s <= 4 THEN ex * CASE WHEN team = 'left' THEN 1 ELSE -1 END < 17.5 AND nsx * CASE WHEN team = 'left' THEN 1 ELSE -1 END >= 17.5 ELSE false END AS into_third FROM q)"""

#: Turnovers of a match in order, each decided from the last one counted.
_DUELS = f"""{_PAIRS},
tu AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi, row_number() OVER (PARTITION BY match_id ORDER BY nf, a, b) AS rn FROM kinds WHERE kind IN ('tackle', 'interception')),
du AS (SELECT match_id, rn, lo, hi, nf AS lf, true AS keep FROM tu WHERE rn = 1 UNION ALL
  SELECT match_id, rn, CASE WHEN keep THEN nlo ELSE lo END, CASE WHEN keep THEN nhi ELSE hi END, CASE WHEN keep THEN nf ELSE lf END, keep FROM (SELECT tu.match_id, tu.rn, du.lo, du.hi, du.lf, tu.lo AS nlo, tu.hi AS nhi, tu.nf, NOT (tu.lo = du.lo AND tu.hi = du.hi AND (tu.nf - du.lf) / 2.0 <= 10) AS keep FROM du JOIN tu ON tu.match_id = du.match_id AND tu.rn = du.rn + 1)),
ev AS (SELECT match_id, kind, end_frame AS frame, a, b, travelled, progressive, into_third FROM kinds WHERE kind = 'pass' UNION ALL SELECT match_id, kind, nf, a, b, travelled, progressive, into_third FROM tu JOIN du USING (match_id, rn) WHERE keep)"""

_SHOTS = f"""en AS (SELECT match_id, owner AS player, team, end_frame AS frame, CAST(coalesce(lead(start_frame) OVER (PARTITION BY match_id ORDER BY start_frame), trunc(end_frame + 6.0)) AS BIGINT) AS until, ex, ey FROM sp),
ix AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) - 1 AS pos FROM b), lx AS (SELECT match_id, max(pos) AS lastp FROM ix GROUP BY match_id),
fx AS (SELECT en.*, ix.pos FROM en ASOF LEFT JOIN ix ON en.match_id = ix.match_id AND en.frame <= ix.frame),
jx AS (SELECT fx.*, o.frame AS f0, o.x AS x0, o.y AS y0, z.frame AS f1, z.x AS x1, z.y AS y1 FROM fx JOIN lx USING (match_id) LEFT JOIN ix o ON o.match_id = fx.match_id AND o.pos = fx.pos LEFT JOIN ix z ON z.match_id = fx.match_id AND z.pos = least(fx.pos + 10, lastp)),
wx AS (SELECT jx.*, l.frame AS lfr, l.x AS lx_, l.y AS ly_, CASE WHEN f1 > f0 THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / ((f1 - f0) / 2.0) ELSE 0 END AS ball_speed, CASE WHEN jx.team = 'left' THEN 1 ELSE -1 END AS sg, coalesce(x0, ex) AS px, coalesce(y0, ey) AS py FROM jx ASOF JOIN b l ON l.match_id = jx.match_id AND jx.until >= l.frame),
ox AS (SELECT *, CASE WHEN (lx_ - px) * sg > 0 THEN abs(py + (sg * 52.5 - px) / (lx_ - px) * (ly_ - py)) END AS off FROM wx WHERE lfr > frame),
sh AS (SELECT match_id, player, team, frame, ball_speed, off AS "offset", off <= 3.66 AS on_target FROM ox WHERE ball_speed >= 1 AND px * sg >= 0 AND off <= 33.66)"""


def spells(spark: SparkSession, sf: str) -> DataFrame:
    return E.spells(ball(spark, sf), M, "owner", gap=12, least=1)


def pair_events(spark: SparkSession, sf: str, own: DataFrame | None = None) -> DataFrame:
    p = E.spell_pairs(spells(spark, sf) if own is None else own, ball(spark, sf), M)
    return E.classify_pairs(p, 2.0).where("kind is not null").select("match_id", "kind", "frame", "a", "b", "travelled", "progressive", "into_final_third")


@query(f"WITH {_PAIRS} SELECT match_id, kind, CASE WHEN kind = 'pass' THEN end_frame ELSE nf END AS frame, a, b, travelled, progressive, into_third AS into_final_third FROM kinds WHERE kind IS NOT NULL")
def chain_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Passes, tackles and interceptions from pairs of spells."""
    return pair_events(spark, sf)


@query(f"WITH {_PAIRS} SELECT a, b, count(*) AS passes, avg(travelled) AS mean_m, count(*) FILTER (progressive) AS progressive FROM kinds WHERE kind = 'pass' GROUP BY a, b")
def pass_network(spark: SparkSession, sf: str) -> DataFrame:
    """Passes from one to another."""
    return pair_events(spark, sf).where("kind = 'pass'").groupBy("a", "b").agg(F.count("*").alias("passes"), F.avg("travelled").alias("mean_m"), F.count_if("progressive").alias("progressive"))


def duels(spark: SparkSession, sf: str, own: DataFrame | None = None) -> DataFrame:
    return E.suppress_duels(pair_events(spark, sf, own), M, 2.0, 10.0)


def struck(spark: SparkSession, sf: str, own: DataFrame | None = None) -> DataFrame:
    return E.shots(spells(spark, sf) if own is None else own, ball(spark, sf), M, 2.0, speed=1.0, min_x=0.0, margin=30.0)


def goals(spark: SparkSession, sf: str, struck: DataFrame, duels: DataFrame) -> DataFrame:
    """Goals with the last shot of the side within 60 frames before, and the last pass to that player within 60 frames before."""
    found = detections(spark, sf).where("kind = 'error'").select("match_id", "event_id", "team", "frame")
    by = struck.select("match_id", "team", "frame", F.col("player").alias("scorer"))
    g = J.last_before(found, by, ["match_id", "team"], "frame", 60, ["event_id"]).drop("found_frame")
    given = duels.where("kind = 'pass'").select("match_id", F.col("b").alias("scorer"), "frame", F.col("a").alias("assist"))
    return J.last_before(g, given, ["match_id", "scorer"], "frame", 60, ["event_id"]).select("match_id", "event_id", "team", "frame", "scorer", "assist")


_GOALS = f"""{_DUELS}, {_SHOTS}, g0 AS (SELECT match_id, event_id, team, frame FROM d WHERE kind = 'error'),
g1 AS (SELECT * FROM (SELECT g0.*, sh.player AS scorer, row_number() OVER (PARTITION BY event_id ORDER BY sh.frame DESC, sh.player) AS rn FROM g0 LEFT JOIN sh ON g0.match_id = sh.match_id AND g0.team = sh.team AND g0.frame - sh.frame BETWEEN 0 AND 60) WHERE rn = 1),
go AS (SELECT match_id, event_id, team, frame, scorer, assist FROM (SELECT g1.* EXCLUDE (rn), ev.a AS assist, row_number() OVER (PARTITION BY event_id ORDER BY ev.frame DESC, ev.a) AS rn FROM g1 LEFT JOIN ev ON ev.kind = 'pass' AND ev.match_id = g1.match_id AND ev.b = g1.scorer AND g1.frame - ev.frame BETWEEN 0 AND 60) WHERE rn = 1)"""
_TALLY = f"""{_GOALS}, cr AS (SELECT *, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS far FROM sp),
ra AS (SELECT match_id, owner AS player, 1 AS touches, 0 AS pa, 0 AS co, 0 AS re, 0 AS pr, 0 AS ft, 0 AS lo, 0 AS i, 0 AS ta, 0 AS di, 0 AS st, 0 AS ot, 0 AS gl, 0 AS ac, CASE WHEN far >= 4 THEN 1 ELSE 0 END AS ca, CASE WHEN far >= 4 THEN far ELSE 0 END AS cd, (end_frame - start_frame + 1) / 2.0 AS po FROM cr
UNION ALL SELECT match_id, a, 0, CASE WHEN kind = 'tackle' THEN 0 ELSE 1 END, CASE WHEN kind = 'pass' THEN 1 ELSE 0 END, 0, CASE WHEN kind = 'pass' AND progressive THEN 1 ELSE 0 END, CASE WHEN kind = 'pass' AND into_third THEN 1 ELSE 0 END, CASE WHEN kind = 'pass' THEN 0 ELSE 1 END, 0, 0, CASE WHEN kind = 'tackle' THEN 1 ELSE 0 END, 0, 0, 0, 0, 0, 0, 0 FROM ev
UNION ALL SELECT match_id, b, 0, 0, 0, CASE WHEN kind = 'pass' THEN 1 ELSE 0 END, 0, 0, 0, CASE WHEN kind = 'interception' THEN 1 ELSE 0 END, CASE WHEN kind = 'tackle' THEN 1 ELSE 0 END, 0, 0, 0, 0, 0, 0, 0, 0 FROM ev
UNION ALL SELECT match_id, player, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, CASE WHEN on_target THEN 1 ELSE 0 END, 0, 0, 0, 0, 0 FROM sh
UNION ALL SELECT match_id, scorer, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0 FROM go WHERE scorer IS NOT NULL UNION ALL SELECT match_id, assist, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0 FROM go WHERE assist IS NOT NULL)"""
_SUMS = "CAST(sum(touches) AS BIGINT) AS touches, CAST(sum(pa) AS BIGINT) AS passes, CAST(sum(co) AS BIGINT) AS passes_completed, CAST(sum(re) AS BIGINT) AS passes_received, CAST(sum(pr) AS BIGINT) AS progressive_passes, CAST(sum(ft) AS BIGINT) AS passes_into_final_third, CAST(sum(lo) AS BIGINT) AS losses, CAST(sum(i) AS BIGINT) AS interceptions, CAST(sum(ta) AS BIGINT) AS tackles, CAST(sum(di) AS BIGINT) AS dispossessed, CAST(sum(st) AS BIGINT) AS shots, CAST(sum(ot) AS BIGINT) AS shots_on_target, CAST(sum(gl) AS BIGINT) AS goals, CAST(sum(ac) AS BIGINT) AS assists, CAST(sum(ca) AS BIGINT) AS carries, sum(cd) AS carry_distance_m, sum(po) AS possession_time_s, CASE WHEN sum(pa) > 0 THEN sum(co) / sum(pa) END AS pass_accuracy"


@query(f"WITH RECURSIVE {_DUELS} SELECT match_id, kind, frame, a, b, travelled, progressive, into_third AS into_final_third FROM ev")
def duel_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated duels, anchored on the last one counted."""
    return duels(spark, sf)


@query(f"WITH {_SPELLS}, {_SHOTS} SELECT * FROM sh")
def shots(spark: SparkSession, sf: str) -> DataFrame:
    """Shots from spell ends."""
    return struck(spark, sf)


@query(f"WITH RECURSIVE {_GOALS} SELECT match_id, event_id, scorer, assist FROM go")
def goal_credits(spark: SparkSession, sf: str) -> DataFrame:
    """Who scored, and who passed to the scorer."""
    own = held(spells(spark, sf))
    return goals(spark, sf, struck(spark, sf, own), duels(spark, sf, own)).select("match_id", "event_id", "scorer", "assist")


def player_sums(spark: SparkSession, sf: str) -> DataFrame:
    own = held(spells(spark, sf))
    turns, hit = held(duels(spark, sf, own)), held(struck(spark, sf, own))
    return E.tallies(own, turns, hit, goals(spark, sf, hit, turns), M, 2.0)


@query(f"WITH RECURSIVE {_TALLY} SELECT match_id, player, {_SUMS} FROM ra GROUP BY match_id, player")
def player_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """All seventeen counters of every player."""
    return player_sums(spark, sf)


@query(f"WITH RECURSIVE {_TALLY}, me AS (SELECT DISTINCT match_id, track_id AS player, team FROM d) SELECT match_id, me.team, {_SUMS} FROM ra JOIN me USING (match_id, player) GROUP BY match_id, me.team")
def team_tallies(spark: SparkSession, sf: str) -> DataFrame:
    """Sums over a side's members, accuracy from the sums."""
    members = detections(spark, sf).select("match_id", F.col("track_id").alias("player"), "team").distinct()
    return E.team_tallies(player_sums(spark, sf), members, M)


@query(f"""WITH RECURSIVE {_GOALS}, n AS (SELECT match_id, count(*) FILTER (team = 'left') AS l, count(*) FILTER (team = 'right') AS r FROM go GROUP BY match_id), m AS (SELECT DISTINCT match_id FROM d), s AS (SELECT DISTINCT match_id FROM d WHERE k % 50 = 0)
SELECT match_id, coalesce(l, 0) AS "left", coalesce(r, 0) AS "right", CASE WHEN s.match_id IS NOT NULL THEN 'scoreboard' WHEN n.match_id IS NOT NULL THEN 'ball_position' ELSE 'none' END AS source FROM m LEFT JOIN n USING (match_id) LEFT JOIN s USING (match_id)""")
def goal_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Goals of the footage and the source of the score."""
    d = detections(spark, sf)
    own = held(spells(spark, sf))
    return E.score_of_goals(goals(spark, sf, struck(spark, sf, own), duels(spark, sf, own)), d.select("match_id").distinct(), d.where("k % 50 = 0").select("match_id"), M)


@query(f"WITH {ROWS}, b0 AS (SELECT match_id, frame, event_id, CASE WHEN k % 7 <> 0 THEN k % 4 END AS home, k % 3 AS away FROM d WHERE kind = 'click'), r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame DESC, event_id) AS rn FROM b0) SELECT match_id, coalesce(home, 0) AS home, coalesce(away, 0) AS away, frame FROM r WHERE rn = 1")
def standing_score(spark: SparkSession, sf: str) -> DataFrame:
    """The last score that the board showed."""
    d, k = detections(spark, sf).where("kind = 'click'"), F.col("k")
    return E.standing_score(d.select("match_id", "frame", F.col("event_id").alias("row"), F.when(k % 7 != 0, k % 4).alias("home"), (k % 3).alias("away")), M)


# ------------------------------------------------------------------ blocks of the second ledger
_TYPES = ["touch", "carry", "pass", "reception", "loss", "recovery", "interception", "challenge", "shot", "phase"]


def ledger_events(spark: SparkSession, sf: str) -> DataFrame:
    """The tracking rows as ledger events with attributes, some of them missing."""
    d, k = detections(spark, sf), F.col("k")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("event_id") % len(_TYPES) + 1).cast("int"))
    outcome = F.when(k % 3 == 0, "complete").when(k % 3 == 1, "incomplete").otherwise("lost")
    return d.select("match_id", F.col("track_id").alias("player"), F.when(k % 8 != 0, F.col("team")).alias("team"), kind.alias("type"), outcome.alias("outcome"), ((k % 9) / 2.0).alias("duration_s"), F.when(k % 5 != 0, F.abs("x")).alias("length_m"), F.when(k % 6 != 0, F.abs("y")).alias("distance_m"), F.when(k % 7 != 0, F.col("x") / 2).alias("progressive_m"), (k % 2 == 0).alias("contested"), F.when(k % 4 != 0, k % 3 == 0).alias("in_box"), F.when(k % 11 != 0, k % 4 == 0).alias("progressive"), (k % 5 < 2).alias("forward"), (k % 6 == 0).alias("into_final_third"), (k % 10 == 0).alias("into_box"))


_LEDGER = f"""{ROWS}, le AS (SELECT match_id, track_id AS player, CASE WHEN k % 8 <> 0 THEN team END AS team, [{', '.join(f"'{t}'" for t in _TYPES)}][event_id % {len(_TYPES)} + 1] AS type, CASE k % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'incomplete' ELSE 'lost' END AS outcome, (k % 9) / 2.0 AS duration_s, CASE WHEN k % 5 <> 0 THEN abs(x) END AS length_m, CASE WHEN k % 6 <> 0 THEN abs(y) END AS distance_m, CASE WHEN k % 7 <> 0 THEN x / 2 END AS progressive_m,
k % 2 = 0 AS contested, CASE WHEN k % 4 <> 0 THEN k % 3 = 0 END AS in_box, CASE WHEN k % 11 <> 0 THEN k % 4 = 0 END AS progressive, k % 5 < 2 AS forward, k % 6 = 0 AS into_final_third, k % 10 = 0 AS into_box FROM d)"""


@query(f"""WITH {_LEDGER} SELECT match_id, player, count(*) FILTER (type = 'touch') AS touches, count(*) FILTER (type = 'touch' AND contested) AS touches_contested, coalesce(sum(duration_s) FILTER (type = 'touch'), 0) AS time_on_ball_s, count(*) FILTER (type = 'reception') AS receptions, count(*) FILTER (type = 'reception' AND in_box) AS receptions_in_box, count(*) FILTER (type = 'carry') AS carries,
coalesce(sum(coalesce(distance_m, 0)) FILTER (type = 'carry'), 0) AS carry_distance_m, coalesce(sum(greatest(coalesce(progressive_m, 0), 0)) FILTER (type = 'carry'), 0) AS carry_progressive_m, count(*) FILTER (type = 'carry' AND progressive) AS progressive_carries, count(*) FILTER (type = 'shot') AS shots FROM le GROUP BY match_id, player""")
def on_ball_block(spark: SparkSession, sf: str) -> DataFrame:
    """Touches, receptions, carries and shots."""
    return E.on_ball(ledger_events(spark, sf), M)


@query(f"""WITH {_LEDGER} SELECT match_id, player, count(*) AS attempted, count(*) FILTER (outcome = 'complete') AS completed, count(*) FILTER (outcome = 'complete') / count(*) AS accuracy, count(*) FILTER (forward) AS forward, count(*) FILTER (progressive) AS progressive, sum(CASE WHEN outcome = 'complete' THEN greatest(coalesce(progressive_m, 0), 0) ELSE 0 END) AS progressive_m,
count(*) FILTER (into_final_third) AS into_final_third, count(*) FILTER (into_box) AS into_box, avg(coalesce(length_m, 0)) AS avg_length_m, count(*) FILTER (coalesce(length_m, 0) >= 25) AS long_passes, sum(coalesce(length_m, 0)) AS total_length_m FROM le WHERE type = 'pass' GROUP BY match_id, player""")
def passing_block(spark: SparkSession, sf: str) -> DataFrame:
    """Passes, their lengths and their progress."""
    return E.passing(ledger_events(spark, sf), M)


@query(f"""WITH {_LEDGER} SELECT match_id, player, count(*) FILTER (type = 'loss') AS losses, count(*) FILTER (type = 'recovery') AS recoveries, count(*) FILTER (type = 'interception') AS interceptions, count(*) FILTER (type = 'challenge') AS challenges, count(*) FILTER (type = 'challenge' AND outcome = 'lost') AS challenges_lost FROM le GROUP BY match_id, player""")
def defensive_block(spark: SparkSession, sf: str) -> DataFrame:
    """A10: losses, recoveries, interceptions and challenges."""
    return E.defensive(ledger_events(spark, sf), M)


@query(f"""WITH {_LEDGER}, pl AS (SELECT DISTINCT match_id, track_id AS player, CASE WHEN track_id % 3 <> 0 THEN track_id % 30 END AS number, CASE WHEN track_id % 17 = 0 THEN 'referee' ELSE 'player' END AS role FROM d), kn AS (SELECT *, number IS NOT NULL AS named FROM pl WHERE role <> 'referee'),
h AS (SELECT match_id, count(*) FILTER (named) AS identified_players, count(*) FILTER (NOT named) AS anonymous_fragments FROM kn GROUP BY match_id), o AS (SELECT le.match_id, count(*) AS n, count(*) FILTER (named) AS a FROM le LEFT JOIN kn USING (match_id, player) WHERE type <> 'phase' GROUP BY le.match_id)
SELECT match_id, identified_players, anonymous_fragments, coalesce(n, 0) AS on_ball_events, coalesce(a, 0) AS attributed, CASE WHEN n > 0 THEN a / n END AS attributed_share FROM h LEFT JOIN o USING (match_id)""")
def identification_share(spark: SparkSession, sf: str) -> DataFrame:
    """How much of the report is about named players."""
    t = F.col("track_id")
    players = detections(spark, sf).select("match_id", t.alias("player"), F.when(t % 3 != 0, t % 30).alias("number"), F.when(t % 17 == 0, "referee").otherwise("player").alias("role")).distinct()
    return E.identification(players, ledger_events(spark, sf), M)


@query(f"""WITH {_LEDGER}, g AS (SELECT match_id, team, coalesce(sum(duration_s) FILTER (type = 'phase'), 0) AS possession_s, count(*) FILTER (type = 'phase') AS phases, count(*) FILTER (type = 'touch') AS touches, count(*) FILTER (type = 'pass') AS passes, count(*) FILTER (type = 'pass' AND outcome = 'complete') AS done, count(*) FILTER (type = 'shot') AS shots FROM le GROUP BY match_id, team), w AS (SELECT *, sum(possession_s) OVER (PARTITION BY match_id) AS tot FROM g)
SELECT match_id, team, possession_s, phases, touches, passes, shots, possession_s / CASE WHEN tot > 0 THEN tot ELSE 1 END AS possession_share, CASE WHEN passes > 0 THEN done / passes END AS pass_accuracy FROM w WHERE team IS NOT NULL""")
def side_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of a side, its share against the time of all sides, unknown ones too."""
    return E.side_totals(ledger_events(spark, sf), M)


@query(f"WITH {_SPELLS} SELECT match_id, owner, start_frame, end_frame, sqrt((ex - sx) ** 2 + (ey - sy) ** 2) AS distance_m FROM sp WHERE sqrt((ex - sx) ** 2 + (ey - sy) ** 2) >= 4")
def carries(spark: SparkSession, sf: str) -> DataFrame:
    """Spells whose ends lie apart."""
    return E.carries(spells(spark, sf)).select("match_id", "owner", "start_frame", "end_frame", "distance_m")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    b = ball(spark, sf)
    rows = b.select("match_id", "frame", F.when(F.col("x") > 0, F.col("owner") % 5).otherwise(-1).alias("holder"), F.when(F.col("owner") % 5 % 2 == 0, "left").otherwise("right").alias("team"), "x", "y", (F.abs("y") < 5).alias("contested"), (F.abs("y") / 14).alias("dist"))
    return E.held_runs(rows, M, 2.0, 0.5)


_RUNS = f"""{BALL}, h0 AS (SELECT match_id, frame, x, y, CASE WHEN x > 0 THEN owner % 5 ELSE -1 END AS holder, CASE WHEN owner % 5 % 2 = 0 THEN 'left' ELSE 'right' END AS team, abs(y) < 5 AS contested, abs(y) / 14 AS dist FROM b),
h1 AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY frame) AS r FROM (SELECT *, CASE WHEN lag(holder) OVER (PARTITION BY match_id ORDER BY frame) IS DISTINCT FROM holder THEN 1 ELSE 0 END AS n FROM h0)),
h2 AS (SELECT * REPLACE (CASE WHEN (max(frame) OVER (PARTITION BY match_id, r) - min(frame) OVER (PARTITION BY match_id, r) + 1) / 2.0 < 0.5 THEN -1 ELSE holder END AS holder) FROM h1),
h3 AS (SELECT *, sum(m) OVER (PARTITION BY match_id ORDER BY frame) AS q FROM (SELECT *, CASE WHEN lag(holder) OVER (PARTITION BY match_id ORDER BY frame) IS DISTINCT FROM holder THEN 1 ELSE 0 END AS m FROM h2)),
runs AS (SELECT match_id, holder, q, min(frame) AS start_frame, max(frame) AS end_frame, bool_or(contested) AS contested, avg(dist) AS mean_dist, arg_min(x, frame) AS sx, arg_min(y, frame) AS sy, arg_max(x, frame) AS ex, arg_max(y, frame) AS ey, max(team) AS team, count(*) AS frames FROM h3 GROUP BY match_id, holder, q)"""


@query(f"WITH {_RUNS} SELECT match_id, holder, start_frame, end_frame, contested, mean_dist, frames FROM runs")
def held_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a holder, short ones demoted, equal neighbours merged."""
    return _runs(spark, sf).select("match_id", F.col("holder").cast("long"), "start_frame", "end_frame", "contested", "mean_dist", "frames")


@query(f"""WITH {_RUNS}, r AS (SELECT *, CASE WHEN holder <> -1 THEN team END AS side FROM runs), c AS (SELECT *, sum(n) OVER (PARTITION BY match_id ORDER BY start_frame) AS i FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(side) OVER w IS DISTINCT FROM side THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY match_id ORDER BY start_frame))),
p AS (SELECT match_id, side, min(start_frame) AS start_frame, max(end_frame) AS last_frame FROM c GROUP BY match_id, i, side) SELECT match_id, side, start_frame, coalesce(lead(start_frame) OVER (PARTITION BY match_id ORDER BY start_frame), last_frame) AS end_frame FROM p""")
def possession_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Phases of a side; a phase ends where the next begins."""
    return E.phases(_runs(spark, sf), M)


@query(f"""WITH {_RUNS}, h AS (SELECT *, lead(holder) OVER w AS nh, lead(team) OVER w AS nt, lead(start_frame) OVER w AS nf, lead(sx) OVER w AS nx, lead(sy) OVER w AS ny FROM runs WHERE holder <> -1 WINDOW w AS (PARTITION BY match_id ORDER BY start_frame)),
t AS (SELECT *, sqrt((nx - ex) ** 2 + (ny - ey) ** 2) AS travel, CASE WHEN team = 'left' THEN 1 ELSE -1 END AS sg FROM h WHERE nh IS NOT NULL),
v AS (SELECT *, CASE WHEN nf > end_frame THEN travel / ((nf - end_frame) / 2.0) ELSE 0 END AS speed FROM t),
k AS (SELECT *, CASE WHEN holder = nh THEN 'carry' WHEN travel < 6 AND team = nt THEN 'kept' WHEN travel < 6 THEN 'lost' WHEN team <> nt AND speed >= 12 AND nx * sg > ex * sg AND abs(nx) > 40.5 AND abs(ny) < 12 AND ex * sg > 17.5 THEN 'shot' WHEN team = nt THEN 'complete' ELSE 'incomplete' END AS w FROM v),
e AS (SELECT match_id, CASE w WHEN 'carry' THEN 'carry' WHEN 'kept' THEN 'challenge' WHEN 'lost' THEN 'challenge' WHEN 'shot' THEN 'shot' ELSE 'pass' END AS kind, holder AS player, end_frame AS frame, CASE w WHEN 'carry' THEN 'bridged' WHEN 'shot' THEN NULL ELSE w END AS outcome FROM k
UNION ALL SELECT match_id, 'loss', holder, end_frame, NULL FROM k WHERE w IN ('lost', 'incomplete') UNION ALL SELECT match_id, CASE w WHEN 'lost' THEN 'recovery' WHEN 'complete' THEN 'reception' ELSE 'interception' END, nh, nf, NULL FROM k WHERE w IN ('lost', 'complete', 'incomplete'))
SELECT * FROM e""")
def run_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Events between held runs."""
    return E.run_transitions(_runs(spark, sf), M, 2.0).select("match_id", "kind", F.col("player").cast("long"), "frame", "outcome")


@query(f"""WITH {_RUNS}, la AS (SELECT * FROM (SELECT match_id, holder, team, end_frame, ex, ey, row_number() OVER (PARTITION BY match_id ORDER BY start_frame DESC) AS rn FROM runs WHERE holder <> -1) WHERE rn = 1), ta AS (SELECT match_id, count(*) AS n, max(b.frame) AS f, arg_max(b.x, b.frame) AS x, arg_max(b.y, b.frame) AS y FROM b JOIN la USING (match_id) WHERE b.frame >= la.end_frame GROUP BY match_id), j AS (SELECT la.*, n, f, x, y, sqrt((x - ex) ** 2 + (y - ey) ** 2) AS travel, CASE WHEN team = 'left' THEN 1 ELSE -1 END AS sg FROM la JOIN ta USING (match_id) WHERE n >= 2)
SELECT match_id, 'shot' AS kind, holder AS player, end_frame AS frame, travel, 0.35 AS confidence FROM j WHERE f > end_frame AND travel / ((f - end_frame) / 2.0) >= 0.5 AND x * sg > ex * sg AND abs(x) > 0 AND abs(y) < 40 AND ex * sg > -60""")
def trailing_shots(spark: SparkSession, sf: str) -> DataFrame:
    """A shot after which the footage ends."""
    out = E.trailing_shots(_runs(spark, sf), ball(spark, sf), M, 2.0, shot_speed=0.5, least_rows=2, final_third=-60.0, near_goal=0.0, half_width=40.0)
    return out.withColumn("player", F.col("player").cast("long"))


@query(f"WITH {_RUNS} SELECT match_id, holder, start_frame, 0.35 + 0.45 * (1 - least(mean_dist / 2.5, 1)) + 0.2 * least((end_frame - start_frame + 1) / 2.0 / 2.0, 1) AS confidence FROM runs WHERE holder <> -1")
def touch_confidence(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence of touches."""
    r = _runs(spark, sf).where("holder <> -1")
    return r.select("match_id", F.col("holder").cast("long"), "start_frame", E.touch_confidence(F.col("mean_dist"), (F.col("end_frame") - F.col("start_frame") + 1) / 2.0).alias("confidence"))


# ------------------------------------------------------------------ kernels without SQL
@query(None)
def longest_reachable_run(spark: SparkSession, sf: str) -> DataFrame:
    """The longest physically possible chain of each segment."""
    return P.clean_tracks(ball(spark, sf), M, P.Body(30.0, 5.0), gap=50).drop("interpolated")


@query(None)
def clean_ball(spark: SparkSession, sf: str) -> DataFrame:
    """O2: segments, longest run, interpolation, smoothing, and the run again, in one pass."""
    return P.clean_tracks(ball(spark, sf), M, P.Body(30.0, 5.0), gap=50, fill=12, smooth=True, again=True)


@query(None)
def clean_players(spark: SparkSession, sf: str) -> DataFrame:
    """O3: player tracks without interpolation; segments of two samples stay whole."""
    return P.clean_tracks(track_points(spark, sf), ["match_id", "track_id"], P.Body(11.0, 25.0, lookback=240), gap=240, smooth=True, least=3).drop("interpolated")


@query(f"""WITH RECURSIVE {ROWS}, c AS (SELECT match_id, frame, list({{'s': CAST(k AS DOUBLE), 'x': x, 'y': y}} ORDER BY k DESC, x, y) AS l FROM d GROUP BY match_id, frame), f AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS rn FROM c),
g AS (SELECT match_id, rn, frame, l[1] AS p, true AS hit FROM f WHERE rn = 1 UNION ALL
  SELECT match_id, rn, CASE WHEN n IS NULL THEN last ELSE frame END, CASE WHEN n IS NULL THEN p ELSE n END, n IS NOT NULL FROM (SELECT f.match_id, f.rn, f.frame, g.frame AS last, g.p, coalesce(list_filter(f.l, lambda q: sqrt((q.x - g.p.x) ** 2 + (q.y - g.p.y) ** 2) <= 20.0 / 2.0 * (f.frame - g.frame) + 5)[1], CASE WHEN f.frame - g.frame > 8 THEN f.l[1] END) AS n FROM g JOIN f ON f.match_id = g.match_id AND f.rn = g.rn + 1))
SELECT match_id, frame, p.x AS x, p.y AS y, p.s AS score FROM g WHERE hit""")
def image_ball_track(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate per frame behind a speed gate."""
    d = detections(spark, sf).select("match_id", "frame", "x", "y", F.col("k").cast("double").alias("score"))
    return N.gate_candidates(d, M, 20.0, 2.0, slack=5.0, reacquire=8)


@query(f"""WITH RECURSIVE {BALL}, s0 AS (SELECT *, first_value(frame) OVER w AS f0, last_value(frame) OVER w AS f1, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1, first_value(y) OVER w AS y0, last_value(y) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY match_id ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
s1 AS (SELECT match_id, frame, CASE WHEN f1 > f0 THEN sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) / ((f1 - f0) / 2.0) ELSE 0 END AS v FROM s0),
t AS (SELECT match_id, row_number() OVER w - 1 AS i, lead(frame, 4) OVER w - frame AS df, lead(v, 4) OVER w - v AS dv FROM s1 WINDOW w AS (PARTITION BY match_id ORDER BY frame)), u AS (SELECT match_id, i, CASE WHEN df > 0 THEN dv / (df / 2.0) ELSE 0 END AS a FROM t WHERE df IS NOT NULL),
r AS (SELECT match_id, i, a FROM u WHERE i = 0 UNION ALL SELECT u.match_id, u.i, u.a FROM r JOIN u ON u.match_id = r.match_id AND u.i = r.i + CASE WHEN abs(r.a) >= 2 THEN 4 ELSE 1 END)
SELECT m.match_id, count(*) FILTER (a >= 2) AS accelerations, count(*) FILTER (a <= -2) AS decelerations, coalesce(max(a) FILTER (abs(a) >= 2), 0) AS peak FROM (SELECT DISTINCT match_id FROM s1) m LEFT JOIN r ON r.match_id = m.match_id GROUP BY m.match_id""")
def accelerations(spark: SparkSession, sf: str) -> DataFrame:
    """Accelerations that do not overlap."""
    return N.count_accelerations(T.speeds(ball(spark, sf), M, 2.0), M, 2.0, span_s=2.0)


@query(f"""WITH RECURSIVE {ROWS}, e AS (SELECT match_id, event_id AS frame, k % 3 AS h, k % 2 AS a, row_number() OVER (PARTITION BY match_id ORDER BY event_id) AS rn FROM d),
r AS (SELECT match_id, rn, CAST(NULL AS INTEGER) AS lh, CAST(NULL AS INTEGER) AS la, frame AS wf, h AS wh, a AS wa, CAST(NULL AS BIGINT) AS out FROM e WHERE rn = 1 UNION ALL
  SELECT match_id, rn, CASE WHEN st = 2 THEN wh ELSE lh END, CASE WHEN st = 2 THEN wa ELSE la END, CASE st WHEN 0 THEN wf WHEN 3 THEN frame END, CASE st WHEN 0 THEN wh WHEN 3 THEN h END, CASE st WHEN 0 THEN wa WHEN 3 THEN a END, CASE WHEN st = 2 THEN wf END
  FROM (SELECT e.*, r.lh, r.la, r.wf, r.wh, r.wa, CASE WHEN lh IS NOT NULL AND (e.h < lh OR e.a < la) THEN 0 WHEN lh IS NOT NULL AND e.h = lh AND e.a = la THEN 1 WHEN wf IS NOT NULL AND wh = e.h AND wa = e.a THEN 2 ELSE 3 END AS st FROM r JOIN e ON e.match_id = r.match_id AND e.rn = r.rn + 1))
SELECT match_id, out AS frame, lh AS home, la AS away FROM r WHERE out IS NOT NULL""")
def confirmed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Monotone score timeline with two readings."""
    d = detections(spark, sf).select("match_id", F.col("event_id").alias("frame"), (F.col("k") % 3).alias("home"), (F.col("k") % 2).alias("away"))
    return N.score_timeline(d, M)


@query(f"""WITH RECURSIVE {ROWS}, e AS (SELECT match_id, kind, frame, row_number() OVER (PARTITION BY match_id, kind ORDER BY frame) AS rn FROM d WHERE kind = 'error'),
r AS (SELECT match_id, kind, frame, rn, frame AS last, true AS keep FROM e WHERE rn = 1 UNION ALL SELECT e.match_id, e.kind, e.frame, e.rn, CASE WHEN e.frame - r.last > 30 THEN e.frame ELSE r.last END, e.frame - r.last > 30 FROM r JOIN e ON e.match_id = r.match_id AND e.kind = r.kind AND e.rn = r.rn + 1) SELECT match_id, kind, frame FROM r WHERE keep""")
def card_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Events within a window of the last one kept go."""
    return N.debounce(detections(spark, sf).where("kind = 'error'").select("match_id", "kind", "frame"), ["match_id", "kind"], "frame", 30.0)


@query(f"""WITH RECURSIVE {ROWS}, b0 AS (SELECT event_id AS id, match_id, frame // 10 AS frame, x + 60 AS bx, y + 40 AS b_y, k % 30 + 10.0 AS bw, k % 20 + 20.0 AS bh, team, CAST(k AS DOUBLE) AS score FROM d), e AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame ORDER BY score DESC, bx, b_y) AS rn FROM b0),
r AS (SELECT e.*, [{{'x': bx, 'y': b_y, 'w': bw, 'h': bh}}] AS kept, true AS keep FROM e WHERE rn = 1 UNION ALL SELECT id, match_id, frame, bx, b_y, bw, bh, team, score, rn, CASE WHEN ok THEN list_append(kept, {{'x': bx, 'y': b_y, 'w': bw, 'h': bh}}) ELSE kept END, ok FROM (SELECT e.*, r.kept, len(list_filter(r.kept, lambda q: greatest(least(q.x + q.w, e.bx + e.bw) - greatest(q.x, e.bx), 0) * greatest(least(q.y + q.h, e.b_y + e.bh) - greatest(q.y, e.b_y), 0) > 0.3 * (q.w * q.h + e.bw * e.bh - greatest(least(q.x + q.w, e.bx + e.bw) - greatest(q.x, e.bx), 0) * greatest(least(q.y + q.h, e.b_y + e.bh) - greatest(q.y, e.b_y), 0)))) = 0 AS ok FROM r JOIN e ON e.match_id = r.match_id AND e.frame = r.frame AND e.rn = r.rn + 1))
SELECT id, match_id, frame, bx, b_y AS "by", bw, bh, team, score FROM r WHERE keep""")
def box_suppression(spark: SparkSession, sf: str) -> DataFrame:
    """greedy suppression of overlapping boxes."""
    return N.non_maximum_suppression(boxes(spark, sf), ["match_id", "frame"], 0.3, ["id"])


@query(None)
def linear_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """One-to-one matches of two kinds of points per half-hour."""
    d = detections(spark, sf).withColumn("slot", F.floor(F.col("frame") / 30))
    a = d.where("kind = 'click'").select("match_id", "slot", F.col("event_id").alias("a"), "x", "y")
    b = d.where("kind = 'view'").select("match_id", "slot", F.col("event_id").alias("b"), "x", "y")
    return N.assign_points(a, b, ["match_id", "slot"], 40.0)


@query(None)
def kit_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted two-means on descriptors."""
    d = detections(spark, sf).groupBy("match_id", "track_id").agg(F.avg("x").alias("l"), F.avg("y").alias("a"), (F.avg("k") + F.when(F.col("track_id") % 2 == 0, 500).otherwise(0)).alias("b"), F.count("*").cast("double").alias("w"))
    return N.cluster_kits(d, M, ["l", "a", "b"], "w")


@query(None)
def identity_solver(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks merged by appearance, best pairs first, unless sides or times forbid it."""
    d = detections(spark, sf).groupBy("match_id", "track_id", "team").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.avg("x").alias("v0"), F.avg("y").alias("v1"), F.avg("k").alias("v2"))
    return N.solve_identities(d, M, vector=["v0", "v1", "v2"])


@query(None)
def id_switch_split(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks cut at gaps where the majority changes."""
    return N.split_switches(detections(spark, sf).select("track_id", (F.col("match_id") * 1440 + F.col("frame")).cast("long").alias("frame"), "kind"), ["track_id"], "kind", 600)


@query(None)
def diverse_views(spark: SparkSession, sf: str) -> DataFrame:
    """Best views that are neither near nor alike."""
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") * 100.0).alias("time_ms"), ((F.col("vec_id") * 37) % 101 / 101.0).alias("score"), "embedding")
    return N.select_views(e, ["label"], "time_ms", "score", "embedding").select("label", "time_ms", "score")


@query(f"WITH {ROWS}, r AS (SELECT track_id, match_id, frame // 60 AS hour, event_id, x, row_number() OVER (PARTITION BY track_id, match_id, frame // 60 ORDER BY x DESC, event_id) AS rn FROM d), q AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY x DESC, event_id) AS rk FROM r WHERE rn = 1) SELECT track_id, event_id FROM q WHERE rk <= 10")
def stratified_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Best per bucket, then the best ten."""
    d = detections(spark, sf)
    one = F.row_number().over(Window.partitionBy("track_id", "match_id", F.floor(F.col("frame") / 60)).orderBy(F.col("x").desc(), "event_id"))
    best = F.row_number().over(Window.partitionBy("track_id").orderBy(F.col("x").desc(), "event_id"))
    return d.withColumn("rn", one).where("rn = 1").withColumn("rk", best).where("rk <= 10").select("track_id", "event_id")
