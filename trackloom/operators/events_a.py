"""Possession spells and the event ledgers derived from them.

Two ladders of decisions live here side by side, because their thresholds and ties differ on
purpose: `spell_events` (passes, tackles, interceptions, shots and carries from pairs of
spells) and `run_transitions` (touches, bridged carries, challenges, passes and their
counterparts from pairs of held runs).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import joins as J
from trackloom.operators import temporal as T

Keys = Sequence[str]


# ------------------------------------------------------------------ spells
def spells(owned: DataFrame, keys: Keys, owner: str = "owner", gap: int = 12, least: int = 5) -> DataFrame:
    """Spells from (keys, frame, owner, team, x, y): runs of one owner with gaps of up to `gap`, spans below `least` frames
    dropped, then neighbours of one owner merged whatever lies between them."""
    w = Window.partitionBy(*keys).orderBy("frame")
    new = ~F.col(owner).eqNullSafe(F.lag(owner).over(w)) | (F.col("frame") - F.lag("frame").over(w) > gap)
    p = F.struct("x", "y")
    runs = T.islands(owned.where(F.col(owner).isNotNull()), keys, ["frame"], new)
    runs = runs.groupBy(*keys, owner, "team", "island").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by(p, "frame").alias("start_point"), F.max_by(p, "frame").alias("end_point"))
    runs = runs.where(F.col("end_frame") - F.col("start_frame") + 1 >= least).drop("island")
    merged = T.change_islands(runs, keys, ["start_frame"], owner)
    return merged.groupBy(*keys, owner, "team", "island").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min_by("start_point", "start_frame").alias("start_point"), F.max_by("end_point", "end_frame").alias("end_point")).drop("island")


def spell_pairs(s: DataFrame, ball: DataFrame, keys: Keys, owner: str = "owner") -> DataFrame:
    """Each spell with the next one, and the ball's release and receipt (the spells' points where the ball is not seen)."""
    w = Window.partitionBy(*keys).orderBy("start_frame")
    nxt = F.lead(F.struct(F.col(owner).alias("owner"), "team", "start_frame", "end_frame", "start_point")).over(w)
    pairs = s.withColumn("nxt", nxt).where("nxt is not null").select(*keys, F.col(owner).alias("a"), F.col("team").alias("team_a"), "end_frame", "end_point", F.col("nxt.owner").alias("b"), F.col("nxt.team").alias("team_b"), F.col("nxt.start_frame").alias("next_frame"), F.col("nxt.start_point").alias("next_point"))
    at = ball.select(*keys, F.col("frame").alias("end_frame"), F.struct("x", "y").alias("release"))
    to = ball.select(*keys, F.col("frame").alias("next_frame"), F.struct("x", "y").alias("receipt"))
    out = pairs.join(at, [*keys, "end_frame"], "left").join(to, [*keys, "next_frame"], "left")
    return out.withColumn("release", F.coalesce("release", "end_point")).withColumn("receipt", F.coalesce("receipt", "next_point"))


def classify_pairs(pairs: DataFrame, fps: float, flight_s: float = 4.0, pass_m: float = 3.0, duel_m: float = 3.0, progressive_m: float = 10.0, final_third: float = 17.5) -> DataFrame:
    """kind: pass, tackle or interception, NULL for nothing; duels that repeat are suppressed by `suppress_duels`."""
    sign = X.direction(F.col("team_a"))
    d = lambda a, b: X.distance(F.col(f"{a}.x"), F.col(f"{a}.y"), F.col(f"{b}.x"), F.col(f"{b}.y"))
    p = pairs.withColumn("flight_s", (F.col("next_frame") - F.col("end_frame")) / fps).withColumn("travelled", d("release", "receipt")).withColumn("apart", d("end_point", "next_point"))
    same = F.col("team_a") == F.col("team_b")
    kind = (
        F.when(F.col("flight_s") > flight_s, None)
        .when(same & (F.col("travelled") < pass_m), None)
        .when(same, "pass")
        .when(F.col("team_a").isNull() | F.col("team_b").isNull(), None)
        .when((F.col("apart") <= duel_m) & (F.col("travelled") < duel_m), "tackle")
        .otherwise("interception")
    )
    progressive = (F.col("receipt.x") - F.col("release.x")) * sign >= progressive_m
    into = (F.col("release.x") * sign < final_third) & (F.col("receipt.x") * sign >= final_third)
    return p.withColumn("kind", kind).withColumn("frame", F.when(F.col("kind") == "pass", F.col("end_frame")).otherwise(F.col("next_frame"))).withColumn("progressive", (F.col("kind") == "pass") & progressive).withColumn("into_final_third", (F.col("kind") == "pass") & into)


def suppress_duels(events: DataFrame, keys: Keys, fps: float, window_s: float = 1.5) -> DataFrame:
    """Turnovers of the same two within a window of the last *counted* one go: a fold over a match's turnovers."""
    turn = events.where("kind in ('tackle', 'interception')")

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "a", "b"])
        keep, last_pair, last_frame = [], None, 0
        for a, b, f in zip(g["a"], g["b"], g["frame"], strict=True):
            pair = frozenset((a, b))
            ok = not (pair == last_pair and (f - last_frame) / fps <= window_s)
            keep.append(ok)
            if ok:
                last_pair, last_frame = pair, f
        return g[keep]

    return turn.groupBy(*keys).applyInPandas(fold, turn.schema).unionByName(events.where("kind = 'pass'"))


# What a player's tally counts, in the order of the report.
TALLY = ("touches", "passes", "passes_completed", "passes_received", "progressive_passes", "passes_into_final_third", "losses", "interceptions", "tackles", "dispossessed", "shots", "shots_on_target", "goals", "assists", "carries", "carry_distance_m", "possession_time_s")


def tallies(s: DataFrame, turns: DataFrame, struck: DataFrame, goals: DataFrame, keys: Keys, fps: float, owner: str = "owner", carry_m: float = 4.0) -> DataFrame:
    """Per player: the counters of TALLY and pass_accuracy (NULL without passes).

    s: spells; turns: passes, tackles and interceptions (kind, a, b, progressive,
    into_final_third) after suppression of repeated duels; struck: shots (player,
    on_target); goals: (scorer, assist), either NULL where unknown. An interception is
    also a failed pass and a loss of the one who gave the ball away; a tackle is a loss and a
    dispossession, not a pass. One union of sparse rows, one aggregate.
    """
    zero = lambda **has: [has.get(c, F.lit(0)).cast("double").alias(c) for c in TALLY]
    one = F.lit(1)
    far = X.distance(F.col("start_point.x"), F.col("start_point.y"), F.col("end_point.x"), F.col("end_point.y"))
    carried = F.coalesce(far >= carry_m, F.lit(False))
    held = s.select(*keys, F.col(owner).alias("player"), *zero(touches=one, possession_time_s=(F.col("end_frame") - F.col("start_frame") + 1) / fps, carries=carried.cast("int"), carry_distance_m=F.when(carried, far).otherwise(0.0)))
    is_ = lambda k: (F.col("kind") == k).cast("int")
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) * is_("pass")
    gave = turns.select(*keys, F.col("a").alias("player"), *zero(passes=is_("pass") + is_("interception"), passes_completed=is_("pass"), progressive_passes=flag("progressive"), passes_into_final_third=flag("into_final_third"), losses=is_("tackle") + is_("interception"), dispossessed=is_("tackle")))
    got = turns.select(*keys, F.col("b").alias("player"), *zero(passes_received=is_("pass"), tackles=is_("tackle"), interceptions=is_("interception")))
    shot = struck.select(*keys, "player", *zero(shots=one, shots_on_target=F.col("on_target").cast("int")))
    scored = goals.where("scorer is not null").select(*keys, F.col("scorer").alias("player"), *zero(goals=one))
    helped = goals.where("assist is not null").select(*keys, F.col("assist").alias("player"), *zero(assists=one))
    rows = held.unionByName(gave).unionByName(got).unionByName(shot).unionByName(scored).unionByName(helped)
    return _summed(rows, [*keys, "player"])


def _summed(rows: DataFrame, by: Keys) -> DataFrame:
    whole = lambda c: F.sum(c) if c in ("carry_distance_m", "possession_time_s") else F.sum(c).cast("long")
    out = rows.groupBy(*by).agg(*[whole(c).alias(c) for c in TALLY])
    return out.withColumn("pass_accuracy", F.when(F.col("passes") > 0, F.col("passes_completed") / F.col("passes")))


def team_tallies(players: DataFrame, members: DataFrame, keys: Keys) -> DataFrame:
    """Tallies of teams: sums over their members (keys, player, team); accuracy from the sums."""
    return _summed(players.join(members, [*keys, "player"]), [*keys, "team"])


# ------------------------------------------------------------------ blocks of a second ledger
def on_ball(events: DataFrame, keys: Keys, who: str = "player") -> DataFrame:
    """Touches, receptions, carries and shots of a ledger (type, duration_s, contested, in_box, distance_m, progressive_m, progressive) per player."""
    is_ = lambda k: F.col("type") == k
    yes = lambda k, c: F.count_if(is_(k) & F.coalesce(F.col(c), F.lit(False)))
    total = lambda k, v: F.coalesce(F.sum(F.when(is_(k), v)), F.lit(0.0))
    return events.groupBy(*keys, who).agg(
        F.count_if(is_("touch")).alias("touches"), yes("touch", "contested").alias("touches_contested"), total("touch", F.col("duration_s")).alias("time_on_ball_s"),
        F.count_if(is_("reception")).alias("receptions"), yes("reception", "in_box").alias("receptions_in_box"), F.count_if(is_("carry")).alias("carries"),
        total("carry", F.coalesce("distance_m", F.lit(0.0))).alias("carry_distance_m"), total("carry", F.greatest(F.coalesce("progressive_m", F.lit(0.0)), F.lit(0.0))).alias("carry_progressive_m"),
        yes("carry", "progressive").alias("progressive_carries"), F.count_if(is_("shot")).alias("shots"),
    )


def passing(events: DataFrame, keys: Keys, who: str = "player", long_m: float = 25.0) -> DataFrame:
    """Passes of a ledger (type, outcome, length_m, progressive_m, forward, progressive, into_final_third, into_box) per player; progress counts completed ones only."""
    p = events.where("type = 'pass'")
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    done, length = F.col("outcome") == "complete", F.coalesce("length_m", F.lit(0.0))
    return p.groupBy(*keys, who).agg(
        F.count("*").alias("attempted"), F.count_if(done).alias("completed"), (F.count_if(done) / F.count("*")).alias("accuracy"), yes("forward").alias("forward"), yes("progressive").alias("progressive"),
        F.sum(F.when(done, F.greatest(F.coalesce("progressive_m", F.lit(0.0)), F.lit(0.0))).otherwise(0.0)).alias("progressive_m"), yes("into_final_third").alias("into_final_third"), yes("into_box").alias("into_box"),
        F.avg(length).alias("avg_length_m"), F.count_if(length >= long_m).alias("long_passes"), F.sum(length).alias("total_length_m"),
    )


def defensive(events: DataFrame, keys: Keys, who: str = "player") -> DataFrame:
    """Losses, recoveries, interceptions, challenges and lost challenges of a ledger per player."""
    n = lambda k: F.count_if(F.col("type") == k)
    return events.groupBy(*keys, who).agg(n("loss").alias("losses"), n("recovery").alias("recoveries"), n("interception").alias("interceptions"), n("challenge").alias("challenges"), F.count_if((F.col("type") == "challenge") & (F.col("outcome") == "lost")).alias("challenges_lost"))


# Types of events that have a player on the ball.
ON_BALL = ("touch", "carry", "pass", "reception", "loss", "recovery", "interception", "challenge", "shot")


def identification(players: DataFrame, events: DataFrame, keys: Keys) -> DataFrame:
    """How much of a report is about players with a number: players (keys, player, number, role), events (keys, player, type)."""
    known = players.where("role <> 'referee'").withColumn("named", F.col("number").isNotNull())
    heads = known.groupBy(*keys).agg(F.count_if("named").alias("identified_players"), F.count_if(~F.col("named")).alias("anonymous_fragments"))
    on = events.where(F.col("player").isNotNull() & F.col("type").isin(list(ON_BALL))).join(known.select(*keys, "player", "named"), [*keys, "player"], "left")
    share = on.groupBy(*keys).agg(F.count("*").alias("on_ball_events"), F.count_if(F.coalesce("named", F.lit(False))).alias("attributed"))
    out = heads.join(share, list(keys), "left").fillna(0, ["on_ball_events", "attributed"])
    return out.withColumn("attributed_share", F.when(F.col("on_ball_events") > 0, F.col("attributed") / F.col("on_ball_events")))


def side_totals(events: DataFrame, keys: Keys) -> DataFrame:
    """Per side: possession time, its share of all sides' (1 s stands in for none at all), phases, touches, passes, accuracy and shots."""
    n = lambda k: F.count_if(F.col("type") == k)
    done = F.count_if((F.col("type") == "pass") & (F.col("outcome") == "complete"))
    g = events.groupBy(*keys, "team").agg(F.coalesce(F.sum(F.when(F.col("type") == "phase", F.col("duration_s"))), F.lit(0.0)).alias("possession_s"), n("phase").alias("phases"), n("touch").alias("touches"), n("pass").alias("passes"), done.alias("_done"), n("shot").alias("shots"))
    total = F.sum("possession_s").over(Window.partitionBy(*keys))
    g = g.withColumn("possession_share", F.col("possession_s") / F.when(total > 0, total).otherwise(1.0)).withColumn("pass_accuracy", F.when(F.col("passes") > 0, F.col("_done") / F.col("passes")))
    return g.where("team is not null").drop("_done")


def standing_score(timeline: DataFrame, keys: Keys) -> DataFrame:
    """The last score that the board showed (frame, home, away; unknown counts 0); of equal frames the first row by `row`."""
    return timeline.groupBy(*keys).agg(F.max_by(F.struct(F.coalesce("home", F.lit(0)).alias("home"), F.coalesce("away", F.lit(0)).alias("away"), "frame"), F.struct(F.coalesce("frame", F.lit(0)), -F.col("row"))).alias("s")).select(*keys, "s.home", "s.away", "s.frame")


def score_of_goals(goals: DataFrame, matches: DataFrame, board: DataFrame, keys: Keys) -> DataFrame:
    """Goals by side within the footage, and where a score comes from: the board, the ball, or nowhere."""
    n = goals.groupBy(*keys).agg(F.count_if(F.col("team") == "left").alias("left"), F.count_if(F.col("team") == "right").alias("right"), F.count("*").alias("goals"))
    shown = board.select(*keys).distinct().withColumn("shown", F.lit(True))
    out = matches.join(n, list(keys), "left").join(shown, list(keys), "left").fillna(0, ["left", "right", "goals"])
    source = F.when(F.col("shown"), "scoreboard").when(F.col("goals") > 0, "ball_position").otherwise("none")
    return out.select(*keys, "left", "right", source.alias("source"))


def shots(s: DataFrame, ball: DataFrame, keys: Keys, fps: float, owner: str = "owner", speed: float = 12.0, min_x: float = 15.0, half_goal: float = 3.66, margin: float = 5.0, reach_s: float = 3.0, window: int = 10) -> DataFrame:
    """A spell's end is a shot if the ball leaves fast, far enough forward, towards the goal line between the wider posts."""
    w = Window.partitionBy(*keys).orderBy("start_frame")
    ends = s.select(*keys, F.col(owner).alias("player"), "team", F.col("end_frame").alias("frame"), F.coalesce(F.lead("start_frame").over(w), (F.col("end_frame") + reach_s * fps).cast("long")).alias("until"), "end_point")
    j = J.asof_forward(ends, ball.select(*keys, "frame", "x", "y"), keys, window=window)
    v = X.distance(F.col("from_x"), F.col("from_y"), F.col("to_x"), F.col("to_y")) / ((F.col("to_frame") - F.col("from_frame")) / fps)
    j = j.withColumn("ball_speed", F.when(F.col("to_frame") > F.col("from_frame"), v).otherwise(0.0))
    # the last ball row up to `until`: ball rows and deadlines in one order, no join of both
    seen = ball.select(*keys, F.col("frame").alias("at"), F.lit(0).alias("mark"), F.struct("frame", "x", "y").alias("b"), F.lit(None).cast("long").alias("own"))
    marks = seen.unionByName(ends.select(*keys, F.col("until").alias("at"), F.lit(1).alias("mark"), F.lit(None).cast(seen.schema["b"].dataType).alias("b"), F.col("frame").cast("long").alias("own")))
    upto = Window.partitionBy(*keys).orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.withColumn("b", F.last("b", ignorenulls=True).over(upto)).where("mark = 1 and b.frame > own").select(*keys, F.col("own").alias("frame"), F.struct("b.x", "b.y").alias("last"))
    sign = X.direction(F.col("team"))
    out = j.join(last, [*keys, "frame"])
    offset = X.goal_line_offset(F.coalesce("from_x", "end_point.x"), F.coalesce("from_y", "end_point.y"), F.col("last.x"), F.col("last.y"), sign)
    out = out.withColumn("offset", offset).where((F.col("ball_speed") >= speed) & (F.coalesce("from_x", "end_point.x") * sign >= min_x) & (F.col("offset") <= half_goal + margin))
    return out.select(*keys, "player", "team", "frame", "ball_speed", "offset", (F.col("offset") <= half_goal).alias("on_target"))


def carries(s: DataFrame, least: float = 4.0) -> DataFrame:
    """Spells whose points lie `least` metres apart."""
    return s.withColumn("distance_m", X.distance(F.col("start_point.x"), F.col("start_point.y"), F.col("end_point.x"), F.col("end_point.y"))).where(F.col("distance_m") >= least)


# ------------------------------------------------------------------ held runs
def held_runs(rows: DataFrame, keys: Keys, fps: float, least_s: float = 0.5) -> DataFrame:
    """Runs of a holder id (-1: nobody) by row; shorter ones become nobody's, then equal neighbours merge."""
    r = T.change_islands(rows, keys, ["frame"], "holder", "run")
    length = r.groupBy(*keys, "run", "holder").agg(((F.max("frame") - F.min("frame") + 1) / fps).alias("s"))
    r = r.join(length, [*keys, "run", "holder"]).withColumn("holder", F.when(F.col("s") < least_s, F.lit(-1)).otherwise(F.col("holder"))).drop("run", "s")
    r = T.change_islands(r, keys, ["frame"], "holder", "run")
    p = F.struct("x", "y")
    return r.groupBy(*keys, "run", "holder").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max("contested").alias("contested"), F.avg("dist").alias("mean_dist"), F.min_by(p, "frame").alias("start_point"), F.max_by(p, "frame").alias("end_point"), F.max("team").alias("team"), F.count("*").alias("frames"))


def touch_confidence(mean_dist, seconds):
    """0.35 + 0.45 * closeness + 0.2 * persistence."""
    near = 1 - F.least(F.coalesce(mean_dist, F.lit(2.5)) / 2.5, F.lit(1.0))
    return 0.35 + 0.45 * near + 0.2 * F.least(seconds / 2.0, F.lit(1.0))


def run_transitions(runs: DataFrame, keys: Keys, fps: float, travel_m: float = 6.0, shot_speed: float = 12.0) -> DataFrame:
    """Events between a held run and the next: the first that applies of carry (same holder), challenge (short travel,
    with loss and recovery across sides), shot, pass with its reception or interception."""
    held = runs.where("holder <> -1")
    w = Window.partitionBy(*keys).orderBy("start_frame")
    nxt = F.lead(F.struct("holder", "team", "start_frame", "start_point")).over(w)
    p = held.withColumn("n", nxt).where("n is not null")
    travel = X.distance(F.col("end_point.x"), F.col("end_point.y"), F.col("n.start_point.x"), F.col("n.start_point.y"))
    seconds = (F.col("n.start_frame") - F.col("end_frame")) / fps
    sign = X.direction(F.col("team"))
    p = p.withColumn("travel", travel).withColumn("speed", F.when(seconds > 0, travel / seconds).otherwise(0.0))
    same = F.coalesce(F.col("team") == F.col("n.team"), F.lit(False))
    to_x, to_y = F.col("n.start_point.x"), F.col("n.start_point.y")
    shot = (F.col("speed") >= shot_speed) & (to_x * sign > F.col("end_point.x") * sign) & (F.abs(to_x) > 40.5) & (F.abs(to_y) < 12) & (F.col("end_point.x") * sign > 17.5)

    def e(kind: str, who: str, frame: str, outcome: str | None = None):
        return F.struct(F.lit(kind).alias("kind"), F.col(who).alias("player"), F.col(frame).alias("frame"), F.lit(outcome).cast("string").alias("outcome"))

    loss, gain = e("loss", "holder", "end_frame"), lambda k: e(k, "n.holder", "n.start_frame")
    events = (
        F.when(F.col("holder") == F.col("n.holder"), F.array(e("carry", "holder", "end_frame", "bridged")))
        .when((F.col("travel") < travel_m) & same, F.array(e("challenge", "holder", "end_frame", "kept")))
        .when(F.col("travel") < travel_m, F.array(e("challenge", "holder", "end_frame", "lost"), loss, gain("recovery")))
        .when(~same & shot, F.array(e("shot", "holder", "end_frame")))
        .when(same, F.array(e("pass", "holder", "end_frame", "complete"), gain("reception")))
        .otherwise(F.array(e("pass", "holder", "end_frame", "incomplete"), loss, gain("interception")))
    )
    out = p.select(*keys, F.posexplode(events).alias("rank", "e"), "travel").select(*keys, "e.kind", "e.player", "e.frame", "e.outcome", "rank", "travel")
    order = Window.partitionBy(*keys).orderBy("frame", "rank", "kind", "player")
    return out.withColumn("event_id", F.format_string("%s_%06d", F.col("kind"), F.row_number().over(order)))


def trailing_shots(runs: DataFrame, ball: DataFrame, keys: Keys, fps: float, shot_speed: float = 12.0, least_rows: int = 3, final_third: float = 17.5, near_goal: float = 40.5, half_width: float = 12.0) -> DataFrame:
    """A match's last held run ends in a shot if the ball, over its last rows (`least_rows` or more), flies like one: the footage ends before the outcome (confidence 0.35)."""
    last = runs.where("holder <> -1").groupBy(*keys).agg(F.max_by(F.struct("holder", "team", "end_frame", "end_point"), "start_frame").alias("r"))
    tail = ball.join(last, list(keys)).where(F.col("frame") >= F.col("r.end_frame")).groupBy(*keys).agg(F.count("*").alias("rows"), F.max_by(F.struct("frame", "x", "y"), "frame").alias("e"))
    t = last.join(tail, list(keys)).where(F.col("rows") >= least_rows)
    seconds = (F.col("e.frame") - F.col("r.end_frame")) / fps
    travel = X.distance(F.col("r.end_point.x"), F.col("r.end_point.y"), F.col("e.x"), F.col("e.y"))
    sign, from_x = X.direction(F.col("r.team")), F.col("r.end_point.x")
    shot = (seconds > 0) & (travel / seconds >= shot_speed) & (F.col("e.x") * sign > from_x * sign) & (F.abs("e.x") > near_goal) & (F.abs("e.y") < half_width) & (from_x * sign > final_third)
    return t.where(shot).select(*keys, F.lit("shot").alias("kind"), F.col("r.holder").alias("player"), F.col("r.end_frame").alias("frame"), travel.alias("travel"), F.lit(0.35).alias("confidence"))


def phases(runs: DataFrame, keys: Keys) -> DataFrame:
    """Phases of a side (NULL or nobody's: loose ball); a phase ends where the next one starts, the last at its own end."""
    r = runs.withColumn("side", F.when(F.col("holder") != -1, F.col("team")))
    g = T.change_islands(r, keys, ["start_frame"], "side").groupBy(*keys, "island", "side").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("last_frame"))
    return g.withColumn("end_frame", F.coalesce(F.lead("start_frame").over(Window.partitionBy(*keys).orderBy("start_frame")), "last_frame")).select(*keys, "side", "start_frame", "end_frame")
