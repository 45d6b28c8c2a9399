"""The match report: a fixed catalogue of metrics, tri-state qualifiers, and one count for all scopes.

events: match_id, event_id, kind, team, player_id, target_id, period, outcome (NULL =
unknown), x, y, end_x, end_y, sign (attacking direction, 1 or -1), start_ms, end_ms, status
('verified' or 'estimated'), flags map<string,boolean> (a key with NULL: stated as unknown),
numbers map<string,double> (distance_m, xg, xa), labels map<string,string> (colour, xg_model,
xa_model).

A kind has at most SLOTS metrics, so every event states its kind's metrics in that many
small codes; one aggregate counts the codes by match, kind, team, player and period. Teams,
players and periods are rolled up from that small table, and only then is it turned into
one row for each metric. Evidence lists are built apart, by `evidence`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Pitch, zones and bounds, in metres."""

    length: float = 105.0
    width: float = 68.0
    box_depth: float = 16.5
    box_width: float = 40.32
    short_below: float = 10.0
    medium_to: float = 40.0
    forward_cosine: float = 0.5
    gain_own_half: float = 30.0
    gain_across: float = 15.0
    gain_other_half: float = 10.0
    press_depth: float = 40.0
    interval_ms: int = 900_000

    def __post_init__(self) -> None:
        if not 0 < self.short_below < self.medium_to:
            raise ValueError("bounds of pass lengths must increase")
        if self.box_depth >= self.length / 2 or self.box_width > self.width or self.press_depth > self.length:
            raise ValueError("a zone exceeds the pitch")
        if not 0 < self.forward_cosine <= 1 or min(self.length, self.width, self.box_depth, self.box_width, self.press_depth, self.interval_ms) <= 0:
            raise ValueError("sizes must be positive and the cosine at most 1")


# The report's metrics by group, as (metric, kind of event, qualifier).
CATALOG: dict[str, list[tuple[str, str, str | None]]] = {
    "general": [("goals", "goal", None), ("assists", "assist", None), ("chances", "chance", None), ("saves", "save", None), ("fouls", "foul", None), ("fouls_suffered", "foul_suffered", None), ("offsides", "offside", None), ("corners", "corner", None), ("yellow_cards", "card", "yellow"), ("red_cards", "card", "red")],
    "shots": [("total", "shot", None), ("on_target", "shot", "on_target"), ("off_target", "shot", "off_target"), ("blocked", "shot", "blocked"), ("inside_box", "shot", "inside_box"), ("headers", "shot", "header"), ("free_kicks", "shot", "free_kick"), ("penalties", "shot", "penalty")],
    "passes": [("total", "pass", None), ("short", "pass", "short"), ("medium", "pass", "medium"), ("long", "pass", "long"), ("forward", "pass", "forward"), ("lateral", "pass", "lateral"), ("backward", "pass", "backward"), ("progressive", "pass", "progressive"), ("into_final_third", "pass", "into_final_third"), ("into_box", "pass", "into_box"), ("key", "pass", "key"), ("crosses", "pass", "cross"), ("open_play", "pass", "open_play"), ("set_piece", "pass", "set_piece"), ("throw_ins", "pass", "throw_in"), ("corner_deliveries", "pass", "corner")],
    "duels": [("total", "duel", None), ("aerial", "duel", "aerial"), ("ground", "duel", "ground"), ("attacking", "duel", "attacking"), ("defending", "duel", "defending"), ("dribbles", "dribble", None), ("tackles", "tackle", None)],
    "recoveries_losses": [("losses", "loss", None), ("losses_own_half", "loss", "own_half"), ("recoveries", "recovery", None), ("recoveries_opponent_half", "recovery", "opponent_half"), ("interceptions", "interception", None), ("interceptions_opponent_half", "interception", "opponent_half"), ("loose_ball_recoveries", "recovery", "loose_ball"), ("miscontrols", "miscontrol", None), ("clearances", "clearance", None)],
    "attacks": [("total", "attack", None), ("positional", "attack", "positional"), ("fast", "attack", "fast"), ("set_piece", "attack", "set_piece"), ("with_shot", "attack", "with_shot"), ("left_flank", "attack", "left_flank"), ("centre", "attack", "centre"), ("right_flank", "attack", "right_flank")],
    "pressing": [("total", "pressure", None), ("high", "pressure", "high"), ("low", "pressure", "low"), ("build_ups", "build_up", None), ("unopposed_build_ups", "build_up", "unopposed")],
    "progression": [("carries", "carry", None), ("final_third_entries", "entry", "final_third"), ("opponent_half_entries", "entry", "opponent_half"), ("box_entries", "entry", "box")],
    "possession": [("spells", "possession", None), ("duration_0_10_s", "possession", "duration_0_10"), ("duration_10_20_s", "possession", "duration_10_20"), ("duration_20_45_s", "possession", "duration_20_45"), ("duration_over_45_s", "possession", "duration_over_45")],
}
# Sums and means, as (group, metric, kind, measure, whether a mean, unit, decimals).
MEASURES = [("shots", "xg", "shot", "model", False, "expected_goals", 4), ("passes", "xa", "pass", "model", False, "expected_goals", 4), ("passes", "average_distance_m", "pass", "amount", True, "m", 3), ("shots", "average_distance_m", "shot", "amount", True, "m", 3), ("progression", "carry_distance_m", "carry", "amount", False, "m", 4), ("possession", "time_s", "possession", "amount", False, "s", 4), ("possession", "average_duration_s", "possession", "amount", True, "s", 3)]
METRICS = [(g, m, k, q) for g, rows in CATALOG.items() for m, k, q in rows]
#: The qualifiers of each kind, in the order of its slots, and the slot of each metric.
OF_KIND: dict[str, list[str | None]] = {}
SLOT: list[int] = []
for _, _, _k, _q in METRICS:
    SLOT.append(len(OF_KIND.setdefault(_k, [])))
    OF_KIND[_k].append(_q)
SLOTS = max(map(len, OF_KIND.values()))
KINDS = list(OF_KIND)
#: What an event says of a metric.
NO, UNKNOWN, OPEN, FAILED, WON = range(5)
SCOPES = ("team", "player", "period")


def rounded(value: Column, decimals: int) -> Column:
    """Half up, in plain floating-point steps that any engine repeats."""
    return F.floor(value * float(10**decimals) + 0.5) / float(10**decimals)


def derived(name: str, kind: str, c: Config) -> Column:
    """What a qualifier is by time and place, NULL where something that it needs is missing."""
    x, y, ex, ey, s = (F.col(n) for n in ("x", "y", "end_x", "end_y", "sign"))
    ax, aex, half = x * s, ex * s, c.length / 2
    in_box = lambda px, py: F.when(px.isNotNull(), px.between(half - c.box_depth, half) & (F.abs(py) <= c.box_width / 2))
    if name in ("yellow", "red"):
        return F.element_at("labels", "colour") == name
    if name.startswith("duration_"):
        seconds = (F.col("end_ms") - F.col("start_ms")) / 1000
        low, high = {"duration_0_10": (0, 10), "duration_10_20": (10, 20), "duration_20_45": (20, 45), "duration_over_45": (45, float("inf"))}[name]
        return (seconds >= low) & (seconds < high)
    if name in ("own_half", "opponent_half"):
        return ax < 0 if name == "own_half" else ax >= 0
    if name == "inside_box":
        return in_box(ax, y)
    if kind != "pass":
        return F.lit(None).cast("boolean")
    flown = F.sqrt((ex - x) * (ex - x) + (ey - y) * (ey - y))
    length = F.coalesce(flown, F.element_at("numbers", "distance_m"))
    gain = (ex - x) * s
    cosine = gain / F.greatest(flown, F.lit(1e-12))
    need = F.when(aex < 0, c.gain_own_half).when(ax < 0, c.gain_across).otherwise(c.gain_other_half)
    table = {
        "short": length < c.short_below,
        "medium": length.between(c.short_below, c.medium_to),
        "long": length > c.medium_to,
        "forward": cosine >= c.forward_cosine,
        "backward": cosine <= -c.forward_cosine,
        "lateral": (cosine > -c.forward_cosine) & (cosine < c.forward_cosine),
        "progressive": (cosine >= c.forward_cosine) & (gain >= need),
        "into_final_third": F.when(cosine.isNotNull(), aex >= c.length / 6),
        "into_box": F.when(cosine.isNotNull(), in_box(aex, ey)),
    }
    return table.get(name, F.lit(None).cast("boolean"))


def qualifier(name: str | None, kind: str, config: Config) -> Column:
    """A stated flag wins, even a stated unknown; without one, time and place; else unknown."""
    if name is None:
        return F.lit(True)
    return F.when(F.map_contains_key("flags", name), F.element_at("flags", name)).otherwise(derived(name, kind, config))


def _codes(config: Config) -> list[Column]:
    """The metrics of an event's kind by slot: NO, UNKNOWN, or by outcome; NULL where the kind has fewer."""
    out = []
    for slot in range(SLOTS):
        code = F.lit(None).cast("int")
        for kind, names in OF_KIND.items():
            if slot < len(names):
                q = qualifier(names[slot], kind, config)
                told = F.when(F.col("outcome").isNull(), OPEN).when(F.col("outcome"), WON).otherwise(FAILED)
                code = F.when(F.col("kind") == kind, F.when(q.isNull(), UNKNOWN).when(q, told).otherwise(NO)).otherwise(code)
        out.append(code.alias(f"c{slot}"))
    return out


def _amounts(config: Config) -> list[Column]:
    """model: expected goals or assists that name their model; amount: metres or seconds of the event."""
    n, kind = lambda k: F.element_at("numbers", k), F.col("kind")
    model = F.when((kind == "shot") & F.element_at("labels", "xg_model").isNotNull(), n("xg")).when((kind == "pass") & F.element_at("labels", "xa_model").isNotNull(), n("xa"))
    flown = F.sqrt((F.col("end_x") - F.col("x")) * (F.col("end_x") - F.col("x")) + (F.col("end_y") - F.col("y")) * (F.col("end_y") - F.col("y")))
    goal = F.col("sign") * (config.length / 2) - F.col("x")
    amount = (
        F.when(kind == "pass", F.coalesce(flown, n("distance_m")))
        .when(kind == "shot", F.sqrt(goal * goal + F.col("y") * F.col("y")))
        .when(kind == "carry", n("distance_m"))
        .when(kind == "possession", (F.col("end_ms") - F.col("start_ms")) / 1000)
    )
    return [model.alias("model"), amount.alias("amount")]


def counted(events: DataFrame, config: Config) -> DataFrame:
    """One row by match, kind, team, player and period: n, estimated, and per slot the selected, unknown, open and won events; sums and numbers of both measures."""
    rows = events.where(F.col("kind").isin(KINDS)).select("match_id", "kind", "team", "player_id", "period", (F.col("status") == "estimated").alias("est"), *_codes(config), *_amounts(config))
    counts = [F.count("*").alias("n"), F.count_if("est").alias("estimated")]
    for k in range(SLOTS):
        c = F.col(f"c{k}")
        counts += [F.count_if(c >= OPEN).alias(f"sel{k}"), F.count_if(c == UNKNOWN).alias(f"unk{k}"), F.count_if(c == OPEN).alias(f"open{k}"), F.count_if(c == WON).alias(f"won{k}")]
    for m in ("model", "amount"):
        counts += [F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n")]
    return rows.groupBy("match_id", "kind", "team", "player_id", "period").agg(*counts)


def completeness(fine: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """match_id, kind, ok_team, ok_player: a certified kind stays complete for teams (players) if all its events name one."""
    named = fine.groupBy("match_id", "kind").agg((F.sum(F.when(F.col("team").isNull(), F.col("n")).otherwise(0)) == 0).alias("ok_team"), (F.sum(F.when(F.col("player_id").isNull(), F.col("n")).otherwise(0)) == 0).alias("ok_player"))
    return named.where(F.col("kind").isin(list(kinds)))


def rolled_up(events: DataFrame, complete_kinds: Sequence[str], config: Config | None = None, teams: DataFrame | None = None, periods: DataFrame | None = None) -> DataFrame:
    """All metrics and measures at team, player and period x team: match_id, scope, entity, period, group, metric, value,
    observed, unknown, successful, success_pct, state, unit.

    value is NULL (state: unavailable) where a qualifier is unknown, or where no event of
    the kind is seen and the kind is not certified as complete; certified kinds count 0.
    teams (match_id, team) are reported whether or not they have events, and in all of
    periods (match_id, period) if these are given.
    """
    config = config or Config()
    fine = counted(events, config)
    sums = [F.sum(c).alias(c) for c in fine.columns[5:]]
    keys = [F.col(c) for c in ("match_id", "kind", "team", "player_id", "period")]
    m, k, t, p, w = keys
    rolled = fine.groupingSets([[m, k, t], [m, k, p], [m, k, t, w]], *keys).agg(F.grouping("player_id").alias("no_player"), F.grouping("period").alias("no_period"), *sums)
    scope = F.when(F.col("no_player") == 0, "player").when(F.col("no_period") == 0, "period").otherwise("team")
    rolled = rolled.withColumn("scope", scope).withColumn("entity", F.coalesce("player_id", "team")).where("entity is not null")
    rolled = rolled.drop("no_player", "no_period", "team", "player_id")
    who = rolled.select("match_id", "scope", "entity", "period")
    if teams is not None:
        named = teams.select("match_id", F.lit("team").alias("scope"), F.col("team").alias("entity"), F.lit(None).cast("int").alias("period"))
        who = who.unionByName(named)
        if periods is not None:
            who = who.unionByName(named.drop("period").join(periods.select("match_id", F.col("period").cast("int").alias("period")), "match_id").withColumn("scope", F.lit("period")))
    who = who.distinct()
    # every entity reports every metric, seen or not; the catalogue is a constant of some 80 rows
    names = ("group", "metric", "kind", "slot", "measure", "mean", "unit", "decimals")
    spec = lambda r: F.struct(*[F.lit(v).alias(c) for v, c in zip(r, names, strict=True)])
    specs = [(g, n, kind, slot, "", False, "count", 0) for (g, n, kind, _), slot in zip(METRICS, SLOT, strict=True)] + [(g, n, kind, 0, *rest) for g, n, kind, *rest in MEASURES]
    wanted = who.select("*", F.inline(F.array(*[spec(r) for r in specs])))
    arrays = [F.array(*[F.col(f"{a}{i}") for i in range(SLOTS)]).alias(a) for a in ("sel", "unk", "open", "won")]
    small = rolled.select("match_id", "scope", "entity", "period", "kind", "n", "estimated", "model_sum", "model_n", "amount_sum", "amount_n", *arrays)
    j = wanted.alias("a").join(small.alias("b"), (F.col("a.match_id") == F.col("b.match_id")) & (F.col("a.scope") == F.col("b.scope")) & (F.col("a.entity") == F.col("b.entity")) & F.col("a.period").eqNullSafe(F.col("b.period")) & (F.col("a.kind") == F.col("b.kind")), "left")
    j = j.select("a.*", *[F.col(f"b.{c}") for c in small.columns[5:]])
    # a certified kind of which the match has no event is complete, too
    j = j.join(completeness(fine, complete_kinds), ["match_id", "kind"], "left")
    named = F.when(F.col("scope") == "player", F.col("ok_player")).otherwise(F.col("ok_team"))
    complete = F.col("kind").isin(list(complete_kinds)) & F.coalesce(named, F.lit(True))
    at = lambda a: F.coalesce(F.element_at(a, F.col("slot") + 1), F.lit(0))
    n, is_count = F.coalesce("n", F.lit(0)), F.col("measure") == ""
    available = (n > 0) | complete
    count = F.when(available & (at("unk") == 0), at("sel"))
    total = F.when(F.col("measure") == "model", F.col("model_sum")).otherwise(F.col("amount_sum"))
    known = F.coalesce(F.when(F.col("measure") == "model", F.col("model_n")).otherwise(F.col("amount_n")), F.lit(0))
    total = F.when(available & (known == n), F.coalesce(total, F.lit(0.0)))
    decimals = lambda v: F.when(F.col("decimals") == 4, rounded(v, 4)).otherwise(rounded(v, 3))
    # means are taken of the rounded sum, as the sum itself is reported
    measured = F.when(F.col("mean"), F.when(n > 0, decimals(rounded(total, 4) / n))).otherwise(decimals(total))
    value = F.when(is_count, count.cast("double")).otherwise(measured)
    state = F.when(value.isNull(), "unavailable").when(complete & (F.coalesce("estimated", F.lit(0)) == 0), "verified").when(F.coalesce("estimated", F.lit(0)) > 0, "estimated").otherwise("partial")
    won = F.when(is_count & (at("sel") > 0) & (at("open") == 0), at("won"))
    pct = F.when(count > 0, rounded(won * 100 / count, 2))
    return j.select("match_id", "scope", "entity", "period", "group", "metric", value.alias("value"), F.when(is_count, at("sel")).alias("observed"), F.when(is_count, at("unk")).alias("unknown"), won.alias("successful"), pct.alias("success_pct"), state.alias("state"), "unit")


def selected(events: DataFrame, config: Config | None = None) -> DataFrame:
    """An event's row for each metric that it counts for: match_id, event_id, team, player_id, period, group, metric."""
    config = config or Config()
    cells = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("metric"), F.coalesce(F.when(F.col("kind") == k, qualifier(q, k, config)), F.lit(False)).alias("yes")) for g, m, k, q in METRICS])
    return events.select("match_id", "event_id", "team", "player_id", "period", F.inline(F.filter(cells, lambda c: c["yes"]))).drop("yes")


def evidence(events: DataFrame, scope: str, config: Config | None = None) -> DataFrame:
    """The ids of the events behind each metric at one of SCOPES: match_id, entity, period (NULL but for periods), group, metric, evidence_ids (sorted)."""
    who = F.col("player_id") if scope == "player" else F.col("team")
    period = F.col("period") if scope == "period" else F.lit(None).cast("int")
    rows = selected(events, config).select("match_id", who.alias("entity"), period.alias("period"), "group", "metric", "event_id").where("entity is not null")
    return rows.groupBy("match_id", "entity", "period", "group", "metric").agg(F.array_sort(F.collect_list("event_id")).alias("evidence_ids"))


def passes_received(events: DataFrame, complete: bool = False) -> DataFrame:
    """match_id, player_id, received, state: passes that reached the player; complete: passes are certified, and hold unless a completed one names no receiver."""
    p = events.where("kind = 'pass'")
    reached = F.coalesce(F.col("outcome"), F.lit(False)) | F.coalesce(F.element_at("flags", "observed_teammate_transition"), F.lit(False))
    got = p.where(reached & F.col("target_id").isNotNull()).groupBy("match_id", F.col("target_id").alias("player_id")).agg(F.count("*").alias("received"), F.count_if(F.col("status") == "estimated").alias("estimated"))
    gap = p.groupBy("match_id").agg(F.count_if(F.col("player_id").isNull() | (F.coalesce(F.col("outcome"), F.lit(False)) & F.col("target_id").isNull())).alias("gaps"))
    state = F.when(F.lit(complete) & (F.col("gaps") == 0) & (F.col("estimated") == 0), "verified").when(F.col("estimated") > 0, "estimated").otherwise("partial")
    return got.join(gap, "match_id").select("match_id", "player_id", "received", state.alias("state"))


def pass_network(events: DataFrame) -> DataFrame:
    """match_id, team, player_id, target_id, passes, completed (NULL unless all outcomes are known to be good), evidence_ids."""
    reached = F.coalesce(F.col("outcome"), F.lit(False)) | F.coalesce(F.element_at("flags", "observed_teammate_transition"), F.lit(False))
    p = events.where((F.col("kind") == "pass") & reached & F.col("player_id").isNotNull() & F.col("target_id").isNotNull())
    good = F.count_if("outcome")
    return p.groupBy("match_id", "team", "player_id", "target_id").agg(F.count("*").alias("passes"), F.when(good == F.count("*"), good).alias("completed"), F.array_sort(F.collect_list("event_id")).alias("evidence_ids"))


def pressing(events: DataFrame, complete_kinds: Sequence[str], config: Config | None = None) -> DataFrame:
    """Passes allowed per defensive action: match_id, team, passes, actions, ppda.

    Opponents' completed passes from their own side of the zone's edge over own tackles,
    interceptions, duels and fouls beyond it. NULL unless all five kinds are certified, name
    their teams and have places, the match has two teams, and all outcomes of passes are known.
    """
    config = config or Config()
    kinds, edge = ["tackle", "interception", "duel", "foul"], config.length / 2 - config.press_depth
    e = events.where(F.col("kind").isin([*kinds, "pass"]))
    ax, is_pass = F.col("x") * F.col("sign"), F.col("kind") == "pass"
    sides = e.groupBy("match_id", "team").agg(
        F.count_if(~is_pass & (ax >= edge)).alias("actions"), F.count_if(is_pass & F.coalesce(F.col("outcome"), F.lit(False)) & (ax <= -edge)).alias("passes"),
        F.count_if(~is_pass & ax.isNull()).alias("lost"), F.count_if(is_pass & (ax.isNull() | F.col("outcome").isNull())).alias("blind"),
    )
    teams = events.groupBy("match_id").agg(F.countDistinct("team").alias("teams"))
    own = sides.where("team is not null").select("match_id", "team", "actions", "lost")
    # a match has two rows here, so the other side is its other row
    other = sides.where("team is not null").select("match_id", F.col("team").alias("opponent"), "passes", "blind")
    both = own.join(other, "match_id").where("team <> opponent").join(teams, "match_id").where("teams = 2")
    unnamed = sides.where("team is null").select("match_id", F.lit(True).alias("unnamed"))
    both = both.join(unnamed, "match_id", "left")
    ok = F.lit(set([*kinds, "pass"]) <= set(complete_kinds)) & F.col("unnamed").isNull() & (F.col("lost") == 0) & (F.col("blind") == 0) & (F.col("actions") > 0)
    return both.select("match_id", "team", "passes", "actions", F.when(ok, rounded(F.col("passes") / F.col("actions"), 3)).alias("ppda"))


def possession_shares(events: DataFrame) -> DataFrame:
    """match_id, team, time_s, share_pct, state: share of all sides' possession; NULL as soon as one length is unknown, and the state is the worst of all sides'."""
    p = events.where("kind = 'possession' and team is not null").groupBy("match_id", "team").agg(F.when(F.count("end_ms") == F.count("*"), F.sum(F.col("end_ms") - F.col("start_ms")) / 1000).alias("time_s"), F.count_if(F.col("status") == "estimated").alias("est"))
    w = Window.partitionBy("match_id")
    total = F.when(F.count("time_s").over(w) == F.count("*").over(w), F.sum("time_s").over(w))
    state = F.when(F.coalesce(total, F.lit(0.0)) <= 0, "unavailable").when(F.sum("est").over(w) > 0, "estimated").otherwise("partial")
    return p.select("match_id", "team", rounded(F.col("time_s"), 4).alias("time_s"), F.when(total > 0, rounded(100 * F.col("time_s") / total, 2)).alias("share_pct"), state.alias("state"))


def event_maps(events: DataFrame) -> DataFrame:
    """match_id, kind, events: what happened where, in order of time and id; places that are not known say so."""
    row = F.struct("start_ms", "event_id", "team", "player_id", "x", "y", "end_x", "end_y", F.when(F.col("x").isNotNull(), "available").otherwise("unavailable").alias("spatial"))
    return events.groupBy("match_id", "kind").agg(F.array_sort(F.collect_list(row)).alias("events"))


def with_duration(report: DataFrame, duration_ms: Column, fps: Column) -> DataFrame:
    """Coverage by the source's own duration: clip_frames, coverage and problem (NULL if the duration holds what was observed).

    report: last_frame, frames_seen. A duration that excludes observed frames is a problem, not a number.
    """
    frames = F.ceil(duration_ms / 1000 * fps - 1e-9).cast("long")
    seen, last = F.col("frames_seen"), F.coalesce("last_frame", F.lit(0))
    problem = F.when(duration_ms.isNull(), None).when((duration_ms <= 0) | (frames <= 0), "source duration must be positive").when(last > frames, "source duration excludes observed frames").when((seen < 0) | (seen > frames), "observed frame count exceeds the source interval")
    fine = problem.isNull() & duration_ms.isNotNull()
    return report.withColumn("problem", problem).withColumn("clip_frames", F.when(fine, frames)).withColumn("coverage", F.when(fine, rounded(seen / frames, 4)))
