"""Row filters and small rules of detections, tracks and rosters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def sane_boxes(df: DataFrame, least_corner: float = 1.0, least_side: float = 2.0, least_area: float = 0.0) -> DataFrame:
    """Boxes (x, y, w, h) whose corner is inside the picture, whose sides are `least_side` or more, and whose area is above a floor."""
    return df.where((F.col("x") >= least_corner) & (F.col("y") >= least_corner) & (F.col("w") >= least_side) & (F.col("h") >= least_side) & (F.col("w") * F.col("h") > least_area))


def in_scale(df: DataFrame, low: float, high: float) -> DataFrame:
    """Boxes whose root of the area is strictly within a range."""
    area = F.col("w") * F.col("h")
    return df.where((area > low * low) & (area < high * high))


def confident(df: DataFrame, floors: Mapping[str, float], kind: str = "label", score: str = "score") -> DataFrame:
    """Rows of known classes whose score reaches their class's floor."""
    floor = F.create_map(*[F.lit(v) for kv in floors.items() for v in kv])
    return df.where(F.col(score) >= F.element_at(floor, F.col(kind)))


def small_tracks_as(df: DataFrame, keys: Keys, below: float = 800.0, role: str = "ball", column: str = "role") -> DataFrame:
    """Rows of tracks whose mean box area is below a bound get another role."""
    area = F.avg(F.col("w") * F.col("h")).over(Window.partitionBy(*keys))
    return df.withColumn("_area", area).withColumn(column, F.when(F.col("_area") < below, role).otherwise(F.col(column))).drop("_area")


def strided(df: DataFrame, stride: int, frame: str = "frame") -> DataFrame:
    return df.where(F.col(frame) % stride == 0)


def long_tracks(df: DataFrame, keys: Keys, ident: str = "track_id", least: int = 20, floor: int = 4, ratio: float = 0.5, truncated: bool = True) -> DataFrame:
    """Rows without short tracks of players and referees.

    truncated: a track that begins near the end has to last only for `ratio` of the frames
    that are left (rounded half to even), at least `floor`, at most `least`.
    """
    w = Window.partitionBy(*keys, ident)
    last = df.groupBy(*keys).agg(F.max("frame").alias("_last"))
    need = F.greatest(F.lit(floor), F.least(F.lit(least), F.bround((F.col("_last") - F.min("frame").over(w) + 1) * ratio, 0).cast("int"))) if truncated else F.lit(least)
    rows = df.join(last, list(keys)).withColumn("_n", F.count("*").over(w)).withColumn("_need", need)
    return rows.where(~F.lower("role").isin("player", "referee") | (F.col("_n") >= F.col("_need"))).drop("_n", "_need", "_last")


def grid_peaks(cells: DataFrame, keys: Keys, reach: int = 1) -> DataFrame:
    """Cells (keys, gx, gy, value) that no cell within `reach` in either direction exceeds. Each cell serves its neighbours: an equi-join, no pairs of cells."""
    steps = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    served = cells.withColumn("_dx", steps).withColumn("_dy", steps).select(*keys, (F.col("gx") + F.col("_dx")).alias("gx"), (F.col("gy") + F.col("_dy")).alias("gy"), F.col("value").alias("_v"))
    best = served.groupBy(*keys, "gx", "gy").agg(F.max("_v").alias("_best"))
    return cells.join(best, [*keys, "gx", "gy"]).where(F.col("value") >= F.col("_best")).drop("_best")


def allowed_numbers(roster: DataFrame, starters_only: bool = False) -> DataFrame:
    """role, team, number: goalkeepers may have goalkeepers' numbers, players the others'; starters_only narrows to the line-up of teams that have one.

    roster: team, number, is_keeper, is_starter.
    """
    r = roster
    if starters_only:
        r = r.withColumn("_any", F.max(F.col("is_starter").cast("int")).over(Window.partitionBy("team"))).where((F.col("_any") == 0) | F.col("is_starter")).drop("_any")
    return r.select(F.when(F.col("is_keeper"), "goalkeeper").otherwise("player").alias("role"), "team", "number")


def defending_votes(players: DataFrame, keys: Keys, sign: Column, deepest: int = 2, least_depth: float = 25.0) -> DataFrame:
    """keys, team, votes: teams of the deepest players of each frame towards a goal, in frames where someone is that deep."""
    depth = F.col("x") * sign
    w = Window.partitionBy(*keys, "frame")
    r = players.withColumn("_d", depth).withColumn("_rk", F.row_number().over(w.orderBy(F.col("_d").desc(), "track_id"))).withColumn("_top", F.max("_d").over(w))
    return r.where((F.col("_top") >= least_depth) & (F.col("_rk") <= deepest)).groupBy(*keys, "team").agg(F.count("*").alias("votes"))


def roster_check(reads: DataFrame, roster: DataFrame) -> DataFrame:
    """side, identities, reads, outside: numbers read by side (side, track_id, number), and how many are in neither squad."""
    known = roster.select("number").distinct().withColumn("_in", F.lit(True))
    return reads.join(known, "number", "left").groupBy("side").agg(F.countDistinct("track_id").alias("identities"), F.count("*").alias("reads"), F.count_if(F.col("_in").isNull()).alias("outside"))


def squad_check(reads: DataFrame, roster: DataFrame) -> DataFrame:
    """team, found, starters_found, starters_missing (arrays of numbers) by squad."""
    seen = reads.select("number").distinct().withColumn("_seen", F.lit(True))
    r = roster.join(seen, "number", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
    pick = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("number"))))
    return r.groupBy("team").agg(pick(F.col("_seen")).alias("found"), pick(F.col("_seen") & F.col("is_starter")).alias("starters_found"), pick(~F.col("_seen") & F.col("is_starter")).alias("starters_missing"))


def clusters_to_teams(evidence: DataFrame, roster: DataFrame) -> DataFrame:
    """direct, swapped, mapping of evidence (cluster 0 or 1, number, weight): how much of it lies in the squads (team 0 or 1) either way; direct wins ties."""
    e = evidence.join(roster.select("team", "number").distinct(), "number")
    s = e.agg(F.coalesce(F.sum(F.when(F.col("cluster") == F.col("team"), F.col("weight"))), F.lit(0.0)).alias("direct"), F.coalesce(F.sum(F.when(F.col("cluster") != F.col("team"), F.col("weight"))), F.lit(0.0)).alias("swapped"))
    return s.withColumn("mapping", F.when(F.col("direct") >= F.col("swapped"), "direct").otherwise("swapped"))


def named(rows: DataFrame, roster: DataFrame) -> DataFrame:
    """rows (team, number, ..) with the name of the roster (team, number, name), NULL where there is none."""
    return rows.join(roster.select("team", "number", "name").dropDuplicates(["team", "number"]), ["team", "number"], "left")


def coverage_joins(labels: DataFrame, summaries: DataFrame, keys: Keys) -> tuple[DataFrame, DataFrame]:
    """Labels of known tracks, and summaries that no label names."""
    return labels.join(summaries.select(*keys).distinct(), list(keys), "left_semi"), summaries.join(labels.select(*keys).distinct(), list(keys), "left_anti")


# The canvas of a drawn pitch, in pixels a metre and a margin.
CANVAS_SCALE, CANVAS_MARGIN = 10.0, 50.0


def to_canvas(x: Column, y: Column, scale: float = CANVAS_SCALE, margin: float = CANVAS_MARGIN) -> Column:
    """struct(px, py): pixels of a place on the pitch, truncated as integers are."""
    return F.struct(((x + 52.5) * scale + margin).cast("int").alias("px"), ((y + 34.0) * scale + margin).cast("int").alias("py"))


def from_canvas(px: Column, py: Column, scale: float = CANVAS_SCALE, margin: float = CANVAS_MARGIN) -> Column:
    return F.struct(((px - margin) / scale - 52.5).alias("x"), ((py - margin) / scale - 34.0).alias("y"))


def clock(frame: Column, fps: float, segment_start: Column, period: Column) -> Column:
    """struct(video_s, segment_s, text, period): where a frame stands on the clocks."""
    video, own = frame / fps, (frame - segment_start) / fps
    text = F.format_string("%02d:%06.3f", F.floor(own / 60).cast("int"), own % 60)
    return F.struct(video.alias("video_s"), own.alias("segment_s"), text.alias("text"), period.alias("period"))


def payload(row: Column) -> Column:
    """A nested row as canonical JSON text, NULLs written out."""
    return F.to_json(row, {"ignoreNullFields": "false"})
