"""Segmentation, rolling statistics, filling and interpolation over ordered rows.

Every window is partitioned by the caller's keys (match, and track where there is one), so
the work spreads over matches and no window is global.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import median_of, mode_of_three

Keys = Sequence[str]


def islands(df: DataFrame, keys: Keys, order: Keys, breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a row where `breaks` holds (or the first one) starts a new run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    # a window function cannot be nested in another, so the flag is a column first
    flagged = df.withColumn("_new", F.coalesce(breaks.cast("int"), F.lit(0)))
    return flagged.withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_islands(df: DataFrame, keys: Keys, frame: str = "frame", gap: int = 12, name: str = "island") -> DataFrame:
    """Runs of frames: a gap of up to `gap` stays inside."""
    w = Window.partitionBy(*keys).orderBy(frame)
    return islands(df, keys, [frame], F.col(frame) - F.lag(frame).over(w) > gap, name)


def segments(df: DataFrame, keys: Keys, frame: str = "frame", gap: int = 12) -> DataFrame:
    """start, end and size of each run of frames."""
    return gap_islands(df.select(*keys, frame).distinct(), keys, frame, gap).groupBy(*keys, "island").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count("*").alias("samples"))


def change_islands(df: DataFrame, keys: Keys, order: Keys, value: str, name: str = "island") -> DataFrame:
    """Run-length encoding: a new run wherever the value changes (NULL equals NULL)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return islands(df, keys, order, ~F.col(value).eqNullSafe(F.lag(value).over(w)), name)


def rolling_median_time(df: DataFrame, keys: Keys, frame: str, value: str, half: int, name: str) -> DataFrame:
    """Median over all rows within `half` frames: a range of time, not of rows; edges shrink."""
    w = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-half, half)
    return df.withColumn(name, median_of(F.collect_list(value).over(w)))


def rolling_mean_time(df: DataFrame, keys: Keys, frame: str, value: str, half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(frame).rangeBetween(-half, half)))


def rolling_median_rows(df: DataFrame, keys: Keys, order: Keys, value: str, half: int, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn(name, median_of(F.collect_list(value).over(w)))


def rolling_mean_rows(df: DataFrame, keys: Keys, order: Keys, value: str, half: int, name: str) -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)))


def smooth_track(df: DataFrame, keys: Keys, half_median: int = 2, half_mean: int = 5) -> DataFrame:
    """x and y by a rolling median, then a rolling mean of the medians, per segment (keys must name it)."""
    for c in ("x", "y"):
        df = rolling_median_time(df, keys, "frame", c, half_median, f"_{c}")
    for c in ("x", "y"):
        df = rolling_mean_time(df, keys, "frame", f"_{c}", half_mean, f"smooth_{c}")
    return df.drop("_x", "_y")


def mode_filter(df: DataFrame, keys: Keys, order: Keys, value: str, name: str) -> DataFrame:
    """Mode over a row and its two neighbours; ties go to the smallest value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn(name, mode_of_three(F.col("_a"), F.col(value), F.col("_b"))).drop("_a", "_b")


def fill_forward(df: DataFrame, keys: Keys, order: Keys, value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def fill_both(df: DataFrame, keys: Keys, order: Keys, value: str, name: str) -> DataFrame:
    """Forward fill, then backward fill of what stands before the first value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(before, after))


def interpolate(df: DataFrame, keys: Keys, frame: str = "frame", values: Keys = ("x", "y"), most: int = 12) -> DataFrame:
    """Linear rows for missing frames in gaps of 2 to `most` frames; interpolated says which rows are new."""
    w = Window.partitionBy(*keys).orderBy(frame)
    rows = df.withColumn("_next", F.lead(frame).over(w))
    for c in values:
        rows = rows.withColumn(f"_{c}", F.lead(c).over(w))
    gap = F.col("_next") - F.col(frame)
    new = rows.where(gap.between(2, most)).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), (gap - 1).cast("long"))))
    lerp = [(F.col(c) + (F.col(f"_{c}") - F.col(c)) * F.col("_k") / gap).alias(c) for c in values]
    new = new.select(*keys, (F.col(frame) + F.col("_k")).alias(frame), *lerp, F.lit(True).alias("interpolated"))
    return df.select(*keys, frame, *values, F.lit(False).alias("interpolated")).unionByName(new)


def speeds(df: DataFrame, keys: Keys, fps: float, half: int = 4) -> DataFrame:
    """Speed over a baseline of +-half frames; 0 where there is no neighbour in it."""
    w = Window.partitionBy(*keys).orderBy("frame").rangeBetween(-half, half)
    p = F.struct("frame", "x", "y")
    a, b = F.first(p).over(w), F.last(p).over(w)
    dt = (b["frame"] - a["frame"]) / fps
    d = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
    return df.withColumn("speed", F.when(dt > 0, d / dt).otherwise(0.0))


def path_length(df: DataFrame, keys: Keys, most_gap: int) -> DataFrame:
    """Sum of steps; steps over gaps of more than `most_gap` frames are skipped."""
    w = Window.partitionBy(*keys).orderBy("frame")
    step = df.select(*keys, (F.col("frame") - F.lag("frame").over(w)).alias("gap"), F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)).alias("step"))
    return step.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col("gap") <= most_gap, F.col("step"))), F.lit(0.0)).alias("distance_m"))


def sprints(df: DataFrame, keys: Keys, fps: float, fast: float = 7.0, least_s: float = 0.6) -> DataFrame:
    """Runs of rows at `fast` or more; a run ends at the first slower row, or its own last one."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.withColumn("fast", F.col("speed") >= fast).withColumn("next_frame", F.lead("frame").over(w))
    runs = change_islands(rows, keys, ["frame"], "fast").where("fast")
    runs = runs.groupBy(*keys, "island").agg(F.min("frame").alias("start_frame"), F.max_by(F.coalesce("next_frame", "frame"), "frame").alias("end_frame"), F.max("speed").alias("peak"))
    return runs.where((F.col("end_frame") - F.col("start_frame")) / fps >= least_s).drop("island")


def sprint_count(df: DataFrame, keys: Keys, fps: float, fast: float = 7.0, least_s: float = 0.8, gap: int = 3) -> DataFrame:
    """Streaks of fast rows at most `gap` frames apart that last round(least_s * fps) rows."""
    w = Window.partitionBy(*keys).orderBy("frame")
    rows = df.withColumn("fast", F.col("speed") >= fast)
    broke = ~F.col("fast").eqNullSafe(F.lag("fast").over(w)) | (F.col("frame") - F.lag("frame").over(w) > gap)
    runs = islands(rows, keys, ["frame"], broke).where("fast").groupBy(*keys, "island").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.count_if(F.col("n") >= round(least_s * fps)).alias("sprints"))


def hysteresis(df: DataFrame, keys: Keys, order: str, value: str, opens: float, stays: float, name: str = "open") -> DataFrame:
    """A state that opens at `opens` and stays until the value falls below `stays`."""
    decisive = F.when(F.col(value) >= opens, 1).when(F.col(value) < stays, 0)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.coalesce(F.last(decisive, ignorenulls=True).over(w), F.lit(0)) == 1)


def merge_intervals(df: DataFrame, keys: Keys, start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Union of intervals; those at most `gap` apart become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = islands(df, keys, [start, end], F.col(start) > reach + gap)
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def playable_segments(df: DataFrame, keys: Keys, time: str, share: str, opens: float = 0.45, stays: float = 0.40, pad: float = 0.4, merge: float = 1.0, least: float = 1.0) -> DataFrame:
    """Stretches of footage with hysteresis, padded, merged and of a least length."""
    state = hysteresis(df, keys, time, share, opens, stays)
    runs = change_islands(state, keys, [time], "open").where("open").groupBy(*keys, "island").agg(F.min(time).alias("start_s"), F.max(time).alias("end_s"))
    padded = runs.select(*keys, F.greatest(F.col("start_s") - pad, F.lit(0.0)).alias("start_s"), (F.col("end_s") + pad).alias("end_s"))
    return merge_intervals(padded, keys, "start_s", "end_s", merge).where(F.col("end_s") - F.col("start_s") >= least)


def split_intervals(df: DataFrame, start: str, end: str, most: float, name: str = "piece") -> DataFrame:
    """Intervals in ceil(length / most) equal pieces."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / most), F.lit(1)).cast("int")
    rows = df.withColumn("_n", n).withColumn(name, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    size = (F.col(end) - F.col(start)) / F.col("_n")
    return rows.withColumn("piece_start", F.col(start) + size * F.col(name)).withColumn("piece_end", F.col(start) + size * (F.col(name) + 1)).drop("_n")


def score_changes(df: DataFrame, keys: Keys, sides: Keys = ("left", "right")) -> DataFrame:
    """Rows of a score timeline where a side's score rises above its last known one."""
    w = Window.partitionBy(*keys, "side").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    long = df.select(*keys, "frame", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("score")) for s in sides])).alias("e")).select(*keys, "frame", "e.side", "e.score")
    return long.withColumn("before", F.last("score", ignorenulls=True).over(w)).where("score > before")
