"""Trajectories that a body could have run: longest chains, interpolation and smoothing in one pass.

Rows are dealt by their keys (a match, or a match and a track), sorted by frame, and stream
through Python in Arrow batches; a task holds the rows of one batch and of one key. All
segments of a batch are worked on side by side: the chain of longest length is found in
steps over the place within the segment, where one step looks at every segment's row of that
place against the rows before it that are still in reach of time. Nothing is shuffled after
the rows are dealt: cutting, chaining, filling, smoothing and chaining again are one stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Keys = Sequence[str]


@dataclass(frozen=True)
class Body:
    """What can be reached: metres a second, with some tolerance, within a number of frames."""

    speed: float
    fps: float = 25.0
    tolerance: float = 0.25
    lookback: int = 50


def chain_mask(starts: np.ndarray, frames: np.ndarray, x: np.ndarray, y: np.ndarray, body: Body) -> np.ndarray:
    """Which rows are on the longest chain of their segment.

    Segments are runs of rows from each of `starts` on, in order of frames. A row may follow
    an earlier one of its segment if time has passed, at most `lookback` frames, and the
    distance is within reach. Of equally long chains to a row, that through the earliest row
    counts; of equally long chains of a segment, that with the earliest end.
    """
    n = len(frames)
    if not n:
        return np.zeros(0, bool)
    sizes = np.diff(np.append(starts, n))
    first = np.repeat(starts, sizes)
    place = np.arange(n) - first
    # frames made increasing over all segments, so that one search finds where reach begins
    lift = np.repeat(np.cumsum(np.append(0, np.full(len(starts) - 1, float(frames.max() - frames.min() + body.lookback + 1)))), sizes)
    back = np.arange(n) - np.searchsorted(frames + lift, frames + lift - body.lookback, "left")
    length, before = np.ones(n, np.int64), np.full(n, -1, np.int64)
    by_place = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[by_place], np.arange(int(place.max()) + 2))
    for step in range(1, len(edges) - 1):
        rows = by_place[edges[step] : edges[step + 1]]
        rows = rows[back[rows] > 0]
        if not len(rows):
            continue
        lag = np.arange(int(back[rows].max()), 0, -1)  # the earliest candidate first
        at = rows[:, None] - lag
        inside = lag <= back[rows][:, None]
        at[~inside] = rows[0]
        passed = (frames[rows][:, None] - frames[at]) / body.fps
        far = np.hypot(x[rows][:, None] - x[at], y[rows][:, None] - y[at])
        told = np.where(inside & (passed > 0) & (far <= body.speed * passed + body.tolerance), length[at], 0)
        pick = told.argmax(1)
        best = told[np.arange(len(rows)), pick]
        got = best > 0
        length[rows[got]] = best[got] + 1
        before[rows[got]] = at[got, pick[got]]
    # the first row of each segment's greatest length, then back along all chains at once
    top = np.maximum.reduceat(length, starts)
    ends = np.flatnonzero(length == np.repeat(top, sizes))
    live = ends[np.unique(first[ends], return_index=True)[1]]
    keep = np.zeros(n, bool)
    while len(live):
        keep[live] = True
        live = before[live]
        live = live[live >= 0]
    return keep


def longest_run(frames: np.ndarray, x: np.ndarray, y: np.ndarray, body: Body) -> np.ndarray:
    """Row numbers of the longest chain of one segment."""
    return np.flatnonzero(chain_mask(np.zeros(min(1, len(frames)), np.int64), np.asarray(frames, float), np.asarray(x, float), np.asarray(y, float), body))


def filled(starts: np.ndarray, frames: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(source row, frames, values, whether new) with linear rows in gaps of 2 to `most` frames within segments."""
    n = len(frames)
    gap = np.ones(n, np.int64)
    gap[:-1] = np.diff(frames).astype(np.int64)
    last = np.zeros(n, bool)
    last[np.append(starts[1:], n) - 1] = True
    more = np.where(last | (gap < 2) | (gap > most), 0, gap - 1)
    row = np.repeat(np.arange(n), more + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    follow = np.minimum(row + 1, n - 1)
    share = (k / gap[row])[:, None]
    lerp = np.where(k[:, None] > 0, values[row] + (values[follow] - values[row]) * share, values[row])
    return row, frames[row] + k, lerp, k > 0


def _near(segment: np.ndarray, frames: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows within half frames of each row, as a matrix with a mask; frames increase within segments."""
    at = np.arange(len(frames))[:, None] + np.arange(-half, half + 1)
    ok = (at >= 0) & (at < len(frames))
    at = np.where(ok, at, 0)
    return at, ok & (segment[at] == segment[:, None]) & (np.abs(frames[at] - frames[:, None]) <= half)


def smoothed(segment: np.ndarray, frames: np.ndarray, values: np.ndarray, half_median: int = 2, half_mean: int = 5) -> np.ndarray:
    """A median over rows within half_median frames, then a mean of the medians within half_mean frames; edges shrink."""
    if not len(frames):
        return values
    at, ok = _near(segment, frames, half_median)
    low = np.nanmedian(np.where(ok[..., None], values[at], np.nan), axis=1)
    at, ok = _near(segment, frames, half_mean)
    return np.where(ok[..., None], low[at], 0).sum(1) / ok.sum(1)[:, None]


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches regrouped so that no key goes over two of them."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        whole = (table if held is None else pa.concat_tables([held, table])).combine_chunks()
        new = np.zeros(whole.num_rows, bool)
        new[0] = True
        for k in range(keys):
            v = whole.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cut = int(np.flatnonzero(new)[-1])
        held = whole.slice(cut)
        if cut:
            yield whole.slice(0, cut)
    if held is not None:
        yield held


def clean_tracks(df: DataFrame, keys: Keys, body: Body, gap: int, fill: int = 0, smooth: bool = False, again: bool = False, least: int = 1) -> DataFrame:
    """Rows (keys, island, frame, x, y, interpolated) of possible trajectories.

    Each key's rows are cut into islands where more than `gap` frames are missing; of each
    island of `least` rows or more the longest chain stays. fill: gaps of up to so many
    frames are interpolated; smooth: median, then mean; again: once more the longest chain.
    """
    rows = df.select(*keys, F.col("frame").cast("double").alias("frame"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("frame is not null and x is not null and y is not null")
    n = len(keys)
    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "island bigint, frame bigint, x double, y double, interpolated boolean"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_key(batches, n):
            frames, x, y = (t.column(n + k).to_numpy() for k in range(3))
            new = np.ones(len(frames), bool)
            new[1:] = False
            for k in range(n):
                v = t.column(k).to_numpy()
                new[1:] |= v[1:] != v[:-1]
            key = np.cumsum(new) - 1
            part = new.copy()
            part[1:] |= np.diff(frames) > gap
            island = np.cumsum(part) - 1
            number = island - island[np.flatnonzero(new)][key]
            size = np.bincount(island)
            origin = np.arange(len(frames))

            def chain(origin, frames, x, y, own, size=size):
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                return chain_mask(starts, frames, x, y, body) | (size[own] < least)

            keep = chain(origin, frames, x, y, island)
            origin, frames, xy, own = origin[keep], frames[keep], np.column_stack([x[keep], y[keep]]), island[keep]
            made = np.zeros(len(frames), bool)
            if fill and len(frames):
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                row, frames, xy, made = filled(starts, frames, xy, fill)
                origin, own = origin[row], own[row]
            if smooth:
                xy = smoothed(own, frames, xy)
            if again and len(frames):
                keep = chain(origin, frames, xy[:, 0], xy[:, 1], own)
                origin, frames, xy, made = origin[keep], frames[keep], xy[keep], made[keep]
            named = t.select(range(n)).take(pa.array(origin))
            columns = [*(c.combine_chunks() for c in named.columns), pa.array(number[origin]), pa.array(frames.astype(np.int64)), pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1])), pa.array(made)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "island", "frame", "x", "y", "interpolated"])

    return rows.repartition(*keys).sortWithinPartitions(*keys, "frame", "x", "y").mapInArrow(clean, schema)
