"""Scalar and array column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LENGTH, HALF_WIDTH = 52.5, 34.0
BOX_DEPTH, BOX_HALF_WIDTH = 16.5, 20.16
GOAL_HALF = 3.66


# ------------------------------------------------------------------ text
def clean_text(c: Column) -> Column:
    """Trimmed text; NULL for what stands for nothing: '', 'nan' in any case and '100'."""
    t = F.trim(c)
    return F.when(F.lower(t).isin("", "nan", "100"), None).otherwise(t)


def timecode(seconds: Column) -> Column:
    """MM:SS.mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)


def number_in(text: Column) -> Column:
    """The first number of one or two digits, unless the text says there is none."""
    low = F.lower(text)
    found = F.regexp_extract(text, r"(\d{1,2})", 1)
    return F.when(low.contains("none") | low.contains("no "), None).when(found == "", None).otherwise(found.cast("int"))


def two_digits(tens: Column, units: Column, blank: int = 10, unknown: int = 100) -> Column:
    """A number from two digit readings; `blank` is no digit and `unknown` no number."""
    return F.when((tens == blank) & (units == blank), unknown).when(tens == blank, units).when(units == blank, tens).otherwise(tens * 10 + units)


# ------------------------------------------------------------------ geometry
def direction(team: Column) -> Column:
    """+1 for the side that attacks +x, -1 otherwise (no side too)."""
    return F.when(team == "left", F.lit(1)).otherwise(F.lit(-1))


def inside_pitch(x: Column, y: Column, margin_x: float = 3.0, margin_y: float = 3.0) -> Column:
    return (F.abs(x) <= HALF_LENGTH + margin_x) & (F.abs(y) <= HALF_WIDTH + margin_y)


def in_box(x: Column, y: Column, sign: Column) -> Column:
    """Inside the box attacked by a side."""
    return (x * sign >= HALF_LENGTH - BOX_DEPTH) & (F.abs(y) <= BOX_HALF_WIDTH)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def goal_line_offset(x0: Column, y0: Column, x1: Column, y1: Column, sign: Column) -> Column:
    """Where a straight line meets the goal line: |y|; NULL unless it moves towards the goal."""
    dx = (x1 - x0) * sign
    t = (sign * HALF_LENGTH - x0) / F.nullif(x1 - x0, F.lit(0.0))
    return F.when(dx > 0, F.abs(y0 + t * (y1 - y0)))


def third(x: Column, sign: Column) -> Column:
    """Pitch third seen by a side; the edges belong to the middle."""
    a = x * sign
    return F.when(a < -17.5, "defensive").when(a <= 17.5, "middle").otherwise("attacking")


def zone(v: Column, half: float, n: int) -> Column:
    """Grid cell of a coordinate, clamped to the edge."""
    return F.least(F.greatest(((v + half) / (2 * half) * n).cast("int"), F.lit(0)), F.lit(n - 1))


def control_radius(speed: Column, slow: float = 5.0, fast: float = 15.0, near: float = 1.2, far: float = 2.5) -> Column:
    """Radius of control by ball speed: linear between slow and fast."""
    return F.when(speed.isNull() | F.isnan(speed) | (speed <= slow), far).when(speed >= fast, near).otherwise(far + (near - far) * (speed - slow) / (fast - slow))


def project(h: Column, x: Column, y: Column) -> Column:
    """struct(x, y): a point under a homography given as an array of nine numbers, row by row."""
    e = lambda k: F.element_at(h, k + 1)
    w = e(6) * x + e(7) * y + e(8)
    return F.struct(((e(0) * x + e(1) * y + e(2)) / w).alias("x"), ((e(3) * x + e(4) * y + e(5)) / w).alias("y"))


# ------------------------------------------------------------------ boxes (x, y, w, h from the top left)
def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    both = w * h
    union = aw * ah + bw * bh - both
    return F.when(union > 0, both / union).otherwise(0.0)


def expanded(x: Column, y: Column, w: Column, h: Column, e: float) -> tuple[Column, Column, Column, Column]:
    """A box grown by 2e of its size, the growth halved downwards on each side."""
    gw, gh = F.floor(w * 2 * e / 2), F.floor(h * 2 * e / 2)
    return x - gw, y - gh, w + 2 * gw, h + 2 * gh


def expanded_iou(a: tuple[Column, ...], b: tuple[Column, ...], e: float) -> Column:
    return iou(*expanded(*a, e), *expanded(*b, e))


def giou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Generalised IoU, rescaled from (-1, 1) to (0, 1)."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    hull = (F.greatest(ax + aw, bx + bw) - F.least(ax, bx)) * (F.greatest(ay + ah, by + bh) - F.least(ay, by))
    w = F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0))
    h = F.greatest(F.least(ay + ah, by + bh) - F.greatest(ay, by), F.lit(0.0))
    union = aw * ah + bw * bh - w * h
    return (iou(*a, *b) - (hull - union) / hull + 1) / 2


def centre_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x + w / 2).alias("cx"), (y + h / 2).alias("cy"), w.alias("w"), h.alias("h"))


def corner_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def aspect_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct((x + w / 2).alias("cx"), (y + h / 2).alias("cy"), (w / h).alias("aspect"), h.alias("h"))


# ------------------------------------------------------------------ vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, clamp: bool = False) -> Column:
    n = norm(a) * norm(b)
    c = F.when(n > 0, dot(a, b) / n).otherwise(0.0)
    return F.greatest(c, F.lit(0.0)) if clamp else c


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def part_distance(a: Column, b: Column, seen_a: Column, seen_b: Column) -> Column:
    """Mean distance over the parts that both sides show; -1 where there is none. a, b: arrays of vectors; seen: arrays of weights."""
    w = F.zip_with(seen_a, seen_b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double")))
    d = F.zip_with(a, b, lambda x, y: F.sqrt(squared_distance(x, y)))
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.aggregate(F.zip_with(d, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / total).otherwise(-1.0)


def gaussian_similarity(d: Column, tolerance: float, floor: float = 0.05) -> Column:
    """exp(-d^2 / 2 sigma^2), with sigma so that `tolerance` metres score `floor`."""
    import math

    return F.exp(d * d * math.log(floor) / (tolerance * tolerance))


# ------------------------------------------------------------------ maps and arrays
def median_of(values: Column) -> Column:
    """Median of an array, the mean of the middle two for even counts; NULL if empty."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(s)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return F.when(n > 0, (low + high) / 2)


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array: for even counts the upper of the middle two."""
    s = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, F.floor(F.size(s) / 2).cast("int") + 1))


def mode_of_three(before: Column, own: Column, after: Column) -> Column:
    """Mode of a row and its neighbours; all different: the smallest; a missing neighbour counts as none."""
    pair = F.when(before.isNull(), F.least(own, after)).when(after.isNull(), F.least(own, before))
    return F.when((own == before) | (own == after), own).when(before == after, before).when(before.isNull() | after.isNull(), F.coalesce(pair, own)).otherwise(F.least(before, own, after))


def normalised(counts: Column) -> Column:
    """A map of counts as shares."""
    total = F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(counts, lambda _, v: v / total)


def map_overlap(p: Column, q: Column) -> Column:
    """Sum of the smaller shares of two distributions."""
    both = F.map_zip_with(p, q, lambda _, a, b: F.least(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
    return F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)


def argmax_key(m: Column) -> Column:
    """The key of the largest value; ties: the smallest key."""
    e = F.array_sort(F.transform(F.map_entries(m), lambda x: F.struct((-x["value"]).alias("v"), x["key"].alias("k"))))
    return F.when(F.size(e) > 0, F.element_at(e, 1)["k"])


def canonical_hash(prefix: str, length: int, *parts: Column) -> Column:
    """prefix and the first `length` hex digits of the SHA-256 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))


def view_quality(sharpness: Column, resolution: Column, occlusion: Column, back: Column, front: Column, side: Column, confidence: Column, weights: tuple[float, ...] = (0.25, 0.20, 0.20, 0.15, 0.08, 0.02, 0.10), scale: float = 250.0) -> Column:
    """A view's score: seven weighted features, all within 0 and 1; sharpness saturates."""
    w = [F.lit(x) for x in weights]
    return w[0] * (1 - F.exp(-F.greatest(sharpness, F.lit(0.0)) / scale)) + w[1] * resolution + w[2] * (1 - occlusion) + w[3] * back + w[4] * front + w[5] * side + w[6] * confidence
