"""Aggregates: majorities with defined ties, tri-state metrics, posteriors, shape and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.columns import third, zone

Keys = Sequence[str]


def majority(df: DataFrame, keys: Keys, value: str, order: str, name: str | None = None) -> DataFrame:
    """Commonest non-null value per key; ties: the one seen first. Keys without any value are NULL."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    known = F.col(value).isNotNull()
    best = F.max_by(value, F.when(known, F.struct("_n", -F.col("_first"))))
    return counts.groupBy(*keys).agg(best.alias(name or value))


def sentinel_majority(df: DataFrame, keys: Keys, value: str, order: str, sentinel: int = 100, share: float = 0.97) -> DataFrame:
    """Majority in which the sentinel wins only when alone or with at least `share` of the votes; share 1: only when unanimous."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    per = counts.groupBy(*keys).agg(
        F.sum("n").alias("votes"),
        F.sum(F.when(F.col(value) == sentinel, F.col("n")).otherwise(0)).alias("blank"),
        F.max_by(value, F.when(F.col(value) != sentinel, F.struct("n", -F.col("f")))).alias("best"),
    )
    return per.select(*keys, F.when((F.col("blank") >= share * F.col("votes")) | F.col("best").isNull(), F.lit(sentinel)).otherwise(F.col("best")).alias(value), "votes")


def share_of_total(df: DataFrame, keys: Keys, within: Keys, measure: str, empty: float | None = 1.0) -> DataFrame:
    """Sum per key and its share of the sum over `within`; `empty` where that sum is zero."""
    sums = df.groupBy(*within, *keys).agg(F.sum(measure).alias(measure))
    total = F.sum(measure).over(Window.partitionBy(*within))
    return sums.withColumn("share", F.when(total > 0, F.col(measure) / total).otherwise(F.lit(empty).cast("double")))


def network(df: DataFrame, source: str, target: str, outcome: str, evidence: str, keys: Keys = ()) -> DataFrame:
    """Passes from one to another: how many, how many completed (NULL unless all outcomes are known), and the sorted evidence."""
    known = F.count(outcome) == F.count("*")
    return df.groupBy(*keys, source, target).agg(F.count("*").alias("passes"), F.when(known, F.count_if(F.col(outcome))).alias("completed"), F.array_sort(F.collect_list(evidence)).alias("evidence"))


def heatmap(df: DataFrame, keys: Keys, nx: int = 14, ny: int = 9, half_length: float = 52.5, half_width: float = 34.0) -> DataFrame:
    return df.groupBy(*keys, zone(F.col("x"), half_length, nx).alias("zx"), zone(F.col("y"), half_width, ny).alias("zy")).agg(F.count("*").alias("n"))


def thirds(df: DataFrame, keys: Keys) -> DataFrame:
    """Share of rows in each third.

    The sign is that of the published report: a left-side row at x = -40 counts as
    attacking. Line heights use the other sign; both are kept on purpose.
    """
    sign = F.when(F.col("team") == "left", -1).otherwise(1)
    t = third(F.col("x"), sign)
    return df.groupBy(*keys).agg(*[F.avg((t == name).cast("double")).alias(name) for name in ("defensive", "middle", "attacking")])


ZONES = (("walk", 0.0, 2.0), ("jog", 2.0, 4.0), ("run", 4.0, 5.5), ("high", 5.5, 7.0), ("sprint", 7.0, 99.0))


def speed_zones(df: DataFrame, keys: Keys, fps: float, most_gap: int = 12) -> DataFrame:
    """Time and distance by band of speed, [low, high); steps over larger gaps are skipped."""
    w = Window.partitionBy(*keys).orderBy("frame")
    step = df.select(*keys, (F.col("frame") - F.lag("frame").over(w)).alias("gap"), F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)).alias("step"))
    step = step.where(F.col("gap").between(1, most_gap)).withColumn("speed", F.col("step") / (F.col("gap") / fps))
    band = F.lit(None).cast("string")
    for name, low, high in reversed(ZONES):
        band = F.when((F.col("speed") >= low) & (F.col("speed") < high), name).otherwise(band)
    return step.withColumn("zone", band).where("zone is not null").groupBy(*keys, "zone").agg((F.sum("gap") / fps).alias("seconds"), F.sum("step").alias("metres"))


def team_shape(df: DataFrame, keys: Keys, least: int = 4) -> DataFrame:
    """Width, depth, compactness and line height: per frame and side with enough players, then the median over frames."""
    side = Window.partitionBy(*keys, "frame", "team")
    sign = F.when(F.col("team") == "left", 1).otherwise(-1)
    c = df.withColumn("cx", F.avg("x").over(side)).withColumn("cy", F.avg("y").over(side))
    away = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    per = c.groupBy(*keys, "frame", "team").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("width"), (F.max("x") - F.min("x")).alias("depth"), F.avg(away).alias("compactness"), F.avg(F.col("x") * sign).alias("line"))
    return per.where(F.col("n") >= least).groupBy(*keys, "team").agg(F.count("*").alias("frames"), *[F.median(m).alias(m) for m in ("width", "depth", "compactness", "line")])


def rank_correlation(df: DataFrame, keys: Keys, a: str, b: str) -> DataFrame:
    """Spearman correlation with average ranks; 0 where a side is constant."""

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    r = df.withColumn("_ra", average_rank(a)).withColumn("_rb", average_rank(b))
    moments = r.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_ra").alias("sa"), F.stddev_pop("_rb").alias("sb"), F.covar_pop("_ra", "_rb").alias("c"))
    return moments.select(*keys, "n", F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("c") / (F.col("sa") * F.col("sb"))).otherwise(0.0).alias("rho"))


def frame_validity(stats: DataFrame, keys: Keys, most_outside: float = 0.25, least_extent: float = 8.0, least_corr: float = 0.7, least_people: int = 6) -> DataFrame:
    """The first reason that rejects a frame, NULL if none; few people: only the first test. The clip's orientation is the sign of the median of clear correlations."""
    clear = F.when(F.abs("rho") >= 0.8, F.col("rho"))
    sign = stats.groupBy(*keys).agg(F.coalesce(F.signum(F.median(clear)), F.lit(0.0)).alias("orientation"))
    s = stats.join(sign, list(keys))
    many = F.col("people") >= least_people
    reason = (
        F.when(F.col("outside") > most_outside, "outside the pitch")
        .when(many & (F.col("extent") < least_extent), "collapsed")
        .when(many & (F.abs("rho") < least_corr), "not in order")
        .when(many & (F.col("orientation") != 0) & (F.signum("rho") != F.col("orientation")), "mirrored")
    )
    return s.withColumn("reason", reason)


def all_or_nothing(measure: str) -> Column:
    """Sum that is NULL unless every row has the number."""
    return F.when(F.count(measure) == F.count("*"), F.sum(measure))


def log_pool(df: DataFrame, keys: Keys, observation: str, value: str, confidence: str) -> DataFrame:
    """Posterior of each value by logarithmic pooling of confidences.

    Repeated readings of an observation count once (the most confident); a value's score is
    log(0.2 / n) + sum of log(1 + 9 c / C), with C the observation's total and n the values.
    """
    once = df.groupBy(*keys, observation, value).agg(F.max(confidence).alias("c"))
    once = once.withColumn("total", F.sum("c").over(Window.partitionBy(*keys, observation)))
    score = once.groupBy(*keys, value).agg(F.sum(F.log1p(9.0 * F.col("c") / F.col("total"))).alias("s"))
    w = Window.partitionBy(*keys)
    score = score.withColumn("s", F.col("s") + F.log(F.lit(0.2) / F.count("*").over(w)))
    e = F.exp(F.col("s") - F.max("s").over(w))
    return score.withColumn("e", e).select(*keys, value, (F.col("e") / F.sum("e").over(w)).alias("posterior"))


def expected_calibration_error(df: DataFrame, keys: Keys, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    b = F.least((F.col(confidence) * bins).cast("int"), F.lit(bins - 1))
    per = df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("conf"), F.avg(F.col(correct).cast("double")).alias("acc"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n")).alias("ece"))


def classification_report(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Per class: support, precision, recall, F1 (0 where undefined)."""
    labels = df.select(F.col(truth).alias("label")).unionByName(df.select(F.col(prediction).alias("label"))).distinct()
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(prediction)).alias("tp"))
    p = df.groupBy(F.col(prediction).alias("label")).agg(F.count("*").alias("predicted"))
    x = labels.join(t, "label", "left").join(p, "label", "left").na.fill(0)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    x = x.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return x.select("label", "support", "predicted", "precision", "recall", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0).alias("f1"))


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
