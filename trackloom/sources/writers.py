"""Sinks: Parquet stores with upsert, text formats, flat reports, caches and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackloom.operators.joins import upsert


def write_ledger(df: DataFrame, path: str) -> None:
    """Ledger events by type; free attributes as JSON text beside them."""
    df.withColumn("attributes_json", F.to_json("attributes")).write.mode("overwrite").partitionBy("type").parquet(path)


def write_store(events: DataFrame, players: DataFrame, meta: DataFrame, path: str) -> None:
    """A run as three tables: events by type, players, and one row of meta; nested attributes as JSON text."""
    write_ledger(events, f"{path}/events")
    text = lambda df: df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "map", "array") else F.col(f.name) for f in df.schema.fields])
    text(players).write.mode("overwrite").parquet(f"{path}/players")
    text(meta).write.mode("overwrite").parquet(f"{path}/meta")


def write_predictions(df: DataFrame, path: str, drop: Sequence[str] = ("color",)) -> None:
    """Detections as JSON lines, attributes without what a reader must not see; NULLs are written out."""
    a = df.schema["attributes"].dataType
    kept = F.struct(*[F.col(f"attributes.{n}") for n in a.names if n not in drop])
    df.withColumn("attributes", kept).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Replace rows with the same keys; only the partitions that `new` touches are rewritten, from a table read before they are.

    Existing rows of these partitions are checkpointed to the shared folder, so that the
    overwrite never reads what it is replacing.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        old = spark.read.parquet(path)
    except (AnalysisException, Py4JJavaError):
        new.write.partitionBy(partition).parquet(path)
        return
    touched = old.join(new.select(partition).distinct(), partition, "left_semi").select(new.columns)
    merged = upsert(touched, new, keys).checkpoint()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def flattened(df: DataFrame, drop: Sequence[str] = ("source", "note")) -> DataFrame:
    """Struct columns as section_key columns, without the named fields."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StructType):
            cols += [F.col(f"{f.name}.{g}").alias(f"{f.name}_{g}") for g in f.dataType.names if g not in drop]
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_report_csv(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("header", True).csv(path)


def tracking_lines(df: DataFrame, digits: int = 2, with_score: bool = True) -> DataFrame:
    """One text line per detection with track_id >= 0: frame,id,x,y,w,h,score,-1,-1,-1."""
    scale = float(10**digits)  # half up in floating-point steps, so that the text is the same in any engine
    number = lambda c: F.format_string(f"%.{digits}f", F.floor(F.col(c).cast("double") * scale + 0.5) / scale)
    score = number("score") if with_score else F.lit("-1")
    line = F.concat_ws(",", F.col("frame").cast("string"), F.col("track_id").cast("string"), *[number(c) for c in "xywh"], score, F.lit("-1"), F.lit("-1"), F.lit("-1"))
    return df.where("track_id >= 0").select(line.alias("value"))


def benchmark_lines(df: DataFrame, kind: str = "mot") -> DataFrame:
    """Text lines of tracks with track_id >= 0: mot `frame,id,x,y,w,h,1,-1,-1,-1`; kitti `frame id pedestrian 0 0 -10 x1 y1 x2 y2 -10 -10 -10 -1000 -1000 -1000 -10`, frames from 0."""
    n = lambda c: c.cast("double").cast("string")
    x, y, w, h = (F.col(c) for c in "xywh")
    frame, ident = F.col("frame"), F.col("track_id").cast("string")
    if kind == "mot":
        line = F.concat_ws(",", frame.cast("string"), ident, n(x), n(y), n(w), n(h), F.lit("1"), F.lit("-1"), F.lit("-1"), F.lit("-1"))
    elif kind == "kitti":
        line = F.concat_ws(" ", (frame - 1).cast("string"), ident, F.lit("pedestrian 0 0 -10"), n(x), n(y), n(x + w), n(y + h), F.lit("-10 -10 -10 -1000 -1000 -1000 -10"))
    else:
        raise ValueError(f"unknown form {kind}")
    return df.where("track_id >= 0").select(line.alias("value"))


def renumbered(df: DataFrame, keys: Sequence[str], ident: str = "track_id") -> DataFrame:
    """Tracks renumbered 1..n by their old ids, within a match."""
    return df.withColumn(ident, F.dense_rank().over(Window.partitionBy(*keys).orderBy(ident)))


def timeline(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each frame as one sorted array, coordinates to two digits."""
    row = F.struct("track_id", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    return df.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def content_key(columns: Sequence[str]) -> Column:
    """SHA-256 of the JSON of columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def cache_key(df: DataFrame, name: str = "key") -> DataFrame:
    """df with the key of all its columns."""
    return df.withColumn(name, content_key(df.columns))


def not_cached(requests: DataFrame, cache: DataFrame, name: str = "key") -> DataFrame:
    return requests.join(cache.select(name).distinct(), name, "left_anti")


def cache_put(results: DataFrame, path: str, name: str = "key") -> None:
    """Results of new keys are added to a store of one row a key; what is there stays. A key's first writer wins, and readers see whole files only."""
    from pyspark.errors import AnalysisException

    try:
        results = not_cached(results, results.sparkSession.read.parquet(path), name)
    except AnalysisException:  # no store yet
        pass
    results.dropDuplicates([name]).write.mode("append").parquet(path)


def cache_get(requests: DataFrame, path: str, name: str = "key") -> DataFrame:
    """Requests with their stored results; of a key that two runs added at once, one row."""
    stored = requests.sparkSession.read.parquet(path).dropDuplicates([name])
    return requests.join(stored, name)


def run_row(spark: SparkSession, config: dict, versions: dict[str, str], started: str, git: str | None = None) -> DataFrame:
    """One row that tells a run: the hash of its canonical configuration, versions, cores, and the source revision."""
    import hashlib
    import json

    canonical = json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    row = (hashlib.sha256(canonical.encode()).hexdigest(), canonical, versions | {"spark": spark.version}, spark.sparkContext.defaultParallelism, started, git)
    return spark.createDataFrame([row], "config_sha256 string, config string, versions map<string,string>, cores int, started string, git string")


def summary_text(totals: DataFrame, title: str) -> DataFrame:
    """A readable summary, one text a match: the title, then a line a side with its figures in order of their names.

    totals: match_id, team, figures (map of numbers).
    """
    figures = F.array_join(F.transform(F.array_sort(F.map_entries("figures")), lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(F.format_number(e["value"], 2), F.lit("unknown")))), ", ")
    lines = totals.select("match_id", F.struct("team", F.concat(F.col("team"), F.lit(": "), figures).alias("line")).alias("l"))
    g = lines.groupBy("match_id").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return g.select("match_id", F.concat_ws("\n", F.lit(title), F.concat_ws("\n", F.transform("l", lambda x: x["line"]))).alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with size and SHA-256."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unfinished(plan: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks of a plan that have no result yet."""
    return plan.join(done.select(*keys).distinct(), list(keys), "left_anti")
