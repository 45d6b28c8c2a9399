"""Sources: every reader states its schema and normalises sentinels once, on the way in."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.columns import clean_text

BOX = "struct<x double, y double, w double, h double>"
PITCH = "struct<x_bottom_left double, y_bottom_left double, x_bottom_right double, y_bottom_right double, x_bottom_middle double, y_bottom_middle double>"
ATTRIBUTES = "struct<role string, jersey string, team string, name string>"
DETECTION = f"struct<id string, image_id string, video_id string, frame long, track_id long, bbox_image {BOX}, bbox_pitch {PITCH}, attributes {ATTRIBUTES}>"
LEDGER = "event_id string, type string, frame long, end_frame long, player_id string, team string, outcome string, confidence double, clock struct<frame long, video_s double, segment_s double, text string, period int>, start_xy struct<x double, y double>, end_xy struct<x double, y double>, attributes map<string,string>"
EVENT = "event_id string, kind string, team string, player_id string, target_id string, timestamp_ms long, end_ms long, outcome boolean, position_m struct<x double, y double>, end_position_m struct<x double, y double>, attacking_sign int, evidence_ids array<string>, status string, confidence double, confidence_kind string, flags map<string,boolean>, numbers map<string,double>, texts map<string,string>"


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """{"predictions": [...]} documents as a flat table; a missing role is a player, sentinels are NULL, missing boxes stay NULL."""
    docs = spark.read.schema(f"predictions array<{DETECTION}>").option("multiLine", True).json(path)
    d = docs.withColumn("match_id", F.input_file_name()).select("match_id", F.explode("predictions").alias("p")).select("match_id", "p.*")
    a = "attributes"
    return d.select(
        "match_id", "frame", F.coalesce("track_id", F.lit(-1)).alias("track_id"), F.coalesce(clean_text(F.col(f"{a}.role")), F.lit("player")).alias("role"),
        clean_text(F.col(f"{a}.team")).alias("team"), clean_text(F.col(f"{a}.jersey")).alias("jersey"), clean_text(F.col(f"{a}.name")).alias("name"),
        F.col("bbox_pitch.x_bottom_middle").alias("x"), F.col("bbox_pitch.y_bottom_middle").alias("y"),
        F.col("bbox_image.x").alias("img_x"), F.col("bbox_image.y").alias("img_y"), F.col("bbox_image.w").alias("img_w"), F.col("bbox_image.h").alias("img_h"),
    )


def attribute_sidecar(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Names with their largest confidence over all side-car files."""
    rows = spark.read.schema("name string, confidence double").json(paths)
    return rows.where("name is not null").groupBy("name").agg(F.max("confidence").alias("confidence"))


def tracking_csv(spark: SparkSession, path: str, least_columns: int = 7) -> DataFrame:
    """frame, id, x, y, w, h, score text; shorter rows and frames below 1 are skipped."""
    raw = spark.read.text(path).select(F.split("value", ",").alias("c")).where(F.size("c") >= least_columns)
    names = ("frame", "id", "x", "y", "w", "h", "score")
    cols = [F.element_at("c", k + 1).try_cast("double").alias(n) for k, n in enumerate(names)]
    out = raw.select(*cols).where("frame >= 1")
    return out.select(F.col("frame").cast("long"), F.col("id").cast("long"), *names[2:])


# Classes of a benchmark's truth that count, and those that are left out of scoring.
TRUTH_LABELS, IGNORED_LABELS = (1,), (2, 7, 8, 12)


def truth_csv(spark: SparkSession, path: str, ignored: bool = False, ignored_labels: tuple[int, ...] = IGNORED_LABELS) -> DataFrame:
    """Ground truth of the same form: frame, id, box, and in place of the score a mark, the class and the visibility.

    Rows of a mark of 0 or of a class that does not count are left out; ignored: the rows of
    classes left out of scoring, or of negative visibility, instead.
    """
    raw = spark.read.text(path).select(F.split("value", ",").alias("c")).where(F.size("c") >= 7)
    n = lambda k: F.element_at("c", k).try_cast("double")
    label, seen = F.coalesce(F.when(F.size("c") >= 8, n(8)), F.lit(1.0)).cast("int"), F.when(F.size("c") >= 9, n(9))
    kept = (label.isin(list(ignored_labels)) | F.coalesce(seen < 0, F.lit(False))) if ignored else ((F.round(n(7)) != 0) & label.isin(list(TRUTH_LABELS)))
    rows = raw.where(kept).select(n(1).cast("long").alias("frame"), n(2).cast("long").alias("id"), *[n(k).alias(c) for k, c in ((3, "x"), (4, "y"), (5, "w"), (6, "h"))], label.alias("label"), seen.alias("visibility"))
    return rows.where("frame >= 1")


#: Columns of a tracker's wide text form.
TRACK_TEXT = "frame long, track_id long, x double, y double, w double, h double, score double, role string, jersey string, colour string, team string"


def track_text(spark: SparkSession, path: str) -> DataFrame:
    """Rows of eleven comma-separated columns without a header; sentinels are NULL."""
    rows = spark.read.schema(TRACK_TEXT).csv(path)
    return rows.select(*[clean_text(F.col(c)).alias(c) if c in ("role", "jersey", "colour", "team") else F.col(c) for c in rows.columns])


def detection_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Looks of detections from Parquet (frame, x, y, vector), keyed as detections are: frame and place to one digit, half to even."""
    r = spark.read.parquet(path)
    return r.select("frame", F.bround("x", 1).alias("key_x"), F.bround("y", 1).alias("key_y"), "vector")


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Detections (frame, x, y, ..) with the vector of their key, NULL where there is none; of several the first by vector."""
    one = vectors.groupBy("frame", "key_x", "key_y").agg(F.min("vector").alias("vector"))
    keyed = rows.withColumn("key_x", F.bround("x", 1)).withColumn("key_y", F.bround("y", 1))
    return keyed.join(one, ["frame", "key_x", "key_y"], "left").drop("key_x", "key_y")


def homographies(spark: SparkSession, path: str) -> DataFrame:
    """frame, h: nine numbers a frame from JSON lines; frames without a full matrix are left out."""
    r = spark.read.schema("frame long, homography array<array<double>>").json(path)
    return r.select("frame", F.flatten("homography").alias("h")).where("size(h) = 9")


def zipped_documents(spark: SparkSession, path: str, suffix: str = ".json") -> DataFrame:
    """archive, name, text of the documents in zip archives: an archive is opened by one task, its members come out one by one."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(suffix)):
                        yield pd.DataFrame({"archive": [archive], "name": [name], "text": [z.read(name).decode("utf-8", "replace")]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, text string")


def timeline_or_cards(spark: SparkSession, path: str, member: str, row: str) -> DataFrame:
    """Rows of a JSON document that is a list, or an object that holds the list under `member`; row: the rows' schema."""
    text = spark.read.option("wholetext", True).text(path).select(F.trim("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{row}>>")
    held = F.from_json("v", f"struct<{member}: array<struct<{row}>>>")[member]
    return text.select(F.explode(F.when(F.col("v").startswith("["), listed).otherwise(held)).alias("r")).select("r.*")


def store_rows(spark: SparkSession, path: str, match: str | None = None, kind: str | None = None, ident: str | None = None) -> DataFrame:
    """Rows of an event store by match, kind or id, in order of their start; each condition reaches the scan, and match or kind prune partitions."""
    rows = spark.read.parquet(path)
    for column, value in (("match_id", match), ("kind", kind), ("event_id", ident)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy("start_ms", "event_id")


def court_csv(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated numbers with a header; what is no number is NULL."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in raw.columns])


def ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).json(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Report events; a field of the wrong type fails the read."""
    return spark.read.schema(EVENT).option("mode", "FAILFAST").json(path)


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("truth string, prediction string, confidence double, insufficient_evidence boolean, evidence_id string").json(path)


def rosters(spark: SparkSession, path: str) -> DataFrame:
    """One row per player: team, number, name, is_keeper, is_starter."""
    r = spark.read.schema("team string, short string, players map<string,string>, goalkeepers array<string>, starting_lineup array<string>").option("multiLine", True).json(path)
    p = r.select("team", "goalkeepers", "starting_lineup", F.explode("players").alias("number", "name"))
    has = lambda c: F.coalesce(F.array_contains(c, F.col("number")), F.lit(False))
    return p.select("team", F.col("number").try_cast("int").alias("number"), "name", has("goalkeepers").alias("is_keeper"), has("starting_lineup").alias("is_starter"))


def truth_labels(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth annotations; the frame is the last six digits of the image id."""
    docs = spark.read.schema("annotations array<struct<image_id string, track_id long, attributes struct<role string, jersey string, team string>>>").option("multiLine", True).json(path)
    return docs.select(F.explode("annotations").alias("a")).select(F.substring("a.image_id", -6, 6).cast("long").alias("frame"), "a.track_id", "a.attributes.*")


def jersey_reads(spark: SparkSession, path: str) -> DataFrame:
    """Tallies of readings: identity, votes map, questions (the number of answers where it is missing)."""
    r = spark.read.schema("identity string, votes map<string,long>, questions long, answers array<string>").json(path)
    return r.select("identity", "votes", F.coalesce("questions", F.size("answers").cast("long"), F.lit(0).cast("long")).alias("questions"))


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Mean and peak of a comma-separated gauge by stage."""
    r = spark.read.schema("stage string, gpu string").json(path)
    v = r.select("stage", F.trim(F.element_at(F.split("gpu", ","), 1)).try_cast("double").alias("v"))
    return v.groupBy("stage").agg(F.avg("v").alias("mean"), F.max("v").alias("peak"))


def report_files(spark: SparkSession, path: str) -> DataFrame:
    """Report files with safe names, newest first."""
    f = spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return f.withColumn("report_id", name).where(F.col("report_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]*$")).orderBy(F.col("modificationTime").desc(), "report_id")


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """over wins; dictionaries merge all the way down."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def parsed_yaml(text: str) -> dict[str, Any]:
    """A document of nested mappings, lists of scalars and scalars, as configurations are written; other forms are an error.

    Indentation by spaces; `- x` and `[a, b]` lists; quoted or plain scalars; comments.
    """
    import json
    import re

    def scalar(v: str) -> Any:
        v = v.strip()
        if v[:1] in "\"'" and v[-1:] == v[:1] and len(v) > 1:
            return v[1:-1]
        if v.startswith("[") and v.endswith("]"):
            return [scalar(x) for x in v[1:-1].split(",") if x.strip()]
        if v.lower() in ("", "~", "null"):
            return None
        if v.lower() in ("true", "false"):
            return v.lower() == "true"
        if re.fullmatch(r"[-+]?\d+", v):
            return int(v)
        if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", v):
            return float(v)
        if v[:1] in "{&*!|>":
            return json.loads(v) if v.startswith("{") else _unreadable(v)
        return v

    lines = []
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip(" ")), line.strip()))

    def block(at: int, indent: int) -> tuple[Any, int]:
        out: Any = None
        while at < len(lines) and lines[at][0] == indent:
            body = lines[at][1]
            if body.startswith("- ") or body == "-":
                out = [] if out is None else out
                out.append(scalar(body[1:]))
                at += 1
                continue
            key, colon, value = body.partition(":")
            if not colon:
                _unreadable(body)
            out = {} if out is None else out
            name = scalar(key)
            at += 1
            deeper = at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- ")))
            if not value.strip() and deeper:
                out[name], at = block(at, lines[at][0])
            else:
                out[name] = scalar(value)
        return out, at

    out, at = block(0, lines[0][0]) if lines else ({}, 0)
    if at != len(lines):
        _unreadable(lines[at][1])
    return out


def _unreadable(what: str) -> None:
    raise ValueError(f"cannot read {what!r} as configuration")


def config(path: str) -> dict[str, Any]:
    """A JSON or YAML configuration that may extend another (`extends`, relative to it); the one that extends wins."""
    import json

    p = Path(path)
    own = parsed_yaml(p.read_text()) if p.suffix in (".yaml", ".yml") else json.loads(p.read_text())
    parent = own.pop("extends", None)
    return merged(config(str(p.parent / parent)), own) if parent else own
