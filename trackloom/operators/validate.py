"""Row rules and set rules: what breaks them comes back as rows, never as a silent drop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def _rules(*pairs: tuple[str, str]) -> list[tuple[str, str]]:
    return list(pairs)


#: (what is wrong, SQL predicate that holds where it is).
EVENT_RULES = _rules(("ends before it starts", "end_ms < start_ms"), ("confidence out of range", "confidence < 0 or confidence > 1"))
REPORT_RULES = _rules(
    ("negative time", "timestamp_ms < 0"), ("ends before it starts", "end_ms < timestamp_ms"), ("empty evidence", "size(evidence_ids) = 0 or exists(evidence_ids, e -> trim(e) = '')"),
    ("not finite", "exists(map_values(numbers), v -> isnan(v) or abs(v) = double('infinity'))"), ("negative measure", "numbers['distance_m'] < 0 or numbers['xg'] < 0 or numbers['xa'] < 0"),
    ("expected value above 1", "numbers['xg'] > 1 or numbers['xa'] > 1"), ("confidence out of range", "confidence < 0 or confidence > 1"), ("confidence without its kind", "confidence is not null and confidence_kind is null"),
)
SEMANTIC_RULES = _rules(("ends before it starts", "end_ms < start_ms"), ("insufficient evidence names an event", "insufficient_evidence and event <> 'unknown'"), ("timestamps out of order", "exists(zip_with(slice(times, 1, size(times) - 1), slice(times, 2, size(times) - 1), (a, b) -> a > b), x -> x)"))
ROSTER_RULES = _rules(("number out of range", "number < 0 or number > 99"), ("keeper not in the squad", "is_keeper and name is null"))
INTERVAL_RULES = _rules(("interval too short", "end_s - start_s < 0.2"), ("negative start", "start_s < 0"))


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, str]]) -> DataFrame:
    """keys and rule of every row that breaks a rule; unknown (NULL) breaks none."""
    broken = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(name)) for name, p in rules]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def overlaps(df: DataFrame, keys: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """Rows that start before an earlier row of their key has ended."""
    w = Window.partitionBy(*keys).orderBy(start, ident).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reach", F.max(end).over(w)).where(F.col(start) < F.col("reach"))


def outside(df: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not among the allowed ones."""
    return df.join(allowed.select(*keys).distinct(), list(keys), "left_anti")


def roster_problems(rosters: DataFrame) -> DataFrame:
    """roster, team, problem of team sheets (roster, team, short, numbers, names, goalkeepers, starters: arrays of strings).

    Numbers are 0 to 99, names are not empty, goalkeepers and starters are among the
    players, starters are none or eleven different ones, and a match has two different teams.
    """
    plain = lambda c: F.transform(c, lambda n: F.trim(n).try_cast("int"))
    bad = F.exists("numbers", lambda n: ~F.trim(n).rlike("^[0-9]+$") | (F.coalesce(F.trim(n).try_cast("int"), F.lit(-1)) > 99) | F.trim(n).try_cast("int").isNull())
    missing = lambda c: F.size(F.array_except(plain(c), plain("numbers"))) > 0
    starters = F.size(F.array_distinct(plain("starters")))
    w = Window.partitionBy("roster")
    teams = F.size(F.collect_set(F.lower("team")).over(w)) != 2
    shorts = F.size(F.collect_set(F.upper("short")).over(w)) != 2
    rules = [("invalid number", bad), ("empty name", F.exists("names", lambda n: F.trim(n) == "")), ("goalkeeper is no player", missing("goalkeepers")), ("starter is no player", missing("starters")), ("not eleven starters", (F.size("starters") > 0) & (starters != 11)), ("not two different teams", teams | shorts)]
    rows = rosters.select("roster", "team", F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]).alias("p"))
    return rows.select("roster", "team", F.explode(F.array_compact("p")).alias("problem"))


def known_labels_only(rows: DataFrame, labels: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """rows, whose labels fail the read where they are not among the known ones: an unknown label is an error, never a class of its own."""
    out = rows
    for c in columns:
        strange = F.col(c).isNotNull() & ~F.col(c).isin(list(labels))
        out = out.withColumn(c, F.when(strange, F.raise_error(F.concat(F.lit(f"unknown label in {c}: "), F.col(c)))).otherwise(F.col(c)))
    return out


def require_empty(df: DataFrame, what: str) -> None:
    """Raise if there is any row; looks at one row only."""
    first = df.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")
