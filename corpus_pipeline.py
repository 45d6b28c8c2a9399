"""The corpus pipeline: five stages, each over all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Decisions meet texts by merge joins at every size: a list
of keys grows with the corpus and is never broadcast. Decisions are carried by a 64-bit hash
of the whole row, so rows that repeat an id or have none are decided one by one; rows of one key
are equal in all columns and can stand for each other.

Edge cases, for every stage: rows that repeat an id, have none, or repeat a whole row are decided
as their own texts say; null and empty texts pass the first three stages and are never taken by
the mix, as they hold no words; very long texts are decided whole; ties fall to the smallest id,
then to the smallest key; further columns of documents come through, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, mixing, neardup, quality, tokens
from trackloom.llm.common import Workspace
from trackloom.llm.queries import table, tokenizer_file

#: Names that no table of documents has.
KEY, COPIES, COPY = "_pipeline_key", "_pipeline_copies", "_pipeline_copy"


def keyed(docs: DataFrame) -> DataFrame:
    """With a hash of all columns; nulls are told apart by their place, as hashes skip them."""
    return docs.withColumn(KEY, F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns]))


def once(rows: DataFrame) -> DataFrame:
    """One row of each key; copies meet on the map side first, so a row that a third of the table repeats is no hot group."""
    return rows.dropDuplicates([KEY])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    rows = keyed(docs)
    kept = quality.quality_scores(rows, id_col=KEY).where("predicted = 1").select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(kept.hint("merge"), KEY, "left_semi").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id, null last. Texts without words are in no group."""
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    rows = keyed(docs.where(worded))
    found = neardup.near_duplicates(rows, id_col=KEY, shingle_words=5, similarity=(80, 100)).select(F.col("doc_id").alias(KEY), "component_id").distinct()
    ids = rows.select(KEY, F.col("doc_id").cast("long").alias("doc_id")).distinct()
    first = F.min_by(KEY, F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias(KEY)
    kept = found.join(ids.hint("merge"), KEY).groupBy("component_id").agg(first).select(KEY)
    return once(rows).join(kept.hint("merge"), KEY, "left_semi").select(docs.columns).unionByName(docs.where(~worded))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by benchmark passages go."""
    rows = keyed(docs)
    spans = decontam.removal_spans(rows, table(spark, sf_dir, "benchmark"), id_col=KEY)
    gone = spans.where(decontam.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(KEY)).distinct()
    return rows.join(gone.hint("merge"), KEY, "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = keyed(docs)
    copies = mixing.mix_sources(rows, id_col=KEY).where("copies > 0").groupBy(F.col("doc_id").alias(KEY)).agg(F.sum("copies").alias(COPIES))
    taken = once(rows).join(copies.hint("merge"), KEY)
    return taken.withColumn(COPY, F.explode(F.sequence(F.lit(1).cast("long"), COPIES))).select(docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, as read back."""
    return tokens.token_output(docs, tokenizer_file()).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("token_files", token_files)]

#: Stages of trained models, seeded hashes and token files have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.stage(stage(spark, docs, sf_dir), f"{k}_{name}")
    return docs
