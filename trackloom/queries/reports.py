"""Queries of the report, posteriors, evaluation and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions import columns as X
from trackloom.operators import aggregates as A
from trackloom.operators import evaluation as E
from trackloom.operators import identity as I
from trackloom.operators import joins as J
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query


@query("SELECT o_custkey, CASE WHEN count(CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END) = count(*) THEN sum(o_totalprice) END AS total FROM orders GROUP BY o_custkey")
def all_or_nothing_sum(spark: SparkSession, sf: str) -> DataFrame:
    """NULL unless every row has the number."""
    o = table(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderkey") % 50 != 0, F.col("o_totalprice")))
    return o.groupBy("o_custkey").agg(A.all_or_nothing("v").alias("total"))


_READ = f"{ROWS}, e AS (SELECT track_id, match_id AS obs, k % 10 AS number, (x + 53) / 106 AS conf FROM d)"


@query(f"""WITH {_READ}, o AS (SELECT track_id, obs, number, max(conf) AS c FROM e GROUP BY track_id, obs, number), t AS (SELECT *, sum(c) OVER (PARTITION BY track_id, obs) AS tot FROM o),
s AS (SELECT track_id, number, sum(ln(1 + 9 * c / tot)) + ln(0.2 / count(*) OVER (PARTITION BY track_id)) AS s FROM t GROUP BY track_id, number), x AS (SELECT *, exp(s - max(s) OVER (PARTITION BY track_id)) AS e FROM s) SELECT track_id, number, e / sum(e) OVER (PARTITION BY track_id) AS posterior FROM x""")
def log_pool_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithmic pooling of readings."""
    e = detections(spark, sf).select("track_id", F.col("match_id").alias("obs"), (F.col("k") % 10).alias("number"), ((F.col("x") + 53) / 106).alias("conf"))
    return A.log_pool(e, ["track_id"], "obs", "number", "conf")


@query(f"""WITH {ROWS}, c AS (SELECT track_id, kind, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY track_id) AS p FROM d GROUP BY track_id, kind), t AS (SELECT DISTINCT track_id FROM d)
SELECT a.track_id AS a, b.track_id AS b, coalesce(sum(least(p.p, q.p)), 0) AS overlap FROM t a JOIN t b ON b.track_id = a.track_id + 1 LEFT JOIN c p ON p.track_id = a.track_id LEFT JOIN c q ON q.track_id = b.track_id AND q.kind = p.kind GROUP BY a.track_id, b.track_id""")
def overlap_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap of posteriors of neighbouring tracks."""
    counts = detections(spark, sf).groupBy("track_id", "kind").agg(F.count("*").cast("double").alias("n"))
    p = counts.groupBy("track_id").agg(X.normalised(F.map_from_entries(F.collect_list(F.struct("kind", "n")))).alias("p"))
    b = p.select((F.col("track_id") - 1).alias("track_id"), F.col("p").alias("q"))
    return p.join(b, "track_id").select(F.col("track_id").alias("a"), (F.col("track_id") + 1).alias("b"), X.map_overlap(F.col("p"), F.col("q")).alias("overlap"))


@query("""WITH l AS (SELECT DISTINCT quality AS label FROM labels UNION SELECT DISTINCT toxic FROM labels), t AS (SELECT quality AS label, count(*) AS support, count(*) FILTER (quality = toxic) AS tp FROM labels GROUP BY quality), p AS (SELECT toxic AS label, count(*) AS predicted FROM labels GROUP BY toxic),
x AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp FROM l LEFT JOIN t USING (label) LEFT JOIN p USING (label)), y AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM x)
SELECT label, support, predicted, pr AS "precision", re AS recall, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM y""")
def confusion_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class precision, recall and F1."""
    return A.classification_report(table(spark, sf, "labels"), "quality", "toxic")


@query("""WITH r AS (SELECT quality AS g, (doc_id * 37 % 101) / 101.0 AS conf, quality = toxic AS ok FROM labels), b AS (SELECT g, least(CAST(trunc(conf * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS a FROM r GROUP BY ALL) SELECT g, sum(n * abs(c - a)) / sum(n) AS ece FROM b GROUP BY g""")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calibration error of ten bins."""
    r = table(spark, sf, "labels").select(F.col("quality").alias("g"), ((F.col("doc_id") * 37 % 101) / 101.0).alias("conf"), (F.col("quality") == F.col("toxic")).alias("ok"))
    return A.expected_calibration_error(r, ["g"], "conf", "ok")


@query(f"""WITH {ROWS}, a AS (SELECT event_id, kind, k FROM d WHERE event_id % 10 <> 3), z AS (SELECT event_id, kind, CASE WHEN event_id % 7 = 0 THEN k + 1 ELSE k END AS k FROM d WHERE event_id % 10 <> 4)
SELECT coalesce(a.event_id, z.event_id) AS event_id, CASE WHEN z.event_id IS NULL THEN 'missing' WHEN a.event_id IS NULL THEN 'added' WHEN a.k IS DISTINCT FROM z.k OR a.kind IS DISTINCT FROM z.kind THEN 'changed' ELSE 'same' END AS status, CASE WHEN a.event_id IS NOT NULL AND z.event_id IS NOT NULL AND a.k IS DISTINCT FROM z.k THEN 'k' ELSE '' END AS fields FROM a FULL JOIN z ON a.event_id = z.event_id""")
def outer_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison of two sets of rows."""
    d = detections(spark, sf).select("event_id", "kind", "k")
    after = d.where("event_id % 10 <> 4").withColumn("k", F.when(F.col("event_id") % 7 == 0, F.col("k") + 1).otherwise(F.col("k")))
    return J.compare(d.where("event_id % 10 <> 3"), after, ["event_id"], ["kind", "k"])


@query(f"WITH {ROWS} SELECT kind, k FROM d WHERE event_id % 3 = 0 INTERSECT ALL SELECT kind, k FROM d WHERE event_id % 3 = 1")
def multiset_intersect(spark: SparkSession, sf: str) -> DataFrame:
    """U4: multiset intersection."""
    d = detections(spark, sf)
    return d.where("event_id % 3 = 0").select("kind", "k").intersectAll(d.where("event_id % 3 = 1").select("kind", "k"))


@query(f"""WITH {ROWS}, c AS (SELECT match_id, max(frame) + 1 AS frames, max(track_id) + 1 AS tracks FROM d GROUP BY match_id), o AS (SELECT match_id, coalesce(sum(frames) OVER w, 0) AS fo, coalesce(sum(tracks) OVER w, 0) AS tof FROM c WINDOW w AS (ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, d.frame + CAST(fo AS BIGINT) AS frame, d.track_id + CAST(tof AS BIGINT) AS track_id FROM d JOIN o USING (match_id)""")
def chunk_union(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks rebased by running offsets."""
    d = detections(spark, sf)
    c = d.groupBy("match_id").agg((F.max("frame") + 1).alias("frames"), (F.max("track_id") + 1).alias("tracks"))
    w = Window.orderBy("match_id").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    o = c.select("match_id", F.coalesce(F.sum("frames").over(w), F.lit(0)).alias("fo"), F.coalesce(F.sum("tracks").over(w), F.lit(0)).alias("to"))
    return d.join(o, "match_id").select("event_id", (F.col("frame") + F.col("fo")).alias("frame"), (F.col("track_id") + F.col("to")).alias("track_id"))


@query("""WITH t AS (SELECT p_partkey AS id, (p_partkey * 7) % 11 AS tens, (p_partkey * 3) % 11 AS units, 0.5 + (p_partkey % 50) / 100.0 AS readable FROM part), n AS (SELECT *, CASE WHEN tens = 10 AND units = 10 THEN 100 WHEN tens = 10 THEN units WHEN units = 10 THEN tens ELSE tens * 10 + units END AS number FROM t)
SELECT id % 20 AS track, number, sum(readable) AS mass FROM n GROUP BY ALL""")
def digit_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes from two digit readings."""
    p = F.col("p_partkey")
    reads = table(spark, sf, "part").select((p % 20).alias("track"), ((p * 7) % 11).alias("tens"), ((p * 3) % 11).alias("units"), (0.5 + (p % 50) / 100.0).alias("readable"))
    return I.digit_mass(reads, ["track"])


@query("""SELECT p_partkey, CASE WHEN lower(p_brand) LIKE '%none%' OR lower(p_brand) LIKE '%no %' THEN NULL ELSE CAST(nullif(regexp_extract(p_brand, '(\\d{1,2})', 1), '') AS INTEGER) END AS number, 'gp_' || substr(sha256(CAST(p_partkey AS VARCHAR) || '|' || p_brand), 1, 12) AS gid, CASE WHEN lower(trim(p_brand)) IN ('', 'nan', '100') THEN NULL ELSE trim(p_brand) END AS clean, lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS padded FROM part""")
def text_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Text parsers and hashed identities."""
    return table(spark, sf, "part").select("p_partkey", X.number_in(F.col("p_brand")).alias("number"), X.canonical_hash("gp_", 12, F.col("p_partkey"), F.col("p_brand")).alias("gid"), X.clean_text(F.col("p_brand")).alias("clean"), F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("padded"))


@query("""SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS accepted, count(*) FILTER (o_orderstatus <> 'P') / count(*) AS coverage FROM orders GROUP BY o_orderpriority""")
def semantic_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts per type, accepted ones, and coverage."""
    return E.type_statistics(table(spark, sf, "orders"), "o_orderpriority", F.col("o_orderstatus") != "P")


@query("""SELECT l_suppkey AS source, l_partkey % 100 AS target, count(*) AS passes, CASE WHEN count(CASE WHEN l_returnflag <> 'N' THEN 1 END) = count(*) THEN count(*) FILTER (l_returnflag = 'A') END AS completed FROM lineitem GROUP BY ALL""")
def evidence_network(spark: SparkSession, sf: str) -> DataFrame:
    """Network whose completed count is NULL unless all outcomes are known."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100).alias("target"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A").alias("won"), "l_orderkey")
    return A.network(li, "source", "target", "won", "l_orderkey").drop("evidence")


@query("""WITH e AS (SELECT (date_part('year', o_orderdate) * 12 + date_part('month', o_orderdate)) AS m, o_orderstatus AS team, o_totalprice AS v FROM orders), s AS (SELECT m, team, sum(v) AS v FROM e GROUP BY m, team) SELECT CAST(m AS INTEGER) AS m, team, v, CASE WHEN sum(v) OVER (PARTITION BY m) > 0 THEN v / sum(v) OVER (PARTITION BY m) ELSE 1.0 END AS share FROM s""")
def possession_share(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and shares within a period."""
    e = table(spark, sf, "orders").select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.col("o_orderstatus").alias("team"), F.col("o_totalprice").alias("v"))
    return A.share_of_total(e, ["team"], ["m"], "v")
