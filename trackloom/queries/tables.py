"""Queries of sorts, set algebra, persistence, validation and the batch face of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.operators import aggregates as A
from trackloom.operators import joins as J
from trackloom.operators import validate as C
from trackloom.plans.tracking import ROWS, detections, table
from trackloom.queries.registry import query


@query("SELECT user_id, CAST(epoch_ms(date_trunc('hour', ts)) AS BIGINT) AS hour_ms, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("user_id", F.unix_millis("w.start").alias("hour_ms"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, i""")
def session_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions; a gap of exactly the limit still merges."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("""WITH u AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice * 2 FROM orders WHERE o_orderkey % 3 = 0) SELECT * FROM u""")
def upsert_store(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a new batch replace stored ones."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return J.upsert(o, o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def newest_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Filter, total order, top 25 (the limit is the feature)."""
    return table(spark, sf, "orders").where("o_orderstatus = 'O'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rk FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM t WHERE rk <= 5")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest per group."""
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    return A.top_k(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice"), ["l_suppkey"], order, 5).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("WITH t AS (SELECT o_custkey AS id, 0 AS src FROM orders UNION ALL SELECT c_custkey, 1 FROM customer), f AS (SELECT id, min(src) AS src FROM t GROUP BY id) SELECT * FROM f")
def joined_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Union by id, first occurrence wins."""
    return J.first_of([table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))], ["id"])


@query("WITH p AS (SELECT n_nationkey AS pid, 'a' AS src FROM nation UNION ALL SELECT n_nationkey + 25, 'b' FROM nation WHERE n_regionkey <> 2) SELECT pid, src, CAST(dense_rank() OVER (ORDER BY pid) - 1 AS INTEGER) AS label FROM p")
def dataset_algebra(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets added with an offset and relabelled (a dimension of a few dozen rows)."""
    n = table(spark, sf, "nation")
    p = n.select(F.col("n_nationkey").alias("pid"), F.lit("a").alias("src")).unionByName(n.where("n_regionkey <> 2").select((F.col("n_nationkey") + 25).alias("pid"), F.lit("b").alias("src")))
    return p.withColumn("label", F.dense_rank().over(Window.orderBy("pid")) - 1)


@query(f"""WITH {ROWS}, e AS (SELECT match_id, event_id, CAST(frame * 60 AS BIGINT) AS start_ms, CAST(frame * 60 + k - 20 AS BIGINT) AS end_ms, CASE WHEN k % 9 <> 0 THEN x / 20 END AS confidence, team FROM d)
SELECT event_id, 'ends before it starts' AS rule FROM e WHERE end_ms < start_ms UNION ALL SELECT event_id, 'confidence out of range' FROM e WHERE confidence < 0 OR confidence > 1""")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    """V1-V4: rows that break a rule, with the rule."""
    d, k = detections(spark, sf), F.col("k")
    e = d.select("match_id", "event_id", (F.col("frame") * 60).alias("start_ms"), (F.col("frame") * 60 + k - 20).alias("end_ms"), F.when(k % 9 != 0, F.col("x") / 20).alias("confidence"), "team")
    return C.violations(e, ["event_id"], C.EVENT_RULES)


@query("""WITH s AS (SELECT o_custkey AS k, epoch_ms(o_orderdate) AS a, epoch_ms(o_orderdate) + 86400000 * (o_orderkey % 90) AS b, o_orderkey AS id FROM orders), n AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s) SELECT k, id FROM n WHERE a < reach""")
def overlapping_spans(spark: SparkSession, sf: str) -> DataFrame:
    """V4: spans that begin before an earlier one of their key has ended."""
    o = table(spark, sf, "orders")
    a = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    s = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), a.alias("a"), (a + 86400000 * (F.col("o_orderkey") % 90)).alias("b"))
    return C.overlaps(s, ["k"], "a", "b", "id").select("k", "id")


@query("SELECT conv_id, turn, role, lag(role) OVER w IS DISTINCT FROM role AS starts, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def conversation_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Owner changes along a chain."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (~F.col("role").eqNullSafe(F.lag("role").over(w))).alias("starts"), F.lead("role").over(w).alias("next_role"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS revenue, avg(l_quantity) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def volume_totals(spark: SparkSession, sf: str) -> DataFrame:
    """A16 at volume: pushed-down filter, pruned columns, one partial aggregate."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.avg("l_quantity").alias("avg_qty"), F.count("*").alias("n"))
