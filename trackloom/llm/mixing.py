"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources that hold
them), so the network has a node per pattern and per source, however many documents
there are. Pattern p may send its token capacity C_p to the quotas of its sources up to
`max_repeats` times, the k-th time at cost k - 1: convex costs, so fresh tokens always go
before repeated ones. Flows are then turned into documents: every document of a pattern
is taken floor(f / C) times, and the rest goes to documents in a seeded order.

The seeded order needs no sort of a whole source. Documents have an order of 50 bits, 30 of a
hash of (seed, id, text) and 20 that part equal rows; level by level, ten bits at a time, the
sizes of the cell that holds a pattern's cut are pre-aggregated, until the cells are small. Cells below the cut
are taken whole, and only the documents of the last cell are ordered.

Edge cases: null and empty texts have size 0 and are never taken; a null source, or an empty
set of sources, is a source of its own, last in order; ties of the order fall to ids; rows that repeat an id are
mixed one by one, and which of two equal rows is taken is left open, as they cannot be told
apart; reruns agree; a very long text is one document, taken or not as a whole; other columns
of the table are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import Workspace, source_columns

#: Bits of the order that one level looks at, and levels.
LEVEL_BITS, LEVELS = 10, 5
#: Documents of a pattern's last cell, which are ordered in one task.
CELL_ROWS = 10_000
#: Patterns that the driver's network may have; more is an error that says so, never a cut.
MAX_PATTERNS = 1_000_000


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Mapping[str | None, int], weights: Mapping[str | None, float], total: float, cap: float) -> dict[str | None, float]:
    """Shares of total by weight, each at most cap times its source's size; the excess is reshared by weight until none is above."""
    target: dict[str | None, float] = {}
    open_, left = [s for s in sizes if weights[s] > 0], float(total)
    while open_:
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > cap * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_} | {s: 0.0 for s in sizes if s not in target and s not in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return target | {s: 0.0 for s in sizes if s not in target}


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int) -> list[dict[int, int]]:
    """Flow of each pattern to its sources: successive shortest paths with potentials."""
    flow: list[dict[int, int]] = [{} for _ in capacity]
    rest = [p for p, c in enumerate(capacity) if c > 0]
    n_p, n_s = len(rest), len(quota)
    src, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: int, w: int) -> None:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(z)
            cost.append(v)

    sends: list[tuple[int, int, int]] = []
    for i, p in enumerate(rest):
        for k in range(repeats):
            arc(src, i, capacity[p], k)
        for s in members[p]:
            sends.append((p, s, len(to)))
            arc(i, n_p + s, repeats * capacity[p], 0)
    for s in range(n_s):
        if quota[s] > 0:
            arc(n_p + s, sink, quota[s], 0)
    potential = [0] * len(graph)
    while n_p:
        dist: list[float] = [float("inf")] * len(graph)
        via = [-1] * len(graph)
        dist[src], heap = 0, [(0, src)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                if cap[e] and (v := d + cost[e] + potential[a] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = v, e
                    heapq.heappush(heap, (v, to[e]))
        if dist[sink] == float("inf"):
            break
        for a, d in enumerate(dist):
            potential[a] += int(d) if d < float("inf") else 0
        push, a = None, sink
        while a != src:
            push = cap[via[a]] if push is None else min(push, cap[via[a]])
            a = to[via[a] ^ 1]
        a = sink
        while a != src:
            cap[via[a]] -= push
            cap[via[a] ^ 1] += push
            a = to[via[a] ^ 1]
    for p, s, e in sends:
        if cap[e ^ 1]:
            flow[p][s] = flow[p].get(s, 0) + cap[e ^ 1]
    return flow


def default_weights(sources: list[str | None], cycle: tuple[float, ...] = (5, 2, 1)) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 5, 2, 1, repeating."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sources else [])
    return {s: float(cycle[k % len(cycle)]) for k, s in enumerate(ordered)}


def order_of(row: Column, seed: int) -> Column:
    """50 bits, the same in every run but for equal rows: 30 from id and text, 20 from the place in the work table, which part equal rows."""
    high = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 30) - 1))
    return F.shiftleft(high, 20).bitwiseOR(F.xxhash64(row).bitwiseAND(F.lit((1 << 20) - 1)))


def cut_cells(sized: DataFrame, plan: DataFrame, work: Workspace) -> DataFrame:
    """(pattern_id, low, high, want): of the documents that a pattern takes once more, those of an order below low are in, those of high or more are out, and of those between a size of `want` is in."""
    cuts = plan.select("pattern_id", F.lit(0).cast("long").alias("low"), F.lit(1 << (LEVEL_BITS * LEVELS)).cast("long").alias("high"), F.col("rest").alias("want"))
    for level in range(LEVELS):
        width = 1 << (LEVEL_BITS * (LEVELS - 1 - level))
        inside = sized.join(F.broadcast(cuts), "pattern_id").where("want > 0 and o >= low and o < high")
        cells = inside.groupBy("pattern_id", "low", "want", F.floor((F.col("o") - F.col("low")) / width).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        run = Window.partitionBy("pattern_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0))).where("before < want and want <= before + size")
        found = cells.select("pattern_id", (F.col("low") + F.col("cell") * width).alias("low"), (F.col("low") + (F.col("cell") + 1) * width).alias("high"), (F.col("want") - F.col("before")).alias("want"), "n")
        found = work.stage(found, f"cuts_{level}")
        cuts = found.drop("n")
        if (found.agg(F.max("n")).first()[0] or 0) <= CELL_ROWS:
            break
    return cuts


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Mapping[str | None, float] | None = None, share: float = 1.0, max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """Per document row: doc_id, size, pattern (the sources that hold it), taken (words the mix takes, repeats counted), copies, and the first source's source, source_size and target.

    source_col is a string, or an array of strings for documents that several sources
    hold. share: the mix's size as a share of all words.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    several = dict(docs.dtypes)[source_col].startswith("array")
    rows = source_columns(docs, doc_id=id_col, text=text_col, source=source_col)
    pattern = F.array_sort(F.array_distinct(F.when(F.size("source") > 0, F.col("source")).otherwise(F.array(F.lit(None).cast("string"))))) if several else F.array(F.col("source"))
    sized = rows.select("doc_id", pattern.alias("pattern"), word_count(F.col("text")).alias("size"), order_of(F.monotonically_increasing_id(), seed).alias("o"))
    # a pattern goes by a number from here on; nulls are told apart by their place, as hashes skip them
    sized = sized.withColumn("pattern_id", F.xxhash64("pattern", F.transform("pattern", lambda x: x.isNull())))
    sized = work.stage(sized, "sized")

    held = work.stage(sized.groupBy("pattern_id").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("size")), "patterns")
    coarse = held.limit(MAX_PATTERNS + 1).collect()
    if len(coarse) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns: too many for the driver's network")
    patterns = sorted(coarse, key=lambda r: [(s is None, s or "") for s in r["pattern"]])
    sizes: dict[str | None, int] = {}
    for r in patterns:
        for s in r["pattern"]:
            sizes[s] = sizes.get(s, 0) + r["size"]
    weights = dict(weights) if weights is not None else default_weights(list(sizes))
    total = share * sum(r["size"] for r in patterns)
    target = capped_targets(sizes, {s: weights.get(s, 0.0) for s in sizes}, total, max_repeats)
    names = list(sizes)
    at = {s: k for k, s in enumerate(names)}
    flow = min_cost_flow([r["size"] for r in patterns], [[at[s] for s in r["pattern"]] for r in patterns], [round(target[s]) for s in names], max_repeats)
    plan = []
    for r, f in zip(patterns, flow, strict=True):
        sent, first = sum(f.values()), r["pattern"][0]
        whole, rest = divmod(sent, r["size"]) if r["size"] else (0, 0)
        plan.append((r["pattern_id"], first, sizes.get(first, 0), float(target.get(first, 0.0)), int(whole), int(rest)))
    plan_df = spark.createDataFrame(plan, "pattern_id long, source string, source_size long, target double, whole long, rest long")

    # at most MAX_PATTERNS rows of a few numbers each are broadcast
    cuts = cut_cells(sized, plan_df, work)
    got = sized.join(F.broadcast(plan_df), "pattern_id").join(F.broadcast(cuts), "pattern_id", "left")
    between = (F.col("o") >= F.col("low")) & (F.col("o") < F.col("high"))
    split = got.where(between)
    upto = Window.partitionBy("pattern_id").orderBy("o", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    split = split.withColumn("upto", F.sum("size").over(upto)).withColumn("extra", F.when(F.col("upto") <= F.col("want"), 1).otherwise(0))
    plain = got.where(~F.coalesce(between, F.lit(False))).withColumn("upto", F.lit(0).cast("long")).withColumn("extra", F.when(F.col("o") < F.col("low"), 1).otherwise(0))
    out = plain.unionByName(split)
    # what whole documents below the cut leave open goes to the one document beyond it that fills it best, if it brings the sum nearer
    open_ = cuts.join(split.where("extra = 1").groupBy("pattern_id").agg(F.max("upto").alias("got")), "pattern_id", "left")
    open_ = work.stage(open_.select("pattern_id", (F.col("want") - F.coalesce("got", F.lit(0))).alias("gap")), "open")
    off = F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "o", "doc_id")
    best = out.where("extra = 0 and size > 0").join(F.broadcast(open_), "pattern_id").groupBy("pattern_id", "gap").agg(F.min(off).alias("best"))
    best = work.stage(best.where("best.off < gap").select("pattern_id", F.col("best.o").alias("best_o"), F.col("best.doc_id").alias("best_id")), "best")
    out = out.join(F.broadcast(best), "pattern_id", "left")
    out = out.withColumn("extra", F.when((F.col("o") == F.col("best_o")) & F.col("doc_id").eqNullSafe(F.col("best_id")), 1).otherwise(F.col("extra")))
    return out.select("doc_id", "size", "pattern", "source", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).alias("taken"), F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int").alias("copies"))
