"""MinHash near-dedup: universal hash minima, banding, signature verification, exact
confirmation, and connected components by alternating large-star and small-star.

Two documents are linked when the Jaccard similarity of their full shingle sets is at
least the threshold. 200 minima in 40 bands of 5 miss a pair of similarity 0.8 with a
probability of (1 - 0.8**5)**40 = 1.3e-7, and the signature filters (see ESTIMATE, NEAR)
such a pair with about 1e-7 each. Every pair that passes is confirmed on its full sets.

Nodes are distinct shingle sets (by a 64-bit digest), so documents with equal sets are one
node from the start, whatever their ids. A bucket never yields its pairs: its members are
first linked to its most connected member (a star), each node to the hub with which it
shares most buckets, in two rounds. Once these components are known, buckets of one
component are settled. The nodes of the others are compared under filters that lose nothing:
two sets can only be similar enough if they share a shingle among the rarest of both, early
enough for the rest to suffice, under any order of shingles that is the same for all (rarity
comes from a fixed number of counters). Nodes of a shingle's commonest component need no
comparison among themselves, so only those of *other* components meet the rest: in cells of a
bounded number of nodes on either side, where they are compared by sizes, places and long
one-bit signatures. Only what passes all of that leaves a cell and is confirmed; the pairs of
a group are never rows. Confirmation streams members past their hub's set; hubs with many
members are split over several tasks. No bucket, component or candidate list is capped.

Edge cases: null or wordless texts have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle; rows that repeat an id are judged one by one, by
their own texts; a null id takes part like any other and gets the smallest id of its
component (null, and kept, if all ids there are null); very long texts are hashed whole, in
chunks of bytes; of equal degrees the smallest node is the hub, which changes no result; other columns of the
table are never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, NOT_SPACE, Workspace, chunks, list_array, mix, ragged, source_columns, span_hashes, text_buffers, word_spans

ROWS, BANDS = 5, 40
#: Least estimate from the minima that is confirmed: 5.3 deviations (of sqrt(0.8 * 0.2 / 200)) below 0.8.
ESTIMATE = 0.65
#: Rounds in which bucket members are linked to a hub before what is left is compared in cells.
STARS = 2
#: Members of a hub that one task confirms.
GROUP = 512
#: One-bit minima of nodes that are compared in cells, and the least estimate from them: 5.3 deviations (of 2 * sqrt(0.9 * 0.1 / 1024)) below 0.8.
BITS, NEAR = 1024, 0.70
#: Nodes on either side of a cell, about; pairs that a task looks at together.
CELL, SLICE = 512, 1 << 17

_draw = np.random.Generator(np.random.PCG64(7))
_A = _draw.integers(1, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)
_C = _draw.integers(1, 2**63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_D = _draw.integers(0, 2**63, BITS, dtype=np.uint64)


def shingles(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, first of each row and the end). A row of fewer words has all of them as one shingle."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, NOT_SPACE)
    h = span_hashes(data, starts, ends)
    words = np.diff(first)
    if not len(h):
        return h, first * 0
    acc = h.copy()
    for k in range(1, size):
        follow = np.zeros_like(h)
        follow[:-k or None] = h[k:]
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + follow)
    row = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(h)) - first[:-1][row]
    keep = place <= words[row] - size
    per = np.maximum(words - size + 1, 0)
    short = np.flatnonzero((words > 0) & (words < size))
    per[short] = 1
    if len(short):  # all words of a short row, as one
        whole = words[short].astype(np.uint64)
        for k in range(size - 1):
            more = words[short] > k
            whole[more] = mix(whole[more] * np.uint64(0x9FB21C651E98DF25) + h[first[:-1][short[more]] + k])
        acc[first[:-1][short]] = whole
        keep[first[:-1][short]] = True
    out = acc[keep]
    bounds = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=bounds[1:])
    return out, bounds


SKETCH = "doc_id bigint, row_key bigint, node bigint, n_shingles bigint, bands array<bigint>, sig binary"


def _sketcher(size: int):
    k_all = ROWS * BANDS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = text_buffers(batch.column(2))
            for lo, hi in chunks(off, 1 << 19):
                sh, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                n = hi - lo
                has = np.flatnonzero(np.diff(bounds))
                sig = np.empty((len(has), k_all), np.uint32)
                if len(has):
                    at = bounds[has]
                    for k in range(k_all):
                        sig[:, k] = np.minimum.reduceat((sh * _A[k] + _B[k]) >> np.uint64(32), at)
                nodes = np.zeros(n, np.int64)
                counts = np.zeros(n, np.int64)
                for r in has:
                    own = np.unique(sh[bounds[r] : bounds[r + 1]])
                    counts[r] = len(own)
                    nodes[r] = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                acc = np.zeros((len(has), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for k in range(ROWS):
                    acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + sig[:, k::ROWS].astype(np.uint64))
                per = np.zeros(n, np.int64)
                per[has] = BANDS
                sigs: list[bytes | None] = [None] * n
                for j, r in enumerate(has):
                    sigs[r] = sig[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(nodes, mask=counts == 0), pa.array(counts), list_array(acc.reshape(-1).view(np.int64), per, pa.int64()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "row_key", "node", "n_shingles", "bands", "sig"],
                )

    return sketch


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k_all = ROWS * BANDS
    for batch in batches:
        if not batch.num_rows:
            continue
        s = [np.frombuffer(text_buffers(batch.column(c))[0].tobytes(), np.uint32).reshape(-1, k_all) for c in (2, 3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((s[0] == s[1]).mean(1))], names=["hub", "doc_id", "est"])


def _confirmer(size: int, num: int, den: int):
    """Rows sorted by (hub, salt, role): the hub's text comes first, then the members'."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        key, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            hub, salt, role, doc = (batch.column(c).to_pylist() for c in range(4))
            data, off = text_buffers(batch.column(4))
            ok_h, ok_d = [], []
            for lo, hi in chunks(off):
                sh, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                for r in range(lo, hi):
                    own = np.unique(sh[bounds[r - lo] : bounds[r - lo + 1]])
                    if role[r] == 0:
                        key, hub_set = (hub[r], salt[r]), own
                    elif key == (hub[r], salt[r]):
                        small, big = (own, hub_set) if len(own) < len(hub_set) else (hub_set, own)
                        at = np.searchsorted(big, small)
                        at[at == len(big)] = 0
                        both = int((big[at] == small).sum()) if len(big) else 0
                        if both and den * both >= num * (len(own) + len(hub_set) - both):
                            ok_h.append(hub[r])
                            ok_d.append(doc[r])
            if ok_h:
                yield pa.RecordBatch.from_arrays([pa.array(ok_h, pa.int64()), pa.array(ok_d, pa.int64())], names=["hub", "doc_id"])

    return confirm


def confirm_pairs(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Of (hub, doc_id) pairs, those whose full sets are similar enough; texts: doc_id, text."""
    count = pairs.groupBy("hub").agg(F.count("*").alias("c")).withColumn("salts", F.ceil(F.col("c") / GROUP).cast("int"))
    salted = pairs.join(count.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("role"), "doc_id")
    hubs = count.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("doc_id"))
    rows = salted.unionByName(hubs).join(texts.hint("merge"), "doc_id").select("hub", "salt", "role", "doc_id", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return rows.mapInArrow(_confirmer(size, num, den), "hub bigint, doc_id bigint")


#: Counters that order shingles by rarity; few of them make the filter weaker, never wrong.
COUNTERS = 1 << 21


def _counter(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, off = text_buffers(batch.column(0))
            for lo, hi in chunks(off):
                sh, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds))
                order = np.lexsort((sh, row))
                sh, row = sh[order], row[order]
                new = np.ones(len(sh), bool)
                new[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
                total += np.bincount((sh[new] % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 16):
            own = at[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own])], names=["b", "n"])

    return count


TOKENS = "bucket bigint, doc_id bigint, place int, n_shingles int"


def _prefixer(size: int, num: int, den: int, rarity):
    """The shingles of each set's prefix, rarest first, with their places (from 0); those that no other set can hold are left out."""

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        count = rarity.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off):
                sh, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                out: list[list[np.ndarray]] = [[], [], [], []]
                for r in range(hi - lo):
                    own = np.unique(sh[bounds[r] : bounds[r + 1]])
                    c = count[(own % np.uint64(COUNTERS)).astype(np.int64)]
                    order = np.argsort(c, kind="stable")[: len(own) - -(-num * len(own) // den) + 1]
                    at = np.flatnonzero(c[order] > 1)
                    for k, v in enumerate((own[order][at].view(np.int64), np.full(len(at), ids[lo + r]), at, np.full(len(at), len(own)))):
                        out[k].append(v)
                cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["bucket", "doc_id", "place", "n_shingles"])

    return prefix


def _signer(size: int):
    """One-bit minima: the last bit of each of BITS minima."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off, 1 << 19):
                sh, bounds = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size)
                at, bits = bounds[:-1], np.zeros((hi - lo, BITS), np.uint8)
                for k in range(BITS):
                    bits[:, k] = (np.minimum.reduceat((sh * _C[k] + _D[k]) >> np.uint64(32), at) & np.uint64(1)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())], names=["doc_id", "bits"])

    return sign


def _cells(num: int, den: int):
    """Rows (cell, role, doc_id, c, place, n_shingles, bits) sorted by cell: those of role 0 meet those of role 1; pairs that may be similar come out.

    A cell that goes on in the next batch waits for it; cells hold about CELL rows of either role.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            cell = whole.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], "left"))
            rest = whole.slice(cut)
            if cut:
                yield from pairs_of(whole.slice(0, cut))
        if rest is not None:
            yield from pairs_of(rest)

    def pairs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, role, doc, c, place, n = (batch.column(k).to_numpy() for k in range(6))
        words = np.frombuffer(text_buffers(batch.column(6))[0].tobytes(), np.uint64).reshape(-1, BITS // 64)
        end = np.searchsorted(cell, cell, "right")
        odd = np.flatnonzero(role == 0)
        first = np.searchsorted(cell * 2 + role, cell[odd] * 2 + 1)  # cells are below 2**62
        size = end[odd] - first
        upto = np.cumsum(size)
        lo = 0
        while lo < len(odd):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, "right")))
            row, k = ragged(size[lo:hi])
            x, y = odd[lo:hi][row], first[lo:hi][row] + k
            # den * both >= num * (n + nx - both), and both is bounded by what is left of either set
            needed = -(-num * (n[x] + n[y]).astype(np.int64) // (den + num))
            ok = (c[x] != c[y]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= needed) & (np.minimum(n[x], n[y]) >= needed)
            x, y = x[ok], y[ok]
            for a in range(0, len(x), SLICE // 4):
                p, q = x[a : a + SLICE // 4], y[a : a + SLICE // 4]
                same = BITS - np.bitwise_count(words[p] ^ words[q]).sum(1, dtype=np.int64)
                near = 2 * same / BITS - 1 >= NEAR
                if near.any():
                    one, two = doc[p[near]], doc[q[near]]
                    found = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["hub", "doc_id"])
            lo = hi

    return compare


def components(edges: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with component the smallest node reachable: alternating large-star and small-star.

    Every round is written to the shared folder; it ends when a round changes nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = work.stage(e, "edges_0")
    mark = lambda d: d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    seen, k = mark(e), 0
    while seen["n"]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        k += 1
        e = work.stage(small, f"edges_{k}")
        now = mark(e)
        work.drop(f"edges_{k - 1}")
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept.

    similarity is an exact fraction of 0.8 or more: pairs are linked when
    den * |intersection| >= num * |union|. A document is kept when its id is the smallest
    of its component.
    """
    num, den = similarity
    if 10 * num < 8 * den:
        raise ValueError("bands and signatures are set for a similarity of 0.8 or more")
    spark = docs.sparkSession
    work = Workspace(spark, "neardup")
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = rows.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("row_key"), "text")
    sk = work.stage(rows.mapInArrow(_sketcher(shingle_words), SKETCH), "sketch")
    # one row for each distinct set
    reps = work.stage(sk.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("row_key")), "reps")
    own = sk.select("row_key", "node", "n_shingles", "bands", "sig").join(reps.select("node", "row_key").hint("merge"), ["node", "row_key"], "left_semi").dropDuplicates(["node", "row_key"])
    own = work.stage(own.withColumnRenamed("node", "doc_id"), "own")
    bucket = own.select("doc_id", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("bucket", "size")
    members = work.stage(bucket.join(shared.hint("merge"), "bucket"), "members")
    degree = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    members = work.stage(members.join(degree.hint("merge"), "doc_id").select("bucket", "doc_id", "degree"), "ranked")
    found = members.select("doc_id").distinct()
    found = work.stage(own.join(found.hint("merge"), "doc_id", "left_semi").select("doc_id", "row_key", "n_shingles", "sig"), "sigs", "none")
    sigs = found.select("doc_id", "n_shingles", "sig")
    # texts of nodes that share a bucket, once each; by a merge join at every size
    texts = rows.where("text is not null").select("row_key", "text").dropDuplicates(["row_key"])
    texts = work.stage(texts.join(found.select("row_key", "doc_id").hint("merge"), "row_key").select("doc_id", "text"), "texts")

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow the similarity."""
        x = pairs.join(sigs.hint("merge"), "doc_id").join(sigs.select(F.col("doc_id").alias("hub"), F.col("n_shingles").alias("n_hub"), F.col("sig").alias("sig_hub")).hint("merge"), "hub")
        x = x.where(den * F.least("n_shingles", "n_hub") >= num * F.greatest("n_shingles", "n_hub"))
        return x.select("hub", "doc_id", "sig", "sig_hub").mapInArrow(_estimate, "hub bigint, doc_id bigint, est double").where(F.col("est") >= ESTIMATE).select("hub", "doc_id")

    def several(rows: DataFrame) -> DataFrame:
        """Rows (bucket, c, ..) of buckets that hold several components, with the commonest of them."""
        share = rows.groupBy("bucket", "c").agg(F.count("*").alias("n"))
        commonest = share.groupBy("bucket").agg(F.max_by("c", F.struct("n", "c")).alias("big"), F.count("*").alias("k"), F.sum("n").alias("n_all")).where("k > 1")
        return rows.join(commonest.select("bucket", "big", "n_all").hint("merge"), "bucket")

    def with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
        c = comp.withColumnRenamed("node", "doc_id").hint("merge")
        return rows.join(c, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component")

    links: DataFrame | None = None
    comp: DataFrame | None = None
    tested: DataFrame | None = None
    for k in range(STARS):
        if comp is None:
            open_rows = members.select("bucket", "doc_id", "degree", F.col("doc_id").alias("c"), F.lit(None).cast("long").alias("big"))
        else:
            open_rows = work.stage(several(with_component(members, comp)), f"open_{k}")
        rank = F.struct("degree", -F.col("doc_id"))
        hubs = open_rows.where("big is null or c <> big").groupBy("bucket").agg(F.max_by(F.struct("doc_id", "c"), rank).alias("h")).select("bucket", F.col("h.doc_id").alias("hub"), F.col("h.c").alias("ch"))
        star = open_rows.join(hubs.hint("merge"), "bucket").where("c <> ch").groupBy("doc_id", "hub").agg(F.count("*").alias("n"))
        if tested is not None:
            star = star.join(tested.hint("merge"), ["hub", "doc_id"], "left_anti")
        star = work.stage(star.groupBy("doc_id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select("hub", "doc_id"), f"star_{k}")
        tested = star if tested is None else tested.unionByName(star)
        more = confirm_pairs(scored(star), texts, shingle_words, num, den)
        links = work.stage(more if links is None else links.unionByName(more), f"links_{k}")
        comp = components(links, Workspace(spark, "neardup"), "hub", "doc_id")

    # what is left: nodes of buckets that hold several components
    unsettled = several(with_component(members, comp)).select("doc_id").distinct()
    rest = work.stage(texts.join(unsettled.hint("merge"), "doc_id", "left_semi").select("doc_id", "text"), "rest")
    seen = rest.select("text").mapInArrow(_counter(shingle_words), "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    rarity = np.zeros(COUNTERS, np.int64)
    rarity[seen.column("b").to_numpy()] = seen.column("n").to_numpy()
    held = spark.sparkContext.broadcast(np.minimum(rarity, 1 << 30).astype(np.int32))
    tokens = work.stage(rest.mapInArrow(_prefixer(shingle_words, num, den, held), TOKENS), "tokens")
    full = work.stage(several(with_component(tokens, comp)), "tokens_open")
    signed = full.select("doc_id").distinct()
    bits = work.stage(rest.join(signed.hint("merge"), "doc_id", "left_semi").mapInArrow(_signer(shingle_words), "doc_id bigint, bits binary"), "bits", "none")
    n_odd = full.where("c <> big").groupBy("bucket").agg(F.count("*").alias("n_odd"))
    full = full.join(n_odd.hint("merge"), "bucket").join(bits.hint("merge"), "doc_id")
    blocks = lambda n: F.ceil(F.col(n) / CELL).cast("int")
    block = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    columns = ["bucket", "doc_id", "c", "place", "n_shingles", "bits"]
    one = full.where("c <> big").select(*columns, F.lit(0).alias("role"), block("n_odd").alias("i"), upto("n_all").alias("j"))
    two = full.select(*columns, F.lit(1).alias("role"), upto("n_odd").alias("i"), block("n_all").alias("j"))
    cells = one.unionByName(two).withColumn("cell", F.shiftrightunsigned(F.xxhash64("bucket", "i", "j"), 2))
    cells = cells.select("cell", "role", "doc_id", "c", "place", "n_shingles", "bits").repartition("cell").sortWithinPartitions("cell", "role")
    near = cells.mapInArrow(_cells(num, den), "hub bigint, doc_id bigint").distinct()
    both_ways = tested.select(F.least("hub", "doc_id").alias("hub"), F.greatest("hub", "doc_id").alias("doc_id"))
    near = work.stage(near.join(both_ways.hint("merge"), ["hub", "doc_id"], "left_anti"), "near")
    more = confirm_pairs(near, texts, shingle_words, num, den)
    joined = work.stage(comp.select(F.col("node").alias("hub"), F.col("component").alias("doc_id")).unionByName(more), "joined")
    final = components(joined, Workspace(spark, "neardup"), "hub", "doc_id")

    named = with_component(reps.select(F.col("node").alias("doc_id"), "least"), final)
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = work.stage(named.select(F.col("doc_id").alias("node"), "c").join(least.hint("merge"), "c").select("node", "component_id"), "named")
    work.drop("sigs", "members", "ranked", "rest", "tokens", "tokens_open", "bits", "near", "texts", "joined", "own", "reps", *[f"{n}_{k}" for n in ("open", "star", "links") for k in range(STARS)])

    out = sk.select("doc_id", "node", "n_shingles").join(named.hint("merge"), "node", "left")
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), component.isNull()).alias("kept"))
