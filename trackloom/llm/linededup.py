"""Line dedup: line hashes range-partitioned with secondary sort by document and position.

The operator returns, for every document, a compressed keep bitmap instead of text;
`apply_bitmaps` turns bitmaps back into text. A line's key is the line stripped of
`[\\x20\\x09-\\x0D]` at both ends with A-Z lower-cased. Keys of at least `min_chars` code points
that occur in at least `min_docs` documents lose all their lines but those of the largest
document id.

Skew. The range partitioning is by (hash, document), so one hot line spreads over as many
tasks as its rows need. Each sorted batch decides the keys that lie wholly inside it. Keys
that touch a batch's edge may go on elsewhere; their rows are set aside and settled by one
map-side combined aggregate per key, which meets the rows again in SALTS parts per key.

Edge cases: a null or empty text is one empty line; rows that repeat a document id count as
one document, and each loses its own lines; null ids never count and keep all their lines;
repeated lines of one document go or stay together; very long texts are cut whole, in chunks
of bytes; other columns of the table are never read, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, NOT_SPACE, Workspace, chunks, mix, partitions, source_columns, span_hashes, text_buffers

#: Parts of a hot key when its rows meet their decision.
SALTS = 32
LINES = "h1 bigint, h2 bigint, doc_id bigint, line int, row_key bigint"


def line_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key start, key end, first line of each row and the end) of the lines in rows of lower-cased bytes."""
    n = len(off) - 1
    cut = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([off[:-1], cut + 1]))
    # a row that ends in \n has an empty last line, which starts where the next row does: one start each
    row = np.searchsorted(off[1:], starts, "right")
    per = np.bincount(np.searchsorted(off[1:], cut, "right"), minlength=n) + 1
    row = np.repeat(np.arange(n), per)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(per, out=first[1:])
    ends = np.empty_like(starts)
    ends[first[1:] - 1] = off[1:]
    inner = np.ones(len(starts), bool)
    inner[first[1:] - 1] = False
    ends[inner] = cut
    solid = np.flatnonzero(NOT_SPACE[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    empty = a == b
    if len(solid):
        s = np.where(empty, starts, solid[np.minimum(a, len(solid) - 1)])
        e = np.where(empty, starts, solid[np.maximum(b - 1, 0)] + 1)
    else:
        s = e = starts
    return row, s, e, first


def _hasher(min_chars: int):
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi in chunks(off):
                d, o = LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
                row, s, e, first = line_keys(d, o)
                chars = np.zeros(len(d) + 1, np.int64)
                np.cumsum((d & 0xC0) != 0x80, out=chars[1:])
                own = np.flatnonzero(chars[e] - chars[s] >= min_chars)
                h = span_hashes(d, s[own], e[own])
                h2 = span_hashes(255 - d, s[own], e[own])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(mix(h2 ^ (h >> np.uint64(7))).view(np.int64)), pa.array(ids[lo:hi][row[own]]), pa.array((np.arange(len(row)) - first[row])[own].astype(np.int32)), pa.array(keys[lo:hi][row[own]])],
                    names=["h1", "h2", "doc_id", "line", "row_key"],
                )

    return lines


DECIDED = "open boolean, h1 bigint, h2 bigint, doc_id bigint, line int, row_key bigint"


def _decider(min_docs: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2, doc = (batch.column(c).to_numpy() for c in range(3))
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            run = np.cumsum(new) - 1
            fresh = new.copy()
            fresh[1:] |= doc[1:] != doc[:-1]
            n_docs = np.bincount(run[fresh])
            last = np.append(np.flatnonzero(new)[1:] - 1, n - 1)
            edge = (run == 0) | (run == run[-1])
            out = edge | ((n_docs[run] >= min_docs) & (doc != doc[last][run]))
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(edge[at]), *(batch.column(c).take(pa.array(at)) for c in range(5))], names=["open", "h1", "h2", "doc_id", "line", "row_key"])

    return decide


BITMAP = "doc_id bigint, row_key bigint, n_lines bigint, n_dropped bigint, keep binary"


def packed(keep: np.ndarray) -> bytes:
    """Booleans by line as a compressed bitmap."""
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A bitmap as booleans by line: True where the line stays."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole: dict[int, bytes] = {}  # bitmaps of texts that keep all lines, by their number
    for batch in batches:
        maps, gone = [], []
        for n, x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if x is None:
                if n not in whole:
                    whole[n] = packed(np.ones(n, bool))
                maps.append(whole[n])
                gone.append(0)
                continue
            keep = np.ones(n, bool)
            keep[np.array(x, np.int64)] = False
            maps.append(packed(keep))
            gone.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "row_key", "n_lines", "n_dropped", "keep"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of both, which names rows whose ids are null or repeat."""
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.withColumn("row_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document row: doc_id, row_key (a hash of id and text), n_lines, n_dropped, keep (compressed bitmap of the lines that stay)."""
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    rows = _keyed(docs, id_col, text_col)
    keys = work.stage(rows.where("doc_id is not null").select("doc_id", "text", "row_key").mapInArrow(_hasher(min_chars), LINES), "keys")
    keys = keys.repartitionByRange(2 * partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "line")
    decided = work.stage(keys.mapInArrow(_decider(min_docs), DECIDED), "decided")
    work.drop("keys")
    held = decided.where("open")
    per_doc = held.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    per_key = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last")).where(F.col("docs") >= min_docs)
    parts = per_key.select("h1", "h2", "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = held.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    settled = salted.join(parts.hint("merge"), ["h1", "h2", "salt"]).where("doc_id <> last")
    gone = decided.where("not open").select("row_key", "line").unionByName(settled.select("row_key", "line"))
    gone = gone.groupBy("row_key").agg(F.collect_set("line").alias("gone"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) + 1
    counted = rows.select("doc_id", "row_key", n_lines.cast("long").alias("n_lines"))
    return counted.join(gone.hint("merge"), "row_key", "left").select("doc_id", "row_key", "n_lines", "gone").mapInArrow(_bitmaps, BITMAP)


APPLIED = "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string, keep binary, text string"


def _applier(with_text: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off, 1 << 22):
                part = batch.slice(lo, hi - lo)
                n_lines, n_dropped, sha, keeps, kept = [], [], [], [], []
                for t, m in zip(part.column(1), part.column(2), strict=True):
                    text, m = t.as_py() or "", m.as_py()
                    n = text.count("\n") + 1
                    stay = n
                    if m is not None:
                        keep = kept_lines(m, n)
                        stay = int(keep.sum())
                        if stay < n:
                            text = "\n".join(p for p, k in zip(text.split("\n"), keep, strict=True) if k)
                    n_lines.append(n)
                    n_dropped.append(n - stay)
                    sha.append(hashlib.sha256(text.encode()).hexdigest())
                    keeps.append(packed(np.ones(n, bool)) if m is None and with_text else m)
                    kept.append(text if with_text else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha), pa.array(keeps, pa.binary()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep", "text"])

    return apply


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, keep (its bitmap) and the kept text."""
    rows = _keyed(docs, id_col, text_col)
    # one plan at every size: texts meet the bitmaps that drop something by a merge join, whether or not these would fit a broadcast
    own = bitmaps.where("n_dropped > 0").select("row_key", "keep").dropDuplicates(["row_key"])
    return rows.join(own.hint("merge"), "row_key", "left").select("doc_id", "text", "keep").mapInArrow(_applier(with_text), APPLIED)
