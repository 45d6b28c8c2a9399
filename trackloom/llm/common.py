"""Shared helpers: work tables in the shared folder and byte-level text kernels.

The kernels look at the UTF-8 buffers of an Arrow column directly, so a batch
of documents is handled by a few numpy passes instead of a Python loop over
words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task, so that the arrays over them stay in the cache; one longer document is handled alone.
CHUNK_BYTES = 1 << 18


# ---------------------------------------------------------------- work tables
def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a folder of its own in local mode; on a cluster that is an error, as each machine would have another."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.trackloom.scratch", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.trackloom.scratch", named)
    return named


class Workspace:
    """Tables written below the shared folder, so that lineage ends there and lost executors cost nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/trackloom/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def source_columns(docs: DataFrame, **cols: str) -> DataFrame:
    """Project exactly the needed columns under fixed names, whatever else the table has."""
    return docs.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


# ---------------------------------------------------------------- text kernels
def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buf = column.buffers()
    off = np.frombuffer(buf[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, at least one row each."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: digits, a-z and all that is not ASCII.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the words in rows of bytes; no word crosses a row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = table[data]
    edge = np.zeros(n + 1, bool)
    edge[off[off <= n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    starts = np.flatnonzero(w & (~before | edge[:-1]))
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if not _pow or len(_pow[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for b in (_BASE, inverse):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _pow[:] = out
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same for equal bytes everywhere: a polynomial over random byte values."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per row: the row of each element and its place within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return row, np.arange(len(row)) - first[row]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
