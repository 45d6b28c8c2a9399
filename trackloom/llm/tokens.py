"""Token-ID / binary output: Simple-8b word-aligned coding.

File format (all little-endian). A shard is a sequence of segments; a segment is

    magic   8 bytes  b"TLS8B\\x00\\x00\\x01"
    n_ids   uint64   ids in the segment
    n_esc   uint64   escaped ids
    n_word  uint64   64-bit words
    offsets uint32[ceil(n_ids / BLOCK) + 1]   first word of each block
    (padding to 8 bytes)
    words   uint64[n_word]
    esc_at  uint32[n_esc], esc_id uint64[n_esc] (after padding to 8 bytes)

A word holds a 4-bit selector in its top bits and a number of ids of equal width
below, first id lowest. Blocks of BLOCK ids start on a word of their own, so all
blocks of a segment are encoded and decoded side by side. Ids of more than 60 bits
are written as 0 and listed as escapes.

Edge cases: a null or empty text is its end id alone; equal ids stand together, by text, and
null ids come first; repeated rows are written as often as they come; very long texts are
encoded whole, and a document never goes over two segments; other columns of the table are
never read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import NOT_SPACE, Workspace, chunks, partitions, ragged, source_columns, span_hashes, text_buffers, word_spans

MAGIC = b"TLS8B\x00\x00\x01"
BLOCK = 256
#: Fixed values of Simple-8b: (ids in a word, bits of each), by selector.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([c for c, _ in SELECTORS], np.int64)
WIDTH = np.array([w for _, w in SELECTORS], np.uint64)
#: Ids of a segment at least, unless its shard ends; a document is never split between segments.
SEGMENT_IDS = 1 << 20


def _bits(ids: np.ndarray) -> np.ndarray:
    small = ids < (1 << 53)
    out = np.full(ids.shape, 64, np.uint8)
    out[small] = np.frexp(ids[small].astype(np.float64))[1].astype(np.uint8)
    big = ~small
    if big.any():
        out[big] = [int(x).bit_length() for x in ids[big]]
    return out


def encode(ids: np.ndarray) -> bytes:
    """A segment; decode() gives the same ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    esc = np.flatnonzero(ids >> np.uint64(60))
    esc_id = ids[esc]
    if len(esc):
        ids = ids.copy()
        ids[esc] = 0
    blocks = -(-n // BLOCK)
    head = MAGIC + np.array([n, len(esc)], "<u8").tobytes()
    if not n:
        return head + np.array([0], "<u8").tobytes() + bytes(8)
    last = n - (blocks - 1) * BLOCK
    grid = np.zeros((blocks, BLOCK), np.uint64)
    grid.reshape(-1)[:n] = ids
    bits = np.zeros((blocks, BLOCK), np.uint8)
    bits.reshape(-1)[:n] = _bits(ids)
    room = np.full(blocks, BLOCK, np.int64)
    room[-1] = last
    # the best selector at every place, as if a word began there: the most ids whose widest fits
    best = np.full((blocks, BLOCK), 15, np.uint8)
    wide, reach = bits, 1
    by_count = sorted(range(16), key=lambda s: SELECTORS[s][0])
    for s in by_count:
        count, width = SELECTORS[s]
        if count >= BLOCK:
            continue
        while reach < count:
            step = min(reach, count - reach)
            grown = np.full_like(wide, 255)
            grown[:, : BLOCK - step] = np.maximum(wide[:, : BLOCK - step], wide[:, step:])
            wide, reach = grown, reach + step
        best[wide <= width] = s
    # places near the end of the last block must not take ids that are not there
    tail = np.arange(max(0, last - 240), last)
    for p in tail:
        fits = [s for s in range(16) if SELECTORS[s][0] <= last - p and bits[-1, p : p + SELECTORS[s][0]].max() <= SELECTORS[s][1]]
        best[-1, p] = max(fits, key=lambda s: SELECTORS[s][0])
    at = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    n_words = np.zeros(blocks, np.int64)
    picked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        sel = best[live, at[live]]
        picked.append((live, at[live].copy(), sel))
        n_words[live] += 1
        at[live] += COUNT[sel]
        live = live[at[live] < room[live]]
    first = np.zeros(blocks + 1, np.int64)
    np.cumsum(n_words, out=first[1:])
    words = np.zeros(first[-1], np.uint64)
    flat = grid.reshape(-1)
    for k, (b, p, sel) in enumerate(picked):
        to = first[b] + k
        words[to] = sel.astype(np.uint64) << np.uint64(60)
        start = b * BLOCK + p
        for s in np.unique(sel):
            count, width = SELECTORS[s]
            if not width:
                continue
            own = np.flatnonzero(sel == s)
            out = words[to[own]]
            for j in range(count):
                out |= flat[start[own] + j] << np.uint64(j * width)
            words[to[own]] = out
    offsets = first.astype("<u4").tobytes()
    offsets += bytes(-len(offsets) % 8)
    tail_at = esc.astype("<u4").tobytes()
    tail_at += bytes(-len(tail_at) % 8)
    return head + np.array([len(words)], "<u8").tobytes() + offsets + words.astype("<u8").tobytes() + tail_at + esc_id.astype("<u8").tobytes()


def decode(blob: bytes) -> np.ndarray:
    """The ids of a segment, all words at once."""
    if blob[:8] != MAGIC:
        raise ValueError("not a token segment")
    n, n_esc, n_word = (int(x) for x in np.frombuffer(blob, "<u8", 3, 8))
    at = 32 + (-(-n // BLOCK) + 1) * 4
    at += -at % 8
    words = np.frombuffer(blob, "<u8", n_word, at).astype(np.uint64)
    at += 8 * n_word
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[sel]
    begin = np.cumsum(counts) - counts
    out = np.zeros(n, np.uint64)
    for s in np.unique(sel):
        count, width = SELECTORS[s]
        if not width:
            continue
        own = np.flatnonzero(sel == s)
        w, to, mask = words[own], begin[own], np.uint64((1 << width) - 1)
        for j in range(count):
            out[to + j] = (w >> np.uint64(j * width)) & mask
    if n_esc:
        where = np.frombuffer(blob, "<u4", n_esc, at).astype(np.int64)
        at += 4 * n_esc
        at += -at % 8
        out[where] = np.frombuffer(blob, "<u8", n_esc, at)
    return out


class WordTokenizer:
    """A tokenizer file applied word by word: each distinct word is encoded once per task.

    Right for tokenizers whose normaliser and pre-tokenizer never look across white
    space, as those that drop it. `check` compares texts encoded both ways: probes when the
    file is loaded, and the first texts of each task. Where they differ, `by_word` is off and
    all texts are encoded whole.
    """

    #: Texts whose words would differ under tokenizers that look across white space.
    PROBES = ("a", "a b", "a  b", " a", "a ", "a\tb\nc", "\n\na\n", "it's a 'b' c", "x ! y", "x, y. z", "1 2 3 456 7", "A b C", "\u00e9 e \u00e9", "\u4e2d \u6587 a", "a - b -- c", "the the the", "http://a.b c@d.e")
    FIRST_ROWS, FIRST_BYTES = 32, 1 << 15

    CACHE_WORDS = 2_000_000
    apart = "a"  # stands in for words that hold a special token, which are encoded alone

    def __init__(self, file: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        added = {i: t for i, t in self.tok.get_added_tokens_decoder().items() if t.special}
        self.special = [t.content[:2] for t in added.values()]
        self.mark = next(((t.content, i) for i, t in sorted(added.items()) if " " not in t.content and self.tok.encode(f"a {t.content} a", add_special_tokens=False).ids.count(i) == 1), None)
        self._clear()
        self.by_word = self.check(list(self.PROBES))
        self.met = False

    def check(self, texts: list[str]) -> bool:
        """Whether these texts get the same ids word by word as whole."""
        data, off = text_buffers(pa.array(texts, pa.string()))
        ids, n = self._words(data, off)
        whole = [self.tok.encode(t, add_special_tokens=False).ids for t in texts]
        return n.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def _batch(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each). Words that a special token keeps apart are encoded together."""
        fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        if self.mark is None or any(m in w for w in words for m in self.special):
            got = [e.ids for e in fast(words, add_special_tokens=False)]
            return np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got))
        text, mark = self.mark
        lines = [f" {text} ".join(words[k : k + 512]) + f" {text}" for k in range(0, len(words), 512)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in fast(lines, add_special_tokens=False)])
        at = np.flatnonzero(ids == mark)
        if len(at) != len(words):
            raise ValueError("a word was encoded as the separating token")
        n = np.diff(at, prepend=-1) - 1
        return ids[ids != mark], n

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, number of ids of each row)."""
        texts = lambda rows: [data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace") for r in rows]
        if self.by_word and not self.met:
            self.met = True
            own = np.flatnonzero(np.diff(off))[: self.FIRST_ROWS]
            self.by_word = self.check(texts(own[np.cumsum(np.diff(off)[own]) <= self.FIRST_BYTES]))
        if self.by_word:
            return self._words(data, off)
        got = [e.ids for e in self.tok.encode_batch(texts(range(len(off) - 1)), add_special_tokens=False)]
        return np.fromiter((i for g in got for i in g), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same, word by word."""
        starts, ends, first = word_spans(data, off, NOT_SPACE)
        h = span_hashes(data, starts, ends)
        uniq, where, inv = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.known, uniq)
        old = np.zeros(len(uniq), bool)
        inside = at < len(self.known)
        old[inside] = self.known[at[inside]] == uniq[inside]
        new = np.flatnonzero(~old)
        if len(new):
            raw = data.tobytes()
            s, e = starts[where[new]], ends[where[new]]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s.tolist(), e.tolist(), strict=True)]
            odd = [k for k, w in enumerate(words) if any(m in w for m in self.special)]
            if odd:  # these alone, so that the others still go together
                for k in odd:
                    words[k] = self.apart
            ids, n = self._batch(words)
            if odd:
                upto = np.cumsum(n)
                parts = np.split(ids, upto[:-1])
                for k in odd:
                    parts[k] = np.array(self.tok.encode(raw[s[k] : e[k]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
                ids, n = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
            self.ids = np.concatenate([self.ids, ids])
            slots = len(self.first) - 1 + np.arange(len(new))
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
            self.known, self.slot = np.insert(self.known, at[new], uniq[new]), np.insert(self.slot, at[new], slots)
            at = np.searchsorted(self.known, uniq)
        slot = self.slot[at][inv]
        n = self.first[slot + 1] - self.first[slot]
        row, k = ragged(n)
        ids = self.ids[self.first[slot][row] + k]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        return ids, upto[first[1:]] - upto[first[:-1]]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(file: str) -> WordTokenizer:
    if file not in _tokenizers:
        _tokenizers[file] = WordTokenizer(file)
    return _tokenizers[file]


SEGMENTS = "shard int, segment int, doc_ids array<bigint>, n_tokens array<bigint>, payload binary"


def _packer(tokenizer_file: str, end_id: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, shard, segment = _tokenizer(tokenizer_file), TaskContext.get().partitionId(), 0
        tok.met = False
        docs: list = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([[d for x in docs for d in x]], pa.list_(pa.int64())),
                    pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                    pa.array([encode(ids)], pa.binary()),
                ],
                names=["shard", "segment", "doc_ids", "n_tokens", "payload"],
            )
            segment += 1
            for x in (docs, counts, held):
                x.clear()
            return out

        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off, 1 << 20):
                ids, n = tok(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                # the end id goes behind each document
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)
                docs.append(batch.column(0).slice(lo, hi - lo).to_pylist())
                counts.append(n + 1)
                held.append(ids)
                if sum(map(len, held)) >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    return pack


def write_token_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode whole texts and write shards of segments in ascending id order.

    Rows are range-partitioned by id, so shard k holds smaller ids than shard k + 1.
    Null texts are empty; equal ids stay together, ordered by text; null ids come
    first. The shards are rows of a Parquet table, which Spark's committer makes safe
    against lost executors on any store; `export_shards` turns them into plain files.
    """
    spark = docs.sparkSession
    rows = source_columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    rows = rows.repartitionByRange(shards or 2 * partitions(spark), "id").sortWithinPartitions("id", "text")
    rows.mapInArrow(_packer(tokenizer_file, end_id), SEGMENTS).write.mode("overwrite").option("compression", "none").parquet(path)


READ = "shard int, segment int, place int, doc_id bigint, before bigint, n_tokens bigint, ids_crc32 bigint"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            ids = decode(batch.column(4)[k].as_py()).astype("<u4")
            doc_ids, n = batch.column(2)[k].values, np.asarray(batch.column(3)[k].values)
            end = np.cumsum(n)
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
            m = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, batch.column(0)[k].as_py()), pa.int32()), pa.array(np.full(m, batch.column(1)[k].as_py()), pa.int32()), pa.array(np.arange(m), pa.int32()), doc_ids, pa.array(end - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=["shard", "segment", "place", "doc_id", "before", "n_tokens", "ids_crc32"],
            )


def read_token_shards(spark, path: str) -> DataFrame:
    """Per document, from the stored bytes: doc_id, start, n_tokens, ids_crc32.

    The driver sees one row per shard (their number is that of the write's
    partitions); offsets of segments within a shard come from a window over shards.
    """
    from pyspark.sql import Window

    segments = spark.read.parquet(path)
    size = segments.select("shard", "segment", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    per_shard = sorted((r["shard"], r["n"]) for r in size.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    base, rows = 0, []
    for s, n in per_shard:
        rows.append((s, base))
        base += n
    bases = spark.createDataFrame(rows, "shard int, base long")
    within = Window.partitionBy("shard").orderBy("segment")
    first = size.join(F.broadcast(bases), "shard").select("shard", "segment", (F.col("base") + F.sum("n").over(within) - F.col("n")).alias("first"))
    docs = segments.select("shard", "segment", "doc_ids", "n_tokens", "payload").mapInArrow(_reader, READ)
    return docs.join(first, ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def _exporter(folder: str):
    def export(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        attempt, current, out, size = TaskContext.get().taskAttemptId(), None, None, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(f"{name(current)}.{attempt}", name(current))  # whole files only, whichever attempt comes first
            return pa.RecordBatch.from_arrays([pa.array([f"shard-{current:06d}.s8b"]), pa.array([size], pa.int64())], names=["file", "bytes"])

        def name(shard: int) -> str:
            return f"{root}/shard-{shard:06d}.s8b"

        for batch in batches:
            for shard, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if shard != current:
                    if out is not None:
                        yield close()
                    current, size = shard, 0
                    out = store.open_output_stream(f"{name(shard)}.{attempt}")
                out.write(payload.as_buffer())
                size += len(payload.as_buffer())
        if out is not None:
            yield close()

    return export


def export_shards(spark, path: str, folder: str) -> list[str]:
    """Write each shard as a plain file of concatenated segments below a folder (a URI) that the executors share; the names, in order.

    Tasks write their shards under a name of their own attempt and move them when they are whole.
    """
    rows = spark.read.parquet(path)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    dealt = rows.select("shard", "segment", "payload").repartition("shard").sortWithinPartitions("shard", "segment").select("shard", "payload")
    return sorted(r["file"] for r in dealt.mapInArrow(_exporter(folder), "file string, bytes bigint").collect())


def token_output(docs: DataFrame, tokenizer_file: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids to shards in the shared folder and return what is read back from them."""
    spark = docs.sparkSession
    path = Workspace(spark, "tokens").path("shards")
    write_token_shards(docs, path, tokenizer_file, end_id, id_col, text_col)
    return read_token_shards(spark, path)


__all__ = ["WordTokenizer", "decode", "encode", "export_shards", "read_token_shards", "token_output", "write_token_shards"]
