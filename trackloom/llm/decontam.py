"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its documents into shards of a few MB of text and builds a word-level
FM-index of every shard: suffix array by prefix doubling, Burrows-Wheeler transform, and a
wavelet matrix for ranks. All test phrases (windows of consecutive item words) are searched
backwards at once; occurrences are located by walking to sampled suffix positions; the
spans are merged per document.

A word that no phrase holds cannot be part of an occurrence. Such words end a piece, and
pieces shorter than the shortest phrase are left out of the index; everything else is
indexed, and nothing is sampled or capped. There is no shuffle: a document is decided where
it is read. Benchmark items come in blocks of bounded size; each batch of documents is
searched for the blocks one after another, and their spans are merged in place.

Edge cases: null and empty texts have no words and are clean; items without words match
nothing; items shorter than the window are one phrase; repeated items are all reported, each
id once; an item without an id marks words but has no name to report; rows that repeat a
document id, or have none, are judged one by one at every benchmark size; very long texts are
shards of their own; other columns of both tables are never read, whatever their names; an
empty table gives an empty result, an empty benchmark clean documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, WORDLIKE, chunks, list_array, ragged, source_columns, span_hashes, text_buffers, word_spans

#: Bytes of benchmark text in one block. Its windows take some 15 times that on the driver while they are made, and a third of it in a task.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many queries at once."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.zeros, self.ones, self.bits, cur = [], [], [], seq
        for level in range(levels - 1, -1, -1):
            bit = cur >> level & 1
            count = np.zeros(len(cur) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.bits.append(level)
            self.ones.append(count)
            self.zeros.append(len(cur) - int(count[-1]))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before lo and before hi."""
        base = np.zeros(len(symbol), np.int64)
        for level, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            one = (symbol >> level & 1).astype(bool)
            base, lo, hi = (np.where(one, zeros + ones[x], x - ones[x]) for x in (base, lo, hi))
        return lo - base, hi - base

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level, ones, zeros in zip(self.bits, self.ones, self.zeros, strict=True):
            one = ones[at + 1] - ones[at]
            out |= one.astype(np.int64) << level
            at = np.where(one.astype(bool), zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Of a sequence of symbols 1 and above; 0 is added as its end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        t = np.append(seq.astype(np.int64), 0)
        n = len(t)
        rank, reach = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
        while True:  # prefix doubling; the unique end makes all suffixes differ at last
            second = np.zeros(n, np.int64)
            second[: max(0, n - reach)] = rank[reach:] + 1
            key = rank * (n + 1) + second
            sa = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = key[sa[1:]] != key[sa[:-1]]
            rank = np.empty(n, np.int64)
            rank[sa] = np.cumsum(new) - 1
            if new.all():
                break
            reach *= 2
        bwt = t[sa - 1]
        self.n = n
        self.before = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(t, minlength=symbols + 1), out=self.before[1:])
        self.wm = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        kept = sa % SAMPLE == 0
        self.marks = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.marks[1:])
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases (rows of a matrix, right-padded)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(length.max(initial=0))):
            live = np.flatnonzero((length > back) & (lo < hi))
            if not len(live):
                break
            c = phrases[live, length[live] - 1 - back].astype(np.int64)
            a, b = self.wm.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-array rows: LF steps to the next sampled position."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            hit = self.marks[r + 1] > self.marks[r]
            out[live[hit]] = self.samples[self.marks[r[hit]]] + steps
            live, r = live[~hit], r[~hit]
            c = self.wm.access(r)
            rows[live] = self.before[c] + self.wm.rank(c, r, r)[0]
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of items, over an alphabet of the items' words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        data, off = text_buffers(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, first = word_spans(data, off, WORDLIKE)
        h = span_hashes(data, starts, ends)
        self.alphabet, at = np.unique(h, return_inverse=True)
        ids = at.astype(np.int32) + 2  # 1 parts pieces, 0 pads phrases
        n = np.diff(first)
        windows = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
        owner, place = ragged(windows)
        start = first[:-1][owner] + place
        length = np.minimum(n[owner], window)
        matrix = np.zeros((len(owner), window), np.int32)
        for k in range(window):
            has = length > k
            matrix[has, k] = ids[start[has] + k]
        key, back = np.unique(matrix.view([("", np.int32)] * window).ravel(), return_inverse=True)
        self.matrix = key.view(np.int32).reshape(len(key), window)
        self.length = (self.matrix > 0).sum(1)
        pair = np.unique(np.stack([back, owner], 1), axis=0)
        self.items = pair[:, 1]
        self.first = np.searchsorted(pair[:, 0], np.arange(len(key) + 1))
        self.shortest = int(self.length.min()) if len(key) else 1 << 30

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hit words of a shard, and sorted distinct (row, item) pairs. words: hashes; first: first word of each row."""
        hit = np.zeros(len(words) + 1, np.int64)
        none = np.zeros((0, 2), np.int64)
        if not len(words) or not len(self.matrix):
            return hit[:-1] > 0, none
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        known = self.alphabet[at] == words
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        new = np.ones(len(words), bool)
        new[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        run = np.flatnonzero(new)
        size = np.diff(np.append(run, len(words)))
        good = known[run] & (size >= self.shortest)
        run, size = run[good], size[good]
        if not len(run):
            return hit[:-1] > 0, none
        # pieces one after another, each followed by a 1
        begin = np.cumsum(size + 1) - (size + 1)
        seq = np.ones(int((size + 1).sum()), np.int64)
        origin = np.full(len(seq), -1, np.int64)
        inner = np.arange(len(seq)) - np.repeat(begin, size + 1)
        is_word = inner < np.repeat(size, size + 1)
        origin[is_word] = (np.repeat(run, size + 1) + inner)[is_word]
        seq[is_word] = at[origin[is_word]] + 2
        index = FMIndex(seq, len(self.alphabet) + 2)
        lo, hi = index.search(self.matrix, self.length)
        n = hi - lo
        n[n < 0] = 0
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return hit[:-1] > 0, none
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        word = origin[index.locate(place)]
        np.add.at(hit, word, 1)
        np.add.at(hit, word + self.length[which], -1)
        pair = np.unique(np.stack([row[word], which], 1), axis=0)
        k = self.first[pair[:, 1] + 1] - self.first[pair[:, 1]]
        r = np.repeat(pair[:, 0], k)
        j = np.arange(len(r)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(self.first[pair[:, 1]], k)
        return np.cumsum(hit)[:-1] > 0, np.unique(np.stack([r, self.items[j]], 1), axis=0)


OUT = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, span_start array<bigint>, span_end array<bigint>"


def _searcher(phrases):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            shards = []
            for lo, hi in chunks(off, SHARD_BYTES):
                d, o = LOWER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo]
                starts, ends, first = word_spans(d, o, WORDLIKE)
                shards.append((lo, hi, span_hashes(d, starts, ends), first, np.zeros(len(starts), bool), [set() for _ in range(hi - lo)]))
            for block in phrases:
                own: Phrases = block.value
                for _, _, h, first, hit, names in shards:
                    more, pairs = own.find(h, first)
                    np.logical_or(hit, more, out=hit)
                    for r, i in pairs.tolist():
                        if own.names[i] is not None:
                            names[r].add(own.names[i])
                if len(phrases) > 1:  # a task holds one block at a time
                    del own
                    vars(block).pop("_value", None)
            for lo, hi, _, first, hit, names in shards:
                n = hi - lo
                row = np.repeat(np.arange(n), np.diff(first))
                per_row = np.bincount(row[hit], minlength=n)
                edge = np.ones(len(hit), bool)
                edge[1:] = (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])
                stop = np.ones(len(hit), bool)
                stop[:-1] = edge[1:]
                a, b = np.flatnonzero(hit & edge), np.flatnonzero(hit & stop)
                spans = np.bincount(row[a], minlength=n)
                items = [sorted(x) for x in names]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(np.diff(first)), pa.array(per_row, pa.int64()), pa.array(items, pa.list_(pa.string())), list_array(a - first[row[a]], spans, pa.int64()), list_array(b + 1 - first[row[b]], spans, pa.int64())],
                    names=["doc_id", "n_words", "n_hit", "items", "span_start", "span_end"],
                )

    return search


def _blocks(bench: DataFrame) -> Iterator[list[tuple[str, str]]]:
    held, size = [], 0
    for r in bench.toLocalIterator():
        held.append((r["item_id"], r["text"] or ""))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    yield held


def removal_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids found, sorted as strings), span_start, span_end (words to remove, end exclusive, merged)."""
    spark = docs.sparkSession
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    bench = source_columns(benchmark, item_id=item_id_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("string")).orderBy("item_id", "text")
    blocks = [spark.sparkContext.broadcast(Phrases(b, window)) for b in _blocks(bench)]
    out = rows.mapInArrow(_searcher(blocks), OUT)
    return out.withColumn("items", F.array_sort(F.array_distinct("items")))


def contaminated(n_hit, n_words):
    """At least a twentieth of the words are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
