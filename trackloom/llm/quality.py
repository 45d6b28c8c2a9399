"""Quality classifier from weak labels.

Overlapping heuristic labellers fire or stay silent on every document; firing says junk or
ordinary.
Expectation-maximisation over the counts of vote patterns (all documents, at most
2**LABELLERS patterns) estimates each labeller's accuracy and the posterior of each
pattern. The posteriors label a bounded sample (`fit_rows` distinct rows of id and text, by
hash) that a hashed linear scorer is fitted on; the scorer then scores every whole text.

No labelled rows are used; `labels` serves tests only.

Edge cases: texts of fewer than MIN_WORDS words (null and empty ones too) say nothing about
labellers: they are a pattern of their own, with the prior as its posterior, nothing is fitted
on them, and they are kept; rows that repeat an id or have none are scored one by one, and
equal texts alike; repeated rows are counted as often as they come, and fitted on once; ties
of the sample's order are rows of equal id and text; very long texts are scored whole, in
chunks of bytes; other columns of the table are never read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, NOT_SPACE, Workspace, chunks, list_array, mix, partitions, source_columns, span_hashes, text_buffers, word_spans
from trackloom.llm.mixing import word_count

#: (name, fires from, what firing says: 0 junk, 1 ordinary). Rates are shares of words, letters, trigrams or lines.
LABELLERS = [("symbol_words", 0.10, 0), ("upper_letters", 0.25, 0), ("repeated_neighbours", 0.15, 0), ("repeated_trigrams", 0.30, 0), ("shouted_words", 0.05, 0), ("bar_words", 0.05, 0), ("repeated_lines", 0.60, 0), ("long_words", 0.20, 0), ("plain_words", 0.90, 1), ("sentence_ends", 0.035, 1)]
MIN_WORDS = 8
DIM = 1 << 16
#: Buckets of the hashed byte trigrams; above them come the binned rates.
RATE_BINS = 12

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[[ord(c) for c in "#$%&*|~^<>{}[]=_\\"]] = 1
_ASCII_LETTER = np.zeros(256, np.int32)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = 1


_ODD = np.ones(256, np.int32)
_ODD[65:91] = _ODD[97:123] = _ODD[128:] = 0
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_END = np.zeros(256, np.int32)
_END[[ord(c) for c in ".,;:!?"]] = 1


def _upto(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def rates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x labellers, words of each row): what the labellers look at."""
    n = len(off) - 1
    starts, ends, first = word_spans(data, off, NOT_SPACE)
    words = np.diff(first)
    out = np.zeros((n, len(LABELLERS)))
    if not len(starts):
        return out, words
    low = LOWER[data]
    h = span_hashes(low, starts, ends)
    row = np.repeat(np.arange(n), words)
    per = np.maximum(words, 1)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row[flag], minlength=n) / per

    symbols = _upto(_SYMBOL[data])
    out[:, 0] = share(symbols[ends] > symbols[starts])
    # letters: ASCII, and two-byte Latin-1 whose second byte tells the case
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    letter = _ASCII_LETTER[data] + lead
    upper = ((data >= 65) & (data <= 90)) | (lead & (data < 0x9F))
    a, b = _upto(letter), _upto(upper)
    out[:, 1] = (b[off[1:]] - b[off[:-1]]) / np.maximum(a[off[1:]] - a[off[:-1]], 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    out[:, 2] = share(same)
    if len(h) > 2:
        tri = mix(mix(h[:-2] + np.uint64(11)) * np.uint64(3) + mix(h[1:-1] + np.uint64(5)) * np.uint64(7) + h[2:])
        whole = row[:-2] == row[2:]
        tri, own = tri[whole], row[:-2][whole]
        order = np.lexsort((tri, own))
        tri, own = tri[order], own[order]
        again = (tri[1:] == tri[:-1]) & (own[1:] == own[:-1])
        out[:, 3] = np.bincount(own[1:][again], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)
    bang = np.zeros(len(starts), bool)
    two = ends - starts >= 2
    bang[two] = (data[ends[two] - 1] == 33) & (data[ends[two] - 2] == 33)
    out[:, 4] = share(bang)
    out[:, 5] = share((ends - starts == 1) & (data[starts] == 124))
    cut = np.flatnonzero(data == 10)
    line_start = np.union1d(off[:-1], cut + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    lh = span_hashes(low, line_start, line_end)
    lr = np.searchsorted(off, line_start, "right") - 1
    order = np.lexsort((lh, lr))
    lh, lr = lh[order], lr[order]
    again = (lh[1:] == lh[:-1]) & (lr[1:] == lr[:-1])
    out[:, 6] = np.bincount(lr[1:][again], minlength=n) / np.maximum(np.bincount(lr, minlength=n), 1)
    out[:, 7] = share(ends - starts > 32)
    # letters only, but for one mark of punctuation at the end
    odd = _upto(_ODD[data])
    last_mark = _END[data[ends - 1]]
    out[:, 8] = share(odd[ends] - odd[starts] - last_mark == 0)
    out[:, 9] = np.minimum(share(_STOP[data[ends - 1]] & ~bang), 0.5)
    out[:, 9][out[:, 9] > 0.35] = 0
    return out, words


def fired(rate: np.ndarray) -> np.ndarray:
    return rate >= np.array([x[1] for x in LABELLERS])


SHORT = 1 << len(LABELLERS)


def pattern_ids(rate: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which labellers fire, as bits; SHORT for texts of few words."""
    return np.where(words < MIN_WORDS, SHORT, fired(rate) @ (1 << np.arange(len(LABELLERS))))


def expectation_maximisation(ids: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of ordinary by pattern, rate of firing [class, labeller] with junk first, prior of ordinary).

    Labellers are independent given the class. The start calls junk what any junk labeller
    fires on; from there on all rates are estimated. Half a firing and half a silence a class
    are added, so that no rate is 0 or 1.
    """
    says = np.array([x[2] for x in LABELLERS])
    v = (ids[:, None] >> np.arange(len(LABELLERS)) & 1).astype(bool)
    short = ids == SHORT
    n = np.where(short, 0.0, count)
    p = np.where((v & (says == 0)).any(1), 0.05, 0.95)
    rate, prior = np.full((2, len(LABELLERS)), 0.5), 0.9
    for _ in range(rounds):
        prior = float(((n * p).sum() + 0.5) / (n.sum() + 1))
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            rate[c] = ((v * w[:, None]).sum(0) + 0.5) / (w.sum() + 1)
        ratio = np.where(v, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + ratio.sum(1), -30, 30)))
        change, p = np.abs(new - p).max(initial=0), new
        if change < 1e-7:
            break
    return np.where(short, prior, p), rate, prior


def _rate_features(rate: np.ndarray, words: np.ndarray) -> np.ndarray:
    """One hashed feature per labeller: its binned rate (short texts have bins of their own)."""
    size = np.digitize(words, [3, MIN_WORDS])
    bins = np.minimum((np.log2(1 + 255 * rate) * 1.5).astype(np.int64), RATE_BINS - 1)
    return DIM + (np.arange(rate.shape[1]) * 3 + size[:, None]) * RATE_BINS + bins


FEATURES = DIM + len(LABELLERS) * 3 * RATE_BINS


def _trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the byte trigram at each place, number of places of each row)."""
    d = LOWER[data].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    code = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) & (DIM - 1)
    n = np.maximum(np.diff(off) - 2, 0)
    row = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    return bucket[off[:-1][row] + np.arange(len(row)) - first[row]], n


PATTERN = "doc_id bigint, pattern int"


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        for lo, hi in chunks(off):
            rate, words = rates(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(pattern_ids(rate, words), pa.int32())], names=["doc_id", "pattern"])


SAMPLE = "pattern int, buckets array<int>, weights array<float>"


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        for lo, hi in chunks(off):
            d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            rate, words = rates(d, o)
            pattern, extra = pattern_ids(rate, words), _rate_features(rate, words)
            bucket, n = _trigrams(d, o)
            end = np.cumsum(n)
            keys, weights = [], []
            for r in range(hi - lo):
                k, c = np.unique(bucket[end[r] - n[r] : end[r]], return_counts=True)
                keys.append(np.concatenate([k, extra[r]]).astype(np.int32))
                weights.append(np.concatenate([c / max(int(n[r]), 1), np.full(extra.shape[1], 1 / extra.shape[1])]).astype(np.float32))
            size = np.array([len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), list_array(np.concatenate(keys), size, pa.int32()), list_array(np.concatenate(weights), size, pa.float32())], names=["pattern", "buckets", "weights"])


def fit_linear(row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, target: np.ndarray, steps: int = 150, rate: float = 1.0, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression on sparse rows with soft targets by Adagrad; the last weight is the bias."""
    w = np.zeros(FEATURES + 1)
    seen = np.full(FEATURES + 1, 1e-6)
    n = max(len(target), 1)
    for _ in range(steps):
        z = np.bincount(row, weight * w[bucket], len(target)) * 4 + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.append(np.bincount(bucket, err[row] * weight * 4, FEATURES), err.sum()) + l2 * w / n
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


def _scorer(model, posterior):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        w, by_pattern = model.value, posterior.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off):
                d, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                rate, words = rates(d, o)
                bucket, n = _trigrams(d, o)
                total = np.zeros(len(bucket) + 1)
                np.cumsum(w[bucket], out=total[1:])
                end = np.cumsum(n)
                z = 4 * ((total[end] - total[end - n]) / np.maximum(n, 1) + w[_rate_features(rate, words)].mean(1)) + w[-1]
                s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                pattern = pattern_ids(rate, words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(pattern, pa.int32()), pa.array([by_pattern[int(p)] for p in pattern], pa.float64()), pa.array(s), pa.array(((s >= 0.5) | (pattern == SHORT)).astype(np.int32))],
                    names=["doc_id", "n_words", "pattern", "posterior", "score", "predicted"],
                )

    return score


SCORED = "doc_id bigint, n_words bigint, pattern int, posterior double, score double, predicted int"


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 4096) -> DataFrame:
    """Per document: doc_id, n_words, pattern, posterior and score (that it is ordinary text, 0 to 1), predicted (1: keep;
    texts of fewer than MIN_WORDS words, about which nothing is known, are kept).

    fit_rows bounds the sample that the linear scorer is fitted on: distinct rows of id and
    text with MIN_WORDS words or more. The vote counts behind its labels cover all documents.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "quality")
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    hashed = rows.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    per_pattern = hashed.mapInArrow(_label, PATTERN).groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("distinct"))
    counts = work.stage(per_pattern, "patterns").orderBy("pattern").collect()
    ids, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.float64)
    post, _, _ = expectation_maximisation(ids, n)
    by_pattern = {int(k): float(p) for k, p in zip(ids, post, strict=True)}
    # the cut leaves room for the error of the distinct count; the ordered limit is the bound
    share = min(1.0, 1.5 * fit_rows / max(sum(r["distinct"] for r in counts if r["pattern"] != SHORT), 1))
    chosen = hashed.where(F.pmod("doc_id", F.lit(1 << 40)) < int(share * (1 << 40))).where(word_count(F.col("text")) >= MIN_WORDS)
    chosen = chosen.dropDuplicates(["doc_id"]).orderBy(F.pmod("doc_id", F.lit(1 << 40)), "doc_id").limit(fit_rows).repartition(partitions(spark))
    fit = chosen.mapInArrow(_sample, SAMPLE).toArrow().combine_chunks() if len(ids) else None
    if fit is None or not fit.num_rows:
        model = np.zeros(FEATURES + 1)
    else:
        lists = fit.column("buckets").chunk(0)
        order = np.diff(lists.offsets.to_numpy())
        model = fit_linear(np.repeat(np.arange(fit.num_rows), order), lists.flatten().to_numpy(), fit.column("weights").chunk(0).flatten().to_numpy().astype(np.float64), np.array([by_pattern[p] for p in fit.column("pattern").to_pylist()]))
    sc = spark.sparkContext
    return rows.mapInArrow(_scorer(sc.broadcast(model), sc.broadcast(by_pattern)), SCORED)
