"""Toxicity by class-conditional Kneser-Ney models.

Two models, toxic and ordinary, are counted from labelled training rows. A word's count in a
class is its continuation count, the number of distinct words it follows there, less a
discount that is estimated from the class's own counts of counts (modified Kneser-Ney). The
mass that the discounts take, and no more, goes to one distribution that both classes share:
the relative frequencies of words in all documents, counted without a cap. Each model thus
sums to 1 over the words of the corpus, and an expression that a class has not seen has the
same shape in both.

A document's score is a calibrated, monotone function of the difference of its two
length-normalised log-likelihoods. Before they are averaged, the words' log-ratios are moved
towards 0 by a margin, on both sides alike: what is below it is chance at the size of a
labelled sample. The margin (0 is among the choices) is the one that ranks the calibration
rows best; a fifth of the training rows calibrates and is not counted. labels, lang, source
and doc_id are never inputs of a score.

Sizes. The table of shared counts grows with the vocabulary and stays in the shared folder;
only the words of the labelled sample are looked up in it. That sample is bounded by
`max_rows` rows and `max_bytes` bytes of text a class, and by `ordinary_per_toxic`; its
words with evidence beyond the margin are what is broadcast.

Edge cases: null and empty texts have no words and get the score of no evidence; rows that
repeat an id are scored one by one, and equal texts get equal scores; labels of a null id and
null labels are ignored, an id labelled both ways is toxic; with no labelled rows of a class
every score is the prior; very long texts are scored whole, in pieces of bounded memory;
other columns of the table are never read, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import LOWER, WORDLIKE, Workspace, chunks, mix, source_columns, span_hashes, text_buffers, word_spans

BEGIN = np.uint64(0)
#: Margins that are tried.
MARGINS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 19


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each row and the end)."""
    d = LOWER[data]
    starts, ends, first = word_spans(d, off, WORDLIKE)
    return span_hashes(d, starts, ends), first


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w, back = np.unique(np.concatenate(words), return_inverse=True)
    return w, np.bincount(back, np.concatenate(counts), len(w)).astype(np.int64)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, how often) of a task's texts."""
    np.seterr(over="ignore")
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def hand_on() -> Iterator[pa.RecordBatch]:
        w, n = _merged(words, counts)
        for k in range(0, len(w), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(w[k : k + (1 << 16)].view(np.int64)), pa.array(n[k : k + (1 << 16)])], names=["w", "n"])

    for batch in batches:
        data, off = text_buffers(batch.column(0))
        for lo, hi in chunks(off):
            h, _ = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            w, n = np.unique(h, return_counts=True)
            words.append(w)
            counts.append(n)
            if sum(map(len, words)) > 2 * HELD_WORDS:
                w, n = _merged(words, counts)
                words[:], counts[:] = [w], [n]
                if len(w) > HELD_WORDS:
                    yield from hand_on()
                    words.clear()
                    counts.clear()
    if words:
        yield from hand_on()


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (class, word before, word) of a chunk of labelled texts."""
    np.seterr(over="ignore")
    for batch in batches:
        data, off = text_buffers(batch.column(1))
        toxic = batch.column(0).to_numpy()
        for lo, hi in chunks(off):
            w, first = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            v = np.empty_like(w)
            v[1:] = w[:-1]
            begins = first[:-1][np.diff(first) > 0]
            v[begins] = BEGIN
            c = np.repeat(toxic[lo:hi], np.diff(first)).astype(np.int32)
            at = np.unique(mix(v + c.astype(np.uint64)) + w, return_index=True)[1]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]), pa.array(v[at].view(np.int64)), pa.array(w[at].view(np.int64))], names=["toxic", "v", "w"])


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2 and more lose, from the counts of counts."""
    n1, n2, n3, n4 = (max(int((n == k).sum()), 1) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *(min(max(k - (k + 1) * y * b / a, 0.1), k - 0.1) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))])


class Models:
    """Both classes' probabilities of the words of the labelled sample.

    words: hashes; follows: continuation counts [class, word]; shared: counts in all
    documents; total: words of all documents.
    """

    def __init__(self, words: np.ndarray, follows: np.ndarray, shared: np.ndarray, total: int):
        order = np.argsort(words)
        self.words = words[order]
        common = shared[order] / max(total, 1)
        self.backoff, self.prob = np.ones(2), np.zeros((2, len(words)))
        for c in range(2):
            n = follows[c][order]
            size, lost = n.sum(), discounts(n)[np.minimum(n, 3)]
            if size:
                self.backoff[c] = lost.sum() / size
            self.prob[c] = (n - lost) / max(size, 1) + self.backoff[c] * common
        self.ratio = np.log(self.prob[1]) - np.log(self.prob[0])
        self.unseen = float(np.log(self.backoff[1]) - np.log(self.backoff[0]))

    def evidence(self, margin: float) -> Evidence:
        less = lambda x: np.sign(x) * np.maximum(np.abs(x) - margin, 0)
        ratio, unseen = less(self.ratio), float(less(np.array(self.unseen)))
        told = ratio != unseen
        return Evidence(self.words[told], ratio[told].astype(np.float32), unseen)


class Evidence:
    """Log-ratios by word, and that of all other words."""

    def __init__(self, words: np.ndarray, ratio: np.ndarray, other: float):
        self.words, self.ratio, self.other = words, ratio, other

    def difference(self, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per row, the difference of the length-normalised log-likelihoods; 0 without words."""
        total = np.zeros(len(w) + 1)
        if len(w):
            r = np.full(len(w), self.other)
            if len(self.words):
                at = np.searchsorted(self.words, w)
                at[at == len(self.words)] = 0
                known = self.words[at] == w
                r[known] = self.ratio[at[known]]
            np.cumsum(r, out=total[1:])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)


def spread(difference: np.ndarray) -> np.ndarray:
    """The difference on the scale that is calibrated: monotone, and finer near 0."""
    return np.sign(difference) * np.sqrt(np.abs(difference))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Newton's method; (slope, at least 0; bias)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    w = np.array([0.0, np.log(share / (1 - share))])
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + l2 * np.eye(2), z.T @ (p - y) + l2 * w)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w if w[0] > 0 else np.array([0.0, np.log(share / (1 - share))])


def ranking(x: np.ndarray, y: np.ndarray) -> float:
    """The share of (toxic, ordinary) pairs in the right order, ties as half."""
    if not y.any() or y.all():
        return 0.5
    values, at = np.unique(x, return_inverse=True)
    pos, neg = np.bincount(at[y == 1], minlength=len(values)), np.bincount(at[y == 0], minlength=len(values))
    below = np.cumsum(neg) - neg
    return float((pos * (below + neg / 2)).sum() / (pos.sum() * neg.sum()))


def _calibrator(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        choices = held.value
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off):
                w, first = words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(e.difference(w, first)) for e in choices)], names=["toxic", *(f"d{k}" for k in range(len(choices)))])

    return run


SCORED = "doc_id bigint, difference double, score double, predicted int"


def _scorer(held, weights: tuple[float, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            for lo, hi in chunks(off):
                d = held.value.difference(*words_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                s = 1 / (1 + np.exp(-np.clip(spread(d) * weights[0] + weights[1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(d), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "difference", "score", "predicted"])

    return run


def training_rows(rows: DataFrame, training: DataFrame, max_rows: int, max_bytes: int, ordinary_per_toxic: float) -> DataFrame:
    """(toxic, text, cal): distinct labelled rows of id and text by hash order, within the bounds; cal: rows that calibrate."""
    lab = training.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lab = lab.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    # a fifth calibrates, with the classes as they come; the rest is counted
    lab = lab.withColumn("cal", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0)
    size = {(r["cal"], r["toxic"]): r["n"] for r in lab.groupBy("cal", "toxic").agg(F.count("*").alias("n")).collect()}
    group = F.when(F.col("cal"), -1).otherwise(F.col("toxic"))
    found = {-1: size.get((True, 0), 0) + size.get((True, 1), 0), 0: size.get((False, 0), 0), 1: size.get((False, 1), 0)}
    want = {-1: max_rows, 1: max_rows, 0: min(max_rows, int(ordinary_per_toxic * min(max_rows, found[1])))}
    # ids to look for: somewhat more than wanted, so that the exact bound below can be met
    near = F.lit(0)
    for g, n in want.items():
        near = F.when(group == g, int(min(1.0, (1.3 * n + 50) / max(found[g], 1)) * (1 << 40))).otherwise(near)
    ids = lab.select("doc_id", "toxic", "cal", group.alias("g"), (F.col("h") < near).alias("use")).where("use").drop("use")
    here = rows.join(F.broadcast(ids), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    cut = F.lit(None).cast("long")
    for g, n in want.items():
        held = here.where(F.col("g") == g).select("key", F.octet_length("text").alias("b")).dropDuplicates(["key"]).orderBy("key").limit(n).collect()
        total = np.cumsum([r["b"] or 0 for r in held], dtype=np.int64)
        fits = int(np.searchsorted(total, max_bytes, "right"))
        cut = F.when(F.col("g") == g, held[fits - 1]["key"] if fits else None).otherwise(cut)
    return here.where(F.col("key") <= cut).groupBy("key").agg(*(F.first(c).alias(c) for c in ("toxic", "text", "cal"))).drop("key")


def toxicity_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20000, max_bytes: int = 64 << 20, ordinary_per_toxic: float = 6.0) -> DataFrame:
    """Per document row of docs: doc_id, difference (of length-normalised log-likelihoods, less the margin), score (0 to 1), predicted (score >= 0.5).

    training: (id_col, label_col) of labelled rows whose texts are in docs. max_rows and
    max_bytes bound the labelled rows of each class that are counted, and those that
    calibrate; ordinary rows are at most ordinary_per_toxic times the toxic ones.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    work = Workspace(spark, "toxicity")
    rows = source_columns(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    lab = source_columns(training, doc_id=id_col, toxic=label_col).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
    train = work.stage(training_rows(rows, lab, max_rows, max_bytes, ordinary_per_toxic), "train")

    shared = work.stage(rows.select("text").mapInArrow(_counter, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")), "shared")
    total = shared.agg(F.sum("n")).first()[0] or 0
    follows = train.where("not cal").select("toxic", "text").mapInArrow(_followers, "toxic int, v bigint, w bigint").distinct()
    seen = [F.sum((F.col("toxic") == c).cast("long")).alias(f"n{c}") for c in range(2)]
    known = follows.groupBy("w").agg(*seen).join(shared.hint("merge"), "w").toArrow()
    columns = {c: known.column(c).to_numpy() for c in ("w", "n0", "n1", "n")}
    models = Models(columns["w"].view(np.uint64), np.stack([columns["n0"], columns["n1"]]), columns["n"], total)

    choices = [models.evidence(m) for m in MARGINS]
    schema = "toxic int, " + ", ".join(f"d{k} double" for k in range(len(MARGINS)))
    cal = train.where("cal").select("toxic", "text").mapInArrow(_calibrator(sc.broadcast(choices)), schema).toArrow()
    y = cal.column("toxic").to_numpy().astype(np.float64)
    best = max(range(len(MARGINS)), key=lambda k: round(ranking(cal.column(f"d{k}").to_numpy(), y), 4))
    weights = fit_logistic(spread(cal.column(f"d{best}").to_numpy()), y)
    return rows.mapInArrow(_scorer(sc.broadcast(choices[best]), (float(weights[0]), float(weights[1]))), SCORED)
