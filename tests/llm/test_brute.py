"""Operators without SQL against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from trackloom.llm import decontam, media, mixing, neardup, quality, tokens, toxicity
from trackloom.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


# ------------------------------------------------------------------ 5
def models_by_hand(toxic, ordinary, everything):
    """Kneser-Ney in dictionaries: continuation counts, modified discounts, the shared distribution."""
    shared = Counter(w for t in everything for w in words(t))
    total, out = sum(shared.values()), []
    for texts in (ordinary, toxic):
        follows = defaultdict(set)
        for t in texts:
            before = None
            for w in words(t):
                follows[w].add(before)
                before = w
        n = {w: len(v) for w, v in follows.items()}
        have = Counter(n.values())
        n1, n2, n3, n4 = (max(have[k], 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        less = {1: 1 - 2 * y * n2 / n1, 2: 2 - 3 * y * n3 / n2, 3: 3 - 4 * y * n4 / n3}
        less = {k: min(max(v, 0.1), k - 0.1) for k, v in less.items()}
        size = sum(n.values())
        backoff = sum(less[min(c, 3)] for c in n.values()) / size
        out.append(lambda w, n=n, size=size, backoff=backoff, less=less: (n[w] - less[min(n[w], 3)] if w in n else 0) / size + backoff * shared[w] / total)
    return out, shared


def test_toxicity_models_equal_brute_force_and_sum_to_one(spark, monkeypatch):
    r = np.random.default_rng(3)
    voc = [f"w{k}" for k in range(40)]
    text = lambda extra: " ".join(r.choice(voc + extra, 30, p=None))
    rows = [(i, text(["bad", "worse"] if i % 4 == 0 else []), int(i % 4 == 0)) for i in range(120)] + [(1000, None, None), (1001, "", None), (1002, "never seen before", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None], "doc_id long, toxic int")
    held, kept = [], toxicity.Models
    monkeypatch.setattr(toxicity, "Models", lambda *a: (held.append(kept(*a)), held[-1])[1])
    monkeypatch.setattr(toxicity, "MARGINS", (0.0,))
    got = {x["doc_id"]: x for x in toxicity.toxicity_scores(docs, labels).collect()}
    cal = {x["doc_id"] for x in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0).collect()}
    train = [(t, y) for i, t, y in rows if y is not None and i not in cal]
    (ordinary, toxic), shared = models_by_hand([t for t, y in train if y], [t for t, y in train if not y], [t for _, t, _ in rows])
    for p in (ordinary, toxic):
        assert abs(sum(p(w) for w in shared) - 1) < 1e-9
    for i, t, _ in rows:
        own = words(t)
        want = sum(math.log(toxic(w) / ordinary(w)) for w in own) / len(own) if own else 0.0
        assert abs(got[i]["difference"] - want) < 1e-5, i
    m = held[0]
    seen = len(m.words)
    assert seen == len({w for t, _ in train for w in words(t)}) and (np.diff(m.words.astype(object)) > 0).all()
    assert got[1000]["score"] == got[1001]["score"]


def test_toxicity_sample_is_bounded(spark):
    one = spark.range(4000).select((F.col("id") % 3).alias("doc_id"), F.lit("the same words again").alias("text"))
    many = spark.range(10, 4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    rows = one.unionByName(many)
    lab = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).cast("int").alias("toxic"))
    got = toxicity.training_rows(rows, lab, 100, 1 << 20, 2.0).groupBy("cal", "toxic").count().collect()
    n = {(r["cal"], r["toxic"]): r["count"] for r in got}
    assert n[False, 1] == 100 and n[False, 0] == 100 and n[True, 0] + n[True, 1] == 100
    small = toxicity.training_rows(rows, lab, 100, 200, 2.0)
    assert all(r["b"] <= 200 for r in small.groupBy("cal", F.when(~F.col("cal"), F.col("toxic"))).agg(F.sum(F.octet_length("text")).alias("b")).collect())


# ------------------------------------------------------------------ 6
def families(n, seed=0):
    """One template of 400 words, 18 families of 22 changed words, one word of its own for each document."""
    r = np.random.default_rng(seed)
    own = [r.choice(400, 22, False) for _ in range(18)]
    out = []
    for k in range(n):
        w = [f"t{i}" for i in range(400)]
        for p in own[k % 18]:
            w[p] = f"f{k % 18}_{p}"
        w[int(r.integers(400))] = f"x{k}"
        out.append((k, " ".join(w)))
    return out


def test_confirmations_stay_linear_where_all_pairs_are_near(spark, monkeypatch):
    asked, confirm = [], neardup.confirm_pairs
    monkeypatch.setattr(neardup, "confirm_pairs", lambda pairs, *a: (asked.append(pairs.count()), confirm(pairs, *a))[1])
    rows = families(300)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {k: k % 18 for k, _ in rows}
    assert sum(asked) <= 4 * len(rows)


def test_cells_of_a_hot_bucket_compare_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 3)
    monkeypatch.setattr(neardup, "STARS", 1)
    r, rows = np.random.default_rng(5), []
    for k in range(60):
        w = [f"t{i}" for i in range(60)]
        for p in r.integers(0, 60, r.integers(0, 7)):
            w[p] = f"e{r.integers(1 << 30)}"
        rows.append((k, " ".join(w)))
    sets = {d: set(zip(t.split(), t.split()[1:], strict=False)) for d, t in rows}
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == {d: (len(sets[d]), find(d)) for d in sets}


def test_one_bit_minima_estimate_the_similarity():
    from trackloom.llm.common import text_buffers
    import pyarrow as pa

    base = [f"t{i}" for i in range(500)]
    texts = [" ".join(base), " ".join(base[:450] + [f"n{i}" for i in range(50)])]
    (out,) = neardup._signer(1)(iter([pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(texts)], names=["doc_id", "text"])]))
    bits = np.frombuffer(text_buffers(out.column(1))[0].tobytes(), np.uint64).reshape(2, -1)
    same = neardup.BITS - int(np.bitwise_count(bits[0] ^ bits[1]).sum())
    assert abs(2 * same / neardup.BITS - 1 - 450 / 550) < 0.08


# ------------------------------------------------------------------ 3
def test_flow_is_cheapest_by_brute_force():
    def cost(sent, capacity):
        return sum(sum(min(max(f - k * c, 0), c) * k for k in range(3)) for f, c in zip(sent, capacity, strict=True))

    r = np.random.default_rng(1)
    for _ in range(25):
        capacity = r.integers(1, 4, 3).tolist()
        members = [[0], [1], [0, 1]]
        quota = r.integers(0, 9, 2).tolist()
        flow = mixing.min_cost_flow(capacity, members, quota, 3)
        best = None
        for a, b, x, y in itertools.product(*(range(3 * capacity[k] + 1) for k in (0, 1, 2, 2))):
            if x + y <= 3 * capacity[2] and a + x <= quota[0] and b + y <= quota[1]:
                key = (-(a + b + x + y), cost([a, b, x + y], capacity))
                best = key if best is None or key < best else best
        sent = [sum(f.values()) for f in flow]
        assert (-sum(sent), cost(sent, capacity)) == best
        assert all(sum(f.get(s, 0) for f in flow) <= quota[s] for s in (0, 1))


def test_overlapping_sources_are_mixed_through_the_network(spark):
    rows = [(i, "w " * (1 + i % 7), [["a"], ["b"], ["a", "b"], [], ["a", None]][i % 5]) for i in range(500)] + [(None, "w w", ["a"])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out = mixing.mix_sources(docs).toPandas()
    size = Counter()
    for _, t, s in rows:
        for x in set(s) or {None}:
            size[x] += len(t.split())
    total = sum(len(t.split()) for _, t, _ in rows)
    want = mixing.capped_targets(dict(size), mixing.default_weights(list(size)), total, 3)
    assert len(out) == len(rows) and (out.taken == out["size"] * out.copies).all() and out.copies.max() <= 3
    assert abs(out.taken.sum() - sum(want.values())) <= 8 * 5
    assert {s: t for s, t in zip(out.source, out.target, strict=True)}.keys() <= set(size)


def test_levels_of_the_cut_change_nothing(spark, monkeypatch):
    docs = Q.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "source")
    hot = spark.range(200).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same words").alias("text"), F.lit("src0").alias("source"))
    seen = []
    for rows in (0, 10_000):
        monkeypatch.setattr(mixing, "CELL_ROWS", rows)
        out = mixing.mix_sources(docs.unionByName(hot)).toPandas()
        g = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
        assert ((g.taken - g.target).abs() <= g.most).all()
        seen.append(Counter(zip(out.doc_id, out["size"], out.taken, strict=True)))
    assert seen[0] == seen[1]


# ------------------------------------------------------------------ 4
def test_em_equals_a_plain_version():
    r = np.random.default_rng(2)
    n = len(quality.LABELLERS)
    ids = np.unique(r.integers(0, 1 << n, 60))
    count = r.integers(1, 50, len(ids)).astype(float)
    says = [x[2] for x in quality.LABELLERS]
    votes = [[bool(i >> k & 1) for k in range(n)] for i in ids.tolist()]
    p = [0.05 if any(v and s == 0 for v, s in zip(row, says, strict=True)) else 0.95 for row in votes]
    for _ in range(12):
        prior = (sum(c * x for c, x in zip(count, p, strict=True)) + 0.5) / (count.sum() + 1)
        rate = []
        for side in (0, 1):
            w = [c * (x if side else 1 - x) for c, x in zip(count, p, strict=True)]
            rate.append([(sum(a for a, row in zip(w, votes, strict=True) if row[k]) + 0.5) / (sum(w) + 1) for k in range(n)])
        new = []
        for row in votes:
            z = math.log(prior / (1 - prior)) + sum(math.log(rate[1][k] / rate[0][k]) if v else math.log((1 - rate[1][k]) / (1 - rate[0][k])) for k, v in enumerate(row))
            new.append(1 / (1 + math.exp(-max(min(z, 30), -30))))
        p = new
    got, got_rate, _ = quality.expectation_maximisation(ids, count, rounds=12)
    assert np.allclose(got, p, atol=1e-6) and np.allclose(got_rate, rate, atol=1e-6)


# ------------------------------------------------------------------ 9
def test_tiles_and_hashes_equal_plain_loops(spark):
    texts = ["plain words " * 40, "x", "", "é" * 777]
    out = {r["doc_id"]: r for r in media.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}

    def area(img, h, w):
        big = np.kron(img, np.ones((h, w)))  # every pixel as h x w parts: each output pixel is a whole block of them
        return big.reshape(h, img.shape[0], w, img.shape[1]).mean((1, 3))

    for i, t in enumerate(texts):
        raw = t.encode() or bytes(64)
        img = np.frombuffer(raw + bytes(-len(raw) % 64), np.uint8).reshape(-1, 64).astype(float)
        tile = media.read_tile(out[i]["tile"])
        assert tile.shape == (*media.TILE, 1) and np.abs(tile[..., 0] - area(img, *media.TILE)).max() <= 0.5 + 1e-6
        small = np.round(area(img, 8, 9), 6)
        assert out[i]["feature"] == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def test_damaged_images_give_none():
    good = bytearray(media.encode_bmp(np.arange(12, dtype=np.uint8).reshape(3, 4)))
    for at, value in ((28, 0), (28, 16), (28, 3), (18, 0), (22, 0), (30, 3), (10, 255)):
        bad = bytearray(good)
        bad[at] = value
        if at in (18, 22):
            bad[at : at + 4] = bytes(4)
        assert media.decode_image(bytes(bad)) is None, (at, value)
    for bad in (b"P5 0 0 255\n", b"P5 4 0 255\n", b"P5 1 1 0\n\x01", b"P2 2 2 255\n1 2 3", b"P5", b"P6 1 1 255\n\x00", b"P4 0 3\n"):
        assert media.decode_image(bad) is None, bad


# ------------------------------------------------------------------ 2, 10
def test_phrases_of_a_block_equal_plain_windows():
    items = [("b", "one two three four"), (None, "two three"), ("a", "two three"), ("c", ""), ("d", None), ("e", "one two three four five")]
    p = decontam.Phrases([(i, t or "") for i, t in items], 3)
    want = defaultdict(set)
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        for s in range(max(len(w) - 2, 1) if w else 0):
            want[tuple(w[s : s + 3])].add(k)
    got = Counter(tuple(sorted(p.items[p.first[k] : p.first[k + 1]].tolist())) for k in range(len(p.matrix)))
    assert got == Counter(tuple(sorted(v)) for v in want.values()) and sorted(p.length.tolist()) == sorted(map(len, want))


def test_tokenizers_that_look_across_white_space_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tok = Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, unk_token="?"))
    tok.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    tok.save(str(tmp_path / "t.json"))
    own = tokens.WordTokenizer(str(tmp_path / "t.json"))
    assert not own.by_word
    data, off = np.frombuffer(b"a ba\nb", np.uint8), np.array([0, 3, 6])
    ids, n = own(data, off)
    assert ids.tolist() == [0, 1, 2] and n.tolist() == [1, 2]
    assert tokens.WordTokenizer(Q.tokenizer_file()).by_word


def test_digest_of_items():
    assert decontam.items_digest(["b", "a"]) == hashlib.sha256(b"a,b").hexdigest()
