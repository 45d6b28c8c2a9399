"""Corpus operators against brute force, exact round trips and held-out accuracy, with the edge cases of each."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import decontam, licenses, linededup, media, mixing, neardup, pii, quality, tokens, toxicity
from trackloom.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, k int"
LONG = "word " * 30000


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empties, a very long text, ties, repeated rows, and extra columns with clashing names."""
    line = "This very line of boilerplate is repeated in many documents."
    texts = [None, "", " ", "one", "one", "One two", LONG, LONG, "a b c d e f g\n" + line, "x y z\n" + line, line, "q\n" + line + "\nr", line.upper() + "\n", "same " * 3 + line, "\n\n", "Released under the MIT License.", "card 4111111111111111, mail a.b@c.org"]
    rows = [(i, t, None, f"s{i % 3}" if i % 4 else None, None, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_every_query_runs_and_the_contract_columns_are_there(spark):
    for name, f in Q.queries().items():
        df = f(spark, SF)
        assert "doc_id" in df.columns and df.count() == 200, name


# ------------------------------------------------------------------ 1
def test_pseudonyms_are_valid_linked_and_distinct(spark):
    values = ["4111111111111111", "4111 1111 1111 1111", "5500000000000004", "+1 (743) 555-3824", "1999-02-28", "28/02/1999", "02/30/1999", "10.0.0.7", "300.1.1.1", "123-45-6789", "ann.lee7@mail.example.com", "0" * 12 + "deadbeef" * 3]
    df = spark.createDataFrame([(i, f"see {v}, twice: {v}.") for i, v in enumerate(values)] + [(90, None), (91, ""), (92, "no numbers 12")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    new = {}
    for i, v in enumerate(values):
        m = re.fullmatch(r"see (.*), twice: (.*)\.", out[i]["text"])
        assert m[1] == m[2] and len(m[1]) == len(v) and re.sub(r"\d", "9", re.sub("[a-z]", "a", m[1])) == re.sub(r"\d", "9", re.sub("[a-z]", "a", v)) or i == 11
        new[v] = m[1]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(re.sub(r"\D", "", s)))) % 10 == 0
    assert luhn(new[values[0]]) and luhn(new[values[2]]) and new[values[0]] != values[0]
    assert re.sub(" ", "", new[values[1]]) == new[values[0]]
    assert new["300.1.1.1"] == "300.1.1.1" and all(int(x) < 256 for x in new["10.0.0.7"].split("."))
    assert out[90]["text"] is None and out[91]["text"] == "" and out[92]["text"] == "no numbers 12" and out[92]["n_found"] == 0


def test_feistel_is_a_permutation(spark):
    d = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert d.select(pii.permute_digits(F.col("d"), "k", F.lit("t")).alias("p")).distinct().count() == 1000
    days = spark.range(0, 20000).select(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pii.date(F.col("v"), "k").alias("p")).distinct().count() == 20000


# ------------------------------------------------------------------ 2
def brute_contamination(docs, items):
    pattern, found = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", {}
    windows = {}
    for i, t in items:
        w = words(t, pattern)
        for p in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[p : p + 13]), set()).add(str(i))
    for d, t in docs:
        w, hit, own = words(t, pattern), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit.update(range(p, p + n))
                    own |= windows[tuple(w[p : p + n])]
        found[d] = (len(w), len(hit), sorted(own))
    return found


def test_spans_equal_brute_force(spark):
    items = [(1, "the cat sat on the mat and then it ran away to the far sea again"), (2, "tiny one"), (3, "..."), (4, None), (10, "tiny one")]
    texts = ["the cat sat on the mat and then it ran away to the far sea again", "Tiny, ONE tiny one tiny", None, "", "cat " * 500, "x the cat sat on the mat and then it ran away to the far y", "the cat sat on the mat\nand then it ran away to the far sea again tiny one"]
    docs = list(enumerate(texts)) + [(5, texts[5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.removal_spans(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    want = brute_contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]]
        assert sum(b - a for a, b in zip(r["span_start"], r["span_end"], strict=True)) == r["n_hit"]
    empty = decontam.removal_spans(spark.createDataFrame(docs, "doc_id long, text string"), bench.where("false"))
    assert empty.where("n_hit > 0").count() == 0


def test_blocks_of_a_large_benchmark_merge(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 10)
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta gamma delta"), (3, "zeta")], "item_id long, text string")
    got = decontam.removal_spans(spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "eta")], "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in got] == [(4, 4, ["1", "2"]), (1, 0, [])]


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(1)
    seq = r.integers(1, 5, 400)
    index = decontam.FMIndex(seq, 5)
    pats = [seq[p : p + n] for p, n in ((0, 3), (100, 7), (395, 5), (7, 1))]
    m = np.zeros((4, 7), np.int64)
    for k, p in enumerate(pats):
        m[k, : len(p)] = p
    lo, hi = index.search(m, np.array([len(p) for p in pats]))
    for k, p in enumerate(pats):
        want = [i for i in range(len(seq) - len(p) + 1) if (seq[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


# ------------------------------------------------------------------ 3
def test_targets_stop_at_the_cap_and_flow_is_cheapest():
    sizes = {"a": 100, "b": 1000, None: 10}
    t = mixing.capped_targets(sizes, mixing.default_weights(list(sizes)), 1110, 3)
    assert t["a"] == 300 and abs(t[None] - 30) < 1e-9 and abs(sum(t.values()) - 1110) < 1e-9
    # a document of both sources serves the one that would have to repeat
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [20, 10], 3)
    assert flow[0] == {0: 10} and flow[1] == {1: 10} and flow[2] == {0: 10}


def test_mixture_comes_near_its_targets(spark, docs, none):
    d = Q.table(spark, "/root/testdata/sf0.01", "documents")
    out = mixing.mix_sources(d).toPandas()
    g = out.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert ((g.taken - g.target).abs() <= g.most).all() and (out.taken <= 3 * out["size"]).all()
    again = mixing.mix_sources(d.orderBy(F.rand(3))).toPandas()
    assert dict(zip(out.doc_id, out.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))
    small = mixing.mix_sources(docs).toPandas()
    assert len(small) == docs.count() and (small.taken <= 3 * small["size"]).all()
    assert mixing.mix_sources(none).count() == 0


# ------------------------------------------------------------------ 4, 5
def test_quality_agrees_with_labels_it_never_saw(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    got = quality.quality_scores(Q.table(spark, sf, "documents")).join(Q.table(spark, sf, "labels"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.97
    assert (got[got.quality == 1].predicted == 1).mean() > 0.98  # clean documents stay
    out = quality.quality_scores(docs)
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.quality_scores(none).count() == 0


def test_em_recovers_known_accuracies():
    r = np.random.default_rng(0)
    good = r.random(20000) < 0.85
    n = len(quality.LABELLERS)
    says = np.array([x[2] for x in quality.LABELLERS])
    fire = np.where(good[:, None] == (says == 1), r.random((20000, n)) < 0.6, r.random((20000, n)) < 0.01)
    ids, inv, count = np.unique(fire @ (1 << np.arange(n)), return_inverse=True, return_counts=True)
    p, _, prior = quality.expectation_maximisation(ids, count.astype(float))
    assert ((p[inv] > 0.5) == good).mean() > 0.99 and abs(prior - 0.85) < 0.02


def test_toxicity_on_held_out_rows(spark, docs, none):
    out = Q.op5_toxicity(spark, "/root/testdata/sf0.1").join(Q.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out").toPandas()
    pos, neg = out[out.toxic == 1].score.to_numpy(), out[out.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None]).mean() > 0.9
    assert (neg >= 0.5).mean() < 0.05
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    small = toxicity.toxicity_scores(docs, labels)
    assert small.count() == docs.count() and small.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.toxicity_scores(docs, labels.where("false")).where("score is null").count() == 0
    assert toxicity.toxicity_scores(none, labels.where("false")).count() == 0


# ------------------------------------------------------------------ 6
def brute_components(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = set(zip(*[w[k:] for k in range(size)], strict=False)) if len(w) >= size else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_copies(n, seed):
    """Families whose members are linked through others rather than directly."""
    r = np.random.default_rng(seed)
    rows = []
    for f in range(n):
        base = [f"w{f}_{i}" for i in range(60)]
        for _ in range(12):
            own = list(base)
            for k in r.integers(0, 60, r.integers(0, 8)):
                own[k] = f"e{r.integers(1 << 30)}"
            rows.append(" ".join(own))
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = near_copies(8, seed) + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b"), (1005, "b a"), (1006, LONG), (1007, LONG)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()
    want = brute_components(rows, 2, 80, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark, docs, none):
    assert neardup.near_duplicates(none).count() == 0
    out = neardup.near_duplicates(docs)
    assert out.count() == docs.count() and out.where("component_id is null").count() == 0


def test_components_of_a_long_chain(spark):
    from trackloom.llm.common import Workspace

    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(e, Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


# ------------------------------------------------------------------ 7
def brute_lines(rows):
    strip = " \t\n\x0b\x0c\r"
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders = {}
    for d, t in rows:
        for part in (t or "").split("\n"):
            k = low(part.strip(strip))
            if len(k) >= 40:
                holders.setdefault(k, set()).add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p in parts if len(holders.get(low(p.strip(strip)), ())) < 5 or max(holders[low(p.strip(strip))]) == d]
        out.append((d, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_lines_equal_brute_force(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows += [(100 + i, "é" * 40 + "\n" + "É" * 40 + f"\n\t{'shared words ' * 4} \r\n{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = linededup.apply_bitmaps(df, linededup.line_bitmaps(df))
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in out.collect()) == brute_lines(rows)
    assert linededup.line_bitmaps(none).count() == 0


# ------------------------------------------------------------------ 8
def test_licenses_in_lines_in_text_and_altered(spark, docs, none):
    mit, apache = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["Apache-2.0-header"]
    noise = "lorem ipsum dolor " * 40
    broken = mit.replace("merge, publish", "merge publish and")
    rows = [(1, noise + mit.upper() + noise), (2, apache), (3, noise), (4, "Released under the MIT License."), (5, broken), (6, None), (7, ""), (8, noise + "released under  the\nMIT license " + noise)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT-text", 2: "Apache-2.0,Apache-2.0-header", 3: "", 4: "MIT", 5: "MIT-text", 6: "", 7: "", 8: "MIT"}
    assert licenses.license_scan(docs).count() == docs.count() and licenses.license_scan(none).count() == 0


# ------------------------------------------------------------------ 9
def test_images_decode_and_resize():
    g = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
    assert (media.decode_image(media.encode_bmp(g))[..., 0] == g).all()
    assert (media.decode_image(b"P2\n# note\n2 2\n255\n0 10\n20 255\n")[..., 0] == [[0, 10], [20, 255]]).all()
    assert (media.decode_image(b"P1\n2 1\n1 0\n")[..., 0] == [[0, 1]]).all() or media.decode_image(b"P1\n2 1\n1 0\n").shape == (1, 2, 1)
    assert media.decode_image(b"P6\n1 1\n255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode_image(b"P5\n9 9\n255\n") is None and media.decode_image(b"") is None and media.decode_image(None) is None and media.decode_image(b"BM") is None
    img = np.random.default_rng(0).integers(0, 256, (6, 9, 1))
    assert np.allclose(media.area_resize(img, 3, 3)[..., 0], img[..., 0].reshape(3, 2, 3, 3).mean((1, 3)))
    assert abs(media.area_resize(img, 4, 5).mean() - img.mean()) < 1e-9


def test_media_round_trip(spark, docs, none):
    for r in media.media_columns(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.media_columns(none).count() == 0


# ------------------------------------------------------------------ 10
@pytest.mark.parametrize("top", [1, 2, 300, 50000, 1 << 31, 1 << 63])
def test_simple8b_round_trips(top):
    r = np.random.default_rng(top % 97)
    for n in (0, 1, 239, 255, 256, 257, 5000):
        ids = r.integers(0, top, n, dtype=np.uint64)
        assert (tokens.decode(tokens.encode(ids)) == ids).all()
    assert len(tokens.encode(np.zeros(10000, np.uint64))) < 10000


def test_token_files_hold_what_the_library_encodes(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    file = Q.tokenizer_file()
    tok = Tokenizer.from_file(file)
    odd = spark.createDataFrame([(50, "Σίσυφος it's ’s x<|endoftext|>y <|startoftext|>", "", "", 0, "", 0), (51, "é ́a é   \x1c \x85", "", "", 0, "", 0)], SCHEMA)
    both = docs.unionByName(odd)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_output(both, file).collect())
    rows, start, want = sorted(((r["doc_id"], r["text"]) for r in both.collect()), key=lambda r: (r[0], r[1] or "")), 0, []
    for d, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)
    path = f"file://{tmp_path}/shards"
    tokens.write_token_shards(both, path, file, 1, shards=3)
    files = tokens.export_shards(spark, path, f"file://{tmp_path}/out")
    raw = b"".join((tmp_path / "out" / f).read_bytes() for f in files)
    stored = spark.read.parquet(path).orderBy("shard", "segment").collect()
    assert files and raw == b"".join(bytes(r["payload"]) for r in stored) and len(list((tmp_path / "out").glob("*.s8b*"))) == len(files)
    assert tokens.token_output(none, file).count() == 0


# ------------------------------------------------------------------ the pipeline
def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as P

    docs = Q.table(spark, SF, "documents")
    seen = {}
    for name, f in P.STAGES[:-1]:
        out = f(spark, docs, SF)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.toPandas(), docs.schema)
        seen[name] = (docs.toPandas(), out.toPandas())
        docs = out
    before, after = seen["quality_classifier"]
    labels = Q.table(spark, SF, "labels").toPandas()
    clean = set(labels[labels.quality == 1].doc_id)
    assert clean <= set(after.doc_id) and len(after) < len(before)
    before, after = seen["near_dedup"]
    comp = brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 80, 100)
    assert set(after.doc_id) == {d for d, (_, c) in comp.items() if d == c}
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in Q.table(spark, SF, "benchmark").collect()]
    hit = brute_contamination(list(zip(before.doc_id, before.text, strict=True)), items)
    assert set(after.doc_id) == {d for d, (n, h, _) in hit.items() if not (h > 0 and 20 * h >= n)}
    before, after = seen["mixture"]
    taken, size = Counter(after.doc_id), {d: len(words(t)) for d, t in zip(before.doc_id, before.text, strict=True)}
    assert max(taken.values()) <= 3 and set(taken) <= set(size)
    total = sum(n * size[d] for d, n in taken.items())
    assert abs(total - sum(size.values())) < 0.1 * sum(size.values())
    last = P.STAGES[-1][1](spark, docs, SF).toPandas()
    assert len(last) == len(after) and last.n_tokens.sum() == last.start.max() + last.loc[last.start.idxmax()].n_tokens
