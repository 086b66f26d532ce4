"""Jaccard groups and the language model against brute force; the pipeline's stages."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftwatch.llm import contamination, gru_lm as lm, jaccard as jc
from siftwatch.staging import stage

AZ = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split("[ \t-\r]+", (text or "").translate(AZ)) if w]


def shingles(text, size=3):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, per_cent=90, size=3):
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= per_cent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if group[j] == group[i])) for i in range(len(rows))}


def edited(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        k = rng.randrange(max(1, len(w)))
        w[k : k + 1] = rng.choice([[], [f"n{rng.randrange(10**6)}"], [*w[k : k + 1], f"n{rng.randrange(10**6)}"]])
    return w


def copies(seed, n=150):
    rng = random.Random(seed)
    texts = []
    passage = [f"p{i}" for i in range(60)]
    for _ in range(n):
        kind = rng.randrange(5)
        base = [f"w{rng.randrange(5)}_{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 9, 10, 11, 30, 120, 400]))]
        if kind == 0 or not texts:
            texts.append(base)
        elif kind == 1:
            texts.append(passage + base)
        elif kind == 2:
            texts.append(edited(rng, [f"hot{i}" for i in range(120)], rng.randrange(7)))
        else:
            texts.append(edited(rng, rng.choice(texts), rng.choice([0, 1, 1, 2, 3])))
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def docs_of(spark, rows):
    clash = ("n", "class", "block", "set", "root", "component_id", "first", "t", "key")
    return spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit(1) for c in clash})


@pytest.mark.parametrize("seed, slice_size", [(1, 10**6), (2, 600)])
def test_groups_equal_brute_force(spark, seed, slice_size):
    rows = copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jc.grouped(docs_of(spark, rows), slice_size=slice_size).collect()}
    want = brute_groups(rows)
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def test_group_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t"), (1, "A b"), (2, "a  B"), (3, "a"), (4, "b a"), (9, "x y z"), (8, "X y\nz"), (10, "a b c " * 9000), (11, "a b c " * 8000), (None, "x y z"), (8, "X y\nz")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jc.grouped(docs_of(spark, rows)).collect()), key=str)
    want = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (9, 1, 8), (8, 1, 8), (10, 3, 10), (11, 3, 10), (None, 1, 8), (8, 1, 8)]
    assert got == sorted(want, key=str)
    kept = [r.doc_id for r in jc.first_of_each(docs_of(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([5, 6, 7, 1, 3, 4, 8, 10, None], key=str)
    assert jc.grouped(docs_of(spark, []), slice_size=5).count() == 0


def test_segments_lose_no_link():
    rng = np.random.default_rng(3)
    for n in [9, 10, 11, 19, 20, 50, 200, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
            cut = rng.integers(0, jc.differing(n, 90) + 1)
            b = np.unique(np.concatenate([a[cut // 2 :], rng.integers(0, 1 << 60, cut - cut // 2).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert np.intersect1d(jc.meetings(a, 90), jc.meetings(b, 90)).size or np.array_equal(a, b)


@pytest.mark.parametrize("per_cent", [80, 90])
def test_segments_lose_no_link_at_the_limit(per_cent):
    rng = np.random.default_rng(4)
    for n in [5, 9, 10, 25, 60, 200, 1000, 1249, 1250, 4000]:
        for _ in range(20):
            # The smaller side at and near its least size, where sets differ most and bands meet.
            m = rng.integers(-(-per_cent * n // 100), n + 1)
            both = -(-per_cent * (n + m) // (100 + per_cent))
            if both > m:
                continue
            x = np.unique(rng.integers(0, 1 << 60, n + m - both).astype(np.uint64))
            x = rng.permutation(x)
            a, b = np.sort(x[:n]), np.sort(x[n - both :])
            assert np.array_equal(a, b) or np.intersect1d(jc.meetings(a, per_cent), jc.meetings(b, per_cent)).size


def test_sets_that_share_nothing_seldom_meet_at_four_fifths():
    rng = np.random.default_rng(5)
    for n in [300, 1001, 1100, 1249, 3000]:
        keys = Counter(k for _ in range(100) for k in jc.meetings(np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)), 80).tolist())
        assert max(keys.values()) <= 2, n


def test_sets_are_listed_under_few_large_segments():
    rng = np.random.default_rng(7)
    listed = size = met = 0
    for n in range(300, 1500, 10):
        common = rng.integers(0, 1 << 60, n)
        a, b = (np.unique(np.concatenate([common[: n // 6], rng.integers(0, 1 << 60, n - n // 6)]).astype(np.uint64)) for _ in range(2))
        listed, size = listed + len(jc.meetings(a, 80)), size + n
        met += bool(np.intersect1d(jc.meetings(a, 80), jc.meetings(b, 80)).size)
    assert listed < 0.4 * size  # 0.25 of the shingles may differ
    assert met < 50  # a shared sixth: by small segments 75 of 120 met


def test_near_duplicate_stage_takes_five_words_at_four_fifths(spark):
    rng = random.Random(6)
    rows = []
    for i in range(40):
        base = [f"w{i}_{k}" for k in range(200)]
        rows += [(10 * i + j, " ".join(edited(rng, base, e))) for j, e in enumerate((0, 2, 3, 4, 5, 9))]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs_of(spark, rows), "").collect()}
    sets = {d: shingles(t, 5) for d, t in rows}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = set()
    for i in range(40):  # bases share nothing
        left = [10 * i + j for j in range(6)]
        while left:
            group = [left.pop(0)]
            for a in group:
                near = [b for b in left if alike(a, b)]
                group += near
                left = [b for b in left if b not in near]
            want.add(min(group))
    assert kept == want and kept < {d for d, (_, c) in brute_groups(rows).items() if c == d}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200)]
    got = {r.v: r.root for r in jc.components(stage(spark.createDataFrame(edges, "a long, b long"))).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), **dict.fromkeys((200, 201, 202), 200)}


# the language model


@pytest.fixture(scope="module")
def vocabulary(spark):
    texts = spark.createDataFrame([("the cat sat. the dog",), ("le chat the",), ("x",)], "text string")
    return lm.Vocabulary(stage(lm.counted(texts)))


def test_output_is_a_distribution(vocabulary):
    net = lm.Gru(vocabulary)
    rng = np.random.default_rng(0)
    net.p["wc"], net.p["wi"] = rng.normal(0, 1, net.p["wc"].shape).astype("f"), rng.normal(0, 1, net.p["wi"].shape).astype("f")
    state = rng.normal(0, 1, (1, lm.HIDDEN)).astype("f")
    codes = np.arange(net.n + lm.SHAPES + 1)
    logs, _ = net.output(np.repeat(state, len(codes), axis=0), codes)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    # Within a shape: all known words and one unknown one.
    v = vocabulary
    assert (v.mass + lm.ALPHA * (v.inside + 1)).tolist() == v.whole.tolist() and v.tokens == 12 and v.ends == 3


def test_gradients(vocabulary):
    net = lm.Gru(vocabulary, seed=3)
    rng = np.random.default_rng(1)
    net.p = {k: (a + rng.normal(0, 0.3, a.shape)).astype(np.float64) for k, a in net.p.items()}
    steps, lanes = 5, 3
    inputs, targets = rng.integers(0, net.codes, (steps, lanes)), rng.integers(0, net.end + 1, (steps, lanes))
    fresh = rng.random((steps, lanes)) < 0.3
    state = rng.normal(0, 1, (lanes, lm.HIDDEN))

    def loss():
        h, total = state, 0
        for t in range(steps):
            h, _ = net.step(net.p["embed"][inputs[t]] @ net.p["wx"] + net.p["b"], np.where(fresh[t][:, None], 0, h))
            total -= net.output(h, targets[t])[0].sum()
        return total / steps / lanes

    grads, _ = net.learn(inputs, targets, fresh, state)
    for k, g in grads.items():
        for at in rng.choice(g.size, 6, replace=False):
            at = np.unravel_index(at, g.shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-4
            up = loss()
            net.p[k][at] = old - 1e-4
            down = loss()
            net.p[k][at] = old
            assert g[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-5), k


def test_state_is_carried_through_whole_texts(vocabulary):
    net, rng = lm.Gru(vocabulary), np.random.default_rng(2)
    net.p["wc"] = rng.normal(0, 1, net.p["wc"].shape).astype("f")
    texts = [np.append(rng.integers(0, net.end, n), net.end) for n in [0, 1, 5, 23, 24, 25, 130, 300]]
    together = lm.log_likelihoods(net, texts, lanes=3)
    for t, got in zip(texts, together):
        h, code, total = np.zeros((1, lm.HIDDEN), np.float32), net.start, 0
        for c in t:
            h, _ = net.step(net.p["embed"][[code]] @ net.p["wx"] + net.p["b"], h)
            total += float(net.output(h, np.array([c]))[0][0])
            code = c
        assert got == pytest.approx(total, rel=1e-4)


def test_different_words_are_looked_up_once(vocabulary, monkeypatch):
    met: list[bytes] = []
    key_of = lm.key_of
    monkeypatch.setattr(lm, "key_of", lambda word: met.append(word) or key_of(word))
    coder, texts = lm.Coder(vocabulary), [" The cat\tSAT. ", None, "", "  ", "the\nthe cat Ünï \x1c.. q9! q9", "cat"]
    for _ in range(2):
        places, bounds = coder.texts(pa.array(texts))
        want = [[w.encode() for w in words(t)] for t in texts]
        got = [coder.rows["key"][places[a:b]].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [[key_of(w) for w in t] for t in want]
    assert len(met) == len(set(met)) == len({w for t in want for w in t})
    assert lm.shapes([b"a", b"z.", b"..", b"9", b"9,", "é!".encode(), b"\xff", b"x-a"]).tolist() == [0, 51, lm.SHAPES - 1, 54, 55, 53, 52, 0]


def test_scores_and_base(spark, sf, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 50)
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    rows = lm.held_out_scores(docs).collect()
    texts = {r.doc_id: [*words(r.text), "</end>"] for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(texts) and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_edges(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "a b. c", "a b. c", "日本 x9 !!", "w " * 9000])] + [(None, "q"), (2, "other")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit(1) for c in ("row", "score", "n_known", "rare", "key", "times", "n")})
    got = lm.held_out_scores(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 4, 4, 4, 9001]
    assert lm.held_out_scores(docs.limit(0)).count() == 0
    only_held = docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lm.held_out_scores(only_held).collect())


def test_sets_of_a_sliced_block_are_written_once(spark, monkeypatch):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, f"{shared} own{i}") for i in range(40)] + [(40 + i, f"x{i} y{i} z{i} q{i}") for i in range(5)]
    held = []
    links = jc.grid_links

    def watched(members, slices, per_cent):
        held.append((members.count(), [r.slices for r in slices.collect()]))
        return links(members, slices, per_cent)

    monkeypatch.setattr(jc, "grid_links", watched)
    got = {r.doc_id: r.component_id for r in jc.grouped(docs_of(spark, rows), slice_size=200).collect()}
    assert got == {i: 0 if i < 40 else i for i in range(45)}
    (moved, (slices,)), = held
    assert moved == 40 and slices > 5


# the pipeline


@pytest.fixture(scope="module")
def stages(spark, sf):
    folder = sf.replace("0.001", "0.01")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], folder)))
    return out


def test_pipeline_stages(spark, sf, stages):
    docs = stages[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").collect()}
    rows = [{r.doc_id: r for r in s.collect()} for s in stages]
    for before, after, s in zip(rows, rows[1:], stages[1:5]):
        assert s.columns == docs.columns and set(after) <= set(before)
    for i in (1, 2):  # good documents stay, bad ones go
        good = [d for d in rows[i - 1] if labels.get(d) == 1 and len(words(rows[0][d].text)) >= 60]
        assert sum(d in rows[i] for d in good) >= 0.97 * len(good)
    assert sum(labels.get(d) == 0 for d in rows[2]) < 0.35 * sum(x == 0 for x in labels.values())
    want = brute_groups([(d, r.text) for d, r in sorted(rows[2].items())], per_cent=80, size=5)
    assert set(rows[3]) == {d for d, (_, c) in want.items() if c == d}
    bench = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/benchmark.parquet")
    hit = {r.doc_id for r in contamination.report(stages[3], bench).where("contaminated").collect()}
    assert hit and not contamination.report(stages[4], bench).where("contaminated").count()
    for d, r in rows[4].items():
        assert r.n_chars == len(r.text) and (d in hit or r.text == rows[3][d].text)
    tiktoken = pytest.importorskip("tiktoken")
    from siftwatch.llm.byte_pairs import read_ranks

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for d in sorted(rows[5])[:100]:
        ids = np.array(own.encode_ordinary(rows[4][d].text), "<u4").tobytes()
        assert bytes(rows[5][d].ids) == ids and rows[5][d].ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_pipeline_handles_odd_tables(spark, sf):
    schema = "doc_id int, text string, lang string, source string, n_chars int"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "a b " * 50, None, "s", 200), (2, "a b " * 50, None, "s", 200), (3, "word " * 20000, "en", None, None)], schema)
    for docs in (odd, odd.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            docs_out = step(spark, docs, sf)
            assert docs_out.count() <= docs.count(), name


def test_pipeline_stages_keep_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumn("_limit", F.lit(-1.0)).withColumn("_of", F.lit("x")).withColumn("_rows", F.lit(7)).withColumn("component_id", F.lit(-3))
    plain, odd = docs, extra
    for name, step in corpus_pipeline.STAGES[:4]:
        plain, odd = stage(step(spark, plain, sf)), stage(step(spark, odd, sf))
        assert odd.columns == extra.columns, name
        want = sorted((r.doc_id, r.text) for r in plain.collect())
        got = odd.collect()
        assert sorted((r.doc_id, r.text) for r in got) == want, name
        assert {(r._limit, r._of, r._rows, r.component_id) for r in got} <= {(-1.0, "x", 7, -3)}, name
