"""Learned operators against brute force and held-out rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwatch.llm import kneser_ney as kn, language_id as lid, rule_forest as rf
from siftwatch.staging import stage_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {t: spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels")}


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string").withColumns({c: F.lit(1) for c in ("score", "kept", "n_words", "quality", "n", "own", "perplexity", "anomaly")})


# language identification


def test_forward_sums_all_segmentations():
    number, most = {"▁a": 0, "b": 1, "▁ab": 2, "bb": 3, "▁abb": 4}, 4
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [1e-7], [0.0]])
    got = lid.Lattices(["abb"], number, most, lid.matcher(number)).forward(table.__getitem__)[-1][0, 0]
    seg = 0.1 * 0.2 * 0.2 + 0.1 * 0.15 + 0.3 * 0.2 + 0.05 + 1e-7 * 1e-7 * 0.2**2 + 1e-14 * 0.15 + 1e-21 * 0
    # "▁", "a" are unknown letters: ▁ a b b and ▁ a bb.
    assert got == pytest.approx(seg, rel=1e-9)
    total = np.zeros((7, 1))
    lid.Lattices(["abb"], number, most, lid.matcher(number)).expected(table, np.array([0]), np.array([2]), total)
    assert total[4, 0] == pytest.approx(2 * 0.05 / seg) and total[1, 0] == pytest.approx(2 * (0.1 * 0.04 * 2 + 0.06) / seg, rel=1e-6)


def test_language_accuracy_and_edges(spark, tables):
    docs = tables["documents"]
    rows = lid.held_out_predictions(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)
    languages, table = lid.learn(docs.select("text", "lang").limit(200), PIECES)
    odd = docs_of(spark, [None, "", "123 !!", "the " * 20000, "x" * 5000, "日本語", "the", "the", "½ ² 12", "Ⅻ ① ⁵ ٣"], None)
    got = {r.doc_id: r for r in lid.predict(odd, PIECES, languages, table, [F.col("doc_id")]).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 8, 9)] == ["und"] * 5 and got[0].score == 0
    assert got[3].lang_pred == "en" and got[6][1:] == got[7][1:] and math.isfinite(got[4].score)
    nothing = lid.held_out_predictions(odd.where("doc_id < 0"), PIECES)
    assert nothing.count() == 0
    assert {r.lang_pred for r in lid.held_out_predictions(odd, PIECES).collect()} == {"und"}


# rules and forest


def brute_counts(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


ODD = ["", "a b c a b c", "é ü x  y\n\nz\n \nz", "#1 *2* <x> | & $%\n" * 3, "a\x0bb\x0cc\x1cd", "x x x x", "one"]


def test_counts():
    for t in ODD:
        assert rf.counts_of(t.encode())[:5] == brute_counts(t), t


def test_forest_verdict(spark, tables):
    rows = rf.judged(tables["documents"], tables["labels"])
    texts = {r.doc_id: r.text for r in tables["documents"].where("length(text) < 3000").limit(60).collect()}
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == tables["documents"].count()
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.anomaly <= r.threshold)
    share = rows.where("NOT base_failed").join(tables["labels"], "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r.quality: r.k for r in share.collect()}
    assert kept[1] >= 0.98 and kept[0] < 0.5


def test_forest_paths():
    rows = np.concatenate([np.random.default_rng(0).normal(0, 1, (400, 2)), [[9, 9]]])
    scores = rf.Forest(rows, 50, 128).scores(rows)
    assert scores.argmax() == 400 and ((0 < scores) & (scores < 1)).all()
    assert not rf.Forest(rows[:0]).scores(rows).any()
    assert rf.Forest(rows[:1] * 0).scores(rows[:1] * 0).shape == (1,)


def test_forest_edges(spark):
    docs = docs_of(spark, [None, "", *["word " * 60] * 3, " ".join(f"w{i}" for i in range(60))])
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id int, quality int, toxic int")
    got = {r.doc_id: r for r in rf.judged(docs, labels).collect()}
    assert [got[i].base_failed for i in range(6)] == [True, True, True, True, True, False] and got[5].kept
    assert rf.judged(docs.limit(0), labels.limit(0)).count() == 0


# Kneser-Ney


def brute_kn(train, text):
    grams = Counter()
    for t in train:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        grams.update(zip(w, w[1:], w[2:]))
    two = Counter((b, c) for _, b, c in grams)
    one = Counter(c for _, c in two)

    def off(counts):
        n = Counter(counts.values())
        if not n[1] or not n[2]:
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [min(max(d, 0.05), k) for k, d in enumerate(raw, 1)]

    d1, d2, d3 = off(one), off(two), off(grams)
    all1, off1 = sum(one.values()), sum(d1[min(n, 3) - 1] for n in one.values())

    def share(counts, d, key, lower):
        same = {k: n for k, n in counts.items() if k[:-1] == key[:-1]}
        if not same:
            return lower
        total = sum(same.values())
        n = counts.get(key, 0)
        return (n - d[min(n, 3) - 1] if n else 0) / total + sum(d[min(n, 3) - 1] for n in same.values()) / total * lower

    w, logs = ["<s>", "<s>", *text.split(), "</s>"], 0
    for a, b, c in zip(w, w[1:], w[2:]):
        p = (one[c] - d1[min(one[c], 3) - 1] if one[c] else 0) / all1 + off1 / all1 / (len(one) + 1)
        logs += math.log10(share(grams, d3, (a, b, c), share(two, d2, (b, c), p)))
    return len(w) - 2, 10 ** (-logs / (len(w) - 2))


TRAIN = ["a b c a b d", "a b c", "b c d e a b", "x y z", "a b a b a b", "c", "z a b c", "a c b", "d d d a"]


def test_kneser_ney_equals_brute_force(spark):
    folder = stage_path(spark)
    kn.write_shards(kn.train(spark.createDataFrame([(t,) for t in TRAIN], "text string")), folder, 3)
    texts = ["a b c", "q q", "", "a b q b c d e", "x y z a", "a b c a b c d e a b x y", "d d d d", "e"]
    got = {r.doc_id: r for r in kn.perplexities(docs_of(spark, texts), folder, 3).collect()}
    for i, t in enumerate(texts):
        n, p = brute_kn(TRAIN, t)
        assert got[i].n_tokens == n and got[i].perplexity == pytest.approx(p, rel=1e-4), t


def test_quality_verdict(spark, tables):
    rows = kn.judged(tables["documents"], tables["labels"], least=20).join(tables["labels"], "doc_id")
    kept = {r.quality: r.k for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] >= 0.97 and kept[0] < 0.5


def test_quality_edges(spark):
    docs = docs_of(spark, [None, "", "a b", "a b", "z " * 30000], None)
    labels = spark.createDataFrame([(2, 1, None), (3, 1, 0), (None, 1, 0), (4, 0, 0)], "doc_id int, quality int, toxic int")
    got = {r.doc_id: r for r in kn.judged(docs, labels).collect()}
    assert len(got) == 5 and not got[0].kept and not got[1].kept and got[2][2:] == got[3][2:]
    nothing = {r.doc_id: r.kept for r in kn.judged(docs, labels.limit(0)).collect()}
    assert nothing[2] and nothing[4] and not nothing[0]
    assert kn.judged(docs.limit(0), labels).count() == 0


def test_rare_languages_are_not_judged_by_others(spark, tables):
    docs, labels = tables["documents"], tables["labels"]
    rows = labels.join(docs.select("doc_id", "lang"), "doc_id").orderBy("doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.toxic]
    left = {r.doc_id for h in (0, 1) for r in [r for r in clean if r.lang == "es" and zlib.crc32(str(r.doc_id).encode()) % 2 == h][:3]}
    gone = [r.doc_id for r in clean if r.lang == "de" or r.lang == "es" and r.doc_id not in left]
    rare = labels.where(~F.col("doc_id").isin(gone))
    got = {r.doc_id: r for r in kn.judged(docs, rare).collect()}
    assert all(got[d].kept for d in gone)
    bad = [r.doc_id for r in rows if r.lang == "es" and r.quality == 0]
    assert sum(got[d].kept for d in bad) <= 0.6 * len(bad)
    assert {r.threshold for r in got.values() if r.lang == "de"} == {math.inf}
    held = [got[d].perplexity for d in left if zlib.crc32(str(d).encode()) % 2]
    assert {r.threshold for r in got.values() if r.lang == "es"} == {kn.MARGIN * max(held)}
    assert {r.doc_id for r in kn.accepted(docs, rare).collect()} == {d for d, r in got.items() if r.kept}
    none = kn.judged(docs.withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))), rare)
    assert {r.threshold for r in none.where("lang IS NULL").collect()} == {kn.MARGIN * max(held)}


def test_all_trusted_rows_of_the_half_are_learned(spark):
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 2 == 0]
    docs = spark.createDataFrame([(i, f"w{i}", "en") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in ids], "doc_id long, quality int, toxic int")
    assert len(ids) > 1500
    fitted, scored = kn.fit(docs, labels)
    # every text was learned, so all words are known and equally probable
    assert len({round(r.perplexity, 6) for r in scored.collect()}) == 1


def test_trigrams_are_packed_without_repeating_words():
    rng = np.random.default_rng(9)
    b, a, c = (np.sort(rng.integers(0, 1 << 62, k).astype(np.uint64)) for k in (3, 5, 40))
    grams = {(int(x), int(y), int(z)) for x, y, z in zip(rng.choice(a, 300), rng.choice(b, 300), rng.choice(c, 300))}
    rows = np.array(sorted(grams, key=lambda g: ((g[1] >> 32) % 4, g[1], g[0], g[2])), np.uint64)
    n = np.arange(1, len(rows) + 1)
    out = kn.packed(rows[:, 0], rows[:, 1], rows[:, 2], n, 4)
    back = kn.unpacked(pa.Table.from_batches([out]))
    assert all(np.array_equal(x, y) for x, y in zip(back, (*rows.T, n)))
    assert len(out.column("b").flatten()) == len(b) and len(out.column("a").flatten()) <= len(a) * len(b)
    assert len(kn.unpacked(pa.Table.from_batches([out.slice(1)]))[0]) == len(out.slice(1).column("c").flatten())
