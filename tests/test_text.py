import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import regex
from conftest import cosines, greedy
from pyspark.sql import functions as F

from siftwatch.operators import dedup, simjoin, textjoin, vectorize
from siftwatch.staging import stage


def bucket(token, width):
    """A token's md5 bucket; without a width, the token itself (the text join keys whole tokens)."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % width if width else token


def tfidf(texts, width):
    docs = [
        Counter(bucket(t, width) for t in regex.split(r"[^\p{L}\p{N}_]+", (x or "").lower()) if t) for x in texts
    ]
    seen = Counter(b for d in docs for b in d)
    columns = {b: i for i, b in enumerate(sorted(seen))}
    m = np.zeros((len(texts), max(1, len(columns))))
    for i, d in enumerate(docs):
        for b, n in d.items():
            m[i, columns[b]] = n * math.log((len(texts) + 1) / (seen[b] + 1))
    return m, columns


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id bigint, description string")


def near_copies(n=150, seed=2):
    """A third exact copies, a third near copies with a word of their own, the rest unrelated, some blank."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(rng.choice(words, 40))
    other = rng.choice(words, 40)
    texts = [base] * (n // 3)
    texts += [" ".join([*other[: 38 + rng.integers(3)], f"own{i}"]) for i in range(n // 3)]
    texts += [" ".join(rng.choice(words[: 60 + i], 25)) for i in range(n - len(texts) - 3)]
    texts += [None, "", " \n\t"]
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("pairs_per_entry", [32, 0.0])
def test_text_duplicates_match_brute_force(spark, pairs_per_entry):
    texts = near_copies()
    m, _ = tfidf(texts, None)
    found = textjoin.find_duplicates(table(spark, texts), pairs_per_entry=pairs_per_entry)
    pairs = [(r.i, r.j) for r in found.pairs.collect()]
    gone = {r.row_id for r in found.removed.collect()}
    assert (gone, set(pairs)) == greedy(cosines(m), dedup.THRESHOLD)
    assert len(pairs) == len(set(pairs))


@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_prefix_filter_loses_no_pair(spark, threshold):
    texts = near_copies(n=90, seed=4)
    sims = cosines(tfidf(texts, None)[0])
    units = textjoin.units_of(table(spark, texts), "description", threshold)
    got = {(r.i, r.j) for r in textjoin.pairs_above(units, threshold).collect()}
    assert got == {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sims[i, j] >= threshold}


def test_long_lists_are_cut_without_loss(spark):
    texts = near_copies(n=60, seed=6)
    units = textjoin.units_of(table(spark, texts), "description", 0.6)
    entries = textjoin.postings(units)
    whole = {(r.i, r.j) for r in textjoin.candidate_pairs(entries, 0.6).collect()}
    cut = {(r.i, r.j) for r in textjoin.candidate_pairs(entries, 0.6, list_rows=4).collect()}
    assert whole == cut and whole


def test_leader_rounds_decide_near_copies_without_pairs(spark):
    shared = " ".join(f"s{i}" for i in range(200))
    texts = [f"{shared} own{i}" for i in range(40)] + [f"x{i} y{i} z{i}" for i in range(40)]
    units = textjoin.units_of(table(spark, texts), "description", 0.7)
    done = textjoin.leader_rounds(units, 0.7, pairs_per_entry=1.0)
    assert done.rounds == 1
    assert {r.row_id for r in done.removed[0].collect()} == set(range(1, 40))
    assert done.entries.count() == 0


def test_words_of_one_old_bucket_stay_apart(spark):
    # tok279 and tok557 share a bucket of 393,216: keyed by 64 bits they are different words
    texts = ["tok279 alpha beta gamma", "tok557 alpha beta gamma", "delta epsilon", "zeta eta"]
    sims = cosines(tfidf(texts, None)[0])
    assert sims[0, 1] < 0.8 < cosines(tfidf(texts, 393216)[0])[0, 1]
    units = textjoin.units_of(table(spark, texts), "description", 0.4)
    got = {(r.i, r.j): r.sim for r in textjoin.pairs_above(units, 0.4).collect()}
    assert set(got) == {(0, 1)} and abs(got[(0, 1)] - sims[0, 1]) < 1e-9


def test_dictionary_joined_by_shuffle_equals_broadcast(spark, monkeypatch):
    texts = near_copies(n=60, seed=8)
    terms = stage(vectorize.keyed_terms(table(spark, texts)))
    words = stage(textjoin.frequencies(terms))
    small = sorted(map(tuple, textjoin.with_frequencies(terms, words).collect()))
    monkeypatch.setattr(textjoin, "BROADCAST_TERMS", 1)
    assert sorted(map(tuple, textjoin.with_frequencies(terms, words).collect())) == small
    assert all(list(r[1]) == sorted(r[1]) for r in small)


def test_long_batches_are_cut_by_elements():
    import pyarrow as pa

    from siftwatch.functions import arrays

    lists = pa.array([[1, 2], [], [3], [4, 5, 6, 7], [8], []], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists], names=["row_id", "b"])
    parts = list(arrays.bounded([batch, batch.slice(0, 0)], "b", most=3))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert len([p for p in parts if p.num_rows]) > 1
    for p in parts:
        row, flat = arrays.ragged(p.column(1))
        assert flat.tolist() == [x for one in p.column(1).to_pylist() for x in one]
        assert len(row) == len(flat)


def test_dense_vectors(spark):
    texts = ["Alpha beta, beta", "gamma_1 Überfall", None, "  "]
    terms = stage(vectorize.term_counts(table(spark, texts)))
    idf = vectorize.fit_idf(terms)
    rows = {r.row_id: np.array(r.embedding) for r in vectorize.dense_vectors(terms, idf).collect()}
    m, columns = tfidf(texts, vectorize.DIM)
    assert idf.n_rows == 4
    assert all(len(v) == 384 for v in rows.values())
    assert not rows[2].any() and not rows[3].any()
    for i in (0, 1):
        expected = np.zeros(384)
        for b, c in columns.items():
            expected[b] = m[i, c] / np.linalg.norm(m[i])
        assert np.allclose(rows[i], expected, atol=1e-6)


def test_embed_text_orders_related_above_unrelated(spark):
    texts = ["ransomware gang encrypted hospital files", "ransomware gang encrypted bank files", "cooking pasta at home"]
    rows = {r.row_id: np.array(r.embedding) for r in vectorize.embed_text(table(spark, texts)).collect()}
    assert 0 <= rows[0] @ rows[2] < rows[0] @ rows[1] <= 1 + 1e-9


def test_user_encoder_sees_no_blank_text_and_loads_once_per_task(spark):
    loads = spark.sparkContext.accumulator(0)

    def encoder():
        loads.add(1)

        def run(texts):
            assert all(t.strip() for t in texts)
            return np.array([[len(t), 1.0] for t in texts])

        return run

    df = table(spark, ["a", None, "", "  ", "abc"]).coalesce(1)
    rows = {r.row_id: r.embedding for r in vectorize.embed_with(df, encoder, 2, batch_size=1).collect()}
    assert rows == {0: [1.0, 1.0], 1: [0.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [3.0, 1.0]}
    assert loads.value == 1


def test_nearest_reference_first_index_wins_and_both_ways_agree(spark):
    refs = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "idx int, embedding array<double>")
    rows = spark.createDataFrame(
        [(0, [3.0, 0.0]), (1, [0.0, 0.0]), (2, [0.1, 5.0])], "row_id bigint, embedding array<double>"
    )
    # Indices 1 and 2 differ in length only, so their similarity differs by the epsilon in the norm.
    even = refs.where("idx < 2").unionByName(refs.where("idx = 1").withColumn("idx", F.lit(2)))
    for kwargs in ({}, {"block_values": 1}, {"block_values": 3}):
        got = {r.row_id: (r.most_similar_idx, r.similarity_score) for r in simjoin.nearest_reference(rows, even, **kwargs).collect()}
        assert got[0][0] == 1 and got[0][1] == pytest.approx(1.0)
        assert got[1] == (0, 0.0)
        assert got[2][0] == 0
    with pytest.raises(ValueError):
        simjoin.nearest_reference(rows, refs.where("idx > 9"))


@pytest.mark.parametrize("rows,roles", [(4096, False), (9, False), (9, True)])
def test_tiles_of_written_blocks_lose_no_pair_and_move_no_meeting(spark, rows, roles):
    from siftwatch.operators import sparsetiles

    texts = near_copies(n=70, seed=9)
    sims = cosines(tfidf(texts, None)[0])
    units = textjoin.units_of(table(spark, texts), "description", 0.5)
    blocks = sparsetiles.write(units, block_rows=rows)
    marks = units.select("row_id", (F.col("row_id") % 3 == 0).alias("first"), (F.col("row_id") % 2 == 0).alias("later")) if roles else None
    found = sparsetiles.pairs(blocks, 0.5, marks)
    got = {(r.i, r.j): r.sim for r in found.collect()}
    wanted = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sims[i, j] >= 0.5}
    assert set(got) == ({(i, j) for i, j in wanted if i % 3 == 0 and j % 2 == 0} if roles else wanted) and got
    assert all(abs(s - sims[p]) < 1e-9 for p, s in got.items())
    # the only shuffle deals out the tiles: no vector and no meeting is in it
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_terms_meet_their_frequencies_without_a_shuffle(spark):
    terms = stage(vectorize.keyed_terms(table(spark, ["a b b", "a c", ""])))
    found = textjoin.with_frequencies(terms, stage(textjoin.frequencies(terms)))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = {r.row_id: sorted(zip(r.tf, r.df)) for r in found.collect()}
    assert rows == {0: [(1, 2), (2, 1)], 1: [(1, 1), (1, 2)]}


def test_rows_of_one_id_are_one_row_with_their_frequencies(spark):
    texts = spark.createDataFrame([(0, "a b"), (0, "a"), (None, "a"), (None, "c"), (1, "b")], "row_id bigint, description string")
    terms = stage(vectorize.keyed_terms(texts))
    found = textjoin.with_frequencies(terms, stage(textjoin.frequencies(terms))).collect()
    assert {r.row_id: sorted(r.df) for r in found} == {0: [2, 3, 3], None: [1, 3], 1: [2]}
    assert len(found) == 3


def test_vectors_are_worked_out_once_and_squares_of_tiles_lose_no_pair(spark, monkeypatch):
    from siftwatch.operators import sparsetiles

    texts = near_copies(n=120, seed=12)
    sims = cosines(tfidf(texts, None)[0])
    units = textjoin.units_of(table(spark, texts), "description", 0.6).repartition(1)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    blocks = sparsetiles.write(units.mapInArrow(counted, units.schema), block_rows=5)
    assert seen.value == blocks.n_rows == units.count() and blocks.n >= blocks.n_rows / 5
    wanted = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sims[i, j] >= 0.6}
    for side, placed in ((1, 8_000_000), (3, 0)):
        monkeypatch.setattr(sparsetiles, "SIDE", side)
        monkeypatch.setattr(sparsetiles, "SORTED", placed)
        found = sparsetiles.pairs(blocks, 0.6).collect()
        assert len(found) == len(wanted) and {(r.i, r.j) for r in found} == wanted
        assert all(abs(r.sim - sims[r.i, r.j]) < 1e-9 for r in found)


def test_chance_meetings_take_no_leader_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], 30, replace=False)) for _ in range(200)]
    taken = []
    monkeypatch.setattr(textjoin, "leader_rounds", lambda *a: taken.append(a))
    found = textjoin.find_duplicates(table(spark, texts), pairs_per_entry=1.0)
    gone, pairs = greedy(cosines(tfidf(texts, None)[0]), dedup.THRESHOLD)
    assert not taken
    assert ({r.row_id for r in found.removed.collect()}, {(r.i, r.j) for r in found.pairs.collect()}) == (gone, pairs)
