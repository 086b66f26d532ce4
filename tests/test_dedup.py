import numpy as np
import pytest
from conftest import cosines, greedy, vector_table
from pyspark.sql import functions as F

from siftwatch.operators import dedup, simjoin
from siftwatch.staging import stage


def result(found):
    pairs = [(r.i, r.j) for r in found.pairs.collect()]
    assert len(pairs) == len(set(pairs))
    return {r.row_id for r in found.removed.collect()}, set(pairs)


def angle(degrees):
    r = np.radians(degrees)
    return [np.cos(r), np.sin(r)]


def test_chain_keeps_both_ends(spark):
    m = np.array([angle(0), angle(30), angle(60)])  # neighbours match, the ends do not
    assert result(dedup.find_duplicates(vector_table(spark, m), threshold=0.85)) == ({1}, {(0, 1)})


def test_row_with_two_surviving_neighbours_is_reported_twice_and_counted_once(spark):
    m = np.array([angle(0), angle(60), angle(30)])
    df = vector_table(spark, m)
    found = dedup.find_duplicates(df, threshold=0.85)
    assert result(found) == ({2}, {(0, 2), (1, 2)})
    row = dedup.dedup_summary(df, found.removed).first()
    assert (row.original, row.removed, row.unique_rows) == (3, 1, 2)
    assert row.rate_percent == pytest.approx(100 / 3)


def test_blank_rows_are_not_duplicates(spark):
    m = np.concatenate([np.zeros((3, 4)), np.eye(4)])  # nor are rows at right angles
    assert result(dedup.find_duplicates(vector_table(spark, m))) == (set(), set())


def test_similarity_at_the_threshold_counts(spark):
    m = np.array([[1.0, 0.0], [0.6, 0.8]])
    sim = float(cosines(m)[0, 1])
    df = vector_table(spark, m)
    assert result(dedup.find_duplicates(df, threshold=sim))[0] == {1}
    assert result(dedup.find_duplicates(df, threshold=np.nextafter(sim, 1)))[0] == set()


@pytest.mark.parametrize("bad", [0.0, -1.0, 1.5])
def test_threshold_is_checked(spark, bad):
    with pytest.raises(ValueError):
        dedup.find_duplicates(vector_table(spark, np.eye(2)), threshold=bad)


def noisy_groups(seed=3, n=160):
    """A third of the rows are exact copies of one vector, a third near copies of another, the rest mixed."""
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(2, 12))
    rows = [a] * (n // 3) + [b + rng.normal(size=12) * 0.15 for _ in range(n // 3)]
    base = rng.normal(size=(10, 12))
    rows += [base[rng.integers(10)] + rng.normal(size=12) * 0.5 for _ in range(n - len(rows) - 2)] + [np.zeros(12)] * 2
    return np.array(rows)[rng.permutation(n)]


@pytest.mark.parametrize("neighbours,block_rows", [(64, 2048), (2, 40)])
def test_matches_brute_force_with_hot_groups(spark, neighbours, block_rows):
    m = noisy_groups()
    found = dedup.find_duplicates(vector_table(spark, m), neighbours=neighbours, block_rows=block_rows)
    assert result(found) == greedy(cosines(m), 0.85)


def test_result_does_not_depend_on_partitioning_and_keeps_its_promise(spark):
    m = noisy_groups(seed=8, n=90)
    sims = cosines(m)
    gone, pairs = result(dedup.find_duplicates(vector_table(spark, m).coalesce(1)))
    assert (gone, pairs) == result(dedup.find_duplicates(vector_table(spark, m).repartition(7)))
    alive = sorted(set(range(len(m))) - gone)
    assert all(sims[i, j] < 0.85 for i in alive for j in alive if i < j)
    assert all(any(sims[i, j] >= 0.85 for i in alive if i < j) for j in gone)


@pytest.mark.parametrize("pivots,block_rows", [(1, 2048), (6, 25)])
def test_pruned_tiles_lose_no_pair(spark, pivots, block_rows):
    m = noisy_groups(seed=11, n=120)
    units = stage(simjoin.unit_vectors(vector_table(spark, m)))
    got = {(r.i, r.j) for r in simjoin.pairs_above(units, 0.7, pivots, block_rows).collect()}
    sims = cosines(m)
    assert got == {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if sims[i, j] >= 0.7}


def test_similarity_pairs_are_symmetric_with_unit_diagonal(spark):
    m = np.array([angle(0), angle(10), [0.0, 0.0]])
    units = stage(simjoin.unit_vectors(vector_table(spark, m)))
    got = {(r.i, r.j): r.sim for r in simjoin.similarity_pairs(units, 0.5).collect()}
    assert set(got) == {(0, 0), (1, 1), (0, 1), (1, 0)}
    assert got[0, 1] == got[1, 0]
    assert got[0, 0] == pytest.approx(1.0, abs=1e-5)


def test_whole_similarity_matrix_has_every_pair(spark, monkeypatch):
    m = np.vstack([np.random.default_rng(3).normal(size=(23, 5)), np.zeros((1, 5))])
    monkeypatch.setattr(simjoin, "BATCH_VALUES", 20)
    units = stage(simjoin.unit_vectors(vector_table(spark, m)))
    sims = cosines(m)
    for block_rows in (2048, 7):
        rows = simjoin.similarity_pairs(units, block_rows=block_rows).collect()
        assert len(rows) == 24 * 24 and min(r.sim for r in rows) < -0.5
        assert {(r.i, r.j) for r in rows} == {(i, j) for i in range(24) for j in range(24)}
        assert all(abs(r.sim - sims[r.i, r.j]) < 1e-9 for r in rows)


@pytest.mark.parametrize("rows_per_salt", [3, 1_000_000])
def test_resolve_with_and_without_salted_hot_rows(spark, rows_per_salt):
    rng = np.random.default_rng(1)
    pairs = {(0, j) for j in range(1, 40)} | {tuple(sorted(p)) for p in rng.integers(0, 80, (120, 2)).tolist() if p[0] != p[1]}
    sims = np.zeros((80, 80))
    for i, j in pairs:
        sims[i, j] = 1.0
    edges = stage(spark.createDataFrame(sorted(pairs), "i bigint, j bigint"))
    got = {r.row_id for r in dedup.resolve(edges, rows_per_salt=rows_per_salt).collect()}
    assert got == greedy(sims, 0.5)[0]


def test_report_and_samples(spark):
    m = np.array([angle(0), angle(5), angle(90), angle(95), angle(3)])
    df = vector_table(spark, m).withColumn("name", F.format_string("%060d", "row_id"))
    report = dedup.duplicate_report(dedup.find_duplicates(df).pairs, df)
    rows = [(r.original_idx, r.duplicate_idx) for r in report.collect()]
    assert rows == [(0, 1), (0, 4), (2, 3)]
    assert all(len(r.original_name) == 50 for r in report.collect())
    assert [(r.original_idx, r.duplicate_idx) for r in dedup.duplicate_samples(report, 2).collect()] == rows[:2]


def test_clean_renumbers_on_request(spark):
    df = spark.createDataFrame([(i * 10, str(i)) for i in range(6)], "row_id bigint, v string")
    removed = spark.createDataFrame([(10,), (40,)], "row_id bigint")
    assert [r.v for r in dedup.clean(df, removed).orderBy("row_id").collect()] == ["0", "2", "3", "5"]
    again = dedup.clean(df, removed, renumber_rows=True).orderBy("row_id").collect()
    assert [(r.row_id, r.v) for r in again] == [(0, "0"), (1, "2"), (2, "3"), (3, "5")]


def test_regions_stay_bounded_at_any_threshold(spark):
    m = np.random.default_rng(5).normal(size=(3000, 6))
    m[1500:1600] = m[:100]
    units = simjoin.unit_vectors(vector_table(spark, m))
    for threshold in (0.9, 0.999, 1.0):
        regions = simjoin._regions(units, threshold, 4, 512)
        n = regions.rows.select("region").distinct().count()
        assert n <= 4 * (simjoin.MAX_RINGS + 2) and len(regions.links) <= n * (n + 1) / 2


@pytest.mark.parametrize("part_rows", [20, 60])
def test_parts_decided_one_after_the_other_match_brute_force(spark, monkeypatch, part_rows):
    m = noisy_groups(seed=21, n=130)
    formed = []
    whole = simjoin.first_neighbours
    monkeypatch.setattr(simjoin, "first_neighbours", lambda live, *a: formed.append(live.count()) or whole(live, *a))
    found = dedup.find_duplicates(vector_table(spark, m), part_rows=part_rows, block_rows=40)
    assert result(found) == greedy(cosines(m), 0.85)
    # rows that an earlier part's survivors removed never meet each other
    assert len(formed) > 1 and sum(formed) < len(m)
