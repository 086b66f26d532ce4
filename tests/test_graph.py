"""Components by large-star / small-star rounds, and first-wins decided per component."""

import random

import pandas as pd
import pytest

from siftwatch.operators import dedup, graph


def brute_first_wins(edges, undecided=()):
    state = {}
    for j in sorted({j for _, j in edges}):
        smaller = [state.get(i, 2 if i in undecided else 1) for i, jj in edges if jj == j]
        state[j] = 0 if 1 in smaller else 2 if (j in undecided or 2 in smaller) else 1
    return {r for r, s in state.items() if s == 0}


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {v: find(v) for v in list(root)}


def frame(spark, edges):
    return spark.createDataFrame(edges, "i bigint, j bigint")


def test_chain_of_ten_thousand_in_few_rounds(spark):
    edges = [(k, k + 1) for k in range(10_000)]
    labels, rounds = graph.components(frame(spark, edges))
    assert rounds <= 20
    assert {r.root for r in labels.collect()} == {0} and labels.count() == 10_001
    got = {r.row_id for r in graph.first_wins(frame(spark, edges)).collect()}
    assert got == set(range(1, 10_001, 2))


@pytest.mark.parametrize("local_edges", [graph.LOCAL_EDGES, 3])
def test_random_graphs_against_brute_force(spark, local_edges):
    rng = random.Random(7)
    edges = set()
    for _ in range(300):
        a, b = rng.randrange(200), rng.randrange(200)
        if a != b:
            edges.add((min(a, b), max(a, b)))
    edges |= {(1000 + k, 1001 + k) for k in range(30)} | {(2000, 2001 + k) for k in range(40)}  # chain and hub
    edges = sorted(edges)
    labels, _ = graph.components(frame(spark, edges))
    assert {r.v: r.root for r in labels.collect()} == brute_components(edges)
    undecided = {5, 17, 1003}
    cut = spark.createDataFrame([(x,) for x in undecided], "row_id bigint")
    for held in (set(), undecided):
        got = graph.first_wins(frame(spark, edges), cut if held else None, local_edges=local_edges, fallback=dedup.resolve)
        assert {r.row_id for r in got.collect()} == brute_first_wins(edges, held)


def test_local_pass_and_empty_graph(spark):
    e = pd.DataFrame({"i": [1, 1, 2, 3], "j": [2, 3, 4, 4]})
    assert sorted(graph.first_wins_local(e)) == [2, 3]
    assert sorted(graph.first_wins_local(e, {1})) == []
    assert graph.first_wins(frame(spark, [])).count() == 0


def test_resolve_hands_long_chains_to_components(spark):
    edges = [(k, k + 1) for k in range(3_000)] + [(5000, 5001), (5000, 5002)]
    got = {r.row_id for r in dedup.resolve(frame(spark, edges), max_rounds=2).collect()}
    assert got == set(range(1, 3_001, 2)) | {5001, 5002}
    cut = spark.createDataFrame([(2,)], "row_id bigint")
    held = {r.row_id for r in dedup.resolve(frame(spark, edges), cut, max_rounds=2).collect()}
    assert held == brute_first_wins(edges, {2})
