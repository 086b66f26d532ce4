import numpy as np
import pytest

from siftwatch.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=2, memory="6g")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def greedy(sims, threshold):
    """Brute-force first-wins on a similarity matrix: removed positions and (survivor, removed) pairs."""
    gone, pairs = set(), set()
    for i in range(len(sims)):
        if i in gone:
            continue
        for j in range(i + 1, len(sims)):
            if sims[i, j] >= threshold:
                gone.add(j)
                pairs.add((i, j))
    return gone, pairs


def cosines(m):
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-8)
    return u @ u.T


def vector_table(spark, m):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "row_id bigint, embedding array<double>")
