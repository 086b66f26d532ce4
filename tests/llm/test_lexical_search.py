"""Ranked lexical search against a brute-force scoring of every document, and the SQL of its query."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from siftwatch.llm import lexical_search as ls
from siftwatch.llm.queries import ORACLE

AZ = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(AZ))


def brute(docs, items, top=10):
    tf = {}
    for d, t in docs:
        if d is not None:
            tf.setdefault(d, Counter()).update(terms(t))
    big_n = sum(1 for c in tf.values() if c)
    big_l = sum(sum(c.values()) for c in tf.values())
    df = Counter(t for c in tf.values() for t in c)
    out = {}
    for item, text in items:
        scores = []
        for d, c in tf.items():
            if not c:
                continue
            m = 25 + (75 * sum(c.values()) * big_n) // big_l
            s = 0
            for t in terms(text):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, d))
        out.setdefault(item, []).extend(sorted(scores)[:top])
    return {(i, k + 1, d, -s) for i, rows in out.items() for k, (s, d) in enumerate(rows)}


def got(df):
    return {(r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()}


def test_against_brute_force_and_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    result = got(ls.ranked(docs, items))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result == want and len(result) > 10
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    assert set(con.execute(ORACLE["op11_lexical_search"]).fetchall()) == want


def test_small_shards_ties_and_odd_rows(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"t{i}" for i in range(60)] + ["Über", "naïve", "x9"]
    docs = [(d, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80)))) for d in range(300)]
    docs += [(300, None), (301, ""), (302, "!!! ..."), (303, docs[0][1]), (304, docs[0][1]), (None, "t1 t2"), (305, "t3 " * 20000)]
    docs += [(306, "t4 T4 t5"), (306, "t4 t6")]  # one id in two rows: one document
    items = [(1, "t1 t2 t2"), (2, "t3"), (3, "nothing here"), (4, None), (5, docs[0][1]), (None, "t4"), (6, "über NAÏVE x9"), (7, "t7")]
    monkeypatch.setattr(ls, "DOCS_PER_SHARD", 37)
    monkeypatch.setattr(ls, "QUERIES_PER_BLOCK", 3)
    monkeypatch.setattr(ls, "LEAF", 4)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("w", F.lit(2))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("q", F.lit(1)).withColumn("score", F.lit(0))
    result = got(ls.ranked(d, i))
    assert result == brute(docs, items)
    assert {r[0] for r in result} == {1, 2, 5, None, 6, 7}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ls.ranked(empty, i).count() == 0 and ls.ranked(d, empty.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(1)
    n, t = 500, 40
    dense = (rng.random((n, t)) < 0.15) * rng.integers(1, 10**6, (n, t))
    rows, cols = np.nonzero(dense)
    tree = ls.BallTree(rows, cols, dense[rows, cols], n, t, leaf=8)
    ids = np.arange(n) * 3
    for _ in range(20):
        qc = rng.choice(t, 5, replace=False)
        qv = rng.integers(1, 30000, 5)
        scores = dense[:, qc] @ qv
        want = sorted(((-int(s), int(ids[k])) for k, s in enumerate(scores) if s > 0))[:10]
        assert tree.best(qc, qv, ids) == [(-s, d) for s, d in want]
