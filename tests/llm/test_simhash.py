"""SimHash fingerprints and their components against a brute-force version of the contract."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from siftwatch.llm import simhash

AZ = {c: c + 32 for c in range(65, 91)}


def brute_fp(text):
    words = (text or "").translate(AZ).encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hs) > len(hs))


def brute(rows):
    fps = {d: brute_fp(t) for d, t in rows}
    ids = sorted(fps)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: (f"{fps[d]:016x}", find(d)) for d in ids}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = result(simhash.grouped(docs))
    assert got == want
    assert any(c != d for d, (_, c) in got.items())  # some near copies are there


def planted_rows(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 400))]
        for copy in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(copy):  # one word changed per copy: near copies
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((d, " ".join(w)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \t\n "), (d + 3, "One"), (d + 4, "one TWO"), (d + 5, "x " * 30000)]
    rows += [(d + 6, "one two three four"), (d + 6, "one two three four")]  # a repeated row
    return rows


def test_planted_and_odd_rows(spark):
    rows = planted_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(1))
    got = simhash.grouped(df)
    assert got.count() == len(rows)
    want = brute(sorted(set(rows)))
    assert result(got) == want
    blank = [d for d, t in rows if not (t or "").split()]
    assert {want[d][0] for d in blank} == {"0" * 16} and len({want[d][1] for d in blank}) == 1


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.grouped(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(simhash.grouped(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.fingerprint))
    assert got[0].doc_id == 4 and got[0].component_id == 4
    assert [r.component_id for r in got[1:]] == [None, None]
    assert {r.fingerprint for r in got} == {f"{brute_fp('a b c d'):016x}", "0" * 16}


def test_variants_meet_within_radius():
    assert simhash.variants_of(0) == "array(fp)"
    with pytest.raises(ValueError):
        simhash.variants_of(3)
