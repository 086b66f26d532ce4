"""Cross-tokenizer alignment against a plain walk over the libraries' own tokens."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwatch.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def library_tokens(texts):
    from tokenizers import Tokenizer
    import sentencepiece

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    s = al.Sides(A, B)
    out = []
    for t in texts:
        if not t:
            out.append(([], []))
            continue
        ai, bi = a.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
        whole = (" " + t).encode()
        if b"".join(s.a_bytes[i] for i in ai) != whole or b"".join(s.b_bytes[i] for i in bi) != whole:
            ai, bi = [], []
        out.append((ai, bi, [len(s.a_bytes[i]) for i in ai], [len(s.b_bytes[i]) for i in bi]))
    return out


def brute(texts):
    docs = []
    for tok in library_tokens(texts):
        if not tok[0]:
            docs.append(([], "", 0, 0))
            continue
        ai, bi, al_, bl = tok
        ae, be = list(np.cumsum(al_)), list(np.cumsum(bl))
        links = []
        for x, (s, e) in enumerate(zip([0] + ae[:-1], ae)):  # B tokens overlapping [s, e)
            y = bisect.bisect_right(be, s)
            while y < len(bi) and (be[y - 1] if y else 0) < e:
                links.append((ai[x], bi[y]))
                y += 1
        common = sorted(set(ae) & set(be))
        groups, pa_, pb_ = [], 0, 0
        for c in common:
            x, y = ae.index(c) + 1, be.index(c) + 1
            groups.append(",".join(map(str, ai[pa_:x])) + "|" + ",".join(map(str, bi[pb_:y])))
            pa_, pb_ = x, y
        docs.append((links, ";".join(groups), len(ai), len(bi)))
    count = Counter(l for d in docs for l in d[0])
    top = Counter()
    for (a, b), c in count.items():
        top[b] = max(top[b], c)
    out = []
    for links, g, na, nb in docs:
        out.append((na, nb, g.count(";") + 1 if g else 0, len(links), sum(count[l] == top[l[1]] for l in links), sum(count[l] for l in links), hashlib.sha256(g.encode()).hexdigest() if g else ""))
    return out


def test_against_plain_walk(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    extra = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a <|endoftext|> b  c\n\n\td"), (10**6 + 3, "ﬁ ligature ½"), (10**6 + 4, rows[0].text), (None, "x y")]
    all_rows = [(r.doc_id, r.text) for r in rows] + extra
    df = spark.createDataFrame(all_rows, "doc_id long, text string").withColumn("pairs", F.lit(1)).withColumn("row", F.lit("r"))
    got = {(r.doc_id, r.groups_sha256): r for r in al.report(df, A, B).collect()}
    want = brute([t for _, t in all_rows])
    assert len(got) == len(all_rows)
    for (d, _), w in zip(all_rows, want):
        r = got[(d, w[6])]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w
    assert got[(10**6, "")].n_links == 0 and got[(10**6 + 1, "")].n_a == 0


def test_walk_in_lockstep():
    a = [np.array([2, 5, 9]), np.array([1]), np.array([], np.int64), np.array([4, 8])]
    b = [np.array([1, 5, 6, 9]), np.array([1]), np.array([], np.int64), np.array([8])]
    l_doc, l_a, l_b, cuts, _ = al.walk(a, b)
    links = sorted(zip(l_doc.tolist(), l_a.tolist(), l_b.tolist()))
    assert links == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 2, 2), (0, 2, 3), (1, 0, 0), (3, 0, 0), (3, 1, 0)]
    assert sorted(zip(*cuts.tolist())) == [(0, 1, 1), (0, 2, 3), (1, 0, 0), (3, 1, 0)]
    assert al.groups_text(np.array([7, 8, 9]), np.array([1, 2, 3, 4]), np.array([1, 2]), np.array([1, 3])) == "7,8|1,2;9|3,4"


def test_empty_table(spark):
    assert al.report(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_byte_alphabet_is_a_bijection():
    alpha = al.byte_alphabet()
    assert sorted(alpha.values()) == list(range(256)) and alpha["Ġ"] == 32 and alpha["!"] == 33


def test_batches_are_cut_by_count_and_characters(monkeypatch):
    monkeypatch.setattr(al, "BATCH", 3)
    monkeypatch.setattr(al, "BATCH_CHARS", 10)
    texts = ["abcd", None, "abcdefghijkl", "a", "b", "c", "d", ""]
    assert al.spans(texts) == [(0, 2), (2, 3), (3, 6), (6, 8)]
    assert al.spans([]) == []


def test_pairs_meet_their_counts_in_shards_without_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(0, [(1, 2, 3), (5, 2, 1)]), (1, []), (2, [(5, 2, 2)])], "row long, pairs array<struct<a:int,b:int,k:long>>"
    )
    pair = [(1 << al.ID_BITS) + 2, (5 << al.ID_BITS) + 2]
    table = spark.createDataFrame([(pair[0], 3, 1), (pair[1], 3, 1), (7, 9, 0)], "pair long, count long, best long")
    monkeypatch.setattr(al, "SHARD_PAIRS", 1)
    found = al.link_sums(rows, table)
    assert sorted(map(tuple, found.collect())) == [(0, 4, 12), (1, 0, 0), (2, 2, 6)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_parts_give_what_whole_texts_give_and_are_aligned_once(monkeypatch):
    texts = ["the cat sat. The  cat\n sat", "the cat sat", "", None, " the cat", "the cat ", "a▁ b", " x y\t z", "café 日本 the the", "\n", " "] * 3
    whole, parts = al.Sides(A, B), al.Sides(A, B)
    assert parts.cuts
    whole.cuts = False
    encoded, own = [], parts.tokens
    monkeypatch.setattr(parts, "tokens", lambda p: encoded.extend(p) or own(p))
    for most in (250_000, 6):
        monkeypatch.setattr(al, "MEMO_PARTS", most)
        for _ in range(3):
            want, got = al.align_batch(whole, texts, True), al.align_batch(parts, texts, True)
            assert all(np.array_equal(want[c], got[c]) for c in want)
        if most > 6:
            assert len(encoded) == len(set(encoded)) and encoded.count("cat") == 1
    assert [r[:4] for r in brute(texts)] == list(zip(*(got[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links"))))
    assert [r[6] for r in brute(texts)] == got["groups_sha256"]
