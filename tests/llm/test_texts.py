"""Tokenizer operators against the libraries, decontamination against brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from siftwatch.llm import byte_pairs, contamination as con, crc32c, token_records
from siftwatch.staging import stage, stage_path

ODD = ["", " ", "a", "it's  two\n\n spaces \t tab ", "ＡＢ é́ ß日本語  x", "x\x1cy \x1f z\u0085 q", "12345 678", "!!!??? ...", "<|endoftext|> a", "a" * 3000, " lead", "trail ", "I'll they're  'S 's", "\n\n\n", "naïve café — “quotes”"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [*ODD, None, "word " * 20, "word " * 20]


def docs_of(spark, texts):
    rows = [(i, t, "x", 1, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, start int, decoded string")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_pairs_equal_the_library(tik, text):
    own = byte_pairs.coder(RANKS, public_tokenizers.PATTERN)
    got = own.encode([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == tik.encode_ordinary(text)
    assert own.decode(got) == text.encode()


def test_byte_pairs_on_documents(spark, sf, tik):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in byte_pairs.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for d in docs.collect():
        ids = np.array(tik.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_byte_pairs_odd_texts(spark, tik):
    got = byte_pairs.encode(docs_of(spark, TEXTS), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: tik.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    assert byte_pairs.digests(docs_of(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_crc32c():
    assert crc32c.crc32c(b"123456789") == 0xE3069283
    assert crc32c.crc32c(bytes(32)) == 0x8A9136AA
    assert crc32c.crc32c(b"") == 0
    data = bytes(range(256)) * 5
    slow = 0xFFFFFFFF
    for b in data[3:]:
        slow = slow ^ b
        for _ in range(8):
            slow = slow >> 1 ^ (0x82F63B78 if slow & 1 else 0)
    assert crc32c.crc32c(data[3:]) == slow ^ 0xFFFFFFFF


def test_token_records(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    rows = {r.doc_id: r for r in token_records.round_trip(docs_of(spark, TEXTS), BPE).collect()}
    start = 0
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        assert (rows[i].start, rows[i].n_tokens) == (start, len(ids)), t
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == ids, t
        start += len(ids)
    assert token_records.round_trip(docs_of(spark, []), BPE).count() == 0


def test_different_pieces_go_to_the_model_once():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = True
    own = token_records.Encoder(BPE)
    met: list[str] = []

    class Model:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **options):
            met.extend(p for t in texts for p in t.split("\n"))
            return self.inner.encode_batch_fast(texts, **options)

    own.merges = Model(own.merges)
    plain = ["a word, word. word: word\n\nword", "the word, and words; Σας, ёж! x½"]
    texts = [*plain, "x  a  b 日本 c't it's 'll", "½ ² x½ ª aªb ϐ a\x85b \x1c z", "\0 a\0b c", *ODD]
    for some in (texts, [" ".join(texts)] * 3, plain):
        met.clear()
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(some)] == want
    assert "Ġword" in met and len(met) == len(set(met))


def test_other_tokenizers_and_ties(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    docs = spark.createDataFrame([(1, "Two  words"), (1, "Other"), (None, "none"), (1, "Other")], "doc_id int, text string")
    rows = token_records.round_trip(docs, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 1]
    want = sorted([library.encode(t, add_special_tokens=False).ids + [0] for t in ("Two  words", "Other", "Other")])
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in rows[1:]) == want


def test_shuffled_read_and_a_broken_record(spark):
    folder = stage_path(spark)
    index = stage(token_records.write(docs_of(spark, TEXTS), folder, BPE))
    whole = {r.doc_id: bytes(r.ids) for r in token_records.read(index, ["doc_id"]).collect()}
    mixed = token_records.read(index.orderBy((index.doc_id * 7919) % 13), ["doc_id"]).collect()
    assert {r.doc_id: bytes(r.ids) for r in mixed} == whole
    record = bytearray(token_records.framed(b"payload"))
    record[14] ^= 1
    with pytest.raises(ValueError):
        token_records.unframed(bytes(record))
    assert zlib.crc32(token_records.unframed(token_records.framed(b""))) == 0


def brute(text, items, window=10):
    words = con.words_of((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        own = con.words_of((t or "").encode())
        size = min(window, len(own))
        for a in range(len(own) - size + 1) if size else ():
            for b in range(len(words) - size + 1):
                if words[b : b + size] == own[a : a + size]:
                    hit.update(range(b, b + size))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "a b c"), (2, "A b a b a b a b a b a b c"), (10, None), (11, "?!"), (12, "x y z x y z x y z x y z"), (3, "b"), (4, "c c"), (5, "a b c"), (None, "d")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), max_size=4), st.lists(st.sampled_from("abc"), max_size=40))
def test_suffix_automaton(items, words):
    named = [(str(i), [w.encode() for w in x]) for i, x in enumerate(items) if x]
    mask, found = con.SuffixAutomaton(named, 4).hits([w.encode() for w in words])
    n, hit, n_items, _, _ = brute(" ".join(words), [(i, " ".join(x)) for i, x in enumerate(items)], 4)
    assert (sum(mask or b""), len(found)) == (hit, n_items)


@pytest.mark.parametrize("block_words", [5, 1000])
def test_report(spark, block_words):
    texts = ["a b c", "q A-B.c q", "x y z x y z x y z x", None, "", "!!", "b " * 500, "ab bc", "c c c d", "a b a b a b a b a b a b"]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in con.report(docs, bench, block_words=block_words).collect()}
    assert got == {i: brute(t, [x for x in ITEMS if x[0] is not None]) for i, t in enumerate(texts)}
    assert con.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_report_on_documents(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in con.report(docs, bench).collect()}
    rows = docs.where("length(text) < 4000").collect()
    assert any(got[r.doc_id][-1] for r in rows)
    for r in rows[:60]:
        assert got[r.doc_id] == brute(r.text, items)


def test_decontaminate(spark):
    long = " ".join(f"w{i}" for i in range(100))
    leak = " ".join(f"z{i}" for i in range(12))
    rows = [(1, long), (2, f"{long}, {leak}! {long}"), (3, leak), (4, None), (5, ""), (6, f"{long} z0 z1 {leak} z2 z3 z4 {long}")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id int, text string, spans int")
    bench = spark.createDataFrame([(1, leak)], "item_id int, text string")
    got = {r.doc_id: r.text for r in con.decontaminate(docs, bench).collect()}
    assert got[1] == long and got[4] is None and got[5] == "" and 3 not in got
    assert got[2] == f"{long}, ! {long}"
    assert "z11" not in got[6] and got[6].startswith(long)
