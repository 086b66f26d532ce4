"""WARC archives and ring sharding against brute force."""

import gzip
import hashlib
import io
import json
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from siftwatch.llm import queries as Q, ring, warc
from siftwatch.staging import stage, stage_path

BIG = "é" * 600
PAGES = [(1, "u", BIG), (2, "u\r\nX: y", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", BIG), (7, "u", BIG), (None, "u", BIG), (8, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "u", "z" * 1000), (None, "u", "z" * 1000)]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"sha1": F.lit(1), "type": F.lit("t"), "bytes": F.lit("b")})


def test_round_trip(spark):
    got = sorted(((r.id, r.bytes, r.sha1, r.type, r.refers_to) for r in warc.round_trip(pages_of(spark, PAGES)).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = max((j for j, _, x in PAGES if x == h and j is not None), default=None) if len(b) >= 1000 else None
        refers = first if first is not None and first != i else None
        want.append((i and str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", refers and str(refers)))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages_of(spark, [])).count() == 0


def test_files(spark):
    """The crawl is one member per file; the new files have one per record, as the sidecar says."""
    folder = stage_path(spark)
    crawl = stage(warc.write_monolithic(warc.with_originals(pages_of(spark, PAGES)), f"{folder}/crawl"))
    new = stage(warc.normalise(crawl, f"{folder}/records"))
    assert crawl.agg(F.sum("records")).first()[0] == new.agg(F.sum("records")).first()[0] == len(PAGES)
    for file in [r.file for r in new.collect()]:
        old = open(file.replace("/records/", "/crawl/"), "rb").read()
        unpack = zlib.decompressobj(31)
        whole = unpack.decompress(old)
        assert unpack.eof and not unpack.unused_data
        data = open(file, "rb").read()
        assert gzip.decompress(data) == whole
        rows = [json.loads(x) for x in open(file + ".idx")]
        assert [r["offset"] for r in rows] == [0, *[r["offset"] + r["length"] for r in rows[:-1]]]
        for r in rows:
            one = zlib.decompressobj(31)
            text = one.decompress(data[r["offset"] : r["offset"] + r["length"]])
            assert one.eof and not one.unused_data and text.startswith(b"WARC/1.1\r\nWARC-Type: " + r["type"].encode())
    again = stage(warc.normalise(new, f"{folder}/again"))  # members that stand alone already
    assert again.agg(F.sum("bytes")).first()[0] == new.agg(F.sum("bytes")).first()[0]


def test_payloads_and_a_cut_stream(spark):
    folder = stage_path(spark)
    crawl = stage(warc.write_monolithic(warc.with_originals(pages_of(spark, PAGES)), f"{folder}/crawl"))
    stage(warc.normalise(crawl, f"{folder}/records"))
    rows = warc.read_records(warc.read_index(spark, f"{folder}/records")).collect()
    assert Counter(bytes(r.payload).decode() for r in rows if r.type == "response")["small"] == 2
    assert {r.url for r in rows} == {"u", "u%0D%0AX: y", None}
    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    stream = warc.Inflated(io.BytesIO(whole).read)
    stream.head()
    with pytest.raises(ValueError):
        list(stream.take(50))


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = sorted(tuple(r) for r in Q.QUERIES["op1_warc"](spark, sf).collect())
    assert got == sorted(con.execute(Q.ORACLE["op1_warc"]).fetchall())


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string").withColumns({"size": F.lit(1), "shard": F.lit(1), "h": F.lit(1), "rank": F.lit(1)})


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 1000])
def test_even_counts(spark, n):
    docs = docs_of(spark, [(i // 2 if i % 5 else 3, None if i % 7 == 0 else "é" * (i % 3)) for i in range(n)])
    rows = ring.place(docs, 16, rows_per_cell=50).collect()
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and (n < 16 or max(counts.values()) - min(counts[s] for s in range(16)) <= 1)
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_against_one_row_at_a_time(spark):
    """Rows walk the ring one by one: own arcs first, then leftovers clockwise."""
    docs = docs_of(spark, [(i, f"t{i}") for i in range(700)])
    rows = {r.doc_id: r.shard for r in ring.place(docs, 5, virtual_nodes=4, rows_per_cell=37).collect()}
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("row"), "text"), 16).alias("h")).collect()}
    ends, owners = ring.arcs(5, 4)
    arc = {i: sum(e < h for e in ends) % 20 for i, h in hashes.items()}
    room, got = ring.capacities(700, 5), {}
    waiting = sorted(hashes, key=lambda i: (arc[i], hashes[i]))
    step = 0
    while waiting:
        still = []
        for i in waiting:
            s = owners[(arc[i] + step) % 20]
            if room[s]:
                room[s] -= 1
                got[i] = s
            else:
                still.append(i)
        waiting, step = still, step + 1
    assert rows == got


def test_more_shards_move_few_rows(spark):
    docs = docs_of(spark, [(i, "same") for i in range(4000)])
    a, b = ({r.doc_id: r.shard for r in ring.place(docs, k, slack=0.2).collect()} for k in (16, 17))
    moved = sum(a[i] != b[i] for i in a)
    assert moved < 4000 * 0.12
    assert max(Counter(a.values()).values()) <= 300 and len(a) == 4000


def test_cut_streams_raise():
    import io
    import zlib

    import pytest

    from siftwatch.llm.warc import inflated

    def gz(parts, finish=True):
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out = b"".join(pack.compress(p) + pack.flush(zlib.Z_FULL_FLUSH) for p in parts)
        return out + (pack.flush() if finish else b"")

    whole = gz([b"record one\r\n\r\n", b"record two\r\n\r\n"])
    two_members = whole + gz([b"third\r\n"])
    assert b"".join(inflated(io.BytesIO(two_members).read)) == b"record one\r\n\r\nrecord two\r\n\r\nthird\r\n"
    assert b"".join(inflated(io.BytesIO(b"").read)) == b""
    no_trailer = gz([b"record one\r\n\r\n", b"record two\r\n\r\n"], finish=False)
    cut = gz([b"record one\r\n\r\n"], finish=False)  # ends at a flush point after the first record
    for broken in (no_trailer, cut, whole[:-4]):
        with pytest.raises(ValueError):
            b"".join(inflated(io.BytesIO(broken).read))
