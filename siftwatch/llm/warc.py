"""WARC archives: writing them, normalising whole-file gzip streams, and reading records by offset.

* ``write_monolithic`` writes one gzip stream per partition, the form that only a reader from the start can use.
* ``normalise`` inflates each such stream once, rewrites every record as a gzip member of its own and writes a sidecar
  index (JSON lines: offset, length, type, block length) beside the new file. It streams: a task holds one block of
  bytes whatever the size of a record. Members that already stand alone are read the same way.
* ``read_records`` reads members straight from their offsets, so that one large file is spread over many tasks.

Records of equal payloads of at least ``least`` bytes are stored once: the one with the largest id is the response,
the others are revisits whose block keeps the HTTP head, and so the payload's length. Rows that repeat the largest id
are all responses; null ids count as smallest, and where a group has no other id all its rows are responses. A null
payload is empty; a null URL is left out. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwatch.llm import files
from siftwatch.staging import stage, stage_path

LEAST = 1000
#: Bytes inflated at once.
CHUNK = 1 << 20
LEVEL = 6
SIDECAR = ".idx"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
GZIP = 31

INDEX = "file string, offset long, length long, type string, block long"


def with_originals(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, payload (binary), its SHA-1 and length, and ``refers_to``: the id of the record that holds an equal
    payload, null for that record itself and for payloads with no other copy."""
    payload = F.coalesce(F.encode(payload_col, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")}
    )
    # One row per payload that several records share; the payloads themselves are shuffled only where that table
    # is too large to broadcast, and then as a join whose hot keys adaptive execution splits.
    shared = rows.where(F.col("bytes") >= least).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(shared, "sha1", "left").withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record_id(page, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{sha1}')}>"


def record(row: dict) -> tuple[bytes, bytes]:
    """Head and block of a row's record."""
    http = HTTP.format(row["bytes"]).encode()
    revisit = row["refers_to"] is not None
    block = http if revisit else http + row["payload"]
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(row["id"], row["sha1"])),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", row["url"].replace("\r", "%0D").replace("\n", "%0A"))] if row["url"] is not None else []),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()),
        *([("X-Page-ID", row["id"])] if row["id"] is not None else []),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["refers_to"], row["sha1"])), ("X-Refers-To-Page-ID", row["refers_to"])] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    return head, block


def write_monolithic(originals: DataFrame, folder: str) -> DataFrame:
    """One whole-file gzip stream per partition with rows; the table of files and their record counts."""

    def run(batches):
        name, n = f"{folder}/crawl-{TaskContext.get().partitionId():06d}.warc.gz", 0
        rows = (row for b in batches for i in range(0, b.num_rows, 64) for row in b.slice(i, 64).to_pylist())
        first = next(rows, None)
        if first is None:
            return
        with files.writing(name) as out:
            pack = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            for row in (r for part in ([first], rows) for r in part):
                for piece in (*record(row), b"\r\n\r\n"):
                    out.write(pack.compress(piece))
                n += 1
            out.write(pack.flush())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return originals.mapInArrow(run, "file string, records long")


def inflated(read):
    """Blocks of what a gzip file holds, be it one member or many. A stream that ends inside a member (cut between two
    records at a flush point, or without its trailer) raises ``ValueError``: records are never lost silently."""
    unpack, data, started = zlib.decompressobj(GZIP), b"", False
    while data or (data := read(CHUNK)):
        started = True
        yield unpack.decompress(data, CHUNK)
        data = unpack.unconsumed_tail
        if unpack.eof:
            data = unpack.unused_data
            unpack, started = zlib.decompressobj(GZIP), False
    if rest := unpack.flush():
        yield rest
    if started and not unpack.eof:
        raise ValueError("the gzip stream ends inside a member: the file was cut")


class Inflated:
    """Reads of an inflated stream: up to a blank line, or a number of bytes in blocks."""

    def __init__(self, read):
        self.blocks, self.held = inflated(read), bytearray()

    def more(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held += block
        return True

    def head(self) -> bytes | None:
        """The lines of the next head without the blank one; None at the end of the stream."""
        while True:
            while self.held[:2] == b"\r\n":
                del self.held[:2]
            end = self.held.find(b"\r\n\r\n")
            if end > 0:
                head = bytes(self.held[:end])
                del self.held[: end + 4]
                return head
            if not self.more():
                if self.held.strip():
                    raise ValueError("the stream ends within a record's head")
                return None

    def take(self, n: int):
        while n:
            if not self.held and not self.more():
                raise ValueError("the stream ends within a record")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            if piece:
                yield piece


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def member(head: bytes, body):
    """The pieces of one gzip member that holds a record."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
    yield pack.compress(head + b"\r\n\r\n")
    for piece in body:
        yield pack.compress(piece)
    yield pack.compress(b"\r\n\r\n") + pack.flush()


def rewrite(source: str, target: str):
    """Stream one file into ``target`` with a member per record, its index beside it; yields the index rows."""
    with files.reading(source) as file, files.writing(target) as out, files.writing(target + SIDECAR) as sidecar:
        stream, offset = Inflated(file.read), 0
        while (head := stream.head()) is not None:
            fields, length = fields_of(head), 0
            size = int(fields["content-length"])
            for piece in member(head, stream.take(size)):
                out.write(piece)
                length += len(piece)
            row = {"file": target, "offset": offset, "length": length, "type": fields.get("warc-type"), "block": size}
            sidecar.write((json.dumps(row) + "\n").encode())
            offset += length
            yield row


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Each file named in ``archives`` (column ``file``) rewritten below ``folder``, with its sidecar; returns the new
    files, their records and bytes. A gzip stream can't be entered midway, so one file is one task's work."""

    def run(batches):
        for b in batches:
            for source in b.column(0).to_pylist():
                target, n, size = f"{folder}/{source.rpartition('/')[2]}", 0, 0
                for row in rewrite(source, target):
                    n, size = n + 1, row["offset"] + row["length"]
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return archives.select("file").mapInArrow(run, "file string, records long, bytes long")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a normalised folder."""
    return spark.read.schema(INDEX).json(f"{folder}/*{SIDECAR}")


def parsed(blob: bytes) -> dict:
    """A record's fields and payload from its gzip member; a response is held against its digest."""
    data = zlib.decompress(blob, GZIP)
    end = data.index(b"\r\n\r\n")
    fields = fields_of(data[:end])
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != sha1):
        raise ValueError(f"record {fields['warc-record-id']} does not match its digest")
    return {
        "id": fields.get("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "type": fields["warc-type"],
        "refers_to": fields.get("x-refers-to-page-id"),
        "bytes": length,
        "sha1": sha1,
        "payload": payload if fields["warc-type"] == "response" else None,
    }


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the rows of ``index`` point at; without payloads if none are wanted, after their check."""
    columns = {"id": pa.string(), "url": pa.string(), "type": pa.string(), "refers_to": pa.string(), "bytes": pa.int64(), "sha1": pa.string()} | ({"payload": pa.binary()} if payloads else {})
    schema = pa.schema(list(columns.items()))

    def run(batches):
        ranges = files.Ranges()
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                places = batch.slice(i, 64).to_pylist()
                rows = [parsed(ranges.read(x["file"], x["offset"], x["length"])) for x in places]
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], schema=schema)
        ranges.close()

    kinds = "id string, url string, type string, refers_to string, bytes long, sha1 string" + ", payload binary" * payloads
    return index.select("file", "offset", "length").mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the pages as whole-file streams, normalise those, and read all records back by the sidecar indexes."""
    spark, folder = pages.sparkSession, stage_path(pages.sparkSession)
    archives = stage(write_monolithic(with_originals(pages, least), f"{folder}/crawl"))
    single = archives.repartition(max(1, archives.count()))
    stage(normalise(single, f"{folder}/records"))
    if archives.isEmpty():
        return read_records(spark.createDataFrame([], INDEX), payloads=False)
    return read_records(read_index(spark, f"{folder}/records"), payloads=False)
