"""Token ids as length-delimited binary records with a separate offset index.

A data file is a row of records: length (8 bytes), masked CRC-32C of the length, payload, masked CRC-32C of the
payload, all little-endian. The payload is the ids of one document, its end id last, two bytes each where the
vocabulary allows, else four. The index is a Parquet table with one row per record (file, offset, length), so a
shuffled read goes straight to any record and checks it there.

Order: files follow each other by ``part``, records by offset, both ascending in (id, hash of the text). Rows that
repeat an id are neighbours and each keep a record; a null id comes first; a null text is empty and gives the end id.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from siftwatch.llm import crc32c, files
from siftwatch.llm.texts import by_bytes, by_parts, joined, one_per_worker, release_worker, trim
from siftwatch.staging import stage, stage_path

#: Parts that go to the tokenizer as one text.
JOINED = 1_000
#: Bytes of texts that are encoded at once: equal parts of them go to the tokenizer once.
ENCODED_BYTES = 8 << 20

#: Characters whose kind a byte-level pre-tokenizer's pattern goes by: letters, digits, other marks, white space. No
#: others are cut here; the library cuts texts that hold them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁ"
MARKS = "!-/:-@[-`{-~¡§«¶»¿‐-‧"
OTHER = re.compile(f"[^{LETTERS}0-9{MARKS} \\n]")
PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\\s+(?!\\S)|\\s+")
#: What the library must take as one piece each for that.
KINDS = tuple("".join(filter(re.compile(f"[{kind}]").match, map(chr, range(0x2100)))) for kind in (LETTERS, "0-9", MARKS))

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")


class Encoder:
    """Ids of texts by a tokenizer file, as bytes. Gives what encoding each whole text gives.

    A byte-level tokenizer always cuts before a single space between two words, so texts are encoded part by part
    and equal parts of the texts of a call once. Any other kind of tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        kind = self._kind()
        self.by_parts = kind.get("type") == "ByteLevel" and not kind["add_prefix_space"] and kind["use_regex"] and self.library.normalizer is None
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 65536 else "<u4")
        # A byte-level vocabulary writes one character per byte.
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token)
        self.merges = self._merges() if self.by_parts else None

    def _kind(self) -> dict:
        return json.loads(self.library.to_str()).get("pre_tokenizer") or {}

    def _merges(self):
        """The same model without its pre-tokenizer: takes pieces between line ends, a character a byte. It keeps
        nothing, as it meets different pieces only. None where pieces are not cut by ``PIECE``."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        model = json.loads(self.library.to_str())["model"]
        cut = self.library.pre_tokenizer.pre_tokenize_str
        if model.pop("type", None) != "BPE" or model.get("dropout") or any(len(cut(x)) != 1 for x in KINDS):
            return None
        model["merges"] = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        merges = Tokenizer(models.BPE(**{k: v for k, v in model.items() if v is not None}, cache_capacity=0))
        merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        # The library writes a byte as this character; none of the pieces holds a zero.
        shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        hidden = [b for b in range(256) if b not in shown]
        self.written = dict(zip([*shown, *hidden], [*map(chr, shown), *map(chr, range(256, 256 + len(hidden)))])) | {0: "\n"}
        return merges

    def encode(self, texts: list[str]) -> list[bytes]:
        return by_parts(texts, None, self.encode_parts, self._spaced) if self.by_parts else self._whole(texts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The same for parts of texts: those that start with a single space and end with none go on together."""
        plain = [p[:1] == " " and p.strip() == p[1:] for p in parts]
        spaced = iter(self._spaced(list(compress(parts, plain))))
        rest = iter(self._whole([p for p, x in zip(parts, plain) if not x]))
        return [next(spaced if x else rest) for x in plain]

    def _spaced(self, parts: list[str]) -> list[bytes]:
        """Parts of known characters are cut into pieces here, and each different piece goes to the model once; of the
        others, many go to the library as one text."""
        if not self.merges:
            return self._together(parts)
        safe = np.ones(len(parts), bool)
        if odd := [m.start() for m in OTHER.finditer("".join(parts))]:
            safe[np.searchsorted(np.cumsum(list(map(len, parts))), odd, side="right")] = False
        known = self._by_pieces(list(compress(parts, safe)) if odd else parts)
        if len(known) == len(parts):
            return known
        if not known:
            return self._together(parts)
        known, rest = iter(known), iter(self._together(list(compress(parts, ~safe))))
        return [next(known if x else rest) for x in safe.tolist()]

    def _together(self, parts: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {}
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        for group, e in zip(groups, self.library.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            stops = self._stops(ids, np.cumsum([len(p.encode()) for p in group]))
            if stops is not None:
                data, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
                out.update((p, data[a:b]) for p, a, b in zip(group, [0, *stops], stops))
        rest = [p for p in parts if p not in out]
        out.update(zip(rest, self._whole(rest)))
        return [out[p] for p in parts]

    def _stops(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """How many ids lie before each of these ends in bytes; None if an id goes over one, or the bytes differ."""
        at = np.cumsum(self.lengths[ids])
        cut = np.searchsorted(at, ends)
        return cut + 1 if len(at) and cut[-1] == len(at) - 1 and np.array_equal(at[cut], ends) else None

    def _by_pieces(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without ``OTHER`` characters; none if the model lacks some byte."""
        if not parts:
            return []
        pieces = pa.array(PIECE.findall("".join(parts)), pa.string()).dictionary_encode()
        sizes = pc.binary_length(pieces.dictionary).to_numpy()
        groups = np.append(np.arange(0, len(sizes), JOINED), len(sizes))
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(groups, pa.int32()), pieces.dictionary), "\0")
        texts = [g.decode("latin-1").translate(self.written) for g in groups.cast(pa.binary()).to_pylist()]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])
        stops = self._stops(ids, np.cumsum(sizes))
        if stops is None:
            return []
        data, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
        data, starts = joined([data[a:b] for a, b in zip([0, *stops], stops)], pieces.indices)
        ends = pc.binary_length(pa.array(parts, pa.string())).to_numpy().cumsum()
        stops = starts[np.searchsorted(sizes[pieces.indices.to_numpy()].cumsum(), ends) + 1].tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops)]


def encoder(path: str) -> Encoder:
    return one_per_worker(("token records", path), lambda: Encoder(path))


def framed(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, TAIL.pack(crc32c.masked(length)), payload, TAIL.pack(crc32c.masked(payload))))


def unframed(record: bytes, check: bool = True) -> bytes:
    length, crc = HEAD.unpack_from(record)
    payload = record[HEAD.size : HEAD.size + length]
    if check and (crc != crc32c.masked(record[:8]) or TAIL.unpack_from(record, HEAD.size + length)[0] != crc32c.masked(payload)):
        raise ValueError("a record does not match its checksum")
    return payload


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts below ``folder`` and return the index: id, part, file, offset, length, width, n_tokens and
    ``before`` (ids of the records before it in its file)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField(id_col, kind),
            *(T.StructField(n, t) for n, t in (("part", T.IntegerType()), ("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("width", T.IntegerType()), ("n_tokens", T.LongType()), ("before", T.LongType()))),
        ]
    )
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("h"))
    ordered = texts.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def write_part(batches):
        part, e, offset, before = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        end = np.array([end_id], e.dtype).tobytes()
        name = f"{folder}/part-{part:06d}.records"
        with files.writing(name) as out:
            for batch in batches:
                for rows in by_bytes(batch, 1, ENCODED_BYTES):
                    encoded = [x + end for x in e.encode(rows.column(1).to_pylist())]
                    records = [framed(x) for x in encoded]
                    out.write(b"".join(records))
                    lengths = np.array([len(r) for r in records])
                    counts = np.array([len(x) // e.dtype.itemsize for x in encoded])
                    offsets, befores = np.cumsum(lengths) - lengths + offset, np.cumsum(counts) - counts + before
                    offset, before, n = offset + int(lengths.sum()), before + int(counts.sum()), len(records)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(offsets), pa.array(lengths), pa.array([e.dtype.itemsize] * n, pa.int32()), pa.array(counts), pa.array(befores)],
                        names=schema.names,
                    )
        trim()

    return ordered.mapInArrow(write_part, schema)


def read(index: DataFrame, carry: list[str]) -> DataFrame:
    """The records that the rows of ``index`` point at, checked: the ``carry`` columns and ``ids`` (little-endian
    unsigned 32-bit). Any order of the index works; ascending offsets read whole blocks."""
    schema = T.StructType([*(index.schema[c] for c in carry), T.StructField("ids", T.BinaryType())])
    need = ["file", "offset", "length", "width"]

    def fetch(batches):
        release_worker()
        ranges = files.Ranges()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                got = []
                for f, o, n, w in zip(*(rows.column(c).to_pylist() for c in need)):
                    payload = unframed(ranges.read(f, o, n))
                    got.append(payload if w == 4 else np.frombuffer(payload, f"<u{w}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), pa.array(got, pa.binary())], names=schema.names)
        ranges.close()

    return index.select(*dict.fromkeys([*carry, *need])).mapInArrow(fetch, schema)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all records before each one. One row per file is summed in one task, and
    joined as a broadcast; a data file holds a whole partition, so their number stays small."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = totals.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_first"))
    return index.join(F.broadcast(first), "part").withColumn("start", F.col("_first") + F.col("before")).drop("_first")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the texts as records in a new folder, and read every record back through the index."""
    folder = stage_path(docs.sparkSession)
    index = with_starts(stage(write(docs, folder, tokenizer)))
    return read(index, ["doc_id", "start", "n_tokens"])


def crc32_of(ids: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(x) for x in ids.to_pylist()], pa.int64())
