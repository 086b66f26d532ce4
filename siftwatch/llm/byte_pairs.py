"""Byte-level BPE over a rank file: encoding in linear time by backtracking over longest matches, and decoding.

A piece of text (one match of the split pattern) is mapped byte by byte to Latin-1, where an Aho-Corasick automaton of
the reversed tokens gives the longest token that starts at every byte. Encoding takes the longest token that fits its
left neighbour, falls back to shorter prefixes, and steps back where none fits; a place that failed is never entered
again. Two tokens fit each other when the merges of their joined bytes give just these two; a row of tokens is the
result of the merges exactly when all its neighbours fit, and whether two fit is worked out once and kept.

A null or empty text has no ids. Bytes need not be valid text when decoding. Equal rows give equal rows.
"""

from __future__ import annotations

import base64
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftwatch.llm.texts import Memo, by_bytes, by_parts, one_per_worker, space_parts

#: Parts of texts, and pairs of tokens, that a task keeps (twice that at most).
MEMO_PARTS = 250_000
MEMO_PAIRS = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        # The library's \s is Unicode's white space, without the separators U+001C to U+001F.
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # Words are parts of their own only where the pattern never joins two of them.
        self.by_parts = self._cuts_at_spaces()
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.longest = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.longest.add_word(token.decode("latin-1")[::-1], rank)
        self.longest.make_automaton()
        self.prefixes: dict[int, int | None] = {}
        self.fits: dict[int, bool] = {}
        self.memo = Memo(MEMO_PARTS)

    def _cuts_at_spaces(self) -> bool:
        trials = ("a b", "a. b", "1 b", "a\n.b c", "a 's b", "é ,b", "!! ??")
        return all([p for part in space_parts(t) for p in self.pieces(part)] == self.pieces(t) for t in trials)

    def merges(self, piece: bytes) -> list[int]:
        """The definition, one merge at a time: the adjacent pair of lowest rank, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.prefixes:
            whole = self.bytes_of[token]
            ends = (self.ranks.get(whole[:k]) for k in range(len(whole) - 1, 0, -1))
            self.prefixes[token] = next((t for t in ends if t is not None), None)
        return self.prefixes[token]

    def piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[int] = [-1] * n
        for end, token in self.longest.iter(piece.decode("latin-1")[::-1]):
            if starts[n - 1 - end] < 0:  # the longest comes first
                starts[n - 1 - end] = token
        open_at, out, at, token = [True] * (n + 1), [], 0, starts[0]
        while at < n:
            while token is not None:
                end = at + self.size_of[token]
                if open_at[end] and (not out or self.fit(out[-1], token)):
                    break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at = end
                token = starts[at] if at < n else None
            elif out:
                open_at[at] = False
                token = out.pop()
                at -= self.size_of[token]
            else:
                raise ValueError("the ranks lack a byte of the text")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        return by_parts(texts, self.memo, self._whole) if self.by_parts else self._whole(texts)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", [i for p in self.pieces(part) for i in self.piece(p.encode())]).tobytes() for part in texts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


def coder(path: str, pattern: str) -> BytePairs:
    return one_per_worker(("byte pairs", path, pattern), lambda: BytePairs(read_ranks(path), pattern))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and ``ids`` (binary, little-endian unsigned 32-bit) of every text; no shuffle."""
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.BinaryType())])

    def run(batches):
        own = coder(ranks, pattern)
        for b in (part for batch in batches for part in by_bytes(batch, 1)):
            ids = own.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``encoded``, whose column ``ids`` holds ids as ``encode`` gives them, with their bytes as ``decoded``."""
    schema = T.StructType([*(f for f in encoded.schema if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])

    at = encoded.drop("decoded").columns.index("ids")

    def run(batches):
        own = coder(ranks, pattern)
        for b in (part for batch in batches for part in by_bytes(batch, at)):
            texts = [None if x is None else own.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=schema.names)

    return encoded.drop("decoded").mapInArrow(run, schema)


def encoded_with_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """The ids of every text, decoded again, and digests of both."""
    both = decode(encode(docs, ranks, pattern), ranks, pattern)
    return both.select(
        "doc_id",
        "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    return encoded_with_digests(docs, ranks, pattern).drop("ids")
