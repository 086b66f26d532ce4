"""Texts inside tasks: Arrow columns as bytes, words, and a bounded memo of what their parts give."""

from __future__ import annotations

import re
from functools import partial
from itertools import compress, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: A-Z to lower case, all else as it is (works on UTF-8, whose other bytes are above 127).
LOWER_AZ = bytes.maketrans(UPPER, LOWER)


def utf8(column: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words between the ASCII white space ``\\x20 \\x09-\\x0D``, A-Z in lower case."""
    return text.translate(LOWER_AZ).split()


def coded_words(column: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``lower_words`` of all texts of a string column: the different words, the place among them of every word, and
    where each text's words begin, the end of the last included. Null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = split.values.dictionary_encode()
    different = coded.dictionary.cast(pa.binary()).to_pylist()
    places, bounds = coded.indices.to_numpy(), split.offsets.to_numpy().astype(np.int64)
    if b"" in different:  # around white space at an end of a text
        none = different.index(b"")
        sound = places != none
        bounds = np.concatenate([[0], np.cumsum(sound)])[bounds]
        places = places[sound]
        places -= places > none
        del different[none]
    return different, places, bounds


def fresh(columns: list[str], base: str) -> str:
    """A column name like ``base`` that none of ``columns`` has (case-insensitively, as Spark compares them)."""
    taken, name = {c.lower() for c in columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


_held: dict = {}


def release_worker() -> None:
    """Let go of what an earlier operator kept in this worker, and give the freed memory back to the system (Arrow's
    pool and the C heap), so that the next stage's tasks start from a small worker."""
    if not _held:
        return
    _held.clear()
    import gc

    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc: the memory is reused by this process instead
        pass


def one_per_worker(key: tuple, build):
    """What ``build`` gives, kept for the worker's later tasks. A worker keeps one such thing: tasks of another
    operator let it go first (``release_worker``), so that a worker that serves several of them does not add up their
    memories. Operators that keep nothing call ``release_worker`` at the start of their tasks."""
    if key not in _held:
        release_worker()
        _held[key] = build()
    return _held[key]


class Memo:
    """What keys gave, for about the last ``most`` different ones: two generations, so that frequent keys stay."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def values(self, keys: list, compute) -> list:
        """The values of different keys; ``compute(list of unknown keys)`` gives those not known."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        unknown = []
        for key in filterfalse(young.__contains__, keys):
            if key in old:
                young[key] = old[key]
            else:
                unknown.append(key)
        if unknown:
            young.update(zip(unknown, compute(unknown), strict=True))
        return list(map(young.__getitem__, keys))


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 20):
    """Slices of a batch whose texts hold about ``most`` bytes each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    starts = np.flatnonzero(np.diff(sizes // most, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


SPACE_CUT = re.compile(r"(?<=\S)(?= \S)")


def space_parts(text: str) -> list[str]:
    """The text cut before single spaces between two non-space characters, where a byte-level pre-tokenizer
    (a word takes the one space before it) always cuts. The parts joined are the text."""
    return SPACE_CUT.split(text)


def joined(values: list[bytes], places: pa.Array) -> tuple[bytes, np.ndarray]:
    """The values at ``places`` one after another, and where each starts, the end of the last included."""
    if not len(places):
        return b"", np.zeros(1, np.int64)
    taken = pa.array(values, pa.large_binary()).take(places)
    _, starts, data = taken.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(starts, np.int64)[taken.offset :][: len(places) + 1]


def by_parts(texts: list[str], memo: Memo | None, encode, encode_spaced=None) -> list[bytes]:
    """``encode(list of texts)`` of all texts, worked out once for equal parts: a text's code is its parts' codes
    joined. The memo knows a part without the space before it; None marks one that white space joins to the next.
    Only different parts are met one by one; all others are numbers in Arrow and numpy. Without a memo parts are known
    within ``texts`` only. ``encode_spaced`` may do the same for texts that start with a single space and end with none."""
    if not texts:
        return []

    encode_spaced = encode_spaced or encode

    def codes(parts):
        sound = [p != "" and p.strip() == p for p in parts]
        known = encode_spaced([" " + p for p in compress(parts, sound)])
        if len(known) == len(parts):
            return known
        known = iter(known)
        return [next(known) if x else None for x in sound]

    codes_of = partial(memo.values, compute=codes) if memo else codes

    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    bounds = split.offsets.to_numpy()
    first = np.zeros(len(split.values), bool)
    first[bounds[:-1]] = True
    heads = split.values.take(pa.array(bounds[:-1])).to_pylist()
    coded = split.values.dictionary_encode()
    places = coded.indices.to_numpy()[~first]
    bounds = bounds - np.arange(len(bounds))  # of the texts' parts without their heads
    different = coded.dictionary
    del split, coded  # memory for the codes

    values = codes_of(different.to_pylist())
    unsound = np.array([v is None for v in values], bool)[places]
    unsound = np.concatenate([[0], np.cumsum(unsound)])[bounds]
    data, starts = joined([v or b"" for v in values], pa.array(places))
    stops, sizes = starts[bounds].tolist(), np.diff(bounds).tolist()
    out: list[bytes | None] = []
    for head, size, bad, a, b in zip(heads, sizes, np.diff(unsound).tolist(), stops, stops[1:]):
        sound = (not size or head and not head[-1].isspace()) and not bad
        out.append(data[a:b] if sound else None)
    odd = {k: space_parts(texts[k]) for k, x in enumerate(out) if x is None}
    if odd:
        inner = list({p[1:] for parts in odd.values() for p in parts[1:-1]})
        known = dict(zip(inner, codes_of(inner)))
        ends = iter(encode([p for parts in odd.values() for p in (parts[0], *parts[1:][-1:])]))
        for k, parts in odd.items():
            code = next(ends) + b"".join([known[p[1:]] for p in parts[1:-1]])
            out[k] = code + next(ends) if len(parts) > 1 else code
    plain = [k for k in range(len(texts)) if k not in odd]
    for k, code in zip(plain, encode([heads[k] for k in plain])):
        out[k] = code + out[k]
    return out
