"""CRC-32C (Castagnoli) of byte strings with numpy, and the masked form that record files use."""

from __future__ import annotations

from functools import cache

import numpy as np

POLYNOMIAL = 0x82F63B78
BLOCK = 256


@cache
def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(POLYNOMIAL), crc >> 1)
    return crc


@cache
def _byte_list() -> list[int]:
    return _byte_table().tolist()


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """What a byte at each place of a block adds to the block's remainder, where a place's values start in that table,
    and what a remainder becomes one block on."""
    table = _byte_table()
    places = np.empty((BLOCK, 256), np.uint32)
    places[-1] = table
    for k in range(BLOCK - 2, -1, -1):
        places[k] = (places[k + 1] >> 8) ^ table[places[k + 1] & 0xFF]
    # A remainder is the four last bytes read so far; after one block of zeros each has moved that far on.
    on = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(BLOCK):
        on = (on >> 8) ^ table[on & 0xFF]
    return places.ravel(), np.arange(0, BLOCK * 256, 256, dtype=np.intp), on.tolist()


def crc32c(data: bytes) -> int:
    n = len(data)
    if n < 32:
        crc, table = 0xFFFFFFFF, _byte_list()
        for b in data:
            crc = crc >> 8 ^ table[(crc ^ b) & 0xFF]
        return crc ^ 0xFFFFFFFF
    places, steps, on = _tables()
    # The start value is the first four bytes inverted; zeros before them change nothing.
    rows = -(-n // BLOCK)
    padded = np.zeros(rows * BLOCK, np.uint8)
    padded[-n:] = np.frombuffer(data, np.uint8)
    padded[len(padded) - n : len(padded) - n + 4] ^= 0xFF
    each = np.bitwise_xor.reduce(places[padded.reshape(rows, BLOCK) + steps], axis=1).tolist()
    a, b, c, d = on
    crc = 0
    for x in each:
        crc = a[crc & 0xFF] ^ b[crc >> 8 & 0xFF] ^ c[crc >> 16 & 0xFF] ^ d[crc >> 24] ^ x
    return crc ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    """Rotated and offset, so that the checksum of data that holds checksums stays sound."""
    crc = crc32c(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF
