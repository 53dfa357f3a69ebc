"""CRC-32C of many byte strings at once, with numpy tables."""

from __future__ import annotations

from functools import cache

import numpy as np

from vitrine.llm.words import ragged

#: The reflected Castagnoli polynomial and the mask constant of the record format.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
#: Strings are cut into blocks of so many bytes, whose sums are made side by side and then combined.
BLOCK = 256


@cache
def _tables() -> np.ndarray:
    """Row j: the remainder of a byte that is followed by j zero bytes."""
    rows = np.zeros((4, 256), np.uint32)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), crc >> np.uint32(1)).astype(np.uint32)
    rows[0] = crc
    for j in range(1, 4):
        rows[j] = rows[0][rows[j - 1] & 255] ^ (rows[j - 1] >> np.uint32(8))
    return rows


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


@cache
def _zeros(power: int) -> np.ndarray:
    """What 2**power zero bytes do to a remainder, as a table for each of its four bytes."""
    byte = np.arange(256, dtype=np.uint32)
    parts = np.stack([byte << np.uint32(8 * j) for j in range(4)])
    if power == 0:
        return _tables()[0][parts & 255] ^ (parts >> np.uint32(8))
    half = _zeros(power - 1)
    return np.stack([_apply(half, _apply(half, p)) for p in parts])


def crc32c(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32C of data[start[i] : start[i] + length[i]] for every i."""
    n = len(start)
    if not n:
        return np.zeros(0, np.uint32)
    blocks = (length + BLOCK - 1) // BLOCK
    first = np.concatenate([[0], np.cumsum(blocks)])
    padded = np.zeros(int(first[-1]) * BLOCK, np.uint8)  # zeros in front of a string leave its remainder as it is
    padded[ragged(first[1:] * BLOCK - length, length)] = data[ragged(start, length)]
    words = padded.view("<u4").reshape(-1, BLOCK // 4)
    tables = _tables()
    part = np.zeros(len(words), np.uint32)
    for k in range(words.shape[1]):
        x = part ^ words[:, k]
        part = tables[3][x & 255] ^ tables[2][(x >> 8) & 255] ^ tables[1][(x >> 16) & 255] ^ tables[0][x >> 24]
    crc, shift = np.zeros(n, np.uint32), _zeros(BLOCK.bit_length() - 1)
    rows, k = np.flatnonzero(blocks > 0), 0
    while len(rows):
        crc[rows] = _apply(shift, crc[rows]) ^ part[first[rows] + k]
        k += 1
        rows = rows[blocks[rows] > k]
    begin = np.full(n, 0xFFFFFFFF, np.uint32)
    for power in range(int(length.max()).bit_length()):
        has = (length >> power) & 1 == 1
        begin[has] = _apply(_zeros(power), begin[has])
    return crc ^ begin ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
