"""Words of whole texts in bulk: spans, codes and hashes from Arrow buffers, without an object per word."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in chunks of about so many bytes; a longer text is a chunk of its own.
CHUNK_BYTES = 3 << 19

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: 1: a-z; 3: ASCII signs other than the apostrophe; 7: ASCII digits; 11: the apostrophe; 0: all else. What a pre-token
#: always ends between shows in the product of both: a letter and a sign, a digit and anything but 0.
KIND = np.zeros(256, np.uint8)
KIND[97:123] = 1
KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 3
KIND[48:58] = 7
KIND[39] = 11
MEETS = np.zeros(256, bool)
MEETS[[1 * 3, 7 * 1, 7 * 3, 7 * 7, 7 * 11]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the offsets of a string column; a null counts as an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free back to the system; a worker that goes on to other stages would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes each; free memory goes back after the last."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last
    release()


@dataclass
class Words:
    """The words of some texts. doc: the text of each word; codes: its place in vocab."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    @property
    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    def bounds(self) -> np.ndarray:
        """For each text the place of its first word, and at the end the number of words."""
        return np.concatenate([[0], np.cumsum(self.per_doc)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each entry of vocab."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, pieces: bool = False) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; lower: with A-Z as a-z; pieces: words cut where pre-tokens end for sure."""
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    n = len(data)
    first, last = np.ones(n, bool), np.ones(n, bool)
    if n:
        first[1:] = ~inside[:-1]
        last[:-1] = ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        first[offsets[:-1][full]] = True
        last[offsets[1:][full] - 1] = True
        if pieces:
            kind = KIND[data]
            meet = np.flatnonzero(MEETS[kind[1:] * kind[:-1]])
            first[meet + 1] = True
            last[meet] = True
    start, end = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    where = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    body = np.ascontiguousarray(data[inside])
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(where), pa.py_buffer(body)])
    coded = column.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(data, offsets, start, end, doc, codes, coded.dictionary)


def whole_texts(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Each text that is not empty as one word."""
    doc = np.flatnonzero(offsets[1:] > offsets[:-1])
    start, end = offsets[doc], offsets[doc + 1]
    column = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.take(pa.array(doc)).dictionary_encode()
    return Words(data, offsets, start, end, doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i]+1 ... for length[i] of them, for each i in turn."""
    total = int(length.sum())
    shift = start - np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else start
    return np.repeat(shift, length) + np.arange(total, dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over the whole range (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
