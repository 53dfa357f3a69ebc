"""Packing of token sequences into windows of near-equal length by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the capacity. Whole pieces are windows of their own; the rest is dealt into
groups of bounded size, in each of which differencing merges partial partitions, the largest imbalance first, the
fullest window of one with the emptiest of the other. If a window comes out above the capacity, the group gets one
window more and starts again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.bpe import END_ID, default_path, encoder
from vitrine.llm.storage import free_name, stored
from vitrine.llm.words import text_buffers

CAPACITY = 4096
#: Windows that a group of pieces makes, about, and pieces that it has, about; a group is worked on by one task.
GROUP_WINDOWS, GROUP_PIECES = 256, 1 << 16
#: Bits of a node's number beside its sum.
NODE_BITS = 32
#: Added to a piece's number for the id of a window that it fills alone.
ALONE = 1 << 62

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Deal the sizes into k windows: the window of each.

    A partial partition is the sorted list of its windows that hold anything, each its sum and its node; a node is a
    piece, or two nodes that came into one window. So memory grows with the pieces alone, whatever k is.
    """
    n = len(sizes)
    if n <= k:
        return np.arange(n)
    parts = [[(s << NODE_BITS) + i] for i, s in enumerate(sizes.tolist())]
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    left, right = [], []  # of nodes from n on
    low = (1 << NODE_BITS) - 1
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        one, two = parts[a], parts[b]
        parts[a] = None
        meet = len(one) + len(two) - k
        if meet > 0:  # no empty window is left: the fullest of these with the emptiest of those
            both = []
            for x, y in zip(one[:meet], reversed(two[:meet]), strict=True):
                both.append(((x >> NODE_BITS) + (y >> NODE_BITS) << NODE_BITS) + n + len(left))
                left.append(x & low)
                right.append(y & low)
            both += one[meet:]
            both += two[meet:]
        else:
            both = one + two
        both.sort()
        parts[b] = both
        most, least = both[-1] >> NODE_BITS, both[0] >> NODE_BITS if len(both) == k else 0
        heapq.heapreplace(heap, (least - most, b))
    window = [0] * (n + len(left))
    for w, slot in enumerate(parts[heap[0][1]]):
        window[slot & low] = w
    for node in range(n + len(left) - 1, n - 1, -1):
        window[left[node - n]] = window[right[node - n]] = window[node]
    return np.array(window[:n], np.int64)


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none above the capacity; sizes must be at most the capacity."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if sizes.max() > capacity:
        raise ValueError("a size is above the capacity")
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes).max() <= capacity:
            return window
        k += 1


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Ids of every whole text, cut at multiples of the capacity: doc_id, start, length, doc_tokens, ids (little-endian u32)."""
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc_id = batch.column("doc_id")
            for a, ids, bounds in encoder(path).encode(*text_buffers(batch.column("text")), end_id):
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(n[row] - start, capacity)
                own = ids.astype("<u4", copy=False)
                where = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int64)
                body = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(where), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays(
                    [doc_id.take(pa.array(a + row)), pa.array(start), pa.array(length), pa.array(n[row]), body.cast(pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def assign(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Give pieces (length at most the capacity; any other columns) their sequence_id and offset.

    Columns sequence_id and offset that pieces have already give way to the new ones; all others stay. Rows may repeat;
    each is a piece of its own. An empty table gives an empty result. Which sequence a piece comes to hangs on the order
    in which the table is read; that it is in exactly one does not.
    """
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    own, part = free_name("piece", kept), free_name("group", kept)
    table = stored(pieces.select(*kept, F.monotonically_increasing_id().alias(own)), "pieces")
    whole = table.where(F.col("length") >= capacity).withColumns({"sequence_id": F.col(own) + F.lit(ALONE), "offset": F.lit(0).cast("long")})
    rest = table.where(F.col("length") < capacity)
    total, count = rest.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, round((total or 0) / (capacity * group_windows)), -(-count // GROUP_PIECES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema) + ", sequence_id long, offset long"

    def place(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns=part).sort_values(own, ignore_index=True)
        window = pack(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = (int(key[0]) << 32) + window
        rows = rows.iloc[np.argsort(window, kind="stable")]
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows

    group = F.pmod(F.xxhash64(own), F.lit(groups)).alias(part)
    packed = rest.select("*", group).groupBy(part).applyInPandas(place, schema)
    return packed.unionByName(whole).drop(own)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The packing digest: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone; a null doc_id stays null; rows may repeat, each is packed; a long text is
    cut at multiples of the capacity; other columns are left alone; an empty table gives an empty result.
    """
    pieces = cut_pieces(docs, capacity, tokenizer)
    return assign(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"), capacity)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces with their ids (little-endian unsigned 32-bit), to be laid at their offsets into their sequences:
    columns of pack_documents and ids. Odd rows as there."""
    pieces = cut_pieces(docs, capacity, tokenizer)
    return assign(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "ids"), capacity)
