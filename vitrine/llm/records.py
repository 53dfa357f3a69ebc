"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A record is: length of the payload (u64), masked CRC-32C of these eight bytes (u32), payload, masked CRC-32C of the
payload (u32), all little-endian. A payload is: doc_id (i64), flags (u8; 1: doc_id is null), bytes an id takes (u8),
two zero bytes, number of ids (u32), ids. Ids take two bytes where the vocabulary allows it, else four. The index
file of a shard holds an entry for each record: doc_id (i64), place of the record (u64), ids before it in the shard
(u64), number of ids (u32), flags (u32).

Each task writes a shard under a name of its own; only files named in the manifest, which is stored once the tasks
are done, count. So a task that is run again leaves at most files that nothing reads.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.bpe import END_ID, default_path, encoder
from vitrine.llm.crc32c import crc32c, masked
from vitrine.llm.storage import new_dir, shuffle_partitions, stored
from vitrine.llm.words import text_buffers

HEAD = np.dtype([("doc_id", "<i8"), ("flags", "u1"), ("width", "u1"), ("zero", "<u2"), ("n_ids", "<u4")])
ENTRY = np.dtype([("doc_id", "<i8"), ("at", "<u8"), ("before", "<u8"), ("n_ids", "<u4"), ("flags", "<u4")])
#: Bytes of records that a reader takes in at once, unless one record is longer.
READ_BYTES = 8 << 20

MANIFEST = "part int, records string, index string, n_docs long, n_ids long"
READ = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long"


def framed(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Records of the payloads, and the place of each."""
    length = np.array([len(p) for p in payloads], np.int64)
    data = np.frombuffer(b"".join(payloads), np.uint8)
    body = masked(crc32c(data, np.cumsum(length) - length, length)).astype("<u4")
    sizes = length.astype("<u8")
    head = masked(crc32c(sizes.view(np.uint8), np.arange(len(length)) * 8, np.full(len(length), 8))).astype("<u4")
    out = []
    for k, payload in enumerate(payloads):
        out += (sizes[k].tobytes(), head[k].tobytes(), payload, body[k].tobytes())
    return b"".join(out), np.cumsum(length + 16) - (length + 16)


def parsed(data: bytes, at: np.ndarray) -> list[bytes]:
    """The payloads of the records that begin at these places; ValueError if a checksum differs."""
    raw = np.frombuffer(data, np.uint8)
    at = np.asarray(at, np.int64)
    length = np.array([int.from_bytes(data[p : p + 8], "little") for p in at], np.int64)
    stored_head = np.array([int.from_bytes(data[p + 8 : p + 12], "little") for p in at], np.uint32)
    if (masked(crc32c(raw, at, np.full(len(at), 8))) != stored_head).any() or (at + length + 16 > len(data)).any():
        raise ValueError("a record's length is damaged")
    stored_body = np.array([int.from_bytes(data[p + 12 + n : p + 16 + n], "little") for p, n in zip(at, length, strict=True)], np.uint32)
    if (masked(crc32c(raw, at + 12, length)) != stored_body).any():
        raise ValueError("a record's payload is damaged")
    return [data[p + 12 : p + 12 + n] for p, n in zip(at, length, strict=True)]


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a payload."""
    head = np.frombuffer(payload, HEAD, 1)[0]
    ids = np.frombuffer(payload, f"<u{head['width']}", offset=HEAD.itemsize)
    if len(ids) != head["n_ids"]:
        raise ValueError("a payload has another number of ids than it says")
    return (None if head["flags"] & 1 else int(head["doc_id"])), ids.astype("<u4")


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode every whole text and write shards of records in ascending doc_id order; returns the stored manifest.

    docs needs doc_id and text; other columns are left alone. A null text is empty, a null doc_id comes first, rows
    with one doc_id come in the order of their texts' hashes, rows alike in both in any; they are dealt out by a sign of
    their own, so that no doc_id fills one shard. A long text is one record. An empty table writes no shard.
    """
    path = tokenizer or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        width = 2 if encoder(path).vocab_size <= 1 << 16 else 4
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        names = [f"part-{part:05d}-{name}.{kind}" for kind in ("rec", "idx")]
        n_docs = n_ids = place = 0
        records = index = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if records is None:
                records, index = (fs.open_output_stream(f"{base}/{x}") for x in names)
            doc_id = batch.column("doc_id")
            null = np.asarray(doc_id.is_null())
            doc_id = np.asarray(doc_id.fill_null(0)).astype(np.int64)
            for a, ids, bounds in encoder(path).encode(*text_buffers(batch.column("text")), end_id):
                k = len(bounds) - 1
                head = np.zeros(k, HEAD)
                head["doc_id"], head["flags"], head["width"], head["n_ids"] = doc_id[a : a + k], null[a : a + k], width, np.diff(bounds)
                small = ids.astype(f"<u{width}")
                data, at = framed([head[i].tobytes() + small[bounds[i] : bounds[i + 1]].tobytes() for i in range(k)])
                entry = np.zeros(k, ENTRY)
                entry["doc_id"], entry["at"], entry["before"], entry["n_ids"], entry["flags"] = head["doc_id"], at + place, bounds[:-1] + n_ids, head["n_ids"], head["flags"]
                records.write(data)
                index.write(entry.tobytes())
                place, n_docs, n_ids = place + len(data), n_docs + k, n_ids + int(bounds[-1])
        if records is not None:
            records.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "records": [names[0]], "index": [names[1]], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "salt": F.xxhash64(F.monotonically_increasing_id())})
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h")
    return stored(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def read_at(folder: str, records: str, at: int) -> tuple[int | None, np.ndarray]:
    """One document, from the place that the index gives: a shuffled read."""
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{records}") as f:
        f.seek(at)
        head = f.read(12)
        return ids_of(parsed(head + f.read(int.from_bytes(head[:8], "little") + 4), np.array([0]))[0])


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """Read all shards back, check every checksum, and return a row for each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{base}/{row['index']}") as f:
                    index = np.frombuffer(f.read(), ENTRY)
                with fs.open_input_file(f"{base}/{row['records']}") as f:
                    ends = np.append(index["at"][1:], f.size()).astype(np.int64)
                    first = 0
                    while first < len(index):
                        begin = int(index["at"][first])
                        last = max(first + 1, int(np.searchsorted(ends, begin + READ_BYTES, "right")))
                        data = f.read(int(ends[last - 1]) - begin)
                        own = index[first:last]
                        found = [ids_of(p) for p in parsed(data, own["at"].astype(np.int64) - begin)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([row["part"]] * len(own), pa.int32()),
                                pa.array([d for d, _ in found], pa.int64()),
                                pa.array(own["before"].astype(np.int64)),
                                pa.array([len(x) for _, x in found], pa.int64()),
                                pa.array([zlib.crc32(x.tobytes()) for _, x in found], pa.int64()),
                            ],
                            names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
                        )
                        first = last

    spread = manifest.select("part", "records", "index").repartition(shuffle_partitions(manifest.sparkSession), "part")
    return spread.mapInArrow(read, READ)


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32, part."""
    folder = new_dir(docs.sparkSession, "records")
    manifest = write_records(docs, folder, tokenizer, end_id)
    # A row for each shard: the window is over as many rows as there are shards.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    found = read_records(manifest, folder)
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", "part")
