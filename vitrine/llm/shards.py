"""Sharding by a Feistel permutation of global row numbers, with cycle walking down to the number of rows.

Row number r goes to place P(r), a permutation of 0 .. n-1 that the seed fixes; its shard is P(r) modulo the number of
shards and its slot P(r) divided by it. Shard sizes differ by one row at most. Both can be computed, and P inverted,
from r, n and the seed alone, without a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.storage import free_name, shuffle_partitions, stored
from vitrine.llm.words import mix64

SHARDS, SEED, ROUNDS = 8, 20240607, 6


def half_bits(n: int) -> int:
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, k: int, seed: int, bits: int) -> np.ndarray:
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    return mix64(half + key) & np.uint64((1 << bits) - 1)


def _network(x: np.ndarray, bits: int, seed: int, back: bool) -> np.ndarray:
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    for k in range(ROUNDS):
        if back:
            left, right = right ^ _round(left, ROUNDS - 1 - k, seed, bits), left
        else:
            left, right = right, left ^ _round(right, k, seed, bits)
    return (left << np.uint64(bits)) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The place of each row number below n; back: the row number of each place."""
    bits = half_bits(n)
    out = _network(np.asarray(rows).astype(np.uint64), bits, seed, back)
    while len(far := np.flatnonzero(out >= np.uint64(n))):  # walk along the cycle
        out[far] = _network(out[far], bits, seed, back)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order without bringing them together; returns the rows and their number.

    Rows are sorted by range partitions and counted in each; the counts, a row for each partition, give every
    partition its first number. Rows that are equal in all of `order` are numbered in any order, and a sign of their
    own deals them out to as many partitions as they need. A column `name` that df has gives way to the new one.
    """
    kept = [c for c in df.columns if c != name]
    salt, part, inner, first = (free_name(c, [*df.columns, name]) for c in ("salt", "part", "inner", "first"))
    salted = df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
    sorted_rows = salted.repartitionByRange(shuffle_partitions(df.sparkSession), *order, salt).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = stored(sorted_rows.select(*df.columns, F.spark_partition_id().alias(part), place.alias(inner)), "numbered")
    counts = table.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy(part).collect()
    n, starts = 0, []
    for row in counts:
        starts.append((row[part], n))
        n += row["n"]
    firsts = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{part} int, {first} long")
    return table.join(F.broadcast(firsts), part).select(*kept, (F.col(first) + F.col(inner)).alias(name)), n


def shard_rows(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add row_number, shard and slot to df's columns; columns of these names that df has give way, but may be in `order`.

    An empty table gives an empty result; rows may repeat; nulls come first in the order; other columns stay as they are.
    """
    numbered, n = number_rows(df, order)

    @F.pandas_udf("long")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), n, seed))

    kept = [c for c in df.columns if c not in ("row_number", "shard", "slot")]
    at = free_name("place", numbered.columns)
    return numbered.withColumn(at, place("row_number")).select(*kept, "row_number", (F.col(at) % shards).cast("int").alias("shard"), F.expr(f"{at} div {int(shards)}").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All documents under the law `rows`: shard counts are at most one row apart, a hot text or source changes nothing.

    A null text has size 1 and crc 0; a null doc_id comes first in the row order; the order of rows with one doc_id is
    that of their size and crc, and rows alike in all three take any order, each a place of its own. Long texts are
    measured where they lie; other columns are left alone; an empty table gives an empty result.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = shard_rows(rows, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
