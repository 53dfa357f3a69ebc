"""Exact top-k by inner product: branch and bound over vectors that are stored dimension block by dimension block.

Vectors are whole numbers, floor(1024 x). The candidates of a cell stand in vertical layout, one array for each block
of dimensions. For a query, scores are accumulated block by block; what the blocks to come can still add lies within
the product of the remaining masses (norms) of query and candidate. Candidates whose upper bound is under the k-th
best lower bound go, and those that stay are compacted, until all dimensions are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.storage import stored

SCALE, K = 1024, 10
BLOCK_DIMS = 8
#: A cell has about so many candidates and at most about so many queries.
CELL_ROWS, CELL_QUERIES = 16384, 4096

FOUND = "no long, query_id long, vec_id long, score long"


class Columns:
    """Candidates in vertical layout, the dimensions with the largest mass first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.dims = ids, vectors.shape[1]
        mass = (vectors.astype(np.float64) ** 2).sum(axis=0)
        self.order = np.argsort(-mass, kind="stable")
        self.edges = list(range(0, self.dims, BLOCK_DIMS)) + [self.dims]
        self.blocks = [np.ascontiguousarray(vectors[:, self.order[a:b]]) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        self.rest = self._rest([b.astype(np.float64) for b in self.blocks])

    @staticmethod
    def _rest(blocks: list[np.ndarray]) -> list[np.ndarray]:
        """The norm of what follows each block."""
        squares = [np.zeros(len(blocks[0]))]
        for b in reversed(blocks[1:]):
            squares.append(squares[-1] + (b * b).sum(axis=1))
        return [np.sqrt(s) for s in reversed(squares)]

    def top(self, query: np.ndarray, own: int | None, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best, ties to the smaller id; own: an id that takes no part; least: a score that k
        candidates elsewhere reach, so that lower ones need not be found."""
        query = query[self.order]
        parts = [query[a:b] for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        after = [float(x[0]) for x in self._rest([p[None].astype(np.float64) for p in parts])]
        alive = np.flatnonzero(self.ids != own) if own is not None else np.arange(len(self.ids))
        score = np.zeros(len(alive), np.int64)
        for j, part in enumerate(parts):
            block = self.blocks[j] if len(alive) == len(self.ids) else self.blocks[j][alive]
            score = score + block @ part
            if j + 1 < len(parts) and (len(alive) > k or least is not None):
                slack = np.ceil(self.rest[j][alive] * after[j] * (1 + 1e-9)) + 1
                low = score - slack
                bound = -np.inf if least is None else least
                if len(alive) > k:
                    bound = max(bound, np.partition(low, len(low) - k)[len(low) - k])
                stay = score + slack >= bound
                if not stay.all():
                    alive, score = alive[stay], score[stay]
        best = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive][best], score[best]


def _whole(column: str):
    return F.transform(F.col(column), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and the whole-number vector of all rows that take part: no null id, vector or component, all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", finite)).select("vec_id", _whole("embedding").alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """queries and candidates: vec_id long, v array<long>. Returns query_id, rank, vec_id, score.

    A row's own id is no candidate of it. Vectors of another length than the query's are none either. Every row is a
    candidate, also one that repeats another; a query that repeats is asked once, and an id with several vectors has the
    best of them all. Scores must fit 64 bits; a table whose vectors could go beyond raises an error. Empty tables give an
    empty result. Queries are dealt to cells of candidates in blocks, and candidates to cells by a number of their own,
    so that alike rows fill no cell: a query meets every cell once and brings back its k best there, so what is shuffled
    is queries times cells, not pairs. One cell is searched ahead of the others; where it has k candidates for a query,
    the k-th score bounds the search of all other cells.
    """
    queries = queries.dropDuplicates(["vec_id", "v"]).withColumn("no", F.monotonically_increasing_id())
    table = stored(candidates.withColumn("no", F.monotonically_increasing_id()), "candidates")
    asked = stored(queries, "queries")
    _check_range(table)
    n, n_asked = table.count(), asked.count()
    cells, blocks = max(1, -(-n // CELL_ROWS)), max(1, -(-n_asked // CELL_QUERIES))
    # As many cells as there are tasks to fill, while a cell still has a few thousand candidates.
    cells = max(cells, min(table.sparkSession.sparkContext.defaultParallelism, -(-n // 2048)))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = table.select(F.size("v").alias("dims"), F.pmod(F.xxhash64("no"), F.lit(cells)).cast("int").alias("cell"), numbers(blocks).alias("block"), "vec_id", "v")
    right = asked.select(F.size("v").alias("dims"), numbers(cells).alias("cell"), F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("block"), "no", "vec_id", "v")
    key = ["dims", "cell", "block"]

    def search(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(rows) and len(wanted):
            columns = Columns(rows["vec_id"].to_numpy(np.int64), _matrix(rows["v"]))
            least = [None if pd.isna(x) else int(x) for x in wanted["least"]]
            for no, q, v, bound in zip(wanted["no"].tolist(), wanted["vec_id"].tolist(), _matrix(wanted["v"]), least, strict=True):
                ids, score = columns.top(v, q, k, bound)
                found.append((np.full(len(ids), no), np.full(len(ids), q), ids, score))
        names = ("no", "query_id", "vec_id", "score")
        if not found:
            return pd.DataFrame({c: [] for c in names}).astype("int64")
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(names, zip(*found, strict=True), strict=True)})

    def met(some: str, wanted: DataFrame) -> DataFrame:
        return left.where(some).groupBy(*key).cogroup(wanted.where(some).groupBy(*key)).applyInPandas(search, FOUND)

    out = met("cell = 0", right.withColumn("least", F.lit(None).cast("long")))
    if cells > 1:
        ahead = stored(out, "ahead")
        bounds = ahead.groupBy("no").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).drop("n")
        out = ahead.unionByName(met("cell > 0", right.join(bounds, "no", "left")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _check_range(table: DataFrame) -> None:
    """An error if the product of two of these vectors could leave 64 bits."""
    most = table.select(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))).alias("x"), F.size("v").alias("n")).agg(F.max("x"), F.max("n")).first()
    if most[0] is not None and most[0] * most[0] * most[1] >= 2.0**62:
        raise ValueError("components are too large: scores could leave 64 bits")


def _matrix(column: pd.Series) -> np.ndarray:
    rows = column.to_numpy()
    return np.concatenate(rows).astype(np.int64).reshape(len(rows), -1) if len(rows[0]) else np.zeros((len(rows), 0), np.int64)


def top_k_embeddings(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by `every`, among all other rows."""
    rows = usable(embeddings)
    return top_k(rows.where(F.pmod("vec_id", F.lit(every)) == 0), rows, k)
