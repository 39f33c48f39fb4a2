"""The k best of each query: of a block's scores, of all blocks that a task reads, and of all tasks' rows. All rank alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazmill.sources.shared import checkpointed

#: Bytes of queries that a task holds at once; more of them are searched in parts, one after another.
MOST_HELD = 64_000_000
#: Candidates beyond k for each query that a task gathers before it lets all but the best go.
SPARE = 200_000
#: More than the places that scores are rounded to can move them.
EDGE = 1e-8


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score (to nine places, so that sums in another order rank alike), then chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < k)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best finite scores, rounded as in top_k, then by id, so that ties at the edge of a block are kept alike."""
    keyed = np.round(score, 9)
    n = keyed.shape[1]
    least = np.partition(keyed, n - k, axis=1)[:, n - k] if n > k else np.full(len(keyed), -np.inf)
    row, column = np.nonzero((keyed >= least[:, None]) & np.isfinite(keyed))
    order = np.lexsort((ids[column], -keyed[row, column], row))
    row, column = row[order], column[order]
    within = np.arange(len(row)) - np.searchsorted(row, row)
    return row[within < k], column[within < k]


class Best:
    """The k best of n queries over all blocks that a task reads: what it holds grows with the queries, not with the blocks."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.most = k, n * k + SPARE
        #: No score below a query's floor can be among its best; it rises as candidates are found.
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: a row for each query number in of, a column for each id; scores that are not finite count for nothing."""
        fits = np.isfinite(score) & (score >= (self.floor[of] - EDGE)[:, None])
        many = np.flatnonzero(fits.sum(axis=1) > self.k)
        if len(many):
            order = ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1]
            row, column = best_of(np.where(fits[many], score[many], -np.inf), order, self.k)
            row = many[row]
            fits[many] = False
            self._keep(of[row], score[row, column], ids[column])
        row, column = np.nonzero(fits)
        self._keep(of[row], score[row, column], ids[column])

    def _keep(self, number: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if len(number):
            self.held.append((number, score, ids))
            self.size += len(number)
        if self.size > self.most:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query numbers, scores, ids) of the best so far."""
        if not self.held:
            return None
        number, score, ids = (np.concatenate(x) for x in zip(*self.held, strict=True))
        keyed = np.round(score, 9)
        order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1], -keyed, number))
        number, score, ids, keyed = number[order], score[order], ids[order], keyed[order]
        within = np.arange(len(number)) - np.searchsorted(number, number)
        last = within == self.k - 1
        self.floor[number[last]] = np.maximum(self.floor[number[last]], keyed[last])
        self.held = [(number[within < self.k], score[within < self.k], ids[within < self.k])]
        self.size = len(self.held[0][0])
        return self.held[0]

    def batch(self, asked: pa.Array, kind: pa.DataType) -> pa.RecordBatch:
        """query_id, chunk_id, score of the best so far; asked: the queries' ids by number."""
        found = self.total() or (np.zeros(0, np.int64), np.zeros(0), [])
        return pa.RecordBatch.from_arrays([asked.take(pa.array(found[0])), pa.array(found[2], kind), pa.array(found[1])], names=["query_id", "chunk_id", "score"])


def in_parts(queries: DataFrame, size_of: Callable[[int], int], search: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """What search finds for all queries, of which the driver and a task hold at most about MOST_HELD bytes at once; size_of: bytes of so many."""
    queries = checkpointed(queries)
    parts = max(1, -(-size_of(queries.count()) // MOST_HELD))
    if parts == 1:
        return search(queries.toArrow())
    number, out = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(parts)), None
    for i in range(parts):
        found = checkpointed(search(queries.where(number == i).toArrow()))
        out = found if out is None else out.unionByName(found)
    return out
