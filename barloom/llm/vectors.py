"""Vectors in blocks: decoding, cutting sorted rows into blocks, and keeping the best few of many.

A block is one row of a table: ids, and vectors as one binary matrix. It holds a bounded number of
rows, so that a task works on one bounded matrix at a time however many rows share a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Lists that a task keeps before it hands them on; the final merge is Spark's.
HELD_LISTS = 20_000


def finite(vector: Column) -> Column:
    """True where a vector is there and none of its components is null, infinite or not a number."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors are padded by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten(), float)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def chunks(batches: Iterator[pa.RecordBatch], rows: int, pure: tuple[str, ...] = ()) -> Iterator[pa.Table]:
    """Sorted rows in tables of at most `rows` rows, in each of which the `pure` columns are constant."""
    held: list[pa.RecordBatch] = []
    count, key = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in pure]
        turns = np.zeros(batch.num_rows, bool)
        for c in columns:
            turns[1:] |= c[1:] != c[:-1]
        ends = [*np.flatnonzero(turns).tolist(), batch.num_rows]
        start = 0
        for end in ends:
            now = tuple(c[start] for c in columns)
            if held and now != key:
                yield pa.Table.from_batches(held)
                held, count = [], 0
            key = now
            while start < end:
                take = min(rows - count, end - start)
                held.append(batch.slice(start, take))
                count, start = count + take, start + take
                if count == rows:
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def least(costs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least costs of different ids, ties by smaller id."""
    if len(costs) > 4 * k:
        edge = np.partition(costs, 2 * k - 1)[2 * k - 1]
        near = costs <= edge
        if len(np.unique(ids[near])) >= k:
            costs, ids = costs[near], ids[near]
    order = np.lexsort((ids, costs))
    costs, ids = costs[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return costs[first], ids[first]


class Best:
    """For each key the k least costs so far."""

    def __init__(self, k: int) -> None:
        self.k, self.lists = k, {}

    def add(self, key: tuple, costs: np.ndarray, ids: np.ndarray) -> None:
        if not len(costs):
            return
        had = self.lists.get(key)
        if had is not None:
            if len(had[0]) == self.k and costs.min() > had[0][-1]:
                return
            costs, ids = np.concatenate([had[0], costs]), np.concatenate([had[1], ids])
        self.lists[key] = least(costs, ids, self.k)

    def drained(self, at_least: int = 1) -> Iterator[tuple[list[tuple], np.ndarray, np.ndarray]]:
        """Keys (repeated), costs and ids of all lists, once there are so many."""
        if len(self.lists) >= at_least:
            keys = [key for key, (c, _) in self.lists.items() for _ in range(len(c))]
            yield keys, np.concatenate([c for c, _ in self.lists.values()]), np.concatenate([i for _, i in self.lists.values()])
            self.lists = {}


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """Of each list the k least costs of different ids, with their rank from 1. Tasks hand on k rows of a
    list at most, and Spark keeps k of each before it shuffles, so that no list is gathered."""
    once = found.groupBy(*by, "id").agg(F.min("cost").alias("cost"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("cost", "id"))
    return once.withColumn("rank", rank).where(C("rank") <= k)
