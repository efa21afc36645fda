"""Nearest neighbours by a forest of random-projection trees.

Trees are fitted on a bounded sample: a node parts its rows at the median of their projections on the
line through two of them. Every row of the table is put into its leaf of each tree, and leaves are
stored as blocks of bounded size, so that a leaf full of copies is many blocks. A query descends all
trees through one priority queue, which gives the leaves nearest to it in any tree, by the
smallest margin on the way to them, until they hold the budget of rows. The rows of those leaves are
ranked by their exact distance.

The budget is measured, not guessed: SAMPLE_QUERIES queries are also compared with all rows, and it is
the least number of popped rows at which the share RECALL of their true neighbours lies in popped leaves.
It follows the structure of the data: vectors in clusters need a few leaves, evenly spread ones in 64
dimensions about half of them.

Edges: rows without an id, and vectors that are null, zero or hold a null or non-finite component, take
no part; shorter vectors than the longest count as padded by zeros; a query that repeats an id is asked
once, with its least vector; a vec_id comes once in a query's list, with its smallest distance; a
distance beyond a double is infinite. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, scratch, stored
from .vectors import HELD_LISTS, Best, best_of, chunks, finite, matrix

C = F.col
TREES = 8
#: Rows that a leaf should hold; a tree has at most MOST_LEAVES, and FIT_PER_LEAF sampled rows for each.
LEAF_ROWS, MOST_LEAVES, FIT_PER_LEAF = 128, 2_048, 8
#: Rows on which trees are fitted, first by a hash of the id.
FIT_ROWS = MOST_LEAVES * FIT_PER_LEAF
BLOCK_ROWS, GROUP_ROWS = 512, 256
#: Queries by which the budget is measured, and the share of their neighbours that it must find.
SAMPLE_QUERIES, RECALL = 64, 0.95
SEED = 20
SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass
class Tree:
    """Inner nodes: unit normals, offsets and two children each; a child below 0 is the leaf -1 - child."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    leaves: int

    @staticmethod
    def fit(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
        normals, offsets, children, leaves = [], [], [], 0
        todo = [(np.arange(len(x)), depth, -1, 0)]
        while todo:
            rows, left, parent, side = todo.pop()
            cut_at = None
            if left and len(rows) > 1:
                a, b = x[rng.choice(rows, 2, replace=False)]
                size = np.linalg.norm(a - b)
                if 0 < size < np.inf:
                    line = (a - b) / size
                    p = x[rows] @ line
                    cut_at = (p.min() + np.median(p)) / 2 if np.median(p) == p.max() else np.median(p)
            if cut_at is None:
                me, leaves = -1 - leaves, leaves + 1
            else:
                me = len(offsets)
                normals.append(line)
                offsets.append(float(cut_at))
                children.append([0, 0])
                todo += [(rows[p > cut_at], left - 1, me, 1), (rows[p <= cut_at], left - 1, me, 0)]
            if parent >= 0:
                children[parent][side] = me
        shape = (len(offsets), x.shape[1])
        return Tree(np.array(normals).reshape(shape), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), leaves)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.offsets) else np.full(len(x), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = (x[inner] * self.normals[node]).sum(1) > self.offsets[node]
            at[inner] = self.children[node, right.astype(int)]
        return -1 - at


def popped(trees: list[Tree], margins: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue: by the smallest margin on the way there, greatest
    first. `margins` has a query's signed distance from each node's plane, by tree."""
    queue = [(-np.inf, t, 0 if len(tree.offsets) else -1) for t, tree in enumerate(trees)]
    heapq.heapify(queue)
    while queue:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            yield t, -1 - node
            continue
        d = float(margins[t][node])
        left, right = trees[t].children[node].tolist()
        heapq.heappush(queue, (max(worst, d), t, left))
        heapq.heappush(queue, (max(worst, -d), t, right))


def signed(trees: list[Tree], q: np.ndarray) -> list[np.ndarray]:
    return [np.nan_to_num(q @ tree.normals.T - tree.offsets) for tree in trees]


def leaf_blocks(rows: DataFrame, trees: list[Tree], dims: int, kind: str) -> DataFrame:
    """All rows in the leaves of all trees, in blocks (tree, leaf, n, ids, vectors). The id is a part of the
    order, so that a leaf of many copies spreads over tasks."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dims)
            raw = pa.array([row.astype(kind).tobytes() for row in x], pa.binary())
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaf_of(x).astype(np.int32)), batch.column("vec_id"), raw], names=["tree", "leaf", "vec_id", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, BLOCK_ROWS, ("tree", "leaf")):
            first = [t.column(c)[0].as_py() for c in ("tree", "leaf")]
            yield pa.RecordBatch.from_arrays([pa.array([first[0]], pa.int32()), pa.array([first[1]], pa.int32()), pa.array([t.num_rows], pa.int32()), pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()), pa.array([b"".join(t.column("v").to_pylist())], pa.binary())], names=["tree", "leaf", "n", "ids", "vectors"])

    routed = rows.mapInArrow(route, "tree int, leaf int, vec_id long, v binary")
    return routed.repartitionByRange("tree", "leaf", "vec_id").sortWithinPartitions("tree", "leaf", "vec_id").mapInArrow(pack, "tree int, leaf int, n int, ids binary, vectors binary")


def ranked_rows(best: Best, q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
    """Puts the rows near each query on its list. A product of matrices tells which rows can be among the
    best; their distance is then taken from the differences."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares, mine = (x * x).sum(1), (q * q).sum(1)
        rough = mine[:, None] + squares[None, :] - 2 * (q @ x.T)
        slack = 1e-9 * (mine + squares.max())
        for i, query in enumerate(own.tolist()):
            had = best.lists.get((query,))
            near = ids != query
            if had is not None and len(had[0]) == best.k:
                near &= ~(rough[i] > had[0][-1] ** 2 + slack[i])
            if near.any():
                apart = x[near] - q[i]
                best.add((query,), np.sqrt((apart * apart).sum(1)), ids[near])


def listed(best: Best, at_least: int) -> Iterator[pa.RecordBatch]:
    for keys, costs, ids in best.drained(at_least):
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array(ids, pa.int64()), pa.array(costs, pa.float64())], names=["query_id", "id", "cost"])


LISTED = "query_id long, id long, cost double"


def exact_neighbours(blocks: DataFrame, own: np.ndarray, q: np.ndarray, dims: int, kind: str, k: int) -> DataFrame:
    """The nearest rows of a few queries among all rows: one pass over the leaves of one tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for raw_ids, raw in zip(batch.column("ids").to_pylist(), batch.column("vectors").to_pylist(), strict=True):
                ids = np.frombuffer(raw_ids, np.int64)
                ranked_rows(best, q, own, np.frombuffer(raw, kind).reshape(len(ids), dims).astype(float), ids)
        yield from listed(best, 1)

    return best_of(blocks.where("tree = 0").select("ids", "vectors").mapInArrow(run, LISTED), ["query_id"], k)


def measured_budget(rows: DataFrame, queries: DataFrame, blocks: DataFrame, trees: list[Tree], sizes: list[np.ndarray], dims: int, kind: str, k: int, recall: float) -> int:
    """The rows that must be popped for the share `recall` of the sample queries' true neighbours."""
    asked = queries.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE_QUERIES).toArrow()
    own, q = asked.column("vec_id").to_numpy(), matrix(asked.column("v"), dims)
    truth = cut(exact_neighbours(blocks, own, q, dims, kind, k))
    wanted = truth.select("query_id", C("id").alias("vec_id"))
    found = rows.join(F.broadcast(wanted), "vec_id").select("query_id", "vec_id", "v").limit(4 * SAMPLE_QUERIES * k).toArrow()  # more only where ids repeat
    near, of = matrix(found.column("v"), dims), found.column("query_id").to_numpy()
    codes = [tree.leaf_of(near) for tree in trees]
    margins, need = signed(trees, q), []
    for i, query in enumerate(own.tolist()):
        sought: dict[tuple[int, int], list[int]] = {}
        for row in np.flatnonzero(of == query).tolist():
            for t in range(len(trees)):
                sought.setdefault((t, int(codes[t][row])), []).append(row)
        held, left = 0, {row for rows_of in sought.values() for row in rows_of}
        for t, leaf in popped(trees, [m[i] for m in margins]):
            if not left:
                break
            held += int(sizes[t][leaf])
            for row in sought.get((t, leaf), ()):
                if row in left:
                    left.remove(row)
                    need.append(held)
    least = len(trees) * (k + 1)  # a row is in one leaf of each tree, so that k others are there in any case
    return max(least, int(np.quantile(need, recall, method="higher"))) if need else least


def asked_leaves(queries: DataFrame, trees: list[Tree], sizes: list[np.ndarray], budget: int, dims: int, kind: str) -> DataFrame:
    """(tree, leaf, asked ids, asked vectors): groups of queries by the leaves they pop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, GROUP_ROWS):
            q, own = matrix(t.column("v"), dims), t.column("vec_id").to_numpy()
            margins, asked = signed(trees, q), {}
            for i in range(len(q)):
                held = 0
                for tree, leaf in popped(trees, [m[i] for m in margins]):
                    if sizes[tree][leaf]:
                        asked.setdefault((tree, leaf), []).append(i)
                        held += int(sizes[tree][leaf])
                    if held >= budget:
                        break
            keys = list(asked)
            for start in range(0, len(keys), 256):
                part = keys[start : start + 256]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.int32()), pa.array([own[asked[k]].tobytes() for k in part], pa.binary()), pa.array([q[asked[k]].astype(kind).tobytes() for k in part], pa.binary())], names=["tree", "leaf", "own", "q"])

    return queries.mapInArrow(run, "tree int, leaf int, own binary, q binary")


def nearest(df: DataFrame, is_query: Column, *, k: int = 10, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by Euclidean distance. `df` has
    vec_id and embedding."""
    spark = df.sparkSession
    kind = "<f4" if dict(df.dtypes)["embedding"] == "array<float>" else "<f8"
    some = F.exists("embedding", lambda c: c != 0)
    rows = df.where(C("vec_id").isNotNull() & finite(C("embedding")) & some).select(C("vec_id").cast("long").alias("vec_id"), C("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow().column("v"), dims)
    leaves = min(-(-n // LEAF_ROWS), MOST_LEAVES, max(1, len(sample) // FIT_PER_LEAF))
    rng = np.random.default_rng(SEED)
    with np.errstate(over="ignore", invalid="ignore"):
        forest = [Tree.fit(sample, int(np.ceil(np.log2(leaves))), rng) for _ in range(trees)]

    folder = scratch(spark, "neighbours")
    blocks = stored(leaf_blocks(rows.drop("asked"), forest, dims, kind), folder)
    sizes = [np.zeros(tree.leaves, np.int64) for tree in forest]
    for tree, leaf, held in blocks.groupBy("tree", "leaf").agg(F.sum("n")).collect():  # at most TREES * MOST_LEAVES rows
        sizes[tree][leaf] = held
    queries = cut(rows.where("asked").groupBy("vec_id").agg(F.min("v").alias("v")))
    budget = measured_budget(rows.drop("asked"), queries, blocks, forest, sizes, dims, kind, k, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                own, ids = np.frombuffer(row["own"], np.int64), np.frombuffer(row["ids"], np.int64)
                ranked_rows(best, np.frombuffer(row["q"], kind).reshape(len(own), dims).astype(float), own, np.frombuffer(row["vectors"], kind).reshape(len(ids), dims).astype(float), ids)
                yield from listed(best, HELD_LISTS)
        yield from listed(best, 1)

    asked = asked_leaves(queries, forest, sizes, budget, dims, kind)
    found = asked.join(blocks.drop("n"), ["tree", "leaf"]).select("own", "q", "ids", "vectors").mapInArrow(run, LISTED)
    out = cut(best_of(found, ["query_id"], k).select("query_id", C("rank").cast("int").alias("rank"), C("id").alias("vec_id"), C("cost").alias("score")))
    remove(spark, folder)
    return out
