"""Hard negatives by zone maps over Hilbert-ordered blocks.

Rows are sorted by label and by the place of their leading directions on a Hilbert curve, and cut into
Parquet blocks, each with the least and the greatest value of every dimension (in a rotated basis,
which leaves inner products as they are) and of its labels: its zone map. Interval arithmetic gives
for an anchor and a block bounds of all inner products there, so that an anchor reads only the blocks
that may hold a row of one of its windows: first the two most promising ones, whose scores then rule
out others. Once for the positives, once for the negatives. Anchors go in groups of neighbours, so that
a block meets a matrix of anchors. The result is exact; the rotation, fitted on a bounded sample, and
the order change only what is read.

Edges: rows without an id, a label or a vector, or with a null or non-finite component, take no part;
shorter vectors than the longest count as padded by zeros; of anchors that repeat an id the one with
the least label and vector is asked; a vec_id comes once in a list, with its best score; scores
beyond a long are kept at its ends. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, remove, scratch, stored
from .vectors import HELD_LISTS, Best, best_of, chunks, finite, matrix

C = F.col
#: Rows of a block, anchors of a group, blocks whose zones are compared at once.
BLOCK_ROWS, GROUP_ROWS, PAGE_BLOCKS = 1_024, 256, 512
#: Rows on which the rotation and the grid of the curve are fitted, first by a hash of the id.
FIT_ROWS = 4_096
#: Leading directions on the curve, and bits of each.
CURVE_DIMS, CURVE_BITS = 6, 5
#: Blocks that an anchor reads first.
FIRST_BLOCKS = 2
LOW, HIGH = -(2**63), 2**63 - 1
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of points of a grid (rows of whole numbers below 2**bits), by
    Skilling's transposition (2004)."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[:, i] & q) > 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(flip, p, swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[:, -1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def coded(x: np.ndarray) -> bytes:
    """Whole numbers as 16-bit integers where they fit, else as doubles."""
    return x.astype("<i2").tobytes() if not len(x) or np.abs(x).max() < 2**15 else x.astype("<f8").tobytes()


def decoded(raw: bytes, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * dims * rows else "<f8").astype(float).reshape(rows, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while every sum is below 2**53, beyond that in
    Python's integers, kept within a long."""
    if (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: [[int(v) for v in row] for row in m]
    left, right = whole(a), whole(b)
    return np.array([[max(LOW + 1, min(HIGH, sum(p * q for p, q in zip(u, v, strict=True)))) for v in right] for u in left], np.int64)


def keyed(rows: DataFrame, dims: int, scale: float, rotation: np.ndarray, grid: np.ndarray) -> DataFrame:
    """label, key (place on the curve), vec_id, x (whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * matrix(batch.column("v"), dims))
            lead = x @ rotation[:, : len(grid)]
            cells = np.column_stack([np.searchsorted(edges, lead[:, i]) for i, edges in enumerate(grid)])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(hilbert(cells, CURVE_BITS)), batch.column("vec_id"), pa.array([coded(row) for row in x], pa.binary())], names=["label", "key", "vec_id", "x"])

    return rows.mapInArrow(run, "label long, key long, vec_id long, x binary")


def blocked(rows: DataFrame, dims: int, rotation: np.ndarray, size: int) -> DataFrame:
    """Sorted rows in blocks with their zone maps. The id is a part of the order, so that copies of one
    vector spread over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for k, t in enumerate(chunks(batches, size)):
            x = np.stack([decoded(raw, dims, 1)[0] for raw in t.column("x").to_pylist()])
            labels, ids, y = t.column("label").to_numpy(), t.column("vec_id").to_numpy(), x @ rotation
            one = [at + k, len(ids), int(labels.min()), int(labels.max()), ids.tobytes(), labels.tobytes(), coded(x), y.min(0).tobytes(), y.max(0).tobytes(), float(np.sqrt((y * y).sum(1)).max())]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCK, one, strict=True))], schema=BLOCK_ARROW)

    return rows.repartitionByRange("label", "key", "vec_id").sortWithinPartitions("label", "key", "vec_id").mapInArrow(run, BLOCK_SCHEMA)


BLOCK_SCHEMA = "block long, n int, least_label long, most_label long, ids binary, labels binary, x binary, least binary, most binary, norm double"
BLOCK = [c.split(" ")[0] for c in BLOCK_SCHEMA.split(", ")]
BLOCK_ARROW = pa.schema([(c.split(" ")[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}[c.split(" ")[1]]) for c in BLOCK_SCHEMA.split(", ")])
PAGE_SCHEMA = "page long, zones binary, labels binary, least binary, most binary"
#: What an anchor looks for: inner products from `low` to `high`, of which `best` is the least that still counts.
STATE = "array<struct<member:int,part:int,low:long,high:long,best:long>>"


def paged(blocks: DataFrame) -> tuple[DataFrame, int]:
    """Zone maps of many blocks in a row, and the number of page keys, over which pages are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, PAGE_BLOCKS):
            flat = lambda c: b"".join(t.column(c).to_pylist())  # noqa: B023, E731
            zones = np.column_stack([t.column("block").to_numpy(), t.column("n").to_numpy()]).astype(np.int64)
            labels = np.column_stack([t.column("least_label").to_numpy(), t.column("most_label").to_numpy()]).astype(np.int64)
            norms = np.asarray(t.column("norm").to_numpy(), float)
            yield pa.RecordBatch.from_arrays([pa.array([int(zones[0, 0])]), pa.array([zones.tobytes()], pa.binary()), pa.array([labels.tobytes() + norms.tobytes()], pa.binary()), pa.array([flat("least")], pa.binary()), pa.array([flat("most")], pa.binary())], names=["page", "zones", "labels", "least", "most"])

    count = blocks.count()
    keys = max(1, -(-count // PAGE_BLOCKS))
    narrow = blocks.select("block", "n", "least_label", "most_label", "norm", "least", "most")
    made = narrow.repartitionByRange(keys, "block").sortWithinPartitions("block").mapInArrow(run, PAGE_SCHEMA)
    return cut(made.withColumn("page_key", F.pmod(F.xxhash64("page"), F.lit(keys)))), keys


def bounds(y: np.ndarray, least: np.ndarray, most: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval arithmetic: the least and the greatest inner product of each anchor (row of y) with any
    row of each block, widened by what rounding may have taken off."""
    up, down = np.maximum(y, 0), np.minimum(y, 0)
    own = np.sqrt((y * y).sum(1))[:, None] * norms[None, :]
    slack = 1e-9 * own + 1e-6
    high = np.minimum(up @ most.T + down @ least.T, own) + slack
    low = np.maximum(up @ least.T + down @ most.T, -own) - slack
    return np.clip(low, LOW, HIGH), np.clip(high, LOW, HIGH)  # scores are kept within a long


def chosen_blocks(groups: DataFrame, pages: DataFrame, keys: int, dims: int, rotation: np.ndarray, same: bool, first: int | None) -> DataFrame:
    """(group, block, members): the anchors of a group that must read a block for what they look for;
    with `first`, only the most promising blocks of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, own = decoded(row["x"], dims, row["n"]), np.frombuffer(row["own_labels"], np.int64)
                zones = np.frombuffer(row["zones"], np.int64).reshape(-1, 2)
                side = np.frombuffer(row["labels"], np.int64)[: 2 * len(zones)].reshape(-1, 2)
                norms = np.frombuffer(row["labels"][16 * len(zones) :])
                low, high = bounds(x @ rotation, *(np.frombuffer(row[c]).reshape(-1, dims) for c in ("least", "most")), norms)
                fits = (side[None, :, 0] <= own[:, None]) & (own[:, None] <= side[None, :, 1]) if same else (side[None, :, 0] != own[:, None]) | (side[None, :, 1] != own[:, None])
                need = np.zeros_like(fits)
                for s in row["state"]:
                    m = s["member"]
                    need[m] |= fits[m] & ~(high[m] < s["best"]) & ~(low[m] > s["high"])
                out = []
                if first:
                    for m in np.flatnonzero(need.any(1)):
                        open_blocks = np.flatnonzero(need[m])
                        for k in open_blocks[np.argsort(-high[m, open_blocks], kind="stable")[:first]]:
                            out.append((row["block"], int(zones[k, 0]), [int(m)], float(high[m, k])))
                else:
                    out = [(row["block"], int(zones[k, 0]), np.flatnonzero(need[:, k]).tolist(), 0.0) for k in np.flatnonzero(need.any(0))]
                g, b, m, h = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.list_(pa.int32())), pa.array(h, pa.float64())], names=["group", "block", "members", "high"])

    dealt = groups.select("block", "n", "x", C("labels").alias("own_labels"), "state", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))).alias("page_key"))
    found = dealt.join(pages, "page_key").drop("page_key", "page").mapInArrow(run, "group long, block long, members array<int>, high double")
    if not first:
        return found.select("group", "block", "members")
    rank = F.row_number().over(Window.partitionBy("group", "members").orderBy(C("high").desc(), "block"))
    return found.withColumn("rank", rank).where(C("rank") <= first).groupBy("group", "block").agg(F.flatten(F.collect_list("members")).alias("members"))


def read_blocks(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """(group, member, part, rank, id, cost) of the best k rows of each window in the blocks of `pairs`;
    the cost is the score with its sign changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)

        def out(at_least: int) -> Iterator[pa.RecordBatch]:
            for keys, costs, ids in best.drained(at_least):
                g, m, p = zip(*keys, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(m, pa.int32()), pa.array(p, pa.int32()), pa.array(ids, pa.int64()), pa.array(costs, pa.int64())], names=["group", "member", "part", "id", "cost"])

        for batch in batches:
            for row in batch.to_pylist():
                members = sorted(row["members"])
                place = {m: i for i, m in enumerate(members)}
                own_ids, own_labels = np.frombuffer(row["own_ids"], np.int64), np.frombuffer(row["own_labels"], np.int64)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                scores = products(decoded(row["own_x"], dims, len(own_ids))[members], decoded(row["x"], dims, len(ids)))
                for s in row["state"]:
                    m = s["member"]
                    if m not in place:
                        continue
                    line = scores[place[m]]
                    fits = (labels == own_labels[m]) if same else (labels != own_labels[m])
                    fits &= (ids != own_ids[m]) & (line >= max(s["low"], s["best"])) & (line <= s["high"])
                    best.add((row["group"], m, s["part"]), -line[fits], ids[fits])
                yield from out(HELD_LISTS)
        yield from out(1)

    held = groups.select(C("block").alias("group"), C("ids").alias("own_ids"), C("labels").alias("own_labels"), C("x").alias("own_x"), "state")
    held = F.broadcast(held) if groups.count() <= BROADCAST_ROWS // 4_000 else held
    rows = pairs.join(blocks.select("block", "ids", "labels", "x"), "block").join(held, "group").drop("block")
    found = rows.mapInArrow(run, "group long, member int, part int, id long, cost long")
    return cut(best_of(found, ["group", "member", "part"], k))


def members_of(groups: DataFrame) -> DataFrame:
    """(group, member, anchor_id) of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], names=["group", "member", "anchor_id"])

    return groups.select("block", "ids").mapInArrow(run, "group long, member int, anchor_id long")


def with_state(groups: DataFrame, state: DataFrame) -> DataFrame:
    """Groups with what their members look for; groups of which none looks for anything go. A group has
    at most GROUP_ROWS members."""
    held = state.groupBy(C("group").alias("block")).agg(F.collect_list(F.struct("member", "part", "low", "high", "best")).cast(STATE).alias("state"))
    return cut(groups.drop("state").join(held, "block"))


def searched(groups: DataFrame, state: DataFrame, blocks: DataFrame, pages: DataFrame, keys: int, dims: int, rotation: np.ndarray, same: bool, k: int) -> DataFrame:
    """The best k rows of each window of `state` (group, member, part, low, high): promising blocks first,
    then all that may still hold a better row."""
    state = cut(state.withColumn("best", C("low")))
    open_groups = with_state(groups, state)
    near = chosen_blocks(open_groups, pages, keys, dims, rotation, same, FIRST_BLOCKS)
    early = read_blocks(near, open_groups, blocks, dims, same, k)
    full = early.groupBy("group", "member", "part").agg(F.max(F.when(C("rank") == k, -C("cost"))).alias("kth"))
    told = state.drop("best").join(full, ["group", "member", "part"], "left").withColumn("best", F.greatest("low", F.coalesce("kth", "low"))).drop("kth")
    open_groups = with_state(groups, told)
    every = chosen_blocks(open_groups, pages, keys, dims, rotation, same, None)
    return read_blocks(every, open_groups, blocks, dims, same, k)


def rotation_of(rows: DataFrame, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Directions of falling variance and the curve's grid, of a bounded sample."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v").toArrow()
    x = np.floor(scale * matrix(sample.column("v"), dims))
    with np.errstate(over="ignore", invalid="ignore"):
        moments = np.nan_to_num(np.cov(x.T, bias=True).reshape(dims, dims), posinf=0.0, neginf=0.0)
    rotation = np.linalg.eigh(moments)[1][:, ::-1]
    lead = x @ rotation[:, : min(CURVE_DIMS, dims)]
    return rotation, np.quantile(lead, np.arange(1, 2**CURVE_BITS) / 2**CURVE_BITS, axis=0).T


def mine(df: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 5, least_percent: int = 80, scale: float = 256.0) -> DataFrame:
    """For each anchor and each of its best rows of the same label the best rows of another label that
    score from `least_percent` of the positive's score up to it. `df` has vec_id, label, embedding;
    components become floor(scale * c)."""
    spark = df.sparkSession
    rows = df.where(C("vec_id").isNotNull() & C("label").isNotNull() & finite(C("embedding"))).select(C("label").cast("long").alias("label"), C("vec_id").cast("long").alias("vec_id"), C("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dims = rows.agg(F.max(F.size("v"))).first()[0]
    if not dims:
        return spark.createDataFrame([], SCHEMA)
    rotation, grid = rotation_of(rows, dims, scale)
    folder = scratch(spark, "hard-negatives")
    blocks = stored(blocked(keyed(rows.drop("anchor"), dims, scale, rotation, grid), dims, rotation, BLOCK_ROWS), f"{folder}/blocks")
    once = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*")
    groups = stored(blocked(keyed(once, dims, scale, rotation, grid), dims, rotation, GROUP_ROWS), f"{folder}/groups")
    pages, keys = paged(blocks)

    anchors = cut(members_of(groups))
    look = anchors.select("group", "member", F.lit(0).alias("part"), F.lit(LOW + 1).alias("low"), F.lit(HIGH).alias("high"))
    near = searched(groups, look, blocks, pages, keys, dims, rotation, True, positives)
    near = near.select("group", "member", C("rank").alias("part"), C("id").alias("positive_id"), (-C("cost")).alias("positive_score"))
    share = F.ceil(C("positive_score").cast("decimal(20,0)") * least_percent / 100).cast("long")
    windows = near.where("positive_score >= 0").select("group", "member", "part", share.alias("low"), C("positive_score").alias("high"))
    found = searched(groups, windows, blocks, pages, keys, dims, rotation, False, negatives)

    out = found.select("group", "member", "part", "rank", C("id").alias("negative_id"), (-C("cost")).alias("negative_score")).join(near, ["group", "member", "part"]).join(anchors, ["group", "member"])
    out = cut(out.select("anchor_id", "positive_id", C("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
    remove(spark, folder)
    return out
