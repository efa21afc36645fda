"""Helpers that several operators share: table reading, checkpoints, components, pieces of batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of the word operators: space and the control characters 09 to 0D.
SPACES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column has it (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    A machine-local folder is used only where the session names none and runs in one process, as in
    local tests; on a cluster a missing setting is an error, since executors could not see the folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-checkpoint-"))
    if named and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder; `remove` deletes it when its tables are used up."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again: cuts lineage, survives lost
    executors, and is read by columns."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder on whatever file system Spark wrote it to."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of narrow tables (a few longs each) that may be broadcast: 2 MB or so, several times that on the driver.
BROADCAST_ROWS = 50_000


def beside(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table with a narrow one: broadcast where that one's counted rows are few, by a shuffle
    (whose skewed partitions Spark splits) beyond it. `small` should come from `cut` or a shelf, which have counted it."""
    return big.join(F.broadcast(small) if rows_of(small) <= rows else small, on, how)


def cut(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """Reliable checkpoint in the shared folder: cuts lineage and survives lost executors. It is
    read back in parts of about `rows` rows, if it was written in more, so that a small table does
    not drag a large table's partitions through later shuffles."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    count = out.count()
    parts = max(8, -(-count // rows))
    out = out.coalesce(parts) if parts < out.rdd.getNumPartitions() else out
    out.counted_rows = count
    return out


class Shelf:
    """Tables of one call, in a folder of their own in the shared folder. Each is worked out once,
    written as Parquet and counted on the way, where `cut` works out its last stage twice and counts in a
    query of its own: the driver keeps a record of every stage. Spark does not clean up here: `clear` deletes
    all, after what is made of the tables is in a table elsewhere."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder, self.used = spark, scratch(spark, name), 0

    def put(self, df: DataFrame, where: str = "true") -> DataFrame:
        """The table, written and read again; it knows its rows and how many of them fulfil `where`."""
        seen, self.used = Observation(), self.used + 1
        path = f"{self.folder}/{self.used}"
        out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(where)).alias("found")), path)
        out.counted_rows, out.counted_found, out.path = seen.get["rows"], seen.get["found"], path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes one table that nothing reads any more."""
        remove(self.spark, df.path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


#: Bytes of text that a worker takes at once from a batch of Arrow.
PIECE_BYTES = 2_000_000


def pieces(texts: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Where to cut a batch of texts: (first row, number of rows), all rows in order, at least one and at
    most about `size` bytes at a time. Spark's batches hold up to 10,000 rows of any length; what a worker makes
    of one, and what the JVM has to take back at once, is bounded by a piece instead."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = int(upto[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(upto, before + size, "right")))
        yield first, last - first
        first = last


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the system: Spark keeps workers for later tasks
    and stages, and what the allocators of Arrow and C hold on to would count all that time."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def rows_of(df: DataFrame) -> int:
    """The number of rows; a table from `cut` or a shelf knows it."""
    known = getattr(df, "counted_rows", None)
    return df.count() if known is None else known


def release(spark: SparkSession) -> None:
    """Lets the driver collect garbage: Spark then removes shuffle and checkpoint files of tables
    that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, left: str = "a", right: str = "b", shelf: Shelf | None = None) -> DataFrame:
    """Connected components of an undirected edge table: (id, component), smallest id as label. Its tables
    are on the caller's shelf, if one is given.

    Hook-and-shortcut label propagation: each round hooks a node and its parent to the
    smallest parent among the neighbours, then jumps pointers, so that long chains halve.
    All steps are joins and partially aggregated minima; no neighbour list is gathered.
    Ids must not be null. Self loops and repeated edges are harmless.
    """
    spark = edges.sparkSession
    keep = shelf.put if shelf else cut
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v")
    both = keep(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    parts = max(1, both.rdd.getNumPartitions())
    small = lambda df: df.coalesce(parts)
    parent = keep(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("p")))
    # A node has one row in `parent`, in every round: where they are few, the hub of a star meets its
    # neighbours without a shuffle; beyond that Spark splits the hub's partition.
    few = rows_of(parent) <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if few else df
    while True:
        near = small(both.join(held(parent.withColumnRenamed("id", "u")), "u")).groupBy(F.col("v").alias("id")).agg(F.min("p").alias("m"))
        moved = small(parent.join(near, "id")).select("id", "p", F.least("p", "m").alias("m"))
        # A node keeps its last parent beside the new one, so that no join is needed to see what changed.
        both_ways = moved.select("id", "m", F.col("p").alias("was")).union(moved.select(F.col("p").alias("id"), "m", F.lit(None).cast("long")))
        hooked = small(both_ways.groupBy("id").agg(F.min("m").alias("p"), F.max("was").alias("was")))
        up = hooked.select(F.col("id").alias("p"), F.col("p").alias("g"))
        after = hooked.join(held(up), "p").select("id", F.col("g").alias("p"), "was")
        after = shelf.put(after, "p != was") if shelf else cut(after)
        changed = after.counted_found if shelf else after.where("p != was").limit(1).count()
        parent = after.select("id", "p")
        release(spark)
        if not changed:
            return parent.select("id", F.col("p").alias("component"))
