"""Whitening of embeddings by distributed block matrices.

Centred rows become an indexed row matrix and then a block matrix of MLlib; its transpose times itself
is the scatter, the only thing that comes to the driver (dimensions squared); a local eigen
decomposition gives the whitening matrix, by which the block matrix is multiplied. Rows stay in the
JVM all the way. A row's index is made of its partition and its place there, so that no global numbering
is needed; indices without a row are zero rows, which add nothing to the scatter.

Edges: vectors that are null or hold a null or non-finite entry go; shorter vectors than the longest
count as padded by zero components; rows that repeat an id are rows of their own; scaled values
are kept within +-10^12; a deviation beyond a long is null; components without variance have a null
`whitened`, and `identity_error` is null if there is no other. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array, array_to_vector
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, remove, scratch, stored
from .vectors import finite

C = F.col
#: Rows of a block, 64 dimensions being 4 MB. The driver holds a key of each block.
BLOCK_ROWS, MOST_BLOCK_ROWS, BLOCKS = 8_192, 65_536, 50_000
#: Scaled values are kept within this.
LARGEST = 1e12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * c) + shift of each component, as longs."""
    one = lambda c: (F.floor(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * scale))) + shift).cast("long")
    return F.transform(vector, one)


def sums(rows: DataFrame, dims: int) -> list[int]:
    """The exact sum of each dimension: longs within a partition, decimals over partitions."""
    parts = rows.groupBy(F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() / 1_000_000).alias("q")).agg(*[F.sum(C("x")[i]).alias(f"s{i}") for i in range(dims)])
    one = parts.agg(*[F.sum(C(f"s{i}").cast("decimal(20,0)")).alias(f"s{i}") for i in range(dims)]).first()
    return [int(v) for v in one]


def block_matrix(rows: DataFrame, count: int, dims: int, height: int) -> BlockMatrix:
    """Rows (index, array of doubles) as a block matrix."""
    vectors = rows.select(C("index").alias("index"), array_to_vector("centred").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), count, dims)
    return indexed.toBlockMatrix(height, dims)


def multiplied(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """The product; its inner dimension is spread over `splits` tasks, whose partial sums are then added
    (else a result of one block would be summed up in one task)."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def indexed_rows(product: BlockMatrix) -> DataFrame:
    """A block matrix as rows (index, array of doubles), in the JVM."""
    model = product.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    rows = callMLlibFunc("getIndexedRows", model)
    return rows.select("index", vector_to_array("vector").alias("projected"))


def whiten(df: DataFrame, *, scale: float = 1024.0, shift: int = 100_000, most: int = 8) -> DataFrame:
    """Of each row and component (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = df.sparkSession
    rows = df.where(finite(C("embedding"))).select("vec_id", scaled(C("embedding"), scale, shift).alias("x"))
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n or not dims:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.get("x", i), F.lit(shift).cast("long"))))
    folder = scratch(spark, "whitening")
    held = stored(rows.withColumn("at", F.monotonically_increasing_id()), folder)
    total = sums(held, dims)

    height = min(MOST_BLOCK_ROWS, max(BLOCK_ROWS, n // BLOCKS))
    part, place = F.shiftright("at", 33), C("at").bitwiseAND(F.lit((1 << 33) - 1))
    longest, parts = held.agg(F.max(place) + 1, F.max(part) + 1).first()
    per = -(-longest // 512) * 512
    of_sum = F.array(*[F.lit(s).cast("decimal(38,0)").cast("double") if abs(s) >= 2**63 else F.lit(s).cast("long") for s in total])
    apart = F.zip_with("x", of_sum, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s)) if all(abs(s) < 2**63 for s in total) else F.transform("x", lambda x: F.lit(None).cast("long"))
    mean = F.array(*[F.lit(s / n) for s in total])
    centred = F.transform(F.arrays_zip(apart.alias("a"), C("x").alias("x"), mean.alias("m")), lambda z: F.coalesce(z["a"] / F.lit(float(n)), z["x"] - z["m"]))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda acc, t: F.try_add(acc, F.try_multiply(t, t)))
    indexed = held.withColumn("index", part * F.lit(per).cast("long") + place)

    blocks = block_matrix(indexed.select("index", centred.alias("centred")), int(parts * per), dims, height)
    tall = -(-int(parts * per) // height)
    splits = min(tall, 2 * spark.sparkContext.defaultParallelism)
    scatter = multiplied(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    alive = values > max(values[0], 0.0) * 1e-12
    weights = np.where(alive, vectors / np.sqrt(np.where(alive, values, 1.0)), 0.0)
    k = weights.shape[1]
    local = DenseMatrix(dims, k, weights.T.ravel().tolist())
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dims, k)
    white = indexed_rows(multiplied(blocks, whitening))
    out = cut(indexed.select("index", "vec_id", deviation.alias("deviation")).join(white, "index").select("vec_id", "deviation", "projected"), 500_000)
    remove(spark, folder)

    live = [j for j in range(k) if alive[j]]
    w = lambda j: C("projected")[j]
    pairs = [(i, j) for i in live for j in live if i <= j]
    moments = out.agg(*[F.avg(w(j)) for j in live], *[F.avg(w(i) * w(j)) for i, j in pairs]).first() if live else ()
    mean_of = dict(zip(live, moments, strict=False))
    error = max((abs(v - mean_of[i] * mean_of[j] - (i == j)) for (i, j), v in zip(pairs, moments[len(live) :], strict=True)), default=None)
    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in np.maximum(values, 0.0)])
    shown = F.transform("projected", lambda v, j: F.when(F.get(F.array(*[F.lit(bool(a)) for a in alive]), j), v))
    long = out.select("vec_id", "deviation", F.posexplode(shown).alias("j", "whitened"))
    return long.select("vec_id", (C("j") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, C("j")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
