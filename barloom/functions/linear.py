"""Small least squares in columns: a Gram matrix by one aggregation, solved by sweeps.

The matrix of a group's sums of products is one array (row by row) in one row, whatever the group's length;
partial sums combine before the shuffle. Sweeping a column takes its part out of all others, so that
nested regressions come from one matrix by sweeping one column after the other: after each sweep the last
diagonal entry is the sum of squares that is left. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def gram(df: DataFrame, by: list[str], columns: list[Column], name: str = "gram") -> DataFrame:
    """By group the products' sums of all pairs of columns, as the symmetric matrix in one array, and the
    number n of rows. Rows with a null in a column must be left out before."""
    p = len(columns)
    named = df.select(*by, *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    sums = [F.sum(C(f"__x{i}") * C(f"__x{j}")).alias(f"__s{i}_{j}") for i in range(p) for j in range(i + 1)]
    g = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)
    return g.select(*by, "n", F.array(*[C(f"__s{max(i, j)}_{min(i, j)}") for i in range(p) for j in range(p)]).alias(name))


def swept(matrix: Column, k: Column, p: int) -> Column:
    """The matrix after sweeping row and column k. A pivot that is 0 beside the others' rounding (a column
    that the swept ones explain, or none) leaves the matrix as it is."""
    at = lambda i, j: F.get(matrix, (i * p + j).cast("int"))

    def entry(x: Column, place: Column) -> Column:
        i, j = F.floor(place / p).cast("int"), place % p
        d = at(k, k)
        return F.when((i == k) & (j == k), -1 / d).when(i == k, x / d).when(j == k, x / d).otherwise(x - at(i, k) * at(k, j) / d)

    return F.when(F.abs(at(k, k)) > 1e-12, F.transform(matrix, entry)).otherwise(matrix)


def swept_all(matrix: Column, count: Column, p: int) -> Column:
    """The matrix after sweeping columns 0 to count - 1."""
    steps = F.filter(F.sequence(F.lit(0), F.lit(p - 1)), lambda k: k < count)
    return F.aggregate(steps, matrix, lambda m, k: swept(m, k, p))


def left_over(matrix: Column, p: int) -> Column:
    """What is left of the last column's squares after each sweep, from none to all others swept."""
    start = F.struct(matrix.alias("m"), F.array(F.get(matrix, F.lit(p * p - 1))).alias("left"))

    def step(acc: Column, k: Column) -> Column:
        m = swept(acc["m"], k, p)
        return F.struct(m.alias("m"), F.concat(acc["left"], F.array(F.get(m, F.lit(p * p - 1)))).alias("left"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(p - 2)), start, step, lambda acc: acc["left"])
