"""Operators on embeddings against brute force, with odd rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import hard_negatives, neighbours, queries, vectors, whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"
#: Extra columns whose names are used inside.
EXTRA = "vec_id long, embedding array<double>, label int, id long, cost double, x string, key string, block long, rank int, v string"


def cloud(n: int, dims: int, seed: int = 1) -> list[tuple]:
    """Clusters, a third of all rows being copies of one vector, and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, dims))
    x[: n // 3] = x[0]
    order = rng.permutation(n)
    return [(int(i), [float(v) for v in x[k]], int(rng.integers(0, 4))) for i, k in enumerate(order)]


def odd(dims: int) -> list[tuple]:
    one = [0.25] * dims
    return [(None, one, 1), (100_000, None, 1), (100_100, [None] + one[1:], 1), (100_200, [float("nan")] + one[1:], 1), (100_300, [float("inf")] + one[1:], 1)]


def as_array(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def brute_negatives(rows: list[tuple], every: int, scale: float = 256.0) -> list[tuple]:
    ids, x, y = as_array(rows)
    x = np.floor(scale * x).astype(np.int64)
    out = []
    for a in np.flatnonzero(ids % every == 0):
        score = x @ x[a]
        order = np.lexsort((ids, -score))
        for p in [i for i in order if y[i] == y[a] and i != a][:5]:
            fits = [i for i in order if y[i] != y[a] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:5]
            out += [(ids[a], ids[p], k + 1, ids[i], score[p], score[i]) for k, i in enumerate(fits)]
    return sorted(out)


def test_hilbert_curve_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (6, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        key = hard_negatives.hilbert(cells, bits)
        assert sorted(key) == list(range(len(cells)))
        walk = cells[np.argsort(key)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(2)
    y, blocks = rng.normal(size=(9, 7)), [rng.normal(size=(20, 7)) * s for s in (0.1, 1, 5)]
    low, high = hard_negatives.bounds(y, np.stack([b.min(0) for b in blocks]), np.stack([b.max(0) for b in blocks]), np.array([np.linalg.norm(b, axis=1).max() for b in blocks]))
    for k, b in enumerate(blocks):
        assert (low[:, k] <= (y @ b.T).min(1)).all() and ((y @ b.T).max(1) <= high[:, k]).all()


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "GROUP_ROWS", 7)
    monkeypatch.setattr(hard_negatives, "PAGE_BLOCKS", 5)
    rows = cloud(900, 8)
    df = spark.createDataFrame([(*r, 1, 2.0, "x", "k", 3, 4, "v") for r in rows + odd(8)] + [(100_400, [0.1] * 8, None, 1, 2.0, "x", "k", 3, 4, "v")], EXTRA)
    got = hard_negatives.mine(df, F.col("vec_id") % 30 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 30)


def test_zone_maps_save_reading(spark, monkeypatch):
    """In a table of clusters an anchor reads few of the blocks of other labels."""
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = 4 * rng.normal(size=(40, 8))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.05 * rng.normal(size=8)], i % 3) for i in range(4_000)]
    seen = []
    real = hard_negatives.read_blocks
    monkeypatch.setattr(hard_negatives, "read_blocks", lambda pairs, *a: seen.append(pairs.agg(F.sum(F.size("members"))).first()[0]) or real(pairs, *a))
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 200 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 200)
    anchors, blocks = 20, 80
    assert seen[3] < 0.3 * anchors * blocks


def test_negatives_of_huge_and_short_vectors(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1e30], 1), (2, [1e29, 0.0], 2), (3, [1e30, 5.0], 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert {r["positive_id"] for r in got} == {1} and {r["negative_id"] for r in got} == {2, 3}
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(0, [1.0], 1)], SCHEMA), F.lit(True)).count() == 0


def test_repeated_anchor_and_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (1, [1.0, 0.1], 1), (2, [0.9, 0.0], 2), (2, [0.9, 0.0], 2)]
    got = [tuple(r)[:4] for r in hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()]
    assert got == [(0, 1, 1, 2)]


def test_registered_negatives_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = queries.QUERIES["op11_hilbert_hard_negatives"](spark, SF)
    want = con.sql(queries.ORACLES["op11_hilbert_hard_negatives"])
    assert got.columns == want.columns and sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


def whitened_by_hand(rows: list[tuple], scale: float = 1024.0) -> tuple:
    ids, c, _ = as_array(rows)
    x = np.floor(scale * c).astype(np.int64) + 100_000
    n, total = len(x), x.sum(0)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    e, v = e[::-1], v[:, ::-1]
    return ids, ((n * x - total) ** 2).sum(1), (x - total / n) @ v[:, :8] / np.sqrt(e[:8]), e[:8] / e.sum()


@pytest.mark.parametrize("height", [16, 8_192])
def test_whitening_equals_a_local_one(spark, monkeypatch, height):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", height)
    rng = np.random.default_rng(3)
    spread = np.linspace(0.5, 2, 12)
    rows = [(i, [float(v) for v in rng.normal(size=12) * spread], 1) for i in range(700)]
    df = spark.createDataFrame([(*r, 1, 2.0, "x", "k", 3, 4, "v") for r in rows] + [(*r, 1, 2.0, "x", "k", 3, 4, "v") for r in odd(12)[1:]], EXTRA)
    out = whitening.whiten(df.repartition(5)).toPandas()
    ids, deviation, want, explained = whitened_by_hand(rows)
    wide = out.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert len(out) == 8 * len(rows) and set(out["n"]) == {700}
    assert (out[out["component"] == 1].set_index("vec_id").loc[ids, "deviation"].to_numpy() == deviation).all()
    for j in range(8):
        sign = np.sign(wide[:, j] @ want[:, j])
        assert np.allclose(sign * wide[:, j], want[:, j], rtol=0, atol=1e-9)
    assert np.allclose(out.groupby("component")["explained"].first(), explained, rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    assert np.allclose(wide.T @ wide / 700, np.eye(8), atol=1e-9)


def test_whitening_edges(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1), *odd(2)[1:]], SCHEMA)).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["identity_error"]) for r in one] == [(1, 0, None, None), (2, 0, None, None)]
    flat = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25], 1), (1, [1.5, 0.25], 1), (2, [0.5], 1), (3, [1e30, -1e300], 1)], SCHEMA)).collect()
    assert len(flat) == 8 and {r["n"] for r in flat} == {4}


def brute_nearest(rows: list[tuple], every: int, k: int = 10) -> dict:
    ids, x, _ = as_array(rows)
    out = {}
    for a in np.flatnonzero(ids % every == 0):
        apart = np.sqrt(((x - x[a]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != ids[a]][:k]
        out[int(ids[a])] = [(int(ids[i]), float(apart[i])) for i in order]
    return out


def neighbour_lists(df) -> dict:
    got: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def test_forest_finds_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 9)
    rows = cloud(1_500, 12)
    df = spark.createDataFrame([(*r, 1, 2.0, "x", "k", 3, 4, "v") for r in rows + odd(12)] + [(100_500, [0.0] * 12, 1, 1, 2.0, "x", "k", 3, 4, "v")], EXTRA)
    got, want = neighbour_lists(neighbours.nearest(df, F.col("vec_id") % 25 == 0)), brute_nearest(rows, 25)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    exact = {q: dict(v) for q, v in brute_nearest(rows, 25, len(rows)).items()}
    assert all(abs(exact[q][i] - s) < 1e-12 for q, v in got.items() for i, s in v)
    hit = sum(min(s for _, s in want[q][-1:]) >= s - 1e-12 for q, v in got.items() for _, s in v)
    assert hit >= 0.93 * 10 * len(want)


def test_forest_in_clusters_reads_little(spark, monkeypatch):
    """The measured budget follows the data: of clustered rows a small part is read."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 20)
    rng = np.random.default_rng(8)
    centres = 5 * rng.normal(size=(50, 16))
    rows = [(i, [float(v) for v in centres[i % 50] + 0.02 * rng.normal(size=16)], 1) for i in range(4_000)]
    seen = []
    real = neighbours.measured_budget
    monkeypatch.setattr(neighbours, "measured_budget", lambda *a: seen.append(real(*a)) or seen[-1])
    got, want = neighbour_lists(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 40 == 0)), brute_nearest(rows, 40)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in want.items()) >= 0.9 * 10 * len(want)
    assert seen[0] < 0.5 * neighbours.TREES * len(rows)


def test_forest_edges(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0], 1)], SCHEMA), F.lit(True)).count() == 0
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0], 1), (5, [2.0, 0.0], 1), (5, [9.0, 0.0], 1), (7, [1e300, 1e300], 1)]
    got = neighbour_lists(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0))
    assert got == {0: [(2, 0.0), (3, 0.0), (5, 1.0), (7, float("inf"))]}


def test_chunks_and_least():
    import pyarrow as pa

    made = [pa.RecordBatch.from_pydict({"k": [1, 1, 1, 2], "v": [1, 2, 3, 4]}), pa.RecordBatch.from_pydict({"k": [2, 2, 3], "v": [5, 6, 7]})]
    assert [t.column("v").to_pylist() for t in vectors.chunks(iter(made), 2, ("k",))] == [[1, 2], [3], [4, 5], [6], [7]]
    assert [t.num_rows for t in vectors.chunks(iter(made), 5)] == [5, 2]
    costs, ids = vectors.least(np.array([3.0, 1.0, 1.0, 2.0, 1.0]), np.array([7, 9, 4, 7, 9]), 3)
    assert costs.tolist() == [1.0, 1.0, 2.0] and ids.tolist() == [4, 9, 7]
