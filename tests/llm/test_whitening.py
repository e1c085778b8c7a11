import numpy as np
import pytest
from footfall.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def same_up_to_sign(a, b, tolerance):
    sign = np.sign((a * b).sum(axis=0))
    return np.abs(a * sign - b).max() < tolerance


def covariance(kind, m, rand):
    q = np.linalg.qr(rand.normal(size=(m, m)))[0]
    values = {
        "spread": rand.uniform(1, 1000, m),
        "steep": 10.0 ** np.linspace(6, -4, m),
        "near": 100 + 1e-3 * np.arange(m),
        "two": np.where(np.arange(m) % 2, 5.0, 7.0),
        "low": np.where(np.arange(m) < m // 3, rand.uniform(1, 9, m), 0),
    }[kind]
    a = (q * values) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("kind", ("spread", "steep", "near", "two", "low"))
@pytest.mark.parametrize("m", (1, 2, 3, 8, 64, 100))
def test_components(kind, m):
    a = covariance(kind, m, np.random.default_rng(m))
    values, vectors = whitening.components(a)
    size = np.abs(a).max() * m
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-13 * size + 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(m)).max() < 1e-12
    assert np.abs((vectors * values) @ vectors.T - a).max() < 1e-12 * size + 1e-300
    if kind == "spread" and m == 64:
        assert same_up_to_sign(vectors, np.linalg.eigh(a)[1][:, ::-1], 1e-9)


def test_diagonal_and_equal_values():
    for a in (np.diag([3.0, 1.0, 2.0]), np.eye(5) * 4, np.zeros((3, 3)), np.diag([1.0, 1.0, 1.0, 9.0]), np.array([[2.0, 1.0], [1.0, 2.0]])):
        values, vectors = whitening.components(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-14)
        assert np.allclose((vectors * values) @ vectors.T, a, atol=1e-14)


def test_polar_factor():
    rand = np.random.default_rng(2)
    a = covariance("spread", 20, rand) - 400 * np.eye(20)
    e, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar_factor(a) - (v * np.sign(e)) @ v.T).max() < 1e-12


def plain(rows):
    """The contract in numpy: id, component -> n, deviation, whitened, explained."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) and all(e is not None and np.isfinite(e) for e in v)]
    if not kept:
        return {}
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = centred @ vectors[:, :8] / np.sqrt(values[:8])
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    return [(i, n, int(d), row, values[:8] / values.sum()) for (i, _), d, row in zip(kept, deviation, z)]


def test_report_against_numpy(spark):
    rand = np.random.default_rng(4)
    scale = np.linspace(3, 0.1, 12)
    rows = [(i, (rand.normal(size=12) * scale).astype(np.float32).tolist(), 1) for i in range(300)]
    rows += [rows[0], (None, rows[1][1], 2), (900, None, 1), (901, [], 1), (902, [1.0] * 11 + [None], 1)]
    rows += [(903, [1.0] * 11 + [float("nan")], 1), (904, [1.0] * 11 + [float("-inf")], 1)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as id", "'x' as vector", "'x' as n", "'x' as length")
    want = plain([(r[0], r[1]) for r in rows])
    got = whitening.report(table.repartition(5)).toPandas().sort_values(["component", "vec_id", "deviation"])
    assert len(got) == 8 * len(want) == 8 * 302
    wanted = sorted(want, key=lambda r: (r[0] is None, r[0], r[2]))
    z = got["whitened"].to_numpy().reshape(8, -1).T
    assert same_up_to_sign(z, np.array([r[3] for r in wanted]), 1e-9)
    assert got["deviation"].tolist() == [r[2] for r in wanted] * 8
    assert set(got["n"]) == {302} and got["component"].tolist() == [k for k in range(1, 9) for _ in range(302)]
    assert np.allclose(got["explained"].to_numpy()[::302], wanted[0][4], rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_odd_tables(spark):
    def report(*rows):
        return [tuple(r) for r in whitening.report(spark.createDataFrame(rows, SCHEMA)).sort("vec_id", "component").collect()]

    assert report((1, None, 1)) == []
    assert whitening.report(spark.createDataFrame([], SCHEMA)).collect() == []
    # One vector, or equal ones, have no variance.
    assert report((1, [1.0, 2.0], 1)) == [(1, k, 1, 0, None, 0.0, 0.0) for k in (1, 2)]
    # The commonest length counts, of equally common ones the largest.
    assert {r[0] for r in report((1, [1.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 2.0], 1))} == {2, 3}
    assert {r[0] for r in report((1, [1.0], 1), (2, [1.0, 2.0], 1))} == {2}
    flat = report((1, [1.0, 5.0], 1), (2, [3.0, 5.0], 1))
    assert [abs(r[4]) if r[4] is not None else None for r in flat] == [1.0, None, 1.0, None]
    assert report((1, [1e30], 1), (2, [1.0], 1)) == [(2, 1, 1, 0, None, 0.0, 0.0)]


def test_deviation_beyond_64_bits():
    model = whitening.Whitening(3, np.array([3 * (1 << 40)]), np.array([1.0]), np.eye(1))
    assert model.deviation(np.array([[(1 << 40) + 1], [0]])) == [9, None]


def test_whole_table(spark):
    embeddings = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in embeddings.collect()])
    got = whitening.report(embeddings).toPandas().sort_values(["vec_id", "component"])
    want.sort(key=lambda r: r[0])
    assert same_up_to_sign(got["whitened"].to_numpy().reshape(-1, 8), np.array([r[3] for r in want]), 1e-8)
    assert got["deviation"].tolist() == [r[2] for r in want for _ in range(8)]
