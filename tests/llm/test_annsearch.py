import numpy as np
import pytest
from pyspark.sql import functions as F
from quillmill.llm import annsearch as A


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids.index(q)]) ** 2).sum(axis=1))
        near = sorted((dd, i) for dd, i in zip(d.tolist(), ids, strict=True) if i != q)[:k]
        out[q] = [(i, dd) for dd, i in near]
    return out


@pytest.fixture(scope="module", params=["sf0.01", "sf0.1"])
def table(request, spark):
    df = spark.read.parquet(f"/root/testdata/{request.param}/embeddings.parquet")
    rows = df.collect()
    return df, [r["vec_id"] for r in rows], np.array([list(r["embedding"]) for r in rows], np.float64)


def test_recall_and_exact_scores(table):
    df, ids, x = table
    want = brute(ids, x, [i for i in ids if i % 100 == 0], 10)
    got = {}
    for r in A.search_table(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    assert all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = dict(zip(ids, x, strict=True))
    for q, near in got.items():
        assert near == sorted(near, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(np.sqrt(((exact[q] - exact[i]) ** 2).sum()), rel=1e-12) for i, s in near)


def test_rotation_keeps_lengths_and_is_hadamard():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(7, 16))
    y = A.rotate(x, rng.choice((-1.0, 1.0), (3, 16)))
    assert np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1))
    e = A.rotate(np.eye(4), np.ones((1, 4)))
    assert np.allclose(np.abs(e), 0.5)
    assert np.allclose(e @ e.T, np.eye(4))


def test_few_rows_and_ties(spark):
    rows = [(k, [1.0, 0.0], "x", 1) for k in range(0, 5)]
    rows += [(k, v, "x", 1) for k, v in ((100, [0.0, 1.0]), (200, None), (300, [0.0, 0.0]), (400, [float("nan"), 1.0]), (500, [None, 1.0]), (None, [1.0, 1.0]), (700, [float("inf"), 1.0]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, dim int")  # clashing names
    got = A.search_table(df).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0] == [(0, k, k) for k in range(1, 5)] + [(0, 5, 100)]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [0, 1, 2, 3, 4]
    assert {r["query_id"] for r in got} == {0, 100}


def test_each_length_for_itself(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.2]), (100, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0])]
    got = A.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 2), (0, 1), (100, 3)]


def test_extreme_magnitudes(spark):
    rows = [(0, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [3e200, 0.0]), (3, [1.7e308, 0.0]), (100, [-1.7e308, 1.0]), (200, [1e-200, 0.0]), (201, [0.0, 1e-200])]
    got = A.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    of = lambda q: [(r["vec_id"], r["score"]) for r in got if r["query_id"] == q]
    assert [i for i, _ in of(0)] == [200, 201, 1, 2, 3, 100]
    assert of(0)[2][1] == pytest.approx(np.hypot(1e200, 1e200)) and of(0)[3][1] == pytest.approx(2e200)
    assert of(100)[-1] == (3, float("inf"))
    assert of(200)[0] == (201, pytest.approx(np.hypot(1e-200, 1e-200), rel=1e-12))


def test_repeated_ids_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (0, [1.0, 0.0]), (0, [0.0, 3.0]), (2, [0.0, 2.5])]
    got = A.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, pytest.approx(0.1)), (2, pytest.approx(0.5))]
    assert A.search_table(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_equal_vectors_keep_the_smallest_ids(spark):
    rows = [(k, [1.0, 2.0]) for k in range(500)] + [(7, [1.0, 2.0])] * 20 + [(k, [1.0, 2.5]) for k in range(500, 520)]
    got = A.search_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    near = {q: [r["vec_id"] for r in got.where(f"query_id = {q}").orderBy("rank").collect()] for q in (0, 100, 500)}
    assert near == {0: [*range(1, 11)], 100: [*range(10)], 500: [*range(501, 511)]}


def test_clustered_vectors_need_few_probes(spark):
    """Buckets grow with the rows; what is looked at is a small share where vectors have structure."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(300, 32))
    x = centres[rng.integers(300, size=6000)] + rng.normal(scale=0.15, size=(6000, 32))
    ids = list(range(6000))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = A.usable(df)
    index = A._calibrated(rows.where("vec_id % 100 = 0"), rows, 6000, 10, A.CrossPolytope())
    assert index.hashes == 2
    codes, _ = A.buckets(x, index.hashes, index.c)
    looked = np.zeros((60, 6000), bool)
    for t in range(index.c.tables):
        lists, _ = A.probed(x[::100], t, index.hashes, index.probes, index.c)
        for i in range(60):
            looked[i] |= np.isin(codes[:, t], lists[i])
    assert looked.mean() < 0.05
    want = brute(ids, x, range(0, 6000, 100), 10)
    got = A.search_table(df).collect()
    assert sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got) >= 0.9 * 600


def test_hot_direction_is_dealt_and_exact(spark):
    rng = np.random.default_rng(5)
    same = rng.normal(size=16)
    x = np.vstack([same + rng.normal(scale=1e-3, size=(1500, 16)), rng.normal(size=(500, 16))])
    ids = list(range(2000))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.search_table(df, c=A.CrossPolytope(part=100)).where(F.col("query_id") < 1500).collect()
    want = brute(ids, x, range(0, 1500, 100), 10)
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.95 * 150
