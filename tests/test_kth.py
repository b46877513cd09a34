"""k-th distances against sorted distances, and what leaves the tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.operators import knn, kth, ood


@pytest.fixture
def in_blocks(monkeypatch):
    """No base is small enough to travel."""
    monkeypatch.setattr(knn, "SMALL_BYTES", 0)


def brute(x, k, same=True):
    out = {}
    for i, row in enumerate(x):
        d = np.sort([((row - other) ** 2).sum() for j, other in enumerate(x) if j != i or not same])
        out[i] = d[k - 1] if k <= len(d) else None
    return out


def found(frame):
    return {r.query_id: r.dist for r in frame.collect()}


@pytest.mark.parametrize("k", [1, 7, 60, 250, 299])
def test_blocks_equal_sorted_distances(spark, vectors, in_blocks, k):
    df, x, _ = vectors
    got = found(kth.kth_nearest(df, df, k, exclude_self=True, block_rows=32))
    want = brute(x, k)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_small_base_one_block_and_many_agree(spark, vectors, monkeypatch):
    df, _, _ = vectors
    whole = found(kth.kth_nearest(df, df, 20))
    monkeypatch.setattr(knn, "SMALL_BYTES", 0)
    assert found(kth.kth_nearest(df, df, 20, block_rows=1000)) == whole
    assert found(kth.kth_nearest(df, df, 20, block_rows=16)) == whole
    assert found(kth.kth_nearest(df, df, 20, "cosine", block_rows=16)).keys() == whole.keys()


def test_copies_and_ties(spark, in_blocks):
    """A third of the rows are one vector, others lie on few distances."""
    x = np.array([[0.0, 0.0]] * 100 + [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0], [0.0, -1.0]] * 25 + [[float(i), 5.0] for i in range(100)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    for k in (3, 99, 100, 150, 260):
        assert found(kth.kth_nearest(df, df, k, exclude_self=True, block_rows=40)) == brute(x, k)


def test_fewer_rows_than_k(spark, vectors, in_blocks):
    df, _, _ = vectors
    few = df.filter("vec_id < 50")
    assert kth.kth_nearest(df, few, 51, block_rows=16).count() == 0
    scores = ood.ood_knn_score(df, few, 50, exclude_self=True, block_rows=16).collect()
    assert sum(r.score is None for r in scores) == 50 and len(scores) == 300


def test_about_k_numbers_a_query_leave_the_tasks(spark, in_blocks):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    queries, k, blocks = df.filter("id % 50 = 0"), 200, 40
    one = df.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == 0)
    kernel = lambda g, a, b: kth._kth_kernel(g, a, b, k=kth.sample_rank(k, blocks), metric="sq_l2", skip_same=False)
    bounds = kth.block_join(queries, one, kernel, kth.KTH, False, 1000)
    below = kth.below_bounds(queries, df, bounds, "sq_l2", False, 100)
    sent = below.groupBy("query_id").agg(F.sum(F.size("below")).alias("n"))
    # a search that sends the nearest k of every block sends all its 100 rows, from each of 40
    most = sent.agg(F.max("n")).first()[0]
    assert sent.count() == 80 and sent.agg(F.avg("n")).first()[0] < 1.25 * kth.sample_rank(k, blocks) * blocks < 1000 and most < 2500
    assert sent.filter(F.col("n") >= k).count() >= 78


# --- exact distances of listed pairs --------------------------------------------------------


@pytest.mark.parametrize("block_rows", [16384, 32, 5])
def test_listed_pairs_by_blocks(spark, vectors, block_rows):
    df, x, _ = vectors
    rng = np.random.default_rng(4)
    # row 0 is asked for by every query
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 300, (900, 2))} | {(i, 0) for i in range(300)})
    listed = spark.createDataFrame(pairs, "query_id bigint, neighbor_id bigint")
    got = {(r.query_id, r.neighbor_id): r.dist for r in knn.pair_distance(listed, df, df, block_rows=block_rows).collect()}
    assert got.keys() == set(pairs)
    assert all(abs(d - ((x[a] - x[b]) ** 2).sum()) < 1e-12 for (a, b), d in got.items())


def test_pairs_of_unknown_rows_have_no_distance(spark, vectors):
    df, _, _ = vectors
    listed = spark.createDataFrame([(1, 2), (1, 900), (900, 1)], "query_id bigint, neighbor_id bigint")
    assert [(r.query_id, r.neighbor_id) for r in knn.pair_distance(listed, df, df).collect()] == [(1, 2)]


def test_two_stages_in_blocks_agree_with_one(spark, vectors):
    from curvine.functions.hashing import sign_matrix

    df, x, _ = vectors
    matrix = sign_matrix(4, 8, 42)
    rows = lambda n: sorted(tuple(r) for r in knn.two_stage_knn_join(df, df, matrix, 6, exclude_self=True, block_rows=n).collect())
    assert rows(16384) == rows(40)
    low = x @ matrix.T
    want = []
    for i in range(300):
        rough = [j for _, j in sorted((((low[i] - low[j]) ** 2).sum(), j) for j in range(300) if j != i)[:12]]
        want += [(i, r + 1, j) for r, (_, j) in enumerate(sorted((((x[i] - x[j]) ** 2).sum(), j) for j in rough)[:6])]
    assert [r[:3] for r in rows(16384)] == sorted(want)
