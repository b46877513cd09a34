import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.functions.hashing import sign_matrix
from curvine.operators import cluster, knn, lsh


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def brute(x, k, group=None, exclude_self=True):
    out = {}
    for i in range(len(x)):
        d = [(((x[i] - x[j]) ** 2).sum(), j) for j in range(len(x)) if (j != i or not exclude_self) and (group is None or group[i] == group[j])]
        out[i] = [j for _, j in sorted(d)[:k]]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["neighbor_id"])
    return out


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_knn_is_exact_at_any_block_size(vectors, block_rows):
    df, x, _ = vectors
    got = as_lists(knn.knn_join(df, df, 5, exclude_self=True, block_rows=block_rows))
    assert got == brute(x, 5)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_grouped_knn_with_a_hot_group(vectors, block_rows):
    df, x, label = vectors
    got = as_lists(knn.knn_join(df, df, 3, within="label", exclude_self=True, block_rows=block_rows))
    assert got == brute(x, 3, group=label)


def test_no_task_gets_more_than_two_blocks(vectors):
    """The hot label is spread over many tasks and none sees a whole group."""
    from curvine.plans.blocks import self_block_join

    df, _, _ = vectors
    rows = df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("g"))

    def size(group, first, second):
        import pyarrow as pa

        return pa.table({"g": [group], "n": [first.num_rows + (0 if second is None else second.num_rows)]})

    sizes = self_block_join(rows, size, "g bigint, n bigint", True, block_rows=10).collect()
    hot = [r["n"] for r in sizes if r["g"] == 0]
    assert len(hot) > 40 and max(hot) <= 60


def test_ties_go_to_the_smaller_id(spark):
    df = frame(spark, [(i, [1.0, 0.0], 0) for i in (9, 4, 7, 1)])
    got = as_lists(knn.knn_join(df, df, 2, exclude_self=True))
    assert got == {1: [4, 7], 4: [1, 7], 7: [1, 4], 9: [1, 4]}


def test_k_larger_than_base_gives_absent_rows_and_null_score(spark):
    df = frame(spark, [(0, [0.0], 0), (1, [1.0], 0), (2, [3.0], 0)])
    near = knn.knn_join(df, df, 10, exclude_self=True)
    assert near.count() == 6
    assert {r["score"] for r in knn.kth_distance(near, df, 10).collect()} == {None}


def test_zero_vector_has_cosine_distance_one(spark):
    df = frame(spark, [(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0)])
    rows = knn.knn_join(df, df, 1, "cosine", exclude_self=True).collect()
    assert [r["dist"] for r in rows] == [1.0, 1.0]


def test_ivf_with_all_probes_is_exact(vectors):
    df, x, _ = vectors
    centroids = cluster.sample_rows(df, 6)
    assert as_lists(knn.ivf_knn_join(df, df, centroids, 4, 6, exclude_self=True)) == brute(x, 4)


def test_ivf_empty_probe_is_answered_exactly(spark):
    base = frame(spark, [(0, [0.0], 0), (1, [1.0], 0)])
    queries = frame(spark, [(5, [100.0], 0)])
    centroids = spark.createDataFrame([(0, [0.5]), (1, [100.0])], "cid bigint, centroid array<double>")
    assert as_lists(knn.ivf_knn_join(queries, base, centroids, 1, 1)) == {5: [1]}


def test_ivf_recall_grows_with_probes(vectors):
    df, x, _ = vectors
    truth = brute(x, 5)
    centroids = cluster.sample_rows(df, 10)
    recall = []
    for probes in (1, 3, 10):
        got = as_lists(knn.ivf_knn_join(df, df, centroids, 5, probes, exclude_self=True))
        recall.append(np.mean([len(set(got.get(i, [])) & set(truth[i])) / 5 for i in truth]))
    assert recall[0] < recall[1] < recall[2] == 1.0 and recall[1] > 0.5


def test_lsh_fallback_fills_short_queries(vectors):
    df, x, _ = vectors
    planes = sign_matrix(6, 8, 1)
    got = as_lists(lsh.lsh_knn_join(df, df, 5, bucket=lambda d: lsh.by_all(lsh.sign_codes(d, planes, 6)), overlapping=False, exclude_self=True))
    assert all(len(v) == 5 for v in got.values()) and len(got) == len(x)


def test_all_copies_in_one_bucket(spark):
    """A bucket of identical rows: every row finds a partner and nothing is lost."""
    df = frame(spark, [(i, [1.0, 0.0], 0) for i in range(200)] + [(500, [0.0, 1.0], 0)])
    best = knn.max_similarity(df, within="label", block_rows=16)
    got = {r["vec_id"]: r["max_sim"] for r in best.collect()}
    assert len(got) == 201 and got[500] == 0.0 and all(got[i] == 1.0 for i in range(200))


def test_assign_by_join_equals_assign_by_array(vectors, monkeypatch):
    df, _, _ = vectors
    centroids = cluster.sample_rows(df, 12)
    small = knn.assign(df, centroids).select("vec_id", "cid", "cdist")
    monkeypatch.setattr(knn, "centroid_matrix", lambda *a, **k: None)
    large = knn.assign(df, centroids).select("vec_id", "cid", "cdist")
    assert sorted(small.collect()) == sorted(large.collect())


def test_forest_keeps_the_parts_at_every_threshold():
    rng = np.random.default_rng(0)
    n = 40
    i, j = np.triu_indices(n, 1)
    w = rng.random(len(i))
    a, b, fw = kernels.spanning_forest(n, i, j, w)

    def parts(i, j):
        label = list(range(n))
        for u, v in zip(i, j):
            low, high = sorted((label[u], label[v]))
            label = [low if x == high else x for x in label]
        return label

    assert len(a) == n - 1
    for t in (0.5, 0.9, 0.95, 0.99):
        assert parts(i[w > t], j[w > t]) == parts(a[fw > t], b[fw > t])


def test_ivf_refresh_rules(spark):
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "id bigint")
    reuse = lambda a, b, **k: knn.ivf_refresh(ids(a), ids(b), **k).collect()[0]["reuse"]
    old = range(10)
    assert reuse(old, range(12)) is True
    # 3 of 13, 5 of 15: the share of new rows among the current ones
    assert reuse(old, range(13)) is True
    assert reuse(old, range(15)) is False
    assert reuse(old, range(13), flat=True) is True
    assert reuse(old, range(1, 12)) is False
    assert reuse(old, range(12), same_dim=False) is False


def test_plan_has_no_cross_join(vectors):
    df, _, _ = vectors
    text = knn.knn_join(df, df, 5, within="label")._jdf.queryExecution().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("metric", ["sq_l2", "ip", "cosine"])
@pytest.mark.parametrize("scale", [1.0, 300.0])
def test_shortlists_in_single_precision_lose_no_neighbour(metric, scale, monkeypatch):
    rng = np.random.default_rng(3)
    q, b = rng.normal(size=(60, 16)) * scale, rng.normal(size=(4 * kernels.STRANDS + 7, 16)) * scale
    # copies, distances that differ in the last digits only, zeros and repeated ids
    b[100:700], b[700:1300], b[5], q[7] = q[3], q[3] * (1 + 1e-13), 0, 0
    q_ids, b_ids = np.arange(60), np.arange(len(b)) % 1500
    limits = np.full(60, 0.0)
    for k in (1, 5, 40):
        for skip in (False, True):
            got = kernels.top_k(metric, q, b, k, q_ids, b_ids, skip, tie_ids=-b_ids)
            limits[got[0]] = got[2]
            below = kernels.up_to(metric, q, b, limits, q_ids, b_ids, skip)
            with monkeypatch.context() as m:
                m.setattr(kernels, "_shortlists", lambda *a, **o: None)
                want = kernels.top_k(metric, q, b, k, q_ids, b_ids, skip, tie_ids=-b_ids)
                want_below = kernels.up_to(metric, q, b, limits, q_ids, b_ids, skip)
            assert all(np.array_equal(x, y) for x, y in zip(got + below, want + want_below))


def test_shortlists_hold_for_far_vectors():
    # near 1e8 rounding in double precision hides distances of a few units, so all must be summed again
    b = np.zeros((4 * kernels.STRANDS, 2))
    b[:, 0] = 1e8
    b[:, 1] = np.arange(len(b)) / 64
    qi, bi, dist = kernels.top_k("sq_l2", b[:20], b, 3, np.arange(20), np.arange(len(b)), True)
    assert dist[:3].tolist() == [(1 / 64) ** 2, (2 / 64) ** 2, (3 / 64) ** 2] and bi[:3].tolist() == [1, 2, 3]
    assert kernels.top_k("sq_l2", np.full((1, 2), np.nan), b, 3)[0].tolist() == []


def test_nearest_rows_of_a_block_do_not_sort_the_block(monkeypatch):
    seen = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **o: seen.append(x.shape[1]) or partition(x, *a, **o))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8 * kernels.STRANDS, 8))
    kernels.top_k("sq_l2", x[:50], x, 5, np.arange(50), np.arange(len(x)), True)
    assert seen and max(seen) <= kernels.STRANDS
