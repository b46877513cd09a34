import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.operators import cluster, dedup, knn


def assigned(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cid bigint")


@pytest.fixture(scope="module")
def planted(spark):
    def turn(angle):
        return [float(np.cos(angle)), float(np.sin(angle)), 0.0]

    return assigned(
        spark,
        [
            (0, turn(0.0), 0), (1, turn(0.1), 0), (2, turn(0.2), 0), (3, turn(1.5), 0),  # a chain and a loner
            (4, [0.0, 0.0, 1.0], 1),  # alone in its cluster
            (5, turn(0.0), 2), (6, turn(0.0), 2), (7, [0.0, 0.0, 0.0], 2),  # copies and a zero vector
        ],
    )


def flags(df, name):
    return {r["vec_id"] for r in df.collect() if r[name]}


def test_semdedup_drops_both_sides_of_a_pair(planted):
    out = dedup.semdedup(planted, [0.01, 0.05])
    assert flags(out, "remove_e01") == {0, 1, 2, 5, 6}
    rows = {r["vec_id"]: r["max_sim"] for r in out.collect()}
    assert rows[4] is None and len(rows) == 8


@pytest.mark.parametrize("mode", ["exact", "topk"])
def test_fairdedup_keeps_one_of_a_chain(planted, mode):
    out = dedup.fairdedup(planted, [0.01, 0.001], mode=mode)
    assert flags(out, "remove_e01") == {0, 2, 6}  # 1 is most like the mean; of two copies the smaller id stays
    assert flags(out, "remove_e00") == {6}


def test_many_copies_leave_one_and_emit_few_edges(spark):
    rows = assigned(spark, [(i, [1.0, 0.0], 0) for i in range(150)])
    edges = knn.similarity_forest(rows, 0.9, within="cid", block_rows=20)
    assert edges.count() < 150 * 16
    out = dedup.fairdedup(rows, [0.05])
    assert flags(out, "remove_e05") == set(range(1, 150))


@pytest.mark.parametrize("task_edges", [0, 1 << 20])
def test_components_in_rounds_and_by_one_task(spark, monkeypatch, task_edges):
    rng = np.random.default_rng(11)
    links = [(int(p), int(a), int(b)) for p, a, b in zip(rng.integers(0, 2, 900), rng.integers(0, 500, 900), rng.integers(0, 500, 900))]
    links += [(0, i, i + 1) for i in range(1000, 1300)]
    expected = {}
    for p in (0, 1):
        label = {x: x for q, a, b in links if q == p and a != b for x in (a, b)}
        for _ in range(400):
            for q, a, b in links:
                if q == p and a != b:
                    label[a] = label[b] = min(label[a], label[b])
        expected |= {(p, x): c for x, c in label.items()}
    if task_edges:
        # few links need no rounds
        monkeypatch.setattr(dedup, "_agreed", None)
    edges = spark.createDataFrame(links, "p int, id_a bigint, id_b bigint").repartition(6)
    rows = dedup.connected_components(edges, "p", task_edges).collect()
    assert {(r["part"], r["id"]): r["component"] for r in rows} == expected and len(rows) == len(expected)


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)]
    cycle = [(200 + i, 200 + (i + 1) % 7) for i in range(7)]
    edges = spark.createDataFrame([(a, b, p) for p in (0, 1) for a, b in chain + star + cycle if not (p == 1 and (a, b) == (30, 31))], "id_a bigint, id_b bigint, p int")
    got = {(r["part"], r["id"]): r["component"] for r in dedup.connected_components(edges, "p").collect()}
    want = {}
    for p in (0, 1):
        for i in range(61):
            want[p, i] = 31 if p == 1 and i > 30 else 0
        want.update({(p, 100 + i): 100 for i in range(40)})
        want.update({(p, 200 + i): 200 for i in range(7)})
    assert got == want


def test_hot_hub_goes_through_the_broadcast_branch(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_HOT_KEYS", 4)
    from curvine.plans.join_hot import join_lookup

    big = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0), (3, 0)], "k int, x int")
    lookup = big.groupBy("k").agg(F.count("*").alias("n"))
    out = join_lookup(big, lookup, "k", 10, "n")
    assert out.count() == 52 and {(r["k"], r["n"]) for r in out.collect()} == {(1, 50), (2, 1), (3, 1)}


def test_dedup_compare_counts(planted):
    out = dedup.semdedup(planted, [0.01])
    row = dedup.dedup_compare(out, out.withColumn("remove_e01", F.col("vec_id") < 2), F.col("remove_e01"), F.col("remove_e01")).collect()[0]
    assert (row["both"], row["only_first"], row["only_second"]) == (2, 3, 0)
    assert row["recall"] == 0.4 and row["precision"] == 1.0


def test_kmeans_reseeds_empty_clusters(spark):
    df = spark.createDataFrame([(i, [float(i % 3) * 10 + i * 0.01]) for i in range(30)], "vec_id bigint, embedding array<double>")
    init = spark.createDataFrame([(0, [0.0]), (1, [1000.0]), (2, [2000.0])], "cid bigint, centroid array<double>")
    rows, centroids = cluster.kmeans(df, init, max_iter=20)
    assert rows.select("cid").distinct().count() == 3 and centroids.count() == 3


def test_group_means_do_not_depend_on_the_partitions(vectors):
    df, x, label = vectors
    a = {r["label"]: r["mean"] for r in cluster.group_means(df.repartition(7), ["label"], "embedding").collect()}
    b = {r["label"]: r["mean"] for r in cluster.group_means(df.repartition(2), ["label"], "embedding").collect()}
    assert a == b
    for c in a:
        assert np.allclose(a[c], x[label == c].mean(axis=0), atol=1e-8)


def test_farthest_first_against_brute_force(vectors):
    df, x, _ = vectors
    got = [r["vec_id"] for r in cluster.seed_centers(df, 20, how="farthest", keep_every=4).orderBy("step").collect()]
    chosen = [got[0]]
    while len(chosen) < 20:
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(int(np.argmax(d)))
    assert got == chosen


def test_weighted_seeding_never_repeats(vectors):
    df, _, _ = vectors
    got = [r["vec_id"] for r in cluster.seed_centers(df, 30, how="weighted").collect()]
    assert len(set(got)) == 30


@pytest.mark.parametrize("seed", range(5))
def test_best_matching_against_all_orders(seed):
    gain = np.random.default_rng(seed).integers(0, 30, (6, 6)).astype(float)
    best = max(sum(gain[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    match = cluster._best_matching(gain)
    assert sorted(match) == list(range(6)) and sum(gain[i, m] for i, m in enumerate(match)) == best


def test_mllib_kmeans_repeats(vectors):
    df, _, _ = vectors
    a, _ = cluster.mllib_kmeans(df, 4, cosine=True)
    b, _ = cluster.mllib_kmeans(df, 4, cosine=True)
    assert sorted(a.select("vec_id", "cid").collect()) == sorted(b.select("vec_id", "cid").collect())


def plain_minibatch(x, ids, init, batches, epochs, seed):
    """Sculley's mini-batches, each batch moving its centroids at once."""
    from curvine.functions.hashing import _constants

    multiplier, addend = _constants(seed)
    h = ids % 2147483647 * multiplier % 2147483647
    h = h * (h + addend) % 2147483647
    centers, seen = init.copy(), np.zeros(len(init))
    for step in range(epochs * batches):
        rows = x[h % batches == step % batches]
        near = ((rows[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        for c in range(len(centers)):
            mine = rows[near == c]
            if len(mine):
                seen[c] += len(mine)
                centers[c] += (mine.mean(0) - centers[c]) * len(mine) / seen[c]
    return centers


@pytest.mark.parametrize("batches,epochs", [(1, 1), (5, 1), (7, 3)])
def test_minibatch_steps(vectors, batches, epochs):
    df, x, _ = vectors
    init = cluster.sample_rows(df, 6)
    start = np.array([r.centroid for r in init.orderBy("cid").collect()])
    assigned, centers = cluster.minibatch_kmeans(df, init, batches=batches, epochs=epochs, seed=4)
    got = np.array([r.centroid for r in centers.orderBy("cid").collect()])
    assert np.allclose(got, plain_minibatch(x, np.arange(300), start, batches, epochs, 4), atol=1e-6)
    rows = sorted((r.vec_id, r.cid) for r in assigned.collect())
    assert [c for _, c in rows] == ((x[:, None] - got[None]) ** 2).sum(2).argmin(1).tolist()


def test_minibatches_come_close_to_full_rounds(vectors):
    df, x, _ = vectors
    init = cluster.sample_rows(df, 6)
    cost = lambda frame: sum(r.cdist for r in frame.collect())
    full, _ = cluster.kmeans(df, init, max_iter=12, tol=0.0)
    few, _ = cluster.minibatch_kmeans(df, init, batches=6, epochs=4)
    unit, centers = cluster.minibatch_kmeans(df, init, batches=3, spherical=True)
    assert cost(few) < 1.08 * cost(full)
    assert np.allclose([np.linalg.norm(r.centroid) for r in centers.collect()], 1.0)
