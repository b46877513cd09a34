import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.operators import active, coreset, ood, prompting
from curvine.plans.ranking import rank_rows, running_totals


def test_running_totals_with_heavy_ties(spark):
    rows = [(i, 0 if i % 3 else i, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, v bigint, g int").repartition(5)
    got = {r["id"]: (r["rank"], r["rank_total"]) for r in rank_rows(df, [F.col("v"), F.col("id")], ["g"], totals_too=True).collect()}
    for g in (0, 1):
        order = sorted((v, i) for i, v, h in rows if h == g)
        for pos, (_, i) in enumerate(order, 1):
            assert got[i] == (pos, len(order))
    sums = {r["id"]: r["s"] for r in running_totals(df, [F.col("id")], {"s": F.col("v")}).collect()}
    assert sums[399] == sum(v for _, v, _ in rows)


def test_scip_quota_rounds_half_to_even():
    assert coreset.round_half_even(0.1, 25) == 2
    assert coreset.round_half_even(0.1, 35) == 4
    assert coreset.round_half_even(0.2, 12) == 2


@pytest.mark.parametrize("p,alpha", [(0.2, 0.8), (0.5, 0.5), (0.1, 0.0), (0.3, 1.0)])
def test_scip_against_sorting(vectors, p, alpha):
    df, x, label = vectors
    rows = df.select("vec_id", F.col("label").cast("bigint").alias("cid"), F.col("embedding")[0].alias("d"))
    got = {r["vec_id"]: r["reason"] for r in coreset.scip_prune(rows, F.col("d"), p=p, alpha=alpha).collect()}
    n = len(x)
    total = coreset.round_half_even(p, n)
    quota = coreset.round_half_even(alpha, total)
    size = np.bincount(label)[label]
    by_size = sorted(range(n), key=lambda i: (size[i], i))[:quota]
    rest = sorted(set(range(n)) - set(by_size), key=lambda i: (-x[i, 0], i))[: total - quota]
    assert {i for i, r in got.items() if r == "size"} == set(by_size)
    assert {i for i, r in got.items() if r == "distance"} == set(rest)
    assert len(got) == n


def test_deft_small_cluster_is_taken_whole(spark):
    df = spark.createDataFrame([(i, 0, float(i)) for i in range(10)] + [(20, 1, 0.5)], "vec_id bigint, cid bigint, d double")
    got = {r["vec_id"]: r["kind"] for r in coreset.deft_select(df, F.col("d"), 6).collect()}
    assert got == {0: "easy", 1: "easy", 2: "easy", 7: "hard", 8: "hard", 9: "hard", 20: "easy"}


def greedy(x, rows, steps, sim):
    cover, out = np.zeros(len(rows)), []
    s = np.floor(sim(x[rows]) * 1e9 + 0.5)
    for _ in range(min(steps, len(rows))):
        gain = (np.maximum(s, cover[None, :]) - cover[None, :]).sum(axis=1)
        gain[[rows.index(i) for i in out]] = -1
        best = int(np.argmax(gain))
        out.append(rows[best])
        cover = np.maximum(cover, s[best])
    return out


def cosine(v):
    n = np.sqrt((v * v).sum(axis=1))
    return (v @ v.T) / n[:, None] / n[None, :]


def euclid(v):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    return d.max() - d


@pytest.mark.parametrize("metric,sim", [("cosine", cosine), ("euclidean", euclid)])
def test_lazy_facility_location_makes_the_plain_picks(vectors, metric, sim, monkeypatch):
    monkeypatch.setattr(coreset, "KEEP_EVERY", 3)
    df, x, label = vectors
    budget = {0: 8, 1: 5, 2: 0}
    got = coreset.facility_select(df, budget, metric=metric, block_rows=32, pull=4).orderBy("label", "step").collect()
    for c, b in budget.items():
        picks = [r["vec_id"] for r in got if r["label"] == c]
        assert picks == greedy(x, [int(i) for i in np.nonzero(label == c)[0]], b, sim)


def test_rows_that_could_still_win_are_scored_by_blocks(vectors, monkeypatch):
    df, x, label = vectors
    asked, one_pass = set(), coreset._gain_pass

    def watched(points, metric, spans, chosen, rows):
        asked.update(i for some in rows.values() for i, _ in some)
        return one_pass(points, metric, spans, chosen, rows)

    monkeypatch.setattr(coreset, "_gain_pass", watched)
    # a row without an id and a row that comes twice
    more = df.filter("vec_id = 150").select(F.lit(None).cast("bigint").alias("vec_id"), "embedding", F.lit(7).alias("label")).unionByName(df.filter("label = 1").withColumn("label", F.lit(7)))
    got = coreset.facility_select(df.unionByName(more), {0: 2, 7: 2}, metric="euclidean", block_rows=64, pull=2).orderBy("label", "step").collect()
    rows = [int(i) for i in np.nonzero(label == 0)[0]]
    assert [r["vec_id"] for r in got if r["label"] == 0] == greedy(x, rows, 2, euclid)
    assert all(r["vec_id"] is not None for r in got) and len(got) == 4
    # the rest of the hundred rows never came to the driver
    assert len(asked & set(rows)) < 40


def test_residual_select_stays_inside_the_candidates(vectors):
    df, x, label = vectors
    got = coreset.residual_select(df, {0: 4, 3: 3}, candidates=10, batch=2).collect()
    assert len(got) == 7 and len({r["vec_id"] for r in got}) == 7
    first = [r["vec_id"] for r in got if r["label"] == 0 and r["step"] < 2]
    rows = np.nonzero(label == 0)[0]
    d = ((x[rows] - x[rows].sum(axis=0)) ** 2).sum(axis=1)
    assert set(first) <= set(int(i) for i in rows[np.argsort(d)[:10]])


def test_quota_redistributes_what_small_classes_lack(spark):
    counts = spark.createDataFrame([(0, 3), (1, 50), (2, 50)], "label bigint, n bigint")
    q = {r["label"]: r["quota"] for r in coreset.class_quota(counts, 30, equal=True).collect()}
    assert q == {0: 10, 1: 14, 2: 14}
    q = {r["label"]: r["quota"] for r in coreset.class_quota(counts, 30, equal=True, redistribute="minority").collect()}
    assert q == {0: 10, 1: 17, 2: 17}


def test_batch_sizes_and_rounds():
    assert active.round_plan(1000, 0.15, 0.02) == (150, 20, 8)
    assert active.round_plan(1000, 150, 20) == (150, 20, 8)
    assert active.batch_size(150, 20, 240, 100) == 10


def test_stratified_sizes_sum_up():
    sizes = active.stratified_sizes({0: 10, 1: 11, 2: 12}, 10)
    assert sum(sizes.values()) == 10 and max(sizes.values()) - min(sizes.values()) <= 1


def test_log_prob_input_and_single_pass(spark):
    df = spark.createDataFrame([(0, [math.log(0.7), math.log(0.2), math.log(0.1)])], "vec_id bigint, z array<double>")
    for kind in ("logits", "log_prob"):
        row = active.uncertainty_scores(df, "z", ["least_conf", "margin", "ratio"], input=kind).collect()[0]
        assert np.allclose([row["least_conf"], row["margin"], row["ratio"]], [0.3, 0.5, 2 / 7])


def joint_entropy(ps):
    joint = np.ones((1, ps[0].shape[0]))
    for p in ps:
        joint = (joint[:, None, :] * p.T[None]).reshape(-1, p.shape[0])
    m = joint.mean(axis=1)
    return float((-m * np.log(m)).sum())


def test_batchbald_against_full_enumeration(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5] * 3, (12, 5))
    df = spark.createDataFrame([(i, [float(v) for v in p[i].ravel()]) for i in range(12)], "vec_id bigint, probs array<double>").repartition(3)
    got = active.batchbald_select(df, 3, samples=5, classes=3).collect()
    chosen = []
    for step in range(3):
        score = {
            i: joint_entropy([p[j] for j in chosen + [i]]) - sum((-p[j] * np.log(p[j])).sum(axis=1).mean() for j in chosen + [i])
            for i in range(12) if i not in chosen
        }
        best = max(score, key=lambda i: score[i])
        assert got[step]["vec_id"] == best and abs(got[step]["score"] - score[best]) < 1e-9
        chosen.append(best)


def test_sampled_joint_entropy_is_close(spark):
    rng = np.random.default_rng(2)
    ps = [rng.dirichlet([1.0] * 3, 4) for _ in range(3)]
    joint = active._sample_joint(ps[:2], 20000, 0)
    mixed = joint @ ps[2] / 4
    assert abs(active._sampled_entropy(mixed, joint) - joint_entropy(ps)) < 0.05


def test_vote_tie_goes_to_the_smaller_label(spark):
    near = spark.createDataFrame([(0, i, i, 0.0) for i in (1, 2, 3, 4)], "query_id bigint, neighbor_id bigint, rank bigint, dist double")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "id bigint, y int")
    assert prompting.vote(near, labels, id_col="id", label_col="y").collect()[0]["pred"] == 0


def roc(known, novel):
    cuts = sorted(set(known) | set(novel))
    tp = [len(known)] + [sum(k > s for k in known) for s in cuts]
    fp = [len(novel)] + [sum(n > s for n in novel) for s in cuts]
    area = 0.0
    for i in range(1, len(tp)):
        area += (tp[i - 1] - tp[i]) / len(known) * ((1 - fp[i - 1] / len(novel)) + (1 - fp[i] / len(novel))) / 2
    err = min((len(known) - t + f) / (len(known) + len(novel)) for t, f in zip(tp, fp))
    limit = sorted(known)[round(0.05 * len(known))]
    return sum(n > limit for n in novel) / len(novel), area, err


def test_roc_with_ties(spark):
    rng = np.random.default_rng(5)
    known, novel = [float(v) for v in rng.integers(3, 12, 60)], [float(v) for v in rng.integers(0, 9, 50)]
    one = lambda xs: spark.createDataFrame([(v,) for v in xs], "score double")
    row = ood.ood_metrics(ood.roc_points(one(known), one(novel))).collect()[0]
    assert np.allclose([row["fpr95"], row["auroc"], row["dterr"]], roc(known, novel))


def test_mahalanobis_against_numpy(vectors):
    df, x, label = vectors
    means = np.array([x[label == c].mean(axis=0) for c in range(6)])
    centred = x - means[label]
    shared = np.linalg.pinv(centred.T @ centred / len(x))
    want = np.max([-0.5 * np.einsum("ij,jk,ik->i", x - m, shared, x - m) for m in means], axis=0)
    got = [r["score"] for r in ood.mahalanobis_score(df, ood.fit_gaussians(df)).orderBy("vec_id").collect()]
    assert np.allclose(got, want)
    own = [np.linalg.pinv(np.cov(x[label == c].T, bias=True)) for c in range(6)]
    want = np.max([-0.5 * np.einsum("ij,jk,ik->i", x - m, p, x - m) for m, p in zip(means, own)], axis=0)
    got = [r["score"] for r in ood.mahalanobis_score(df, ood.fit_gaussians(df, per_class=True)).orderBy("vec_id").collect()]
    assert np.allclose(got, want)
    dims = ood.top_contributions(means, np.ones_like(means), range(6), 50)
    assert all(len(v) == 4 for v in dims.values())
    ood.mahalanobis_score(df, ood.fit_gaussians(df, dims=dims)).collect()
    z = np.array([r["embedding"] for r in ood.standardize(df, df).orderBy("vec_id").collect()])
    assert np.allclose(z.mean(axis=0), 0, atol=1e-9) and np.allclose(z.std(axis=0), 1)


def test_large_picks_are_ranked_in_parallel(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "vec_id bigint, score double")
    want = sorted(r["vec_id"] for r in active.pick_top(df, 20).collect())
    monkeypatch.setattr(active, "MAX_HEAP", 10)
    assert sorted(r["vec_id"] for r in active.pick_top(df, 20).collect()) == want


def test_merged_greedy_takes_a_fixed_number_of_jobs(spark, vectors, monkeypatch):
    """Deep merges keep the weights of all rows, and the number of jobs does not follow the budget."""
    from curvine.operators import coreset

    df, _, label = vectors
    sizes = {int(c): int((label == c).sum()) for c in set(label.tolist())}
    tracker = spark.sparkContext.statusTracker()

    def jobs(budget, parts):
        spark.sparkContext.setJobGroup(f"merge-{budget}-{parts}", "")
        rows = coreset.greedi(df, {c: budget for c in sizes}, parts).collect()
        spark.sparkContext.setJobGroup("", "")
        return rows, len(tracker.getJobIdsForGroup(f"merge-{budget}-{parts}"))

    few, one = jobs(2, 3)
    many, two = jobs(12, 3)
    assert one == two
    monkeypatch.setattr(coreset, "MERGE_ROWS", 12)
    deep, _ = jobs(5, 8)
    for rows, budget in ((few, 2), (many, 12), (deep, 5)):
        for c, n in sizes.items():
            own = sorted((r["step"], r["weight"]) for r in rows if r["label"] == c)
            assert [s for s, _ in own] == list(range(min(budget, n))) and sum(w for _, w in own) == n


def test_a_part_too_large_for_a_task_fails(spark, vectors, monkeypatch):
    import pytest

    from curvine.operators import coreset

    monkeypatch.setattr(coreset, "PART_BYTES", 100)
    with pytest.raises(Exception, match="use more parts"):
        coreset.greedi(vectors[0], {c: 2 for c in range(6)}, 1).collect()


def plain_stochastic(x, label, budget, eps, seed):
    """Every step scores its drawn rows against all points of the class."""
    from curvine.functions.hashing import _constants

    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out, ids = [], np.arange(len(x))
    for g, b in budget.items():
        own = ids[label == g]
        sim = np.maximum(unit[own] @ unit[own].T, 0)
        cover, taken = np.zeros(len(own)), set()
        for step in range(b):
            multiplier, addend = _constants(seed + step)
            h = own % 2147483647 * multiplier % 2147483647
            h = h * (h + addend) % 2147483647
            new = [i for i in range(len(own)) if own[i] not in taken]
            drawn = [i for i in new if h[i] < coreset.draw_limit(b, eps)] or [min(new, key=lambda i: (h[i], own[i]))]
            best = max(drawn, key=lambda i: (round(np.maximum(sim[i] - cover, 0).sum(), 6), -own[i]))
            out.append((g, step, int(own[best])))
            cover, taken = np.maximum(cover, sim[best]), taken | {own[best]}
    return sorted(out)


@pytest.mark.parametrize("eps,pull", [(0.3, 64), (0.3, 2), (0.99, 64)])
def test_stochastic_greedy_scores_the_drawn_rows(vectors, eps, pull):
    df, x, label = vectors
    budget = {0: 6, 1: 3, 2: 0, 3: 5}
    got = sorted((r.label, r.step, r.vec_id) for r in coreset.facility_stochastic(df, budget, eps=eps, seed=9, pull=pull).collect())
    assert got == plain_stochastic(x, label, budget, eps, 9)


def test_stochastic_greedy_comes_close_to_plain_greedy(vectors, monkeypatch):
    df, x, label = vectors
    budget = {g: 5 for g in range(6)}
    value = lambda rows: sum(r.gain for r in rows.collect())
    whole = value(coreset.facility_select(df, budget))
    drawn = coreset.facility_stochastic(df, budget, eps=0.05)
    assert value(drawn) > 0.9 * whole
    # one step at a time gives the same picks
    monkeypatch.setattr(coreset, "MAX_BROADCAST_BYTES", 1)
    assert sorted(map(tuple, coreset.facility_stochastic(df, budget, eps=0.05).collect())) == sorted(map(tuple, drawn.collect()))


def test_blocks_are_compared_in_bounded_memory(monkeypatch):
    """No kernel over two blocks lays out their whole square, nor all its pairs at once."""
    import pyarrow as pa

    from curvine.functions import kernels
    from curvine.operators import coreset, knn

    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8))
    block = pa.table({"id": np.arange(700), "vec": kernels.list_column(x, pa.float64())})
    whole = {m: kernels.near(m, x, x) for m in ("sq_l2", "l1", "cosine")}
    monkeypatch.setattr(kernels, "CHUNK_CELLS", 7000)
    seen, plain = [], kernels.near_to

    def watched(metric, b):
        to_b = plain(metric, b)

        def near(q):
            seen.append(len(q) * len(b))
            return to_b(q)

        return near

    monkeypatch.setattr(kernels, "near_to", watched)
    assert np.isclose(coreset._span_kernel(0, block, block, metric="euclidean").column("span")[0].as_py() ** 2, whole["sq_l2"].max())
    assert np.allclose(coreset._similarity("l1", x, x, 5.0), 5.0 - whole["l1"])
    assert np.allclose(coreset._similarity("cosine", x, x, 0.0), 1.0 - whole["cosine"])
    parts = list(knn._pairs_in_parts(0, block, None, metric="sq_l2", limit=9.0))
    got = {(a, b) for t in parts for a, b in zip(t.column("query_id").to_pylist(), t.column("neighbor_id").to_pylist())}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(whole["sq_l2"] < 9.0)) if a < b}
    assert len(parts) == 70 and max(seen) <= 7000
