"""Coreset selection and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql
from curvine.operators import cluster, coreset, knn
from curvine.plans.bounded import collect_bounded
from curvine.plans.ranking import rank_rows
from curvine.queries.clusters import mean_sql, two_level_sql
from curvine.queries.joins import with_clusters_sql
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, sq_l2_sql
from curvine.queries.vectors import GRAD_SQL, _class_probs

K, RATIO = 7, 0.325


def _with_centroids(spark, d, k):
    emb = embeddings(spark, d)
    centroids = cluster.sample_rows(emb, k)
    return knn.assign(emb, centroids).join(F.broadcast(centroids), "cid")


# --- easy and hard ---------------------------------------------------------------


def deft_sql(dist: str) -> str:
    return with_clusters_sql(K) + f""", s AS (SELECT a.vec_id, a.cid, {dist} AS dist FROM a JOIN c USING (cid)),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY dist, vec_id) AS rank, count(*) OVER (PARTITION BY cid) AS n,
  greatest(1, floor(count(*) OVER () * {RATIO}::DOUBLE / {K}))::BIGINT AS quota FROM s),
t AS (SELECT *, least(floor(0.5::DOUBLE * quota), n) AS ne FROM r), u AS (SELECT *, least(floor(0.5::DOUBLE * quota), n - ne) AS nh FROM t)
SELECT vec_id, cid, round(dist, 6) AS dist, CASE WHEN rank <= ne THEN 'easy' ELSE 'hard' END AS kind FROM u WHERE rank <= ne OR rank > n - nh"""


COS_SQL = f"1.0::DOUBLE - {dot_sql('a.v', 'c.centroid')} / (sqrt({dot_sql('a.v', 'a.v')}) * sqrt({dot_sql('c.centroid', 'c.centroid')}))"
NA, NC = (f"sqrt({dot_sql(x, x)})" for x in ("a.v", "c.centroid"))
REUSE_SQL = f"1.0::DOUBLE - least(greatest(0.5::DOUBLE * ({NA} * {NA} + {NC} * {NC} - a.cdist) / greatest({NA} * {NC}, 1e-12::DOUBLE), -1.0), 1.0)"


def _deft(spark, d, distance):
    rows = _with_centroids(spark, d, K)
    quota = coreset.per_cluster_quota(F.count(F.lit(1)), RATIO, K)
    quota = embeddings(spark, d).agg(quota.alias("q")).scalar()
    return coreset.deft_select(rows, distance, quota).withColumn("dist", F.round("dist", 6))


@query("deft_select", deft_sql(COS_SQL))
def deft_select(spark, d):
    return _deft(spark, d, V.cosine_dist("embedding", "centroid"))


@query("deft_select_reuse", deft_sql(REUSE_SQL))
def deft_select_reuse(spark, d):
    """The cosine comes from the distance the assignment carries, not from the vectors again."""
    return _deft(spark, d, F.lit(1.0) - V.cosine_from_sq_l2("cdist", V.l2_norm("embedding"), V.l2_norm("centroid")))


# --- size and distance pruning --------------------------------------------------------


def scip_sql(rows: str, tail: str) -> str:
    return rows + f""", z AS (SELECT *, count(*) OVER (PARTITION BY cid) AS cluster_size, round_even((0.2::DECIMAL(9, 4) * count(*) OVER ())::DOUBLE, 0)::BIGINT AS total FROM s),
z2 AS (SELECT *, round_even((0.8::DECIMAL(9, 4) * total)::DOUBLE, 0)::BIGINT AS quota FROM z),
y AS (SELECT *, row_number() OVER (ORDER BY cluster_size, vec_id) <= quota AS by_size FROM z2),
x AS (SELECT *, NOT by_size AND row_number() OVER (PARTITION BY by_size ORDER BY dist DESC, vec_id) <= total - quota AS by_dist FROM y),
pr AS (SELECT vec_id, cid, dist, cluster_size, NOT (by_size OR by_dist) AS kept, CASE WHEN by_size THEN 'size' WHEN by_dist THEN 'distance' END AS reason FROM x)
""" + tail


SCIP_ROWS = with_clusters_sql(12) + f", s AS (SELECT a.vec_id, a.cid, 1.0::DOUBLE - {dot_sql('a.v', 'c.centroid')} AS dist FROM a JOIN c USING (cid))"
PRUNED = "SELECT vec_id, cid, round(dist, 6) AS dist, cluster_size, kept, reason FROM pr"


@query("scip_prune", scip_sql(SCIP_ROWS, PRUNED))
def scip_prune(spark, d):
    return coreset.scip_prune(_with_centroids(spark, d, 12), F.lit(1.0) - V.dot("embedding", "centroid")).withColumn("dist", F.round("dist", 6))


IP_ASSIGN_SQL = f"""WITH {E_SQL}, c AS (SELECT row_number() OVER (ORDER BY {id_hash_sql('vec_id', 0)}, vec_id) - 1 AS cid, v AS centroid FROM e QUALIFY cid < 12),
s AS (SELECT vec_id, cid, 1.0::DOUBLE - d AS dist FROM (SELECT e.vec_id, c.cid, {dot_sql('e.v', 'c.centroid')} AS d FROM e CROSS JOIN c) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d DESC, cid) = 1)"""


@query("scip_prune_reuse", scip_sql(IP_ASSIGN_SQL, PRUNED))
def scip_prune_reuse(spark, d):
    """Distance = 1 - the similarity the assignment already found."""
    emb = embeddings(spark, d)
    rows = knn.assign(emb, cluster.sample_rows(emb, 12), metric="ip")
    return coreset.scip_prune(rows, F.lit(1.0) + F.col("cdist")).withColumn("dist", F.round("dist", 6))


TWO_LEVEL_ROWS = two_level_sql(12, 4, 2, 0)
TWO_LEVEL_ROWS = TWO_LEVEL_ROWS[: TWO_LEVEL_ROWS.rindex(" SELECT vec_id, cid, round")] + f", s AS (SELECT a0.vec_id, a0.cid, 1.0::DOUBLE - {dot_sql('a0.v', 'c0.centroid')} AS dist FROM a0 JOIN c0 USING (cid))"


@query("scip_prune_ann", scip_sql(TWO_LEVEL_ROWS, PRUNED))
def scip_prune_ann(spark, d):
    """Approximate assignment only; distances are computed afresh."""
    emb = embeddings(spark, d)
    centroids = cluster.sample_rows(emb, 12)
    rows = cluster.assign_rows(emb, *knn.centroid_matrix(centroids), coarse=4, nprobe=2).join(F.broadcast(centroids), "cid")
    return coreset.scip_prune(rows, F.lit(1.0) - V.dot("embedding", "centroid")).withColumn("dist", F.round("dist", 6))


@query("prune_stats", scip_sql(SCIP_ROWS, """SELECT count(*) AS total, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS pruned, round(avg((NOT kept)::INT), 6) AS prune_ratio,
  count(DISTINCT cid) AS clusters, round(count(*)::DOUBLE / count(DISTINCT cid), 6) AS mean_cluster_size, round(avg(dist) FILTER (kept), 6) AS kept_mean_dist, round(avg(dist) FILTER (NOT kept), 6) AS pruned_mean_dist FROM pr"""))
def prune_stats(spark, d):
    return coreset.prune_stats(coreset.scip_prune(_with_centroids(spark, d, 12), F.lit(1.0) - V.dot("embedding", "centroid")))


@query("prune_ratio_by_cluster", scip_sql(SCIP_ROWS, "SELECT cid, count(*) AS n, count(*) FILTER (NOT kept) AS pruned, round(avg((NOT kept)::INT), 6) AS prune_ratio FROM pr GROUP BY cid"))
def prune_ratio_by_cluster(spark, d):
    return coreset.prune_ratio_by_cluster(coreset.scip_prune(_with_centroids(spark, d, 12), F.lit(1.0) - V.dot("embedding", "centroid")))


# --- facility location --------------------------------------------------------------------

COS_XY = f"{dot_sql('x.v', 'y.v')} / (x.norm * y.norm)"


def pick_sql(sims: str, t: int, prefix: str = "p", draw=None, among: str = "") -> str:
    """CTE of the picks of step t: (g, vec_id, gain)."""
    first = "gain DESC"
    if draw:
        h, limit = draw(t)
        first = f"{h} < {limit} DESC, CASE WHEN {h} < {limit} THEN gain ELSE -{h} END DESC"
    cover = " UNION ALL ".join(f"SELECT {sims}.g, i, s FROM {sims} JOIN {prefix}{u} k ON k.g = {sims}.g AND k.vec_id = j" for u in range(t)) or f"SELECT g, i, 0::HUGEINT AS s FROM {sims} WHERE i = j"
    taken = " UNION ALL ".join(f"SELECT g, vec_id FROM {prefix}{u}" for u in range(t)) or "SELECT NULL::BIGINT AS g, NULL::BIGINT AS vec_id"
    return f"""{prefix}{t} AS (SELECT q.g, q.j AS vec_id, sum(greatest(q.s, cv.s) - cv.s)::DOUBLE / 1e9 AS gain FROM {sims} q
  JOIN (SELECT g, i, greatest(0, max(s)) AS s FROM ({cover}) GROUP BY g, i) cv ON cv.g = q.g AND cv.i = q.i {among}
  WHERE (q.g, q.j) NOT IN (SELECT (g, vec_id) FROM ({taken}) WHERE g IS NOT NULL) GROUP BY q.g, q.j
  QUALIFY row_number() OVER (PARTITION BY q.g ORDER BY {first}, q.j) = 1)"""


def greedy_sql(sims: str, steps: int, prefix: str = "p", draw=None) -> str:
    """CTEs of picks: p0, p1, ... each (g, vec_id, gain); ``draw`` gives a step's hash and its limit, for candidates drawn at random."""
    return ", ".join(pick_sql(sims, t, prefix, draw) for t in range(steps))


def union_picks(steps: int, prefix: str = "p", gain: str = "round(gain, 6)") -> str:
    return " UNION ALL ".join(f"SELECT g AS label, {t}::BIGINT AS step, vec_id, {gain} AS gain FROM {prefix}{t}" for t in range(steps))


def sims_plain(rows: str, name: str, metric: str) -> str:
    """Similarities of all pairs of a class, as whole numbers."""
    if metric == "cosine":
        sim = f"SELECT x.g, x.vec_id AS i, y.vec_id AS j, {COS_XY} AS sim FROM {name}n x JOIN {name}n y ON x.g = y.g"
    else:
        sim = f"SELECT g, i, j, max(d) OVER (PARTITION BY g) - d AS sim FROM (SELECT x.g, x.vec_id AS i, y.vec_id AS j, sqrt({sq_l2_sql('x.v', 'y.v')}) AS d FROM {name}n x JOIN {name}n y ON x.g = y.g)"
    return f"""{name}n AS (SELECT *, sqrt({dot_sql('v', 'v')}) AS norm FROM {rows}), {name} AS (SELECT g, i, j, sim, floor(sim * 1e9 + 0.5)::HUGEINT AS s FROM ({sim}))"""


CLASS_ROWS = f"WITH {E_SQL}, rw AS (SELECT vec_id, v, label::BIGINT AS g FROM e)"
STEPS = 3
FL_SQL = CLASS_ROWS + ", " + sims_plain("rw", "sm", "cosine") + ", " + greedy_sql("sm", STEPS)
FL_L2_SQL = CLASS_ROWS + ", " + sims_plain("rw", "sm", "euclidean") + ", " + greedy_sql("sm", STEPS)


def _classes(spark, d):
    return [r[0] for r in collect_bounded(embeddings(spark, d).select("label").distinct())]


def _facility(spark, d, metric="cosine"):
    return coreset.facility_select(embeddings(spark, d), {c: STEPS for c in _classes(spark, d)}, metric=metric)


@query("class_similarity", CLASS_ROWS + ", " + sims_plain("rw", "sm", "euclidean") + " SELECT i AS id_a, j AS id_b, round(sim, 6) AS sim FROM sm WHERE i < j AND sim > 0.5")
def class_similarity(spark, d):
    return coreset.class_similarity(embeddings(spark, d), "euclidean", 0.5).withColumn("sim", F.round("sim", 6))


@query("facility_greedy", FL_SQL + " " + union_picks(STEPS))
def facility_greedy(spark, d):
    return _facility(spark, d).withColumn("gain", F.round("gain", 6))


@query("facility_greedy_l2", FL_L2_SQL + " " + union_picks(STEPS))
def facility_greedy_l2(spark, d):
    return _facility(spark, d, "euclidean").withColumn("gain", F.round("gain", 6))


DRAW_STEPS, DRAW_EPS, DRAW_SEED = 4, 0.3, 31


def _draw(step: int) -> tuple[str, int]:
    return id_hash_sql("q.j", DRAW_SEED + step), coreset.draw_limit(DRAW_STEPS, DRAW_EPS)


@query("facility_stochastic", CLASS_ROWS + ", " + sims_plain("rw", "sm", "cosine") + ", " + greedy_sql("sm", DRAW_STEPS, draw=_draw) + " " + union_picks(DRAW_STEPS))
def facility_stochastic(spark, d):
    """A third of each class is looked at in a step."""
    found = coreset.facility_stochastic(embeddings(spark, d), {c: DRAW_STEPS for c in _classes(spark, d)}, eps=DRAW_EPS, seed=DRAW_SEED)
    return found.withColumn("gain", F.round("gain", 6))


RES_SQL = f"""WITH {E_SQL}, {mean_sql('e', 'label', 'lm')}, r AS (SELECT label, list_transform(centroid, lambda x: x * n) AS residual FROM lm)
SELECT e.label::BIGINT AS label, row_number() OVER (PARTITION BY e.label ORDER BY {sq_l2_sql('e.v', 'residual')}, vec_id) AS rank, vec_id AS neighbor_id, round({sq_l2_sql('e.v', 'residual')}, 6) AS dist
FROM e JOIN r USING (label) QUALIFY rank <= 10"""


@query("craig_residual_candidates", RES_SQL)
def craig_residual_candidates(spark, d):
    return coreset.residual_candidates(embeddings(spark, d), 10).withColumn("dist", F.round("dist", 6))


RES_BATCHES, RES_BATCH = 2, 2


def residual_sql() -> str:
    """Batches of picks among the ten rows nearest to what the earlier batches leave of the sums."""
    parts = ["rs0 AS (SELECT label::BIGINT AS g, list_transform(centroid, lambda x: x * n) AS v FROM lm)"]
    for b in range(RES_BATCHES):
        steps = range(b * RES_BATCH, (b + 1) * RES_BATCH)
        taken = " UNION ALL ".join(f"SELECT vec_id FROM p{u}" for u in range(steps[0])) or "SELECT -1 AS vec_id"
        parts.append(f"""pool{b} AS (SELECT rw.g, vec_id FROM rw JOIN rs{b} r ON r.g = rw.g WHERE vec_id NOT IN ({taken})
  QUALIFY row_number() OVER (PARTITION BY rw.g ORDER BY {sq_l2_sql('rw.v', 'r.v')}, vec_id) <= 10)""")
        parts += [pick_sql("sm", t, among=f"JOIN pool{b} po ON po.g = q.g AND po.vec_id = q.j") for t in steps]
        left = "r.v"
        joins = ""
        for t in steps:
            joins += f" JOIN p{t} k{t} ON k{t}.g = r.g JOIN rw w{t} ON w{t}.vec_id = k{t}.vec_id"
            left = f"list_transform(list_zip({left}, w{t}.v), lambda x: x[1] - x[2])"
        parts.append(f"rs{b + 1} AS (SELECT r.g, {left} AS v FROM rs{b} r{joins})")
    return ", ".join(parts)


@query("craig_residual_select", CLASS_ROWS + ", " + sims_plain("rw", "sm", "cosine") + f", {mean_sql('e', 'label', 'lm')}, " + residual_sql() + " " + union_picks(RES_BATCHES * RES_BATCH))
def craig_residual_select(spark, d):
    picks = coreset.residual_select(embeddings(spark, d), {c: RES_BATCHES * RES_BATCH for c in _classes(spark, d)}, candidates=10, batch=RES_BATCH)
    return picks.withColumn("gain", F.round("gain", 6))


ALL_PICKS = f"pk AS ({union_picks(STEPS)})"
WEIGHTS_SQL = FL_SQL + f""", {ALL_PICKS}, best AS (SELECT sm.g, i, j FROM sm JOIN pk ON pk.label = sm.g AND pk.vec_id = j QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, pk.step) = 1)"""


@query("craig_weights", WEIGHTS_SQL + " SELECT pk.label, pk.vec_id, count(best.i)::DOUBLE AS weight FROM pk LEFT JOIN best ON best.j = pk.vec_id GROUP BY ALL")
def craig_weights(spark, d):
    return coreset.medoid_weights(embeddings(spark, d), _facility(spark, d)).select(F.col("label").cast("bigint").alias("label"), "vec_id", "weight")


QUOTA_SQL = """WITH n AS (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT *, ceil(495.0::DOUBLE / count(*) OVER ()) AS share, ceil(n::DOUBLE / sum(n) OVER () * 495)::BIGINT AS by_size FROM n),
x AS (SELECT *, n < share AS small, sum(CASE WHEN n < share THEN share - n ELSE 0 END) OVER () AS extra FROM t), y AS (SELECT *, count(*) FILTER (NOT small) OVER () AS among FROM x)
SELECT label, n, by_size, (share + CASE WHEN small OR among = 0 THEN 0 ELSE ceil(extra::DOUBLE / among) END)::BIGINT AS equal FROM y"""


@query("class_quota", QUOTA_SQL)
def class_quota(spark, d):
    counts = embeddings(spark, d).groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    by_size = coreset.class_quota(counts, 495, equal=False).withColumnRenamed("quota", "by_size")
    equal = coreset.class_quota(counts, 495, equal=True).select("label", F.col("quota").alias("equal"))
    return by_size.join(equal, "label")


INTER_SQL = """WITH n AS (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label), pp AS (SELECT label, round_even(n::DOUBLE / min(n) OVER (), 0)::BIGINT AS prop FROM n),
sel AS (SELECT label::BIGINT AS label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step FROM embeddings), b AS (SELECT label, step, vec_id, floor(step / prop)::BIGINT AS block FROM sel JOIN pp USING (label))
SELECT *, row_number() OVER (ORDER BY block, label, step) AS position FROM b"""


@query("class_interleave", INTER_SQL)
def class_interleave(spark, d):
    emb = embeddings(spark, d).select(F.col("label").cast("bigint").alias("label"), "vec_id")
    props = coreset.class_proportions(emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    order = rank_rows(emb, [F.col("vec_id")], ["label"], rank="r").select("label", "vec_id", (F.col("r") - 1).alias("step"))
    return coreset.class_interleave(order, props)


PARTS = 2


def greedi_sql(first: int, last: int) -> str:
    """``first`` picks of each part, then ``last`` among them."""
    return (
        f"WITH {E_SQL}, rw AS (SELECT vec_id, v, label::BIGINT * {PARTS} + ({id_hash_sql('vec_id', 0)}) % {PARTS} AS g FROM e), " + sims_plain("rw", "sm", "cosine") + ", " + greedy_sql("sm", first)
        + f""", pk AS ({union_picks(first)}), w AS (SELECT pk.vec_id, count(best.i)::DOUBLE AS w FROM pk LEFT JOIN (SELECT sm.g, i, j FROM sm JOIN pk ON pk.label = sm.g AND pk.vec_id = j
  QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, pk.step) = 1) best ON best.j = pk.vec_id GROUP BY pk.vec_id),
rw2 AS (SELECT e.vec_id, v, label::BIGINT AS g FROM e JOIN w USING (vec_id)), """ + sims_plain("rw2", "s2", "cosine") + ", " + greedy_sql("s2", last, "f")
        + f""", fk AS ({union_picks(last, "f")}), b2 AS (SELECT i, j FROM s2 JOIN fk ON fk.label = s2.g AND fk.vec_id = j QUALIFY row_number() OVER (PARTITION BY i ORDER BY sim DESC, fk.step) = 1)
SELECT fk.label, fk.step, fk.vec_id, fk.gain, sum(w.w) AS weight FROM fk JOIN b2 ON b2.j = fk.vec_id JOIN w ON w.vec_id = b2.i GROUP BY ALL"""
    )


@query("greedi_two_stage", greedi_sql(2, 2))
def greedi_two_stage(spark, d):
    picks = coreset.greedi(embeddings(spark, d), {c: 2 for c in _classes(spark, d)}, PARTS)
    return picks.select("label", "step", "vec_id", F.round("gain", 6).alias("gain"), "weight")


@query("greedi_half_budget", greedi_sql(1, 2))
def greedi_half_budget(spark, d):
    picks = coreset.greedi(embeddings(spark, d), {c: 2 for c in _classes(spark, d)}, PARTS, first_share=0.5)
    return picks.select("label", "step", "vec_id", F.round("gain", 6).alias("gain"), "weight")


@query("facility_log_value", FL_SQL + f""", pk AS ({' UNION ALL '.join(f'SELECT g AS label, {t}::BIGINT AS step, vec_id, gain FROM p{t}' for t in range(STEPS))}), n AS (SELECT label::BIGINT AS label, count(*) AS n FROM e GROUP BY ALL),
lv AS (SELECT label, step, vec_id, ln(1 + sum(gain) OVER (PARTITION BY label ORDER BY step) / n) / ln(2.0::DOUBLE) AS log_value FROM pk JOIN n USING (label))
SELECT label, step, vec_id, round(log_value, 6) AS log_value, round(log_value - coalesce(lag(log_value) OVER (PARTITION BY label ORDER BY step), 0), 6) AS log_gain FROM lv""")
def facility_log_value(spark, d):
    picks = coreset.log_objective(_facility(spark, d), coreset.objective_ceilings(embeddings(spark, d)))
    return picks.select("label", "step", "vec_id", F.round("log_value", 6).alias("log_value"), F.round("log_gain", 6).alias("log_gain"))


# --- baselines -----------------------------------------------------------------------------


SUBSET_SQL = f"sub AS (SELECT vec_id FROM e QUALIFY row_number() OVER (ORDER BY {id_hash_sql('vec_id', 3)}, vec_id) <= floor(0.3::DOUBLE * count(*) OVER ()))"


@query("weighted_random_subset", f"WITH {E_SQL}, {SUBSET_SQL} SELECT vec_id, round(1.0::DOUBLE / 0.3, 6) AS weight, 1.0::DOUBLE AS scaled_weight FROM sub")
def weighted_random_subset(spark, d):
    out = coreset.weighted_random_subset(embeddings(spark, d), 0.3, seed=3)
    return out.select("vec_id", F.round("weight", 6).alias("weight"), F.round("scaled_weight", 6).alias("scaled_weight"))


@query("gradient_difference", GRAD_SQL + f""", {SUBSET_SQL}, gr AS (SELECT vec_id, flatten(list_transform(list_transform(p, lambda x, i: x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END), lambda s: list_transform(b, lambda h: s * h))) AS gd FROM g),
t AS (SELECT i, sum(gd[i]) AS f, sum(CASE WHEN vec_id IN (SELECT vec_id FROM sub) THEN gd[i] / 0.3 ELSE 0 END) AS s FROM gr, range(1, 641) r(i) GROUP BY i)
SELECT round(sqrt(sum((f - s) * (f - s))), 6) AS diff, round(sqrt(sum(f * f)), 6) AS full_norm FROM t""")
def gradient_difference(spark, d):
    probs = _class_probs(spark, d)
    grads = probs.select("vec_id", V.outer_flat(V.minus_onehot("p", "label"), "b").alias("grad"))
    return coreset.gradient_difference(grads, coreset.weighted_random_subset(probs, 0.3, seed=3))


@query("selection_coverage", "WITH e AS (SELECT vec_id FROM embeddings), " + ", ".join(
    f"r{i} AS (SELECT vec_id FROM e QUALIFY row_number() OVER (ORDER BY {id_hash_sql('vec_id', i)}, vec_id) <= floor(0.3::DOUBLE * count(*) OVER ()))" for i in range(3)
) + """, t AS (SELECT e.vec_id, count(s.vec_id) AS times FROM e LEFT JOIN (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) s USING (vec_id) GROUP BY e.vec_id)
SELECT times, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM t GROUP BY times""")
def selection_coverage(spark, d):
    emb = embeddings(spark, d)
    rounds = [coreset.weighted_random_subset(emb, 0.3, seed=i).select("vec_id") for i in range(3)]
    return coreset.selection_coverage(emb, rounds[0].union(rounds[1]).union(rounds[2]))
