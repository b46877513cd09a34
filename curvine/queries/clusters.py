"""Clustering and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql
from curvine.operators import cluster, dedup, knn
from curvine.queries.joins import (
    LSH_MAX_SQL, MAXSIM_SQL, PAIRS_SQL, centroids_sql, clustered, initial, lsh_setting, with_clusters_sql,
)
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, sq_l2_sql
from curvine.queries.vectors import GRAD_SQL, _class_probs

# The vectors are far apart, so thresholds that remove something are wide.
EPS = [0.50, 0.55, 0.60, 0.65]


# --- k-means ---------------------------------------------------------------------


def mean_sql(rows: str, key: str, name: str, vec: str = "v", out: str = "centroid") -> str:
    """CTE of fixed-point mean vectors per key."""
    return f"""{name} AS (SELECT {key}, list(m ORDER BY i) AS {out}, any_value(n) AS n FROM (SELECT {key}, i, count(*) AS n,
  sum(floor({vec}[i] * 1e9 + 0.5)::HUGEINT)::DOUBLE / 1e9 / count(*) AS m FROM {rows}, range(1, 65) t(i) GROUP BY {key}, i) GROUP BY {key})"""


def assign_cte(name: str, centroids: str, extra: str = "") -> str:
    return f"""{name} AS (SELECT vec_id, label, v, cid, d AS cdist FROM (SELECT e.vec_id, e.label, e.v, c.cid, {sq_l2_sql('e.v', 'c.centroid')} AS d
  FROM e CROSS JOIN {centroids} c {extra}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1)"""


def rounds_sql(k: int, rounds: int) -> str:
    """k-means unrolled; an empty cluster keeps nothing here, so k stays small enough that none is."""
    parts = [f"WITH {E_SQL}", centroids_sql(k, "c0")]
    for r in range(rounds):
        parts += [assign_cte(f"a{r}", f"c{r}"), mean_sql(f"a{r}", "cid", f"c{r + 1}")]
    parts.append(assign_cte("af", f"c{rounds}"))
    return ", ".join(parts)


@query("kmeans_fixed_rounds", rounds_sql(7, 3) + " SELECT vec_id, cid, round(cdist, 6) AS cdist FROM af")
def kmeans_fixed_rounds(spark, d):
    emb = embeddings(spark, d)
    assigned, _ = cluster.kmeans(emb, cluster.sample_rows(emb, 7), max_iter=3, tol=0.0)
    return assigned.select("vec_id", "cid", F.round("cdist", 6).alias("cdist"))


def two_level_sql(k: int, coarse: int, probes: int, rounds: int) -> str:
    parts = [f"WITH {E_SQL}", centroids_sql(k, "c0")]
    for r in range(rounds + 1):
        dist = sq_l2_sql("x.centroid", "y.centroid")
        parts.append(f"""g{r} AS (SELECT x.cid, x.centroid, y.cid AS lead FROM c{r} x CROSS JOIN c{r} y WHERE y.cid < {coarse}
  QUALIFY row_number() OVER (PARTITION BY x.cid ORDER BY {dist}, y.cid) = 1)""")
        parts.append(f"""p{r} AS (SELECT e.vec_id, y.cid AS lead FROM e CROSS JOIN c{r} y WHERE y.cid < {coarse}
  QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2_sql('e.v', 'y.centroid')}, y.cid) <= {probes})""")
        parts.append(f"""a{r} AS (SELECT e.vec_id, e.v, g{r}.cid, {sq_l2_sql('e.v', f'g{r}.centroid')} AS cdist FROM e JOIN p{r} USING (vec_id) JOIN g{r} USING (lead)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cdist, g{r}.cid) = 1)""")
        if r < rounds:
            parts.append(mean_sql(f"a{r}", "cid", f"c{r + 1}"))
    return ", ".join(parts) + f" SELECT vec_id, cid, round(cdist, 6) AS cdist FROM a{rounds}"


@query("kmeans_ivf_rounds", two_level_sql(16, 4, 2, 2))
def kmeans_ivf_rounds(spark, d):
    emb = embeddings(spark, d)
    assigned, _ = cluster.kmeans(emb, cluster.sample_rows(emb, 16), max_iter=2, tol=0.0, coarse=4, nprobe=2)
    return assigned.select("vec_id", "cid", F.round("cdist", 6).alias("cdist"))


def spherical_sql(k: int, rounds: int) -> str:
    """Spherical k-means unrolled: nearest by inner product, means scaled to length 1."""
    near = lambda name, c: f"""{name} AS (SELECT vec_id, v, cid, s AS sim FROM (SELECT e.vec_id, e.v, c.cid, {dot_sql('e.v', 'c.centroid')} AS s FROM e CROSS JOIN {c} c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cid) = 1)"""  # noqa: E731
    parts = [f"WITH {E_SQL}", centroids_sql(k, "c0")]
    for r in range(rounds):
        length = f"sqrt({dot_sql('centroid', 'centroid')})"
        parts += [near(f"a{r}", f"c{r}"), mean_sql(f"a{r}", "cid", f"m{r}"), f"c{r + 1} AS (SELECT cid, list_transform(centroid, lambda x: x / {length}) AS centroid FROM m{r})"]
    return ", ".join([*parts, near("af", f"c{rounds}")])


@query("kmeans_spherical", spherical_sql(7, 3) + " SELECT vec_id, cid, round(sim, 6) AS centroid_sim FROM af")
def kmeans_spherical(spark, d):
    emb = embeddings(spark, d)
    assigned, _ = cluster.kmeans(emb, cluster.sample_rows(emb, 7), max_iter=3, tol=0.0, spherical=True)
    return assigned.select("vec_id", "cid", F.round(-F.col("cdist"), 6).alias("centroid_sim"))


MINI_BATCHES, MINI_SEED = 4, 11


def minibatch_sql(k: int) -> str:
    """Mini-batch steps unrolled; ``n`` is how many rows a centroid has seen."""
    parts = [f"WITH {E_SQL}", centroids_sql(k, "i"), "c0 AS (SELECT cid, centroid, 0::BIGINT AS n FROM i)"]
    for b in range(MINI_BATCHES):
        own = f"b{b} AS (SELECT * FROM e WHERE {id_hash_sql('vec_id', MINI_SEED)} % {MINI_BATCHES} = {b})"
        near = assign_cte(f"a{b}", f"c{b}").replace("FROM e CROSS JOIN", f"FROM b{b} e CROSS JOIN")
        step = f"""c{b + 1} AS (SELECT c.cid, c.n + coalesce(m.n, 0) AS n, CASE WHEN m.n IS NULL THEN c.centroid ELSE
  list_transform(list_zip(c.centroid, m.mean), lambda t: t[1] + (t[2] - t[1]) * (m.n::DOUBLE / (c.n + m.n))) END AS centroid FROM c{b} c LEFT JOIN m{b} m USING (cid))"""
        parts += [own, near, mean_sql(f"a{b}", "cid", f"m{b}", out="mean"), step]
    return ", ".join([*parts, assign_cte("af", f"c{MINI_BATCHES}")])


@query("kmeans_minibatch", minibatch_sql(10) + " SELECT vec_id, cid, round(cdist, 6) AS cdist FROM af")
def kmeans_minibatch(spark, d):
    emb = embeddings(spark, d)
    assigned, _ = cluster.minibatch_kmeans(emb, initial(emb, 10), batches=MINI_BATCHES, seed=MINI_SEED)
    return assigned.select("vec_id", "cid", F.round("cdist", 6).alias("cdist"))


@query("kmeans_sampled_fit")
def kmeans_sampled_fit(spark, d):
    assigned, _ = cluster.mllib_kmeans(embeddings(spark, d), 10, cosine=False, fit_share=0.5, normalize_centroids=True)
    return assigned.select("vec_id", "cid", F.round("cdist", 6).alias("cdist"))


@query("cluster_sizes", with_clusters_sql(10) + " SELECT cid, count(*) AS n FROM a GROUP BY cid")
def cluster_sizes(spark, d):
    return cluster.cluster_sizes(clustered(spark, d, 10))


@query("cluster_sorted", with_clusters_sql(10) + f", s AS (SELECT a.vec_id, a.cid, {dot_sql('a.v', 'c.centroid')} AS sim FROM a JOIN c USING (cid)) SELECT *, row_number() OVER (PARTITION BY cid ORDER BY sim DESC, vec_id) AS rank FROM s")
def cluster_sorted(spark, d):
    emb = embeddings(spark, d)
    centroids = initial(emb, 10)
    rows = knn.assign(emb, centroids).join(centroids, "cid")
    return cluster.cluster_sorted(rows, V.dot("embedding", "centroid"))


# --- seeding ---------------------------------------------------------------------------


def weighted_pick(i: int) -> str:
    return f"CASE WHEN mind > 0 THEN -ln(({id_hash_sql('vec_id', i)} + 1)::DOUBLE / 2147483648.0) / mind ELSE 'inf'::DOUBLE END"


def seeding_sql(k: int, pick) -> str:
    h = id_hash_sql("vec_id", 0)
    parts = [f"WITH {E_SQL}", f"s0 AS (SELECT 0::BIGINT AS step, vec_id, v, NULL::DOUBLE AS mind FROM e ORDER BY {h}, vec_id LIMIT 1)"]
    for i in range(1, k):
        chosen = " UNION ALL ".join(f"SELECT v FROM s{j}" for j in range(i))
        parts.append(f"m{i} AS (SELECT e.vec_id, e.v, min({sq_l2_sql('e.v', 'k.v')}) AS mind FROM e CROSS JOIN ({chosen}) k GROUP BY e.vec_id, e.v)")
        parts.append(f"s{i} AS (SELECT {i}::BIGINT AS step, vec_id, v, mind FROM m{i} ORDER BY {pick(i)}, vec_id LIMIT 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT step, vec_id, mind FROM s{i}" for i in range(k))


@query("kmeans_pp_seeding", seeding_sql(5, weighted_pick))
def kmeans_pp_seeding(spark, d):
    return cluster.seed_centers(embeddings(spark, d), 5, how="weighted")


@query("kcenter_greedy", seeding_sql(5, lambda i: "mind DESC"))
def kcenter_greedy(spark, d):
    return cluster.seed_centers(embeddings(spark, d), 5, how="farthest")


def seeding_from_sql(ctes: str, rows: str, k: int, pick, centers: str | None = None) -> str:
    """``seeding_sql`` over any CTE (vec_id, v), after given centres (v) or from the first row by hash."""
    parts, first = [ctes], 0
    if centers is None:
        parts.append(f"s0 AS (SELECT 0::BIGINT AS step, vec_id, v, NULL::DOUBLE AS mind FROM {rows} ORDER BY {id_hash_sql('vec_id', 0)}, vec_id LIMIT 1)")
        first = 1
    for i in range(first, k):
        chosen = " UNION ALL ".join([*([f"SELECT v FROM {centers}"] if centers else []), *[f"SELECT v FROM s{j}" for j in range(i)]])
        parts.append(f"m{i} AS (SELECT e.vec_id, any_value(e.v) AS v, min({sq_l2_sql('e.v', 'k.v')}) AS mind FROM {rows} e CROSS JOIN ({chosen}) k GROUP BY e.vec_id)")
        parts.append(f"s{i} AS (SELECT {i}::BIGINT AS step, vec_id, v, mind FROM m{i} ORDER BY {pick(i)}, vec_id LIMIT 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT step, vec_id, round(mind, 6) AS mind FROM s{i}" for i in range(k))


@query("badge_select", seeding_from_sql(GRAD_SQL + """, sc AS (SELECT vec_id, b, list_transform(p, lambda x, i: x - CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) AS s FROM g),
bv AS (SELECT vec_id, flatten(list_transform(s, lambda x: list_transform(b, lambda h: x * h))) AS v FROM sc)""", "bv", 5, weighted_pick))
def badge_select(spark, d):
    probs = _class_probs(spark, d)
    badge = probs.select("vec_id", V.outer_flat(V.minus_onehot("p", V.argmax("p")), "b").alias("embedding"))
    return cluster.seed_centers(badge, 5, how="weighted").select("step", "vec_id", F.round("mind", 6).alias("mind"))


@query("calinski_harabasz", f"""WITH {E_SQL}, {mean_sql('e', 'label', 'lm')}, g0 AS (SELECT 0 AS one, v FROM e), {mean_sql('g0', 'one', 'gm')},
b AS (SELECT sum(floor(n * {dot_sql('centroid', 'centroid')} * 1e9 + 0.5)::HUGEINT)::DOUBLE AS b, count(*) AS k FROM lm),
s AS (SELECT sum(floor({dot_sql('v', 'v')} * 1e9 + 0.5)::HUGEINT)::DOUBLE AS sq, count(*) AS total FROM e)
SELECT k, total, round(((b / 1e9 - total * {dot_sql('gm.centroid', 'gm.centroid')}) / (k - 1)) / (((sq - b) / 1e9) / (total - k)), 6) AS score FROM b, s, gm""")
def calinski_harabasz(spark, d):
    scored = cluster.calinski_harabasz(embeddings(spark, d), cid_col="label")
    return scored.withColumn("score", F.round("score", 6))


@query("cluster_contingency", with_clusters_sql(10) + " SELECT cid, label, count(*) AS n FROM a GROUP BY ALL")
def cluster_contingency(spark, d):
    return cluster.cluster_contingency(clustered(spark, d, 10), "cid", "label")


def matching_sql(k: int) -> str:
    """The best one-to-one match by a table over sets of labels, one cluster after the other."""
    parts = [
        with_clusters_sql(k), "cn AS (SELECT cid, label, count(*) AS n FROM a GROUP BY ALL)", "ri AS (SELECT cid, row_number() OVER (ORDER BY cid) - 1 AS i FROM (SELECT DISTINCT cid FROM cn))",
        "li AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS j FROM (SELECT DISTINCT label FROM cn))", "g AS (SELECT i, j, n FROM cn JOIN ri USING (cid) JOIN li USING (label))", "d0 AS (SELECT 0::BIGINT AS used, 0::BIGINT AS best)",
    ]
    for i in range(k):
        parts.append(f"""d{i + 1} AS (SELECT used, max(best) AS best FROM (SELECT used, best FROM d{i} UNION ALL
  SELECT used | (1::BIGINT << j::INTEGER), best + n FROM d{i} JOIN g ON i = {i} AND (used >> j::INTEGER) & 1 = 0) GROUP BY used)""")
    return ", ".join(parts) + f" SELECT max(best)::BIGINT AS hits, (SELECT sum(n) FROM cn)::BIGINT AS total, max(best) / (SELECT sum(n) FROM cn)::DOUBLE AS accuracy FROM d{k}"


@query("cluster_matched_accuracy", matching_sql(10))
def cluster_matched_accuracy(spark, d):
    return cluster.matched_accuracy(clustered(spark, d, 10), "cid", "label")


# --- deduplication -------------------------------------------------------------------------

FLAGS_SQL = ", ".join(f"coalesce(max_sim > 1.0 - {e}, FALSE) AS {dedup.flag_name(e)}" for e in EPS)
SEM_SQL = f" SELECT a.vec_id, a.cid, max_sim, {FLAGS_SQL} FROM a LEFT JOIN m USING (vec_id)"


@query("semdedup_exact", MAXSIM_SQL + SEM_SQL)
def semdedup_exact(spark, d):
    return dedup.semdedup(clustered(spark, d, 5), EPS)


@query("semdedup_lsh", LSH_MAX_SQL + SEM_SQL)
def semdedup_lsh(spark, d):
    return dedup.semdedup(clustered(spark, d, 5), EPS, mode="lsh", **lsh_setting())


SEM_IVF_SQL = with_clusters_sql(5) + f""", {centroids_sql(8, 'cc', 1)}, pr AS (SELECT a.vec_id, a.cid, a.v, cc.cid AS cell,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY {sq_l2_sql('a.v', 'cc.centroid')}, cc.cid) AS r FROM a CROSS JOIN cc),
hit AS (SELECT x.vec_id, max({dot_sql('x.v', 'y.v')}) AS max_sim FROM pr x JOIN pr y ON x.cid = y.cid AND x.cell = y.cell AND x.vec_id <> y.vec_id WHERE x.r <= 3 AND y.r = 1 GROUP BY x.vec_id),
rest AS (SELECT x.vec_id, max({dot_sql('x.v', 'y.v')}) AS max_sim FROM a x JOIN a y ON x.cid = y.cid AND x.vec_id <> y.vec_id WHERE x.vec_id NOT IN (SELECT vec_id FROM hit) GROUP BY x.vec_id),
m AS (SELECT * FROM hit UNION ALL SELECT * FROM rest)"""


@query("semdedup_ivf", SEM_IVF_SQL + SEM_SQL)
def semdedup_ivf(spark, d):
    cells = initial(embeddings(spark, d), 8, seed=1)
    return dedup.semdedup(clustered(spark, d, 5), EPS, mode="ivf", centroids=cells, nprobe=3)


def components_sql(eps: float, n: str) -> str:
    """CTEs comp<n>(id, component): recursive reachability over the pairs of one threshold."""
    return f"""ed{n} AS (SELECT id_a AS u, id_b AS v FROM prs WHERE sim > 1.0 - {eps} UNION ALL SELECT id_b, id_a FROM prs WHERE sim > 1.0 - {eps}),
reach{n} AS (SELECT u AS id, u AS r FROM ed{n} UNION SELECT ed{n}.v, reach{n}.r FROM reach{n} JOIN ed{n} ON ed{n}.u = reach{n}.id),
comp{n} AS (SELECT id, min(r) AS component FROM reach{n} GROUP BY id)"""


RPAIRS_SQL = PAIRS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


@query("dup_components", RPAIRS_SQL + ", " + components_sql(0.65, "") + " SELECT id AS vec_id, component FROM comp")
def dup_components(spark, d):
    edges = knn.similarity_forest(clustered(spark, d, 5), 1.0 - 0.65, within="cid")
    return dedup.connected_components(edges).select(F.col("id").alias("vec_id"), "component")


def prototype_sql(n: str) -> str:
    return f"""mem{n} AS (SELECT component, vec_id, v FROM comp{n} JOIN e ON e.vec_id = comp{n}.id), {mean_sql(f'mem{n}', 'component', f'mn{n}', out='mean')},
proto{n} AS (SELECT component, vec_id AS prototype, sim FROM (SELECT component, vec_id, round({dot_sql('v', f"list_transform(mean, lambda x: x / sqrt({dot_sql('mean', 'mean')}))")}, 12) AS sim
  FROM mem{n} JOIN mn{n} USING (component)) QUALIFY row_number() OVER (PARTITION BY component ORDER BY sim DESC, vec_id) = 1)"""


@query("dup_prototype", RPAIRS_SQL + ", " + components_sql(0.65, "") + ", " + prototype_sql("") + " SELECT component, prototype, round(sim, 6) AS sim FROM proto")
def dup_prototype(spark, d):
    assigned = clustered(spark, d, 5)
    groups = dedup.connected_components(knn.similarity_forest(assigned, 1.0 - 0.65, within="cid")).withColumnRenamed("id", "vec_id")
    best = dedup.prototypes(groups.join(assigned.select("vec_id", "embedding"), "vec_id"))
    return best.select("component", "prototype", F.round("sim", 6).alias("sim"))


FAIR_SQL = RPAIRS_SQL + "".join(f", {components_sql(e, str(i))}, {prototype_sql(str(i))}" for i, e in enumerate(EPS))
FAIR_FLAGS = ", ".join(
    f"(vec_id IN (SELECT id FROM comp{i}) AND vec_id NOT IN (SELECT prototype FROM proto{i})) AS {dedup.flag_name(e)}" for i, e in enumerate(EPS)
)


@query("fairdedup", FAIR_SQL + f" SELECT vec_id, cid, {FAIR_FLAGS} FROM a")
def fairdedup(spark, d):
    return dedup.fairdedup(clustered(spark, d, 5), EPS)


@query("dedup_kept", MAXSIM_SQL + " SELECT a.vec_id FROM a LEFT JOIN m USING (vec_id) WHERE NOT coalesce(max_sim > 1.0 - 0.6, FALSE)")
def dedup_kept(spark, d):
    return dedup.kept_ids(semdedup_exact(spark, d), 0.60)


@query("dedup_stats", MAXSIM_SQL + f""", f AS ({SEM_SQL}), r AS ({" UNION ALL ".join(f"SELECT {e}::DOUBLE AS eps, count(*) AS total, count(*) FILTER ({dedup.flag_name(e)}) AS removed FROM f" for e in EPS)})
SELECT eps, total, removed, total - removed AS kept, round(100.0 * removed / total, 4)::DOUBLE AS percent FROM r""")
def dedup_stats(spark, d):
    return dedup.dedup_stats(semdedup_exact(spark, d), EPS)


@query("dedup_compare", MAXSIM_SQL + LSH_MAX_SQL[LSH_MAX_SQL.index(", pl AS"):].replace(",\nm AS", ",\nm2 AS") + """,
j AS (SELECT coalesce(m.max_sim > 1.0 - 0.6, FALSE) AS x, coalesce(m2.max_sim > 1.0 - 0.6, FALSE) AS y FROM a LEFT JOIN m USING (vec_id) LEFT JOIN m2 USING (vec_id)),
n AS (SELECT count(*) FILTER (x AND y) AS b, count(*) FILTER (x AND NOT y) AS o1, count(*) FILTER (NOT x AND y) AS o2 FROM j)
SELECT b AS both, o1 AS only_first, o2 AS only_second, round(b / nullif(b + o1, 0)::DOUBLE, 6) AS recall, round(b / nullif(b + o2, 0)::DOUBLE, 6) AS precision, o1 = o2 AS same_count FROM n""")
def dedup_compare(spark, d):
    flag = F.col(dedup.flag_name(0.60))
    return dedup.dedup_compare(semdedup_exact(spark, d), semdedup_lsh(spark, d), flag, flag)
