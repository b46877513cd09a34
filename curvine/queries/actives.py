"""Active-learning acquisition and bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql
from curvine.operators import active, knn
from curvine.queries.clusters import mean_sql, seeding_from_sql, weighted_pick
from curvine.queries.joins import L2_XY, LABELED_SQL, SPLIT_SQL, knn_sql, labeled_and_pool
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, softmax_sql, sq_l2_sql, table

C = 4

# Logits: the first four elements times 8; the class is the label modulo 4.


def _rows(spark, d):
    logits = V.scale(F.slice("embedding", 1, C), F.lit(8.0))
    return embeddings(spark, d).select("vec_id", "embedding", logits.alias("logits"), F.pmod("label", F.lit(C)).alias("label"))


CAL_SQL = SPLIT_SQL + f""", lg AS (SELECT vec_id, label % {C} AS y, list_transform(v[1:{C}], lambda x: x * 8) AS z FROM e),
pz AS (SELECT vec_id, y, z, {softmax_sql('z')} AS p, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS lse FROM lg),
pb AS (SELECT *, list_transform(z, lambda x: x - lse) AS lq, list_position(z, list_max(z)) AS pred, list_max(p) AS conf, list_sum(list_transform(p, lambda x: x * ln(x))) AS ne FROM pz),
nn AS {knn_sql(L2_XY, 10)},
dv AS (SELECT query_id AS vec_id, rank, neighbor_id, n.ne - {dot_sql('n.p', 'c.lq')} AS kl, -c.lq[n.y + 1] AS ce, n.conf, n.pred = c.pred AS same FROM nn JOIN pb n ON n.vec_id = neighbor_id JOIN pb c ON c.vec_id = query_id)"""


def _divergence(spark, d, **options):
    labeled, pool = labeled_and_pool(_rows(spark, d))
    near = knn.knn_join(pool, labeled, 10, "sq_l2")
    return active.neighbor_divergence(near, pool, labeled, **options)


@query("cal_select", CAL_SQL + " SELECT vec_id, round(avg(kl), 6) AS score FROM dv GROUP BY vec_id ORDER BY round(avg(kl), 9) DESC, vec_id LIMIT 20")
def cal_select(spark, d):
    labeled, pool = labeled_and_pool(_rows(spark, d))
    return active.cal_select(pool, labeled, b=20).select("vec_id", F.round("score", 6).alias("score"))


@query("cal_scores_ops", CAL_SQL + """ SELECT vec_id, round(avg(kl), 6) AS score_mean, round(max(kl), 6) AS score_max, round(median(kl), 6) AS score_median,
  round(avg(CASE WHEN conf > 0.5 THEN kl ELSE 0 END), 6) AS masked_mean, round(avg(ce), 6) AS ce_mean FROM dv GROUP BY vec_id""")
def cal_scores_ops(spark, d):
    plain = active.cal_scores(_divergence(spark, d), ["mean", "max", "median"], digits=6).drop("n_agree", "any_agree")
    masked = active.cal_scores(_divergence(spark, d, conf_thresh=0.5), "mean", digits=6).select("vec_id", F.col("score").alias("masked_mean"))
    ce = active.cal_scores(_divergence(spark, d, loss="ce"), "mean", digits=6).select("vec_id", F.col("score").alias("ce_mean"))
    return plain.join(masked, "vec_id").join(ce, "vec_id")


@query("cal_select_reverse", CAL_SQL + " SELECT vec_id, round(avg(ce), 6) AS score FROM dv GROUP BY vec_id ORDER BY round(avg(ce), 9), vec_id LIMIT 20")
def cal_select_reverse(spark, d):
    labeled, pool = labeled_and_pool(_rows(spark, d))
    picks = active.cal_select(pool, labeled, b=20, loss="ce", reverse=True)
    return picks.select("vec_id", F.round("score", 6).alias("score"))


@query("cal_agreement", CAL_SQL + " SELECT vec_id, count(*) FILTER (same) AS n_agree, bool_or(same) AS any_agree FROM dv GROUP BY vec_id")
def cal_agreement(spark, d):
    return active.cal_scores(_divergence(spark, d)).select("vec_id", "n_agree", "any_agree")


@query("cal_labeled_centric", CAL_SQL + f""", rn AS {knn_sql(L2_XY, 10, 'l', 'q')}, rk AS (SELECT neighbor_id AS vec_id, query_id AS lab, n.ne - {dot_sql('n.p', 'c.lq')} AS kl FROM rn JOIN pb n ON n.vec_id = query_id JOIN pb c ON c.vec_id = neighbor_id)
SELECT vec_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(kl ORDER BY lab)), lambda s, x: (s + x) / 2), 6) AS score FROM rk GROUP BY vec_id""")
def cal_labeled_centric(spark, d):
    labeled, pool = labeled_and_pool(_rows(spark, d))
    near = knn.knn_join(labeled, pool, 10, "sq_l2").select(
        F.col("neighbor_id").alias("query_id"), F.col("query_id").alias("neighbor_id"), "rank", "dist"
    )
    scores = active.labeled_centric_scores(active.neighbor_divergence(near, pool, labeled))
    return scores.select("vec_id", F.round("score", 6).alias("score"))


@query("neighbor_reuse_stats", SPLIT_SQL + f""", nn AS {knn_sql(L2_XY, 10)} SELECT count(DISTINCT neighbor_id) AS distinct_neighbors, count(*) AS accesses, count(*) - count(DISTINCT neighbor_id) AS hits,
  round(100.0::DOUBLE * (count(*) - count(DISTINCT neighbor_id)) / count(*), 6) AS savings_percent, round(count(*)::DOUBLE / count(DISTINCT neighbor_id), 6) AS average_reuse FROM nn""")
def neighbor_reuse_stats(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return active.reuse_stats(knn.knn_join(pool, labeled, 10, "sq_l2")).withColumn("accesses", F.col("accesses").cast("bigint"))


# --- uncertainty over four sampled passes of four classes ----------------------------


def _mc(spark, d):
    v = V.scale(F.slice("embedding", 1, 16), F.lit(8.0))
    passes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("_v", k * 4 + 1, 4))
    return embeddings(spark, d).select("vec_id", v.alias("_v")).select("vec_id", passes.alias("mc"))


MC_SQL = f"""WITH {E_SQL}, z AS (SELECT vec_id, list_transform([1, 5, 9, 13], lambda o: list_transform(v[o:o + 3], lambda x: x * 8)) AS zz FROM e),
pr AS (SELECT vec_id, [{", ".join(softmax_sql(f'zz[{i}]') for i in (1, 2, 3, 4))}] AS pp FROM z),
m AS (SELECT vec_id, pp, list_transform([1, 2, 3, 4], lambda c: (pp[1][c] + pp[2][c] + pp[3][c] + pp[4][c]) / 4) AS mean FROM pr), s AS (SELECT *, list_sort(mean, 'DESC') AS o FROM m)"""
ENT = "-list_sum(list_transform({}, lambda x: x * ln(x)))"


def _uncertainty(spark, d, *methods):
    scores = active.uncertainty_scores(_mc(spark, d), "mc", methods)
    return scores.select("vec_id", *[F.round(m, 6).alias(m) for m in methods])


@query("unc_least_conf", MC_SQL + " SELECT vec_id, round(1.0 - o[1], 6) AS least_conf FROM s")
def unc_least_conf(spark, d):
    return _uncertainty(spark, d, "least_conf")


@query("unc_margin_ratio", MC_SQL + " SELECT vec_id, round(1.0 - (o[1] - o[2]), 6) AS margin, round(o[2] / o[1], 6) AS ratio FROM s")
def unc_margin_ratio(spark, d):
    return _uncertainty(spark, d, "margin", "ratio")


@query("unc_entropy", MC_SQL + f" SELECT vec_id, round({ENT.format('mean')}, 6) AS entropy FROM s")
def unc_entropy(spark, d):
    return _uncertainty(spark, d, "entropy")


@query("unc_std", MC_SQL + " SELECT vec_id, round(list_avg(list_transform([1, 2, 3, 4], lambda c: list_stddev_samp([pp[1][c], pp[2][c], pp[3][c], pp[4][c]]))), 6) AS std FROM s")
def unc_std(spark, d):
    return _uncertainty(spark, d, "std")


@query("unc_bald", MC_SQL + f" SELECT vec_id, round({ENT.format('mean')} - ({' + '.join(ENT.format(f'pp[{i}]') for i in (1, 2, 3, 4))}) / 4, 6) AS bald FROM s")
def unc_bald(spark, d):
    return _uncertainty(spark, d, "bald")


def batchbald_sql(b: int) -> str:
    parts = [MC_SQL, f"cd AS (SELECT vec_id, pp, ({' + '.join(ENT.format(f'pp[{i}]') for i in (1, 2, 3, 4))}) / 4 AS cond FROM pr)", "j0 AS (SELECT [1.0::DOUBLE, 1.0, 1.0, 1.0] AS w)"]
    for t in range(b):
        mixed = " + ".join(f"w[{k}] * pp[{k}][c.c]" for k in (1, 2, 3, 4))
        taken = " UNION ALL ".join(f"SELECT vec_id FROM w{u}" for u in range(t)) or "SELECT -1 AS vec_id"
        spent = " + ".join(f"(SELECT cond FROM w{u})" for u in range(t)) or "0"
        parts.append(f"""w{t} AS (SELECT vec_id, pp, cond, h - cond AS part FROM (SELECT vec_id, pp, cond, sum(-q * ln(q)) AS h FROM (SELECT vec_id, pp, cond, ({mixed}) / 4 AS q FROM cd CROSS JOIN j{t} CROSS JOIN (VALUES (1), (2), (3), (4)) c(c)) GROUP BY ALL)
  WHERE vec_id NOT IN ({taken}) ORDER BY part DESC, vec_id LIMIT 1)""")
        parts.append(f"o{t} AS (SELECT {t}::BIGINT AS step, vec_id, round(part - ({spent}), 6) AS score FROM w{t})")
        parts.append(f"j{t + 1} AS (SELECT [{', '.join(f'w[{k}] * pp[{k}][c.c]' for k in (1, 2, 3, 4))}] AS w FROM j{t} CROSS JOIN w{t} CROSS JOIN (VALUES (1), (2), (3), (4)) c(c))")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM o{t}" for t in range(b))


def _flat_probs(spark, d):
    return active.mc_probabilities(_mc(spark, d), "mc").select("vec_id", F.flatten("_probs").alias("probs"))


@query("batchbald_select", batchbald_sql(3))
def batchbald_select(spark, d):
    picks = active.batchbald_select(_flat_probs(spark, d), 3, samples=4, classes=4)
    return picks.withColumn("score", F.round("score", 6))


@query("batchbald_sampled")
def batchbald_sampled(spark, d):
    picks = active.batchbald_select(_flat_probs(spark, d), 5, samples=4, classes=4, method="sampled", max_configs=64)
    return picks.withColumn("score", F.round("score", 6))


# --- random picks, splits, rounds --------------------------------------------------------


@query("random_select", f"SELECT vec_id FROM embeddings ORDER BY {id_hash_sql('vec_id', 11)}, vec_id LIMIT 25")
def random_select(spark, d):
    return active.pick_random(embeddings(spark, d), 25, seed=11)


@query("farthest_select", seeding_from_sql(f"WITH {E_SQL}, l AS (SELECT * FROM e WHERE {LABELED_SQL}), q AS (SELECT vec_id, v FROM e WHERE NOT ({LABELED_SQL})), {mean_sql('l', 'label', 'lm', out='v')}", "q", 5, lambda i: "mind DESC", "lm"))
def farthest_select(spark, d):
    """Farthest-first picks from the pool, conditioned on the labelled rows' class means."""
    from curvine.operators import cluster

    labeled, pool = labeled_and_pool(embeddings(spark, d))
    centers = cluster.group_means(labeled, ["label"], "embedding", "centroid").withColumnRenamed("label", "cid")
    return cluster.seed_centers(pool, 5, how="farthest", existing=centers).select("step", "vec_id", F.round("mind", 6).alias("mind"))


UNIT_POOL_SQL = f"WITH {E_SQL}, u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt({dot_sql('v', 'v')})) AS v FROM e), l AS (SELECT * FROM u WHERE {LABELED_SQL}), q AS (SELECT * FROM u WHERE NOT ({LABELED_SQL}))"


def _picked(name: str, pick) -> str:
    return f"SELECT vec_id FROM ({seeding_from_sql(UNIT_POOL_SQL, 'q', 6, pick, 'l')})"


@query("cluster_pick_farthest", _picked("farthest", lambda i: "round(mind, 9) DESC"))
def cluster_pick_farthest(spark, d):
    from curvine.operators import cluster

    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return cluster.cluster_pick(pool, 6, how="farthest", labeled=labeled)


@query("cluster_pick_weighted", _picked("weighted", weighted_pick))
def cluster_pick_weighted(spark, d):
    from curvine.operators import cluster

    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return cluster.cluster_pick(pool, 6, how="weighted", labeled=labeled)


def _kmeans_pick_sql(k: int, rounds: int) -> str:
    parts = [UNIT_POOL_SQL, f"c0 AS (SELECT row_number() OVER (ORDER BY {id_hash_sql('vec_id', 0)}, vec_id) - 1 AS cid, v AS centroid FROM q QUALIFY cid < {k})"]
    for r in range(rounds):
        parts.append(f"""a{r} AS (SELECT x.vec_id, x.v, c.cid FROM q x CROSS JOIN c{r} c QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {sq_l2_sql('x.v', 'c.centroid')}, c.cid) = 1)""")
        parts.append(mean_sql(f"a{r}", "cid", f"c{r + 1}"))
    return ", ".join(parts) + f" SELECT DISTINCT vec_id FROM (SELECT x.vec_id FROM q x CROSS JOIN c{rounds} c QUALIFY row_number() OVER (PARTITION BY c.cid ORDER BY {sq_l2_sql('x.v', 'c.centroid')}, x.vec_id) = 1)"


@query("cluster_pick_kmeans", _kmeans_pick_sql(6, 3))
def cluster_pick_kmeans(spark, d):
    from curvine.operators import cluster

    _, pool = labeled_and_pool(embeddings(spark, d))
    return cluster.cluster_pick(pool, 6, how="kmeans", rounds=3)


@query("stratified_split", f"""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT label, n, 100.0::DOUBLE * n / sum(n) OVER () AS exact FROM n),
f AS (SELECT *, floor(exact)::BIGINT AS base FROM t), q AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY base - exact, label) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)
SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {id_hash_sql('vec_id', 5)}, vec_id) <= quota AS selected FROM embeddings JOIN q USING (label)""")
def stratified_split(spark, d):
    return active.stratified_split(embeddings(spark, d), 100, seed=5)


@query("al_round_update", CAL_SQL + f""", pk AS (SELECT vec_id FROM dv GROUP BY vec_id ORDER BY round(avg(kl), 9) DESC, vec_id LIMIT 20)
SELECT vec_id, CASE WHEN {LABELED_SQL} OR vec_id IN (SELECT vec_id FROM pk) THEN 'labeled' ELSE 'pool' END AS state, CASE WHEN {LABELED_SQL} THEN 0 WHEN vec_id IN (SELECT vec_id FROM pk) THEN 1 END AS round FROM e""")
def al_round_update(spark, d):
    state, picks = _state_and_picks(spark, d)
    return active.round_update(state, picks, 1)


def _state_and_picks(spark, d):
    rows = _rows(spark, d)
    labeled, pool = labeled_and_pool(rows)
    state = labeled.select("vec_id", F.lit("labeled").alias("state"), F.lit(0).alias("round")).unionByName(
        pool.select("vec_id", F.lit("pool").alias("state"), F.lit(None).cast("int").alias("round"))
    )
    return state, active.cal_select(pool, labeled, b=20).select("vec_id")


@query("al_round_checks", f"""WITH {E_SQL} SELECT count(*) FILTER ({LABELED_SQL}) + 20 AS n_labeled, count(*) FILTER (NOT ({LABELED_SQL})) - 20 AS n_pool, 20::BIGINT AS n_picked, TRUE AS picks_unique, TRUE AS picks_from_pool, TRUE AS disjoint_and_covering FROM e""")
def al_round_checks(spark, d):
    state, picks = _state_and_picks(spark, d)
    checks = active.round_checks(state, active.round_update(state, picks, 1), picks)
    return checks.withColumn("n_picked", F.col("n_picked").cast("bigint"))


# Documents: labelled ones have a quality label; the longest unlabelled ones are selected.
DOC_SQL = r"""WITH dl AS (SELECT d.doc_id, d.text, d.lang, l.doc_id IS NOT NULL AS lab, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id)),
sl AS (SELECT doc_id FROM dl WHERE NOT lab ORDER BY n_chars DESC, doc_id LIMIT 50), x AS (SELECT dl.*, sl.doc_id IS NOT NULL AS sel FROM dl LEFT JOIN sl USING (doc_id)),
w AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda t: t <> '')) AS n FROM x)"""


def _doc_rows(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    known = table(spark, d, "labels").select("doc_id", F.lit(True).alias("lab"))
    rows = docs.join(known, "doc_id", "left").withColumn("lab", F.col("lab").isNotNull())
    picks = rows.filter(~F.col("lab")).select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(50)
    return rows.join(F.broadcast(picks.select("doc_id", F.lit(True).alias("sel"))), "doc_id", "left").withColumn("sel", F.col("sel").isNotNull())


@query("al_selection_stats", DOC_SQL + " SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, min(n)::BIGINT AS min, max(n)::BIGINT AS max FROM w WHERE sel")
def al_selection_stats(spark, d):
    return active.selection_stats(_doc_rows(spark, d), selected=F.col("sel"), labeled=F.col("lab"), text_col="text", class_col="lang")[0]


@query("al_class_shares", DOC_SQL + """, p AS (SELECT lang, count(*) FILTER (lab) AS b, count(*) FILTER (sel) AS s, count(*) FILTER (lab OR sel) AS a FROM w GROUP BY lang)
SELECT lang, round(100.0::DOUBLE * b / sum(b) OVER (), 6) AS before, round(100.0::DOUBLE * s / sum(s) OVER (), 6) AS selected, round(100.0::DOUBLE * a / sum(a) OVER (), 6) AS after FROM p""")
def al_class_shares(spark, d):
    return active.selection_stats(_doc_rows(spark, d), selected=F.col("sel"), labeled=F.col("lab"), text_col="text", class_col="lang")[1]
