"""Scans, neighbour joins and assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql, in_sample, in_sample_sql, sign_matrix, sign_matrix_sql
from curvine.operators import cluster, evaluation, knn, lsh
from curvine.operators.kth import kth_score
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, softmax_sql, sq_l2_sql

# --- shared inputs ------------------------------------------------------------


def initial(emb, k: int, seed: int = 0):
    """k centroids; how many serve a table is the caller's choice, like any parameter."""
    return cluster.sample_rows(emb, k, seed=seed)


def centroids_sql(k: int, name: str = "c", seed: int = 0) -> str:
    """CTE of k initial centroids drawn in hash order."""
    h = id_hash_sql("vec_id", seed)
    return (
        f"{name} AS (SELECT row_number() OVER (ORDER BY {h}, vec_id) - 1 AS cid, v AS centroid FROM e QUALIFY cid < {k})"
    )


ASSIGN_SQL = f"""a AS (SELECT vec_id, label, v, cid, d AS cdist FROM (
  SELECT e.vec_id, e.label, e.v, c.cid, {sq_l2_sql('e.v', 'c.centroid')} AS d FROM e CROSS JOIN c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) = 1)"""


def with_clusters_sql(k: int) -> str:
    return f"WITH {E_SQL}, {centroids_sql(k)}, {ASSIGN_SQL}"


def clustered(spark, d, k: int):
    emb = embeddings(spark, d)
    return knn.assign(emb, initial(emb, k))


# The labelled set is a random fifth of the rows, the pool is the rest.
LABELED_SEED, LABELED_SHARE = 7, 0.2
LABELED_SQL = in_sample_sql("vec_id", LABELED_SHARE, LABELED_SEED)


def labeled_and_pool(df):
    labeled = in_sample("vec_id", LABELED_SHARE, LABELED_SEED)
    return df.filter(labeled), df.filter(~labeled)


SPLIT_SQL = f"WITH {E_SQL}, l AS (SELECT * FROM e WHERE {LABELED_SQL}), q AS (SELECT * FROM e WHERE NOT ({LABELED_SQL}))"


def knn_sql(dist: str, k: int, queries: str = "q", base: str = "l", cond: str = "TRUE") -> str:
    return f"""(SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rank, neighbor_id, dist FROM (
  SELECT x.vec_id AS query_id, y.vec_id AS neighbor_id, {dist} AS dist FROM {queries} x CROSS JOIN {base} y WHERE {cond})
  QUALIFY rank <= {k})"""


L2_XY = sq_l2_sql("x.v", "y.v")
IP_XY = f"-({dot_sql('x.v', 'y.v')})"


# --- scans ------------------------------------------------------------------------


@query("scan_embeddings", "SELECT vec_id, label, len(embedding)::BIGINT AS dim FROM embeddings")
def scan_embeddings(spark, d):
    from curvine.sources.embeddings import load_embeddings

    return load_embeddings(spark, f"{d}/embeddings.parquet", dim=64).select(
        "vec_id", "label", F.size("embedding").cast("bigint").alias("dim")
    )


@query("head_n", "SELECT doc_id, source, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def head_n(spark, d):
    from curvine.sources.texts import head

    return head(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "n_chars"), 25, "doc_id")


# --- exact joins ---------------------------------------------------------------------


@query("knn_exact_l2", SPLIT_SQL + f" SELECT * FROM {knn_sql(L2_XY, 10)}")
def knn_exact_l2(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return knn.knn_join(pool, labeled, 10, "sq_l2")


@query("knn_exact_cosine", SPLIT_SQL + f""", n AS (SELECT *, sqrt({dot_sql('v', 'v')}) AS norm FROM e), l2 AS (SELECT * FROM n WHERE {LABELED_SQL}), q2 AS (SELECT * FROM n WHERE NOT ({LABELED_SQL}))
 SELECT query_id, rank, neighbor_id, dist FROM {knn_sql(f"1.0::DOUBLE - {dot_sql('x.v', 'y.v')} / (x.norm * y.norm)", 10, 'q2', 'l2')}""")
def knn_exact_cosine(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return knn.knn_join(pool, labeled, 10, "cosine")


PROBS_SQL = SPLIT_SQL + f""", pr AS (SELECT vec_id, label, {softmax_sql('list_transform(v, lambda x: x * 4)')} AS p FROM e),
lp AS (SELECT *, list_transform(p, lambda x: ln(x + 1e-10)) AS lg FROM pr),
lk AS (SELECT *, list_sum(list_transform(list_zip(p, lg), lambda t: t[1] * t[2])) AS ne FROM lp WHERE {LABELED_SQL}), lq AS (SELECT * FROM lp WHERE NOT ({LABELED_SQL}))"""
KL_XY = f"y.ne - {dot_sql('y.p', 'x.lg')}"
CROSS_XY = f"-({dot_sql('x.p', 'y.lg')})"


def prob_rows(spark, d):
    return embeddings(spark, d).select("vec_id", "label", V.softmax(V.scale("embedding", F.lit(4.0))).alias("p"))


@query("knn_kl", PROBS_SQL + f" SELECT query_id, rank, neighbor_id, round(dist, 6) AS dist FROM {knn_sql(KL_XY, 5, 'lq', 'lk')}")
def knn_kl(spark, d):
    labeled, pool = labeled_and_pool(prob_rows(spark, d))
    near = knn.knn_join(pool, labeled, 5, "kl", vec_col="p")
    return near.withColumn("dist", F.round("dist", 6))


MAXSIM_SQL = with_clusters_sql(5) + f""", m AS (SELECT x.vec_id, max({dot_sql('x.v', 'y.v')}) AS max_sim
  FROM a x JOIN a y ON x.cid = y.cid AND x.vec_id <> y.vec_id GROUP BY x.vec_id)"""


@query("max_sim_in_cluster", MAXSIM_SQL + " SELECT vec_id, max_sim FROM m")
def max_sim_in_cluster(spark, d):
    return knn.max_similarity(clustered(spark, d, 5), within="cid")


@query("knn_kth_distance", f"WITH {E_SQL}, n AS {knn_sql(L2_XY, 10, 'e', 'e', 'x.vec_id <> y.vec_id')} SELECT e.vec_id, -n.dist AS score FROM e LEFT JOIN n ON e.vec_id = n.query_id AND n.rank = 10")
def knn_kth_distance(spark, d):
    emb = embeddings(spark, d)
    return kth_score(emb, emb, 10, exclude_self=True)


# --- hashing ------------------------------------------------------------------------------

TABLES, BITS, LSH_SEED = 8, 6, 3


def lsh_setting() -> dict:
    return {"matrix": lsh.planes(TABLES, BITS, 64, LSH_SEED), "bits": BITS}


CODES_SQL = f"""pl AS ({sign_matrix_sql(TABLES * BITS, 64, LSH_SEED)}),
codes AS (SELECT vec_id, row // {BITS} AS tbl, sum(CASE WHEN {dot_sql('signs', 'v')} >= 0 THEN 1 << ({BITS - 1} - row % {BITS})::INT ELSE 0 END)::BIGINT AS code
  FROM e CROSS JOIN pl GROUP BY vec_id, tbl)"""


@query("lsh_sign_codes", f"WITH {E_SQL}, {CODES_SQL} SELECT vec_id, list(code ORDER BY tbl) AS codes FROM codes GROUP BY vec_id")
def lsh_sign_codes(spark, d):
    emb = embeddings(spark, d)
    return lsh.sign_codes(emb, **lsh_setting()).select("vec_id", "codes")


@query("lsh_candidate_pairs", f"""WITH {E_SQL}, {CODES_SQL}, p AS (SELECT DISTINCT x.vec_id AS id_a, y.vec_id AS id_b FROM codes x JOIN codes y ON x.tbl = y.tbl AND x.code = y.code AND x.vec_id < y.vec_id)
SELECT id_a, id_b, {dot_sql('x.v', 'y.v')} AS sim FROM p JOIN e x ON x.vec_id = id_a JOIN e y ON y.vec_id = id_b WHERE {dot_sql('x.v', 'y.v')} > 0.35""")
def lsh_candidate_pairs(spark, d):
    emb = embeddings(spark, d)
    return lsh.candidate_pairs(emb, min_sim=0.35, **lsh_setting())


LSH_MAX_SQL = with_clusters_sql(5) + f", {CODES_SQL}" + f""", p AS (SELECT DISTINCT x.vec_id AS i, y.vec_id AS j FROM codes x JOIN codes y ON x.tbl = y.tbl AND x.code = y.code AND x.vec_id <> y.vec_id),
m AS (SELECT i AS vec_id, max({dot_sql('x.v', 'y.v')}) AS max_sim FROM p JOIN a x ON x.vec_id = i JOIN a y ON y.vec_id = j WHERE x.cid = y.cid GROUP BY i)"""


@query("max_sim_lsh", LSH_MAX_SQL + " SELECT vec_id, max_sim FROM m")
def max_sim_lsh(spark, d):
    return lsh.max_similarity_lsh(clustered(spark, d, 5), within="cid", **lsh_setting())


WIDE_ROWS, WIDE, WIDE_SEED = 3, 1.5, 5
WIDE_SQL = f"""pl AS ({sign_matrix_sql(WIDE_ROWS, 64, WIDE_SEED)}),
wide AS (SELECT vec_id, list(floor({dot_sql('signs', 'v')} / {WIDE})::BIGINT ORDER BY row) AS codes FROM e CROSS JOIN pl GROUP BY vec_id)"""
BUCKET_KNN_SQL = SPLIT_SQL + f", {WIDE_SQL}, near AS " + f"""(SELECT x.vec_id AS query_id, row_number() OVER (PARTITION BY x.vec_id ORDER BY {L2_XY}, y.vec_id) AS rank, y.vec_id AS neighbor_id, {L2_XY} AS dist
  FROM q x JOIN wide wx ON wx.vec_id = x.vec_id JOIN wide wy ON wx.codes = wy.codes JOIN l y ON wy.vec_id = y.vec_id QUALIFY rank <= 5)"""


def _wide_bucket(df):
    return lsh.by_all(lsh.width_codes(df, sign_matrix(WIDE_ROWS, 64, WIDE_SEED), WIDE))


@query("lsh_bucket_knn", BUCKET_KNN_SQL + " SELECT * FROM near")
def lsh_bucket_knn(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return lsh.lsh_knn_join(pool, labeled, 5, bucket=_wide_bucket, overlapping=False, fallback="none")


@query("lsh_knn_with_fallback", BUCKET_KNN_SQL + f""", full_ AS (SELECT DISTINCT query_id FROM near WHERE rank = 5), rest AS (SELECT * FROM q WHERE vec_id NOT IN (SELECT query_id FROM full_))
SELECT * FROM near WHERE query_id IN (SELECT query_id FROM full_) UNION ALL SELECT * FROM {knn_sql(L2_XY, 5, 'rest', 'l')}""")
def lsh_knn_with_fallback(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return lsh.lsh_knn_join(pool, labeled, 5, bucket=_wide_bucket, overlapping=False)


@query("brp_lsh_join", f"""WITH {E_SQL}, pl AS ({sign_matrix_sql(4, 64, 9)}),
wide AS (SELECT vec_id, row AS tbl, floor({dot_sql('signs', 'v')} / 0.5)::BIGINT AS code FROM e CROSS JOIN pl),
p AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id AS neighbor_id FROM wide x JOIN wide y ON x.tbl = y.tbl AND x.code = y.code AND x.vec_id <> y.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {L2_XY}, neighbor_id) AS rank, neighbor_id, {L2_XY} AS dist
FROM p JOIN e x ON x.vec_id = query_id JOIN e y ON y.vec_id = neighbor_id QUALIFY rank <= 5""")
def brp_lsh_join(spark, d):
    emb = embeddings(spark, d)
    planes = sign_matrix(4, 64, 9)
    return lsh.lsh_knn_join(
        emb, emb, 5, bucket=lambda df: lsh.by_table(lsh.width_codes(df, planes, 0.5)), overlapping=True, fallback="none", exclude_self=True
    )


# --- inverted file, two stages, growing index --------------------------------------------------

CELLS_SQL = f"""cells AS (SELECT vec_id, v, cid FROM a), probes AS (SELECT vec_id, v, cid FROM (SELECT e.vec_id, e.v, c.cid,
  row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2_sql('e.v', 'c.centroid')}, c.cid) AS r FROM e CROSS JOIN c) WHERE r <= 4)"""


@query("knn_ivf", with_clusters_sql(20) + f""", {CELLS_SQL}
SELECT query_id, rank, neighbor_id, dist FROM {knn_sql(L2_XY, 5, 'probes', 'cells', f'x.cid = y.cid AND x.vec_id <> y.vec_id')}""")
def knn_ivf(spark, d):
    emb = embeddings(spark, d)
    return knn.ivf_knn_join(emb, emb, initial(emb, 20), 5, 4, exclude_self=True)


@query("knn_two_stage", SPLIT_SQL + f""", m AS ({sign_matrix_sql(8, 64, 42)}), low AS (SELECT vec_id, list({dot_sql('signs', 'v')} ORDER BY row) AS v FROM e CROSS JOIN m GROUP BY vec_id),
ll AS (SELECT * FROM low WHERE {LABELED_SQL}), lq AS (SELECT * FROM low WHERE NOT ({LABELED_SQL})), rough AS {knn_sql(L2_XY, 20, 'lq', 'll')}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {L2_XY}, neighbor_id) AS rank, neighbor_id, {L2_XY} AS dist
FROM rough JOIN e x ON x.vec_id = query_id JOIN e y ON y.vec_id = neighbor_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {L2_XY}, neighbor_id) <= 10""")
def knn_two_stage(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return knn.two_stage_knn_join(pool, labeled, sign_matrix(8, 64, 42), 10)


@query("ivf_incremental_assign", f"""WITH {E_SQL}, {centroids_sql(20)}, {ASSIGN_SQL}, n AS (SELECT count(*) FILTER ({LABELED_SQL}) AS n_previous, count(*) AS n_current, 0::BIGINT AS n_gone,
  count(*) FILTER (NOT ({LABELED_SQL})) AS n_added FROM e)
SELECT a.cid, count(*) FILTER ({LABELED_SQL}) AS n_old, count(*) FILTER (NOT ({LABELED_SQL})) AS n_new, any_value(n_added::DOUBLE / n_current < 0.3) AS reuse FROM a CROSS JOIN n GROUP BY a.cid""")
def ivf_incremental_assign(spark, d):
    """New rows join the cells of the old index; the rule says whether that is still allowed."""
    emb = embeddings(spark, d)
    labeled, pool = labeled_and_pool(emb)
    centroids = initial(emb, 20)
    old, new = knn.assign(labeled, centroids), knn.assign(pool, centroids)
    cells = old.select("cid", F.lit(1).alias("o"), F.lit(0).alias("w")).unionByName(new.select("cid", F.lit(0).alias("o"), F.lit(1).alias("w")))
    rule = knn.ivf_refresh(labeled.select(F.col("vec_id").alias("id")), emb.select(F.col("vec_id").alias("id"))).select("reuse")
    counts = cells.groupBy("cid").agg(F.sum("o").alias("n_old"), F.sum("w").alias("n_new"))
    return counts.select("*", rule.scalar().alias("reuse"))


# Three rounds by the hash of the id: 60, 20 and 20 in a hundred rows.
ROUND_SEED, ROUND_ENDS = 17, (0.6, 0.8, 1.0)


def _stored_sql(last: int) -> str:
    """Search of rounds 0 to ``last``, as if one index had been built from them."""
    here = f"cells{last}"
    return f"""{here} AS (SELECT * FROM a WHERE {in_sample_sql('vec_id', ROUND_ENDS[last], ROUND_SEED)}),
probes{last} AS (SELECT e.vec_id, e.v, c.cid FROM e CROSS JOIN (SELECT * FROM c WHERE cid IN (SELECT cid FROM {here})) c
  QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2_sql('e.v', 'c.centroid')}, c.cid) <= 4)"""


@query("ivf_stored_rounds", with_clusters_sql(20) + f""", {_stored_sql(1)}, {_stored_sql(2)}
SELECT 1 AS round, query_id, rank, neighbor_id, dist FROM {knn_sql(L2_XY, 5, 'probes1', 'cells1', 'x.cid = y.cid AND x.vec_id <> y.vec_id')}
UNION ALL SELECT 2, query_id, rank, neighbor_id, dist FROM {knn_sql(L2_XY, 5, 'probes2', 'cells2', 'x.cid = y.cid AND x.vec_id <> y.vec_id')}""")
def ivf_stored_rounds(spark, d):
    """An index on disk, two rounds appended to it, searched as of either round."""
    from curvine.operators import stored_ivf
    from curvine.sources.sinks import scratch_folder

    emb = embeddings(spark, d)
    upto = [in_sample("vec_id", end, ROUND_SEED) for end in ROUND_ENDS]
    index = stored_ivf.build_index(emb.filter(upto[0]), initial(emb, 20), scratch_folder(spark))
    first = stored_ivf.append_round(index, emb.filter(~upto[0] & upto[1]))
    second = stored_ivf.append_round(first, emb.filter(~upto[1]))
    found = [stored_ivf.search(i, emb, 5, 4, exclude_self=True).select(F.lit(i.round).alias("round"), "*") for i in (first, second)]
    return found[0].unionByName(found[1])


@query("ivf_refresh_rule", f"""WITH r AS (SELECT unnest([0.1, 0.3, 0.7, 0.71, 0.8]::DOUBLE[]) AS share),
n AS (SELECT share, count(*) FILTER ({id_hash_sql('vec_id', 3)} < floor(share * 2147483647)) AS n_previous, count(*) AS n_current FROM embeddings CROSS JOIN r GROUP BY share)
SELECT share, n_previous, n_current, 0::BIGINT AS n_gone, n_current - n_previous AS n_added, (n_current - n_previous)::DOUBLE / n_current < 0.3 AS reuse FROM n""")
def ivf_refresh_rule(spark, d):
    """The rule for several earlier states of one table, each a share of its rows."""
    ids = embeddings(spark, d).select(F.col("vec_id").alias("id"))
    shares = [0.1, 0.3, 0.7, 0.71, 0.8]
    rows = [knn.ivf_refresh(ids.filter(in_sample("id", s, 3)), ids).select(F.lit(s).alias("share"), "*") for s in shares]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


PAIRS_SQL = with_clusters_sql(5) + f""", prs AS (SELECT x.vec_id AS id_a, y.vec_id AS id_b, {dot_sql('x.v', 'y.v')} AS sim FROM a x JOIN a y ON x.cid = y.cid AND x.vec_id < y.vec_id)"""


@query("similar_pairs", PAIRS_SQL + " SELECT * FROM prs WHERE sim > 1.0 - 0.65")
def similar_pairs(spark, d):
    return knn.similar_pairs(clustered(spark, d, 5), 1.0 - 0.65, within="cid")


@query("similar_pairs_topk", with_clusters_sql(5) + f""", near AS (SELECT x.vec_id AS i, y.vec_id AS j, {dot_sql('x.v', 'y.v')} AS sim FROM a x JOIN a y ON x.cid = y.cid AND x.vec_id <> y.vec_id
  QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {dot_sql('x.v', 'y.v')} DESC, y.vec_id) <= 3)
SELECT least(i, j) AS id_a, greatest(i, j) AS id_b, max(sim) AS sim FROM near GROUP BY ALL HAVING max(sim) > 1.0 - 0.7""")
def similar_pairs_topk(spark, d):
    return knn.similar_pairs_topk(clustered(spark, d, 5), 3, 1.0 - 0.7, within="cid")


@query("assign_centroid", with_clusters_sql(10) + " SELECT vec_id, cid, cdist FROM a")
def assign_centroid(spark, d):
    return clustered(spark, d, 10).select("vec_id", "cid", "cdist")


# Centres: the mean vector of every label.
LABEL_MEAN_SQL = f"""lm AS (SELECT label, list(m ORDER BY i) AS v FROM (SELECT label, i, sum(floor(v[i] * 1e9 + 0.5)::HUGEINT)::DOUBLE / 1e9 / count(*) AS m
  FROM e, range(1, 65) t(i) GROUP BY label, i) GROUP BY label)"""


@query("nearest_to_center", f"""WITH {E_SQL}, {LABEL_MEAN_SQL}, c AS (SELECT label AS vec_id, v FROM lm), near AS {knn_sql(L2_XY, 1, 'c', 'e')},
picked AS (SELECT DISTINCT neighbor_id AS vec_id FROM near)
SELECT vec_id, FALSE AS filled FROM picked UNION ALL (SELECT vec_id, TRUE FROM e WHERE vec_id NOT IN (SELECT vec_id FROM picked)
  ORDER BY {id_hash_sql('vec_id', 0)}, vec_id LIMIT (SELECT (SELECT count(*) FROM c) - (SELECT count(*) FROM picked)))""")
def nearest_to_center(spark, d):
    emb = embeddings(spark, d)
    centers = cluster.group_means(emb, ["label"], "embedding", "centroid").withColumnRenamed("label", "cid")
    return knn.nearest_to_centers(emb, centers)


@query("keep_semi", f"SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def keep_semi(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").select("doc_id")
    return docs.join(good, "doc_id", "left_semi")


@query("pool_anti", "SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def pool_anti(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    return docs.join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


@query("dual_space_neighbors", SPLIT_SQL + f""", ha AS (SELECT vec_id, label, v[1:32] AS v FROM e), hb AS (SELECT vec_id, label, v[33:64] AS v FROM e),
qa AS (SELECT * FROM ha WHERE NOT ({LABELED_SQL})), la AS (SELECT * FROM ha WHERE {LABELED_SQL}), qb AS (SELECT * FROM hb WHERE NOT ({LABELED_SQL})), lb AS (SELECT * FROM hb WHERE {LABELED_SQL}),
na AS {knn_sql(L2_XY, 10, 'qa', 'la')}, nb AS {knn_sql(L2_XY, 10, 'qb', 'lb')},
u AS (SELECT query_id, neighbor_id, 'a' AS space FROM na UNION ALL SELECT query_id, neighbor_id, 'b' FROM nb),
agg AS (SELECT query_id, count(*) FILTER (space = 'a' AND y.label = x.label) / 10.0::DOUBLE AS same_label_a, count(*) FILTER (space = 'b' AND y.label = x.label) / 10.0::DOUBLE AS same_label_b
  FROM u JOIN e x ON x.vec_id = query_id JOIN e y ON y.vec_id = neighbor_id GROUP BY query_id),
com AS (SELECT query_id, count(*) AS n FROM na JOIN nb USING (query_id, neighbor_id) GROUP BY query_id)
SELECT query_id, coalesce(n, 0) AS common_neighbours, same_label_a, same_label_b FROM agg LEFT JOIN com USING (query_id)""")
def dual_space_neighbors(spark, d):
    """Neighbours in two feature spaces, here the two halves of each vector."""
    emb = embeddings(spark, d)
    near = {}
    for name, start in (("a", 1), ("b", 33)):
        half = emb.select("vec_id", F.slice("embedding", start, 32).alias("h"))
        labeled, pool = labeled_and_pool(half)
        near[name] = knn.knn_join(pool, labeled, 10, "sq_l2", vec_col="h")
    shares = evaluation.label_agreement(near, emb.select("vec_id", "label"))
    return knn.common_neighbors(near["a"], near["b"]).join(shares, "query_id")
