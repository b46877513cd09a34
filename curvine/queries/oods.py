"""Out-of-distribution detection and nearest-neighbour classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql, in_sample, in_sample_sql, sign_matrix
from curvine.operators import lsh, ood, prompting
from curvine.queries.joins import (
    CELLS_SQL, CROSS_XY, KL_XY, L2_XY, PROBS_SQL, SPLIT_SQL, initial, knn_sql, labeled_and_pool, prob_rows, with_clusters_sql,
)
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, softmax_sql, table

# Labels 0-7 are in-distribution, 8 and 9 are two out-of-distribution sets.
# Every row is scored against the in-distribution rows other than itself.
KNOWN = 8
KTH = 10


def _train(emb):
    return emb.filter(F.col("label") < KNOWN)


TRAIN_SQL = f"WITH {E_SQL}, tr AS (SELECT * FROM e WHERE label < {KNOWN})"
KNN_SCORE = f"{knn_sql(L2_XY, KTH, 'e', 'tr', 'x.vec_id <> y.vec_id')}"
SCORE_SQL = TRAIN_SQL + f", nn AS {KNN_SCORE}, sc AS (SELECT e.vec_id, e.label, -nn.dist AS score FROM e LEFT JOIN nn ON nn.query_id = e.vec_id AND nn.rank = {KTH})"


def _scores(spark, d, **options):
    emb = embeddings(spark, d)
    return ood.ood_knn_score(emb, _train(emb), KTH, exclude_self=True, **options)


def _labeled_scores(spark, d, **options):
    return _scores(spark, d, **options).join(embeddings(spark, d).select("vec_id", "label"), "vec_id")


@query("ood_knn_score", SCORE_SQL + " SELECT vec_id, score FROM sc")
def ood_knn_score(spark, d):
    return _scores(spark, d)


TWO_SQL = TRAIN_SQL.replace("WITH ", "WITH ", 1) + f""", m AS (SELECT * FROM ({{matrix}})), low AS (SELECT vec_id, label, list({dot_sql('signs', 'v')} ORDER BY row) AS v FROM e CROSS JOIN m GROUP BY vec_id, label),
lt AS (SELECT * FROM low WHERE label < {KNOWN}), rough AS {knn_sql(L2_XY, 2 * KTH, 'low', 'lt', 'x.vec_id <> y.vec_id')},
rk AS (SELECT query_id, {L2_XY} AS dist, row_number() OVER (PARTITION BY query_id ORDER BY {L2_XY}, neighbor_id) AS rank FROM rough JOIN e x ON x.vec_id = query_id JOIN e y ON y.vec_id = neighbor_id)
SELECT e.vec_id, -dist AS score FROM e LEFT JOIN rk ON rk.query_id = e.vec_id AND rank = {KTH}"""


def _two_sql():
    from curvine.functions.hashing import sign_matrix_sql

    return TWO_SQL.replace("{matrix}", sign_matrix_sql(8, 64, 42))


@query("ood_knn_two_stage", _two_sql())
def ood_knn_two_stage(spark, d):
    return _scores(spark, d, mode="two_stage", matrix=sign_matrix(8, 64, 42))


@query("ood_knn_ivf", with_clusters_sql(20) + f""", {CELLS_SQL}, cell_tr AS (SELECT cells.* FROM cells JOIN e USING (vec_id) WHERE label < {KNOWN}), hit AS {knn_sql(L2_XY, KTH, 'probes', 'cell_tr', 'x.cid = y.cid AND x.vec_id <> y.vec_id')},
tr AS (SELECT * FROM e WHERE label < {KNOWN}), em AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT query_id FROM hit)), rest AS {knn_sql(L2_XY, KTH, 'em', 'tr', 'x.vec_id <> y.vec_id')},
nn AS (SELECT * FROM hit UNION ALL SELECT * FROM rest) SELECT e.vec_id, -dist AS score FROM e LEFT JOIN nn ON nn.query_id = e.vec_id AND nn.rank = {KTH}""")
def ood_knn_ivf(spark, d):
    return _scores(spark, d, mode="ivf", centroids=initial(embeddings(spark, d), 20), nprobe=4)


def _lsh_bucket(df):
    return lsh.by_table(lsh.width_codes(df, sign_matrix(2, 64, 9), 0.5))


def _lsh_sql():
    from curvine.functions.hashing import sign_matrix_sql

    return TRAIN_SQL + f""", pl AS ({sign_matrix_sql(2, 64, 9)}), wide AS (SELECT vec_id, row AS tbl, floor({dot_sql('signs', 'v')} / 0.5)::BIGINT AS code FROM e CROSS JOIN pl),
pp AS (SELECT DISTINCT x.vec_id AS i, y.vec_id AS j FROM wide x JOIN wide y ON x.tbl = y.tbl AND x.code = y.code AND x.vec_id <> y.vec_id),
hit AS (SELECT i AS query_id, row_number() OVER (PARTITION BY i ORDER BY {L2_XY}, j) AS rank, {L2_XY} AS dist FROM pp JOIN e x ON x.vec_id = i JOIN tr y ON y.vec_id = j QUALIFY rank <= {KTH}),
em AS (SELECT * FROM e WHERE vec_id NOT IN (SELECT query_id FROM hit WHERE rank = {KTH})), rest AS {knn_sql(L2_XY, KTH, 'em', 'tr', 'x.vec_id <> y.vec_id')},
nn AS (SELECT query_id, rank, dist FROM hit WHERE rank = {KTH} UNION ALL SELECT query_id, rank, dist FROM rest WHERE rank = {KTH}) SELECT e.vec_id, -dist AS score FROM e LEFT JOIN nn ON nn.query_id = e.vec_id"""


@query("ood_knn_lsh", _lsh_sql())
def ood_knn_lsh(spark, d):
    return _scores(spark, d, mode="lsh", bucket=_lsh_bucket)


SUB_SQL = in_sample_sql("vec_id", 0.5, 21)


@query("ood_knn_subsampled", f"WITH {E_SQL}, tr AS (SELECT * FROM e WHERE label < {KNOWN} AND {SUB_SQL}), nn AS {KNN_SCORE} SELECT e.vec_id, -nn.dist AS score FROM e LEFT JOIN nn ON nn.query_id = e.vec_id AND nn.rank = {KTH}")
def ood_knn_subsampled(spark, d):
    """All rows scored against a random half of the training rows."""
    emb = embeddings(spark, d)
    return ood.ood_knn_score(emb, _train(emb).filter(in_sample("vec_id", 0.5, 21)), KTH, exclude_self=True)


@query("ood_msp_energy", f"WITH {E_SQL}, z AS (SELECT vec_id, list_transform(v[1:8], lambda x: x * 8) AS z FROM e) SELECT vec_id, round(list_max({softmax_sql('z')}), 6) AS msp, round(list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))), 6) AS energy FROM z")
def ood_msp_energy(spark, d):
    rows = embeddings(spark, d).select("vec_id", V.scale(F.slice("embedding", 1, 8), F.lit(8.0)).alias("z"))
    return rows.select("vec_id", F.round(ood.msp_score("z"), 6).alias("msp"), F.round(ood.energy_score("z"), 6).alias("energy"))


@query("ood_mahalanobis_score", TRAIN_SQL + """, mu AS (SELECT label, i, avg(v[i]) AS m FROM tr, range(1, 65) t(i) GROUP BY ALL),
va AS (SELECT i, avg((v[i] - m) * (v[i] - m)) AS var FROM tr, range(1, 65) t(i) JOIN mu USING (i) WHERE mu.label = tr.label GROUP BY i),
sc AS (SELECT vec_id, mu.label, -0.5 * sum((v[i] - m) * (v[i] - m) / var) AS s FROM e, range(1, 65) t(i) JOIN mu USING (i) JOIN va USING (i) GROUP BY ALL)
SELECT vec_id, round(s, 6) AS score, label::BIGINT AS class FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""")
def ood_mahalanobis_score(spark, d):
    emb = embeddings(spark, d)
    scores = ood.mahalanobis_score(emb, ood.fit_gaussians(_train(emb), diagonal=True))
    return scores.withColumn("score", F.round("score", 6))


@query("ood_mahalanobis_fit")
def ood_mahalanobis_fit(spark, d):
    emb = embeddings(spark, d)
    scores = ood.mahalanobis_score(emb, ood.fit_gaussians(_train(emb)))
    return scores.withColumn("score", F.round("score", 6))


# Feature maps: the vector as 8 x 8 channels and positions, and its first 16 values as 4 x 4.
GRAM_LAYERS = {1: (8, 8), 2: (4, 4)}
GRAM_SQL = f"""WITH {E_SQL}, px AS (SELECT vec_id, label, list_position(v[1:8], list_max(v[1:8])) - 1 AS pred, {softmax_sql('list_transform(v[1:8], lambda x: x * 8)')} AS sm, v FROM e),
x AS (SELECT vec_id, label, pred, list_max(sm) AS conf, ly, c, s, p, v[c * w + s + 1] ** p AS r FROM px, (VALUES (1, 8), (2, 4)) l(ly, w), range(8) a(c), range(8) b(s), (VALUES (1), (2), (3)) q(p) WHERE c < w AND s < w),
al AS (SELECT vec_id, ly, s, p, sum(r) AS tot FROM x GROUP BY ALL),
gg AS (SELECT x.vec_id, label, pred, conf, x.ly, x.c, x.p, sign(sum(r * tot)) * pow(abs(sum(r * tot)), 1.0 / x.p) AS g FROM x JOIN al ON al.vec_id = x.vec_id AND al.ly = x.ly AND al.s = x.s AND al.p = x.p GROUP BY x.vec_id, label, pred, conf, x.ly, x.c, x.p),
rg AS (SELECT label AS pred, ly, p, c, min(g) AS lo, max(g) AS hi FROM gg WHERE label < {KNOWN} GROUP BY ALL),
dv AS (SELECT vec_id, label, conf, gg.ly, sum(greatest(lo - g, 0) / abs(lo + 1e-6) + greatest(g - hi, 0) / abs(hi + 1e-6)) AS dev FROM gg JOIN rg ON rg.pred = gg.pred AND rg.ly = gg.ly AND rg.p = gg.p AND rg.c = gg.c GROUP BY vec_id, label, conf, gg.ly),
ev AS (SELECT ly, avg(dev) AS eva FROM dv WHERE label < {KNOWN} GROUP BY ly)
SELECT vec_id, round(sum(dev / (eva * conf)), 4) AS deviation FROM dv JOIN ev USING (ly) GROUP BY vec_id"""


def _feature_map(channels: int, width: int):
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice("embedding", c * width + 1, width))


@query("ood_gram_deviation", GRAM_SQL)
def ood_gram_deviation(spark, d):
    rows = embeddings(spark, d).select(
        "vec_id", "label", "embedding", V.argmax(F.slice("embedding", 1, 8)).alias("pred"),
        ood.msp_score(V.scale(F.slice("embedding", 1, 8), F.lit(8.0))).alias("conf"),
    )
    layers = {i: _feature_map(ch, w) for i, (ch, w) in GRAM_LAYERS.items()}
    stats = ood.gram_stats(rows, layers, [1, 2, 3], keep=["label", "pred", "conf"])
    train = stats.filter(F.col("label") < KNOWN)
    ranges = ood.gram_ranges(train.select(F.col("label").cast("bigint").alias("pred"), "layer", "power", "g"), "pred")
    dev = ood.gram_layer_deviation(stats, ranges, "pred", keep=["label", "conf"])
    expected = dev.filter(F.col("label") < KNOWN).groupBy("layer").agg(F.avg("dev").alias("eva"))
    return ood.gram_deviation(dev, expected, "conf").withColumn("deviation", F.round("deviation", 4))


# --- metrics ------------------------------------------------------------------------------

POINTS_SQL = SCORE_SQL + f""", ct AS (SELECT st, score AS s, count(*) FILTER (k) AS k, count(*) FILTER (NOT k) AS n FROM (SELECT label AS st, score, FALSE AS k FROM sc WHERE label >= {KNOWN} UNION ALL SELECT z.st, score, TRUE FROM sc, (VALUES (8), (9)) z(st) WHERE label < {KNOWN}) WHERE score IS NOT NULL GROUP BY st, score),
cu AS (SELECT *, sum(k) OVER w AS ck, sum(n) OVER w AS cn, sum(k) OVER (PARTITION BY st) AS kk, sum(n) OVER (PARTITION BY st) AS nn2 FROM ct WINDOW w AS (PARTITION BY st ORDER BY s)),
po AS (SELECT *, kk - ck AS tp, nn2 - cn AS fp, lag(kk - ck, 1, kk) OVER w2 AS tp0, lag(nn2 - cn, 1, nn2) OVER w2 AS fp0 FROM cu WINDOW w2 AS (PARTITION BY st ORDER BY s))"""
IN_NOW, IN_OLD = ("coalesce({t} / nullif({t} + {f}, 0)::DOUBLE, 0)".format(t=t, f=f) for t, f in (("tp", "fp"), ("tp0", "fp0")))
OUT_NOW, OUT_OLD = ("coalesce((nn2 - {f}) / nullif(kk - {t} + nn2 - {f}, 0)::DOUBLE, 0)".format(t=t, f=f) for t, f in (("tp", "fp"), ("tp0", "fp0")))
ROC_SQL = POINTS_SQL + f""", ms AS (SELECT st AS "set", min_by(fp / nn2::DOUBLE, s) FILTER (ck > round_even(0.05::DOUBLE * kk, 0)) AS fpr95,
  sum((tp0 - tp) / kk::DOUBLE * ((1 - fp0 / nn2::DOUBLE) + (1 - fp / nn2::DOUBLE)) / 2) AS auroc, least(min((kk - tp + fp) / (kk + nn2)::DOUBLE), max(nn2 / (kk + nn2)::DOUBLE)) AS dterr,
  sum((tp0 - tp) / kk::DOUBLE * ({IN_OLD} + {IN_NOW}) / 2) AS auin, sum((fp0 - fp) / nn2::DOUBLE * ({OUT_OLD} + {OUT_NOW}) / 2) AS auout FROM po GROUP BY st)"""
NAMES = ["fpr95", "auroc", "dterr", "auin", "auout"]


def _points(spark, d):
    scores = _labeled_scores(spark, d)
    return ood.roc_points(scores.filter(F.col("label") < KNOWN), scores.filter(F.col("label") >= KNOWN), by="label")


def _rounded(df, names):
    return df.select("set", *[F.round(n, 6).alias(n) for n in names])


@query("ood_roc_metrics", ROC_SQL + ' SELECT "set", ' + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + " FROM ms")
def ood_roc_metrics(spark, d):
    return _rounded(ood.ood_metrics(_points(spark, d)), NAMES)


@query("ood_measures", POINTS_SQL + f""", fq AS (SELECT st, fp0 / nn2::DOUBLE AS fpr FROM po WHERE tp < kk QUALIFY row_number() OVER (PARTITION BY st ORDER BY round(abs(tp0 / kk::DOUBLE - 0.95), 12), tp0 DESC, s DESC) = 1)
SELECT st AS "set", round(sum(k / kk::DOUBLE * ((1 - fp0 / nn2::DOUBLE) + (1 - fp / nn2::DOUBLE)) / 2), 6) AS auroc, round(sum(k / kk::DOUBLE * tp0 / (tp0 + fp0)), 6) AS ap_in,
  round(sum(n / nn2::DOUBLE * (nn2 - fp) / (nn2 - fp + kk - tp)), 6) AS ap_out, round(any_value(fq.fpr), 6) AS fpr FROM po JOIN fq USING (st) GROUP BY st""")
def ood_measures(spark, d):
    return _rounded(ood.ood_measures(_points(spark, d)), ["auroc", "ap_in", "ap_out", "fpr"])


@query("ood_in_report", SCORE_SQL + f""", kn AS (SELECT sc.*, list_position(v[1:8], list_max(v[1:8])) - 1 = sc.label AS right FROM sc JOIN e USING (vec_id) WHERE sc.label < {KNOWN}),
th AS (SELECT score AS t FROM kn QUALIFY row_number() OVER (ORDER BY score) = round_even(0.05::DOUBLE * count(*) OVER (), 0) + 1)
SELECT round(avg((NOT score > t)::INT), 6) AS fnr, round(avg("right"::INT), 6) AS accuracy, round(avg(("right" AND score > t)::INT), 6) AS end_to_end_accuracy FROM kn, th""")
def ood_in_report(spark, d):
    scores = _labeled_scores(spark, d).filter(F.col("label") < KNOWN)
    preds = embeddings(spark, d).select("vec_id", V.argmax(F.slice("embedding", 1, 8)).alias("pred"))
    rows = scores.join(preds, "vec_id")
    return ood.in_report(rows, ood.roc_points(scores, scores.filter(F.lit(False))))


@query("ood_average", ROC_SQL + " SELECT count(*) AS sets, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES) + " FROM ms")
def ood_average(spark, d):
    return ood.average_metrics(ood.ood_metrics(_points(spark, d)), NAMES)


@query("ood_score_stats", SCORE_SQL + ' SELECT label AS "set", count(score) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std FROM sc GROUP BY label')
def ood_score_stats(spark, d):
    return ood.score_stats(_labeled_scores(spark, d), "label").withColumnRenamed("label", "set")


@query("ood_recall", SCORE_SQL + ", " + _two_sql()[len(TRAIN_SQL) + 2 :].replace("SELECT e.vec_id, -dist AS score FROM e LEFT", ", ap AS (SELECT e.vec_id, -dist AS score FROM e LEFT") + f""")
, cu AS (SELECT round(quantile_cont(-score, 0.95), 9) AS t FROM sc), fl AS (SELECT round(-sc.score, 9) >= t AS a, coalesce(round(-ap.score, 9) >= t, FALSE) AS b FROM sc JOIN ap USING (vec_id), cu)
SELECT count(*) FILTER (a) AS flagged, count(*) FILTER (a AND b) AS both, coalesce(round(count(*) FILTER (a AND b)::DOUBLE / nullif(count(*) FILTER (a), 0), 6), 1.0) AS recall FROM fl""")
def ood_recall(spark, d):
    exact, approx = _scores(spark, d), ood_knn_two_stage(spark, d)
    return ood.flag_recall(*[s.select("vec_id", (-F.col("score")).alias("dist")) for s in (exact, approx)])


# --- nearest-neighbour classification ---------------------------------------------------------


@query("few_shot_sample", f"""SELECT doc_id, lang, {id_hash_sql('doc_id', 5)} AS position FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {id_hash_sql('doc_id', 4)}, doc_id) <= 8""")
def few_shot_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    toxic = table(spark, d, "labels").filter("toxic = 1")
    return prompting.few_shot_sample(docs, 8, exclude=toxic, seed=4, id_col="doc_id", class_col="lang")


@query("anchor_precompute", PROBS_SQL + " SELECT vec_id, label, round(ne, 6) AS neg_entropy, list_transform(lg, lambda x: round(x, 6)) AS log_p FROM lk")
def anchor_precompute(spark, d):
    labeled, _ = labeled_and_pool(prob_rows(spark, d))
    ready = prompting.prepare_anchors(labeled, id_col="vec_id", label_col="label", prob_col="p")
    return ready.select("vec_id", "label", F.round("neg_entropy", 6).alias("neg_entropy"), V.round_all("log_p").alias("log_p"))


def vote_sql(near: str, labels: str = "e") -> str:
    return f"""(SELECT query_id, label AS pred FROM (SELECT query_id, y.label, count(*) AS n FROM {near} nb JOIN {labels} y ON y.vec_id = neighbor_id GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1)"""


@query("knn_kl_vote", PROBS_SQL + f", nn AS {knn_sql(KL_XY, 5, 'lq', 'lk')} SELECT * FROM {vote_sql('nn')}")
def knn_kl_vote(spark, d):
    anchors, queries = labeled_and_pool(prob_rows(spark, d))
    return prompting.knn_vote(queries, anchors, 5, id_col="vec_id", label_col="label", vec_col="p")


@query("knn_reverse_kl_vote", PROBS_SQL + f", nn AS {knn_sql(CROSS_XY, 5, 'lq', 'lk')} SELECT * FROM {vote_sql('nn')}")
def knn_reverse_kl_vote(spark, d):
    anchors, queries = labeled_and_pool(prob_rows(spark, d))
    return prompting.knn_vote(queries, anchors, 5, metric="cross", id_col="vec_id", label_col="label", vec_col="p")


@query("knn_classify", SPLIT_SQL + f", nn AS {knn_sql(L2_XY, 5)} SELECT * FROM {vote_sql('nn')}")
def knn_classify(spark, d):
    labeled, pool = labeled_and_pool(embeddings(spark, d))
    return prompting.knn_vote(pool, labeled, 5, metric="sq_l2", id_col="vec_id", label_col="label", vec_col="embedding")


@query("icl_predict", PROBS_SQL + " SELECT vec_id, (list_position([p[4], p[18], p[31], p[60]], list_max([p[4], p[18], p[31], p[60]])) - 1)::BIGINT AS pred FROM pr")
def icl_predict(spark, d):
    tokens = F.array(*[F.lit(t) for t in (3, 17, 30, 59)])
    return prob_rows(spark, d).select("vec_id", prompting.icl_predict("p", tokens).alias("pred"))
