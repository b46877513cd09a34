"""Evaluation aggregates over derived predictions and over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.operators import cluster, evaluation as ev, knn, dedup, coreset
from curvine.queries.clusters import semdedup_exact, semdedup_lsh, two_level_sql
from curvine.queries.joins import CELLS_SQL, L2_XY, LSH_MAX_SQL, MAXSIM_SQL, initial, knn_sql, with_clusters_sql
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, softmax_sql, sq_l2_sql, table

# Predictions: softmax of the first four elements times 8; the truth is the label modulo 4.
P_SQL = f"""WITH {E_SQL}, z AS (SELECT vec_id, label % 4 AS label, list_transform(v[1:4], lambda x: x * 8) AS z, v FROM e),
p AS (SELECT vec_id, label, {softmax_sql('z')} AS probs, v FROM z), r AS (SELECT *, (list_position(probs, list_max(probs)) - 1)::INTEGER AS pred FROM p)"""
TINY = "2.220446049250313e-16::DOUBLE"


def _preds(spark, d):
    rows = embeddings(spark, d).select("vec_id", "embedding", F.pmod("label", F.lit(4)).alias("label"), V.softmax(V.scale(F.slice("embedding", 1, 4), F.lit(8.0))).alias("probs"))
    return rows.withColumn("pred", V.argmax("probs").cast("int"))


def _round(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


PER_CLASS = """, c AS (SELECT c, count(*) FILTER (label = c) AS t, count(*) FILTER (pred = c) AS pp, count(*) FILTER (label = c AND pred = c) AS hit FROM r, (SELECT DISTINCT label AS c FROM r UNION SELECT DISTINCT pred FROM r) GROUP BY c),
s AS (SELECT t, hit, coalesce(hit / nullif(pp, 0)::DOUBLE, 0) AS pr, coalesce(hit / nullif(t, 0)::DOUBLE, 0) AS re, pp FROM c)"""


@query("eval_classification", P_SQL + PER_CLASS + """, o AS (SELECT sum(t)::BIGINT AS n, sum(hit) / sum(t)::DOUBLE AS acc, avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)) AS f1, avg(pr) AS p, avg(re) AS re FROM s)
SELECT n, round(acc, 6) AS acc, round(f1, 6) AS f1, round(p, 6) AS precision, round(re, 6) AS recall, round((acc + f1) / 2, 6) AS acc_and_f1 FROM o""")
def eval_classification(spark, d):
    return _round(ev.classification_report(_preds(spark, d)), "acc", "f1", "precision", "recall", "acc_and_f1")


@query("eval_confusion", P_SQL + " SELECT label, pred, count(*) AS n FROM r GROUP BY ALL")
def eval_confusion(spark, d):
    return ev.confusion_matrix(_preds(spark, d))


MCC = """round((sum(hit) * sum(t)::DOUBLE - sum(t::DOUBLE * pp)) / sqrt((sum(t)::DOUBLE ** 2 - sum(pp::DOUBLE * pp)) * (sum(t)::DOUBLE ** 2 - sum(t::DOUBLE * t))), 6)"""


@query("eval_mcc_corr", P_SQL + PER_CLASS + f""", xy AS (SELECT v[1] AS x, v[2] + v[1] AS y FROM r), rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM xy),
m AS (SELECT {MCC} AS mcc FROM s) SELECT any_value(mcc) AS mcc, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round((corr(x, y) + corr(rx, ry)) / 2, 6) AS mean FROM rk, m""")
def eval_mcc_corr(spark, d):
    rows = _preds(spark, d)
    v = V.doubles("embedding")
    corr = ev.correlations(rows.select(v[0].alias("x"), (v[1] + v[0]).alias("y")), "x", "y")
    one = ev.matthews(rows).withColumn("_j", F.lit(1)).join(corr.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return _round(one, "mcc", "pearson", "spearman", "mean")


@query("eval_topk", P_SQL + ", o AS (SELECT len(list_filter(probs, lambda x, i: x > probs[label + 1] OR (x = probs[label + 1] AND i < label + 1))) AS ahead FROM r) SELECT round(avg((ahead < 1)::INT), 6) AS top1, round(avg((ahead < 2)::INT), 6) AS top2, round(avg((ahead < 3)::INT), 6) AS top3 FROM o")
def eval_topk(spark, d):
    return ev.topk_accuracy(_preds(spark, d), [1, 2, 3])


BINS = P_SQL + ", b AS (SELECT ceil(list_max(probs) * 10)::BIGINT AS bin, count(*) AS n, avg((pred = label)::INT) AS acc, avg(list_max(probs)) AS conf FROM r GROUP BY 1)"


@query("eval_ece", BINS + " SELECT round(sum(abs(conf - acc) * n) / sum(n), 6) AS ece, round(sum(acc * (1 - acc) * n) / sum(n), 6) AS refinement FROM b")
def eval_ece(spark, d):
    return _round(ev.ece(_preds(spark, d)), "ece", "refinement")


@query("eval_calibration_bins", BINS + " SELECT bin, n, round(acc, 6) AS acc, round(conf, 6) AS conf FROM b")
def eval_calibration_bins(spark, d):
    return _round(ev.calibration_bins(_preds(spark, d)), "acc", "conf")


UNC_SQL = P_SQL + f""", u AS (SELECT vec_id, 1.0::DOUBLE - list_max(probs) AS var_ratio, -list_sum(list_transform(probs, lambda x: x * ln(x + {TINY}))) / ln(2.0::DOUBLE) AS entropy, list_stddev_pop(probs) AS std,
  list_sort(probs, 'DESC')[1] - list_sort(probs, 'DESC')[2] AS margin FROM r)"""
UNC = ["var_ratio", "entropy", "std", "margin"]


@query("eval_uncertainty", UNC_SQL + " SELECT " + ", ".join(f"round(avg({n}), 3) AS {n}_mean, round(var_pop({n}), 3) AS {n}_var" for n in UNC) + " FROM u")
def eval_uncertainty(spark, d):
    return ev.mean_and_var(_preds(spark, d), ev.row_uncertainty())


@query("eval_uncertainty_rows", UNC_SQL + " SELECT vec_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in UNC) + " FROM u")
def eval_uncertainty_rows(spark, d):
    return _preds(spark, d).select("vec_id", *[F.round(c, 6).alias(n) for n, c in ev.row_uncertainty().items()])


@query("eval_scores", P_SQL + f""", g AS (SELECT sqrt(sum({dot_sql('probs', 'probs')})) AS gn FROM r), u AS (SELECT -ln(probs[label + 1] + {TINY}) AS nll, list_avg(list_transform(probs, lambda x, i: (x - (i = label + 1)::INT) ** 2)) AS brier,
  1.0::DOUBLE - probs[label + 1] / (sqrt({dot_sql('probs', 'probs')}) + {TINY}) AS spherical, 1.0::DOUBLE - probs[label + 1] / (gn + {TINY}) AS spherical_global FROM r, g)
SELECT """ + ", ".join(f"round(avg({n}), 6) AS {n}_mean, round(var_pop({n}), 6) AS {n}_var" for n in ("nll", "brier", "spherical", "spherical_global")) + " FROM u")
def eval_scores(spark, d):
    rows = _preds(spark, d)
    whole = rows.agg(F.sqrt(F.sum(V.dot("probs", "probs"))).alias("g")).scalar()
    scores = ev.row_scores() | {"spherical_global": ev.row_scores(norm="global", global_norm=whole)["spherical"]}
    return ev.mean_and_var(rows, scores, digits=6)


@query("eval_label_entropy", f"WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), p AS (SELECT n / sum(n) OVER ()::DOUBLE AS p FROM n) SELECT round(-sum(p * ln(p + {TINY})), 6) AS entropy FROM p")
def eval_label_entropy(spark, d):
    return _round(ev.label_entropy(embeddings(spark, d)), "entropy")


# The code vector of a query is the query with its first 16 elements negated.
MRR_SQL = f"""WITH {E_SQL}, q AS (SELECT vec_id, list_transform(v, lambda x: x / (sqrt({dot_sql('v', 'v')}) + 1e-12)) AS v, list_concat(list_transform(v[1:16], lambda x: -x), v[17:64]) AS c FROM e),
u AS (SELECT vec_id, v, list_transform(c, lambda x: x / (sqrt({dot_sql('c', 'c')}) + 1e-12)) AS c FROM q), own AS (SELECT vec_id, v, {dot_sql('v', 'c')} AS own FROM u),
k AS (SELECT own.vec_id, 1 + count(*) FILTER (u.vec_id <> own.vec_id AND {dot_sql('own.v', 'u.c')} > own.own) AS rank FROM own CROSS JOIN u GROUP BY own.vec_id)"""


def _ranks(spark, d):
    v = V.doubles("embedding")
    code = F.concat(F.transform(F.slice(v, 1, 16), lambda x: -x), F.slice(v, 17, 48))
    return ev.retrieval_ranks(embeddings(spark, d).select("vec_id", v.alias("query"), code.alias("code")))


@query("eval_mrr", MRR_SQL + " SELECT count(*) AS n, round(avg(1.0::DOUBLE / rank), 6) AS mrr FROM k")
def eval_mrr(spark, d):
    return _round(ev.mrr(_ranks(spark, d)), "mrr")


@query("eval_retrieval_ranks", MRR_SQL + " SELECT vec_id, rank FROM k")
def eval_retrieval_ranks(spark, d):
    return _ranks(spark, d)


# --- texts: a document, the next one by id as its prediction, the two after that as references; the last goes on with the first ---

T_SQL = """o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
t AS (SELECT a.doc_id, a.text AS source, b.text AS prediction, [c.text, f.text] AS refs FROM o a JOIN o b ON b.i = (a.i + 1) % a.n JOIN o c ON c.i = (a.i + 2) % a.n JOIN o f ON f.i = (a.i + 3) % a.n)"""


def _triples(spark, d):
    from curvine.plans.ranking import rank_rows
    from curvine.session import checkpoint

    docs = table(spark, d, "documents").select("doc_id", "text")
    # only ids are ranked; texts join their place once for each role
    places = checkpoint(rank_rows(docs.select("doc_id"), [F.col("doc_id")], rank="i", totals_too=True))

    def shifted(k, name):
        at = F.pmod(F.col("i") - 1 - k, F.col("i_total")).alias("i")
        return docs.join(places, "doc_id").select(*(["doc_id"] if k == 0 else []), at, F.col("text").alias(name))

    rows = shifted(0, "source").join(shifted(1, "prediction"), "i").join(shifted(2, "r1"), "i").join(shifted(3, "r2"), "i")
    return rows.select("doc_id", "source", "prediction", F.array("r1", "r2").alias("references"))


def words_sql(text: str, lower: bool = True) -> str:
    return rf"list_filter(string_split_regex({f'lower({text})' if lower else text}, '\s+'), lambda w: w <> '')"


def grams_sql(tokens: str, where: str, keys: str) -> str:
    lead = f"OVER (PARTITION BY {keys} ORDER BY i)"
    grams = ["g1", "g1 || ' ' || g2", "g1 || ' ' || g2 || ' ' || g3", "g1 || ' ' || g2 || ' ' || g3 || ' ' || g4"]
    rows = f"""(SELECT {keys}, g1, lead(g1, 1) {lead} AS g2, lead(g1, 2) {lead} AS g3, lead(g1, 3) {lead} AS g4
      FROM (SELECT {keys}, unnest({tokens}) AS g1, unnest(range(len({tokens}))) AS i FROM {where}))"""
    return " UNION ALL ".join(f"SELECT {keys}, {n + 1} AS n, {g} AS gram FROM {rows} WHERE {g} IS NOT NULL" for n, g in enumerate(grams))


# The n-grams of a document are counted once; a row then takes those of four documents.
SARI_SQL = f"""WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text FROM documents), t AS (SELECT doc_id FROM o), z AS (SELECT count(*) AS z FROM o),
tok AS MATERIALIZED (SELECT doc_id, {words_sql('text')} AS w FROM o), gc AS MATERIALIZED (SELECT doc_id, n, gram, count(*) AS c FROM ({grams_sql('w', 'tok', 'doc_id')}) GROUP BY ALL),
g AS (SELECT doc_id, rn, n, gram, c AS s, 0 AS p, 0 AS r FROM gc, range(1, 3) x(rn) UNION ALL SELECT (doc_id - 1 + z) % z, rn, n, gram, 0, c, 0 FROM gc, z, range(1, 3) x(rn) UNION ALL SELECT (doc_id - 1 - rn + z) % z, rn, n, gram, 0, 0, c FROM gc, z, range(1, 3) x(rn)),
c AS (SELECT doc_id, rn, n, gram, sum(s) AS s, sum(p) AS p, sum(r) AS r FROM g GROUP BY ALL),
f AS (SELECT doc_id, rn, n, coalesce(sum(least(s, p, r)) / nullif(sum(least(s, p)), 0)::DOUBLE, 0) AS kp, coalesce(sum(least(s, p, r)) / nullif(sum(least(s, r)), 0)::DOUBLE, 0) AS kr,
  coalesce(sum(least(greatest(p - s, 0), greatest(r - s, 0))) / nullif(sum(greatest(p - s, 0)), 0)::DOUBLE, 0) AS ad, coalesce(sum(least(greatest(s - p, 0), greatest(s - r, 0))) / nullif(sum(greatest(s - p, 0)), 0)::DOUBLE, 0) AS de FROM c GROUP BY ALL),
w AS (SELECT doc_id, sum(coalesce(2 * kp * kr / nullif(kp + kr, 0), 0) + ad + de) / 4 / 3 * 100 / 2 AS x FROM f GROUP BY doc_id)
SELECT count(*) AS n, round(avg(coalesce(x, 0)), 6) AS sari FROM t LEFT JOIN w USING (doc_id)"""


@query("eval_sari", SARI_SQL)
def eval_sari(spark, d):
    rows = ev.sari(_triples(spark, d), id_col="doc_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sari"), 6).alias("sari"))


BLEU_SQL = f"""WITH {T_SQL}, h AS (SELECT doc_id, {words_sql('prediction', False)} AS p FROM t), rf AS (SELECT doc_id, rn, {words_sql('refs[rn]', False)} AS r FROM t, range(1, 3) x(rn)),
pc AS (SELECT doc_id, n, gram, count(*) AS p FROM ({grams_sql('p', 'h', 'doc_id')}) GROUP BY ALL), rc AS (SELECT doc_id, n, gram, max(c) AS r FROM (SELECT doc_id, rn, n, gram, count(*) AS c FROM ({grams_sql('r', 'rf', 'doc_id, rn')}) GROUP BY ALL) GROUP BY doc_id, n, gram),
m AS (SELECT n, sum(least(p, coalesce(r, 0)))::DOUBLE AS hit, sum(p)::DOUBLE AS al FROM pc LEFT JOIN rc USING (doc_id, n, gram) GROUP BY n),
le AS (SELECT sum(pl)::BIGINT AS hyp_len, sum(rl)::BIGINT AS ref_len FROM (SELECT doc_id, len(p) AS pl, len(r) AS rl FROM rf JOIN h USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY abs(len(r) - len(p)), len(r)) = 1)),
q AS (SELECT sum(ln(CASE WHEN hit > 0 THEN hit ELSE pow(0.5, z) END / al)) AS lg FROM (SELECT *, count(*) FILTER (hit = 0) OVER (ORDER BY n) AS z FROM m))
SELECT hyp_len, ref_len, round(CASE WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len::DOUBLE) END * exp(lg / 4) * 100, 6) AS bleu FROM le, q"""


@query("eval_bleu", BLEU_SQL)
def eval_bleu(spark, d):
    return _round(ev.bleu(_triples(spark, d), id_col="doc_id"), "bleu")


# The row of the table as its rising steps: step k is the first word of the prediction at which a common subsequence of k words can end.
ROUGE_SQL = f"""WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS z, {words_sql('text')} AS w FROM documents),
tok AS MATERIALIZED (SELECT i, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1))::INTEGER AS j FROM o),
places AS (SELECT i, word, list(j ORDER BY j) AS ps FROM tok GROUP BY ALL),
pairs AS (SELECT p.i, p.z, x.rn, (p.i + 1) % p.z AS a, (p.i + 1 + x.rn) % p.z AS b FROM o p, range(1, 3) x(rn)),
hits AS (SELECT q.i, q.rn, list(ps ORDER BY t.j) AS l FROM pairs q JOIN tok t ON t.i = q.b JOIN places s ON s.i = q.a AND s.word = t.word GROUP BY q.i, q.rn),
l AS (SELECT i, rn, len(list_reduce(list_prepend([]::INTEGER[], l), lambda u, ps: list_filter(list_transform(list_append(u, 1000000000), lambda t, k:
  least(t, coalesce(list_min(list_filter(ps, lambda p: p > CASE WHEN k = 1 THEN 0 ELSE u[k - 1] END)), 1000000000))), lambda t: t < 1000000000))) AS lcs FROM hits),
r AS (SELECT q.i, q.rn, coalesce(lcs, 0) AS lcs, len(x.w) AS np, len(y.w) AS nr FROM pairs q JOIN o x ON x.i = q.a JOIN o y ON y.i = q.b LEFT JOIN l ON l.i = q.i AND l.rn = q.rn),
f AS (SELECT i, max(CASE WHEN lcs = 0 THEN 0 ELSE 2 * (lcs / np) * (lcs / nr) / (lcs / np + lcs / nr) END) * 100 AS x FROM r GROUP BY i)
SELECT count(*) AS n, round(avg(x), 6) AS rouge_l FROM f"""


@query("eval_rouge_l", ROUGE_SQL)
def eval_rouge_l(spark, d):
    rows = ev.rouge_l(_triples(spark, d), id_col="doc_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rouge_l"), 6).alias("rouge_l"))


def fkgl_sql(text: str) -> str:
    w = words_sql(text)
    groups = "len(regexp_extract_all(w, '[aeiouy]+'))"
    syl = f"list_sum(list_transform({w}, lambda w: greatest({groups} - CASE WHEN w LIKE '%e' AND {groups} > 1 THEN 1 ELSE 0 END, 1)))"
    sent = f"greatest(len(list_filter(string_split_regex({text}, '[.!?]+'), lambda s: trim(s) <> '')), 1)"
    return f"0.39::DOUBLE * len({w}) / {sent} + 11.8::DOUBLE * coalesce({syl} / nullif(len({w}), 0)::DOUBLE, 0) - 15.59::DOUBLE"


@query("eval_fkgl", f"WITH {T_SQL}, x AS (SELECT {fkgl_sql('source')} AS s, {fkgl_sql('prediction')} AS p FROM t) SELECT round(avg(s), 6) AS fkgl_source, round(avg(p), 6) AS fkgl_prediction, round(avg(s) - avg(p), 6) AS fkgl_reduction FROM x")
def eval_fkgl(spark, d):
    rows = _triples(spark, d).select(ev.fkgl("source").alias("s"), ev.fkgl("prediction").alias("p"))
    return rows.agg(
        F.round(F.avg("s"), 6).alias("fkgl_source"), F.round(F.avg("p"), 6).alias("fkgl_prediction"), F.round(F.avg("s") - F.avg("p"), 6).alias("fkgl_reduction")
    )


# A conversation is a task, an assistant turn of at least 400 characters passes it.
@query("eval_pass_at_1", "WITH p AS (SELECT conv_id, bool_or(role = 'assistant' AND length(text) >= 400) AS ok FROM conversations GROUP BY conv_id) SELECT count(*) AS total, count(*) FILTER (ok) AS passed, round(avg(ok::INT), 6) AS pass_at_1 FROM p")
def eval_pass_at_1(spark, d):
    return _round(ev.pass_at_1(table(spark, d, "conversations"), "conv_id", (F.col("role") == "assistant") & (F.length("text") >= 400)), "pass_at_1")


# --- selections ------------------------------------------------------------------------------

BOTH_DEDUP = MAXSIM_SQL + LSH_MAX_SQL[LSH_MAX_SQL.index(", pl AS"):].replace(",\nm AS", ",\nm2 AS")


@query("selection_recall", BOTH_DEDUP + """, x AS (SELECT a.cid, a.vec_id, m2.vec_id IS NOT NULL AND m2.max_sim > 1.0 - 0.65 AS hit FROM a JOIN m USING (vec_id) LEFT JOIN m2 USING (vec_id) WHERE m.max_sim > 1.0 - 0.65)
SELECT cid, count(*) AS truth, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS recall FROM x GROUP BY cid""")
def selection_recall(spark, d):
    flag = F.col(dedup.flag_name(0.65))
    return ev.selection_recall(semdedup_exact(spark, d).filter(flag), semdedup_lsh(spark, d).filter(flag), by="cid")


TWO = two_level_sql(16, 4, 2, 0)
TWO_CTES = TWO[: TWO.rindex(" SELECT vec_id, cid, round")]


@query("assignment_agreement", TWO_CTES + f""", ex AS (SELECT e.vec_id, c0.cid FROM e CROSS JOIN c0 QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2_sql('e.v', 'c0.centroid')}, c0.cid) = 1)
SELECT count(*) AS n, round(avg((ex.cid = a0.cid)::INT), 6) AS agreement FROM ex JOIN a0 USING (vec_id)""")
def assignment_agreement(spark, d):
    emb = embeddings(spark, d)
    centroids = knn.centroid_matrix(cluster.sample_rows(emb, 16))
    return ev.assignment_agreement(cluster.assign_rows(emb, *centroids), cluster.assign_rows(emb, *centroids, coarse=4, nprobe=2))


IVF_NEAR = with_clusters_sql(20) + f", {CELLS_SQL}, ex AS {knn_sql(L2_XY, 5, 'e', 'e', 'x.vec_id <> y.vec_id')}"


def _ivf(n: int) -> str:
    return knn_sql(L2_XY, 5, f"(SELECT e.vec_id, e.v, c.cid FROM e CROSS JOIN c QUALIFY row_number() OVER (PARTITION BY e.vec_id ORDER BY {sq_l2_sql('e.v', 'c.centroid')}, c.cid) <= {n})", "cells", "x.cid = y.cid AND x.vec_id <> y.vec_id")


@query("cal_recall", IVF_NEAR + f""", ap AS {_ivf(4)}, tx AS (SELECT query_id FROM ex GROUP BY 1 ORDER BY round(avg(dist), 9) DESC, query_id LIMIT 50), ta AS (SELECT query_id FROM ap GROUP BY 1 ORDER BY round(avg(dist), 9) DESC, query_id LIMIT 50)
SELECT count(*) AS truth, count(ta.query_id) AS found, round(count(ta.query_id) / count(*)::DOUBLE, 6) AS recall FROM tx LEFT JOIN ta USING (query_id)""")
def cal_recall(spark, d):
    emb = embeddings(spark, d)
    exact = knn.knn_join(emb, emb, 5, exclude_self=True)
    approx = knn.ivf_knn_join(emb, emb, initial(emb, 20), 5, 4, exclude_self=True)
    return ev.selection_recall(ev.farthest_by_mean_distance(exact, 50), ev.farthest_by_mean_distance(approx, 50))


PROBES = (1, 2, 4)


@query("ivf_recall_sweep", IVF_NEAR + "".join(f", ap{n} AS {_ivf(n)}" for n in PROBES) + " " + " UNION ALL ".join(
    f"SELECT 'nprobe={n}' AS setting, count(*) AS truth, count(ap{n}.dist) AS found, round(count(ap{n}.dist) / count(*)::DOUBLE, 6) AS recall FROM ex LEFT JOIN ap{n} USING (query_id, neighbor_id)" for n in PROBES
))
def ivf_recall_sweep(spark, d):
    """The cells and the probes are found once for the widest setting; a narrower one keeps fewer probes."""
    emb = embeddings(spark, d).select("vec_id", "embedding")
    centroids = initial(emb, 20)
    cells = knn.assign(emb, centroids)
    probes = knn.assign(emb, centroids, probes=max(PROBES))
    pair = F.struct("query_id", "neighbor_id").alias("vec_id")
    truth = knn.knn_join(emb, emb, 5, exclude_self=True).select(pair)
    results = {}
    for n in PROBES:
        found = knn.knn_join(probes.filter(F.col("probe") <= n), cells, 5, within="cid", exclude_self=True)
        results[f"nprobe={n}"] = ev.selection_recall(truth, found.select(pair))
    return ev.sweep(results)


@query("dataset_stats", f"WITH w AS (SELECT len({words_sql('text', False)}) AS n FROM documents) SELECT count(*) AS num_samples, round(avg(n), 6) AS avg_length, max(n)::BIGINT AS max_length, min(n)::BIGINT AS min_length, sum(n)::BIGINT AS total_tokens FROM w")
def dataset_stats(spark, d):
    return ev.length_stats(table(spark, d, "documents"), F.size(ev.words("text", lower=False)))


@query("method_compare", MAXSIM_SQL + f""", n AS (SELECT count(*) AS total, count(*) FILTER (max_sim > 1.0 - 0.6) AS sem FROM a LEFT JOIN m USING (vec_id))
SELECT 'no_pruning' AS method, total AS kept, 100.0::DOUBLE AS kept_percent FROM n UNION ALL SELECT 'random', total - floor(0.3::DOUBLE * total)::BIGINT, round(100.0::DOUBLE * (total - floor(0.3::DOUBLE * total)) / total, 4) FROM n
UNION ALL SELECT 'semdedup', total - sem, round(100.0::DOUBLE * (total - sem) / total, 4) FROM n""")
def method_compare(spark, d):
    emb = embeddings(spark, d)
    total = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    removed = {
        "no_pruning": emb.filter(F.lit(False)), "random": coreset.weighted_random_subset(emb, 0.3, seed=3),
        "semdedup": semdedup_exact(spark, d).filter(F.col(dedup.flag_name(0.60))),
    }
    counts = {name: df.agg(F.count(F.lit(1)).alias("removed")) for name, df in removed.items()}
    rows = ev.sweep(counts).select(F.col("setting").alias("method"), (total - F.col("removed")).alias("kept"), total.alias("total"))
    return rows.select("method", "kept", F.round(100.0 * F.col("kept") / F.col("total"), 4).alias("kept_percent"))


# Iterations: the documents by id modulo 10, their share of good labels as accuracy and their length as time.
@query("run_summary", """WITH i AS (SELECT d.doc_id % 10 AS iteration, avg(l.quality) AS acc, sum(d.n_chars)::BIGINT AS time FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL)
SELECT max(iteration) AS last_iteration, round(arg_max(acc, iteration), 6) AS last_acc, sum(time)::BIGINT AS total_time FROM i""")
def run_summary(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    per = rows.groupBy((F.col("doc_id") % 10).alias("iteration")).agg(F.avg("quality").alias("acc"), F.sum("n_chars").alias("time"))
    return ev.run_summary(per).withColumn("last_acc", F.round("last_acc", 6))
