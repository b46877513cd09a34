"""Vector functions and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import sign_matrix, sign_matrix_sql
from curvine.operators.knn import project_rows
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, softmax_sql, sq_l2_sql

# Every vector is compared with its own reversal, so each row makes one pair.
REV_SQL = f"WITH {E_SQL}, p AS (SELECT vec_id, label, v AS a, list_reverse(v) AS b FROM e)"


def _pairs(spark, d):
    return embeddings(spark, d).select("vec_id", "label", V.doubles("embedding").alias("a"), V.doubles(F.reverse("embedding")).alias("b"))


# Probability rows: softmax of the whole vector times 4, and of its reversal.
PROB_SQL = REV_SQL + f""", s AS (SELECT vec_id, label,
  {softmax_sql('list_transform(a, lambda x: x * 4)')} AS p, {softmax_sql('list_transform(b, lambda x: x * 4)')} AS q FROM p)"""


def _probs(spark, d):
    return _pairs(spark, d).select(
        "vec_id", "label", V.softmax(V.scale("a", F.lit(4.0))).alias("p"), V.softmax(V.scale("b", F.lit(4.0))).alias("q")
    )


@query("vec_dot", REV_SQL + f" SELECT vec_id, {dot_sql('a', 'b')} AS dot FROM p")
def vec_dot(spark, d):
    return _pairs(spark, d).select("vec_id", V.dot("a", "b").alias("dot"))


@query("vec_normalize", REV_SQL + f""", n AS (SELECT vec_id, a, sqrt({dot_sql('a', 'a')}) AS norm FROM p)
SELECT vec_id, norm, list_transform(a, lambda x: round(x / (norm + 1e-8), 9)) AS unit FROM n""")
def vec_normalize(spark, d):
    return _pairs(spark, d).select(
        "vec_id", V.l2_norm("a").alias("norm"), V.round_all(V.l2_normalize("a", 1e-8), 9).alias("unit")
    )


@query("vec_cosine", REV_SQL + f""", n AS (SELECT vec_id, {dot_sql('a', 'b')} / (sqrt({dot_sql('a', 'a')}) * sqrt({dot_sql('b', 'b')})) AS c FROM p)
SELECT vec_id, c AS cosine_sim, 1.0::DOUBLE - c AS cosine_dist FROM n""")
def vec_cosine(spark, d):
    return _pairs(spark, d).select("vec_id", V.cosine_sim("a", "b").alias("cosine_sim"), V.cosine_dist("a", "b").alias("cosine_dist"))


@query("vec_l2", REV_SQL + f" SELECT vec_id, {sq_l2_sql('a', 'b')} AS sq_l2, sqrt({sq_l2_sql('a', 'b')}) AS l2 FROM p")
def vec_l2(spark, d):
    return _pairs(spark, d).select("vec_id", V.sq_l2("a", "b").alias("sq_l2"), V.l2("a", "b").alias("l2"))


@query("vec_lp", REV_SQL + """ SELECT vec_id,
  list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) AS l1,
  round(pow(list_sum(list_transform(list_zip(a, b), lambda p: pow(abs(p[1] - p[2]), 3.0))), 1.0::DOUBLE / 3.0), 6) AS l3 FROM p""")
def vec_lp(spark, d):
    return _pairs(spark, d).select("vec_id", V.l1("a", "b").alias("l1"), F.round(V.minkowski("a", "b", 3), 6).alias("l3"))


@query("cosine_from_l2", REV_SQL + f""", c AS (SELECT vec_id, {sq_l2_sql('a', 'b')} AS d2, sqrt({dot_sql('a', 'a')}) AS na, sqrt({dot_sql('b', 'b')}) AS nb FROM p)
SELECT vec_id, round(least(greatest(0.5 * (na * na + nb * nb - d2) / greatest(na * nb, 1e-12), -1.0), 1.0), 9) AS cosine FROM c""")
def cosine_from_l2(spark, d):
    carried = _pairs(spark, d).select("vec_id", V.sq_l2("a", "b").alias("d2"), V.l2_norm("a").alias("na"), V.l2_norm("b").alias("nb"))
    return carried.select("vec_id", F.round(V.cosine_from_sq_l2("d2", "na", "nb"), 9).alias("cosine"))


@query("vec_softmax", REV_SQL + f""", s AS (SELECT vec_id, {softmax_sql('a')} AS p,
  list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))) AS lse, a FROM p)
SELECT vec_id, list_transform(p, lambda x: round(x, 9)) AS softmax, round(lse, 6) AS logsumexp,
  list_transform(a, lambda x: round(x - lse, 6)) AS log_softmax FROM s""")
def vec_softmax(spark, d):
    return _pairs(spark, d).select(
        "vec_id", V.round_all(V.softmax("a"), 9).alias("softmax"), F.round(V.logsumexp("a"), 6).alias("logsumexp"),
        V.round_all(V.log_softmax("a"), 6).alias("log_softmax"),
    )


@query("vec_kl", PROB_SQL + " SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda t: t[1] * (ln(t[1] + 1e-10) - ln(t[2] + 1e-10)))), 6) AS kl FROM s")
def vec_kl(spark, d):
    return _probs(spark, d).select("vec_id", F.round(V.kl_div("p", "q"), 6).alias("kl"))


@query("vec_kl_reuse", PROB_SQL + """ SELECT vec_id, round(list_sum(list_transform(p, lambda x: x * ln(x + 1e-10)))
  - list_sum(list_transform(list_zip(p, q), lambda t: t[1] * ln(t[2] + 1e-10))), 6) AS kl FROM s""")
def vec_kl_reuse(spark, d):
    ready = _probs(spark, d).select("vec_id", "p", V.neg_entropy("p").alias("ne"), V.log_smooth("q").alias("log_q"))
    return ready.select("vec_id", F.round(V.kl_from_parts("ne", "p", "log_q"), 6).alias("kl"))


@query("vec_jsd", PROB_SQL + """ SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda t:
  0.5 * (CASE WHEN t[1] > 0 THEN t[1] * (ln(t[1]) - ln((t[1] + t[2]) / 2)) ELSE 0 END)
  + 0.5 * (CASE WHEN t[2] > 0 THEN t[2] * (ln(t[2]) - ln((t[1] + t[2]) / 2)) ELSE 0 END))), 6) AS jsd FROM s""")
def vec_jsd(spark, d):
    return _probs(spark, d).select("vec_id", F.round(V.js_div("p", "q"), 6).alias("jsd"))


@query("vec_xent", REV_SQL + """ SELECT vec_id, round(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a))))) - a[label + 1], 6) AS loss FROM p""")
def vec_xent(spark, d):
    return _pairs(spark, d).select("vec_id", F.round(V.cross_entropy("a", "label"), 6).alias("loss"))


@query("vec_argmax", REV_SQL + """ SELECT vec_id, (list_position(a, list_max(a)) - 1)::BIGINT AS arg, list_max(a) AS top1,
  list_sort(a, 'DESC')[2] AS top2 FROM p""")
def vec_argmax(spark, d):
    first, second = V.top2("a")
    return _pairs(spark, d).select("vec_id", V.argmax("a").alias("arg"), first.alias("top1"), second.alias("top2"))


@query("random_projection", f"""WITH {E_SQL}, m AS ({sign_matrix_sql(8, 64, 42)})
SELECT vec_id, list(round({dot_sql('signs', 'v')} / sqrt(8.0::DOUBLE), 6) ORDER BY row) AS low FROM e CROSS JOIN m GROUP BY vec_id""")
def random_projection(spark, d):
    low = project_rows(embeddings(spark, d), sign_matrix(8, 64, 42))
    return low.select("vec_id", F.transform("embedding", lambda x: F.round(x / F.sqrt(F.lit(8.0)), 6)).alias("low"))


@query("vec_slice", REV_SQL + " SELECT vec_id, a[49:64] AS last_block, list_concat(a[49:64], b[1:16]) AS joined FROM p")
def vec_slice(spark, d):
    last = F.slice("a", 49, 16)
    return _pairs(spark, d).select("vec_id", last.alias("last_block"), F.concat(last, F.slice("b", 1, 16)).alias("joined"))


@query("masked_softmax", REV_SQL + f""", k AS (SELECT vec_id, list_transform(a, lambda x: CASE WHEN x > -0.05 THEN x END) AS kept, a FROM p),
s AS (SELECT vec_id, list_transform(kept, lambda x: CASE WHEN x IS NULL THEN 0.0::DOUBLE ELSE exp(x - list_max(kept)) END) AS ex,
  list_transform({softmax_sql('a')}, lambda x, i: CASE WHEN kept[i] IS NULL THEN 0.0::DOUBLE ELSE x END) AS pk FROM k)
SELECT vec_id, list_transform(ex, lambda x: round(x / list_sum(ex), 9)) AS masked, list_transform(pk, lambda x: round(x / list_sum(pk), 9)) AS renormalized FROM s""")
def masked_softmax(spark, d):
    mask = F.transform("a", lambda x: x > F.lit(-0.05))
    return _pairs(spark, d).withColumn("m", mask).select(
        "vec_id", V.round_all(V.masked_softmax("a", "m"), 9).alias("masked"),
        V.round_all(V.renormalize_masked(V.softmax("a"), "m"), 9).alias("renormalized"),
    )


GRAD_SQL = REV_SQL + f", g AS (SELECT vec_id, label, b, {softmax_sql('list_transform(a[1:10], lambda x: x * 8)')} AS p FROM p)"


def _class_probs(spark, d):
    return _pairs(spark, d).select("vec_id", "label", "b", V.softmax(V.scale(F.slice("a", 1, 10), F.lit(8.0))).alias("p"))


@query("grad_proxy", GRAD_SQL + " SELECT vec_id, label, list_transform(p, lambda x, i: round(x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END, 6)) AS g FROM g")
def grad_proxy(spark, d):
    return _class_probs(spark, d).select("vec_id", "label", V.round_all(V.minus_onehot("p", "label")).alias("g"))


@query("badge_embedding", GRAD_SQL + """, s AS (SELECT vec_id, b, list_transform(p, lambda x, i: x - CASE WHEN i = list_position(p, list_max(p)) THEN 1 ELSE 0 END) AS sc FROM g)
SELECT vec_id, flatten(list_transform(sc, lambda s: list_transform(b, lambda h: round(s * h, 6) + 0.0::DOUBLE))) AS badge FROM s""")
def badge_embedding(spark, d):
    probs = _class_probs(spark, d)
    scales = V.minus_onehot("p", V.argmax("p"))
    return probs.select("vec_id", V.round_all(V.outer_flat(scales, "b")).alias("badge"))
