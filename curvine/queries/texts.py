"""Text preparation over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import text as T
from curvine.functions import vectors as V
from curvine.functions.hashing import id_hash_sql
from curvine.queries.registry import E_SQL, embeddings, query, table


@query("length_filter", "SELECT d.doc_id, length(d.text) >= 50 AS long_enough, coalesce(length(d.text) > 50 AND length(b.text) > 10, FALSE) AS usable_pair FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def length_filter(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("b"))
    return docs.join(bench, "doc_id", "left").select(
        "doc_id", T.long_enough("text", 50).alias("long_enough"), T.code_doc_filter("text", "b").alias("usable_pair")
    )


TURNS_SQL = "t AS (SELECT a.conv_id, a.turn, a.text AS original, b.text AS simple FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


def _turns(spark, d):
    talk = table(spark, d, "conversations").select("conv_id", "turn", "text")
    later = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("Simple"))
    return talk.withColumnRenamed("text", "Original").join(later, ["conv_id", "turn"])


@query("pair_prepare", rf"WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, regexp_replace(original, '^\s+|\s+$', '', 'g') AS o, regexp_replace(simple, '^\s+|\s+$', '', 'g') AS tgt FROM t) SELECT conv_id, turn, 'Simplify this sentence: ' || o AS src, tgt, 'simplification' AS task FROM s WHERE o <> '' AND tgt <> ''")
def pair_prepare(spark, d):
    return T.pair_prepare(_turns(spark, d), keep=["conv_id", "turn"])


# Token ids: character codes of the whole text.
IDS_SQL = "ids AS (SELECT doc_id, list_transform(string_split(text, ''), lambda c: unicode(c)) AS ids FROM documents)"


def _ids(spark, d):
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    return table(spark, d, "documents").select("doc_id", F.transform(chars, lambda c: F.ascii(c)).alias("ids"))


@query("pad_clamp_ids", f"WITH {IDS_SQL}, c AS (SELECT doc_id, list_transform(ids, lambda t: greatest(least(t, 199), 0))[1:256] AS c FROM ids) SELECT doc_id, list_concat(c, list_transform(range(256 - len(c)), lambda x: 0)) AS input_ids FROM c")
def pad_clamp_ids(spark, d):
    return _ids(spark, d).select("doc_id", T.pad_or_cut(T.clamp_ids("ids", 200), 256).alias("input_ids"))


def masking_sql(rate: float, mask_id: int, vocab: int, special: int) -> str:
    draw = lambda salt, buckets: f"({id_hash_sql(f'doc_id * {T.POSITIONS} + i - 1', salt)} % {buckets})"
    chosen = f"(t <> {special} AND {draw(1, 1_000_000)} < {int(rate * 1_000_000)})"
    kind = draw(2, 10)
    return f"""SELECT doc_id, list_transform(ids, lambda t, i: CASE WHEN NOT {chosen} THEN t WHEN {kind} < 8 THEN {mask_id} WHEN {kind} = 8 THEN ({draw(3, vocab)})::INTEGER ELSE t END) AS input_ids,
list_transform(ids, lambda t, i: CASE WHEN {chosen} THEN t ELSE -100 END) AS labels FROM ids"""


@query("mlm_masking", f"WITH {IDS_SQL} " + masking_sql(0.15, 103, 1000, 32))
def mlm_masking(spark, d):
    return T.mask_texts(table(spark, d, "documents"), "doc_id", "text", mask_id=103, vocab=1000, special=[32])


WORD_SQL = "(CASE quality WHEN 0 THEN 'negative' WHEN 1 THEN 'positive' END)"


@query("prompt_render", f"""WITH x AS (SELECT d.doc_id, d.lang, d.text, quality, {WORD_SQL} AS w FROM documents d LEFT JOIN labels USING (doc_id)),
demo AS (SELECT lang, string_agg('Review: ' || text || chr(10) || 'Sentiment: ' || w || chr(10) || chr(10), '' ORDER BY doc_id) AS demos FROM (SELECT * FROM x WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, quality ORDER BY {id_hash_sql('doc_id', 4)}, doc_id) <= 2) GROUP BY lang)
SELECT doc_id, md5(demos || 'Review: ' || text || chr(10) || 'Sentiment:') AS prompt, length(demos || 'Review: ' || text || chr(10) || 'Sentiment:')::BIGINT AS n_chars, quality AS label_id FROM x JOIN demo USING (lang)""")
def prompt_render(spark, d):
    """Every document as a query after two demonstrations per class in its own language."""
    from curvine.operators.prompting import few_shot_sample

    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("text").alias("sentence"))
    known = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = T.label_words(docs.join(known, "doc_id", "left"), "sst2", "label").withColumnRenamed("label_word", "word")
    with_class = rows.filter(F.col("word").isNotNull()).withColumn("cell", F.struct("lang", "label_id"))
    shots = few_shot_sample(with_class, 2, seed=4, id_col="doc_id", class_col="cell").select("doc_id")
    demos = rows.join(F.broadcast(shots), "doc_id").select(
        "lang", "doc_id", T.prompt("sst2", {"sentence": "sentence", "label": "word"}, mode="train").alias("demo")
    )
    joined = rows.join(T.join_demonstrations(demos, ["lang"], "demo", "doc_id"), "lang")
    full = F.concat("demonstrations", T.prompt("sst2", {"sentence": "sentence"}))
    return joined.select("doc_id", F.md5(full).alias("prompt"), F.length(full).cast("bigint").alias("n_chars"), "label_id")


STOP = ["and", "are", "for", "in", "of", "on", "that", "the", "to", "with"]


def tfidf_sql(limit: str) -> str:
    return r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term NOT IN (""" + ", ".join(f"'{w}'" for w in STOP) + r""") GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM c GROUP BY term """ + limit + r"""),
w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS w FROM c JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


@query("tfidf", tfidf_sql(""))
def tfidf(spark, d):
    out = T.tfidf(table(spark, d, "documents"), id_col="doc_id", text_col="text", stop_words=STOP)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# The bounded vocabulary is the feature.
@query("tfidf_top_terms", tfidf_sql("ORDER BY total DESC, term LIMIT 2000"))
def tfidf_top_terms(spark, d):
    out = T.tfidf(table(spark, d, "documents"), id_col="doc_id", text_col="text", stop_words=STOP, max_terms=2000)
    return out.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# A row's 64 elements as 8 tokens of 8 dimensions; a token with a negative first element is masked.
@query("masked_mean_pool", f"""WITH {E_SQL}, t AS (SELECT vec_id, list_transform(range(8), lambda k: v[(k * 8 + 1)::INT:(k * 8 + 8)::INT]) AS t FROM e), k AS (SELECT vec_id, list_filter(t, lambda x: x[1] >= 0) AS kept FROM t)
SELECT vec_id, list_transform(range(1, 9), lambda i: round(coalesce(list_sum(list_transform(kept, lambda x: x[i])), 0.0) / greatest(len(kept), 1e-9), 6)) AS pooled FROM k""")
def masked_mean_pool(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("v", k * 8 + 1, 8))
    rows = embeddings(spark, d).select("vec_id", V.doubles("embedding").alias("v")).select("vec_id", tokens.alias("t"))
    mask = F.transform("t", lambda x: (x[0] >= 0).cast("int"))
    return rows.withColumn("m", mask).select("vec_id", V.round_all(T.masked_mean_pool("t", "m")).alias("pooled"))


@query("center_and_cap", f"""WITH {E_SQL}, mu AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, sum(floor(v[i] * 1e9 + 0.5)::HUGEINT)::DOUBLE / 1e9 / count(*) AS m FROM e, range(1, 65) t(i) GROUP BY i))
SELECT vec_id, label, list_transform(list_zip(v, m), lambda p: round(p[1] - p[2], 6)) AS centered, list_transform(range(10), lambda c: (c = label)::INT::DOUBLE) AS onehot FROM e, mu QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 20""")
def center_and_cap(spark, d):
    out = T.center_and_cap(embeddings(spark, d), per_class=20, id_col="vec_id", class_col="label", vec_col="embedding")
    return out.withColumn("centered", V.round_all("centered"))
