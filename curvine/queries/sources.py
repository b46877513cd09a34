"""Readers, writers and streams, fed with files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from curvine.functions import vectors as V
from curvine.functions.hashing import in_sample, sign_matrix, sign_matrix_sql
from curvine.operators import cluster, knn
from curvine.queries.joins import KL_XY, L2_XY, LABELED_SEED, LABELED_SHARE, PROBS_SQL, initial, knn_sql, with_clusters_sql
from curvine.queries.oods import KNOWN, KTH, TRAIN_SQL, vote_sql
from curvine.queries.registry import E_SQL, dot_sql, embeddings, query, table
from curvine.sources import embeddings as E
from curvine.sources import sinks
from curvine.sources import texts as T
from curvine.streaming import jobs, stateful


@query("source_matrix", "SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, len(embedding)::BIGINT AS dim FROM embeddings")
def source_matrix(spark, d):
    folder = sinks.scratch_folder(spark)
    E.write_matrix(embeddings(spark, d), folder)
    back = E.read_matrix(spark, folder, rowsPerTask=128)
    return back.select("vec_id", F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[63].cast("double").alias("last"), F.size("embedding").cast("bigint").alias("dim"))


@query("source_jsonl", "SELECT d.text AS sentence, l.quality::VARCHAR AS label FROM documents d JOIN labels l USING (doc_id)")
def source_jsonl(spark, d):
    folder = sinks.scratch_folder(spark)
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    rows.select(F.col("text").alias("sentence"), F.col("quality").cast("string").alias("label")).write.json(f"{folder}/train.jsonl")
    return T.read_jsonl(spark, folder, "train")


# Texts with their white space joined into single blanks, so that a line holds one row.
FLAT = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def _flat(col):
    return F.trim(F.regexp_replace(col, r"\s+", " "))


@query("source_text_pairs", f"SELECT {FLAT.format('d.text')} AS text_a, {FLAT.format('b.text')} AS text_b, l.quality::VARCHAR AS label FROM documents d JOIN labels l USING (doc_id) JOIN documents b ON b.doc_id = d.doc_id + 1")
def source_text_pairs(spark, d):
    """Tab-separated question pairs with a header."""
    folder = sinks.scratch_folder(spark)
    docs = table(spark, d, "documents").select("doc_id", _flat("text").alias("q1"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("q1").alias("q2"))
    rows = docs.join(table(spark, d, "labels"), "doc_id").join(nxt, "doc_id")
    out = rows.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("qid1"), F.col("doc_id").alias("qid2"), "q1", "q2", "quality")
    out.write.csv(folder, sep="\t", header=True, quote="", escapeQuotes=False)
    return T.read_text_task(spark, folder, "qqp")


@query("source_text_csv", "SELECT text AS text_a, NULL::VARCHAR AS text_b, lang AS label FROM documents")
def source_text_csv(spark, d):
    folder = sinks.scratch_folder(spark)
    docs = table(spark, d, "documents").select("text", F.col("lang").alias("label"))
    docs.write.csv(folder, header=True, escape='"')
    return T.read_text_task(spark, folder, "ag_news")


@query("source_quoted_csv", "SELECT doc_id, source, text FROM documents")
def source_quoted_csv(spark, d):
    """Texts with line breaks and quotes, from files that many tasks read."""
    from curvine.sources.quoted import read_quoted_csv

    folder = sinks.scratch_folder(spark)
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    docs.write.csv(folder, header=True, escape='"', quoteAll=True, emptyValue="", lineSep="\n")
    return read_quoted_csv(spark, folder, "doc_id bigint, source string, text string")


@query("source_question_lines", "SELECT role AS label, count(*) AS n FROM conversations GROUP BY role")
def source_question_lines(spark, d):
    folder = sinks.scratch_folder(spark)
    lines = table(spark, d, "conversations").select(F.concat(F.col("role"), F.lit(":x "), _flat("text")).alias("line"))
    lines.write.csv(folder, sep="\u0001", quote="", escapeQuotes=False, encoding="ISO-8859-1")
    return T.read_question_lines(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("source_xy_json", "SELECT text, source AS label FROM documents")
def source_xy_json(spark, d):
    """One array per document: a one-element list of texts and one of labels."""
    folder = sinks.scratch_folder(spark)
    arrays = table(spark, d, "documents").select(F.to_json(F.array(F.array("text"), F.array("source"))).alias("value"))
    arrays.write.text(folder)
    return T.read_xy_json(spark, folder, per_line=True).select("text", "label")


@query("source_libsvm", "SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def source_libsvm(spark, d):
    from pyspark.ml.functions import array_to_vector

    folder = sinks.scratch_folder(spark)
    rows = embeddings(spark, d).select((F.col("label") + 1).cast("double").alias("label"), array_to_vector(V.doubles("embedding")).alias("features"))
    rows.write.format("libsvm").save(folder)
    back = T.read_libsvm(spark, folder, signed=False, dim=64)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("features")[0]), 6).alias("first"))


@query("sink_partitions", with_clusters_sql(5) + " SELECT cid::INTEGER AS cid, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM a GROUP BY cid")
def sink_partitions(spark, d):
    emb = embeddings(spark, d)
    folder = sinks.scratch_folder(spark)
    sinks.write_partitions(knn.assign(emb, initial(emb, 5)).select("vec_id", "cid"), folder, "cid")
    return spark.read.parquet(folder).groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("sink_metrics", "SELECT label, n, r FROM (SELECT label::BIGINT AS label, count(*) AS n FROM embeddings GROUP BY label), (VALUES ('a'), ('b')) t(r)")
def sink_metrics(spark, d):
    folder = sinks.scratch_folder(spark)
    counts = embeddings(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    for run in ("a", "b"):
        sinks.append_metrics(counts.withColumn("r", F.lit(run)), folder)
    return spark.read.schema("label bigint, n bigint, r string").json(folder)


# --- streams ------------------------------------------------------------------------

ARRIVAL = "vec_id bigint, embedding array<float>, label int"


def _arrivals(spark, d):
    """The table, a file or a folder of files (a stream takes either by a glob only).

    All files come in one batch: a vote looks at the anchors that have come so far, the SQL at all.
    """
    return jobs.read_arrivals(spark, f"{d}/[e]mbeddings.parquet", "*", ARRIVAL, files_per_batch=None)


@query("stream_assign", with_clusters_sql(10) + " SELECT vec_id, label, cid, cdist FROM a")
def stream_assign(spark, d):
    folder = sinks.scratch_folder(spark)
    centroids = knn.centroid_matrix(cluster.sample_rows(embeddings(spark, d), 10))
    jobs.assign_stream(_arrivals(spark, d), *centroids, f"{folder}/out", f"{folder}/progress", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("stream_ood_score", TRAIN_SQL + f", nn AS {knn_sql(L2_XY, KTH, 'e', 'tr', 'x.vec_id <> y.vec_id')} SELECT e.vec_id, -nn.dist AS score FROM e LEFT JOIN nn ON nn.query_id = e.vec_id AND nn.rank = {KTH}")
def stream_ood_score(spark, d):
    folder = sinks.scratch_folder(spark)
    train = embeddings(spark, d).filter(F.col("label") < KNOWN)
    jobs.ood_score_stream(_arrivals(spark, d), train, KTH, f"{folder}/out", f"{folder}/progress", once=True, exclude_self=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("vec_id", "score")


@query("stream_anchor_vote", PROBS_SQL + f", nn AS {knn_sql(KL_XY, 5, 'lq', 'lk')} SELECT * FROM {vote_sql('nn')}")
def stream_anchor_vote(spark, d):
    folder = sinks.scratch_folder(spark)
    known = in_sample("vec_id", LABELED_SHARE, LABELED_SEED)
    rows = _arrivals(spark, d).select("vec_id", F.when(known, F.col("label")).alias("label"), V.softmax(V.scale("embedding", F.lit(4.0))).alias("p"))
    jobs.anchor_stream(
        rows, f"{folder}/anchors", f"{folder}/out", f"{folder}/progress", 5, id_col="vec_id", label_col="label", prob_col="p", once=True
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("query_id", "pred")


# --- streams with state -------------------------------------------------------------

STEPS = 3


def _in_steps(rows, spark, run) -> None:
    """Hand over the rows ``(..., step)`` one step after the other; every step goes on from the checkpoint of the one before."""
    folder = sinks.scratch_folder(spark)
    schema = rows.drop("step").schema
    for step in range(STEPS):
        rows.filter(F.col("step") == step).drop("step").write.mode("append").parquet(f"{folder}/arrivals")
        run(spark.readStream.schema(schema).parquet(f"{folder}/arrivals"), folder).awaitTermination()


FILTER_BITS, FILTER_SIM, FILTER_KEEP = 4, 0.3, 300
_FILTER_SQL = f"""WITH RECURSIVE {E_SQL}, pl AS ({sign_matrix_sql(FILTER_BITS, 64, 21)}),
coded AS (SELECT vec_id, v, (SELECT sum(CASE WHEN {dot_sql('signs', 'v')} >= 0 THEN 1::BIGINT << ({FILTER_BITS} - 1 - row) ELSE 0 END) FROM pl) AS bucket FROM e),
lined AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY vec_id) AS r FROM coded),
walk AS (
  SELECT bucket, 0::BIGINT AS r, []::STRUCT(id BIGINT, v DOUBLE[])[] AS kept FROM (SELECT DISTINCT bucket FROM coded)
  UNION ALL
  SELECT w.bucket, x.r, CASE WHEN len(list_filter(w.kept, lambda k: k.id > x.vec_id - {FILTER_KEEP} AND {dot_sql('k.v', 'x.v')} > {FILTER_SIM})) = 0
    THEN list_append(w.kept, struct_pack(id := x.vec_id, v := x.v)) ELSE w.kept END
  FROM walk w JOIN lined x ON x.bucket = w.bucket AND x.r = w.r + 1
)
SELECT k.id AS vec_id FROM (SELECT unnest(kept) AS k FROM walk QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY r DESC) = 1)"""


@query("stream_near_duplicates", _FILTER_SQL)
def stream_near_duplicates(spark, d):
    """Vectors arrive one a second in three steps, and survivors of the last 300 seconds count."""
    emb = embeddings(spark, d)
    last = emb.agg(F.max("vec_id")).scalar()
    rows = emb.select("vec_id", "embedding", F.timestamp_seconds(F.col("vec_id") + 1_700_000_000).alias("ts"), F.floor(STEPS * F.col("vec_id") / (last + 1)).alias("step"))
    planes, out = sign_matrix(FILTER_BITS, 64, 21), []

    def run(arrivals, folder):
        out[:] = [f"{folder}/out"]
        return stateful.near_duplicate_stream(arrivals, planes, FILTER_BITS, FILTER_SIM, out[0], f"{folder}/progress", keep=f"{FILTER_KEEP} seconds", once=True)

    _in_steps(rows, spark, run)
    return spark.read.parquet(out[0]).select(F.col("id").alias("vec_id"))


# Every eleventh event arrives one step late; the steps are thirds of the time, a window is a day, and two days may pass.
_LATE_SQL = f"""WITH r AS (SELECT *, epoch_us(ts) AS us, epoch_us(min(ts) OVER ()) AS low, epoch_us(max(ts) OVER ()) AS high FROM events),
s AS (SELECT *, least({STEPS - 1}, {STEPS} * (us - low) // (high - low + 1) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS step, us - us % 86400000000 AS start FROM r),
m AS (SELECT step, max(us) AS most FROM s GROUP BY step),
w AS (SELECT a.step, coalesce(max(b.most), 172800000000) - 172800000000 AS mark FROM m a LEFT JOIN m b ON b.step < a.step GROUP BY a.step),
g AS (SELECT start, event_type, count(value) AS n, count(*) FILTER (value > 30) AS n_flagged, sum(round(value * 1000)::HUGEINT)::DOUBLE AS t, sum((round(value * 1000)::HUGEINT) * (round(value * 1000)::HUGEINT))::DOUBLE AS q
  FROM s JOIN w USING (step) WHERE (start + 86400000000) // 1000 > mark // 1000 GROUP BY start, event_type)
SELECT strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, n_flagged, round(t / n / 1000, 9) AS mean,
  round(sqrt(greatest(q / n - (t / n) * (t / n), 0)) / 1000, 9) AS std, round(n_flagged::DOUBLE / n, 9) AS flagged_share
FROM g WHERE (start + 86400000000) // 1000 <= (SELECT max(us) - 172800000000 FROM s) // 1000"""


@query("stream_window_stats", _LATE_SQL)
def stream_window_stats(spark, d):
    """Daily statistics by event type of events that come in three steps, some of them a step late."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = F.floor((F.unix_micros("ts") - low) * STEPS / F.lit(high - low + 1)) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)
    out = []

    def run(arrivals, folder):
        out[:] = [f"{folder}/out"]
        return stateful.window_stats_stream(arrivals, F.col("value") > 30, out[0], f"{folder}/progress", late="2 days", by=("event_type",), once=True)

    _in_steps(events.withColumn("step", F.least(step, F.lit(STEPS - 1))), spark, run)
    found = spark.read.parquet(out[0])
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "n_flagged", *[F.round(c, 9).alias(c) for c in ("mean", "std", "flagged_share")]
    )
