import os
import subprocess
import sys
import tempfile
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.functions import kernels
from curvine.operators import active, cluster, evaluation, knn, ood
from curvine.functions import text as T
from curvine.plans import blocks
from curvine.plans.bounded import TooLarge
from curvine.session import checkpoint
from curvine.sources import embeddings as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from curvine.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
from curvine.operators import knn
rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id bigint, embedding array<double>")
print("ROWS", knn.knn_join(rows, rows, 2, within=None).count(), knn.max_similarity(rows, within=None).count())
"""


def test_tasks_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ROWS 18 9" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("path,kind,name", [("/a/b", "local", "/a/b"), ("file:/a/b", "local", "/a/b"), ("file:///a/b", "local", "/a/b"), ("a/b:c", "local", "a/b:c")])
def test_local_uris(path, kind, name):
    system, inside = E.open_uri(path)
    assert system.type_name == kind and inside == name


def test_hadoop_schemes_have_an_arrow_name():
    assert E._SCHEMES["s3a"] == "s3" and E._SCHEMES["abfss"] == "abfs"


def test_a_raw_matrix_with_a_cut_row_fails(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.zeros(7, "<f4").tobytes())
    with pytest.raises(Exception, match="ends inside a row"):
        E.read_matrix(spark, str(tmp_path), dim=2).count()


def test_small_base_and_blocks_give_the_same_neighbours(spark, vectors, monkeypatch):
    df, _, _ = vectors
    base, queries = df.filter("vec_id < 120"), df.filter("vec_id >= 100")
    for metric in ("sq_l2", "cosine", "ip"):
        monkeypatch.setattr(knn, "SMALL_BYTES", 1 << 24)
        small = knn.knn_join(queries, base, 4, metric, exclude_self=True)
        assert "Exchange hashpartitioning(g" not in small._jdf.queryExecution().toString()
        monkeypatch.setattr(knn, "SMALL_BYTES", 0)
        cut = knn.knn_join(queries, base, 4, metric, exclude_self=True, block_rows=50)
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, cut.collect()))


def test_wide_rows_make_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 8 * 5000 * 6)
    monkeypatch.setattr(knn, "SMALL_BYTES", 0)
    rng = np.random.default_rng(0)
    x = rng.random((20, 5000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    seen = df.select(blocks._row_limit(df.select(F.col("embedding").alias("vec")), 16384).alias("n")).first()["n"]
    assert seen == 6
    got = {(r.query_id, r.neighbor_id) for r in knn.knn_join(df, df, 1, "sq_l2", exclude_self=True).collect()}
    dist = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(20, np.inf))
    assert got == {(i, int(j)) for i, j in enumerate(dist.argmin(axis=1))}


def test_kernels_of_one_base_serve_many_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    q, b = rng.random((40, 6)), rng.random((30, 6))
    for metric in ("ip", "cosine", "sq_l2", "kl", "cross", "l1"):
        whole = kernels.top_k(metric, q, b, 3)
        monkeypatch.setattr(kernels, "CHUNK_CELLS", 70)
        for one, two in zip(whole, kernels.top_k(metric, q, b, 3)):
            assert np.array_equal(one, two)
        monkeypatch.undo()


def test_all_terms_of_a_labelled_centred_score_count(spark):
    """A thousand zeros after the only term that is not."""
    n = 1040
    rows = [(1, i, 2.0**1000 if i == 0 else 0.0) for i in range(n)]
    div = spark.createDataFrame(rows, "query_id bigint, neighbor_id bigint, div double")
    fold = 0.0
    for _, _, d in rows:
        fold = (fold + d) / 2
    assert fold > 0 and active.labeled_centric_scores(div).first()["score"] == pytest.approx(fold, rel=1e-12)


def test_the_vocabulary_has_no_cap(spark):
    words = [f"w{i:05d}" for i in range(16_000)]
    df = spark.createDataFrame([(i, " ".join(words[i * 1000 : (i + 1) * 1000])) for i in range(16)], "doc_id bigint, text string")
    out = T.tfidf(df, id_col="doc_id", text_col="text", stop_words=["the"])
    assert out.count() == 16_000
    assert T.tfidf(df, id_col="doc_id", text_col="text", stop_words=["the"], max_terms=50).count() == 50


def test_exact_joint_tables_do_not_turn_into_samples(spark):
    p = [0.7, 0.3, 0.2, 0.8]
    df = spark.createDataFrame([(i, p) for i in range(6)], "vec_id bigint, probs array<double>")
    with pytest.raises(TooLarge):
        active.batchbald_select(df, 5, samples=2, classes=2, max_configs=8)
    assert active.batchbald_select(df, 5, samples=2, classes=2, method="sampled", max_configs=8).count() == 5


def test_recall_at_the_quantile_itself(spark):
    exact = spark.createDataFrame([(i, float(i)) for i in range(21)], "vec_id bigint, dist double")
    approx = spark.createDataFrame([(i, float(i) if i != 20 else 0.0) for i in range(21)], "vec_id bigint, dist double")
    row = ood.flag_recall(exact, approx).first()
    assert (row["flagged"], row["both"], row["recall"]) == (2, 1, 0.5)
    none = ood.flag_recall(exact.withColumn("dist", F.lit(None).cast("double")), approx).first()
    assert (none["flagged"], none["recall"]) == (0, 1.0)


def test_dispersion_sums_do_not_overflow(spark):
    df = spark.createDataFrame([(i, i % 2, [3e5 * (1 + i % 2), float(i)]) for i in range(40)], "vec_id bigint, cid int, embedding array<double>")
    row = cluster.calinski_harabasz(df).first()
    x = np.array([[3e5 * (1 + i % 2), float(i)] for i in range(40)])
    means = np.array([x[0::2].mean(axis=0), x[1::2].mean(axis=0)])
    between = sum(20 * ((m - x.mean(axis=0)) ** 2).sum() for m in means)
    within = sum(((x[k::2] - means[k]) ** 2).sum() for k in (0, 1))
    assert row["score"] == pytest.approx(between / (within / 38), rel=1e-3)


def brute_sari(source, prediction, references):
    grams = lambda text, n: Counter(tuple(text.split()[i : i + n]) for i in range(len(text.split()) - n + 1))
    share = lambda a, b: sum(a.values()) / sum(b.values()) if b else 0.0
    total = 0.0
    for reference in references:
        for n in range(1, 5):
            s, p, r = grams(source, n), grams(prediction, n), grams(reference, n)
            precision, recall = share(s & p & r, s & p), share(s & p & r, s & r)
            kept = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
            total += kept + share((p - s) & (r - s), p - s) + share((s - p) & (s - r), s - p)
    return total / 4 / 3 * 100 / len(references) if references else 0.0


def test_sari_counts_references_of_any_number(spark):
    rows = [
        (1, "about 95 species are currently accepted .", "about 95 you now get in .", ["about 95 species are currently known .", "about 95 species are now accepted .", "95 species are now accepted ."]),
        (2, "a b", "a b", []), (3, "a", "a", ["a"]), (4, "a b a b a", "a b c a", ["a a a", "", "b c a b c"]), (5, "", "", ["x y"]), (6, "a b c d e", "", ["a", "a b c d e"]),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, prediction string, references array<string>")
    got = {r["doc_id"]: r["sari"] for r in evaluation.sari(df, id_col="doc_id").collect()}
    for i, *texts in rows:
        assert got[i] == pytest.approx(brute_sari(*texts), abs=1e-9), i


def test_checkpoint_removes_its_shuffles(spark):
    import glob
    import time

    def files():
        top = spark.conf.get("spark.local.dir", tempfile.gettempdir())
        return set(glob.glob(f"{top}/blockmgr-*/*/shuffle_*"))

    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count()
    before, shuffled = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
    kept = checkpoint(rows)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == len(rows.collect()) == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == shuffled
