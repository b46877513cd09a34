"""The stored index: rounds, versions, pruned folders, jobs that died."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvine.operators import cluster, knn, stored_ivf
from curvine.sources.sinks import scratch_folder


@pytest.fixture(scope="module")
def rounds(spark, vectors):
    df, _, _ = vectors
    df = df.drop("label")
    index = stored_ivf.build_index(df.filter("vec_id < 200"), cluster.sample_rows(df, 12), scratch_folder(spark))
    first = stored_ivf.append_round(index, df.filter("vec_id >= 200 AND vec_id < 250"))
    second = stored_ivf.append_round(first, df.filter("vec_id >= 250"))
    return df, index, first, second


def near(frame):
    return sorted((r.query_id, r.rank, r.neighbor_id, r.dist) for r in frame.collect())


def brute(x, centers, upto, k, nprobe):
    """Nearest rows in the nearest cells that hold rows."""
    own = ((x[:upto, None] - centers[None]) ** 2).sum(2).argmin(1)
    filled = np.unique(own)
    out = []
    for q in range(len(x)):
        cells = filled[np.argsort(((x[q] - centers[filled]) ** 2).sum(1), kind="stable")[:nprobe]]
        rows = [(((x[q] - x[i]) ** 2).sum(), i) for i in range(upto) if own[i] in cells and i != q]
        out += [(q, r + 1, int(i)) for r, (_, i) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def test_rounds_equal_brute_force_and_a_rebuild(spark, rounds, vectors):
    df, index, first, second = rounds
    _, x, _ = vectors
    centers = np.array([r.centroid for r in index.centroids.orderBy("cid").collect()])
    for at, upto in ((index, 200), (first, 250), (second, 300)):
        got = near(stored_ivf.search(at, df, 5, 3, exclude_self=True))
        assert [g[:3] for g in got] == brute(x, centers, upto, 5, 3)
    rebuilt = stored_ivf.build_index(df, index.centroids, scratch_folder(spark))
    assert near(stored_ivf.search(rebuilt, df, 5, 3, exclude_self=True)) == near(stored_ivf.search(second, df, 5, 3, exclude_self=True))


def test_only_new_rows_are_written(rounds):
    df, index, first, second = rounds
    assert {r["round"]: r["count"] for r in second.vectors.groupBy("round").count().collect()} == {0: 200, 1: 50, 2: 50}
    again = stored_ivf.append_round(second, df)
    assert again == second
    assert second.sizes().agg(F.sum("n")).first()[0] == 300


def test_a_search_reads_the_probed_folders_only(rounds, capsys):
    df, _, _, second = rounds
    few = df.filter("vec_id = 7")
    cells = sorted(r.cid for r in stored_ivf.probed_cells(second, few, 2).collect())
    found = stored_ivf.search(second, few, 5, 2)
    found.explain("formatted")
    plan = capsys.readouterr().out
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line and "cid" in line]
    assert filters and all("cid#" in f for f in filters) and any(all(str(c) in f for c in cells) for f in filters)


def test_a_job_that_died_is_not_seen_and_may_be_repeated(spark, vectors):
    df, _, _ = vectors
    path = scratch_folder(spark)
    index = stored_ivf.build_index(df.filter("vec_id < 100"), cluster.sample_rows(df, 5), path)
    # vectors of round 1 without its entry in the rounds
    df.filter("vec_id >= 290").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.lit(3).alias("cid")).write.partitionBy("cid").parquet(f"{path}/cells/version=0/round=1")
    seen = stored_ivf.open_index(spark, path)
    assert seen == index and seen.vectors.count() == 100
    after = stored_ivf.append_round(seen, df.filter("vec_id >= 100 AND vec_id < 110"))
    assert after.round == 1 and after.vectors.count() == 110


def test_refresh_appends_or_rebuilds(spark, vectors):
    df, _, _ = vectors
    path = scratch_folder(spark)
    index = stored_ivf.build_index(df.filter("vec_id < 220"), cluster.sample_rows(df, 5), path)
    grown = stored_ivf.refresh_index(index, df)
    assert (grown.version, grown.round, grown.vectors.count()) == (0, 1, 300)
    # a row went away: a new version, and the old one still answers
    shrunk = stored_ivf.refresh_index(grown, df.filter("vec_id > 0"))
    assert (shrunk.version, shrunk.round, shrunk.vectors.count()) == (1, 0, 299)
    assert stored_ivf.open_index(spark, path, 0).vectors.count() == 300
    assert stored_ivf.open_index(spark, path) == shrunk
    # more new rows than the rule allows
    small = stored_ivf.build_index(df.filter("vec_id < 50"), cluster.sample_rows(df, 5), path)
    assert stored_ivf.refresh_index(small, df).version == small.version + 1


def test_compaction_keeps_the_answers(rounds):
    df, _, _, second = rounds
    one = stored_ivf.compact(second)
    assert one.round == 0 and one.version > second.version
    assert near(stored_ivf.search(one, df, 4, 3)) == near(stored_ivf.search(second, df, 4, 3))


def test_wrong_widths_and_missing_indexes(spark, rounds):
    _, _, _, second = rounds
    wrong = spark.createDataFrame([(900, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="dimensions"):
        stored_ivf.append_round(second, wrong)
    with pytest.raises(ValueError, match="no index"):
        stored_ivf.open_index(spark, scratch_folder(spark))


def test_rule_counts_new_rows_among_the_current_ones(spark):
    ids = spark.range(100).select("id")
    for previous, reuse in ((70, False), (71, True), (100, True)):
        assert knn.ivf_refresh(ids.filter(F.col("id") < previous), ids).first()["reuse"] is reuse
    assert knn.ivf_refresh(ids, ids.filter("id > 0")).first()["reuse"] is False
